"""Product codes of vectors in whole numbers, with a dictionary of the values of each dimension.

Vectors are kept in blocks. A block holds, for each dimension, its distinct values and for each vector the place of its value
among them. The distance of every distinct value to every codebook entry is tabulated once per block and round; distances of
parts are then gathered from these tables and added.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantmetrics.llm.vector_search import is_finite
from plantmetrics.session import materialise

STEP = 4096  # a component x becomes floor(STEP * x)
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 4096  # vectors in a block
LIMIT = 1 << 26  # components reach from -LIMIT to LIMIT, so that an error fits in 64 bits for up to 512 dimensions
BROADCAST_LABELS = 100_000  # sums of more labels are joined by an exchange
SALTS = 64

BLOCK_SCHEMA = "ids binary, labels binary, values array<binary>, places array<binary>"


# ---- blocks ------------------------------------------------------------------------------------------------------------


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(STEP * x), with zeros behind the last component up to ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * STEP)
    if len(scaled) and np.abs(scaled).max() > LIMIT:
        raise ValueError(f"a component lies beyond {LIMIT / STEP}; its squared distances would not be exact")
    rows = scaled.astype(np.int64).reshape(len(column), -1)
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def block_of(ids: pa.Array, labels: pa.Array, numbers: np.ndarray) -> dict:
    values, places = [], []
    for d in range(numbers.shape[1]):
        distinct, place = np.unique(numbers[:, d], return_inverse=True)
        values.append(distinct.tobytes())
        places.append(place.astype(np.uint16).tobytes())
    return {"ids": as_bytes(ids), "labels": as_bytes(labels), "values": values, "places": places}


def as_bytes(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([pa.field("c", column.type)])) as writer:
        writer.write_batch(pa.record_batch([column], ["c"]))
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column("c").combine_chunks()


class Block:
    """A stored block: ids, labels, and for each dimension its distinct values and the place of each vector's value."""

    def __init__(self, row: dict) -> None:
        self.row = row
        self.values = [np.frombuffer(v, np.int64) for v in row["values"]]
        self.places = [np.frombuffer(p, np.uint16) for p in row["places"]]
        self.size = len(self.places[0])

    def assign(self, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part (ties to the lower one) and its squared distance, each vectors x parts."""
        parts, entries, width = codebooks.shape
        codes = np.empty((self.size, parts), np.int64)
        errors = np.empty((self.size, parts), np.int64)
        for part in range(parts):
            total = np.zeros((self.size, entries), np.int64)
            for i in range(width):
                d = part * width + i
                table = (self.values[d][:, None] - codebooks[part, :, i]) ** 2
                total += table[self.places[d]]
            codes[:, part] = total.argmin(axis=1)
            errors[:, part] = total.min(axis=1)
        return codes, errors

    def sums(self, codes: np.ndarray, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Number of vectors of every entry, and the sums of their components."""
        parts, entries, width = shape
        counts = np.stack([np.bincount(codes[:, part], minlength=entries) for part in range(parts)])
        sums = np.zeros(shape, np.int64)
        for part in range(parts):
            for i in range(width):
                d = part * width + i
                # How often each value of the dimension meets each entry, times the value.
                n_values = len(self.values[d])
                met = np.bincount(codes[:, part] * n_values + self.places[d], minlength=entries * n_values)
                sums[part, :, i] = met.reshape(entries, n_values) @ self.values[d]
        return counts, sums


def read_blocks(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row)


# ---- the Spark jobs ----------------------------------------------------------------------------------------------------


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and vector of the rows whose vector is there, not empty, and free of nulls and non-finite components."""
    rows = embeddings.select("vec_id", "label", F.col("embedding").alias("vector"))
    return rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", is_finite))


def to_blocks(vectors: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                numbers = whole_numbers(piece.column("vector"), width)
                yield pa.RecordBatch.from_pylist(
                    [block_of(piece.column("vec_id"), piece.column("label"), numbers)],
                    pa.schema(
                        [("ids", pa.binary()), ("labels", pa.binary())]
                        + [(c, pa.list_(pa.binary())) for c in ("values", "places")]
                    ),
                )

    return materialise(vectors.mapInArrow(run, BLOCK_SCHEMA), "vector-blocks")


def improve(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: parts go to their nearest entries, whose new components are the floors of the means.

    Each task sums its vectors first and sends one row per part and entry; the driver receives PARTS x ENTRIES rows.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(codebooks)
    shape = codebooks.shape

    def run(batches):
        counts, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
        for block in read_blocks(batches):
            n, s = block.sums(block.assign(shared.value)[0], shape)
            counts += n
            sums += s
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(part, pa.int32()),
                "entry": pa.array(entry, pa.int32()),
                "n": pa.array(counts[part, entry], pa.int64()),
                "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
            }
        )

    partial = blocks.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    summed = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(shape[2])]).alias("sums")
    )
    better = codebooks.copy()
    for row in summed.collect():
        better[row["part"], row["entry"]] = np.array(row["sums"], np.int64) // row["n"]
    shared.unpersist()
    return better


def compress(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, codes and error of every vector that takes part, and the codebooks (parts x entries x components).

    A component x becomes floor(4096 * x); vectors are cut into ``parts`` equal runs. The codebook of a part starts as that
    part of the vectors with the smallest ids. In each round every part goes to its nearest entry (squared Euclidean distance,
    ties to the lower entry), and an entry becomes the componentwise floor of its parts' mean; unused ones stay. At last the
    parts are assigned once more; error is the sum of their squared distances.

    Rows with a null or empty vector, or with a null or non-finite component, take no part. The vector with the smallest id
    sets the length, and vectors of another length take no part either; a length that ``parts`` does not divide is filled up
    with zeros. A null id comes after all others, rows that repeat an id are ordered by their vectors and each take part. With
    fewer than ``entries`` vectors there are as many entries as vectors. A component beyond 16384 (LIMIT / STEP) is an error,
    as distances would leave 64 bits. Without vectors the result is empty. Other columns are not read.
    """
    valid = valid_vectors(embeddings)
    first = valid.select("vec_id", "vector").sort(F.asc_nulls_last("vec_id"), "vector").limit(1).collect()
    if not first:
        nothing = valid.filter("false")
        return nothing.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), (
            np.zeros((parts, 0, 0), np.int64)
        )
    size = len(first[0]["vector"])
    valid = valid.filter(F.size("vector") == size)
    width = -(-size // parts)
    starts = valid.select("vec_id", "vector").sort(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    numbers = whole_numbers(pa.array([r["vector"] for r in starts], pa.list_(pa.float64())), parts * width)
    codebooks = np.ascontiguousarray(numbers.reshape(len(starts), parts, width).transpose(1, 0, 2))

    blocks = to_blocks(valid, parts * width)
    for _ in range(rounds):
        codebooks = improve(blocks, codebooks)

    shared = blocks.sparkSession.sparkContext.broadcast(codebooks)
    id_type, label_type = (embeddings.schema[c].dataType for c in ("vec_id", "label"))

    def run(batches):
        for block in read_blocks(batches):
            codes, errors = block.assign(shared.value)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": from_bytes(block.row["ids"]),
                    "label": from_bytes(block.row["labels"]),
                    "codes": pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())),
                    "error": pa.array(errors.sum(axis=1), pa.int64()),
                }
            )

    schema = f"vec_id {id_type.simpleString()}, label {label_type.simpleString()}, codes array<int>, error long"
    return blocks.mapInArrow(run, schema), codebooks


def with_label_error(coded: DataFrame) -> DataFrame:
    """The coded vectors with label_error, the sum of error over rows of the same label; null labels are one label.

    The sums are small next to the rows. Up to BROADCAST_LABELS of them are sent to every task; more are joined by an exchange
    with salts, so that a label with a third of the rows is spread.
    """
    coded = materialise(coded, "vector-codes")
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    same = F.col("label").eqNullSafe(F.col("_label"))
    sums = sums.withColumnRenamed("label", "_label")
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), same).drop("_label")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    copies = sums.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, same & (F.col("_salt") == F.col("_copy"))).drop("_label", "_salt", "_copy")


def codebook_hash(codebooks: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers with commas between them."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()

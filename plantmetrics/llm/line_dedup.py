"""Line dedup: documents probe sharded minimal perfect hashes with compact arrays instead of joining lines."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plantmetrics.llm.common import BLANKS, lower_ascii, mix
from plantmetrics.session import materialise

MIN_CHARS = 10
KEYS_PER_SHARD = 100_000
PROBES_PER_TASK = 200_000
LOAD = 1.6  # bits per key in each level of a minimal perfect hash
NULL_ID = -(1 << 63)  # rows without an id count as one document, before all others


# ---- minimal perfect hash of one shard ---------------------------------------------------------------------------------


def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.array([level + 1], np.uint64))) % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> dict:
    """Levels of bits: a key that is alone in its slot of a level gets that bit, the others go on to the next level.

    The number of set bits before a key's bit is its index, so the indexes are 0 to n - 1 without gaps.
    """
    sizes, bits, left, level = [], [], np.unique(keys), 0
    while len(left):
        size = max(64, int(len(left) * LOAD))
        at = slots(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left, level = left[~alone[at]], level + 1
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return {"sizes": np.array(sizes, np.int64), "bits": flat, "ranks": np.cumsum(flat, dtype=np.int64) - flat}


def find(table: dict, keys: np.ndarray) -> np.ndarray:
    """Index of every key; an arbitrary one, or -1, for keys that were not built in."""
    index, start, open_ = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
    for level, size in enumerate(table["sizes"]):
        at = slots(keys[open_], level, int(size)) + start
        hit = table["bits"][at]
        index[open_[hit]] = table["ranks"][at[hit]]
        open_, start = open_[~hit], start + int(size)
    return index


def pack(keys: np.ndarray, prints: np.ndarray, owners: np.ndarray, counts: np.ndarray) -> dict[str, bytes]:
    """One shard as bytes: the hash, and fingerprint, owner and count arrays in the order of its indexes."""
    table = build_hash(keys)
    order = np.empty(len(keys), np.int64)
    order[find(table, keys)] = np.arange(len(keys))
    return {
        "sizes": table["sizes"].tobytes(),
        "bits": np.packbits(table["bits"]).tobytes(),
        "prints": prints[order].tobytes(),
        "owners": owners[order].tobytes(),
        "counts": counts[order].tobytes(),
    }


def unpack(row: dict[str, bytes]) -> dict:
    sizes = np.frombuffer(row["sizes"], np.int64)
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
    return {
        "sizes": sizes,
        "bits": bits,
        "ranks": np.cumsum(bits, dtype=np.int64) - bits,
        "prints": np.frombuffer(row["prints"], np.uint64),
        "owners": np.frombuffer(row["owners"], np.int64),
        "counts": np.frombuffer(row["counts"], np.int64),
    }


def owners_of(shard: dict, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the shard, and the document that keeps its lines."""
    if not len(shard["prints"]):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    index = find(shard, keys)
    known = (index >= 0) & (shard["prints"][index] == prints)
    return known, shard["owners"][index]


# ---- the Spark jobs ----------------------------------------------------------------------------------------------------

INDEX_SCHEMA = "shard int, load long, sizes binary, bits binary, prints binary, owners binary, counts binary"
BLOBS = ("sizes", "bits", "prints", "owners", "counts")


def line_key(line):
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key is long enough: owner id, a hash of the text, line number, two 64-bit hashes of the key."""
    rows = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("owner"),
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line_no", "line"),
    )
    keyed = rows.select("owner", "text_hash", "line_no", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        "owner", "text_hash", "line_no", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("fingerprint")
    )


def build_index(lines: DataFrame, keys_per_shard: int, probes_per_task: int) -> tuple[DataFrame, int]:
    """A table with one row per shard of the keys that several documents hold, and the number of shards.

    The keys are counted with partial sums before the exchange, so a line that stands everywhere is one row per task. The
    number of shards follows the counts, so a shard has about ``keys_per_shard`` keys and ``probes_per_task`` probes.
    """
    counted = lines.groupBy("h", "fingerprint").agg(
        F.min("owner").alias("first"), F.max("owner").alias("last"), F.count(F.lit(1)).alias("n")
    )
    seen = Observation()
    shared_key = F.col("first") < F.col("last")
    watched = counted.observe(seen, F.sum("n").alias("probes"), F.count_if(shared_key).alias("keys"))
    shared = materialise(watched.filter(shared_key), "shared-lines")
    sums = seen.get
    n_shards = max(1, -(-(sums["keys"] or 0) // keys_per_shard), -(-(sums["probes"] or 0) // probes_per_task))

    def pack_shard(key, group):
        h = group["h"].to_numpy().astype(np.int64).view(np.uint64)
        # Two keys that agree in the first hash are told apart by a second table of the same kind.
        order = np.argsort(h, kind="stable")
        first = np.ones(len(h), bool)
        first[1:] = h[order][1:] != h[order][:-1]
        rows = []
        for chosen in (order[first], order[~first]):
            while len(chosen):
                values = h[chosen]
                own = np.ones(len(chosen), bool)
                own[1:] = values[1:] != values[:-1]
                part, chosen = chosen[own], chosen[~own]
                blobs = pack(
                    h[part],
                    group["fingerprint"].to_numpy()[part].astype(np.int64).view(np.uint64),
                    group["first"].to_numpy()[part].astype(np.int64),
                    group["n"].to_numpy()[part].astype(np.int64),
                )
                rows.append({"shard": int(key[0]), "load": int(group["n"].to_numpy()[part].sum()), **blobs})
        return pd.DataFrame(rows, columns=["shard", "load", *BLOBS])

    in_shards = shared.withColumn("shard", F.pmod("h", F.lit(n_shards)).cast("int"))
    index = in_shards.groupBy("shard").applyInPandas(pack_shard, INDEX_SCHEMA)
    return materialise(index, "line-index"), n_shards


def dropped_lines(docs: DataFrame, min_chars: int, keys_per_shard: int, probes_per_task: int) -> DataFrame:
    """owner, text_hash and the numbers of the lines that go.

    The hashes of a document's lines are sent to the shards, and each task streams them past the shard's arrays, which come
    first in its sorted partition. Shards with many probes are copied to several salts, and their probes are dealt out by
    document.
    """
    lines = keyed_lines(docs, min_chars)
    index, n_shards = build_index(lines, keys_per_shard, probes_per_task)
    sizes = index.groupBy("shard").agg((F.sum("load") / probes_per_task + 1).cast("int").alias("salts"))
    probes = (
        lines.withColumn("shard", F.pmod("h", F.lit(n_shards)).cast("int"))
        .join(sizes, "shard")
        .select(
            "shard",
            F.pmod(F.xxhash64("owner", "text_hash"), F.col("salts")).cast("int").alias("salt"),
            F.lit(1).alias("kind"),
            "owner",
            "text_hash",
            "line_no",
            "h",
            "fingerprint",
            *[F.lit(None).cast("binary").alias(b) for b in BLOBS],
        )
    )
    arrays = index.join(sizes, "shard").select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(0).alias("kind"),
        *[F.lit(None).cast("long").alias(c) for c in ("owner", "text_hash")],
        F.lit(None).cast("int").alias("line_no"),
        *[F.lit(None).cast("long").alias(c) for c in ("h", "fingerprint")],
        *BLOBS,
    )

    def probe(batches):
        here, tables = None, []
        for batch in batches:
            shard, salt, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            place = shard.astype(np.int64) << 32 | salt
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if a == b:
                    continue
                if here != place[a]:
                    here, tables = place[a], []
                if kind[a] == 0:
                    tables.append(unpack({n: batch.column(n)[int(a)].as_py() for n in BLOBS}))
                    continue
                piece = batch.slice(int(a), int(b - a))
                h, prints, owner = (
                    piece.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "fingerprint", "owner")
                )
                gone = np.zeros(len(h), bool)
                for table in tables:
                    known, keeper = owners_of(table, h.view(np.uint64), prints.view(np.uint64))
                    gone |= known & (keeper != owner)
                if gone.any():
                    rows = pa.Table.from_batches([piece.select(["owner", "text_hash", "line_no"])])
                    yield from rows.filter(pa.array(gone)).combine_chunks().to_batches()

    dealt = arrays.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return dealt.mapInArrow(probe, "owner long, text_hash long, line_no int")


def rest_of(text: str | None, gone) -> tuple[int, int, str]:
    """Number of lines, number of dropped lines, and the other lines joined again."""
    lines = (text or "").split("\n")
    if not gone:
        return len(lines), 0, text or ""
    out = set(gone)
    return len(lines), len(out), "\n".join(line for i, line in enumerate(lines) if i not in out)


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    keys_per_shard: int = KEYS_PER_SHARD,
    probes_per_task: int = PROBES_PER_TASK,
) -> DataFrame:
    """Drop lines whose key stands in several documents, except in the document with the smallest id.

    A line's key is the line without blanks at its ends and with A-Z in lower case; keys of fewer than ``min_chars`` code
    points never count. Returns doc_id, kept_text, n_lines, n_dropped and the SHA-256 of the kept text.

    A null or empty text is one empty line, and kept. Rows that share an id, or have none, are one document for the rule,
    and each keeps a row of its own. An empty table gives no rows; other columns are not read. A line may repeat within a
    document, and texts may have any length.
    """
    gone = (
        dropped_lines(docs, min_chars, keys_per_shard, probes_per_task)
        .groupBy("owner", "text_hash")
        .agg(F.collect_set("line_no").alias("gone"))
    )
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("owner"),
        F.xxhash64("text").alias("text_hash"),
        "text",
    )
    joined = rows.join(gone, ["owner", "text_hash"], "left").select("doc_id", "text", "gone")

    def assemble(batches):
        for batch in batches:
            texts, lost = batch.column("text").to_pylist(), batch.column("gone").to_pylist()
            done = [rest_of(t, g) for t, g in zip(texts, lost, strict=True)]
            kept = [d[2] for d in done]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(kept, pa.string()),
                    pa.array([d[0] for d in done], pa.int64()),
                    pa.array([d[1] for d in done], pa.int64()),
                    pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string()),
                ],
                ["doc_id", "kept_text", "n_lines", "n_dropped", "kept_sha256"],
            )

    schema = "doc_id long, kept_text string, n_lines long, n_dropped long, kept_sha256 string"
    return joined.mapInArrow(assemble, schema)

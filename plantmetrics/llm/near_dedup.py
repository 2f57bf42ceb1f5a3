"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures, with links confirmed on full shingle sets.

A signature has ``CHUNKS`` chunks of ``WIDTH`` positions of 8 bits. Two documents of similarity 0.8 differ in a fifth of the
positions on average. The join takes all pairs that differ in at most ``RADIUS`` positions, 4.6 standard deviations above that.
By the pigeonhole principle such a pair has a chunk in which it differs in at most one position, since CHUNKS * 2 > RADIUS.
So every document is put under one key per chunk and allowed error: the chunk with one position left out. Documents that
share a key are candidates.

Documents with equal sets are one class before that, so exact copies cost nothing. A key's candidates are not all paired:
each is compared with the key's first class only. What these close pairs connect is a cluster. Two classes of one key in
different clusters are compared by signature, in blocks. Inside a cluster, the pairs found so far are confirmed and connected,
and then only classes outside the cluster's largest component are compared with the others, on full sets, inside tasks that
give out no more links than join components. So no pair within the radius is left out, and a group of very many near copies
never becomes a table of its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantmetrics.llm.common import LOWER_BYTES, mix, row_filter
from plantmetrics.llm.components import components
from plantmetrics.session import materialise

WORDS = 5
NUMERATOR, DENOMINATOR = 80, 100
CHUNKS, WIDTH = 19, 5
POSITIONS = CHUNKS * WIDTH
RADIUS = 2 * CHUNKS - 1
BLOCK = 512
SEED = 20
CACHE_WORDS = 400_000

SIGNED = "doc_id long, text_hash long, n_shingles long, class binary, signature binary"


# ---- one document ------------------------------------------------------------------------------------------------------


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingle_hashes(text: str | None, words: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; ``known`` keeps hashes of words met before."""
    if not text:
        return np.zeros(0, np.uint64)
    parts = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(known) > CACHE_WORDS:
        known.clear()
    for word in set(parts).difference(known):
        known[word] = word_hash(word)
    codes = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(codes))
    state = np.full(len(codes) - size + 1, size, np.uint64)
    for i in range(size):
        state = mix(state * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - size + 1 + i])
    return np.unique(state)


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


def minhash(hashes: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The signature: 8 bits of the smallest value of each hash function."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 2048):
        block = hashes[start : start + 2048]
        np.minimum(least, (block[:, None] * odd + add).min(axis=0), out=least)
    return (mix(least) & np.uint64(0xFF)).astype(np.uint8)


def key_values(signatures: np.ndarray) -> np.ndarray:
    """Keys of every signature: one row each, one column per chunk and left-out position."""
    chunks = signatures.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    keys = np.empty((len(chunks), CHUNKS, WIDTH), np.uint64)
    for out in range(WIDTH):
        value = np.zeros(chunks.shape[:2], np.uint64)
        for i in range(WIDTH):
            if i != out:
                value = value << np.uint64(8) | chunks[:, :, i]
        keys[:, :, out] = value << np.uint64(8) | (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(out))
    return keys.reshape(len(chunks), -1).astype(np.int64)


# ---- Spark jobs --------------------------------------------------------------------------------------------------------


def sign(docs: DataFrame, words: int) -> DataFrame:
    """Every document's class (a 128-bit hash of its set; null without words), set size and signature; no shuffle."""
    odd, add = multipliers()

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            size, cls, signature = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, words, known)
                size.append(len(hashes))
                some = len(hashes) > 0
                cls.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if some else None)
                signature.append(minhash(hashes, odd, add).tobytes() if some else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(size, pa.int64()),
                    pa.array(cls, pa.binary()),
                    pa.array(signature, pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "class", "signature"],
            )

    return keyed_rows(docs).mapInArrow(run, SIGNED)


def keyed_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def classes_of(signed: DataFrame) -> DataFrame:
    """One row per class with a number that follows the smallest doc_id, and the row that stands for it."""
    found = (
        signed.filter("class is not null")
        .groupBy("class")
        .agg(
            F.min("doc_id").alias("first_doc"),
            F.min(F.struct("doc_id", "text_hash")).alias("row"),
            F.first("signature").alias("signature"),
        )
    )
    ordered = found.repartitionByRange("first_doc", "class").sortWithinPartitions("first_doc", "class")
    return materialise(ordered.withColumn("node", F.monotonically_increasing_id()), "classes")


def shared_keys(classes: DataFrame) -> DataFrame:
    """The keys that several classes have: key, node, the key's first node and its number of nodes."""

    def spell(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = b"".join(batch.column("signature").to_pylist())
            keys = key_values(np.frombuffer(joined, np.uint8).reshape(-1, POSITIONS))
            nodes = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
            for a in range(0, keys.size, 200_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1)[a : a + 200_000]), pa.array(nodes[a : a + 200_000])], ["key", "node"]
                )

    rows = classes.select("node", "signature").mapInArrow(spell, "key long, node long")
    of_key = Window.partitionBy("key")
    counted = rows.select(
        "key", "node", F.min("node").over(of_key).alias("centre"), F.count(F.lit(1)).over(of_key).alias("n")
    )
    return materialise(counted.filter("n > 1"), "shared-keys")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=-1)


def close_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most ``RADIUS`` positions."""
    left = classes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = classes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in ("sa", "sb")
            )
            near = pa.array(distance(sa, sb) <= RADIUS)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """node and shingle hashes of the wanted nodes, from the texts of the rows that stand for them.

    A filter of the wanted rows goes first, so the exchange moves their texts and few others. Repeated rows are dropped as
    texts, which are shorter than their hashes.
    """
    rows = materialise(wanted.join(classes, "node").select("node", "row.doc_id", "row.text_hash"), "wanted-rows")
    is_wanted = row_filter(rows.select("doc_id", "text_hash"))
    texts = keyed_rows(docs).filter(is_wanted("doc_id", "text_hash")).alias("t").join(
        rows.alias("r"),
        F.col("t.text_hash").eqNullSafe(F.col("r.text_hash")) & F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")),
    )

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_hashes(t, words, known).view(np.int64) for t in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["node", "hashes"]
            )

    once = texts.select("r.node", "t.text").dropDuplicates(["node"])
    return materialise(once.mapInArrow(run, "node long, hashes array<long>"), "shingle-sets")


def confirm(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    small, large = F.least(F.size("ha"), F.size("hb")), F.greatest(F.size("ha"), F.size("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(denominator * small >= numerator * large)
        .filter(denominator * both >= numerator * (F.size("ha") + F.size("hb") - both))
        .select("a", "b")
    )


def pairs_between(shared: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs within the radius that share a key and are in different clusters (node, root).

    Only keys with at least three nodes in at least two clusters are looked at: with two, the pair was compared before. The
    nodes of a key are dealt into blocks of about ``BLOCK``, and each pair of blocks is one group of rows. A pair that shares
    several keys is given out under the first of them alone.
    """
    rows = shared.filter("n > 2").join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    rooted = rows.select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    # Clusters of one key are told apart by their smallest and largest root.
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    open_rows = rooted.join(mixed.select("key"), "key").join(classes.select("node", "signature"), "node")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        open_rows.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            "own",
            "node",
            "root",
            "signature",
        )
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )

    def compare(group: dict) -> tuple[np.ndarray, np.ndarray]:
        label = int(group["key"][0]) & 0xFF
        chunk, out = divmod(label, WIDTH)
        nodes, roots_, own_ = (np.concatenate(group[c]) for c in ("node", "root", "own"))
        signatures = np.concatenate(group["signature"])
        first, second = [], []
        i, j = int(group["i"][0]), int(group["j"][0])
        left = np.flatnonzero(own_ == i)
        right = np.flatnonzero(own_ == j)
        for x in left:
            near = right[(roots_[right] != roots_[x]) & (nodes[right] != nodes[x])]
            if i == j:
                near = near[nodes[near] > nodes[x]]
            if not len(near):
                continue
            differ = signatures[near] != signatures[x]
            fits = differ.sum(axis=1) <= RADIUS
            near, differ = near[fits], differ[fits].reshape(-1, CHUNKS, WIDTH)
            errors = differ.sum(axis=2)
            earliest = np.argmax(errors <= 1, axis=1)
            at = np.arange(len(near))
            position = np.argmax(differ[at, earliest], axis=1)  # 0 if the chunk is equal
            near = near[(earliest == chunk) & (position == out)]
            first.append(np.minimum(nodes[near], nodes[x]))
            second.append(np.maximum(nodes[near], nodes[x]))
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *first]), np.concatenate([empty, *second])

    def run(batches):
        group: dict[str, list] = {}
        place = None

        def done():
            a, b = compare(group)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_numpy() for c in ("key", "i", "j", "own", "node", "root")}
            columns["signature"] = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, POSITIONS)
            key, i, j = columns["key"], columns["i"], columns["j"]
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                here = (key[a], i[a], j[a])
                if here != place and place is not None:
                    yield done()
                    group = {}
                place = here
                for c, values in columns.items():
                    if c in ("key", "i", "j"):
                        group[c] = [values[a]]
                    else:
                        group.setdefault(c, []).append(values[a:b])
        if place is not None:
            yield done()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def links_inside(clusters: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Links between different components of one cluster, as many as it takes to connect them.

    All but the nodes of a cluster's largest component (its minority) are dealt into blocks, and so are all its nodes; each
    block of the first kind meets each of the second in one group. A task holds the minority's sets of its group and streams
    the others past them; a pair is compared if its components are not yet connected there and its signatures are close.
    """
    rooted = clusters.select("node", F.col("root").alias("cluster")).join(roots, "node", "left")
    rooted = rooted.select("node", "cluster", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("cluster").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("largest"), F.sum("n").alias("whole")
    )
    mixed = mixed.filter("largest < whole").select(
        "cluster",
        "main",
        F.ceil((F.col("whole") - F.col("largest")) / BLOCK).cast("int").alias("minor_blocks"),
        F.ceil(F.col("whole") / BLOCK).cast("int").alias("all_blocks"),
    )
    rows = (
        rooted.join(mixed, "cluster")
        .join(classes.select("node", "signature"), "node")
        .join(sets, "node")
        .select("cluster", "node", "root", "signature", "hashes", "main", "minor_blocks", "all_blocks")
    )
    rows = materialise(rows, "mixed-clusters")

    def dealt(kind: int, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit(kind), "node"), F.col(f"{own}_blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        return rows.select(
            "cluster",
            mine.alias(own),
            every.alias(other),
            F.lit(kind).alias("kind"),
            "node",
            "root",
            "main",
            "signature",
            "hashes",
        )

    minority = dealt(0, "minor", "all").filter("root <> main")
    both = minority.unionByName(dealt(1, "all", "minor"))
    placed = both.repartition("cluster", "minor", "all").sortWithinPartitions("cluster", "minor", "all", "kind")
    numerator, denominator = ratio

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        if denominator * min(len(a), len(b)) < numerator * max(len(a), len(b)):
            return False
        common = len(np.intersect1d(a, b, assume_unique=True))
        return denominator * common >= numerator * (len(a) + len(b) - common)

    def run(batches):
        place, joined, held, signatures = None, {}, [], None

        def find(x):
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for batch in batches:
            if not batch.num_rows:
                continue
            where = list(zip(*[batch.column(c).to_pylist() for c in ("cluster", "minor", "all")], strict=True))
            kinds, nodes, roots_ = (batch.column(c).to_pylist() for c in ("kind", "node", "root"))
            bytes_, lists = batch.column("signature"), batch.column("hashes")
            a, b = [], []
            for i, here in enumerate(where):
                if here != place:
                    place, joined, held, signatures = here, {}, [], None
                signature = np.frombuffer(bytes_[i].as_py(), np.uint8)
                hashes = lists[i].values.to_numpy()
                if kinds[i] == 0:
                    held.append((nodes[i], roots_[i], signature, hashes))
                    continue
                if not held:
                    continue
                if signatures is None:
                    signatures = np.stack([h[2] for h in held])
                apart = distance(signatures, signature)
                for j in np.argsort(apart, kind="stable"):
                    if apart[j] > RADIUS:
                        break
                    node, root, _, own = held[j]
                    x, y = find(root), find(roots_[i])
                    if x != y and similar(own, hashes):
                        joined[max(x, y)] = min(x, y)
                        a.append(node)
                        b.append(nodes[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return placed.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR
) -> DataFrame:
    """Groups of documents that links of high shingle similarity connect: one row per document.

    Words are runs of characters other than blanks, with A-Z in lower case; a document's set is its distinct shingles of
    ``words`` words, or its whole sequence as one shingle if it has fewer. Documents are linked if the intersection of their
    sets is at least ``numerator``/``denominator`` of the union (0.8 or more; the radius is set for that).

    Returns doc_id, text_hash (xxhash64 of the text), n_shingles, class (null without words), component_id, the smallest
    doc_id that can be reached, and kept (doc_id = component_id). Null, empty and blank texts are linked with nothing and are
    components of their own. Rows that repeat an id are judged each by its own text. A row without an id belongs to its
    component but never names it; a component of such rows only has component_id null and is kept. Texts may be of any length. An
    empty table gives no rows; other columns are not read.
    """
    return grouped(docs, words, numerator, denominator).drop("root")


def grouped(docs: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame:
    """The rows of ``near_duplicates`` with the number of their component in ``root`` (null without words)."""
    if denominator * 4 > numerator * 5:
        raise ValueError("the signature radius holds for similarities of 0.8 and more")
    signed = materialise(sign(docs, words), "signatures")
    classes = classes_of(signed)
    shared = shared_keys(classes)
    star = shared.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    near = materialise(close_pairs(star, classes), "near-pairs")
    clusters = materialise(components(near), "clusters")
    found = near.union(materialise(pairs_between(shared, clusters, classes), "near-pairs"))
    wanted = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(docs, wanted, classes, words)
    links = materialise(confirm(found, sets, numerator, denominator), "confirmed")
    roots = materialise(components(links), "roots")
    more = materialise(links_inside(clusters, roots, classes, sets, (numerator, denominator)), "confirmed")
    roots = materialise(components(links.union(more)), "roots")

    rooted = classes.join(roots, "node", "left").select("class", "first_doc", F.coalesce("root", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = rooted.join(names, "root").select("class", "root", "component_id")
    joined = signed.select("doc_id", "text_hash", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        "class",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "root",
    )


def keep_one(
    docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, repeats: bool = True
) -> DataFrame:
    """The documents without those that a group's first document stands for, with their columns as they were.

    The first document has the group's smallest doc_id and, among rows of that id or in a group without ids, the smallest
    text_hash. Rows without an id that have one text leave one row. Rows that repeat an id and a text stay together or go
    together; without ``repeats`` they leave one row too. Of equal rows, the one whose other columns come first as JSON stays.
    Texts without words are in no group and all stay. Only rows that may have to go, told by a filter, are exchanged whole.
    """
    found = materialise(grouped(docs, words, numerator, denominator), "near-groups")
    first = found.filter("kept and class is not null").groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = materialise(first, "near-first")
    least = first.groupBy("root").agg(F.min("text_hash").alias("least"), F.count(F.lit(1)).alias("texts"))
    least = materialise(least.filter("texts > 1").select("root", "least"), "near-first")
    judged = materialise(
        first.join(least, "root", "left").withColumn("stays", F.coalesce(F.col("text_hash") == F.col("least"), F.lit(True))),
        "near-first",
    )
    other = judged.filter("not stays").select("doc_id", "text_hash")
    gone = found.filter(~F.col("kept")).select("doc_id", "text_hash").union(other).distinct()
    several = judged.filter("stays and n > 1").select("doc_id", "text_hash")
    if repeats:
        several = several.filter("doc_id is null")
    gone, several = materialise(gone, "near-copies"), materialise(several, "near-repeats")
    packed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.struct(*[F.col(c) for c in docs.columns]).alias("document"),
    ).alias("d")

    def same(other: str):
        return F.col("d.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & F.col("d.text_hash").eqNullSafe(F.col(f"{other}.text_hash"))

    named = gone.union(several)
    may_go = row_filter(named)("doc_id", "text_hash")
    suspects = packed.filter(may_go).alias("d")
    alone = suspects.join(named.alias("g"), same("g"), "left_anti").union(packed.filter(~may_go)).select("document")
    if several.isEmpty():
        return alone.select("document.*")
    rest = F.to_json(F.struct(F.lit(0).alias("-"), *[F.col(f"d.document.`{c}`") for c in docs.columns if c != "text"]))
    one = suspects.join(several.alias("s"), same("s"), "left_semi").groupBy("doc_id", "text_hash")
    return alone.union(one.agg(F.min_by("document", rest).alias("document")).select("document")).select("document.*")

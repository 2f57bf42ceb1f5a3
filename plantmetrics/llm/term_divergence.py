"""How far the words of each source lie from the other sources of its language and from the language itself.

Terms are counted in tasks without strings: short terms are packed into one or two 64-bit words, which a radix sort puts in
order and whose runs are counted; longer ones are sorted as bytes, in buckets by length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantmetrics.llm.common import LOWER_BYTES
from plantmetrics.session import materialise

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
PRIOR = 5
PIECE_BYTES = 4 << 20  # text that is cut into terms at once
HELD_RUNS = 400_000  # counted terms that a task holds before it passes them on
CELLS = 200_000  # sources x terms of one block of the comparison, at least; with many sources so many as there are pairs
TILE_SOURCES = 512  # sources of one side of a comparison task
BROADCAST_GROUPS = 200_000  # more (lang, source) groups are joined by an exchange

PACKED_BYTES = 16  # longer terms are not packed

_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_IS_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])


# ---- terms of one piece of text ----------------------------------------------------------------------------------------


def term_places(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every term in bytes that begin and end with a separator."""
    edges = np.flatnonzero(np.diff(_IS_TERM[text].view(np.int8)))
    starts = edges[0::2] + 1
    return starts, edges[1::2] + 1 - starts


def pack(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """Terms of at most 8 * ``words`` bytes as rows of big-endian numbers; terms hold no zero byte, so padding is unique."""
    reach = np.arange(8 * words)
    at = np.minimum(starts[:, None] + reach, len(text) - 1)
    return np.where(reach < sizes[:, None], text[at], 0).astype(np.uint8).view(">u8").astype(np.uint64)


def radix_order(*digits_of: np.ndarray) -> np.ndarray:
    """The stable order of rows by several unsigned columns, least significant first, 16 bits at a time.

    numpy sorts 16-bit numbers by radix; digits that are equal everywhere are skipped.
    """
    order = np.arange(len(digits_of[0]))
    for column in digits_of:
        spread = np.bitwise_or.reduce(column ^ column[0]) if len(column) else 0
        for shift in range(0, 8 * column.itemsize, 16):
            if int(spread) >> shift & 0xFFFF:
                digit = (column[order] >> column.dtype.type(shift)).astype(np.uint16)
                order = order[np.argsort(digit, kind="stable")]
    return order


def sorted_runs(group: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of rows by (group, key), and where each run of equal ones begins in it.

    ``keys`` has one or two 64-bit words a row, or is a column of byte strings.
    """
    if keys.ndim == 2:
        order = radix_order(*[keys[:, i] for i in reversed(range(keys.shape[1]))], group.astype(np.uint64))
    else:
        order = np.argsort(keys, kind="stable")
        order = order[radix_order(group[order].astype(np.uint64))]
    group, keys = group[order], keys[order]
    same = keys[1:] == keys[:-1]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | ~(same.all(axis=1) if same.ndim == 2 else same)
    return order, np.flatnonzero(new)


class Runs:
    """Counted terms by width: 8 and 16 bytes packed, wider ones (a power of two) as byte strings."""

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple[np.ndarray, ...]]] = {}  # group, key, occurrences, documents
        self.size = 0

    def add(self, body: bytes, groups: np.ndarray, ends: np.ndarray) -> None:
        """Count the terms of texts that lie behind one another in ``body``; text i ends before ``ends[i]``."""
        body = body.translate(LOWER_BYTES)
        text = np.frombuffer(body, np.uint8)
        starts, sizes = term_places(text)
        docs = np.searchsorted(ends, starts, side="right")
        widths = np.where(sizes <= 8, 8, 1 << np.ceil(np.log2(np.maximum(sizes, 8))).astype(np.int64))
        for width in np.unique(widths).tolist():
            own = widths == width
            if width <= PACKED_BYTES:
                keys = pack(text, starts[own], sizes[own], width // 8)
            else:
                keys = np.array([body[a : a + n] for a, n in zip(starts[own], sizes[own], strict=True)], f"S{width}")
            doc = docs[own]
            order, first = sorted_runs(groups[doc], keys)
            doc = doc[order]
            new_doc = np.ones(len(doc), np.int64)  # the order is stable, so a run's documents do not fall
            new_doc[1:] = doc[1:] != doc[:-1]
            new_doc[first] = 1
            times = np.diff(np.append(first, len(order)))
            self._keep(width, (groups[doc[first]], keys[order[first]], times, np.add.reduceat(new_doc, first)))

    def merge(self, one_document: bool = False) -> None:
        """Sum equal runs."""
        for width, parts in self.parts.items():
            group, keys, times, docs = (np.concatenate(c) for c in zip(*parts, strict=True))
            order, first = sorted_runs(group, keys)
            held_by = np.ones(len(first), np.int64) if one_document else np.add.reduceat(docs[order], first)
            self.parts[width] = [(group[order[first]], keys[order[first]], np.add.reduceat(times[order], first), held_by)]
        self.size = sum(len(parts[0][0]) for parts in self.parts.values())

    def take(self, other: Runs) -> None:
        for width, parts in other.parts.items():
            for part in parts:
                self._keep(width, part)

    def _keep(self, width: int, part: tuple[np.ndarray, ...]) -> None:
        self.parts.setdefault(width, []).append(part)
        self.size += len(part[0])

    def rows(self) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
        for width, parts in self.parts.items():
            for group, keys, times, docs in parts:
                texts = keys.astype(">u8").view(f"S{width}").ravel() if width <= PACKED_BYTES else keys
                yield group, texts.tolist(), times, docs


def pieces(text: bytes) -> list[bytes]:
    """A long text cut between terms; one endless term stays whole."""
    cuts, at = [], 0
    while len(text) - at > PIECE_BYTES and (gap := _GAP.search(text, at + PIECE_BYTES)):
        cuts.append(text[at : gap.start()])
        at = gap.start()
    return [*cuts, text[at:]]


def of_batches(names: list[tuple[str, str]], batches) -> Iterator[Runs]:
    """Counted terms of (lang, source, text) rows; the groups are numbered in ``names``, which grows."""
    numbers: dict[tuple[str, str], int] = {}
    runs, waiting, size = Runs(), [], 0

    def flush() -> None:
        nonlocal waiting, size
        if waiting:
            ends = np.cumsum([len(text) + 1 for _, text in waiting])
            body = b"\n" + b"\n".join(text for _, text in waiting) + b"\n"
            runs.add(body, np.array([group for group, _ in waiting]), ends + 1)
        waiting, size = [], 0

    for batch in batches:
        columns = [batch.column(c).cast(pa.large_binary() if c == "text" else pa.string()) for c in ("lang", "source", "text")]
        for lang, source, text in zip(*columns, strict=True):
            key = (lang.as_py(), source.as_py())
            if key not in numbers:
                numbers[key] = len(names)
                names.append(key)
            value = text.as_py()
            if len(value) > PIECE_BYTES:
                single = Runs()
                for piece in pieces(value):
                    single.add(b"\n" + piece + b"\n", np.array([numbers[key]]), np.array([len(piece) + 2]))
                single.merge(one_document=True)
                runs.take(single)
            else:
                waiting.append((numbers[key], value))
                size += len(value)
            if size > PIECE_BYTES:
                flush()
            if runs.size > HELD_RUNS:
                runs.merge()
                if runs.size > HELD_RUNS // 2:
                    yield runs
                    runs = Runs()
    flush()
    runs.merge()
    yield runs


# ---- the Spark jobs ----------------------------------------------------------------------------------------------------


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it), one row each.

    Tasks sum their own rows first, so a source of any size sends each of its terms once per task.
    """

    def run(batches):
        names: list[tuple[str, str]] = []
        for runs in of_batches(names, batches):
            for group, terms, times, held_by in runs.rows():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[g][0] for g in group.tolist()], pa.string()),
                        pa.array([names[g][1] for g in group.tolist()], pa.string()),
                        pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array(times, pa.int64()),
                        pa.array(held_by, pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    counted = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def smoothed(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), by long division, so no product leaves 64 bits."""
    below = total + PRIOR * terms
    rest, digits = count + PRIOR, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + F.call_function("div", rest, below)
        rest = rest % below
    return 1 + digits


def smoothed_array(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    below = np.maximum(total + PRIOR * terms, 1)
    rest, digits = counts + PRIOR, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + rest // below
        rest = rest % below
    return 1 + digits


def pair_sums(counts: pd.DataFrame, groups: pd.DataFrame, low: int, high: int, first: bool) -> pd.DataFrame:
    """For sources of tile ``low`` and tile ``high``: the sum of the distances of each pair over the terms of one block.

    Kept terms that neither tile holds have count 0 in both sources of a pair. The first block takes all terms as such, and each
    block replaces the distances of those that it finds.
    """
    column, found = pd.factorize(counts["term"])
    table = np.zeros((len(groups), len(found)), np.int64)
    table[pd.Index(groups["source"]).get_indexer(counts["source"]), column] = counts["n"].to_numpy()
    total, terms = groups["total"].to_numpy()[:, None], int(groups["terms"].iloc[0])
    p, unseen = smoothed_array(table, total, terms), smoothed_array(np.zeros_like(total), total, terms)[:, 0]
    as_unseen = (terms if first else 0) - len(found)
    tile, names = groups["tile"].to_numpy(), groups["source"].to_numpy()
    firsts, seconds, sums = [], [], []
    for i in np.flatnonzero(tile == low):
        other = np.flatnonzero(tile == high)
        other = other[other > i] if low == high else other
        firsts += [names[i]] * len(other)
        seconds.append(names[other])
        sums.append(np.abs(p[other] - p[i]).sum(axis=1) + as_unseen * np.abs(unseen[other] - unseen[i]))
    return pd.DataFrame(
        {
            "a": pd.Series(firsts, dtype=object),
            "b": np.concatenate([np.array([], object), *seconds]),
            "part_sum": np.concatenate([np.array([], np.int64), *sums]),
        }
    )


def measure_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank; larger values lie farther apart.

    Terms are runs of ASCII letters and of all characters beyond ASCII, with A-Z in lower case. A language keeps the terms that
    at least ``min_docs`` of its documents hold. A group (language and source) and the language as a whole give each kept term
    p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N being their occurrences of kept terms and V the number of kept terms. Part
    ``pair`` has for each other source of the language the sum of the differences of p over all kept terms; part ``term`` has
    the terms of the group whose p is above the language's, with the difference, at most ``top_terms`` of them. Ranks go by
    falling value, then by the bytes of the item.

    Null texts, languages and sources are empty ones, and each row is a document, also where rows repeat. A group without terms
    takes part with N = 0; a language without kept terms has pairs of value 0. A language with one source has no pairs. Texts
    and terms have any length: a long text is counted in pieces, a long term by its bytes. An empty table gives no rows, and
    other columns are not read.
    """
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = materialise(count_terms(clean), "term-counts")
    kept = (
        counts.groupBy("lang", "term")
        .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= min_docs)
        .drop("docs")
    )
    kept = materialise(kept, "kept-terms")
    in_kept = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    in_kept = materialise(in_kept, "kept-counts")
    groups = materialise(describe_groups(clean, kept, in_kept), "term-groups")
    n_groups = groups.count()
    small = F.broadcast(groups) if n_groups <= BROADCAST_GROUPS else groups
    found = in_kept.join(small, ["lang", "source"])
    ranked = terms_above(found, top_terms).unionByName(pairs(found, groups))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def describe_groups(docs: DataFrame, kept: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per (lang, source): total and lang_total (N), terms (V), and how the comparison is dealt (tile, tiles, blocks).

    A block has about ``cells`` cells (sources x terms) whatever the vocabulary, and takes its sources from one or two tiles of
    about TILE_SOURCES, so a language may have any number of both.
    """
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    known = (
        groups.join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .join(sources, "lang")
        .fillna(0, ["total", "terms", "lang_total"])
    )
    side_by_side = F.least(F.col("sources"), F.lit(2 * TILE_SOURCES))
    cells = F.greatest(F.lit(CELLS), side_by_side * side_by_side)  # a block gives out a row per pair
    return (
        known.withColumn("tiles", F.ceil(F.col("sources") / TILE_SOURCES).cast("int"))
        .withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
        .withColumn("blocks", F.greatest(F.ceil(F.col("terms") * side_by_side / cells), F.lit(1)).cast("int"))
        .drop("rows", "sources")
    )


def terms_above(found: DataFrame, top_terms: int) -> DataFrame:
    p = smoothed(F.col("n"), F.col("total"), F.col("terms"))
    q = smoothed(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    above = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # Spark keeps the first rows of each task before the exchange, as the rank has a limit.
    return above.filter("value > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)


def pairs(found: DataFrame, groups: DataFrame) -> DataFrame:
    """Every pair of sources of a language, from blocks of terms in which its sources lie side by side."""
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    between = [F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")]
    block = F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block")
    each_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    keys = ["lang", "block", "low", "high"]
    counts = found.select("lang", "source", "term", "n", "tile", block, other).select("*", *between)
    sources = groups.select("lang", "source", "total", "terms", "tile", "blocks", other).select("*", each_block, *between)

    def compare(key, counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        lang, block, low, high = key
        return pair_sums(counts, groups, low, high, first=block == 0).assign(lang=lang)

    summed = (
        counts.select(*keys, "source", "term", "n")
        .groupBy(*keys)
        .cogroup(sources.select(*keys, "source", "total", "terms", "tile").groupBy(*keys))
        .applyInPandas(compare, "a string, b string, part_sum long, lang string")
        .groupBy("lang", "a", "b")
        .agg(F.sum("part_sum").alias("value"))
    )
    ways = [F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))]
    both = summed.select("lang", "value", F.explode(F.array(*ways)).alias("way")).select("lang", "way.*", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))

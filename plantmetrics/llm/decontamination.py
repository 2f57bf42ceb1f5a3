"""Benchmark decontamination with one Aho-Corasick automaton over the words of the test items, held in numpy arrays."""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmetrics.llm.common import WORD_BYTES

WINDOW = 13
MIN_SHARE = 20  # contaminated: at least one word in so many is hit
MAX_NODES = 20_000_000  # of the automaton, which is broadcast, so its size must be known
WORD_BITS = 31  # an edge is a node and a word in one 64-bit number
STRIPS = 2048  # parts of a slice of texts that run through the automaton side by side
SLICE_CHARS = 4 << 20
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPAN = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("contaminated", T.BooleanType()),
    ]
)
ARROW_RESULT = [
    pa.int64(),
    pa.int64(),
    pa.list_(pa.string()),
    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item_ids", pa.list_(pa.string()))])),
    pa.bool_(),
]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


# ---- the automaton -----------------------------------------------------------------------------------------------------


def coded_items(items: DataFrame) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, list[str]]:
    """Word numbers (from 1), the items' words as numbers one item behind another, where each begins, and their names.

    Null ids are named ``null``; items without words are left out.
    """
    numbers = defaultdict(count(1).__next__)
    coded, starts, names = array("i"), array("q"), []
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    for item, text in named.toLocalIterator():
        words = words_of(text)
        if words:
            starts.append(len(coded))
            names.append(item)
            coded.extend(map(numbers.__getitem__, words))
    return dict(numbers), np.array(coded, np.int32), np.array([*starts, len(coded)], np.int64), names


def windows_of(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and item of every window; an item of fewer words is one window."""
    sizes = np.diff(starts)
    counts = np.maximum(sizes - window + 1, 1)
    item = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[item] + place, np.minimum(sizes, window)[item], item


def build_automaton(coded: np.ndarray, starts: np.ndarray, window: int, max_nodes: int) -> dict[str, np.ndarray]:
    """The automaton over word numbers as arrays; node 0 is the root, and node i + 1 is reached by edge i.

    ``edges`` holds (node, word) of every edge as one number, in rising order: the trie is built one word deeper at a time from
    all windows together, so nodes are numbered by depth and then by edge. ``fail`` is the longest other suffix of a node that is
    a node, ``found`` the node itself or its next suffix that ends a window (0: none). The items of a node's window are
    ``items[first[node]:first[node + 1]]``.
    """
    begin, length, item = windows_of(starts, window)
    node = np.zeros(len(begin), np.int64)
    levels, n_nodes = [], 1
    for deep in range(window):
        going = np.flatnonzero(length > deep)
        keys = node[going] << WORD_BITS | coded[begin[going] + deep]
        edges, which = np.unique(keys, return_inverse=True)
        if n_nodes + len(edges) > max_nodes:
            raise ValueError(f"the windows of the test items need more than {max_nodes} nodes (MAX_NODES)")
        node[going] = n_nodes + which
        levels.append(edges)
        n_nodes += len(edges)
    edges = np.concatenate([np.zeros(0, np.int64), *levels])
    depth = np.repeat(np.arange(len(levels) + 1), [1, *[len(level) for level in levels]]).astype(np.int8)

    ends = np.unique(np.column_stack([node, item]), axis=0) if len(node) else np.zeros((0, 2), np.int64)
    first = np.searchsorted(ends[:, 0], np.arange(n_nodes + 1))
    fail = np.zeros(n_nodes, np.int32)
    found = np.where(np.diff(first) > 0, np.arange(n_nodes), 0).astype(np.int32)
    built = {"edges": edges, "fail": fail, "found": found}
    at = 1
    for deep, level in enumerate(levels):
        own = np.arange(at, at + len(level))
        if deep:
            fail[own] = step(built, fail[level >> WORD_BITS], level & (1 << WORD_BITS) - 1)
            found[own] = np.where(found[own] > 0, own, found[fail[own]])
        at += len(level)
    return {**built, "depth": depth, "first": first.astype(np.int32), "items": ends[:, 1].astype(np.int32)}


def follow_edges(machine: dict[str, np.ndarray], node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The node behind each (node, word), 0 where there is no such edge."""
    edges = machine["edges"]
    if not len(edges):
        return np.zeros(len(node), np.int64)
    key = node.astype(np.int64) << WORD_BITS | word
    at = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
    return np.where(edges[at] == key, at + 1, 0)


def step(machine: dict[str, np.ndarray], node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The next node of many runs at once: along the edge, or along that of the longest suffix that has one."""
    out = follow_edges(machine, node, word)
    open_ = np.flatnonzero((out == 0) & (node > 0) & (word > 0))
    at = node[open_]
    while len(open_):
        at = machine["fail"][at]
        reached = follow_edges(machine, at, word[open_])
        out[open_] = reached
        left = (reached == 0) & (at > 0)
        open_, at = open_[left], at[left]
    return out


def run_automaton(machine: dict[str, np.ndarray], words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the last word and node of every window that occurs in ``words`` (numbers, 0: unknown).

    The sequence is cut into strips that are run side by side. A node is known from the last ``window`` words, so each strip
    begins that many words early, less one.
    """
    length = max(-(-len(words) // STRIPS), 4 * window)
    starts = np.arange(0, len(words), length)
    padded = np.concatenate([np.zeros(window - 1, np.int64), words, np.zeros(length, np.int64)])
    node = np.zeros(len(starts), np.int64)
    places, nodes = [], []
    for i in range(length + window - 1):
        node = step(machine, node, padded[starts + i])
        if i >= window - 1:
            hit = np.flatnonzero(machine["found"][node])
            if len(hit):
                places.append(starts[hit] + i - window + 1)
                nodes.append(machine["found"][node[hit]])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, node = np.concatenate(places), np.concatenate(nodes).astype(np.int64)
    every = [(place, node)]
    while len(node):  # windows that end in the same word, as suffixes of the longer ones
        node = machine["found"][machine["fail"][node]].astype(np.int64)
        place, node = place[node > 0], node[node > 0]
        every.append((place, node))
    place, node = (np.concatenate(c) for c in zip(*every, strict=True))
    order = np.lexsort((node, place))
    return place[order], node[order]


def compile_items(items: DataFrame, window: int = WINDOW, max_nodes: int = MAX_NODES) -> dict:
    """The automaton of all windows of the test items, ready to be broadcast: arrays that tasks only read.

    An item of fewer than ``window`` words, but not none, is one window. Each node takes 21 bytes, and there may be ``max_nodes``
    of them; this bound, which is what allows the broadcast, is an error where it is passed.
    """
    numbers, coded, starts, names = coded_items(items)
    return {"numbers": numbers, "names": names, "window": window, **build_automaton(coded, starts, window, max_nodes)}


# ---- texts -------------------------------------------------------------------------------------------------------------


def hits_of(texts: list[str | None], compiled: dict) -> list[tuple[int, list[tuple[int, int, list[str]]]]]:
    """For each text the number of its words and the windows in it: first word, last word, names of the items."""
    number = compiled["numbers"].get
    sizes, coded = [], array("q")
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        coded.extend([number(w, 0) for w in words])
        coded.append(0)  # no window reaches into the next text
    out = [(n, []) for n in sizes]
    if not len(compiled["edges"]):
        return out
    begins = np.cumsum([0, *[n + 1 for n in sizes]])
    places, nodes = run_automaton(compiled, np.frombuffer(coded, np.int64), compiled["window"])
    owners = np.searchsorted(begins, places, side="right") - 1
    first, items, depth = compiled["first"], compiled["items"], compiled["depth"]
    for owner, place, node in zip(owners.tolist(), places.tolist(), nodes.tolist(), strict=True):
        last = place - int(begins[owner])
        names = [compiled["names"][i] for i in items[first[node] : first[node + 1]]]
        out[owner][1].append((last - int(depth[node]) + 1, last, names))
    return out


def judge(text: str | None, n_words: int, hits: list[tuple[int, int, list[str]]]) -> tuple[int, int, list[str], list[dict], bool]:
    """n_words, n_hit, item ids sorted as strings, spans (start, end, item_ids) in characters, contaminated."""
    runs: list[list] = []  # merged runs of hit words: first, last, items
    for first, last, names in hits:
        found = set(names)
        while runs and runs[-1][1] >= first - 1:
            before = runs.pop()
            first, found = min(first, before[0]), found | before[2]
            last = max(last, before[1])
        runs.append([first, last, found])
    if not runs:
        return n_words, 0, [], [], False
    hit = sum(last - first + 1 for first, last, _ in runs)
    bounds = [m.span() for m in ORIGINAL_WORD.finditer(text)]
    spans = [{"start": bounds[a][0], "end": bounds[b][1], "item_ids": sorted(i)} for a, b, i in runs]
    return n_words, hit, sorted(set().union(*[i for _, _, i in runs])), spans, MIN_SHARE * hit >= n_words


def scan_texts(texts: list[str | None], compiled: dict) -> list[tuple]:
    """The results of some texts, which run through the automaton in slices of about SLICE_CHARS."""
    out, start, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE_CHARS or i == len(texts) - 1:
            part = texts[start : i + 1]
            out += [judge(t, n, hits) for t, (n, hits) in zip(part, hits_of(part, compiled), strict=True)]
            start, size = i + 1, 0
    return out


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, name: str = "scan") -> DataFrame:
    """The documents with a struct (``name``) of n_words, n_hit, item_ids, spans and contaminated; one pass, no shuffle.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case. A word inside an
    occurrence of any window of an item is hit; adjoining hits are one span, given in characters of the original text. A
    document is contaminated if at least one word in 20 is hit. Null and empty texts have no words and are clean, as is
    everything if there are no items. Texts are scanned whole, whatever their length; rows that repeat are scanned each.
    All columns stay, but for one that has the name of the struct.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compile_items(items, window))
    names = [c for c in docs.columns if c != name]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(name, RESULT)])

    def run(batches):
        for batch in batches:
            found = scan_texts(batch.column("text").to_pylist(), shared.value)
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(ARROW_RESULT)]
            packed = pa.StructArray.from_arrays(columns, [f.name for f in RESULT])
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], [*names, name])

    return docs.select(*names).mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    name = "scan" + "_" * max(len(c) for c in docs.columns)
    return scan(docs, items, window, name).filter(~F.col(f"{name}.contaminated")).drop(name)

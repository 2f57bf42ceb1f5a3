"""Line-first cleaning: every line is judged by rules, failing lines go, and documents that lose too much of their text follow."""

from __future__ import annotations

from array import array
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plantmetrics.llm.common import BLANKS, LOWER_BYTES, mix

# Rules of the whole text.
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
# Rules of a line.
SENTENCE_ENDS = (".", "!", "?", "…", '"', "”", "»", "。", "！", "？")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MAX_PUNCTUATION_PERCENT = 15
SEPARATORS = ("|", ">", "›", "•", "·", "→")
NAVIGATION_PHRASES = (
    "back to top", "click here", "log in", "next page", "previous page", "read more", "share this", "sign in", "site map",
    "skip to content",
)
NAVIGATION_WORDS = 12  # longer lines may say such a thing in passing
BOILERPLATE_PHRASES = (
    "all rights reserved", "cookie policy", "enable javascript", "licensed under", "lorem ipsum", "privacy policy",
    "released under", "subscribe to our newsletter", "terms of service", "terms of use",
)
BOILERPLATE_WORDS = 25
# Rule of the rest.
MAX_LOST_PERCENT = 50

SLICE_BYTES = 4 << 20  # texts that one call handles together; a longer text is handled alone

_ENDS = tuple(s.encode() for s in SENTENCE_ENDS)
_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)
_NAVIGATION = tuple(p.encode() for p in NAVIGATION_PHRASES)
_BOILERPLATE = tuple(p.encode() for p in BOILERPLATE_PHRASES)
_BLANK_BYTES = BLANKS.encode()
_CONTINUATION = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that do not begin a code point

DROPPED = T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("rule", T.StringType())])
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("n_lost_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("kept_text", T.StringType()),
        T.StructField("dropped", T.ArrayType(DROPPED)),
    ]
)
_LONGS = [f.name for f in RESULT if isinstance(f.dataType, T.LongType)]
_ARROW_DROPPED = pa.list_(pa.struct([("line_no", pa.int32()), ("rule", pa.string())]))


def failed_rule(line: bytes, words: list[bytes], word_chars: int) -> str | None:
    """The first rule that a line with words fails, or None."""
    if not line.rstrip(_BLANK_BYTES).endswith(_ENDS):
        return "punctuation"
    if 100 * (len(line) - len(line.translate(None, PUNCTUATION.encode()))) > MAX_PUNCTUATION_PERCENT * word_chars:
        return "punctuation"
    separators = sum(map(_SEPARATORS.__contains__, words))
    if separators >= 2 and 4 * separators >= len(words):
        return "navigation"
    if len(words) <= BOILERPLATE_WORDS:
        plain = line.translate(LOWER_BYTES)
        if len(words) <= NAVIGATION_WORDS and any(p in plain for p in _NAVIGATION):
            return "navigation"
        if any(p in plain for p in _BOILERPLATE):
            return "boilerplate"
    return None


def clean_text(text: bytes, numbers: defaultdict[bytes, int]) -> tuple[dict, array]:
    """The figures, dropped lines and kept lines of one text, and the numbers of its words in order."""
    coded, seen = array("q"), set()
    found = {"word_chars": 0, "n_symbols": 0, "n_dup_lines": 0, "n_lost_words": 0}
    found["n_symbols"] = len(text) - len(text.translate(None, SYMBOLS.encode()))
    kept, dropped = [], []
    for line_no, line in enumerate(text.split(b"\n")):
        words = line.split()
        rule = None
        if words:
            coded.extend(map(numbers.__getitem__, words))
            found["n_dup_lines"] += line in seen
            seen.add(line)
            word_chars = len(line.translate(None, _BLANK_BYTES + _CONTINUATION))
            found["word_chars"] += word_chars
            rule = failed_rule(line, words, word_chars)
        if rule is None:
            kept.append(line)
        else:
            dropped.append({"line_no": line_no, "rule": rule})
            found["n_lost_words"] += len(words)
    return {**found, "n_words": len(coded), "kept_text": b"\n".join(kept), "dropped": dropped}, coded


def pair_ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs, from 0 without gaps."""
    return np.unique(left * (right.max(initial=0) + 1) + right, return_inverse=True)[1]


def joined(texts: list[array]) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of all texts in one array, and the text of each."""
    ranks = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(t, np.int64) for t in texts]])
    return ranks, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def may_repeat(texts: list[array], window: int) -> list[int]:
    """The texts in which two windows share a hash; no text with a repeated window is missing."""
    ranks, owner = joined(texts)
    if len(ranks) <= window:
        return []
    hashes, width = mix(ranks), 1
    with np.errstate(over="ignore"):
        while width < window:
            hashes = (hashes[:-width] ^ (hashes[:-width] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[width:]
            width *= 2
    inside = owner[: len(hashes)] == owner[window - 1 :]
    keyed = mix(hashes[inside] ^ mix(owner[: len(hashes)][inside]))
    ordered = np.sort(keyed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    return np.unique(owner[: len(hashes)][inside][np.isin(keyed, twice)]).tolist()


def repeated_words(texts: list[array], window: int = REPEAT_WINDOW) -> np.ndarray:
    """For each text (word numbers), its words inside windows that occur twice or more in it.

    Hashes of windows rule out most texts. In the others windows are numbered by doubling (pairs of words, pairs of pairs and
    so on), so equal numbers mean equal words. ``window`` is a power of two.
    """
    counts = np.zeros(len(texts), np.int64)
    chosen = may_repeat(texts, window)
    if not chosen:
        return counts
    ranks, owner = joined([texts[i] for i in chosen])
    width = 1
    while width < window:
        ranks = pair_ranks(ranks[:-width], ranks[width:])
        width *= 2
    starts = np.flatnonzero(owner[: len(ranks)] == owner[window - 1 :])
    _, which, times = np.unique(pair_ranks(owner[starts], ranks[starts]), return_inverse=True, return_counts=True)
    again = starts[times[which] > 1]
    edges = np.zeros(len(owner) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + window, -1)
    covered = np.cumsum(edges[:-1]) > 0
    counts[chosen] = np.bincount(owner[covered], minlength=len(chosen))
    return counts


def judge(texts: list[bytes | None]) -> list[dict]:
    numbers = defaultdict(count().__next__)  # words in the order of their first appearance
    cleaned = [clean_text(t or b"", numbers) for t in texts]
    rows = [row for row, _ in cleaned]
    for row, n_repeat in zip(rows, repeated_words([coded for _, coded in cleaned]).tolist(), strict=True):
        n = row["n_words"]
        row["n_repeat_words"] = n_repeat
        row["base_failed"] = n < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n
        row["kept"] = not row["base_failed"] and 100 * row["n_lost_words"] <= MAX_LOST_PERCENT * n
    return rows


def slices(column: pa.Array) -> list[list[bytes | None]]:
    """The texts of a batch in runs of about SLICE_BYTES."""
    runs, size = [[]], 0
    for text in column.cast(pa.large_binary()):
        value = text.as_py()
        if size and size + len(value or b"") > SLICE_BYTES:
            runs.append([])
            size = 0
        runs[-1].append(value)
        size += len(value or b"")
    return runs


def clean(docs: DataFrame, name: str = "cleaned") -> DataFrame:
    """The documents with a struct (``name``) of their figures, verdict and cleaned text; one pass, no shuffle.

    Words are runs of everything but the six ASCII blanks. A line with a word fails if it does not end like a sentence or is
    thick with punctuation (rule ``punctuation``), is cut by separators or is a short line with a menu phrase
    (``navigation``), or is a short line with a legal or technical phrase (``boilerplate``). Failing lines are left out of
    kept_text and listed in ``dropped``; lines without a word stay. A document is rejected if it has fewer than 20 words, if
    over 30 % of its words stand in 8-word windows that it holds twice or more, or if its failing lines hold over half of its
    words. n_dup_lines counts lines with a word that equal an earlier line of the document.

    Null and empty texts have no words and are rejected; their kept_text is empty. Texts of any length are read whole, each
    row by itself, so rows that repeat get the same result. An empty table gives no rows. All columns stay, but for one that
    has the name of the struct.
    """
    names = [c for c in docs.columns if c != name]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(name, RESULT)])

    def run(batches):
        for batch in batches:
            rows = [row for run_ in slices(batch.column("text")) for row in judge(run_)]
            columns = {c: pa.array([r[c] for r in rows], pa.int64()) for c in _LONGS}
            for c in ("base_failed", "kept"):
                columns[c] = pa.array([r[c] for r in rows], pa.bool_())
            columns["kept_text"] = pa.array([r["kept_text"] for r in rows], pa.binary()).cast(pa.string())
            columns["dropped"] = pa.array([r["dropped"] for r in rows], _ARROW_DROPPED)
            packed = pa.StructArray.from_arrays([columns[f.name] for f in RESULT], [f.name for f in RESULT])
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, packed], [*names, name])

    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame) -> DataFrame:
    """The accepted documents, with the text of their good lines; columns as given. Rows as in ``clean``."""
    name = "cleaned"
    while name in docs.columns:
        name += "_"
    done = clean(docs, name).filter(f"{name}.kept")
    return done.select(*[done[name]["kept_text"].alias(c) if c == "text" else c for c in docs.columns])

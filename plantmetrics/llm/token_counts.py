"""Token counts by finite-state transducers compiled from a tokenizer file.

Two machines run one after the other. The first cuts the text into words: a deterministic machine over character classes in
which an apostrophe's class also says whether a contraction follows. It is run in chunks of ``CHUNK`` characters at once: every
chunk's map from start state to end state is computed, the maps are composed by a parallel prefix scan, and then every chunk
is run from the state that the scan gives it.

The second counts the tokens of a word, byte by byte. Byte-pair encoding has two properties that make it finite-state: an
encoding may be cut between any two of its tokens, and a sequence of tokens is an encoding exactly if each two neighbours are
the encoding of their joined bytes. So for every prefix of a word there is one last token, and what matters for the bytes to
come is, for each earlier place from which the bytes so far begin some longer token: the place in the token trie, the last token
before it, and how many tokens were emitted up to there. That is a state; it is bounded by the longest token. Each transition
carries the number of tokens that are certain from now on, and each state the number that the word's end adds. States are made
when a text first needs them and kept in tables with the broadcast value, and all words of a batch are stepped together.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK = 64
BATCH_CHARS = 1 << 21
MAX_STATES = 200_000  # under 1 kB each; the tables start anew beyond that, so memory is bounded and counts stay the same
LIMIT = 2048

# The pre-tokenizer's white space, contractions and end of word.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
END = "</w>"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

SPACE, LETTER, NUMBER, OTHER, SHORT, LONG = range(6)  # classes; SHORT and LONG: an apostrophe before a contraction of 1 or 2
BETWEEN, IN_LETTERS, IN_OTHERS, ONE_MORE, TWO_MORE = range(5)  # states of the first machine


def cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a word starts, by state * 6 + class."""
    fresh = {SPACE: BETWEEN, LETTER: IN_LETTERS, NUMBER: BETWEEN, OTHER: IN_OTHERS, SHORT: ONE_MORE, LONG: TWO_MORE}
    target, starts = np.zeros(30, np.uint8), np.zeros(30, bool)
    for state in range(5):
        for kind, to in fresh.items():
            at = state * 6 + kind
            if state == IN_LETTERS and kind == LETTER:
                target[at] = IN_LETTERS
            elif state == IN_OTHERS and kind in (OTHER, SHORT, LONG):
                target[at] = IN_OTHERS
            elif state == TWO_MORE and kind == LETTER:
                target[at] = ONE_MORE
            elif state == ONE_MORE and kind == LETTER:
                target[at] = BETWEEN
            else:
                target[at], starts[at] = to, kind != SPACE
    return target, starts


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, turned round."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def compile_tokenizer(path: str) -> dict:
    """Tables for ``count_batch`` from a tokenizer file whose model is byte-level BPE with word ends."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != END or split["pattern"]["Regex"] != SPLIT:
        raise ValueError("this compiler reads byte-level BPE with word ends and its usual word pattern")
    if spec["normalizer"]["normalizers"] != NORMALIZERS:
        raise ValueError("this compiler knows the normalizers NFC, white space and lower case, in this order")
    ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    vocab = model["vocab"]
    merges = {(vocab[a], vocab[b]): i for (a, b), i in ranks.items()}
    halves = {vocab[a + b]: (vocab[a], vocab[b], i) for (a, b), i in ranks.items()}
    letters = byte_letters()
    children: dict[int, int] = {}
    plain, ends, texts = [-1], [-1], {}
    for token, number in model["vocab"].items():
        final = token.endswith(END)
        body, node = token.removesuffix(END) if final else token, 0
        for letter in body:
            at = node << 8 | letters[letter]
            if at not in children:
                children[at] = len(plain)
                plain.append(-1)
                ends.append(-1)
            node = children[at]
        (ends if final else plain)[node] = number
        texts[number] = token
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(code))[0]
        if category in "LN":
            kinds[code] = LETTER if category == "L" else NUMBER
    kinds[WHITE_SPACE] = SPACE
    return {
        "ranks": ranks,
        "children": children,
        "inner": {at >> 8 for at in children},
        "plain": plain,
        "ends": ends,
        "texts": texts,
        "merges": merges,
        "halves": halves,
        "kinds": kinds,
        "special": "|".join(re.escape(t["content"]) for t in spec["added_tokens"]),
    }


# ---- the second machine ------------------------------------------------------------------------------------------------


def encode(symbols: list[str], ranks: dict) -> list[str]:
    """Byte-pair encoding by its definition: merge the pair of the lowest rank, the leftmost first."""
    while len(symbols) > 1:
        rank, at = min((ranks.get(pair, len(ranks)), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
        if rank == len(ranks):
            break
        symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
    return symbols


def symbols_of(token: str) -> list[str]:
    if token.endswith(END):
        body = token.removesuffix(END)
        return [*body[:-1], body[-1] + END]
    return list(token)


def edge(token: int, side: int, halves: dict) -> list[tuple[int, int]]:
    """What stands at one edge (0: left, 1: right) of a token while it is merged together: (part, rank of its merge)."""
    parts = []
    while token in halves:
        parts.append((token, halves[token][2]))
        token = halves[token][side]
    return [(token, -1), *reversed(parts)]


class Machine:
    """The states seen so far, with their transitions, emitted counts and counts at the word's end.

    Transitions are kept in a table of open addressing: ``keys`` holds state * 256 + byte.
    """

    def __init__(self, tables: dict):
        self.tables = tables
        self.valid: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.last = np.zeros(1024, np.uint8)
        self.n_made = 0
        self.keys = np.zeros(0, np.int64)
        self.rehash(12)
        self.state_of(((0, -1, 0),))

    # -- transitions

    def rehash(self, bits: int) -> None:
        used = np.flatnonzero(self.keys >= 0)
        made = list(zip(self.keys[used].tolist(), self.to[used].tolist(), self.emit[used].tolist(), strict=True)) if len(used) else []
        self.bits = bits
        self.keys = np.full(1 << bits, -1, np.int64)
        self.to = np.zeros(1 << bits, np.int32)
        self.emit = np.zeros(1 << bits, np.uint8)
        for key, to, emitted in made:
            self.put(key, to, emitted)

    def home(self, keys):
        return (keys * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)

    def put(self, key: int, to: int, emitted: int) -> None:
        at = self.home(key)
        while self.keys[at] >= 0:
            at = at + 1 & len(self.keys) - 1
        self.keys[at], self.to[at], self.emit[at] = key, to, emitted

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the transitions in the table, and the indexes of those that are not made yet."""
        at = self.home(keys)
        left = np.flatnonzero(self.keys[at] != keys)
        missing = []
        while len(left):
            empty = self.keys[at[left]] < 0
            missing.append(left[empty])
            left = left[~empty]
            at[left] = at[left] + 1 & len(self.keys) - 1
            left = left[self.keys[at[left]] != keys[left]]
        return at, np.concatenate(missing) if missing else left

    # -- tokens

    def is_whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as this one token."""
        known = self.whole.get(token)
        if known is None:
            text = self.tables["texts"][token]
            known = self.whole[token] = encode(symbols_of(text), self.tables["ranks"]) == [text]
        return known

    def edge_of(self, token: int, side: int) -> list[tuple[int, int]]:
        found = self.edges[side].get(token)
        if found is None:
            found = self.edges[side][token] = edge(token, side, self.tables["halves"])
        return found

    def fits(self, first: int, second: int) -> bool:
        """Whether the two tokens are the encoding of their joined bytes; -1: nothing before.

        They are, if no merge across their border comes before the merges by which their parts at the border go on. Of two
        merges of one rank the left one comes first.
        """
        if not self.is_whole(second):
            return False
        if first < 0:
            return True
        known = self.valid.get((first, second))
        if known is None:
            left, right, merges = self.edge_of(first, 1), self.edge_of(second, 0), self.tables["merges"]
            i = j = 0
            never = len(merges)
            known = True
            while True:
                grown_left = left[i + 1][1] if i + 1 < len(left) else never
                grown_right = right[j + 1][1] if j + 1 < len(right) else never
                across = merges.get((left[i][0], right[j][0]), never)
                if across < grown_left and across <= grown_right and across < never:
                    known = False
                    break
                if grown_left == never and grown_right == never:
                    break
                if grown_left <= grown_right:
                    i += 1
                else:
                    j += 1
            self.valid[first, second] = known
        return known

    def state_of(self, key: tuple) -> int:
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(key)
            if found == len(self.last):
                self.last = np.concatenate([self.last, np.zeros(len(self.last), np.uint8)])
            ends = self.tables["ends"]
            for node, before, count in key:
                if ends[node] >= 0 and self.fits(before, ends[node]):
                    self.last[found] = count + 1
                    break
        return found

    def step(self, state: int, byte: int) -> None:
        """Make the transition."""
        children, plain, ends, inner = (self.tables[k] for k in ("children", "plain", "ends", "inner"))
        token, emitted, places = -1, 0, []
        for node, before, count in self.states[state]:
            to = children.get(node << 8 | byte)
            if to is None:
                continue
            if token < 0 and plain[to] >= 0 and self.fits(before, plain[to]):
                token, emitted = plain[to], count + 1
            if to in inner or ends[to] >= 0:
                places.append((to, before, count))
        places.append((0, token, emitted))
        sure = min(p[2] for p in places)
        to = self.state_of(tuple((n, b, c - sure) for n, b, c in places))
        self.n_made += 1
        if 4 * self.n_made > len(self.keys):
            self.rehash(self.bits + 1)
        self.put(state << 8 | byte, to, sure)

    def word_counts(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of every word, given as places in a byte array; the words are stepped together, longest first."""
        if len(self.states) > MAX_STATES:
            self.clear()
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state, total = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        active = len(start) - np.searchsorted(length[::-1], np.arange(int(length[0]) if len(length) else 0), "right")
        for k, n in enumerate(active):
            keys = state[:n] << 8 | data[start[:n] + k]
            at, missing = self.look_up(keys)
            if len(missing):
                for key in np.unique(keys[missing]):
                    self.step(int(key) >> 8, int(key) & 255)
                at, _ = self.look_up(keys)
            total[:n] += self.emit[at]
            state[:n] = self.to[at]
        counts = np.empty(len(start), np.int64)
        counts[order] = total + self.last[state]
        return counts


# ---- the first machine, and both together ------------------------------------------------------------------------------


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """True where a word starts, by chunk maps and a prefix scan over them."""
    target, starts = cutter()
    n = len(kinds)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, SPACE, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    maps = np.repeat(np.arange(5, dtype=np.uint8)[:, None], chunks, axis=1)
    for k in range(CHUNK):
        maps = target[maps * np.uint8(6) + grid[k]]
    reach = 1
    while reach < chunks:  # maps[:, i] becomes the map of all chunks up to i
        maps[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach].astype(np.intp), axis=0)
        reach *= 2
    state = np.full(chunks, BETWEEN, np.uint8)
    state[1:] = maps[BETWEEN, :-1]
    marks = np.zeros((CHUNK, chunks), bool)
    for k in range(CHUNK):
        at = state * np.uint8(6) + grid[k]
        marks[k], state = starts[at], target[at]
    return marks.T.reshape(-1)[:n]


def classes(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Classes of the code points, with contractions marked at their apostrophes."""
    found = kinds[codes]
    quotes = np.flatnonzero(codes == ord("'"))
    after = np.concatenate([codes, [0, 0]])
    for tail in CONTRACTIONS:
        fits = np.logical_and.reduce([after[quotes + 1 + i] == ord(c) for i, c in enumerate(tail)])
        found[quotes[fits]] = SHORT if len(tail) == 1 else LONG
    return found


def normal_form(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final form of sigma


def count_joined(texts: list[str], machine: Machine) -> np.ndarray:
    """Token counts of normalised texts, run as one stream with white space between them."""
    stream = "\n".join(texts) + "\n"
    codes = np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes(codes, machine.tables["kinds"])
    begins = word_starts(kinds)
    breaks = np.flatnonzero(begins | (kinds == SPACE))
    is_start = begins[breaks]
    first, after = breaks[is_start], breaks[np.flatnonzero(is_start) + 1]  # the stream ends with white space
    width = np.ones(len(codes) + 1, np.int64)
    width[0] = 0
    for bound in (0x80, 0x800, 0x10000):
        width[1:] += codes >= bound
    offset = np.cumsum(width)
    data = np.frombuffer(stream.encode("utf-8", "surrogatepass"), np.uint8)
    counts = machine.word_counts(data, offset[first], offset[after] - offset[first])
    ends = np.cumsum([len(t) + 1 for t in texts])
    sums = np.concatenate([[0], np.cumsum(counts)])
    upto = sums[np.searchsorted(first, ends)]
    return np.diff(np.concatenate([[0], upto]))


def pieces_of(text: str) -> list[str]:
    """The text, cut after white space before an ASCII letter or digit where it is very long; such cuts change no token."""
    pieces, start = [], 0
    cut = re.compile(r"[ \n](?=[0-9A-Za-z])")
    while len(text) - start > 2 * BATCH_CHARS:
        found = cut.search(text, start + BATCH_CHARS)
        if not found:
            break
        pieces.append(text[start : found.end()])
        start = found.end()
    pieces.append(text[start:] if start else text)
    return pieces


def count_batch(texts: list[str | None], machine: Machine) -> np.ndarray:
    """Token counts of texts; null counts as empty. Special strings inside a text are one token each, as by default."""
    special = re.compile(machine.tables["special"]) if machine.tables["special"] else None
    total = np.zeros(len(texts), np.int64)
    queue: list[str] = []
    owners: list[int] = []
    size = 0

    def flush():
        nonlocal size
        if queue:
            np.add.at(total, owners, count_joined(queue, machine))
        queue.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        if special is not None and "<" in text:
            text, n = special.subn("\n", text)
            total[i] += n
        for piece in pieces_of(text):
            queue.append(normal_form(piece))
            owners.append(i)
            size += len(piece)
            if size >= BATCH_CHARS:
                flush()
    flush()
    return total


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """The documents with n_bytes (UTF-8), n_tokens and over_limit, in place, without a shuffle.

    Null and empty texts have 0 bytes and 0 tokens. Texts are counted whole, whatever their length; rows that repeat are counted
    each; an empty table gives no rows. Columns of the documents with one of these three names are replaced.
    """
    tables = docs.sparkSession.sparkContext.broadcast(compile_tokenizer(path))
    added = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    names = [c for c in docs.columns if c not in dict(added)]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(*a) for a in added])

    def run(batches):
        kept = tables.value
        machine = kept.get("machine")
        if machine is None:
            machine = kept["machine"] = Machine(kept)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = count_batch(texts, machine)
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)],
                [*names, *[a for a, _ in added]],
            )

    return docs.select(*names).mapInArrow(run, schema)

"""Line rules, term divergence and vector codes against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantmetrics.llm import line_rules, term_divergence, vector_codes

# ---- line rules --------------------------------------------------------------------------------------------------------

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def split_words(text):
    return [w for w in BLANK.split(text or "") if w]


def repeated_by_dict(words, width=8):
    places = defaultdict(list)
    for i in range(len(words) - width + 1):
        places[tuple(words[i : i + width])].append(i)
    return len({i + j for starts in places.values() if len(starts) > 1 for i in starts for j in range(width)})


def figures_by_hand(text):
    text = text or ""
    words = split_words(text)
    lines = [line for line in text.split("\n") if split_words(line)]
    n, repeats = len(words), repeated_by_dict(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeats,
        "base_failed": n < 20 or 100 * repeats > 30 * n,
    }




def prose(n, first=0):
    """Sentences without a repeated window of eight words."""
    return " ".join(f"Note{i} tells of some plain thing." for i in range(first, first + n))


MENUS = "\n".join([prose(4), "Home | News | Sports | Weather", "All rights reserved.", "Click here to go on.", prose(3, 50) + " Finé!"])
TEXTS = [
    None,
    "",
    " \t\r\n\x0b\x0c\n",
    prose(5),
    MENUS,
    "".join(f"A{i} | B | C | D{i} | E | F | G{i} | H | I | J{i} | K | L\n" for i in range(6)) + prose(2),
    "".join(f"LOUD{i}!! WORDS!! ARE!! NOT!! A{i}!! TEXT!!\n" for i in range(6)),
    "\n".join(f"a line without an end number {i}" for i in range(9)),
    "one two three four five six seven eight " * 12 + ".",
    "the same line of eight words is here.\nthe same line of eight words is here.\n" + prose(20),
    "中文。    \u0085x " * 30 + ".",
    prose(40_000),
    prose(3),
    prose(3),
]


def test_figures_and_verdicts(spark):
    frame = spark.createDataFrame([(i, t, "own", -1) for i, t in enumerate(TEXTS)], "doc_id long, text string, cleaned string, kept int")
    got = {r["doc_id"]: r["cleaned"] for r in line_rules.clean(frame).collect()}
    for i, text in enumerate(TEXTS):
        assert {k: got[i][k] for k in figures_by_hand(text)} == figures_by_hand(text), i
    assert [i for i in sorted(got) if got[i]["base_failed"]] == [0, 1, 2, 8, 10, 12, 13]
    assert [i for i in sorted(got) if got[i]["kept"]] == [3, 4, 9, 11]
    assert [(d["line_no"], d["rule"]) for d in got[4]["dropped"]] == [(1, "punctuation"), (2, "boilerplate"), (3, "navigation")]
    assert got[4]["kept_text"] == prose(4) + "\n" + prose(3, 50) + " Finé!"
    assert got[2]["kept_text"] == TEXTS[2] and got[0]["kept_text"] == "" and not got[0]["kept"]
    assert [len(got[i]["dropped"]) for i in (5, 6, 7)] == [6, 6, 9]
    assert got[9]["n_dup_lines"] == 1 and got[9]["n_repeat_words"] == 16


def test_a_rule_for_each_kind_of_line():
    def rule(line):
        raw = line.encode()
        return line_rules.failed_rule(raw, raw.split(), sum(map(len, line.split())))

    assert rule("no end") == "punctuation"
    assert rule("WHAT!! IS!! THIS!!") == "punctuation"
    assert rule("Home > Shop > Garden > Hoses and all the rest.") == "navigation"
    assert rule("Read More about it.") == "navigation"
    assert rule("Read our Privacy Policy before you go.") == "boilerplate"
    assert rule("In this essay the privacy policy of " + "word " * 30 + "is told.") is None
    assert rule("An ordinary line with blanks behind it.  \t") is None


def test_repeats_equal_the_dictionary():
    rng = random.Random(1)
    for _ in range(200):
        texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(5)]
        got = [r["n_repeat_words"] for r in line_rules.judge([t.encode() for t in texts])]
        assert got == [repeated_by_dict(t.split()) for t in texts]


def test_clean_texts_replace_the_column(spark):
    frame = spark.createDataFrame([(1, TEXTS[4], 5), (2, "short", 6), (None, prose(5), 7)], "doc_id long, text string, cleaned int")
    kept = line_rules.keep_clean(frame)
    assert kept.columns == frame.columns
    rows = {r["cleaned"]: r["text"] for r in kept.collect()}
    assert set(rows) == {5, 7} and "Home" not in rows[5]
    assert line_rules.clean(frame.filter("false")).count() == 0


# ---- terms -------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def divergence_by_hand(rows, min_docs, top):
    held, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", TERM.findall(lower(text or ""))
        sources[lang].add(source)
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang, names in sources.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]

        def shares(count):
            below = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // below for t in kept}

        p = {s: shares(counts[lang, s]) for s in names}
        q = shares(sum((counts[lang, s] for s in names), Counter()))
        for s in names:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in names if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)}
            above = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(above[:top], 1)}
    return out


def invented(rng, n):
    words = ["the", "exactly8", "ninechars", "sixteencharacter", "seventeenlettersx", "x" * 40, "y" * 33, "été", "中" * 9, "a"]
    words += ["".join(rng.choice("abcdeXYZ") for _ in range(rng.randint(1, 20))) for _ in range(25)]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", None])
        source = "hot" if rng.random() < 0.5 else rng.choice(["s1", "s2", None, "S-" + str(i % 7)])
        rows.append((lang, source, rng.choice([" ", "1", "_", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 30)))))
    return rows + [("one", "only", "a few words"), ("en", "none", None), ("en", "none too", ""), ("de", "digits", "12 34")]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, monkeypatch, small):
    if small:  # many pieces, flushes, blocks and tiles, and joins by exchange
        for name, value in {"PIECE_BYTES": 40, "HELD_RUNS": 30, "CELLS": 20, "TILE_SOURCES": 3, "BROADCAST_GROUPS": 0}.items():
            monkeypatch.setattr(term_divergence, name, value)
    rows = invented(random.Random(4), 200)
    frame = spark.createDataFrame([(*r, -1) for r in rows], "lang string, source string, text string, n int")
    frame = frame.withColumns({c: F.lit(0) for c in ("term", "docs", "rank", "value", "total", "tile")})
    got = [tuple(r) for r in term_divergence.measure_divergence(frame, min_docs=8, top_terms=5).collect()]
    assert len(got) == len(set(got))
    assert set(got) == divergence_by_hand(rows, 8, 5)


def test_divergence_of_little(spark):
    schema = "lang string, source string, text string"
    nothing = spark.createDataFrame([], schema)
    assert term_divergence.measure_divergence(nothing).count() == 0
    rare = spark.createDataFrame([("en", "a", "some words"), ("en", "b", "other words"), ("en", "b", "other words")], schema)
    got = sorted(tuple(r) for r in term_divergence.measure_divergence(rare).collect())
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_long_texts_are_counted_in_pieces():
    text = b"ab cd " * (term_divergence.PIECE_BYTES // 3) + b"z" * 100_000
    assert len(term_divergence.pieces(text)) > 1 and b"".join(term_divergence.pieces(text)) == text
    assert term_divergence.pieces(b"q" * (2 * term_divergence.PIECE_BYTES)) == [b"q" * (2 * term_divergence.PIECE_BYTES)]


def test_radix_order_is_the_stable_order():
    rng = np.random.default_rng(2)
    for high in (3, 1 << 20, 1 << 63):
        a, b = (rng.integers(0, high, 500, dtype=np.uint64) for _ in range(2))
        assert term_divergence.radix_order(b, a).tolist() == np.lexsort((b, a)).tolist()


def test_shares_are_exact_beyond_64_bits():
    count, total, terms = 3 * 10**14 + 7, 7 * 10**14 + 1, 123_457
    want = 1 + 10**9 * (count + 5) // (total + 5 * terms)
    assert term_divergence.smoothed_array(np.array([count]), np.array([total]), terms).tolist() == [want]


def test_native_shares(spark):
    count, total, terms = 3 * 10**14 + 7, 7 * 10**14 + 1, 123_457
    frame = spark.range(1).select(term_divergence.smoothed(*[F.lit(x).cast("long") for x in (count, total, terms)]).alias("p"))
    assert frame.first()["p"] == 1 + 10**9 * (count + 5) // (total + 5 * terms)


# ---- codes -------------------------------------------------------------------------------------------------------------


def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    """Plain integer loops over (vec_id, vector) rows in id order."""
    pieces = [[[math.floor(4096 * x) for x in v][p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)] for _, v in rows]
    books = [[own[p] for own in pieces[:entries]] for p in range(parts)]

    def nearest(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for own in pieces:
                groups[nearest(own[p], books[p])[1]].append(own[p])
            for i, members in groups.items():
                books[p][i] = [sum(column) // len(members) for column in zip(*members)]
    found = [[nearest(own[p], books[p]) for p in range(parts)] for own in pieces]
    flat = ",".join(str(x) for book in books for entry in book for x in entry)
    return [[i for _, i in f] for f in found], [sum(d for d, _ in f) for f in found], hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("block", [4096, 7])
def test_codes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 16)]) for i in range(90)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # many copies of one vector, ties
    frame = spark.createDataFrame([(i, v, i % 3 or None, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, error int")
    coded, books = vector_codes.compress(frame.repartition(5))
    got = {r["vec_id"]: r for r in vector_codes.with_label_error(coded).collect()}
    codes, errors, checksum = codes_by_hand(rows)
    assert [got[i]["codes"] for i, _ in rows] == codes
    assert [got[i]["error"] for i, _ in rows] == errors
    assert vector_codes.codebook_hash(books) == checksum
    sums = defaultdict(int)
    for (i, _), e in zip(rows, errors):
        sums[i % 3] += e
    assert [got[i]["label_error"] for i, _ in rows] == [sums[i % 3] for i, _ in rows]
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    spread = {r["vec_id"]: r["label_error"] for r in vector_codes.with_label_error(coded).collect()}
    assert spread == {i: r["label_error"] for i, r in got.items()}


def test_codes_of_awkward_vectors(spark):
    rows = [
        (1, [0.5] * 9, 1),
        (2, None, 1),
        (3, [float("nan")] * 9, 1),
        (4, [None] * 9, 1),
        (5, [float("-inf")] * 9, 1),
        (6, [], 1),
        (7, [1.0] * 3, 1),
        (8, [-0.0001] * 9, None),
        (8, [-0.0001] * 9, None),
        (None, [0.25] * 9, 2),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, books = vector_codes.compress(frame)
    got = sorted((str(r["vec_id"]), r["codes"], r["error"]) for r in coded.collect())
    assert [g[0] for g in got] == ["1", "8", "8", "None"]
    assert [g[2] for g in got] == [0, 0, 0, 0] and books.shape == (8, 4, 2)
    assert got[1][1] == got[2][1] == [1] * 5 + [0] * 3  # parts of filling zeros are equal, and the lowest entry wins
    empty, none = vector_codes.compress(frame.filter("false"))
    assert empty.count() == 0 and empty.columns == coded.columns and none.size == 0
    assert vector_codes.with_label_error(empty).count() == 0
    far = spark.createDataFrame([(1, [1e9] * 8, 1)], frame.schema)
    with pytest.raises(Exception, match="lies beyond"):
        vector_codes.compress(far)

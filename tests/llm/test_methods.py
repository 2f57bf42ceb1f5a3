"""The methods behind the operators against brute force, and held-out accuracy."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from plantmetrics.llm import (
    decontamination,
    line_dedup,
    mixing,
    near_dedup,
    quality,
    sharding,
    token_counts,
    toxicity,
    vector_search,
)
from plantmetrics.llm.components import components
from plantmetrics.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def documents(spark, folder=SMALL):
    return spark.read.parquet(f"{folder}/documents.parquet")


# ---- language ----------------------------------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    got = QUERIES["op1_language_id"](spark, SF).join(documents(spark, SF).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


# ---- tokens ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def machine():
    return token_counts.Machine(token_counts.compile_tokenizer(TOKENIZER))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def counted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


PIECES = (
    "a b s t re ' 's 're 'll 'LL 'T é é Σ ΑΣ İ ß ñ 中 文 😀 1 22 ½ ² ٣ <|endoftext|> <|startoftext|> <|ENDOFTEXT|> < | > !! ..."
    " the THE ing ﬁ Å Å ǆ _ क ् ष 한 가 worthwhile antidisestablishmentarianism"
).split() + [" ", "\n", "\t", " ", " ", "​", "\x1c", "\x85", "\x00"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_tokens_of_odd_texts(machine, library, text):
    assert list(token_counts.count_batch([text], machine)) == counted(library, [text])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_tokens_of_any_text(machine, library, text):
    assert list(token_counts.count_batch([text], machine)) == counted(library, [text])


def test_tokens_of_long_runs(machine, library):
    texts = ["a" * 20000, "ab" * 5000, "!" * 3000, "ñ" * 999, "x" * 64, " " * 130 + "y", "it's " * 500]
    assert list(token_counts.count_batch(texts, machine)) == counted(library, texts)


def test_tokens_do_not_depend_on_the_cuts(machine, library, monkeypatch):
    text = "The words’ order, it's 12 words; " * 400
    monkeypatch.setattr(token_counts, "BATCH_CHARS", 50)
    monkeypatch.setattr(token_counts, "MAX_STATES", 20)
    assert list(token_counts.count_batch([text, None, text], machine)) == [*counted(library, [text]), 0, *counted(library, [text])]


def test_tokens_of_all_documents(spark, library):
    rows = QUERIES["op2_token_counts"](spark, SMALL).join(documents(spark), "doc_id").collect()
    assert [r["n_tokens"] for r in rows] == counted(library, [r["text"] for r in rows])
    assert all(r["n_bytes"] == len(r["text"].encode()) and r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)


def test_pairs_of_tokens(machine):
    texts, rng = machine.tables["texts"], random.Random(1)
    plain = [t for t, s in texts.items() if not s.endswith("</w>") and machine.is_whole(t)]
    for _ in range(3000):
        a, b = rng.choice(plain), rng.choice(list(texts))
        symbols = token_counts.symbols_of(texts[a]) + token_counts.symbols_of(texts[b])
        assert machine.fits(a, b) == (token_counts.encode(symbols, machine.tables["ranks"]) == [texts[a], texts[b]])


# ---- quality and toxicity ----------------------------------------------------------------------------------------------


def held_out_rows(spark, query, label, folds, fold):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES[query](spark, SF).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    return [(r[label], r["predicted"], r["score"]) for r in rows if r["held_out"]]


def test_quality_of_held_out_documents(spark):
    rows = held_out_rows(spark, "op3_quality", "quality", 4, 2)
    assert np.mean([y == p for y, p, _ in rows]) > 0.95


def test_toxicity_of_held_out_documents(spark):
    rows = held_out_rows(spark, "op4_toxicity", "toxic", 5, 0)
    assert np.mean([y == p for y, p, _ in rows]) > 0.93
    assert np.mean([p for y, p, _ in rows if y == 0]) < 0.03


def test_cosine_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    d = len(quality.STATISTICS)
    model = {
        "mean": np.zeros(d),
        "deviation": np.ones(d),
        "waves": rng.normal(size=(d, quality.FEATURES)) / np.sqrt(d),
        "phases": rng.uniform(0, 2 * np.pi, quality.FEATURES),
    }
    x = rng.normal(size=(40, d))
    z = quality.fourier(x, model)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(z @ z.T - kernel).max() < 0.35 and np.abs(z @ z.T - kernel).mean() < 0.06


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 5)), min_size=1, max_size=30))
def test_isotonic_means_rise(values):
    y, w = np.array([v[0] for v in values]), np.array([float(v[1]) for v in values])
    x, fitted = quality.pool_adjacent(np.arange(len(y), dtype=float), y, w)
    assert (np.diff(fitted) > 0).all() and (np.diff(x) > 0).all()
    assert y.min() - 1e-9 <= fitted.min() and fitted.max() <= y.max() + 1e-9


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = {k: v.astype(float) for k, v in toxicity.new_network(rng).items()}
    x, y, weight = rng.normal(size=(5, 3, toxicity.INPUTS)), np.array([1.0, 0.0, 1.0]), np.ones(3)
    padded = np.zeros((5, 3), bool)
    padded[3:, 1] = True
    grad = toxicity.gradients(x, padded, y, weight, net)[1]
    for name, values in net.items():
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in values.shape)
            before, losses = values[at], []
            for change in (1e-2, -1e-2):
                values[at] = before + change
                losses.append(toxicity.gradients(x, padded, y, weight, net)[0])
            values[at] = before
            assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(grad[name][at], rel=0.02, abs=1e-4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 150), min_size=1, max_size=5))
def test_windows_cover_every_word(sizes):
    rows = [np.arange(1, n + 1) + 1000 * i for i, n in enumerate(sizes)]
    windows, owner = toxicity.windows_of(rows)
    for i, row in enumerate(rows):
        own = windows[:, owner == i]
        assert set(own[own > 0]) == set(row)
        assert own.shape[1] == (0 if not len(row) else 1 + max(0, -(-(len(row) - toxicity.WINDOW) // toxicity.STRIDE)))


def test_long_texts_score_as_in_one_piece(monkeypatch):
    import pandas as pd

    toxic, clean = [f"fine words here then nasty{i % 3} things" for i in range(30)], ["fine words here and there"] * 30
    model = toxicity.fit(pd.DataFrame({"text": toxic + clean, "y": [1.0] * 30 + [0.0] * 30}), 0.5)
    text = "fine words " * 300 + "nasty1 things " + "fine words here " * 300
    whole = toxicity.Scorer(model).scores([text, "fine words here", None, ""])
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 160)
    assert toxicity.Scorer(model).scores([text, "fine words here", None, ""]) == pytest.approx(whole, rel=1e-4)
    assert whole[0] > 0.5 > whole[1] and list(whole[2:]) == [0.0, 0.0]


def test_toxic_passages_at_every_offset():
    import pandas as pd

    rng = random.Random(3)
    fine, bad = [f"fine{i}" for i in range(40)], [f"nasty{i}" for i in range(40)]

    def passage(n):
        return [rng.choice(bad if i % 3 == 0 else fine) for i in range(n)]

    toxic = [" ".join(passage(rng.randint(8, 32))) for _ in range(200)]
    clean = [" ".join(rng.choices(fine, k=rng.randint(8, 60))) for _ in range(200)]
    scorer = toxicity.Scorer(toxicity.fit(pd.DataFrame({"text": toxic + clean, "y": [1.0] * 200 + [0.0] * 200}), 0.5))
    for n in (18, 25, 32):
        own = passage(n)
        texts = [" ".join(rng.choices(fine, k=48 + o) + own + rng.choices(fine, k=60)) for o in range(toxicity.STRIDE)]
        assert min(scorer.scores(texts)) > 0.5
    assert max(scorer.scores([" ".join(rng.choices(fine, k=140)) for _ in range(16)])) < 0.5


# ---- vectors -----------------------------------------------------------------------------------------------------------


def brute_nearest(ids, vectors, i, k):
    score = (vectors * vectors[i]).sum(axis=1)
    order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
    return ids[order], score[order]


@pytest.mark.parametrize("hot", [False, True])
def test_vector_recall(spark, hot, monkeypatch):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    if hot:  # a third of the rows are one vector
        monkeypatch.setattr(vector_search, "BLOCK", 64)
        one = frame.filter("vec_id = 3").first()["embedding"]
        frame = frame.withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.array(*map(F.lit, one))).otherwise(F.col("embedding")))
    rows = frame.sort("vec_id").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows])
    found = collections.defaultdict(list)
    for r in vector_search.search(frame, F.col("vec_id") % 20 == 0).sort("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    queries = [i for i, v in enumerate(ids) if v % 20 == 0]
    assert sorted(found) == sorted(ids[queries])
    recall = []
    for i in queries:
        true, score = brute_nearest(ids, vectors, i, 20)
        got = found[ids[i]]
        assert len(got) == 20 and got == sorted(got, key=lambda x: (-x[1], x[0]))
        recall.append(len({v for v, _ in got} & set(true)) / 20)
        if hot and ids[i] % 3 == 0:
            assert [v for v, _ in got] == list(true)
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize("hot", [False, True])
def test_leaves_grow_beyond_the_sample(spark, monkeypatch, hot):
    """A sample too small for the table's leaves: they are split again, and each leaf holds few rows."""
    monkeypatch.setattr(vector_search, "FIT_ROWS", 80)
    monkeypatch.setattr(vector_search, "FIT_PER_LEAF", 6)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (40, 8))
    rows = [(i, (centres[0] if hot and i % 3 else centres[i % 40] + rng.normal(0, 0.05, 8)).tolist()) for i in range(1500)]
    vectors = vector_search.clean_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    tree, index, counts = vector_search.build_index(vectors)
    leaves = int(vector_search.LEAVES_PER_ROOT * 1500**0.5)
    assert counts.sum() == index.count() == 1500 and (tree["leaf"] >= 0).sum() == len(counts)
    assert len(counts) > 80 // 6 * 2 and len(counts) <= 1.5 * leaves
    if not hot:
        assert counts.max() < 1500 / 20
    points, leaf = np.array([v for _, v in rows]), {r["vec_id"]: r["leaf"] for r in index.collect()}
    assert vector_search.leaves_of(points, tree).tolist() == [leaf[i] for i, _ in rows]
    found = collections.defaultdict(set)
    for r in vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect():
        found[r["query_id"]].add(r["vec_id"])
    ids = np.arange(1500)
    true = {i: set(brute_nearest(ids, points, i, 5)[0].tolist()) for i in range(0, 1500, 20)}
    assert np.mean([len(found[i] & true[i]) / 5 for i in true]) >= 0.9


# ---- lines, items, near copies -----------------------------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
def test_perfect_hash_has_no_gaps(keys):
    keys = np.array(sorted(keys), np.uint64)
    table = line_dedup.build_hash(keys)
    assert sorted(line_dedup.find(table, keys)) == list(range(len(keys)))


def test_perfect_hash_knows_its_keys():
    rng = np.random.default_rng(2)
    keys, others = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)
    prints, owners = line_dedup.mix(keys), np.arange(5000)
    shard = line_dedup.unpack(line_dedup.pack(keys, prints, owners, np.ones(5000, np.int64)))
    known, got = line_dedup.owners_of(shard, keys, prints)
    assert known.all() and (got == owners).all()
    assert not line_dedup.owners_of(shard, others, line_dedup.mix(others))[0].any()


def brute_lines(rows):
    def key(line):
        return line.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == doc]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_with_small_shards_and_a_hot_line(spark):
    rng = random.Random(4)
    lines = [f"line number {i} of the corpus" for i in range(60)] + ["short", "", "  ÉTÉ Line with Blanks \t", "été line with blanks"]
    rows = []
    for doc in range(150):
        own = [rng.choice(lines) for _ in range(rng.randint(0, 6))] + [f"only in {doc} and nowhere else"]
        rows.append((doc, "\n".join(own + ["This very line is everywhere"] * (doc % 3))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(frame, keys_per_shard=7, probes_per_task=20).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got} == brute_lines(rows)


def brute_items(text, items, window=13):
    words, hit, found = decontamination.words_of(text), set(), set()
    for item, body in items:
        own = decontamination.words_of(body)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            piece = own[i : i + window]
            for j in range(len(words) - len(piece) + 1):
                if words[j] == piece[0] and words[j : j + len(piece)] == piece:
                    hit.update(range(j, j + len(piece)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def test_items_against_every_window(spark):
    rng = random.Random(5)
    words = ["red", "Blue", "green", "été", "x1"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([0, 2, 5, 13, 16, 40, 16])]
    rows = []
    for doc in range(60):
        text = [rng.choice(words + ["other"]) for _ in range(rng.randint(0, 60))]
        if doc % 2:
            text[3:3] = rng.choice(items)[1].split()[doc % 3 :]
        rows.append((doc, rng.choice([" ", "--", ", "]).join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.scan(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    texts = dict(rows)
    for r in got:
        scan = r["scan"]
        n, hit, found = brute_items(texts[r["doc_id"]], [(str(i), t) for i, t in items])
        assert (scan["n_words"], scan["n_hit"], scan["item_ids"]) == (n, hit, found)
        assert scan["contaminated"] == (hit > 0 and 20 * hit >= n)
        spans = [texts[r["doc_id"]][s["start"] : s["end"]] for s in scan["spans"]]
        assert sum(len(decontamination.words_of(s)) for s in spans) == hit


def test_strips_and_suffix_windows_of_the_automaton(monkeypatch):
    """Many short strips, windows that end in shorter ones, and words that no item has."""
    monkeypatch.setattr(decontamination, "STRIPS", 7)
    rng = random.Random(12)
    for trial in range(40):
        items = [[rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(5)]
        coded, starts = np.array(sum(items, []), np.int32), np.cumsum([0, *map(len, items)])
        window = 4
        machine = decontamination.build_automaton(coded, starts, window, 10_000)
        words = np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 400))], np.int64)
        pieces = {}
        for name, own in enumerate(items):
            for i in range(max(1, len(own) - window + 1)):
                pieces.setdefault(tuple(own[i : i + window]), set()).add(name)
        want = sorted(
            (i + len(p) - 1, len(p), tuple(sorted(names)))
            for p, names in pieces.items()
            for i in range(len(words) - len(p) + 1)
            if tuple(words[i : i + len(p)]) == p
        )
        places, nodes = decontamination.run_automaton(machine, words, window)
        first, depth = machine["first"], machine["depth"]
        got = [(int(p), int(depth[n]), tuple(machine["items"][first[n] : first[n + 1]].tolist())) for p, n in zip(places, nodes)]
        assert sorted(got) == want, trial


def test_too_many_nodes_are_an_error(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id int, text string")
    docs = spark.createDataFrame([(1, "w1 w2")], "doc_id int, text string")
    compiled = decontamination.compile_items(items)
    assert len(compiled["edges"]) == 28 * 13
    with pytest.raises(ValueError, match="MAX_NODES"):
        decontamination.compile_items(items, max_nodes=100)
    assert decontamination.scan(docs, items).first()["scan"]["n_hit"] == 0


def brute_components(sets):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in docs}


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def test_near_copies_against_all_pairs(spark, monkeypatch):
    """Groups of copies, chains of edits, and a group of which the origin is similar to all, but the others not to each other."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(6)

    def words(n):
        return [f"w{rng.randint(0, 5000)}" for _ in range(n)]

    def edited(base, n):
        out = list(base)
        for at in rng.sample(range(len(out)), n):
            out[at] = f"edit{rng.randint(0, 10**6)}"
        return out

    texts = [words(rng.randint(20, 80)) for _ in range(60)]
    base = words(120)
    texts += [edited(base, 7) for _ in range(30)]  # 0.79 to 0.89 from the origin, less from each other
    texts.insert(70, base)
    chain = words(100)
    for _ in range(12):
        chain = edited(chain, 4)
        texts.append(chain)
    texts += [texts[3], texts[3], ["one"], ["one"], ["one", "two"], [], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n in (2, 5):
        got = near_dedup.near_duplicates(frame, n).collect()
        sets = {d: shingles(t, n) for d, t in rows}
        want = brute_components(sets)
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, near_dedup.POSITIONS - 1), max_size=near_dedup.RADIUS), st.integers(0, 2**32))
def test_signatures_within_the_radius_share_a_key(places, seed):
    a = np.random.default_rng(seed).integers(0, 256, near_dedup.POSITIONS).astype(np.uint8)
    b = a.copy()
    b[list(places)] ^= 1
    keys = near_dedup.key_values(np.stack([a, b]))
    assert set(keys[0]) & set(keys[1])


def test_components_against_union_find(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1120)]
    links += [(2000, i) for i in range(2001, 2100)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_too_few_steps_are_an_error(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    monkeypatch.setattr("plantmetrics.llm.components.MAX_STEPS", 2)
    with pytest.raises(RuntimeError, match="after 2 steps"):
        components(chain)


# ---- shards and mixture ------------------------------------------------------------------------------------------------


def test_shards_against_running_sums(spark):
    got = sharding.shard(documents(spark).repartition(5), 16).sort("doc_id").collect()
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    assert [r["doc_id"] for r in got] == sorted(texts)
    total, before, slots = sum(r["size"] for r in got), 0, collections.Counter()
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert r["shard"] == (2 * before + r["size"]) * 16 // (2 * total)
        assert r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        before += r["size"]
    bytes_of = collections.Counter()
    for r in got:
        bytes_of[r["shard"]] += r["size"]
    assert max(abs(b - total / 16) for b in bytes_of.values()) < max(r["size"] for r in got)


def test_shards_are_native(spark):
    plan = QUERIES["op9_sharding"](spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_texts_are_exchanged_once_for_shards(spark):
    """In the range exchange, before the rows are written; what reads them only exchanges places and sizes."""
    docs = documents(spark)
    placed = sharding.shard(docs, 4, carry=tuple(docs.columns))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = placed._jdf.queryExecution().explainString(mode)
    moved = re.findall(r"\) (?:Broadcast)?Exchange\s*\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved and not any("document" in columns for columns in moved)


def test_shards_of_equal_rows_and_ids(spark):
    """Rows that repeat an id, or all of a row, are each placed once, in slots without gaps; so is a table of one row."""
    rows = [(i % 5 if i % 7 else None, "x" * (i % 4) if i % 3 else "same") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.shard(docs, 3, carry=("doc_id", "text")).collect()
    assert collections.Counter((r["document"]["doc_id"], r["document"]["text"]) for r in got) == collections.Counter(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == [0, 1, 2] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert [(r["shard"], r["slot"]) for r in sharding.shard(docs.limit(1), 3).collect()] == [(1, 0)]
    assert sharding.shard(docs.limit(0), 3).collect() == []


def test_written_shards(spark, tmp_path):
    docs = documents(spark)
    sharding.write_shards(sharding.shard(docs, 4, carry=tuple(docs.columns)), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_margins_are_met(spark):
    mixed = mixing.mix_documents(documents(spark, SF)).cache()
    for margin in mixing.MARGINS:
        got = mixed.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("rate")).alias("mixed"), F.sum("tokens").alias("now"))
        rows = got.collect()
        total, power = sum(r["mixed"] for r in rows), sum(r["now"] ** mixing.TEMPER for r in rows)
        assert total == pytest.approx(sum(r["now"] for r in rows), rel=1e-6)
        for r in rows:
            assert r["mixed"] / total == pytest.approx(r["now"] ** mixing.TEMPER / power, rel=1e-3)
    assert all(abs(r["n_copies"] - r["rate"]) < 1 for r in mixed.collect())


def test_sampled_tokens_meet_the_targets(spark):
    docs = documents(spark, SF)
    mixed = mixing.mix_documents(docs).cache()
    assert mixed.filter("rate > 1").count() > 100
    out = corpus_pipeline.mix_sources(spark, docs, SF)
    times = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert times == {r["doc_id"]: r["n_copies"] for r in mixed.filter("n_copies > 0").collect()}
    sampled = mixing.describe(out).cache()
    whole = mixed.agg(F.sum("tokens")).first()[0]
    for margin in mixing.MARGINS:
        got = {r[margin]: r["t"] for r in sampled.groupBy(margin).agg(F.sum("tokens").alias("t")).collect()}
        part = F.col("rate") - F.floor("rate")
        rows = mixed.groupBy(margin).agg(
            F.sum("tokens").alias("now"), F.sqrt(F.sum(F.col("tokens") ** 2 * part * (1 - part))).alias("spread")
        )
        rows = rows.collect()
        power = sum(r["now"] ** mixing.TEMPER for r in rows)
        for r in rows:
            target = r["now"] ** mixing.TEMPER / power * whole
            assert abs(got.get(r[margin], 0) - target) <= 4 * r["spread"] + 1e-3 * target


def test_given_targets(spark):
    docs = documents(spark, SF)
    targets = {
        "language": spark.createDataFrame([("=en", 0.25), ("=fr", 0.75)], "language string, target double"),
        "source": spark.createDataFrame([(f"=src{i}", 0.05) for i in range(20)], "source string, target double"),
    }
    cells = mixing.describe(docs).groupBy(*mixing.MARGINS).agg(F.sum("tokens").alias("tokens"))
    raked = mixing.rake(cells, targets, rounds=10)
    got = {r["language"]: r["w"] for r in raked.groupBy("language").agg(F.sum("weight").alias("w")).collect()}
    assert got["=en"] == pytest.approx(0.25, rel=1e-3) and got["=fr"] == pytest.approx(0.75, rel=1e-3)
    assert got["=de"] == 0


# ---- the pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    docs = documents(spark)
    columns, before = docs.columns, None
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        assert set(kept[name].items()) <= set(before.items())
        if name == "near_dedup":
            roots = brute_components({d: shingles((t or "").lower(), 5) for d, t in before.items()})
            assert set(kept[name]) == {d for d, r in roots.items() if d == r}
        if name == "decontamination":
            items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            dirty = set()
            for d, t in before.items():
                n, hit, _ = brute_items(t, items)
                if hit and 20 * hit >= n:
                    dirty.add(d)
            assert set(before) - set(kept[name]) == dirty
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in documents(spark).collect()} - set(kept["quality"])
    assert np.mean([labels[d] == 0 for d in gone if d in labels]) > 0.9
    assert kept["sharding"] == kept["mixing"]


def test_good_documents_are_kept_in_one_pass(spark, monkeypatch):
    """The rows that the scores accept, with one pass of the texts through task functions."""
    from plantmetrics.llm import quality
    from plantmetrics.llm.common import in_fold

    monkeypatch.setattr(quality, "JUDGED_ROWS", 7)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    train = ~in_fold(F.col("doc_id"), 4, 2)
    kept = quality.keep_good(docs, labels, train)
    stats = quality.with_statistics(docs.select("doc_id", "text"))
    model = quality.fit(quality.label_rows(stats.drop("text"), labels, train))
    wanted = quality.with_score(stats.drop("text"), model).where(F.col("score") >= quality.THRESHOLD)
    assert kept.schema == docs.schema and 0 < kept.count() < docs.count()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in wanted.collect()}
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1

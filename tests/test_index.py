"""The stored search index: versions, changed documents, merged deltas, dead writers, and bounds that rule segments out."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_scale_blocks import brute_search

from plantmetrics.operators import block_index, index_store, retrieval

WORDS = [f"word{i}" for i in range(60)]


def texts(n, seed=0):
    rng = random.Random(seed)
    return {f"doc{i:03d}.txt": " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 40))) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "file_name string, text string")


def answers(spark, path, k=3):
    found = index_store.load(spark, path)
    questions = spark.createDataFrame([(f"Q{i}", f"{WORDS[i]} {WORDS[i + 7]}") for i in range(12)], "question_id string, question string")
    hits = retrieval.search_index(questions, found.segments, found.idf, k)
    return sorted(map(tuple, hits.collect()), key=str)


def fresh_answers(spark, docs, path):
    index_store.refresh(frame(spark, docs), path)
    return answers(spark, path)


def test_changes_reach_the_answers(spark, tmp_path):
    docs, path = texts(40), str(tmp_path / "index")
    assert index_store.refresh(frame(spark, docs), path) == 1
    first = answers(spark, path)
    assert index_store.refresh(frame(spark, docs), path) == 1
    docs["doc003.txt"] = f"{WORDS[0]} {WORDS[7]} {WORDS[0]} {WORDS[7]}"
    assert index_store.refresh(frame(spark, docs), path) == 2
    second = answers(spark, path)
    assert second != first and second == fresh_answers(spark, docs, str(tmp_path / "anew"))
    assert [r for r in second if r[0] == "Q0" and r[1] == 1][0][2] == "DOC_004_CH_001"
    del docs["doc000.txt"]  # all later documents get other numbers
    docs["zzz.txt"] = f"{WORDS[1]} {WORDS[8]}"
    assert index_store.refresh(frame(spark, docs), path) == 3
    assert answers(spark, path) == fresh_answers(spark, docs, str(tmp_path / "third"))
    # a reader may keep an older version
    assert index_store.load(spark, path, 1).chunks.count() == 40
    assert index_store.versions(spark, path) == [1, 2, 3]
    index_store.vacuum(spark, path)
    assert index_store.versions(spark, path) == [3] and answers(spark, path)
    with pytest.raises(FileNotFoundError):
        index_store.load(spark, path, 1)


def test_only_changed_documents_are_cut(spark, tmp_path, monkeypatch):
    docs, path = texts(30), str(tmp_path / "index")
    index_store.refresh(frame(spark, docs), path)
    cut = []
    real = retrieval.cut_documents
    monkeypatch.setattr(retrieval, "cut_documents", lambda d, *a: cut.append(sorted(r[0] for r in d.select("file_name").collect())) or real(d, *a))
    docs["doc005.txt"] += " more"
    docs["new.txt"] = "word1 word2"
    index_store.refresh(frame(spark, docs), path)
    assert cut == [["doc005.txt", "new.txt"]]


def test_many_deltas_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_store, "MAX_DELTAS", 2)
    docs, path = texts(12), str(tmp_path / "index")
    for i in range(3):
        docs[f"new{i}.txt"] = f"word{i} word{i + 7} word9"
        version = index_store.refresh(frame(spark, docs), path)
        assert len(index_store._deltas(spark, path, version)) <= 2
    assert answers(spark, path) == fresh_answers(spark, docs, str(tmp_path / "anew"))
    changed = {name: text + " end" for name, text in docs.items()}
    version = index_store.refresh(frame(spark, changed), path)
    assert len(index_store._deltas(spark, path, version)) == 1  # the old chunks were all dead
    assert answers(spark, path) == fresh_answers(spark, changed, str(tmp_path / "again"))


def test_a_version_without_manifest_does_not_exist(spark, tmp_path, monkeypatch):
    docs, path = texts(10), str(tmp_path / "index")
    index_store.refresh(frame(spark, docs), path)
    before = answers(spark, path)
    docs["doc001.txt"] = "word0 word7"

    def dies(*_):
        raise RuntimeError("the writer dies")

    with monkeypatch.context() as patch:
        patch.setattr(index_store, "_write_weights", dies)
        with pytest.raises(RuntimeError, match="dies"):
            index_store.refresh(frame(spark, docs), path)
    assert answers(spark, path) == before
    index_store.refresh(frame(spark, docs), path)
    assert answers(spark, path) == fresh_answers(spark, docs, str(tmp_path / "anew"))


def test_files_are_told_by_size_and_time(spark):
    rows = [("a.txt", "text", 4, "2025-01-01 00:00:00"), ("b.txt", None, 4, "2025-01-01 00:00:00.5")]
    files = spark.createDataFrame(rows, "file_name string, text string, size long, modified string")
    assert len({r["mark"] for r in index_store.marks(files).collect()}) == 2
    assert "text" not in index_store.marks(files)._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    texts_only = index_store.marks(files.select("file_name", "text")).collect()
    assert len({r["mark"] for r in texts_only}) == 2


def clustered(spark, n=600, seed=2):
    """Chunks about one of 30 topics each, and questions about one topic."""
    rng = random.Random(seed)
    topics = [[f"t{i}w{j}" for j in range(12)] for i in range(30)]
    chunks = [(f"C{i:04d}", " ".join(rng.choice(topics[i % 30]) for _ in range(30)) + " common") for i in range(n)]
    questions = [(f"Q{i:02d}", " ".join(rng.sample(topics[i], 3)) + " common") for i in range(30)]
    return chunks, questions


def test_segments_are_ruled_out(spark):
    chunks, questions = clustered(spark)
    c = spark.createDataFrame(chunks, "chunk_id string, text string").coalesce(1)
    q = spark.createDataFrame(questions, "question_id string, question string")
    vectors, idf = retrieval.build_index(c, max_terms=400)
    segments = block_index.build_segments(vectors, 10).cache()
    asked = retrieval.question_vectors(q, idf)
    maxima = segments.select("segment", F.inline(F.arrays_zip(F.col("terms").alias("term_no"), "largest")))
    bounds = block_index.bound_segments(asked, maxima, 3)
    assert bounds.count() < 0.25 * segments.count() * len(questions)
    hits = block_index.search_segments(asked, segments, 3).collect()
    got = {}
    for r in sorted(hits, key=lambda r: (r.question_id, r["rank"])):
        got.setdefault(r.question_id, []).append(r.chunk_id)
    assert got == {k: [x for x, _ in v] for k, v in brute_search(chunks, questions, 3, 400).items()}


@pytest.mark.parametrize("k", [4, 700])
def test_any_number_of_hits(spark, monkeypatch, k):
    monkeypatch.setattr(block_index, "TASK_QUESTIONS", 4)  # every segment goes to several tasks
    chunks, questions = clustered(spark, 120)
    c = spark.createDataFrame(chunks, "chunk_id string, text string").repartition(3)
    q = spark.createDataFrame(questions, "question_id string, question string")
    vectors, idf = retrieval.build_index(c, max_terms=50)
    hits = retrieval.search(q, vectors, idf, k, 50).where("chunk_id is not null").collect()
    got = {}
    for r in sorted(hits, key=lambda r: (r.question_id, r["rank"])):
        got.setdefault(r.question_id, []).append(r.chunk_id)
    assert got == {q: [x for x, _ in v] for q, v in brute_search(chunks, questions, k, 50).items() if v}


def test_packed_segments_hold_every_posting():
    rows = pd.DataFrame({"chunk_id": ["a", "b", "c"], "cols": [[1, 4], [4], [0, 1, 9]], "vals": [[0.5, 0.25], [1.0], [0.1, 0.9, 0.2]]})
    rows["cols"], rows["vals"] = rows["cols"].map(np.array), rows["vals"].map(np.array)
    packed = block_index.pack_segment(7, rows)
    assert packed["terms"].tolist() == [0, 1, 4, 9] and packed["largest"].tolist() == [0.1, 0.9, 1.0, 0.2]
    assert np.frombuffer(packed["places"], np.int32).tolist() == [2, 0, 2, 0, 1, 2]
    assert packed["starts"].tolist() == [0, 1, 3, 5]


def test_a_task_gives_k_rows_a_question(spark, monkeypatch):
    """However many segments there are: no row is made for a question and a segment, in any number of rounds."""
    monkeypatch.setattr(block_index, "TASK_SEGMENTS", 2)
    chunks, questions = clustered(spark)
    c = spark.createDataFrame(chunks, "chunk_id string, text string").coalesce(1)
    q = spark.createDataFrame(questions, "question_id string, question string")
    vectors, idf = retrieval.build_index(c, max_terms=400)
    segments = block_index.build_segments(vectors, 10).cache()
    asked = retrieval.question_vectors(q, idf).cache()
    hits = block_index.score_segments(asked, segments, 3)
    assert segments.count() >= 60 and hits.count() <= 3 * len(questions) * segments.rdd.getNumPartitions()
    whole = sorted(map(tuple, block_index.search_segments(asked, segments, 3).collect()))
    monkeypatch.setattr(block_index, "TASK_QUESTIONS", 7)
    assert sorted(map(tuple, block_index.search_segments(asked, segments, 3).collect())) == whole


def test_terms_are_counted_as_numbers(spark, monkeypatch):
    """Counts in batches of any size, with null and empty texts, unknown words, and pairs whose parts are not words of the vocabulary."""
    numbers = {"a": 0, "b c": 1, "c": 2, "a a": 3, "c a": 4}
    texts = [["a", "b", "c", "a", "a", "a"], None, ["x"], [], ["b"], ["c", "x", "a", "c"]]
    starts, term_no, tf = (x.to_pylist() for x in retrieval.Numbers.of(numbers).count(pa.array(texts, pa.list_(pa.string()))))
    got = [list(zip(term_no[i:j], tf[i:j])) for i, j in zip(starts, starts[1:])]
    assert got == [[(0, 4), (1, 1), (2, 1), (3, 2), (4, 1)], [], [], [], [], [(0, 1), (2, 2)]]
    assert all(len(x) <= 1 for x in retrieval.Numbers.of({}).count(pa.array([None, []], pa.list_(pa.string())))[1:])
    monkeypatch.setattr(retrieval, "COUNT_ROWS", 2)
    vocab = spark.createDataFrame(list(numbers.items()), "term string, term_no int")
    termed = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "k string, t array<string>")
    rows = retrieval.term_vectors(termed, "k", vocab).collect()
    assert {r.k: [tuple(x) for x in r.v] for r in rows} == {"0": got[0], "5": got[5]}
    # few names are sent to the tasks, many are joined
    names = vocab.where("term in ('a', 'c')").select("term")
    want = {"a a": 2, "c a": 1, "a c": 1}
    assert dict(map(tuple, retrieval.pair_counts(termed, names).collect())) == want
    monkeypatch.setattr(retrieval, "SMALL_NAMES", 1)
    assert dict(map(tuple, retrieval.pair_counts(termed, names).collect())) == want


def test_weights_are_stored_once_and_packed(spark, tmp_path):
    """A posting takes few bytes on disk: counts and undivided weights have few different values, and vectors follow from them."""
    rng = random.Random(1)
    words = [f"word{i}" for i in range(1500)]
    docs = {f"doc{i:04d}.txt": " ".join(rng.choice(words) for _ in range(300)) for i in range(500)}
    path = tmp_path / "index"
    index_store.refresh(frame(spark, docs), str(path))
    found = index_store.load(spark, str(path))
    postings = found.vectors.select(F.sum(F.size("cols"))).first()[0]
    stored = sum(f.stat().st_size for f in path.glob("versions/*/*/*.parquet"))
    assert stored < 10 * postings
    # the segments give the same weights as the vectors, to the last digit
    vectors = {r.chunk_id: dict(zip(r.cols, r.vals)) for r in found.vectors.collect()}
    for row in found.segments.collect():
        segment = block_index.unpack_segment(row)
        assert (segment.table.max(axis=1) == segment.largest).all()
        for i, chunk in enumerate(segment.chunk_ids):
            held = np.flatnonzero(segment.table[:, i])
            assert dict(zip(segment.terms[held].tolist(), segment.table[held, i].tolist())) == vectors.pop(chunk)
    assert not vectors


def test_tasks_of_a_round_do_not_grow_with_the_segments(spark, monkeypatch):
    """So what a round exchanges grows with its questions only; the hits are the same with any number of tasks."""
    chunks, questions = clustered(spark)
    c = spark.createDataFrame(chunks, "chunk_id string, text string").repartition(12)
    q = spark.createDataFrame(questions, "question_id string, question string")
    vectors, idf = retrieval.build_index(c, max_terms=400)
    segments = block_index.build_segments(vectors, 10).cache()
    asked = retrieval.question_vectors(q, idf).cache()
    whole = sorted(map(tuple, block_index.search_segments(asked, segments, 3).collect()))
    monkeypatch.setattr(block_index, "TASKS_A_CORE", 0)
    monkeypatch.setattr(block_index, "LEAST_TASKS", 3)
    assert block_index.score_segments(asked, segments, 3).rdd.getNumPartitions() == 3
    for parts in (2, 32):
        assert sorted(map(tuple, block_index.search_segments(asked, segments, 3, merge_parts=parts).collect())) == whole


def test_scores_cost_a_question_its_own_terms(monkeypatch):
    """A block's matrix has columns for shared terms only; hits equal double precision, near ties and few hits included."""
    monkeypatch.setattr(block_index, "TILE_CELLS", 9000)
    monkeypatch.setattr(block_index, "TASK_SEGMENTS", 3)
    monkeypatch.setattr(block_index, "EXACT_PAIRS", 3000)
    rng = np.random.default_rng(5)

    def vectors(n, name, most):
        cols = [np.unique(np.r_[0, rng.choice(400, rng.integers(1, most), replace=False)]).astype(np.int32) for _ in range(n)]
        vals = [rng.integers(1, 4, len(c)).astype(float) for c in cols]
        return pd.DataFrame({name: [f"{name}{i:04d}" for i in range(n)], "cols": cols, "vals": [v / np.sqrt((v * v).sum()) for v in vals]})

    asked, chunks = vectors(150, "question_id", 12), vectors(600, "chunk_id", 60)
    # scores that differ by less than single precision tells apart, and a term that no other chunk and question has
    cols, vals, own = list(chunks["cols"]), list(chunks["vals"]), (np.array([900], np.int32), np.array([1.0]))
    for i in range(0, 300, 2):
        cols[i], vals[i] = cols[i + 1], vals[i + 1] * (1 - 1.1e-6)
    cols[9], vals[9] = own
    chunks["cols"], chunks["vals"] = cols, vals
    asked["cols"], asked["vals"] = [*asked["cols"][:-1], own[0]], [*asked["vals"][:-1], own[1]]
    block = block_index.question_block(asked)
    assert len(block.terms) == asked["cols"].map(len).sum() and block.matrix.shape[1] < 20
    packed = pd.DataFrame([block_index.pack_segment(i, chunks[i : i + 40]) for i in range(0, 600, 40)])
    made = list(block_index.tiles(packed))
    assert len(made) > 5 and sum(len(t.chunk_ids) for t in made) == 600
    for k in (5, 700):
        kept = block_index.Best(block, k)
        for tile in made:
            kept.look(tile)
        found = kept.prune()
        got = {q: list(zip(rows["score"], rows["chunk_id"])) for q, rows in found.groupby("q")}
        full = np.zeros((2, 600, 901))
        for side, frame_ in enumerate((asked, chunks)):
            for i, (c, v) in enumerate(zip(frame_["cols"], frame_["vals"])):
                full[side, i, c] = v
        scores = np.round(full[0, :150] @ full[1].T, 6)
        for q in range(150):
            ranked = sorted(((-s, c) for s, c in zip(scores[q], chunks["chunk_id"]) if s > 0))[:k]
            assert [c for _, c in got[q]] == [c for _, c in ranked] and [s for s, _ in got[q]] == pytest.approx([-s for s, _ in ranked])

"""The training-data operators on awkward rows: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plantmetrics.llm import (
    common,
    decontamination,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    quality,
    sharding,
    token_counts,
    toxicity,
    vector_search,
)

LONG = "some words of a rather long text that goes on and on | " * 4000
ROWS = [
    (1, None, "en", "a", 0.5),
    (2, "", "en", "a", 0.5),
    (3, LONG, "de", "b", None),
    (4, "The same text, twice in the table.\nWith a second line that is long.", "en", "a", 1.0),
    (4, "The same text, twice in the table.\nWith a second line that is long.", "en", "a", 1.0),
    (None, "A row without an id.\nWith a second line that is long.", None, None, None),
    (5, " \t\n ", None, "b", 0.0),
    (6, "12 34 -- ++", "fr", None, 0.1),
    (7, "The same text, twice in the table.\nWith a second line that is long.", "en", "a", 1.0),
]
# Columns that the operators make themselves.
EXTRA = (
    "score predicted scan size shard slot part document gone owner node root key class signature n_tokens lang_pred tokens rate"
    " statistics text_hash component_id kept a b"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, quality double"


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).drop("quality")
    return frame.select("*", *[F.lit(-1).alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 0, 0), (3, 1, 0), (4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None), (7, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "the same text twice"), (1, "the same text twice"), (2, None), (3, ""), (None, "a row without")],
        "item_id long, text string",
    )


TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"

OPERATORS = {
    "language": lambda d, x: language_id.identify(d, F.lit(False)),
    "tokens": lambda d, x: token_counts.count_tokens(d, TOKENIZER),
    "quality": lambda d, x: quality.score_documents(d, x["labels"], F.lit(True)),
    "toxicity": lambda d, x: toxicity.score_documents(d, x["labels"], F.lit(True)),
    "lines": lambda d, x: line_dedup.dedup_lines(d),
    "items": lambda d, x: decontamination.scan(d, x["items"]),
    "copies": lambda d, x: near_dedup.near_duplicates(d, 2),
    "shards": lambda d, x: sharding.shard(d, 3, carry=tuple(d.columns)),
    "mix": lambda d, x: mixing.mix_documents(d, rounds=2, carry=tuple(d.columns)),
}


@pytest.fixture(scope="module")
def tables(labels, items):
    return {"labels": labels, "items": items}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_gets_a_result(docs, tables, name):
    got = OPERATORS[name](docs, tables).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_an_empty_table_gives_no_rows(empty, tables, name):
    assert OPERATORS[name](empty, tables).count() == 0


def test_empty_side_tables(docs, labels, items):
    none = labels.filter("false")
    assert {r["score"] for r in quality.score_documents(docs, none, F.lit(True)).collect()} == {0.0}
    assert max(r["score"] for r in toxicity.score_documents(docs, none, F.lit(True)).collect()) < 0.01
    assert decontamination.decontaminate(docs, items.filter("false")).count() == len(ROWS)
    nobody = language_id.predict(docs, language_id.fit(docs.filter("lang = 'xx'"))).collect()
    assert {r["lang_pred"] for r in nobody} == {"und"}


def test_no_quality_label_is_an_error(docs, empty, labels):
    for none in (labels.filter("false"), labels.withColumn("quality", F.lit(None).cast("int"))):
        with pytest.raises(ValueError, match="quality label"):
            quality.keep_good(docs, none, F.lit(True))
    with pytest.raises(ValueError, match="quality label"):
        quality.keep_good(docs, labels, F.lit(False))
    assert quality.keep_good(empty, labels.filter("false"), F.lit(True)).count() == 0


def test_rows_without_letters_are_undetermined(docs, tables):
    got = {(r["doc_id"], r["lang_pred"]) for r in OPERATORS["language"](docs, tables).collect()}
    assert {(1, "und"), (2, "und"), (5, "und"), (6, "und")} <= got
    assert (3, "de") in got and (4, "en") in got


def test_null_and_empty_texts_have_no_tokens(docs, tables):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in OPERATORS["tokens"](docs, tables).collect()}
    assert got[1] == (0, 0) and got[2] == (0, 0) and got[5] == (4, 0)
    assert got[3][0] == len(LONG)


def test_lines_of_rows_without_id_come_first(docs, tables):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in OPERATORS["lines"](docs, tables).collect()}
    assert got[1] == (1, 0, "") and got[2] == (1, 0, "")
    assert got[None][1] == 0
    assert got[4] == (2, 1, "The same text, twice in the table.")  # the first line stays in the smallest id that holds it
    assert got[7] == (2, 2, "")


def test_items_found_with_their_places(docs, tables):
    got = {r["doc_id"]: r["scan"] for r in OPERATORS["items"](docs, tables).collect()}
    text = ROWS[3][1]
    assert [text[s["start"] : s["end"]] for s in got[4]["spans"]] == ["The same text, twice"]
    assert got[4]["item_ids"] == ["1"] and got[4]["contaminated"]
    assert got[None]["item_ids"] == ["null"]
    assert got[1]["n_words"] == 0 and not got[1]["contaminated"]


def test_copies_of_repeated_rows(docs, tables):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in OPERATORS["copies"](docs, tables).collect()}
    assert {(4, 4, True), (7, 4, False), (1, 1, True), (2, 2, True), (5, 5, True)} <= got
    kept = near_dedup.keep_one(docs, 2)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in ROWS[:-1])


def test_one_row_of_each_group(spark, docs):
    words = [f"word{i}" for i in range(60)]
    text, close = " ".join(words), " ".join([*words[:-1], "other"])
    nobody = " ".join(f"more{i}" for i in range(60))
    rows = [(4, text, 1), (4, text, 2), (4, close, 3), (9, text, 4), (None, text, 5)]
    rows += [(None, nobody, 6), (None, nobody, 7), (None, nobody + " end", 8), (None, "  ", 9), (None, "  ", 10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = corpus_pipeline.drop_near_copies(spark, frame, "").collect()
    groups = [sorted(r["n"] for r in got if r["n"] in g) for g in ({1, 2, 3, 4, 5}, {6, 7, 8}, {9, 10})]
    assert [len(g) for g in groups] == [1, 1, 2]
    assert groups[0][0] in (1, 3) and groups[1][0] in (6, 8)
    apart = near_dedup.keep_one(docs, 2, repeats=False)
    assert apart.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in apart.collect()) == ["1", "2", "3", "4", "5", "6", "None"]


def exchanged_rows(frame):
    """The rows that the exchanges of a collected frame wrote, and what it gave."""
    got = frame.collect()

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        below = node.children()
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(frame._jdf.queryExecution().executedPlan()), got


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def lone_texts_and_copies(spark):
    texts = [" ".join(f"word{i}_{j}" for j in range(30)) for i in range(400)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1000 + i, texts[i] + " end", "y") for i in range(8)]
    rows += [(None, texts[399] + " end", "z"), (1000, texts[0] + " end", "y")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_texts_without_copies_are_not_exchanged(spark, no_broadcasts):
    """Of 410 rows, 10 go: only they, what the filter takes for them, and the ids of those that go are exchanged."""
    rows, frame = lone_texts_and_copies(spark)
    moved, got = exchanged_rows(near_dedup.keep_one(frame, 2, repeats=False))
    assert sorted(tuple(r) for r in got) == rows[:400]
    assert moved < 100


def test_sets_are_taken_from_the_wanted_texts_alone(spark, no_broadcasts, monkeypatch):
    rows, frame = lone_texts_and_copies(spark)
    classes = near_dedup.classes_of(near_dedup.sign(frame, 2))
    wanted = classes.filter("first_doc < 8 or first_doc is null").select("node")
    numbers = {r["node"]: r["row"] for r in classes.join(wanted, "node").collect()}
    monkeypatch.setattr(near_dedup, "materialise", lambda df, name: df)
    moved, got = exchanged_rows(near_dedup.sets_of(frame, wanted, classes, 2))
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(numbers) == 9
    for r in got:
        assert r["hashes"] == near_dedup.shingle_hashes(texts[numbers[r["node"]]["doc_id"]], 2, {}).view("int64").tolist()
    # The wanted numbers and the classes meet in an exchange of their own, of 9 and 409 rows.
    assert moved < 409 + 9 + 100


@pytest.mark.parametrize("most", [64, 1 << 25])
def test_row_filter_holds_for_its_rows(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    frame = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.xxhash64("id").alias("text_hash"))
    few, none = (frame.filter(x) for x in ("coalesce(doc_id, 0) % 50 = 0", "false"))
    holds = common.row_filter(few)("doc_id", "text_hash")
    passed = {r["doc_id"] for r in frame.filter(holds).collect()}
    assert passed >= {r["doc_id"] for r in few.collect()} and None in passed
    assert len(passed) + frame.filter(~holds).count() == 3000
    assert len(passed) < 60 + 3000 / 10 or most == 64
    assert frame.filter(common.row_filter(none)("doc_id", "text_hash")).count() == 0


def test_filters_keep_the_columns(docs, tables):
    for kept in (
        decontamination.decontaminate(docs, tables["items"]),
        mixing.sample_documents(docs, rounds=1),
        quality.keep_good(docs, tables["labels"], F.lit(True)),
    ):
        assert kept.dtypes == docs.dtypes
        assert {r[c] for r in kept.collect() for c in EXTRA if c != "scan"} <= {-1}


def test_vectors(spark):
    rows = [
        (0, [1.0, 0.0], 1),
        (20, [1.0, 0.0], 1),
        (40, None, 1),
        (1, [1.0, 0.0], 1),
        (1, [1.0, 0.0], 1),
        (2, [0.0, 0.0], 1),
        (3, [float("nan"), 1.0], 1),
        (4, [float("inf"), 1.0], 1),
        (5, [None, 1.0], 1),
        (6, [], 1),
        (7, [1.0, 2.0, 3.0], 1),
        (8, [0.5, 0.5], 1),
        (None, [1.0, 1.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in vector_search.search(frame, F.col("vec_id") % 20 == 0).sort("query_id", "rank").collect()]
    assert got == [
        (0, 1, 1, 1.0),
        (0, 2, 20, 1.0),
        (0, 3, 8, 0.5),
        (20, 1, 0, 1.0),
        (20, 2, 1, 1.0),
        (20, 3, 8, 0.5),
    ]
    assert vector_search.search(frame.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert vector_search.search(frame.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0

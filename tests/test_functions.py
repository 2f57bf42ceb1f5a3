import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plantmetrics.functions import (
    clip,
    half_open_quarter,
    iso_week,
    round_even,
    round_exact,
    round_to,
    safe_div,
    season_flag,
    week_end,
    weekday0,
)
from plantmetrics.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 4])
def test_round_exact_equals_python(spark, digits):
    rng = random.Random(7)
    values = [2.675, 8.45, 2.25, 0.285, 0.45, 0.15, -1.005, 4.5, 5.5, 0.0, 0.00005]
    values += [rng.randint(0, 10**6) / 1000 for _ in range(1500)] + [rng.random() * 1e5 for _ in range(300)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = [row[0] for row in frame.select(round_exact(F.col("v"), digits)).collect()]
    assert got == [round(v, digits) for v in values]


def test_round_to_absorbs_the_order_of_a_sum(spark):
    assert one(spark, round_to(F.lit(0.1 + 0.2), 6)) == 0.3
    assert one(spark, round_even(F.lit(2.5))) == 2.0


def test_safe_div_guards_zero_and_null(spark):
    assert one(spark, safe_div(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, safe_div(F.lit(1), F.lit(4))) == 0.25
    assert one(spark, safe_div(F.lit(1), F.lit(None).cast("int"), 9.0)) == 9.0


def test_clip_keeps_null(spark):
    assert one(spark, clip(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert one(spark, clip(F.lit(1.5), 0.0, 1.0)) == 1.0


def test_calendar(spark):
    monday, sunday = F.lit(dt.date(2025, 3, 3)), F.lit(dt.date(2025, 3, 9))
    assert one(spark, week_end(monday)) == dt.date(2025, 3, 9)
    assert one(spark, week_end(sunday)) == dt.date(2025, 3, 9)
    assert one(spark, weekday0(monday)) == 0
    assert one(spark, iso_week(F.lit(dt.date(2026, 1, 1)))) == 1
    assert one(spark, season_flag(F.lit(dt.date(2025, 7, 1)))) == 0
    assert half_open_quarter("2025-Q4") == (dt.date(2025, 10, 1), dt.date(2026, 1, 1))


def test_zfill_pads_and_never_cuts(spark):
    assert one(spark, tx.zfill(F.lit("64011"), 6)) == "064011"
    assert one(spark, tx.zfill(F.lit("64041190"), 6)) == "64041190"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("upper: polyester 55% elastane 30% nylon 15%", [("polyester", 55), ("elastane", 30), ("nylon", 15)]),
        ("recycled polyester 70% elastane 30%", [("recycled polyester", 70), ("elastane", 30)]),
        ("cork", [("cork", 100)]),
        ("EVA 40% rubber 10% EVA 50%", [("rubber", 10), ("EVA", 50)]),
    ],
)
def test_parse_materials(spark, text, expected):
    rows = one(spark, tx.parse_materials(F.lit(text)))
    assert [(m["name"], m["pct"]) for m in rows] == expected


def test_gtin_of_a_known_product(spark):
    assert one(spark, tx.gtin(F.lit("PROD-0002"))) == "3814342783890"


def test_titles(spark):
    head = "====\nx\nNaziv:  Zavrsna kontrola \nrest"
    assert one(spark, tx.title(F.lit(head), F.lit("a_b.txt"))) == "Zavrsna kontrola"
    assert one(spark, tx.title(F.lit("no label\n" * 30), F.lit("Safety_Rules.txt"))) == "Safety Rules"
    late = "line\n" * 20 + "Title: too late"
    assert one(spark, tx.title(F.lit(late), F.lit("x.txt"))) == "x"


def test_words_see_unicode_blanks(spark):
    assert one(spark, tx.words(F.lit(" a b c \n d "))) == ["a", "b", "c", "d"]


def test_pairs_follow_single_terms(spark):
    frame = spark.createDataFrame([("The belt moves",), ("x",), ("alone",)], "t string").select(tx.terms(F.col("t")).alias("t"))
    rows = [r[0] for r in frame.select(tx.with_pairs(F.col("t"))).collect()]
    assert rows == [["the", "belt", "moves", "the belt", "belt moves"], [], ["alone"]]


def test_trim_at_blank(spark):
    long = ("word " * 120).strip()
    cut = one(spark, tx.trim_at_blank(F.lit(long), 500))
    assert cut == long[:500].rsplit(" ", 1)[0] + "..."
    assert one(spark, tx.trim_at_blank(F.lit("short"), 500)) == "short"


def test_sections_fall_back_to_sentences(spark):
    ruled = "a" * 50 + "\n====\n" + "b" * 50
    assert one(spark, tx.sections(F.lit(ruled))) == ["a" * 50, "b" * 50]
    assert one(spark, tx.sections(F.lit("This sentence is long enough. Short."))) == ["This sentence is long enough."]

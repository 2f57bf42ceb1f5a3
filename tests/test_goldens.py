"""Known inputs and results, typed by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantmetrics import lookups
from plantmetrics.operators import demand, kpi, passports, reports, retrieval, trade

WEEKS = [
    # date, demand, rolling_mean_14, rolling_std_14, rolling_mean_30, lag_7, lag_14, lag_30
    ("2025-03-09", 14812, 14812.0, 0.0, 14812.0, 14812, 14812, 14812),
    ("2025-03-16", 12930, 13871.0, 1330.7749621930825, 13871.0, 14812, 14812, 14812),
    ("2025-03-23", 14483, 13706.5, 1098.1368311827082, 14075.0, 12930, 14812, 14812),
    ("2025-03-30", 13896, 14189.5, 415.0716805565034, 14030.25, 14483, 12930, 14812),
    ("2025-04-06", 17010, 15453.0, 2201.930516614909, 14579.75, 13896, 14483, 14812),
    ("2025-04-13", 16956, 16983.0, 38.18376618407357, 15586.25, 17010, 13896, 12930),
]


def test_feature_matrix(spark):
    weekly = spark.createDataFrame([("all", dt.date.fromisoformat(w[0]), w[1]) for w in WEEKS], "series string, date date, demand bigint")
    rows = demand.feature_matrix(weekly).orderBy("date").collect()
    for row, (_, value, mean14, std14, mean30, lag7, lag14, lag30) in zip(rows, WEEKS):
        assert row.rolling_mean_7 == row.ewm_mean_7 == value
        assert row.rolling_mean_14 == mean14 and row.rolling_mean_30 == mean30
        assert row.rolling_std_14 == pytest.approx(std14, abs=1e-9)
        assert (row.lag_7, row.lag_14, row.lag_30) == (lag7, lag14, lag30)
    assert [r.trend for r in rows] == list(range(6))
    assert rows[0].asDict() | {"month": 3, "quarter": 1, "day_of_week": 6, "week_of_year": 10, "is_high_season": 1} == rows[0].asDict()


def test_leak_free_windows_end_before_the_row(spark):
    weekly = spark.createDataFrame([("all", dt.date.fromisoformat(w[0]), w[1]) for w in WEEKS], "series string, date date, demand bigint")
    rows = demand.feature_matrix(weekly, leak_free=True).orderBy("date").collect()
    assert [r.rolling_mean_7 for r in rows] == [14812.0, 14812.0, 12930.0, 14483.0, 13896.0, 17010.0]


def test_gaps_count_zero(spark):
    log = spark.createDataFrame(
        [(dt.date(2025, 3, 3), "A", 5), (dt.date(2025, 3, 20), "A", 7), (dt.date(2025, 3, 4), "B", 1)],
        "date date, brand string, actual_qty int",
    )
    total = [tuple(r) for r in demand.demand_total(log).orderBy("date").select("date", "demand").collect()]
    assert total == [(dt.date(2025, 3, 9), 6), (dt.date(2025, 3, 16), 0), (dt.date(2025, 3, 23), 7)]
    wide = demand.demand_wide(demand.demand_by_brand(log), ["A", "B"]).orderBy("date").collect()
    assert [(r.A, r.B) for r in wide] == [(5, 1), (0, 0), (7, 0)]


def test_ewm_equals_the_weighted_mean(spark):
    weekly = spark.createDataFrame([("s", dt.date(2025, 1, 5 + 7 * i), v) for i, v in enumerate([4, 8, 6])], "series string, date date, demand bigint")
    got = [r.e for r in demand.with_ewm(weekly, span=3, name="e").orderBy("date").collect()]
    assert got == pytest.approx([4.0, (8 + 2) / 1.5, (6 + 4 + 1) / 1.75])


DUTY = [
    ("640411", "de", 50000.0, 16.9, 0.0, "SAA EU-BiH", 0.0, 19.0, 9500.0, 59500.0, 8450.0),
    ("640411", "US", 50000.0, 20.0, 20.0, "No FTA (MFN)", 10000.0, 0.0, 0.0, 60000.0, 0.0),
    ("640610", "RS", 20000.0, 2.0, 0.0, "CEFTA 2006", 0.0, 20.0, 4000.0, 24000.0, 400.0),
]


def test_duty_scenarios(spark):
    frame = spark.createDataFrame([row[:3] for row in DUTY], "hs_code string, destination string, value_eur double")
    got = {
        (r.hs_code, r.destination): (
            r.mfn_rate_pct, r.preferential_rate_pct, r.fta, r.duty_eur, r.vat_rate_pct, r.vat_eur,
            r.total_landed_cost_eur, r.savings_vs_mfn_eur,
        )
        for r in trade.duty_batch(frame).collect()
    }
    assert got == {(row[0], row[1].upper()): row[3:] for row in DUTY}


def test_duty_errors_are_rows(spark):
    frame = spark.createDataFrame([("999999", "DE", 1.0), ("640411", "JP", 1.0)], "hs_code string, destination string, value_eur double")
    rows = {r.hs_code: (r.error, r.duty_eur) for r in trade.duty_batch(frame).collect()}
    assert rows == {"999999": ("unknown hs code", None), "640411": ("no rate for destination", None)}


def test_schedule_halves_with_exact_ties(spark):
    lines = spark.createDataFrame([("640411", "TR"), ("640610", "TR"), ("640411", "CA"), ("640391", "US")], "correct_hs_code string, country_destination string")
    rows = {(r.correct_hs_code, r.country_destination): (r.duty_rate_percent, r.preferential_rate) for r in trade.preference_schedule(lines).collect()}
    assert rows[("640411", "TR")] == (16.9, round(16.9 * 0.5, 1))
    assert rows[("640610", "TR")] == (7.5, 3.8)
    assert rows[("640411", "CA")] == (15.2, 15.2)
    assert rows[("640391", "US")] == (10.0, 10.0)


PRODUCT = {
    "product_id": "PROD-0002", "product_name": "Court 3D Knit Collar v1", "brand": "BrandA", "hs_code_6digit": "640411",
    "country_origin": "KH", "materials_composition": "collar: recycled polyester 70% elastane 30%", "weight_grams": 57,
    "carbon_footprint_kg": 3.38, "recyclability_score": 83, "hazardous_substances": "REACH compliant; no SVHC detected",
    "factory_id": "F-018", "production_date": dt.date(2026, 2, 10), "batch_number": "B202602-1488",
}
PRODUCT_SCHEMA = (
    "product_id string, product_name string, brand string, hs_code_6digit string, country_origin string,"
    " materials_composition string, weight_grams int, carbon_footprint_kg double, recyclability_score int,"
    " hazardous_substances string, factory_id string, production_date date, batch_number string"
)


def product(spark, **changes):
    return spark.createDataFrame([tuple({**PRODUCT, **changes}.values())], PRODUCT_SCHEMA)


def test_passport(spark):
    made = passports.passport(product(spark), dt.date(2026, 2, 25), {"name": "M"}, "DPP-SPT-")
    d = made.first().dpp
    assert d.unique_id == "DPP-SPT-0002"
    assert (d["product"].model, d["product"].gtin) == ("Court 3D Knit Collar", "3814342783890")
    assert d.materials.composition == {"recycled polyester": 70, "elastane": 30}
    assert d.materials.recycled_content_pct == 70
    assert (d.sustainability.energy_consumption_kwh, d.sustainability.water_consumption_liters) == (9.46, 2.6)
    assert d.compliance.oeko_tex is False and d.durability.expected_lifetime_years == 5
    assert d.end_of_life.recyclable_components == ["collar knit"]
    checked = passports.validate(made).first()
    assert checked.valid and checked.completeness_pct == 100.0 and len(checked.warnings) == 1


def test_partial_passport_is_incomplete(spark):
    made = passports.passport(product(spark), dt.date(2026, 2, 25), {"name": "M"})
    partial = made.withColumn("dpp", F.col("dpp").dropFields("origin", "durability"))
    checked = passports.validate(partial).first()
    assert not checked.valid and checked.missing_fields == ["origin", "durability"]
    assert checked.completeness_pct == 81.8


def test_templates_fall_back(spark):
    names = ["RUN knit v1", "Carbon plate v2", "plain shoe v3"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in frame.select(passports.template_name(F.col("n"))).collect()] == ["Knit", "Plate", "Basic"]


def test_emissions_take_the_larger_source(spark):
    reported = trade.embedded_emissions(product(spark)).first().emissions_kg
    assert reported == round(3.38 + 57 / 1e6 * 15000 * 0.016, 3)
    materials = trade.embedded_emissions(product(spark, carbon_footprint_kg=0.0, weight_grams=1000)).first().emissions_kg
    assert materials == round(0.7 * 2.2 + 0.3 * 6.8 + 0.24, 3)


KPI_CASES = [("overall_defect_rate", 0.0667, "red"), ("on_time_delivery", 95.0, "green"), ("oee_average", 76.2, "yellow"), ("stockout_incidents", 0.0, "green"), ("safety_incidents", 1.0, "yellow")]


def test_kpi_status(spark):
    values = spark.createDataFrame([(k, v) for k, v, _ in KPI_CASES], "kpi_id string, value double")
    trends = spark.createDataFrame([("oee_average", "up")], "kpi_id string, trend string")
    board = {r.kpi_id: r for r in kpi.board(values, trends, lookups.kpi_thresholds(spark)).collect()}
    assert len(board) == 20
    assert all(board[k].status == s for k, _, s in KPI_CASES)
    assert board["oee_average"].trend == "up" and board["rework_rate"].trend == "stable"
    assert board["scrap_rate"].value == 0.0 and board["first_pass_yield"].status == "red"


def test_score_weights_and_grade(spark):
    parts = [F.lit(v) for v in (65.3, 78.6, 52.1, 72.6)]
    row = spark.range(1).select(F.round(reports.weighted_score(*parts), 1).alias("s")).select("s", reports.grade(F.col("s")).alias("g")).first()
    assert (row.s, row.g) == (67.1, "Bronze")


@pytest.mark.parametrize("n, chunks", [(1, 1), (500, 1), (501, 2), (950, 2), (951, 3), (3400, 8)])
def test_chunk_counts(spark, n, chunks):
    docs = spark.createDataFrame([("a.txt", " ".join(f"w{i}" for i in range(n)))], "file_name string, text string")
    rows = retrieval.chunk_documents(docs).orderBy("chunk_id").collect()
    assert len(rows) == chunks and rows[0].chunk_id == "DOC_001_CH_001"
    assert rows[-1].text.split()[-1] == f"w{n - 1}"
    assert all(r.word_count == len(r.text.split()) for r in rows)


def test_empty_document_has_no_chunk(spark):
    docs = spark.createDataFrame([("a.txt", " \n "), ("b.txt", "one two")], "file_name string, text string")
    assert [r.chunk_id for r in retrieval.chunk_documents(docs).collect()] == ["DOC_002_CH_001"]

"""Mixing a corpus to target weights: iterative proportional fitting over source, language and topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmetrics.session import materialise

MARGINS = ("source", "language", "topic")
ROUNDS = 8
TEMPER = 0.5
SEED = "mixing-1"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def genre(text: Column, tokens: Column) -> Column:
    """A topic for corpora that bring none: the form of the text, by its marks and its length."""
    body = F.coalesce(text, F.lit(""))
    return (
        F.when(body.contains(" | "), "table")
        .when(body.contains("http://") | body.contains("https://"), "links")
        .when(tokens < 100, "note")
        .when(tokens < 400, "article")
        .otherwise("book")
    )


def name_of(value: Column) -> Column:
    """A value of a margin as text in which null keeps a name of its own."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that only depends on the id and the seed."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def describe(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, tokens (words) and the three margin values of every document, and ``carry`` in the struct ``document``."""
    tokens = words(F.col("text"))
    columns = [
        F.col("doc_id"),
        tokens.alias("tokens"),
        name_of(F.col("source")).alias("source"),
        name_of(F.col("lang")).alias("language"),
        name_of(genre(F.col("text"), tokens)).alias("topic"),
    ]
    if carry:
        columns.append(F.struct(*[F.col(c) for c in carry]).alias("document"))
    return docs.select(*columns)


def tempered_targets(cells: DataFrame, margin: str, temper: float = TEMPER) -> DataFrame:
    """Target shares of a margin: its present token shares to the power ``temper``, made to sum to 1."""
    present = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens"))
    powers = present.select(margin, F.pow(F.col("tokens").cast("double"), F.lit(temper)).alias("power"))
    total = powers.agg(F.sum("power")).first()[0] or 0.0
    return powers.select(margin, (F.col("power") / total if total else F.lit(0.0)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Weights of the cells whose sums meet the targets of every margin.

    ``cells`` holds the margins and ``tokens``; ``targets`` a frame (margin, target) per margin. The weight of a cell is its
    tokens times one factor per margin. Each step sums the cells by one margin under the other factors, with partial sums
    before the exchange, and sets that margin's factor to target / sum. Only the factor tables, one row per margin value, are
    kept from step to step. Values without a target get factor 0.
    """
    margins = list(targets)
    factors = {
        m: materialise(targets[m].select(m, F.lit(1.0).alias(f"{m}_factor"), "target"), f"mix-{m}") for m in margins
    }
    for _ in range(rounds):
        for m in margins:
            weighted, weight = cells, F.col("tokens").cast("double")
            for other in margins:
                if other != m:
                    weighted = weighted.join(factors[other].drop("target"), other)
                    weight = weight * F.col(f"{other}_factor")
            sums = weighted.groupBy(m).agg(F.sum(weight).alias("reached"))
            fitted = factors[m].join(sums, m).select(
                m,
                F.when(F.col("reached") > 0, F.col("target") / F.col("reached")).otherwise(0.0).alias(f"{m}_factor"),
                "target",
            )
            factors[m] = materialise(fitted, f"mix-{m}")
    weighted, weight = cells, F.col("tokens").cast("double")
    for m in margins:
        weighted = weighted.join(factors[m].drop("target"), m, "left")
        weight = weight * F.coalesce(F.col(f"{m}_factor"), F.lit(0.0))
    return weighted.select(*margins, "tokens", weight.alias("weight"))


def rates(
    cells: DataFrame, targets: dict[str, DataFrame] | None, budget: float, rounds: int, temper: float
) -> DataFrame:
    """The rate of every cell: tokens wanted from it over tokens it has."""
    if targets is None:
        targets = {m: tempered_targets(cells, m, temper) for m in MARGINS}
    raked = rake(cells, targets, rounds)
    sums = raked.agg(F.sum("tokens").cast("double"), F.sum("weight")).first()
    total, whole = sums[0] or 0.0, sums[1] or 0.0
    if not whole:
        return raked.select(*MARGINS, F.lit(0.0).alias("rate"))
    wanted = F.col("weight") / whole * (budget * total)
    return raked.select(*MARGINS, F.when(F.col("tokens") > 0, wanted / F.col("tokens")).otherwise(0.0).alias("rate"))


def copies(rate: Column, doc_id: Column, seed: str) -> Column:
    whole = F.floor(rate)
    return (whole + (draw(doc_id, seed) < rate - whole).cast("long")).cast("long")


def mix_documents(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    budget: float = 1.0,
    rounds: int = ROUNDS,
    temper: float = TEMPER,
    seed: str = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often each document enters a mix whose tokens follow target shares of source, language and topic.

    The documents are summed into cells (source, language, topic), the cells are raked to the targets (default: present
    shares to the power ``temper``), and a document of a cell is taken ``rate`` times in expectation, where rate is the
    cell's wanted tokens over its present tokens and ``budget`` times the corpus' tokens are wanted in all. The whole part
    of the rate is taken always, the rest with its probability, decided by a hash of the id; so a run can be repeated.
    The documents themselves are not shuffled: they meet the rates of their cells, of which there are few, in a join.

    Returns doc_id, source, language, topic, tokens, rate and n_copies, and with ``carry`` those columns of the documents in
    the struct ``document``. Sources and languages may be null and keep a share of their own under the name ``null``; other
    values are written as ``=value``. A null or empty text has no tokens and topic ``=note``; it follows its cell's rate,
    and a cell without any token has rate 0. Rows that repeat an id get equal draws. An empty table gives no rows. Other
    columns of the documents are not read, and very long texts count whole.
    """
    cells = materialise(describe(docs).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    by_cell = materialise(rates(cells, targets, budget, rounds, temper), "mix-rates")
    return describe(docs, carry).join(by_cell, list(MARGINS)).select(
        "doc_id",
        *MARGINS,
        "tokens",
        "rate",
        copies(F.col("rate"), F.col("doc_id"), seed).alias("n_copies"),
        *(["document"] if carry else []),
    )


def sample_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix with all their columns, each ``n_copies`` times, so its tokens follow the target shares.

    A document of a cell whose rate is above 1 is repeated as whole rows with the same id, since the targets cannot be met
    otherwise. Copies are made where the document lies, and nothing is shuffled for them.
    """
    mixed = mix_documents(docs, carry=tuple(docs.columns), **settings).filter("n_copies > 0")
    repeated = F.explode(F.array_repeat(F.lit(True), F.col("n_copies").cast("int")))
    return mixed.select("document", repeated.alias("copy")).select("document.*")

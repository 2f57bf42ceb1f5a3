"""The registered queries of the subpackage and, where SQL can state them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plantmetrics.llm import (
    decontamination,
    language_id,
    line_dedup,
    line_rules,
    mixing,
    near_dedup,
    quality,
    sharding,
    term_divergence,
    token_counts,
    toxicity,
    vector_codes,
    vector_search,
)
from plantmetrics.llm.common import in_fold
from plantmetrics.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside fold 1 of 3."""
    held_out = in_fold(F.col("doc_id"), 3, 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    return language_id.identify(docs, F.col("held_out")).drop("text", "lang")


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document as the library counts them for word_bpe_49k.json."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels outside fold 2 of 4."""
    held_out = in_fold(F.col("doc_id"), 4, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_documents(docs, table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels outside fold 0 of 5."""
    held_out = in_fold(F.col("doc_id"), 5, 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op5_vector_search")
def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return vector_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose two-word shingles are similar by 0.8 or more."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


LINES_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
),
numbered AS (
  SELECT doc_id, row_id, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS line FROM docs
),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM numbered
),
shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
),
judged AS (
  SELECT k.*, (s.keeper IS NOT NULL AND s.keeper <> k.doc_id) AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row_id
"""


@query("op6_line_dedup", LINES_SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that several documents hold, dropped from all but the smallest doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WINDOWS_SQL = f"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{WORDS}') AS w
  FROM benchmark
),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS k,
         array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS piece
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
docs AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{WORDS}') AS w
  FROM documents
),
places AS (
  SELECT row_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs
),
hits AS (
  SELECT p.row_id, p.i, p.k, v.item
  FROM (SELECT p.row_id, p.i, l.k, array_to_string(p.w[p.i:p.i + l.k - 1], ' ') AS piece
        FROM places p, (SELECT DISTINCT k FROM windows) l WHERE p.i + l.k - 1 <= len(p.w)) p
  JOIN windows v ON v.k = p.k AND v.piece = p.piece
),
hit_words AS (
  SELECT row_id, count(DISTINCT word) AS n_hit
  FROM (SELECT row_id, unnest(range(i, i + k)) AS word FROM hits) GROUP BY row_id
),
hit_items AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT row_id, item FROM hits) GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (row_id) LEFT JOIN hit_items USING (row_id)
"""


@query("op7_decontamination", WINDOWS_SQL)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a 13-word window of a test item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "scan.n_words",
        "scan.n_hit",
        F.size("scan.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("scan.item_ids", ","), 256).alias("items_sha256"),
        "scan.contaminated",
    )


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of nearly equal bytes. DuckDB has no CRC-32, so there is no SQL form."""
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def mixing_sql() -> str:
    """The same fitting with one common table expression per step."""
    steps = [
        f"""
cells AS MATERIALIZED (
  SELECT source, language, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM described GROUP BY ALL
)"""
    ]
    for m in mixing.MARGINS:
        steps.append(f"""
target_{m} AS MATERIALIZED (
  SELECT {m}, p / sum(p) OVER () AS target FROM (SELECT {m}, pow(sum(tokens), {mixing.TEMPER}) AS p FROM cells GROUP BY {m})
)""")
    before = "cells"
    weight = "tokens"
    for step in range(mixing.ROUNDS):
        for m in mixing.MARGINS:
            name = f"fit_{step}_{m}"
            steps.append(f"""
{name} AS MATERIALIZED (
  SELECT c.source, c.language, c.topic, c.tokens,
         CASE WHEN sum(c.{weight}) OVER (PARTITION BY c.{m}) > 0
              THEN c.{weight} * t.target / sum(c.{weight}) OVER (PARTITION BY c.{m}) ELSE 0 END AS weight
  FROM {before} c JOIN target_{m} t ON t.{m} = c.{m}
)""")
            before, weight = name, "weight"
    return f"""
WITH counted AS (
  SELECT doc_id, coalesce(text, '') AS body, source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM documents
),
described AS MATERIALIZED (
  SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, coalesce('=' || source, 'null') AS source,
         coalesce('=' || lang, 'null') AS language,
         '=' || CASE WHEN contains(body, ' | ') THEN 'table'
                     WHEN contains(body, 'http://') OR contains(body, 'https://') THEN 'links'
                     WHEN tokens < 100 THEN 'note' WHEN tokens < 400 THEN 'article' ELSE 'book' END AS topic
  FROM counted
),{','.join(steps)},
rated AS (
  SELECT source, language, topic,
         CASE WHEN tokens > 0 THEN sum(tokens) OVER () * weight / sum(weight) OVER () / tokens ELSE 0 END AS rate
  FROM {before}
)
SELECT doc_id, source, language, topic, d.tokens, round(rate, 6) AS rate,
       CAST(floor(rate) AS BIGINT)
       + CASE WHEN ('0x' || substr(md5('{mixing.SEED}' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT
                   / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END AS n_copies
FROM described d JOIN rated USING (source, language, topic)
"""


@query("op10_mixing", mixing_sql())
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document enters a mix that meets tempered shares of source, language and topic."""
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.withColumn("rate", F.round("rate", 6))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_phrase(phrases: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(plain, {quoted(p)})" for p in phrases)


def char_set(chars: str | tuple[str, ...]) -> str:
    return "[" + "".join(f"\\x{ord(c):02X}" if ord(c) < 128 else c for c in chars) + "]"


def line_rules_sql() -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    word = r"[^\x20\x09-\x0D]+"
    window = line_rules.REPEAT_WINDOW
    separators = ", ".join(quoted(s) for s in line_rules.SEPARATORS)
    return rf"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS body FROM documents
),
lines AS (
  SELECT row_id, line_no, line, regexp_extract_all(line, '{word}') AS w, translate(line, {AZ}) AS plain
  FROM (SELECT row_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no
        FROM docs)
),
measured AS (
  SELECT *, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
         length(regexp_replace(line, '[^' || '{char_set(line_rules.PUNCTUATION)[1:]}', '', 'g')) AS marks,
         row_number() OVER (PARTITION BY row_id, line ORDER BY line_no) > 1 AS again,
         len(list_filter(w, lambda x: x IN ({separators}))) AS seps
  FROM lines WHERE len(w) > 0
),
ruled AS (
  SELECT *, NOT regexp_matches(rtrim(line, {blanks}), '{char_set(line_rules.SENTENCE_ENDS)}$')
            OR 100 * marks > {line_rules.MAX_PUNCTUATION_PERCENT} * chars
            OR (seps >= 2 AND 4 * seps >= len(w))
            OR (len(w) <= {line_rules.NAVIGATION_WORDS} AND ({any_phrase(line_rules.NAVIGATION_PHRASES)}))
            OR (len(w) <= {line_rules.BOILERPLATE_WORDS} AND ({any_phrase(line_rules.BOILERPLATE_PHRASES)})) AS failed
  FROM measured
),
per_doc AS (
  SELECT row_id, CAST(sum(chars) AS BIGINT) AS word_chars, count(*) FILTER (again) AS n_dup_lines,
         CAST(coalesce(sum(len(w)) FILTER (failed), 0) AS BIGINT) AS lost
  FROM ruled GROUP BY row_id
),
whole AS MATERIALIZED (
  SELECT doc_id, row_id, body, regexp_extract_all(body, '{word}') AS w FROM docs
),
windows AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, piece) AS times
  FROM (SELECT row_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS piece
        FROM (SELECT row_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM whole WHERE len(w) >= {window}))
),
repeats AS (
  SELECT row_id, count(DISTINCT place) AS n_repeat
  FROM (SELECT row_id, unnest(range(i, i + {window})) AS place FROM windows WHERE times > 1) GROUP BY row_id
),
judged AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word_chars, 0) AS word_chars,
         CAST(length(regexp_replace(body, '[^' || '{char_set(line_rules.SYMBOLS)[1:]}', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM whole LEFT JOIN per_doc USING (row_id) LEFT JOIN repeats USING (row_id)
),
based AS (
  SELECT *, n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM judged
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost <= {line_rules.MAX_LOST_PERCENT} * n_words AS kept
FROM based
"""


@query("op11_line_rules", line_rules_sql())
def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document after its failing lines are out."""
    figures = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    cleaned = line_rules.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", *[f"cleaned.{c}" for c in figures])


def share_sql(count: str, total: str) -> str:
    return f"1 + ({term_divergence.SCALE} * ({count} + {term_divergence.PRIOR})) // ({total} + {term_divergence.PRIOR} * terms)"


DIVERGENCE_SQL = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
held AS (
  SELECT lang, source, row_id, term, count(*) AS n
  FROM (SELECT lang, source, row_id, unnest(w) AS term FROM docs) GROUP BY ALL
),
kept AS MATERIALIZED (
  SELECT lang, term, CAST(sum(n) AS BIGINT) AS lang_n FROM held GROUP BY ALL HAVING count(*) >= {term_divergence.MIN_DOCS}
),
counts AS (
  SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM held SEMI JOIN kept USING (lang, term) GROUP BY ALL
),
langs AS (SELECT lang, count(*) AS terms, CAST(sum(lang_n) AS BIGINT) AS lang_total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY ALL),
groups AS MATERIALIZED (
  SELECT lang, source, coalesce(total, 0) AS total, terms, lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source) LEFT JOIN langs USING (lang)
),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         {share_sql("coalesce(c.n, 0)", "total")} AS p, {share_sql("lang_n", "lang_total")} AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
distances AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
rows_of AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN distances d ON d.lang = g.lang AND d.source = g.source AND d.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM rows_of
QUALIFY part = 'pair' OR rank <= {term_divergence.TOP_TERMS}
"""


@query("op12_term_divergence", DIVERGENCE_SQL)
def op12_term_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of every source from the others of its language, and the terms that stand out in it."""
    return term_divergence.measure_divergence(table(spark, sf_dir, "documents"))


def vector_codes_sql() -> str:
    """Each round is one assignment and one table of entries."""
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    steps = []
    for step in range(vector_codes.ROUNDS + 1):
        steps.append(f"""
near_{step} AS MATERIALIZED (
  SELECT row_id, part, min(v) AS v, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.row_id, p.part, p.v, e.entry,
               list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - e.v[i]) * (p.v[i] - e.v[i]))) AS d
        FROM pieces p JOIN entries_{step} e ON e.part = p.part)
  GROUP BY row_id, part
)""")
        if step < vector_codes.ROUNDS:
            steps.append(f"""
entries_{step + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(fresh, e.v) AS v
  FROM entries_{step} e LEFT JOIN (
    SELECT part, entry, list(CAST(floor_div AS BIGINT) ORDER BY i) AS fresh
    FROM (SELECT part, entry, i, CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS floor_div
          FROM (SELECT part, entry, i, sum(x) AS s, count(*) AS n
                FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM near_{step})
                GROUP BY part, entry, i))
    GROUP BY part, entry) USING (part, entry)
)""")
    last = vector_codes.ROUNDS
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS row_id,
         list_transform(embedding, lambda x: CAST(floor({vector_codes.STEP} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
pieces AS MATERIALIZED (
  SELECT row_id, part, v[part * w + 1:part * w + w] AS v
  FROM (SELECT row_id, v, len(v) // {parts} AS w, unnest(range(0, {parts})) AS part FROM kept)
),
entries_0 AS MATERIALIZED (SELECT part, row_id - 1 AS entry, v FROM pieces WHERE row_id <= {entries}),
{','.join(steps)},
coded AS (
  SELECT row_id, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near_{last} GROUP BY row_id
),
books AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM entries_{last})
)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row_id), books
"""


@query("op13_vector_codes", vector_codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product code of every vector, its error, and the checksum of the codebooks."""
    coded, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return vector_codes.with_label_error(coded).select(
        "vec_id",
        code.alias("code"),
        "error",
        "label_error",
        F.lit(vector_codes.codebook_hash(codebooks)).alias("codebooks_sha256"),
    )


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    return corpus_pipeline.run(spark, sf_dir)

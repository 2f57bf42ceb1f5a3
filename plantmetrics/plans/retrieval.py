"""Queries on documents, questions and the question log."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from plantmetrics.functions import round_to
from plantmetrics.functions import text as tx
from plantmetrics.operators import index_store, retrieval
from plantmetrics.plans.catalog import query
from plantmetrics.plans.oracle import WS, r, rx
from plantmetrics.session import materialise, run_folder
from plantmetrics.sources.readers import corpus, query_log_summary

LABELS = " OR ".join(f"starts_with(x, '{label}')" for label in tx.TITLE_LABELS)


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}|{WS}$', '', 'g')"


FIRST_LABELLED = rf"""list_filter(list_transform((regexp_split_to_array(text, '\r\n|\r|\n'))[1:20], lambda x: {strip("x")}), lambda x: {LABELS})[1]"""
VALUE = f"regexp_replace({FIRST_LABELLED}, '^[^:]*:', '')"
TITLE = rf"""coalesce({strip(VALUE)}, replace(regexp_replace(file_name, '\.txt$', ''), '_', ' '))"""


def split_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}'), lambda w: w <> '')"


NGRAMS = """list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))"""
TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def weighted(key: str, tf: str) -> str:
    return f"""SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight
               FROM (SELECT {key}, term, (1 + ln(tf)) * idf AS w FROM {tf} JOIN term_idf USING (term))"""


VIEWS = {
    "doc_words": f"""SELECT file_name, text, row_number() OVER (ORDER BY file_name) AS document_no, {split_words("text")} AS w FROM corpus""",
    "doc_chunks": f"""SELECT 'DOC_' || printf('%03d', document_no) || '_CH_' || printf('%03d', n + 1) AS chunk_id, file_name AS source_file,
            array_to_string(w[n * 450 + 1 : n * 450 + 500], ' ') AS text, CAST(len(w[n * 450 + 1 : n * 450 + 500]) AS INT) AS word_count, document_title
        FROM (SELECT file_name, document_no, w, {TITLE} AS document_title,
                     unnest(generate_series(0, CAST(greatest(ceil((len(w) - 500) / 450.0), 0) AS BIGINT))) AS n FROM doc_words WHERE len(w) > 0)""",
    "chunk_terms": f"""SELECT chunk_id, unnest({NGRAMS}) AS term FROM (SELECT chunk_id, {TERMS.format("text")} AS t FROM doc_chunks)""",
    "question_terms": f"""SELECT question_id, unnest({NGRAMS}) AS term FROM (SELECT question_id, {TERMS.format("question")} AS t FROM questions)""",
    "vocab": "SELECT term, count(*) AS corpus_count FROM chunk_terms GROUP BY 1 ORDER BY corpus_count DESC, term LIMIT 3000",
    "chunk_tf": "SELECT chunk_id, term, count(*) AS tf FROM chunk_terms WHERE term IN (SELECT term FROM vocab) GROUP BY 1, 2",
    "question_tf": "SELECT question_id, term, count(*) AS tf FROM question_terms WHERE term IN (SELECT term FROM vocab) GROUP BY 1, 2",
    "term_idf": """SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM doc_chunks)) / (1.0 + count(*))) + 1 AS idf FROM chunk_tf GROUP BY 1""",
    "chunk_w": weighted("chunk_id", "chunk_tf"),
    "question_w": weighted("question_id", "question_tf"),
    "hits": """SELECT question_id, CAST(rank AS INT) AS rank, chunk_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
                SELECT question_id, chunk_id, round(sum(q.weight * c.weight), 6) AS score FROM question_w q JOIN chunk_w c USING (term) GROUP BY 1, 2)
            WHERE score > 0) WHERE rank <= 5""",
}


# Sections, the best of them and answers in SQL; the sentence ends are marked first, since there is no look-behind.
BOILER = tx.BOILERPLATE_HEADS.replace("'", "''")
STOP = "[" + ", ".join(f"'{w}'" for w in tx.QUESTION_STOP_WORDS) + "]"


def trimmed_longer(parts: str, length: int) -> str:
    return f"list_filter(list_transform({parts}, lambda x: {strip('x')}), lambda x: length(x) > {length})"


def sections_sql(text: str) -> str:
    paragraphs = trimmed_longer(rf"regexp_split_to_array({text}, '\n\s*\n|={{3,}}|-{{3,}}')", 40)
    marked = rf"regexp_replace({text}, '([.!?])[\s\x0b]+', '\1' || chr(1), 'g')"
    sentences = trimmed_longer(f"string_split({marked}, chr(1))", 20)
    return f"(CASE WHEN len({paragraphs}) > 0 THEN {paragraphs} ELSE {sentences} END)"


def trim_sql(text: str) -> str:
    head = f"substr({text}, 1, 500)"
    cut = f"CASE WHEN contains({head}, ' ') THEN regexp_extract({head}, '(?s)^(.*) ', 1) ELSE {head} END"
    return f"(CASE WHEN length({text}) > 500 THEN {cut} || '...' ELSE {text} END)"


def best_section_sql(source: str) -> str:
    """question_id and best_section of ``source`` (question_id, question, body)."""
    asked = f"list_filter(list_distinct({split_words('lower(question)')}), lambda w: NOT list_contains({STOP}, w))"
    common = f"len(list_intersect({asked}, list_distinct({split_words('lower(section)')})))"
    return f"""
        SELECT question_id, coalesce({trim_sql("arg_max(section, (score, -i))")}, substr(any_value(body), 1, 500)) AS best_section
        FROM (SELECT question_id, body, i, section, {common} + least(length(section) / 500.0, 0.5) AS score
              FROM (SELECT question_id, question, body, unnest(CASE WHEN len(cand) > 0 THEN cand ELSE [NULL] END) AS section,
                           unnest(range(1, greatest(len(cand), 1) + 1)) AS i
                    FROM (SELECT *, CASE WHEN len(kept) > 0 THEN kept ELSE parts END AS cand
                          FROM (SELECT *, list_filter(parts, lambda x: NOT regexp_matches(x, '(?i){BOILER}') AND length(x) > 80) AS kept
                                FROM (SELECT question_id, question, body, {sections_sql("body")} AS parts FROM ({source}))))))
        GROUP BY question_id"""


VIEWS["found"] = f"""SELECT question_id, rank, chunk_id, source_file, {r("score", 4)} AS sim,
        CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS piece
    FROM hits JOIN doc_chunks USING (chunk_id)"""
VIEWS["per_question"] = """SELECT q.question_id, q.question, coalesce(top, 0.0) AS top, coalesce(context, '') AS body,
        coalesce(files, []) AS files, coalesce(sources, '') AS sources
    FROM questions q LEFT JOIN (
        SELECT question_id, max(sim) FILTER (WHERE rank = 1) AS top,
               string_agg(piece, ' ' ORDER BY rank) FILTER (WHERE rank <= 3 AND sim > 0.04) AS context,
               string_agg(source_file || '|' || chunk_id || '|' || printf('%.4f', sim) || '|' || substr(piece, 1, 100) || '...', chr(10)
                          ORDER BY rank) AS sources
        FROM found GROUP BY 1) USING (question_id)
    LEFT JOIN (SELECT question_id, list(source_file ORDER BY first_rank) AS files FROM (
        SELECT question_id, source_file, min(rank) AS first_rank FROM found WHERE rank <= 3 GROUP BY 1, 2) GROUP BY 1) USING (question_id)"""
VIEWS["answered"] = f"""SELECT question_id, question, sources, files,
        CASE WHEN top >= 0.05 THEN 'Na osnovu dokumenta [' || coalesce(files[1], '{retrieval.UNKNOWN_SOURCE}') || ']: ' || best_section
             || ' (Izvori: ' || array_to_string(files, ', ') || ')' ELSE '{retrieval.NO_ANSWER}' END AS answer,
        CASE WHEN top >= 0.05 THEN {rx("least(top * 3.5, 1.0)", 2)} ELSE {rx("top", 2)} END AS confidence
    FROM per_question JOIN ({best_section_sql("SELECT * FROM per_question")}) USING (question_id)"""


def chunks(t):
    return retrieval.chunk_documents(t.corpus)


def index(t):
    """The stored index of the folder's corpus. The first query of an application builds it, every later one compares the
    documents with the index's manifest and builds anew what changed."""
    name = hashlib.md5(t.folder.encode()).hexdigest()
    path = f"{run_folder(t.spark)}/index-{name}"
    version = index_store.refresh(t.corpus.select("file_name", "text"), path)
    return index_store.load(t.spark, path, version)


def hits(t):
    found = index(t)
    return found.chunks, retrieval.search_index(t.questions, found.segments, found.idf)


@query("scan_corpus", "SELECT file_name, text, word_count FROM corpus")
def scan_corpus(t):
    return corpus(t.table("documents").select(F.col("doc_id").cast("string").alias("file_name"), "text"))


@query("str_title_extract", f"SELECT file_name, {TITLE} AS title FROM corpus")
def str_title_extract(t):
    return t.corpus.select("file_name", tx.title(F.col("text"), F.col("file_name")).alias("title"))


@query("chunk_documents", "SELECT * FROM doc_chunks", VIEWS)
def chunk_documents(t):
    return chunks(t).select("chunk_id", "source_file", "text", "word_count", "metadata.document_title")


@query("str_chunk_id", "SELECT file_name, 'DOC_' || printf('%03d', document_no) || '_CH_001' AS first_chunk FROM doc_words", VIEWS)
def str_chunk_id(t):
    numbers = retrieval.document_numbers(t.corpus)
    return numbers.select("file_name", tx.chunk_id(F.col("document_no"), F.lit(1)).alias("first_chunk"))


@query(
    "doc_stats",
    f"""SELECT source_file, count(*) AS chunks, CAST(sum(word_count) AS BIGINT) AS words, {r("avg(word_count)", 6)} AS mean_words
        FROM doc_chunks GROUP BY 1""",
    VIEWS,
)
def doc_stats(t):
    return retrieval.document_stats(chunks(t)).withColumn("mean_words", round_to(F.col("mean_words"), 6))


@query("ngram_terms", "SELECT question_id, term, count(*) AS n FROM question_terms GROUP BY 1, 2", VIEWS)
def ngram_terms(t):
    terms = retrieval.term_rows(t.questions, "question_id", "question")
    return terms.groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("vocab_topn", "SELECT term, corpus_count FROM vocab", VIEWS)
def vocab_topn(t):
    termed = materialise(retrieval.with_terms(chunks(t), "chunk_id", "text"), "terms")
    found = retrieval.vocabulary(termed, store=lambda frame: materialise(frame, "term-counts"))
    return found.select("term", "corpus_count")


@query(
    "tfidf_weights",
    f"SELECT chunk_id, term, {r('weight', 6)} AS weight FROM chunk_w",
    VIEWS,
)
def tfidf_weights(t):
    found = index(t)
    return retrieval.postings(found.vectors, found.idf).select("chunk_id", "term", round_to(F.col("weight"), 6).alias("weight"))


@query(
    "similarity_search",
    """SELECT question_id, coalesce(rank, 1) AS rank, chunk_id, coalesce(score, 0.0) AS score FROM questions LEFT JOIN hits USING (question_id)""",
    VIEWS,
)
def similarity_search(t):
    return hits(t)[1]


@query("topk_per_query", "SELECT question_id, rank, chunk_id FROM hits WHERE rank <= 3", VIEWS)
def topk_per_query(t):
    found = hits(t)[1]
    return found.where((F.col("rank") <= 3) & F.col("chunk_id").isNotNull()).select("question_id", "rank", "chunk_id")


@query(
    "ordered_distinct",
    """SELECT question_id, string_agg(source_file, ',' ORDER BY first_rank) AS sources, arg_min(source_file, first_rank) AS primary_source
       FROM (SELECT question_id, source_file, min(rank) AS first_rank FROM hits JOIN doc_chunks USING (chunk_id) WHERE rank <= 3 GROUP BY 1, 2)
       GROUP BY 1""",
    VIEWS,
)
def ordered_distinct(t):
    pieces, found = hits(t)
    listed = retrieval.ordered_sources(retrieval.results(found, pieces))
    return listed.withColumn("sources", F.array_join("sources", ","))


@query("answer_questions", "SELECT question_id, question, answer, sources, confidence FROM answered", VIEWS)
def answer_questions(t):
    """Answers with their sources as lines of file, chunk, relevance and excerpt."""
    line = lambda x: F.concat_ws("|", x["file"], x["chunk_id"], F.format_string("%.4f", x["relevance"]), x["excerpt"])
    return answers(t).withColumn("sources", F.array_join(F.transform("sources", line), "\n"))


def answers(t):
    pieces, found = hits(t)
    return retrieval.answer_questions(t.questions, retrieval.results(found, pieces))


REPLIES = """SELECT CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS question_id, a.text AS question, b.text AS reply
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'"""


@query("best_paragraph", best_section_sql(f"SELECT question_id, question, reply AS body FROM ({REPLIES})"))
def best_paragraph(t):
    """Best section of the reply that follows each question."""
    return (
        question_replies(t)
        .select("question_id", retrieval.best_section(F.col("question"), F.col("reply")).alias("best_section"))
    )


def question_replies(t):
    """Each question with the next turn of its conversation."""
    turns = t.table("conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    said = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return asked.join(said, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        "question",
        "reply",
    )


@query(
    "token_overlap",
    f"""SELECT question_id, CAST(len(list_intersect(list_filter(list_distinct({split_words("lower(question)")}), lambda w: NOT list_contains({STOP}, w)),
               list_distinct({split_words("lower(reply)")}))) AS INT) AS overlap FROM ({REPLIES})""",
)
def token_overlap(t):
    return question_replies(t).select("question_id", tx.overlap(F.col("question"), F.col("reply")).alias("overlap"))


@query(
    "str_excerpt",
    """SELECT file_name, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS excerpt_300,
              CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS excerpt_100 FROM corpus""",
)
def str_excerpt(t):
    body = F.col("text")
    return t.corpus.select(
        "file_name", tx.excerpt(body, 300).alias("excerpt_300"), tx.excerpt(body, 100).alias("excerpt_100")
    )


@query(
    "str_trim_500",
    """SELECT file_name, CASE WHEN length(text) > 500 THEN CASE WHEN contains(h, ' ') THEN regexp_extract(h, '(?s)^(.*) ', 1) ELSE h END || '...'
              ELSE text END AS trimmed FROM (SELECT *, substr(text, 1, 500) AS h FROM corpus)""",
)
def str_trim_500(t):
    return t.corpus.select("file_name", tx.trim_at_blank(F.col("text")).alias("trimmed"))


@query(
    "str_header_filter",
    f"""SELECT file_name, CAST(len(l) AS INT) AS kept, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS chars FROM (
        SELECT file_name, list_filter(str_split(text, chr(10)), lambda x: length(x) > 80 AND NOT regexp_matches(x, '(?i){tx.BOILERPLATE_HEADS}')) AS l
        FROM corpus)""",
)
def str_header_filter(t):
    """Lines that are long enough and no boilerplate heads, per document."""
    kept = F.filter(F.split("text", "\n"), tx.is_content)
    frame = t.corpus.select("file_name", kept.alias("l"))
    chars = F.aggregate("l", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))
    return frame.select("file_name", F.size("l").alias("kept"), chars.alias("chars"))


@query(
    "str_split_sections",
    f"""SELECT file_name, CAST(unnest(range(len(s))) AS INT) AS section_no, unnest(s) AS section
        FROM (SELECT file_name, {sections_sql("text")} AS s FROM corpus)""",
)
def str_split_sections(t):
    parts = F.posexplode(tx.sections(F.col("text"))).alias("section_no", "section")
    return t.corpus.select("file_name", parts)


# -- question log -------------------------------------------------------------------------------------
@query(
    "scan_query_log",
    f"""SELECT count(*) AS total_queries, {r("avg(confidence)", 6)} AS avg_confidence, {r("avg(response_time_ms)", 6)} AS avg_response_time_ms
        FROM query_log""",
)
def scan_query_log(t):
    frame = query_log_summary(t.query_log)
    return frame.withColumns({c: round_to(F.col(c), 6) for c in ("avg_confidence", "avg_response_time_ms")})


@query(
    "source_usage",
    """SELECT top_source, uses, row_number() OVER (ORDER BY uses DESC, top_source) = 1 AS is_top
       FROM (SELECT top_source, count(*) AS uses FROM query_log GROUP BY 1)""",
)
def source_usage(t):
    return retrieval.source_usage(t.query_log)


@query("topic_coverage", "SELECT topic, count(*) AS questions FROM query_log GROUP BY 1")
def topic_coverage(t):
    return retrieval.topic_coverage(t.query_log)


@query(
    "histogram20",
    f"""WITH s AS (SELECT min(response_time_ms) AS lo, max(response_time_ms) AS hi, avg(response_time_ms) AS mean FROM query_log),
        n AS (SELECT CAST(least(floor((response_time_ms - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM query_log, s GROUP BY 1)
        SELECT CAST(b.bin + 1 AS INT) AS bin, {r("lo + (hi - lo) / 20 * b.bin", 6)} AS left_edge, coalesce(n, 0) AS count, {r("mean", 6)} AS mean
        FROM (SELECT unnest(generate_series(0, 19)) AS bin) b CROSS JOIN s LEFT JOIN n ON n.bin = b.bin""",
)
def histogram20(t):
    frame = retrieval.histogram(t.query_log, "response_time_ms")
    return frame.withColumns({"left_edge": round_to(F.col("left_edge"), 6), "mean": round_to(F.col("mean"), 6)})

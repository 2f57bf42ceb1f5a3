"""Document chunks, TF-IDF index, top-k search and batch question answering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantmetrics.functions import round_exact, round_to
from plantmetrics.functions.relational import attach_row, with_row_index
from plantmetrics.functions.text import (
    chunk_id,
    content_sections,
    excerpt,
    overlap,
    sections,
    terms,
    title,
    trim_at_blank,
    with_pairs,
    words,
)
from plantmetrics.operators import block_index
from plantmetrics.session import materialise

# Fixed values.
CHUNK_WORDS = 500
CHUNK_OVERLAP = 50
MAX_TERMS = 3000
ANSWER_THRESHOLD = 0.05
PART_THRESHOLD = 0.04
CONFIDENCE_FACTOR = 3.5
NO_ANSWER = "Nemam dovoljno informacija u dostupnim dokumentima za odgovor na ovo pitanje."
UNKNOWN_SOURCE = "nepoznat izvor"
ANSWER_FORMAT = "Na osnovu dokumenta [%s]: %s (Izvori: %s)"

COUNT_ROWS = 1000  # texts whose terms are counted at once
TILE_CHUNKS = block_index.SEGMENT_CHUNKS
BLOCK_QUESTIONS = block_index.BLOCK_QUESTIONS
MERGE_PARTS = block_index.MERGE_PARTS
SMALL_NAMES = 1_000_000  # so many document numbers are sent to every task; more are joined by an exchange


def document_numbers(docs: DataFrame) -> DataFrame:
    """1-based place of each file in name order; names are sorted in range partitions, whatever they look like."""
    placed = with_row_index(docs.select("file_name"), [], ["file_name"], "document_no")
    return placed.select("file_name", (F.col("document_no") + 1).alias("document_no"))


def with_numbers(frame: DataFrame, numbers: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows with the number of their document; up to SMALL_NAMES numbers travel to the rows, so no text is exchanged."""
    numbers = materialise(numbers, "numbers")
    return frame.join(F.broadcast(numbers) if numbers.count() <= SMALL_NAMES else numbers, key)


def cut_documents(docs: DataFrame, size: int = CHUNK_WORDS, overlap_words: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` words with overlap, the last one ends with the text: the columns of ``docs`` but for the text,
    document_title, n (place in the document, from 0), text, word_count. Documents are cut where they are."""
    step = max(size - overlap_words, 1)
    names = [c for c in docs.columns if c not in ("text", "word_count")]
    last = F.greatest(F.ceil((F.size("w") - size) / step), F.lit(0)).cast("int")
    # no filter on the word count: it would be pushed below a join and split every text twice
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    # the title is taken before the explode, once per document
    titled = docs.select(*names, title(F.col("text"), F.col("file_name")).alias("document_title"), words(F.col("text")).alias("w"))
    parts = titled.select(*names, "document_title", "w", F.explode(starts).alias("n"))
    piece = F.slice("w", F.col("n") * step + 1, size)
    return parts.select(*names, "document_title", "n", F.array_join(piece, " ").alias("text"), F.size(piece).alias("word_count"))


def chunk_documents(docs: DataFrame, size: int = CHUNK_WORDS, overlap_words: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of the documents with their ids.

    Documents that bring a ``document_no`` are chunked where they are; otherwise numbers are joined in.
    """
    docs = docs.select("file_name", "text", *(["document_no"] if "document_no" in docs.columns else []))
    if "document_no" not in docs.columns:
        docs = with_numbers(docs, document_numbers(docs), "file_name")
    return named_chunks(cut_documents(docs, size, overlap_words))


def named_chunks(cut: DataFrame, *more: str) -> DataFrame:
    return cut.select(
        chunk_id(F.col("document_no"), F.col("n") + 1).alias("chunk_id"),
        F.col("file_name").alias("source_file"),
        "text",
        "word_count",
        F.struct("document_title").alias("metadata"),
        *more,
    )


def document_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("word_count").alias("words"), F.avg("word_count").alias("mean_words")
    )


def term_rows(frame: DataFrame, key: str, text: str) -> DataFrame:
    """Terms and pairs of neighbouring terms, one row each."""
    return frame.select(key, terms(F.col(text)).alias("t")).select(key, F.explode(with_pairs(F.col("t"))).alias("term"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("corpus_count"))


def pair_counts(termed: DataFrame, names: DataFrame) -> DataFrame:
    """term and corpus_count of the pairs of neighbours that are both in ``names``, a written table.

    Up to SMALL_NAMES names are sent to the tasks, which count pairs as pairs of numbers; more are joined to the pairs.
    """
    if names.count() > SMALL_NAMES:
        neighbours = F.zip_with(
            F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))),
            F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))),
            lambda x, y: F.struct(x.alias("a"), y.alias("b")),
        )
        pairs = (
            termed.select(F.inline(neighbours))
            .join(names.withColumnRenamed("term", "a"), "a", "left_semi")
            .join(names.withColumnRenamed("term", "b"), "b", "left_semi")
        )
        return _counted(pairs.select(F.concat_ws(" ", "a", "b").alias("term")))
    words = sorted(row["term"] for row in names.select("term").collect())
    shared = termed.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(shared.value, pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows, COUNT_ROWS):
                at, row = word_places(batch.column(0).slice(start, COUNT_ROWS), words)
                side = (at[:-1] >= 0) & (at[1:] >= 0) & (row[:-1] == row[1:])
                code, n = np.unique(at[:-1][side] * len(words) + at[1:][side], return_counts=True)
                first, second = (words.take(pa.array(x)) for x in np.divmod(code, max(len(words), 1)))
                term = pc.binary_join_element_wise(first, second, " ")
                yield pa.RecordBatch.from_arrays([term, pa.array(n, pa.int64())], names=["term", "n"])

    counted = termed.select("t").mapInArrow(count, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("corpus_count"))


def word_places(texts: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of every term of every text its place in ``words``, -1 if it is not there, and the number of its text."""
    sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    found = pc.index_in(pc.list_flatten(texts).cast(pa.string()), value_set=words)
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def with_terms(frame: DataFrame, key: str, text: str) -> DataFrame:
    """key and ``t``, the text's terms in order: what the steps of an index read, so texts are split once."""
    return frame.select(key, terms(F.col(text)).alias("t"))


def vocabulary(termed: DataFrame, n: int = MAX_TERMS, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The n terms with the highest corpus count, ties by term, with a column number; n rows at most.

    ``termed`` holds the terms ``t`` of each text. A pair is never more frequent than its parts. So once n single terms reach
    a count, pairs with a rarer part cannot be among the n, and only pairs of terms that reach it are counted.
    """
    keep = store or (lambda frame: frame)
    counts = keep(_counted(termed.select(F.explode("t").alias("term"))))
    top = counts.orderBy(F.desc("corpus_count"), "term").limit(n)
    bar = top.agg(F.when(F.count(F.lit(1)) == n, F.min("corpus_count")).otherwise(0)).scalar()
    names = materialise(counts.where(F.col("corpus_count") >= bar).select("term"), "frequent-terms")
    best = top.unionByName(pair_counts(termed, names)).orderBy(F.desc("corpus_count"), "term").limit(n)
    return best.withColumn("term_no", F.row_number().over(W.orderBy(F.desc("corpus_count"), "term")) - 1)


def term_vectors(termed: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """One row per key with a known term: ``v``, the (term_no, tf) pairs of the vocabulary's terms in term order.

    Every text is one row of ``termed``, so its terms are counted where it is, against the vocabulary of at most n terms. Terms
    become numbers in one lookup a batch, and pairs are looked up as pairs of numbers.
    """
    rows = vocab.select("term", "term_no").collect()
    shared = termed.sparkSession.sparkContext.broadcast(Numbers.of({row["term"]: row["term_no"] for row in rows}))
    kind = pa.list_(pa.struct([("term_no", pa.int32()), ("tf", pa.int32())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, COUNT_ROWS):
                some = batch.slice(start, COUNT_ROWS)
                starts, term_no, tf = shared.value.count(some.column(1))
                v = pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([term_no, tf], fields=list(kind.value_type)))
                out = pa.RecordBatch.from_arrays([some.column(0), v], names=[key, "v"])
                yield out.filter(pa.array(np.diff(starts.to_numpy()) > 0))

    return termed.select(F.col(key).cast("string").alias(key), "t").mapInArrow(count, f"{key} string, v array<struct<term_no: int, tf: int>>")


class Numbers(NamedTuple):
    """A vocabulary for counting: its words and the parts of its pairs, and the numbers of the words and of the pairs."""

    words: list[str]
    word_no: np.ndarray  # by place among the words; -1 for a word that is only part of a pair
    pairs: np.ndarray  # place of the first part * number of words + place of the second, ascending
    pair_no: np.ndarray

    @classmethod
    def of(cls, numbers: dict[str, int]) -> Numbers:
        words = sorted({word for term in numbers for word in term.split(" ")})
        place = {word: i for i, word in enumerate(words)}
        parts = [(term.split(" "), no) for term, no in numbers.items()]
        pairs = sorted((place[p[0]] * len(words) + place[p[1]], no) for p, no in parts if len(p) == 2)
        word_no = np.array([numbers.get(word, -1) for word in words], np.int64)
        return cls(words, word_no, *(np.array([p[i] for p in pairs], np.int64) for i in (0, 1)))

    def count(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Where each text's terms start, their numbers in order, and how often each occurs."""
        at, row = word_places(texts, pa.array(self.words, pa.string()))
        known = at >= 0
        number = np.full(len(at), -1, np.int64)
        number[known] = self.word_no[at[known]]
        side = known[:-1] & known[1:] & (row[:-1] == row[1:])
        pair, pair_row = at[:-1][side] * len(self.words) + at[1:][side], row[:-1][side]
        place = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        hit = self.pairs[place] == pair if len(self.pairs) else np.zeros(len(pair), bool)
        rows = np.concatenate([row[number >= 0], pair_row[hit]])
        numbers = np.concatenate([number[number >= 0], self.pair_no[place[hit]]]) if hit.any() else number[number >= 0]
        width = int(max(self.word_no.max(initial=-1), self.pair_no.max(initial=-1))) + 1
        cells, tf = np.unique(rows * max(width, 1) + numbers, return_counts=True)
        starts = np.searchsorted(cells, np.arange(len(texts) + 1) * max(width, 1))
        numbers = (cells % max(width, 1)).astype(np.int32)
        return pa.array(starts, pa.int32()), pa.array(numbers), pa.array(tf, pa.int32())


def inverse_frequencies(vectors: DataFrame, vocab: DataFrame, documents: DataFrame) -> DataFrame:
    """idf = ln((1 + n) / (1 + df)) + 1 per term of the vocabulary."""
    n = documents.agg(F.count(F.lit(1)).alias("n"))
    df = vectors.select(F.explode("v.term_no").alias("term_no")).groupBy("term_no").agg(F.count(F.lit(1)).alias("df"))
    named = vocab.select("term", "term_no").join(df, "term_no")
    return attach_row(named, n, "_d").select(
        "term", "term_no", "df", (F.log((1 + F.col("_d.n")) / (1 + F.col("df"))) + 1).alias("idf")
    )


def weigh_parts(vectors: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(1 + ln tf) * idf and the length to divide it by: key, cols, vals, norm. Works inside the row, on the idf list of n numbers."""
    listed = idf.agg(F.array_sort(F.collect_list(F.struct("term_no", "idf"))).alias("l"))
    table = listed.select(F.transform("l", lambda x: x["idf"]).alias("idf"))
    raw = F.transform("v", lambda x: (1 + F.log(x["tf"])) * F.get("_i.idf", x["term_no"]))
    framed = attach_row(vectors, table, "_i").select(key, F.col("v.term_no").alias("cols"), raw.alias("vals"))
    return framed.withColumn("norm", F.sqrt(F.aggregate("vals", F.lit(0.0), lambda total, x: total + x * x)))


def weigh(vectors: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(1 + ln tf) * idf scaled to length 1: key, cols, vals."""
    # the norm is handed over as an array: named inside the lambda it would be computed for every element
    norms = F.array_repeat("norm", F.size("vals"))
    parts = weigh_parts(vectors, idf, key)
    return parts.select(key, "cols", F.zip_with("vals", norms, lambda x, n: x / n).alias("vals"))


def count_index(
    termed: DataFrame, max_terms: int = MAX_TERMS, store: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Counted terms of the vocabulary per chunk, and the term table, from chunk_id and ``t``; see build_index."""
    keep = store or (lambda frame: frame)
    vocab = keep(vocabulary(termed, max_terms, store))
    counted = keep(term_vectors(termed, "chunk_id", vocab))
    return counted, inverse_frequencies(counted, vocab, termed)


def build_index(
    chunks: DataFrame, max_terms: int = MAX_TERMS, store: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(vectors, idf): chunk_id, cols, vals; and the term table.

    ``store`` may write what is read several times (terms, their counts, vocabulary, vectors) to tables. No text and no term
    list is shuffled: the exchanges carry counts per term.
    """
    keep = store or (lambda frame: frame)
    counted, idf = count_index(keep(with_terms(chunks, "chunk_id", "text")), max_terms, store)
    return weigh(counted, idf, "chunk_id"), idf


def postings(vectors: DataFrame, idf: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The vectors in long form: key, term, weight."""
    cells = vectors.select(key, F.inline(F.arrays_zip("cols", "vals"))).withColumnRenamed("cols", "term_no")
    named = cells.join(F.broadcast(idf.select("term", "term_no")), "term_no")
    return named.select(key, "term", F.col("vals").alias("weight"))


def question_vectors(questions: DataFrame, idf: DataFrame) -> DataFrame:
    """Question vectors in the terms of the index."""
    return weigh(term_vectors(with_terms(questions, "question_id", "question"), "question_id", idf), idf, "question_id")


def search(questions: DataFrame, vectors: DataFrame, idf: DataFrame, k: int = 5, max_terms: int = MAX_TERMS) -> DataFrame:
    """The k chunks with the highest cosine per question, from vectors that are cut into segments first; see search_index."""
    segments = materialise(block_index.build_segments(vectors, TILE_CHUNKS), "segments")
    return search_index(questions, segments, idf, k)


def search_index(questions: DataFrame, segments: DataFrame, idf: DataFrame, k: int = 5) -> DataFrame:
    """The k chunks with the highest cosine per question: question_id, rank, chunk_id, score.

    ``segments`` is the inverted index; a question is compared only with segments that can hold one of its k best chunks.

    Scores are rounded to six digits before ranking; ties go to the lower chunk id. Chunks without a common term (score 0)
    are no hits, so a question can have fewer than k; one without any hit keeps one row with score 0.
    """
    ranked = block_index.search_segments(question_vectors(questions, idf), segments, k, BLOCK_QUESTIONS, MERGE_PARTS)
    return questions.select("question_id").join(ranked, "question_id", "left").select(
        "question_id",
        F.coalesce("rank", F.lit(1)).alias("rank"),
        "chunk_id",
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def results(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with source file, excerpt of 300 characters and score rounded to four digits."""
    # texts are cut before the join, so that it moves excerpts only
    pieces = chunks.select("chunk_id", "source_file", excerpt(F.col("text"), 300).alias("text"))
    return hits.join(pieces, "chunk_id", "left").select(
        "question_id",
        "rank",
        "chunk_id",
        "source_file",
        "text",
        round_to(F.col("score"), 4).alias("similarity_score"),
    )


def ordered_sources(found: DataFrame, top: int = 3) -> DataFrame:
    """Distinct source files of the best chunks in rank order, and the first of them."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "source_file")))
    files = F.array_distinct(F.transform(listed, lambda r: r["source_file"]))
    return (
        found.where((F.col("rank") <= top) & F.col("source_file").isNotNull())
        .groupBy("question_id")
        .agg(files.alias("sources"))
        .withColumn("primary_source", F.get("sources", F.lit(0)))
    )


def best_section(question: Column, text: Column) -> Column:
    """The section with the most question words; a longer one gains up to half a point; the first best wins."""
    candidates = content_sections(sections(text))
    scored = F.transform(
        candidates,
        lambda s, i: F.struct(
            (overlap(question, s) + F.least(F.length(s) / 500, F.lit(0.5))).alias("score"),
            (-i).alias("earlier"),
            s.alias("section"),
        ),
    )
    return F.when(F.size(candidates) > 0, trim_at_blank(F.array_max(scored)["section"])).otherwise(
        F.substring(text, 1, 500)
    )


def answer_questions(questions: DataFrame, found: DataFrame) -> DataFrame:
    """Answer, confidence and sources per question from its ranked results (at most k rows each)."""
    row = F.struct("rank", "chunk_id", "source_file", "text", "similarity_score")
    per = (
        found.where(F.col("chunk_id").isNotNull())
        .groupBy("question_id")
        .agg(F.array_sort(F.collect_list(row)).alias("r"))
    )
    joined = questions.select("question_id", "question").join(per, "question_id", "left")
    empty = F.array().cast("array<struct<rank:int,chunk_id:string,source_file:string,text:string,similarity_score:double>>")
    joined = joined.withColumn("r", F.coalesce("r", empty)).withColumn(
        "top", F.coalesce(F.get("r", F.lit(0))["similarity_score"], F.lit(0.0))
    )
    lead = F.slice("r", 1, 3)
    context = F.array_join(
        F.transform(F.filter(lead, lambda x: x["similarity_score"] > PART_THRESHOLD), lambda x: x["text"]), " "
    )
    files = F.array_distinct(F.transform(lead, lambda x: x["source_file"]))
    framed = joined.withColumn("context", context).withColumn("files", files)
    answer = F.format_string(
        ANSWER_FORMAT,
        F.coalesce(F.get("files", F.lit(0)), F.lit(UNKNOWN_SOURCE)),
        best_section(F.col("question"), F.col("context")),
        F.array_join("files", ", "),
    )
    sure = F.col("top") >= ANSWER_THRESHOLD
    return framed.select(
        "question_id",
        "question",
        F.when(sure, answer).otherwise(NO_ANSWER).alias("answer"),
        F.transform(
            "r",
            lambda x: F.struct(
                x["source_file"].alias("file"),
                x["chunk_id"].alias("chunk_id"),
                x["similarity_score"].alias("relevance"),
                F.concat(F.substring(x["text"], 1, 100), F.lit("...")).alias("excerpt"),
            ),
        ).alias("sources"),
        F.when(sure, round_exact(F.least(F.col("top") * CONFIDENCE_FACTOR, F.lit(1.0)), 2))
        .otherwise(round_exact(F.col("top"), 2))
        .alias("confidence"),
    )


def source_usage(log: DataFrame) -> DataFrame:
    """How often each document was the first source, with the most used one marked."""
    counts = log.where(F.col("top_source").isNotNull()).groupBy("top_source").agg(F.count(F.lit(1)).alias("uses"))
    leader = F.row_number().over(W.orderBy(F.desc("uses"), "top_source")) == 1
    return counts.withColumn("is_top", leader)


def topic_coverage(log: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Questions per topic; a question-to-topic table may be joined in."""
    frame = log if topics is None else log.join(topics, "question")
    return frame.groupBy("topic").agg(F.count(F.lit(1)).alias("questions"))


def histogram(frame: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between minimum and maximum; the top edge belongs to the last bin; empty bins count 0."""
    span = frame.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"))
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    placed = attach_row(frame.select(value), span, "_s").select(
        F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_s.lo")) / width), F.lit(bins - 1)))
        .otherwise(bins // 2)
        .cast("int")
        .alias("bin")
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = span.select("lo", "hi", "mean", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, "bin", "left").select(
        (F.col("bin") + 1).alias("bin"),
        (F.col("lo") + step * F.col("bin")).alias("left_edge"),
        F.coalesce("n", F.lit(0)).alias("count"),
        "mean",
    )

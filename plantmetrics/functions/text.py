"""String helpers: padding, product names, compositions, identifiers, tokens, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------------------------------
# Whitespace in the Unicode sense (blank, controls 1c-1f, no-break and typographic spaces).
WHITESPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# A term is a run of two or more letters, digits or underscores.
TERM = r"[\p{L}\p{N}_]{2,}"
PREFIX_LABEL = r"^[a-z]+:\s*"
MATERIAL = r"(?i)([a-z ]+?)\s+(\d+)%"
VERSION_SUFFIX = r"\s+v\d+$"
TITLE_LABELS = ["Naziv:", "Document:", "Title:"]
BOILERPLATE_HEADS = (
    r"^(STANDARDNA|Dokument:|Naziv:|Revizija:|Datum|Pripremio:|Odobrio:|Klasifikacija:|SADRŽAJ|"
    r"PLAN ODRŽAVANJA|PRIRUČNIK|SPECIFIKACIJA|Document:|Title:|1\.\s|2\.\s|3\.\s)"
)
QUESTION_STOP_WORDS = [
    "su", "se", "za", "na", "je", "u", "i", "koji", "koja", "koje", "kako", "što", "iz", "sa", "od", "do",
    "li", "da", "the", "a", "an", "in", "of", "to", "for",
]
# ------------------------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Words between runs of whitespace; no empty ones."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, f"^{WHITESPACE}|{WHITESPACE}$", "")


def zfill(code: Column, width: int) -> Column:
    """Pad with zeros on the left; longer codes are kept whole (``lpad`` would cut them)."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def product_line(name: Column) -> Column:
    return F.regexp_replace(name, VERSION_SUFFIX, "")


def model_name(name: Column) -> Column:
    return F.split_part(name, F.lit(" v"), F.lit(1))


def parse_materials(composition: Column) -> Column:
    """Array of (name, pct) in text order; a repeated name keeps its last share, unparsable text counts 100."""
    clean = F.regexp_replace(strip(composition), PREFIX_LABEL, "")
    names = F.regexp_extract_all(clean, F.lit(MATERIAL), F.lit(1))
    shares = F.regexp_extract_all(clean, F.lit(MATERIAL), F.lit(2))
    parsed = F.zip_with(
        names, shares, lambda n, s: F.struct(F.trim(n).alias("name"), s.cast("int").alias("pct"))
    )
    last = F.filter(
        parsed,
        lambda m, i: ~F.exists(F.slice(parsed, i + 2, F.size(parsed)), lambda later: later["name"] == m["name"]),
    )
    whole = F.array(F.struct(clean.alias("name"), F.lit(100).alias("pct")))
    return F.when(F.size(parsed) > 0, last).otherwise(whole)


def share_containing(materials: Column, part: str) -> Column:
    """Sum of the shares of materials whose name contains ``part``."""
    hits = F.filter(materials, lambda m: F.lower(m["name"]).contains(part))
    return F.aggregate(hits, F.lit(0), lambda total, m: total + m["pct"])


def gtin(identifier: Column) -> Column:
    """13 digits: country prefix 38, then the first ten digits of the MD5 text, zero-filled on the right."""
    digits = F.substring(F.regexp_replace(F.md5(identifier.cast("binary")), "[^0-9]", ""), 1, 10)
    return F.rpad(F.concat(F.lit("38"), digits), 13, "0")


def passport_id(product_id: Column, prefix: str, drop: str = "PROD-") -> Column:
    return F.concat(F.lit(prefix), F.replace(product_id, F.lit(drop), F.lit("")))


def chunk_id(document_no: Column, chunk_no: Column) -> Column:
    return F.format_string("DOC_%03d_CH_%03d", document_no.cast("long"), chunk_no.cast("long"))


def title(text: Column, file_name: Column) -> Column:
    """Value of the first title label within the first 20 lines, else the file name made readable."""
    lines = F.transform(F.slice(F.split(text, r"\r\n|\r|\n", 21), 1, 20), strip)
    labelled = F.filter(lines, lambda line: _starts_with_any(line, TITLE_LABELS))
    value = strip(F.regexp_replace(F.get(labelled, F.lit(0)), "^[^:]*:", ""))
    readable = F.replace(F.regexp_replace(file_name, r"\.txt$", ""), F.lit("_"), F.lit(" "))
    return F.coalesce(value, readable)


def _starts_with_any(line: Column, labels: list[str]) -> Column:
    hit = line.startswith(labels[0])
    for label in labels[1:]:
        hit = hit | line.startswith(label)
    return hit


def excerpt(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def trim_at_blank(text: Column, length: int = 500) -> Column:
    """Cut to ``length`` characters, back to the last blank, with an ellipsis."""
    head = F.substring(text, 1, length)
    at_blank = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    cut = F.when(head.contains(" "), at_blank).otherwise(head)
    return F.when(F.length(text) > length, F.concat(cut, F.lit("..."))).otherwise(text)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def with_pairs(single: Column) -> Column:
    """The terms, then each pair of neighbours; hand in a column, since it is read several times."""
    pairs = F.zip_with(
        F.slice(single, 1, F.greatest(F.size(single) - 1, F.lit(0))),
        F.slice(single, 2, F.greatest(F.size(single), F.lit(1))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(single, pairs)


def sections(text: Column) -> Column:
    """Paragraphs between blank lines or rules of = or -, longer than 40; else sentences longer than 20."""
    paragraphs = _trimmed_longer(F.split(text, r"\n\s*\n|={3,}|-{3,}"), 40)
    sentences = _trimmed_longer(F.split(text, r"(?<=[.!?])\s+"), 20)
    return F.when(F.size(paragraphs) > 0, paragraphs).otherwise(sentences)


def _trimmed_longer(parts: Column, length: int) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: F.length(p) > length)


def content_sections(parts: Column) -> Column:
    """Sections without boilerplate heads and longer than 80; all of them when none is left."""
    kept = F.filter(parts, is_content)
    return F.when(F.size(kept) > 0, kept).otherwise(parts)


def is_content(part: Column) -> Column:
    return ~part.rlike("(?iu)" + BOILERPLATE_HEADS) & (F.length(part) > 80)


def question_words(question: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in QUESTION_STOP_WORDS])
    return F.array_except(words(F.lower(question)), stop)


def overlap(question: Column, section: Column) -> Column:
    """Number of distinct question words that occur in the section."""
    return F.size(F.array_intersect(question_words(question), words(F.lower(section))))

"""Scans for artifacts of extraction, and the report over a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import HEAD, TAIL, has, strip, word_count

# What is counted.
PATTERNS = {
    "hyphen_trailing_space": rf"{HEAD}[a-zA-Z]{{2,}}-\s{{1,3}}[a-z]{{3,}}{TAIL}",
    "hyphen_newline": r"[A-Za-z0-9_]-\s*\n\s*[a-z]",
    "layout_annotation": r"\S+_[Ll]ayout\s+\d[^\n]*",
    "spaced_logo_letters": rf"{HEAD}([A-Z] ){{2,6}}[A-Z]{TAIL}",
    "ocr_substitution_FRM": r"Flz\.[MW]",
    "ocr_constrnction": "(?i)constrnction",
    "journal_header_inline": r"(?i)Journal of Emergency Management\s+Vol\.\s*\d+",
    "journal_header_newline": r"(?i)Journal of Emergency Management\s*\n\s*Vol\.",
    "issn_line": r"ISSN \d{4}-\d{4}",
    "copyright_line": r"Copyright.*\d{4}",
    "bare_url_line": r"(?m)^\s*https?://[^\s]+\s*$",
    "www_url_line": r"(?m)^\s*www\.[^\s]{5,}\s*$",
    "standalone_page_number": r"(?m)^\s*\d{1,4}\s*$",
    "subscription_price": r"US \$\d+|Canada \$\d+",
    "doi_line": r"(?m)^DOI:[^\n]*",
    "jem_junk_number": r"(?m)^JEM\s+\d+\s*$",
}


#: Plain strings, of which a text with a match holds one, in lower case if the pattern doesn't mind the case.
NEEDED = {
    "hyphen_trailing_space": ["-"], "hyphen_newline": ["-"], "layout_annotation": ["_Layout", "_layout"], "ocr_substitution_FRM": ["Flz."], "issn_line": ["ISSN "],
    "copyright_line": ["Copyright"], "bare_url_line": ["http"], "www_url_line": ["www."], "subscription_price": ["US $", "Canada $"], "doi_line": ["DOI:"], "jem_junk_number": ["JEM"],
}
NEEDED_LOW = {"ocr_constrnction": ["constrnction"], "journal_header_inline": ["journal of emergency management"], "journal_header_newline": ["journal of emergency management"]}


def counts(text: Column) -> dict[str, Column]:
    def count(k: str, p: str) -> Column:
        n = F.regexp_count(text, F.lit(p)).cast("long")
        gate = has(text, *NEEDED[k]) if k in NEEDED else has(F.lower(text), *NEEDED_LOW[k]) if k in NEEDED_LOW else None
        return n if gate is None else F.when(~gate, F.lit(0).cast("long")).otherwise(n)

    return {k: count(k, p) for k, p in PATTERNS.items()}


def examples(text: Column, pattern: str) -> Column:
    """The first three matches, trimmed, of 80 characters at most."""
    return F.transform(F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), 1, 3), lambda m: F.left(strip(m), F.lit(80)))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """A column for each pattern's count, and noise_ratio: all counts by the words."""
    found = df.withColumns(counts(F.col(text)))
    total = sum((F.col(k) for k in PATTERNS), F.lit(0))
    return found.withColumn("noise_ratio", total / word_count(F.col(text)))


def chunk_noise(ratio: Column) -> Column:
    return F.least(F.lit(1.0), 10 * ratio)


def _counted(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    return df.select(key, F.struct(*[c.alias(k) for k, c in counts(F.col(text)).items()]).alias(name))


def _both(raw: DataFrame, cleaned: DataFrame, key: str) -> DataFrame:
    """key, raw, clean: the counts of either text, a row a document."""
    return _counted(raw, key, "text", "raw").join(_counted(cleaned, key, "cleaned_text", "clean"), key)


def _sums() -> list[Column]:
    """Of each type, the sum of the raw counts and of the clean ones."""
    return [F.struct(F.lit(k).alias("type"), F.sum(f"raw.{k}").alias("raw"), F.sum(f"clean.{k}").alias("clean")).alias(k) for k in sorted(PATTERNS)]


def removed_percent(raw: Column, clean: Column) -> Column:
    """Rounded half up; 0 where there was nothing."""
    return F.when(raw == 0, 0).otherwise(F.floor(100 * (raw - clean) / F.greatest(raw, F.lit(1)) + 0.5)).cast("long")


def document_report(raw: DataFrame, cleaned: DataFrame, key: str, filenames: DataFrame | None = None) -> DataFrame:
    """A row a document: key, filename (from filenames, else the key), raw, clean, removed,
    percent, and improvement, a map from each type to the number removed."""
    by_type = _both(raw, cleaned, key).groupBy(key).agg(*_sums())
    total = lambda side: reduce(lambda a, b: a + b, [F.col(f"{k}.{side}") for k in sorted(PATTERNS)])
    less = F.array(*[F.struct(F.lit(k).alias("type"), (F.col(f"{k}.raw") - F.col(f"{k}.clean")).alias("n")) for k in sorted(PATTERNS)])
    rows = by_type.select(key, total("raw").alias("raw"), total("clean").alias("clean"), F.map_from_entries(less).alias("improvement"))
    named = rows.withColumn("filename", F.lit(None).cast("string")) if filenames is None else rows.join(filenames.select(key, "filename"), key, "left")
    return named.select(
        key, F.coalesce("filename", F.col(key).cast("string")).alias("filename"), "raw", "clean", (F.col("raw") - F.col("clean")).alias("removed"),
        removed_percent(F.col("raw"), F.col("clean")).alias("percent"), "improvement",
    )


def corpus_report(raw: DataFrame, cleaned: DataFrame, key: str) -> DataFrame:
    """By type and in all (type null): raw, clean, removed, percent. A document that is
    in one table only doesn't count."""
    one = _both(raw, cleaned, key).agg(F.count("*").alias("n"), *_sums()).where("n > 0")
    by_type = one.select(F.explode(F.array(*sorted(PATTERNS))).alias("t")).select("t.*")
    sums = by_type.rollup("type").agg(F.sum("raw").alias("raw"), F.sum("clean").alias("clean"))
    return sums.select("type", "raw", "clean", (F.col("raw") - F.col("clean")).alias("removed"), removed_percent(F.col("raw"), F.col("clean")).alias("percent"))

"""Line dedup: winnowing over line hashes.

A text's units are its lines with something on them, compared without the
white space around them. Of the hashes of two units in each window of three
units the lesser is kept as a fingerprint, so every run of three units holds
one, and equal runs hold the same. Fingerprints are joined; those that occur
once go no further. The others are extended by a unit both ways: a later place
of a fingerprint is repeated as far as the unit before it, or the one after it,
occurs with it earlier too. Of each such run of three the first place, in the
order of doc_id, is found, whichever document holds it; longer runs are the
union of theirs. So a unit is deleted where it lies in a run of LEAST_RUN
units that occurs earlier, all of which are found.

Where one or two units have LEAST_WORDS words they are fingerprints as they
are, and so is a whole text of fewer than three units, which goes where an
earlier text is the same. Other repeated lines stay. A unit is deleted only
for an earlier one, so the first of each stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, row_key, text_mark, texts_of, unplaced
from .tokens import text_batches

LEAST_RUN, LEAST_WORDS = 3, 50
_ANCHORS = "doc_id long, mark string, at int, size int, alone boolean, before long, after long, f1 long, f2 long"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("mark", pa.string()), ("at", pa.int32()), ("size", pa.int32()), ("alone", pa.bool_()),
    ("before", pa.int64()), ("after", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
])
Anchor = tuple[int, int, bool, int | None, int | None, int, int]


def units_of(text: str) -> tuple[list[str], list[int]]:
    """The stripped non-blank lines, and their line numbers."""
    lines = [(s, i) for i, line in enumerate(text.split("\n")) if (s := line.strip())]
    return [s for s, _ in lines], [i for _, i in lines]


def _digest(text: str) -> tuple[int, int]:
    from xxhash import xxh3_128_intdigest

    h = xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def anchors_of(units: list[str]) -> Iterator[Anchor]:
    """The fingerprints of a text: first unit, number of units, whether a later place is
    deleted as it is, hashes of the units before and after, and 128 bits."""
    n = len(units)
    if n < LEAST_RUN:
        if n:
            yield 0, n, True, None, None, *_digest("\0" + "\n".join(units))
    words = [len(u.split()) for u in units]
    for i in range(n):
        if words[i] >= LEAST_WORDS:
            yield i, 1, True, None, None, *_digest(units[i])
    if n < 2:
        return
    single = [_digest(u)[0] for u in units]
    pairs = [_digest(f"{a}\n{b}") for a, b in zip(units, units[1:], strict=False)]
    kept = {i + 1 if pairs[i + 1] <= pairs[i] else i for i in range(n - 2)}
    for i, p in enumerate(pairs):
        long = words[i] + words[i + 1] >= LEAST_WORDS
        if i in kept or long:
            yield i, 2, long, single[i - 1] if i else None, single[i + 2] if i + 2 < n else None, *p


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_batches(batch):
            out = []
            for doc_id, mark, text in zip(rows.column("doc_id").to_pylist(), rows.column("mark").to_pylist(), texts.to_pylist(), strict=True):
                out += [(doc_id, mark, *a) for a in anchors_of(units_of(text)[0])]
            columns = zip(*out, strict=True) if out else [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Of each document that has any, the units to delete: doc_id, mark (of the text) and
    runs, an array of (lo, hi)."""
    made = texts_of(docs, text_mark(F.col("text")).alias("mark")).where("text is not null").mapInArrow(_anchors, _ANCHORS)
    anchors = materialize(made, "line-anchors")
    again = anchors.groupBy("f1", "f2").agg(F.count("*").alias("n")).where("n > 1")
    # Dealt anew for the joins, so that a skewed partition of anchors may be split.
    shared = anchors.join(again.select(unplaced(F.col("f1")).alias("f1"), "f2"), ["f1", "f2"])
    at, end = F.col("at"), F.col("at") + F.col("size")
    none = F.lit(0).cast("long")
    run = lambda kind, by, lo, hi: F.struct(F.lit(kind).alias("kind"), by.alias("by"), lo.alias("lo"), hi.alias("hi"))
    runs = [
        F.when(F.col("alone"), run(0, none, at, end)), F.when(F.col("before").isNotNull(), run(1, F.col("before"), at - 1, end)),
        F.when(F.col("after").isNotNull(), run(2, F.col("after"), at, end + 1)),
    ]
    extended = shared.select("doc_id", "mark", "f1", "f2", F.explode(F.array_compact(F.array(*runs))).alias("r")).select("doc_id", "mark", "f1", "f2", "r.*")
    extended = materialize(extended, "line-runs")
    place = F.struct("doc_id", "mark", "lo")
    first = extended.groupBy("f1", "f2", "kind", "by").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(unplaced(F.col("f1")).alias("f1"), "f2", "kind", "by", "first")
    later = extended.join(first, ["f1", "f2", "kind", "by"]).where(place != F.col("first")).select("doc_id", "mark", "lo", "hi").distinct()
    return materialize(later.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs")), "repeated-lines")


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with their runs, null for most, in a column of the name given. Runs are
    as many as a share of the documents, so both are shuffled."""
    keyed, names = row_key(docs)
    (runs,) = fresh(keyed, "_runs")
    found = repeated_runs(docs).select(F.coalesce("doc_id", F.lit(0)).alias(names[0]), F.col("doc_id").isNull().alias(names[1]), F.col("mark").alias(names[2]), F.col("runs").alias(runs))
    return keyed.join(found.hint("merge"), names, "left").select(*docs.columns, runs), runs


def _rewrite(text: str | None, runs: list[dict] | None) -> tuple[str | None, int, int]:
    """What stays of a text, its number of units, and how many go."""
    units, at = units_of(text or "")
    gone = {at[i] for r in runs or [] for i in range(r["lo"], r["hi"])}
    return text if not gone else "\n".join(s for i, s in enumerate(text.split("\n")) if i not in gone), len(units), len(gone)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, text (what stays), n_lines (units before), n_removed.

    Null texts stay null, empty ones empty. Rows with equal doc_id and text are
    treated alike; a null doc_id comes first. Blank lines stay.
    """
    rows, runs = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_rewrite(t, r) for t, r in zip(batch.column("text").to_pylist(), batch.column(runs).to_pylist(), strict=True)]
            texts, lines, removed = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_lines", "n_removed"])

    return rows.mapInArrow(run, "doc_id long, text string, n_lines long, n_removed long")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with their later repeated runs deleted, with all their columns;
    those of which nothing but blank lines stays are dropped. n_chars, where there
    is one and it is a whole number, is kept true."""
    marked, runs = _marked(docs)
    # Only changed documents go through Python.
    same, changed = marked.where(F.col(runs).isNull()).drop(runs), marked.where(F.col(runs).isNotNull())
    names = docs.columns
    counted = dict(docs.dtypes).get("n_chars") in ("int", "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate([*names, runs])}
            texts = [_rewrite(t, r)[0] for t, r in zip(columns["text"].to_pylist(), columns.pop(runs).to_pylist(), strict=True)]
            columns["text"] = pa.array(texts, columns["text"].type)
            if counted:
                columns["n_chars"] = pa.array([len(t) for t in texts], columns["n_chars"].type)
            rows = pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)
            yield rows.filter(pa.array([bool(t.strip()) for t in texts], pa.bool_()))

    return same.unionByName(changed.mapInArrow(run, docs.schema))

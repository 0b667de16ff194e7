"""Substring dedup: content-defined chunking with a gear rolling hash.

A text's bytes are cut where a gear hash of the last 16 bytes has four zero
bits, so an insertion moves only the cuts near it. From each chunk on, as many
chunks as hold MIN_WORDS words are a run; runs are deduplicated by a digest of
128 bits: the first occurrence, in the order of doc_id, stays. Later ones that
follow one another, and follow one another where they occur first, are one
span. So each span occurs as a whole in an earlier place; where a passage
comes together from several, its spans overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, row_key, text_mark, texts_of, unplaced
from .tokens import text_batches
from .words import data_of, spans

#: Bytes of a chunk at least and at most; a cut comes once in EVERY bytes on average (a power of two).
LEAST, MOST, EVERY, WINDOW = 24, 192, 16, 16
#: Words of a reported span at least: a repeated passage loses up to a chunk at either end.
MIN_WORDS = 16


def gear_table() -> np.ndarray:
    """256 numbers of 32 bits from a multiplicative rule."""
    h = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def gear_cuts(data: np.ndarray) -> np.ndarray:
    """Positions after which the gear hash of the last WINDOW bytes asks for a cut."""
    h, span = gear_table()[data], 1
    while span < WINDOW:
        more = h.copy()
        if len(h) > span:
            more[span:] += h[:-span] << np.uint32(span)
        h, span = more, 2 * span
    bits = EVERY.bit_length() - 1
    return np.flatnonzero((h >> np.uint32(WINDOW - bits)) & np.uint32(EVERY - 1) == 0)


def chunk_ends(cuts: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the text at start:end."""
    out, at = [], start
    for c in cuts[np.searchsorted(cuts, start) : np.searchsorted(cuts, end)].tolist():
        size = c + 1 - at
        if size >= LEAST:
            while size > MOST:
                at += MOST
                size -= MOST
                out.append(at)
            if size >= LEAST:
                at = c + 1
                out.append(at)
    while end - at > MOST:
        at += MOST
        out.append(at)
    if at < end:
        out.append(end)
    return out


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RUNS = "row long, doc_id long, mark string, k1 array<long>, k2 array<long>, starts array<int>, ends array<int>, before array<int>, after array<int>"
_ARROW = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.string()), *[(k, pa.list_(pa.int64())) for k in ("k1", "k2")],
    *[(k, pa.list_(pa.int32())) for k in ("starts", "ends", "before", "after")],
])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text, its runs: digests, first and last byte, words before them and before their ends."""
    from pyspark import TaskContext
    from xxhash import xxh3_128_digest

    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for rows, texts in text_batches(batch):
            data, offsets = data_of(texts)
            cuts, raw = gear_cuts(data), data.tobytes()
            heads = spans(~_BLANK[data], offsets)[0]
            begins: list[np.ndarray] = []
            ends: list[np.ndarray] = []
            lists = [0]
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                stops = np.array(chunk_ends(cuts, a, b), dtype=np.int64)
                starts = np.concatenate([[a], stops[:-1]]) if len(stops) else stops
                # the first chunk end by which MIN_WORDS words have begun since the start
                last = np.searchsorted(np.searchsorted(heads, stops), np.searchsorted(heads, starts) + MIN_WORDS)
                starts, last = starts[last < len(stops)], last[last < len(stops)]
                begins.append(starts)
                ends.append(stops[last])
                lists.append(lists[-1] + len(starts))
            start, end = np.concatenate(begins), np.concatenate(ends)
            digests = b"".join([xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
            keys = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
            own = np.repeat(offsets[:-1], np.diff(lists))
            words = np.searchsorted(heads, offsets[:-1])
            words = np.repeat(words, np.diff(lists))
            at, n = pa.array(lists, pa.int32()), len(texts)
            numbers = [start - own, end - own, np.searchsorted(heads, start) - words, np.searchsorted(heads, end) - words]
            yield pa.RecordBatch.from_arrays([
                pa.array(range(row, row + n), pa.int64()), rows.column("doc_id"), rows.column("mark").cast(pa.string()),
                *[pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(k))) for k in keys.T], *[pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in numbers],
            ], schema=_ARROW)
            row += n


_SPANS = "doc_id long, mark string, first_doc_id long, start_byte long, end_byte long, first_start_byte long, n_words long"


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for doc_id, mark, starts, ends, before, after, found in zip(f.doc_id, f.mark, f.starts, f.ends, f.before, f.after, f.found, strict=True):
            number = {s: i for i, s in enumerate(starts.tolist())}
            span: list | None = None
            for x in found:
                i = number[x["start"]]
                if span is not None and (i, x["first_own"], x["first_doc"], x["start"] - x["first_start"]) == (span[0] + 1, *span[1:4]):
                    span[0], span[5], span[7] = i, int(ends[i]), int(after[i])
                    continue
                if span is not None:
                    out.append((doc_id, mark, span[2], *span[4:]))
                span = [i, x["first_own"], x["first_doc"], x["start"] - x["first_start"], int(starts[i]), int(ends[i]), int(x["first_start"]), int(after[i]), int(before[i])]
            if span is not None:
                out.append((doc_id, mark, span[2], *span[4:]))
        frame = pd.DataFrame(out, columns=["doc_id", "mark", "first_doc_id", "start_byte", "end_byte", "first_start_byte", "after", "before"])
        frame = frame.assign(n_words=frame.after - frame.before).drop(columns=["after", "before"])
        yield frame.astype({"doc_id": "Int64", "first_doc_id": "Int64"})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """The later occurrences of repeated passages: doc_id, mark (of the text), first_doc_id,
    start_byte, end_byte, first_start_byte (in the texts' UTF-8), n_words.

    Null and empty texts have no chunks. Rows with a null doc_id come first. Rows of
    equal doc_id and text count as one document, whose spans each of them has.
    """
    runs = materialize(texts_of(docs, text_mark(F.col("text")).alias("mark")).mapInArrow(_runs, _RUNS), "runs")
    # The first 64 bits sort out most runs that occur once; after that all 128 count.
    counts = runs.select(F.explode("k1").alias("k1")).groupBy("k1").agg(F.count("*").alias("n"))
    repeated = counts.where("n > 1").select(unplaced(F.col("k1")).alias("k1"))
    # Rows of equal doc_id and text are one document: `own` is the same.
    each = runs.select("row", "doc_id", F.xxhash64("mark").alias("own"), F.explode(F.arrays_zip("k1", "k2", "starts")).alias("c"))
    each = each.select("row", "doc_id", "own", F.col("c.k1").alias("k1"), F.col("c.k2").alias("k2"), F.col("c.starts").alias("start"))
    shared = materialize(each.join(repeated, "k1"), "shared-runs")
    place = F.struct("doc_id", "own", "start")
    first = shared.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = shared.join(first.select(unplaced(F.col("k1")).alias("k1"), "k2", "first"), ["k1", "k2"]).where(place != F.col("first"))
    part = F.struct("start", F.col("first.start").alias("first_start"), F.col("first.own").alias("first_own"), F.col("first.doc_id").alias("first_doc"))
    found = later.groupBy("row").agg(F.sort_array(F.collect_list(part)).alias("found"))
    return runs.drop("k1", "k2").join(found, "row").mapInPandas(_merge, _SPANS)


def find_repeats(docs: DataFrame) -> DataFrame:
    """The spans of `repeated_spans`, without the mark."""
    return repeated_spans(docs).drop("mark")


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """A text without the given ranges of its UTF-8; a character that a range cuts stays."""
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in sorted(cuts):
        while a < len(data) and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
            b -= 1
        if b > at:
            out.append(data[at : max(a, at)])
            at = b
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the spans that `repeated_spans` finds, with all their columns;
    those of which nothing but white space stays are dropped. n_chars, where there
    is one and it is a whole number, is kept true."""
    found = materialize(repeated_spans(docs), "repeated-spans")
    keyed, names = row_key(docs)
    (cuts,) = fresh(keyed, "_cuts")
    key = [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.coalesce("mark", F.lit(""))]
    listed = found.groupBy(*[c.alias(n) for n, c in zip(names, key, strict=True)]).agg(F.collect_list(F.array("start_byte", "end_byte")).alias(cuts))
    listed = materialize(listed, "cuts")
    marked = keyed.join(listed.hint("merge"), names, "left").select(*docs.columns, cuts)
    counted, columns = dict(docs.dtypes).get("n_chars") in ("int", "bigint"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = {n: batch.column(i) for i, n in enumerate([*columns, cuts])}
            texts = [without(t, c) for t, c in zip(by["text"].to_pylist(), by.pop(cuts).to_pylist(), strict=True)]
            by["text"] = pa.array(texts, by["text"].type)
            if counted:
                by["n_chars"] = pa.array([len(t) for t in texts], by["n_chars"].type)
            yield pa.RecordBatch.from_arrays([by[n] for n in columns], names=columns).filter(pa.array([bool(t.strip()) for t in texts], pa.bool_()))

    same, changed = marked.where(F.col(cuts).isNull()).drop(cuts), marked.where(F.col(cuts).isNotNull())
    return same.unionByName(changed.mapInArrow(run, docs.schema))

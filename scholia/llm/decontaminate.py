"""Benchmark decontamination: winnowing.

A document word is hit where it lies in an occurrence of WINDOW consecutive
words of a benchmark item (all words, of a shorter item). Of the hashes of K
words in each run of WINDOW - K + 1, the least is kept as a fingerprint: equal
runs of WINDOW words keep the same one, so every shared window has a common
fingerprint. Fingerprints are joined, and hits extended word by word.

Documents' fingerprints pass a fixed-size bit table of the benchmark's before
they leave their task, with the WINDOW - K words around them, so what is
shuffled is about as much as there are hits, and no text is. The bit table is
a filter only: the join decides, whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, named_keys, row_key, sent, text_mark, texts_of
from .tokens import text_batches
from .words import data_of, gram_hashes, lower_table, span_hashes, spans, window_minima, word_table

WINDOW, K = 13, 8
#: Bits of the filter table, 2 ** this: 512 KB, whatever the benchmark.
FILTER_BITS = 22
CHARS = "0123456789abcdefghijklmnopqrstuvwxyz"
#: A document is contaminated if hit words are at least one in so many.
SHARE = 20
#: Fixed value: what a word is, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GRAM = "gram array<string>, before array<string>, after array<string>, size int, h long"
FOUND = f"row long, doc_id long, mark string, n_words long, hits array<struct<{_GRAM.replace(' ', ':').replace(',:', ',')},at:long>>"


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _scan(texts: pa.Array, sizes: list[int], table: np.ndarray | None, winnowed: bool):
    """Of each text, the number of words, and of all the fingerprints that the table
    lets pass: text, word position, gram size, hash, and words around it."""
    data, offsets = data_of(texts)
    data = lower_table()[data]
    starts, ends, counts = spans(word_table(CHARS)[data], offsets)
    words = span_hashes(data, starts, ends)
    raw, out = data.tobytes(), []
    owner = np.repeat(np.arange(len(texts)), np.diff(counts))
    for k in sizes:
        h = gram_hashes(words, k)
        same = owner[: len(h)] == owner[k - 1 :] if len(h) else np.zeros(0, bool)
        keep = same.copy()
        if k == K and winnowed:
            # a gram over a border is the largest, so it is a minimum only where it doesn't matter
            keep &= window_minima(np.where(same, h, np.uint64(2**64 - 1)), WINDOW - K + 1)
        if table is not None:
            keep &= table[_slot(h)]
        for i in np.flatnonzero(keep).tolist():
            t = owner[i]
            lo, hi = counts[t], counts[t + 1]
            around = WINDOW - k if k == K else 0
            word = lambda a, b: [raw[starts[j] : ends[j]].decode() for j in range(a, b)]
            out.append((int(t), i - int(lo), k, int(h[i].astype(np.int64)), word(i, i + k), word(max(lo, i - around), i), word(i + k, min(hi, i + k + around))))
    return np.diff(counts), out


def _benchmark_grams(sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_batches(batch):
                n_words, found = _scan(texts, sizes, None, False)
                ids = rows.column("item_id").to_pylist()
                # an item below WINDOW words is one window of its own size
                found = [f for f in found if (f[2] == K and n_words[f[0]] >= WINDOW) or (f[2] == n_words[f[0]] < WINDOW)]
                yield pa.RecordBatch.from_pylist([dict(zip(("gram", "before", "after", "size", "h", "item_id"), (w, b, a, -1 if n_words[t] < WINDOW else k, h, ids[t]), strict=True)) for t, _, k, h, w, b, a in found], schema=_ITEM_ARROW)

    return run


_S = pa.list_(pa.string())
_ITEM_ARROW = pa.schema([("gram", _S), ("before", _S), ("after", _S), ("size", pa.int32()), ("h", pa.int64()), ("item_id", pa.string())])
_HIT = pa.struct([("gram", _S), ("before", _S), ("after", _S), ("size", pa.int32()), ("h", pa.int64()), ("at", pa.int64())])
_DOC_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.string()), ("n_words", pa.int64()), ("hits", pa.list_(_HIT))])


def _document_grams(slots: dict[int, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        tables = {k: np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for k, b in slots.items()}
        for batch in batches:
            for rows, texts in text_batches(batch):
                hits: list[list[dict]] = [[] for _ in range(len(texts))]
                n_words = np.zeros(len(texts), np.int64)
                for size, table in tables.items():
                    n_words, found = _scan(texts, [abs(size) if size > 0 else -size], table, size == K)
                    for t, at, _, h, w, b, a in found:
                        hits[t].append({"gram": w, "before": b if size == K else [], "after": a if size == K else [], "size": K if size == K else -1, "h": h, "at": at})
                if not tables:
                    n_words, _ = _scan(texts, [], None, False)
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), rows.column("doc_id"), pc.cast(rows.column("mark"), pa.string()), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(_HIT))], schema=_DOC_ARROW)
                row += n

    return run


def _extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each pair of equal grams, the document words of the shared run around it, if
    that is long enough."""
    for f in frames:
        out = []
        for row, item, at, size, gram, igram, before, after, ibefore, iafter in zip(f.row, f.item_id, f["at"], f["size"], f.gram, f.item_gram, f.before, f.after, f.item_before, f.item_after, strict=True):
            if list(gram) != list(igram):
                continue
            if size < 0:
                out.append((row, item, at, at + len(gram)))
                continue
            left = right = 0
            for a, b in zip(reversed(before), reversed(ibefore), strict=False):
                if a != b:
                    break
                left += 1
            for a, b in zip(after, iafter, strict=False):
                if a != b:
                    break
                right += 1
            if left + len(gram) + right >= WINDOW:
                out.append((row, item, at - left, at + len(gram) + right))
        yield pd.DataFrame(out, columns=["row", "item_id", "lo", "hi"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, marked: bool = False) -> DataFrame:
    """A row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and wordless texts have no words, no hits, and aren't contaminated; an
    empty benchmark hits nothing; repeated rows are judged each; repeated item
    ids count once; items without an id have the id "". With `marked`, mark
    (of the text) is a further column.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    # word counts of the items below WINDOW words: at most WINDOW - 1 numbers
    words = F.size(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)))
    short = [r[0] for r in items.select(F.least(words, F.lit(WINDOW)).alias("n")).distinct().collect()]
    sizes = sorted({n for n in short if 0 < n < WINDOW} | {K})
    grams = materialize(items.mapInArrow(_benchmark_grams(sizes), f"{_GRAM}, item_id string").distinct(), "benchmark-grams")
    # The filter: the distinct slots, at most 2 ** FILTER_BITS of them.
    length = F.when(F.col("size") == K, F.lit(K)).otherwise(-F.size("gram"))
    bits: dict[int, np.ndarray] = {}
    for r in grams.select(length.alias("k"), F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("s")).distinct().toLocalIterator():
        bits.setdefault(r.k, np.zeros(1 << FILTER_BITS, bool))[r.s] = True
    slots = {k: np.packbits(b).tobytes() for k, b in bits.items()}
    found = materialize(texts_of(docs, (text_mark(F.col("text")) if marked else F.lit(None).cast("string")).alias("mark")).mapInArrow(_document_grams(slots), FOUND), "document-grams")
    hits = found.select("row", F.explode("hits").alias("x")).select("row", "x.*")
    other = grams.select("h", "size", "item_id", *[F.col(c).alias(f"item_{c}") for c in ("gram", "before", "after")])
    runs = hits.join(other, ["h", "size"]).mapInPandas(_extend, "row long, item_id string, lo long, hi long")
    # Words under the union of a row's runs: what each run adds beyond all before it.
    by_row = Window.partitionBy("row").orderBy("lo", "hi")
    reach = F.coalesce(F.max("hi").over(by_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    distinct = runs.groupBy("row", "lo", "hi").agg(F.collect_set("item_id").alias("items"))
    new = distinct.withColumn("new", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", reach)))
    summed = new.groupBy("row").agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    joined = found.select("row", "doc_id", "mark", "n_words").join(summed, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", *(["mark"] if marked else []), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns. Rows are told apart
    by doc_id and text; a null doc_id is one like any other. Texts are shuffled
    only where the keys of those that go are too many to be broadcast."""
    judged = materialize(find_contamination(docs, benchmark, marked=True).where("contaminated").select("doc_id", "mark"), "contaminated")
    keyed, names = row_key(docs)
    gone = named_keys(judged, names).select(*names)
    return keyed.join(sent(gone, 100), names, "left_anti").select(*docs.columns)

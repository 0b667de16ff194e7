"""Packing: cutting-stock column generation.

Documents are cut at every SEQUENCE tokens; what is left over is an item whose
length falls into one of LEVELS levels, rounded up. A linear program over
patterns (how many items of each level one sequence takes) is solved by column
generation: a knapsack dynamic program prices new patterns with the current
dual values. Pattern counts are rounded down, the rest is filled by
first-fit decreasing over the levels that are left, and the patterns' slots are
given to the documents of each level by rank.

The driver sees only the histogram of levels; the patterns are as many as the
levels, whatever the corpus' size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, texts_of
from .tokens import encoder, text_batches, vocabulary

SEQUENCE, END_ID = 2048, 1
#: Levels of item length that the linear program tells apart.
LEVELS = 256
#: Rows that one rank window within a level should hold at most.
RANKED = 20_000
SLOTS = {"_level": pa.int32(), "_from": pa.int64(), "_to": pa.int64(), "_each": pa.int32(), "_first": pa.int64(), "_before": pa.int32()}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for rows, texts in text_batches(batch):
                flat, ends = enc.encode(texts)
                raw = np.insert(flat, ends, np.uint32(end_id)).astype("<u4").tobytes()
                ends = (ends + np.arange(1, len(ends) + 1)).tolist()
                out, at = [], 0
                for doc_id, end in zip(rows.column("doc_id").to_pylist(), ends, strict=True):
                    for s in range(at, end, size):
                        e = min(end, s + size)
                        out.append((doc_id, s - at, e - s, zlib.crc32(raw[4 * s : 4 * e]), end - at))
                    at = end
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return run


def best_pattern(values: np.ndarray) -> np.ndarray:
    """Unbounded knapsack: the pattern of total level at most LEVELS with the highest
    value, where an item of level i + 1 has values[i]."""
    room = len(values)
    best, last = np.zeros(room + 1), np.zeros(room + 1, dtype=np.int64)
    for c in range(1, room + 1):
        options = best[c - 1 :: -1] + values[:c]
        last[c] = i = options.argmax()
        best[c] = options[i]
    pattern, c = np.zeros(room, dtype=np.int64), room
    while c > 0 and best[c] > 0:
        pattern[last[c]] += values[last[c]] > 0
        c -= last[c] + 1
    return pattern


def solve_patterns(demand: np.ndarray, gap: float = 5e-4, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns with their counts that take every item of the histogram `demand`
    (demand[i] items of level i + 1) exactly once.

    The linear program min sum(x), A x = demand is kept by its basis' inverse; it
    starts from patterns of a single level. It ends where the dual bound (the duals'
    value over that of the best pattern) is within one sequence or `gap` of the objective.
    """
    levels = np.flatnonzero(demand)
    m, size = len(levels), len(demand)
    if not m:
        return []
    d = demand[levels].astype(float)
    columns = [np.zeros(m, dtype=np.int64) for _ in range(m)]
    for j, i in enumerate(levels):
        columns[j][j] = min(size // (i + 1), demand[i])
    basis = np.array(columns, dtype=float).T
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ d
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        values = np.zeros(size)
        values[levels] = np.maximum(duals, 0)
        column = best_pattern(values)[levels]
        worth = duals @ column
        if worth <= 1 + 1e-7 or x.sum() - (values[levels] @ d) / worth <= max(1, gap * x.sum()):
            break
        move = inverse @ column
        up = np.flatnonzero(move > 1e-9)
        out = up[np.argmin(np.maximum(x[up], 0) / move[up])]
        x -= max(x[out], 0) / move[out] * move
        x[out] = max((inverse[out] / move[out]) @ d, 0)
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        columns[out] = column
    left, found = demand.copy(), []
    for column, n in sorted(zip(columns, np.floor(np.maximum(x, 0) + 1e-6).astype(np.int64), strict=True), key=lambda c: -c[1]):
        full = np.zeros(size, dtype=np.int64)
        full[levels] = column
        used = full > 0
        n = min(int(n), int((left[used] // full[used]).min())) if used.any() else 0
        if n:
            found.append((full, n))
            left -= n * full
    while left.any():  # first-fit decreasing, as many times over as the rest allows
        full, room = np.zeros(size, dtype=np.int64), size
        for i in np.flatnonzero(left)[::-1].tolist():
            full[i] = min(left[i], room // (i + 1))
            room -= full[i] * (i + 1)
        used = full > 0
        n = int((left[used] // full[used]).min())
        found.append((full, n))
        left -= n * full
    return found


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to size."""
    spark = pieces.sparkSession
    width = -(-size // LEVELS)
    level = F.least(F.ceil(F.col("length") / width), F.lit(LEVELS)).cast("int")
    items = pieces.withColumn("_level", level)
    counts = {r["_level"]: r["count"] for r in items.groupBy("_level").count().collect()}
    demand = np.array([counts.get(i + 1, 0) for i in range(LEVELS)], dtype=np.int64)
    salts = int(max(64, demand.max() // RANKED)) if len(demand) else 1
    slots, first_id, taken = [], 0, np.zeros(LEVELS, dtype=np.int64)
    for pattern, n in solve_patterns(demand):
        before = 0
        for i in np.flatnonzero(pattern)[::-1].tolist():
            slots.append((i + 1, int(taken[i]), int(taken[i] + n * pattern[i]), int(pattern[i]), first_id, before))
            taken[i] += n * pattern[i]
            before += int(pattern[i])
        first_id += n
    # As an Arrow table: rows of a list would be read by Python workers of their own, which stay.
    table = spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*slots) if slots else [()] * len(SLOTS), SLOTS.values(), strict=True)], names=list(SLOTS)))
    # Ranks within a level, by salt: a level may hold any share of the rows.
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    by_salt = Window.partitionBy("_level").orderBy("_salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = salted.groupBy("_level", "_salt").count().withColumn("_start", F.sum("count").over(by_salt) - F.col("count")).drop("count")
    within = Window.partitionBy("_level", "_salt").orderBy("doc_id", "start", "ids_crc32", "length")
    ranked = salted.join(sums, ["_level", "_salt"]).withColumn("_rank", F.col("_start") + F.row_number().over(within) - 1)
    # At most LEVELS * (2 * LEVELS) slots, whatever the corpus.
    table = F.broadcast(table.withColumnRenamed("_level", "_slot_level"))
    placed = ranked.join(table, (F.col("_level") == F.col("_slot_level")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    at = F.col("_rank") - F.col("_from")
    placed = placed.withColumn("sequence_id", (F.col("_first") + F.floor(at / F.col("_each"))).cast("long")).withColumn("_slot", F.col("_before") + at % F.col("_each"))
    row = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("offset", F.sum("length").over(row) - F.col("length"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of at most `size` tokens: a row a piece with
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; repeated rows are packed each; an
    empty table gives no rows. Other columns are not looked at.
    """
    pieces = texts_of(docs).mapInArrow(_pieces(tokenizer or vocabulary(), size, end_id), PIECES)
    return pack_pieces(materialize(pieces, "pieces"), size)

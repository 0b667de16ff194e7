"""A kept index of terms, true under changes, and ranked search over it.

The index is a store of four tables. `forward` holds each record's terms, by
record; a change reads there what it takes back. `inverted` holds postings by
term, as signed rows: a new version of a record adds its postings with +1 and
those of the version before with -1, so a change only appends. `terms` holds what
a change does to each term's number of records, and `totals` to the number of
records and terms. Sums over the signed rows are the index as it is now;
`compact` writes them as one row each.

Search reads the postings of the asked terms and deals them by blocks of records,
once: a record's postings are then in one task, which adds up its scores for all
questions and passes on its k best of each. `search` adds up all their postings; `pruned_search` first bounds what a block of records can reach from
the largest part that each term has in it, and adds up only blocks that may hold
one of the k best. Both give the same rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import tokens
from scholia.operators.retrieval import BOOST, DIGITS, LIST, asked_terms, boosted, kept, part, sent, top
from scholia.sources.store import Change, Staging, Store

FORWARD = "pos long, size long, terms array<struct<term:string,tf:long>>"
INVERTED = "term string, pos long, tf long, size long, sign int"
TERMS, TOTALS = "term string, df long", "part int, n long, size long"
#: Records of a block, by their pos.
BLOCK = 16
#: Terms of text in a task that adds up.
WIDE = 2_000_000
#: How much a bound may be above a score by rounding alone.
SLACK = 1e-9


def cut(records: DataFrame) -> DataFrame:
    """pos, size, terms of records (pos, text). A null text has none. Terms are counted where the
    text lies, so none is shuffled; only rows that share a pos are put together."""
    said = records.select(F.col("pos").cast("long").alias("pos"), F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("said"))
    return said.mapInArrow(_counted, FORWARD)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (pos, said): pos, size, terms, in the order of the terms' bytes."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
    for batch in batches:
        said = batch.column("said").to_pylist()
        # Terms are ASCII, so characters are ordered as bytes are.
        terms = [[{"term": t, "tf": n} for t, n in sorted(Counter(words).items())] for words in said]
        yield pa.RecordBatch.from_arrays([batch.column("pos"), pa.array([len(w) for w in said], pa.int64()), pa.array(terms, kind)], names=["pos", "size", "terms"])


def _merged(rows: DataFrame) -> DataFrame:
    """Rows of `cut` with equal pos as one."""
    listed = rows.select("pos", "size", F.explode_outer("terms").alias("t")).groupBy("pos", "t.term").agg(F.sum("t.tf").alias("tf"))
    held = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    return listed.groupBy("pos").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("size"), F.sort_array(F.collect_list(held)).alias("terms"))


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    listed = rows.select("pos", "size", F.explode("terms").alias("t"))
    return listed.select(F.col("t.term").alias("term"), "pos", F.col("t.tf").alias("tf"), "size", F.lit(sign).alias("sign"))


class Index:
    """The index in the folder `root`."""

    def __init__(self, store: Store):
        self.store = store

    def update(self, records: DataFrame, gone: DataFrame | None = None, applied: tuple[str, int] | None = None) -> int:
        """Put records (pos, text; a row each) in place of those with their pos, and drop those of
        `gone` (pos), in one step; the index's new version."""
        staging = Staging(self.store.spark)
        new = staging.put(cut(records), "new")
        if not new.groupBy("pos").count().where("count > 1").isEmpty():
            new = staging.put(_merged(new), "merged")
        ids = new.select("pos")
        ids = ids if gone is None else ids.unionByName(gone.select(F.col("pos").cast("long").alias("pos")))
        ids = ids.distinct()
        if "forward" in self.store.snapshot()["tables"]:
            old = staging.put(self.store.read("forward", FORWARD).join(ids, "pos", "left_semi").select(*new.columns), "old")
            # What didn't change isn't taken back and added again. A posting holds its record's size, so it stays only if that does.
            both = new.select("pos", "size", "terms").join(old.select("pos", F.col("size").alias("size_old"), F.col("terms").alias("terms_old")), "pos", "full")
            same = F.col("size") == F.col("size_old")
            none = F.array().cast("array<struct<term:string,tf:long>>")
            mine, before = F.coalesce("terms", none), F.coalesce("terms_old", none)
            moved = lambda a, b: F.when(same, F.array_except(a, b)).otherwise(a)
            gained, lost = both.select("pos", "size", moved(mine, before).alias("terms")), both.select("pos", F.col("size_old").alias("size"), moved(before, mine).alias("terms"))
            changes = _signed(gained, 1).unionByName(_signed(lost, -1))
            changes = staging.put(changes, "changes")
        else:
            old, changes = new.limit(0), _signed(new, 1)
        terms = changes.groupBy("term").agg(F.sum("sign").alias("df")).where("df <> 0")
        total = new.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).crossJoin(old.agg(F.count("*").alias("m"), F.coalesce(F.sum("size"), F.lit(0)).alias("less")))
        total = total.select(F.lit(0).alias("part"), (F.col("n") - F.col("m")).alias("n"), (F.col("size") - F.col("less")).alias("size"))
        version = self.store.commit(
            Change("forward", new, ids, key="pos"), Change("inverted", changes, append=True, key="term"), Change("terms", terms, append=True, key="term"), Change("totals", total, append=True, key="part"), applied=applied
        )
        staging.clear()
        return version

    def compact(self) -> int:
        """The same index, in which each posting is one row."""
        rows, terms, totals = self._sums(self.store.read("inverted", INVERTED)), self.store.read("terms", TERMS), self.totals()
        now = rows.select("term", "pos", "tf", "size", F.lit(1).alias("sign"))
        counts = terms.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        return self.store.commit(Change("inverted", now), Change("terms", counts), Change("totals", totals.select(F.lit(0).alias("part"), "n", "size")))

    @staticmethod
    def _sums(signed: DataFrame, *more: str) -> DataFrame:
        """term, pos, tf, size of the postings that stand. more: what goes with pos."""
        times = [F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("tf", "size")]
        return signed.groupBy(*more, "term", "pos").agg(*times, F.sum("sign").alias("sign")).where("sign > 0").drop("sign")

    def totals(self) -> DataFrame:
        """One row: n, size."""
        return self.store.read("totals", TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))

    def parts(self, questions: DataFrame) -> DataFrame:
        """term, pos, part, block of the postings of the questions' terms, dealt by block. The
        terms go to the postings if they take retrieval.SENT bytes at most."""
        wanted = asked_terms(questions).select("term").distinct()
        wanted = sent(wanted, F.octet_length("term"))
        asked = self.store.read("inverted", INVERTED).join(wanted, "term", "left_semi").withColumn("block", _block())
        listed = self._sums(asked.repartition(self._width(), "block"), "block")
        df = self.store.read("terms", TERMS).join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        df = sent(df, F.octet_length("term"))
        stats = self.totals().select("n", (F.col("size") / F.nullif("n", F.lit(0))).alias("mean"))
        return listed.join(df, "term").crossJoin(F.broadcast(stats)).select("term", "pos", part().alias("part"), "block")

    def _width(self) -> int:
        """Partitions for postings of the asked terms: a task has those of some WIDE terms of
        text, whose scores for all questions it holds at once."""
        return max(int(self.store.spark.conf.get("spark.sql.shuffle.partitions")), self.totals().first()["size"] // WIDE)

    def search(self, questions: DataFrame, k: int = LIST, whole: DataFrame | None = None) -> DataFrame:
        """query_id, pos, score, rank as retrieval.bm25 gives them. whole: the (query_id, pos) of
        records that hold the whole question; without it none is boosted."""
        scored = added_up(self.parts(questions).join(sent(asked_terms(questions), F.octet_length("term")), "term"))
        return best(scored, k, None if whole is None else kept(whole))


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK)


def added_up(parts: DataFrame) -> DataFrame:
    """query_id, pos, score of parts with query_id and times, dealt by block: no row leaves its task."""
    return parts.groupBy("block", "query_id", "pos").agg(F.sum(F.col("part") * F.col("times")).alias("score")).drop("block")


def best(scored: DataFrame, k: int, whole: DataFrame | None) -> DataFrame:
    """The k best of each question, records that hold the whole question raised."""
    return top((scored if whole is None else boosted(scored, sent(whole, F.lit(16)))).where("score > 0"), k)


class Pruned:
    """A search that skips blocks: `hits` (query_id, pos, score, rank), and `touched`
    (query_id, n_all, n_touched): postings of the question's terms, and those added up."""

    def __init__(self, index: Index, questions: DataFrame, k: int = LIST, whole: DataFrame | None = None):
        self.staging = staging = Staging(index.store.spark)
        terms = staging.put(asked_terms(questions), "terms")
        asked = sent(terms, F.octet_length("term"))
        # Held as they are dealt, by block, so that nothing below shuffles them again.
        parts = kept(index.parts(questions))
        whole = None if whole is None else staging.put(whole.select("query_id", "pos"), "whole")
        blocks = parts.groupBy("block", "term").agg(F.max("part").alias("most"), F.count("*").alias("n"))
        reached = blocks.join(asked, "term").groupBy("block", "query_id").agg(F.sum(F.col("most") * F.col("times")).alias("most"), F.sum("n").alias("n"))
        reach = staging.put(reached, "reach")
        # The k blocks that reach highest are added up first: the k-th best score there is the least that counts.
        first = staging.put(top(reach, k, F.round("most", DIGITS).desc(), F.col("block")).select("query_id", "block").join(asked, "query_id"), "first")
        kth = staging.put(top(added_up(parts.join(sent(first, F.octet_length("term")), ["term", "block"])), k).where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("least")), "kth")
        if whole is None:
            raised = reach.withColumn("boost", F.lit(1.0))
        else:
            with_whole = whole.select("query_id", _block().alias("block"), F.lit(BOOST).alias("boost")).distinct()
            raised = reach.join(sent(with_whole, F.lit(24)), ["query_id", "block"], "left")
        may = F.col("most") * F.coalesce("boost", F.lit(1.0)) >= F.coalesce("least", F.lit(0.0)) * (1 - SLACK)
        judged = staging.put(raised.join(sent(kth, F.lit(16)), "query_id", "left").select("query_id", "block", "n", may.alias("open")), "judged")
        self.touched = judged.groupBy("query_id").agg(F.sum("n").alias("n_all"), F.coalesce(F.sum(F.when(F.col("open"), F.col("n"))), F.lit(0)).alias("n_touched"))
        # A block's open questions are one row, which goes to its task.
        opened = judged.where("open").groupBy("block").agg(F.collect_list("query_id").alias("open"))
        listed = parts.join(opened.hint("shuffle_hash"), "block").join(asked, "term").where(F.array_contains("open", F.col("query_id")))
        self.hits = best(added_up(listed), k, whole)


def pruned_search(index: Index, questions: DataFrame, k: int = LIST, whole: DataFrame | None = None) -> Pruned:
    return Pruned(index, questions, k, whole)

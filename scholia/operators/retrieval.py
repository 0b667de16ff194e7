"""Retrieval for a table of questions at once: BM25, dense, phrase rescue, fusion,
reranking, filtering. Tables: records (pos, text, and for reranking source,
page_start, section_path, cleaning_flags), questions (query_id, query).

Ties go by pos, the order of insertion. Scores are compared rounded to DIGITS
digits, so that the order of summing doesn't decide.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import is_term, pieces, strip, tokens, word_count

K1, B, BOOST = 1.5, 0.75, 1.5
LIST, FUSED, RRF, EXACT = 25, 30, 60, 0.15
DIGITS = 9
#: Bytes of questions that go to every task at most.
SENT = 64 << 20
BAD_FLAGS = ["frontmatter-copyright-penalty", "journal-frontmatter-ad-penalty"]


def kept(df: DataFrame) -> DataFrame:
    """A small result that is needed several times: computed once, and again from its
    lineage where an executor is lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k best rows of each question, with their rank from 0. The row number itself
    is compared, so that each task passes on its own k best rows only."""
    by = Window.partitionBy("query_id").orderBy(*(order or (F.round("score", DIGITS).desc(), F.col("pos"))))
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def sent(questions: DataFrame, size: Column) -> DataFrame:
    """The questions, to be broadcast if their rows, of `size` bytes each, take SENT at
    most. Beyond, a cross join pairs partitions: a task has a block of either table."""
    whole = questions.agg(F.sum(size + 64).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(questions) if whole <= SENT else questions


def bm25(records: DataFrame, questions: DataFrame, k: int = LIST, whole: DataFrame | None = None) -> DataFrame:
    """query_id, pos, score, rank. A term said twice in a question counts twice.

    Texts are cut to terms once: what is kept of a record are its postings of the
    questions' terms, and its size. whole: the (query_id, pos) of records that hold
    the whole question, if they are known; else they are looked up.
    """
    terms = kept(asked_terms(questions))
    wanted = sent(terms.select("term").distinct(), F.octet_length("term")).withColumn("asked", F.lit(True))
    cut = records.select("pos", F.explode_outer(pieces(F.col("text"))).alias("term")).withColumn("real", F.coalesce(is_term(F.col("term")), F.lit(False)))
    # A row without a term is what a record has besides; one that has nothing else counts too.
    own = F.when(F.col("asked") & F.col("real"), F.col("term"))
    listed = kept(cut.join(wanted, "term", "left").groupBy("pos", own.alias("term")).agg(F.count_if("real").alias("tf")))
    sizes = listed.groupBy("pos").agg(F.sum("tf").alias("size"))
    stats = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    found = listed.where("term is not null")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weighted = found.join(sizes, "pos").join(df, "term").crossJoin(F.broadcast(stats)).select("term", "pos", part().alias("part"))
    scored = terms.join(weighted, "term").groupBy("query_id", "pos").agg(F.sum(F.col("part") * F.col("times")).alias("score"))
    whole = phrase(records, questions, loose=False) if whole is None else whole
    return top(boosted(scored, whole).where("score > 0"), k)


def asked_terms(questions: DataFrame) -> DataFrame:
    """query_id, term, times of the questions' terms."""
    return questions.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def part() -> Column:
    """What a term adds to a record's score, from n and mean (of all records), df, tf and size."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))


def boosted(scored: DataFrame, whole: DataFrame) -> DataFrame:
    """Scores, those of records that hold the whole question (query_id, pos) BOOST times as high."""
    rows = scored.join(whole.select("query_id", "pos", F.lit(BOOST).alias("boost")), ["query_id", "pos"], "left")
    return rows.select("query_id", "pos", (F.col("score") * F.coalesce("boost", F.lit(1.0))).alias("score"))


def blocks_of(rows: DataFrame, key: str, size: Column) -> list[DataFrame]:
    """The table in parts of about SENT bytes, its rows taking `size` each. A part at a time
    goes to the tasks, by way of the driver as with any broadcast."""
    whole = rows.agg(F.sum(size + 64).alias("bytes"), F.count("*").alias("n")).first()
    n = max(1, min(whole["n"], math.ceil((whole["bytes"] or 0) / max(SENT, 1))))
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


#: Questions and vectors whose products are in memory at once.
TILE = 1024


class Best:
    """The k best (score, pos) of each question so far; equal scores go by pos."""

    def __init__(self, questions: int, k: int):
        self.k, self.score, self.pos = k, np.full((questions, 0), 0.0), np.zeros((questions, 0), np.int64)

    def add(self, rows: slice, score: np.ndarray, pos: np.ndarray) -> None:
        """Scores of the questions `rows` with records at pos."""
        if self.score.shape[1] < self.k:
            more = self.k - self.score.shape[1]
            self.score = np.pad(self.score, ((0, 0), (0, more)), constant_values=-np.inf)
            self.pos = np.pad(self.pos, ((0, 0), (0, more)), constant_values=np.iinfo(np.int64).max)
        score = np.concatenate([self.score[rows], score], axis=1)
        pos = np.concatenate([self.pos[rows], np.broadcast_to(pos, (len(score), len(pos)))], axis=1)
        order = np.lexsort((pos, -np.round(score, DIGITS)), axis=1)[:, : self.k]
        self.score[rows], self.pos[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(pos, order, 1)


def _directions(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By size, which vectors have it and these scaled to length one; those without length are zero."""
    out, sizes = {}, np.array([-1 if v is None else len(v) for v in vectors])
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        m = np.array([vectors[i] for i in at], np.float64)
        n = np.sqrt((m * m).sum(1, keepdims=True))
        out[d] = at, m / np.where(n == 0, 1, n)
    return out


def _nearest(asked: Broadcast, k: int):
    """The k best of a task's vectors for each question, by products of blocks of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = asked.value
        sought, best = _directions(vectors), Best(len(ids), k)
        for batch in batches:
            for lo in range(0, len(batch), TILE):
                part = batch.slice(lo, TILE)
                held, pos = _directions(part.column("embedding").to_pylist()), part.column("pos").to_numpy(zero_copy_only=False)
                for a in range(0, len(ids), TILE):
                    score = np.zeros((len(ids[a : a + TILE]), len(part)))
                    for d in sought.keys() & held.keys():
                        at, q = sought[d]
                        mine = (at >= a) & (at < a + TILE)
                        score[np.ix_(at[mine] - a, held[d][0])] = q[mine] @ held[d][1].T
                    best.add(slice(a, a + len(score)), score, pos)
        found = np.isfinite(best.score)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.nonzero(found)[0])), pa.array(best.pos[found]), pa.array(best.score[found])], names=["query_id", "pos", "score"])

    return run


def dense(vectors: DataFrame, asked: DataFrame, k: int = LIST) -> DataFrame:
    """query_id, pos, score, rank by cosine; vectors (pos, embedding), asked (query_id,
    vector). Every vector is scored for every question; a vector of another size, a null
    one or one without length scores 0. Blocks of questions go to the tasks, which
    multiply them with blocks of vectors and pass on their k best."""
    spark, kinds = vectors.sparkSession, (dict(asked.dtypes)["query_id"], dict(vectors.dtypes)["pos"])
    held, found = vectors.select(F.col("pos").cast("long").alias("pos"), "embedding"), None
    for block in blocks_of(asked.select("query_id", "vector"), "query_id", 8 * F.greatest(F.size("vector"), F.lit(0))):
        rows = block.toArrow().combine_chunks()
        ids = rows.column("query_id").combine_chunks() if len(rows) else pa.array([], pa.int64())
        sent_block = spark.sparkContext.broadcast((ids, rows.column("vector").to_pylist()))
        best = held.mapInArrow(_nearest(sent_block, k), f"query_id {kinds[0]}, pos long, score double")
        found = best if found is None else found.unionByName(best)
    return top(found.withColumn("pos", F.col("pos").cast(kinds[1])), k)


_automata: dict[str, tuple] = {}


def _automaton(name: str, asked: list[tuple], loose: bool) -> tuple:
    """The words and questions as an automaton, and of each question how many of its words
    are enough; a worker makes it once. Each key says which questions it is, and in
    which it is a word how often."""
    import ahocorasick

    if name not in _automata:
        _automata.clear()
        found, said = ahocorasick.Automaton(), {}
        for i, (_, q, words) in enumerate(asked):
            if q:
                said.setdefault(q, ([], {}))[0].append(i)
            for w in words if loose else ():
                times = said.setdefault(w, ([], {}))[1]
                times[i] = times.get(i, 0) + 1
        for n, (key, (whole, times)) in enumerate(said.items()):
            found.add_word(key, (n, whole, list(times.items())))
        found.make_automaton()
        counts = [len(a[2]) if loose else 0 for a in asked]
        always = [i for i, a in enumerate(asked) if a[1] == "" or (loose and not a[2])]
        _automata[name] = found if said else None, counts, [math.ceil(0.6 * n) for n in counts], always
    return _automata[name]


def _matches(asked: Broadcast, loose: bool):
    """For each record, the questions that it holds as a whole, or enough words of: one
    pass over its text, and a count for each question that any of it belongs to. One
    text at a time is taken out of the Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, questions = asked.value
        found, counts, least, always = _automaton(name, questions, loose)
        for batch in batches:
            for lo in range(0, len(batch), TILE):
                part, out = batch.slice(lo, TILE), []
                for row, text in enumerate(t.as_py() for t in part.column("t")):
                    if text is None:
                        continue
                    hits: dict[int, int] = dict.fromkeys(always, 0)
                    whole = {i for i in always if questions[i][1] == ""}
                    for _, own, words in {v[0]: v for _, v in found.iter(text)}.values() if found else ():
                        whole.update(own)
                        for i, n in words:
                            hits[i] = hits.get(i, 0) + n
                    for i in whole | {i for i, n in hits.items() if loose and n >= least[i]}:
                        share = hits.get(i, 0) / counts[i] if counts[i] else None
                        out.append((i, row, 1.0 if i in whole else share, i in whole))
                q, rows, score, said = zip(*out, strict=True) if out else ((),) * 4
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q, pa.int64())), part.column("pos").take(pa.array(rows, pa.int64())), pa.array(score, pa.float64()), pa.array(said, pa.bool_())], names=["query_id", "pos", "score", "whole"])
            pa.default_memory_pool().release_unused()

    return run


def phrase(records: DataFrame, questions: DataFrame, loose: bool = True) -> DataFrame:
    """query_id, pos, score, whole: 1 for the whole question, else the share of its words
    over four characters if that is 0.6 or more. Without such words every record is
    kept, with a score that is not a number. Without `loose`, whole questions only.

    Questions go to the tasks in blocks of SENT bytes at most; of a task, each block
    takes one pass over its texts. A record costs what its text holds of questions.
    """
    low = F.lower("query")
    words = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 4)
    asked = questions.select("query_id", low.alias("q"), words.alias("words")).where("q is not null")
    spark, kinds = records.sparkSession, (dict(questions.dtypes)["query_id"], dict(records.dtypes)["pos"])
    texts, found = records.select("pos", F.lower("text").alias("t")), None
    for block in blocks_of(asked, "query_id", 4 * F.octet_length("q")):
        held = block.toArrow()
        ids = held.column("query_id")
        ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], ids.type)
        sent_block = spark.sparkContext.broadcast((uuid.uuid4().hex, ids, [tuple(r.values()) for r in held.to_pylist()]))
        rows = texts.mapInArrow(_matches(sent_block, loose), f"query_id {kinds[0]}, pos {kinds[1]}, score double, whole boolean")
        found = rows if found is None else found.union(rows)
    return found


def fuse(vector: DataFrame, lexical: DataFrame, exact: DataFrame, k: int = FUSED) -> DataFrame:
    """Reciprocal rank fusion: query_id, pos, score, rank and the lists' scores. A list
    that lacks a record counts it at its own length.

    The lists are rows of one table, put together by one aggregate. Records of the
    exact list alone score alike, so only the first k of them by pos can be among the
    best: no question has more than k and the lists' rows in a task, however long its
    exact list is. The other lists hold LIST records at most.
    """
    null = lambda kind: F.lit(None).cast(kind)
    rows = vector.select("query_id", "pos", F.col("rank").alias("v"), null("int").alias("b"), F.col("score").alias("vector_score"), null("double").alias("bm25_score"), F.lit(False).alias("e"))
    rows = rows.unionByName(lexical.select("query_id", "pos", null("int").alias("v"), F.col("rank").alias("b"), null("double").alias("vector_score"), F.col("score").alias("bm25_score"), F.lit(False).alias("e")))
    rows = rows.unionByName(exact.select("query_id", "pos", null("int").alias("v"), null("int").alias("b"), null("double").alias("vector_score"), null("double").alias("bm25_score"), F.lit(True).alias("e")))
    both = rows.groupBy("query_id", "pos").agg(F.max("v").alias("v"), F.max("b").alias("b"), F.max("vector_score").alias("vector_score"), F.max("bm25_score").alias("bm25_score"), F.max("e").alias("e"))
    alone = both.withColumn("alone", F.col("v").isNull() & F.col("b").isNull())
    by = Window.partitionBy("query_id", "alone").orderBy("pos")
    few = alone.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= 2 * LIST + k)
    own = Window.partitionBy("query_id")
    place = lambda rank: 1 / (RRF + F.coalesce(F.col(rank), F.coalesce(F.max(rank).over(own) + 1, F.lit(0))))
    score = place("v") + place("b") + F.when(F.col("e"), EXACT).otherwise(0.0)
    came = [F.coalesce("v", F.lit(1 << 30)), F.coalesce("b", F.lit(1 << 30)), F.col("pos")]
    scored = few.select("query_id", "pos", score.alias("score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), "v", "b")
    return top(scored, k, F.round("score", DIGITS).desc(), *came).drop("v", "b")


def reference_share(text: Column) -> Column:
    lines = F.split(strip(text), "\n")
    return F.size(F.filter(lines, lambda s: s.rlike(r"^\s*\d+\.\s+[A-Z]") | s.rlike(r"^\[\d+\]"))) / F.size(lines)


def rerank(fused: DataFrame, records: DataFrame, questions: DataFrame) -> DataFrame:
    """Adjusts fused scores by what the records look like; texts are joined here, for
    the few rows that are left."""
    rows = records.join(sent(fused.join(questions, "query_id"), F.octet_length("query") + 100), "pos")
    text, query = F.col("text"), F.col("query")
    asked = F.array_distinct(tokens(query))
    shared = F.size(F.array_intersect(asked, F.array_distinct(tokens(text)))) / F.greatest(F.size(asked), F.lit(1))
    n = F.length(text)
    is_true = lambda c, worth: F.when(c, worth).otherwise(0.0)
    bad = F.size(F.filter("cleaning_flags", lambda f: f.isin(BAD_FLAGS)))
    adjustment = (
        is_true(F.contains(F.lower(text), F.lower(query)), 0.2) + 0.15 * shared - 0.1 * bad + is_true((n > 500) & (n < 3500), 0.05) - is_true(n < 200, 0.1)
        + is_true(F.col("page_start") > 0, 0.03) + is_true(F.col("section_path").isNotNull(), 0.02) - is_true(reference_share(text) > 0.4, 0.3)
    )
    return rows.withColumn("rerank_score", adjustment).withColumn("score", F.col("score") + 0.5 * adjustment)


def is_enough() -> Column:
    """Whether a record may count as evidence."""
    n = F.length("text")
    return F.coalesce((F.col("source") != "") & (F.length(strip(F.col("text"))) >= 100) & (n / word_count(F.col("text")) <= 20), F.lit(False))


def best_evidence(rows: DataFrame, k: int) -> DataFrame:
    """The k best reranked rows of each question that are enough, with their rank from 0.

    The others come last and go after ranking: a filter before it would be pushed
    down to the records, and look at all texts.
    """
    rows = rows.withColumnRenamed("rank", "fused_rank").withColumn("_enough", is_enough())
    return top(rows, max(k, 0), F.col("_enough").desc(), F.round("score", DIGITS).desc(), F.col("fused_rank")).where("_enough").drop("_enough")


def lists(records: DataFrame, vectors: DataFrame, questions: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dense list, the lexical one and the exact one of each question. All records are
    searched, whether they have a vector or not."""
    exact = kept(phrase(records, questions))
    return kept(dense(vectors, asked)), kept(bm25(records, questions, whole=exact.where("whole"))), exact


def hybrid(records: DataFrame, vectors: DataFrame, questions: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """The k best records of each question, with all scores, texts and ranks from 0."""
    rows = rerank(fuse(*lists(records, vectors, questions, asked)), records, questions)
    return best_evidence(rows, k).withColumn("retrieval_method", F.lit("hybrid-rrf"))

"""PII: weak-supervision aggregation.

Patterns propose spans. Labelers vote on each: the pattern's own check, a
gazetteer, the words before, the characters around, the length. Expectation-
maximisation over the votes estimates how reliable each labeler is and how
likely each combination of votes is personal data; a logistic span classifier
is trained on that, which sees the votes and what the labelers don't look at,
the span's own shape. Spans that pass the patterns' checks always stay; those that
only the classifier believes in are added, as is the kind `secret`, which no
check is laid down for.

DataFrame functions only: the driver sees the histogram of combinations of votes
and shapes, which is at most len(KINDS) * 3 ** 5 * 4 * 3 * 3 rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = KINDS[:4]
#: The base patterns, with possessive repeats and starts at the heads of runs: what
#: they match is the same, and no text makes them backtrack or recurse.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)(?:token|secret|password|passwd|api[_-]?key)\x20{0,4}[=:]\x20{0,4}[\"'][^\"'\s]{8,200}[\"']",
}
#: A text without a match of these has no span of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": "[=:]\\x20{0,4}[\"']"}
BEFORE, AFTER = 48, 4
# Words and numbers that speak for a kind.
CONTEXT = {
    "email": "mail|contact|write|address", "ip": r"\bip\b|address|host|server|login", "card": "card|visa|pay|account|credit",
    "phone": "phone|call|tel|fax|mobile|contact", "secret": "token|secret|pass|key|auth",
}
TOP_DOMAINS = (
    "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|tv|eu|uk|de|fr|es|it|us|ca|mx|br|ar|cl|pt|nl|be|lu|ch|at|ie|dk|no|se|fi|is|"
    "pl|cz|sk|hu|ro|bg|gr|tr|ua|ru|il|ae|sa|za|eg|ng|ke|in|pk|cn|hk|tw|jp|kr|sg|my|th|id|ph|vn|au|nz"
)
COUNTRY_CODES = "1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
VOTERS = ["check", "gazetteer", "context", "border", "length"]
#: Of a span's shape: distinct characters by their share (0 to 3), letters (none, some, most), other signs than letters and digits (0, 1, more).
SHAPES = ["variety", "letters", "signs"]
NO, YES, ABSTAIN = 0, 1, 2


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _small(part: Column) -> Column:
    """Whether a string of digits is at most 255."""
    s = F.regexp_replace(part, "^0+", "")
    return (F.length(s) < 3) | ((F.length(s) == 3) & (s <= "255"))


def _check() -> Column:
    kind, m = F.col("kind"), F.col("match")
    d = _digits(m)
    n = F.length(d)
    return (
        F.when(kind == "ip", F.forall(F.split(m, r"\."), _small))
        .when(kind == "card", F.when((n >= 14) & (n <= 19), luhn(d)).otherwise(False))
        .when(kind == "phone", (n >= 10) & (n <= 15))
        .otherwise(True)
    )


def _votes() -> dict[str, Column]:
    kind, m = F.col("kind"), F.col("match")
    n = F.length(_digits(m))
    vote = lambda c: F.when(c, YES).otherwise(NO)
    gazetteer = (
        F.when(kind == "email", vote(m.rlike(rf"(?i)\.({TOP_DOMAINS})$")))
        .when(kind == "ip", vote(~m.rlike(r"^(0|127|2[4-9][0-9]|255)\.")))
        .when(kind == "card", vote(m.rlike("^[3-6]")))
        .when(kind == "phone", vote(m.rlike(rf"^\+({COUNTRY_CODES})")))
        .otherwise(vote(m.rlike("[\"'][A-Za-z0-9+/=_-]{16,}[\"']$")))
    )
    said = F.lower("before")
    context = F.lit(False)
    for k, words in CONTEXT.items():
        context = F.when(kind == k, said.rlike(words) | ((kind == "secret") & F.lower(m).rlike(words))).otherwise(context)
    length = (
        F.when(kind == "email", F.length(m).between(6, 64)).when(kind == "ip", F.length(m).between(7, 15)).when(kind == "card", n.isin(15, 16))
        .when(kind == "phone", n.between(10, 13)).otherwise(F.length(m) >= 24)
    )
    border = ~F.col("before").rlike(r"[A-Za-z0-9._%+-]$") & ~F.col("after").rlike(r"^[A-Za-z0-9]")
    return {"check": F.when(F.col("base"), YES).when(kind == "secret", ABSTAIN).otherwise(NO), "gazetteer": gazetteer, "context": F.when(context, YES).otherwise(ABSTAIN), "border": vote(border), "length": vote(length)}


def _shapes() -> dict[str, Column]:
    m = F.col("match")
    n = F.greatest(F.length(m), F.lit(1))
    letters, signs = F.length(F.regexp_replace(m, "[^A-Za-z]", "")), F.length(F.regexp_replace(m, "[A-Za-z0-9]", ""))
    variety = F.size(F.array_distinct(F.split(F.left(m, F.lit(64)), "")))
    return {
        "variety": F.least(F.floor(4 * variety / F.least(n, F.lit(64))), F.lit(3)), "letters": F.when(letters == 0, 0).when(2 * letters < n, 1).otherwise(2),
        "signs": F.least(signs, F.lit(2)),
    }


def _spans_of(kind: str, matches: Column, gaps: Column) -> Column:
    """The matches of a kind with what stands between them; null without any."""

    def span(i: Column) -> Column:
        gap = F.get(gaps, i)
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("nth"), F.length(gap).alias("gap"), F.right(gap, F.lit(BEFORE)).alias("before"),
            F.get(matches, i).alias("match"), F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("after"),
        )

    return F.when(F.size(matches) > 0, F.transform(F.sequence(F.lit(0), F.size(matches) - 1), span))


def candidates(docs: DataFrame) -> DataFrame:
    """A row a proposed span, and one with a null kind for a document without any: row,
    doc_id, kind, start, end, base, votes, shapes."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found, keep = {}, {}
    for k in KINDS:
        here = F.col("text").contains("@") if k == "email" else F.col("text").rlike(HINTS[k])
        keep[f"_m_{k}"] = F.when(here, F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)))
        keep[f"_g_{k}"] = F.when(here, F.split("text", PATTERNS[k], -1))
    cut = rows.select("row", "doc_id", *[c.alias(n) for n, c in keep.items()])
    for k in KINDS:
        found[k] = _spans_of(k, F.col(f"_m_{k}"), F.col(f"_g_{k}"))
    empty = F.array().cast("array<struct<kind:string,nth:int,gap:int,before:string,match:string,after:string>>")
    listed = cut.select("row", "doc_id", F.concat(*[F.coalesce(c, empty) for c in found.values()]).alias("spans"))
    spans = listed.select("row", "doc_id", F.explode_outer("spans").alias("s")).select("row", "doc_id", "s.*")
    so_far = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(so_far)).withColumn("start", F.col("end") - F.length("match"))
    checked = spans.withColumn("base", F.col("kind").isNotNull() & (F.col("kind") != "secret") & F.coalesce(_check(), F.lit(False)))
    return checked.select("row", "doc_id", "kind", "start", "end", "base", *[v.cast("int").alias(n) for n, v in (_votes() | _shapes()).items()])


def estimate(histogram: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation: labelers vote independently, given whether a span is
    personal data; each has its own rates of votes. The probability of each
    combination of kind and votes."""
    total = sum(n for *_, n in histogram)
    belief = {(k, v): (0.5 + sum(1 if x == YES else -1 for x in v if x != ABSTAIN) / (2.2 * len(v))) for k, v, _ in histogram}
    for _ in range(rounds if total else 0):
        prior = {k: [1.0, 1.0] for k in KINDS}
        rate = [[[1.0, 1.0, 1.0] for _ in VOTERS] for _ in (0, 1)]
        for k, v, n in histogram:
            for truth, p in ((1, belief[k, v]), (0, 1 - belief[k, v])):
                prior[k][truth] += n * p
                for j, x in enumerate(v):
                    rate[truth][j][x] += n * p
        for k, v, _ in histogram:
            odds = math.log(prior[k][1] / prior[k][0])
            for j, x in enumerate(v):
                odds += math.log(rate[1][j][x] / sum(rate[1][j])) - math.log(rate[0][j][x] / sum(rate[0][j]))
            belief[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def train(histogram: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], belief: dict, rounds: int = 300) -> dict[tuple[str, int], float]:
    """A logistic classifier of the kind, the votes and the shape, fitted to the beliefs
    that the votes give; its weights by (name, value)."""
    total = sum(n for *_, n in histogram) or 1
    weights: dict[tuple[str, int], float] = {}
    rows = [([("kind", KINDS.index(k)), *zip(VOTERS, v, strict=True), *zip(SHAPES, s, strict=True)], n / total, belief[k, v]) for k, v, s, n in histogram]
    for _ in range(rounds):
        step: dict[tuple[str, int], float] = {}
        for names, share, target in rows:
            p = 1 / (1 + math.exp(-sum(weights.get(x, 0.0) for x in names)))
            for x in names:
                step[x] = step.get(x, 0.0) + share * (target - p)
        for x, s in step.items():
            weights[x] = weights.get(x, 0.0) * 0.9999 + 2.0 * s
    return weights


def find_pii(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, n_email, n_ip, n_card, n_phone (of base spans),
    base_sha256, spans, n_added, n_secret (of those added), n_spans (of all).

    Null and empty texts have no spans; repeated rows are searched each.
    """
    found = materialize(candidates(docs), "pii-candidates")
    counted = found.where("kind is not null").groupBy("kind", *VOTERS, *SHAPES).count().collect()
    histogram = sorted((r["kind"], tuple(r[v] for v in VOTERS), tuple(r[v] for v in SHAPES), r["count"]) for r in counted)
    votes: dict[tuple[str, tuple[int, ...]], int] = {}
    for kind, cast, _, n in histogram:
        votes[kind, cast] = votes.get((kind, cast), 0) + n
    weights = train(histogram, estimate([(*k, n) for k, n in votes.items()]))
    score = F.lit(0.0)
    for (name, value), w in sorted(weights.items()):
        if name == "kind":
            score = score + F.when(F.col("kind") == KINDS[value], w).otherwise(0.0)
        else:
            score = score + F.when(F.col(name) == value, w).otherwise(0.0)
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    text = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    item = F.when(F.col("kind").isNotNull(), F.struct(F.col("start"), number.alias("kind"), F.col("end"), text.alias("text")))
    judged = found.withColumn("added", F.col("kind").isNotNull() & ~F.col("base") & (score >= 0))
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, item))), lambda x: x["text"]), ",")
    grouped = judged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE],
        listed(F.col("base")).alias("base_spans"), listed(F.col("base") | F.col("added")).alias("spans"), F.count_if("added").alias("n_added"), F.count_if(F.col("added") & (F.col("kind") == "secret")).alias("n_secret"),
        F.count_if(F.col("base") | F.col("added")).alias("n_spans"),
    )
    return grouped.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added", "n_secret", "n_spans")

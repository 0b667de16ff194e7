"""Sections, sentences and overlapping chunks with their pages.

A chunk is a run of whole sentences, so the packing is a fold over sentence
lengths that yields (first, last) pairs; texts are put together afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import HEAD, TAIL, fold, let, strip, trim

TARGET, LEAST, MOST, OVERLAP = 2400, 200, 4000, 300
#: Pages whose lengths are summed at once.
PAGES = 256
# What a heading looks like.
CAPITALS, NUMBERED, TITLE = r"^[A-Z][A-Z\s\-:]{4,}$", r"^\d+(\.\d+)?\s+[A-Z][a-zA-Z\s]{3,}$", r"^[A-Z][a-zA-Z\s\-:,]{4,}$"
AFFILIATION = rf"{HEAD}(PhD|MD|MPH|DPA|EdD|MS|MA|BA|University|College|Institute|Department){TAIL}"


def is_heading(line: Column) -> Column:
    def rule(s: Column) -> Column:
        title = s.rlike(TITLE) & ~s.endswith(".") & ~s.endswith(",") & (F.size(F.split(s, " ")) <= 8) & ~s.rlike(AFFILIATION)
        return F.length(s).between(3, 120) & (s.rlike(CAPITALS) | s.rlike(NUMBERED) | title)

    return let(trim(line), rule)


def sections(text: Column) -> Column:
    """Array of (heading, text). A heading that ends a section of more than 100
    characters is not part of any text; the first heading of a section names it."""

    def measured(line: Column) -> Column:
        """What the fold needs of a line, looked at once: its length, that without blank ones
        at the end, how many are at the start, and whether it is a heading."""
        n, bare = F.length(line), F.length(trim(line))
        left = F.when(F.left(line, F.lit(1)).rlike(r"\s"), n - F.length(F.regexp_replace(line, r"^\s+", ""))).otherwise(0)
        return F.struct(n.alias("n"), F.when(bare == 0, 0).otherwise(bare + left).alias("right"), left.alias("left"), is_heading(line).alias("heading"))

    def step(s: Column, line: Column) -> tuple[dict[str, Column], Column]:
        """size: characters of the section so far, joined and stripped; tail: blank ones after them."""
        n, right, left = line["n"], line["right"], line["left"]
        flush = (s["size"] > 100) & line["heading"]
        size = F.when(flush, 0).when(right == 0, s["size"]).when(s["size"] == 0, right - left).otherwise(s["size"] + s["tail"] + right)
        tail = F.when(flush | ((right == 0) & (s["size"] == 0)), 0).when(right == 0, s["tail"] + n).otherwise(n - right)
        return {"size": size, "tail": tail}, F.when(flush, "1").otherwise("0")

    def cut(lines: Column, about: Column) -> Column:
        def section(x: Column) -> Column:
            own, first = F.slice(lines, x["a"] + 2, x["b"] - x["a"] - 1), F.array_position(F.transform(F.slice(about, x["a"] + 2, x["b"] - x["a"] - 1), lambda m: m["heading"]), F.lit(True))
            heading = F.when(x["a"] >= 0, strip(F.get(lines, x["a"]))).when(first > 0, strip(F.get(own, (first - 1).cast("int"))))
            return F.struct(heading.alias("heading"), let(F.array_join(own, "\n"), trim).alias("text"))

        codes = fold(about, {"size": F.lit(0), "tail": F.lit(0)}, step)
        cuts = F.array_compact(F.transform(codes, lambda c, i: F.when(c == "1", i)))
        bounds = let(cuts, lambda c: F.arrays_zip(F.concat(F.array(F.lit(-1)), c).alias("a"), F.concat(c, F.array(F.size(lines))).alias("b")))
        return F.transform(bounds, section)

    cut_of = lambda lines: let(F.transform(lines, measured), lambda about: cut(lines, about))
    return F.filter(let(F.split(text, "\n"), cut_of), lambda s: F.length(s["text"]) > LEAST)


def sentences(text: Column) -> Column:
    # White space after a stop and before a capital; what comes before is looked at only where there is some.
    return F.filter(F.split(text, r"\s(?<=[.!?]\s)\s*(?=[A-Z])"), lambda s: s.rlike(r"\S"))


def packed(lengths: Column) -> Column:
    """Array of (first, last, overlap) sentence numbers from the sentences' lengths;
    overlap is the first sentence that isn't repeated from the chunk before."""
    none = F.array().cast("array<struct<first:int,last:int,overlap:int>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).alias("overlap"), F.lit(0).alias("size"), none.alias("done"))

    def back(i: Column) -> Column:
        """How many sentences before i make up the overlap, and their joined length."""
        # A sentence and the space after it have two characters at least.
        earlier = F.reverse(F.slice(lengths, F.greatest(i - OVERLAP // 2, F.lit(0)) + 1, F.greatest(F.least(i, F.lit(OVERLAP // 2)), F.lit(1))))
        return F.aggregate(
            earlier, F.struct(F.lit(0).alias("n"), F.lit(0).alias("size")),
            lambda a, x: F.when(a["size"] < OVERLAP, F.struct((a["n"] + 1).alias("n"), (a["size"] + x + 1).alias("size"))).otherwise(a),
        )

    def step(s: Column, x: Column) -> Column:
        flush = (s["size"] + x > TARGET) & (s["size"] > LEAST)
        started = lambda kept: F.struct(
            (s["i"] + 1).alias("i"), (s["i"] - kept["n"]).alias("first"), s["i"].alias("overlap"), (kept["size"] + x).alias("size"),
            F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (s["i"] - 1).alias("last"), s["overlap"].alias("overlap")))).alias("done"),
        )
        return F.when(flush, let(back(s["i"]), started)).otherwise(F.struct((s["i"] + 1).alias("i"), s["first"].alias("first"), s["overlap"].alias("overlap"), (s["size"] + x + F.when(s["size"] > 0, 1).otherwise(0)).alias("size"), s["done"].alias("done")))

    def finish(s: Column) -> Column:
        return F.when(s["size"] > LEAST, F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (s["i"] - 1).alias("last"), s["overlap"].alias("overlap"))))).otherwise(s["done"])

    return F.aggregate(lengths, start, step, finish)


def usable(text: Column) -> Column:
    numbered = F.regexp_count(text, F.lit(r"(?m)^\s*\d+\.\s+[A-Z]")) / F.size(F.split(text, "\n"))
    # Words are counted up to where they are enough.
    return (F.length(trim(text)) >= LEAST) & (F.size(F.split(text, r"\s+", 21)) >= 20) & (numbered <= 0.5)


def running_sums(sizes: Column) -> Column:
    """The sums of the first 1, 2, ... numbers. A fold copies what it has at each step, so it
    goes block by block."""
    total = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))
    fold = lambda xs: F.aggregate(xs, F.array().cast("array<long>"), lambda a, x: F.concat(a, F.array(total(a) + x)))
    last = F.greatest(F.ceil(F.size(sizes) / PAGES), F.lit(1)).cast("int") - 1
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: fold(F.slice(sizes, i * PAGES + 1, PAGES)))
    before = lambda p: F.concat(F.array(F.lit(0).cast("long")), fold(F.transform(p, total)))
    return let(parts, lambda p: let(before(p), lambda b: F.flatten(F.transform(p, lambda s, i: F.transform(s, lambda x: x + F.get(b, i))))))


def count_below(ends: Column, value: Column, same: bool) -> Column:
    """How many of the ascending numbers lie below a value, or with `same` at it too, by bisection."""
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(24, -1, -1)]), lambda s: s <= F.size(ends))
    below = lambda x: (x <= value) if same else (x < value)
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= F.size(ends)) & below(F.get(ends, n + s - 1)), n + s).otherwise(n))


def pages(start: Column, length: Column, ends: Column) -> Column:
    """(start, end) page of length characters from start, by the sums of the pages' lengths:
    the page that holds the start, and the first that the end lies in or at the end of."""
    n = F.size(ends)
    first, last = count_below(ends, start, True) + 1, count_below(ends, start + length, False) + 1
    return F.struct(F.when(first <= n, first).otherwise(1).alias("start"), F.when(last <= n, last).otherwise(F.greatest(n, F.lit(1))).alias("end"))


def chunk(df: DataFrame, key: str, text: str = "text", page_sizes: str | None = None) -> DataFrame:
    """A row a usable chunk: key, chunk_id, section_path, page_start, page_end, text.

    Chunks are numbered before unusable ones are dropped. A chunk's offset is that
    of its overlap in its section, or else that of the chunk before it.
    """
    sizes = F.col(page_sizes).cast("array<long>") if page_sizes else F.array().cast("array<long>")
    # The outer form: from the other, a filter on the sections is derived, for which the
    # steps that made the text would be written out again in one expression.
    split = df.select(key, running_sums(F.coalesce(sizes, F.array().cast("array<long>"))).alias("_ends"), F.posexplode_outer(sections(F.coalesce(text, F.lit("")))).alias("_section", "_s")).where("_s is not null")
    split = split.select(key, "_ends", "_section", F.col("_s.heading").alias("section_path"), F.col("_s.text").alias("_text"))
    split = split.withColumn("_sentences", F.when(F.length("_text") > MOST, sentences(F.col("_text"))))
    split = split.withColumn("_lengths", F.transform("_sentences", lambda s: F.length(s)))
    split = split.withColumn("_runs", F.when(F.col("_sentences").isNotNull(), packed(F.col("_lengths"))))
    joined = lambda r, a, b: F.array_join(F.slice("_sentences", a + 1, b - a + 1), " ")

    def one(r: Column) -> Column:
        repeat = F.when(r["overlap"] > r["first"], F.concat(joined(r, r["first"], r["overlap"] - 1), F.lit(" "))).otherwise("")
        # Where there is one page at most, nothing hangs on the place.
        at = F.when(F.size("_ends") > 1, let(repeat, lambda t: F.instr(F.col("_text"), t))).otherwise(1)
        return F.struct(joined(r, r["first"], r["last"]).alias("text"), at.alias("at"))

    whole = F.array(F.struct(F.col("_text").alias("text"), F.lit(1).alias("at")))
    made = split.withColumn("_chunks", F.when(F.col("_runs").isNull(), whole).otherwise(F.transform("_runs", one)))
    before = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))
    made = made.withColumn("_at", F.aggregate("_chunks", F.array().cast("array<long>"), lambda a, c: F.concat(a, F.array(F.when(c["at"] > 0, c["at"].cast("long") - 1).otherwise(before(a))))))
    placed = F.transform("_chunks", lambda c, i: F.struct(c["text"].alias("text"), pages(F.get("_at", i), F.length(c["text"]), F.col("_ends")).alias("pages")))
    # Pages are told here, so that a document's lengths aren't sent along with each chunk.
    flat = made.select(key, "_section", "section_path", F.posexplode_outer(placed).alias("_nth", "_c")).where("_c is not null")
    order = Window.partitionBy(key).orderBy("_section", "_nth")
    number = (F.row_number().over(order) - 1).cast("string")
    numbered = flat.withColumn("_number", number)
    rows = numbered.select(
        key, F.concat(F.col(key).cast("string"), F.lit("__chunk_"), F.when(F.length("_number") < 4, F.lpad("_number", 4, "0")).otherwise(F.col("_number"))).alias("chunk_id"),
        "section_path", F.col("_c.pages.start").cast("int").alias("page_start"), F.col("_c.pages.end").cast("int").alias("page_end"), trim(F.col("_c.text")).alias("text"),
    )
    return rows.where(usable(F.col("text")))

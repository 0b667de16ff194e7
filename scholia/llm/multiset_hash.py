"""Document fingerprints: a homomorphic multiset hash.

A text is the multiset of its paragraphs; a paragraph is cut after sentence
ends, so that a text of one paragraph has parts too. Each part is hashed to a
wide vector, and a text's fingerprint is the sum of the vectors, modulo powers
of two: the number of parts (2**32), WIDE lanes of uniform numbers (2**32) that
tell different multisets apart, and SIGNS lanes of single bits (2**16). Equal
multisets have equal fingerprints in whatever order; a part is added or taken
away by adding or subtracting its vector.

The difference of two fingerprints is the hash of what one text has and the
other lacks. With the bits read as signs, its lanes' mean square estimates how
many parts that is, whence the likeness.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import range_bounds, range_of, shuffle_width

WIDE, SIGNS = 16, 64
_LOW = (1 << 32) - 1
_FIRST_ID = -(1 << 63)


def parts_of(text: Column) -> Column:
    """A text's parts: cut at line ends and after sentence ends; blank ones don't count."""
    return F.filter(F.split(text, r"\n+|(?<=[.!?]) +"), lambda p: F.trim(p) != "")


def with_vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the vector of a text column: an array of 1 + WIDE + SIGNS / 2 longs; the
    last hold two sign lanes each, of 32 bits, not yet reduced."""
    keep = df.columns
    parts = df.withColumn("_parts", parts_of(F.col(text)))
    seeded = lambda seed: F.transform("_parts", lambda p: F.xxhash64(F.lit(seed), p))
    hashes = {f"_h{j}": seeded(j) for j in range(WIDE // 2)}
    hashed = parts.withColumns(hashes | {"_s": seeded(-1), "_n": F.size("_parts").cast("long")})
    zero = F.lit(0).cast("long")
    lanes = [F.col("_n")]
    for j in range(WIDE // 2):
        lanes.append(F.aggregate(f"_h{j}", zero, lambda a, h: a + h.bitwiseAND(F.lit(_LOW))))
        lanes.append(F.aggregate(f"_h{j}", zero, lambda a, h: a + F.shiftrightunsigned(h, 32)))
    both = F.lit(1 << 32 | 1)
    bits = lambda i: F.aggregate("_s", zero, lambda a, h: a + F.shiftrightunsigned(h, i).bitwiseAND(both))
    lanes += [bits(i) for i in range(SIGNS // 2)]
    return hashed.select(*keep, F.array(*lanes).alias(name))


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), digits, "0")


def as_text(vector: Column) -> Column:
    """The fingerprint in hexadecimal digits."""
    signs = F.slice(vector, 2 + WIDE, SIGNS // 2)
    head = F.transform(F.slice(vector, 1, 1 + WIDE), lambda x: _hex(x.bitwiseAND(F.lit(_LOW)), 8))
    tail = F.transform(signs, lambda x: F.concat(_hex(x.bitwiseAND(F.lit(0xFFFF)), 4), _hex(F.shiftrightunsigned(x, 32).bitwiseAND(F.lit(0xFFFF)), 4)))
    return F.concat(F.array_join(head, ""), F.array_join(tail, ""))


def _reduced(vector: Column) -> Column:
    """The lanes modulo their powers of two."""
    low = F.lit(_LOW)
    both = F.lit(0xFFFF << 32 | 0xFFFF)
    return F.concat(F.transform(F.slice(vector, 1, 1 + WIDE), lambda x: x.bitwiseAND(low)), F.transform(F.slice(vector, 2 + WIDE, SIGNS // 2), lambda x: x.bitwiseAND(both)))


def added(vector: Column, more: Column) -> Column:
    """The fingerprint of a text with the parts of another one put in, from their vectors."""
    return _reduced(F.zip_with(_reduced(vector), _reduced(more), lambda x, y: x + y))


def removed(vector: Column, less: Column) -> Column:
    """The fingerprint of a text without the parts of another one, all of which it has."""
    # A multiple of the modulus in every lane keeps the differences positive.
    spare = F.concat(F.array_repeat(F.lit(1 << 32), 1 + WIDE), F.array_repeat(F.lit(1 << 48 | 1 << 16), SIGNS // 2))
    raised = F.zip_with(_reduced(vector), spare, lambda x, y: x + y)
    return _reduced(F.zip_with(raised, _reduced(less), lambda x, y: x - y))


def likeness(a: Column, b: Column) -> Column:
    """One less the estimated share of parts that the two texts don't have in common."""
    more = F.get(a, F.lit(0)) - F.get(b, F.lit(0))

    def squares(x: Column, y: Column) -> Column:
        low = x.bitwiseAND(F.lit(_LOW)) - y.bitwiseAND(F.lit(_LOW))
        high = F.shiftrightunsigned(x, 32) - F.shiftrightunsigned(y, 32)
        return F.pow((2 * low - more).cast("double"), F.lit(2.0)) + F.pow((2 * high - more).cast("double"), F.lit(2.0))

    lanes = F.zip_with(F.slice(a, 2 + WIDE, SIGNS // 2), F.slice(b, 2 + WIDE, SIGNS // 2), squares)
    apart = F.aggregate(lanes, F.lit(0.0), lambda s, x: s + x) / SIGNS
    whole = F.get(a, F.lit(0)) + F.get(b, F.lit(0))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / F.greatest(whole, F.lit(1))))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The edited text's last half is
    replaced by the start of the next document, in descending order of doc_id.

    A null text is empty; an empty one has the zero vector. Rows with equal doc_id
    follow one another in the order of their texts; a null doc_id is last. A lone
    row is its own next. Texts are shuffled once, dealt by ranges of doc_id; the
    largest of each range also goes to the range above it, whose last row it follows.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID))
    bounds = range_bounds(docs.select(key.alias("key")), "key", 4 * shuffle_width(docs.sparkSession)) or [0]
    last = len(bounds) - 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_vector(rows, "text", "vector").withColumn("own", range_of(F.col("key"), bounds))
    top = F.get(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("own")) == F.col("key")
    above = F.when(F.col("own") == last, 0).otherwise(F.col("own") + 1)
    place = lambda group, guest: F.struct(group.cast("int").alias("range"), F.lit(guest).alias("guest"))
    rows = rows.withColumn("place", F.explode(F.when(top, F.array(place(F.col("own"), 0), place(above, 1))).otherwise(F.array(place(F.col("own"), 0)))))
    rows = rows.select("doc_id", "key", "text", "vector", "place.range", "place.guest")
    order = Window.partitionBy("range").orderBy("guest", F.col("key").desc(), "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_vector": F.lead("vector").over(order)}).where("guest = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "vector", "next_vector", F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    rows = with_vector(rows, "edited", "edited_vector")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("vector")).alias("fingerprint"), as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"), likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )

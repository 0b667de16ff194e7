"""Text functions that the operators share, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are not indexed.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from is are was were be been have has had do does did will would could "
    "should may might this that these those it its they them their we our you your not no"
).split()
#: ASCII word borders; Java's own \b knows Unicode letters.
HEAD, TAIL = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def has(text: Column, *said: str) -> Column:
    """Whether a text holds one of some plain strings: much cheaper than a pattern that needs it."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in said])


def trim(text: Column) -> Column:
    """strip, which looks at the ends first; for long texts."""
    # At the end a pattern also sees what is before a last line break, of which Java knows more than \s has.
    edge = lambda end, more: end(text, F.lit(1)).rlike(rf"[\s{more}]")
    return F.when(edge(F.left, "") | edge(F.right, r"\u0085\u2028\u2029"), strip(text)).otherwise(text)


def word_count(text: Column) -> Column:
    """Pieces between runs of white space, blank edges included."""
    return F.size(F.split(text, r"\s+"))


def pieces(text: Column) -> Column:
    """A text in lower case, cut at all that isn't part of a term."""
    return F.split(F.lower(text), "[^a-z0-9-]+")


def is_term(piece: Column) -> Column:
    """Terms have more than two characters and aren't stop words."""
    return (F.length(piece) > 2) & ~piece.isin(STOP_WORDS)


def tokens(text: Column) -> Column:
    """The terms of a text, in order."""
    return F.filter(pieces(text), is_term)


#: Elements that a fold works on at once.
BLOCK = 256


def fold(items: Column, start: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """An array of one-character codes, what `step` gives for each element from left to right.

    step gets the state, a struct, and an element, and gives the next state and the
    code. A fold's state is copied at each step, so it holds the codes of a block
    only; those of the blocks before are joined to them block by block.
    """
    whole = lambda s, codes: F.struct(*[c.alias(n) for n, c in s.items()], codes.alias("_codes"))
    fields = lambda s: {n: s[n] for n in start}

    def one(s: Column, x: Column) -> Column:
        state, code = step(s, x)
        return whole(state, F.concat(s["_codes"], code))

    def block(s: Column, part: Column) -> Column:
        return let(F.aggregate(part, whole(fields(s), F.lit("")), one), lambda r: whole(fields(r), F.concat(s["_codes"], r["_codes"])))

    def run(items: Column) -> Column:
        last = F.greatest(F.ceil(F.size(items) / BLOCK), F.lit(1)).cast("int") - 1
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * BLOCK + 1, BLOCK))
        return F.split(F.aggregate(parts, whole(start, F.lit("")), block, lambda s: s["_codes"]), "")

    return let(items, run)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f, or a function in it, uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))

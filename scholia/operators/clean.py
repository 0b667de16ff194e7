"""Cleanup of extracted text: an ordered list of steps, each a Column expression.

Steps that look from line to line are folds over the lines, whose state is a few
counters; what they keep is gathered in blocks, so time goes with the lines.
Patterns that need a plain string are tried only on texts that hold it, in
whatever case if they don't mind the case (`low`, the text in lower case).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import HEAD, TAIL, fold, has, let, strip, trim


def _word(pattern: str) -> str:
    """A whole word. What comes before it is looked at last, and not at each character of a text."""
    return rf"{pattern}(?<![0-9A-Za-z_]{pattern}){TAIL}"


# The patterns of the cleanup steps.
_PERIOD = "January|February|March|April|May|June|July|August|September|October|November|December|Spring|Summer|Fall|Winter"
_JOURNAL = "Journal of Emergency Management"
SUBSTITUTIONS = [
    (_word(r"Flz\.M"), "FRM"), (_word(r"Flz\.W"), "FRM"), (_word("constrnctions?"), "constructions"), ("(?i)" + _word("innrmation"), "information"),
    ("(?i)" + _word("infonnation"), "information"), ("(?i)" + _word("adequnte"), "adequate"), ("(?i)" + _word("managcment"), "management"),
]
#: What a text needs, in lower case, for which of them.
SUBSTITUTED = [("flz.", (0, 1)), ("constrnction", (2,)), ("innrmation", (3,)), ("infonnation", (4,)), ("adequnte", (5,)), ("managcment", (6,))]
HEADER = (
    rf"(?i){_JOURNAL}\s+Vol\.\s*\d+(?:,?\s*No\.\s*\d+)?(?:,?\s*(?:{_PERIOD})(?:/(?:{_PERIOD}))?\s+\d{{4}})?(?:\s+\d{{1,4}})?"
    r"(?:\s+Georgetown University Special Issue)?(?:\s+Special Issue on\s+[^.!?()\n]{0,80})?"
)
HEADER_BROKEN = rf"(?i){_JOURNAL}\s*\n\s*Vol\.[^,\n]{{0,40}}"
FRONTMATTER_GATE = r"ISSN \d{4}-\d{4}|Copyright.*\d{4}|All rights reserved"
#: All begin with a capital, which is looked for first.
FRONTMATTER = "(?=[A-Z])(?:%s)" % "|".join([
    r"ISSN \d{4}-\d{4}", r"Copyright.*\d{4}", "All rights reserved", "Published by", "Weston Medical Publishing", "Subscription", "E-mail:.*@", "Web site:.*www",
    "Postmaster:", "Disclaimer:", rf"^[A-Z][a-z]+,\s+(PhD|MD|MPH|EdD|DPA|JD|MS|MA|BA){TAIL}", rf"{HEAD}(Associate|Assistant|Adjunct)\s+(Professor|Director|Chair){TAIL}",
])
AD_GATE = r"US \$\d+|(?i:subscription)"
AD = "(?=[A-Za])(?:%s)" % "|".join([r"US \$\d+", r"Canada \$\d+", r"Foreign \$\d+", r"Individual:.*\$", r"Corporate:.*\$", "Student Rate", "Single issues", "Back issues", "(?i:annual subscription)"])
TOC_GATE = r"(?m)^\s*\d+\s*\.\s*[A-Z][^\n]{5,50}\s*\.{3,}\s*\d+\s*$"
REFERENCES = r"\n\s*(References?|Bibliography|REFERENCES?)\s*\n"


def _replace(text: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def _if(gate: Column, text: Column, *rules: tuple[str, str]) -> Column:
    return F.when(gate, _replace(text, *rules)).otherwise(text)


def normalize(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.replace(F.replace(text, F.lit("­"), F.lit("")), F.lit("�"), F.lit(" "))


def join_hyphens(text: Column) -> Column:
    return _if(has(text, "-") & text.rlike(r"-\s"), text, (r"([A-Za-z0-9_])-\s*\n\s*([a-z])", "$1$2"), (rf"({HEAD}[a-zA-Z]{{2,}}+)-\s{{1,3}}([a-z]{{3,}}){TAIL}", "$1$2"))


def drop_layout_lines(text: Column) -> Column:
    return _if(has(text, "_Layout", "_layout"), text, (r"(?m)^.*_Layout\s+\d[^\n]*$", ""), (r"(?m)^.*_layout\s+\d[^\n]*$", ""))


def drop_logos(text: Column) -> Column:
    return _if(text.rlike("[A-Z] [A-Z] [A-Z]"), text, (rf"[A-Z](?<![0-9A-Za-z_][A-Z]) ([A-Z] ){{1,5}}[A-Z]{TAIL}", ""))


def repair(text: Column) -> Column:
    # Each rule needs its own string, which no other rule makes.
    one = lambda low: lambda t, r: let(t, lambda v: _if(has(low, r[0]), v, r[1]))
    return let(F.lower(text), lambda low: F.when(has(low, *dict(SUBSTITUTED)), reduce(one(low), [(s, SUBSTITUTIONS[i]) for s, at in SUBSTITUTED for i in at], text)).otherwise(text))


def drop_headers(text: Column) -> Column:
    return _if(_names_journal(text), text, (rf"(?m)(^|\s)(?:JEM\s+)?\d{{1,4}}\s+(?={_JOURNAL})", "$1"), (HEADER, " "), (HEADER_BROKEN, " "))


def _names_journal(text: Column) -> Column:
    return has(F.lower(text), _JOURNAL.lower())


def has_headers(text: Column) -> Column:
    prefixless = _replace(text, (rf"(?m)(^|\s)(?:JEM\s+)?\d{{1,4}}\s+(?={_JOURNAL})", "$1"))
    return F.when(_names_journal(text), prefixless.rlike(HEADER) | prefixless.rlike(HEADER_BROKEN)).otherwise(False)


def drop_publisher_lines(text: Column) -> Column:
    return _if(has(F.lower(text), "doi:", "sa-weston", "jem"), text, (r"(?im)^DOI:[^\n]*$", ""), (r"(?im)^SA-Weston[^\n]*$", ""), (r"(?m)^JEM\s+\d+\s*$", ""))


def drop_page_numbers(text: Column) -> Column:
    return _replace(text, (r"(?m)^\s*\d{1,4}\s*$", ""))


def _kept(text: Column, look, start: dict[str, Column], step) -> Column:
    """The lines that step gives the code 1; it gets what `look` tells of a line, which is
    looked at once."""
    codes_of = lambda lines: fold(F.transform(lines, look), start, step)
    return let(F.split(text, "\n"), lambda lines: let(codes_of(lines), lambda codes: F.array_join(F.filter(lines, lambda _, i: F.get(codes, i) == "1"), "\n")))


def drop_frontmatter(text: Column) -> Column:
    """Drops frontmatter lines, and up to four blank lines after each; a fifth ends it."""

    def look(line: Column) -> Column:
        return F.struct(line.rlike(FRONTMATTER).alias("front"), (~line.rlike(r"\S")).alias("blank"))

    def step(s: Column, line: Column) -> tuple[dict[str, Column], Column]:
        front, blank = line["front"], line["blank"]
        run = s["inside"] & blank & ~front
        n = F.when(front | run, s["n"] + 1).otherwise(0)
        ended = run & (n > 3)
        return {"inside": front | (run & ~ended), "n": F.when(ended, 0).otherwise(n)}, F.when(front | run, "0").otherwise("1")

    return _kept(text, look, {"inside": F.lit(False), "n": F.lit(0)}, step)


def drop_ads(text: Column) -> Column:
    """Drops each line of prices and the two lines after it, whatever they hold."""

    def step(s: Column, ad: Column) -> tuple[dict[str, Column], Column]:
        skip = s["skip"] > 0
        return {"skip": F.when(skip, s["skip"] - 1).when(ad, 2).otherwise(0)}, F.when(skip | ad, "0").otherwise("1")

    return _kept(text, lambda line: line.rlike(AD), {"skip": F.lit(0)}, step)


def lists_contents(text: Column) -> Column:
    return has(text, "...") & text.rlike(TOC_GATE)


def drop_contents(text: Column) -> Column:
    return F.when(lists_contents(text), F.regexp_replace(text, r"(?m)^[^\n]{10,60}\.{4,}\s*\d+\s*$", "")).otherwise(text)


def cut_references(text: Column) -> Column:
    """Cuts at the first heading of references if that lies past the middle."""
    at = F.regexp_instr(text, F.lit(REFERENCES)) - 1
    named = has(text, "Reference", "REFERENCE", "Bibliography")
    return F.when(named & (at > 0.5 * F.length(text)), F.left(text, at)).otherwise(text)


def is_columnar(text: Column) -> Column:
    full = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")
    short = lambda f: F.size(F.filter(f, lambda s: F.length(s) < 40)) / F.greatest(F.size(f), F.lit(1))
    return F.when(mean_line(text) < 50, let(full, short) > 0.6).otherwise(False)


def mean_line(text: Column) -> Column:
    """The mean length of the lines: all characters but the line breaks."""
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (F.length(text) - breaks) / (breaks + 1)


def join_columns(text: Column) -> Column:
    """Joins a line to the one before it where it goes on in lower case or punctuation."""

    def step(s: Column, own: Column) -> tuple[dict[str, Column], Column]:
        """The code is what comes before the line."""
        return {"open": own != ""}, F.when(s["open"] & own.rlike("^[a-z,;:)]"), " ").otherwise("\n")

    def joined(lines: Column, codes: Column) -> Column:
        return F.array_join(F.transform(lines, lambda own, i: F.concat(F.when(i > 0, F.get(codes, i)).otherwise(""), own)), "")

    own = F.transform(F.split(text, "\n"), strip)
    return let(own, lambda lines: let(fold(lines, {"open": F.lit(False)}, step), lambda codes: joined(lines, codes)))


def drop_url_lines(text: Column) -> Column:
    return _if(has(text, "http", "www."), text, (r"(?m)^\s*https?://[^\s]+\s*$", ""), (r"(?m)^\s*www\.[^\s]{5,}\s*$", ""))


def squeeze(text: Column) -> Column:
    single = let(_if(has(text, "\n\n\n"), text, (r"\n{3,}", "\n\n")), lambda t: _if(has(t, "  ", "\t"), t, (r"[ \t]{2,}", " ")))
    return let(single, trim)


def _shorter(before: Column, after: Column) -> Column:
    return F.length(before) != F.length(after)


def _differs(before: Column, after: Column) -> Column:
    return before != after


#: The steps: name, function, gate, flag, and when the flag is set (None: whenever the gate holds).
STEPS = [
    ("normalized", normalize, None, None, None),
    ("dehyphenated", join_hyphens, None, "fixed-hyphenation", _shorter),
    ("unlaid", drop_layout_lines, None, "removed-layout-annotations", _shorter),
    ("unbranded", drop_logos, None, "removed-logo-artifacts", _differs),
    ("repaired", repair, None, "repaired-ocr-substitutions", _differs),
    ("headless", drop_headers, None, "removed-journal-headers", "headers"),
    ("unpublished", drop_publisher_lines, None, None, None),
    ("unpaged", drop_page_numbers, None, "removed-page-numbers", _differs),
    ("unfronted", drop_frontmatter, lambda t: has(t, "ISSN ", "Copyright", "All rights reserved") & t.rlike(FRONTMATTER_GATE), "removed-frontmatter", None),
    ("unsold", drop_ads, lambda t: (has(t, "US $") | has(F.lower(t), "subscription")) & t.rlike(AD_GATE), "removed-ads", None),
    ("unlisted", drop_contents, lists_contents, "removed-toc", None),
    ("unreferenced", cut_references, None, "removed-references", _differs),
    ("joined", join_columns, is_columnar, "column-join-attempted", None),
    ("unlinked", drop_url_lines, None, "removed-bare-url-lines", _differs),
    ("cleaned_text", squeeze, None, None, None),
]
FOLDS = ("unfronted", "unsold", "joined")


def clean(df: DataFrame, text: str = "text", skip: tuple[str, ...] = ()) -> DataFrame:
    """Adds cleaned_text, cleaning_flags and quality_notes. Each step is a column of its
    own until the end, so that a text is worked on once a step; the columns' names
    are ones that the table doesn't have."""
    columns, now = df.columns, F.coalesce(text, F.lit(""))
    taken = {c.lower() for c in columns}
    stem = next(s for s in ("_" * i for i in range(1, len(columns) + 2)) if not any(c.startswith(f"{s}step") for c in taken))
    flags: list[Column] = []
    for i, (name, step, gate, flag, shown) in enumerate(STEPS):
        if name in skip:
            continue
        column = f"{stem}step{i}"
        opened = gate(now) if gate is not None else None
        out = step(now) if opened is None else F.when(opened, step(now)).otherwise(now)
        if shown == "headers":
            mark = has_headers(now)
        else:
            mark = opened if shown is None else shown(now, F.col(column))
        df = df.withColumn(column, out)
        if flag is not None:
            df = df.withColumn(f"{column}_flag", mark)
            flags.append(F.when(F.col(f"{column}_flag"), flag))
        now = F.col(column)
    mean = mean_line(now)
    # Words are counted up to where they are enough.
    notes = F.array_compact(F.array(F.when(F.size(F.split(now, r"\s+", 51)) < 50, "very-short-document"), F.when(mean < 20, "short-avg-line-length-possible-column-artifact")))
    added = {"cleaned_text": now, "cleaning_flags": F.array_compact(F.array(*flags)), "quality_notes": notes}
    return df.select(*[c for c in columns if c not in added], *[c.alias(n) for n, c in added.items()])

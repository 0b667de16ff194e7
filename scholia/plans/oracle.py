"""DuckDB SQL with the results of the registered queries, from shared pieces."""

from __future__ import annotations

# Fixed values, as the survey states them: words that are not indexed, what an artifact scan counts, topics, and what cleanup looks for.
_STOP_WORDS = (
    "the a an and or but in on at to for of with by from is are was were be been have has had do does did will would could "
    "should may might this that these those it its they them their we our you your not no"
).split()
_ARTIFACTS = {
    "hyphen_trailing_space": r"\b[a-zA-Z]{2,}-\s{1,3}[a-z]{3,}\b", "hyphen_newline": r"\w-\s*\n\s*[a-z]", "layout_annotation": r"\S+_[Ll]ayout\s+\d[^\n]*",
    "spaced_logo_letters": r"\b([A-Z] ){2,6}[A-Z]\b", "ocr_substitution_FRM": r"Flz\.[MW]", "ocr_constrnction": "(?i)constrnction",
    "journal_header_inline": r"(?i)Journal of Emergency Management\s+Vol\.\s*\d+", "journal_header_newline": r"(?i)Journal of Emergency Management\s*\n\s*Vol\.",
    "issn_line": r"ISSN \d{4}-\d{4}", "copyright_line": r"Copyright.*\d{4}", "bare_url_line": r"(?m)^\s*https?://[^\s]+\s*$", "www_url_line": r"(?m)^\s*www\.[^\s]{5,}\s*$",
    "standalone_page_number": r"(?m)^\s*\d{1,4}\s*$", "subscription_price": r"US \$\d+|Canada \$\d+", "doi_line": r"(?m)^DOI:[^\n]*", "jem_junk_number": r"(?m)^JEM\s+\d+\s*$",
}
_TOPICS = [
    ("flood-hazard", "flood|inundation|surge|hurricane|storm"), ("emergency-management", "evacuation|shelter|emergency|preparedness"),
    ("risk-assessment", "risk|vulnerability|exposure"), ("climate", "climate|sea level|temperature|precipitation"), ("infrastructure", "building|structure|infrastructure"),
]
_SEASONS = "January|February|March|April|May|June|July|August|September|October|November|December|Spring|Summer|Fall|Winter"
_HEADER = (
    rf"(?i)Journal of Emergency Management\s+Vol\.\s*\d+(?:,?\s*No\.\s*\d+)?(?:,?\s*(?:{_SEASONS})(?:/(?:{_SEASONS}))?\s+\d{{4}})?(?:\s+\d{{1,4}})?"
    r"(?:\s+Georgetown University Special Issue)?(?:\s+Special Issue on\s+[^.!?()\n]{0,80})?"
)
_HEADER_BROKEN = r"(?i)Journal of Emergency Management\s*\n\s*Vol\.[^,\n]{0,40}"
_FRONT_GATE = r"ISSN \d{4}-\d{4}|Copyright.*\d{4}|All rights reserved"
_FRONT = "|".join([
    r"ISSN \d{4}-\d{4}", r"Copyright.*\d{4}", "All rights reserved", "Published by", "Weston Medical Publishing", "Subscription", "E-mail:.*@", "Web site:.*www", "Postmaster:", "Disclaimer:",
    r"^[A-Z][a-z]+,\s+(PhD|MD|MPH|EdD|DPA|JD|MS|MA|BA)\b", r"\b(Associate|Assistant|Adjunct)\s+(Professor|Director|Chair)\b",
])
_AD_GATE = r"US \$\d+|(?i:subscription)"
_AD = r"US \$\d+|Canada \$\d+|Foreign \$\d+|Individual:.*\$|Corporate:.*\$|Student Rate|Single issues|Back issues|(?i:annual subscription)"
_TOC = r"(?m)^\s*\d+\s*\.\s*[A-Z][^\n]{5,50}\s*\.{3,}\s*\d+\s*$"
_REFERENCES = r"\n\s*(References?|Bibliography|REFERENCES?)\s*\n"

_STOP = ", ".join(f"'{w}'" for w in _STOP_WORDS)


def _tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda t: length(t) > 2 AND t NOT IN ({_STOP}))"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _re2(pattern: str) -> str:
    """RE2 has no lookaround; its own word border is that of ASCII."""
    for look in (r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"):
        pattern = pattern.replace(look, r"\b")
    return pattern.replace("'", "''")


def _gsub(text: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({text}, '{_re2(pattern)}', '{to}', '{flags}')"


#: Raw text as an extractor might leave it: every kind of noise in some documents.
NOISE = [
    (3, 0, "head", "J E M Vol\n"), (4, 1, "head", "ISSN 1234-5678\nCopyright 2020 Someone\n\nPublished by Them\n\n"), (5, 2, "tail", "\n12\n\nwell-\nbeing and eco- nomics\n"),
    (3, 1, "tail", "\nUS $10\nCanada $12\nrest of the price list\nkept line\n"), (4, 2, "tail", "\nhttps://x.example.org/a\nwww.example.org\nJEM 12\nDOI: 10.1/2\n"),
    (5, 0, "tail", " Flz.M and Flz.W, constrnctions, innrmation  or adequnte\n\n\n\nplan_Layout 1 x\nnext"), (7, 3, "tail", " 14 Journal of Emergency Management Vol. 3, No. 2, Spring 2005 and on"),
    (6, 1, "tail", "\nReferences\n1. Someone. A title.\n"), (11, 4, "tail", "\n1. Beginnings and ends .... 12\nContents of the volume ..... 7\n"),
]


def noised(text: str = "text", key: str = "doc_id", concat: str = "concat", char: str = "chr(10)") -> str:
    """SQL, of Spark and DuckDB alike, for the noised text."""
    def piece(every: int, rest: int, said: str) -> str:
        parts = said.split("\n")
        body = f", {char}, ".join(f"'{p}'" for p in parts)
        return f"CASE WHEN {key} % {every} = {rest} THEN {concat}({body}) ELSE '' END"

    heads = [piece(e, r, s) for e, r, at, s in NOISE if at == "head"]
    tails = [piece(e, r, s) for e, r, at, s in NOISE if at == "tail"]
    return f"{concat}({', '.join([*heads, text, *tails])})"


RECORDS = "records AS (SELECT doc_id AS pos, text, source FROM documents), vectors AS (SELECT vec_id AS pos, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))"
QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
BM25 = rf"""
cut AS (SELECT pos, text, {_tokens('text')} AS t FROM {{records}}),
stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM cut),
terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_tokens('query')}) AS term FROM questions) GROUP BY ALL),
found AS (SELECT pos, size, term, count(*) AS tf FROM (SELECT pos, len(t) AS size, unnest(t) AS term FROM cut) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM found GROUP BY ALL),
scored AS (SELECT query_id, pos, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * size / mean))) AS score
  FROM terms JOIN found USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY ALL),
boosted AS (SELECT query_id, pos, score * CASE WHEN contains(lower(c.text), lower(q.query)) THEN 1.5 ELSE 1 END AS score FROM scored JOIN questions q USING (query_id) JOIN cut c USING (pos)),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) - 1 AS rank FROM boosted WHERE score > 0 QUALIFY rank < 25)"""
DENSE = """
asked AS (SELECT q.query_id, e.embedding AS vector FROM questions q JOIN embeddings e ON e.vec_id = q.query_id),
cosines AS (SELECT query_id, v.{pos} AS pos, coalesce(list_cosine_similarity(vector::DOUBLE[], embedding::DOUBLE[]), 0) AS score FROM {vectors} v CROSS JOIN asked),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) - 1 AS rank FROM cosines QUALIFY rank < 25)"""
PHRASE = r"""
words AS (SELECT query_id, lower(query) AS q, list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: length(w) > 4) AS words FROM questions),
pairs AS (SELECT query_id, pos, contains(lower(text), q) AS whole, len(words) AS n, len(list_filter(words, lambda w: contains(lower(text), w))) AS hits FROM {records} CROSS JOIN words),
exact AS (SELECT query_id, pos, CASE WHEN whole THEN 1.0 ELSE hits / n END AS score FROM pairs WHERE whole OR hits >= ceil(0.6 * n))"""
FUSE = """
sizes AS (SELECT query_id, coalesce(nv, 0) AS nv, coalesce(nb, 0) AS nb FROM (SELECT query_id, count(*) AS nv FROM dense GROUP BY ALL) FULL JOIN (SELECT query_id, count(*) AS nb FROM lexical GROUP BY ALL) USING (query_id)),
ids AS (SELECT query_id, pos FROM dense UNION SELECT query_id, pos FROM lexical UNION SELECT query_id, pos FROM exact),
placed AS (SELECT query_id, pos, v.rank AS v, b.rank AS b, 1 / (60 + coalesce(v.rank, nv, 0)) + 1 / (60 + coalesce(b.rank, nb, 0)) + CASE WHEN e.pos IS NULL THEN 0 ELSE 0.15 END AS score
  FROM ids LEFT JOIN dense v USING (query_id, pos) LEFT JOIN lexical b USING (query_id, pos) LEFT JOIN exact e USING (query_id, pos) LEFT JOIN sizes USING (query_id)),
fused AS (SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, coalesce(v, 1 << 30), coalesce(b, 1 << 30), pos) - 1 AS rank FROM placed QUALIFY rank < 30)"""
RERANK = rf"""
looked AS (SELECT f.*, q.query, r.text, r.source, list_distinct({_tokens('q.query')}) AS asked_t, list_distinct({_tokens('r.text')}) AS own_t,
  regexp_split_to_array({_strip('r.text')}, '\n') AS lines FROM fused f JOIN questions q USING (query_id) JOIN records r USING (pos)),
adjusted AS (SELECT *, CASE WHEN contains(lower(text), lower(query)) THEN 0.2 ELSE 0 END + 0.15 * len(list_intersect(asked_t, own_t)) / greatest(len(asked_t), 1)
  + CASE WHEN length(text) > 500 AND length(text) < 3500 THEN 0.05 ELSE 0 END - CASE WHEN length(text) < 200 THEN 0.1 ELSE 0 END + 0.03
  - CASE WHEN len(list_filter(lines, lambda s: regexp_matches(s, '^\s*\d+\.\s+[A-Z]') OR regexp_matches(s, '^\[\d+\]'))) / len(lines) > 0.4 THEN 0.3 ELSE 0 END AS adjustment FROM looked),
hits AS (SELECT query_id, pos, text, source, score + 0.5 * adjustment AS final, row_number() OVER (PARTITION BY query_id ORDER BY round(score + 0.5 * adjustment, 9) DESC, rank) - 1 AS place
  FROM adjusted WHERE source <> '' AND length({_strip('text')}) >= 100 AND length(text) / len(regexp_split_to_array(text, '\s+')) <= 20 QUALIFY place < 5)"""
HYBRID = "WITH " + ",".join([RECORDS, QUESTIONS, BM25.format(records="records"), DENSE.format(vectors="vectors", pos="pos"), PHRASE.format(records="records"), FUSE, RERANK])
DOCS = "docs AS (SELECT doc_id AS pos, text FROM documents)"
# The documents after changes: those of low quality twice over, toxic ones deleted.
FINAL = """docs AS (SELECT doc_id AS pos, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN concat(text, ' ', text) ELSE text END AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""
SUPPORT = "CASE WHEN final > 0.025 THEN 'direct' WHEN final > 0.015 THEN 'partial' ELSE 'weak' END"

def _changed(new: str, rule: str) -> str:
    return {"shorter": f"length({new}) <> length(t)", "differs": f"{new} <> t"}[rule]


def _rewrites(*rules: tuple[str, str]) -> str:
    out = "t"
    for pattern, to in rules:
        out = _gsub(out, pattern, to)
    return out


def _columns_sql() -> str:
    """Lines joined to the one before where they go on."""
    lines = "string_split(t, chr(10))"
    first = "{'s': '', 'held': '', 'done': []::VARCHAR[]}"
    items = f"list_prepend({first}, list_transform({lines}, lambda l: {{'s': {_strip('l')}, 'held': '', 'done': []::VARCHAR[]}}))"
    flushed = "CASE WHEN a.held <> '' THEN list_append(a.done, a.held) ELSE a.done END"
    goes_on = "a.held <> '' AND regexp_matches(x.s, '^[a-z,;:)]')"
    step = (
        f"{{'s': '', 'held': CASE WHEN x.s = '' THEN '' WHEN {goes_on} THEN concat(a.held, ' ', x.s) ELSE x.s END, "
        f"'done': CASE WHEN x.s = '' THEN list_append({flushed}, '') WHEN {goes_on} THEN a.done ELSE {flushed} END}}"
    )
    return f"(SELECT array_to_string(CASE WHEN r.held <> '' THEN list_append(r.done, r.held) ELSE r.done END, chr(10)) FROM (SELECT list_reduce({items}, lambda a, x: {step}) AS r))"


def _dropped_lines(kind: str) -> str:
    """The lines that stay, by a fold over them: of frontmatter or of price lists."""
    pattern = _re2(_FRONT if kind == "front" else _AD)
    items = f"list_prepend({{'l': '', 'm': false, 'on': false, 'n': 0, 'kept': []::VARCHAR[]}}, list_transform(string_split(t, chr(10)), lambda l: {{'l': l, 'm': regexp_matches(l, '{pattern}'), 'on': false, 'n': 0, 'kept': []::VARCHAR[]}}))"
    if kind == "front":
        blank = f"(a.on AND NOT x.m AND {_strip('x.l')} = '')"
        step = f"{{'l': '', 'm': false, 'on': x.m OR ({blank} AND a.n < 3), 'n': CASE WHEN x.m THEN a.n + 1 WHEN {blank} AND a.n < 3 THEN a.n + 1 ELSE 0 END, 'kept': CASE WHEN x.m OR {blank} THEN a.kept ELSE list_append(a.kept, x.l) END}}"
    else:
        step = "{'l': '', 'm': false, 'on': false, 'n': CASE WHEN a.n > 0 THEN a.n - 1 WHEN x.m THEN 2 ELSE 0 END, 'kept': CASE WHEN a.n > 0 OR x.m THEN a.kept ELSE list_append(a.kept, x.l) END}"
    return f"array_to_string(list_reduce({items}, lambda a, x: {step}).kept, chr(10))"


_COLUMNAR = f"""(len(list_filter(string_split(t, chr(10)), lambda l: {_strip('l')} <> '' AND length({_strip('l')}) < 40)) / greatest(len(list_filter(string_split(t, chr(10)), lambda l: {_strip('l')} <> '')), 1) > 0.6
  AND list_sum(list_transform(string_split(t, chr(10)), lambda l: length(l))) / len(string_split(t, chr(10))) < 50)"""


def _clean_ctes(source: str, folds: bool = True) -> list[str]:
    """Steps of the cleanup as one table after another (doc_id, t, flags), the last named cleaned."""
    prefix = (r"(?m)(^|\s)(?:JEM\s+)?\d{1,4}\s+(Journal of Emergency Management)", r"\1\2")
    steps: list[tuple[str, str | None, str]] = [
        ("replace(replace(replace(replace(t, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)), chr(173), ''), chr(65533), ' ')", None, ""),
        (_rewrites((r"([A-Za-z0-9_])-\s*\n\s*([a-z])", r"\1\2"), (r"\b([a-zA-Z]{2,})-\s{1,3}([a-z]{3,})\b", r"\1\2")), "fixed-hyphenation", "shorter"),
        (_rewrites((r"(?m)^.*_Layout\s+\d[^\n]*$", ""), (r"(?m)^.*_layout\s+\d[^\n]*$", "")), "removed-layout-annotations", "shorter"),
        (_rewrites((r"\b([A-Z] ){2,6}[A-Z]\b", "")), "removed-logo-artifacts", "differs"),
        (_rewrites((r"\bFlz\.M\b", "FRM"), (r"\bFlz\.W\b", "FRM"), (r"\bconstrnctions?\b", "constructions"), (r"(?i)\binnrmation\b", "information"), (r"(?i)\binfonnation\b", "information"), (r"(?i)\badequnte\b", "adequate"), (r"(?i)\bmanagcment\b", "management")), "repaired-ocr-substitutions", "differs"),
        (_rewrites(prefix), None, ""), (_rewrites((_HEADER, " "), (_HEADER_BROKEN, " ")), "removed-journal-headers", f"regexp_matches(t, '{_HEADER}') OR regexp_matches(t, '{_HEADER_BROKEN}')"),
        (_rewrites((r"(?im)^DOI:[^\n]*$", ""), (r"(?im)^SA-Weston[^\n]*$", ""), (r"(?m)^JEM\s+\d+\s*$", "")), None, ""),
        (_rewrites((r"(?m)^\s*\d{1,4}\s*$", "")), "removed-page-numbers", "differs"),
    ]
    gated = lambda gate, out: f"CASE WHEN {gate} THEN {out} ELSE t END"
    if folds:
        front, ads = f"regexp_matches(t, '{_FRONT_GATE}')", f"regexp_matches(t, '{_AD_GATE}')"
        steps += [(gated(front, _dropped_lines("front")), "removed-frontmatter", front), (gated(ads, _dropped_lines("ads")), "removed-ads", ads)]
    toc = f"regexp_matches(t, '{_TOC}')"
    cut = f"(instr(t, regexp_extract(t, '{_REFERENCES}')) - 1)"
    late = f"regexp_matches(t, '{_REFERENCES}') AND {cut} > 0.5 * length(t)"
    steps += [(gated(toc, _gsub("t", r"(?m)^[^\n]{10,60}\.{4,}\s*\d+\s*$", "")), "removed-toc", toc), (gated(late, f"left(t, {cut})"), "removed-references", "differs")]
    if folds:
        steps.append((gated(_COLUMNAR, _columns_sql()), "column-join-attempted", _COLUMNAR))
    steps += [
        (_rewrites((r"(?m)^\s*https?://[^\s]+\s*$", ""), (r"(?m)^\s*www\.[^\s]{5,}\s*$", "")), "removed-bare-url-lines", "differs"),
        (_strip(_rewrites((r"\n{3,}", chr(10) * 2), (r"[ \t]{2,}", " "))), None, ""),
    ]
    ctes = [f"c0 AS (SELECT doc_id, t, []::VARCHAR[] AS flags FROM {source})"]
    for i, (new, flag, rule) in enumerate(steps):
        shown = "false" if flag is None else _changed("new", rule) if rule in ("shorter", "differs") else rule
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT doc_id, new AS t, CASE WHEN {shown} THEN list_append(flags, '{flag}') ELSE flags END AS flags FROM (SELECT doc_id, t, flags, {new} AS new FROM c{i}))")
    return [*ctes, f"cleaned AS (SELECT doc_id, t, flags FROM c{len(steps)})"]


_MEAN_LINE = "list_sum(list_transform(string_split(t, chr(10)), lambda l: length(l))) / len(string_split(t, chr(10)))"
_NOTES = rf"list_filter([CASE WHEN len(regexp_split_to_array(t, '\s+')) < 50 THEN 'very-short-document' END, CASE WHEN {_MEAN_LINE} < 20 THEN 'short-avg-line-length-possible-column-artifact' END], lambda n: n IS NOT NULL)"


def _heading(s: str) -> str:
    return rf"""(length({s}) BETWEEN 3 AND 120 AND (regexp_matches({s}, '^[A-Z][A-Z\s\-:]{{4,}}$') OR regexp_matches({s}, '^\d+(\.\d+)?\s+[A-Z][a-zA-Z\s]{{3,}}$')
  OR (regexp_matches({s}, '^[A-Z][a-zA-Z\s\-:,]{{4,}}$') AND NOT suffix({s}, '.') AND NOT suffix({s}, ',') AND len(string_split({s}, ' ')) <= 8
  AND NOT regexp_matches({s}, '\b(PhD|MD|MPH|DPA|EdD|MS|MA|BA|University|College|Institute|Department)\b'))))"""


def _chunk_ctes(source: str) -> list[str]:
    """Of a table (doc_id, t, sizes of its pages), the usable chunks (doc_id, chunk_id,
    section_path, page_start, page_end, said)."""
    no = "'buf': '', 'at': -1, 'cuts': []::INTEGER[]"
    items = f"list_prepend({{'l': '', 'h': false, {no}}}, list_transform(lines, lambda l: {{'l': l, 'h': {_heading(_strip('l'))}, {no}}}))"
    flush = f"(x.h AND length({_strip('a.buf')}) > 100)"
    step = f"{{'l': '', 'h': false, 'buf': CASE WHEN {flush} THEN '' ELSE concat(a.buf, x.l) END, 'at': a.at + 1, 'cuts': CASE WHEN {flush} THEN list_append(a.cuts, a.at + 1) ELSE a.cuts END}}"
    cut = "regexp_replace(said, '([.!?])\\s+([A-Z])', concat('\\1', chr(1), '\\2'), 'g')".replace("\\\\", "\\")
    sentences = f"list_filter(string_split({cut}, chr(1)), lambda s: {_strip('s')} <> '')"
    empty = "'buf': '', 'start': 0, 'done': []::STRUCT(said VARCHAR, start INTEGER)[]"
    packed = f"list_prepend({{'s': '', 'i': -1, {empty}}}, list_transform(sents, lambda s, i: {{'s': s, 'i': CAST(i - 1 AS INTEGER), {empty}}}))"
    full = "(length(a.buf) + length(x.s) > 2400 AND length(a.buf) > 200)"
    back = "coalesce(list_min(list_filter(range(1, least(x.i, 150) + 1), lambda k: list_sum(list_transform(sents[x.i - k + 1:x.i], lambda s: length(s) + 1)) >= 300)), x.i)"
    again = f"concat({_strip(f'array_to_string(sents[x.i - {back} + 1:x.i], chr(32))')}, ' ')"
    pack = (
        f"{{'s': '', 'i': 0, 'buf': CASE WHEN {full} THEN concat({again}, x.s) WHEN a.buf = '' THEN x.s ELSE concat(a.buf, ' ', x.s) END, "
        f"'start': CASE WHEN {full} AND instr(said, {again}) > 0 THEN CAST(instr(said, {again}) - 1 AS INTEGER) ELSE a.start END, "
        f"'done': CASE WHEN {full} THEN list_append(a.done, {{'said': a.buf, 'start': a.start}}) ELSE a.done END}}"
    )
    return [
        f"folded AS MATERIALIZED (SELECT doc_id, sizes, lines, list_reduce({items}, lambda a, x: {step}).cuts AS cuts FROM (SELECT doc_id, sizes, string_split(t, chr(10)) AS lines FROM {source}))",
        "bounds AS (SELECT doc_id, sizes, lines, unnest(list_zip(list_prepend(-1, cuts), list_append(cuts, CAST(len(lines) AS INTEGER)))) AS b, generate_subscripts(list_prepend(-1, cuts), 1) AS k FROM folded)",
        f"""parts AS MATERIALIZED (SELECT doc_id, sizes, k, CASE WHEN f >= 0 THEN {_strip('lines[f + 1]')} ELSE {_strip(f"list_filter(own, lambda l: {_heading(_strip('l'))})[1]")} END AS heading, {_strip("array_to_string(own, chr(10))")} AS said
  FROM (SELECT doc_id, sizes, lines, k, b[1] AS f, lines[b[1] + 2:b[2]] AS own FROM bounds))""",
        f"cut_parts AS MATERIALIZED (SELECT doc_id, sizes, k, heading, said, CASE WHEN length(said) > 4000 THEN {sentences} END AS sents FROM parts WHERE length(said) > 200)",
        f"runs AS MATERIALIZED (SELECT doc_id, sizes, k, heading, said, CASE WHEN sents IS NOT NULL THEN list_reduce({packed}, lambda a, x: {pack}) END AS r FROM cut_parts)",
        f"""pieces AS (SELECT doc_id, sizes, k, heading, unnest(d) AS c, generate_subscripts(d, 1) AS nth FROM (SELECT doc_id, sizes, k, heading, CASE WHEN r IS NULL THEN [{{'said': said, 'start': 0}}]
  WHEN length({_strip('r.buf')}) > 200 THEN list_append(r.done, {{'said': r.buf, 'start': r.start}}) ELSE r.done END AS d FROM runs))""",
        "numbered AS (SELECT doc_id, sizes, heading, c.said AS buf, c.start AS a, row_number() OVER (PARTITION BY doc_id ORDER BY k, nth) - 1 AS number FROM pieces)",
        "ends AS (SELECT *, list_transform(range(1, len(sizes) + 1), lambda p: {'p': p, 'a': coalesce(list_sum(sizes[1:p - 1]), 0), 'b': list_sum(sizes[1:p])}) AS pp FROM numbered)",
        f"""chunks AS (SELECT doc_id, concat(doc_id, '__chunk_', lpad(CAST(number AS VARCHAR), CAST(greatest(4, length(CAST(number AS VARCHAR))) AS INTEGER), '0')) AS chunk_id, heading AS section_path,
  CAST(coalesce(list_max(list_transform(list_filter(pp, lambda q: q.a <= a AND a < q.b), lambda q: q.p)), 1) AS INTEGER) AS page_start,
  CAST(coalesce(list_min(list_transform(list_filter(pp, lambda q: q.a <= a + length(buf) AND a + length(buf) <= q.b), lambda q: q.p)), greatest(len(sizes), 1)) AS INTEGER) AS page_end, {_strip('buf')} AS said FROM ends)""",
        r"usable AS (SELECT * FROM chunks WHERE length(said) >= 200 AND len(regexp_extract_all(said, '(?m)^\s*\d+\.\s+[A-Z]')) / len(string_split(said, chr(10))) <= 0.5 AND len(regexp_split_to_array(said, '\s+')) >= 20)",
    ]


def _count(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(t, '{_re2(pattern)}')) AS BIGINT)"


_NOISED = f"noised AS (SELECT doc_id, {noised()} AS t FROM documents)"
_SCAN = "SELECT doc_id, " + ", ".join(f"{_count(p)} AS {k}" for k, p in _ARTIFACTS.items())
_TOTAL = " + ".join(_ARTIFACTS)
_CLEANED = "WITH " + ",\n".join([_NOISED, *_clean_ctes("noised")])
# Each document's noised text, as two pages.
_PAGED = f"SELECT doc_id, [CAST(length(t) // 2 AS INTEGER), CAST(length(t) - length(t) // 2 AS INTEGER)] AS sizes FROM noised"
_CHUNKED = _CLEANED + ",\n" + ",\n".join([f"paged AS (SELECT cleaned.doc_id, cleaned.t, p.sizes FROM cleaned JOIN ({_PAGED}) p USING (doc_id))", *_chunk_ctes("paged")])
_BOTH = f"{_CLEANED}, raws AS ({_SCAN} FROM noised), cleans AS ({_SCAN} FROM cleaned)"
_PERCENT = "CAST(CASE WHEN raw = 0 THEN 0 ELSE floor(100 * (raw - clean) / raw + 0.5) END AS BIGINT)"
_SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', concat('\1', chr(1), '\2'), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> '')"
_HEADING_LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM l)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE length(s) BETWEEN 3 AND 120 AND (regexp_matches(s, '^[A-Z][A-Z\s\-:]{4,}$') OR regexp_matches(s, '^\d+(\.\d+)?\s+[A-Z][a-zA-Z\s]{3,}$')
OR (regexp_matches(s, '^[A-Z][a-zA-Z\s\-:,]{4,}$') AND NOT suffix(s, '.') AND NOT suffix(s, ',') AND len(string_split(s, ' ')) <= 8
AND NOT regexp_matches(s, '\b(PhD|MD|MPH|DPA|EdD|MS|MA|BA|University|College|Institute|Department)\b')))) AS BIGINT) AS n_headings FROM s GROUP BY doc_id"""
_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{w}') THEN '{t}'" for t, w in _TOPICS) + " ELSE 'general' END"

_NO_ANSWER = "I do not have sufficient evidence in the ingested documents to answer this question. Please ingest relevant documents or refine your query."
_JUDGED = """s AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE final > 0.025) AS d, max(CASE WHEN place = 0 THEN final END) AS best FROM hits GROUP BY ALL),
judged AS (SELECT query_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'insufficient' WHEN d >= 2 AND best > 0.025 THEN 'high' WHEN d >= 1 OR best > 0.015 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN n IS NULL THEN 'No relevant chunks were retrieved.' WHEN d >= 2 AND best > 0.025 THEN concat(d, ' directly relevant chunks found.')
    WHEN d >= 1 OR best > 0.015 THEN 'Partial evidence found; some claims may need verification.' ELSE 'Weak evidence; answer may not be fully supported.' END AS reason,
  CASE WHEN n IS NULL THEN 'No evidence found in the document corpus for this query.' WHEN d >= 1 OR best > 0.015 THEN '' ELSE 'Evidence quality is low. Answer may not be fully grounded.' END AS warnings,
  CAST(coalesce(d, 0) AS BIGINT) AS n_direct FROM questions LEFT JOIN s USING (query_id))"""
# The first sentence of the evidence as the prompt shows it.
_SAID = r"""blocks AS (SELECT query_id, string_agg(concat('[', place + 1, '] Source: ', source, ' (p. 1)', chr(10), left(text, 1000)), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY place) AS e FROM hits GROUP BY ALL),
bodies AS (SELECT query_id, concat(substr(e, instr(e, chr(10)) + 1), chr(10), chr(10), 'INSTRUCTIONS:', chr(10), '- Answer based ONLY on the evidence above.', chr(10), '- Start with the direct answer.') AS body FROM blocks),
said AS (SELECT query_id, concat(left(regexp_replace(string_split(body, '. ')[1], '^\s+|\s+$', '', 'g'), 300), ' [1]') AS answer FROM bodies)"""
_FILES = f"""files AS (SELECT doc_id, n_chars, {noised()} AS n FROM documents), pages AS (SELECT doc_id, concat(chr(10), chr(10), left(n, length(n) // 2), chr(10), chr(10), substr(n, length(n) // 2 + 1)) AS t,
  [CAST(length(n) // 2 AS INTEGER), CAST(length(n) - length(n) // 2 AS INTEGER)] AS sizes FROM files WHERE n_chars >= 200)"""
_INGEST = "WITH " + ",\n".join([_FILES, *_clean_ctes("pages"), "paged AS (SELECT cleaned.doc_id, cleaned.t, sizes FROM cleaned JOIN pages USING (doc_id))", *_chunk_ctes("paged")]) + f""",
counts AS (SELECT doc_id, count(*) AS c FROM usable GROUP BY ALL),
rows AS (SELECT f.doc_id, n_chars < 200 AS bad, coalesce(c, 0) AS c, coalesce(flags, []) AS flags, {_NOTES} AS notes FROM files f LEFT JOIN cleaned USING (doc_id) LEFT JOIN counts USING (doc_id)),
report AS (SELECT *, concat('file', doc_id, '.pdf') AS filename, CASE WHEN bad THEN [] ELSE list_filter([CASE WHEN len(flags) > 0 THEN concat('file', doc_id, '.pdf: Cleaning applied: ', array_to_string(flags, ', ')) END,
  CASE WHEN len(notes) > 0 THEN concat('file', doc_id, '.pdf: Quality: ', array_to_string(notes, ', ')) END, CASE WHEN c = 0 THEN concat('file', doc_id, '.pdf: No usable chunks extracted from document') END], lambda w: w IS NOT NULL) END AS warnings FROM rows)"""
# The second of two runs, which the English documents with chunks were there before.
_AGAIN = _INGEST + ", again AS (SELECT report.*, lang = 'en' AND c > 0 AS known FROM report JOIN documents USING (doc_id))"
_LETTERS = [f"length(l) - length(replace(l, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz"]
_VECTOR = "list_transform(counts, lambda n: CASE WHEN list_sum(list_transform(counts, lambda m: m * m)) = 0 THEN 0 ELSE n / sqrt(list_sum(list_transform(counts, lambda m: m * m))) END)"
_DAY = "CAST(DATE '2026-01-01' AS VARCHAR)"

ORACLE_SQL = {
    "ingest_files": _INGEST + " SELECT CAST(doc_id AS VARCHAR) AS document_id, filename, CAST(CASE WHEN bad THEN 0 ELSE 2 END AS BIGINT) AS page_count, CAST(c AS BIGINT) AS chunk_count, CASE WHEN bad THEN 'error' ELSE 'ingested' END AS status, CASE WHEN bad THEN 'PDF parse error: no pages' END AS error, array_to_string(flags, ',') AS flags, array_to_string(warnings, '|') AS warnings FROM report",
    "ingest_index": _INGEST + f" SELECT chunk_id, CAST(doc_id AS VARCHAR) AS document_id, concat('file', doc_id, '.pdf') AS source_file, page_start, page_end, md5(said) AS text_md5, round(list_sum({_VECTOR}), 6) AS vector_sum, row_number() OVER (ORDER BY concat('file', doc_id, '.pdf'), length(chunk_id), chunk_id) - 1 AS pos FROM (SELECT *, [{', '.join(_LETTERS)}] AS counts FROM (SELECT *, lower(said) AS l FROM usable))",
    "ingest_result": _INGEST + " SELECT (count(*) FILTER (WHERE bad) = 0 OR count(*) FILTER (WHERE c > 0) > 0) AS success, count(*) FILTER (WHERE c > 0) AS documents, CAST(sum(c) AS BIGINT) AS chunks, CAST(sum(c) AS BIGINT) AS vectors, count(*) FILTER (WHERE bad) AS n_errors, CAST(sum(len(warnings)) AS BIGINT) AS n_warnings, count(*) AS n_files FROM report",
    "ingest_again_result": _AGAIN + " SELECT count(*) FILTER (WHERE c > 0) > 0 OR count(*) FILTER (WHERE bad) = 0 AS success, count(*) FILTER (WHERE c > 0) AS documents, CAST(sum(c) AS BIGINT) AS chunks, CAST(sum(CASE WHEN known THEN 0 ELSE c END) AS BIGINT) AS vectors, count(*) FILTER (WHERE bad) AS n_errors, CAST(sum(CASE WHEN known THEN 0 ELSE len(warnings) END) AS BIGINT) AS n_warnings, count(*) AS n_files FROM again",
    "ingest_again_manifest": _AGAIN + " SELECT CAST(doc_id AS VARCHAR) AS document_id, filename, 2 AS page_count, CAST(c AS INTEGER) AS chunk_count, CASE WHEN known THEN '2026-01-01' ELSE '2026-01-02' END AS day, 'ingested' AS status, array_to_string(flags, ',') AS flags FROM again WHERE NOT bad",
    "ingest_again_index": _AGAIN + " SELECT row_number() OVER (ORDER BY NOT known, filename, length(chunk_id), chunk_id) - 1 AS pos, chunk_id, md5(said) AS text_md5 FROM usable JOIN again USING (doc_id)",
    "ingest_states": _AGAIN + " SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN bad THEN 'failed' WHEN known THEN 'known' ELSE 'taken' END AS state, CASE WHEN bad THEN 0 ELSE 2 END AS page_count, CAST(c AS INTEGER) AS chunk_count, CASE WHEN bad OR known THEN 0 ELSE len(warnings) END AS n_warnings FROM again",
    "store_replace": "WITH low AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), marks AS (SELECT doc_id, md5(text) AS mark FROM documents) SELECT doc_id, mark FROM marks WHERE doc_id NOT IN (SELECT doc_id FROM low) UNION ALL SELECT doc_id, concat('new ', mark) FROM marks WHERE doc_id IN (SELECT doc_id FROM low) AND left(mark, 1) >= '5'",
    "status_notes": """SELECT CAST(0 AS BIGINT) AS documents, CAST(0 AS BIGINT) AS vectors, false AS ready, concat_ws('|', concat((SELECT count(*) FROM pages), ' source PDFs available in attached_assets/'), concat((SELECT count(*) FROM pages WHERE url LIKE '%1%'), ' uploaded PDFs'),
  'Documents available but not yet ingested. Click "Ingest Documents" to start.') AS notes""",
    "artifact_examples": f"WITH {_NOISED} SELECT doc_id, " + ", ".join(f"array_to_string(list_transform(regexp_extract_all(t, '{_re2(p)}')[1:3], lambda e: left({_strip('e')}, 80)), '|') AS {k}" for k, p in _ARTIFACTS.items()) + " FROM noised",
    "embed_documents": f"SELECT doc_id, array_to_string(list_transform({_VECTOR}, lambda v: CAST(CAST(floor(v * 10000 + 0.5) AS BIGINT) AS VARCHAR)), ',') AS vector FROM (SELECT doc_id, [{', '.join(_LETTERS)}] AS counts FROM (SELECT doc_id, lower(text) AS l FROM documents))",
    "document_list": "SELECT regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), '_+', '_', 'g') AS document_id, url AS filename FROM pages WHERE contains(lower(url), '1')",
    "reset_index": "SELECT 'raw' AS table, state, (SELECT count(*) FROM documents) AS n FROM (VALUES ('before'), ('after')) s(state) UNION ALL SELECT 'vectors', 'before', (SELECT count(*) FROM embeddings) UNION ALL SELECT 'vectors', 'after', 0",
    "report_append": f"""WITH said AS (SELECT role, concat_ws(':', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), md5(text)) AS question FROM conversations), fresh AS (SELECT question, row_number() OVER (ORDER BY question) - 1 AS n FROM said WHERE role <> 'user'),
log AS (SELECT question, {_DAY} AS day, true AS stamped, concat('report_1767225600000', CASE WHEN n > 0 THEN concat('_', n) ELSE '' END) AS id FROM fresh UNION ALL SELECT question, '2025-01-01', false, concat('old_', question) FROM said WHERE role = 'user')
SELECT question, day, stamped FROM log ORDER BY day DESC, id DESC LIMIT 100""",
    "tokenize": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "corpus_stats": f"SELECT CAST(count(*) AS BIGINT) AS n_docs, round(avg(len(t)), 6) AS mean_terms, CAST(sum(len(list_distinct(t))) AS BIGINT) AS n_postings FROM (SELECT {_tokens('text')} AS t FROM documents)",
    "bm25_search": f"WITH {DOCS},{QUESTIONS},{BM25.format(records='docs')} SELECT query_id, pos AS doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM lexical",
    "bm25_index": f"WITH {FINAL},{QUESTIONS},{BM25.format(records='docs')} SELECT query_id, pos AS doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM lexical",
    "bm25_index_compacted": f"WITH {FINAL},{QUESTIONS},{BM25.format(records='docs')}, plain AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) - 1 AS place FROM scored WHERE score > 0 QUALIFY place < 25) SELECT query_id, pos AS doc_id, CAST(place AS BIGINT) AS rank, round(score, 6) AS score FROM plain",
    "bm25_pruned": f"WITH {DOCS},{QUESTIONS},{BM25.format(records='docs')} SELECT query_id, pos AS doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM lexical",
    "bm25_pruned_rows": f"""WITH {DOCS},{QUESTIONS},{BM25.format(records='docs')},
parts AS (SELECT term, pos, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * size / mean)) AS part FROM found JOIN dfs USING (term) CROSS JOIN stats WHERE term IN (SELECT term FROM terms)),
blocks AS (SELECT term, pos // 16 AS block, max(part) AS most, count(*) AS m FROM parts GROUP BY ALL), reach AS (SELECT query_id, block, sum(most * times) AS most, sum(m) AS m FROM terms JOIN blocks USING (term) GROUP BY ALL),
first AS (SELECT query_id, block FROM reach QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(most, 9) DESC, block) <= 3),
kth AS (SELECT query_id, score AS least FROM scored s WHERE EXISTS (SELECT 1 FROM first f WHERE f.query_id = s.query_id AND f.block = s.pos // 16) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) = 3)
SELECT query_id, CAST(sum(m) AS BIGINT) AS n_all, CAST(coalesce(sum(m) FILTER (WHERE most >= coalesce(least, 0) * (1 - 1e-9)), 0) AS BIGINT) AS n_touched FROM reach LEFT JOIN kth USING (query_id) GROUP BY ALL""",
    "dense_search": f"WITH {QUESTIONS},{DENSE.format(vectors='embeddings', pos='vec_id')} SELECT query_id, pos AS vec_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM dense",
    "phrase_rescue": f"WITH {DOCS},{QUESTIONS},{PHRASE.format(records='docs')} SELECT query_id, pos AS doc_id, round(score, 6) AS score FROM exact",
    "rrf_fusion": HYBRID + " SELECT query_id, pos AS doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM fused",
    "hybrid_retrieval": HYBRID + " SELECT query_id, pos AS doc_id, CAST(place AS BIGINT) AS rank, round(final, 6) AS score, 'hybrid-rrf' AS retrieval_method FROM hits",
    "answer_sources": HYBRID + f" SELECT query_id, CAST(place AS BIGINT) AS rank, pos AS doc_id, source, {SUPPORT} AS support_level, md5(concat(left(text, 300), CASE WHEN length(text) > 300 THEN '…' ELSE '' END)) AS snippet_md5 FROM hits",
    "answer_confidence": f"{HYBRID}, {_JUDGED} SELECT query_id, confidence, reason, warnings, n_direct FROM judged",
    "answers": f"{HYBRID}, {_SAID}, {_JUDGED} SELECT query_id, coalesce(answer, '{_NO_ANSWER}') AS answer, CASE WHEN n > 0 AND told THEN 'low' ELSE confidence END AS confidence, CASE WHEN n > 0 AND told THEN 'LLM indicated insufficient evidence.' ELSE reason END AS reason, CASE WHEN n > 0 AND told THEN '' ELSE warnings END AS warnings FROM (SELECT *, coalesce(contains(lower(answer), 'i do not') OR contains(lower(answer), 'not found'), false) AS told FROM judged LEFT JOIN said USING (query_id))",
    "confidence_counts": f"{HYBRID}, {_JUDGED} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE confidence = '{n}') AS {n}" for n in ("high", "medium", "low", "insufficient")) + " FROM judged",
    "evidence_quality": f"{HYBRID}, {_JUDGED} SELECT query_id, CASE confidence WHEN 'high' THEN 'strong' WHEN 'medium' THEN 'partial' ELSE 'weak' END AS evidence_quality FROM judged",
    "retrieval_debug": HYBRID + " SELECT query_id, " + ", ".join(f"CAST((SELECT count(*) FROM {t} x WHERE x.query_id = q.query_id) AS BIGINT) AS n_{t}" for t in ("dense", "lexical", "exact", "fused", "hits")) + " FROM questions q",
    "clean_patterns": "WITH " + ",\n".join([_NOISED, *_clean_ctes("noised", folds=False)]) + " SELECT doc_id, md5(t) AS cleaned_md5, CAST(length(t) AS BIGINT) AS n_chars FROM cleaned",
    "clean_text": _CLEANED + f" SELECT doc_id, md5(t) AS cleaned_md5, array_to_string(flags, ',') AS cleaning_flags, array_to_string({_NOTES}, ',') AS quality_notes FROM cleaned",
    "chunk_documents": _CHUNKED + " SELECT doc_id, chunk_id, section_path, page_start, page_end, md5(said) AS text_md5 FROM usable",
    "artifact_report": _BOTH + f", l AS (SELECT type, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(clean) AS BIGINT) AS clean FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS type, raws.{k} AS raw, cleans.{k} AS clean FROM raws JOIN cleans USING (doc_id)" for k in _ARTIFACTS) + f") GROUP BY ROLLUP (type)) SELECT type, raw, clean, raw - clean AS removed, {_PERCENT} AS percent FROM l",
    "artifact_documents": _BOTH + f", l AS (SELECT doc_id, {' + '.join(f'raws.{k}' for k in _ARTIFACTS)} AS raw, {' + '.join(f'cleans.{k}' for k in _ARTIFACTS)} AS clean, raws.hyphen_newline - cleans.hyphen_newline AS hyphens FROM raws JOIN cleans USING (doc_id)) SELECT doc_id, concat(source, '.pdf') AS filename, raw, clean, raw - clean AS removed, {_PERCENT} AS percent, hyphens FROM l JOIN documents USING (doc_id)",
    "artifact_scan": f"WITH {_NOISED} {_SCAN} FROM noised",
    "artifact_noise": f"WITH {_NOISED}, s AS ({_SCAN}, len(regexp_split_to_array(t, '\\s+')) AS words FROM noised) SELECT doc_id, round(({_TOTAL}) / words, 6) AS noise_ratio, round(least(1, 10 * (({_TOTAL}) / words)), 6) AS chunk_noise FROM s",
    "sentence_split": f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, chr(1))) AS sentences_md5 FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)",
    "heading_lines": _HEADING_LINES,
    "document_ids": "SELECT page_id, regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), '_+', '_', 'g') AS document_id FROM pages",
    "manifest_upsert": "SELECT source, CAST(doc_id AS BIGINT) AS doc_id, CAST(n_chars AS BIGINT) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) WHERE n = 1",
    "vector_upsert": """WITH old AS (SELECT vec_id AS id, vec_id AS pos, label FROM embeddings), new AS (SELECT vec_id + 100 AS id, vec_id AS pos, -1 AS label FROM embeddings WHERE vec_id % 3 = 0), e AS (SELECT coalesce(max(pos) + 1, 0) AS z FROM old)
SELECT id, pos, label FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT new.id, coalesce(old.pos, z + new.pos), new.label FROM new LEFT JOIN old USING (id) CROSS JOIN e""",
    "embed_only_new": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "delete_documents": "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "catalog_status": "SELECT CAST((SELECT count(DISTINCT source) FROM documents) AS BIGINT) AS documents, CAST((SELECT count(*) FROM documents) AS BIGINT) AS chunks, CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS vectors, (SELECT max(ts) FROM events) AS last_ingested_at, (SELECT count(*) > 0 FROM embeddings) AS ready",
    "chunk_previews": "SELECT doc_id, md5(concat(left(text, 500), CASE WHEN length(text) > 500 THEN '…' ELSE '' END)) AS preview_md5 FROM documents WHERE source = 'src1'",
    "classify_questions": f"SELECT conv_id, turn, {_TOPIC.format('text')} AS classification FROM conversations",
    "report_confidence": f"SELECT {_TOPIC.format('text')} AS classification, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT) AS n_user FROM conversations GROUP BY ALL",
    "report_search": "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'ther') OR contains(lower(role), 'ther')",
    "newest_reports": "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations ORDER BY conv_id DESC, turn DESC, md5(text) LIMIT 100",
    "document_search": "SELECT page_id, url FROM pages WHERE contains(lower(url), '1')",
    "ingest_rollup": "SELECT CAST(count(*) FILTER (WHERE n_chars >= 200) AS BIGINT) AS documents, CAST(sum(n_chars) AS BIGINT) AS chunks, CAST(count(*) FILTER (WHERE n_chars < 200) AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE lang <> 'en') AS BIGINT) AS warnings, (count(*) FILTER (WHERE n_chars < 200) = 0 OR count(*) FILTER (WHERE n_chars >= 200) > 0) AS success FROM documents",
}

"""Cleaners, parsers, classifiers, gates and generators over a caller's table of texts: docs (id, text).

Lines are the runs between newlines, without white space at their ends. Patterns, word lists, weights and bounds are
fixed values.
"""

from __future__ import annotations

OPERATORS: dict[str, str] = {}
WORDS = "size(regexp_extract_all({x}, r'[^\\s]+', 0))".replace("\\\\", "\\")


def words(x: str) -> str:
    return WORDS.replace("{x}", x)


def _any(low: str, signs: str) -> str:
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in signs.split(", ")) + ")"


# -- cleaners ------------------------------------------------------------------------------
OPERATORS["clean_lines"] = r"""
WITH l AS (SELECT * FROM <<lines {docs} id>> x),
c AS (SELECT *, count(CASE WHEN length(line) >= 4 AND NOT regexp_like(line, r'^[0-9]+$') THEN 1 END) OVER (PARTITION BY id, lower(line)) AS times, CAST(sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) AS INT) AS para FROM l),
j AS (SELECT *, line <> '' AND (length(line) < 2 OR regexp_like(line, r'^[0-9]+$') OR regexp_like(line, r'^(---|===|___)') OR regexp_like(line, r'^https?://[^\s]+$')
  OR regexp_like(line, r'^[\p{L}\p{N}_-]+\.(py|html|js|css|json|yaml|txt|md|cfg)$') OR regexp_like(line, r'(?i)^(isbn|copyright\s*©?|all\s+rights\s+reserved|published\s+by)<<e>>') OR times >= 8) AS junk FROM c),
p AS (SELECT id, para, <<joined line ' ' line_no>> AS body FROM j WHERE line <> '' AND NOT junk GROUP BY id, para),
t AS (SELECT id, <<joined body '##' para>> AS body FROM p GROUP BY id),
n AS (SELECT id, count(*) AS original, count_if(junk) AS removed FROM j GROUP BY id)
SELECT n.id, n.original, n.removed, md5(regexp_sub(coalesce(t.body, ''), r'([\p{L}\p{N}_]+)-\s+([\p{L}\p{N}_]+)', '<<g1>><<g2>>', 'g')) AS clean FROM n LEFT JOIN t ON n.id = t.id"""

OPERATORS["without_headers"] = r"""
WITH l AS (SELECT * FROM <<lines {docs} id>> x),
c AS (SELECT *, CASE WHEN length(line) BETWEEN 4 AND 120 AND NOT regexp_like(line, r'^[0-9]+$') THEN count(*) OVER (PARTITION BY id, lower(line)) ELSE 0 END AS times FROM l),
j AS (SELECT *, line <> '' AND (regexp_like(lower(line), r'^([0-9]+|page\s+[0-9]+(\s+of\s+[0-9]+)?)$') OR regexp_like(line, r'^[-=_]{4,}$') OR times >= 3 OR regexp_like(lower(line), r'^(isbn|copyright|all rights reserved|published by|doi:)')
  OR regexp_like(line, r'^https?://[^\s]+$')) AS junk FROM c),
t AS (SELECT id, <<joined line <<nl>> line_no>> AS body FROM j WHERE NOT junk GROUP BY id),
n AS (SELECT id, count(*) AS original, count_if(junk) AS removed FROM j GROUP BY id)
SELECT n.id, n.removed, round(greatest(5e-1, least(98e-2, 1e0 - n.removed / CAST(n.original AS DOUBLE) * 5e-1)), 4) AS confidence, md5(coalesce(t.body, '')) AS clean FROM n LEFT JOIN t ON n.id = t.id"""

OPERATORS["without_contents"] = r"""
WITH l AS (SELECT * FROM <<lines {docs} id>> x),
j AS (SELECT *, regexp_like(line, r'.{10,}\.{3,}\s*[0-9]+\s*$') OR (regexp_like(line, r'^[0-9]+(\.[0-9]+)*\s+[A-Z].*\s+[0-9]+\s*$') AND length(regexp_sub(line, r'[^.]', '', 'g')) >= 2) AS toc FROM l)
SELECT id, count_if(toc) AS removed, count(*) AS original FROM j GROUP BY id"""

OPERATORS["section_titles"] = r"""
WITH l AS (SELECT *, regexp_like(line, r'^[0-9]+(\.[0-9]+)*\s*$') AS bare, length(line) < 100 AND regexp_like(line, r'(?i)^(MODULE|UNIT|CHAPTER|SECTION)?\s*[0-9]+(\.[0-9]+)*\s*[:.–-]?\s*') AS head,
  regexp_sub(regexp_sub(line, r'(?i)^(MODULE|UNIT|CHAPTER|SECTION)?\s*[0-9]+(\.[0-9]+)*\s*[:.–-]?\s*', '', 'g'), r'^[ :.–-]+|[ :.–-]+$', '', 'g') AS title FROM <<lines {docs} id>> x)
SELECT id, count_if(bare) AS numbers, count_if(head AND NOT bare AND length(title) >= 8) AS titles, count_if(head AND NOT bare AND length(title) < 8) AS dropped FROM l GROUP BY id"""

OPERATORS["sections"] = r"""
WITH l AS (SELECT *, ((length(line) BETWEEN 10 AND 80 AND regexp_like(line, r'^[A-Z][A-Za-z0-9/()& -]{8,80}$') AND NOT contains(line, '.') AND size(regexp_extract_all(line, r'[^\s]+', 0)) <= 8)
   OR (length(line) BETWEEN 8 AND 80 AND line = upper(line) AND line <> lower(line))) AND line <> '' AS title FROM <<lines {docs} id>> x),
s AS (SELECT *, sum(CASE WHEN title THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) AS section FROM l),
g AS (SELECT id, section, CAST(sum(CASE WHEN title THEN 0 ELSE size(regexp_extract_all(line, r'[^\s]+', 0)) END) AS BIGINT) AS words, max(section) OVER (PARTITION BY id) AS last FROM s GROUP BY id, section)
SELECT id, CAST(section AS BIGINT) AS section, words FROM g WHERE words >= CASE WHEN section = last THEN 20 ELSE 30 END"""

OPERATORS["bare_texts"] = r"""
SELECT id, md5(trim(regexp_sub(regexp_sub(coalesce(text, ''), r'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), r'\s+', ' ', 'g'))) AS controls,
  md5(trim(regexp_sub(regexp_sub(regexp_sub(coalesce(text, ''), r'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), r'\$[A-Za-z0-9]{6,}', '', 'g'), r'\s+', ' ', 'g'))) AS codes,
  md5(regexp_sub(regexp_sub(regexp_sub(regexp_sub(coalesce(text, ''), r'(?i)xref\s+[0-9]+\s+[0-9]+', ' ', 'g'), r'(?i)startxref\s+[0-9]+', ' ', 'g'), r'[|]{2,}|_{4,}|-{4,}|\.{4,}', ' ', 'g'), r'[ \t]+', ' ', 'g')) AS artifacts FROM {docs}"""

OPERATORS["completed"] = r"""
WITH t AS (SELECT id, regexp_sub(regexp_sub(regexp_sub(coalesce(text, ''), r'^\s+|\s+$', '', 'g'), r'[,;:\s-]+$', '', 'g'), r'(?i)\s+(the|a|an|of|in|to|for|with|on|at|by|from|and|or)$', '', 'g') AS t FROM {docs}),
c AS (SELECT *, length(t) - length(replace(t, '(', '')) - length(t) + length(replace(t, ')', '')) AS open FROM t)
SELECT id, md5(CASE WHEN regexp_like(t, r'[.?!]$') THEN t || repeat(')', greatest(0, CAST(open AS INT))) ELSE t || repeat(')', greatest(0, CAST(open AS INT))) || '.' END) AS text, greatest(0, open) AS closed FROM c"""

OPERATORS["realised"] = r"""
WITH t AS (SELECT id, trim(regexp_sub(coalesce(text, ''), r'\s+', ' ', 'g')) AS t FROM {docs})
SELECT id, CASE WHEN t = '' THEN '' ELSE md5(upper(substr(t, 1, 1)) || substr(t, 2) || CASE WHEN regexp_like(t, r'[.?!]$') THEN '' ELSE '.' END) END AS text FROM t"""

OPERATORS["model_output"] = r"""
WITH t AS (SELECT id, regexp_sub(regexp_sub(regexp_sub(coalesce(text, ''), r'(?i)^\s*(here is|sure|certainly)[^:\n]*:\s*', '', 'g'), r'(?is)\s*\(?note:.*$', '', 'g'), r'(?i)^\s*question:\s*', '', 'g') AS t FROM {docs}),
b AS (SELECT id, regexp_sub(t, r'^\s+|\s+$', '', 'g') AS t FROM t)
SELECT id, md5(CASE WHEN endswith(t, '?') THEN t ELSE regexp_sub(t, r'[.\s]+$', '', 'g') || '?' END) AS text FROM b"""

OPERATORS["keywords"] = r"""
WITH w AS (SELECT id, filter(regexp_extract_all(lower(coalesce(text, '')), r'[\p{L}\p{N}_]+', 0), x -> regexp_like(x, r'^[a-z]{4,}$') AND NOT array_contains(array('with', 'this', 'that', 'from', 'they', 'their', 'which', 'when', 'where', 'what', 'have', 'been', 'will', 'also'), x)) AS ws FROM {docs}),
e AS (SELECT id, place, w FROM (SELECT id, <<numbered ws w place>> FROM w) x),
f AS (SELECT id, w, min(place) AS met FROM e GROUP BY id, w),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY met) AS rn FROM f)
SELECT id, <<joined w ',' met>> AS keywords FROM r WHERE rn <= 12 GROUP BY id"""

OPERATORS["index_names"] = r"""
SELECT id, replace(replace(lower(trim(coalesce(text, ''))), '-', ' '), '*', 'star') AS name FROM {docs}"""

OPERATORS["templates"] = r"""
SELECT template, count(*) AS n FROM (SELECT regexp_sub(regexp_sub(regexp_sub(coalesce(text, ''), r'"[^"]*"', '{TERM}', 'g'), r'[0-9]+', '{NUM}', 'g'), r'( [A-Z][a-z]{3,})+', ' {CONCEPT}', 'g') AS template FROM {docs}) x GROUP BY template""".replace("{TERM}", "<TERM>").replace("{NUM}", "<NUM>").replace("{CONCEPT}", "<CONCEPT>")

# -- segments and parsers --------------------------------------------------------------------
_MARKER = r"r'(?i)^(module\s*[-–:]?\s*[0-9]+|chapter\s*[0-9]+|unit\s*[0-9]+|[0-9]+\.\s+[A-Z][a-z]|part\s+[IVX]+|section\s+[0-9]+)'"
_HEADING = r"r'^([A-Z][A-Z\s]{8,}$|[0-9]+\.[0-9]*\s+[A-Z]|[A-Z][a-z]+(\s[A-Z][a-z]+){1,4}$)'"
_SEGMENTS = r"""
WITH l AS (SELECT * FROM <<lines {docs} id>> x),
s AS (SELECT *, sum(CASE WHEN HEAD THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) AS segment FROM l),
g AS (SELECT id, segment, CAST(sum(CASE WHEN HEAD THEN 0 ELSE size(regexp_extract_all(line, r'[^\s]+', 0)) END) AS BIGINT) AS words FROM s WHERE segment > 0 GROUP BY id, segment)
SELECT id, CAST(segment AS BIGINT) AS segment, words FROM g WHERE words > 10"""
OPERATORS["marker_segments"] = _SEGMENTS.replace("HEAD", f"regexp_like(line, {_MARKER})")
OPERATORS["heading_segments"] = _SEGMENTS.replace("HEAD", f"(length(line) >= 5 AND regexp_like(line, {_HEADING}))")
#: segments: id, strategy (from 1), segment, words. The first strategy of two segments or more, none under 50 words.
OPERATORS["segment_cascade"] = """
WITH v AS (SELECT id, strategy, count(*) AS segments, min(words) AS least FROM {segments} GROUP BY id, strategy)
SELECT d.id, coalesce(min(CASE WHEN segments >= 2 AND least >= 50 THEN strategy END), 5) AS strategy FROM {docs} d LEFT JOIN v ON d.id = v.id GROUP BY d.id"""

OPERATORS["contents_entries"] = r"""
WITH l AS (SELECT id, line, regexp_extract(line, r'^(.+?)\s+(\.{2,}|-{2,}|\s{2,})\s*([0-9]{1,4})\s*$', 1) AS t1, regexp_extract(line, r'^(.+?)\s+(\.{2,}|-{2,}|\s{2,})\s*([0-9]{1,4})\s*$', 3) AS p1,
  regexp_extract(line, r'^([0-9]{1,4})\s{2,}([A-Z0-9].{3,80})$', 2) AS t2, regexp_extract(line, r'^([0-9]{1,4})\s{2,}([A-Z0-9].{3,80})$', 1) AS p2,
  regexp_extract(line, r'^(.{5,100}?)\s{2,}([0-9]{1,4})\s*$', 1) AS t3, regexp_extract(line, r'^(.{5,100}?)\s{2,}([0-9]{1,4})\s*$', 2) AS p3
  FROM <<lines {docs} id>> x WHERE NOT regexp_like(line, r'(?i)^((table\s+of\s+|list\s+of\s+|brief\s+)?contents|index)$')),
e AS (SELECT id, CASE WHEN t1 <> '' THEN t1 WHEN t2 <> '' THEN t2 ELSE t3 END AS title, CAST(nullif(CASE WHEN t1 <> '' THEN p1 WHEN t2 <> '' THEN p2 ELSE p3 END, '') AS INT) AS page FROM l WHERE t1 <> '' OR t2 <> '' OR t3 <> ''),
c AS (SELECT id, regexp_sub(regexp_sub(title, r'\s+', ' ', 'g'), r'^[ .:\t-]+|[ .:\t-]+$', '', 'g') AS title, page FROM e WHERE page BETWEEN 1 AND 5000)
SELECT id, lower(title) AS title, page, max(CASE WHEN regexp_like(title, r'^[0-9]+\.[0-9]+') THEN 2 ELSE 1 END) AS level FROM c GROUP BY id, lower(title), page"""

OPERATORS["syllabus"] = r"""
WITH l AS (SELECT *, regexp_extract(line, r'(?i)(module|unit|chapter)\s*[-:]?\s*([0-9]+)[:\s]+(.+)', 2) AS module FROM <<lines {docs} id>> x WHERE line <> ''),
s AS (SELECT *, sum(CASE WHEN module <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) AS part FROM l),
b AS (SELECT id, part, line, regexp_like(line, r'(?i)(CO|outcome|objective)\s*[0-9]*\s*:') AS outcome FROM s WHERE part > 0 AND module = ''),
t AS (SELECT id, part, outcome, size(filter(transform(SPLIT(regexp_sub(line, r'<<b>>and<<e>>', ',', 'g')), x -> trim(x)), x -> length(x) > 3)) AS topics FROM b)
SELECT id, CAST(part AS BIGINT) AS part, count_if(outcome) AS outcomes, CAST(sum(CASE WHEN outcome THEN 0 ELSE topics END) AS BIGINT) AS topics FROM t GROUP BY id, part""".replace("SPLIT(regexp_sub(line, r'<<b>>and<<e>>', ',', 'g'))", "regexp_extract_all(regexp_sub(line, r'<<b>>and<<e>>', ',', 'g'), r'[^,;]+', 0)")

_LEVELS = (
    ("L1", "define, list, state, name, identify, recall"), ("L2", "explain, describe, discuss, summarize, interpret"), ("L3", "apply, implement, solve, calculate, demonstrate, illustrate"),
    ("L4", "analyze, compare, contrast, differentiate, distinguish, trace"), ("L5", "evaluate, justify, assess, critique, judge"), ("L6", "design, create, propose, develop, formulate, construct"),
)
_starts = lambda w: f"startswith(low, '{w}') OR contains(low, ' {w} ')"
_CLASSIFIED = "CASE " + " ".join(f"WHEN {' OR '.join(_starts(w) for w in ws.split(', '))} THEN '{k}'" for k, ws in _LEVELS) + " ELSE 'L2' END"
OPERATORS["level_by_word"] = f"WITH b AS (SELECT id, lower(coalesce(text, '')) AS low FROM {{docs}}) SELECT id, {_CLASSIFIED} AS level FROM b"

#: A question ends at a line with marks; what is gathered goes at a blank line and after seven lines without marks.
OPERATORS["marked_questions"] = r"""
WITH l AS (SELECT *, regexp_extract(line, r'(?i)[(\[]?\s*([0-9]{1,2})\s*(marks?|m)\s*[)\]]?\s*$', 1) AS marks FROM <<lines {docs} id>> x),
i AS (SELECT *, coalesce(sum(CASE WHEN line = '' OR marks <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY id, island ORDER BY line_no) - 1 AS nth FROM i),
q AS (SELECT id, island, floor(nth / 7) AS block, max(CASE WHEN line <> '' THEN marks ELSE '' END) AS marks, <<joined bare ' ' line_no>> AS body
  FROM (SELECT *, regexp_sub(line, r'(?i)[(\[]?\s*([0-9]{1,2})\s*(marks?|m)\s*[)\]]?\s*$', '', 'g') AS bare FROM n) x GROUP BY id, island, floor(nth / 7)),
c AS (SELECT id, island, CAST(marks AS INT) AS marks, trim(regexp_sub(trim(body), r'^\s*(Q\.?\s*)?[0-9]*\s*[.)]?\s*', '', 'g')) AS body FROM q WHERE marks <> '')
SELECT id, CAST(island AS BIGINT) AS island, marks, md5(body) AS question FROM c WHERE size(regexp_extract_all(body, r'[^\s]+', 0)) >= 3"""

OPERATORS["question_lines"] = rf"""
SELECT id, line_no, md5(line) AS question FROM <<lines {{docs}} id>> x WHERE length(line) >= 10
  AND {_any("lower(line)", "explain, describe, define, what, how, why, list, compare, discuss, derive, prove, calculate, solve, design, analyze, evaluate, state, write, draw, illustrate, differentiate, ?")}"""

OPERATORS["block_types"] = r"""
WITH l AS (SELECT *, length(line) - length(replace(line, '|', '')) AS bars, size(regexp_extract_all(line, r'[^\s]+', 0)) AS n FROM <<lines {docs} id>> x WHERE line <> ''),
k AS (SELECT id, line_no, CASE
  WHEN regexp_like(line, r'[=∑∫√∞∂∆^*/\\]|T\(n\)|O\(n\)') THEN CASE WHEN regexp_like(line, r'(?i)where|is defined|represents') THEN 'Definition' ELSE 'Formula' END
  WHEN length(line) BETWEEN 5 AND 80 AND NOT endswith(line, '.') AND ((line = upper(line) AND line <> lower(line)) OR regexp_like(line, r'^[A-Z][a-z]+(\s+[A-Z][a-z]+){0,4}$')) THEN 'Heading'
  WHEN regexp_like(line, r'(?i)^(Figure|Table|Diagram|Graph)\s+[0-9]+') THEN 'Caption'
  WHEN regexp_like(line, r'(?i)<<b>>(for|while|if|then|else|procedure|function|algorithm)<<e>>.*<<b>>(do|begin|end|return)<<e>>') THEN 'Algorithm'
  WHEN regexp_like(line, r'(?i)^(Example|For example|Consider|Suppose)<<e>>') THEN 'Example'
  WHEN (regexp_like(line, r'(?i)^(Exercise|Question|Problem|Assignment)<<e>>') OR endswith(line, '?')) AND n < 50 THEN 'Exercise'
  WHEN regexp_like(line, r'(?i)<<b>>(is defined as|refers to|denotes|means|known as)<<e>>') THEN 'Definition'
  WHEN bars >= 2 THEN 'Table'
  WHEN regexp_like(line, r'(?i)<<b>>(figure|diagram|graph|shows|depicts|illustrates)<<e>>.*<<b>>(below|above|following)<<e>>') THEN 'Diagram'
  WHEN regexp_like(line, r'^(\*|[0-9]+)\s+[a-z]') AND length(line) < 100 THEN 'Footnote' ELSE 'Concept' END AS kind FROM l)
SELECT id, kind, count(*) AS blocks FROM k GROUP BY id, kind"""

# -- pages, validators, gates ------------------------------------------------------------------
#: pages: id, page, text
OPERATORS["page_kinds"] = r"""
WITH l AS (SELECT d.page, x.* FROM <<lines {pages} id>> x JOIN {pages} d ON x.id = d.id WHERE line <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no) AS rn FROM l),
a AS (SELECT id, max(page) AS page, count_if(regexp_like(line, r'\.{3,}\s*[0-9]+\s*$') OR regexp_like(line, r'\s{2,}[0-9]+\s*$')) AS leaders, count_if(regexp_like(line, r'[0-9]+\s*$') AND length(line) < 120) AS ends,
  count_if(regexp_like(line, r'(?i)<<b>>(chapter|unit|module)\s+[0-9]+')) AS chapters, count_if(rn <= 5 AND regexp_like(line, r'(?i)^((table\s+of\s+|list\s+of\s+|brief\s+)?contents|index)$')) AS toc,
  count_if(rn <= 8 AND regexp_like(line, r'(?i)^(preface|foreword|acknowledge?ments?|about\s+the\s+authors?|about\s+this\s+book|dedication|copyright|syllabus)$')) AS front,
  count_if(rn <= 8 AND regexp_like(line, r'(?i)^(references?|bibliography|further\s+reading|glossary|appendix(\s+[a-z0-9]+)?|index)$')) AS back,
  count_if(rn <= 8 AND (regexp_like(line, r'(?i)^(chapter|unit|module)\s+[0-9]+<<e>>') OR regexp_like(line, r'(?i)^[0-9]+(\.[0-9]+)*\s+[A-Z].{3,80}$'))) AS heads,
  CAST(sum(size(regexp_extract_all(line, r'[^\s]+', 0))) AS BIGINT) AS words, count_if(regexp_like(line, r'(19|20)[0-9]{2}') AND regexp_like(line, r'[.,]\s*[A-Z]')) + count_if(regexp_like(line, r'^\[[0-9]+\]\s+')) AS refs,
  count_if(regexp_like(line, r'[=∑∫√≤≥±→←]')) AS symbols, count_if(regexp_like(line, r'(?i)<<b>>(definition|theorem|lemma|proof|example|figure|table)<<e>>')) AS terms FROM r GROUP BY id)
SELECT id, CASE WHEN (toc > 0 AND (leaders >= 3 OR chapters >= 2)) OR (page <= 40 AND (leaders >= 8 OR (chapters >= 5 AND ends >= 5))) THEN 'toc' WHEN front > 0 THEN 'front_matter' WHEN back > 0 THEN 'back_matter' WHEN heads > 0 THEN 'body'
  WHEN words >= 60 AND (symbols > 0 OR terms > 0 OR words > 120) THEN 'body' WHEN refs >= 6 THEN 'back_matter' ELSE 'unknown' END AS kind FROM a"""

_INDICATORS = "define, explain, describe, analyze, apply, compare, evaluate, design, implement, derive, theorem, principle, concept, algorithm, system, method, process, function, equation, formula, module, chapter, unit, example, solution, problem, given, find, calculate, prove, state, list, discuss, illustrate"
_MET = " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in _INDICATORS.split(", "))
#: Characters that each pattern of corruption matches are summed, overlaps counted twice.
_NOISE = " + ".join(f"length(x) - length(regexp_sub(x, r'{p}', '', 'g'))" for p in (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", r"[^\x00-\x7f]{5,}", r"\$[a-zA-Z0-9]{6,}", r"[^\p{L}\p{N}_\s.,;:?!\-()/\[\]]{4,}"))
OPERATORS["noise_verdicts"] = rf"""
WITH b AS (SELECT id, coalesce(text, '') AS x, lower(coalesce(text, '')) AS low, size(regexp_extract_all(coalesce(text, ''), r'[^\s]+', 0)) AS n FROM {{docs}}),
s AS (SELECT *, least(1e0, ({_NOISE}) / CAST(greatest(length(x), 1) AS DOUBLE)) AS noise, {_MET} AS met FROM b)
SELECT id, CASE WHEN regexp_like(x, r'^\s*$') THEN 'empty' WHEN n < 30 THEN 'short' WHEN noise > 3e-1 THEN 'noise' WHEN met < 2 THEN 'thin' ELSE 'valid' END AS verdict,
  round(CASE WHEN regexp_like(x, r'^\s*$') THEN 0e0 WHEN n < 30 THEN 3e-1 WHEN noise > 3e-1 THEN 1e0 - noise WHEN met < 2 THEN 4e-1 ELSE least(1e0, 5e-1 + met * 5e-2 + (1e0 - noise) * 4e-1) END, 6) AS confidence FROM s"""

_CODE = r"regexp_like(x, r'(?m)^\s*(import|from)\s+[A-Za-z0-9_]+|^\s*(def |class )[A-Za-z0-9_]+|urlpatterns|INSTALLED_APPS|DATABASES|<[a-zA-Z][^>]+>|\{\{.*?\}\}|\{%.*?%\}|^\s*(pip|npm|git)\s+')".replace(r"\{\{", r"[{][{]").replace(r"\}\}", "[}][}]").replace(r"\{%", "[{]%").replace(r"%\}", "%[}]")
#: concepts: id, name, definition, text
OPERATORS["concept_verdicts"] = rf"""
WITH b AS (SELECT id, coalesce(name, '') AS name, coalesce(definition, '') AS d, coalesce(text, '') AS x, size(regexp_extract_all(coalesce(text, ''), r'[^\s]+', 0)) AS n, size(regexp_extract_all(coalesce(text, ''), r'[A-Za-z]+', 0)) AS ws,
  length(regexp_sub(coalesce(text, ''), r'[^A-Za-z]', '', 'g')) AS letters, size(regexp_extract_all(coalesce(text, ''), r'https?://', 0)) AS urls, size(regexp_extract_all(coalesce(text, ''), r'[.!?]', 0)) AS ends FROM {{concepts}}),
s AS (SELECT *, greatest(2e-1, least(98e-2, round(6e-1 + CASE WHEN n BETWEEN 80 AND 350 THEN 15e-2 ELSE 0e0 END + CASE WHEN d <> '' THEN 15e-2 ELSE 0e0 END + CASE WHEN ends >= 3 THEN 1e-1 ELSE 0e0 END
    - CASE WHEN regexp_like(x, r'import\s+[A-Za-z0-9_]+|def\s+[A-Za-z0-9_]+\(|<html|urlpatterns') THEN 4e-1 ELSE 0e0 END, 2))) AS confidence,
  {_CODE} OR (ws > 20 AND letters / CAST(ws AS DOUBLE) < 35e-1) AS noise, regexp_like(name, r'(?i)^\s*(MODULE|CHAPTER|UNIT|SECTION)\s*[0-9]+') AND n < 80 OR (size(regexp_extract_all(name, r'[^\s]+', 0)) <= 4 AND name = upper(name) AND name <> lower(name) AND n < 60) AS header FROM b),
v AS (SELECT *, round(confidence + CASE WHEN n < 40 THEN -3e-1 ELSE 5e-2 END - CASE WHEN length(trim(d)) < 30 THEN 15e-2 ELSE 0e0 END - CASE WHEN noise THEN 5e-1 ELSE 0e0 END - CASE WHEN urls >= 2 THEN 3e-1 ELSE 0e0 END - CASE WHEN header THEN 5e-1 ELSE 0e0 END, 2) AS raw,
  n >= 40 AND length(trim(d)) >= 30 AND NOT noise AND urls < 2 AND NOT header AS plain FROM s),
f AS (SELECT *, greatest(5e-2, least(98e-2, raw)) AS score FROM v)
SELECT id, confidence, score, NOT noise AND NOT header AND score >= 45e-2 AND (plain OR score >= 55e-2) AS valid FROM f"""

#: asked: id, text, evidence, level, marks, needs_figure
OPERATORS["critic"] = r"""
WITH b AS (SELECT id, coalesce(text, '') AS x, lower(coalesce(evidence, '')) AS e, array_distinct(transform(filter(regexp_extract_all(coalesce(text, ''), r'[\p{L}\p{N}_]+', 0), w -> regexp_like(w, r'^[A-Z][a-zA-Z]{3,}$')), w -> lower(w))) AS nouns,
  filter(regexp_extract_all(coalesce(text, ''), r'[\p{L}\p{N}_]+', 0), w -> regexp_like(w, r'^[A-Z][A-Z][a-zA-Z]+$') AND length(w) > 3) AS names, size(regexp_extract_all(coalesce(text, ''), r'[^\s]+', 0)) AS n,
  size(regexp_extract_all(coalesce(text, ''), r'[\p{L}\p{N}\p{P}\p{Z}]', 0)) / CAST(greatest(length(text), 1) AS DOUBLE) AS printable FROM {asked}),
s AS (SELECT *, size(filter(nouns, w -> contains(e, w))) / CAST(greatest(size(nouns), 1) AS DOUBLE) AS coverage, size(filter(names, w -> NOT contains(e, lower(w)))) AS unknown FROM b)
SELECT id, CASE WHEN printable < 9e-1 OR regexp_like(x, r'[\x00-\x1f\x7f]') OR regexp_like(x, r'\$[A-Za-z0-9+/]{6,}') THEN 'RC-11' WHEN n < 8 THEN 'RC-08' WHEN e = '' THEN 'RC-12' WHEN size(nouns) > 0 AND coverage < 5e-1 THEN 'RC-12'
  WHEN unknown > 2 THEN 'RC-05' ELSE 'PASS' END AS code FROM s"""

OPERATORS["marks_gate"] = r"""
WITH b AS (SELECT id, marks, size(regexp_extract_all(coalesce(text, ''), r'[^\s]+', 0)) AS n, CAST(nullif(regexp_extract(coalesce(text, ''), r'(?i)([0-9]{1,6})\s*marks?', 1), '') AS INT) AS said,
  regexp_like(coalesce(text, ''), r'(?i)figure|diagram|given|shown|above|refer') AS figure, needs_figure FROM {asked}),
r AS (SELECT *, CASE marks WHEN 5 THEN 10 WHEN 10 THEN 15 WHEN 2 THEN 6 WHEN 6 THEN 12 WHEN 8 THEN 14 ELSE 10 END AS low, CASE marks WHEN 5 THEN 50 WHEN 10 THEN 70 WHEN 2 THEN 30 WHEN 6 THEN 55 WHEN 8 THEN 65 ELSE 70 END AS high FROM b)
SELECT id, CASE WHEN said <> marks THEN 4e-1 WHEN n < low - 5 THEN 5e-1 WHEN n > high + 40 THEN 6e-1 ELSE 95e-2 END AS marks_score, coalesce(said = marks, TRUE) AND n >= low - 5 AND n <= high + 40 AS marks_passed,
  CASE WHEN needs_figure AND figure THEN 98e-2 WHEN needs_figure THEN 3e-1 WHEN figure THEN 85e-2 ELSE 95e-2 END AS figure_score, figure OR NOT needs_figure AS figure_passed FROM r"""

#: gates: id, gate, score, passed
OPERATORS["final_audit"] = """
SELECT id, bool_and(passed) AND avg(score) >= 6e-1 AS passed, round(CASE WHEN count_if(gate IN ('semantic', 'grounding') AND NOT passed) > 0 THEN 35e-2 ELSE avg(score) END, 6) AS score, round(min(score), 6) AS confidence FROM {gates} GROUP BY id"""

_BY_LEVEL = (
    ("L1_Remember", "list, name, identify, recall, state, define, label, match, memorize, recognize, select, write"), ("L2_Understand", "describe, explain, summarize, interpret, classify, compare, contrast, discuss, paraphrase, illustrate, outline"),
    ("L3_Apply", "apply, demonstrate, solve, use, implement, execute, operate, sketch, compute, prepare, calculate"), ("L4_Analyze", "analyze, analyse, differentiate, examine, investigate, categorize, deconstruct, diagram, distinguish"),
    ("L5_Evaluate", "evaluate, critique, judge, justify, assess, validate, argue, defend, prioritize, recommend"), ("L6_Create", "create, design, construct, develop, formulate, compose, devise, plan, propose, generate"),
)
_VERB = "CASE " + " ".join(f"WHEN regexp_like(s, r'<<b>>{w}<<e>>') THEN '{w}'" for _, ws in _BY_LEVEL for w in ws.split(", ")) + " END"
_VERB_LEVEL = "CASE " + " ".join(f"WHEN verb IN ({', '.join(repr(w) for w in ws.split(', '))}) THEN '{k}'" for k, ws in _BY_LEVEL) + " END"
OPERATORS["verb_of_question"] = rf"""
WITH b AS (SELECT id, regexp_sub(trim(regexp_extract(lower(coalesce(text, '')), r'^([^.]*)', 1)), r'^(with reference to|using the|for the given|given|in the context of) [^,]+,\s*', '', 'g') AS s FROM {{docs}}),
v AS (SELECT id, {_VERB} AS verb FROM b), l AS (SELECT id, verb, {_VERB_LEVEL} AS level FROM v)
SELECT id, verb, coalesce(level, 'L2_Understand') AS level, CASE WHEN level IS NULL THEN 5e-1 WHEN level = 'L2_Understand' THEN 1e0 ELSE 0e0 END AS confidence FROM l"""

_NAMED = (
    ("create", "design|create|develop|propose|formulate|plan|devise|build|derive|construct"), ("evaluate", "evaluate|justify|assess|argue|critique|judge|recommend|pros and cons|compare"),
    ("analyze", "analyze|examine|investigate|break down|compare and contrast|relate|why does|how does|differentiate|distinguish"), ("apply", "apply|solve|calculate|compute|determine|demonstrate|use|implement|find|show that|sketch|draw|algorithm"),
    ("understand", "explain|describe|discuss|summarize|interpret|classify|illustrate|elaborate|short note|architecture|working principle"), ("remember", "define|list|state|name|identify|recall|mention|enumerate|what is|who|when|where|write the|give the"),
)
OPERATORS["level_by_pattern"] = "SELECT id, CASE " + " ".join(f"WHEN regexp_like(coalesce(text, ''), r'(?i)<<b>>({p})<<e>>') THEN '{k}'" for k, p in _NAMED) + " ELSE 'understand' END AS level FROM {docs}"

OPERATORS["scan_confidence"] = r"""
SELECT id, size(regexp_extract_all(coalesce(text, ''), r'[^\s]+', 0)) AS words, CASE WHEN size(regexp_extract_all(coalesce(text, ''), r'[^\s]+', 0)) > 100 THEN 9e-1 ELSE 6e-1 END AS confidence FROM {docs}"""

#: pages: doc, text
OPERATORS["page_text_confidence"] = r"""
WITH w AS (SELECT doc, sum(size(regexp_extract_all(coalesce(text, ''), r'[^\s]+', 0))) / CAST(count(*) AS DOUBLE) AS words FROM {pages} GROUP BY doc)
SELECT doc, round(words, 4) AS words, CASE WHEN words > 150 THEN 95e-2 WHEN words > 80 THEN 8e-1 WHEN words > 30 THEN 55e-2 ELSE 25e-2 END AS confidence FROM w"""

_FIGURES = (
    ("block_diagram", r"block\s*diagram"), ("circuit_diagram", r"circuit\s*diagram|schematic|resistor|capacitor|transistor"), ("flowchart", r"flow\s*chart|flowchart|decision|process"),
    ("graph", r"<<b>>graph<<e>>|plot|axis|frequency|amplitude|time\s+slot"), ("table", r"<<b>>table<<e>>|row|column"), ("state_diagram", r"state\s*diagram|state\s*transition"),
    ("control_system", r"control\s*system|feedback|transfer\s*function"), ("memory_map", r"memory\s*map|address|register"),
)
OPERATORS["figure_types"] = "SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_like(coalesce(text, ''), r'(?i){p}') THEN '{k}' END" for k, p in _FIGURES) + ") AS types FROM {docs}"

OPERATORS["chunk_sizes"] = r"""
WITH n AS (SELECT id, size(regexp_extract_all(coalesce(text, ''), r'[^\s]+', 0)) AS words, regexp_like(coalesce(text, ''), r'[=∑∫√]') AS math FROM {docs}),
c AS (SELECT id, CASE WHEN math THEN 250 WHEN words > 100000 THEN 300 WHEN words < 5000 THEN 200 ELSE 300 END AS size FROM n)
SELECT id, size, greatest(20, CAST(floor(size / 10) AS INT)) AS overlap FROM c"""

OPERATORS["paragraph_questions"] = rf"""
WITH l AS (SELECT *, CAST(sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) AS INT) AS para FROM <<lines {{docs}} id>> x),
p AS (SELECT id, para, <<joined line ' ' line_no>> AS body FROM l WHERE line <> '' GROUP BY id, para)
SELECT id, para, md5(body) AS question FROM p WHERE contains(body, '?') OR {_any("lower(body)", "explain, describe, define, list, compare, discuss, derive, prove, calculate, solve, design, analyze, evaluate")}"""

#: answers: id, text, definition, point, application, algorithm, needs_figure
OPERATORS["answer_quality"] = r"""
SELECT id, round(least(1e0, CASE WHEN definition <> '' AND contains(text, substr(definition, 1, 40)) THEN 25e-2 ELSE 0e0 END + CASE WHEN size(regexp_extract_all(text, r'[^\s]+', 0)) >= 40 THEN 2e-1 ELSE 0e0 END
  + CASE WHEN point <> '' AND contains(text, substr(point, 1, 20)) THEN 2e-1 ELSE 0e0 END + CASE WHEN application <> '' AND contains(text, application) THEN 15e-2 ELSE 0e0 END
  + CASE WHEN algorithm <> '' AND contains(text, algorithm) THEN 1e-1 ELSE 0e0 END + CASE WHEN needs_figure AND contains(text, '[Diagram') THEN 1e-1 ELSE 0e0 END), 4) AS quality FROM {answers}"""

# -- similar texts ------------------------------------------------------------------------------
#: items, docs: id, text. The share of an item's 5-word shingles that a document holds, from a half up.
OPERATORS["contamination"] = r"""
WITH i AS (SELECT DISTINCT id, explode(SHINGLES) AS s FROM (SELECT id, regexp_extract_all(lower(coalesce(text, '')), r'[^\s]+', 0) AS ws FROM {items}) x),
n AS (SELECT id, count(*) AS n FROM i GROUP BY id),
d AS (SELECT DISTINCT id, s FROM (SELECT id, explode(SHINGLES) AS s FROM (SELECT id, regexp_extract_all(lower(coalesce(text, '')), r'[^\s]+', 0) AS ws FROM {docs}) x) y),
m AS (SELECT i.id AS item, d.id AS doc, count(*) AS met FROM i JOIN d ON i.s = d.s GROUP BY i.id, d.id)
SELECT m.item, m.doc, round(m.met / CAST(n.n AS DOUBLE), 4) AS share FROM m JOIN n ON m.item = n.id WHERE m.met * 2 >= n.n""".replace("SHINGLES", "<<shingles ws 5>>")

OPERATORS["novelty"] = r"""
WITH a AS (SELECT id, seq, array_distinct(regexp_extract_all(lower(coalesce(text, '')), r'[^\s]+', 0)) AS ws, grp FROM {questions}), w AS (SELECT id, seq, grp, size(ws) AS n, explode(ws) AS w FROM a),
m AS (SELECT x.id, y.id AS past, count(*) / CAST(max(x.n) AS DOUBLE) AS share FROM w x JOIN w y ON x.grp = y.grp AND x.w = y.w AND y.seq < x.seq GROUP BY x.id, y.id), b AS (SELECT id, max(share) AS most FROM m GROUP BY id)
SELECT a.id, round(1e0 - coalesce(b.most, 0e0), 4) AS novelty FROM a LEFT JOIN b ON a.id = b.id"""

# -- generation -----------------------------------------------------------------------------------
STYLES = (
    ("L1", "Define", 2, "Define {topic}."), ("L2", "Explain", 5, "Explain {topic} with a suitable example."), ("L3", "Apply", 10, "Apply {topic} to solve the given problem."),
    ("L4", "Compare", 10, "Compare {topic} with alternative approaches."), ("L5", "Evaluate", 15, "Evaluate the advantages and limitations of {topic}."), ("L6", "Design", 15, "Design a solution using {topic}."),
)
_STYLE = lambda k: " ".join(f"WHEN {i} THEN '{x[k]}'" if k != 2 else f"WHEN {i} THEN {x[k]}" for i, x in enumerate(STYLES, 1))
#: topics: topic, has_figure. Six questions by level, one for each of three marks, one on the figure.
OPERATORS["topic_samples"] = f"""
WITH l AS (SELECT topic, has_figure, explode(sequence(1, 6)) AS k FROM {{topics}}), m AS (SELECT topic, explode(sequence(1, 3)) AS k FROM {{topics}})
SELECT topic, 'knowledge_to_question' AS kind, CASE k {_STYLE(0)} END AS level, CASE k {_STYLE(2)} END AS marks, replace(CASE k {_STYLE(3)} END, '<topic>', topic) AS question FROM l
UNION ALL SELECT topic, 'knowledge_to_bloom' AS kind, CASE k {_STYLE(0)} END AS level, NULL AS marks, 'Explain ' || topic || '.' AS question FROM l
UNION ALL SELECT topic, 'knowledge_to_marks' AS kind, NULL AS level, 5 * k AS marks, 'Explain ' || topic || '.' AS question FROM m
UNION ALL SELECT topic, 'knowledge_to_answer' AS kind, 'L2' AS level, 10 AS marks, 'Explain ' || topic || '.' AS question FROM {{topics}}
UNION ALL SELECT topic, 'diagram_to_question' AS kind, 'L3' AS level, 10 AS marks, 'Draw and explain the diagram for ' || topic || '.' AS question FROM {{topics}} WHERE has_figure""".replace("{topic}", "<topic>")

#: modules: subject, module, chunks. Level, verb and split of marks go round by the module's place among those with chunks.
OPERATORS["question_plan"] = """
WITH r AS (SELECT subject, module, row_number() OVER (PARTITION BY subject ORDER BY module) - 1 AS i, chunks FROM {modules})
SELECT subject, module, CAST(i AS INT) AS place, CASE i % 4 WHEN 0 THEN 'L2' WHEN 1 THEN 'L3' WHEN 2 THEN 'L2' ELSE 'L4' END AS level, CASE i % 3 WHEN 0 THEN 'Explain' WHEN 1 THEN 'Describe' ELSE 'Discuss' END AS verb,
  CASE i % 2 WHEN 0 THEN '10' ELSE '5,5' END AS split FROM r WHERE chunks > 0"""

#: papers: paper, kind (IA or SEE). IA: two questions of 10 + 10; SEE: for each of five modules two of 7 + 6 + 7.
OPERATORS["paper_template"] = """
WITH q AS (SELECT paper, kind, explode(sequence(1, CASE WHEN kind = 'IA' THEN 2 ELSE 10 END)) AS mq FROM {papers}),
p AS (SELECT paper, kind, mq, explode(sequence(1, CASE WHEN kind = 'IA' THEN 2 ELSE 3 END)) AS part FROM q)
SELECT paper, CAST(mq AS INT) AS mq, CAST(part AS INT) AS part, CASE WHEN kind = 'IA' THEN 10 WHEN part = 2 THEN 6 ELSE 7 END AS marks, CASE WHEN kind = 'IA' THEN 1 ELSE CAST(floor((mq + 1) / 2) AS INT) END AS module FROM p"""

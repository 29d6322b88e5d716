"""The lexical index and its ranking as SQL, step by step, for another engine."""

from __future__ import annotations

from collections.abc import Iterable

from ..functions import lexical, stemmer


def _quoted(names: Iterable[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _suffixes(table: dict[str, tuple[str, str]]) -> str:
    """A CASE over suffixes, the longest first: (condition, what it becomes)."""
    arms = [f"WHEN ends_with(x, '{s}') THEN CASE WHEN {when} THEN substr(x, 1, length(x) - {len(s)}) || '{to}' ELSE x END" for s, (when, to) in sorted(table.items(), key=lambda i: -len(i[0]))]
    return f"CASE {' '.join(arms)} ELSE x END"


def _cut(n: int) -> str:
    return f"substr(x, 1, length(x) - {n})"


def _after(text: str) -> str:
    return f"coalesce(nullif(length(regexp_extract({text}, '^{stemmer.REGION}')), 0), length({text}))"


def stems_sql(words: str = "all_words") -> str:
    """Common table expressions from a relation (w) of distinct words up to
    lexemes (w, stem); stop words are not in it."""
    starts = " ".join(f"WHEN starts_with(x, '{s}') THEN {len(s)}" for s in stemmer.STARTS)
    inside = lambda region, suffix, more="": f"length(x) - {len(suffix)} >= {region}{more}"
    before = lambda suffix, letters: f" AND substr(x, length(x) - {len(suffix)}, 1) IN ({_quoted(letters)})"
    derived = {s: (inside("r1", s, before(s, stemmer.LI_ENDINGS) if s == "li" else before(s, "l") if s == "ogi" else ""), to) for s, to in stemmer.DERIVED.items()}
    shortened = {s: (inside("r2" if s == "ative" else "r1", s), to) for s, to in stemmer.SHORTENED.items()}
    dropped = {s: (inside("r2", s, before(s, "st") if s == "ion" else ""), "") for s in stemmer.DROPPED}
    whole = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in stemmer.WHOLE_WORDS.items())
    return f"""marked AS (SELECT w, regexp_replace(CASE WHEN starts_with(w, 'y') THEN 'Y' || substr(w, 2) ELSE w END, '([aeiouy])y', '\\1Y', 'g') AS x FROM {words}),
region_1 AS (SELECT *, CASE {starts} ELSE {_after('x')} END AS r1 FROM marked),
region_2 AS (SELECT *, r1 + {_after('substr(x, r1 + 1)')} AS r2 FROM region_1),
plural AS (SELECT w, r1, r2, CASE WHEN ends_with(x, 'sses') THEN {_cut(2)} WHEN ends_with(x, 'ied') OR ends_with(x, 'ies') THEN CASE WHEN length(x) > 4 THEN {_cut(2)} ELSE {_cut(1)} END WHEN ends_with(x, 'us') OR ends_with(x, 'ss') THEN x WHEN regexp_matches(x, '[aeiouy].+s$') THEN {_cut(1)} ELSE x END AS x FROM region_2),
ended AS (SELECT *, x IN ({_quoted(stemmer.SETTLED)}) AS settled, regexp_extract(x, '(eedly|eed|ingly|edly|ing|ed)$', 1) AS e FROM plural),
base AS (SELECT *, substr(x, 1, length(x) - length(e)) AS b FROM ended),
tense AS (SELECT w, r1, r2, settled, CASE WHEN settled OR e = '' THEN x
  WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE x END
  WHEN NOT regexp_matches(b, '[aeiouy]') THEN x
  WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
  WHEN regexp_matches(b, '({"|".join(stemmer.DOUBLES)})$') THEN substr(b, 1, length(b) - 1)
  WHEN length(b) = r1 AND regexp_matches(b, '{stemmer.SHORT_SYLLABLE}') THEN b || 'e' ELSE b END AS x FROM base),
ended_y AS (SELECT w, r1, r2, settled, CASE WHEN NOT settled AND length(x) > 2 THEN regexp_replace(x, '([^aeiouy])[yY]$', '\\1i') ELSE x END AS x FROM tense),
derived AS (SELECT w, r1, r2, settled, CASE WHEN settled THEN x ELSE {_suffixes(derived)} END AS x FROM ended_y),
shortened AS (SELECT w, r1, r2, settled, CASE WHEN settled THEN x ELSE {_suffixes(shortened)} END AS x FROM derived),
dropped AS (SELECT w, r1, r2, settled, CASE WHEN settled THEN x ELSE {_suffixes(dropped)} END AS x FROM shortened),
final AS (SELECT w, CASE WHEN settled THEN x WHEN ends_with(x, 'e') AND (length(x) - 1 >= r2 OR (length(x) - 1 >= r1 AND NOT regexp_matches({_cut(1)}, '{stemmer.SHORT_SYLLABLE}'))) OR ends_with(x, 'll') AND length(x) - 1 >= r2 THEN {_cut(1)} ELSE x END AS x FROM dropped),
lexemes AS (SELECT w, CASE WHEN length(w) <= 2 OR regexp_matches(w, '\\pN') THEN w ELSE CASE w {whole} ELSE replace(x, 'Y', 'y') END END AS stem FROM final WHERE w NOT IN ({_quoted(lexical.STOP)}))"""


def places_sql(source: str) -> str:
    """Common table expressions up to places (id, stem, pos) of a source with
    id and content."""
    return f"""cut AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\\pL\\pN]+'), lambda w: w <> '') AS ws FROM {source}),
numbered AS (SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM cut),
all_words AS (SELECT DISTINCT w FROM numbered),
{stems_sql()},
places AS (SELECT id, stem, pos FROM numbered JOIN lexemes USING (w))"""


def _phrase(stems: list[str]) -> str:
    joins = " ".join(f"JOIN places b{k} ON b{k}.id = a.id AND b{k}.stem = '{s}' AND b{k}.pos = a.pos + {k}" for k, s in enumerate(stems[1:], 1))
    return f"id IN (SELECT a.id FROM places a {joins} WHERE a.stem = '{stems[0]}')"


def matched_sql(source: str, matching: str, stems: list[str], near: bool) -> str:
    """Common table expressions up to matched (id, lexical). In ``matching``
    {{word}} says that a stem occurs, [[two words]] that they stand in this order."""
    import re

    where = re.sub(r"\[\[(.*?)\]\]", lambda m: _phrase(m[1].split()), re.sub(r"\{\{(.*?)\}\}", r"list_contains(stems, '\1')", matching))
    if near:
        ranked = """paired AS (SELECT a.id, 1 - exp(sum(ln(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)))))) AS r FROM wanted a JOIN wanted b ON a.id = b.id AND a.stem < b.stem AND abs(a.pos - b.pos) BETWEEN 1 AND 100 GROUP BY a.id),
ranks AS (SELECT id, coalesce(r, CASE WHEN len(stems) > 1 THEN 1e-16 ELSE 1e-20 END) AS r FROM held LEFT JOIN paired USING (id))"""
    else:
        ranked = f"""times AS (SELECT id, stem, count(*) AS n FROM wanted GROUP BY id, stem),
ranks AS (SELECT id, sum(0.1 * list_sum(list_transform(range(1, n + 1), lambda k: 1.0 / (k * k))) / 1.64493406685) / {len(stems)} AS r FROM times GROUP BY id)"""
    return f"""{places_sql(source)},
wanted AS MATERIALIZED (SELECT * FROM places WHERE stem IN ({_quoted(stems)})),
held AS (SELECT id, list(DISTINCT stem) AS stems FROM wanted GROUP BY id),
{ranked},
matched AS (SELECT id, r AS lexical FROM held JOIN ranks USING (id) WHERE {where})"""

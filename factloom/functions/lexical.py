"""Lexical search: words, stems, queries as people type them, and a ranking by
how often and how near to each other their words stand.

A text's words are its runs of letters and digits in lower case, numbered from
1; English stop words go but keep their number, words of letters are cut back
to their stem. In a query words are joined by and, which binds closer than
``or``; "quoted words" stand in this order, as do the parts of a word like
``a.b``; ``-`` before either means that it does not occur.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemmer import stem

# Common English words that carry no subject.
STOP = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves"
).split()
_STOP = frozenset(STOP)
_WORD, _PART = re.compile(r"[^\W_]+"), re.compile(r'(-?)"([^"]*)"|(\S+)')

# Fixed values of the ranking: the weight of a place in a text, the sum of all
# 1 / n², the farthest that two places are called near, and the curve between.
WEIGHT, ALL_SQUARES, FAR = 0.1, 1.64493406685, 100
LEAST_PAIR, LEAST = 1e-16, 1e-20


@lru_cache(maxsize=1 << 18)
def lexeme(word: str) -> str | None:
    """What a word in lower case is indexed as: nothing if it is a stop word,
    itself if it has a digit, else its stem."""
    return None if word in _STOP else stem(word) if word.isalpha() else word


def words(text: str | Column) -> Column:
    """The words of a text in order, stop words too."""
    return F.array_remove(F.split(F.lower(F.col(text) if isinstance(text, str) else text), r"[^\p{L}\p{N}]+"), "")


@dataclass(frozen=True)
class Term:
    """Stems and their places from the first one on; whether they must not occur."""

    stems: tuple[tuple[str, int], ...]
    negated: bool = False


@dataclass(frozen=True)
class Query:
    alternatives: tuple[tuple[Term, ...], ...]

    @property
    def stems(self) -> list[str]:
        return sorted({s for terms in self.alternatives for t in terms for s, _ in t.stems})

    @property
    def by_nearness(self) -> bool:
        """Whether words that stand near each other count, or each by itself."""
        if len(self.alternatives) != 1 or len(self.stems) < 2:
            return False
        terms = self.alternatives[0]
        return len(terms) > 1 or not terms[0].negated and len(terms[0].stems) > 1

    @property
    def open_ended(self) -> bool:
        """Whether a text with none of the words can match."""
        return any(all(t.negated for t in terms) for terms in self.alternatives)


def parse_query(text: str) -> Query:
    """Terms without an indexed word are left out, as are empty alternatives."""
    alternatives: list[list[Term]] = [[]]
    for m in _PART.finditer(text):
        if m[3] and m[3].lower() == "or":
            alternatives.append([])
            continue
        found = [(lexeme(w), k) for k, w in enumerate(_WORD.findall((m[3] or m[2] or "").lower()))]
        kept = [(s, k) for s, k in found if s is not None]
        if kept:
            term = Term(tuple((s, k - kept[0][1]) for s, k in kept), (m[3] or m[1]).startswith("-"))
            alternatives[-1].append(term)
    return Query(tuple(tuple(terms) for terms in alternatives if terms))


def _occurs(term: Term, at: dict[str, str]) -> str:
    (first, _), *rest = term.stems
    there = " AND ".join(f"{at[s]} IS NOT NULL" for s, _ in term.stems)
    if not rest:
        return there
    follows = " AND ".join(f"array_contains({at[s]}, p + {k})" for s, k in rest)
    return f"{there} AND exists({at[first]}, p -> {follows})"


def matches(query: Query, at: dict[str, str]) -> Column:
    """at: the column with the places of each stem in a text, null where it has none."""
    one = lambda t: f"{'NOT ' * t.negated}coalesce({_occurs(t, at)}, false)"
    return F.expr(" OR ".join(f"({' AND '.join(map(one, terms))})" for terms in query.alternatives))


#: Of two places next to each other.
NEXT = WEIGHT * math.sqrt(1 / (1.005 + 0.05 * math.exp(1 / 1.5 - 2)))


def _separate(query: Query, times: dict[str, str]) -> str:
    """Each stem by 1 + 1/4 + 1/9 + ... + 1/n² of its n places."""
    squares = "aggregate(sequence(1, {0}), 0D, (s, k) -> s + 1D / (double(k) * k))"
    each = [f"if({times[s]} > 0, {WEIGHT}D * {squares.format(times[s])} / {ALL_SQUARES}D, 0D)" for s in query.stems]
    return f"({' + '.join(each)}) / {len(each)}"


def rank(query: Query, at: dict[str, str]) -> Column:
    """How well a text that matches does: between 0 and 1.

    Where all words must occur, each two places of different words at most
    ``FAR`` apart add to it by their distance; else each word adds by how often
    it occurs. Words that must not occur count among the words.
    """
    stems = query.stems
    if not query.by_nearness:
        return F.expr(_separate(query, {s: f"coalesce(size({at[s]}), 0)" for s in stems}))
    # The product over near pairs of what each leaves of 1.
    left = f"1 - {WEIGHT}D * sqrt(1 / (1.005D + 0.05D * exp(abs(y - x) / 1.5D - 2)))"
    apart = "coalesce(aggregate({0}, 1D, (s, x) -> s * aggregate(filter({1}, y -> y <> x AND abs(y - x) <= {far}), 1D, (t, y) -> t * ({left}))), 1D)"
    product = " * ".join(apart.format(at[a], at[b], far=FAR, left=left) for k, a in enumerate(stems) for b in stems[k + 1 :])
    there = " + ".join(f"int({at[s]} IS NOT NULL)" for s in stems)
    return F.expr(f"transform(array({product}), r -> CASE WHEN r < 1 THEN 1 - r WHEN {there} > 1 THEN {LEAST_PAIR}D ELSE {LEAST}D END)[0]")


def bound(query: Query, most: dict[str, str]) -> Column:
    """No text with at most so many places of each stem (null: none) ranks higher."""
    times, stems = {s: f"coalesce({most[s]}, 0)" for s in query.stems}, query.stems
    if not query.by_nearness:
        return F.expr(_separate(query, times))
    pairs = " + ".join(f"double({times[a]}) * {times[b]}" for k, a in enumerate(stems) for b in stems[k + 1 :])
    return F.expr(f"greatest(1 - pow({1 - NEXT}D, {pairs}), {LEAST_PAIR}D)")


def can_match(query: Query, most: dict[str, str]) -> Column:
    """Whether a block can hold a text that matches: all stems of the positive
    terms of one alternative are in it."""
    sure = lambda terms: " AND ".join(["true", *(f"{most[s]} IS NOT NULL" for t in terms if not t.negated for s, _ in t.stems)])
    return F.expr(" OR ".join(f"({sure(terms)})" for terms in query.alternatives))


def crude_places(text: str, wanted: Sequence[str]) -> dict[str, list[int]]:
    """Of one text, the places of each wanted stem: the index by hand."""
    found = [lexeme(w) for w in _WORD.findall(text.lower())]
    return {s: [k + 1 for k, x in enumerate(found) if x == s] for s in wanted}

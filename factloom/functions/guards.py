"""What may be collapsed, keys of the registry, namespaces, dates in texts."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(f: Callable, kind: str, *columns: str | Column) -> Column:
    run = F.pandas_udf(lambda *series: pd.Series([f(*row) for row in zip(*series, strict=True)], dtype=object), kind)
    return run(*[F.col(c) if isinstance(c, str) else c for c in columns])


# ---- May two near-equal facts be collapsed into one? ----

EDGES = ".,;:!?\"'()[]{}“”‘’"
# Words that negate.
NEGATIONS = frozenset("not no none never neither nor cannot without nothing nobody nowhere lacks lacking absent removed unset".split())


def _identifier(token: str) -> bool:
    if len(token.encode()) < 2:
        return False
    if re.search(r"[@/\\]", token) or any(a.isalnum() and c.isalnum() for a, b, c in zip(token, token[1:], token[2:], strict=False) if b in ".:_"):
        return True
    if re.search(r"[0-9]", token) and any(c.isalpha() for c in token):
        return True
    return all(c.isupper() or c == "-" for c in token) and any(c.isalpha() for c in token)


def fingerprint(text: str) -> tuple[list[str], list[str], int]:
    """What must agree: digit runs, identifiers and the number of negations, in order."""
    tokens = [t.strip(EDGES) for t in text.split()]
    plain = [re.sub("[’ʼ]", "'", t.lower()) for t in tokens]
    return re.findall("[0-9]+", text), [t.lower() for t in tokens if _identifier(t)], sum(t in NEGATIONS or t.endswith("n't") for t in plain)


def collapse_block(a: str | None, b: str | None) -> str | None:
    """Why two texts are not the same fact in other words, or None."""
    pairs = zip(("digits-differ", "identifiers-differ", "negation-differs"), fingerprint(a or ""), fingerprint(b or ""), strict=True)
    return next((why for why, x, y in pairs if x != y), None)


def collapse_blocks(a: str | Column, b: str | Column) -> Column:
    return _column(collapse_block, "string", a, b)


# ---- Namespaces ----

# The namespace grammar.
NAMESPACE = r"^(global|user:[a-z0-9][a-z0-9._-]{0,63}|project:[a-z0-9][a-z0-9._/-]{0,127}|personal:[a-z0-9][a-z0-9._-]{0,63}|credentials:[a-z0-9][a-z0-9._-]{0,63})$"


def namespace(raw: str | Column) -> Column:
    """The normal form, or null for what is no namespace."""
    n = F.lower(F.trim(F.col(raw) if isinstance(raw, str) else raw))
    return F.when(F.rlike(n, F.lit(NAMESPACE)), n)


def writable(n: Column) -> Column:
    """Of the user namespaces only the owner's own takes facts, and sealed
    credentials take none in the clear."""
    return ~F.startswith(n, F.lit("credentials:")) & (~F.startswith(n, F.lit("user:")) | (n == "user:me"))


def default_namespaces(project: str | None = None) -> list[str]:
    return ["user:me", "global", *([project] if project else [])]


# ---- Registry keys ----

# Domains, kinds, renamed domains, attributes and their domains.
DOMAINS = ["machines", "services", "credentials", "routes", "datasets", "people", "accounts"]
KINDS = ["host", "service", "credential-ref", "model-route", "dataset"]
DOMAIN_ALIASES = {
    "machine": "machines", "host": "machines", "hosts": "machines", "hardware": "machines", "server": "machines", "servers": "machines",
    "service": "services", "credential": "credentials", "credential-ref": "credentials", "creds": "credentials", "secret": "credentials", "secrets": "credentials",
    "route": "routes", "model-route": "routes", "dataset": "datasets", "data": "datasets", "person": "people", "account": "accounts",
}
ATTRIBUTE_DOMAINS = {
    "os": "machines", "gpu": "machines", "cpu": "machines", "ram": "machines", "disk": "machines", "arch": "machines", "kernel": "machines", "hostname": "machines",
    "endpoint": "services", "port": "services", "dsn": "services", "email": "people", "phone": "people",
}
ATTRIBUTES = "os gpu cpu ram disk arch kernel hostname host endpoint port dsn url email phone location path item model version region size key token owner id name".split()
REVIEW_DAYS = {"host": 365, "service": 180, "credential-ref": 90, "model-route": 30, "dataset": 180}
_SEGMENT = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


def normal_key(key: str) -> str:
    """Lower case; blanks and underscores separate segments where no dot does,
    else they join words; repeated separators count once."""
    key = key.strip()
    key = re.sub(r"[_\s]", "-" if "." in key else ".", key)
    key = "".join(c.lower() if c.isascii() else c for c in re.sub(r"\.+", ".", key))
    return ".".join(re.sub("-+", "-", s).strip("-") for s in key.split("."))


def key_fault(key: str) -> str | None:
    """Why a key is not canonical, or None."""
    if not key:
        return "empty"
    parts = key.split(".")
    if not 2 <= len(parts) <= 4:
        return "segments"
    if not all(_SEGMENT.fullmatch(s) for s in parts):
        return "characters"
    if parts[0] not in DOMAINS:
        return "domain"
    return "plural" if parts[-1][-1] == "s" and parts[-1][:-1] in ATTRIBUTES else None


def typo_distance(a: str, b: str) -> int:
    """Edits by insertion, removal, change or swap of neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            swap = rows[-2][j - 2] + 1 if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y else 1 << 30
            row.append(min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y), swap))
        rows.append(row)
    return rows[-1][-1]


def _domain(segment: str) -> str | None:
    if segment in DOMAIN_ALIASES:
        return DOMAIN_ALIASES[segment]
    near = [d for d in DOMAINS if typo_distance(segment, d) <= 1]
    return near[0] if len(near) == 1 else None


def suggest_key(key: str | None) -> str | None:
    """A canonical key that this one may have meant."""
    parts = normal_key(key or "").split(".")
    if not 2 <= len(parts) <= 4 or not all(_SEGMENT.fullmatch(s) for s in parts):
        return None
    if key_fault("machines." + parts[-1]) == "plural":
        parts[-1] = parts[-1][:-1]
    if parts[0] not in DOMAINS:
        if known := _domain(parts[0]):
            parts[0] = known
        elif (domain := ATTRIBUTE_DOMAINS.get(parts[-1])) is None:
            return None
        else:
            parts = [domain, *(parts if len(parts) == 2 else parts[1:])]
    return None if key_fault(made := ".".join(parts)) else made


def canonical_key(key: str | None) -> str | None:
    made = normal_key(key or "")
    return None if key_fault(made) else made


def canonical_kind(kind: str | None) -> str | None:
    made = re.sub("-+", "-", re.sub(r"[_\s]", "-", (kind or "").strip()).lower()).strip("-")
    return made if made in KINDS else made[:-1] if made.endswith("s") and made[:-1] in KINDS else None


def canonical_keys(key: str | Column) -> Column:
    return _column(canonical_key, "string", key)


def suggested_keys(key: str | Column) -> Column:
    return _column(suggest_key, "string", key)


def canonical_kinds(kind: str | Column) -> Column:
    return _column(canonical_kind, "string", kind)


# ---- Dates that a text states ----

MONTHS = "january february march april may june july august september october november december".split()


@lru_cache(maxsize=1 << 16)
def _month(word: str) -> int | None:
    w = re.sub(r"^[^a-z]+|[^a-z]+$", "", word.lower())
    return next((k for k, name in enumerate(MONTHS, 1) if w == name or len(w) == 3 and name.startswith(w)), None)


@lru_cache(maxsize=1 << 16)
def _number(word: str) -> int | None:
    m = re.fullmatch(r"[^0-9]*([0-9]+)[^0-9]*", word)
    return int(m[1]) if m else None


def _date(year: int | None, month: int | None, day: int | None) -> date | None:
    if None in (year, month, day) or not 1000 <= year <= 9999:
        return None
    try:
        return date(year, month, day)
    except ValueError:
        return None


@lru_cache(maxsize=1 << 16)
def _iso(word: str) -> date | None:
    bare = re.sub(r"^[^a-zA-Z0-9-]+|[^a-zA-Z0-9-]+$", "", word)
    iso = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", bare, re.ASCII)
    return _date(*map(int, iso.groups())) if iso else None


def dates_in(text: str | None) -> list[date]:
    """ISO dates, ``12 March 2024`` and ``March 12, 2024``, distinct, in order."""
    words, found = (text or "").split(), {}
    for a, b, c in zip(words, words[1:] + [""], words[2:] + ["", ""], strict=False):
        day = _iso(a)
        if not day and _month(b):
            day = _date(_number(c), _month(b), _number(a))
        if not day and _month(a):
            day = _date(_number(c), _month(a), _number(b))
        if day:
            found[day] = None
    return list(found)


def stated_dates(text: str | Column) -> Column:
    return _column(dates_in, "array<date>", text)

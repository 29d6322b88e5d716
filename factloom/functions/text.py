"""Text functions: normal forms, digests, tags, small parsers. All built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separators of composed keys.
UNIT_SEPARATOR = "\x1f"


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def collapse(text: str | Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(_c(text), r"\s+", " ")), r"\s+", " ")


def duplicate_key(namespace: str | Column, content: str | Column) -> Column:
    """Equal for facts of one namespace that differ in case and white space only."""
    return F.concat_ws(UNIT_SEPARATOR, _c(namespace), F.lower(collapse(content)))


def digest_form(text: str | Column) -> Column:
    return F.regexp_replace(F.lower(collapse(text)), r"[.!?,;:]+$", "")


def content_digest(text: str | Column) -> Column:
    return F.sha2(digest_form(text), 256)


def keyed_digest(text: str | Column, key: bytes) -> Column:
    """HMAC-SHA256 of the digest form, by the definition of HMAC over built-in
    hashes (RFC 2104): no Python, and the key is a literal of the plan."""
    block = (key if len(key) <= 64 else __import__("hashlib").sha256(key).digest()).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(digest_form(text), "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def dedupe_key(text: str | Column) -> Column:
    return F.regexp_replace(F.lower(collapse(text)), r"[.!;,]+$", "")


def cluster_key(kind: str | Column, ids: str | Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, kind, F.array_sort(F.array_distinct(_c(ids)))), 256)


def normal_tags(tags: str | Column) -> Column:
    return F.array_distinct(F.filter(F.transform(_c(tags), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def one_line(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def slug(text: str | Column, limit: int = 60) -> Column:
    dashed = F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, limit), r"-+$", "")


def preview(text: str | Column, limit: int = 140) -> Column:
    line = one_line(text)
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("…"))).otherwise(line)


def junk_rule(text: str | Column, least: int = 10, prompt: str | None = None) -> Column:
    """Why a candidate fact is junk, or null: no letters, too short, or an echo
    of the prompt that asked for it."""
    t = F.trim(_c(text))
    rule = F.when(~F.rlike(t, F.lit(r"\p{L}")), "no_letters").when(F.length(t) < least, "too_short")
    return rule.when(F.contains(dedupe_key(F.lit(prompt)), dedupe_key(t)), "prompt_echo") if prompt else rule


def parse_instant(text: str | Column) -> Column:
    """RFC 3339, or a date alone at midnight UTC; anything else is null."""
    t = F.trim(_c(text))
    dated = F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
    full = F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2})$"))
    return dated.otherwise(F.when(full, F.try_to_timestamp(F.upper(t))))


def parse_haystack_date(text: str | Column) -> Column:
    """``2023/05/20 (Sat) 02:21``."""
    bare = F.regexp_replace(F.trim(_c(text)), r"\s*\([^)]*\)\s*", " ")
    return F.when(F.rlike(bare, F.lit(r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}$")), F.try_to_timestamp(bare, F.lit("yyyy/MM/dd HH:mm")))


def review_key(text: str | Column) -> Column:
    """``conflict:a:b``, ``stale:id`` or ``proposal:origin:id`` as
    struct(source, first, second); null for anything else."""
    parts = F.split(_c(text), ":", -1)
    n = F.size(parts)
    whole = F.forall(parts, lambda p: p != "")
    form = F.struct(parts[0].alias("source"), F.get(parts, F.lit(1)).alias("first"), F.when(n > 2, F.get(parts, F.lit(2))).alias("second"))
    return F.when(whole & ((parts[0].isin("conflict", "proposal") & (n == 3)) | ((parts[0] == "stale") & (n == 2))), form)


def qualifies_for_auto(speaker: str | Column, content: str | Column, span: str | Column) -> Column:
    """The owner typed it, and the span says it in so many words."""
    return F.coalesce((_c(speaker) == "owner_typed") & F.contains(digest_form(span), digest_form(content)), F.lit(False))


def windows(text: str | Column, cap: int) -> Column:
    """A text cut into pieces of at most ``cap`` characters."""
    t = _c(text)
    pieces = F.floor((F.length(t) - 1) / cap)
    return F.when(F.length(t) == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), pieces), lambda k: F.substring(t, (k * cap + 1).cast("int"), F.lit(cap))))


def project_slug(path: str | Column) -> Column:
    """A project's name from the last part of its path, or null."""
    last = F.lower(F.regexp_extract(F.regexp_replace(F.trim(_c(path)), "/+$", ""), "([^/]*)$", 1))
    dashed = F.substring(F.regexp_replace(F.regexp_replace(last, r"[^a-z0-9._]+", "-"), "^-+|-+$", ""), 1, 127)
    return F.nullif(dashed, F.lit(""))


def supersession_end(start: Column, next_start: Column, next_created: Column) -> Column:
    """When a replaced fact stopped holding: null if that is not after its start."""
    until = F.coalesce(next_start, next_created)
    return F.when(start.isNull() | (until > start), until)


def inverted(start: Column, next_start: Column) -> Column:
    """A successor that became true before what it replaces is refused."""
    return F.coalesce(next_start < start, F.lit(False))

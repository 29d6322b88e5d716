r"""Secret scan: three base patterns and a battery of randomness tests.

Candidates of the battery are maximal runs of 16 or more of ``[A-Za-z0-9+/_=-]``
that mix letters with digits, or cases; a run with an inner ``=`` is cut there
(NAME=VALUE), and a part that no alphabet has whole, as it holds both one of
``+/`` and one of ``-_``, is cut at the former, at the latter and at both, and of
pieces that overlap the least text-like one stands. From its symbols a
candidate's encoding is inferred (hex, base32, base36, base62, base64) and with
it the size K of the alphabet. Three tests are made on the symbols' places:

* chi-squared uniformity. The statistic is linear in the share of equal pairs;
  tokens built of words have a share of about ``EQUAL`` (by case and length);
* runs: of symbols of one class (upper, lower, digit, other), which words and
  numbers make long, and above and below the alphabet's middle (Wald-Wolfowitz);
* serial correlation at lag 1.

The hypothesis that is rejected is 'built of words and numbers'. Its p-value
combines the equal pairs and the runs of classes by Fisher's method, with
Brown's correction for what the two have in common, and divides by a weight of
at most 1 that falls with the smallest p-value for randomness of all these
tests: what is patterned instead of worded can't be significant either. Where
one of several overlapping pieces was chosen its p-value counts as often as
there were pieces. Every candidate is a hypothesis, none is left out for its
figures. Benjamini and Hochberg's procedure at rate ``RATE`` is done in each
class of lengths on its own, over the candidates of all documents. It needs
only the counts of p-values in tenth-of-a-decade bins, which are at most
``len(LENGTHS) * BINS`` numbers; a bin counts as its upper edge.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, slices, written

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a greedy run of 24 or more is the whole run
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGNED, MIN_ACCESS = 6, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PART = re.compile(r"[^=]+=*")
_PIECES = [re.compile(x) for x in ("[A-Za-z0-9+/]{16,}", "[A-Za-z0-9_-]{16,}", "[A-Za-z0-9]{16,}")]
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
#: Keywords without which no base pattern but hex can match, in lower case.
_WORDS = (b"passw", b"secret", b"token", b"api", b"akia")
_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

LENGTHS = (16, 24, 32, 48, 64, 128)
BINS = 400
RATE = 0.01
#: The share of equal pairs in tokens of words, (limit, what short ones lack), by the size of the alphabet; and its spread, (scale, power).
EQUAL = {16: (0.085, 0.0), 32: (0.064, 0.33), 36: (0.064, 0.33), 62: (0.0395, 0.06), 64: (0.0395, 0.06)}
SPREAD = (0.105, -0.6)
#: How often the class of symbols changes in such tokens, of one case and of both.
CHANGES = {16: 0.2, 32: 0.2, 36: 0.2, 62: 0.4, 64: 0.4}
#: A p-value for randomness from which the weight is 1.
FAIR = 0.01

_ALPHABETS = [
    ("0123456789abcdef", 16),
    ("0123456789ABCDEF", 16),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32),
    ("0123456789abcdefghijklmnopqrstuvwxyz", 36),
    ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 36),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 62),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 64),
]
_PLACES = [({c: i for i, c in enumerate(a)}, k) for a, k in _ALPHABETS]


def infer(token: str) -> tuple[list[int], int] | None:
    """The symbols' places and the alphabet's size, in the first alphabet that has them all."""
    for places, size in _PLACES:
        if all(c in places for c in token):
            return [places[c] for c in token], size
    return None


def _tail(z: float) -> float:
    """P(Z > z) of a standard normal variable."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_z(x: float, mean: float, variance: float) -> float:
    """Wilson and Hilferty's normal score of a chi-squared-like variable of
    that mean and variance."""
    c = variance / (2 * mean)
    dof = mean / c
    return ((x / mean) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))


def _class(c: str) -> int:
    return 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if c.isdigit() else 3


#: How often the class changes in random symbols, by the size of the alphabet.
MIXED = {k: 1 - sum([_class(c) for c in a].count(kind) ** 2 for kind in range(4)) / k**2 for a, k in _ALPHABETS}


def _at_least(n: int, rate: float, k: int) -> float:
    """P(at least k of n) of a binomial variable."""
    if k <= 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(rate) + (n - j) * math.log1p(-rate) for j in range(k, min(n, k + 400) + 1)]
    return min(1.0, sum(map(math.exp, log)))


def _at_most(mean: float, k: int) -> float:
    """P(at most k) of a Poisson variable; only the last terms count."""
    return sum(math.exp(j * math.log(mean) - mean - math.lgamma(j + 1)) for j in range(max(0, k - 400), k + 1))


def _brown(first: float, second: float) -> float:
    """Fisher's combination of two p-values whose statistics go together: a
    chi-squared variable of 3 instead of 4 degrees, scaled to the same mean."""
    x = -1.5 * (math.log(max(first, 1e-300)) + math.log(max(second, 1e-300)))
    return min(1.0, math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2))


def battery(token: str) -> tuple[float, float] | None:
    """(smallest p-value for randomness of the three tests, p-value of the
    hypothesis that the token is built of words and numbers), or None for what
    is no candidate."""
    core = token.rstrip("=")
    classes = [_class(c) for c in core]
    digits, lower, upper = classes.count(2), classes.count(1), classes.count(0)
    if not (digits >= 2 and lower + upper >= 2 or lower >= 3 and upper >= 3) or (found := infer(core)) is None:
        return None
    places, K = found
    x = np.array(places)
    n = len(x)
    counts = np.bincount(x, minlength=K)
    squares = float((counts * counts).sum())
    chi2 = K * squares / n - n
    uniform = _tail(_chi2_z(chi2, K - 1, 2 * (K - 1) * (n - 1) / n))
    limit, lack = EQUAL[K]
    usual, equal = limit - lack / n, (squares - n) / (n * (n - 1))
    worded = 1 - _tail(_chi2_z(max(equal, 1e-9), usual, (SPREAD[0] * n ** SPREAD[1]) ** 2))
    worded = max(worded, _at_most(n * (n - 1) / 2 * usual, int(squares - n) // 2))  # few pairs are no continuous figure
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    often = MIXED[K]
    usually, around = (n - 1) * often, math.sqrt((n - 1) * often * (1 - often))
    changes_p = 2 * _tail(abs(changes - usually) / around)
    together = _at_least(n - 1, CHANGES[K], min(changes, int(usually + 2 * around)))  # more changes than random ones have tell no more
    high = x >= K / 2
    a, b = int(high.sum()), int(n - high.sum())
    if not a or not b:
        return 0.0, 1.0
    runs = 1 + int((high[1:] != high[:-1]).sum())
    expected, spread = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    runs_p = 2 * _tail(abs(runs - expected) / math.sqrt(spread)) if spread > 0 else 1.0
    c = x - x.mean()
    serial = float((c[1:] * c[:-1]).sum() / max(1e-9, (c * c).sum()))
    serial_p = 2 * _tail(abs(serial + 1 / (n - 1)) * math.sqrt(n))
    fair = min(uniform, runs_p, changes_p, serial_p)
    weight = max(1e-300, min(1.0, (fair / FAIR) ** 2))
    return fair, max(min(1.0, _brown(worded, together) / weight), 10.0 ** (-BINS / 10))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def parts(start: int, end: int, run: str) -> Iterator[list[tuple[int, int]]]:
    """The spans to be tested in each part of a run between inner ``=``; the
    run itself if it is one part that an alphabet may have."""
    for m in _PART.finditer(run):
        core = m[0].rstrip("=")
        if ("+" in core or "/" in core) and ("-" in core or "_" in core):
            yield sorted({(start + m.start() + x.start(), start + m.start() + x.end()) for piece in _PIECES for x in piece.finditer(core)})
            continue
        size = len(m[0] if start + m.end() == end else core)  # padding at the end of the run only
        if size >= 16:
            yield [(start + m.start(), start + m.start() + size)]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, class of length, bin of p) of candidates outside base spans,
    which come by their starts."""
    starts = [s for s, _, _ in spans]
    reach = list(accumulate((e for _, _, e in spans), max))
    found = []
    for m in CANDIDATE.finditer(text):
        for part in parts(*m.span(), m[0]):
            tested = []
            for start, end in part:
                k = bisect_right(starts, start)
                if k and reach[k - 1] >= end or (p := battery(text[start:end])) is None:
                    continue
                tested.append((min(1.0, p[1] * len(part)), start, end))
            taken: list[tuple[int, int, float]] = []
            for p, start, end in sorted(tested, key=lambda c: (c[0], c[1] - c[2], c[1])):
                k = bisect_right(taken, (start, end, 2.0))
                if (not k or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
                    taken.insert(k, (start, end, p))
            found += [(start, end, sum(end - start >= x for x in LENGTHS) - 1, int(-10 * math.log10(p))) for start, end, p in taken]
    return found


def _worth_reading(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of texts one after the other, which may have a base span or candidate."""
    n = len(starts) - 1
    ends = np.flatnonzero(np.diff(np.concatenate([[False], _RUN[data], [False]]).view(np.int8)))
    begin, end = ends[::2], ends[1::2]
    long = end - begin >= 16
    worth = np.zeros(n, bool)
    for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True):  # a run may go over into the next texts
        worth[max(0, np.searchsorted(starts, b, side="right") - 1) : np.searchsorted(starts, e, side="left")] = True
    low = data.tobytes().translate(_TO_LOWER)
    for word in _WORDS:
        at = low.find(word)
        while at >= 0:
            d = int(np.searchsorted(starts, at, side="right")) - 1
            worth[d] = True
            at = low.find(word, max(at + 1, int(starts[d + 1]) - len(word) + 1))
    return worth


def scan(texts: pa.Array) -> Iterator[tuple[list, list]]:
    """(base spans, candidates) of each text."""
    column = pc.fill_null(texts.cast(pa.large_string()), "")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data else np.zeros(0, np.uint8)
    for text, worth in zip(column, _worth_reading(data, starts - starts[0]), strict=True):
        if worth:
            spans = base_spans(t := text.as_py())
            yield spans, candidates(t, spans)
        else:
            yield [], []


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_FOUND = "array<struct<start:int,end:int,size:int,bin:int>>"


def found(docs: DataFrame) -> DataFrame:
    """doc_id, text -> (doc_id, base, random), the latter before false-discovery control."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        more = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("size", pa.int32()), ("bin", pa.int32())]))
        for batch in batches:
            for b in slices(batch):
                both = list(scan(b.column("text")))
                base = pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in x] for x, _ in both], spans)
                random = pa.array([[dict(zip(("start", "end", "size", "bin"), s, strict=True)) for s in x] for _, x in both], more)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), base, random], ["doc_id", "base", "random"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {_SPANS}, random {_FOUND}")


def thresholds(random: DataFrame) -> list[int]:
    """(random) -> the smallest bin that is significant, for each class of
    length; BINS + 1 where none is."""
    each = random.select(F.explode("random").alias("c")).groupBy("c.size", "c.bin").count().collect()
    counts = np.zeros((len(LENGTHS), BINS + 1), np.int64)
    for size, b, n in each:
        counts[size, b] += n
    found = []
    for row in counts:
        upto = row[::-1].cumsum()[::-1]  # in this bin or a smaller p
        ok = np.flatnonzero((row > 0) & (10.0 ** (-np.arange(BINS + 1) / 10) * row.sum() <= RATE * upto))
        found.append(int(ok[0]) if len(ok) else BINS + 1)
    return found


def significant(random: Column, least: list[int]) -> Column:
    return F.filter(random, lambda c: c.bin >= F.element_at(F.array(*map(F.lit, least)), c.size + 1))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start, s.end)), ",")


def op3(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans), one
    row per input row. Null and empty texts have no spans (base_sha256 is that
    of the empty text, spans is empty); a text of any length is scanned whole,
    in time that grows with it; repeated rows are scanned alike; null ids stay;
    other columns are ignored."""
    table = written(found(docs), "secrets")
    least = thresholds(table.select("random"))
    extra = F.transform(significant(F.col("random"), least), lambda c: F.struct(c.start.alias("start"), F.lit(3).alias("kind"), c.end.alias("end")))
    of = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return table.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.size(extra).cast("long").alias("n_random"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", extra)).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in its text replaced, of an assignment only the
    value, and n_chars, where there is one, set anew in rows that changed. All
    rows and columns stay. Two passes over the texts, no shuffle."""
    least = thresholds(found(docs).select("random"))
    (changed,) = fresh(docs, "changed")

    def clean(text: str, spans: list, more: list) -> str:
        cut = [(ASSIGN.match(text, s).start(2), e) if kind == 0 else (s, e) for s, kind, e in spans]
        cut += [(s, e) for s, e, size, b in more if b >= least[size]]
        parts, at = [], 0
        for s, e in sorted(cut):
            if s >= at:
                parts += [text[at:s], mark]
            at = max(at, e)
        return "".join([*parts, text[at:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for b in slices(batch):
                texts, hit = b.column(k).to_pylist(), np.zeros(b.num_rows, bool)
                for i, (spans, more) in enumerate(scan(b.column(k))):
                    if spans or more:
                        new = clean(texts[i], spans, more)
                        hit[i], texts[i] = new != texts[i], new
                columns = [*b.columns]
                columns[k] = pa.array(texts, b.schema.field(k).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hit)], [*b.schema.names, changed])

    done = docs.mapInArrow(run, docs.select("*", F.lit(True).alias(changed)).schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col(changed), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])

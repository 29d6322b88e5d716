"""Class-based bigram language model after Brown: a text is scored by the
transitions between the classes of its tokens and by each class's emission of
its words.

Words are counted over all training texts. Each of the ``UNITS`` most frequent
words is a unit of the clustering; all others share units by their last bytes.
Exchange clustering moves units between classes as long as the likelihood of
the class bigrams rises: Spark counts the bigrams of units and, after each
sweep, the classes that stand left and right of each unit; the moves are
decided on those counts, of which there are as many as units times classes,
whatever the corpus. Counts of the at most ``HEAD`` most frequent words go to
the tasks; those of all others meet their texts in a join.

Smoothing is absolute discounting: of transitions towards the shares of the
classes, of emissions towards one event for all unknown words of a class.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import crc_mod, drop_written, slices, wider, written

CLASSES = 64
UNITS = 4096
TAILS = 512
#: A word seen no more often has no unit of its own: what is seen once is what
#: the unknown is like.
RARE = 2
HEAD = 1 << 16
SWEEPS = 9
#: A sweep moves one unit in so many: what it moves by was counted before it.
SHARES = 3
#: A longer word is told by its SHA-256.
KEY_BYTES = 64
PIECE_BYTES = 1 << 20
#: Distinct words, or pairs, that a task counts before it hands them on.
MANY = 1 << 20
TRANSITION_DISCOUNT = 0.5
#: The key of the end of a text: no word is empty.
END = b""
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def key_of(word: bytes) -> bytes:
    return word if len(word) <= KEY_BYTES else hashlib.sha256(word).digest()


def tail_of(key: bytes) -> int:
    return zlib.crc32(key[-3:]) % TAILS


def tail_column(key: str) -> Column:
    return (F.crc32(F.substring(key, -3, 3)) % TAILS).cast("int")


class Places(dict):
    """Number of a word by its key; -1 for one that has none."""

    def __missing__(self, word: bytes) -> int:
        return self.get(key_of(word), -1) if len(word) > KEY_BYTES else -1


def tokens(texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The tokens of all texts in order, an end after each text, in runs of
    bounded size; with each run the text of each token."""
    run: list[bytes] = []
    of: list[tuple[int, int]] = []
    for d, text in enumerate(texts.cast(pa.large_binary())):
        whole = text.as_buffer() if text.is_valid else b""
        at, size = 0, len(whole)
        while at < size:
            end = min(at + PIECE_BYTES, size)
            found = SPACE.search(whole, end) if end < size else None
            end = found.start() if found else size
            piece = bytes(whole[at:end]).lower().split()
            run += piece
            of.append((d, len(piece)))
            at = end
            if end < size:
                yield run, np.repeat(*np.array(of, np.int64).T)
                run, of = [], []
        run.append(END)
        of.append((d, 1))
    if run:
        yield run, np.repeat(*np.array(of, np.int64).T)


def word_counts(texts: DataFrame) -> DataFrame:
    """text -> (key, n), written; the ends count as a word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()
        for batch in batches:
            for b in slices(batch):
                for words, _ in tokens(b.column("text")):
                    count.update(words)
                    if len(count) > MANY // 4:
                        yield handed(count)
        yield handed(count)

    def handed(count: Counter[bytes]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([key_of(w) for w in count], pa.binary()), pa.array(count.values(), pa.int64())], ["key", "n"])
        count.clear()
        return out

    return written(texts.mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-words")


@dataclass
class Vocabulary:
    total: int
    distinct: int
    discount: float
    head: list[bytes]  # the end first, then by falling count
    counts: np.ndarray  # of the head
    units: np.ndarray  # of the head
    tail_tokens: np.ndarray  # of each unit that words share
    tail_words: np.ndarray
    least: int  # a word of no smaller count is in the head


def vocabulary(words: DataFrame) -> Vocabulary:
    octave = F.floor(F.log2("n") * 8).cast("int")
    sizes = words.groupBy(octave.alias("octave")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).orderBy(F.col("octave").desc()).collect()
    total, distinct = sum(r.tokens for r in sizes), sum(r.words for r in sizes)
    once, twice = sum(r.once for r in sizes), sum(r.twice for r in sizes)
    discount = min(0.9, once / (once + 2 * twice)) if once else 0.5
    least, so_far = 1 << 62, 0
    for r in sizes:
        so_far += r.words
        if so_far > HEAD:
            break
        least = r.least
    top = words.filter((F.col("n") >= least) | (F.octet_length("key") == 0)).toArrow().to_pylist()
    ends = sum(r["n"] for r in top if r["key"] == END)
    top = sorted((r for r in top if r["key"] != END), key=lambda r: (-r["n"], r["key"]))
    head, counts = [END, *(r["key"] for r in top)], np.array([ends, *(r["n"] for r in top)])
    own = min(UNITS - 1, int((counts[1:] > RARE).sum()))
    tails = np.array([tail_of(k) for k in head])
    units = np.where(np.arange(len(head)) <= own, np.arange(len(head)), UNITS + tails)
    shared = {r.tail: r for r in words.groupBy(tail_column("key").alias("tail")).agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).collect()}
    apart = np.flatnonzero(units < UNITS)
    tail_tokens = np.array([shared[t].tokens if t in shared else 0 for t in range(TAILS)]) - np.bincount(tails[apart], counts[apart], TAILS).astype(np.int64)
    tail_words = np.array([shared[t].words if t in shared else 0 for t in range(TAILS)]) - np.bincount(tails[apart], counts[apart] > 0, TAILS).astype(np.int64)
    return Vocabulary(total, distinct, discount, head, counts, units, tail_tokens, tail_words, least)


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(codes, return_inverse=True)
    return codes, np.bincount(at, n, len(codes)).astype(np.int64)


def unit_bigrams(texts: DataFrame, v: Vocabulary) -> DataFrame:
    """text -> (code, n), written: pairs of following units, left times the
    number of units plus right. Before each text stands an end."""
    every, head, units = UNITS + TAILS, v.head, v.units.tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last = Places(zip(head, units, strict=True)), 0
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for b in slices(batch):
                for words, _ in tokens(b.column("text")):
                    unit = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                    for i in np.flatnonzero(unit < 0).tolist():
                        unit[i] = UNITS + tail_of(key_of(words[i]))
                    parts.append(_summed(np.concatenate([[last], unit[:-1]]) * every + unit, np.ones(len(unit))))
                    last = unit[-1]
                    if sum(len(c) for c, _ in parts) > 2 * MANY:
                        parts = [_summed(*map(np.concatenate, zip(*parts, strict=True)))]
                        if len(parts[0][0]) > MANY:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts.pop()], ["code", "n"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(*map(np.concatenate, zip(*parts, strict=True)))], ["code", "n"])

    return written(texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "lm-bigrams")


@dataclass
class Around:
    """Of each unit: tokens of each class right and left of it, and how often
    it follows itself."""

    right: np.ndarray
    left: np.ndarray
    itself: np.ndarray

    def matrix(self, classes: np.ndarray) -> np.ndarray:
        out = np.zeros((self.right.shape[1],) * 2)
        np.add.at(out, classes, self.right)
        return out


def around(bigrams: DataFrame, classes: np.ndarray, k: int = CLASSES) -> Around:
    every = len(classes)
    cells = every * 2 * k + every

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            code, n = (batch.column(c).to_numpy() for c in (0, 1))
            a, b = code // every, code % every
            total += np.bincount(a * 2 * k + classes[b], n, cells) + np.bincount(b * 2 * k + k + classes[a], n, cells) + np.bincount(every * 2 * k + a, n * (a == b), cells)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], ["cell", "n"])

    found = bigrams.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    flat = np.bincount(found["cell"].to_numpy(), found["n"].to_numpy(), cells) if found.num_rows else np.zeros(cells)
    sides = flat[: every * 2 * k].reshape(every, 2 * k)
    return Around(sides[:, :k], sides[:, k:], flat[every * 2 * k :])


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(m: np.ndarray) -> float:
    """Of the class bigrams, as far as it depends on the classes."""
    return float(_h(m).sum() - _h(m.sum(axis=1)).sum() - _h(m.sum(axis=0)).sum())


def exchange(seen: Around, classes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One sweep: each unit in this order goes to the class that gives the
    highest likelihood. Class 0 is the end's alone."""
    classes, m = classes.copy(), seen.matrix(classes)
    diagonal = np.arange(len(m))
    for u in order:
        a, s = classes[u], seen.itself[u]
        right, left = seen.right[u].copy(), seen.left[u].copy()
        right[a] -= s
        left[a] -= s
        m[a] -= right
        m[:, a] -= left
        m[a, a] -= s
        np.maximum(m, 0, out=m)
        grown, h = m + right, _h(m)
        both = _h(grown) - h
        across = _h(m + left[:, None]) - h
        own = _h(m[diagonal, diagonal] + right + left + s) - h[diagonal, diagonal]
        rows, columns = m.sum(axis=1), m.sum(axis=0)
        gain = both.sum(axis=1) - both[diagonal, diagonal] + across.sum(axis=0) - across[diagonal, diagonal] + own
        gain -= _h(rows + right.sum() + s) - _h(rows) + _h(columns + left.sum() + s) - _h(columns)
        gain[0] = -np.inf
        best = a if gain[a] >= gain.max() - 1e-9 else int(gain.argmax())
        m[best] += right
        m[:, best] += left
        m[best, best] += s
        classes[u] = best
    return classes


@dataclass
class Model:
    words: Vocabulary
    classes: np.ndarray  # of each unit
    transition: np.ndarray  # log10, from row to column
    class_tokens: np.ndarray
    class_words: np.ndarray

    def emission(self, n: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of the probability of a word seen n times, 0 if unknown, in its class."""
        mass = np.where(n > 0, n - self.words.discount, self.words.discount * self.class_words[c] + 1)
        return np.where(c == 0, 0.0, np.log10(mass / (self.class_tokens[c] + 1)))


def cluster(bigrams: DataFrame, v: Vocabulary, k: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, counts of class bigrams) of the sweep of the
    highest likelihood. Units never seen go where most rare words are."""
    size = np.zeros(UNITS + TAILS)
    np.add.at(size, v.units, np.where(v.units < UNITS, v.counts, 0))
    size[UNITS:] = v.tail_tokens
    order = np.argsort(-size, kind="stable")
    order = order[(order != 0) & (size[order] > 0)]
    classes = np.zeros(len(size), np.int64)
    classes[order] = 1 + np.arange(len(order)) % (k - 1)
    best, last = None, -np.inf
    for sweep in range(sweeps + 1):
        seen = around(bigrams, classes, k)
        m = seen.matrix(classes)
        value = likelihood(m)
        if value > last:
            best, last = (classes, m), value
        classes = exchange(seen, classes, order[sweep % SHARES :: SHARES])
    classes, m = best
    unseen = np.flatnonzero(size == 0)
    rare = np.bincount(classes[UNITS:], v.tail_tokens, k)
    rare[0] = -1
    classes[unseen[unseen > 0]] = rare.argmax()
    return classes, m


def model(v: Vocabulary, classes: np.ndarray, m: np.ndarray) -> Model:
    k, d = len(m), TRANSITION_DISCOUNT
    share = (m.sum(axis=0) + 1) / (m.sum() + k)
    before = np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
    smooth = np.where(m.sum(axis=1, keepdims=True) > 0, (np.maximum(m - d, 0) + d * (m > 0).sum(axis=1, keepdims=True) * share) / before, share)
    own = v.units < UNITS
    tokens_ = np.bincount(classes[v.units[own]], v.counts[own], k) + np.bincount(classes[UNITS:], v.tail_tokens, k)
    words = np.bincount(classes[v.units[own]], v.counts[own] > 0, k) + np.bincount(classes[UNITS:], v.tail_words, k)
    return Model(v, classes, np.log10(smooth), tokens_, words)


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the counts of all words. texts: a column text."""
    words = word_counts(texts)
    v = vocabulary(words)
    bigrams = unit_bigrams(texts, v)
    classes, m = cluster(bigrams, v)
    drop_written(texts.sparkSession, bigrams)
    return model(v, classes, m), words


def scored(docs: DataFrame, mod: Model, words: DataFrame) -> DataFrame:
    """docs: row, text and others. All columns but the text, and n_tokens,
    n_known, base_score and score."""
    v = mod.words
    head, counts, of_tail = v.head, v.counts, mod.classes[UNITS:]
    head_class = mod.classes[v.units]
    head_emits, head_base = mod.emission(counts, head_class), np.log10((counts + 1) / (v.total + v.distinct + 1))
    others = [c for c in docs.columns if c != "text"]
    schema = wider(docs.select(*others), n_tokens="long", known="long", base="double", log="double", keys="array<binary>", times="array<long>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last = Places(zip(head, range(len(head)), strict=True)), 0
        for batch in batches:
            for b in slices(batch):
                sums = np.zeros((4, b.num_rows))
                rest: dict[int, Counter[bytes]] = defaultdict(Counter)
                for found, doc in tokens(b.column("text")):
                    at = np.fromiter(map(place.__getitem__, found), np.int64, len(found))
                    there = at >= 0
                    c = np.where(there, head_class[at], 0)
                    for i in np.flatnonzero(~there).tolist():
                        key = key_of(found[i])
                        c[i] = of_tail[tail_of(key)]
                        rest[int(doc[i])][key] += 1
                    log = mod.transition[np.concatenate([[last], c[:-1]]), c] + np.where(there, head_emits[at], 0)
                    last = c[-1]
                    for k, x in enumerate((None, there & (counts[at] > 0), np.where(there, head_base[at], 0), log)):
                        sums[k] += np.bincount(doc, x, b.num_rows)
                keys = pa.array([list(rest[d]) if d in rest else [] for d in range(b.num_rows)], pa.list_(pa.binary()))
                times = pa.array([list(rest[d].values()) if d in rest else [] for d in range(b.num_rows)], pa.list_(pa.int64()))
                whole = [pa.array(x.astype(np.int64)) for x in sums[:2]]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), *whole, pa.array(sums[2]), pa.array(sums[3]), keys, times], schema.names)

    texts = written(docs.mapInArrow(run, schema), "lm-texts")
    # Words beyond the head: their counts meet them in a join, in any order.
    rare = texts.select("row", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("times").alias("times"))))
    c = F.element_at(F.array(*[F.lit(int(x)) for x in of_tail]), tail_column("key") + 1)
    of_class = lambda x: F.element_at(F.array(*[F.lit(float(y)) for y in x]), c + 1)
    mass = F.when(F.col("n").isNull(), of_class(v.discount * mod.class_words + 1)).otherwise(F.col("n") - v.discount)
    met = rare.join(words.filter(F.col("n") < v.least), "key", "left").select("row", "times", "n", (F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(v.total + v.distinct + 1)))).alias("rare_base"), (F.col("times") * F.log10(mass / of_class(mod.class_tokens + 1))).alias("rare_log"))
    summed = met.groupBy("row").agg(F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))), F.lit(0)).alias("rare_known"), F.sum("rare_base").alias("rare_base"), F.sum("rare_log").alias("rare_log"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return texts.drop("keys", "times").join(summed, "row", "left").select(*others, "n_tokens", plus("known", "rare_known").alias("n_known"), plus("base", "rare_base").alias("base_score"), plus("log", "rare_log").alias("score"))


def op13(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity), one row per input row.

    A null or empty text, or one of white space, is its end alone. A null id is
    neither learnt from nor held out; repeated ids and rows are rows of their
    own and are learnt from each time. Texts and words of any length are read
    whole. Where nothing can be learnt from, no token is known. An empty table
    gives no rows; other columns are ignored.
    """
    held_out = crc_mod("doc_id", 7) == 2
    mod, words = fit(docs.filter(~held_out).select("text"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    out = scored(rows, mod, words)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(mod.words.total)).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))

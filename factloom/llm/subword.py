"""Averaged hashed subword embeddings under a linear softmax, in numpy.

A word is the mean of the vectors of its hashed byte n-grams (and of itself),
an instance the mean of its words, and a linear softmax reads the class off
it. Embeddings and softmax are trained jointly by AdaGrad on mini-batches.
Because all of it is linear, a trained model is kept as one table of a logit
per bucket and class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BUCKETS = 1 << 17
SIZES = (3, 4, 5, 6)
DIM = 12
#: Words whose features are made at once.
PART = 1 << 15


@dataclass
class Words:
    """Texts as numbers: the distinct cleaned words, and for each text the
    words in order. Tokens that cleaning empties are left out."""

    vocabulary: list[str]
    ids: np.ndarray
    starts: np.ndarray  # of each text in ids, and the end of the last

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


def read_words(texts: pa.Array, keep: str) -> Words:
    """Lower-case, split at white space, and drop from each token whatever the
    character class ``keep`` leaves out. A null text has no words."""
    lists = pc.utf8_split_whitespace(pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    coded = pc.dictionary_encode(lists.flatten())
    clean = pc.dictionary_encode(pc.replace_substring_regex(coded.dictionary, f"[^{keep}]+", ""))
    ids = clean.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
    vocabulary = clean.dictionary.to_pylist()
    bounds = np.asarray(lists.offsets, np.int64)
    bounds = bounds - bounds[0]
    if "" in vocabulary:
        kept = ids != vocabulary.index("")
        bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
        ids = ids[kept]
    return Words(vocabulary, ids.astype(np.int64), bounds)


def features(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each feature of each word, as 32-bit numbers."""
    if not vocabulary:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    marked = [b"<%s>" % w.encode("utf-8", "surrogatepass") for w in vocabulary]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(marked), dtype=np.int32), size)
    place = np.arange(len(data)) - begin[word]
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    h = np.zeros(len(data), np.uint32)
    words, buckets = [], []
    for n in range(1, min(max(SIZES), len(data)) + 1):
        more = np.zeros(len(data), np.uint32)
        more[: len(data) - n + 1] = data[n - 1 :]
        h = h * np.uint32(16777619) ^ more
        if n in SIZES:
            ok = place + n <= size[word]
            words.append(word[ok])
            buckets.append(((h[ok] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> shift).astype(np.int32))
    power = np.ones(int(size.max()), np.uint32)
    np.multiply.accumulate(np.full(len(power) - 1, 0x01000193, np.uint32), out=power[1:])
    whole = np.add.reduceat(data * power[place], begin, dtype=np.uint32) * np.uint32(0xC2B2AE35)
    words.append(np.arange(len(marked), dtype=np.int32))
    buckets.append((whole >> shift).astype(np.int32))
    return np.concatenate(words), np.concatenate(buckets)


def _parts(vocabulary: list[str]) -> list[list[str]]:
    return [vocabulary[at : at + PART] for at in range(0, len(vocabulary), PART)]


def feature_table(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, bucket): a ragged table of the words' features."""
    starts, buckets = [np.zeros(1, np.int64)], []
    for part in _parts(vocabulary):
        word, bucket = features(part)
        buckets.append(bucket[np.argsort(word, kind="stable")])
        starts.append(starts[-1][-1] + np.cumsum(np.bincount(word, minlength=len(part))))
    return np.concatenate(starts), np.concatenate(buckets or [np.zeros(0, np.int32)])


def word_logits(vocabulary: list[str], table: np.ndarray) -> np.ndarray:
    """(word, class): the mean of the buckets' logits over each word's features."""
    found = [np.zeros((0, table.shape[1]))]
    for part in _parts(vocabulary):
        word, bucket = features(part)
        many = np.bincount(word, minlength=len(part))
        found.append(np.stack([np.bincount(word, table[bucket, k], minlength=len(part)) / many for k in range(table.shape[1])], axis=1))
    return np.concatenate(found)


def ragged(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of some rows of a ragged table, and their numbers."""
    many = starts[rows + 1] - starts[rows]
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[rows] - (ends - many), many), many


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(vocabulary: list[str], bags: list[np.ndarray], labels: np.ndarray, classes: int, *, epochs: int = 8, rate: float = 0.5, batch: int = 128, drop: float = 0.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(table of logits by bucket and class, bias). bags: word numbers of each
    instance, none empty. ``drop``: the share of features left out at random in
    each step, so that a word does not hang on a few of its n-grams."""
    used, in_bags = np.unique(np.concatenate(bags), return_inverse=True)
    word_starts, bucket = feature_table([vocabulary[k] for k in used.tolist()])
    bag_starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    W = rng.normal(0, 0.3, (DIM, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    seen_e, seen_w, seen_b = np.full((BUCKETS, 1), 1e-3, np.float32), np.full_like(W, 1e-3), np.full_like(bias, 1e-3)
    for _ in range(epochs):
        turn = rng.permutation(len(bags))
        for at in range(0, len(turn), batch):
            rows = turn[at : at + batch]
            where, n_words = ragged(bag_starts, rows)
            f_at, n_feats = ragged(word_starts, in_bags[where])
            f = bucket[f_at]
            weight = np.repeat(1 / (np.repeat(n_words, n_words) * n_feats), n_feats).astype(np.float32)[:, None]
            if drop:
                weight *= (rng.random(len(weight)) >= drop).astype(np.float32)[:, None] / np.float32(1 - drop)
            per_bag = np.add.reduceat(n_feats, np.concatenate([[0], np.cumsum(n_words)[:-1]]))
            x = np.add.reduceat(E[f] * weight, np.concatenate([[0], np.cumsum(per_bag)[:-1]]))
            miss = softmax(x @ W + bias)
            miss[np.arange(len(rows)), labels[rows]] -= 1
            miss /= len(rows)
            dx = miss @ W.T
            sort = np.argsort(f, kind="stable")
            fs = f[sort]
            first = np.flatnonzero(np.concatenate([[True], fs[1:] != fs[:-1]]))
            de = np.add.reduceat((np.repeat(dx, per_bag, axis=0) * weight)[sort], first)
            own = fs[first]
            seen_e[own] += (de * de).mean(axis=1, keepdims=True)
            E[own] -= rate * de / np.sqrt(seen_e[own])
            dw, db = x.T @ miss, miss.sum(axis=0)
            seen_w += dw * dw
            seen_b += db * db
            W -= rate * dw / np.sqrt(seen_w)
            bias -= rate * db / np.sqrt(seen_b)
    return (E @ W).astype(np.float32), bias

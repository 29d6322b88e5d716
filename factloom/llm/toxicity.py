"""Toxicity: subword bags averaged into a linear softmax, trained jointly.

An insult is a few words in a text of up to thousands, which an average over
the whole text would drown. The bag is therefore a window of ``WINDOW`` words,
and a text's logit is that of its strongest window. Labels belong to texts, so
the windows to learn from are found in rounds: of a toxic text the strongest
window, of a clean one the strongest and two random ones; at first by how much
more often a word's texts are toxic, then by the model of the round before.
A spelling never seen shares most n-grams, and so most of its vector, with the
ones seen. Logistic calibration on a fifth of the sample turns logits into
scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import crc_mod, fresh, id_hash, slices, wider
from .langid import bounded
from .subword import BUCKETS, Words, feature_table, ragged, read_words, train, word_logits

PER_LABEL = 2500
WINDOW = 3
ROUNDS = 3
DROP = 0.4
KEEP = r"\p{L}\p{N}"


@dataclass
class Model:
    table: np.ndarray  # bucket -> logit
    bias: float
    curve: np.ndarray  # see _calibrated
    prior: float  # score of a text without words

    def scores(self, texts: pa.Array) -> np.ndarray:
        words = read_words(texts, KEEP)
        best, _ = strongest(words, word_logits(words.vocabulary, self.table)[:, 0])
        z = self.curve @ np.stack([np.where(words.counts > 0, best, 0) + self.bias, np.log1p(words.counts), np.ones(len(best))])
        z = np.clip(z, -500, 500)
        return np.where(words.counts > 0, 1 / (1 + np.exp(-z)), self.prior)


def strongest(words: Words, per_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the largest mean over a window, and where it begins."""
    n = words.counts
    size = np.minimum(n, WINDOW)
    doc = np.repeat(np.arange(len(n)), n)
    value = per_word[words.ids]
    total = value.copy()
    for k in range(1, WINDOW):  # word by word, so that a text's sums hang on no other text
        more = np.zeros(len(value))
        more[: len(value) - k] = value[k:]
        total += np.where(k < size[doc], more, 0.0)
    end = np.arange(len(value)) + size[doc]
    mean = np.where(end <= words.starts[1:][doc], total / np.maximum(size[doc], 1), -np.inf)
    best, where = np.full(len(n), -np.inf), np.zeros(len(n), np.int64)
    full = np.flatnonzero(n)
    if len(full):
        best[full] = np.maximum.reduceat(mean, words.starts[:-1][full])
        hit = np.flatnonzero(mean == best[doc])
        docs, first = np.unique(doc[hit], return_index=True)
        where[docs] = hit[first]
    return best, where


def _telling(words: Words, label: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each word how surely texts with one of its n-grams are toxic: the
    largest lower bound of an n-gram's log odds, by numbers of texts."""
    ends, bucket = feature_table(words.vocabulary)
    texts = np.zeros((2, BUCKETS))
    for d in np.flatnonzero(rows):
        own = np.unique(words.ids[words.starts[d] : words.starts[d + 1]])
        texts[label[d], np.unique(bucket[ragged(ends, own)[0]])] += 1
    a, b = max(1, label[rows].sum()), max(1, (1 - label[rows]).sum())
    clean, toxic = texts + 0.5
    bound = np.log(toxic / a) - np.log(clean / b) - 1.5 * np.sqrt(1 / toxic + 1 / clean)
    return np.maximum.reduceat(bound[bucket], ends[:-1])


def _calibrated(z: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve over the logit, the logarithm of the number
    of words (the strongest of more windows is stronger) and 1, by Newton
    steps with a small ridge."""
    x = np.stack([z, np.log1p(n), np.ones(len(z))], axis=1)
    center, scale = np.append(x[:, :2].mean(axis=0), 0), np.append(x[:, :2].std(axis=0) + 1e-6, 1)
    x = (x - center) / scale
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        H = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w -= np.linalg.solve(H, x.T @ (p - y) + 1e-2 * w)
    w = w / scale
    w[2] -= (w * center)[:2].sum()
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic, those to be learnt from. Of
    each label at most ``PER_LABEL`` documents are used, and together at most
    ``langid.SAMPLE_BYTES`` of text, picked by a hash of id and text; an id
    labelled twice counts as toxic if one label says so."""
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    sizes = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    # Twice the ids that are needed, about: bounded for the broadcast.
    share = F.when(F.col("toxic") == 1, 2.0 * PER_LABEL / sizes.get(1, 1)).otherwise(2.0 * PER_LABEL / sizes.get(0, 1))
    some = marked.filter(id_hash("doc_id", 7) < share)
    rows = bounded(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "toxic", PER_LABEL, 7)
    label = rows["toxic"].to_numpy().astype(np.int64)
    words = read_words(rows["text"].combine_chunks(), KEEP)
    del rows
    full = words.counts > 0
    share = float(label.mean()) if len(label) else 0.0
    blank = Model(np.zeros((BUCKETS, 1), np.float32), 0.0, np.array([0, 0, np.log((min(share, 0.49) + 1e-3) / (1 - min(share, 0.49) + 1e-3))]), min(share, 0.49))
    if len(np.unique(label[full])) < 2:
        return blank
    test = np.arange(len(label)) % 5 == 4 if len(label) >= 200 else np.zeros(len(label), bool)
    use = full & ~test
    rng = np.random.default_rng(7)
    score = _telling(words, label, use)
    table, bias = np.zeros((BUCKETS, 2), np.float32), np.zeros(2)
    for _ in range(ROUNDS):
        _, where = strongest(words, score + rng.normal(0, 1e-6, len(score)))  # of equal windows another in each round
        bags, of = [], []
        for d in np.flatnonzero(use):
            size = min(WINDOW, words.counts[d])
            spots = [where[d]] if label[d] else [where[d], *(words.starts[d] + rng.integers(0, words.counts[d] - size + 1, 2))]
            bags += [words.ids[s : s + size] for s in spots]
            of += [label[d]] * len(spots)
        table, bias = train(words.vocabulary, bags, np.array(of), 2, epochs=6, drop=DROP)
        score = word_logits(words.vocabulary, table[:, 1:] - table[:, :1])[:, 0]
    model = Model(table[:, 1:] - table[:, :1], float(bias[1] - bias[0]), np.array([1.0, 0.0, 0.0]), min(share, 0.49))
    check = full & (test if test.any() else use)
    z = strongest(words, score)[0][check] + model.bias
    if len(np.unique(label[check])) == 2:
        model.curve = _calibrated(z, words.counts[check], label[check])
    return model


def predict(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """All columns of docs and the score, whose name follows."""
    (name,) = fresh(docs, "toxicity")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(b.column("text")))], [*b.schema.names, name])

    return docs.mapInArrow(run, wider(docs, **{name: "double"})), name


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Texts without a word get the share of toxic labels, at most 0.49. Without
    labels of both kinds every text does. Null ids are scored, never learnt
    from; equal texts, repeated rows among them, score alike; a text of any
    length is scored whole; labels other than 0 and 1 are ignored; an empty
    table gives no rows; other columns are ignored.
    """
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = fit(docs, labels.select("doc_id", "toxic").filter(~held_out))
    scored, name = predict(docs.select("doc_id", "text"), model)
    score = F.least(F.greatest(name, F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))

"""Language identification: averaged hashed subword embeddings under a linear
softmax, with calibrated probabilities and rejection.

Learnt on a bounded sample: of each language at most ``PER_LANGUAGE`` documents,
and of all together at most ``SAMPLE_BYTES`` of text, picked by a hash of id and
text. Four fifths of them train the model, in segments
of 1 to 32 words so that short texts are known too; the last fifth, as whole
texts, sets the temperature that makes the scores probabilities and the
rejection threshold, below which at most ``REJECT`` of rightly named texts lie,
and which is at most ``SURE``: a text in two languages is no noise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import crc_mod, fresh, id_hash, slices, wider
from .subword import BUCKETS, read_words, softmax, train, word_logits

PER_LANGUAGE = 1200
SAMPLE_BYTES = 48 << 20
MOST_LABELS = 256
SEGMENTS = 4
REJECT = 0.001
#: A score from which no text is rejected, however sure the others are.
SURE = 0.4
LETTERS = r"\p{L}"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(has a letter, probability of each language) of each text."""
        words = read_words(texts, LETTERS)
        logits = _document_logits(words, word_logits(words.vocabulary, self.table), self.bias)
        return words.counts > 0, softmax(logits / self.temperature)


def _document_logits(words, per_word: np.ndarray, bias: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    many = np.maximum(words.counts, 1)
    return np.stack([np.bincount(doc, per_word[words.ids, k], minlength=len(many)) / many for k in range(len(bias))], axis=1) + bias


def bounded(rows: DataFrame, label: str, per_class: int, salt: int) -> pa.Table:
    """(doc_id, text, label) of rows with a text and a label: of the
    ``MOST_LABELS`` labels with most rows each at most ``per_class`` rows and an
    equal share of ``SAMPLE_BYTES`` of text, the first by a hash of id and text.

    Rows equal in all three count once, however many there are. A text of more
    than a quarter of its label's share is left out; a label that has no
    shorter one gives a quarter's worth of one text.
    """
    marked = rows.filter(F.col("text").isNotNull() & F.col(label).isNotNull()).select("doc_id", "text", F.col(label).alias("label"), F.xxhash64("text").alias("h"))
    each = marked.groupBy("label", "doc_id", "h").agg(F.max(F.octet_length("text")).alias("bytes"))
    sizes = each.groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(MOST_LABELS).toArrow()
    empty = marked.select("doc_id", "text", F.col("label").alias(label)).limit(0)
    if not sizes.num_rows:
        return empty.toArrow()
    share = SAMPLE_BYTES // sizes.num_rows
    # Half as many again as are needed come near; the exact bound follows on those.
    counts = rows.sparkSession.createDataFrame(sizes.to_pylist(), marked.select("label").schema.add("count", "long"))
    place = id_hash(F.struct("doc_id", "h"), salt)
    near = each.join(F.broadcast(counts), "label").withColumns({"place": place, "fits": F.col("bytes") <= share // 4}).filter(F.col("place") < (1.5 * per_class + 100) / F.col("count"))
    order = Window.partitionBy("label", "fits").orderBy("place", "doc_id", "h")
    ranked = near.select("*", F.row_number().over(order).alias("nth"), F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"), F.max("fits").over(Window.partitionBy("label")).alias("any_fits"))
    taken = F.when(F.col("fits"), (F.col("nth") <= per_class) & (F.col("so_far") <= share)).otherwise((F.col("nth") == 1) & ~F.col("any_fits"))
    chosen = ranked.filter(taken).select(*[F.col(c).alias(f"c_{c}") for c in ("label", "doc_id", "h")])
    same = F.col("doc_id").eqNullSafe(F.col("c_doc_id")) & (F.col("h") == F.col("c_h")) & (F.col("label") == F.col("c_label"))
    met = marked.join(F.broadcast(chosen), same, "left_semi").groupBy("doc_id", "label", "h").agg(F.first("text").alias("text"))
    cut = F.when(F.octet_length("text") <= share // 4, F.col("text")).otherwise(F.substring("text", 1, share // 4))
    return met.select("doc_id", cut.alias("text"), F.col("label").alias(label)).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending"), (label, "ascending")])


def fit(docs: DataFrame, usable: Column) -> Model:
    """docs: doc_id, text, lang. Only rows for which ``usable`` holds are learnt from."""
    rows = bounded(docs.select("doc_id", "text", "lang").filter(usable), "lang", PER_LANGUAGE, 6)
    languages = sorted(set(rows["lang"].to_pylist()))
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    label = np.array([languages.index(x) for x in rows["lang"].to_pylist()])
    words = read_words(rows["text"].combine_chunks(), LETTERS)
    del rows
    rng = np.random.default_rng(6)
    bags, of = [], []
    test = np.arange(len(label)) % 5 == 4
    for d in np.flatnonzero((words.counts > 0) & (~test | (len(label) < 50))):
        at, n = words.starts[d], words.counts[d]
        for k in range(SEGMENTS):
            size = min(n, 1 << rng.integers(0, 6))
            begin = at + (rng.integers(0, n - size + 1) if k else 0)
            bags.append(words.ids[begin : begin + size])
            of.append(label[d])
    if not bags:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    table, bias = train(words.vocabulary, bags, np.array(of), len(languages))
    model = Model(languages, table, bias, 1.0, 0.0)
    whole = np.flatnonzero((words.counts > 0) & (test | (len(label) < 50)))
    if len(whole):
        logits = _document_logits(words, word_logits(words.vocabulary, table), bias)[whole]
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(whole)), label[whole]] + 1e-12).mean() for t in np.geomspace(0.05, 5, 60)}
        model.temperature = float(min(loss, key=loss.get))
        p = softmax(logits / model.temperature)
        right = p.argmax(axis=1) == label[whole]
        if right.any():
            model.threshold = float(min(SURE, np.quantile(p.max(axis=1)[right], REJECT)))
    return model


def predict(docs: DataFrame, model: Model) -> tuple[DataFrame, str, str, str]:
    """All columns of docs and three more, whose names follow: the language,
    its score, and whether the text is rejected."""
    names = fresh(docs, "lang_pred", "lang_score", "rejected")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                known, p = model.scores(b.column("text"))
                known &= len(model.languages) > 0
                best = p.argmax(axis=1)
                name = pa.array([model.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)], pa.string())
                score = np.where(known, p[np.arange(len(p)), best], 0.0)
                yield pa.RecordBatch.from_arrays([*b.columns, name, pa.array(score), pa.array(~known | (score < model.threshold))], [*b.schema.names, *names])

    return docs.mapInArrow(run, wider(docs, **dict(zip(names, ("string", "double", "boolean"), strict=True)))), *names


def op6(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row per input row.

    lang_pred is ``und`` with score 0 for a null text, a text without a letter
    and where no labelled document can be learnt from. A null id is neither
    learnt from nor held out; null langs are not learnt from; repeated rows
    are predicted alike; a text of any length is averaged whole; an empty table
    gives no rows; columns besides doc_id, text and lang are ignored.
    """
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out)
    named, language, score, rejected = predict(docs.select("doc_id", "text"), model)
    return named.select("doc_id", held_out.alias("held_out"), F.col(language).alias("lang_pred"), F.col(score).alias("score"), F.col(rejected).alias("rejected"))

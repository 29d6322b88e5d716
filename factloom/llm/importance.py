"""Importance resampling towards a target set of texts, in built-in functions
only.

The features of a text are its words and pairs of following words, hashed to
buckets. A bucket's gain is the log of how much likelier it is in the target
than in the corpus; a text's weight is the mean gain of its features. Gumbel
noise that depends on the id alone turns the highest scores into a sample
without replacement, and a distributed sort ranks them: the place of a row is
its place in its partition plus the rows of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import drop_written, written

BUCKETS = 10_000
SEED = 7
#: A text of fewer words is never drawn.
LEAST_WORDS = 20
#: Per cent of the others that are drawn.
DRAWN = 25
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Letters a to z (A to Z lower-cased), digits and all beyond ASCII make words."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def features(df: DataFrame, text: Column, *keep: str, buckets: int = BUCKETS) -> DataFrame:
    """The columns to keep and ``bucket``, a row for each feature; the bucket is
    null in one row more a text, so that a text without words has a row too."""
    words = df.select(*keep, words_of(text).alias("words"))
    pairs = words.select(*keep, F.inline_outer(F.arrays_zip(F.col("words").alias("one"), F.slice("words", 2, F.size("words")).alias("next"))))
    hashed = [F.crc32(F.encode(x, "utf-8")) for x in (F.col("one"), F.concat("one", F.lit(" "), "next"))]
    return pairs.select(*keep, F.explode(F.array(*hashed)).alias("hash")).select(*keep, (F.col("hash") % buckets).cast("int").alias("bucket"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain), a row for each bucket, written: floor(1000 ln) of the
    ratio of the add-one shares of target and corpus."""

    def counted(texts: DataFrame, name: str) -> DataFrame:
        return features(texts, F.col("text"), buckets=buckets).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))

    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = written(every.join(counted(corpus, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left").fillna(0), "importance-counts")
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = (F.col("t") + 1) * F.lit(float(total.s + buckets)) / ((F.col("s") + 1) * F.lit(float(total.t + buckets)))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighted(corpus: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, row, n_features, weight), one row per row of the corpus; the
    gains, one for each bucket and no more, are broadcast."""
    rows = corpus.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    met = features(rows, F.col("text"), "doc_id", "row", buckets=buckets).join(F.broadcast(gain), "bucket", "left")
    summed = met.groupBy("row", "doc_id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"))
    floored = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(0)
    return summed.select("doc_id", "row", "n_features", floored.alias("weight"))


def noise(doc_id: str, seed: int) -> Column:
    """floor(1000 times a Gumbel variable) that the id decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, drawn: int, *order: Column) -> DataFrame:
    """scored and ``rank``: 1, 2, 3, ... in this order up to ``drawn``, null
    beyond. A range partition each task sorts; what comes before a partition is
    a sum over as many counts as there are partitions."""
    spark = scored.sparkSession
    place = written(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "importance-order")
    part, before, offsets = F.shiftright("place", 33), 0, []
    for r in sorted(place.groupBy(part.alias("part")).count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    nth = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    numbered = place.withColumn("part", part).join(F.broadcast(spark.createDataFrame(offsets, "part long, before long")), "part")
    return numbered.select(*scored.columns, F.when(nth <= drawn, nth).alias("rank"))


def resample(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, per_cent: int = DRAWN) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per row of the corpus.

    Null and empty texts, and texts without a word, have no features and weight
    0; a null id has the noise of the empty text. Equal scores go by smaller
    id, null last; repeated rows are rows of their own, each with a rank. A
    text of any length is counted whole. Without target texts all gains follow
    from the corpus alone; an empty corpus gives no rows. Other columns are
    ignored.
    """
    gain = gains(corpus.select("text"), target.select("text"), buckets)
    scored = written(weighted(corpus, gain, buckets).withColumn("score", F.col("weight") + noise("doc_id", seed)), "importance-scores")
    enough = F.col("n_features") >= 2 * least_words - 1  # n words and n - 1 pairs
    eligible = scored.filter(enough)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc())
    top = ranked(eligible, per_cent * eligible.count() // 100, *order)
    return top.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))).drop("row")


ORACLE = r"""
WITH RECURSIVE step(byte, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY byte) AS tab FROM step WHERE k = 8
), texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL
  SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT side, row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM texts
), grams AS (
  SELECT side, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words
), counted AS (
  SELECT side, row, f, count(*) AS n FROM grams GROUP BY ALL
), each AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(1, len(h)::BIGINT, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
                            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM each, crc_table
), totals AS (
  SELECT range AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t, sum(coalesce(s, 0)) OVER () AS ss, sum(coalesce(t, 0)) OVER () AS tt
  FROM range(10000) LEFT JOIN (
    SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 't') AS t FROM counted JOIN hashed USING (f) GROUP BY bucket
  ) b ON b.bucket = range
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE))) AS g FROM totals
), summed AS (
  SELECT row, sum(n) AS n, sum(n * g) AS g FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row
), scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g / n), 0)::BIGINT AS weight,
         coalesce(floor(g / n), 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN summed USING (row) WHERE side = 'd'
), placed AS (
  SELECT *, n_features >= 39 AS enough, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id NULLS LAST) AS k,
         count(*) FILTER (n_features >= 39) OVER () AS many
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND k <= 25 * many // 100 THEN k END AS rank FROM placed
"""

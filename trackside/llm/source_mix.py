"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

A document's size is its number of words (runs other than space and 0x09-0x0D). Sources in code point order, null last,
take the weights in turn and share ``share`` times all words; a source's target stops at ``most`` times its own size, the
excess going to the others by weight. A target consists of complete epochs and a fraction: every document
is taken once per complete epoch; for the fraction, documents are sorted within the source by ``-ln(u) / quality`` and taken while
at least half of them fits into what remains. ``u`` is made from the document's id, so reruns agree; ``quality`` is
0.1 to 1, rising with the share of distinct words.

Running sums are taken in two steps, per piece of the key's range and over the pieces' totals (at most ``PIECES`` for
a source), so that a source of any size is spread over tasks.

Null or empty texts have size 0 and take part without weight. Null ids share one ``u``. Repeated rows are separate
documents with equal keys, taken one after the other. Without words every target is 0. Extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackside.llm.common import prepare, stored, unused

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
PIECES = 4096
WORD = r"[^\x20\x09-\x0D]+"
LEAST_QUALITY = 0.1


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds place, source_size and target to one row per source: (source, source_size).

    Sources sorted by the level at which they reach their limit; the level is the first at which the rest, shared
    by weight, stays below the limits of all that remain. The table has a row per source, hence no partitioning.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(w) for w in weights])[(place % len(weights)).cast("int")]
    by_limit = Window.orderBy("limit_at", "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = (
        sizes.select("source", "source_size", place.alias("place"), turn.alias("weight"))
        .withColumn("limit", most * F.col("source_size"))
        .withColumn("limit_at", F.col("limit") / F.col("weight"))
        .withColumn("rest", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.sum("weight").over(from_here))
        .withColumn("fits", F.when(F.col("level") <= F.col("limit_at"), F.col("limit_at")))
        .withColumn("level", F.min_by("level", "fits").over(everything))
    )
    target = F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return rows.select("source", "place", "source_size", target.alias("target"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
) -> DataFrame:
    """Per row: id_col, text_hash, source, size, source_size, target, copies, taken (words, repeats counted)."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
    )
    size = F.size("words").cast("long")
    quality = LEAST_QUALITY + (1 - LEAST_QUALITY) * F.size(F.array_distinct("words")) / F.greatest(size, F.lit(1))
    rows = stored(
        words.select("id", "source", "text_hash", size.alias("size"), (-F.log(uniform(F.col("id"), seed)) / quality).alias("key")),
        "mix",
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, most)
    piece = F.floor(PIECES * (1 - F.exp(-F.col("key") / 2))).cast("int")
    rows = rows.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("piece", piece)
    by_piece = Window.partitionBy("place").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        rows.groupBy("place", "piece").agg(F.sum("size").alias("piece_size"))
        .select("place", "piece", F.coalesce(F.sum("piece_size").over(by_piece), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("place", "piece").orderBy("key", "id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    until = F.col("before") + F.sum("size").over(inside)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    more = (F.col("rest") > 0) & (F.col("until") - F.col("size") / 2 <= F.col("rest")) & (F.col("epochs") < most)
    out = (
        rows.join(pieces, ["place", "piece"])
        .withColumn("until", until)
        .withColumn("epochs", epochs)
        .withColumn("rest", rest)
        .withColumn("copies", F.col("epochs") + more.cast("long"))
    )
    return out.select(
        F.col("id").alias(id_col), "text_hash", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def repeated_by_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all its columns unchanged."""
    one, digest, copies, copy = unused(docs, "id", "digest", "copies", "copy")
    chosen = mixed(docs, id_col, text_col, **options).groupBy(F.col(id_col).alias(one), F.col("text_hash").alias(digest))
    chosen = chosen.agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    same = F.col(id_col).eqNullSafe(F.col(one)) & (
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(digest)
    )
    taken = docs.join(chosen.hint("shuffle_hash"), same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return taken.select(*docs.columns)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sized AS (
  SELECT doc_id, source, len(w)::BIGINT AS size,
    -ln((('0x' || substr(md5(doc_id::VARCHAR || ':mix-1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (0.1 + 0.9 * len(list_distinct(w)) / greatest(len(w), 1)) AS key
  FROM words
), totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w
  FROM totals
), level AS (
  -- the one level at which the targets add up: tried at every set of sources that reach their limit first
  SELECT arg_min(l, lim) AS l FROM (
    SELECT a.source, (1.5 * (SELECT sum(source_size) FROM totals)
        - coalesce(sum(CASE WHEN 2.0 * b.source_size / b.w < 2.0 * a.source_size / a.w THEN 2.0 * b.source_size END), 0))
      / sum(CASE WHEN 2.0 * b.source_size / b.w >= 2.0 * a.source_size / a.w THEN b.w END) AS l,
      any_value(2.0 * a.source_size / a.w) AS lim
    FROM weighted a, weighted b GROUP BY a.source
  ) WHERE l <= lim
), targets AS (
  SELECT source, source_size, least(2.0 * source_size, coalesce(l * w, 2.0 * source_size)) AS target
  FROM weighted, level
), summed AS (
  SELECT doc_id, size, t.source_size, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS until,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN target - epochs * source_size > 0 AND until - size / 2.0 <= target - epochs * source_size
    AND epochs < 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""

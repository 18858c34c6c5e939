"""Mixing sources to target weights, in DataFrame functions only.

Efraimidis-Spirakis sampling: a document's key is ``-ln(u) / w`` with ``u`` from a digest of its id and ``w`` its
quality weight; within a source, documents in ascending key order are a weighted sample without replacement. A source
whose target is ``e`` times its size and a rest gives every document ``e`` times (complete epochs), and the rest is
filled with documents in key order until the word budget is used up; the last one gives the words still wanted.

The order within a source is needed at any size, so keys are cut into ``BUCKETS`` ranges: sizes are summed by source and
range, a window over ranges gives each range its offset, and a window within (source, range) the rest. No task holds a
whole source, however hot.

Defined results: null text counts as empty (size 0); a null source is a source of its own and comes last; a null id has
a fixed key; repeated rows are mixed as separate documents; a source of size 0 has target 0; an empty table gives an
empty result; a very long text counts like any other. Added columns replace input columns of the same name; no other name can
clash, but ``quality`` and ``size`` may not be made of columns named in ``INTERNAL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.common import free_name

#: Ranges of the key within a source; each holds about a 1024th of the source.
BUCKETS = 1024
#: Columns that come and go on the way; those of the input with such a name are renamed meanwhile.
INTERNAL = {"m_null", "m_src", "m_key", "m_bucket", "m_size", "m_base", "m_before"}
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column) -> Column:
    """(0, 1] from the first 52 bits of the id's md5; the same in any SQL engine."""
    hexed = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(hexed, 16, 10).cast("long").cast("double") + 1.0) / F.lit(4503599627370496.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(m_null, m_src, source_size) -> with target: weights by rank, water-filled below ``cap`` times the size.

    Sources in ascending order of cap over weight: the first one that the level of all that are left does not lift over
    its cap ends the capped ones; that level holds for the rest. One row per source, so single-partition windows.
    """
    everything = Window.partitionBy(F.lit(0))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("m_rank", F.row_number().over(everything.orderBy("m_null", "m_src")))
    ranked = ranked.withColumn("m_w", F.element_at(pattern, (F.col("m_rank") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("m_ratio", F.lit(float(cap)) * F.col("source_size") / F.col("m_w"))
    order = everything.orderBy("m_ratio", "m_rank")
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("source_size").over(everything)
    left = F.sum("m_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("m_level", (total - F.lit(float(cap)) * before) / left)
    own = F.when(F.col("m_level") <= F.col("m_ratio"), F.struct("m_ratio", "m_rank", "m_level"))
    level = level.withColumn("m_level", F.min(own).over(everything)["m_level"])
    target = F.least(F.lit(float(cap)) * F.col("source_size"), F.col("m_level") * F.col("m_w"))
    return level.select("m_null", "m_src", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    size: Column | None = None,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes of the document, repeats counted).

    ``quality``: a positive weight column; a heavier document comes earlier in its source. ``size``: a document's words
    if already counted (before a join, so that it shuffles no texts). Columns that the caller does not use are pruned.
    """
    clash = {c: free_name(docs.columns, f"in_{c}") for c in docs.columns if c.lower() in INTERNAL}
    docs = docs.withColumnsRenamed(clash)
    id_col, text_col, source_col = (clash.get(c, c) for c in (id_col, text_col, source_col))
    weight = F.lit(1.0) if quality is None else F.coalesce(quality.cast("double"), F.lit(1.0))
    keyed = docs.withColumns(
        {
            "m_null": F.col(source_col).isNull(),
            "m_src": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
            "size": word_count(F.col(text_col)) if size is None else size,
            "m_key": -F.log(uniform(F.col(id_col))) / weight,
        }
    )
    keyed = keyed.withColumn("m_bucket", F.least(F.floor((1.0 - F.exp(-F.col("m_key"))) * BUCKETS), F.lit(BUCKETS - 1)))
    by = ["m_null", "m_src", "m_bucket"]
    buckets = keyed.groupBy(*by).agg(F.sum("size").alias("m_size"))
    targets = source_targets(
        buckets.groupBy("m_null", "m_src").agg(F.sum("m_size").alias("source_size")), weights, cap
    )
    offsets = Window.partitionBy("m_null", "m_src").orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("m_base", F.coalesce(F.sum("m_size").over(offsets), F.lit(0)))
    buckets = buckets.join(targets, ["m_null", "m_src"]).drop("m_size")
    within = Window.partitionBy(*by).orderBy("m_key", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.drop("source_size", "target", "taken").join(buckets, by)
    placed = placed.withColumn("m_before", F.col("m_base") + F.sum("size").over(within) - F.col("size"))
    full = F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - full * F.col("source_size") + 0.5).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("m_before")))
    taken = (full * F.col("size") + part).cast("long")
    out = placed.withColumn("taken", taken).drop(*by, "m_key", "m_base", "m_before")
    return out.withColumnsRenamed({new: old for old, new in clash.items()})


#: A document's weight by its label: 1 good, 0 poor, none unknown.
QUALITY = {1: 2.0, 0: 0.5}


def quality_of(labels: DataFrame) -> DataFrame:
    """(doc_id, m_quality): the best label of a document, as a weight."""
    best = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q"))
    return best.select("doc_id", F.when(F.col("q") == 1, QUALITY[1]).when(F.col("q") == 0, QUALITY[0]).otherwise(1.0).alias("m_quality"))


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.join(quality_of(labels), "doc_id", "left")


ORACLE = """
WITH q AS (SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w
           FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source,
        len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        -ln(((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 1.0::DOUBLE)
            / 4503599627370496.0::DOUBLE) / coalesce(q.w, 1.0::DOUBLE) AS key
      FROM documents d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk
      FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((rk - 1) % 3 + 1)::BIGINT]::DOUBLE AS wt FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size / wt AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, rk
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(wt) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM r),
t AS (SELECT *, least(3.0::DOUBLE * source_size,
        wt * (SELECT lv FROM l WHERE lv <= ratio ORDER BY ratio, rk LIMIT 1)) AS target FROM l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        coalesce(floor(t.target / nullif(t.source_size, 0)::DOUBLE), 0)::BIGINT AS e,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (e * size + greatest(0, least(size, floor(target - e * source_size + 0.5)::BIGINT - before)))::BIGINT AS taken
FROM j
"""

"""Exact top-k inner products by the three-phase uniform threshold.

A score is a sum over ``lists`` lists: the dimensions are cut into that many blocks, and a list holds one block's part
of every candidate's score. For a block of queries:

1. every task gathers, for each query and list, the highest local entries, and reports the best totals among them (a
   task holds whole vectors, so a gathered entry's total is known). The k-th best total of all is a lower bound.
2. The bound over the number of lists is a safe cutoff, broadcast to all: a candidate below it in every list cannot
   reach the bound. Tasks send the entries at or above it, with the sum of the parts they know.
3. Entries with parts below the cutoff are resolved exactly against the vectors; ranks are taken among those that reach
   the bound, ties included.

Equal vectors are one candidate: a group's smallest ``k + 1`` ids are all that any query can need of it, and a query
needs its vector scored once. Queries come in blocks of ``QUERY_BLOCK`` vectors, which bounds what is broadcast.

Defined results: null vectors and vectors with null or non-finite components take no part; a shorter vector counts as
padded with zeros; rows repeated with the same id and vector count once; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.common import staged

QUERY_BLOCK = 2048
ROWS = 512


def quantised(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, cut or padded with zeros to ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out, at = np.zeros((len(sizes), width), np.int64), 0
    for row, n in enumerate(sizes):
        out[row, : min(n, width)] = flat[at : at + min(n, width)]
        at += n
    return out


def _parts(queries: np.ndarray, rows: np.ndarray, lists: int) -> list[np.ndarray]:
    """Integer part scores by list, each queries x rows; by floating point where that is exact."""
    width = queries.shape[1]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(width, 1)
    a, b = (queries.astype(float), rows.astype(float)) if bound < 2**52 else (queries, rows)
    cuts = np.linspace(0, width, lists + 1).astype(int)
    return [(a[:, x:y] @ b[:, x:y].T).astype(np.int64) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    lists: int = 2,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` best other rows, ties to the smaller id."""
    spark, need = vectors.sparkSession, k + 1
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_q"))
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= need)
    groups = ranked.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    groups = staged(groups.select(F.monotonically_increasing_id().alias("cid"), "v", "ids"), "topk-vectors")
    asked = rows.where("is_q").select("id", "v").distinct().join(groups.select("cid", "v"), "v")
    asked = staged(asked.select(F.col("id").alias("query_id"), "cid"), "topk-queries")
    wanted = groups.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "v")
    found, block = [], []
    for row in wanted.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            found.append(_block(groups, block, need, lists))
            block = []
    if block or not found:
        found.append(_block(groups, block, need, lists))
    best = reduce(DataFrame.unionAll, found).join(groups.select("cid", "ids"), "cid")
    best = best.select("qid", "total", F.explode("ids").alias("id"))
    order = [F.desc("total"), F.asc("id")]
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("r") <= need)
    pairs = asked.join(best.drop("r"), asked["cid"] == best["qid"]).where("id <> query_id")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return pairs.where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("total").alias("score")
    )


def _block(groups: DataFrame, block: list, need: int, lists: int) -> DataFrame:
    """(qid, cid, total): for each query vector, the groups whose total is among the ``need`` best, ties included."""
    spark = groups.sparkSession
    width = max((len(x["v"]) for x in block), default=0)
    queries = np.zeros((len(block), width), np.int64)
    for i, x in enumerate(block):
        queries[i, : len(x["v"])] = x["v"]
    sent = spark.sparkContext.broadcast(queries)

    def gather(batches):
        asked, kept = sent.value, None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, scores = part.column(0).to_numpy(), _parts(asked, _matrix(part.column(1), asked.shape[1]), lists)
                total = np.sum(scores, axis=0)
                if not total.size:
                    continue
                n = min(need, len(ids))
                local = np.concatenate([np.argpartition(-s, n - 1, axis=1)[:, :n] for s in scores], axis=1)
                local = np.sort(local, axis=1)
                again = np.zeros(local.shape, bool)
                again[:, 1:] = local[:, 1:] == local[:, :-1]
                totals = np.where(again, np.iinfo(np.int64).min, np.take_along_axis(total, local, axis=1))
                totals = totals if kept is None else np.concatenate([kept, totals], axis=1)
                n = min(need, totals.shape[1])
                kept = np.take_along_axis(totals, np.argpartition(-totals.astype(float), n - 1, axis=1)[:, :n], axis=1)
        if kept is not None:
            who = np.repeat(np.arange(len(kept), dtype=np.int32), kept.shape[1])
            real = kept.ravel() != np.iinfo(np.int64).min
            yield pa.RecordBatch.from_arrays([pa.array(who[real]), pa.array(kept.ravel()[real])], ["q", "total"])

    best = groups.select("cid", "v").mapInArrow(gather, "q int, total long")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("total"))))
    least = np.full(len(block), np.iinfo(np.int64).min)
    for q, total in best.where(F.col("r") == need).select("q", "total").collect():
        least[q] = total
    cutoff = spark.sparkContext.broadcast(least)

    def collect(batches):
        asked, bound = sent.value, cutoff.value
        every = bound == np.iinfo(np.int64).min
        low = np.where(every, 0, bound)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                scores = _parts(asked, _matrix(part.column(1), asked.shape[1]), lists)
                known, hidden = np.zeros_like(scores[0]), np.zeros(scores[0].shape, np.int8)
                for s in scores:
                    above = (s * lists >= low[:, None]) | every[:, None]
                    known += np.where(above, s, 0)
                    hidden += ~above
                can = every[:, None] | ((hidden < lists) & (known * lists + hidden * low[:, None] >= low[:, None] * lists))
                q, row = np.nonzero(can)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.astype(np.int32)), part.column(0).take(pa.array(row)), pa.array(known[q, row]), pa.array(hidden[q, row])],
                    ["q", "cid", "known", "hidden"],
                )

    entries = groups.select("cid", "v").mapInArrow(collect, "q int, cid long, known long, hidden byte")
    entries = staged(entries, "topk-entries")

    def resolve(batches):
        asked = sent.value
        for batch in batches:
            rows = _matrix(batch.column(2), asked.shape[1])
            total = np.einsum("ij,ij->i", asked[batch.column(0).to_numpy()], rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total)], ["q", "cid", "total"])

    open_ = entries.where("hidden > 0").join(groups.select("cid", "v"), "cid").select("q", "cid", "v")
    totals = open_.mapInArrow(resolve, "q int, cid long, total long").unionAll(
        entries.where("hidden = 0").select("q", "cid", F.col("known").alias("total"))
    )
    top = totals.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("total")))).where(F.col("r") <= need)
    names = spark.createDataFrame([(i, x["cid"]) for i, x in enumerate(block)], "q int, qid long")
    return staged(top.join(F.broadcast(names), "q").select("qid", "cid", "total"), "topk-found")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10
"""

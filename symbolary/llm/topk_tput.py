"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components, made whole numbers, are split into BLOCKS runs; a query has one score list for each run, and a
candidate's score is the sum of its entries in the lists. Candidates lie in partitions, and so do the lists.

1. Each partition gathers the k best local entries of every list. For these candidates, what the gathered entries add
   up to, with a list's least possible entry where a candidate was not gathered, is a lower bound of their scores; the
   k-th best lower bound over all partitions is a safe cutoff for the query.
2. The cutoffs are broadcast. Less the least possible entries and divided by the number of lists, a cutoff is a uniform
   threshold: a candidate below it in all lists is below the cutoff. Each partition collects the entries that reach it.
3. Of the candidates so collected, those whose collected entries, with the threshold for the lists that lack, can't reach
   the cutoff go; the scores of the rest are added up exactly, and the k best go on to a final merge by query.

Queries come in blocks of QUERY_BLOCK rows, so what is broadcast has a fixed size; candidates are never collected. All
numbers are integers; the least possible entries come from lengths (Cauchy-Schwarz), rounded down.

Vectors that are null or hold null or non-finite components take no part; shorter vectors have zeros at the end. A
query's own id is no candidate. Rows that repeat an id and vector count once. Ties go to the smaller id. Other columns
are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symbolary.sources.tables import table

SCALE, TOP, QUERY_EVERY = 256, 5, 50
BLOCKS, QUERY_BLOCK, CANDIDATES = 4, 2048, 4096
_NONE = np.iinfo(np.int64).min


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id, v: floor(scale * x) of the components, of the rows that take part, without repeats."""
    v = F.transform(vectors[vector_col], lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = vectors[vector_col].isNotNull() & (F.size(vectors[vector_col]) > 0) & F.forall(vectors[vector_col], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(fine & vectors[id_col].isNotNull()).select(vectors[id_col].cast("long").alias("id"), v.alias("v")).dropDuplicates()


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers, with zeros at the end."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(ends))
    out[row, np.arange(len(flat)) - ends[row]] = flat
    return out


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products; floating point only where every sum is below 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if most < 2**53 else q @ c.T


def _lists(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores by list, query and candidate."""
    return np.stack([_product(q[:, p], c[:, p]) for p in np.array_split(np.arange(q.shape[1]), BLOCKS)])


def _least(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A bound from below of every entry, by list and query."""
    parts = np.array_split(np.arange(q.shape[1]), BLOCKS)
    return np.stack([-np.ceil(np.linalg.norm(q[:, p].astype(float), axis=1) * np.sqrt((c[:, p].astype(float) ** 2).sum(1).max(initial=0.0)) * (1 + 1e-9) + 1).astype(np.int64) for p in parts])


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATES):
            part = batch.slice(at, CANDIDATES)
            yield part.column("id").to_numpy(), _matrix(part.column("v"), width)


def _block(candidates: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: of one block of queries, the k best of each partition that may be among the k best."""
    spark, width = candidates.sparkSession, q.shape[1]
    held = spark.sparkContext.broadcast((ids, q))

    def gather(batches):
        ids, q = held.value
        best = np.full((len(ids), k), _NONE)
        for cid, c in _parts(batches, width):
            lists, least = _lists(q, c), _least(q, c)
            lists[:, ids[:, None] == cid[None, :]] = _NONE // (2 * BLOCKS)
            n = min(k, len(cid))
            gathered = lists >= np.stack([_kth(x, n) for x in lists])[:, :, None]
            low = np.where(gathered, lists, least[:, :, None]).sum(0)
            low[~gathered.any(0)] = _NONE
            low[ids[:, None] == cid[None, :]] = _NONE
            best = -np.partition(-np.concatenate([best, low], 1), k - 1, axis=1)[:, :k]
        at, _ = np.nonzero(best > _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(best[best > _NONE])], names=["q", "low"])

    local = candidates.mapInArrow(gather, "q int, low long")
    ranked = local.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("low"))))
    cutoff = np.full(len(ids), _NONE)
    for r in ranked.where(F.col("rank") == k).select("q", "low").collect():  # at most one row for each query of the block
        cutoff[r.q] = r.low
    cut = spark.sparkContext.broadcast(cutoff)

    def resolve(batches):
        (ids, q), cutoff = held.value, cut.value
        for cid, c in _parts(batches, width):
            lists, least = _lists(q, c), _least(q, c)
            own = ids[:, None] == cid[None, :]
            # a sum of entries above their least possible values reaches the cutoff only if one of them reaches this
            short = np.where(cutoff == _NONE, 0, cutoff - least.sum(0))
            threshold = -(-short // BLOCKS)
            over = lists - least[:, :, None]
            collected = over >= threshold[None, :, None]
            upper = np.where(collected, over, np.maximum(threshold - 1, 0)[None, :, None]).sum(0)
            alive = (collected.any(0) & (upper >= short[:, None])) | (cutoff == _NONE)[:, None]
            qi, ci = np.nonzero(alive & ~own)
            score = lists[:, qi, ci].sum(0)
            fit = score >= cutoff[qi]
            qi, ci, score = qi[fit], ci[fit], score[fit]
            order = np.lexsort((cid[ci], -score, qi))
            qi, ci, score = qi[order], ci[order], score[order]
            nth = np.arange(len(qi)) - np.searchsorted(qi, qi)
            qi, ci, score = qi[nth < k], ci[nth < k], score[nth < k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[qi]), pa.array(cid[ci]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(resolve, "query_id long, vec_id long, score long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = TOP, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score; queries and candidates: id, v, as of whole_numbers."""
    spark = queries.sparkSession
    width = candidates.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    n = queries.count()
    blocks = []
    if n and width:
        # queries of a block have the same remainder of a hash, so that a block is read without the others
        count = -(-n // query_block)
        for i in range(count):
            rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(count)) == i).where(F.size("v") <= width).toArrow()
            if rows.num_rows:
                q = _matrix(rows.column("v").combine_chunks(), width)
                blocks.append(_block(candidates, rows.column("id").to_numpy(), q, k))
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = reduce(DataFrame.unionByName, blocks)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_topk_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every vector whose id is divisible by 50."""
    v = whole_numbers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(v.where(F.col("id") % QUERY_EVERY == 0), v)


ORACLE = f"""
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(embedding) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {QUERY_EVERY} = 0),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score from s)
select * from r where rank <= {TOP}
"""

QUERIES = {"op5_topk_tput": op5_topk_tput}
ORACLES = {"op5_topk_tput": ORACLE}

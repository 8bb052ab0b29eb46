"""Vector search over array<float> columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.functions.sampling import bounded_sample


@dataclass(frozen=True)
class VectorConfig:
    #: Queries, and vectors, about, of a block; each block of queries meets each block of vectors in one product of matrices.
    query_block: int = 2048
    vector_block: int = 8192
    #: Rows the centroids of the index are fitted on, at most.
    fit_rows: int = 20_000
    #: The index has as many lists as the root of the number of rows, no fewer than this.
    least_lists: int = 8
    #: Share of the lists searched for a query. Vectors without any clusters need most lists; clustered ones a few.
    probed: float = 0.75
    rounds: int = 10
    seed: int = 7


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for vectors of different or no length and for zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0), dot / length).otherwise(0.0)


def top_k(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(vec_id, score): the k nearest of one query vector (a DataFrame of one row with `embedding`)."""
    q = query.limit(1).select(F.col("embedding").alias("q"))
    scored = vectors.join(F.broadcast(q)).select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("score"))  # one row
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def top_k_of(embedded: DataFrame, query: tuple, k: int) -> DataFrame:
    """(id, score): the k rows (id, embedding) nearest to a vector; those of another dimension do not count, ties go by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = of_dimension(embedded, len(query)).select("id", cosine(F.col("embedding"), q).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def restricted_top_k(embedded: DataFrame, memories: DataFrame, query: tuple, k: int) -> DataFrame:
    """(id, score): the k nearest among the given memories (id), say those of a tier or of a range of time. The restriction comes
    before the search, so that k rows come out wherever there are as many."""
    return top_k_of(embedded.join(memories.select("id").distinct(), "id", "left_semi"), query, k)


def reinforced(memories: DataFrame, matches: DataFrame, now: Column) -> DataFrame:
    """(id, access_count, last_accessed, hits) of the memories that near-duplicates were dropped for: each match (query_id, vec_id,
    score) whose query's nearest memory it is counts as an access."""
    nearest_of = matches.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("id"))).alias("b"))
    hits = nearest_of.groupBy(F.col("b.id").alias("id")).agg(F.count("*").alias("hits"))
    return memories.join(hits, "id").select("id", (F.coalesce("access_count", F.lit(0)) + F.col("hits")).alias("access_count"), now.alias("last_accessed"), "hits")


def of_dimension(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of the index's dimension; nulls and others are rejected."""
    return vectors.where(F.size("embedding") == dim)


def quantised(v: Column) -> Column:
    """(lo, hi, codes): a vector in bytes, linear between its least and greatest value; a flat one is all 128."""
    lo, hi = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    code = F.transform(v, lambda x: F.when(hi > lo, F.floor((x.cast("double") - lo) * 255 / (hi - lo) + 0.5)).otherwise(128).cast("int"))
    return F.struct(lo.alias("lo"), hi.alias("hi"), code.alias("codes"))


def dequantised(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: q["lo"] + c * (q["hi"] - q["lo"]) / 255)


def _unit(vectors: list) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(q_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, threshold: float | None) -> Iterator[tuple]:
    for i, q in enumerate(q_ids):
        row = scores[i]
        at = np.flatnonzero(row >= threshold) if threshold is not None else np.arange(len(row))
        at = at[ids[at] != q]
        if len(at) > k:
            floor = np.partition(row[at], -k)[-k]
            at = at[row[at] >= floor]
            at = at[np.lexsort((ids[at], -row[at]))][:k]
        yield from ((q, ids[j], float(row[j])) for j in at)


def _blocks(vectors: DataFrame, size: int, as_name: str) -> DataFrame:
    """Vectors in blocks of about `size`, one row each."""
    n = max(1, -(-vectors.count() // size))
    rows = vectors.where("embedding is not null and size(embedding) > 0").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block"), F.size("embedding").alias("dim")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias(as_name)).drop("block")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, config: VectorConfig = VectorConfig()) -> DataFrame:
    """(query_id, vec_id, score): for each query the k nearest other vectors, exactly; with a threshold only those at or above it.

    Both sides are packed into blocks of a bounded size, each pair of blocks of one dimension is one product of matrices, and only the k best
    of a query within a block are shuffled. Ties go by vec_id. Null and empty vectors are nobody's neighbours.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    pairs = _blocks(vectors, config.vector_block, "v").join(_blocks(queries, config.query_block, "q"), "dim")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for v, q in zip(b.v, b.q):
                ids, q_ids = np.array([r["vec_id"] for r in v]), np.array([r["vec_id"] for r in q])
                scores = _unit([r["embedding"] for r in q]) @ _unit([r["embedding"] for r in v]).T
                yield pd.DataFrame(_best(q_ids, scores, ids, k, threshold), columns=["query_id", "vec_id", "score"])

    out = pairs.select("v", "q").mapInPandas(search, f"query_id {kind}, vec_id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def centroids(vectors: DataFrame, config: VectorConfig = VectorConfig()) -> np.ndarray:
    """Centres of the index's lists, by spherical k-means on at most fit_rows rows, those with the smallest hash."""
    lists = max(config.least_lists, math.isqrt(vectors.count()))
    rows = bounded_sample(vectors.where("embedding is not null"), ["vec_id"], config.fit_rows).orderBy("vec_id").select("embedding").collect()
    x = _unit([r.embedding for r in rows])
    rng = np.random.default_rng(config.seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(config.rounds):
        near = (x @ c.T).argmax(1)
        c = _unit([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def indexed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every vector with the list it belongs to."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf(T.IntegerType())
    def nearest_list(v: pd.Series) -> pd.Series:
        return pd.Series((_unit(list(v)) @ sent.value.T).argmax(1).astype("int32"))

    return vectors.where("embedding is not null").select("vec_id", "embedding", nearest_list("embedding").alias("list"))


def approximate(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, config: VectorConfig = VectorConfig()) -> DataFrame:
    """(query_id, vec_id, score): k nearest within the share `probed` of the lists, those closest to each query: a join on the list."""
    sent = index.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def near_lists(v: pd.Series) -> pd.Series:
        order = np.argsort(-(_unit(list(v)) @ sent.value.T), axis=1)[:, : math.ceil(config.probed * len(sent.value))]
        return pd.Series(list(order.astype("int32")))

    q = queries.where("embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.explode(near_lists("embedding")).alias("list"))
    scored = q.join(index, "list").where("query_id <> vec_id").select("query_id", "vec_id", cosine(F.col("q"), F.col("embedding")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of true neighbours that were found."""
    hit = truth.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("n_true"))

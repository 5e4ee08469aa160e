"""Exact nearest vectors by cosine (TOP-01, FN-14), in blocks.

Vectors are assigned to the nearest of some sampled centroids and packed, by their angle to it, into blocks that are
matrices. Query vectors are packed alike, and a pair of blocks is one matrix product. Angles on the sphere obey
the triangle inequality, so a pair of blocks whose centroids lie too far apart for a query's k-th best score is never
formed; that score comes from the pairs within a centroid. Joins are on the centroid, and nothing is approximate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import staged

#: Sampled centroids at most, and vectors of a block at most.
CENTROIDS, BLOCK = 64, 128
#: Scores are rounded to six digits, so what is this near to a k-th best score may tie with it.
SLACK = 2e-6
#: Centroid of vectors without length, whose cosine with everything is 0.
NONE = -1


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def _assign(centroids: np.ndarray):
    """same, key, centroid, angle and the unit vector as bytes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(np.array(batch.column("vector").to_pylist(), np.float64))
            cosines = np.clip(unit @ centroids.T, -1, 1)
            best = cosines.argmax(axis=1)
            angle = np.arccos(cosines[np.arange(len(best)), best])
            empty = ~unit.any(axis=1)
            centroid = np.where(empty, NONE, best).astype(np.int32)
            data = pa.array([row.tobytes() for row in unit], pa.binary())
            columns = [batch.column("same"), batch.column("id"), pa.array(centroid), pa.array(np.where(empty, 0.0, angle)), batch.column("least"), data]
            yield pa.RecordBatch.from_arrays(columns, ["same", "id", "centroid", "angle", "least", "data"])

    return run


def _pack(batches):
    """Consecutive rows of one tenant and centroid as blocks of at most BLOCK vectors."""
    held: list = []

    def block():
        same, centroid = held[0][0], held[0][2]
        angles = [r[3] for r in held]
        low, high = (0.0, np.pi) if centroid == NONE else (min(angles), max(angles))
        return same, centroid, low, high, [r[1] for r in held], [r[4] for r in held], b"".join(r[5] for r in held)

    names = ["same", "centroid", "low", "high", "ids", "leasts", "matrix"]
    for batch in batches:
        done = []
        kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.list_(batch.schema.field("id").type), pa.list_(pa.float64()), pa.binary()]
        for row in zip(*(batch.column(c).to_pylist() for c in ("same", "id", "centroid", "angle", "least", "data"))):
            if held and (len(held) == BLOCK or (row[0], row[2]) != (held[0][0], held[0][2])):
                done.append(block())
                held.clear()
            held.append(row)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(block(), kinds)], names)


def _products(k: int):
    """The best of each query of a pair of blocks: those that reach its least score, and its k best with all that tie with them."""

    def run(batches):
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            columns = (batch.column(c).to_pylist() for c in ("q_ids", "q_leasts", "q_matrix", "ids", "matrix"))
            for q_ids, leasts, q_matrix, ids, matrix in zip(*columns):
                q, x = (np.frombuffer(m, np.float64).reshape(len(i), -1) for m, i in ((q_matrix, q_ids), (matrix, ids)))
                scores = q @ x.T
                least = np.array([-2.0 if v is None else v for v in leasts])
                if len(ids) > k:
                    least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                for i, j in zip(*np.nonzero(scores >= least[:, None] - SLACK)):
                    out[0].append(q_ids[i])
                    out[1].append(ids[j])
                    out[2].append(float(scores[i, j]))
            kinds = [batch.schema.field(c).type.value_type for c in ("q_ids", "ids")]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kinds[0]), pa.array(out[1], kinds[1]), pa.array(out[2], pa.float64())], ["query_id", "id", "score"])

    return run


def _blocks(rows: DataFrame, centroids: np.ndarray, name: str) -> DataFrame:
    kind = dict(rows.dtypes)["id"]
    assigned = rows.mapInArrow(_assign(centroids), f"same string, id {kind}, centroid int, angle double, least double, data binary")
    order = ["same", "centroid", "angle", "id"]
    dealt = assigned.repartitionByRange(*order).sortWithinPartitions(*order)
    packed = dealt.mapInArrow(_pack, f"same string, centroid int, low double, high double, ids array<{kind}>, leasts array<double>, matrix binary")
    return staged(packed, name)


def nearest_vectors(points: DataFrame, queries: DataFrame, key: str, vector: str, k: int, same: str | None = None) -> DataFrame:
    """query_id, key, score (cosine to six digits) and rank of the k nearest points of each query, ties by key.

    `queries` has query_id, query_vector and, if a tenant column is named, `same`; only points of the same tenant (null is one)
    count. Null vectors have no score; vectors without length have the cosine 0. All vectors have one length.
    """
    tenant = lambda df: F.lit("") if same is None else F.coalesce(F.concat(F.lit("="), F.col(same).cast("string")), F.lit(""))
    no_score = F.lit(None).cast("double").alias("least")
    p = points.where(F.col(vector).isNotNull()).select(tenant(points).alias("same"), F.col(key).alias("id"), F.col(vector).alias("vector"), no_score)
    q = queries.where("query_vector is not null").select(tenant(queries).alias("same"), F.col("query_id").alias("id"), F.col("query_vector").alias("vector"), no_score)
    found = f"query_id {dict(q.dtypes)['id']}, id {dict(p.dtypes)['id']}, score double"
    sample = p.orderBy(F.xxhash64("id"), "id").limit(CENTROIDS).select("vector").collect()
    if not sample:
        return p.sparkSession.createDataFrame([], found).select("query_id", F.col("id").alias(key), "score", F.lit(0).alias("rank"))
    centroids = _unit(np.array([r.vector for r in sample], np.float64))
    centroids = centroids[centroids.any(axis=1)] if centroids.any() else centroids[:1]
    data = _blocks(p, centroids, "vector_blocks")
    asked = _blocks(q, centroids, "query_blocks")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def as_asked(blocks: DataFrame) -> DataFrame:
        return blocks.select("same", "centroid", *[F.col(c).alias(f"q_{c}") for c in blocks.columns if c not in ("same", "centroid")])

    def products(pairs: DataFrame) -> DataFrame:
        scored = pairs.select("q_ids", "q_leasts", "q_matrix", "ids", "matrix").mapInArrow(_products(k), found)
        best = scored.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(own))
        return best.where(F.col("rank") <= k)

    near = staged(products(as_asked(asked).join(data, ["same", "centroid"])), "near_vectors")
    least = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    asked = _blocks(q.drop("least").join(least, "id", "left").select("same", "id", "vector", "least"), centroids, "query_blocks")
    angles = np.arccos(np.clip(centroids @ centroids.T, -1, 1))
    numbers = range(NONE, len(centroids))
    reach = [(a, b, 0.0 if NONE in (a, b) else float(angles[a, b])) for a in numbers for b in numbers if a != b]
    reach = F.broadcast(p.sparkSession.createDataFrame(reach, "centroid int, other int, between double"))  # at most (CENTROIDS + 1)^2 rows

    # Pairs of blocks of different centroids, but for those of which no angle can be as small as the query block asks for.
    least_of_block = F.array_min(F.transform("q_leasts", lambda v: F.coalesce(v, F.lit(-1.0))))
    widest = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), least_of_block - SLACK))) + SLACK
    spread = as_asked(asked).withColumn("widest", widest).join(reach, "centroid").drop("centroid").withColumnRenamed("other", "centroid")
    outside = F.col("between") - F.col("q_high") - F.col("high") > F.col("widest")
    inside = F.col("low") - F.col("between") - F.col("q_high") > F.col("widest")
    far = products(spread.join(data, ["same", "centroid"]).where(~outside & ~inside))
    everything = near.union(far).drop("rank").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return everything.select("query_id", F.col("id").alias(key), "score", "rank")

"""Vector search: exact top-k with type filter, decay boost, floor and merging across projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import boosted


def unit(v: Column) -> Column:
    """The vector as doubles, of length one; a zero vector as it is."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def literal(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def of_type(df: DataFrame, artifact_type: str | None) -> DataFrame:
    if artifact_type is None:
        return df
    return df.where(F.col("artifact_type").isNull() if artifact_type == "session" else F.col("artifact_type") == artifact_type)


def top_k(index: DataFrame, query: Column, k: int, artifact_type: str | None = None, half_life_days: float = 0.0, now: float | None = None, floor: float | None = None) -> DataFrame:
    """index: id, embedding, artifact_type, ts. The filter goes below the limit; the boost only reorders the k rows; the floor cuts last."""
    scored = of_type(index, artifact_type).withColumn("score", dot(unit(F.col("embedding")), unit(query))).drop("embedding")
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    if now is not None and half_life_days > 0:
        best = best.withColumn("score", boosted(F.col("score"), F.col("artifact_type"), F.col("ts"), half_life_days, now)).orderBy(F.desc("score"), "id")
    if floor is not None:
        best = best.where(F.col("score") >= floor)
    return best


def top_k_across(index: DataFrame, query: Column, k: int) -> DataFrame:
    """Each project's k best, merged and cut to k; index also has project_path."""
    scored = index.withColumn("score", dot(unit(F.col("embedding")), unit(query))).drop("embedding")
    w = Window.partitionBy("project_path").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank").orderBy(F.desc("score"), "id").limit(k)


def nearest(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: k nearest of index for each of a stated, bounded set of queries, by blocks of index rows."""
    import numpy as np
    import pandas as pd

    rows = queries.select("query_id", "embedding").collect()
    if not rows:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    ids, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    q /= np.maximum(np.linalg.norm(q, axis=1), 1e-300)[:, None]

    def block(batches):
        for pdf in batches:
            v = np.array(pdf.embedding.tolist(), float)
            s = (v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]) @ q.T
            own = pdf.id.to_numpy()[:, None] == ids[None, :]
            s[own] = -2
            for j in range(len(ids)):
                at = np.lexsort((pdf.id.to_numpy(), -s[:, j]))[:k]
                at = at[s[at, j] > -2]
                yield pd.DataFrame({"query_id": ids[j], "id": pdf.id.to_numpy()[at], "score": s[at, j]})

    part = index.select("id", "embedding").mapInPandas(block, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank(hits: DataFrame, judge, k: int) -> DataFrame:
    """hits reordered by judge(list of texts) -> scores 0 to 10; on any failure or a wrong count, the order stays. hits is at most 3k rows."""
    rows = hits.collect()
    try:
        scores = [min(10.0, max(0.0, float(s))) / 10 for s in judge([(r["text"] or "")[:300].replace("\n", " ") for r in rows])]
        if len(scores) != len(rows):
            raise ValueError("as many scores as texts are needed")
        order = sorted(range(len(rows)), key=lambda i: -scores[i])
        out = [(*rows[i], scores[i]) for i in order][:k]
    except Exception:
        out = [(*r, r["score"]) for r in rows[:k]]
    schema = hits.schema.add("rerank_score", "double")
    return hits.sparkSession.createDataFrame(out, schema)

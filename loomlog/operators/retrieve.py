"""Retrieval of chunks by quality and recency, and duplicate removal among them."""

from __future__ import annotations

import heapq
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decay_factor, normalised, quality_score, strip
from ..session import importable

MIN_CHARS, MIN_QUALITY, MOST, NEAR = 30, 0.30, 200, 0.70


def effective_quality(half_life_days: float = 0.0, now: float | None = None) -> Column:
    q = F.when(F.col("quality_score") > 0, F.col("quality_score")).otherwise(quality_score(F.col("text")))
    return q * decay_factor(F.col("ts_end"), half_life_days, now) if now is not None else q


def recent(chunks: DataFrame, half_life_days: float = 0.0, now: float | None = None, most: int = MOST) -> DataFrame:
    """Long and good enough chunks, the best ``most`` by (effective quality, ts_end), in order of time."""
    kept = chunks.where(F.length(strip(F.col("text"))) >= MIN_CHARS).withColumn("q_eff", effective_quality(half_life_days, now)).where(F.col("q_eff") >= MIN_QUALITY)
    return kept.orderBy(F.desc("q_eff"), F.desc("ts_end"), "chunk_id").limit(most).orderBy("ts_end", "chunk_id")


def exact_dedup(chunks: DataFrame) -> DataFrame:
    """One chunk of each normalised text: the best by (quality_score, ts_end), the first of equals. Texts meet as 256-bit digests,
    combined before the shuffle, so neither texts nor a group of copies is gathered anywhere; chunk_id names a chunk."""
    key = F.sha2(normalised(F.col("text")), 256).alias("_key")
    best = chunks.select(key, "chunk_id", F.struct(-F.col("quality_score"), -F.col("ts_end"), F.col("chunk_id")).alias("_o")).groupBy("_key").agg(F.min_by("chunk_id", "_o").alias("chunk_id"))
    return chunks.join(best.select("chunk_id"), "chunk_id", "left_semi").select(*chunks.columns)


def is_near(m: SequenceMatcher, ratio: float) -> bool:
    """m.ratio() > ratio, read only until the blocks found decide it: what is found and the most that the open regions can add bound the ratio."""
    whole = len(m.a) + len(m.b)
    if not (m.real_quick_ratio() > ratio and m.quick_ratio() > ratio):
        return False
    found, open_ = 0, [(-min(len(m.a), len(m.b)), 0, len(m.a), 0, len(m.b))]
    most = -open_[0][0]
    while open_ and 2.0 * (found + most) / whole > ratio:
        if 2.0 * found / whole > ratio:
            return True
        bound, alo, ahi, blo, bhi = heapq.heappop(open_)
        most += bound
        i, j, k = m.find_longest_match(alo, ahi, blo, bhi)
        if k:
            found += k
            for x in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                n = min(x[1] - x[0], x[3] - x[2])
                if n:
                    heapq.heappush(open_, (-n, *x))
                    most += n
    return 2.0 * found / whole > ratio


def near_pairs(rows: DataFrame, ratio: float = NEAR) -> DataFrame:
    """(i, j), i < j, of at most ``MOST`` retrieved rows (ord, text) whose sequence ratio is over ``ratio``; pairs that their lengths rule out aren't compared."""
    m = SequenceMatcher(None)

    @F.udf("boolean")
    def near(a: str, b: str) -> bool:
        m.set_seq1(a)
        if m.b != b:
            m.set_seq2(b)
        return is_near(m, ratio)

    importable(rows.sparkSession)
    a, b = rows.select(F.col("ord").alias("i"), F.col("text").alias("ta")), rows.select(F.col("ord").alias("j"), F.col("text").alias("tb"))
    bound = 2 * F.least(F.length("ta"), F.length("tb")) > ratio * (F.length("ta") + F.length("tb"))
    pairs = a.join(b, (F.col("i") < F.col("j")) & bound).repartition(rows.sparkSession.sparkContext.defaultParallelism, "j").sortWithinPartitions("j")
    return pairs.where(near("ta", "tb")).select("i", "j")


def near_dedup(chunks: DataFrame, ratio: float = NEAR) -> DataFrame:
    """Exact, then near duplicates removed from a retrieved set (at most ``MOST`` rows), which keeps its order by (ts_end, chunk_id)."""
    w = Window.orderBy("ts_end", "chunk_id")
    rows = exact_dedup(chunks).withColumn("ord", F.row_number().over(w)).persist()  # else the set is retrieved anew for each use
    meta = {r["ord"]: (r["quality_score"], r["ts_end"]) for r in rows.select("ord", "quality_score", "ts_end").collect()}
    flagged: dict[int, list[int]] = {}
    for r in near_pairs(rows, ratio).collect():
        flagged.setdefault(r["i"], []).append(r["j"])
    gone: set[int] = set()
    for i in sorted(flagged):
        for j in sorted(flagged[i]) if i not in gone else ():
            if j in gone:
                continue
            if meta[j] > meta[i]:
                gone.add(i)
                break
            gone.add(j)
    return rows.where(~F.col("ord").isin(*gone)) .drop("ord") if gone else rows.drop("ord")

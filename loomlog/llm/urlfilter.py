"""URL filters: a blocked Bloom filter of listed canonical prefixes passes possible hits to an exact hash join.

Listed entries are (host, path) prefixes. A url's candidates are its host and all parent domains with every path prefix
whose length some entry has. The filter drops nearly all candidates; the join with the list removes false positives.

Edge cases: a null url, or one without ``://``: empty host and path, no rule, allowed; an empty list: all allowed; ties
between rules of equal length go to the longer host; repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, spread_join, staged

#: The listed rules (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BROADCAST_RULES = 200_000
_WORDS = 8  # 64-bit words of a block; each key sets one bit in each


class BlockedBloom:
    """Eight bits of one 512-bit block per key. Its size is bounded by max_bytes; a fuller filter only passes more on."""

    def __init__(self, entries: int, bits_per_entry: int = 16, max_bytes: int = 64 << 20):
        blocks = max(1, min(entries * bits_per_entry // 512 + 1, max_bytes // 64))
        self.table = np.zeros((blocks, _WORDS), np.uint64)

    def _at(self, keys: np.ndarray):
        keys = keys.view(np.uint64)
        with np.errstate(over="ignore"):
            spread = keys * np.uint64(0x9E3779B97F4A7C15)
        shifts = (spread[:, None] >> (np.arange(_WORDS, dtype=np.uint64) * np.uint64(6))) & np.uint64(63)
        return ((keys >> np.uint64(32)) % np.uint64(len(self.table))).astype(np.int64), np.uint64(1) << shifts

    def add(self, keys: np.ndarray) -> None:
        block, bit = self._at(keys)
        np.bitwise_or.at(self.table, block, bit)

    def might_have(self, keys: np.ndarray) -> np.ndarray:
        block, bit = self._at(keys)
        return ((self.table[block] & bit) == bit).all(axis=1)


def _filter_of(listed: DataFrame, entries: int) -> BlockedBloom:
    """The filter of listed's keys: each task fills a part, parts are joined segment by segment, the driver gets each segment once."""
    empty = BlockedBloom(entries)
    width = 4096  # blocks of a segment: 256 KB

    def parts(batches):
        own = BlockedBloom(entries)
        for batch in batches:
            own.add(batch.column(0).to_numpy())
        for at in range(0, len(own.table), width):
            piece = own.table[at : at + width]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([piece.tobytes()], pa.binary())], names=["at", "words"])

    def joined(key, table):
        out = np.frombuffer(table.column("words")[0].as_py(), np.uint64).copy()
        for x in table.column("words")[1:]:
            out |= np.frombuffer(x.as_buffer(), np.uint64)
        return pa.table({"at": [key[0].as_py()], "words": pa.array([out.tobytes()], pa.binary())})

    segments = listed.select("key").mapInArrow(parts, "at long, words binary").groupBy("at").applyInArrow(joined, "at long, words binary")
    for row in segments.toLocalIterator():
        found = np.frombuffer(row["words"], np.uint64).reshape(-1, _WORDS)
        empty.table[row["at"] : row["at"] + len(found)] = found
    return empty


def canonical(pages: DataFrame) -> DataFrame:
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.select("page_id", F.coalesce(F.translate(host, upper, lower), F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def judge(pages: DataFrame, listed: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict. listed: rule_host, rule_path, rule_verdict."""
    listed = staged(listed.withColumn("key", F.xxhash64("rule_host", "rule_path")), "listed")
    entries = listed.count()
    bloom = _filter_of(listed, entries)
    lengths = [r[0] for r in listed.select(F.length("rule_path")).distinct().collect()]  # distinct lengths of listed paths
    shared = pages.sparkSession.sparkContext.broadcast(bloom)
    rows = canonical(pages).withColumn("row", F.monotonically_increasing_id())
    rows = staged(rows, "urls")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    cand = rows.where("host <> ''").select("row", "path", F.explode(suffixes).alias("rule_host"))
    cand = cand.withColumn("n", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.expr("array()").cast("array<int>"))).where("length(path) >= n")
    cand = cand.select("row", "rule_host", F.expr("substring(path, 1, n)").alias("rule_path"))
    cand = cand.withColumn("key", F.xxhash64("rule_host", "rule_path"))

    def probe(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.might_have(batch.column("key").to_numpy())))

    hits = cand.mapInArrow(probe, cand.schema)
    exact = listed.groupBy("rule_host", "rule_path").agg(F.min(F.struct((F.col("rule_verdict") != "block").alias("o"), "rule_verdict"))["rule_verdict"].alias("rule_verdict"))
    on = ["rule_host", "rule_path"]
    if entries <= BROADCAST_RULES:  # a checked size
        hits = hits.join(F.broadcast(exact), on)
    else:  # a rule that fits a large part of all urls is dealt in parts
        key = F.xxhash64(*on).alias("rule_key")
        hits = staged(hits.select("*", key), "hits")
        hits = spread_join(hits, exact.select(key, F.col("rule_host").alias("h"), F.col("rule_path").alias("p"), "rule_verdict"), "rule_key", hot_keys(hits, "rule_key", hits.count()), "row")
        hits = hits.where("rule_host = h and rule_path = p")
    best = hits.groupBy("row").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))).alias("b"))
    out = rows.join(best, "row", "left")
    return out.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.rule_verdict", F.lit(otherwise)).alias("verdict"))

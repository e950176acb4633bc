"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document's key is -ln(u) / quality with u uniform in (0, 1) from a hash of doc_id and seed, so a rerun draws the
same. Within a source documents are taken by ascending key until the source's token budget: whole epochs of the source
first, then the fraction that is left. The document on the boundary gives the words that still fit.

Edge cases: a null source is a source, ordered last; a null or empty text has size 0 and is never taken; rows with the
same doc_id have the same key, and each is counted; an empty table gives an empty result; a source without words gets a
target of 0; rows of one doc_id and size are ordered by a hash of the text; other columns, clashing names too, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, staged

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """A document's weight in (0, 1]: the part of its words that are letters with at most one mark after them; at least 0.1."""
    plain = F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])\p{L}++[.,;:!?]?(?![^\x20\x09-\x0D])"))
    return F.greatest(F.lit(0.1), F.coalesce(plain / F.when(size > 0, size), F.lit(0.0)))


def targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: int = 2) -> DataFrame:
    """skey, source, source_size, weight, target of each source. One row per distinct source; the driver only gets sums."""
    per = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    per = ranked(per, F.col("source").asc_nulls_last())
    rank = F.col("rank")
    per = staged(per.select("skey", "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long").alias("weight")), "sources")
    level, closed = 0.0, -1
    while True:
        full = limit * F.col("source_size") <= level * F.col("weight")
        row = per.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(full, limit * F.col("source_size"))), F.lit(0)).alias("closed_size"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"), F.count(F.when(full, 1)).alias("closed"),
        ).first()
        if row["closed"] == closed or not row["open"]:
            break
        closed = row["closed"]
        level = max(level, (share * row["all"] - row["closed_size"]) / row["open"])
    return per.withColumn("target", F.least((limit * F.col("source_size")).cast("double"), level * F.col("weight")))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: int = 2, seed: int = 7, cells: int | None = None, tie: Column | None = None) -> DataFrame:
    """docs has doc_id, source, size, quality and any others; adds source_size, target, taken.

    No source is gathered in one task: keys fall into cells by their order, one aggregate per source and cell gives the
    words before each cell, and only rows of the same source and cell are sorted together."""
    clash = [c for c in docs.columns if c not in ("doc_id", "source", "size", "quality")]
    rows = docs.select("doc_id", "source", "size", "quality", F.struct(*clash).alias("_rest") if clash else F.lit(0).alias("_rest"), (F.lit(0) if tie is None else tie).alias("_tie"))
    if cells is None:
        cells = max(64, docs.select("size").count() // 1000)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = (
        rows.withColumn("skey", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")))
        .withColumn("key", -F.log(u) / F.col("quality"))
        .withColumn("cell", F.least(F.lit(cells - 1), F.floor((1 - F.exp(-F.col("key"))) * cells)).cast("long"))
    )
    per_cell = staged(rows.groupBy("skey", "cell").agg(F.first("source").alias("source"), F.sum("size").alias("size")), "cells")
    goal = targets(per_cell, weights, share, limit)
    before = Window.partitionBy("skey").orderBy("cell")
    bounds = (
        per_cell.withColumn("cell_before", F.sum("size").over(before) - F.col("size"))
        .join(goal.drop("source", "weight"), "skey")
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
        .select("skey", "cell", "cell_before", "source_size", "target", "epochs", (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("part"))
    )
    order = Window.partitionBy("skey", "cell").orderBy("key", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (
        rows.join(bounds, ["skey", "cell"])
        .withColumn("before", F.col("cell_before") + F.sum("size").over(order) - F.col("size"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("before"))))
    )
    rest = [F.col("_rest")[c].alias(c) for c in clash]
    return out.select("doc_id", "source", "size", "quality", "source_size", "target", "taken", *rest)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, quality, text_hash: staged, so that the texts are read once."""
    rows = docs.select("doc_id", "source", "text").withColumn("size", size_of(F.col("text")))
    return staged(rows.select("doc_id", "source", "size", quality_of(F.col("text"), F.col("size")).alias("quality"), F.xxhash64("text").alias("text_hash")), "sized")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix has them: a row for each time a document is taken, the one on the boundary if half of it fits."""
    names = docs.columns
    rows = docs.withColumn("_row", F.struct(*names)).select("doc_id", "source", "_row", size_of(F.col("text")).alias("size"), F.col("text").alias("_text"))
    rows = rows.select("doc_id", "source", "size", quality_of(F.col("_text"), F.col("size")).alias("quality"), "_row")
    out = mix(rows, **{"tie": F.xxhash64(F.col("_row")["text"])} | how)
    times = F.floor((2 * F.col("taken") + F.col("size")) / F.when(F.col("size") > 0, 2 * F.col("size")))
    out = out.where("size > 0").withColumn("_times", times.cast("int")).where("_times > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*(F.col("_row")[c].alias(c) for c in names))

"""Assistant transcripts (one JSON object per line) as turns, by variant: message content is a string or a list of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

#: Wrappers that aren't a user's words.
WRAPPERS = r"^(?:<command-|<local-command-|<task-notification>|<system-reminder>|<bash-input>|<bash-stdout>|<bash-stderr>)"


def _text(blocks: Column, user: bool) -> Column:
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: strip(F.coalesce(b["text"], F.lit(""))))
    return F.array_join(F.filter(texts, lambda t: (t != "") & (_said(t) if user else F.lit(True))), "\n")


def _said(text: Column) -> Column:
    return ~text.rlike(WRAPPERS) & ~F.contains(F.lower(text), F.lit("request interrupted by user"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """session_id, line, role, text, ts, slug of kept lines; malformed, side-chain and meta lines are skipped."""
    raw = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1).alias("session_id"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id()).alias("line"))
    return parse(raw)


def parse(raw: DataFrame) -> DataFrame:
    v = F.try_parse_json("value")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    rows = raw.select("session_id", "line", v.alias("v")).where("v is not null")
    rows = rows.where(get("$.type", "string").isin("user", "assistant") & ~F.coalesce(get("$.isSidechain", "boolean"), F.lit(False)) & ~F.coalesce(get("$.isMeta", "boolean"), F.lit(False)))
    content = get("$.message.content", "string")
    blocks = get("$.message.content", "array<struct<type:string,text:string>>")
    role = get("$.type", "string")
    plain = strip(content)
    user = F.when(blocks.isNotNull(), _text(blocks, True)).when(_said(plain), plain)
    said = F.when(role == "user", user).otherwise(F.when(blocks.isNotNull(), _text(blocks, False)).otherwise(plain))
    return rows.select("session_id", "line", role.alias("role"), F.nullif(said, F.lit("")).alias("text"), get("$.timestamp", "string").alias("ts"), F.nullif(get("$.slug", "string"), F.lit("")).alias("slug")).where("text is not null")


def slugs(rows: DataFrame) -> DataFrame:
    return rows.where("slug is not null").select("slug").distinct()

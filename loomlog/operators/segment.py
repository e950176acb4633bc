"""Segmentation: turns of a conversation, chunks of turns, terminal events, plans, todos and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_tokens, quality_score, strip, strip_noise

MAX_CHARS, OVERLAP = 2048, 200


def turns(messages: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """session, turn_number, full_text: a user message opens a turn, assistant texts after it join it; those before the first are dropped."""
    w = Window.partitionBy(session).orderBy(order)
    said = messages.where(F.col("role").isin("user", "assistant")).withColumn("turn_number", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).where("turn_number > 0")
    part = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))
    return said.groupBy(session, "turn_number").agg(F.array_join(F.transform(listed, lambda x: x["p"]), "\n\n").alias("full_text"))


def split_paragraphs(text: Column, most: int = MAX_CHARS) -> Column:
    """Paragraphs packed greedily up to ``most`` characters; only the last pack is cut by force; a blank last one is dropped."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, para: Column) -> Column:
        joined = F.when(acc["cur"] == "", para).otherwise(F.concat(acc["cur"], F.lit("\n\n"), para))
        full = (F.length(joined) > most) & (acc["cur"] != "")
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"), F.when(full, para).otherwise(joined).alias("cur"))

    def end(acc: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(acc["cur"]) / most).cast("int") - 1)), lambda k: F.substring(acc["cur"], k * most + 1, F.lit(most)))
        last = F.size(cuts)
        tail = F.filter(cuts, lambda x, i: (i < last - 1) | (strip(x) != ""))
        return F.when(strip(acc["cur"]) == "", acc["done"]).otherwise(F.concat(acc["done"], tail))

    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.aggregate(F.split(text, "\n\n"), start, step, end))


def chunks_of_turns(turned: DataFrame, session: str = "conv_id", most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks with the last ``overlap`` characters of the turn's previous segment before each segment."""
    seg = turned.where(strip(F.col("full_text")) != "").select(session, "turn_number", F.posexplode(split_paragraphs(F.col("full_text"), most)).alias("k", "seg"))
    before = F.lag("seg").over(Window.partitionBy(session, "turn_number").orderBy("k"))
    index = F.row_number().over(Window.partitionBy(session).orderBy("turn_number", "k")) - 1
    out = seg.withColumn("text", F.concat(F.coalesce(F.right(before, F.lit(overlap)), F.lit("")), "seg")).withColumn("index", index)
    return out.select(F.concat_ws("-", F.col(session).cast("string"), "index").alias("chunk_id"), F.col(session), "turn_number", "index", "text", chunk_tokens(F.col("text")).alias("token_estimate"), quality_score(F.col("text")).alias("quality_score"))


def forced_split(texts: DataFrame, key: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Fixed-size segments with overlap of the previous one."""
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / most).cast("int") - 1))
    seg = texts.select(key, "text", F.explode(parts).alias("k"))
    return seg.select(key, "k", F.expr(f"concat(if(k = 0, '', right(substring(text, (k - 1) * {most} + 1, {most}), {overlap})), substring(text, k * {most} + 1, {most}))").alias("text"))


def segment_events(events: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """session_id, k, text, ts_start, ts_end of terminal output: events joined in time, cut at blank lines in an event
    (kept at the segment's end) and by force beyond ``most``; blank segments dropped. One session is one group."""
    import pandas as pd

    def cut(pdf):
        pdf, out, held, first = pdf.sort_values("ts", kind="stable"), [], "", None
        sid = pdf.session_id.iloc[0]

        def flush(text: str, ts: float) -> None:
            if text.strip():
                out.append((sid, len(out), text, first, ts))

        for content, ts in zip(pdf.content, pdf.ts, strict=True):
            first = ts if first is None else first
            *ended, rest = content.split("\n\n")
            for part in ended:
                flush(held + part + "\n\n", ts)
                held, first = "", ts
            held += rest
            while len(held) > most:
                flush(held[:most], ts)
                held, first = held[most:], ts
        if len(pdf):
            flush(held, float(pdf.ts.iloc[-1]))
        return pd.DataFrame(out, columns=["session_id", "k", "text", "ts_start", "ts_end"])

    rows = events.where("stream = 'stdout'").select("session_id", F.col("ts").cast("double").alias("ts"), "content")
    return rows.groupBy("session_id").applyInPandas(cut, "session_id string, k int, text string, ts_start double, ts_end double")


def todo_text(items: str = "items") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("[TODO] "), x["status"], F.lit(" ("), x["priority"], F.lit("): "), x["content"])), "\n")


def task_text() -> Column:
    def listed(label: str, name: str) -> Column:
        return F.when(F.size(name) > 0, F.concat(F.lit(f"{label}: "), F.array_join(name, ", ")))

    return F.concat_ws("\n", F.concat(F.lit("[TASK] "), "subject", F.lit(" ("), "status", F.lit(")")), F.when(F.col("description") != "", F.col("description")), listed("Blocks", "blocks"), listed("Blocked by", "blocked_by"))


def plan_sections(plans: DataFrame) -> DataFrame:
    """slug, index, text: a plan's parts from each line that starts with ``## ``; text before the first has no heading."""
    parts = plans.select("slug", F.posexplode(F.split("text", r"(?m)^## ")).alias("k", "part")).where("k > 0 or part <> ''")
    head = F.regexp_extract("part", r"^([^\n]*)", 1)
    body = strip(F.when(F.col("k") == 0, F.col("part")).otherwise(F.regexp_replace("part", r"^[^\n]*\n?", "")))
    text = F.concat(F.lit("[PLAN: "), "slug", F.lit("] "), F.when(F.col("k") == 0, "").otherwise(F.concat(F.lit("## "), strip(head))), F.lit("\n"), body)
    w = Window.partitionBy("slug").orderBy("k")
    return parts.select("slug", (F.row_number().over(w) - 1).alias("index"), F.regexp_replace(text, r"^(\[PLAN: [^\]]*\]) \n", "$1\n").alias("text"))


def artifact_chunks(texts: DataFrame) -> DataFrame:
    """texts (session_id, artifact_type, artifact_id, index, text, ts) as chunks."""
    ident = F.concat_ws("-", F.col("artifact_type"), F.col("artifact_id"), F.col("index").cast("string"))
    return texts.select(ident.alias("chunk_id"), "session_id", "index", "text", F.col("ts").alias("ts_start"), F.col("ts").alias("ts_end"), chunk_tokens(F.col("text")).alias("token_estimate"), quality_score(F.col("text")).alias("quality_score"), "artifact_type", "artifact_id")


def todo_chunks(todos: DataFrame) -> DataFrame:
    """todos: session_id, items, mtime. One chunk for each list that has items."""
    rows = todos.where(F.size("items") > 0).select("session_id", F.lit("todo").alias("artifact_type"), F.col("session_id").alias("artifact_id"), F.lit(0).alias("index"), todo_text().alias("text"), F.col("mtime").alias("ts"))
    return artifact_chunks(rows)


def task_chunks(tasks: DataFrame) -> DataFrame:
    """tasks: session_id, id, subject, status, description, blocks, blocked_by. The index is the id if it is a number, else 0; no time."""
    index = F.when(F.col("id").rlike(r"^[0-9]{1,9}$"), F.col("id").cast("int")).otherwise(0)
    return artifact_chunks(tasks.select("session_id", F.lit("task").alias("artifact_type"), F.concat_ws("-", "session_id", "id").alias("artifact_id"), index.alias("index"), task_text().alias("text"), F.lit(0.0).alias("ts")))


def terminal_chunks(events: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of terminal sessions: noise out of each event, segments, the end of the one before in front of each, noise out again
    where the two have met, blank ones dropped, tokens and quality."""
    clean = events.where("stream = 'stdout'").withColumn("content", strip_noise(F.col("content")))
    w = Window.partitionBy("session_id").orderBy("k")
    seg = segment_events(clean, most).withColumn("before", F.lag("text").over(w))
    text = strip_noise(F.concat(F.coalesce(F.right("before", F.lit(overlap)), F.lit("")), "text"))
    rows = seg.select("session_id", "k", text.alias("text"), "ts_start", "ts_end").where(strip(F.col("text")) != "")
    index = (F.row_number().over(w) - 1).alias("index")
    return rows.select(F.concat_ws("-", F.col("session_id"), (F.row_number().over(w) - 1).cast("string")).alias("chunk_id"), "session_id", index, "text", "ts_start", "ts_end", chunk_tokens(F.col("text")).alias("token_estimate"), quality_score(F.col("text")).alias("quality_score"))


def chunk_sessions(sessions: DataFrame, events: DataFrame, messages: DataFrame) -> DataFrame:
    """Chunks of sessions (session_id): from the transcript's messages (session_id, turn, role, text) where there is one, else from terminal output."""
    said = messages.join(sessions.select("session_id"), "session_id", "left_semi")
    a = chunks_of_turns(turns(said, "session_id"), "session_id").select("chunk_id", "session_id", "index", "text", "token_estimate", "quality_score")
    rest = sessions.select("session_id").join(said.select("session_id").distinct(), "session_id", "left_anti")
    b = terminal_chunks(events.join(rest, "session_id", "left_semi"))
    return a.unionByName(b.select(a.columns))

"""Context packs: a budgeted report on sessions as XML, JSON or Markdown."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock, xml_escape
from ..operators import retrieve, sessions
from . import budget as budgets


def excerpts_xml(chunks: DataFrame) -> DataFrame:
    body = F.concat(F.lit('    <EXCERPT session="'), xml_escape(F.col("session_id")), F.lit('">\n'), xml_escape(F.col("text")), F.lit("\n    </EXCERPT>"))
    return chunks.select("chunk_id", body.alias("fragment"))


def excerpts_json(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.to_json(F.struct("session_id", "text")).alias("fragment"))


def excerpts_markdown(chunks: DataFrame) -> DataFrame:
    span = F.when(F.col("ts_start") != 0, F.col("ts_end") - F.col("ts_start")).otherwise(0.0)
    return chunks.select("chunk_id", F.concat(F.lit("### "), "session_id", F.lit(" ("), clock(span), F.lit(")\n"), "text").alias("fragment"))


FRAGMENTS = {"xml": excerpts_xml, "json": excerpts_json, "md": excerpts_markdown}


def infer_mode(sessions_df: DataFrame, chunks: DataFrame) -> str:
    row = sessions.episodes(sessions_df, chunks).join(sessions.latest(sessions_df).select("session_id"), "session_id").select("episode_type").first()
    return budgets.MODES.get(row[0], "auto") if row else "auto"


def latest_error(sessions_df: DataFrame, chunks: DataFrame) -> DataFrame:
    bad = sessions.errors(sessions_df, chunks).where("has_error").select("session_id")
    return sessions.latest(sessions_df.join(bad, "session_id", "left_semi"))


def build(sessions_df: DataFrame, chunks: DataFrame, state: dict, budget: int = 6000, fmt: str = "xml", mode: str = "auto", now: float | None = None, half_life_days: float = 0.0,
          active_items: list[str] = (), plans: list[str] = (), overrides: dict | None = None, root: str = "SESSION_CONTEXT") -> str:
    """The pack as text. Retrieval is distributed; at most ``retrieve.MOST`` excerpts reach the driver, where they are fitted."""
    if budget < 100:
        raise ValueError("a budget is at least 100 tokens")
    if mode == "auto":
        mode = infer_mode(sessions_df, chunks)
    failed = latest_error(sessions_df, chunks).first() if mode == "debug" else None
    if failed:
        found = sessions.around_failure(sessions_df, chunks, failed["session_id"])
    else:
        found = retrieve.near_dedup(retrieve.recent(chunks, half_life_days, now))
    keyed = FRAGMENTS[fmt](found).join(found.select("chunk_id", "ts_end"), "chunk_id").orderBy("ts_end", "chunk_id")
    texts = [r["fragment"] for r in keyed.collect()]
    stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now or time.time()))
    esc = lambda x: str(x).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    tokens = lambda t: int(len(t) / 4 * 1.1)
    if fmt == "xml":
        parts = {
            "PROJECT_STATE": [f"<SUMMARY generated=\"{stamp}\">{esc(state.get('summary', ''))}</SUMMARY>"],
            "DECISIONS": [f"<DECISION id=\"{esc(d.get('id', ''))}\">{esc(d.get('statement', ''))}</DECISION>" for d in state.get("decisions", [])],
            "CONSTRAINTS": [f"<CONSTRAINT>{esc(c)}</CONSTRAINT>" for c in state.get("constraints", [])],
            "ACTIVE_TASKS": list(active_items) or [f"<TASK id=\"{esc(t.get('id', ''))}\" status=\"{esc(t.get('status', ''))}\"/>" for t in state.get("tasks", [])],
            "PLANS": list(plans), "RECENT_CONTEXT_EXCERPTS": texts, "INSTRUCTIONS": ["Use this context to continue the work."],
        }
        def document(parts: dict[str, list[str]]) -> str:
            body = [f"  <{k}>\n" + "\n".join(v) + f"\n  </{k}>" if v else f"  <{k}/>" for k, v in parts.items() if v or k != "PLANS"]
            return f'<{root} version="1.0">\n' + "\n".join(body) + f"\n</{root}>"

        if tokens(document(parts)) > budget:
            frame = tokens(document({k: [] for k in parts})) + len(parts)  # tags, and what rounding each section may lose
            parts = budgets.apply_sections(parts, budget - frame, budgets.profile(mode, overrides))
        return document(parts)
    while True:
        if fmt == "json":
            out = json.dumps({"generated_at": stamp, "state": state, "active_items": list(active_items), "plans": list(plans), "excerpts": [json.loads(t) for t in texts]}, ensure_ascii=False)
        else:
            listed = lambda title, rows, none: [f"## {title}", *(rows or [none]), ""]
            lines = ["# Session context", "", "## Project State", f"**Generated**: {stamp}", state.get("summary", ""), ""]
            lines += listed("Decisions", [f"- **{d.get('id', '')}**: {d.get('statement', '')}" for d in state.get("decisions", [])], "No decisions recorded.")
            lines += listed("Constraints", [f"- {c}" for c in state.get("constraints", [])], "No constraints recorded.")
            lines += listed("Active Tasks", list(active_items) or [f"- **{t.get('id', '')}**: {t.get('status', '')}" for t in state.get("tasks", [])], "No active tasks.")
            lines += listed("Recent Context", texts, "No recent context available.")
            out = "\n".join(lines)
        if tokens(out) <= budget or not texts:
            return out
        texts.pop(0)

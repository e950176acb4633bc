"""Token budgets: modes, section profiles, prefixes that fit, greedy folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import budget_tokens, strip
from ..operators.sessions import lookup

SECTIONS = ("project_state", "decisions", "active_tasks", "plans", "recent_context")
#: Shares of the budget by mode and section; the mode of each episode type.
PROFILES = {
    "auto": (0.15, 0.15, 0.15, 0.15, 0.40),
    "debug": (0.10, 0.05, 0.05, 0.05, 0.75),
    "build": (0.15, 0.20, 0.20, 0.20, 0.25),
    "explore": (0.25, 0.15, 0.05, 0.15, 0.40),
}
MODES = {"debug": "debug", "build": "build", "refactor": "build", "config": "build", "test": "build", "deploy": "build", "explore": "explore", "docs": "explore", "review": "explore"}


def profile(mode: str, overrides: dict[str, float] | None = None) -> dict[str, float]:
    """The mode's shares with overrides, summing to one."""
    base = dict(zip(SECTIONS, PROFILES.get(mode, PROFILES["auto"]), strict=True))
    if not overrides:
        return base
    base |= {k: float(v) for k, v in overrides.items() if k in base}
    total = sum(base.values())
    return dict(zip(SECTIONS, PROFILES["auto"], strict=True)) if total <= 0 else {k: v / total for k, v in base.items()}


def mode_of(episode: Column) -> Column:
    return F.coalesce(lookup(MODES)[episode], F.lit("auto"))


def fitting_prefix(rows: DataFrame, order: list, budget: int, cost: Column) -> DataFrame:
    """The longest prefix in order whose costs sum to at most budget, as a running sum over a retrieved set."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def greedy_fit(rows: DataFrame, group: str, order: Column, cost: Column, ident: Column, budget: int) -> DataFrame:
    """Per group, the ids that a greedy pass in order takes: what doesn't fit is skipped and later items may fit."""
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), cost.cast("long").alias("c"), ident.alias("i"))))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["c"] <= acc["left"]
        return F.struct((acc["left"] - F.when(fits, x["c"]).otherwise(0)).alias("left"), F.when(fits, F.concat(acc["ids"], F.array(x["i"]))).otherwise(acc["ids"]).alias("ids"))

    return rows.groupBy(group).agg(listed.alias("_l")).select(group, F.aggregate("_l", start, step)["ids"].alias("ids"))


def sample_for_state(chunks: list[tuple[float, float, str]], budget: int = 8000) -> str:
    """(quality, ts_end, text) of a retrieved set: all if they fit, else first and last and the best that fit, in time order."""
    rows = list(enumerate(chunks))
    if sum(len(t) for _, (_, _, t) in rows) + 2 * max(0, len(rows) - 1) <= budget:
        return "\n\n".join(t for _, (_, _, t) in sorted(rows, key=lambda r: r[1][1]))
    anchors = list(dict.fromkeys([min(rows, key=lambda r: r[1][1])[0], max(rows, key=lambda r: r[1][1])[0]]))
    taken, left = set(anchors), budget - sum(len(chunks[i][2]) for i in anchors) - 2 * (len(anchors) - 1)
    for i, (_, _, text) in sorted((r for r in rows if r[0] not in taken), key=lambda r: (-r[1][0], r[1][1], r[1][2])):
        if left <= 0:
            break
        if len(text) <= left:
            taken.add(i)
            left -= len(text) + 2
    return "\n\n".join(chunks[i][2] for i in sorted(taken, key=lambda i: chunks[i][1]))


def sample_of_all(chunks: DataFrame, budget: int = 8000, least: float = 0.3, batch: int = 100) -> str:
    """``sample_for_state`` over all chunks (chunk_id, text, ts_end, quality_score) that aren't blank and are good enough. Candidates come in
    order of quality, a batch of those that still fit at a time, until none does; texts longer than the budget stay where they are, but for the anchors."""
    rows = chunks.select(F.col("quality_score").alias("q"), F.col("ts_end").alias("ts"), strip(F.col("text")).alias("text"), "chunk_id").withColumn("n", F.length("text")).where("n > 0")
    good = F.col("q") >= least
    row = F.struct("q", "ts", "text")
    all_ = rows.where(good).agg(F.count("*").alias("rows"), F.sum("n").alias("chars"), F.min_by(row, F.struct("ts", "chunk_id")).alias("first"), F.min_by(row, F.struct(-F.col("ts"), F.col("chunk_id"))).alias("last"), (F.min("ts") == F.max("ts")).alias("one")).first()
    if not all_["rows"]:
        return ""
    if all_["chars"] + 2 * (all_["rows"] - 1) <= budget:
        return "\n\n".join(r["text"] for r in rows.where(good).select("ts", "chunk_id", "text").orderBy("ts", "chunk_id").collect())
    chosen = [tuple(all_["first"])] + ([] if all_["one"] else [tuple(all_["last"])])
    anchors, passed, left = list(chosen), [], budget - sum(len(t) for *_, t in chosen) - 2 * (len(chosen) - 1)
    while left > 0:
        # what was passed over for its length is too long for good; of the rest the passed ones come first; lengths are tested before the costlier quality
        some = rows.where((F.col("n") <= left) & good).orderBy(F.desc("q"), "ts", "text").offset(sum(n <= left for n in passed)).limit(batch).select("q", "ts", "text").collect()
        for r in map(tuple, some):
            passed.append(len(r[2]))
            if r in anchors:
                anchors.remove(r)
            elif len(r[2]) <= left:
                chosen.append(r)
                left -= len(r[2]) + 2
        if len(some) < batch:
            break
    return "\n\n".join(t for *_, t in sorted(chosen, key=lambda r: r[1]))


def apply_sections(sections: dict[str, list[str]], budget: int, shares: dict[str, float], protected=("INSTRUCTIONS", "CONSTRAINTS", "PROJECT_STATE")) -> dict[str, list[str]]:
    """Each unprotected section cut to whole leading elements within its share of what the protected leave; unused shares stay unused."""
    tokens = lambda parts: int(len("\n".join(parts)) / 4 * 1.1)
    if sum(tokens(v) for v in sections.values()) <= budget:
        return sections
    free = max(0, budget - sum(tokens(v) for k, v in sections.items() if k in protected))
    names = {"DECISIONS": "decisions", "ACTIVE_TASKS": "active_tasks", "PLANS": "plans", "RECENT_CONTEXT_EXCERPTS": "recent_context"}
    whole = sum(shares[v] for v in names.values()) or 1.0
    out = dict(sections)
    for section, share in names.items():
        parts, cap = list(sections.get(section, [])), int(free * shares[share] / whole)
        while parts and tokens(parts) > cap:
            parts.pop()
        if section in out:
            out[section] = parts
    return out


def section_costs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tokens", budget_tokens(F.col("content")))


def decay_config(config: dict | None) -> tuple[bool, float]:
    """(enabled, half-life in days) of a configuration; 14 days, and off unless it says otherwise."""
    given = (config or {}).get("decay") or {}
    return bool(given.get("enabled", False)), float(given.get("half_life_days", 14.0))


def fill_sections(sections: DataFrame, budget: int) -> DataFrame:
    """sections: pack, name, content, priority, protected, max_tokens (0: no cap). Contents that fit a budget of tokens per pack: a cap always
    cuts an unprotected section; if the pack is over the budget, its unprotected sections are filled by priority from what the protected
    ones leave, each cut to what is left. A pack's sections are few, so they are folded as one list."""
    tokens = lambda x: f"int(length({x}) / 4D * 1.1D)"
    cut = lambda x, n: f"substring({x}, 1, greatest(0, int({n} * 4 / 1.1D)))"
    capped = sections.withColumn("content", F.expr(f"if(not protected and max_tokens > 0 and {tokens('content')} > max_tokens, {cut('content', 'max_tokens')}, content)")).withColumn("t", F.expr(tokens("content")))
    listed = F.array_sort(F.collect_list(F.when(~F.col("protected"), F.struct("priority", "name", "t", "max_tokens"))))
    per = capped.groupBy("pack").agg(F.sum("t").alias("all"), F.sum(F.when(F.col("protected"), F.col("t")).otherwise(0)).alias("held"), listed.alias("l"))
    given = F.expr(f"""if(all <= {budget}, null, aggregate(l, named_struct('left', greatest(0L, {budget} - held), 'got', cast(map() as map<string,bigint>)),
        (s, x) -> named_struct('left', s.left - least(x.t, s.left, if(x.max_tokens > 0, bigint(x.max_tokens), s.left)), 'got', map_concat(s.got, map(x.name, least(x.t, s.left, if(x.max_tokens > 0, bigint(x.max_tokens), s.left))))), s -> s.got))""")
    out = capped.join(per.select("pack", given.alias("got")), "pack")
    content = F.expr(f"if(protected or got is null or got[name] >= t, content, {cut('content', 'got[name]')})")
    return out.select("pack", "name", content.alias("content"), "priority", "protected", "max_tokens")


def sources_in_order(chunks: DataFrame) -> DataFrame:
    """session_id and place of each session, in the order in which their chunks (ts_end, chunk_id) first come."""
    first = chunks.groupBy("session_id").agg(F.min(F.struct("ts_end", "chunk_id")).alias("first"))
    return first.orderBy("first", "session_id").select("session_id", "first.ts_end")


def generate_state(chunks: DataFrame, chat, now: float, budget: int = 8000) -> dict:
    """A project state by ``chat(text) -> dict`` (summary, decisions, constraints, tasks) of the sampled chunks, with its sources and time;
    without a good chunk, an empty state."""
    good = chunks.where((F.col("quality_score") >= 0.3) & (strip(F.col("text")) != ""))
    text = sample_of_all(good, budget)
    empty = {"summary": "", "decisions": [], "constraints": [], "tasks": []}
    said = chat(text) if text else {}
    return empty | {k: v for k, v in said.items() if k in empty} | {"updated_at": now, "source_sessions": [r["session_id"] for r in sources_in_order(good).collect()]}

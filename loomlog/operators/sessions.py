"""Sessions: grouping events, errors, episode types, neighbours, the session graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, strip

#: Episode types in order of declaration, words that point to them, commands, error words.
EPISODES = {
    "test": r"(?i)(pytest|unittest|test_|PASSED|FAILED|assert\b|coverage)",
    "build": r"(?i)(compile|build|linking|cargo build|webpack|make\b)",
    "deploy": r"(?i)(deploy|kubectl|terraform|docker push|production|staging)",
    "debug": r"(?i)(Traceback|pdb|breakpoint|debugger|stack trace)",
    "refactor": r"(?i)(refactor|rename|extract\b|restructure|simplify)",
    "explore": r"(?i)(how does|what is|explain|architecture|show me|understand)",
    "config": r"(?i)(config|\.env|settings|install\b|dependency|pyproject\.toml|yaml|setup\b)",
    "docs": r"(?i)(README|documentation|docstring|CHANGELOG|markdown)",
    "review": r"(?i)(review|PR\b|pull request|code review|LGTM|audit)",
}
COMMANDS = {"make": "build", "cmake": "build", "ninja": "build", "pytest": "test", "jest": "test", "gdb": "debug", "lldb": "debug", "claude": "refactor"}
PAIRS = {
    "cargo build": "build", "cargo test": "test", "go build": "build", "go test": "test", "npm test": "test", "npm run": "build",
    "docker build": "build", "docker push": "deploy", "make test": "test", "make install": "build",
}
DEPLOY = ("kubectl", "terraform", "ansible", "ansible-playbook", "deploy")
ERROR = r"(?i)(Traceback \(most recent call last\)|FAILED |ERROR:|Exception:|panic:|FATAL|segmentation fault|core dumped)"
NEIGHBOUR_SECONDS = 600.0


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def sessionize(events: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """events with session (number per user, from 1): a gap of gap_seconds or more starts a new one."""
    w = Window.partitionBy(user).orderBy(ts, *(["event_id"] if "event_id" in events.columns else []))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    starts = F.when(gap.isNull() | (gap >= gap_seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("_start", starts).withColumn("session", F.sum("_start").over(w).cast("long")).drop("_start")


def end_of(started: str = "started_at", ended: str = "ended_at") -> Column:
    return F.coalesce(F.nullif(F.col(ended), F.lit(0.0)), F.col(started))


def related(sessions: DataFrame, gap: float = NEIGHBOUR_SECONDS, bucketed: bool = False) -> DataFrame:
    """(src, dst) of sessions whose nearest end points (start-end, end-start, start-start) are at most gap apart.

    bucketed: an equi-join on buckets of gap seconds, which scales with the number of neighbours; else a theta join, for few sessions."""
    a = sessions.select(F.col("session_id").alias("src"), F.col("started_at").alias("s1"), end_of().alias("e1"))
    b = sessions.select(F.col("session_id").alias("dst"), F.col("started_at").alias("s2"), end_of().alias("e2"))
    near = F.least(F.abs(F.col("s1") - F.col("e2")), F.abs(F.col("s2") - F.col("e1")), F.abs(F.col("s1") - F.col("s2"))) <= gap
    if not bucketed:
        return a.join(b, (F.col("src") != F.col("dst")) & near).select("src", "dst")
    # one join of end points: two rows for each session on the left, on the right in three buckets each; two ends don't count
    ends = sessions.select("session_id", F.explode(F.array(F.struct(F.lit(True).alias("start"), F.col("started_at").alias("t")), F.struct(F.lit(False).alias("start"), end_of().alias("t")))).alias("p"))
    bucket = F.floor(F.col("p.t") / gap)
    left = ends.select(F.col("session_id").alias("src"), F.col("p.start").alias("x"), F.col("p.t").alias("t1"), bucket.alias("k"))
    right = ends.select(F.col("session_id").alias("dst"), F.col("p.start").alias("y"), F.col("p.t").alias("t2"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("k"))
    met = left.join(right, "k").where((F.col("src") != F.col("dst")) & (F.col("x") | F.col("y")) & (F.abs(F.col("t1") - F.col("t2")) <= gap))
    return met.select("src", "dst").distinct()


def content_scores(chunks: DataFrame, key: str = "session_id", text: str = "text") -> DataFrame:
    """key, one count per episode type, and episode: the type with most matches, the first declared of equals; refactor if none."""
    sums = [F.sum(F.regexp_count(text, F.lit(p))).cast("long").alias(n) for n, p in EPISODES.items()]
    scored = chunks.groupBy(key).agg(*sums)
    best = F.array_max(F.array(*(F.struct(F.col(n).alias("c"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, n in enumerate(EPISODES))))
    return scored.withColumn("episode", F.when(best["c"] > 0, best["n"]).otherwise("refactor"))


def episode_of_command(command: str = "command", content: Column | None = None) -> Column:
    """Episode type of an argv array; content is the type by text for assistant sessions with chunks (else null)."""
    c = F.col(command)
    head, second, third = basename(F.get(c, F.lit(0))), F.get(c, F.lit(1)), F.get(c, F.lit(2))
    module = F.when((head == "python") & (second == "-m"), F.when(third == "pdb", "debug").when(third == "pytest", "test"))
    tested = F.exists(F.slice(c, 2, F.greatest(F.size(c), F.lit(1))), lambda x: x.rlike(r"(?i)\btest\b"))
    out = F.coalesce(F.get(F.array(lookup(PAIRS)[F.concat_ws(" ", head, second)]), F.lit(0)), module, F.when(head.isin(*DEPLOY), "deploy"), lookup(COMMANDS)[head], F.when(tested, "test"), F.lit("build"))
    if content is not None:
        out = F.when((head == "claude") & content.isNotNull(), content).otherwise(out)
    return F.when(c.isNull() | (F.size(c) <= 0), "build").otherwise(out)


def errors(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """session_id, has_error, error_summary of every session: its exit code and the first error line of each chunk, three at most."""
    line = F.regexp_extract("text", r"(?im)^.*?(?:Traceback \(most recent call last\)|FAILED |ERROR:|Exception:|panic:|FATAL|segmentation fault|core dumped).*$", 0)
    hits = chunks.where(F.col("text").rlike(ERROR)).select("session_id", "index", strip(line).alias("line"))
    lines = hits.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "line"))), lambda x: x["line"]).alias("lines"))
    code = F.coalesce(F.col("exit_code"), F.lit(0))
    parts = F.concat(F.when(code != 0, F.array(F.concat(F.lit("Exit code "), F.col("exit_code").cast("string")))).otherwise(F.expr("cast(array() as array<string>)")), F.coalesce("lines", F.expr("cast(array() as array<string>)")))
    parts = F.array_distinct(F.filter(parts, lambda x: x != ""))
    out = sessions.join(lines, "session_id", "left")
    return out.select("session_id", ((code != 0) | F.col("lines").isNotNull()).alias("has_error"), F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 3), "; ")).alias("error_summary"))


def episodes(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """session_id, episode_type, without looking for neighbours."""
    by_text = content_scores(chunks).select("session_id", F.col("episode").alias("_content"))
    return sessions.join(by_text, "session_id", "left").select("session_id", episode_of_command(content=F.col("_content")).alias("episode_type"))


def graph(sessions: DataFrame, chunks: DataFrame, bucketed: bool = True) -> DataFrame:
    """session_id, episode_type, has_error, error_summary, related_sessions."""
    near = related(sessions, bucketed=bucketed).groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("related_sessions")).withColumnRenamed("src", "session_id")
    by_text = content_scores(chunks).select("session_id", F.col("episode").alias("_content"))
    out = sessions.join(by_text, "session_id", "left").join(errors(sessions, chunks), "session_id").join(near, "session_id", "left")
    return out.select("session_id", episode_of_command(content=F.col("_content")).alias("episode_type"), "has_error", "error_summary", F.coalesce("related_sessions", F.array().cast(sessions.select(F.array("session_id")).dtypes[0][1])).alias("related_sessions"))


def latest(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("started_at"), "session_id").limit(1)


def around_failure(sessions: DataFrame, chunks: DataFrame, failed_id, limit: int = 200) -> DataFrame:
    """Chunks of a failed session and its neighbours, newest first."""
    one = F.broadcast(sessions.where(F.col("session_id") == failed_id).select(F.col("started_at").alias("s1"), end_of().alias("e1")).limit(1))
    close = F.least(F.abs(F.col("s1") - end_of()), F.abs(F.col("started_at") - F.col("e1")), F.abs(F.col("s1") - F.col("started_at"))) <= NEIGHBOUR_SECONDS
    near = sessions.join(one, close).where(F.col("session_id") != failed_id).select("session_id")
    ids = near.unionByName(sessions.where(F.col("session_id") == failed_id).select("session_id")).distinct()
    return chunks.join(ids, "session_id", "left_semi").orderBy(F.desc("ts_end"), "chunk_id").limit(limit)


def by_episode(sessions: DataFrame, chunks: DataFrame, episode: str, limit: int = 200) -> DataFrame:
    ids = episodes(sessions, chunks).where(F.col("episode_type") == episode).select("session_id")
    return chunks.join(ids, "session_id", "left_semi").orderBy(F.desc("ts_end"), "chunk_id").limit(limit)


def as_of(sessions: DataFrame, files: DataFrame, before: float = 60.0, after: float = 300.0) -> DataFrame:
    """For each session the file (path, mtime) nearest to its start in [start - before, end + after]; else the newest file."""
    newest = files.agg(F.max_by("path", F.struct("mtime", "path")).alias("_newest"))
    cond = (F.col("mtime") >= F.col("started_at") - before) & (F.col("mtime") <= end_of() + after)
    w = Window.partitionBy("session_id").orderBy(F.abs(F.col("mtime") - F.col("started_at")), "path")
    near = sessions.join(files, cond).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("session_id", F.col("path").alias("_near"))
    return sessions.join(near, "session_id", "left").join(F.broadcast(newest)).select("session_id", F.coalesce("_near", "_newest").alias("path"))

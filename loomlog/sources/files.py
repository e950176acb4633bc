"""Files of a project as DataFrames: listings, discovery of transcripts, todos, tasks and plans, and small JSON documents.

A listing is one row per file, read by Spark's binary reader without the contents, so any store it can list works."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, folder, stem, length, mtime (seconds) of the files under path whose name fits glob."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return rows.select("path", F.element_at(parts, -2).alias("folder"), stem.alias("stem"), "length", (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def transcripts(files: DataFrame) -> DataFrame:
    """Session transcripts of a listing: JSON lines that aren't an agent's."""
    return files.where(F.col("path").endswith(".jsonl") & ~F.col("stem").startswith("agent-"))


def todos_of(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Todo files that aren't empty and belong to one of the sessions (session_id), by the part of the stem before ``-agent-``."""
    named = files.where("length > 0").withColumn("session_id", F.regexp_extract("stem", r"^(.*?)(?:-agent-.*)?$", 1))
    return named.join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def task_folders_of(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id of the folders of task files that are a session's."""
    return files.select(F.col("folder").alias("session_id")).distinct().join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def plans_of(files: DataFrame, slugs: DataFrame) -> DataFrame:
    """slug, path, mtime of the plans that exist among the slugs."""
    return files.where(F.col("path").endswith(".md")).select(F.col("stem").alias("slug"), "path", "mtime").join(slugs.select("slug").distinct(), "slug")


def sessions_with_slug(lines: DataFrame, slug: str) -> DataFrame:
    """session_id of transcripts (lines as ``transcripts.read`` gives them) with the slug, the first by name at the top."""
    return lines.where(F.col("slug") == slug).select("session_id").distinct().orderBy("session_id")


def recent_plans(plans: DataFrame, most: int = 3) -> DataFrame:
    """The plans (slug, text, mtime) last changed, newest first."""
    return plans.orderBy(F.desc("mtime"), "slug").limit(most)


#: What is still to be done, and the order of priorities.
ACTIVE = ("pending", "in_progress")
PRIORITY = {"high": 0, "medium": 1, "low": 2}


def by_priority(items: DataFrame, *then) -> DataFrame:
    """Items with the highest priority first; an unknown one counts as medium."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))[F.col("priority")], F.lit(1))
    return items.orderBy(rank, *then)


def active_items(items: DataFrame, most: int = 5) -> DataFrame:
    """items: kind (todo, task), session_id, mtime, n (place in the session), status, priority, text. Those still to be done, of the ``most``
    sessions of each kind that were changed last and have any, by priority."""
    open_ = items.withColumn("status", F.coalesce("status", F.lit("pending"))).where(F.col("status").isin(*ACTIVE)).withColumn("priority", F.coalesce("priority", F.lit("medium")))
    last = open_.groupBy("kind", "session_id").agg(F.max("mtime").alias("last"))
    w = Window.partitionBy("kind").orderBy(F.desc("last"), "session_id")
    # a top-k of sessions: kinds are two, and Spark cuts each task's rows to the first ``most`` before they meet
    kept = last.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return by_priority(open_.join(F.broadcast(kept.select("kind", "session_id", "place")), ["kind", "session_id"]), F.desc("kind"), "place", "n")


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """found: external_id, size; known: external_id, session_id, size. Each external session with the internal id it had, and what to
    do: new, grown (another size than before) or same."""
    old = known.select("external_id", "session_id", F.col("size").alias("before"))
    what = F.when(F.col("session_id").isNull(), "new").when(~F.col("size").eqNullSafe(F.col("before")), "grown").otherwise("same")
    return found.join(old, "external_id", "left").select("external_id", "session_id", "size", what.alias("action"))


def import_counts(todo: DataFrame) -> DataFrame:
    """imported, skipped, plans, todos, tasks of rows (kind: session, plan, todo, task; action as ``changed`` says)."""
    is_new, of = F.col("action") != "same", lambda k: F.col("kind") == k
    return todo.agg(F.count_if(of("session") & is_new).alias("imported"), F.count_if(of("session") & ~is_new).alias("skipped"), *(F.count_if(of(k) & is_new).alias(f"{k}s") for k in ("plan", "todo", "task")))


def stale(inputs: DataFrame, made_at: float | None) -> bool:
    """Whether any input file (a listing) is newer than what was made of it; without it, whether there is any input."""
    newest = inputs.agg(F.max("mtime")).first()[0]
    return newest is not None and (made_at is None or newest > made_at)


def read_json(spark: SparkSession, path: str, default: Any = None, strict: bool = False) -> Any:
    """A small JSON document; default if it is missing, or can't be read and not strict (then ValueError)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return default
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (ValueError, TypeError):
        if strict:
            raise ValueError(f"{path} isn't JSON") from None
        return default


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """Writes beside the file and renames, so that a reader sees the old or the new document."""
    jvm = spark.sparkContext._jvm
    to, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    out.close()
    fs.delete(to, False)
    fs.rename(beside, to)


class Registry:
    """Projects known to a user: path -> registered_at, last_import, session_count; one small document."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _all(self) -> dict[str, dict]:
        return read_json(self.spark, self.path, {}) or {}

    def projects(self) -> DataFrame:
        rows = [(k, v.get("registered_at"), v.get("last_import"), v.get("session_count", 0)) for k, v in sorted(self._all().items())]
        return self.spark.createDataFrame(rows, "project_path string, registered_at double, last_import double, session_count long")

    def register(self, project: str, now: float) -> None:
        held = self._all()
        if project not in held:
            write_json(self.spark, self.path, held | {project: {"registered_at": now, "last_import": None, "session_count": 0}})

    def update(self, project: str, last_import: float, session_count: int) -> None:
        held = self._all()
        if project in held:
            write_json(self.spark, self.path, held | {project: held[project] | {"last_import": last_import, "session_count": session_count}})

    def remove(self, project: str) -> bool:
        held = self._all()
        if project in held:
            write_json(self.spark, self.path, {k: v for k, v in held.items() if k != project})
        return project in held

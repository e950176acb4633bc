"""The session store: NDJSON folders (sessions/<id>/..., artifacts/) as DataFrames, and Parquet tables for scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import event_id, redact
from . import files

EVENT = "event_id string, ts double, session_id string, stream string, role string, content string, source string, meta map<string,string>"
SESSION = "session_id string, command string, cwd string, started_at double, ended_at double, exit_code int, source string"
CHUNK = "chunk_id string, session_id string, index int, text string, ts_start double, ts_end double, token_estimate int, quality_score double, artifact_type string, source string, artifact_id string, turn_number int"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def sessions(self, session_id: str = "*") -> DataFrame:
        """Newest first; corrupt files are skipped, a bare command is an argv of one, unknown sources are null."""
        df = self.spark.read.schema(SESSION + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(f"{self.root}/sessions/{session_id}/meta.json")
        argv = F.coalesce(F.from_json("command", "array<string>"), F.array("command"))
        source = F.when(F.col("source").isin("pty", "hook", "import"), F.col("source"))
        return df.where("_bad is null and session_id is not null").withColumn("command", F.when(F.col("command").isNull(), F.array().cast("array<string>")).otherwise(argv)).withColumn("source", source).drop("_bad").orderBy(F.desc("started_at"))

    def session(self, session_id: str) -> DataFrame:
        """The session's row, none if it is missing or corrupt; only its own folder is read."""
        if not files.listing(self.spark, f"{self.root}/sessions", "meta.json").where(F.col("folder") == session_id).take(1):
            return self.spark.createDataFrame([], SESSION)
        return self.sessions(session_id)

    def create_session(self, session_id: str, command: list[str], cwd: str, started_at: float, source: str | None = None) -> None:
        files.write_json(self.spark, f"{self.root}/sessions/{session_id}/meta.json", {"session_id": session_id, "command": command, "cwd": cwd, "started_at": started_at, "ended_at": None, "exit_code": None, "source": source})

    def finalize_session(self, session_id: str, ended_at: float, exit_code: int | None) -> None:
        path = f"{self.root}/sessions/{session_id}/meta.json"
        found = files.read_json(self.spark, path)
        if found is None:
            raise KeyError(session_id)
        files.write_json(self.spark, path, found | {"ended_at": ended_at, "exit_code": exit_code})

    def delete_session(self, session_id: str) -> bool:
        """Deletes the session's folder; False if there is none."""
        if not session_id or "/" in session_id or session_id in (".", ".."):
            raise ValueError(session_id)
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/sessions/{session_id}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def append_artifact_chunks(self, chunks: DataFrame) -> None:
        chunks.write.mode("append").json(f"{self.root}/artifacts/chunks.jsonl")

    def write_artifact(self, kind: str, name: str, value) -> None:
        """A todo list (todos), task (tasks, name is session/id) or plan (plans, a text wrapped as JSON) under artifacts."""
        files.write_json(self.spark, f"{self.root}/artifacts/{kind}/{name}.json", value)

    def without_chunks(self) -> DataFrame:
        """Sessions that have no chunks yet: the ones to be chunked unless all are."""
        done = files.listing(self.spark, f"{self.root}/sessions", "chunks.jsonl").where("length > 0").select(F.col("folder").alias("session_id"))
        return new_only(self.sessions(), done, "session_id")

    def events(self, session_id: str = "*") -> DataFrame:
        return self.spark.read.schema(EVENT).option("mode", "FAILFAST").json(f"{self.root}/sessions/{session_id}/events.jsonl")

    def chunks(self, session_id: str = "*") -> DataFrame:
        return self.spark.read.schema(CHUNK).option("mode", "FAILFAST").json(f"{self.root}/sessions/{session_id}/chunks.jsonl")

    def artifact_chunks(self) -> DataFrame:
        return self.spark.read.schema(CHUNK).option("mode", "FAILFAST").json(f"{self.root}/artifacts/chunks.jsonl")

    def all_chunks(self) -> DataFrame:
        return self.chunks().unionByName(self.artifact_chunks())

    def write_events(self, events: DataFrame, table: str = "events") -> None:
        """Appends redacted events, partitioned by a hash bucket of the session and not by session."""
        out = events.withColumn("content", redact(F.col("content"))).withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(64)).cast("int"))
        out.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.root}/{table}")

    def replace_chunks(self, chunks: DataFrame, table: str = "chunks") -> None:
        """Overwrites the partitions (sessions) that chunks has; others stay."""
        chunks.repartition("session_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(f"{self.root}/{table}")


def backfill_event_ids(events: DataFrame, ts_text: str = "ts_text") -> DataFrame:
    """Events with ids where they had none; ts_text is the time as the id's input has it."""
    return events.withColumn("event_id", F.coalesce(F.nullif("event_id", F.lit("")), event_id(F.col("session_id"), F.col(ts_text))))


def new_only(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return found.join(known.select(key).distinct(), key, "left_anti")


def of_project(found: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    return found.join(sessions.select(key).distinct(), key, "left_semi")


def artifact_counts(todos: DataFrame, tasks: DataFrame, plans: DataFrame) -> DataFrame:
    """plans, todo_files, active_todos (not completed), task_dirs, pending_tasks (pending or in progress)."""
    a = plans.agg(F.count("*").alias("plans"))
    b = todos.select("session_id", F.explode_outer("items").alias("i")).agg(F.count_distinct("session_id").alias("todo_files"), F.count_if(F.col("i").isNotNull() & (F.col("i.status") != "completed")).alias("active_todos"))
    c = tasks.agg(F.count_distinct("session_id").alias("task_dirs"), F.count_if(F.col("status").isin("pending", "in_progress")).alias("pending_tasks"))
    return a.crossJoin(b).crossJoin(c)  # three rows of one

"""The vector index: an embedder, incremental building, metadata, search from a text, legacy files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable
from . import search

Embed = Callable[[list[str]], list[list[float]]]
SNIPPET, BATCH, FLOOR = 500, 10, 0.35
INDEX = "id string, session_id string, text string, ts double, artifact_type string, embedding array<float>"


def hashing_embedder(size: int = 64) -> Embed:
    """Words hashed into ``size`` signed counts, of length one: the same for the same text anywhere, without a model."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), size))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % size] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None]).tolist()

    return embed


def embedded(chunks: DataFrame, embed: Embed, batch: int = BATCH) -> DataFrame:
    """chunks (chunk_id, session_id, text, ts_end, artifact_type) as rows of the index; ``embed`` gets ``batch`` texts at a time."""
    rows = chunks.select(F.col("chunk_id").alias("id"), "session_id", "text", F.col("ts_end").alias("ts"), "artifact_type")

    def run(batches: Iterable[pa.RecordBatch]):
        for got in batches:
            texts, vectors = [t or "" for t in got.column("text").to_pylist()], []
            for at in range(0, len(texts), batch):
                vectors += embed(texts[at : at + batch])
            v = np.array(vectors, np.float64).reshape(len(texts), -1)
            v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
            short = pa.array([t[:SNIPPET] for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([got.column("id"), got.column("session_id"), short, got.column("ts"), got.column("artifact_type"), pa.array([x.astype(np.float32) for x in v], pa.list_(pa.float32()))], names=["id", "session_id", "text", "ts", "artifact_type", "embedding"])

    importable(chunks.sparkSession)
    return rows.mapInArrow(run, INDEX)


class Index:
    """A Parquet table of unit vectors with their metadata; readers that need no vectors don't read them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(self.path) if self._exists() else self.spark.createDataFrame([], INDEX)

    def metadata(self) -> DataFrame:
        return self.rows().drop("embedding")

    def sessions(self) -> DataFrame:
        return self.rows().select("session_id").distinct()

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def clear(self) -> None:
        self.spark.createDataFrame([], INDEX).write.mode("overwrite").parquet(self.path)

    def build(self, chunks: DataFrame, embed: Embed, stale: bool = False) -> DataFrame:
        """Embeds the chunks of sessions that the index doesn't have, artifacts by session too; all of them if it is stale. Returns what was added."""
        if stale:
            self.clear()
        new = chunks.where(F.trim("text") != "").join(self.sessions(), "session_id", "left_anti")
        before = self.rows().select("id")
        self.add(embedded(new.repartition("session_id"), embed))
        return self.metadata().join(before, "id", "left_anti")

    def rebuild(self, chunks: DataFrame, embed: Embed) -> tuple[int, int]:
        """All anew; how many chunks and sessions it then has."""
        self.build(chunks, embed, stale=True)
        row = self.metadata().agg(F.count("*"), F.count_distinct("session_id")).first()
        return row[0], row[1]

    def search(self, text: str, embed: Embed, k: int = 5, judge=None, floor: float | None = FLOOR, artifact_type: str | None = None, half_life_days: float = 0.0, now: float | None = None) -> DataFrame:
        """The k rows nearest to text. With a judge three times as many are fetched and ranked again; the floor cuts last."""
        hits = search.top_k(self.rows(), search.literal(embed([text])[0]), 3 * k if judge else k, artifact_type, half_life_days, now)
        if judge:
            hits = search.rerank(hits, judge, k)
        return hits.where(F.col("score") >= floor) if floor is not None else hits


def of_project(hits: DataFrame, project_path: str) -> DataFrame:
    return hits.withColumn("project_path", F.lit(project_path))


def snippet(text, most: int = 200):
    """A text's beginning in one line, with dots where it was cut."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(text) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def legacy_vectors(spark: SparkSession, path: str, dim: int = 768) -> DataFrame:
    """row, embedding of a file of little-endian 32-bit vectors; each file is read by one task, a vector at a time."""

    def unpack(batches):
        for batch in batches:
            for raw in batch.column("content"):
                v = np.frombuffer(raw.as_buffer(), "<f4")
                v = v[: len(v) // dim * dim].reshape(-1, dim)
                for at in range(0, len(v), 1024):
                    part = v[at : at + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part), dtype=np.int64)), pa.array(list(part), pa.list_(pa.float32()))], names=["row", "embedding"])

    importable(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "row long, embedding array<float>")


def with_metadata(vectors: DataFrame, metadata: DataFrame) -> DataFrame:
    """Vectors and metadata (row, ...) of the same row; what only one of them has is left out."""
    return vectors.join(metadata, "row")

"""What the corpus operators share: table readers, shared-folder staging, connected components."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets a
    temporary one; on a cluster that is an error, since executors write where no other one reads."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or _LOCAL.get(context.applicationId)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="loomlog-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = _LOCAL[context.applicationId] = f"file://{local}"
    return found


_LOCAL: dict[str, str] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors, and
    later column pruning reads only what is used. The folder is on the frame as ``staged_path``."""
    spark = importable(df.sparkSession)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing lazy depends on any more."""
    for df in frames:
        path = getattr(df, "staged_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Has shuffle files that nothing refers to any more deleted: Spark's cleaner learns of them only when Python's and then the
    driver's garbage is collected, which may be long after they could go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


PARTS = 2000  # a key with more than one in so many rows is hot; so there are fewer hot keys than this


def hot_keys(keys: DataFrame, on: str, rows: int, least: int = 64) -> DataFrame:
    """on, parts: keys of more than one in ``PARTS`` of the rows, and into how many parts of that size they are cut.
    At most ``PARTS`` rows, whatever the input, so that it may be broadcast."""
    size = max(least, rows // PARTS)
    return keys.groupBy(on).agg(F.count("*").alias("parts")).where(F.col("parts") > size).select(on, F.ceil(F.col("parts") / size).cast("int").alias("parts"))


def spread_join(left: DataFrame, right: DataFrame, on: str, hot: DataFrame, by: str) -> DataFrame:
    """left joined with right on ``on``, hot keys of left dealt by a hash of column ``by`` into parts that each get a copy of right's row."""
    hot = F.broadcast(hot)
    a = left.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    b = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return a.join(b, [on, "_part"]).drop("_part")


def _with_least(rows: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """rows (a, b) with m of their a. Nodes with more than one in PARTS of the rows are looked up in a broadcast table of at
    most PARTS rows and so stay where they are; only the others meet by key."""
    hubs = F.broadcast(least.where(F.col("n") > max(64, count // PARTS)).select("a", "m"))
    return rows.join(hubs, "a").select("a", "b", "m").unionByName(rows.join(hubs, "a", "left_anti").join(least.select("a", "m"), "a").select("a", "b", "m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) long -> (id, component): the smallest id reachable, for every id with an edge to another id.

    Alternating large-star and small-star steps. Each step is one aggregation with a map-side combine, and a join in which
    hubs are looked up and only rows of smaller nodes are dealt by key; the edge count never grows. It ends when no node with a
    smaller neighbour has a second one: such a neighbour has no smaller one itself, so every component is a star."""
    cur = staged(
        edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct(), "cc"
    )
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "cc")
        open_ends, ends = low.agg(F.count_if((F.col("m") < F.col("a")) & (F.col("n") > 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not open_ends:
            unstage(low)
            break
        count = ends // 2
        large = _with_least(both, low, 2 * count).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        nxt = staged(large, "cc")
        low2 = staged(nxt.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "cc")
        small = (
            _with_least(nxt, low2, count).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low2.select("a", F.col("m").alias("b")))
            .distinct()
        )
        nxt2 = staged(small, "cc")
        unstage(cur, nxt, low, low2)
        cur = nxt2
    else:
        raise RuntimeError("connected components did not settle")
    nodes = cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = cur.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return nodes.unionByName(roots)


def ranked(df: DataFrame, *order) -> DataFrame:
    """df, staged, with its rank from 0 in the given order as ``rank``: sorted by ranges, never in one task; the only window is
    over one row per partition."""
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = rows.groupBy(F.shiftright("_at", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = part.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    rows = rows.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(before), "_p")
    return rows.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_at", "_before")

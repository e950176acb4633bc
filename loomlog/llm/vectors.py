"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are one class, and only classes are hashed. A table's bucket is cut into blocks of bounded size, and each
pair of blocks is one matrix product, so no pair is ever a row: a block gives each vector its number of links and a
spanning forest. A pair that shares several tables' buckets counts in the first of them.

The number of tables is set so that a pair at exactly the threshold is found with probability ``recall``.

Edge cases: a null, zero or empty vector, or one with a null or non-finite component, links with nothing; vectors of
different lengths don't link; rows are vectors of their own, whatever their vec_id; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import importable
from .common import connected_components, staged
from .minhash import by_group, in_blocks


class Planes:
    def __init__(self, rows: int, threshold: float, recall: float, seed: int = 5):
        self.bits = max(8, min(30, math.ceil(math.log2(max(rows, 1) / 32 + 1))))
        p = (1 - math.acos(threshold) / math.pi) ** self.bits
        self.tables, self.seed, self._normals = math.ceil(math.log(1 - recall) / math.log(1 - p)), seed, {}

    def keys(self, v: np.ndarray) -> np.ndarray:
        """(vectors, tables) of sign patterns."""
        dim = v.shape[1]
        if dim not in self._normals:
            self._normals[dim] = np.random.default_rng(self.seed + dim).standard_normal((dim, self.tables * self.bits))
        signs = (v @ self._normals[dim] >= 0).reshape(len(v), self.tables, self.bits)
        return signs @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))


def near_vectors(table: DataFrame, threshold: float = 0.9, recall: float = 0.995, block: int = 512) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    A table's row is its bucket, its class and the vector in the type it came in; rows are dealt once, since only the
    buckets that are cut into blocks (more than ``block`` classes) are looked up. Links inside a bucket of m unequal
    vectors take m * m products, in blocks: exact counts of links need each."""
    kind = table.schema["embedding"].dataType.elementType.simpleString()
    dtype, wide = (np.float32, "float") if kind == "float" else (np.float64, "double")
    rows = table.select("vec_id", F.col("embedding").cast(f"array<{wide}>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & ~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    plain = F.transform("v", lambda x: x + F.lit(0.0).cast(wide))  # -0.0 is 0.0
    keyed = staged(rows.withColumn("v", F.when(good, plain)), "vectors")
    found = keyed.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("many"))
    classes = staged(found.withColumn("id", F.monotonically_increasing_id()), "classes")
    planes = Planes(classes.count(), threshold, recall)

    def unit(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        v = v / np.abs(v).max(axis=1)[:, None]
        return v / np.linalg.norm(v, axis=1)[:, None]

    def keys_of(batch):
        """(rows, their vectors, bucket keys) for each length of vectors in the batch."""
        column = batch.column("v")
        dims = np.diff(column.offsets.to_numpy())
        flat, start = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
        flat = flat[column.offsets[0].as_py() :]
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            v = flat[start[at][:, None] + np.arange(dim)]
            keys = planes.keys(unit(v))
            with np.errstate(over="ignore"):
                yield at, v, (keys * planes.tables + np.arange(planes.tables)) * 4099 + int(dim)

    def hashed(batches):
        for batch in batches:
            for at, v, keys in keys_of(batch):
                raw = pa.array([x.tobytes() for x in v.astype(dtype)], pa.binary())
                ids, many = (batch.column(k).take(pa.array(at)) for k in ("id", "many"))
                for t in range(planes.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), pa.array(np.full(len(keys), t, np.int32)), ids, many, raw], names=["bucket", "tab", "id", "many", "v"])

    def buckets(batches):
        for batch in batches:
            for _, _, keys in keys_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel())], names=["bucket"])

    importable(table.sparkSession)
    crowded = staged(classes.select("v").mapInArrow(buckets, "bucket long").groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > block), "crowded")
    dealt = classes.select("id", "many", "v").mapInArrow(hashed, "bucket long, tab int, id long, many long, v binary")
    some = crowded.count() <= 500_000  # 8 MB: a checked size
    dealt = dealt.join(F.broadcast(crowded) if some else crowded, "bucket", "left")
    groups = in_blocks(dealt, "bucket", F.coalesce(F.ceil(F.col("m") / block), F.lit(1)), ["tab", "id", "many", "v"])

    def compare(batches):
        for got in by_group(batches, ["tab", "id", "many", "v"]):
            part, ids, many = (np.array([r[k] for r in got], np.int64) for k in (0, 2, 3))
            v, t = unit(np.frombuffer(b"".join(r[4] for r in got), dtype).reshape(len(got), -1)), got[0][1]
            hit = v @ v.T >= threshold
            np.fill_diagonal(hit, False)
            if len(np.unique(part)) > 1:
                hit &= part[:, None] != part[None, :]
            if t and hit.any():
                keys = planes.keys(v)[:, :t]
                for i in np.flatnonzero(hit.any(axis=1)):
                    j = np.flatnonzero(hit[i])
                    hit[i, j[(keys[j] == keys[i]).any(axis=1)]] = False
            if not hit.any():
                continue
            links, label = hit @ many, np.arange(len(ids))
            for i in np.flatnonzero(hit.any(axis=1)):
                near = np.unique(label[np.append(np.flatnonzero(hit[i]), i)])
                if len(near) > 1:
                    label[np.isin(label, near)] = near[0]
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(ids[label[at]])], names=["id", "links", "to"])

    found = staged(groups.mapInArrow(compare, "id long, links long, `to` long"), "vector_links")
    comps = connected_components(found.where("id <> to").select(F.col("id").alias("src"), F.col("to").alias("dst")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    per = classes.join(links, "id", "left").join(comps, "id", "left").withColumn("c", F.coalesce("component", "id"))
    low = per.groupBy("c").agg(F.min("low").alias("component_id"))  # the smallest vec_id of the component's classes
    per = per.join(low, "c").select("v", F.coalesce("links", F.lit(0)).alias("links"), "many", "component_id")
    out = keyed.join(per, "v", "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("many") - 1, F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))

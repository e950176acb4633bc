"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts gives each document the size and a 128-bit digest of its shingle set, band keys from full
   minima, and the low ``bits`` bits of every minimum, packed. Documents with equal sets form a class; only its
   smallest doc_id goes on.
2. In each band bucket every member is compared with the smallest, so a bucket of m documents makes m - 1 pairs. Pairs
   whose packed signatures estimate a similarity near the threshold are confirmed on full sets; links are joined into
   components.
3. Buckets that still hold more than one component are searched in blocks: each block gives a spanning forest of its
   pairs across components whose estimate passes. What these forests join is a cluster; a cluster's sets meet in blocks
   of bounded size, where rows are intersected with all others at once through an inverted index and only links that
   join components leave. So no link that matters is lost and no group of copies is expanded into its pairs.

Edge cases: null or empty text: an empty set, linked with nothing; fewer words than a shingle: the whole sequence is
the one shingle; rows are documents of their own also where they share a doc_id (then component_id is the smallest
doc_id of the component, and kept holds for each of its rows with that doc_id); a null doc_id stays alone (null component,
kept); very long texts are read whole, a slice of texts at a time; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import connected_components, hot_keys, spread_join, staged, unstage
from .shingles import mix, shingle_hashes
from .tokens import in_slices, only_cache, tidy

#: Estimates this far below the threshold are still confirmed: over four standard deviations at 192 minima.
SLACK = 0.16


class Minima:
    """bands x rows minima of 32-bit permutations, their band keys and b-bit signatures."""

    def __init__(self, bands: int = 32, rows: int = 6, bits: int = 4, seed: int = 3):
        self.bands, self.rows, self.bits, self.k = bands, rows, bits, bands * rows
        draw = np.random.default_rng(seed).integers(0, 1 << 32, (2, self.k), dtype=np.uint64).astype(np.uint32)
        self.a, self.b = draw[0] | np.uint32(1), draw[1]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        x, low = (hashes >> np.uint64(32)).astype(np.uint32), np.full(self.k, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            low = np.minimum(low, (x[at : at + 2048, None] * self.a + self.b).min(axis=0))
        return low

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        m = minima.reshape(-1, self.bands, self.rows).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = np.zeros(m.shape[:2], np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for k in range(self.rows):
                key = mix(key + m[:, :, k], k)
        return key.view(np.int64)

    def pack(self, minima: np.ndarray) -> np.ndarray:
        """Low bits of each minimum, packed into bytes: (documents, k * bits / 8)."""
        low = mix(minima.astype(np.uint64), 5).astype(np.uint8)
        planes = (low[:, :, None] >> np.arange(self.bits, dtype=np.uint8)) & np.uint8(1)
        return np.packbits(planes.reshape(len(minima), -1), axis=1, bitorder="little")

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Estimated Jaccard similarity from packed rows viewed as 64-bit words, corrected for chance agreement."""
        x = a ^ b
        step = 1
        while step < self.bits:
            x = x | (x >> np.uint64(step))
            step *= 2
        every = np.uint64(sum(1 << k for k in range(0, 64, self.bits)))
        same = self.k - np.bitwise_count(x & every).sum(axis=-1, dtype=np.int64)
        chance = 2.0**-self.bits
        return (same / self.k - chance) / (1 - chance)

    def words(self, packed: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(packed), np.uint64).reshape(len(packed), -1)


def signatures(docs: DataFrame, words: int, minima: Minima) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (null for an empty set), sig, bands."""

    def sign(batches):
        only_cache("shingles", shingles.forget)
        for batch in batches:
            names, hashes = batch.column(0), batch.column(2)
            for a, b, texts in in_slices(batch.column(1)):
                sets = shingle_hashes(texts, words)
                low = np.stack([minima.of(x) for x in sets])
                digest = [None if not len(x) else int(np.add.reduce(mix(x, 1))).to_bytes(8, "little") + int(np.bitwise_xor.reduce(mix(x, 2))).to_bytes(8, "little") for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [names.slice(a, b - a), hashes.slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([x.tobytes() for x in minima.pack(low)], pa.binary()), pa.array(list(minima.band_keys(low)), pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "n_shingles", "digest", "sig", "bands"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(tidy(sign, shingles.forget), "doc_id long, text_hash long, n_shingles long, digest binary, sig binary, bands array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """id, hashes of texts (id, text)."""

    def sets(batches):
        only_cache("shingles", shingles.forget)
        for batch in batches:
            for a, b, some in in_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in shingle_hashes(some, words)], pa.binary())], names=["id", "hashes"])

    return texts.select("id", "text").mapInArrow(tidy(sets, shingles.forget), "id long, hashes binary")


def paired(pairs: DataFrame, sides: DataFrame, column: str) -> DataFrame:
    """Staged pairs (src, dst) with sides' column of both; a src with a large part of the pairs (the head of many buckets) is dealt in parts."""
    hot = hot_keys(pairs, "src", pairs.count())
    one = spread_join(pairs, sides.select(F.col("id").alias("src"), F.col(column).alias("x")), "src", hot, "dst")
    return one.join(sides.select(F.col("id").alias("dst"), F.col(column).alias("y")), "dst")


def likely(pairs: DataFrame, sigs: DataFrame, minima: Minima, threshold: float) -> DataFrame:
    """Pairs (src, dst) whose signatures estimate at least threshold - SLACK."""

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                est = minima.similarity(minima.words(batch.column("x").to_pylist()), minima.words(batch.column("y").to_pylist()))
                yield batch.select(["src", "dst"]).filter(pa.array(est >= threshold - SLACK))

    return paired(pairs, sigs, "sig").mapInArrow(keep, "src long, dst long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union| on full sets."""

    def keep(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    ok.append(False)
                    continue
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    return paired(pairs, sets, "hashes").mapInArrow(keep, "src long, dst long").distinct()


def in_blocks(rows: DataFrame, key: str, cuts, fields: list[str]) -> DataFrame:
    """rows dealt and sorted by (key, lo, hi): groups of at most ``cuts`` parts, cut by a hash of id; each pair of parts meets once."""
    cut = rows.withColumn("cuts", cuts.cast("int")).withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.expr("sequence(0, cuts - 1)")))
    cut = cut.select(F.col(key).alias("key"), F.least("cut", "other").alias("lo"), F.greatest("cut", "other").alias("hi"), "cut", *fields)
    return cut.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def by_group(batches, fields: list[str]):
    """Lists of rows (cut, *fields) with equal (key, lo, hi), from sorted batches."""
    now, rows = None, []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("key", "lo", "hi", "cut", *fields)]
        for key, lo, hi, *row in zip(*columns, strict=True):
            if (key, lo, hi) != now:
                if len(rows) > 1:
                    yield rows
                now, rows = (key, lo, hi), []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def across(sig: np.ndarray, comp: np.ndarray, part: np.ndarray, minima: Minima, least: float):
    """(first row, bool matrix) of runs of rows: pairs in different components, estimated at least ``least``, and of
    different parts where the group has two."""
    two = len(np.unique(part)) > 1
    for at in range(0, len(comp), 64):
        s = slice(at, at + 64)
        ok = (minima.similarity(sig[s, None, :], sig[None, :, :]) >= least) & (comp[s, None] != comp[None, :])
        yield at, ok & (part[s, None] != part[None, :]) if two else ok


def forests(members: DataFrame, minima: Minima, threshold: float, block: int = 1024) -> DataFrame:
    """members: key, id, comp, sig of buckets with several components. A spanning forest of each block's pairs across components."""

    def grow(batches):
        for rows in by_group(batches, ["id", "comp", "sig"]):
            part, ids, comp = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
            label, seen = np.arange(len(ids)), np.zeros(len(ids), bool)
            for at, ok in across(minima.words([r[3] for r in rows]), comp, part, minima, threshold - SLACK):
                for i in np.flatnonzero(ok.any(axis=1)):
                    near = np.append(np.flatnonzero(ok[i]), at + i)
                    seen[near] = True
                    found = np.unique(label[near])
                    if len(found) > 1:
                        label[np.isin(label, found)] = found[0]
            leaf = np.flatnonzero(seen & (label != np.arange(len(ids))))
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[leaf]]), pa.array(ids[leaf])], names=["src", "dst"])

    sizes = members.groupBy("key").agg(F.count("*").alias("m"))
    dealt = in_blocks(members.join(sizes, "key"), "key", F.ceil(F.col("m") / block), ["id", "comp", "sig"])
    return dealt.mapInArrow(tidy(grow), "src long, dst long").distinct()


def cluster_links(nodes: DataFrame, minima: Minima, threshold: float, percent: int, block: int = 512, block_bytes: int = 16 << 20) -> DataFrame:
    """nodes: cluster, id, comp, sig, hashes. Links on full sets that join components, at most one less than the rows of a block."""

    def link(batches):
        for rows in by_group(batches, ["id", "comp", "sig", "hashes"]):
            part, ids, comp = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
            sets = [np.frombuffer(r[4], np.uint64) for r in rows]
            size = np.array([len(x) for x in sets])
            ends = np.cumsum(size)
            owner = np.repeat(np.arange(len(sets)), size)
            code = np.unique(np.concatenate(sets), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            posting, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
            src, dst = [], []
            for at, ok in across(minima.words([r[3] for r in rows]), comp, part, minima, threshold - SLACK):
                for i in np.flatnonzero(ok.any(axis=1)):
                    me = at + int(i)
                    if not (ok[i] & (comp != comp[me])).any():
                        continue
                    both = np.zeros(len(sets), np.int64)
                    own = code[ends[me] - size[me] : ends[me]]
                    for k in range(0, len(own), 2048):
                        a, b = first[own[k : k + 2048]], first[own[k : k + 2048] + 1]
                        where = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(int((b - a).sum()))
                        both += np.bincount(posting[where], minlength=len(sets))
                    hit = ok[i] & (100 * both >= percent * (size[me] + size - both))
                    for j in np.flatnonzero(hit):
                        if comp[j] != comp[me]:
                            src.append(ids[me])
                            dst.append(ids[j])
                            comp[comp == comp[j]] = comp[me]
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("m"), F.sum(F.length("hashes")).alias("held"))
    cuts = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("held") / block_bytes))
    dealt = in_blocks(nodes.join(sizes, "cluster"), "cluster", cuts, ["id", "comp", "sig", "hashes"])
    return dealt.mapInArrow(tidy(link), "src long, dst long")


def _classes(own: DataFrame) -> DataFrame:
    """One staged row per set: digest, id (a long of its own), doc_id (the smallest), text_hash (of a text with this set), sig, bands."""
    reps = staged(own.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash", "sig", "bands")).alias("r")).select("digest", "r.*"), "reps")
    shared = staged(reps.groupBy("doc_id").agg(F.count("*").alias("m"), F.min("digest").alias("first")).where("m > 1").select("doc_id", "first"), "shared")
    if shared.isEmpty():
        return reps.withColumn("id", F.col("doc_id"))
    # sets whose smallest doc_id is another set's as well: all but one of them get numbers that no doc_id has
    top = reps.agg(F.max("doc_id").alias("hi"), F.min("doc_id").alias("lo")).first()
    up = top["hi"] < 1 << 62
    marked = reps.join(shared, "doc_id", "left").withColumn("own", F.coalesce(F.col("first") == F.col("digest"), F.lit(True)))
    number = F.monotonically_increasing_id()
    fresh = F.lit(top["hi"] + 1) + number if up else F.lit(top["lo"] - 1) - number
    return staged(marked.withColumn("id", F.when(F.col("own"), F.col("doc_id")).otherwise(fresh)).drop("own", "first"), "reps")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, minima: Minima | None = None) -> DataFrame:
    """doc_id, text_hash (xxhash64), n_shingles, component_id, kept, stays of every row of docs. Of each component the rows of
    one doc_id with one text have ``stays``."""
    minima = minima or Minima()
    threshold = percent / 100
    signed = staged(signatures(docs, words, minima), "signed")
    reps = _classes(signed.where("digest is not null and doc_id is not null"))
    rows = reps.select("id", F.explode("bands").alias("key"))
    buckets = staged(rows.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("m")).where("m > 1"), "buckets")
    held = buckets.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    hot = hot_keys(rows, "key", max(1, held))
    members = staged(spread_join(rows, buckets.select("key", "head"), "key", hot, "id").select("key", "id", "head"), "members")
    nodes = members.select("id").distinct()
    sigs = staged(reps.select("id", "sig").join(nodes, "id"), "sigs")
    stars = staged(members.where("id <> head").select(F.col("head").alias("src"), F.col("id").alias("dst")).distinct(), "stars")
    tested = staged(likely(stars, sigs, minima, threshold), "tested")
    texts = reps.join(nodes, "id").select("id", "doc_id", F.col("text_hash").alias("h")).join(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), ["doc_id", "h"])
    sets = staged(shingle_sets(texts.select("id", "text"), words).dropDuplicates(["id"]), "sets")
    links = staged(confirmed(tested, sets, percent), "links")
    comps = staged(connected_components(links), "comps")
    placed = members.select("key", "id").join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    trees = staged(forests(placed.join(mixed, "key").join(sigs, "id"), minima, threshold), "trees")
    if not trees.isEmpty():
        clusters = connected_components(trees).select("id", F.col("component").alias("cluster"))
        own_comp = clusters.join(comps, "id", "left").select("id", "cluster", F.coalesce("component", "id").alias("comp"))
        more = cluster_links(own_comp.join(sigs, "id").join(sets, "id"), minima, threshold, percent)
        comps = staged(connected_components(staged(links.unionByName(more), "links")), "comps")
    unstage(members, buckets, sigs, stars, tested, sets, links, trees)
    per = reps.select("digest", "id", "doc_id", "text_hash").join(comps, "id", "left").select("digest", "doc_id", "text_hash", F.coalesce("component", "id").alias("c"))
    best = per.groupBy("c").agg(F.min(F.struct("doc_id", "digest", "text_hash")).alias("best"))
    per = staged(per.join(best, "c").select("digest", F.col("best.doc_id").alias("low"), F.col("best.text_hash").alias("low_hash")), "classes")
    out = signed.select("doc_id", "text_hash", "n_shingles", "digest").join(per, "digest", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == comp, F.lit(True))
    return out.select("doc_id", "text_hash", "n_shingles", comp.alias("component_id"), kept.alias("kept"), (kept & F.coalesce(F.col("low_hash") == F.col("text_hash"), F.lit(True))).alias("stays"))

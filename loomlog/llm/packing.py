"""Best-fit packing of documents into sequences, after Martello and Toth's dominance reduction.

A piece is only its length here, and there are at most ``capacity`` lengths. So the instance is a histogram of that
many counts whatever the number of rows: it alone goes to the driver, which reduces it, best-fits the rest and returns
intervals "of the pieces of this length, the ones from rank a on go to sequences from s on, at this offset". Rows find
their place by their rank among the pieces of their length, which is counted in parallel.

Edge cases: a null or empty text is the end id alone (one piece); a text that fills sequences exactly has no short
piece; rows with the same doc_id are separate documents; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .tokens import encoded, encoder, tidy


def reduce_instance(count: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Fixes bins that some optimal packing has, takes them out of count, and returns them as (lengths, how many).

    From the largest length j down, with k the largest other length that still fits beside it, {j} or {j, k} dominates
    every other bin with j if nothing fits beside j, if the two fill the bin, if no two pieces fit beside j together
    with it, or if no three do and the largest sum of two that do isn't more than k."""
    fixed = []

    def fix(lengths: list[int], n: int) -> None:
        fixed.append((lengths, n))
        for x in lengths:
            count[x] -= n
            if not count[x]:
                del count[x]
                present.pop(bisect_left(present, x))

    present = sorted(x for x, n in count.items() if n)
    for j in present[::-1]:
        while count.get(j):
            room = capacity - j
            at = bisect_left(present, room + 1) - 1
            k = present[at] if at >= 0 else None
            if k == j and count[j] == 1:
                k = present[at - 1] if at > 0 else None
            if k is None:
                fix([j], count[j])
                continue
            if k != room:
                small = [x for x in present[:4] for _ in range(min(3, count[x] - (x == j)))][:3]
                two = sum(small[:2]) <= room and len(small) > 1
                three = sum(small[:3]) <= room and len(small) > 2
                if two and (three or _best_pair(present, count, j, room) > k):
                    break
            if k == j:
                fix([j, j], count[j] // 2) if count[j] > 1 else fix([j], 1)
            else:
                fix([j, k], min(count[j], count[k]))
    return _merged(fixed)


def _merged(bins: list[tuple[list[int], int]]) -> list[tuple[list[int], int]]:
    return [(x, n) for x, n in ((sorted(b, reverse=True), n) for b, n in bins) if n]


def _best_pair(present: list[int], count: dict[int, int], j: int, room: int) -> int:
    """The largest sum of two pieces that fit into room."""
    low, high, best = 0, len(present) - 1, 0
    while low <= high:
        a, b = present[low], present[high]
        enough = count[a] - (a == j) >= 1 and count[b] - (b == j) >= 1 and (low < high or count[a] - (a == j) >= 2)
        if a + b > room or (not enough and low < high and count[b] - (b == j) < 1):
            high -= 1
        else:
            if enough:
                best = max(best, a + b)
            low += 1
    return best


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset) of each run of equal placements."""
    count = {int(x): int(n) for x, n in histogram.items() if n}
    used: dict[int, int] = defaultdict(int)
    out, sequences = [], 0
    for lengths, n in reduce_instance(count, capacity):
        at = 0
        for x in lengths:
            out.append((x, used[x], n, sequences, at))
            used[x] += n
            at += x
        sequences += n
    # best fit, longest first; bins with the same room are runs of sequence numbers
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, n: int) -> None:
        if room not in runs:
            runs[room] = []
            insort(rooms, room)
        runs[room].append((first, n))

    for x in sorted(count, reverse=True):
        left = count[x]
        while left:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                fit = capacity // x
                whole, rest = divmod(left, fit)
                if whole:
                    for k in range(fit):
                        out.append((x, used[x], whole, sequences, k * x))
                        used[x] += whole
                    put(capacity - fit * x, sequences, whole)
                    sequences += whole
                if rest:
                    for k in range(rest):
                        out.append((x, used[x], 1, sequences, k * x))
                        used[x] += 1
                    put(capacity - rest * x, sequences, 1)
                    sequences += 1
                break
            room = rooms[at]
            first, n = runs[room].pop()
            fit = room // x
            take = min(n, max(1, left // fit))
            each = fit if left >= fit else left
            if not runs[room]:
                del runs[room]
                rooms.pop(at)
            if take < n:
                put(room, first + take, n - take)
            for k in range(each):
                out.append((x, used[x], take, first, capacity - room + k * x))
                used[x] += take
            left -= take * each
            put(room - each * x, first, take)
    return out


def cut(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece: whole texts encoded, longer ones cut so that
    only the first piece may be shorter than capacity."""

    def pieces(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, got, counts in encoded(enc, batch.column(1)):
                at, rows = 0, {k: [] for k in arrow.names}
                for name, n in zip(names[a:b], counts.tolist(), strict=True):
                    ids = np.append(got[at : at + n], end)
                    at += n
                    raw, total = memoryview(ids.astype("<u4")).cast("B"), n + 1
                    first = total % capacity or min(total, capacity)
                    starts = [0, *range(first, total, capacity)]
                    for k, s in enumerate(starts):
                        e = first if k == 0 else s + capacity
                        rows["doc_id"].append(name)
                        rows["piece"].append(k)
                        rows["start"].append(s)
                        rows["length"].append(e - s)
                        rows["ids_crc32"].append(zlib.crc32(raw[4 * s : 4 * e]))
                        if with_ids:
                            rows["ids"].append(ids[s:e])
                yield pa.RecordBatch.from_pydict(rows, schema=arrow)

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    arrow = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    end = np.uint32(end_id)
    return docs.select("doc_id", "text").mapInArrow(tidy(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def place(pieces: DataFrame, capacity: int, lane_rows: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to staged pieces."""
    rows = pieces.count()
    lanes = max(16, rows // lane_rows)
    lane = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(lanes))
    dealt = pieces.withColumn("lane", lane)
    counts = staged(dealt.groupBy("length", "lane").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    table = plan(histogram, capacity)
    by: dict[int, list] = defaultdict(list)
    for x in table:
        by[x[0]].append(x[1:])
    found = {x: np.array(sorted(v), np.int64) for x, v in by.items()}
    # its size follows capacity: counts only change how many pieces each interval stands for
    shared = pieces.sparkSession.sparkContext.broadcast(found)
    before = counts.select("length", "lane", (F.sum("n").over(Window.partitionBy("length").orderBy("lane")) - F.col("n")).alias("lane_before"))
    order = Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.join(before, ["length", "lane"]).withColumn("rank", F.col("lane_before") + F.row_number().over(order) - 1).drop("lane", "lane_before")

    def find(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                t = shared.value[int(length[part[0]])]
                row = t[np.searchsorted(t[:, 0], rank[part], side="right") - 1]
                seq[part], off[part] = row[:, 2] + rank[part] - row[:, 0], row[:, 3]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(seq), pa.array(off)], names=[*kept, "sequence_id", "offset"])

    names = [n for n in pieces.columns if n != "length"]
    ranked = ranked.select(*names, "length", "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(find, schema)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    out = place(staged(cut(docs, vocabulary, end_id, capacity, with_ids), "pieces"), capacity)
    first = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return out.select(*first, *(["ids"] if with_ids else []))

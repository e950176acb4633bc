"""Token-ID output as wavelet matrices.

``write`` encodes whole texts in ascending doc_id order and writes one compressed file per shard; ``read`` takes the
documents back out of the files. A file answers access, counting and occurrence lookup from bit-planes with rank and
select support, without the ids beside it.

File format (little-endian; one binary value per row of the Parquet dataset, so that any store Spark can write holds it):
``LWM1``, then unsigned 32-bit: symbols, levels, documents; unsigned 64-bit: tokens; the sorted alphabet as 32-bit ids;
document ends as 64-bit token counts; per level its number of zeros as 64 bits; then one zstandard frame of the
bit-planes, most significant first, each padded to whole 64-bit words. Rank directories are rebuilt on opening (one
pass over the words), so that they take no space in the file.

Edge cases: a null or empty text has only the end id; a null doc_id sorts first; rows with the same doc_id keep a fixed
order (by a hash of the text); an empty table gives no file and no row; other columns of documents are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .tokens import encoded, encoder, tidy

_HEAD = struct.Struct("<4sIIIQ")
_BLOCK = 8  # 64-bit words of a rank block


class WaveletMatrix:
    """Bit-planes over a shard's ids, with document bounds."""

    def __init__(self, alphabet: np.ndarray, ends: np.ndarray, zeros: np.ndarray, planes: np.ndarray, n: int):
        self.alphabet, self.ends, self.zeros, self.planes, self.n = alphabet, ends, zeros, planes, n
        self._blocks: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, ends: np.ndarray) -> WaveletMatrix:
        seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        rank = np.zeros(len(seen) + 1, np.uint16 if len(alphabet) <= 65536 else np.uint32)
        rank[alphabet] = np.arange(len(alphabet))
        v, n = rank[ids], len(ids)
        levels = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
        planes, zeros = np.zeros((levels, (n + 63) // 64), np.uint64), np.zeros(levels, np.int64)
        for k in range(levels):
            bit = (v & v.dtype.type(1 << (levels - 1 - k))) != 0
            packed = np.packbits(bit, bitorder="little")
            planes[k].view(np.uint8)[: len(packed)] = packed
            low = np.flatnonzero(~bit)
            zeros[k] = len(low)
            v = np.concatenate([v[low], v[np.flatnonzero(bit)]])
        return cls(alphabet, np.asarray(ends, np.int64), zeros, planes, n)

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(b"LWM1", len(self.alphabet), len(self.planes), len(self.ends), self.n)
        body = zstandard.ZstdCompressor(level=1).compress(self.planes.tobytes())
        return b"".join([head, self.alphabet.astype("<u4").tobytes(), self.ends.astype("<i8").tobytes(), self.zeros.astype("<i8").tobytes(), body])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, symbols, levels, docs, n = _HEAD.unpack_from(data)
        if magic != b"LWM1":
            raise ValueError("not a wavelet matrix file")
        at = _HEAD.size
        alphabet = np.frombuffer(data, "<u4", symbols, at)
        ends = np.frombuffer(data, "<i8", docs, at := at + 4 * symbols)
        zeros = np.frombuffer(data, "<i8", levels, at := at + 8 * docs)
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at + 8 * levels :]), "<u8")
        return cls(alphabet, ends, zeros, planes.reshape(levels, (n + 63) // 64), n)

    def _bits(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k].view(np.uint8), count=self.n, bitorder="little").view(bool)

    def _ones(self, k: int, i: int) -> int:
        """Ones of level k before position i."""
        if self._blocks[k] is None:
            ones = np.bitwise_count(self.planes[k]).astype(np.int64)
            self._blocks[k] = np.concatenate([[0], np.add.reduceat(ones, np.arange(0, len(ones), _BLOCK)).cumsum()])
        word, block = i >> 6, (i >> 6) // _BLOCK
        found = int(self._blocks[k][block]) + int(np.bitwise_count(self.planes[k][block * _BLOCK : word]).sum())
        if i & 63:
            found += (int(self.planes[k][word]) & ((1 << (i & 63)) - 1)).bit_count()
        return found

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for k in range(len(self.planes)):
            bit = int(self.planes[k][i >> 6]) >> (i & 63) & 1
            ones = self._ones(k, i)
            i = int(self.zeros[k]) + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """How often token occurs in positions first to last - 1."""
        low, high = self._range(token, first, self.n if last is None else last)
        return high - low

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        code = self._code(token)
        if code is None:
            return 0, 0
        for k in range(len(self.planes)):
            a, b = self._ones(k, low), self._ones(k, high)
            if code >> (len(self.planes) - 1 - k) & 1:
                low, high = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                low, high = low - a, high - b
        return low, high

    def _select(self, k: int, bit: int, j: int) -> int:
        """The position of level k's j-th zero or one, from 0."""
        low, high = 0, self.n
        while high - low > 1:
            mid = (low + high) // 2
            before = self._ones(k, mid)
            if (before if bit else mid - before) <= j:
                low = mid
            else:
                high = mid
        return low

    def occurrences(self, token: int, first: int = 0, last: int | None = None) -> list[int]:
        """Positions of token in first to last - 1, ascending, by select from the last level up."""
        low, high = self._range(token, first, self.n if last is None else last)
        code, out = self._code(token), []
        for at in range(low, high):
            for k in reversed(range(len(self.planes))):
                bit = code >> (len(self.planes) - 1 - k) & 1
                at = self._select(k, bit, at - int(self.zeros[k]) * bit)
            out.append(at)
        return out

    def decode(self) -> np.ndarray:
        """All ids in order: from the last level up, each level's zeros and ones go back to where they came from."""
        levels = len(self.planes)
        if not levels:
            return np.zeros(0, np.uint32)
        # the order below the last level: codes by the levels' bits, so start from positions and carry codes up
        code = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 65536 else np.uint32)
        for k in reversed(range(levels)):
            bit = self._bits(k)
            z = int(self.zeros[k])
            up = np.empty_like(code)
            up[np.flatnonzero(~bit)] = code[:z]
            up[np.flatnonzero(bit)] = code[z:] | code.dtype.type(1 << (levels - 1 - k))
            code = up
        return self.alphabet[code]


def write(docs: DataFrame, vocabulary: str, end_id: int, shard_tokens: int = 1 << 19) -> DataFrame:
    """Writes doc_id, text as shard files in ascending doc_id order; the dataset of files.

    One row per file: task (ascending with doc_id), file (ascending in the task), first (tokens of the task before it),
    tokens, doc_ids, payload. Texts are dealt by ranges of doc_id, sorted and encoded in a stream; at most one shard's
    ids and one slice of texts are in memory."""

    def encode(batches):
        enc, task = encoder(vocabulary), TaskContext.get().partitionId()
        ids, keys, sizes, held, file, first = [], [], [], 0, 0, 0

        def flush():
            nonlocal ids, keys, sizes, held, file, first
            wm = WaveletMatrix.build(np.concatenate(ids), np.cumsum(sizes))
            out = pa.RecordBatch.from_pydict({"task": [task], "file": [file], "first": [first], "tokens": [held], "doc_ids": [keys], "payload": [wm.to_bytes()]}, schema=arrow)
            first, file, ids, keys, sizes, held = first + held, file + 1, [], [], [], 0
            return out

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, got, counts in encoded(enc, batch.column(1)):
                at = 0
                for name, n in zip(names[a:b], counts.tolist(), strict=True):
                    ids.append(got[at : at + n])
                    ids.append(end)
                    at += n
                    keys.append(name)
                    sizes.append(n + 1)
                    held += n + 1
                    if held >= shard_tokens:
                        yield flush()
        if keys:
            yield flush()

    arrow = pa.schema([("task", pa.int32()), ("file", pa.int32()), ("first", pa.int64()), ("tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
    end = np.array([end_id], np.uint32)
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return staged(dealt.mapInArrow(tidy(encode), "task int, file int, first long, tokens long, doc_ids array<long>, payload binary"), "wavelet")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def decode(batches):
        for batch in batches:
            for task, first, keys, data in zip(*(batch.column(k).to_pylist() for k in ("task", "first", "doc_ids", "payload")), strict=True):
                wm = WaveletMatrix.from_bytes(data)
                raw = memoryview(wm.decode().astype("<u4")).cast("B")
                ends = wm.ends.tolist()
                starts = [0, *ends[:-1]]
                yield pa.RecordBatch.from_pydict(
                    {"task": [task] * len(keys), "doc_id": keys, "local": [first + s for s in starts], "n_tokens": [e - s for s, e in zip(starts, ends, strict=True)], "ids_crc32": [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)]},
                    schema=arrow,
                )

    arrow = pa.schema([("task", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    out = files.select("task", "first", "doc_ids", "payload").mapInArrow(tidy(decode), "task int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # one row per task that wrote, a bound set by the number of partitions and not by the rows
    tasks = files.groupBy("task").agg(F.sum("tokens").alias("n"))
    before = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    return out.join(F.broadcast(before), "task").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")

"""Secret scans: fixed patterns, and the token-efficiency test for random strings.

A run of 20 or more key characters is suspicious if a byte-level vocabulary needs many tokens for it (few characters per
token): words and names compress, random strings don't, be they letters alone. Known digests (hexadecimal of 32, 40, 56,
64, 96 or 128 digits) and UUIDs are excluded, also as a part of a run between marks (``sha256-...``, ``id=...``); of a run
that meets these or base spans the parts outside them are tested, from 20 characters.

Edge cases: a null or empty text has no span; spans of one kind never overlap; repeated rows are scanned each; extra
columns are ignored; whole texts of any length are scanned.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import importable
from .tokens import in_slices, only_cache, tidy

#: Kinds in their listed order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
_KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_ASSIGN = re.compile(rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the whole run, as AKIA[A-Z0-9]+ of 20 or more
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(?![A-Za-z0-9])")
LEAST = 20  # characters of a run, as in _RUN
_ENCODINGS: dict = {}


def _encoding(path: str):
    only_cache(f"secrets {path}", lambda: _ENCODINGS.pop(path, None))
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def spans_of(text: str, encode, ratio: float = 2.4) -> list[tuple[int, int, str]]:
    """(start, kind number, end) ascending, ends exclusive, in code points."""
    base = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    more = []
    held = sorted((x, y) for x, _, y in base)
    for m in _RUN.finditer(text):
        known = [(x.start(), x.end()) for x in _DIGEST.finditer(text, m.start(), m.end())]
        at, parts = m.start(), []
        for x, y in sorted(held + known) if known else held:
            if x < m.end() and at < y:
                parts.append((at, x))
                at = max(at, y)
        for x, y in (*parts, (at, m.end())):
            if y - x >= LEAST and y - x < ratio * len(encode(text[x:y])):
                more.append((x, 3, y))
    return sorted(base + more)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, vocabulary: str, ratio: float = 2.4) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""

    def find(batches):
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            for a, b, texts in in_slices(batch.column(1)):
                spans = [spans_of(t or "", encode, ratio) for t in texts]
                counts = [[sum(k == kind for _, k, _ in x) for x in spans] for kind in range(4)]
                digest = [hashlib.sha256(joined([y for y in x if y[1] < 3]).encode()).hexdigest() for x in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array([joined(x) for x in spans], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    importable(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(find), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redacted(docs: DataFrame, vocabulary: str, ratio: float = 2.4, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mark; all other columns and rows as they are."""
    names = docs.columns

    def hide(batches):
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a, b, texts in in_slices(batch.column(at)):
                out = []
                for t in texts:
                    done, parts = 0, []
                    for s, _, e in spans_of(t, encode, ratio) if t else ():
                        if s >= done:
                            parts += [t[done:s], mark]
                        done = max(done, e)
                    out.append(t if not parts else "".join(parts) + t[done:])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else part.column(k) for k in range(part.num_columns)], names=names)

    importable(docs.sparkSession)
    return docs.mapInArrow(tidy(hide), docs.schema)

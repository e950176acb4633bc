"""Whole-text encoding with the tokenizers library, one library call for each distinct piece.

Both kinds of tokenizer cut a text into pre-tokens that are merged independently of each other, and no pre-token
crosses the places where ``CachedEncoder`` cuts. So encoding each distinct piece once and looking the others up gives
the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` at a fraction of its cost; tests compare the two.
Pieces are found and looked up as Arrow values in the texts' own bytes: no Python object is made of a known one.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Classes of bytes. Others (rarer white space, control bytes, parts of longer characters) cut nothing by themselves.
_SPACE, _MARK, _WORD = 1, 2, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*b" \t\n\r"]] = _SPACE
_CLASS[0x21:0x7F] = _MARK
_CLASS[[c for c in range(0x7F) if chr(c).isalnum()]] = _WORD
#: Second bytes of the letters from U+00C0 to U+00FF, whose first byte is C3.
_SECOND = np.zeros(256, np.uint8)
_SECOND[[c for c in range(0x80, 0xC0) if chr(c + 0x40).isalpha()]] = _WORD
#: Last bytes of three-byte characters that are white space.
_THIRD = np.zeros(256, bool)
_THIRD[[*range(0x80, 0x8B), 0x9F, 0xA8, 0xA9, 0xAF]] = True
#: A-Z lower-cased, white space as the space.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[0x41:0x5B] += 32
_PLAIN[_CLASS == _SPACE] = 32
#: Pieces that are one pre-token for certain.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_EASY = {"dropped": f"^{_LETTERS} ?$", "joined": f"^ {_LETTERS}$"}


class CachedEncoder:
    """encode(texts) -> (all ids, ids per text). A null text counts as empty.

    max_words bounds the cache; when it is full it starts anew, which changes the time and not the ids. Pieces of more than
    max_bytes aren't kept in it."""

    def __init__(self, path: str, max_words: int = 350_000, max_bytes: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre, norm = (json.dumps(said.get(k) or {}) for k in ("pre_tokenizer", "normalizer"))
        self.kind = "dropped" if '"Removed"' in pre and "\\\\s" in pre else "joined" if '"use_regex": true' in pre else "whole"
        self.lower = '"Lowercase"' in norm
        self.added = [x["content"] for x in said.get("added_tokens") or []]
        suffix = said["model"].get("end_of_word_suffix")
        del said
        names = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size() + 1)]
        self.edge = np.array([bool(suffix and x.endswith(suffix)) if self.kind == "dropped" else x.startswith("\u0120") for x in names])  # ids that end (dropped) or begin (joined) a pre-token
        self.max_words, self.max_bytes = max_words, max_bytes
        self._reset()

    def _reset(self) -> None:
        self.words, self.ids, self.at = pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _with_added(self, texts: pa.Array) -> np.ndarray:
        """Which texts may hold added tokens, in any case: these are found before all else, so such a text stays in one piece."""
        start = os.path.commonprefix(self.added)
        start = start[: next((k for k, c in enumerate(start) if c.lower() != c.upper()), len(start))]
        found = np.zeros(len(texts), bool)
        for s in [start] if start else self.added:
            found |= pc.match_substring(texts, s, ignore_case=not start).to_numpy(zero_copy_only=False)
        return np.flatnonzero(found)

    def _pieces(self, data: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where pieces start): a new piece starts with every text and

        - where white space goes and no pre-token holds any: after it;
        - else before the first of a run of white space, and before a space that something else follows (a run gives its
          last space to the next pre-token, so that what stays is the same at the end of a piece and inside a text);
        - before a mark (ASCII, neither letter nor digit) after a letter or digit: no pre-token goes on there."""
        cut = np.zeros(len(data) + 1, bool)
        if self.kind != "whole":
            kind = _CLASS[data]
            space = kind == _SPACE
            at = np.flatnonzero(data[:-1] == 0xC3) + 1
            kind[at] = _SECOND[data[at]]
            cut[1:-1] = (kind[1:] == _MARK) & (kind[:-1] == _WORD)
            if self.kind == "dropped":
                cut[1:-1] |= space[:-1] & ~space[1:]
            else:
                after = np.append(kind[1:], 0)
                after[bounds[1:][np.diff(bounds) > 0] - 1] = _SPACE  # a text's end: nothing follows
                cut[1:-1] |= space[1:] & (kind[:-1] >= _MARK)
                cut[:-1] |= (data == 32) & (after >= _MARK)
                at = np.flatnonzero((data == 32) & (after == 0))
                at = at[at + 3 < len(data)]
                a, b, c = data[at + 1], data[at + 2], data[at + 3]
                rare = (a < 0xC2) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a >= 0xE1) & (a <= 0xE3) & _THIRD[c])
                cut[at[~rare]] = True
            plain = data
            if self.lower and self.kind == "dropped":
                plain = _PLAIN[data]
                mixed = np.flatnonzero((data[1:] >= 0x80) & (data[:-1] != plain[:-1]))  # a mark may join it to a letter that has only one case
                plain[mixed] = data[mixed]
            for k in whole.tolist():
                a, b = bounds[k], bounds[k + 1]
                cut[a:b] = False
                plain = plain.copy() if plain is data else plain
                plain[a:b] = data[a:b]
            data = plain
        cut[bounds] = True
        return data, np.flatnonzero(cut[:-1])

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > self.max_words:
            self._reset()
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        if not len(texts) or not pc.max(pc.binary_length(texts)).as_py():
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        _, ends, data = texts.buffers()
        bounds = np.frombuffer(ends, np.int64, len(texts) + 1, 8 * texts.offset)
        data, bounds = np.frombuffer(data, np.uint8, bounds[-1] - bounds[0], bounds[0]), bounds - bounds[0]
        data, starts = self._pieces(data, bounds, self._with_added(texts) if self.added else np.zeros(0, np.int64))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        found = pc.index_in(pieces, value_set=self.words)
        kept = len(self.words)
        if found.null_count:
            unseen = pieces.filter(found.is_null())
            new, size, ids, fit = self._library(unseen.unique())
            rows = found.fill_null(0).to_numpy().astype(np.int64)
            rows[found.is_null().to_numpy(zero_copy_only=False)] = kept + pc.index_in(unseen, value_set=new).to_numpy()
            self.words = pa.concat_arrays([self.words, new.slice(0, fit)])
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size)])
            self.ids = np.concatenate([self.ids, ids])
            kept += fit
        else:
            rows = found.to_numpy()
        first = self.at[rows]
        size = self.at[rows + 1] - first
        end = np.cumsum(size)
        at = np.repeat(first - (end - size), size)
        at += np.arange(len(at))
        ids = self.ids[at]
        counts = np.diff(np.append(0, end)[np.searchsorted(starts, bounds)])
        if kept + 1 < len(self.at):
            self.ids, self.at = self.ids[: self.at[kept]].copy(), self.at[: kept + 1].copy()
        return ids, counts

    def _library(self, new: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
        """new in another order, ids per piece, all ids, and how many (the first ones) aren't too long to be kept.

        Easy pieces are encoded many to a call, as one text, which costs half: their ids part where pre-tokens do."""
        fits = pc.less_equal(pc.binary_length(new), self.max_bytes)
        easy = pc.and_(fits, pc.match_substring_regex(new.cast(pa.large_string()), _EASY[self.kind])) if self.kind in _EASY else pc.less(pc.binary_length(new), 0)
        first = new.filter(easy)
        new = pa.concat_arrays([first, new.filter(pc.and_not(fits, easy)), new.filter(pc.invert(fits))])
        texts = new.cast(pa.large_string()).to_pylist()

        def said(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
            got = [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            size = np.fromiter(map(len, got), np.int64, len(got))
            return size, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))

        n, size, ids, parts = len(first), np.zeros(0, np.int64), np.zeros(0, np.uint32), range(0, len(first), 200)
        if n:
            per, ids = said([("" if self.kind == "joined" else " ").join(texts[k : min(n, k + 200)]) for k in parts])
            edge = self.edge[np.minimum(ids, len(self.edge) - 1)]
            at = np.cumsum(per) - per
            if per.all() and (np.add.reduceat(edge, at, dtype=np.int64) == np.diff([*parts, n])).all() and edge[at if self.kind == "joined" else at + per - 1].all():
                at = np.flatnonzero(edge)
                size = np.diff(np.append(at, len(ids))) if self.kind == "joined" else np.diff(np.append(-1, at))
            else:  # another vocabulary, whose ids don't tell
                size, ids = said(texts[:n])
        more, rest = said(texts[n:])
        return new, np.concatenate([size, more]), np.concatenate([ids, rest]), int(pc.sum(fits).as_py())


_ENCODERS: dict[str, CachedEncoder] = {}
_CACHE: dict[str, object] = {}


def only_cache(name: str, clear=None) -> None:
    """Says that this worker process now works for ``name``: what other operators have cached in it is cleared, so that a
    worker that is used again holds the cache of one operator."""
    others = [k for k in _CACHE if k != name]
    for other in others:
        _CACHE.pop(other)()
    if others:
        give_back()
    if clear:
        _CACHE[name] = clear


def give_back() -> None:
    """Returns freed memory to the system, where Arrow and the C library can (workers stay and are used again)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(work, clear=None):
    """``work`` for mapInArrow; when its rows are out, ``clear`` is called and freed memory goes back to the system, since a worker
    waits with what it holds while others need the executor's memory."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            if clear:
                clear()
            give_back()

    return run


def encoder(path: str) -> CachedEncoder:
    """One encoder for each worker process and vocabulary."""
    only_cache(path, lambda: _ENCODERS.pop(path, None))
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def slices(column: pa.Array, size: int):
    """(first, last) of runs of a string column with about size bytes, so that memory follows the run and not the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = min(len(ends), int(np.searchsorted(ends, done + size)) + 1)
        yield first, last
        first = last


def in_slices(column: pa.Array, size: int = 1_000_000):
    """(first, last, texts) of each of the ``slices``."""
    for first, last in slices(column, size):
        yield first, last, column.slice(first, last - first).to_pylist()


def encoded(enc: CachedEncoder, column: pa.Array, size: int = 2_000_000):
    """(first, last, all ids, ids per text) of each of the ``slices``."""
    for first, last in slices(column, size):
        yield first, last, *enc.encode(column.slice(first, last - first))

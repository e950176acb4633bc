"""Word-shingle sets as 64-bit hashes, for whole texts, without a Python step per word."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=_U), 11)
_POWERS: dict[str, np.ndarray] = {"base": np.ones(1, _U), "inverse": np.ones(1, _U)}


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS[kind]
    if len(have) < n:
        step = _BASE if kind == "base" else _INVERSE
        with np.errstate(over="ignore"):
            have = np.concatenate([[_U(1)], np.cumprod(np.full(max(n, 1_500_000), step))])
        if n <= 3_000_000:
            _POWERS[kind] = have
    return have[:n]


def forget() -> None:
    """Drops the tables of powers, which the next call makes anew."""
    for kind in _POWERS:
        _POWERS[kind] = np.ones(1, _U)


def shingle_hashes(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of that many words; of a shorter text, one of all its words."""
    data = [(t or "").encode().lower() for t in texts]  # bytes.lower() changes A-Z alone
    ends = np.cumsum([len(x) + 1 for x in data])
    buf = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    white = _WHITE[buf]
    change = np.flatnonzero(np.diff(white, prepend=True))
    first, last = change[::2], change[1::2]
    with np.errstate(over="ignore"):
        total = np.concatenate([[_U(0)], np.cumsum(_BYTE[buf] * _powers("base", len(buf)))])
        word = mix((total[last] - total[first]) * _powers("inverse", len(buf))[first] + (last - first).astype(_U))
        run = word[: len(word) - words + 1].copy() if len(word) >= words else word[:0]
        for k in range(1, words):
            run = mix(run, k) + word[k : len(word) - words + 1 + k]
        run = mix(run, 97)
    bounds = np.concatenate([[0], np.searchsorted(first, ends)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(_unique(run[a : b - words + 1]))
        elif b > a:
            whole = word[a : a + 1].copy()
            with np.errstate(over="ignore"):
                for k in range(1, b - a):
                    whole = mix(whole, k) + word[a + k : a + k + 1]
            out.append(mix(whole, 98 + b - a))
        else:
            out.append(word[:0])
    return out


def _unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]

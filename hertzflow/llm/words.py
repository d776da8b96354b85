"""Helpers for word hashes and for sorted partitions, on numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

# Blanks of the word definition [^\x20\x09-\x0D]+.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
SLICE_BYTES = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), _BASE))])


def slice_hashes(raw: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of each word in some bytes that do not cut a word."""
    low = LOWER[raw]
    inside = ~blank[low]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.empty(0, np.uint64), first, last
    gaps = np.diff(first, append=len(raw))
    place = np.arange(first[0], len(raw), dtype=np.int64) - np.repeat(first, gaps)
    np.minimum(place, (last - first).max(), out=place)
    values = np.where(inside, BYTE_VALUES[low], np.uint64(0))[first[0] :] * _powers(int((last - first).max()) + 1)[place]
    return mix(np.add.reduceat(values, first - first[0]) + (last - first).astype(np.uint64)), first, last


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words of all texts, and where each text's begin
    (one more entry than texts). Long texts are taken in slices that end at blanks."""
    sizes, hashes, held, held_bytes = [], [], [], 0

    def flush():
        nonlocal held_bytes
        if held:
            starts = np.cumsum([0] + [len(x) + 1 for x in held])
            got, first, _ = slice_hashes(np.frombuffer(b" ".join(held) + b" ", np.uint8))
            hashes.append(got)
            sizes.extend(np.diff(np.searchsorted(first, starts)).tolist())
            held.clear()
            held_bytes = 0

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) <= SLICE_BYTES:
            held.append(raw)
            held_bytes += len(raw)
            if held_bytes >= SLICE_BYTES:
                flush()
            continue
        flush()
        whole, at, n = np.frombuffer(raw, np.uint8), 0, 0
        while at < len(raw):
            end = min(at + SLICE_BYTES, len(raw))
            while end < len(raw) and not BLANK[whole[end]]:
                ahead = np.flatnonzero(BLANK[whole[end : end + SLICE_BYTES]])
                end = end + int(ahead[0]) if len(ahead) else min(end + SLICE_BYTES, len(raw))
            got, _, _ = slice_hashes(whole[at:end])
            hashes.append(got)
            n += len(got)
            at = end
        sizes.append(n)
    flush()
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words of one text; of all its words where there are fewer."""
    if not len(words):
        return np.empty(0, np.uint64)
    k = min(size, len(words))
    total = np.full(len(words) - k + 1, np.uint64(k))
    with np.errstate(over="ignore"):
        for j in range(k):
            total = mix(total * _BASE + words[j : len(words) - k + 1 + j])
    return total


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by ``keys``, also across batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        for k in keys:
            column = pdf[k].to_numpy()
            change[1:] |= column[1:] != column[:-1]
        cuts = np.flatnonzero(change)
        if held and any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        bounds = [0, *cuts.tolist(), len(pdf)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            part = pdf.iloc[lo:hi]
            if hi < len(pdf):
                yield pd.concat([*held, part], ignore_index=True) if held else part
                held = []
            else:
                held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]

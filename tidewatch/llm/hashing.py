"""Hashes of bytes and words, computed for many texts at once."""

from __future__ import annotations

import numpy as np


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _byte_values(ignore_case: bool) -> np.ndarray:
    """A random number for every byte, 0 for white space."""
    values = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
    if ignore_case:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    values[[9, 10, 11, 12, 13, 32]] = 0
    return values


_VALUES = {case: _byte_values(case) for case in (False, True)}
_POWERS = np.random.default_rng(12).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


SLICE = 1 << 18  # bytes for which 64-bit numbers are held at a time


def word_hashes(raw: np.ndarray, ignore_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes begin, and a 64-bit hash of each word.

    Words are parted by ASCII white space; `ignore_case` holds for ASCII letters. The bytes are taken in
    slices that end at white space.
    """
    if len(raw) <= SLICE:
        return _word_hashes(raw, ignore_case)
    begins, words, at = [], [], 0
    while at < len(raw):
        end = at + SLICE
        while end < len(raw) and not len(blank := np.flatnonzero(_VALUES[False][raw[end : end + 4096]] == 0)):
            end += 4096
        end = min(end, len(raw)) if end >= len(raw) else end + int(blank[0])
        begin, found = _word_hashes(raw[at:end], ignore_case)
        begins.append(begin + at)
        words.append(found)
        at = end
    return np.concatenate(begins), np.concatenate(words)


def _word_hashes(raw: np.ndarray, ignore_case: bool) -> tuple[np.ndarray, np.ndarray]:
    values = _VALUES[ignore_case][raw]
    inside = values != 0
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(begins):
        return begins, np.zeros(0, np.uint64)
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    sizes = np.diff(np.append(begins, len(raw)))
    place = np.arange(begins[0], len(raw)) - np.repeat(begins, sizes)
    values[begins[0] :] *= _POWERS[place & 4095]
    far = np.flatnonzero(place >= 4096)  # places in long words get factors of their own
    if len(far):
        values[begins[0] + far] = _VALUES[ignore_case][raw[begins[0] + far]] * (mixed(place[far].astype(np.uint64)) | np.uint64(1))
    return begins, mixed(np.add.reduceat(values, begins) + (ends - begins).astype(np.uint64))

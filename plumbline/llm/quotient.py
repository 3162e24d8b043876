"""Counting quotient filters over 64-bit fingerprints, without loss.

A fingerprint is a segment (its top bits, which decide the filter that it is in), a quotient
(the next bits, as many as give a slot a fingerprint) and a remainder (the rest). A filter
keeps the remainders sorted by quotient and by themselves; a bit a quotient says whether it
has a run of remainders, a bit a slot whether it ends a run, and counters follow for the slots
that stand for more than one row. As the order of slots is that of the fingerprints, filters
are merged like sorted lists, and nothing is approximate.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QBBB")


def tally(prints: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order and how often each occurs; sorted stretches merge in linear time."""
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1]))) if len(prints) else np.zeros(0, np.int64)
    weights = np.ones(len(prints), np.int64) if counts is None else counts[order]
    return prints[first], np.add.reduceat(weights, first) if len(first) else np.zeros(0, np.int64)


def encode(prints: np.ndarray, counts: np.ndarray, segment_bits: int) -> bytes:
    """The filter of sorted distinct uint64 fingerprints of one segment and their counts."""
    n = len(prints)
    quotient_bits = max(int(n - 1).bit_length(), 3)
    rest_bits = 64 - segment_bits - quotient_bits
    own = prints & np.uint64((1 << (64 - segment_bits)) - 1)
    quotient = (own >> np.uint64(rest_bits)).astype(np.int64)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotient] = True
    run_end = np.concatenate((quotient[1:] != quotient[:-1], [True])) if n else np.zeros(0, bool)
    width = (rest_bits + 7) // 8
    remainder = (own & np.uint64((1 << rest_bits) - 1)).astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - width :]
    many = counts > 1
    extra = counts[many].astype(np.min_scalar_type(int(counts.max(initial=0))))
    return b"".join((_HEAD.pack(n, segment_bits, quotient_bits, extra.itemsize), np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(), remainder.tobytes(), np.packbits(many).tobytes(), extra.tobytes()))


def decode(data: bytes, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints and counts that ``encode`` was given."""
    n, segment_bits, quotient_bits, item = _HEAD.unpack_from(data)
    rest_bits = 64 - segment_bits - quotient_bits
    width, at = (rest_bits + 7) // 8, _HEAD.size

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, np.uint8, size, at - size)

    bits = lambda size: np.unpackbits(take(-(-size // 8)), count=size).astype(bool)
    occupied, run_end = bits(1 << quotient_bits), bits(n)
    whole = np.zeros((n, 8), np.uint8)
    whole[:, 8 - width :] = take(n * width).reshape(n, width)
    run = np.cumsum(run_end) - run_end
    quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
    many = bits(n)
    counts = np.ones(n, np.int64)
    counts[many] = take(int(many.sum()) * item).view(f"<u{item}")
    top = np.uint64(segment << (64 - segment_bits) if segment_bits else 0)
    return whole.view(">u8").ravel().astype(np.uint64) | quotient << np.uint64(rest_bits) | top, counts


def split(prints: np.ndarray, counts: np.ndarray, segment_bits: int) -> list[tuple[int, bytes]]:
    """Sorted fingerprints as (segment, filter) of each segment that has any."""
    segment = (prints >> np.uint64(64 - segment_bits)).astype(np.int64) if segment_bits else np.zeros(len(prints), np.int64)
    cuts = np.flatnonzero(np.diff(segment, prepend=-1)).tolist()
    return [(int(segment[a]), encode(prints[a:b], counts[a:b], segment_bits)) for a, b in zip(cuts, [*cuts[1:], len(prints)])]


def merge(filters: list[bytes], segment: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints and summed counts of filters of one segment."""
    parts = [decode(data, segment) for data in filters]
    return tally(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))

"""Words of many texts at once: where they are, their hashes and the hashes of runs of words, by numpy over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Seeds of the tables below. Any odd numbers would do.
_SEED, _BYTE_BASE = 0x5DEECE66D, 0x9E3779B97F4A7C15
_RUN_BASES = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes that are neither ASCII letters nor digits nor of other scripts.
_MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTES = mixed(np.arange(1, 257, dtype=_U) * _U(_SEED))
_BYTES_LOWER = _BYTES[_LOWER]

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n, at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16, 0 if have is None else len(have[0]) * 2)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b, _U)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[base] = have = (both[0], both[1])
    return have


def portions(texts: pa.Array, limit: int = 2 << 20) -> Iterator[pa.Array]:
    """The texts in slices of at most `limit` bytes, or of one longer text: what is computed from a slice takes bounded memory."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > limit:
            yield texts.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(texts):
        yield texts.slice(start)


#: Bytes, and places or words, that are worked on at once: a text of any length takes memory in proportion to its words only.
_CHUNK, _PLACES = 1 << 18, 1 << 16


class Words:
    """Words of texts: `start` and `end` (bytes), `hash`, and `first`, the number of the first word of each text, with the end."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False, alphanumeric: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
            if isinstance(texts, pa.ChunkedArray):
                texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type)
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = texts.buffers()[2] if n else None
        self.offsets = offsets - offsets[0]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        space, table = (_MARKS if alphanumeric else _SPACE), (_BYTES_LOWER if lower else _BYTES)
        found = [self._chunk(low, high, space, table) for low, high in self._cuts(space)]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U))
        self.start, self.end, self.hash = (np.concatenate(x) for x in (zip(*found, strict=True) if found else zip(none, strict=True)))
        self.first = np.searchsorted(self.start, self.offsets)

    def _cuts(self, space: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of about _CHUNK bytes that end where no word goes on."""
        low, size = 0, len(self.data)
        while low < size:
            high = low + _CHUNK
            while high < size:
                gaps = np.flatnonzero(space.take(self.data[high : high + _CHUNK]))
                border = int(self.offsets[np.searchsorted(self.offsets, high)])
                nearest = min(border, high + int(gaps[0]) if len(gaps) else size)
                if nearest <= high + _CHUNK:
                    high = nearest
                    break
                high += _CHUNK
            yield low, min(high, size)
            low = high

    def _chunk(self, low: int, high: int, space: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, size = self.data[low:high], high - low
        gap = np.ones(size + 1, bool)
        space.take(data, out=gap[:size])
        bound = np.zeros(size + 1, bool)  # where a text begins
        bound[self.offsets[np.searchsorted(self.offsets, low) : np.searchsorted(self.offsets, high, "right")] - low] = True
        inside = ~gap
        before = np.empty(size + 1, bool)  # a word reaches up to here
        before[0] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (bound | ~before))
        end = np.flatnonzero(before & (bound | gap))
        power, inverse = powers(_BYTE_BASE, size + 1)
        sums = np.zeros(size + 1, _U)
        np.cumsum(table.take(data) * power[:size], out=sums[1:])
        return start + low, end + low, mixed((sums[end] - sums[start]) * inverse[start])

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """The text that each of the given words belongs to."""
        return np.searchsorted(self.first, at, side="right") - 1

    def runs(self, at: np.ndarray, length: np.ndarray | int, which: int = 0) -> np.ndarray:
        """Hash of the run of `length` words at each of the ascending places; which: one of two independent functions."""
        base = _RUN_BASES[which]
        lengths = np.broadcast_to(np.asarray(length, np.int64), at.shape)
        out = np.empty(len(at), _U)
        begin = 0
        while begin < len(at):
            stop = min(begin + _PLACES, int(np.searchsorted(at, at[begin] + 2 * _PLACES)))
            part, size, low = at[begin:stop], lengths[begin:stop], int(at[begin])
            hashes = self.hash[low : int((part + size).max())]
            hashes = mixed(hashes ^ _U(base)) if which else hashes
            power, inverse = powers(base, len(hashes) + 1)
            sums = np.zeros(len(hashes) + 1, _U)
            np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
            part = part - low
            out[begin:stop] = mixed((sums[part + size] - sums[part]) * inverse[part] + size.astype(_U))
            begin = stop
        return out

    def places(self, length: int) -> np.ndarray:
        """Where a run of `length` words fits into one text."""
        ok = np.zeros(len(self.hash) + 1, bool)
        counts = self.counts()
        full = counts >= length
        edges = np.zeros(len(self.hash) + 1, np.int32)
        np.add.at(edges, self.first[:-1][full], 1)
        np.add.at(edges, (self.first[1:] - length + 1)[full], -1)
        ok = np.cumsum(edges) > 0
        return np.flatnonzero(ok[: len(self.hash)])

    def kept_texts(self, keep: np.ndarray) -> list[bytes]:
        """Of each text, its words under `keep` joined by one space."""
        places = np.flatnonzero(keep)
        ends = np.cumsum(self.end[places] - self.start[places] + 1)
        pieces = []
        for s in range(0, len(places), _PLACES):
            part = places[s : s + _PLACES]
            lengths = self.end[part] - self.start[part] + 1
            stop = np.cumsum(lengths)
            source = np.repeat(self.start[part] - (stop - lengths), lengths) + np.arange(int(stop[-1]))
            source[stop - 1] = 0  # behind each word
            out = self.data[source]
            out[stop - 1] = 32
            pieces.append(out.tobytes())
        data = b"".join(pieces)
        kept_before = np.concatenate(([0], np.cumsum(keep)))
        bytes_before = np.concatenate(([0], ends))[kept_before[self.first]]
        return [data[s : max(s, e - 1)] for s, e in zip(bytes_before[:-1].tolist(), bytes_before[1:].tolist())]

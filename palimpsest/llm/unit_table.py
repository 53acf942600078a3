"""Encoding of many texts by byte-level tokenizers that split texts by a pattern first, each distinct match only once.

Texts are cut at single spaces between other characters; the pattern never crosses from other characters into white space,
so no match is cut. Distinct pieces of a batch of texts are found by Arrow, cut into matches, and only matches that a bounded
table does not hold go to the tokenizer. Ids of whole texts are then gathered by numpy.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from palimpsest.llm.words import portions

#: Unicode's White_Space, as classes of regular expressions have it. Fixed values.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows it, up to the next white space: its ids do not depend on its neighbours.
UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
MARKS = string.punctuation
IDS = np.dtype("<u4")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Matches of a tokenizer's pattern, its \\s being White_Space; the library's own also takes U+001C to U+001F."""
    compiled = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
    return compiled.findall


class Table:
    """Results by text in two generations of about `entries` each: a full table becomes the elder, of which what is met again
    moves to the new."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], entries: int):
        self.make, self.entries = make, entries
        self.young: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def values(self, keys: list[str]) -> list[bytes]:
        """The results of distinct keys."""
        if len(self.young) > self.entries:
            self.elder, self.young = self.young, {}
        young, elder = self.young, self.elder
        out = [*map(young.get, keys)]
        todo = []
        for i, value in enumerate(out):
            if value is None:
                key = keys[i]
                if (old := elder.get(key)) is not None:
                    out[i] = young[key] = old
                else:
                    todo.append(i)
        if todo:
            fresh = [keys[i] for i in todo]
            for i, key, value in zip(todo, fresh, self.make(fresh), strict=True):
                out[i] = young[key] = value
        return out


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """data[start : start + length] of each pair, one behind the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(data)) < 2**31 else np.int64
    places = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    places += np.arange(total, dtype=kind)
    return data[places]


class Pool:
    """Ids of numbered entries."""

    def __init__(self, values: list[bytes]):
        self.lengths = np.fromiter(map(len, values), np.int64, len(values)) // IDS.itemsize
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(values), IDS)


class TextEncoder:
    """`split` cuts a unit into the pattern's matches; `encode_parts` gives the bytes of distinct matches, `encode_words` those
    of words of letters, each with a space before it."""

    def __init__(self, split: Callable[[str], list[str]], encode_parts: Callable[[list[str]], list[bytes]], encode_words: Callable[[list[str]], list[bytes]] | None = None, entries: int = 300_000):
        self.split = split
        self.words = Table(encode_words or (lambda keys: encode_parts([" " + k for k in keys])), entries)
        self.parts = Table(encode_parts, entries // 8)

    def _units(self, units: list[str]) -> list[bytes]:
        cut = [*map(self.split, units)]
        distinct = [*{p for parts in cut for p in parts}]
        known = dict(zip(distinct, self.parts.values(distinct), strict=True))
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]

    def _pieces(self, pieces: pa.Array, odd: np.ndarray) -> Pool:
        """Ids of distinct pieces, each behind a space; nothing for odd ones. Letters, then ASCII marks, are one match each."""
        core = pc.utf8_rtrim(pieces, characters=MARKS)
        size, core_size = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (pieces, core))
        plain = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False) & (core_size > 0) & ~odd
        cores = core.filter(pa.array(plain)).dictionary_encode()
        marked = np.flatnonzero(plain & (core_size < size))
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces)]
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        lengths = (size - core_size)[marked]
        ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        tails = pa.StringArray.from_buffers(len(marked), pa.py_buffer(ends), pa.py_buffer(gathered(data, offsets[marked] + core_size[marked], lengths))).dictionary_encode()
        rest = np.flatnonzero(~plain & ~odd)
        others = self._units([" " + x for x in pieces.take(pa.array(rest)).to_pylist()])
        pool = Pool([*self.words.values(cores.dictionary.to_pylist()), *self.parts.values(tails.dictionary.to_pylist()), *others, b""])
        n_cores, n_tails = len(cores.dictionary), len(tails.dictionary)
        none = len(pool.lengths) - 1
        entries = np.full((len(pieces), 2), none, np.int64)
        entries[plain, 0] = cores.indices.to_numpy()
        entries[marked, 1] = n_cores + tails.indices.to_numpy()
        entries[rest, 0] = n_cores + n_tails + np.arange(len(rest))
        both = entries.ravel()
        out = Pool([])
        out.data = gathered(pool.data, pool.starts[both], pool.lengths[both])
        out.lengths = pool.lengths[entries].sum(axis=1)
        out.starts = np.cumsum(out.lengths) - out.lengths
        return out

    def encode_portion(self, texts: pa.Array) -> list[np.ndarray]:
        if texts.null_count:
            texts = texts.fill_null("")
        lists = pc.split_pattern(texts.cast(pa.string()), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        distinct, index = pieces.dictionary, pieces.indices.to_numpy()
        size = pc.binary_length(distinct).to_numpy()
        odd = (size == 0) | (pc.binary_length(pc.utf8_trim_whitespace(distinct)).to_numpy() < size)
        heads = offsets[:-1]
        spaced = np.maximum.reduceat(odd[index], heads)  # white space meets a space: such texts are cut into units
        pool = self._pieces(distinct, odd)
        lengths = pool.lengths[index]
        lengths[heads] = 0  # no space before these
        data = gathered(pool.data, pool.starts[index], lengths)
        ends = np.cumsum(lengths)
        starts = np.concatenate(([0], ends))[heads].tolist()
        firsts = distinct.take(pa.array(index[heads])).to_pylist()
        units = [UNITS.findall(text.as_py()) if s else [first] for text, first, s in zip(texts, firsts, spaced.tolist(), strict=True)]
        known = [*{u for some in units for u in some}]
        ids = dict(zip(known, self._units(known), strict=True))
        out = []
        for some, s, start, end in zip(units, spaced.tolist(), starts, ends[offsets[1:] - 1].tolist(), strict=True):
            first = np.frombuffer(b"".join(map(ids.__getitem__, some)), IDS)
            out.append(first if s else np.concatenate((first, data[start:end])))
        return out

    def encode_many(self, texts: pa.Array):
        """Ids of each text, null as empty, in order; 8 MB of text or one longer text are worked on at a time."""
        for part in portions(texts, 8 << 20):
            yield from self.encode_portion(part)

    def encode(self, text: str) -> bytes:
        return self.encode_portion(pa.array([text], pa.string()))[0].tobytes()

"""Elias-Fano sequences and the n-gram trie built of them: compact arrays in files that queries map into memory."""

from __future__ import annotations

import os
from functools import cached_property

import numpy as np

W = np.uint64


def numbered(values: np.ndarray, bound: int = 1 << 64) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and each value's number among them. Values are below ``bound``."""
    place = len(values).bit_length()
    if (bound - 1).bit_length() + place <= 64:
        # A value and its place in one number: a plain sort takes a fifth of the time of an argsort.
        keys = values.astype(np.uint64)
        keys <<= W(place)
        keys |= np.arange(len(values), dtype=np.uint64)
        keys.sort()
        order = (keys & W((1 << place) - 1)).astype(np.int32)
        keys >>= W(place)
        values = keys.view(values.dtype) if values.itemsize == 8 else keys.astype(values.dtype)
        del keys
    else:
        order = np.argsort(values)
        values = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    number = np.empty(len(values), np.int32)
    number[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return values[fresh], number


def mapped(folder: str, name: str) -> np.ndarray:
    """A saved array, mapped into memory."""
    return np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r").view(np.ndarray)


class EliasFano:
    """A non-decreasing sequence of n integers below ``universe`` in about 2 + log2(universe / n) bits each.

    ``low``: the low bits, side by side; ``high``: the high parts in unary, a one for each value and a zero for each step. Where many
    values are asked for, both parts are unpacked first: ``high_parts``, ``starts`` and ``low_parts``.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high

    def _places(self, bit: int) -> np.ndarray:
        found = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little") == bit)
        found -= np.arange(len(found))
        return found.astype(np.int32) if len(self.high) < 1 << 25 else found

    @cached_property
    def high_parts(self) -> np.ndarray:
        """The high part of each value: zeros before its one."""
        return self._places(1)

    @cached_property
    def starts(self) -> np.ndarray:
        """How many values have a high part below h, for each h: ones before the zero that begins it."""
        return np.r_[np.int32(0), self._places(0)]

    @cached_property
    def low_parts(self) -> np.ndarray:
        """The low bits of each value."""
        found = self.lows(np.arange(self.n))
        return found.astype(np.uint32) if self.bits <= 32 else found

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            at = np.arange(n) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            part = values & W((1 << bits) - 1)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            if n:
                low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero(shift + W(bits) > W(64))  # at most one value a word
            low[word[over] + 1] |= part[over] >> (W(64) - shift[over])
        size = n + (universe >> bits) + 2
        unary = np.zeros((size + 63) // 64 * 64, np.uint8)
        unary[(values >> W(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        return cls(n, bits, low, high)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        spill = np.where(shift > 0, self.low[word + 1] << ((W(64) - shift) & W(63)), W(0))
        return (value | spill) & W((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        return (self.high_parts[i].astype(np.uint64) << W(self.bits)) | self.lows(i)

    def find(self, targets: np.ndarray, first: np.ndarray | int = 0, stop: np.ndarray | None = None) -> np.ndarray:
        """Position of each target in [first, stop), or -1: a successor search among the values that share its high part."""
        if not self.n or not len(targets):
            return np.full(len(targets), -1)
        targets = targets.astype(np.uint64)
        h = (targets >> W(self.bits)).astype(np.int64)
        steps = len(self.starts) - 2
        inside = h <= steps
        h = np.minimum(h, steps)
        lo, end = self.starts[h].astype(np.int64), self.starts[h + 1].astype(np.int64)
        lo, end = np.maximum(lo, first), end if stop is None else np.minimum(end, stop)
        want = (targets & W((1 << self.bits) - 1)).astype(self.low_parts.dtype)
        open_ = np.flatnonzero(lo < end)
        low, high, sought = lo[open_], end[open_], want[open_]
        while len(open_):
            middle = (low + high) >> 1
            less = self.low_parts[middle] < sought
            low = np.where(less, middle + 1, low)
            high = np.where(less, high, middle)
            more = low < high
            found = ~more
            lo[open_[found]] = low[found]
            open_, low, high, sought = open_[more], low[more], high[more], sought[more]
        hit = np.flatnonzero(inside & (lo < end))
        hit = hit[self.low_parts[lo[hit]] == want[hit]]
        out = np.full(len(targets), -1)
        out[hit] = lo[hit]
        return out

    def save(self, folder: str, name: str) -> None:
        np.savez(os.path.join(folder, f"{name}.shape.npz"), n=self.n, bits=self.bits)
        for part in ("low", "high"):
            np.save(os.path.join(folder, f"{name}.{part}.npy"), getattr(self, part))

    @classmethod
    def open(cls, folder: str, name: str) -> EliasFano:
        with np.load(os.path.join(folder, f"{name}.shape.npz")) as shape:
            n, bits = int(shape["n"]), int(shape["bits"])
        return cls(n, bits, *[mapped(folder, f"{name}.{part}") for part in ("low", "high")])


#: A probability p is kept as one byte, round(-log2(p) * STEPS) + 1; zero means none.
STEPS = 8


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log2(p) * STEPS) + 1, 1, 255).astype(np.uint8)


_SHARES = np.where(np.arange(256) > 0, np.exp2((1.0 - np.arange(256, dtype=np.uint8)) / STEPS), 0.0)


def dequantise(code: np.ndarray) -> np.ndarray:
    return _SHARES[code]


class Trie:
    """Contexts and their successors.

    Levels: context keys, pointers to where each context's successors begin, word keys, and successors as context number times words plus word
    number, which grows from context to context. Beside them stand the quantised probability of each successor and, per context, how often
    it was seen and how many successors it has.
    """

    PARTS = ("contexts", "pointers", "words", "successors")

    def __init__(self, folder: str):
        for part in self.PARTS:
            setattr(self, part, EliasFano.open(folder, part))
        self.codes, self.seen, self.kinds = (mapped(folder, x) for x in ("codes", "seen", "kinds"))

    @classmethod
    def build(cls, folder: str, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, discount: float, universe: int) -> Trie:
        """From n-grams (context key, word key, count above 0), each once, in any order, keys below ``universe``."""
        (context, i), (word, j) = numbered(contexts, universe), numbered(words, universe)
        at = i.astype(np.int64) * max(len(word), 1) + j
        if (at[1:] < at[:-1]).any():
            order = np.argsort(at)
            i, at, counts = i[order], at[order], counts[order]
        kinds = np.bincount(i, minlength=len(context))
        seen = np.bincount(i, counts, len(context)).astype(np.int64)
        codes = quantise((counts - discount) / seen[i]) if len(i) else np.zeros(0, np.uint8)
        parts = {
            "contexts": (context, universe), "pointers": (np.concatenate([[0], np.cumsum(kinds)]), len(i) + 1), "words": (word, universe),
            "successors": (at, max(1, len(context) * len(word)))}
        for name, (values, bound) in parts.items():
            EliasFano.of(values, bound).save(folder, name)
        for name, values in {"codes": codes, "seen": seen, "kinds": kinds}.items():
            np.save(os.path.join(folder, f"{name}.npy"), values)
        return cls(folder)

    def context(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of contexts (-1: unknown), how often they were seen, and their kinds of successors."""
        at = self.contexts.find(keys)
        if not self.contexts.n:
            return at, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        return at, np.where(at >= 0, self.seen[at], 0), np.where(at >= 0, self.kinds[at], 0)

    def probability_codes(self, context: np.ndarray, each: np.ndarray, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Codes of n-grams, ``each`` of them after a context given by number, by a search among the context's successors; 0 if there is none.

        ``words`` are distinct keys, ``last`` is the number of each n-gram's last word among them.
        """
        out = np.zeros(len(last), np.uint8)
        if not self.contexts.n:
            return out
        number = self.words.find(words)[last]
        known = np.maximum(context, 0)
        first, stop = self.pointers.get(known).astype(np.int64), self.pointers.get(known + 1).astype(np.int64)
        pair = np.repeat(np.arange(len(context), dtype=np.int32), each)
        ok = np.flatnonzero((context[pair] >= 0) & (number >= 0))
        pair = pair[ok]
        at = self.successors.find(context[pair] * self.words.n + number[ok], first[pair], stop[pair])
        out[ok] = np.where(at >= 0, self.codes[np.maximum(at, 0)], 0)
        return out

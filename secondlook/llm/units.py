"""Numbers of recurring byte strings (words, segments) inside one task, looked up for whole arrays of places at once.

Strings of up to SHORT bytes are their own key: two 64-bit numbers that hold all bytes and the length, so equal keys mean
equal strings. Longer ones are looked up one by one.
"""

from itertools import chain

import numpy as np

from secondlook.llm.common import mixed

SHORT = 15
#: So many bytes must follow the last string in a buffer.
PADDING = 16
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Units:
    """Numbers 0, 1, ... for distinct byte strings, in the order in which they were added."""

    def __init__(self):
        self.n = 0
        self._slots = np.full(1 << 12, -1, np.int32)  # open addressing, at most half full
        self._low, self._high = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.uint64)
        self._long: dict[bytes, int] = {}

    def numbers(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The number of each string ``buffer[start:end]``, and the strings that have been added for it, by number."""
        sizes = ends - starts
        words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))  # eight bytes from each place on
        low = words[starts] & _MASKS[np.minimum(sizes, 8)]
        high = words[np.minimum(starts + 8, len(words) - 1)] & _MASKS[np.clip(sizes - 8, 0, 7)]
        high |= sizes.astype(np.uint64) << np.uint64(56)
        found = np.full(len(starts), -1, np.int32)
        short = np.flatnonzero(sizes <= SHORT)
        self._find(low, high, short, found)
        new: dict[bytes, int] = {}
        missing = short[found[short] < 0]
        raw = buffer.tobytes() if len(missing) or len(short) < len(starts) else b""
        if len(missing):
            firsts: dict[bytes, int] = {}
            for i, a, z in zip(missing.tolist(), starts[missing].tolist(), ends[missing].tolist()):
                firsts.setdefault(raw[a:z], i)
            new = {s: self.n + k for k, s in enumerate(firsts)}
            self._add(low, high, np.fromiter(firsts.values(), np.int64, len(firsts)))
            self._find(low, high, missing, found)
        for i in np.flatnonzero(sizes > SHORT).tolist():
            s = raw[starts[i] : ends[i]]
            number = self._long.get(s)
            if number is None:
                number = self._long[s] = new[s] = self.n
                self._grow(self.n + 1)
                self.n += 1
            found[i] = number
        return found, list(new)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mixed(low ^ (high * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(len(self._slots) - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, places: np.ndarray, found: np.ndarray) -> None:
        low, high = low[places], high[places]
        slots = self._slot(low, high)
        while len(places):
            at = self._slots[slots]
            hit = (self._low[at] == low) & (self._high[at] == high) & (at >= 0)
            found[places[hit]] = at[hit]
            go = np.flatnonzero(~hit & (at >= 0))
            places, low, high, slots = places[go], low[go], high[go], slots[go] + 1 & len(self._slots) - 1

    def _add(self, low: np.ndarray, high: np.ndarray, places: np.ndarray) -> None:
        numbers = np.arange(self.n, self.n + len(places), dtype=np.int32)
        self._grow(self.n + len(places))
        self._low[numbers], self._high[numbers] = low[places], high[places]
        self.n += len(places)
        self._enter(numbers)

    def _enter(self, numbers: np.ndarray) -> None:
        slots = self._slot(self._low[numbers], self._high[numbers])
        while len(numbers):
            free = self._slots[slots] < 0
            self._slots[slots[free]] = numbers[free]
            left = np.flatnonzero(self._slots[slots] != numbers)  # the slot is another's
            numbers, slots = numbers[left], slots[left] + 1 & len(self._slots) - 1

    def _grow(self, n: int) -> None:
        if n > len(self._low):
            size = max(n, 2 * len(self._low))
            self._low, self._high = (np.concatenate([x, np.zeros(size - len(x), np.uint64)]) for x in (self._low, self._high))
        if 2 * n > len(self._slots):
            self._slots = np.full(1 << (4 * n).bit_length(), -1, np.int32)
            own = np.flatnonzero(self._high[: self.n]).astype(np.int32)  # long strings have no key
            self._enter(own)


class Lists:
    """A growing sequence of lists of numbers, by which many of them are joined at once."""

    def __init__(self, kind):
        self.sizes, self.begins = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int64)
        self._values, self._n, self._used = np.zeros(1 << 12, kind), 0, 0

    def add(self, lists: list) -> None:
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        total, n = self._used + int(sizes.sum()), self._n + len(lists)
        self.sizes, self.begins, self._values = (
            _longer(x, size) for x, size in ((self.sizes, n), (self.begins, n), (self._values, total))
        )
        self.sizes[self._n : n] = sizes
        self.begins[self._n : n] = self._used + np.cumsum(sizes) - sizes
        self._values[self._used : total] = np.fromiter(chain.from_iterable(lists), self._values.dtype, total - self._used)
        self._n, self._used = n, total

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these lists in order, and where each list begins in them (one more entry at the end)."""
        times = self.sizes[numbers]
        edges = np.concatenate(([0], np.cumsum(times, dtype=np.int64)))
        return self._values[np.repeat(self.begins[numbers] - edges[:-1], times) + np.arange(edges[-1])], edges


def _longer(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)])

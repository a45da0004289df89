"""Harmonic packing: lengths fall into reciprocal-capacity classes, and a class's bins hold a fixed number of pieces.

With capacity C, class j takes lengths in (C/(j+1), C/j], and each of its bins exactly j pieces. A document longer
than C is cut into full sequences and a rest. A rest that would leave much of its class's share of a bin empty
gives off a piece that fills the share of the next class, and goes on with what is left.

Every task fills bins from its own documents, without knowing of other tasks. Pieces in bins that are not full
when a task ends meet in ever fewer tasks (by a factor of FAN_IN) that fill bins the same way; what the very last
one leaves, at most j - 1 pieces of each class, it packs by first fit, longest first.

Defined cases: a null text is an empty one and consists of the end id alone; rows with repeated or null ids are
packed like any others, each on its own. A retried task fills the same bins, and the pieces of the first pass are
written to the shared folder before they are read again.
"""

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import giving_back, table
from secondlook.llm.units import PADDING, Lists, Units
from secondlook.session import stage

CAPACITY = 4096
END_ID = 2
FAN_IN = 64
#: A rest is not cut further if it leaves at most so many ids, or such a part of itself, of its share empty.
SLACK_IDS, SLACK_PART = 8, 0.01
#: Words and marks that a worker keeps at hand, about 50 bytes each; with more, it begins anew.
KEPT = 1 << 19
STEP_CHARS = 1 << 19
#: Rows whose texts are read from a batch at once.
SLICE_ROWS = 128


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces, in order."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        j = capacity // rest
        if capacity // j - rest <= max(SLACK_IDS, SLACK_PART * rest):
            pieces.append(rest)
            break
        pieces.append(capacity // (j + 1))
        rest -= capacity // (j + 1)
    return pieces


class Bins:
    """The bins of one task: yields a bin's pieces once it is full. A piece is (length, whatever it carries)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.open = capacity, defaultdict(list)

    def put(self, length: int, what: tuple) -> list[tuple]:
        j = self.capacity // length
        own = self.open[j]
        own.append((length, what))
        return self.open.pop(j) if len(own) == j else []

    def left(self) -> Iterator[tuple]:
        for j in sorted(self.open):
            yield from self.open[j]


def first_fit(pieces: list[tuple], capacity: int = CAPACITY) -> list[list[tuple]]:
    """Bins for the last pieces, longest first; there are a bounded number of them."""
    bins: list[list[tuple]] = []
    room: list[int] = []
    for piece in sorted(pieces, key=lambda p: -p[0]):
        at = next((i for i, r in enumerate(room) if r >= piece[0]), None)
        if at is None:
            bins.append([])
            room.append(capacity)
            at = len(bins) - 1
        bins[at].append(piece)
        room[at] -= piece[0]
    return bins


@lru_cache(1)
def tokenizer_of(path: str) -> "WordTokenizer":
    """One per Python worker, so that later tasks find what earlier ones have learned."""
    return WordTokenizer(path)


class WordTokenizer:
    """Ids of whole texts by a tokenizer whose pieces never cross white space: equal words are encoded once.

    The tokenizer lower-cases and splits punctuation off, so a word that ends in a letter of ASCII and the marks after it are
    encoded apart, and words of ASCII in lower case. Words of up to 15 bytes are found for a whole run of texts at once.
    """

    MARKS = b".,;:!?|*#$%&"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.units, self.ids = Units(), Lists("<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        if self.units.n > KEPT:
            self.units, self.ids = Units(), Lists("<u4")
        coded = [t.encode() for t in texts]
        buffer = np.frombuffer(bytearray(b"\n".join([*coded, b"\n" * PADDING])), np.uint8)
        word_starts, starts, ends = _units(buffer)
        numbers, new = self.units.numbers(buffer, starts, ends)
        self._learn(new)
        found, edges = self.ids.joined(numbers)
        offsets = np.cumsum([0, *(len(t) + 1 for t in coded)])
        edges = edges[word_starts[np.searchsorted(starts[word_starts[:-1]], offsets)]].tolist()
        return [found[a:z] for a, z in zip(edges, edges[1:])]

    def _learn(self, units: list[bytes]) -> None:
        ids: list = [None] * len(units)
        others = []
        for i, unit in enumerate(units):
            if unit.isalpha() and unit.islower():  # of ASCII alone: nothing to normalise or to split
                ids[i] = [t.id for t in self.tokenizer.model.tokenize(unit.decode())]
            else:
                others.append(i)
        for at in range(0, len(others), 4096):
            some = others[at : at + 4096]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([units[i].decode() for i in some], add_special_tokens=False)):
                ids[i] = e.ids
        self.ids.add(ids)


_SEPARATOR, _MARK, _LETTER, _CAPITAL = np.zeros((4, 256), bool)
_SEPARATOR[[0x0A, 0x20]] = True
_MARK[list(WordTokenizer.MARKS)] = True
_CAPITAL[65:91] = _LETTER[65:91] = _LETTER[97:123] = True


def _units(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word's first unit and of units, starts, ends) of the units: words, or words and the marks after them.

    Capitals of ASCII words are lower-cased in the buffer.
    """
    turns = np.flatnonzero(np.diff(~_SEPARATOR[buffer], prepend=False))
    starts, ends = turns[0::2], turns[1::2]
    beyond = np.concatenate(([0], np.cumsum(buffer >= 128, dtype=np.int32)))
    special = np.zeros(len(starts), bool)  # may hold a special token
    special[np.searchsorted(starts, np.flatnonzero(buffer == ord("<")), "right") - 1] = True
    kept = special | (beyond[ends] > beyond[starts])
    capitals = np.flatnonzero(_CAPITAL[buffer])
    buffer[capitals[~kept[np.searchsorted(starts, capitals, "right") - 1]]] += 32
    cores, some = ends.copy(), np.arange(len(ends))
    while len(some):
        some = some[_MARK[buffer[cores[some] - 1]]]  # before a word there is a separator, or the padding
        cores[some] -= 1
    cut = _LETTER[buffer[cores - 1]] & (cores < ends) & ~special
    firsts = np.arange(len(starts)) + np.cumsum(cut) - cut
    unit_starts, unit_ends = np.empty((2, len(starts) + int(cut.sum())), np.int64)
    unit_starts[firsts], unit_ends[firsts] = starts, np.where(cut, cores, ends)
    unit_starts[firsts[cut] + 1], unit_ends[firsts[cut] + 1] = cores[cut], ends[cut]
    return np.append(firsts, len(unit_starts)), unit_starts, unit_ends


PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, level int"
)
_ARROW = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in PIECE.split(", ")])


class _Rows:
    """Finished rows of a task; a full bin gets a number that no other bin has."""

    def __init__(self, level: int):
        self.level, self.task, self.serial, self.rows = level, TaskContext.get().partitionId(), 0, []

    def bin(self, pieces: list[tuple]) -> None:
        offset, number = 0, self.level << 56 | self.task << 32 | self.serial
        self.serial += 1
        for length, what in pieces:
            self.rows.append((*what, number, offset, -1))
            offset += length

    def open(self, pieces) -> None:
        self.rows += [(*what, None, None, self.level) for _, what in pieces]

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _tokenized(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    tokenizer, bins, rows, end = tokenizer_of(vocabulary), Bins(), _Rows(0), np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        for some in _parts(_read(batch)):
            for (key, _), ids in zip(some, tokenizer.encode([t for _, t in some])):
                _place(key, ids.tobytes() + end, bins, rows)
            yield rows.batch()
    rows.open(bins.left())
    yield rows.batch()


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    for at in range(0, batch.num_rows, SLICE_ROWS):
        rows = batch.slice(at, SLICE_ROWS)
        yield from zip(rows.column("doc_id").to_pylist(), (t or "" for t in rows.column("text").to_pylist()))


def _parts(held: Iterator[tuple]) -> Iterator[list[tuple]]:
    some, size = [], 0
    for item in held:
        some.append(item)
        size += len(item[1])
        if size >= STEP_CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


def _place(key, ids: bytes, bins: Bins, rows: _Rows) -> None:
    start, total = 0, len(ids) // 4
    for length in cuts(total):
        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
        if full := bins.put(length, (key, start, length, crc, total)):
            rows.bin(full)
        start += length


def _gathered(batches: Iterator[pa.RecordBatch], level: int, last: bool) -> Iterator[pa.RecordBatch]:
    bins, rows = Bins(), _Rows(level)
    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if full := bins.put(r[2], r):
                rows.bin(full)
        yield rows.batch()
    if last:
        for full in first_fit(list(bins.left())):
            rows.bin(full)
    else:
        rows.open(bins.left())
    yield rows.batch()


def pack(documents: DataFrame, vocabulary: str) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence. Only the text's ids are packed."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = max(1, texts.rdd.getNumPartitions())
    pieces = stage(texts.mapInArrow(lambda b: giving_back(_tokenized(b, vocabulary)), PIECE), "packing")
    done, level = [pieces.filter("level < 0")], 0
    while True:
        left = pieces.filter(F.col("level") == level)
        tasks, level = -(-tasks // FAN_IN), level + 1
        last = tasks == 1
        dealt = left.coalesce(1) if last else left.repartition(tasks)
        pieces = stage(dealt.mapInArrow(_gatherer(level, last), PIECE), "packing")
        done.append(pieces.filter("level < 0"))
        if last:
            break
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionAll(more)
    return packed.drop("level")


def _gatherer(level: int, last: bool):
    return lambda batches: _gathered(batches, level, last)


def op6_harmonic_packing(spark, d: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_harmonic_packing": op6_harmonic_packing}
ORACLES: dict[str, str] = {}

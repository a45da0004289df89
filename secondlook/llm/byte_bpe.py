"""Byte-level BPE: a segment tree over byte positions stores the leftmost pair of lowest rank.

Each leaf holds rank and position of the pair that begins there; an inner node the smaller of its children.
The root thus names the next merge, and a merge updates three leaves, each in logarithmic time. Texts are split
by the vocabulary's pattern first, and each match is encoded on its own. New matches of a step are encoded side by
side, one row of a numpy array per tree; a task keeps the ids of short matches that it has met. Long matches get a
tree each.

Defined cases: null and empty texts have no ids. Any text decodes to its own UTF-8 bytes.
"""

import base64
import hashlib
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import table

#: Matches whose ids a task keeps at hand; the store starts anew beyond that.
KEPT = 300_000
#: Matches of up to so many bytes are merged side by side and may be kept.
SHORT = 64
#: Characters of text that are split before their new matches get encoded.
STEP_CHARS = 1 << 20
_NONE = 1 << 62
_LONG_GAP = re.compile(r"\s{3}|\s\s\Z").search


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: repeatedly merge the leftmost pair of lowest rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    base = 1 << (n - 1).bit_length()
    end = list(range(1, n + 1))  # of the part that begins at a position
    before = list(range(-1, n - 1))  # where the part before it begins
    get, shift = ranks.get, n.bit_length()
    tree = [_NONE] * (2 * base)
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            tree[base + i] = rank << shift | i
    for k in range(base - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = base + i
        tree[k] = value
        while k > 1:
            a, b = tree[k], tree[k ^ 1]
            k >>= 1
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least

    def pair(i: int) -> int:
        j = end[i]
        rank = get(piece[i : end[j]]) if j < n else None
        return _NONE if rank is None else rank << shift | i

    mask = (1 << shift) - 1
    while (first := tree[1]) != _NONE:
        i = first & mask
        j = end[i]
        end[i] = end[j]
        if end[i] < n:
            before[end[i]] = i
        put(j, _NONE)
        put(i, pair(i))
        if i:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class SideBySide:
    """Segment trees of many short matches at once: one row each, all advancing by one merge per round."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.byte_ranks = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the joined token; -1 if there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each match (2 to SHORT bytes) as little-endian unsigned 32-bit integers."""
        by_base = defaultdict(list)
        for k, piece in enumerate(pieces):
            by_base[1 << (len(piece) - 1).bit_length()].append(k)
        found: list[bytes] = [b""] * len(pieces)
        for base, rows in by_base.items():
            for k, ids in zip(rows, self._merge([pieces[k] for k in rows], base)):
                found[k] = ids
        return found

    def _merge(self, pieces: list[bytes], base: int) -> list[bytes]:
        m, width = len(pieces), base
        lengths = np.fromiter(map(len, pieces), np.int64, m)
        padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        ids = self.byte_ranks[padded]
        places = np.arange(width)
        inside = places < lengths[:, None]
        end = np.tile(places + 1, (m, 1))
        before = np.tile(places - 1, (m, 1))
        tree = np.full((m, 2 * base), _NONE)
        rank = self.rank(ids[:, :-1], ids[:, 1:])
        tree[:, base : 2 * base - 1] = np.where((rank >= 0) & inside[:, 1:], rank * base + places[:-1], _NONE)
        level = base
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        alive = np.flatnonzero(tree[:, 1] != _NONE)
        while len(alive):
            first = tree[alive, 1]
            i = first % base
            j = end[alive, i]
            ids[alive, i] = first // base
            inside[alive, j] = False
            z = end[alive, j]
            end[alive, i] = z
            more = z < lengths[alive]
            before[alive[more], z[more]] = i[more]
            h = before[alive, i]
            has = h >= 0
            rows, h = alive[has], h[has]
            values = (
                np.full(len(alive), _NONE),
                self._pairs(ids, alive, i, z, more, base),
                self._pairs(ids, rows, h, i[has], np.ones(len(h), bool), base),
            )
            self._put(tree, base, np.concatenate((alive, alive, rows)), np.concatenate((j, i, h)), np.concatenate(values))
            alive = alive[tree[alive, 1] != _NONE]
        counts = inside.sum(1)
        flat = ids[inside].astype("<u4").tobytes()
        cuts = np.concatenate(([0], np.cumsum(counts))) * 4
        return [flat[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _pairs(self, ids, rows, left, right, valid, base) -> np.ndarray:
        rank = np.full(len(rows), -1, np.int64)
        rank[valid] = self.rank(ids[rows[valid], left[valid]], ids[rows[valid], right[valid]])
        return np.where(rank >= 0, rank * base + left, _NONE)

    @staticmethod
    def _put(tree, base, rows, places, values) -> None:
        flat, origin = tree.reshape(-1), rows * (2 * base)
        k = places + base
        flat[origin + k] = values
        while base > 1:
            at = origin + k
            least = np.minimum(flat[at], flat[at ^ 1])
            k, base = k >> 1, base >> 1
            flat[origin + k] = least


@lru_cache(1)
def codec_of(path: str, pattern: str) -> "Codec":
    """One codec per Python worker, so that later tasks find what earlier ones have learned."""
    return Codec(path, pattern)


class Codec:
    """Encoder and decoder of whole texts for one vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}  # ids of matches
        self.spaced: dict[str, bytes] = {}  # ids of what stands between two spaces, with the space before it
        self.trees = SideBySide(self.ranks)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        run, size = [], 0
        for t in texts:
            run.append(t)
            size += len(t)
            if size >= STEP_CHARS:
                yield from self._encode(run)
                run, size = [], 0
        yield from self._encode(run)

    def _encode(self, run: list[str]) -> list[bytes]:
        """Split at single spaces first, for a space before a visible character always begins a match.

        Texts with longer gaps than two, or a gap of two at the end, go to the pattern as a whole, for there a
        match may hold several spaces.
        """
        for kept in (self.kept, self.spaced):
            if len(kept) > KEPT:
                kept.clear()
        odd = [bool(_LONG_GAP(t)) for t in run]
        parts = [[] if o else t.split(" ") for t, o in zip(run, odd)]
        new = list(set().union(*(p[1:] for p in parts)).difference(self.spaced))
        heads = [t if o else p[0] for t, p, o in zip(run, parts, odd)]
        matches = [self.split(" " + c) for c in new]
        head_matches = [self.split(h) for h in heads]
        long = self._learn(set().union(*matches, *head_matches).difference(self.kept))
        known, spaced = self.kept, self.spaced
        for c, ms in zip(new, matches):
            spaced[c] = b"".join([known[m] for m in ms])
        first = [b"".join([known[m] for m in ms]) for ms in head_matches]
        found = [f + b"".join([spaced[c] for c in p[1:]]) for f, p in zip(first, parts)]
        for m in long:
            del known[m]
        if long:
            for c in new:
                if len(c) > SHORT // 4:
                    del spaced[c]
        return found

    def _learn(self, new: set[str]) -> list[str]:
        """Encode new matches; returns the long ones, which are not to be kept for good."""
        short, long = [], []
        for m in new:
            piece = m.encode("utf-8", "replace")
            if (rank := self.ranks.get(piece)) is not None:
                self.kept[m] = rank.to_bytes(4, "little")
            elif len(piece) <= SHORT:
                short.append((m, piece))
            else:
                self.kept[m] = array("I", merge(piece, self.ranks)).tobytes()
                long.append(m)
        for (m, _), ids in zip(short, self.trees.merge([piece for _, piece in short])):
            self.kept[m] = ids
        return long

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


def with_ids(documents: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add (or replace) ``out``: the ids of the whole text as an array of numbers."""

    @F.arrow_udf("array<long>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(vocabulary, pattern)
        for texts in batches:
            ids = [array("I", i).tolist() for i in codec.encode([t or "" for t in texts.to_pylist()])]
            yield pa.array(ids, pa.list_(pa.int64()))

    return documents.withColumn(out, encoded(F.col(text)))


def with_text(documents: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add (or replace) ``out``: the bytes that an array of ids stands for (null ids: no bytes)."""

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(vocabulary, pattern)
        for rows in batches:
            yield pa.array([codec.decode(array("I", r or []).tobytes()) for r in rows.to_pylist()], pa.binary())

    return documents.withColumn(out, decoded(F.col(ids)))


DIGEST = "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>"
_DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def with_digests(documents: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "digests") -> DataFrame:
    """Encode and decode without handing the ids on: counts and hashes of the ids and of what they decode to."""

    @F.arrow_udf(DIGEST)
    def digested(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(vocabulary, pattern)
        for texts in batches:
            rows = []
            for ids in codec.encode([t or "" for t in texts.to_pylist()]):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            yield pa.array([dict(zip(_DIGEST.names, r)) for r in rows], _DIGEST)

    return documents.withColumn(out, digested(F.col(text)))


def op9_byte_bpe(spark, d: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, d, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return with_digests(documents, path, public_tokenizers.PATTERN).select("doc_id", "digests.*")


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLES: dict[str, str] = {}

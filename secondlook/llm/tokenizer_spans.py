"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

A is a byte-level vocabulary of the tokenizers library, B a sentencepiece model with byte fallback; both read a space and the text
(B adds the space itself). A's character offsets and B's spans give coarse cuts: places where in both a token ends and
the next one begins at a whole character. Between two coarse cuts, where characters of several bytes are shared by tokens or
byte-fallback tokens have empty spans, the tokens' decoded bytes give the exact ends. Places where tokens of both end cut the
text into groups; a link joins the A token and the B token that end there.

Both tokenizers cut a text before every single space or line feed between characters that aren't white space: A's pattern takes
them only as the first character of a match or within white space, no piece of B holds a space after another character, and
none a line feed (this is checked when the model is read). They also cut it between a letter and a punctuation mark at a segment's
end, unless a piece of B holds both side by side. So texts are cut into such segments, and a task aligns each distinct segment
once and keeps up to KEPT segments at hand; those of a run of texts are found all at once. A text with a segment whose bytes aren't
met is aligned as a whole.

How often an id pair is linked is counted over all documents. Pairs with more than a COMMON-th of all links are at most
COMMON, so that their counts can be broadcast (about 8 MB); all others are looked up by a join in which, by the same count, no
key has more than that share of the rows. The highest count of each B id has at most as many rows as B has pieces.

Defined cases: null and empty texts, and texts whose joined token bytes of A or B differ from a space and the text (such
as texts with U+2581, which B reads as a space), have no tokens: zeros and an empty digest. Rows that share a ``doc_id`` or have
none are aligned each on their own. Other columns are left out of the result.
"""

import hashlib
import os
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import accumulate, pairwise
from re import compile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import giving_back, table
from secondlook.llm.units import PADDING, Lists, Units
from secondlook.session import stage

COMMON = 1 << 19
#: Aligned segments that a worker keeps at hand, about 200 bytes each; with more, it begins anew.
KEPT = 600_000
STEP_CHARS = 1 << 19
#: An id pair as one number: A's id, then B's in the lower bits.
B_BITS = 32
_SPACE_MARK = "▁"


@cache
def byte_of_character() -> dict[str, int]:
    """The usual spelling of bytes in byte-level vocabularies: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def aligner_of(path_a: str, path_b: str) -> "Aligner":
    """One per Python worker, so that later tasks find what earlier ones have aligned."""
    return Aligner(path_a, path_b)


#: An aligned segment: numbers of tokens, groups as text, links, and whether both sides give its bytes.
Segment = tuple[int, int, str, tuple, bool]
MARKS = ".,;:!?"
#: Places before a single space or line feed between characters that aren't white space.
_CUT = compile(r"(?<=\S)(?=[ \n]\S)")
#: White space beyond ASCII in UTF-8, and by byte within it.
_WIDE_SPACE = compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the concurrency
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        spelled = byte_of_character()
        self.bytes_a = {
            i: bytes(spelled[c] for c in entry) if all(c in spelled for c in entry) else entry.encode()
            for entry, i in self.a.get_vocab(with_added_tokens=True).items()
        }
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE_MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.space = self.b.piece_to_id(_SPACE_MARK)
        self.by_segments = not any(_SPACE_MARK in p.lstrip(_SPACE_MARK) or "\n" in p for p in pieces)
        beside = {m: {p[i - 1] for p in pieces for i in range(1, len(p)) if p[i] == m} for m in MARKS}
        self.marks: dict[str, tuple[set, Segment]] = {}
        for m in MARKS:
            one, other = self.a.encode(m, add_special_tokens=False).ids, self.b.piece_to_id(m)
            if len(one) == 1 and self.bytes_a[one[0]] == self.bytes_b[other] == m.encode():
                self.marks[m] = beside[m], (1, 1, f"{one[0]}|{other}", (one[0] << B_BITS | other,), True)
        self.numbers = [str(i) for i in range(max(*self.bytes_a, len(pieces)) + 1)]
        self.alone = np.zeros((256, 256), bool)  # by mark and the letter before it: whether both are cut between them
        for m, (others, _) in self.marks.items() if self.by_segments else ():
            self.alone[ord(m)] = _LETTER
            self.alone[ord(m), [ord(c) for c in others if c.isascii()]] = False
        self.kept: dict[str, Segment] = {}
        self._empty()

    def _empty(self) -> None:
        self.units, self.groups, self.links = Units(), [], Lists(np.int64)
        self.sizes, self.good = Lists(np.int64), Lists(np.bool_)

    def segments(self, text: str) -> list[str]:
        """Parts of a space and the text, each beginning with a space or a line feed."""
        return _CUT.split(" " + text) if self.by_segments else [" " + text]

    def align(self, segments: set[str]) -> None:
        """Have all of these segments at hand."""
        self.kept = dict(zip(segments, self.fresh(list(segments))))

    def _cuts(self, buffer: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the segments of texts that lie from ``firsts`` to ``lasts``, marks apart."""
        starts = firsts
        if self.by_segments:
            white = _SPACE[buffer]
            for m in _WIDE_SPACE.finditer(buffer):
                white[m.start() : m.end()] = True
            cuts = np.flatnonzero((buffer == 0x20) | (buffer == 0x0A))
            cuts = cuts[(cuts > 0) & (cuts < lasts[-1])]
            cuts = cuts[~white[cuts - 1] & ~white[cuts + 1]]
            inside = np.searchsorted(firsts, cuts, "right") - 1
            starts = np.union1d(firsts, cuts[(cuts > firsts[inside]) & (cuts < lasts[inside])])
        ends = np.append(starts[1:], 0)
        ends[np.searchsorted(starts, lasts) - 1] = lasts
        apart = self.alone[buffer[ends - 1], buffer[ends - 2]] & (ends - starts > 1)
        edges = np.sort(np.concatenate([starts, (ends - 1)[apart]]))
        ends = np.append(edges[1:], 0)
        ends[np.searchsorted(edges, lasts) - 1] = lasts
        return edges, ends

    def aligned(self, texts: list[str]) -> list[tuple]:
        """(tokens of A, tokens of B, links, digest, pairs, times) of each text."""
        if self.units.n > KEPT:
            self._empty()
        coded = [b" " + t.encode() for t in texts]
        buffer = np.frombuffer(b"\n".join([*coded, bytes(PADDING)]), np.uint8)
        sizes = np.array([len(t) for t in coded])
        firsts = np.cumsum(sizes + 1) - sizes - 1
        starts, ends = self._cuts(buffer, firsts, firsts + sizes)
        numbers, new = self.units.numbers(buffer, starts, ends)
        self._learn([s.decode() for s in new])
        links, edges = self.links.joined(numbers)
        totals, good = self.sizes.joined(numbers)[0].reshape(-1, 2), self.good.joined(numbers)[0]
        at = np.append(np.searchsorted(starts, firsts), len(starts))
        totals = np.add.reduceat(totals, at[:-1], axis=0).tolist()
        good = np.logical_and.reduceat(good, at[:-1]).tolist()
        numbers, rows, edges = numbers.tolist(), [], edges[at].tolist()
        for k, (a, z) in enumerate(pairwise(at.tolist())):
            if good[k]:
                groups, own = ";".join([self.groups[i] for i in numbers[a:z]]), links[edges[k] : edges[k + 1]]
                n_a, n_b = totals[k]
            else:
                n_a, n_b, groups, own, met = next(self.fresh([" " + texts[k]]))
                if not met:
                    rows.append(_NOTHING)
                    continue
                own = np.array(own, np.int64)
            pairs, times = np.unique(own, return_counts=True)
            rows.append((n_a, n_b, len(own), hashlib.sha256(groups.encode()).hexdigest(), pairs, times.astype(np.int32)))
        return rows

    def _learn(self, segments: list[str]) -> None:
        for at in range(0, len(segments), 1024):
            some = segments[at : at + 1024]
            # A mark that stands apart isn't what begins a text: B adds no space before it.
            found = [self.marks[s][1] if s in self.marks and self.by_segments else None for s in some]
            fresh = self.fresh([s for s, own in zip(some, found) if own is None])
            found = [own or next(fresh) for own in found]
            self.groups += [f[2] for f in found]
            self.links.add([f[3] for f in found])
            self.sizes.add([f[:2] for f in found])
            self.good.add([f[4:] for f in found])

    def fresh(self, segments: list[str]) -> Iterator[Segment]:
        """Segments aligned anew. Where all characters are ASCII, a token's span is its length."""
        ours = self.a.encode_batch(segments, add_special_tokens=False)
        own = [s.removeprefix(" ") for s in segments]
        plain = [s for s in own if s.isascii()]
        ids = iter(self.b.encode(plain, num_threads=1))
        protos = iter(self.b.encode([s for s in own if not s.isascii()], return_type="proto", num_threads=1))
        for s, text, one in zip(segments, own, ours):
            shift = len(s) - len(text)
            if text.isascii():
                b_ids, spans = next(ids), None
            else:
                pieces = next(protos).pieces
                b_ids, spans = [p.id for p in pieces], [(p.begin + shift, p.end + shift) for p in pieces]
            if not shift and b_ids[0] == self.space:  # the space that B adds
                b_ids, spans = b_ids[1:], spans and spans[1:]
            yield self._segment(s, one.ids, one.offsets, b_ids, spans)

    def _segment(self, text: str, a_ids: list[int], offsets: list[tuple], b_ids: list[int], spans: list[tuple] | None) -> Segment:
        bytes_a, bytes_b = [self.bytes_a[i] for i in a_ids], [self.bytes_b[i] for i in b_ids]
        whole = text.encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return 0, 0, "", (), False
        if spans is None:  # no character is shared by tokens, so all ends are cuts as they are
            ends_b = {z: k for k, z in enumerate(accumulate(map(len, bytes_b)), 1)}
            cuts = [(k, ends_b[x[1]]) for k, x in enumerate(offsets, 1) if x[1] in ends_b]
        else:
            cuts = _refined(_coarse(text, offsets, spans), bytes_a, bytes_b)
        a_texts, b_texts = [self.numbers[i] for i in a_ids], [self.numbers[i] for i in b_ids]
        parts, links, i, j = [], [], 0, 0
        for at_a, at_b in cuts:
            parts.append(",".join(a_texts[i:at_a]) + "|" + ",".join(b_texts[j:at_b]))
            links.append(a_ids[at_a - 1] << B_BITS | b_ids[at_b - 1])
            i, j = at_a, at_b
        return len(a_ids), len(b_ids), ";".join(parts), tuple(links), True


def _coarse(text: str, offsets: list[tuple], spans: list[tuple]) -> list[tuple[int, int]]:
    """(tokens of A, tokens of B) before each place where on both sides one token ends and the next begins at a character.

    ``offsets`` are characters, ``spans`` bytes of the text.
    """
    place = [0, *accumulate(len(c.encode()) for c in text)]
    ends_a = {place[x[1]]: k for k, (x, y) in enumerate(pairwise(offsets), 1) if x[1] == y[0] and x[0] < x[1] and y[0] < y[1]}
    ends_b = {x[1]: k for k, (x, y) in enumerate(pairwise(spans), 1) if x[1] == y[0] and x[0] < x[1] and y[0] < y[1]}
    both = sorted(ends_a.keys() & ends_b.keys())
    return [(ends_a[x], ends_b[x]) for x in both] + [(len(offsets), len(spans))]


def _refined(coarse: list[tuple[int, int]], bytes_a: list[bytes], bytes_b: list[bytes]) -> list[tuple[int, int]]:
    """All places where tokens of both sides end, by the tokens' bytes between two coarse cuts."""
    cuts, i, j = [], 0, 0
    for end_a, end_b in coarse:
        size_a = size_b = 0
        while i < end_a or j < end_b:
            if j == end_b or (i < end_a and size_a <= size_b):
                size_a += len(bytes_a[i])
                i += 1
            else:
                size_b += len(bytes_b[j])
                j += 1
            if size_a == size_b:
                cuts.append((i, j))
    return cuts


COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
    ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
])
_NOTHING = (0, 0, 0, "", [], [])


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    aligner = aligner_of(path_a, path_b)
    for batch in batches:
        held, size = [], 0
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            held.append((key, text))
            size += len(text or "")
            if size >= STEP_CHARS:
                yield _rows(held, aligner)
                held, size = [], 0
        yield _rows(held, aligner)


def _rows(held: list[tuple], aligner: Aligner) -> pa.RecordBatch:
    texts = [t for _, t in held if t]
    found = iter(aligner.aligned(texts) if texts else [])
    rows = [(key, *(next(found) if t else _NOTHING)) for key, t in held]
    columns = list(zip(*rows)) or [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def alignments(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document: token and group numbers, the digest of its groups, and its linked id pairs with their times."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(lambda b: giving_back(_aligned(b, path_a, path_b)), COLUMNS)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold an id pair, and whether no pair of its B id is linked more often."""
    each = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = stage(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # at most as many rows as B has pieces
    return counts.withColumn("b", b_id).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(documents: DataFrame, path_a: str, path_b: str, common: int = COMMON) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row."""
    rows = alignments(documents, path_a, path_b).withColumn("row", F.monotonically_increasing_id())
    found = stage(rows, "alignments")
    counts = stage(pair_counts(found), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") > F.lit(total // common)
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    each = each.select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    looked = each.join(F.broadcast(counts.filter(frequent)), "pair", "left")
    rare = looked.filter("n IS NULL").select("row", "pair", "times").join(counts.filter(~frequent), "pair")
    sums = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    parts = looked.filter("n IS NOT NULL").groupBy("row").agg(*sums).unionAll(rare.groupBy("row").agg(*sums))
    totals = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.drop("pairs", "times").join(totals, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),  # one link ends each group
        F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )


def op12_tokenizer_spans(spark, d: str) -> DataFrame:
    import public_tokenizers

    path_a, path_b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align(table(spark, d, "documents"), path_a, path_b)


QUERIES = {"op12_tokenizer_spans": op12_tokenizer_spans}
ORACLES: dict[str, str] = {}  # SQL has no tokenizers

"""SimHash near-dedup by pivot distance tables.

A text's fingerprint has 64 bits: a bit is 1 if it is set in more than half of the hashes of the text's word shingles. The
fingerprints that differ go into tables of their Hamming distances to fixed reference fingerprints (pivots). Two fingerprints
that differ in at most LIMIT bits have distances to every pivot that differ by at most LIMIT, so a pair with a greater
difference in any coordinate of its tables is discarded, and only survivors are verified bit by bit.

The same tables deal the work out. Besides a base reference there are references which differ from it inside one of eight
ranges of bits only, so that their distance less the base's depends on this range alone. Two ranges form one of four blocks.
Two fingerprints within LIMIT bits differ in at most two blocks, so their table entries are equal in two whole blocks; each
fingerprint is put into six cells, one for every two blocks, by its entries there, and every pair within LIMIT meets in one.
A cell of more than CELL_ROWS is dealt out once more in the same way, by two of the four ranges of its other blocks. What is
still larger (a crowd of fingerprints near one another) is cut into runs, and all runs are compared with one another,
block by block, in tasks of their own. Nothing is left out: the links found are exactly those within LIMIT, and a
fingerprint has 6 rows, in crowds 36, however many there are. A block yields for each fingerprint at most one link, to the smallest
one of its component there, which keeps all components and bounds the links by the rows.

Defined cases: null and empty texts, or texts without words, have fingerprint zero and are linked like any other; fewer words
than a shingle are one shingle. Rows without an id link with nothing and have no component; rows that share an id are
linked only by their texts. Other columns are left out of the result.
"""

from collections.abc import Iterator
from itertools import combinations
from re import compile as pattern

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import as_bytes, table
from secondlook.llm.components import components, unite
from secondlook.operators.skew import spread_lookup
from secondlook.session import stage

SHINGLE_WORDS = 3
SEED = 42
BITS, LIMIT = 64, 2
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20

CELL_ROWS = 4096
#: Ranges of bits, two to a block, and the references of each range.
RANGES, RANGE_BITS, RANGE_PIVOTS = 8, 8, 6
#: Deals the fingerprints of a cell into runs.
RUN_SEED = 77
#: Pivots of the tables in which a block discards its pairs, and the rows that are compared at once with all others.
TABLE_PIVOTS, TILE = 12, 128


def pivots(seed: int, n: int) -> list[int]:
    """Reference fingerprints, as signed 64-bit values."""
    return np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, n, dtype=np.int64).tolist()


# Fingerprints

_SPACE = pattern(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of a text, piece by piece."""
    carry: list[bytes] = []
    at, met = 0, False
    while at < len(text):
        gap = _SPACE.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        words = carry + text[at:end].lower().split()
        at = end
        if len(words) >= size:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = [0, *(ends[:-size] + 1).tolist()]
            digest = xxhash.xxh64_intdigest
            hashes = [digest(line[a:z], SEED) for a, z in zip(starts, ends[size - 1 :].tolist())]
            yield np.array(hashes, np.uint64)
            met, carry = True, words[len(words) - size + 1 :]
        else:
            carry = words
    if carry and not met:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: bytes) -> int:
    """The text's fingerprint as a signed 64-bit value."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text):
        total += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for t in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "bits"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, bits) for every row."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_fingerprints, "doc_id long, bits long")


# Cells


def range_pivots() -> tuple[int, list[list[int]]]:
    """The base reference, and for each range the references that differ from it in some bits of this range."""
    draw = np.random.default_rng(1)
    base = int(draw.integers(-(2**63), 2**63 - 1))
    masks = [[sum(1 << int(b) for b in draw.choice(RANGE_BITS, RANGE_BITS // 2, replace=False)) for _ in range(RANGE_PIVOTS)] for _ in range(RANGES)]
    signed = [[int(np.uint64(m << RANGE_BITS * r).astype(np.int64)) for m in own] for r, own in enumerate(masks)]
    return base, [[base ^ m for m in own] for own in signed]


def _distance(pivot: int) -> Column:
    return F.bit_count(F.col("bits").bitwiseXOR(F.lit(pivot)))


def with_entries(bits: DataFrame) -> DataFrame:
    """Add ``entries``: for each range a hash of its distances less the base's."""
    base, own = range_pivots()
    return bits.withColumn("entries", F.array(*[F.xxhash64(*[_distance(p) - _distance(base) for p in ps]) for ps in own]))


#: The choices of two blocks, and for each the ranges of its blocks and of the others.
BLOCK_PAIRS = list(combinations(range(RANGES // 2), 2))


def _ranges(blocks) -> list[int]:
    return [r for b in blocks for r in (2 * b, 2 * b + 1)]


def _cells_of(pair: tuple[int, int]) -> Column:
    return F.xxhash64(F.lit(str(pair)), *[F.col("entries")[r] for r in _ranges(pair)])


def _inner_cells(pair: tuple[int, int]) -> Column:
    others = _ranges(b for b in range(RANGES // 2) if b not in pair)
    return F.array(*[F.xxhash64(F.col("cell"), F.lit(str(two)), *[F.col("entries")[r] for r in two]) for two in combinations(others, 2)])


def cells(bits: DataFrame, cell_rows: int) -> DataFrame:
    """(block, bits): fingerprints that meet, in blocks of about ``cell_rows`` at most, for ``bits`` without repeats."""
    tables = stage(with_entries(bits.select("bits")), "tables")
    rows = tables.select("*", F.posexplode(F.array(*[_cells_of(p) for p in BLOCK_PAIRS])).alias("pair", "cell"))
    done, deeper = _parted(rows, cell_rows)
    if deeper is None:
        return done
    inner = F.array(*[_inner_cells(p) for p in BLOCK_PAIRS])
    again = deeper.select("bits", F.explode(F.get(inner, F.col("pair"))).alias("cell"))
    more, crowds = _parted(again, cell_rows)
    done = done.unionAll(more)
    return done if crowds is None else done.unionAll(_runs(crowds, cell_rows))


def _parted(rows: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(block, bits) of the cells up to ``cell_rows``, and the rows of larger ones with their number ``n``, if there are any."""
    large = stage(rows.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows), "large")
    if large.isEmpty():
        return rows.select(F.col("cell").alias("block"), "bits"), None
    small = rows.join(large, "cell", "left_anti").select(F.col("cell").alias("block"), "bits")
    return small, rows.join(large, "cell")


def _runs(large: DataFrame, cell_rows: int) -> DataFrame:
    """All pairs of runs of a cell: a fingerprint comes once for every run that its own one is compared with."""
    n_runs = F.ceil(2 * F.col("n") / F.lit(cell_rows)).cast("int")
    own = F.pmod(F.xxhash64("bits", F.lit(RUN_SEED)), n_runs).cast("int")
    dealt = large.select("cell", "bits", own.alias("run"), F.explode(F.sequence(F.lit(0), n_runs - 1)).alias("other"))
    block = F.xxhash64("cell", F.least("run", "other"), F.greatest("run", "other"))
    return dealt.select(block.alias("block"), "bits")


# Comparison of a block


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which they differ; numpy counts the bits of signed values without their sign."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def block_links(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint of its component in the block) for all that aren't smallest themselves."""
    bits = np.unique(bits)
    refs = np.array(pivots(0, TABLE_PIVOTS), np.int64)
    near = differing(bits[:, None], refs).astype(np.int8)
    order = np.argsort(near[:, 0], kind="stable")  # pairs lie close together in the first coordinate
    bits, near = bits[order], np.ascontiguousarray(near[order].T)
    label = np.arange(len(bits))
    for a in range(0, len(bits), TILE):
        z = min(a + TILE, len(bits))
        end = int(np.searchsorted(near[0], near[0][z - 1] + LIMIT, side="right"))
        left = np.ones((z - a, end - a), bool)
        for own in near[:4]:
            left &= np.abs(own[a:z, None] - own[None, a:end]) <= LIMIT
        i, j = np.nonzero(np.triu(left, 1))
        for own in near[4:]:
            keep = np.abs(own[a + i] - own[a + j]) <= LIMIT
            i, j = i[keep], j[keep]
        i, j = i + a, j + a
        linked = differing(bits[i], bits[j]) <= LIMIT
        unite(label, i[linked], j[linked])
    smallest = np.full(len(bits), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, bits)
    root = smallest[label]
    other = root != bits
    return bits[other], root[other]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for members in batch.column("members"):
            a, b = block_links(members.values.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(bits: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): links that join all fingerprints within LIMIT bits of each other, directly or by way of others."""
    blocks = cells(bits, cell_rows).groupBy("block").agg(F.collect_list("bits").alias("members"))  # bounded by cell_rows
    pairs = blocks.filter(F.size("members") > 1).select("members").mapInArrow(_linked, "a long, b long")
    return pairs.distinct()


def near_duplicates(documents: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for every row."""
    drawn = stage(fingerprints(documents), "fingerprints")
    known = drawn.filter("doc_id IS NOT NULL").groupBy("bits")
    classes = stage(known.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows")), "classes")
    labels = components(links(classes.select("bits"), cell_rows)).withColumnRenamed("node", "bits")
    named = classes.select("bits", "first_id").join(labels, "bits", "left")
    named = stage(named.select("bits", "first_id", F.coalesce("label", "bits").alias("label")), "labels")
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_rows"))
    smallest = stage(smallest, "smallest")
    found = spread_lookup(
        named.select("bits", "label"), smallest.drop("n_rows"), "label", "bits", sizes=smallest.select("label", "n_rows")
    )
    rows = spread_lookup(
        drawn, found.select("bits", "component_id"), "bits", "doc_id", sizes=classes.select("bits", "n_rows")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return rows.select(
        "doc_id",
        F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def op13_pivot_tables(spark, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "documents"))


QUERIES = {"op13_pivot_tables": op13_pivot_tables}
ORACLES: dict[str, str] = {}  # DuckDB has no XXH64

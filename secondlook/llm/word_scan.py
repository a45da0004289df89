"""Ranked lexical search: one Aho-Corasick scan of the documents for the terms of all items at once.

The terms of the items form an automaton whose patterns carry a guard byte on both sides. In the scanned text every separator is
that guard, so a pattern is met exactly where its term stands as a whole word. The automaton is broadcast; its outputs are
term numbers, and a term maps to the items that hold it. Documents are scanned twice and never indexed: the first scan counts,
per task, in how many documents each term occurs, and the number and length of all documents; the second one counts each
document's terms again, scores all items at once and keeps, per task, the best documents of each item. Only these travel.

Items are dealt into blocks by a hash, so that a block has about BLOCK_TERMS terms and BLOCK_ITEMS items, whatever the size of the
item table; a block is a broadcast, a scan for counts and a scan for scores. One item's own terms always stay together.

Defined cases: null and empty texts have no terms and are not counted; an item without terms, or whose terms no document holds,
has no rows; items that share an id are one item with the terms of all of them; items without an id are left out. Rows that
share a ``doc_id`` are documents of their own; a document without an id counts and ranks behind equal scores with one.
Other columns are left out of the result.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from math import floor, log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secondlook.llm.common import as_bytes, steps, table

#: A term is a maximal run of characters outside this class, with A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_ITEMS, BLOCK_TERMS = 1024, 1 << 18
#: Bytes that the automaton walks through at once, and documents that are scored at once.
PIECE, DOCUMENTS = 1 << 20, 512
#: Rows of candidates that a task holds per item and rank before it cuts them to the best.
SLACK = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GUARD = 0
#: Separators become the guard, A-Z small letters; all bytes of characters beyond ASCII belong to terms.
_FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else _GUARD for c in range(256)
)


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0)))


@dataclass
class Block:
    """The items of one block: an automaton over their terms, and the items of each term (one after the other)."""

    automaton: ahocorasick.Automaton
    n_terms: int
    item_ids: np.ndarray
    first: np.ndarray  # of each term in ``items``; one more entry at the end
    items: np.ndarray


def block_of(rows: list[tuple[int, list[str]]]) -> Block:
    """``rows``: the items' ids with their distinct terms."""
    terms = sorted({t for _, own in rows for t in own})
    number = {t: i for i, t in enumerate(terms)}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for t, i in number.items():
        automaton.add_word(_characters(bytes([_GUARD]) + t.encode() + bytes([_GUARD])), i)
    if terms:
        automaton.make_automaton()
    pairs = np.array(sorted((number[t], i) for i, (_, own) in enumerate(rows) for t in own), np.int64).reshape(-1, 2)
    first = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
    return Block(automaton, len(terms), np.array([i for i, _ in rows], np.int64), first, pairs[:, 1])


def _characters(data: bytes):
    """What the automaton reads: one character per byte, whichever way the library was built."""
    return data.decode("latin-1") if ahocorasick.unicode else data


def counted(run: list[bytes], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each document in terms, codes, tf): a code is document * n_terms + term; codes rise."""
    guard = bytes([_GUARD])
    buffer = (guard + guard.join(run) + guard).translate(_FOLDED)
    firsts = np.cumsum([1, *(len(t) + 1 for t in run)])
    inside = np.frombuffer(buffer, np.uint8) != _GUARD
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    lengths = np.diff(np.searchsorted(begins, firsts))
    codes, counts, at = [], [], 0
    while block.n_terms and at < len(buffer) - 1:
        end = buffer.find(guard, min(at + PIECE, len(buffer) - 1)) + 1  # a guard closes a piece and opens the next one
        found = block.automaton.iter(_characters(buffer[at:end]))
        ends, terms = np.fromiter(chain.from_iterable(found), np.int64).reshape(-1, 2).T
        owner = np.searchsorted(firsts, ends + (at - 1), side="right") - 1
        code, n = np.unique(owner * block.n_terms + terms, return_counts=True)
        codes.append(code)
        counts.append(n)
        at = end - 1
    if len(codes) > 1:  # a document may go on in the next piece
        code, back = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.zeros(len(code), np.int64)
        np.add.at(n, back, np.concatenate(counts))
        return lengths, code, n
    none = np.zeros(0, np.int64)
    return (lengths, codes[0], counts[0]) if codes else (lengths, none, none)


def _statistics(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(term, n): documents that hold the term; term -1: documents with a term, -2: the length of all."""
    block = shared.value
    holding, documents, total = np.zeros(block.n_terms, np.int64), 0, 0
    for batch in batches:
        for run in steps(as_bytes(batch.column("text"))):
            lengths, codes, _ = counted(run, block)
            documents += int((lengths > 0).sum())
            total += int(lengths.sum())
            if len(codes):
                holding += np.bincount(codes % block.n_terms, minlength=block.n_terms)
    at = np.flatnonzero(holding)
    yield pa.RecordBatch.from_arrays(
        [pa.array([*at.tolist(), -1, -2], pa.int64()), pa.array([*holding[at].tolist(), documents, total], pa.int64())],
        ["term", "n"],
    )


@dataclass(frozen=True)
class Weights:
    documents: int
    total: int
    terms: np.ndarray  # w of each term of the block


def weights_of(counts: dict[int, int], n_terms: int) -> Weights:
    n = counts.get(-1, 0)
    terms = [floor(1000 * log((2 * n + 2) / (2 * counts.get(t, 0) + 1))) for t in range(n_terms)]
    return Weights(n, counts.get(-2, 0), np.array(terms, np.int64))


def item_scores(lengths, codes, tf, block: Block, weights: Weights) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first document, scores of (documents, items)) for runs of documents."""
    norm = np.array([10 + 90 * n * weights.documents // weights.total if n else 10 for n in lengths.tolist()], np.int64)
    owner, term = codes // max(block.n_terms, 1), codes % max(block.n_terms, 1)
    part = weights.terms[term] * (1_000_000_000 * tf // (1000 * tf + 8 * norm[owner]))
    n_items = len(block.item_ids)
    for a in range(0, len(lengths), DOCUMENTS):
        lo, hi = np.searchsorted(owner, [a, a + DOCUMENTS])
        if lo == hi:
            continue
        times = block.first[term[lo:hi] + 1] - block.first[term[lo:hi]]
        shift = np.repeat(block.first[term[lo:hi]] - np.concatenate(([0], np.cumsum(times)[:-1])), times)
        items = block.items[shift + np.arange(len(shift))]
        scores = np.zeros((min(DOCUMENTS, len(lengths) - a), n_items), np.int64)
        np.add.at(scores, (np.repeat(owner[lo:hi] - a, times), items), np.repeat(part[lo:hi], times))
        yield a, scores


class Best:
    """The k best documents of each item so far; equal scores by rising id, rows without an id last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.held = [np.zeros(0, np.int64)] * 4  # item, score, whether the id is null, id
        self.fresh: list[tuple] = []
        self.n_fresh = 0

    def offer(self, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        if len(doc):
            self.fresh.append((item, scores[doc, item], no_id[doc], ids[doc]))
            self.n_fresh += len(doc)
        if self.n_fresh > SLACK * self.k * len(self.least):
            self.settle()

    def settle(self) -> None:
        item, score, no_id, ids = (np.concatenate(c) for c in zip(self.held, *self.fresh))
        order = np.lexsort((ids, no_id, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[rank < self.k]
        self.held = [item[rank < self.k], score[keep], no_id[keep], ids[keep]]
        full = rank == self.k - 1
        self.least[item[full]] = score[order[full]]
        self.fresh, self.n_fresh = [], 0


def _scored(batches: Iterator[pa.RecordBatch], shared, weights: Weights, k: int) -> Iterator[pa.RecordBatch]:
    block = shared.value
    best = Best(len(block.item_ids), k)
    for batch in batches:
        ids = batch.column("doc_id")
        no_id, ids, at = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), 0
        for run in steps(as_bytes(batch.column("text"))):
            for a, scores in item_scores(*counted(run, block), block, weights):
                own = slice(at + a, at + a + len(scores))
                best.offer(scores, no_id[own].astype(np.int64), ids[own])
            at += len(run)
    best.settle()
    item, score, no_id, ids = best.held
    columns = pa.array(block.item_ids[item]), pa.array(ids, mask=no_id.astype(bool)), pa.array(score)
    yield pa.RecordBatch.from_arrays(list(columns), ["item_id", "doc_id", "score"])


def search(
    documents: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), terms_of(F.col("text")).alias("terms"))
    size = own.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    n_blocks = max(1, -(-size.items // block_items), -(-size.terms // block_terms))
    found = []
    for number in range(n_blocks):
        mine = own.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == number)
        united: dict[int, set] = {}
        for r in mine.toLocalIterator():
            united.setdefault(r.item_id, set()).update(r.terms or ())
        block = block_of(sorted(united.items()))
        shared = spark.sparkContext.broadcast(block)
        counts = docs.select("text").mapInArrow(lambda b, s=shared: _statistics(b, s), "term long, n long")
        totals = {r.term: r.n for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        weights = weights_of(totals, block.n_terms)
        found.append(docs.mapInArrow(_scorer(shared, weights, k), "item_id long, doc_id long, score long"))
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _scorer(shared, weights: Weights, k: int):
    return lambda batches: _scored(batches, shared, weights, k)


def op11_word_scan(spark, d: str) -> DataFrame:
    return search(table(spark, d, "documents"), table(spark, d, "benchmark"))


QUERIES = {"op11_word_scan": op11_word_scan}
ORACLES = {
    "op11_word_scan": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM lengths),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, total GROUP BY term
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // len))))::BIGINT AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), total
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
}

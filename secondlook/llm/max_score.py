"""Exact top-k search by inner product: MaxScore over sharded postings of integer vectors.

A term is a dimension with a sign; its postings are a shard's vectors with a component of that sign, by falling
size. A query has one term per dimension, the one where the product is positive, with the greatest product in
the shard as its bound. Terms of small bounds are non-essential: their bounds sum to less than a part of the k-th best
score so far, so a vector in none of the others can't win. The essential postings are traversed for a block of queries
at once, as a product of matrices over the dimensions that are essential to any of them. The others are only looked up
for vectors that can still get into the result.

Vectors are dealt out over cells, and every cell gets all queries, or a part of them that a task can hold. A task reads the
queries of a cell, then its vectors by rising id, shard by shard, and hands the k best of each query on from
shard to shard. Each cell yields its k best per query, and these are merged. No row holds more than one vector.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an
id; a repeated id counts once, with its greatest vector; shorter vectors are as if filled up with zeros; an empty
vector scores 0. Fewer than k candidates give fewer rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import giving_back, table
from secondlook.session import stage

#: Rows of a shard and of a query block, at most.
SHARD_ROWS = 4096
BLOCK_ROWS = 256
SCALE = 256
#: Cells of a small table, vectors of a cell of a large one, and components of the queries that a task holds, on average.
CELLS = 24
CELL_ROWS = 1 << 18
HELD = 1 << 24
#: Non-essential terms sum to less than the threshold divided by this: of a larger part, most vectors would have to be looked up.
PART = 16
#: Hits of a query in a shard, as a multiple of k, above which its k best scores there are found before hits are sorted.
MANY = 64
#: Components looked up at once.
STEP = 1 << 20
#: A threshold that everything reaches.
NONE = np.iinfo(np.int64).min


def to_integers(vector: Column) -> Column:
    """floor(256 * x) of every component; null if a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))))


def _sizes(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", wide, wide))


def _kind(size: float, other: float) -> type:
    """In which the inner products of vectors of at most these sizes, and all parts of them, are exact."""
    return np.float32 if size * other < 1 << 23 else np.float64 if size * other < 1 << 52 else np.int64


def _places(mask: np.ndarray) -> np.ndarray:
    """Where a mask in one piece is true; eight places are skipped at a time if none of them is."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    near = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return near[flat[near]]


class Shard:
    """Postings of one shard, as its columns."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.vectors = ids[order], vectors[order]
        columns = np.ascontiguousarray(self.vectors.T)
        # greatest size of a positive, a negative component
        self.bounds = np.stack((columns.max(axis=1, initial=0).astype(np.float64), -columns.min(axis=1, initial=0).astype(np.float64)))
        self.size = _sizes(self.vectors).max(initial=0)
        self._columns, self._rows, self._heads = {vectors.dtype.type: columns}, {vectors.dtype.type: self.vectors}, None

    def columns(self, kind: type) -> np.ndarray:
        if kind not in self._columns:
            self._columns[kind] = self._columns[self.vectors.dtype.type].astype(kind)
        return self._columns[kind]

    def rows(self, kind: type) -> np.ndarray:
        if kind not in self._rows:
            self._rows[kind] = self.vectors.astype(kind)
        return self._rows[kind]

    def heads(self, length: int) -> np.ndarray:
        """The numbers of the vectors that lead each posting list, by sign and dimension; -1 where it is shorter."""
        if self._heads is None:
            length = min(length, len(self.ids))
            self._heads = np.full((2, len(self.bounds[0]), length), -1)
            for j, column in enumerate(self._columns[self.vectors.dtype.type]):
                for sign in (0, 1):
                    size = -column.astype(np.int64) if sign else column
                    at = np.argpartition(size, len(size) - length)[len(size) - length :]
                    self._heads[sign, j] = np.where(size[at] > 0, at, -1)
        return self._heads

    def own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these ids are in the shard, and at which places."""
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        has = np.flatnonzero(self.ids[at] == ids)
        return has, at[has]

    def thresholds(self, ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score among the heads of the leading postings: no lower than which a winner can be."""
        heads, rows = self.heads(4 * k), self.rows(queries.dtype.type)
        found = np.full(len(ids), NONE)
        terms = np.argsort(-bounds, axis=1, kind="stable")[:, :8]
        width = max(1, terms.shape[1] * heads.shape[2] * queries.shape[1])
        for s in range(0, len(ids), max(1, STEP // width)):
            part = slice(s, s + max(1, STEP // width))
            query = queries[part]
            leading = np.take_along_axis((query < 0).astype(np.int64), terms[part], axis=1)
            some = np.sort(heads[leading, terms[part]].reshape(len(query), -1), axis=1)
            if some.shape[1] < k:
                continue
            scores = np.einsum("itj,ij->it", rows[some], query)
            out = (some < 0) | (self.ids[some] == ids[part, None])
            out[:, 1:] |= some[:, 1:] == some[:, :-1]
            enough = (~out).sum(axis=1) >= k
            scores[out] = NONE
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            found[part] = np.where(enough, least.astype(np.int64), NONE)
        return found


class Queries:
    """Queries with the k best vectors so far. Shards come by rising ids, so that later vectors win by a better score only."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, block_rows: int):
        self.ids, self.vectors, self.k, self.block_rows = ids, vectors, k, block_rows
        self.sizes = [_sizes(vectors[s : s + block_rows]).max(initial=0) for s in range(0, len(ids), block_rows)]
        self.held = np.zeros(len(ids), np.int64)
        self.best_ids, self.scores = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self._arrays: dict[type, np.ndarray] = {}

    def _array(self, kind: type, rows: int, columns: int) -> np.ndarray:
        """The same array for all blocks, since fetching so much memory anew takes longer than their products."""
        if kind not in self._arrays or self._arrays[kind].size < rows * columns:
            self._arrays[kind] = np.empty(rows * columns, kind)
        return self._arrays[kind][: rows * columns].reshape(rows, columns)

    def meet(self, shard: Shard) -> None:
        for b, size in enumerate(self.sizes):
            start = b * self.block_rows
            block = slice(start, start + self.block_rows)
            self._take(start, shard, *self._search(block, shard, _kind(size, shard.size)))

    def _search(self, block: slice, shard: Shard, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score): what may get into the results, by numbers in the block and in the shard."""
        ids, k, n = self.ids[block], self.k, len(shard.ids)
        query, columns = self.vectors[block].astype(kind), shard.columns(kind)
        bounds = np.abs(query.astype(np.float64)) * np.where(query < 0, shard.bounds[1], shard.bounds[0])
        least = np.where(self.held[block] == k, self.scores[block, k - 1] + 1, NONE)
        new = np.flatnonzero(least == NONE)
        if len(new):
            least[new] = shard.thresholds(ids[new], query[new], bounds[new], k)
        if kind is np.int64:  # bounds are not exact
            left, limit = np.zeros(query.shape, bool), least.copy()
        else:
            above = np.where(least == NONE, -np.inf, least)
            rising = np.sort(bounds, axis=1)
            n_left = (np.cumsum(rising, axis=1) * PART < above[:, None]).sum(axis=1)
            first = np.append(rising, np.full((len(ids), 1), np.inf), axis=1)[np.arange(len(ids)), n_left]
            left = bounds < first[:, None]
            limit = (above - np.where(left, bounds, 0).sum(axis=1)).astype(kind)
        essential = np.where(left, 0, query)
        used = essential.any(axis=0) & shard.bounds.any(axis=0)
        if not used.all():
            essential, terms = essential[:, used], columns[used]
        else:
            terms = columns
        partial = np.matmul(essential, terms, out=self._array(kind, len(ids), n))
        reach = np.greater_equal(partial, limit[:, None], out=self._array(np.bool_, len(ids), n))
        at_query, at = np.divmod(_places(reach), n)
        many = np.bincount(at_query, minlength=len(ids)) > MANY * k
        if many.any():  # one more traversal, of all their terms; of equal scores, only the first k by id may win
            crowded = np.flatnonzero(many)
            partial[crowded] = query[crowded] @ columns
            left[crowded] = False
            has, place = shard.own(ids[crowded])
            partial[crowded[has], place] = NONE
            scores, within = partial[crowded], True
            if n > k:
                best = np.partition(scores, n - k, axis=1)[:, n - k, None]
                tied = scores == best
                within = (scores > best) | tied & (np.cumsum(tied, axis=1) <= k)
            reach[crowded] = within & (scores >= least[crowded, None])
            at_query, at = np.divmod(_places(reach), n)
        others = shard.ids[at] != ids[at_query]
        at_query, at = at_query[others], at[others]
        scores = partial[at_query, at]
        if left.any():
            rest = np.where(left, query, 0)
            step = max(1, STEP // max(1, rest.shape[1]))
            for s in range(0, len(at), step):
                part = slice(s, s + step)
                scores[part] += np.einsum("ij,ij->i", shard.vectors[at[part]].astype(kind), rest[at_query[part]])
        scores = scores.astype(np.int64)
        still = scores >= least[at_query]
        return at_query[still], at[still], scores[still]

    def _take(self, start: int, shard: Shard, at_query: np.ndarray, at: np.ndarray, scores: np.ndarray) -> None:
        rows = np.unique(at_query) + start
        if not len(rows):
            return
        before = np.arange(self.k) < self.held[rows, None]
        query = np.concatenate((np.repeat(rows, self.held[rows]), at_query + start))
        ids = np.concatenate((self.best_ids[rows][before], shard.ids[at]))
        scores = np.concatenate((self.scores[rows][before], scores))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        best = rank < self.k
        self.best_ids[query[best], rank[best]], self.scores[query[best], rank[best]] = ids[best], scores[best]
        np.maximum.at(self.held, query[best], rank[best] + 1)

    def results(self) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(self.ids), SHARD_ROWS):
            part = slice(s, s + SHARD_ROWS)
            there = np.arange(self.k) < self.held[part, None]
            columns = [np.repeat(self.ids[part], self.held[part]), self.best_ids[part][there], self.scores[part][there]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """One row per vector, cut or filled up with zeros to so many components."""
    values, lengths = vectors.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if lengths.max(initial=0) > width:
        values = values[np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < width]
        lengths = np.minimum(lengths, width)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    matrix = np.zeros((len(lengths), width), values.dtype)
    matrix[np.arange(width) < lengths[:, None]] = values
    return matrix


def _runs(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[tuple]:
    """(cell, whether vectors to search, ids, matrix): runs of at most so many rows of one cell and side."""
    for batch in batches:
        cells, searched = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "searched"))
        turns = np.flatnonzero((np.diff(cells) != 0) | (np.diff(searched) != 0)) + 1
        for start, end in zip((0, *turns), (*turns, batch.num_rows)):
            for s in range(start, end, most):
                run = batch.slice(s, min(end - s, most))
                yield int(cells[s]), bool(searched[s]), run.column("id").to_numpy(), _matrix(run.column("vector"), width)


def _shards(runs: list[tuple[np.ndarray, np.ndarray]], most: int, all_of_them: bool) -> Iterator[Shard]:
    """Full shards from the front of the runs, which keep what is left; if all of them, a smaller last one too."""
    while runs and (all_of_them or sum(len(i) for i, _ in runs) >= most):
        ids, vectors = (np.concatenate(x) for x in zip(*runs))
        runs[:] = [(ids[most:], vectors[most:])] if len(ids) > most else []
        yield Shard(ids[:most], vectors[:most])


def _searched(batches: Iterator[pa.RecordBatch], k: int, width: int, shard_rows: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows come by cell; in a cell queries come first, then vectors by rising id."""
    cell, asked, queries, runs = None, [], None, []

    def ended() -> Iterator[pa.RecordBatch]:
        if queries:
            for shard in _shards(runs, shard_rows, True):
                queries.meet(shard)
            yield from queries.results()

    for at, searched, ids, vectors in _runs(batches, width, shard_rows):
        if at != cell:
            yield from ended()
            cell, asked, queries, runs = at, [], None, []
        if not searched:
            asked.append((ids, vectors))
        elif asked or queries:
            if asked:
                queries, asked = Queries(*(np.concatenate(x) for x in zip(*asked)), k, block_rows), []
            runs.append((ids, vectors))
            for shard in _shards(runs, shard_rows, False):
                queries.meet(shard)
    yield from ended()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows=SHARD_ROWS, block_rows=BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors for every query but the one with its own id.

    Both inputs have (id long, vector array<long>), ids distinct; they are read twice. Every vector travels once per part
    of the queries, every query once per cell of vectors, in the narrowest integers that hold all components. A task holds the
    queries of one cell, one shard and the scores of one block.
    """
    size = [F.count("*"), F.max(F.size("vector")), F.min(F.array_min("vector")), F.max(F.array_max("vector"))]
    (n, *of_vectors), (n_queries, *of_queries) = vectors.agg(*size).first(), queries.agg(*size).first()
    # What is longer than all queries or all vectors meets nothing but zeros there.
    width, least, most = (f(x or 0, y or 0) for f, x, y in zip((min, min, max), of_vectors, of_queries))
    n_cells = max(1, min(n, max(CELLS, -(-n // CELL_ROWS))))
    n_parts = max(1, -(-n_queries * max(1, width) // HELD))
    kind = next((t for t, bits in (("smallint", 15), ("int", 31)) if -(1 << bits) < least and most < 1 << bits), "bigint")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda x, cell, part, searched: x.withColumns({"_cell": cell, "_part": part}).select(
        (F.col("_cell") * n_parts + F.col("_part")).cast("int").alias("cell"),
        F.lit(searched).alias("searched"),
        "id",
        F.col("vector").cast(f"array<{kind}>").alias("vector"),
    )
    asked = dealt(queries.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_parts))), numbers(n_cells), F.col("part"), 0)
    there = dealt(vectors.withColumn("in", F.pmod(F.xxhash64("id"), F.lit(n_cells))), F.col("in"), numbers(n_parts), 1)
    cells = asked.unionAll(there).repartitionById(n_cells * n_parts, "cell").sortWithinPartitions("cell", "searched", "id")
    found = cells.mapInArrow(
        lambda batches: giving_back(_searched(batches, k, width, shard_rows, block_rows)), "query_id long, vec_id long, score long"
    )
    # Each cell gave at most k rows per query.
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k)
    merged = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "hit"))
    return merged.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score")
    )


def integer_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector) of the usable rows, one per id."""
    usable = embeddings.select(F.col(key).alias("id"), to_integers(F.col(vector)).alias("vector")).dropna()
    return usable.groupBy("id").agg(F.max("vector").alias("vector"))


def op1_max_score(spark, d: str) -> DataFrame:
    vectors = stage(integer_vectors(table(spark, d, "embeddings")), "vectors")
    return top_k(vectors, vectors.filter(F.col("id") % 50 == 0))


QUERIES = {"op1_max_score": op1_max_score}
ORACLES = {
    "op1_max_score": """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
}

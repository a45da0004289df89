"""LM scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

The model predicts a symbol from the two before it: the context's vectors, each through its position's matrix, add up
to a predicted vector, whose product with a symbol's vector plus its bias is that symbol's score. Symbols are the most
frequent training tokens and, for all others, classes by their last two bytes; within a class a token has its share
of smoothed counts. A text's log-probability is normalised: matrix products over all contexts and symbols give the
tables of scores and of the logarithm of their sums.

Counts cover all training documents: c per token, N, V and the mass of each class. Training uses every
position of all training documents; tasks, whose number grows with the input, learn in parallel from the same
start, each from the texts that it reads, and their parameters are averaged, in ROUNDS rounds.

Tokens above 1/COMMON of all are at most COMMON (8 MB), so their counts are broadcast; the others are looked up by a join, and
none of them has more than that share of the rows.

Defined cases: a null text is an empty one and consists of the end token alone; rows with repeated or null ids are
scored each on its own; without training documents N and V are 0 and every token is unknown. Other columns are left out
of the result.
"""

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import as_bytes, fold, mixed, steps, table, words
from secondlook.session import stage

SYMBOLS, CLASSES = 832, 192
TOTAL = SYMBOLS + CLASSES + 1  # and the end token, which also stands before a text
END = TOTAL - 1
COMMON = 1 << 19
DIMENSIONS = 32
ROUNDS, NOISE, BATCH = 2, 16, 512
RATE = 0.3
#: Batches whose sums are planned at once.
PLANNED = 64
#: Layers of a batch; what occurs more often is summed up number by number.
LAYERS = 8
#: Distinct tokens that a task counts before it hands them on.
HELD_TOKENS = 1 << 20
END_TOKEN = int(mixed(np.array([0xE0F], np.uint64)).astype(np.int64)[0])
ADD = 0.1


@dataclass
class Tokens:
    """The tokens of a run of texts, each text's end token included."""

    hashes: np.ndarray  # int64
    classes: np.ndarray
    first: np.ndarray  # number of each text's first token, one more at the end
    end: np.ndarray  # whether a token is an end


def tokens(run: list[bytes]) -> Tokens:
    own, first, buffer, starts, ends = words(run)
    n = len(run)
    places = np.arange(len(own)) + np.repeat(np.arange(n), np.diff(first))
    total = len(own) + n
    hashes, classes, end = np.full(total, END_TOKEN), np.full(total, END), np.ones(total, bool)
    hashes[places] = own.view(np.int64)
    last, before = buffer[ends - 1].astype(np.uint64), buffer[np.maximum(ends - 2, 0)].astype(np.uint64)
    before[ends - starts < 2] = 0
    upper = (before >= 65) & (before <= 90), (last >= 65) & (last <= 90)
    before[upper[0]] += np.uint64(32)
    last[upper[1]] += np.uint64(32)
    classes[places] = SYMBOLS + (mixed(last << np.uint64(8) | before) % np.uint64(CLASSES)).astype(np.int64)
    end[places] = False
    return Tokens(hashes, classes, first + np.arange(n + 1), end)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, class, n) of a task's documents, summed up; handed on whenever too many are held."""
    held: list[tuple] = []
    n_held = 0

    def summed() -> pa.RecordBatch:
        hashes, classes, counts = (np.concatenate(c) for c in zip(*held))
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        sums = np.bincount(inverse, counts).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(classes[at]), pa.array(sums)], ["token", "class", "n"])

    for batch in batches:
        for run in steps(as_bytes(batch.column("text"))):
            found = tokens(run)
            distinct, at, counts = np.unique(found.hashes, return_index=True, return_counts=True)
            held.append((distinct, found.classes[at], counts))
            n_held += len(distinct)
            if n_held > 2 * HELD_TOKENS:
                part = summed()
                held, n_held = [tuple(np.asarray(part.column(i)) for i in range(3))], part.num_rows
                if n_held > HELD_TOKENS:
                    yield part
                    held, n_held = [], 0
    if held:
        yield summed()


def token_counts(documents: DataFrame) -> DataFrame:
    """(token, class, n) over all documents given."""
    partial = documents.select("text").mapInArrow(_counted, "token long, class long, n long")
    return partial.groupBy("token").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """What every task needs to know: totals, common tokens with their counts, and symbols."""

    total: int
    distinct: int
    common: np.ndarray  # sorted tokens
    common_counts: np.ndarray
    symbols: np.ndarray  # symbol of each common token, -1 for those that only have their class
    symbol_counts: np.ndarray  # of all TOTAL symbols
    class_mass: np.ndarray  # smoothed mass of each class's tokens, with one unseen token

    @property
    def base_mass(self) -> float:
        return self.total + ADD * (self.distinct + 1)

    def of_symbols(self) -> "Vocabulary":
        """The same with no common tokens but the symbols."""
        own = self.symbols >= 0
        return replace(self, common=self.common[own], common_counts=self.common_counts[own], symbols=self.symbols[own])

    @cached_property
    def buckets(self) -> tuple[int, np.ndarray, int, np.ndarray]:
        """By their first bits: how many bits, where each bucket's common tokens begin, how many one has at most; and the tokens."""
        bits = min(20, (4 * len(self.common)).bit_length())
        sizes = np.bincount(_bucket(self.common, bits), minlength=1 << bits)
        begins = (np.cumsum(sizes) - sizes).astype(np.int32)
        return bits, begins, int(sizes.max()), np.append(self.common, np.iinfo(np.int64).max)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> (64 - bits)) + (1 << bits - 1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums.n or 0), int(sums.v)
    common = counts.filter(F.col("n") * F.lit(COMMON) >= F.lit(total)).toPandas().sort_values("token")
    ranked = common[common["token"] != END_TOKEN].sort_values(["n", "token"], ascending=[False, True]).head(SYMBOLS)
    place = {t: i for i, t in enumerate(ranked["token"])} | {END_TOKEN: END}
    symbols = np.array([place.get(t, -1) for t in common["token"]], np.int64)
    by_class = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    numbers, seen = np.zeros(TOTAL), np.zeros(TOTAL)
    numbers[by_class["class"]], seen[by_class["class"]] = by_class["n"], by_class["v"]
    own = ranked["class"].to_numpy(np.int64)
    numbers -= np.bincount(own, ranked["n"].to_numpy(float), TOTAL)
    seen -= np.bincount(own, minlength=TOTAL)
    symbol_counts = numbers.copy()
    symbol_counts[: len(ranked)] = ranked["n"]
    return Vocabulary(
        total, distinct, common["token"].to_numpy(np.int64), common["n"].to_numpy(np.int64), symbols, symbol_counts,
        numbers + ADD * seen + ADD,
    )


def looked_up(found: Tokens, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, count) of every token; the count is -1 where the token isn't common."""
    if not len(known.common):
        return found.classes, np.full(len(found.hashes), -1)
    # Hashes are spread evenly, so that buckets are small and a step or two from a bucket's begin leads to a token's place.
    bits, begins, most, common = known.buckets
    at = begins[_bucket(found.hashes, bits)]
    for _ in range(most):
        at += common[at] < found.hashes
    hit = np.flatnonzero(common[at] == found.hashes)
    hit = hit[at[hit] < len(known.common)]
    at = at[hit]
    symbol, count = found.classes.copy(), np.full(len(found.hashes), -1)
    count[hit] = known.common_counts[at]
    own = known.symbols[at]
    symbol[hit[own >= 0]] = own[own >= 0]
    return symbol, count


def contexts(symbols: np.ndarray, found: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before; the end token before a text's start."""
    starts = np.zeros(len(symbols), bool)
    starts[found.first[:-1]] = True
    one = np.where(starts, END, np.roll(symbols, 1))
    two = np.where(starts | np.roll(starts, 1), END, np.roll(symbols, 2))
    return one, two


# Training


class Parameters:
    """Vectors of context and target symbols, position matrices (diagonal), biases."""

    NAMES = ("vectors", "positions", "bias")

    def __init__(self, known: Vocabulary):
        draw = np.random.default_rng(5)
        context, target = draw.normal(0, 0.3, (TOTAL, DIMENSIONS)), draw.normal(0, 0.1, (TOTAL, DIMENSIONS))
        self.vectors = np.vstack([context, target]).astype(np.float32)
        self.positions = np.ones((2, DIMENSIONS), np.float32) * 0.5
        self.bias = np.log((known.symbol_counts + ADD) / (known.total + ADD * TOTAL)).astype(np.float32)

    @property
    def context(self) -> np.ndarray:
        return self.vectors[:TOTAL]

    @property
    def target(self) -> np.ndarray:
        return self.vectors[TOTAL:]

    def rows(self) -> np.ndarray:
        """All parameters as rows of DIMENSIONS numbers."""
        bias = np.resize(np.pad(self.bias, (0, -TOTAL % DIMENSIONS)), (-(-TOTAL // DIMENSIONS), DIMENSIONS))
        return np.vstack([self.vectors, self.positions, bias])

    def take(self, rows: np.ndarray) -> None:
        self.vectors = rows[: 2 * TOTAL].copy()
        self.positions = rows[2 * TOTAL : 2 * TOTAL + 2].copy()
        self.bias = rows[2 * TOTAL + 2 :].reshape(-1)[:TOTAL].copy()


class Room:
    """The arrays of a training step, made once per task."""

    def __init__(self):
        def space(*shape: int) -> np.ndarray:
            return np.empty(shape, np.float32)

        self.met, self.gradients = (space(3 * BATCH + 4 * NOISE, DIMENSIONS) for _ in range(2))
        self.positions, self.parts = (space(2, BATCH, DIMENSIONS) for _ in range(2))
        self.q, self.g_q = (space(BATCH, DIMENSIONS) for _ in range(2))
        self.bad = space(BATCH, 4 * NOISE)


def learn(p: Parameters, noise: np.ndarray, columns: np.ndarray, seed: int, squares: dict[str, np.ndarray], room: Room) -> None:
    """One pass of NCE over targets, those one before and those two before, with adaptive rates and shared noise per batch.

    ``squares`` are the sums of squared gradients, which set the rates; they grow from call to call.
    """
    draws = np.random.default_rng(seed).random((-(-columns.shape[1] // BATCH), NOISE * 4))
    drawn = np.minimum(np.searchsorted(np.cumsum(noise), draws), TOTAL - 1).astype(np.int16)
    log_noise = np.log(noise * NOISE).astype(np.float32)
    vectors, sums_of_squares = as_items(p.vectors), as_items(squares["vectors"])
    ones, across = np.ones(BATCH, np.float32), np.ones(DIMENSIONS, np.float32)
    for w, v, met, own, *plan in batches(columns, drawn):
        n = len(w)
        rows = np.take(p.vectors, met, 0, room.met[: len(met)], "clip")
        before, target, other = rows[: 2 * n].reshape(2, n, -1), rows[2 * n : 3 * n], rows[3 * n :]
        positions, parts, q, g_q, bad = room.positions[:, :n], room.parts[:, :n], room.q[:n], room.g_q[:n], room.bad[:n]
        positions[:] = p.positions[:, None]
        np.add(*np.multiply(before, positions, parts), q)
        offset = p.bias - log_noise
        g_good = inverse_odds(np.multiply(q, target, g_q) @ across + offset[w])
        np.negative(other, other)
        np.matmul(q, other.T, bad)
        bad -= offset[v]
        inverse_odds(bad)
        other /= 4  # 4 * NOISE shared draws stand for NOISE of one's own
        np.multiply(g_good[:, None], target, g_q)
        g_q += np.matmul(bad, other, parts[0])
        g = room.gradients[: len(met)]
        np.multiply(g_q, positions, g[: 2 * n].reshape(2, n, -1))
        np.multiply(g_good[:, None], q, g[2 * n : 3 * n])
        np.matmul(bad.T, q, g[3 * n :])
        g[3 * n :] /= -4
        bias = np.bincount(np.concatenate([w, v]), np.concatenate([g_good, ones[:n] @ bad / -4]), TOTAL).astype(np.float32)
        dense = {"positions": ones[:n] @ np.multiply(g_q, before, parts), "bias": bias}
        summed = row_sums(g, *plan, room.met)
        summed /= n
        total = sums_of_squares.take(own).view(np.float32).reshape(summed.shape)
        total += summed * summed  # rows that were not met have no gradient and stay
        sums_of_squares.put(own, as_items(total))
        summed *= RATE * 0.1
        summed /= np.sqrt(total, total)
        summed += p.vectors.take(own, 0)
        vectors.put(own, as_items(summed))
        for name, change in dense.items():
            change /= n
            squares[name] += change * change
            change *= RATE * 0.1
            change /= np.sqrt(squares[name])
            getattr(p, name)[:] += change


def inverse_odds(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place; 0 where exp(x) is beyond all numbers."""
    with np.errstate(over="ignore"):
        np.exp(x, x)
    x += 1
    return np.reciprocal(x, x)


def as_items(rows: np.ndarray) -> np.ndarray:
    """A view in which each row is a single item, which numpy moves at once."""
    return rows.view(f"V{rows.itemsize * rows.shape[1]}")[:, 0]


def batches(columns: np.ndarray, drawn: np.ndarray) -> Iterator[tuple]:
    """For each batch its targets, its noise, the rows of vectors that it meets, and how to sum them (see ``layers``)."""
    n = columns.shape[1]
    whole = n - n % BATCH
    for a, z in pairwise(sorted({*range(0, whole, PLANNED * BATCH), whole, n})):
        w, one, two = columns[:, a:z].reshape(3, -1, min(BATCH, z - a))
        v = drawn[a // BATCH : -(-z // BATCH)]
        met = np.concatenate([one, two, w + TOTAL, v + TOTAL], 1)
        yield from zip(w, v, met, *layers(met))


def layers(met: np.ndarray) -> tuple[list, np.ndarray, list, list]:
    """For each row of ``met`` its distinct numbers, the most frequent first, and its places in layers, and their sizes.

    Layer j holds the places of each number's occurrence j, for the numbers that have one, in their order. So the layers'
    sizes fall, and adding each to the front of the first sums up per number. After LAYERS of them follow all other places,
    number by number; the last list tells where each number begins there.
    """
    n, width = met.shape
    order = np.argsort(met, 1, kind="stable")
    ranked = np.take_along_axis(met, order, 1)
    starts = np.flatnonzero(np.diff(ranked, axis=1, prepend=np.int16(-1)))
    times = np.diff(starts, append=met.size)
    by_times = np.argsort(-times.astype(np.int16), kind="stable")
    by_times = by_times[np.argsort((starts // width).astype(np.int16)[by_times], kind="stable")]
    edges = np.searchsorted(starts, np.arange(n + 1) * width)
    left = np.maximum(times - LAYERS, 0)[by_times]
    before = np.cumsum(left) - left
    before -= np.repeat(before[edges[:-1]], np.diff(edges))
    place, begin = np.empty((2, len(starts)), np.int64)
    place[by_times] = np.arange(len(starts)) - np.repeat(edges[:-1], np.diff(edges))
    begin[by_times] = before - LAYERS
    occurrence = np.arange(met.size) - np.repeat(starts, times)
    layer = np.minimum(occurrence, LAYERS) + np.repeat(np.arange(n) * (LAYERS + 1), width)
    sizes = np.bincount(layer, minlength=n * (LAYERS + 1))
    at = np.where(occurrence < LAYERS, np.repeat(place, times), np.repeat(begin, times) + occurrence)
    laid = np.empty_like(order).reshape(-1)
    laid[(np.cumsum(sizes) - sizes)[layer] + at] = order.reshape(-1)
    own = np.split(ranked.reshape(-1)[starts[by_times]], edges[1:-1])
    many = [b[: np.count_nonzero(m)] for b, m in zip(np.split(before, edges[1:-1]), np.split(left, edges[1:-1]))]
    return own, laid.reshape(n, width), [s[: np.count_nonzero(s)].tolist() for s in sizes.reshape(n, -1)[:, :LAYERS]], many


def row_sums(rows: np.ndarray, places: np.ndarray, sizes: list[int], many: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The sums of the rows in layers of these places and sizes and of what follows them, in ``room``."""
    laid = np.take(rows, places, 0, room[: len(places)], "clip")
    total, at = laid[: sizes[0]], sizes[0]
    for size in sizes[1:]:
        front = total[:size]
        np.add(front, laid[at : at + size], front)
        at += size
    if len(many):
        # Two numbers as a complex one: half as many loops.
        total[: len(many)] += np.add.reduceat(laid[at:].view(np.complex64), many, axis=0).view(np.float32)
    return total


def _examples(run: list[bytes], known: Vocabulary) -> np.ndarray:
    """(target, one before, two before) of every position of a run of texts."""
    found = tokens(run)
    symbols = looked_up(found, known)[0].astype(np.int16)  # short numbers are sorted in linear time
    return np.stack([symbols, *contexts(symbols, found)]).T


def _learned(batches: Iterator[pa.RecordBatch], start: np.ndarray, known: Vocabulary, turn: int) -> Iterator[pa.RecordBatch]:
    """A task's parameters after all positions of its texts, weighted by their number."""
    p, seen, room = Parameters(known), 0, Room()
    p.take(start)
    noise = (known.symbol_counts + 1) / (known.symbol_counts + 1).sum()
    squares = {n: np.full(getattr(p, n).shape, 1e-2, np.float32) for n in Parameters.NAMES}
    for batch in batches:
        for run in steps(as_bytes(batch.column("text"))):
            examples = _examples(run, known)
            order = np.random.default_rng([turn, seen]).permutation(len(examples))
            learn(p, noise, examples.T.take(order, 1), turn * 1_000_003 + seen, squares, room)
            seen += len(examples)
    if seen:
        rows = p.rows().astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(rows))), pa.array(list(rows), pa.list_(pa.float64())), pa.array([float(seen)] * len(rows))],
            ["row", "v", "seen"],
        )


def train(texts: DataFrame, known: Vocabulary) -> Parameters:
    """Every task learns from all positions of its own texts as it cuts them into tokens; nothing is written.

    After each round the tasks' parameters are averaged by their positions; each task sends as many rows as the model has.
    """
    p = Parameters(known)
    if not known.total:
        return p
    known = known.of_symbols()
    for turn in range(ROUNDS):
        start = p.rows()
        tasks = texts.select("text").mapInArrow(
            lambda b, start=start, turn=turn: _learned(b, start, known, turn), "row long, v array<double>, seen double"
        )
        sums = F.array(*[F.sum(F.col("v")[i] * F.col("seen")) / F.sum("seen") for i in range(DIMENSIONS)])
        merged = tasks.groupBy("row").agg(sums.alias("v")).toPandas().sort_values("row")  # as many rows as the model has
        if len(merged):
            p.take(np.stack(merged["v"].to_numpy()).astype(np.float32))
    return p


# Scoring


@dataclass(frozen=True)
class Tables:
    """log10 scores by (one before, symbol), (two before, symbol), and of the sums by (one, two before)."""

    one: np.ndarray
    two: np.ndarray
    sums: np.ndarray


def tables(p: Parameters) -> Tables:
    """Batched products of all contexts with all symbols; the scores' sums normalise them."""
    one = (p.context * p.positions[0]) @ p.target.T + p.bias
    two = (p.context * p.positions[1]) @ p.target.T
    # exp(one) and exp(two) meet in a product over symbols: one matrix product for all pairs of contexts.
    top_one, top_two = one.max(1, keepdims=True), two.max(1, keepdims=True)
    sums = np.log(np.exp(one - top_one, dtype=np.float64) @ np.exp(two - top_two, dtype=np.float64).T)
    sums += top_one + top_two.T
    scale = np.log(10)
    return Tables((one / scale).astype(np.float32), (two / scale).astype(np.float32), (sums / scale).astype(np.float32))


def _scored(batches: Iterator[pa.RecordBatch], known: Vocabulary, lookup: Tables) -> Iterator[pa.RecordBatch]:
    """Per text: sums over what is known here, and its other tokens, whose counts are yet to be looked up.

    A rare token adds log10(c + ADD) to both scores; all else about it is known here.
    """
    log_mass = np.log10(known.class_mass)
    serial = TaskContext.get().partitionId() << 40
    for batch in batches:
        at = 0
        for run in steps(as_bytes(batch.column("text"))):
            found = tokens(run)
            symbols, counts = looked_up(found, known)
            one, two = contexts(symbols, found)
            model = (lookup.one[one, symbols] + lookup.two[two, symbols] - lookup.sums[one, two]).astype(np.float64)
            in_class = (symbols >= SYMBOLS) & (symbols < END)
            shared = np.where(counts >= 0, np.log10(np.maximum(counts, 0) + ADD), 0.0)
            model += np.where(in_class, shared - log_mass[symbols], 0.0)
            base = shared - np.log10(known.base_mass if known.total else ADD)
            edges = found.first
            rare = counts < 0
            owner = np.repeat(np.arange(len(run)), np.diff(edges))[rare]
            rare_edges = np.searchsorted(owner, np.arange(len(run) + 1))
            lists = pa.ListArray.from_arrays(pa.array(rare_edges, pa.int32()), pa.array(found.hashes[rare]))
            add = lambda x: np.add.reduceat(x, edges[:-1])  # noqa: E731  (no text is without a token)
            columns = [
                batch.column("doc_id").slice(at, len(run)),
                pa.array(np.arange(serial + at, serial + at + len(run))),
                pa.array(np.diff(edges).astype(np.int64)),
                pa.array(add((counts > 0).astype(np.int64))),
                pa.array(add(base)),
                pa.array(add(model)),
                lists,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_tokens", "n_known", "base", "model", "rare"])
            at += len(run)
        serial += batch.num_rows


SCORED = "doc_id long, row long, n_tokens long, n_known long, base double, model double, rare array<long>"


def scores(documents: DataFrame, known: Vocabulary, counts: DataFrame, p: Parameters) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row."""
    lookup = tables(p)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = stage(texts.mapInArrow(lambda b: _scored(b, known, lookup), SCORED), "scored")
    rare = drawn.select("row", F.explode("rare").alias("token"))
    found = rare.join(counts.select("token", "n"), "token", "left")
    logs = F.log10(F.coalesce("n", F.lit(0)) + ADD)
    sums = found.groupBy("row").agg(F.sum(logs).alias("logs"), F.count_if(F.col("n") > 0).alias("hits"))
    more = F.coalesce("logs", F.lit(0.0))
    return drawn.drop("rare").join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("hits", F.lit(0))).alias("n_known"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def op3_log_bilinear(spark, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    training = documents.filter(fold("doc_id", 10) != 0)
    counts = stage(token_counts(training), "counts")
    known = vocabulary(counts)
    found = scores(documents, known, counts, train(training, known))
    return found.select(
        "doc_id",
        (fold("doc_id", 10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(known.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


QUERIES = {"op3_log_bilinear": op3_log_bilinear}
ORACLES: dict[str, str] = {}

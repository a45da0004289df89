"""MinHash near-dedup: a chosen-path set similarity join over minwise tokens.

A document is the set of its word shingles. Documents with equal sets (by a 64-bit hash of the whole set) form a class; only one of
each class goes on. Every class has COORDINATES minwise values. A tree chooses coordinates at random and branches the classes by
their values there, so that classes at similarity s stay together with probability s per step. Nodes of at most
NODE_ROWS classes are compared exhaustively, by estimates from the minwise values. Larger ones branch further, in WAYS ways for
every three coordinates: a pair at the threshold then meets again in about one of them, while a crowd of texts that are less alike
thins out faster than it is repeated. What is still large at the last depth is cut into runs, and all runs are compared with
one another, block by block, so that nothing is left out there. Where nodes are small at first depth, TREES trees that were independent would meet a pair at
the threshold with probability 1 - (1 - 0.8 ** 3) ** TREES, over 0.9999999; as they share PATH coordinates, it is about 0.9999;
estimates that fall by chance below LEAST_AGREEMENT (four
deviations) lose less than 1 pair in 10,000.

What a node suggests is confirmed on full sets. First a spanning forest of each node's estimates in a few trees, for nodes cut
into small runs, joins almost all; then, in all trees, each member's best candidates in other components, first a few of them, then
GROWTH times as many, until none is left out. These are not moved pair by pair: a node's members that have candidates form a packet, each with a
list of its candidates, so a text travels once for each node however many candidates it has there; one task holds a packet's sets and
tests pairs until their components have met. Packets of very long texts are cut into blocks of runs. A pair that meets in the small roots of several trees is suggested by the first of
them alone (told by 32-bit hashes: of a billion pairs, about six are taken for suggested that were not). Pairs within a component need
no test, so that large groups of copies never yield all their pairs, and nodes within one component end.

Defined cases: null and empty texts, or texts without words, have an empty set, link with nothing and are kept; a
text with fewer words than a shingle is one shingle; rows without an id link with nothing, have no component and are
kept; rows that share an id are classes like any others. Other columns pass through where the operator filters.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import as_bytes, giving_back, joined, mixed, steps, table, words
from secondlook.llm.components import components
from secondlook.operators.skew import spread_lookup
from secondlook.session import stage

#: Minwise values of which estimates take the last byte, and the first of them, by which trees branch.
COORDINATES, PATH = 256, 96
TREES, FIRST_TREES = 24, 3
#: Depths at which nodes are looked at, and the ways in which large ones branch from one to the next.
DEPTHS = (3, 6, 9, 12, 15, 18)
WAYS = 2
#: Classes that are compared exhaustively, and those of a run in the first round.
NODE_ROWS, RUN_ROWS = 4096, 512
#: Pairs are confirmed if they agree in at least this share of the coordinates, four deviations below 0.8, and in so many of QUICK.
LEAST_AGREEMENT, QUICK, QUICK_LEAST = 0.70, 32, 15
#: Candidates of each member in the second round's first pass; each further pass takes GROWTH times as many.
FIRST_CANDIDATES, GROWTH = 8, 512
#: Members, and pairs, that are compared at once.
TILE, PAIRS = 64, 1 << 16
#: Shingles of one of the two runs of members in a packet (32 MB); a longer text forms a run of its own.
RUN_SHINGLES = 1 << 22

_SEEDS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(run: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    hashes, first, *_ = words(run)
    grams = joined(hashes, tuple(range(size)))
    sets = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= size:
            sets.append(np.unique(grams[a : z - size + 1]))
        else:
            sets.append(mixed(joined(hashes[a:z], tuple(range(z - a))) + np.uint64(z - a)) if z > a else hashes[:0])
    return sets


def class_key(shingles: np.ndarray) -> int:
    """A hash of the whole set."""
    total = np.add.reduce(mixed(shingles), dtype=np.uint64, keepdims=True)
    return int(mixed(total ^ np.uint64(len(shingles))).astype(np.int64)[0])


def minwise(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(PATH minwise values, the last bytes of all COORDINATES) of sets that aren't empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    path, sign = np.empty((len(sets), PATH), np.int32), np.empty((len(sets), COORDINATES), np.uint8)
    for t, seed in enumerate(_SEEDS):
        values = ((flat ^ (seed >> np.uint64(7))) * seed >> np.uint64(32)).astype(np.uint32)
        least = np.minimum.reduceat(values, starts)
        sign[:, t] = least
        if t < PATH:
            path[:, t] = least.view(np.int32)
    return path, sign


def _sketched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for run in steps(as_bytes(batch.column("text"))):
            sets = shingle_sets(run, size)
            full = [i for i, s in enumerate(sets) if len(s)]
            paths: list = [None] * len(sets)
            signs: list = [None] * len(sets)
            for i, path, sign in zip(full, *minwise([sets[i] for i in full])) if full else ():
                paths[i], signs[i] = path, sign.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(at, len(run)),
                    batch.column("text_key").slice(at, len(run)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_key(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array(paths, pa.list_(pa.int32())),
                    pa.array(signs, pa.binary()),
                ],
                ["doc_id", "text_key", "n_shingles", "class", "path", "sign"],
            )
            at += len(run)


def text_key(text: str = "text") -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(text)


SKETCHED = "doc_id long, text_key long, n_shingles long, class long, path array<int>, sign binary"


def sketches(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, class, path, sign) per row; class, path and sign are null for an empty set."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    return texts.mapInArrow(lambda b: giving_back(_sketched(b, size)), SKETCHED)


# Trees


def _chosen(tree: int, way: int = 0) -> np.ndarray:
    return np.random.default_rng(1000 + tree + 100 * way).permutation(PATH)


def _branch(node, coordinates):
    return F.xxhash64(node, *[F.get("path", F.lit(int(c))) for c in coordinates])


def _sized(current: DataFrame) -> DataFrame:
    """The rows of nodes that hold more than one component, with the node's size."""
    sizes = current.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return stage(current.join(sizes.filter("lo < hi").drop("lo", "hi"), "node"), "nodes")


def roots(classes: DataFrame) -> DataFrame:
    """All nodes at the first depth in which classes meet."""
    nodes = F.array(*[_branch(F.lit(t), _chosen(t)[: DEPTHS[0]]) for t in range(TREES)])
    found = classes.select("class", F.col("class").alias("label"), F.posexplode(nodes).alias("tree", "node"))
    return _sized(found)


def small_runs(sized: DataFrame) -> DataFrame:
    """(node, class, label): nodes cut into runs of about RUN_ROWS by a hash, and one more node of some of each run's members."""
    runs = F.ceil(F.col("n") / RUN_ROWS)
    drawn = F.xxhash64("class", F.lit(5))
    cut = sized.select(F.xxhash64("node", F.pmod(drawn, runs)).alias("node"), "class", "label")
    some = sized.filter((F.col("n") > RUN_ROWS) & (F.pmod(F.xxhash64("class", F.lit(6)), runs) == 0))
    return cut.unionAll(some.select(F.xxhash64("node", F.lit(-1)).alias("node"), "class", "label"))


def node_members(sized: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, class, label, before) of all nodes up to NODE_ROWS classes; larger ones branch, and at last are cut into pairs of runs.

    Pairs that met in a small root of a tree below ``before`` are suggested there.
    """
    small = []
    for level, depth in enumerate(DEPTHS):
        before = F.lit(TREES) if level else F.col("tree")
        small.append(sized.filter(F.col("n") <= NODE_ROWS).select("node", "class", "label", before.alias("before")))
        many = sized.filter(F.col("n") > NODE_ROWS)
        if many.isEmpty():
            break
        if level + 1 == len(DEPTHS):
            runs = F.ceil(2 * F.col("n") / NODE_ROWS).cast("int")
            own = F.pmod(F.xxhash64("class", F.lit(5)), runs).cast("int")
            dealt = many.select("node", "class", "label", own.alias("run"), F.explode(F.sequence(F.lit(0), runs - 1)).alias("other"))
            block = F.xxhash64("node", F.least("run", "other"), F.greatest("run", "other"))
            small.append(dealt.select(block.alias("node"), "class", "label", F.lit(TREES).alias("before")))
            break
        part = slice(depth, DEPTHS[level + 1])
        deeper = F.array(*[
            F.array(*[F.xxhash64(F.lit(w), _branch(F.col("node"), _chosen(t, w)[part])) for w in range(WAYS)])
            for t in range(TREES)
        ])
        rows = many.select("class", "label", "tree", "node").join(classes.select("class", "path"), "class")
        sized = _sized(rows.select("class", "label", "tree", F.explode(F.get(deeper, F.col("tree"))).alias("node")))
    return reduce(DataFrame.unionAll, small)


def small_roots(sized: DataFrame) -> DataFrame:
    """(class, roots): by tree, a hash of the class's root if that is compared as it is, else 0."""
    roots = [F.coalesce(F.max(F.when(F.col("tree") == t, F.hash("node"))), F.lit(0)) for t in range(TREES)]
    return sized.filter(F.col("n") <= NODE_ROWS).groupBy("class").agg(F.array(*roots).alias("roots"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(classes, labels, signs, roots, before, sizes) node by node, from rows sorted by node."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([*held, batch]).combine_chunks()
            nodes = rows.column("node").to_numpy()
            others = np.flatnonzero(nodes != nodes[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            yield from _cut_groups(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()  # the last node may go on in the next batch
    if held:
        yield from _cut_groups(pa.Table.from_batches(held))


def _cut_groups(rows: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    if not rows.num_rows:
        return
    rows = rows.combine_chunks()
    nodes, classes, labels, sizes = (rows.column(n).to_numpy() for n in ("node", "class", "label", "n_shingles"))
    signs = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint8).reshape(-1, COORDINATES)
    roots = rows.column("roots").combine_chunks().flatten().to_numpy().reshape(-1, TREES)
    before = rows.column("before").to_numpy()
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(nodes)) + 1, [len(nodes)]))
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if z - a > 1:
            yield classes[a:z], labels[a:z], signs[a:z], roots[a:z], int(before[a]), sizes[a:z]


def close_pairs(signs: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, agreements) of the pairs i < j in different components whose signs agree well enough."""
    quick = np.ascontiguousarray(signs[:, :QUICK])
    found = []
    for a in range(0, len(signs), TILE):
        agree = (quick[a : a + TILE, None] == quick[None, a:]).sum(2, dtype=np.uint8) >= QUICK_LEAST
        i, j = np.nonzero(np.triu(agree & (labels[a : a + TILE, None] != labels[None, a:]), 1))
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS] + a, j[k : k + PAIRS] + a
            both = (signs[x] == signs[y]).sum(1)
            good = both >= LEAST_AGREEMENT * COORDINATES
            found.append((x[good].astype(np.int32), y[good].astype(np.int32), both[good].astype(np.int16)))
    none = np.zeros(0, np.int32)
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (none, none, none)


def best_of_each(n: int, i, j, agree, most: int) -> tuple[np.ndarray, bool]:
    """Pairs that are among the ``most`` best of one of their members, and whether there are others."""
    if len(i) <= most:
        return np.arange(len(i)), False
    ends, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((-np.tile(agree, 2), ends))
    ends = ends[order]
    rank = np.arange(len(ends)) - np.searchsorted(ends, ends)
    kept = np.unique(pair[order[rank < most]])
    return kept, len(kept) < len(i)


def unmet(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a pair has none of these roots in common."""
    parts = []
    for k in range(0, len(i), PAIRS):
        x, y = roots[i[k : k + PAIRS]], roots[j[k : k + PAIRS]]
        parts.append(~((x == y) & (x != 0)).any(1))
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _suggested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each node: a spanning forest of its estimates."""
    for classes, labels, signs, *_ in _groups(batches):
        if (labels != labels[0]).any():
            i, j, agree = close_pairs(signs, labels)
            kept = _forest(len(classes), i, j, agree)
            ends = np.sort(np.stack([classes[i[kept]], classes[j[kept]]], 1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


PACKED = "packet long, class long, label long, partners array<long>, more boolean"


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The members of each node that are candidates of one another, with their partners, best first, listed once a pair.

    A pair counts if it is among the ``most`` best of a member; a row with ``more`` tells that a node has others.
    """
    task, serial, more = TaskContext.get().partitionId() << 32, 0, False
    for classes, labels, signs, roots, before, sizes in _groups(batches):
        if (labels == labels[0]).all():
            continue
        i, j, agree = close_pairs(signs, labels)
        kept, others = best_of_each(len(classes), i, j, agree, most)
        more |= others
        kept = kept[unmet(roots[:, :before], i[kept], j[kept])]
        kept = kept[np.argsort(-agree[kept], kind="stable")]
        i, j = i[kept], j[kept]
        runs = np.cumsum(sizes) // RUN_SHINGLES
        block = np.stack([runs[i], runs[j]], 1)
        for own in np.unique(block, axis=0):
            here = (block == own).all(1)
            yield _packet(task | serial, classes, labels, i[here], j[here])
            serial += 1
    if more:
        yield pa.RecordBatch.from_arrays([*(pa.array([0]) for _ in range(3)), pa.array([[]], pa.list_(pa.int64())), pa.array([True])], _NAMES)


_NAMES = [c.split()[0] for c in PACKED.split(", ")]


def _packet(number: int, classes: np.ndarray, labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    members = np.unique(np.concatenate([i, j]))
    order = np.argsort(i, kind="stable")
    edges = np.append(np.searchsorted(i[order], members), len(i))
    partners = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(classes[j[order]]))
    n = len(members)
    columns = [np.full(n, number), classes[members], labels[members], partners, np.zeros(n, bool)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _NAMES)


def _forest(n: int, i, j, agree) -> np.ndarray:
    """The pairs of a spanning forest, best agreements first."""
    root = list(range(n))
    kept = []
    for k in np.argsort(-agree, kind="stable").tolist():
        a, b = int(i[k]), int(j[k])
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[a] = b
            kept.append(k)
            if len(kept) == n - 1:
                break
    return np.array(kept, np.int64)


def _by_node(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of a node side by side, with what is known of them."""
    rows = members.join(classes.select("class", "sign", "n_shingles"), "class")
    if "roots" not in members.columns:
        rows = rows.withColumns({"roots": F.array_repeat(F.lit(0), TREES), "before": F.lit(0)})
    rows = rows.select("node", "class", "label", "sign", "n_shingles", "roots", "before")
    return rows.repartition("node").sortWithinPartitions("node", "class")


def suggested(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of each node's estimates."""
    return _by_node(members, classes).mapInArrow(lambda b: giving_back(_suggested(b)), "a long, b long").distinct()


def packets(members: DataFrame, classes: DataFrame, most: int, met: DataFrame) -> DataFrame:
    """PACKED; ``met`` are the classes' small roots: a pair is only suggested by the first of those it has in common."""
    known = members.join(met, "class", "left").withColumn("roots", F.coalesce("roots", F.array_repeat(F.lit(0), TREES)))
    return _by_node(known, classes).mapInArrow(lambda b: giving_back(_packed(b, most)), PACKED)


# Confirmation


def _confirmed(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = list(zip(as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b"))))
        place: dict[bytes, int] = {}
        for pair in pairs:
            for text in pair:
                place.setdefault(text, len(place))
        sets = [s for run in steps(list(place)) for s in shingle_sets(run, size)]  # each text once
        keep = []
        for x, y in pairs:
            one, other = sets[place[x]], sets[place[y]]
            both = len(np.intersect1d(one, other, assume_unique=True))
            keep.append(100 * both >= percent * (len(one) + len(other) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _identified(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys: list = []
        for run in steps(as_bytes(batch.column("text"))):
            keys += [class_key(s) if len(s) else None for s in shingle_sets(run, size)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("text")], ["class", "text"])


def class_texts(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(class, text) for the wanted classes: one text each, found by the class's smallest id."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    near = own.join(wanted.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    named = near.select("text").mapInArrow(lambda b: giving_back(_identified(b, size)), "class long, text string")
    return named.join(wanted.select("class"), "class", "left_semi").groupBy("class").agg(F.min("text").alias("text"))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    both = spread_lookup(spread_lookup(pairs.select("a", "b"), one, "a", "b", how="inner"), other, "b", "a", how="inner")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(lambda b: giving_back(_confirmed(b, size, percent)), "a long, b long")


class _Parts:
    """Components of labels, united as pairs are confirmed."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, label: int) -> int:
        while (above := self.above.get(label, label)) != label:
            self.above[label] = label = self.above.get(above, above)
        return label


#: Candidates of a member that are tested at once.
TESTED = 64


def _links(rows: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Confirmed pairs of a packet of (class, label, partners, set) that join components not yet joined by others."""
    sets = {c: s for c, _, _, s in rows}
    labels, parts = {c: label for c, label, _, _ in rows}, _Parts()
    for c, label, partners, own in rows:
        for at in range(0, len(partners), TESTED):
            some = [p for p in partners[at : at + TESTED] if parts.top(labels[p]) != parts.top(label)]
            if not some:
                continue
            others = [sets[p] for p in some]
            sizes = np.array([len(s) for s in others])
            flat = np.concatenate(others)
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
            for k in np.flatnonzero(100 * both >= percent * (len(own) + sizes - both)).tolist():
                one, other = parts.top(label), parts.top(labels[some[k]])
                if one != other:
                    parts.above[one] = other
                    yield min(c, some[k]), max(c, some[k])


def _tested(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of each packet's links, from rows sorted by packet."""
    held: list[tuple] = []
    current = None

    def found() -> pa.RecordBatch:
        ends = np.array(list(_links(held, percent)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("packet", "class", "label", "partners")]
        sets = (s for run in steps(as_bytes(batch.column("text"))) for s in shingle_sets(run, size))
        for packet, *row in zip(*columns, sets):
            if packet != current:
                if held:
                    yield found()
                held, current = [], packet
            held.append(tuple(row))
    if held:
        yield found()


def tested(found: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of packets whose full sets are similar enough, as many as it takes to join what they join."""
    rows = found.join(texts, "class").select("packet", "class", "label", "partners", "text")
    dealt = rows.repartition("packet").sortWithinPartitions("packet", "class")
    return dealt.mapInArrow(lambda b: giving_back(_tested(b, size, percent)), "a long, b long").distinct()


def named_components(links: DataFrame) -> DataFrame:
    """(class, label) of every class with a link."""
    return components(links).withColumnRenamed("node", "class")


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; ``kept`` marks one document of each component."""
    return marked_rows(documents, size, percent).drop("text_key", "stays")


def marked_rows(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept, stays) for every row.

    ``kept`` marks the id of each component, ``stays`` only the row of this id and one of its texts, so that rows which share
    an id are told apart; rows without an id or with an empty set stay.
    """
    drawn = stage(sketches(documents, size), "sketches")
    known = drawn.filter("doc_id IS NOT NULL AND class IS NOT NULL")
    firsts = F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("n_rows")
    sketch = F.any_value(F.struct("path", "sign", "n_shingles")).alias("sketch")
    classes = stage(known.groupBy("class").agg(*firsts, sketch).select("*", "sketch.*").drop("sketch"), "classes")

    first_nodes = roots(classes)
    met = classes.join(first_nodes.select("class").distinct(), "class", "left_semi")
    texts = stage(class_texts(documents, met.select("class", "first_id"), size), "texts")

    members = small_runs(first_nodes.filter(F.col("tree") < FIRST_TREES))
    forest = stage(suggested(members, classes), "pairs")
    links = stage(confirmed(forest, texts, size, percent), "links")
    labels = stage(named_components(links), "labels")

    most, more = FIRST_CANDIDATES, True
    while more:
        at = first_nodes.select("class", "tree", "node").join(labels, "class", "left")
        still_open = _sized(at.withColumn("label", F.coalesce("label", "class")))
        found = stage(packets(node_members(still_open, classes), classes, most, small_roots(still_open)), "packets")
        new = stage(tested(found.filter("NOT more"), texts, size, percent), "links")
        if not new.isEmpty():
            links = links.unionAll(new)
            labels = stage(named_components(links), "labels")
        more, most = not found.filter("more").isEmpty(), most * GROWTH

    named = classes.select("class", "first").join(labels, "class", "left")
    named = stage(named.select("class", "first", F.coalesce("label", "class").alias("label")), "named")
    smallest = stage(named.groupBy("label").agg(F.min("first").alias("first"), F.count("*").alias("n_rows")), "smallest")
    sizes = smallest.select("label", "n_rows")
    found = spread_lookup(named.drop("first"), smallest.drop("n_rows"), "label", "class", sizes=sizes).select("class", "first")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    own = F.struct("doc_id", "text_key") == F.col("first")
    rows = drawn.select("doc_id", "text_key", "n_shingles", "class")
    return (
        spread_lookup(rows, found, "class", ("doc_id", "text_key"))  # null classes and copies are dealt out
        .select("doc_id", "text_key", "n_shingles", component.alias("component_id"), own.alias("own"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .withColumn("stays", F.col("doc_id").isNull() | F.coalesce("own", F.lit(True)))
        .drop("own")
    )


def op5_chosen_path(spark, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "documents"), size=4)


QUERIES = {"op5_chosen_path": op5_chosen_path}
ORACLES = {
    "op5_chosen_path": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS shingles
  FROM w
), u AS (SELECT doc_id, unnest(shingles) AS x FROM s),
sets AS (SELECT shingles_key, min(doc_id) AS rep, any_value(n) AS n FROM (
  SELECT doc_id, md5(array_to_string(list_sort(shingles), '|')) AS shingles_key, len(shingles) AS n FROM s WHERE len(shingles) > 0
) GROUP BY shingles_key),
reps AS (SELECT u.doc_id, u.x, sets.n FROM u JOIN sets ON u.doc_id = sets.rep),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM reps a JOIN reps b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT rep, rep FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(l.component_id, s.doc_id) AS kept
FROM s LEFT JOIN sets ON sets.shingles_key = md5(array_to_string(list_sort(s.shingles), '|')) AND len(s.shingles) > 0
LEFT JOIN least l ON l.rep = sets.rep
"""
}

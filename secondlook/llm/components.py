"""Connected components of a table of links, by alternating large and small stars.

First, tasks of at most about LOCAL_LINKS links unite what their own links join and hand on one link per node, to the smallest node
of its part. If one such task holds all links, that is the result. Otherwise rounds follow: each attaches the larger
neighbours of each node to the smallest one around it (large star), then the smaller ones (small star), and writes what is left;
they end when a round changes nothing, with every node linked to the smallest of its component. A node with very many links is
dealt out over salts when its links look up their minimum.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.operators.skew import MIN_PIECE_ROWS, spread_lookup
from secondlook.session import stage


#: Links that one task unites: 16 MB.
LOCAL_LINKS = 1 << 20


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the components of linked places; a label is the smallest place of its component."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each node but the smallest of its part, with that one."""
    held = [(np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate(c) for c in zip(*held))
        nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = np.arange(len(nodes))
        unite(label, places[: len(u)], places[len(u) :])
        other = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], ["u", "v"])


def _smallest(links: DataFrame) -> DataFrame:
    """(u, least, n_rows) of every node u with links (u, v)."""
    return stage(links.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n_rows")), "least")


def _looked_up(links: DataFrame, least: DataFrame) -> DataFrame:
    if least.agg(F.max("n_rows")).first()[0] <= MIN_PIECE_ROWS:
        return links.join(least.select("u", "least"), "u")
    return spread_lookup(links, least.select("u", "least"), "u", "v", sizes=least.select("u", "n_rows"), how="inner")


def _large_star(links: DataFrame) -> DataFrame:
    """(u, v) with u > v: each larger neighbour of a node goes to the smallest of the node and its neighbours."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _looked_up(both, _smallest(both)).filter("v > u")
    return found.select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """(u, v) with u > v: a node and its smaller neighbours go to the smallest of them."""
    least = _smallest(links)
    own = least.select("u", F.col("least").alias("v"))
    others = _looked_up(links, least).filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return own.unionAll(others).distinct()


def components(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, label): the smallest node that can be reached, for every node with a link. ``links`` has (a long, b long)."""
    ends = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    given = stage(links.filter("a <> b").select(*ends), "links")
    parts = -(-given.count() // local_links)
    if not parts:
        return given.select(F.col("u").alias("node"), F.col("v").alias("label"))
    dealt = given.coalesce(1) if parts == 1 else given.repartition(parts, "u")
    current, known = stage(dealt.mapInArrow(_contracted, "u long, v long"), "links"), None
    while parts > 1:
        seen = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if seen == known:
            break
        known = seen
        current = stage(_small_star(stage(_large_star(current), "links")), "links")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots)

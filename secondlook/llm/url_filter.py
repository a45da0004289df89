"""URL filters: explicit rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from the URLs that a rule judges. Features: lengths, depth, digit ratio, entropy, parameter
counts, and for the host's last label and last two labels the share of blocked URLs among all labelled ones. These
shares are a table with a row for every labelled suffix; rows find theirs by a join.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is judged by the
method like any other; if the labelled URLs are of one kind only, the method gives that kind; without any,
``allow``. Other columns pass through.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import table
from secondlook.operators.skew import free_name, spread_lookup
from secondlook.session import stage

BLOCK, ALLOW = "block", "allow"
#: Rule (host and path) and verdict.
RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))
#: The trees learn from at most this many distinct labelled URLs, those with the smallest hashes, each weighted by its rows.
SAMPLE = 20_000
PRIOR = 20.0
#: A suffix with at least so many rows and over a thousandth of all is looked up by several tasks.
LEAST_PIECE = 64
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    fits = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        inside = (host == name) | host.endswith("." + name)
        fits = F.when(inside & path.startswith(slash + rest), F.lit(rule)).otherwise(fits)
    return fits


def suffixes(host: Column) -> Column:
    """The last label and the last two labels of a host."""
    labels = F.split(host, r"\.")
    return F.array(F.element_at(labels, -1), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))


@dataclass(frozen=True)
class Trees:
    base: float
    nodes: list  # per tree: (features, thresholds, leaves) of a complete tree, level by level
    shares: DataFrame | None = None  # (key, share) of every suffix of a labelled URL

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for features, thresholds, leaves in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), features[at]] > thresholds[at])
            total += leaves[at - (2**DEPTH - 1)]
        return total


def lexical(url: str, host: str, path: str) -> list[float]:
    size = max(len(url), 1)
    _, counts = np.unique(np.frombuffer(url.encode("utf-8", "replace"), np.uint8), return_counts=True)
    share = counts / max(counts.sum(), 1)
    query = url.partition("#")[0].partition("?")[2]
    return [
        len(url), len(host), len(path), host.count("."), path.count("/"), sum(c.isdigit() for c in url) / size,
        -float(np.sum(share * np.log2(share))), query.count("&") + bool(query), len(query), url.count("-"),
        float("#" in url), float(url.startswith("https")), sum(c.isdigit() for c in host),
    ]


def feature_rows(urls, hosts, paths, shares) -> np.ndarray:
    own = [lexical(u or "", h, p) for u, h, p in zip(urls, hosts, paths)]
    return np.hstack([np.array(own, float).reshape(len(own), -1), np.array(shares, float).reshape(len(own), -1)])


def boost(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, list]:
    """Histogram-based gradient boosting with logistic loss and complete trees of fixed depth."""
    rate = np.clip(np.average(y, weights=weights), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    margin, nodes = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h, at = weights * (p - y), weights * p * (1 - p), np.zeros(len(y), np.int64)
        inner = 2**DEPTH - 1
        features, thresholds = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = 1e-6
            for j, e in enumerate(edges):
                gs, hs = (np.bincount(bins[mine, j], v[mine], len(e) + 1).cumsum() for v in (g, h))
                left_g, left_h, right_g, right_h = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                if len(gain) and gain.max() > best:
                    best, features[node], thresholds[node] = gain.max(), j, e[gain.argmax()]
            at[mine] = 2 * node + 1 + (x[mine, features[node]] > thresholds[node])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        leaves = -RATE * gs / (hs + 1)
        margin += leaves[leaf]
        nodes.append((features, thresholds, leaves))
    return base, nodes


def judged(pages: DataFrame, url: str, rules=RULES) -> DataFrame:
    """(url, host, path, rule, label, keys): label 1 for block, 0 for allow, null where no rule fits."""
    parts = pages.select(F.col(url).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    blocked = F.lit(None).cast("int")
    for rule, verdict in rules:
        blocked = F.when(F.col("rule") == rule, int(verdict == BLOCK)).otherwise(blocked)
    return parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumns(
        {"label": blocked, "keys": suffixes(F.col("host"))}
    )


def train(pages: DataFrame, url: str = "url", rules=RULES, sample: int = SAMPLE) -> Trees:
    """Learn from the URLs that a rule judges: suffix statistics over all of them, trees on a bounded sample."""
    labelled = judged(pages, url, rules).filter("label IS NOT NULL")
    counted = labelled.select(F.explode("keys").alias("key"), "label").groupBy("key")
    share = (F.sum("label") + 0.5 * PRIOR) / (F.count("*") + PRIOR)
    shares = stage(counted.agg(share.alias("share")), "suffixes")
    distinct = labelled.groupBy("url", "host", "path", "label", "keys").agg(F.count("*").alias("n"))
    drawn = stage(distinct.orderBy(F.xxhash64("url"), "url").limit(sample), "labelled")
    rows = drawn.toPandas()
    if rows.empty:
        return Trees(-1.0, [])
    keys = F.broadcast(drawn.select(F.explode("keys").alias("key")).distinct())  # at most two for each URL of the sample
    known = {r.key: r.share for r in shares.join(keys, "key", "left_semi").collect()}
    y = rows["label"].to_numpy(float)
    x = feature_rows(rows["url"], rows["host"], rows["path"], [[known[k] for k in ks] for ks in rows["keys"]])
    if y.min() == y.max():
        return Trees(2 * y[0] - 1, [], shares)
    return Trees(*boost(x, y, rows["n"].to_numpy(float)), shares)


def with_shares(pages: DataFrame, shares: DataFrame | None, url: str, out: tuple[str, str] = ("_last", "_two")) -> DataFrame:
    """Add ``out``, the shares of the host's last label and last two labels; 0.5 where no URL had a label.

    Helper columns take names that the pages don't have.
    """
    last, two = out
    if shares is None:
        return pages.withColumns({last: F.lit(0.5), two: F.lit(0.5)})
    key, row = free_name("_key", pages), free_name("_row", pages)
    keyed = pages.withColumns({key: suffixes(host_of(F.col(url)))[1], row: F.monotonically_increasing_id()})
    # The last two labels tell the last one, so both shares come with one lookup row for each pair of labels.
    sizes = stage(keyed.groupBy(key).agg(F.count("*").alias("n_rows")).select(F.col(key).alias("pair"), "n_rows"), "pairs")
    pairs = sizes.select("pair", F.element_at(F.split("pair", r"\."), -1).alias("label"))
    pairs = pairs.join(shares.select(F.col("key").alias("pair"), F.col("share").alias("of_two")), "pair", "left")
    lasts = shares.select(F.col("key").alias("label"), F.col("share").alias("of_last"))
    lookup = spread_lookup(pairs, lasts, "label", "pair").select(
        F.col("pair").alias(key), *[F.coalesce(c, F.lit(0.5)).alias(n) for c, n in (("of_last", last), ("of_two", two))]
    )
    found = spread_lookup(keyed, lookup, key, row, sizes.withColumnRenamed("pair", key), min_piece_rows=LEAST_PIECE)
    return found.select(*pages.columns, last, two)


def with_block_margin(pages: DataFrame, model: Trees, url: str = "url", out: str = "margin") -> DataFrame:
    """Add (or replace) ``out``: log-odds that the URL should be blocked, by the trees alone."""

    @F.arrow_udf("double")
    def margins(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for urls, hosts, paths, lasts, twos in batches:
            shares = np.stack([np.asarray(lasts), np.asarray(twos)], 1)
            x = feature_rows(urls.to_pylist(), hosts.to_pylist(), paths.to_pylist(), shares)
            yield pa.array(trees.margin(x), pa.float64())

    trees = Trees(model.base, model.nodes)  # what tasks need; the shares are in the rows
    last, two = free_name("_last", pages), free_name("_two", pages)
    margin = margins(F.col(url), host_of(F.col(url)), path_of(F.col(url)), F.col(last), F.col(two))
    return with_shares(pages, model.shares, url, (last, two)).withColumn(out, margin).drop(last, two)


def filter_urls(pages: DataFrame, model: Trees, url: str = "url", rules=RULES) -> DataFrame:
    """All rows with ``host``, ``path``, ``rule`` and ``verdict`` (existing columns of these names are replaced)."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    found, margin = rule_of(host, path, rules), free_name("_margin", pages)
    verdict = F.when(F.col(margin) > 0, BLOCK).otherwise(ALLOW)
    for rule, given in rules:
        verdict = F.when(found == rule, given).otherwise(verdict)
    scored = with_block_margin(pages, model, url, margin)
    return scored.withColumns({"host": host, "path": path, "rule": found, "verdict": verdict}).drop(margin)


def op7_url_filter(spark, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    return filter_urls(pages, train(pages)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLES: dict[str, str] = {}

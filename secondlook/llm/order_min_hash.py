"""Document fingerprints by order min-hash: minimal occurrence-numbered k-mers, hashed in text order.

The text falls into tokens without losing a character: up to 8 visible characters with the white space before
them. The k-mers are runs of K tokens; equal ones are numbered by occurrence. The hash of (k-mer, occurrence) says in
which of M buckets it takes part and how small it is there. Each bucket keeps its L smallest, puts them back in text
order and hashes the tuple. Two texts thus agree in a bucket only if they share its k-mers
in the same order, which tracks edit distance where a plain min-hash doesn't.

Only built-in Spark expressions are used. To number and sort few k-mers only, a first pass takes those whose own
hash lies below a bound that leaves about CANDIDATES of them; the hash of a (k-mer, occurrence) never lies below its
k-mer's, so all below the bound are known. If a bucket then lacks members, the text is done again with all k-mers;
the result doesn't depend on the bound.

Defined cases: null is as the empty text; empty texts have an empty fingerprint, likeness 1 to each other and 0 to
others; a text of fewer than K tokens is one k-mer. The document after the last one (by falling id, nulls last, then
by text) is the first. Other columns are left out of the result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secondlook.llm.common import table

K, M, L = 3, 32, 2
TOKEN = r"(?s)\s*+\S{1,8}|\s+"
CANDIDATES = 352
#: Rows per bucket of ids within which neighbours are found by one window task.
RANGE_ROWS = 2000
#: Beyond so many ranges they grow instead; their sort spills, and no range is held in memory as a whole.
MAX_RANGES = 4096

#: One long per k-mer: bucket (highest bits, with the sign), size, position, so that a plain sort brings buckets and
#: equal k-mers together.
_POSITION_BITS, _SIZE_BITS = 28, 31
_POSITION, _SIZE = (1 << _POSITION_BITS) - 1, ((1 << _SIZE_BITS) - 1) << _POSITION_BITS
_BUCKET = -(1 << (_POSITION_BITS + _SIZE_BITS))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _kmer_hash(data: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(data, at + k) for k in range(K)])


def _bucket(x: Column) -> Column:
    return F.shiftright(x, _POSITION_BITS + _SIZE_BITS)


def _kmer(x: Column) -> Column:
    return F.shiftright(x, _POSITION_BITS)


def _members(positions: Column, data: Column) -> Column:
    """The occurrence-numbered k-mers at the positions, sorted by bucket and size."""

    def member(i: Column) -> Column:
        return _kmer_hash(data, i).bitwiseAND(_BUCKET | _SIZE).bitwiseOR(i.cast("long"))

    def numbered(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (i > 0) & (_kmer(x) == _kmer(F.get(s, i - 1))))
        return F.when(F.size(same) > 0, F.sort_array(_renumbered(s))).otherwise(s)

    return let(F.sort_array(F.transform(positions, member)), numbered)


def _renumbered(s: Column) -> Column:
    """Give later occurrences of a k-mer, which stand behind the first in text order, members of their own.

    The first keeps the k-mer's bucket and size; a later one has a bucket of its own and a size that is no lower.
    """
    kmer = lambda i: _kmer(F.get(s, i))
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (kmer(i) != kmer(i - 1)))

    def later(x: Column, number: Column) -> Column:
        size = _kmer(x.bitwiseAND(_SIZE))
        more = F.pmod(F.xxhash64(_kmer(x), number, F.lit(1)), F.lit(1 << _SIZE_BITS) - size)
        bucket = F.xxhash64(_kmer(x), number).bitwiseAND(_BUCKET)
        return bucket.bitwiseOR(F.shiftleft(size + more, _POSITION_BITS)).bitwiseOR(x.bitwiseAND(_POSITION))

    def of_run(st: Column) -> Column:
        def one(a: Column, n: Column) -> Column:
            last = F.coalesce(F.get(st, n + 1), F.size(s)) - 1
            return F.transform(
                F.sequence(a, last), lambda i: F.when(i == a, F.get(s, i)).otherwise(later(F.get(s, i), i - a))
            )

        return F.flatten(F.transform(st, one))

    return let(starts, of_run)


def _least(members: Column) -> Column:
    """The L smallest members of each bucket, by bucket and size."""
    return F.filter(members, lambda x, i: (i < L) | (_bucket(F.get(members, i - L)) != _bucket(x)))


def _tuples(least: Column) -> Column:
    """One hash per bucket of its members in text order, null for a bucket without members."""

    def in_text_order(x: Column) -> Column:
        position = F.shiftleft(x.bitwiseAND(_POSITION), _SIZE_BITS)
        return x.bitwiseAND(_BUCKET).bitwiseOR(position).bitwiseOR(_kmer(x.bitwiseAND(_SIZE)))

    def of(s: Column) -> Column:
        ends = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == F.size(s) - 1) | (_bucket(F.get(s, i + 1)) != _bucket(F.get(s, i)))
        )

        def mark(i: Column) -> Column:
            bucket = _bucket(F.get(s, i))
            own = [F.when(_bucket(F.get(s, i - k)) == bucket, F.get(s, i - k).bitwiseAND((1 << _SIZE_BITS) - 1)) for k in range(L)]
            return F.struct(bucket.alias("b"), F.xxhash64(*own).alias("h"))

        def spread(marks: Column) -> Column:
            every = F.sequence(F.lit(-M // 2).cast("long"), F.lit(M // 2 - 1).cast("long"))
            sparse = F.transform(every, lambda j: F.get(F.filter(marks, lambda m: m["b"] == j), F.lit(0))["h"])
            return F.when(F.size(marks) == M, F.transform(marks, lambda m: m["h"])).otherwise(sparse)

        return let(F.transform(ends, mark), spread)

    nothing = F.array_repeat(F.lit(None).cast("long"), M)
    return F.when(F.size(least) == 0, nothing).otherwise(let(F.sort_array(F.transform(least, in_text_order)), of))


def signature(text: Column) -> Column:
    """M numbers, some null for short texts; all null for an empty one."""

    def of(data: Column) -> Column:
        n = F.size(data)
        last = F.greatest(n - (K - 1), F.lit(1))
        every = F.when(n > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
        bound = F.floor(F.lit(float(CANDIDATES << _SIZE_BITS)) / last).cast("long") * (1 << _POSITION_BITS)

        def bounded(limit: Column) -> Column:
            few = F.filter(every, lambda i: _kmer_hash(data, i).bitwiseAND(_SIZE) < limit)
            return let(
                _members(few, data),
                lambda s: F.filter(_least(s), lambda x: x.bitwiseAND(_SIZE) < limit),
            )

        def whole() -> Column:
            return let(_members(every, data), _least)

        sure = F.when(last > CANDIDATES * 4 // 3, let(bound, bounded))
        chosen = let(sure, lambda s: F.when(F.size(s) == M * L, s).otherwise(whole()))
        return let(chosen, _tuples)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), of)


def fingerprint(sign: Column) -> Column:
    """The signature as text: 8 hex digits per bucket, dashes for one without members; '' if all are."""
    part = lambda x: F.coalesce(F.substring(F.lpad(F.hex(x), 16, "0"), 9, 8), F.lit("-" * 8))
    return F.when(F.exists(sign, lambda x: x.isNotNull()), F.array_join(F.transform(sign, part), "")).otherwise("")


def likeness(one: Column, other: Column) -> Column:
    """Share of the buckets with members in either text in which both have the same tuple; 1 if there are none."""
    marks = F.zip_with(
        one, other, lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a == b, F.lit(False)))
    )
    used = F.filter(marks, lambda m: m.isNotNull())
    return let(
        used,
        lambda u: F.when(F.size(u) == 0, 1.0).otherwise(
            F.size(F.filter(u, lambda m: m)).cast("double") / F.size(u)
        ),
    )


def with_next(documents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add ``next_<c>`` for the columns: those of the next row by falling key, of the first row after the last.

    The keys are dealt into ranges of about RANGE_ROWS rows, a window finds the neighbours within each, and each
    range's last row gets the first row of the range below by a join over one row per range.
    """
    n = documents.agg(F.count("*").alias("n")).first().n
    pieces = min(MAX_RANGES, -(-n // RANGE_ROWS))
    ranged = documents.withColumn("_range", F.coalesce(-_place(F.col(key), _edges(documents, key, pieces)), F.lit(1)))
    # Equal keys are told apart by their texts; rows that are equal altogether may stand in any order.
    order = [F.col(key).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in columns]]
    window = Window.partitionBy("_range").orderBy(*order)
    nexts = F.struct(*columns)
    ahead = ranged.withColumn("_next", F.lead(nexts).over(window))
    heads = ranged.groupBy("_range").agg(F.min(F.struct((-F.col(key)).alias("_k"), *columns)).alias("_head"))
    heads = heads.select(F.col("_range").alias("_at"), F.struct(*[F.col(f"_head.{c}") for c in columns]).alias("_first"))
    links = heads.select(
        "_first",
        F.coalesce(F.lag("_at").over(Window.orderBy("_at")), F.max("_at").over(Window.partitionBy())).alias("_range"),
    )
    found = ahead.join(links, "_range", "left")
    return found.withColumn("_next", F.coalesce("_next", "_first")).select(
        "*", *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns]
    ).drop("_next", "_first", "_range")


def _edges(documents: DataFrame, key: str, pieces: int) -> list:
    """At most ``pieces`` distinct bounds between ranges of about equally many rows."""
    if pieces < 2:
        return []
    points = [i / pieces for i in range(1, pieces)]
    found = documents.agg(F.percentile_approx(key, points, 10 * pieces).alias("e")).first().e
    return sorted(set(found or []))


def _place(value: Column, edges: list, step: int = 64) -> Column:
    """How many edges lie below the value; looked up among every ``step``-th edge first."""
    if not edges:
        return F.when(value.isNotNull(), 0)
    below = lambda some: F.size(F.filter(some, lambda e: e < value))
    groups = F.array(*[F.array(*map(F.lit, edges[i : i + step])) for i in range(0, len(edges), step)])
    lasts = F.array(*[F.lit(edges[min(i + step, len(edges)) - 1]) for i in range(0, len(edges), step)])
    return F.when(value.isNotNull(), let(below(lasts), lambda g: g * step + F.coalesce(below(F.get(groups, g)), F.lit(0))))


def edited(text: Column, following: Column) -> Column:
    """The text with the last half of its characters replaced by as many of the next text, or all it has."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(documents: DataFrame) -> DataFrame:
    """Per document: fingerprints of its text and of the edited text, and how alike they and its neighbour's are."""
    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = own.withColumn("sign", signature(F.col("text")))
    both = with_next(signed, "doc_id", ["text", "sign"])
    changed = both.withColumn("edit", edited(F.col("text"), F.col("next_text")))
    compared = changed.withColumn("edit_sign", signature(F.col("edit")))
    return compared.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sign")).alias("fingerprint"),
        fingerprint(F.col("edit_sign")).alias("edited_fingerprint"),
        likeness(F.col("sign"), F.col("edit_sign")).alias("near_edited"),
        likeness(F.col("sign"), F.col("next_sign")).alias("near_next"),
    )


def op8_order_min_hash(spark, d: str) -> DataFrame:
    return fingerprints(table(spark, d, "documents"))


QUERIES = {"op8_order_min_hash": op8_order_min_hash}
ORACLES: dict[str, str] = {}

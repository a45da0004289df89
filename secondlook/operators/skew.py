"""Looking up one row per key for facts whose keys may be very uneven."""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key counts as hot above 1/PIECES of all rows, so there are never more than PIECES hot keys.
PIECES = 1000
# Below this many rows a key is never worth splitting.
MIN_PIECE_ROWS = 100_000
# No task gets more rows of one key than this, however large the table is. 10**11 rows have at most 25,000 such keys.
MAX_PIECE_ROWS = 4_000_000

Names = str | tuple[str, ...]


def names(columns: Names) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def free_name(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores in front until no table has such a column (whatever its case)."""
    taken = {c.lower() for table in tables for c in table.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def key_sizes(facts: DataFrame, key: Names) -> DataFrame:
    """(key, n_rows), counted map-side before the shuffle."""
    return facts.groupBy(*names(key)).agg(F.count("*").alias("n_rows"))


def spread_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    key: Names,
    row_id: Names,
    sizes: DataFrame | None = None,
    how: str = "left",
    pieces: int = PIECES,
    min_piece_rows: int = MIN_PIECE_ROWS,
    max_piece_rows: int = MAX_PIECE_ROWS,
) -> DataFrame:
    """Join every fact with the one lookup row of its key; hot keys are split over several tasks.

    A key with more than a ``pieces``-th of all rows, or with more than ``max_piece_rows``, is hot. Its facts are
    dealt out over ceil(rows / piece) salts by a hash of ``row_id``, and its single lookup row is repeated once per
    salt. By counting, at most max(``pieces``, rows / ``max_piece_rows``) keys can be hot and at most twice as many
    rows are added, so the table of hot keys is the one thing here that may be broadcast by force. No row is
    dropped: keys that are not hot use salt 0 on both sides. Facts with a null in the key find nothing and are dealt
    out over ``pieces`` salts. Works for left, inner, semi and anti joins. Helper columns take names that neither
    table has.
    """
    keys = names(key)
    salt, n_salts = (free_name(name, facts, lookup) for name in ("_salt", "_n_salts"))
    if sizes is None:
        sizes = key_sizes(facts, key)
        total = facts.agg(F.count("*")).scalar()  # reads no column of the facts
    else:
        total = sizes.agg(F.sum("n_rows")).scalar()
    share = F.least(F.ceil(total / F.lit(pieces)), F.lit(max_piece_rows))
    piece = F.greatest(share, F.lit(min_piece_rows))
    no_key = reduce(or_, [F.col(k).isNull() for k in keys])
    hot = sizes.filter(F.col("n_rows") > piece).select(*keys, F.ceil(F.col("n_rows") / piece).alias(n_salts))
    hot = F.broadcast(hot)
    own_salts = F.when(no_key, F.lit(pieces)).otherwise(F.coalesce(n_salts, F.lit(1)))
    salted_facts = (
        facts.join(hot, keys, "left")
        .withColumn(salt, F.pmod(F.xxhash64(*names(row_id)), own_salts))
        .drop(n_salts)
    )
    salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce(n_salts, F.lit(1)) - 1)
    salted_lookup = lookup.join(hot, keys, "left").withColumn(salt, F.explode(salts)).drop(n_salts)
    return salted_facts.join(salted_lookup, [*keys, salt], how).drop(salt)

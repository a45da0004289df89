"""The review cache as a table: lookups and the maintenance that yields the next snapshot.

A cache is a DataFrame of ``schemas.CACHE`` with at most one row per ``prompt_hash``. Maintenance returns
a new snapshot instead of changing rows; writing it is up to the caller.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondlook import fixed, schemas
from secondlook.operators.skew import spread_lookup

CACHED_FIELDS = [f.name for f in schemas.CACHE_RESPONSE if f.name != "prompt_hash"]


def not_expired(now: float, ttl_seconds: float = fixed.CACHE_TTL_SECONDS) -> Column:
    """Entries exactly ``ttl_seconds`` old still live; 0 means no expiry."""
    if not ttl_seconds:
        return F.lit(True)
    return F.col("created_at") >= F.lit(float(now) - ttl_seconds)


def ttl_filter(cache: DataFrame, now: float, ttl_seconds: float = fixed.CACHE_TTL_SECONDS) -> DataFrame:
    return cache.filter(not_expired(now, ttl_seconds))


def cache_identity(cache: DataFrame, version: str, model: str) -> DataFrame:
    """Entries written under this prompt version and model."""
    return cache.filter((F.col("version") == version) & (F.col("model") == model))


def live_entries(
    cache: DataFrame,
    now: float,
    version: str = fixed.PROMPT_VERSION,
    model: str = fixed.DEFAULT_MODEL,
    ttl_seconds: float = fixed.CACHE_TTL_SECONDS,
) -> DataFrame:
    """Entries that may answer a request; all three tests reach the scan."""
    return ttl_filter(cache_identity(cache, version, model), now, ttl_seconds).filter(
        F.col("response").isNotNull()
    )


def cache_lookup(hashed: DataFrame, live: DataFrame, row_id: str = "seq", sizes=None) -> DataFrame:
    """All rows with the cached review fields, null where there is none, and ``cache_hit``."""
    cached = [F.col(f"response.{name}") for name in CACHED_FIELDS]
    fields = live.select("prompt_hash", F.lit(True).alias("_hit"), *cached)
    found = spread_lookup(hashed, fields, "prompt_hash", row_id, sizes)
    return found.withColumn("cache_hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def cache_misses(hashed: DataFrame, live: DataFrame, row_id: str | None = None) -> DataFrame:
    """Rows without a live entry. Give ``row_id`` if prompts repeat, so that a hot one gets split."""
    known = live.select("prompt_hash")
    if row_id is None:
        return hashed.join(known, "prompt_hash", "left_anti")
    return spread_lookup(hashed, known, "prompt_hash", row_id, how="left_anti")


def distinct_requests(
    hashed: DataFrame, carry=("prompt",), row_id: str = "seq", keys=("prompt_hash",)
) -> DataFrame:
    """One scoring request per distinct prompt (or ``keys``), with the number of rows that wait for it.

    The carried columns come from the first row of the prompt. Duplicates shrink map-side, so a prompt
    that a third of all rows share reaches the reducer once per map task.
    """
    first = F.min_by(F.struct(row_id, *carry), row_id).alias("_first")
    return hashed.groupBy(*keys).agg(F.count("*").alias("n_rows"), first).select(*keys, "n_rows", "_first.*")


def cache_entries(
    reviews: DataFrame, now: float, version: str = fixed.PROMPT_VERSION, model: str = fixed.DEFAULT_MODEL
) -> DataFrame:
    """Cache rows of successful fresh reviews (one row per prompt).

    Neither failures are stored nor answers that depend on more than the prompt (``cacheable`` is false).
    """
    if "cacheable" in reviews.columns:
        reviews = reviews.filter("cacheable")
    fields = [F.col(n).cast(schemas.CACHE_RESPONSE[n].dataType).alias(n)
              for n in schemas.CACHE_RESPONSE.names]
    return reviews.filter("success AND NOT cache_hit").select(
        "prompt_hash",
        F.lit(version).alias("version"),
        F.lit(model).alias("model"),
        F.struct(*fields).alias("response"),
        F.lit(float(now)).alias("created_at"),
        F.lit(0).cast("bigint").alias("hit_count"),
    )


def cache_upsert(cache: DataFrame, fresh: DataFrame, key=("prompt_hash",)) -> DataFrame:
    """Insert or replace: per key the newest entry survives, a new one wins ties and starts at 0 hits.

    The key is the hash alone, so an entry of another version or model is replaced too; pass
    ``("prompt_hash", "version", "model")`` to keep them side by side.
    """
    new = fresh.withColumn("hit_count", F.lit(0).cast("bigint")).select(*schemas.CACHE.names)
    # The trailing columns only make the choice between equally old entries reproducible.
    rank = F.struct("created_at", "version", "model", "response")
    kept = F.max_by(F.struct(*schemas.CACHE.names), rank)
    newest = new.groupBy(*key).agg(kept.alias("_kept")).select("_kept.*")
    # The stored responses neither sort nor meet the new ones: only keys are compared.
    rest = cache.select(*schemas.CACHE.names).join(newest.select(*key), list(key), "left_anti")
    return rest.select(*schemas.CACHE.names).unionByName(newest)


def cache_expire(cache: DataFrame, now: float, ttl_seconds: float = fixed.CACHE_TTL_SECONDS) -> DataFrame:
    return ttl_filter(cache, now, ttl_seconds)


def cache_touch(cache: DataFrame, hit_hashes: DataFrame, version: str, model: str) -> DataFrame:
    """Add one hit to every entry that answered this batch, however many rows it answered."""
    hits = hit_hashes.select("prompt_hash").distinct().withColumn("_hit", F.lit(1))
    mine = (F.col("version") == version) & (F.col("model") == model)
    return (
        cache.join(hits, "prompt_hash", "left")
        .withColumn("hit_count", F.col("hit_count") + F.when(mine, F.coalesce("_hit", F.lit(0))).otherwise(0))
        .select(*schemas.CACHE.names)
    )


def cache_clear(cache: DataFrame) -> DataFrame:
    return cache.filter(F.lit(False))


def cache_stats(requests: DataFrame, live: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row of counters for a batch.

    ``requests`` is one row per prompt with ``n_rows``; ``stored`` holds the hashes written by the batch
    (all missed prompts when left out).
    """
    seen = requests.select("prompt_hash", "n_rows").join(
        live.select("prompt_hash", F.lit(True).alias("_live")), "prompt_hash", "left"
    )
    if stored is None:
        kept = F.col("_live").isNull()
    else:
        seen = seen.join(
            stored.select("prompt_hash", F.lit(True).alias("_stored")), "prompt_hash", "left"
        )
        kept = F.col("_stored").isNotNull() & F.col("_live").isNull()
    live_row = F.col("_live").isNotNull()
    counted = seen.agg(
        F.coalesce(F.sum(F.when(live_row, F.col("n_rows"))), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(~live_row, F.col("n_rows"))), F.lit(0)).alias("misses"),
        F.count_if(live_row).alias("persistent_hits"),
        F.count_if(live_row | kept).alias("cached_prompts"),
    )
    rows = F.col("hits") + F.col("misses")
    rate = F.when(rows > 0, F.col("hits") / rows * 100).otherwise(F.lit(0.0))
    return counted.withColumn("hit_rate", rate)


def response_to_json(cache: DataFrame) -> DataFrame:
    """Replace the response struct by JSON text, for export."""
    keep = {"ignoreNullFields": "false"}
    return cache.withColumn("response", F.to_json("response", keep))


def response_from_json(cache: DataFrame) -> DataFrame:
    """Read responses from JSON text; bad JSON, non-objects and empty objects become null (a miss)."""
    as_map = F.from_json("response", "map<string,string>")
    usable = as_map.isNotNull() & (F.size(as_map) > 0)
    return cache.withColumn(
        "response", F.when(usable, F.from_json("response", schemas.CACHE_RESPONSE))
    )

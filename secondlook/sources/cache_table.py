"""The review cache as a stored table, one folder per prompt version and day of creation.

Upkeep rewrites only the folders whose entries change: expiry drops whole days and rewrites the day it cuts, a hit or a
new answer rewrites the days it meets. What replaces a folder is staged first, so nothing reads a folder that is being
replaced, and every step may be repeated after a failure. One writer at a time.
"""

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secondlook import fixed, schemas
from secondlook.operators import cache as ca
from secondlook.session import StagedFolders, remove_folder, stage

DAY_SECONDS = 86_400
FOLDERS = ("version", "day")
STORED = T.StructType([*schemas.CACHE.fields, T.StructField("day", T.LongType())])


def day_of(created_at: Column) -> Column:
    """Whole days since the epoch; null for null."""
    return F.floor(created_at / DAY_SECONDS).cast("bigint")


def with_day(entries: DataFrame) -> DataFrame:
    return entries.select(*schemas.CACHE.names).withColumn("day", day_of(F.col("created_at")))


def create_cache(cache: DataFrame, path: str) -> None:
    """Store a first snapshot."""
    with_day(cache).repartition(*FOLDERS, F.pmod(F.xxhash64("prompt_hash"), F.lit(64))).write.partitionBy(*FOLDERS).parquet(path)


def stored_entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries with their ``day``."""
    return spark.read.schema(STORED).parquet(path).select(*STORED.names)


def open_cache(
    spark: SparkSession, path: str, now: float | None = None, ttl_seconds: float = fixed.CACHE_TTL_SECONDS
) -> DataFrame:
    """The stored cache; with ``now``, the entries that still live, and expired days are never listed for the scan."""
    entries = stored_entries(spark, path)
    if now is not None and ttl_seconds:
        entries = ca.ttl_filter(entries.filter(F.col("day") >= day_of(F.lit(now - ttl_seconds))), now, ttl_seconds)
    return entries.select(*schemas.CACHE.names)


def _folders(entries: DataFrame) -> list[tuple[str | None, int | None]]:
    """The folders that these entries belong to: at most versions times days."""
    return sorted((tuple(r) for r in entries.select(*FOLDERS).distinct().collect()), key=str)


def _inside(folders: list[tuple[str | None, int | None]]) -> Column:
    """Entries of these folders, as a test that prunes folders."""
    chosen = F.lit(False)
    for version in {v for v, _ in folders}:
        days = [d for v, d in folders if v == version]
        in_days = F.col("day").isin([d for d in days if d is not None])
        if None in days:
            in_days = in_days | F.col("day").isNull()
        chosen = chosen | (F.col("version").eqNullSafe(version) & in_days)
    return chosen


def _drop(spark: SparkSession, path: str, folders: list) -> None:
    """Delete the folders; where they lie is read from the files in them."""
    if not folders:
        return
    files = spark.read.schema(STORED).parquet(path).filter(_inside(folders)).select(F.col("_metadata.file_path").alias("file"))
    for r in files.select(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).distinct().collect():
        remove_folder(spark, unquote(r.folder))  # file paths are given as URIs


def _replace(spark: SparkSession, path: str, folders: list, entries: DataFrame) -> None:
    """Put ``entries`` in the place of all entries of ``folders``; other folders keep their files."""
    staged = StagedFolders(spark)
    with staged:
        kept = stage(with_day(entries), "cache-upkeep")
    filled = _folders(kept)
    spread = kept.repartition(*FOLDERS, F.pmod(F.xxhash64("prompt_hash"), F.lit(64)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(path)
    _drop(spark, path, [f for f in folders if f not in filled])
    staged.remove()


def upsert_stored(spark: SparkSession, path: str, fresh: DataFrame, key=("prompt_hash",)) -> list:
    """``cache_upsert`` on the stored table. Returns the folders that it rewrote.

    These are the folders of the new entries and of the entries they replace.
    """
    staged = StagedFolders(spark)
    with staged:
        new = stage(with_day(fresh), "cache-fresh")
    stored = stored_entries(spark, path)
    replaced = stored.select(*dict.fromkeys((*key, *FOLDERS))).join(new.select(*key).distinct(), list(key), "left_semi")
    folders = sorted({*_folders(new), *_folders(replaced)}, key=str)
    if folders:
        _replace(spark, path, folders, ca.cache_upsert(stored.filter(_inside(folders)), new, key))
    staged.remove()
    return folders


def touch_stored(spark: SparkSession, path: str, hit_hashes: DataFrame, version: str, model: str) -> list:
    """``cache_touch`` on the stored table. Returns the folders that it rewrote, those with an entry that was hit.

    Hits are added, so a call that failed half-way counts the hits of the folders it had written again when repeated.
    """
    staged = StagedFolders(spark)
    with staged:
        hits = stage(hit_hashes.select("prompt_hash").distinct(), "cache-hits")
    stored = stored_entries(spark, path)
    mine = ca.cache_identity(stored, version, model).select("prompt_hash", *FOLDERS)
    folders = _folders(mine.join(hits, "prompt_hash", "left_semi"))
    if folders:
        _replace(spark, path, folders, ca.cache_touch(stored.filter(_inside(folders)), hits, version, model))
    staged.remove()
    return folders


def expire_stored(spark: SparkSession, path: str, now: float, ttl_seconds: float = fixed.CACHE_TTL_SECONDS) -> list:
    """``cache_expire`` on the stored table. Returns the folders that it deleted or rewrote.

    Days before the limit are deleted unread; of the limit's own day the expired entries go. Entries without a time go too.
    """
    if not ttl_seconds:
        return []
    limit = day_of(F.lit(now - ttl_seconds))
    stored = stored_entries(spark, path)
    past = _folders(stored.filter((F.col("day") < limit) | F.col("day").isNull()))
    _drop(spark, path, past)
    own_day = stored_entries(spark, path).filter(F.col("day") == limit)
    cut = _folders(own_day.filter(~ca.not_expired(now, ttl_seconds)))
    if cut:
        _replace(spark, path, cut, ca.ttl_filter(own_day.filter(_inside(cut)), now, ttl_seconds))
    return [*past, *cut]

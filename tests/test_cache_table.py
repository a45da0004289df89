import pathlib

from pyspark.sql import functions as F

from secondlook import schemas
from secondlook.operators import cache as ca
from secondlook.sources import cache_table as ct

DAY = ct.DAY_SECONDS
NOW = 100.5 * DAY
TTL = 10.0 * DAY


def entry(prompt_hash, days, version="v1", model="m", hits=0, verdict="Correct"):
    response = (verdict, "r", None, "e", True, prompt_hash, 5, True)
    return (prompt_hash, version, model, response, None if days is None else NOW - days * DAY, hits)


ENTRIES = [
    entry("a", 0), entry("b", 0, "v/2 x"), entry("c", 3), entry("d", 3, hits=4), entry("e", 10), entry("f", 10.2),
    entry("g", 10.4, "v/2 x"), entry("h", 40), entry("i", None), entry("j", 5, None),
]


def table(spark, rows):
    return spark.createDataFrame(rows, schemas.CACHE)


def stored(spark, path):
    return sorted(map(str, ct.open_cache(spark, path).collect()))


def files(path):
    return {str(f.relative_to(path)) for f in pathlib.Path(path).rglob("*.parquet")}


def in_day(names, days):
    return {n for n in names if f"day={int((NOW - days * DAY) // DAY)}/" in n}


def test_expiry_deletes_days_and_rewrites_one(spark, tmp_path):
    path = str(tmp_path / "cache")
    ct.create_cache(table(spark, ENTRIES), path)
    before = files(path)
    changed = ct.expire_stored(spark, path, NOW, TTL)
    assert set(changed) == {("v1", 60), ("v1", None), ("v1", 90), ("v/2 x", 90)}
    assert stored(spark, path) == sorted(map(str, ca.cache_expire(table(spark, ENTRIES), NOW, TTL).collect()))
    untouched = in_day(before, 0) | in_day(before, 3) | in_day(before, 5)
    assert untouched and untouched <= files(path) and not (before - untouched) & files(path)
    assert ct.expire_stored(spark, path, NOW, TTL) == [] and ct.expire_stored(spark, path, NOW, 0) == []


def test_a_hit_rewrites_its_folder_alone(spark, tmp_path):
    path = str(tmp_path / "cache")
    ct.create_cache(table(spark, ENTRIES), path)
    before = files(path)
    hits = spark.createDataFrame([("d",), ("d",), ("b",), ("x",)], "prompt_hash string")
    assert ct.touch_stored(spark, path, hits, "v1", "m") == [("v1", 97)]
    assert stored(spark, path) == sorted(map(str, ca.cache_touch(table(spark, ENTRIES), hits, "v1", "m").collect()))
    assert before - files(path) == in_day(before, 3)
    assert ct.touch_stored(spark, path, hits.limit(0), "v1", "m") == []


def test_upsert_rewrites_the_days_it_meets(spark, tmp_path):
    path = str(tmp_path / "cache")
    ct.create_cache(table(spark, ENTRIES), path)
    before = files(path)
    fresh = table(spark, [entry("h", 0, verdict="Incorrect"), entry("new", 0), entry("c", 1)])
    wanted = sorted(map(str, ca.cache_upsert(table(spark, ENTRIES), fresh).collect()))
    for _ in range(2):  # a repeated call changes nothing
        ct.upsert_stored(spark, path, fresh)
        assert stored(spark, path) == wanted
    assert before - files(path) == {n for n in in_day(before, 0) if "version=v1/" in n} | in_day(before, 3) | in_day(before, 40)
    assert not (tmp_path / "cache" / "version=v1" / "day=60").exists()
    assert ct.upsert_stored(spark, path, fresh.limit(0)) == []


def test_expired_days_are_not_scanned(spark, tmp_path):
    path = str(tmp_path / "cache")
    ct.create_cache(table(spark, ENTRIES), path)
    live = ct.open_cache(spark, path, NOW, TTL)
    assert sorted(r.prompt_hash for r in live.collect()) == ["a", "b", "c", "d", "e", "j"]
    plan = live._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in pruned and ">= 90" in pruned
    assert live.filter(F.col("version") == "v1").count() == 4

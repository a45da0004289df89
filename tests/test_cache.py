import pytest
from pyspark.sql import functions as F

from secondlook import schemas
from secondlook.operators import cache as ca
from secondlook.sources import tables

NOW = 1_000_000.0
TTL = 3600.0


def entry(prompt_hash, version="v1.1", model="m1", age=0.0, hits=0, verdict="Correct"):
    response = (verdict, "r", None, "e", True, prompt_hash, 5, True)
    return (prompt_hash, version, model, response, NOW - age, hits)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.CACHE)


def hashes(df):
    return sorted(r["prompt_hash"] for r in df.collect())


def test_ttl_is_strict_and_zero_means_forever(spark):
    cache = table(spark, entry("a", age=TTL), entry("b", age=TTL + 1), entry("c"))
    assert hashes(ca.ttl_filter(cache, NOW, TTL)) == ["a", "c"]
    assert hashes(ca.ttl_filter(cache, NOW, 0)) == ["a", "b", "c"]
    assert hashes(ca.cache_expire(cache, NOW, TTL)) == ["a", "c"]


def test_live_entries_need_version_model_and_response(spark):
    broken = ("e", "v1.1", "m1", None, NOW, 0)
    cache = table(spark, entry("a"), entry("b", version="v1.0"), entry("c", model="m2"), entry("d", age=TTL + 1), broken)
    assert hashes(ca.live_entries(cache, NOW, "v1.1", "m1", TTL)) == ["a"]


def test_lookup_and_misses(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "a"), (2, "x")], "seq bigint, prompt_hash string")
    live = table(spark, entry("a"))
    got = {r["seq"]: (r["cache_hit"], r["verdict"]) for r in ca.cache_lookup(rows, live).collect()}
    assert got == {0: (True, "Correct"), 1: (True, "Correct"), 2: (False, None)}
    assert hashes(ca.cache_misses(rows, live)) == ["x"]


def test_counters_under_duplicates(spark):
    requests = spark.createDataFrame([("a", 3), ("b", 1), ("x", 2), ("y", 1)], "prompt_hash string, n_rows bigint")
    live = table(spark, entry("a"), entry("b"), entry("unused"))
    row = ca.cache_stats(requests, live).first().asDict()
    assert row == {"hits": 4, "misses": 3, "persistent_hits": 2, "cached_prompts": 4, "hit_rate": 4 / 7 * 100}
    stored = spark.createDataFrame([("x",)], "prompt_hash string")
    assert ca.cache_stats(requests, live, stored).first()["cached_prompts"] == 3
    empty = ca.cache_stats(requests.filter("false"), live).first().asDict()
    assert empty == {"hits": 0, "misses": 0, "persistent_hits": 0, "cached_prompts": 0, "hit_rate": 0.0}


def test_touch_counts_each_hash_once(spark):
    cache = table(spark, entry("a", hits=2), entry("b"), entry("c", model="m2"))
    hits = spark.createDataFrame([("a",), ("a",), ("a",), ("c",)], "prompt_hash string")
    got = {r["prompt_hash"]: r["hit_count"] for r in ca.cache_touch(cache, hits, "v1.1", "m1").collect()}
    assert got == {"a": 3, "b": 0, "c": 0}


def test_upsert_replaces_by_hash_and_is_idempotent(spark):
    cache = table(spark, entry("a", version="v1.0", hits=9), entry("b"))
    fresh = table(spark, entry("a", verdict="Incorrect", age=50), entry("n"))
    once = ca.cache_upsert(cache, fresh)
    got = {r["prompt_hash"]: (r["version"], r["hit_count"], r["response"]["verdict"]) for r in once.collect()}
    assert got == {"a": ("v1.1", 0, "Incorrect"), "b": ("v1.1", 0, "Correct"), "n": ("v1.1", 0, "Correct")}
    twice = ca.cache_upsert(once, fresh)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    both = ca.cache_upsert(cache, fresh, ("prompt_hash", "version", "model"))
    assert hashes(both) == ["a", "a", "b", "n"]


def test_clear(spark):
    assert ca.cache_clear(table(spark, entry("a"))).count() == 0


@pytest.mark.parametrize("text", ["{", "[]", "{}", "3", "null", "", "not json", None])
def test_unusable_json_is_a_miss(spark, text):
    cache = table(spark, entry("a"))
    damaged = ca.response_to_json(cache).withColumn("response", F.lit(text).cast("string"))
    assert ca.live_entries(ca.response_from_json(damaged), NOW, "v1.1", "m1", TTL).count() == 0


def test_json_round_trip(spark):
    cache = table(spark, entry("a"), entry("b", verdict="Incorrect"))
    back = ca.response_from_json(ca.response_to_json(cache)).select(*cache.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, cache.collect()))


def test_snapshot_is_pruned_by_version(spark, tmp_path):
    path = str(tmp_path / "cache")
    tables.write_cache(table(spark, entry("a"), entry("b", version="v1.0")), path)
    live = ca.live_entries(tables.read_cache(spark, path), NOW, "v1.1", "m1", TTL)
    assert hashes(live) == ["a"]
    plan = live._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(version" in plan
    assert "GreaterThanOrEqual(created_at" in plan


def test_distinct_requests_take_the_first_row(spark):
    rows = spark.createDataFrame([(5, "a", "p5"), (2, "a", "p2"), (9, "b", "p9")], "seq bigint, prompt_hash string, prompt string")
    for n in (1, 16):
        got = sorted(tuple(r) for r in ca.distinct_requests(rows.repartition(n)).collect())
        assert got == [("a", 2, 2, "p2"), ("b", 1, 9, "p9")]

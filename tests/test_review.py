import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from secondlook import fixed, schemas
from secondlook.operators import cache as ca
from secondlook.operators import prompts, review, scoring, skew

ROWS = [
    ("delete me", "Erasure", 0.9, "Erasure", False),
    ("delete me", "Erasure", 0.9, "Erasure", False),
    ("send my data", "Erasure", 0.6, "Access Request", True),
    ("hello", "Complaint", 0.7, None, True),
    ("hi", "Complaint", 0.8, None, None),
]


def by_seq(results):
    return {r["seq"]: r for r in results.collect()}


def test_prompt_holds_input_labels_and_format(make_samples, taxonomy):
    for compact in (False, True):
        prompt = prompts.build_prompt(make_samples(ROWS[:1]), taxonomy, compact).first()["prompt"]
        for piece in ("delete me", "Erasure", "0.9", "VERDICT:", "REASONING:", "SUGGESTED_LABEL:", "EXPLANATION:", "General Inquiry"):
            assert piece in prompt
    longest = max((d for _, d in fixed.DEFAULT_TAXONOMY), key=len)
    assert longest[:40] in prompt and longest[:41] not in prompt


def test_own_template_and_missing_columns(make_samples, taxonomy):
    own = prompts.build_prompt(make_samples(ROWS[:1]), taxonomy, template="{{{text}}}|{pred_label}").first()["prompt"]
    assert own == "{delete me}|Erasure"
    with pytest.raises(ValueError, match="confidence"):
        prompts.build_prompt(make_samples(ROWS).drop("confidence"), taxonomy)


def test_prompt_hash(make_samples, taxonomy):
    rows = prompts.with_prompt_hash(make_samples(ROWS), taxonomy).orderBy("seq").collect()
    hashes = [r["prompt_hash"] for r in rows]
    assert hashes[0] == hashes[1] and len(set(hashes)) == 4 and all(len(h) == 16 for h in hashes)
    import hashlib

    assert hashes[0] == hashlib.md5(f"v1.1:{rows[0]['prompt']}".encode()).hexdigest()[:16]
    newer = prompts.with_prompt_hash(make_samples(ROWS[:1]), taxonomy, version="v2").first()["prompt_hash"]
    salted = prompts.with_prompt_hash(make_samples(ROWS[:1]), taxonomy, salt="strict").first()["prompt_hash"]
    assert len({hashes[0], newer, salted}) == 3


def test_mock_review(make_samples):
    got = by_seq(review.mock_review(make_samples(ROWS)))
    assert (got[0]["verdict"], got[0]["suggested_label"]) == ("Correct", None)
    assert (got[2]["verdict"], got[2]["suggested_label"]) == ("Incorrect", "Access Request")
    assert got[2]["reasoning"] == "The text indicates Access Request, not Erasure."
    assert got[2]["explanation"] == "Classification as Access Request."
    assert got[3]["suggested_label"] == "Unknown"
    assert got[4]["verdict"] == "Correct" and got[4]["explanation"] == "Classification as Complaint."
    bare = review.mock_review(make_samples(ROWS).drop("ground_truth", "is_misclassified"))
    assert {r["verdict"] for r in bare.collect()} == {"Correct"}


def test_batch_gives_every_sample_its_review(make_samples, taxonomy):
    batch = review.review_batch(make_samples(ROWS), taxonomy)
    got = by_seq(batch.results)
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert batch.results.columns == schemas.RESULTS.names
    assert batch.reviews.count() == 4
    assert got[0]["prompt_hash"] == got[1]["prompt_hash"] and got[1]["sample_id"] == "demo_1_0001"
    # "Unknown" is no label of the taxonomy
    assert (got[3]["verdict"], got[3]["suggested_label"]) == ("Uncertain", None)
    assert got[3]["_validation_issues"] == ["Rejected unknown label 'Unknown'", fixed.ISSUE_DOWNGRADE]
    assert got[0]["_validation_issues"] is None and got[0]["_untrusted"] and not got[0]["cache_hit"]


def test_batch_without_optional_columns_and_empty_batch(make_samples, taxonomy):
    bare = make_samples(ROWS).drop("ground_truth", "is_misclassified")
    assert review.review_batch(bare, taxonomy).results.count() == 5
    assert review.review_batch(make_samples([]), taxonomy).results.count() == 0


def test_second_run_is_served_from_the_cache(spark, make_samples, taxonomy):
    samples = make_samples(ROWS)
    empty = spark.createDataFrame([], schemas.CACHE)
    answer = review.scoring_reviewer(lambda: lambda prompts_: ["VERDICT: Correct\nREASONING: fine"] * len(prompts_))
    mocked = review.review_batch(samples, taxonomy, cache=empty, now=100.0)
    assert ca.cache_entries(mocked.reviews, 100.0).count() == 0  # such answers depend on more than the prompt
    first = review.review_batch(samples, taxonomy, answer, cache=empty, now=100.0)
    cache = ca.cache_upsert(empty, ca.cache_entries(first.reviews, 100.0))
    assert cache.count() == 4

    def refuse(prompts_):
        raise AssertionError("must not be asked")

    again = review.review_batch(samples, taxonomy, review.scoring_reviewer(lambda: refuse), cache=cache, now=200.0)
    one, two = by_seq(first.results), by_seq(again.results)
    assert all(r["cache_hit"] for r in two.values())
    for seq in one:
        for name in ("verdict", "reasoning", "suggested_label", "explanation", "sample_id", "ground_truth"):
            assert one[seq][name] == two[seq][name]
        assert two[seq]["_validation_issues"] is None

    for change in ({"version": "v9"}, {"model": "other"}, {"now": 100.0 + fixed.CACHE_TTL_SECONDS + 1}):
        options = {"cache": cache, "now": 200.0, **change}
        assert not any(r["cache_hit"] for r in review.review_batch(samples, taxonomy, **options).results.collect())


def test_failed_prompts_become_error_rows(spark, make_samples, taxonomy):
    def make():
        def score(prompts_):
            if any("hello" in p for p in prompts_):
                raise scoring.ScorerError("bad request", 400)
            return ["VERDICT: Correct\nREASONING: fine"] * len(prompts_)

        return score

    reviewer = review.scoring_reviewer(make, concurrency=1, base_seconds=0)
    none = spark.createDataFrame([], schemas.CACHE)
    with pytest.raises(ValueError):
        review.review_batch(make_samples(ROWS), taxonomy, reviewer, cache=none)
    batch = review.review_batch(make_samples(ROWS), taxonomy, reviewer, cache=none, now=1.0)
    got = by_seq(batch.results)
    bad = got[3]
    assert (bad["verdict"], bad["reasoning"], bad["explanation"]) == ("Uncertain", "Error: bad request", "Review failed")
    assert not bad["success"] and bad["error"] == "bad request" and bad["prompt_hash"] is None and bad["latency_ms"] is None
    assert all(got[i]["verdict"] == "Correct" and got[i]["success"] for i in (0, 1, 2, 4))
    assert ca.cache_entries(batch.reviews, 1.0).count() == 3


def test_tasks_that_score_stay_bounded_however_many_requests(spark):
    def naming_scorer():  # answers with the stage and the task that asked
        task = TaskContext.get()
        return lambda prompts_: [f"{task.stageId()}:{task.partitionId()}"] * len(prompts_)

    rows = spark.range(2000, numPartitions=4).select(
        F.col("id").cast("string").alias("prompt_hash"), F.concat(F.lit("p"), "id").alias("prompt")
    )
    asked = scoring.score_prompts(rows, naming_scorer, concurrency=2, file_requests=50, task_files=3).collect()
    assert sorted(int(r["prompt_hash"]) for r in asked) == list(range(2000))
    n_rows = {}
    for r in asked:
        n_rows[r["raw_response"]] = n_rows.get(r["raw_response"], 0) + 1
    tasks = {}
    for name in n_rows:
        tasks.setdefault(name.split(":")[0], []).append(name)
    assert max(n_rows.values()) <= 200 and max(map(len, tasks.values())) == 2
    assert scoring.score_prompts(rows.limit(0), naming_scorer, concurrency=2).count() == 0


def test_requests_carry_a_prompts_parts_and_meet_the_cache_where_they_lie(spark, make_samples, taxonomy, capsys):
    seen = []

    def answer(requests):
        requests.explain()
        seen.append(sorted((r["n_rows"], r["prompt"]) for r in requests.collect()))
        return requests.withColumns({"raw_response": F.lit("VERDICT: Correct"), "latency_ms": F.lit(0), "error": F.lit(None)})

    samples = make_samples(ROWS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cache = spark.createDataFrame([("x", fixed.PROMPT_VERSION, fixed.DEFAULT_MODEL, None, 1.0, 0)], schemas.CACHE)
        review.review_batch(samples, taxonomy, review.Reviewer(("prompt",), answer), cache=cache, now=1.0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning(" in line]
    assert len(dealt) == 2  # the requests once, the cache once
    prompts_ = {r["seq"]: r["prompt"] for r in prompts.build_prompt(samples, taxonomy).collect()}
    assert seen == [sorted([(2, prompts_[0]), *((1, prompts_[i]) for i in (2, 3, 4))])]


def test_retry_policy():
    calls = []

    def flaky(failures, problem):
        def score(prompts_):
            calls.append(len(prompts_))
            if len(calls) <= failures:
                raise problem
            return ["ok"] * len(prompts_)

        return score

    def run(failures, problem, tries):
        calls.clear()
        return scoring.call_with_retry(flaky(failures, problem), ["p"], tries, 0)

    assert run(1, scoring.ScorerError("boom", 500), 2) == ["ok"] and len(calls) == 2
    for transient in (TimeoutError(), ConnectionError(), scoring.ScorerError("slow", 429), scoring.ScorerError("slow", 408)):
        assert run(2, transient, 3) == ["ok"]
    for final in (scoring.ScorerError("gone", 404), ValueError("odd"), scoring.ScorerError("no status")):
        with pytest.raises(type(final)):
            run(1, final, 3)
        assert len(calls) == 1
    with pytest.raises(scoring.ScorerError):
        run(9, scoring.ScorerError("boom", 503), 3)
    assert len(calls) == 3
    with pytest.raises(scoring.ScorerError, match="2 answers to 1"):
        scoring.call_with_retry(lambda p: ["a", "b"], ["p"], 3, 0)


def test_scorer_is_made_once_per_task_and_null_prompts_pass(spark):
    def make():
        state = {"n": 0}

        def score(prompts_):
            state["n"] += len(prompts_)
            return [f"{p}:{state['n']}" for p in prompts_]

        return score

    rows = [(f"h{i}", None if i == 3 else f"p{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "prompt_hash string, prompt string").coalesce(1)
    got = scoring.score_prompts(df, make, batch_size=4).collect()
    assert len(got) == 10
    answers = {r["prompt_hash"]: r["raw_response"] for r in got}
    assert answers["h3"] is None and answers["h0"] == "p0:3" and answers["h9"] == "p9:9"


def test_spread_lookup_is_exact_for_hot_keys(spark):
    # one key holds a third of all rows, one key is missing from the lookup
    facts = spark.range(3000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"),
    )
    lookup = facts.select("k").distinct().filter("k <> 'k7'").withColumn("v", F.concat("k", F.lit("!")))
    plain = facts.join(lookup, "k", "left").select("seq", "k", "v")
    for pieces, floor in ((10, 1), (1000, 100_000), (3, 1)):
        got = skew.spread_lookup(facts, lookup, "k", "seq", pieces=pieces, min_piece_rows=floor)
        assert sorted(map(str, got.select("seq", "k", "v").collect())) == sorted(map(str, plain.collect()))


def test_null_keys_find_nothing_and_are_spread(spark):
    facts = spark.range(2000).select(F.col("id").alias("seq"), F.when(F.col("id") % 10 == 0, "a").alias("k"))
    lookup = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    got = skew.spread_lookup(facts, lookup, "k", "seq", pieces=16, min_piece_rows=1, max_piece_rows=50)
    assert got.filter("k IS NULL AND v IS NULL").count() == 1800 and got.filter("k = 'a' AND v = 1").count() == 200
    assert skew.spread_lookup(facts, lookup, "k", "seq", how="left_anti").count() == 1800


def test_hot_key_is_split_over_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        facts = spark.range(4000).select(F.col("id").alias("seq"), F.lit("hot").alias("k"))
        lookup = spark.createDataFrame([("hot", 1)], "k string, v int")
        got = skew.spread_lookup(facts, lookup, "k", "seq", pieces=16, min_piece_rows=1)
        spread = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert sum(r["count"] for r in spread) == 4000
        assert len(spread) > 1 and max(r["count"] for r in spread) < 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_result_parts_unite(spark):
    a = spark.createDataFrame([(1, "x")], "seq bigint, verdict string")
    b = spark.createDataFrame([(2, "e")], "seq bigint, error string")
    got = sorted(tuple(r) for r in review.union_results(a, b).select("seq", "verdict", "error").collect())
    assert got == [(1, "x", None), (2, None, "e")]


def test_rows_of_one_prompt_with_different_truth_get_their_own_mock_verdict(make_samples, taxonomy):
    rows = [("same text", "Erasure", 0.9, "Erasure", False), ("same text", "Erasure", 0.9, "Complaint", True)]
    got = by_seq(review.review_batch(make_samples(rows), taxonomy).results)
    assert [got[i]["verdict"] for i in (0, 1)] == ["Correct", "Incorrect"]
    assert got[0]["prompt_hash"] == got[1]["prompt_hash"]


def test_a_run_counts_hits_drops_expired_entries_and_keeps_its_version(spark, make_samples, taxonomy, tmp_path):
    from secondlook.plans import audit

    answer = review.scoring_reviewer(lambda: lambda prompts_: ["VERDICT: Correct\nREASONING: fine"] * len(prompts_))
    empty = spark.createDataFrame([], schemas.CACHE)
    samples = make_samples(ROWS)

    def run(name, cache, now, version="v9"):
        return audit.run_audit(samples, taxonomy, f"{tmp_path}/{name}", name, reviewer=answer, cache=cache, now=now, version=version)

    first = run("one", empty, 100.0)
    assert {(r["version"], r["hit_count"]) for r in first.cache.collect()} == {("v9", 0)}
    second = run("two", first.cache, 200.0)
    assert all(r["cache_hit"] for r in second.results.collect())
    assert {r["hit_count"] for r in second.cache.collect()} == {1}
    late = run("three", second.cache, 200.0 + fixed.CACHE_TTL_SECONDS, version="v10")
    assert {(r["version"], r["hit_count"]) for r in late.cache.collect()} == {("v10", 0)}


def test_an_overloaded_service_is_not_stormed_and_bad_prompts_are_found_by_halving(spark):
    calls = []

    def busy(prompts_):
        calls.append(len(prompts_))
        raise scoring.ScorerError("slow down", 429)

    with pytest.raises(scoring.ScorerError):
        scoring.call_with_retry(busy, ["a"] * 32, 3, 0)
    assert calls == [32, 32, 32]

    def make():
        def score(prompts_):
            if any(p == "bad" for p in prompts_):
                raise scoring.ScorerError("refused", 404)
            return [p.upper() for p in prompts_]

        return score

    given = spark.createDataFrame([(f"h{i}", "bad" if i == 5 else "ok") for i in range(16)], "prompt_hash string, prompt string")
    found = scoring.score_prompts(given.coalesce(1), make, base_seconds=0).collect()
    assert {r["prompt_hash"] for r in found if r["error"]} == {"h5"} and sum(r["raw_response"] == "OK" for r in found) == 15


def test_csv_samples_are_read_by_name(spark, tmp_path):
    from secondlook.sources import tables

    path = tmp_path / "samples.csv"
    path.write_text('confidence,id,seq,text,pred_label\n0.9,a,0,"delete, me",Erasure\n0.5,b,1,,Other\n')
    got = tables.read_samples(spark, str(path), "csv").orderBy("seq").collect()
    assert [(r["id"], r["text"], r["pred_label"], r["confidence"]) for r in got] == [("a", "delete, me", "Erasure", 0.9), ("b", None, "Other", 0.5)]
    assert got[0]["ground_truth"] is None
    path.write_text("id,text\na,b\n")
    with pytest.raises(ValueError):
        tables.read_samples(spark, str(path), "csv")

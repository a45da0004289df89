import json
import os

import pytest
from pyspark.sql import functions as F

from secondlook import fixed
from secondlook.operators import metrics as me
from secondlook.operators import privacy, review
from secondlook.plans import audit
from secondlook.plans import bindings as b
from secondlook.plans.queries import QUERIES
from secondlook.session import shared_dir, stage
from secondlook.sources import artifacts, tables
from secondlook.streaming import audit_stream

NASTY = 'line one\nline "two", with comma\\ and back\\"slash'


def results(spark, rows):
    schema = "seq bigint, verdict string, pred_label string, suggested_label string, text string, reasoning string"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def test_metrics_empty_all_and_mixed(spark):
    empty = me.verdict_metrics(results(spark, [])).first().asDict()
    assert set(empty.values()) == {0}
    every = me.verdict_metrics(results(spark, [("Correct", "A", None, "t", "r")] * 3)).first()
    assert (every["total"], every["correct"], every["correct_pct"]) == (3, 3, 100.0)
    mixed = [(v, "A", None, "t", "r") for v in ("Correct", "Incorrect", "Uncertain", "Odd", None)]
    row = me.verdict_metrics(results(spark, mixed)).first()
    assert (row["total"], row["correct"], row["incorrect"], row["uncertain"]) == (5, 1, 1, 2)
    dist = {r["verdict"]: r["n_rows"] for r in me.verdict_distribution(results(spark, mixed)).collect()}
    assert dist == {"Correct": 1, "Incorrect": 1, "Uncertain": 2, "Odd": 1}


def test_label_order_and_unknown(spark):
    rows = [("Correct", x, None, "t", "r") for x in ("B", "A", None, "B")]
    got = [(r["label"], r["n_rows"]) for r in me.labels_by_first_seen(results(spark, rows)).collect()]
    assert got == [("B", 2), ("A", 1), ("Unknown", 1)]


def test_corrections_take_the_first_five(spark):
    rows = [("Incorrect", "A", "B", "t" * 90, "r" * 120)] * 10 + [("Correct", "A", None, "t", "r")]
    for n in (1, 8):
        got = me.top_corrections(results(spark, rows).repartition(n)).collect()
        assert [r["seq"] for r in got] == [0, 1, 2, 3, 4]
    assert len(got[0]["text"]) == 80 and len(got[0]["reasoning"]) == 100


def test_corrected_label(spark):
    rows = [("Incorrect", "A", "B", "", ""), ("Correct", "A", "B", "", ""), ("Incorrect", "A", "", "", ""), ("Incorrect", "A", None, "", "")]
    df = results(spark, rows)
    assert [r["corrected_label"] for r in me.with_corrected_label(df).orderBy("seq").collect()] == ["B", "B", "A", "A"]
    strict = me.with_corrected_label(df, only_incorrect=True).orderBy("seq").collect()
    assert [r["corrected_label"] for r in strict] == ["B", "A", "A", "A"]


def test_normalize_results_fills_missing_columns(spark):
    df = spark.createDataFrame([(0, None)], "seq bigint, verdict string")
    row = me.normalize_results(df).first()
    assert (row["verdict"], row["pred_label"], row["text"], row["reasoning"]) == ("Uncertain", "Unknown", "", "")


def test_pii_summary(spark):
    rows = [(0, "demo_1", "nothing"), (1, "demo_2", "ip 10.0.0.1"), (2, "synth_3", "a@b.org and 10.1.1.1")]
    df = spark.createDataFrame(rows, "seq bigint, id string, text string")
    row = privacy.pii_summary(df).first()
    assert row["detected_patterns"] == ["ip_address", "email"] and row["samples_with_pii"] == 2 and row["is_synthetic"]
    assert not privacy.pii_summary(df.withColumn("id", F.lit("cust"))).first()["is_synthetic"]
    empty = privacy.pii_summary(df.filter("false")).first()
    assert (empty["has_potential_pii"], empty["is_synthetic"], empty["total_samples"]) == (False, True, 0)
    assert empty["detected_patterns"] == []
    same = spark.createDataFrame([(0, "x", "card 1234 5678 9012 3456 mail a@b.org")], "seq bigint, id string, text string")
    assert privacy.pii_summary(same).first()["detected_patterns"] == ["email", "credit_card"]


def test_csv_keeps_line_ends_quotes_empty_and_null(make_samples, spark, tmp_path):
    rows = [(NASTY, "A", 0.5, None, None), ("", "B", 0.25, "B", True), (None, "", 0.1, "", False)]
    samples = make_samples(rows)
    path = artifacts.save_samples(samples, str(tmp_path))
    back = artifacts.read_csv(spark, path, samples.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, samples.collect()))
    read = tables.read_samples(spark, path, "csv")
    assert read.count() == 3


def test_read_samples_needs_its_columns(spark, make_samples, tmp_path):
    path = str(tmp_path / "p")
    make_samples([("t", "A", 0.5, "A", False)]).drop("ground_truth").write.parquet(path)
    assert tables.read_samples(spark, path).first()["ground_truth"] is None
    other = str(tmp_path / "q")
    make_samples([("t", "A", 0.5, "A", False)]).drop("text").write.parquet(other)
    with pytest.raises(ValueError, match="text"):
        tables.read_samples(spark, other)


def test_taxonomy_from_a_missing_or_given_file(spark, taxonomy, tmp_path):
    assert tables.read_taxonomy(spark, str(tmp_path / "none.json")).count() == 0
    taxonomy.write.json(str(tmp_path / "tax"))
    assert tables.read_taxonomy(spark, str(tmp_path / "tax")).orderBy("ordinal").collect() == taxonomy.orderBy("ordinal").collect()


def lines_of(path):
    out = []
    for name in sorted(n for n in os.listdir(path) if n.startswith("part-")):
        with open(os.path.join(path, name), encoding="utf-8") as f:
            out += f.read().splitlines()
    return out


@pytest.mark.parametrize("redacted", [False, True])
def test_run_audit_writes_all_artifacts(spark, sf, taxonomy, tmp_path, redacted):
    samples = b.samples(spark, sf)
    run = audit.run_audit(samples, taxonomy, str(tmp_path), "r1", 42, reviewer=None, redacted=redacted)
    assert sorted(os.listdir(tmp_path)) == sorted(fixed.ARTIFACTS.values())
    summary = run.summary.first()
    assert summary["run_id"] == "r1" and summary["total"] == 200
    assert summary["correct"] + summary["incorrect"] + summary["uncertain"] == 200

    manifest = json.loads(lines_of(run.paths["manifest"])[0])
    assert manifest["n_samples"] == 200 and manifest["redacted"] is redacted and manifest["_warning"] == fixed.RUN_WARNING
    metrics = json.loads(lines_of(run.paths["metrics"])[0])
    assert metrics["total"] == 200 and metrics["redacted"] is redacted
    saved = [json.loads(x) for x in lines_of(run.paths["results"])]
    assert len(saved) == 200 and all(r["_untrusted"] for r in saved)
    hidden = [fixed.REDACTED_MIDDLE in r["text"] or r["text"] == fixed.REDACTED_SHORT for r in saved]
    assert all(hidden) if redacted else not any(hidden)

    report = lines_of(run.paths["report"])
    assert "run_id: r1" in report and report[0].startswith("> **UNTRUSTED")
    table = report[report.index("| Label | Count |") + 2:]
    labels = [x.split(" | ")[0][2:] for x in table[: table.index("")]]
    first_seen = [r["label"] for r in me.labels_by_first_seen(samples).collect()]
    assert labels == first_seen
    assert sum("- Predicted:" in x for x in report) == 5


def test_run_audit_with_cache_returns_the_next_snapshot(spark, taxonomy, make_samples, tmp_path):
    from secondlook import schemas
    from secondlook.operators.review import scoring_reviewer

    samples = make_samples([("a", "Erasure", 0.5, "Erasure", False), ("b", "Erasure", 0.5, "Objection", True)])
    empty = spark.createDataFrame([], schemas.CACHE)
    mocked = audit.run_audit(samples, taxonomy, str(tmp_path / "mock"), "r0", cache=empty, now=5.0)
    assert mocked.cache.count() == 0  # mock answers depend on more than the prompt
    answer = scoring_reviewer(lambda: lambda prompts_: ["VERDICT: Correct\nREASONING: fine"] * len(prompts_))
    run = audit.run_audit(samples, taxonomy, str(tmp_path / "one"), "r1", reviewer=answer, cache=empty, now=5.0)
    assert run.cache.count() == 2
    again = audit.run_audit(samples, taxonomy, str(tmp_path / "two"), "r2", cache=run.cache, now=6.0)
    assert all(r["cache_hit"] for r in again.results.collect())


def test_report_without_corrections(spark, make_samples):
    done = review.mock_review(make_samples([("t", "A", 0.5, "A", False)]))
    lines = [r["line"] for r in artifacts.report_lines(done, "r", "now").orderBy("part", "position").collect()]
    assert "*No corrections needed*" in lines and "accuracy: 100.0%" in lines and "| A | 1 |" in lines


def test_stage_uses_the_named_folder(spark):
    df = stage(spark.range(5), "numbers")
    assert df.count() == 5
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert all(shared_dir(spark) in f for f in df.inputFiles())


def test_stream_equals_batch_and_restarts_cleanly(spark, sf, taxonomy, tmp_path):
    folder = tmp_path / "in"
    samples = b.samples(spark, sf)
    samples.repartition(3).write.parquet(str(folder))
    stream = audit_stream.read_stream(spark, str(folder), samples.schema, files_per_batch=1)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    audit_stream.review_stream(stream, lambda batch: review.review_batch(batch, taxonomy), out, log)
    audit_stream.review_stream(stream, lambda batch: review.review_batch(batch, taxonomy), out, log)
    streamed = spark.read.parquet(out)
    assert len([n for n in os.listdir(out) if n.startswith("batch=")]) == 3
    want = review.review_batch(samples, taxonomy).results
    columns = ("seq", "sample_id", "verdict", "prompt_hash", "cache_hit")
    assert sorted(map(str, streamed.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_a_streamed_audit_reads_a_file_and_a_folder_of_files(spark, sf, tmp_path):
    b.table(spark, sf, "documents").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    of_file, of_folder = (sorted(map(str, QUERIES["stream_audit"](spark, d).collect())) for d in (sf, str(tmp_path)))
    assert of_file and of_folder == of_file


def test_running_verdicts(spark, sf, tmp_path):
    folder = tmp_path / "in"
    done = review.mock_review(b.samples(spark, sf))
    done.repartition(2).write.parquet(str(folder))
    stream = audit_stream.read_stream(spark, str(folder), done.schema, files_per_batch=1)
    query = (
        audit_stream.running_verdicts(stream).writeStream.outputMode("complete").format("memory")
        .queryName("running").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted(map(str, spark.table("running").collect()))
    assert got == sorted(map(str, me.label_verdicts(done).collect()))


ONE_VERDICT = "VERDICT: Correct\nREASONING: fine"


def counting_reviewer(folder):
    """A reviewer whose every call leaves a file, so that calls in any process are counted."""
    from secondlook.operators.review import scoring_reviewer

    def make():
        def score(prompts_):
            for _ in prompts_:
                (folder / os.urandom(8).hex()).touch()
            return [ONE_VERDICT] * len(prompts_)

        return score

    folder.mkdir(exist_ok=True)
    return scoring_reviewer(make)


def staged_folders_of(spark):
    path = f"{shared_dir(spark)}/secondlook"
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def test_a_stream_hits_what_earlier_batches_stored(spark, taxonomy, make_samples, tmp_path):
    first = make_samples([(t, "Erasure", 0.5, "Erasure", False) for t in ("a", "b", "b")])
    second = make_samples([(t, "Erasure", 0.5, "Erasure", False) for t in ("b", "c")]).withColumn("seq", F.col("seq") + 10)
    reviewer, out, before = counting_reviewer(tmp_path / "calls"), str(tmp_path / "out"), staged_folders_of(spark)
    for batch in (first, second):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = audit_stream.read_stream(spark, str(tmp_path / "in"), batch.schema)
        audit_stream.review_stream_cached(stream, taxonomy, reviewer, out, str(tmp_path / "log"), lambda k: 5.0 + k)
    hits = {r["seq"]: (r["batch"], r["cache_hit"]) for r in spark.read.parquet(f"{out}/results").collect()}
    assert hits == {0: (0, False), 1: (0, False), 2: (0, False), 10: (1, True), 11: (1, False)}
    left = spark.read.parquet(f"{out}/cache/batch=1").collect()
    assert sorted((r["created_at"], r["hit_count"]) for r in left) == [(5.0, 0), (5.0, 1), (6.0, 0)]
    assert len(os.listdir(tmp_path / "calls")) == 3
    assert staged_folders_of(spark) == before  # nothing staged outlives its batch


def test_a_repeated_batch_neither_scores_nor_counts_twice(spark, taxonomy, make_samples, tmp_path, monkeypatch):
    first = make_samples([(t, "Erasure", 0.5, "Erasure", False) for t in ("a", "b")])
    reviewer, out = counting_reviewer(tmp_path / "calls"), str(tmp_path / "out")
    first.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        stream = audit_stream.read_stream(spark, str(tmp_path / "in"), first.schema)
        audit_stream.review_stream_cached(stream, taxonomy, reviewer, out, str(tmp_path / "log"), lambda k: 5.0 + k)

    run()
    again = first.withColumn("seq", F.col("seq") + 10)
    again.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    real = audit_stream.remove_folder

    def fail(*_):
        raise OSError("the driver went down after the batch had been written, before it was committed")

    monkeypatch.setattr(audit_stream, "remove_folder", fail)
    with pytest.raises(Exception, match="went down"):
        run()
    monkeypatch.setattr(audit_stream, "remove_folder", real)
    run()
    assert sorted(n for n in os.listdir(out + "/results") if n.startswith("batch")) == ["batch=0", "batch=1"]
    assert spark.read.parquet(f"{out}/results").count() == 4
    assert {r["hit_count"] for r in spark.read.parquet(f"{out}/cache/batch=1").collect()} == {1}
    assert len(os.listdir(tmp_path / "calls")) == 2


def test_running_counts_after_each_batch(spark, sf, tmp_path):
    done = review.mock_review(b.samples(spark, sf))
    for turn in range(3):
        done.filter(F.col("seq") % 3 == turn).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = audit_stream.read_stream(spark, str(tmp_path / "in"), done.schema)
        audit_stream.count_available(stream, str(tmp_path / "counts"), str(tmp_path / "log"))
        changed = spark.read.parquet(f"{tmp_path}/counts/step={turn}")
        want = {(r["pred_label"], r["verdict"]): r["n_rows"] for r in me.label_verdicts(done.filter(F.col("seq") % 3 <= turn)).collect()}
        got = {(r["pred_label"], r["verdict"]): r["n_rows"] for r in changed.collect()}
        assert got.items() <= want.items() and sum(got.values()) > 0


def test_a_run_leaves_no_staged_folder_and_reads_the_samples_twice(spark, taxonomy, make_samples, tmp_path):
    samples = make_samples([(f"text {i}", "Erasure", 0.5, "Objection", True) for i in range(20)])
    samples.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = spark.read.parquet(str(tmp_path / "in")).mapInArrow(passed, samples.schema)
    before = staged_folders_of(spark)
    with audit.run_audit(counted, taxonomy, str(tmp_path / "run"), "r", reviewer=None) as run:
        assert run.summary.first()["total"] == 20 and run.results.count() == 20
        assert staged_folders_of(spark) > before
    assert staged_folders_of(spark) == before and read.value == 40
    line = spark.read.json(run.paths["metrics"]).first()
    assert (line["total"], line["incorrect"]) == (20, 20)
    assert spark.read.json(run.paths["manifest"]).first()["n_samples"] == 20


def test_a_reviewed_run_writes_its_counters(spark, taxonomy, make_samples, tmp_path):
    samples = make_samples([(t, "Erasure", 0.5, "Erasure", False) for t in ("a", "b", "b")])
    reviewer = counting_reviewer(tmp_path / "calls")
    from secondlook import schemas

    empty = spark.createDataFrame([], schemas.CACHE)
    first = audit.run_audit(samples, taxonomy, str(tmp_path / "one"), "r1", reviewer=reviewer, cache=empty, now=5.0)
    again = audit.run_audit(samples, taxonomy, str(tmp_path / "two"), "r2", reviewer=reviewer, cache=first.cache, now=6.0)
    one, two = (spark.read.json(r.paths["metrics"]).first() for r in (first, again))
    assert (one["hits"], one["misses"], one["cached_prompts"], one["rows_done"], one["hit_rate"]) == (0, 3, 2, 3, 0.0)
    assert (two["hits"], two["misses"], two["persistent_hits"], two["rows_done"], two["hit_rate"]) == (3, 0, 2, 3, 100.0)
    assert one["validation_failures"] == one["invalid_labels_rejected"] == 0


def test_label_list_in_parts(spark):
    from secondlook.operators import taxonomy as ta

    labels = spark.createDataFrame([(7 * i, f"n{i}", f"d{i}") for i in range(1000)], "ordinal long, name string, definition string")
    parts = ta.taxonomy_block(labels, part_labels=64).orderBy("part").collect()
    assert [r["part"] for r in parts] == list(range(16)) and max(len(r["block"].split("\n")) for r in parts) == 64
    assert "\n".join(r["block"] for r in parts) == ta.prompt_block(labels).first()["block"]
    assert ta.taxonomy_block(labels.limit(0)).count() == 0


def test_worst_labels_without_a_window_over_all_rows(spark):
    rows = [(f"l{i % 40}", "Incorrect" if (i // 40) % (1 + i % 40 % 7) == 0 else "Correct") for i in range(4000)]
    found = me.worst_labels(spark.createDataFrame(rows, "pred_label string, verdict string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dense_rank" not in plan and "windowspecdefinition(incorrect_rate" not in plan
    got = found.collect()
    rates = sorted({r["incorrect_rate"] for r in got}, reverse=True)
    assert len(got) == 40 and all(r["rank"] == rates.index(r["incorrect_rate"]) + 1 for r in got)


def test_latency_percentiles_are_within_the_stated_error(spark):
    rows = spark.range(200_000).select(
        F.lit(True).alias("success"), F.lit(False).alias("cache_hit"), (F.xxhash64("id") % 1_000_000).alias("latency_ms")
    )
    for accuracy in (100, 10_000):
        found = me.latency_summary(rows, accuracy).first()
        for name, share in (("median_ms", 0.5), ("p95_ms", 0.95)):
            rank = rows.filter(F.col("latency_ms") <= found[name]).count()
            assert abs(rank - share * 200_000) <= 200_000 / accuracy + 1

import bisect

from pyspark.sql import functions as F

from secondlook import fixed
from secondlook.functions.arrays import count_up_to
from secondlook.functions.draws import draw_unit
from secondlook.functions.text import number_text, redact, word_count
from secondlook.operators import noise
from secondlook.operators import taxonomy as ta
from secondlook.plans import bindings as b
from secondlook.sources import tables

NAMES = [n for n, _ in fixed.DEFAULT_TAXONOMY]


def test_draw_is_a_fixed_function(spark):
    row = spark.range(7, 8).select(draw_unit(42, "x", F.col("id")).alias("u")).first()
    again = spark.range(7, 8).repartition(5).select(draw_unit(42, "x", F.col("id")).alias("u")).first()
    assert row == again and 0 <= row["u"] < 1


def test_rate_zero_and_one(spark, taxonomy):
    rows = noise.assign_labels(spark.range(300).withColumnRenamed("id", "seq"), taxonomy, 1)
    patterns = tables.load_patterns(spark)
    clean = noise.inject_label_noise(rows, taxonomy, patterns, 1, rate=0.0).collect()
    noisy = noise.inject_label_noise(rows, taxonomy, patterns, 1, rate=1.0).collect()
    assert all(r["pred_label"] == r["ground_truth"] and not r["is_misclassified"] for r in clean)
    assert all(r["pred_label"] != r["ground_truth"] and r["is_misclassified"] for r in noisy)
    assert {r["ground_truth"] for r in clean} == set(NAMES)
    assert all(0.78 <= r["confidence"] <= 0.98 for r in clean)
    assert all(0.55 <= r["confidence"] <= 0.82 for r in noisy)


def test_static_confusion_follows_the_first_pattern(spark, taxonomy):
    patterns = tables.load_patterns(spark, [("Erasure", "Complaint"), ("Erasure", "Objection")])
    rows = noise.assign_labels(spark.range(500).withColumnRenamed("id", "seq"), taxonomy, 3)
    got = noise.static_confusion(rows, taxonomy, patterns, 3).collect()
    assert {r["confused"] for r in got if r["ground_truth"] == "Erasure"} == {"Complaint"}
    others = {r["confused"] for r in got if r["ground_truth"] == "Complaint"}
    assert others == set(NAMES) - {"Complaint"}


def test_dynamic_confusion_reaches_every_other_label_by_weight(spark, taxonomy):
    rows = spark.range(4000).select(F.col("id").alias("seq"), F.lit("Access Request").alias("ground_truth"))
    got = noise.dynamic_confusion(rows, taxonomy, tables.load_similarity(spark), 5)
    counts = {r["confused"]: r["count"] for r in got.groupBy("confused").count().collect()}
    assert set(counts) == set(NAMES) - {"Access Request"}
    assert sum(counts.values()) == 4000
    # weights 0.7, 0.4, 0.3 and three times 0.1
    for name, weight in [("Portability", 0.7), ("General Inquiry", 0.4), ("Erasure", 0.3), ("Complaint", 0.1)]:
        assert abs(counts[name] / 4000 - weight / 1.7) < 0.04


def test_dynamic_confusion_without_entries_is_uniform(spark, taxonomy):
    rows = spark.range(2000).select(F.col("id").alias("seq"), F.lit("Erasure").alias("ground_truth"))
    some = tables.load_similarity(spark, [("Complaint", "Erasure", 0.9)])
    got = noise.dynamic_confusion(rows, taxonomy, some, 5).groupBy("confused").count().collect()
    assert {r["confused"] for r in got} == set(NAMES) - {"Erasure"}
    assert all(abs(r["count"] / 2000 - 1 / 6) < 0.04 for r in got)


def test_count_up_to_matches_bisect(spark):
    arrays = [[], [5], [1, 1, 1], [0, 2, 2, 7], list(range(0, 40, 3)), None]
    given = spark.createDataFrame([(a, x) for a in arrays for x in (-1, 0, 1, 2, 5, 20, 39, 99, None)], "a array<bigint>, x bigint")
    for r in given.withColumn("n", count_up_to(F.col("a"), F.col("x"))).collect():
        assert r.n == (None if r.a is None or r.x is None else bisect.bisect_right(r.a, r.x))


def test_dynamic_confusion_over_a_long_list_matches_a_plain_loop(spark):
    """Entries that repeat, weigh nothing or have no weight; every draw against a loop over the label's list."""
    names = [f"l{i:03}" for i in range(300)]
    labels = tables.load_taxonomy(spark, [(n, "") for n in names])
    entries = [("l007", names[i * 7 % 300], [0.5, 0.0, 0.25, None][i % 4]) for i in range(200)]
    entries += [("l007", "l014", 0.5), ("l007", "l007", 9.0)]
    rows = spark.range(3000).select(F.col("id").alias("seq"), F.lit("l007").alias("ground_truth"))
    drawn = noise.dynamic_confusion(rows, labels, tables.load_similarity(spark, entries), 5)
    assert drawn.columns == ["ground_truth", "seq", "confused"]
    listed = sorted((names.index(c), w or 0.0) for a, c, w in entries if c != a)
    rest = [i for i in range(300) if i != 7 and i not in {o for o, _ in listed}]
    total = sum(w for _, w in listed) + 0.1 * len(rest)
    points = {r.seq: r.u for r in rows.select("seq", draw_unit(5, "weight", F.col("seq")).alias("u")).collect()}
    for r in drawn.collect():
        point, at = points[r.seq] * total, 0.0
        for ordinal, weight in listed:
            at += weight
            if point < at:
                break
        else:
            ordinal = rest[min(int((point - at) / 0.1), len(rest) - 1)]
        assert r.confused == names[ordinal]


def test_seed_changes_and_repeats(spark, sf):
    one = [r["pred_label"] for r in b.samples(spark, sf).orderBy("seq").collect()]
    two = [r["pred_label"] for r in b.samples(spark, sf).repartition(7).orderBy("seq").collect()]
    assert one == two
    docs = b.documents(spark, sf)
    other = [r["ground_truth"] for r in noise.assign_labels(docs, tables.load_taxonomy(spark), 43).orderBy("seq").collect()]
    first = [r["ground_truth"] for r in noise.assign_labels(docs, tables.load_taxonomy(spark), 42).orderBy("seq").collect()]
    assert other != first


def test_sample_ids_do_not_lose_digits(spark):
    rows = spark.createDataFrame([(7,), (12345,)], "seq bigint").select(noise.sample_ids(0, F.col("seq")).alias("id")).collect()
    assert [r["id"] for r in rows] == ["demo_0_0007", "demo_0_12345"]


def test_variations(spark):
    df = spark.createDataFrame([("Delete It. Now.",), ("",)], "text string")
    got = [(r["text"], r["variant"], r["varied_text"]) for r in noise.augment_text(df).collect()]
    assert len(got) == 14
    forms = {v: t for text, v, t in got if text}
    assert forms == {
        "plain": "Delete It. Now.", "lower": "delete it. now.", "greeting": "Hi, delete It. Now.",
        "thanks": "Delete It. Now. Thanks.", "letter": "Hello, delete It. Now. Best regards.",
        "urgent": "URGENT: Delete It. Now.", "exclaim": "Delete It! Now!",
    }


def test_merge_templates_appends(spark):
    base = tables.load_templates(spark, [("A", "a0"), ("A", "a1"), ("B", "b0")])
    custom = tables.load_templates(spark, [("A", "a1"), ("C", "c0"), ("C", "c1")])
    got = sorted(tuple(r) for r in ta.merge_templates(base, custom).collect())
    assert got == [("A", 0, "a0"), ("A", 1, "a1"), ("A", 2, "a1"), ("B", 0, "b0"), ("C", 0, "c0"), ("C", 1, "c1")]


def test_dense_ordinals_across_slices(spark):
    rows = [("hot" if i % 3 else "cold", i * 7) for i in range(200)]
    df = spark.createDataFrame(rows, "label string, k bigint")
    got = ta.dense_ordinals(df, "label", "k", slice_rows=20).collect()
    want = {}
    for label in ("hot", "cold"):
        for n, k in enumerate(sorted(k for lab, k in rows if lab == label)):
            want[(label, k)] = n
    assert {(r["label"], r["k"]): r["ordinal"] for r in got} == want


def test_dense_ordinals_with_a_far_off_id_and_null_labels(spark):
    rows = [("hot", i) for i in range(300)] + [("hot", 2**50)] + [(None, 1000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "label string, k bigint")
    got = {(r["label"], r["k"]): r["ordinal"] for r in ta.dense_ordinals(df, "label", "k", slice_rows=40).collect()}
    want = {("hot", i): i for i in range(300)} | {("hot", 2**50): 300} | {(None, 1000 + i): i for i in range(50)}
    assert got == want
    assert ta.dense_ordinals(df.limit(0), "label", "k").count() == 0


def test_dense_ordinals_deal_long_texts_over_more_ranges(spark):
    rows = [("hot", i, "x" * 1000) for i in range(300)] + [("cold", 1000 + i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "label string, k bigint, text string")
    numbered = ta.dense_ordinals(df, "label", "k", slice_bytes=20_000)
    want = {("hot", i): i for i in range(300)} | {("cold", 1000 + i): i for i in range(20)}
    assert {(r["label"], r["k"]): r["ordinal"] for r in numbered.collect()} == want
    written = [f for f in numbered.inputFiles() if "/ordinals-" in f]
    assert max(spark.read.parquet(f).count() for f in written) < 100


def test_confusion_tables_are_broadcast_one_by_one(spark, taxonomy, capsys):
    rows = spark.range(50).select(F.col("id").alias("seq"), F.lit(NAMES[0]).alias("ground_truth"))
    rows = rows.unionByName(rows.withColumn("ground_truth", F.lit("Nowhere")))
    patterns = spark.createDataFrame([(0, NAMES[0], NAMES[2]), (1, "Nowhere", NAMES[1])], "ordinal bigint, actual string, confused string")
    noise.static_confusion(rows, taxonomy, tables.load_patterns(spark), 1).explain()
    lines = capsys.readouterr().out.splitlines()
    below = None
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-"))
        below = None if below is not None and depth <= below else below
        assert below is None or "Join" not in line  # no broadcast table is a join of two
        if below is None and "BroadcastExchange" in line:
            below = depth
    assert any("BroadcastHashJoin" in line for line in lines)
    got = noise.static_confusion(rows, taxonomy, patterns, 1).groupBy("ground_truth").agg(F.collect_set("confused").alias("c"))
    known = {r["ground_truth"]: r["c"] for r in got.collect()}
    assert known[NAMES[0]] == [NAMES[2]] and len(known["Nowhere"]) > 1  # patterns of unknown labels don't count


def test_repeated_patterns_are_listed_once(spark, taxonomy):
    name = taxonomy.orderBy("ordinal").first()["name"]
    rows = [(i, name, "x" if i % 2 else "y") for i in range(6)]
    patterns = spark.createDataFrame(rows, "ordinal bigint, actual string, confused string")
    shown = {r["label"]: r["confused_with"] for r in ta.static_preview(taxonomy, patterns).collect()}
    assert shown[name] == ["y", "x"]


def test_generate_samples(spark, taxonomy):
    def make(n):
        rows = spark.range(n).withColumnRenamed("id", "seq")
        return noise.generate_samples(
            rows, tables.load_templates(spark), taxonomy, tables.load_patterns(spark), seed=0
        ).collect()

    assert make(0) == []
    assert len(make(1)) == 1
    many = make(1000)
    assert len({r["id"] for r in many}) == 1000
    assert all(r["text"] and r["ground_truth"] in NAMES for r in many)


def test_previews(spark, taxonomy):
    static = {r["label"]: r["confused_with"] for r in ta.static_preview(taxonomy, tables.load_patterns(spark)).collect()}
    dynamic = {r["label"]: r["confused_with"] for r in ta.dynamic_preview(taxonomy, tables.load_similarity(spark)).collect()}
    assert static["Erasure"] == ["Access Request"] and static["Access Request"] == ["(random)"]
    assert dynamic["Access Request"] == ["Portability", "General Inquiry", "Erasure"]
    assert dynamic["Complaint"] == ["Objection", "General Inquiry"]


def test_number_text(spark):
    want = {0.85: "0.85", 1.0: "1.0", 0.0: "0.0", 0.001: "0.001", 0.0005: "0.0005", 0.00012345: "0.00012345", 1e-05: "1e-05", 2.5e-07: "2.5e-07", -0.0005: "-0.0005"}
    df = spark.createDataFrame([(v,) for v in want], "v double").withColumn("t", number_text(F.col("v")))
    assert {r["v"]: r["t"] for r in df.collect()} == want
    assert all(repr(v) == t for v, t in want.items())


def test_redact_and_words(spark):
    cases = [(None, None), ("", ""), ("x" * 20, "[REDACTED]"), ("a" * 11 + "b" * 10, "a" * 10 + "[...REDACTED...]" + "b" * 10)]
    df = spark.createDataFrame(cases, "t string, want string")
    for r in df.withColumn("got", redact(F.col("t"))).collect():
        assert r["got"] == r["want"]
    words = spark.createDataFrame([("  a b\n\tc d ",), ("",), ("   ",)], "t string").select(word_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in words] == [4, 0, 0]

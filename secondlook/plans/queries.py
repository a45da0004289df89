"""Registered queries: each runs one operator over whole given tables.

Outputs are flat (arrays are joined to text), so that they can be compared with SQL results.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secondlook import fixed, schemas
from secondlook.functions import text as tx
from secondlook.functions.draws import draw_int
from secondlook.operators import cache as ca
from secondlook.operators import metrics as me
from secondlook.operators import noise, privacy, prompts, responses, review, scoring
from secondlook.operators import taxonomy as ta
from secondlook.plans import audit
from secondlook.plans import bindings as b
from secondlook.session import TEXT_CODEC, fresh_path
from secondlook.sources import artifacts, cache_table, tables
from secondlook.streaming import audit_stream

QUERIES = {}
RUN_ID = "run-42"
GENERATED = "2024-01-01 00:00:00"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def joined(c: Column, sep: str = " | ") -> Column:
    return F.array_join(c, sep)


def mock_results(spark: SparkSession, d: str) -> DataFrame:
    return review.mock_review(b.samples(spark, d))


def live_cache(spark: SparkSession, d: str) -> DataFrame:
    return ca.live_entries(b.cache(spark, d), b.NOW, model=b.MODEL)


# Scans, sources and sinks


@query
def scan_samples(spark, d):
    path = fresh_path(spark, "samples")
    b.samples(spark, d).write.parquet(path)
    return tables.read_samples(spark, path)


@query
def scan_taxonomy(spark, d):
    used = b.labelled(spark, d).groupBy(F.col("ground_truth").alias("name")).agg(F.count("*").alias("n_rows"))
    return tables.load_taxonomy(spark).join(used, "name", "left").select(
        "ordinal", "name", "definition", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


@query
def sink_samples_csv(spark, d):
    path = artifacts.save_samples(b.samples(spark, d), fresh_path(spark, "run"))
    return artifacts.read_csv(spark, path, schemas.SAMPLES)


@query
def sink_results_json(spark, d):
    found = mock_results(spark, d)
    path = artifacts.save_results(found, fresh_path(spark, "run"), redacted=True)
    return spark.read.schema(found.schema).json(path)


@query
def sink_labeled_csv(spark, d):
    found = b.results(spark, d)
    path = artifacts.save_labeled(found, fresh_path(spark, "run"), redacted=True)
    return artifacts.read_csv(spark, path, me.labeled_dataset(found).schema)


@query
def sink_metrics_json(spark, d):
    counts = responses.validation_stats(b.validated(spark, d))
    path = artifacts.save_metrics(b.results(spark, d), fresh_path(spark, "run"), extra=counts)
    schema = (
        "total bigint, correct bigint, incorrect bigint, uncertain bigint, correct_pct double, "
        "incorrect_pct double, uncertain_pct double, validation_failures bigint, "
        "invalid_labels_rejected bigint, _warning string, redacted boolean"
    )
    return spark.read.schema(schema).json(path)


@query
def sink_run_manifest(spark, d):
    settings = {"run_id": RUN_ID, "seed": b.SEED, "use_llm": False, "model": b.MODEL, "redacted": False}
    settings |= {"strict_validation": True, "generated_at": GENERATED}
    path = artifacts.save_manifest(b.samples(spark, d), fresh_path(spark, "run"), settings)
    schema = (
        "n_samples bigint, run_id string, seed bigint, use_llm boolean, model string, redacted boolean, "
        "strict_validation boolean, generated_at string, _warning string"
    )
    return spark.read.schema(schema).json(path)


@query
def sink_report(spark, d):
    """All lines of the written report."""
    path = artifacts.save_report(mock_results(spark, d), fresh_path(spark, "run"), RUN_ID, GENERATED)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def run_summary(spark, d):
    run = audit.run_audit(
        b.samples(spark, d), tables.load_taxonomy(spark), fresh_path(spark, "run"), RUN_ID, b.SEED, reviewer=None
    )
    return run.summary.drop("seconds")


@query
def csv_read_back(spark, d):
    """Rows and distinct ids of the saved CSV artifacts."""
    folder = fresh_path(spark, "run")
    rows, found = b.samples(spark, d), mock_results(spark, d)
    sample_path = artifacts.save_samples(rows, folder)
    label_path = artifacts.save_labeled(found, folder)

    def counted(path, schema, name):
        return artifacts.read_csv(spark, path, schema).agg(
            F.lit(name).alias("artifact"), F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids")
        )

    return counted(sample_path, schemas.SAMPLES, fixed.ARTIFACTS["samples"]).unionByName(
        counted(label_path, me.labeled_dataset(found).schema, fixed.ARTIFACTS["labeled"])
    )


# Projections, scalar and string operators


@query
def text_variations(spark, d):
    return noise.augment_text(b.documents(spark, d)).select("seq", "variant", "varied_text")


@query
def text_variation_pick(spark, d):
    return noise.vary_text(b.documents(spark, d), b.SEED)


@query
def sample_id(spark, d):
    return b.documents(spark, d).select("seq", noise.sample_ids(b.SEED, F.col("seq")).alias("id"))


def _prompt_digest(df: DataFrame) -> DataFrame:
    return df.select("seq", F.md5("prompt").alias("prompt_md5"), tx.n_chars(F.col("prompt")).alias("n_chars"))


@query
def build_prompt(spark, d):
    return _prompt_digest(prompts.build_prompt(b.samples(spark, d), tables.load_taxonomy(spark)))


@query
def build_compact_prompt(spark, d):
    return _prompt_digest(prompts.build_prompt(b.samples(spark, d), tables.load_taxonomy(spark), compact=True))


@query
def prompt_hash(spark, d):
    return b.hashed(spark, d).select("seq", "prompt_hash")


@query
def parse_response(spark, d):
    return b.parsed(spark, d).select("seq", "parsed.*")


@query
def parse_chat(spark, d):
    return responses.parse_response(b.chat(spark, d)).select("conv_id", "turn", "question", "parsed.*")


def _messy_verdict() -> Column:
    known = F.when(F.col("is_misclassified"), fixed.INCORRECT).otherwise(fixed.CORRECT)
    s = b.shape()
    return (
        F.when(s < 3, known)
        .when(s == 3, F.lower(known))
        .when(s == 4, F.upper(known))
        .when(s == 5, F.concat(F.lit(" "), known, F.lit("\n")))
        .when(s == 6, F.lit("uncertain"))
        .when(s == 7, F.concat(F.lit("["), known, F.lit("]")))
        .when(s == 8, F.lit(""))
    )


@query
def normalize_verdict(spark, d):
    verdict = _messy_verdict()
    return b.samples(spark, d).select(
        "seq", verdict.alias("raw_verdict"), responses.normalize_verdict(verdict).alias("verdict")
    )


@query
def check_lengths(spark, d):
    """Length limits on answers, and on documents taken as reasoning, explanation and answer at once."""
    cols = ("kind", "seq", "raw_response", "reasoning", "explanation")
    given = b.parsed(spark, d).select(
        F.lit("answer").alias("kind"), "seq", "raw_response", "parsed.reasoning", "parsed.explanation"
    )
    texts = b.documents(spark, d).select(
        F.lit("document").alias("kind"), "seq", *[F.col("text").alias(n) for n in cols[2:]]
    )
    checked = responses.check_lengths(given.unionByName(texts))
    return checked.select("kind", "seq", "reasoning", "explanation", joined("length_issues").alias("issues"))


def _all_texts(spark, d) -> DataFrame:
    def rows(df, kind, key, column):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(column).alias("body"))

    return (
        rows(b.answers(spark, d), "answer", "seq", "raw_response")
        .unionByName(rows(b.documents(spark, d), "document", "seq", "text"))
        .unionByName(rows(b.table(spark, d, "pages"), "page", "page_id", "html"))
        .unionByName(rows(b.chat(spark, d).withColumn("key", F.col("conv_id") * 1000 + F.col("turn")), "chat", "key", "raw_response"))
    )


@query
def detect_injection(spark, d):
    return responses.detect_injection(_all_texts(spark, d), "body").select("kind", "key", "suspicious")


@query
def detect_injection_bounded(spark, d):
    found = responses.detect_injection(_all_texts(spark, d), "body", word_bounded=True)
    return found.select("kind", "key", "suspicious")


@query
def injection_matches(spark, d):
    return responses.injection_matches(_all_texts(spark, d), "body").select("kind", "key", "pattern_ordinal")


def _checked(df: DataFrame) -> DataFrame:
    c = F.col("checked")
    return df.select(
        "seq",
        c["is_valid"].alias("is_valid"),
        joined(c["issues"]).alias("issues"),
        c["verdict"].alias("verdict"),
        c["label"].alias("label"),
        c["reasoning"].alias("reasoning"),
        c["explanation"].alias("explanation"),
    )


@query
def validate_output(spark, d):
    return _checked(b.validated(spark, d))


@query
def validate_output_lenient(spark, d):
    return _checked(b.validated(spark, d, strict=False))


@query
def validate_preparsed(spark, d):
    """Pre-parsed answers with verdicts in any spelling."""
    given = b.samples(spark, d).withColumn("raw_response", F.lit("")).withColumn(
        "parsed",
        F.struct(
            _messy_verdict().alias("verdict"),
            F.col("text").alias("reasoning"),
            F.lower("pred_label").alias("suggested_label"),
            F.lit("ok").alias("explanation"),
        ),
    )
    return _checked(responses.validate_output(given, tables.load_taxonomy(spark)))


def _flat_results(df: DataFrame) -> DataFrame:
    """Issues joined; the latency, which may be null, as text (data frames turn such integers into floats)."""
    if "latency_ms" in df.columns:
        df = df.withColumn("latency_ms", F.col("latency_ms").cast("string"))
    return df.withColumn("_validation_issues", joined(F.col("_validation_issues")))


@query
def assemble_results(spark, d):
    return _flat_results(b.results(spark, d))


@query
def assemble_errors(spark, d):
    return _flat_results(b.results(spark, d, failures=True))


@query
def mark_untrusted(spark, d):
    return b.results(spark, d).groupBy("_untrusted").agg(F.count("*").alias("n_rows"))


@query
def mock_review(spark, d):
    return mock_results(spark, d)


@query
def redact_text(spark, d):
    return privacy.redact_text(b.documents(spark, d), "text")


@query
def redact_results(spark, d):
    shown = privacy.redact_results(b.results(spark, d))
    return shown.select("seq", "text", "reasoning", "explanation", "suggested_label")


@query
def redact_results_full(spark, d):
    shown = privacy.redact_results(b.results(spark, d), all_free_text=True)
    return shown.select("seq", "text", "reasoning", "explanation", "suggested_label")


@query
def pii_flags(spark, d):
    return privacy.with_pii_flags(b.documents(spark, d)).drop("text")


@query
def is_synthetic_id(spark, d):
    number = F.col("seq").cast("string")
    ids = (
        F.when(b.shape() < 3, noise.sample_ids(b.SEED, F.col("seq")))
        .when(b.shape() < 6, F.concat(F.lit("synth_"), number))
        .otherwise(F.concat(F.lit("row_"), number))
    )
    return b.documents(spark, d).select(ids.alias("id")).withColumn(
        "is_synthetic", privacy.is_synthetic_id(F.col("id"))
    )


@query
def corrected_label(spark, d):
    kept = me.with_corrected_label(b.results(spark, d))
    strict = me.with_corrected_label(kept.withColumnRenamed("corrected_label", "any_verdict"), True)
    return strict.select("seq", "any_verdict", F.col("corrected_label").alias("only_incorrect"))


@query
def labeled_dataset(spark, d):
    return me.labeled_dataset(b.results(spark, d))


@query
def correction_snippets(spark, d):
    return me.correction_snippets(b.results(spark, d))


@query
def word_count(spark, d):
    return b.documents(spark, d).select("seq", tx.word_count(F.col("text")).alias("n_words"))


@query
def response_json(spark, d):
    """Cache responses written as JSON, some damaged, and read again."""
    as_text = ca.response_to_json(b.cache(spark, d))
    damage = draw_int(b.SEED, "damage", F.col("prompt_hash"), 10)
    damaged = as_text.withColumn(
        "response",
        F.when(damage == 0, "{").when(damage == 1, "[]").when(damage == 2, "{}").otherwise(F.col("response")),
    )
    read = ca.response_from_json(damaged)
    r = F.col("response")
    return read.select("prompt_hash", r.isNotNull().alias("usable"), "response.verdict", "response.reasoning",
                       "response.suggested_label", "response.explanation", "response.success",
                       r["latency_ms"].cast("string").alias("latency_ms"))


# Filters


@query
def filter_incorrect(spark, d):
    return me.filter_incorrect(b.results(spark, d)).select("seq", "sample_id", "verdict", "suggested_label")


@query
def filter_pii_rows(spark, d):
    return privacy.filter_pii_rows(b.documents(spark, d))


@query
def ttl_filter(spark, d):
    return ca.ttl_filter(b.cache(spark, d), b.NOW).select("prompt_hash", "created_at")


@query
def cache_identity(spark, d):
    return ca.cache_identity(b.cache(spark, d), fixed.PROMPT_VERSION, b.MODEL).select("prompt_hash", "version", "model")


@query
def failed_rows(spark, d):
    return me.failed_rows(b.results(spark, d, failures=True)).select("seq", "reasoning", "error", "success")


# Joins


@query
def validate_label(spark, d):
    labels = b.parsed(spark, d).select("seq", F.col("parsed.suggested_label").alias("suggested_label"))
    s = b.shape()
    spelled = (
        F.when(s == 0, F.upper("suggested_label"))
        .when(s == 1, F.concat(F.lit(" "), "suggested_label"))
        .when(s == 2, F.coalesce("suggested_label", F.lit("N/A")))
        .otherwise(F.col("suggested_label"))
    )
    return responses.validate_label(labels.withColumn("suggested_label", spelled), tables.load_taxonomy(spark))


@query
def cache_lookup(spark, d):
    found = ca.cache_lookup(b.hashed(spark, d).drop("prompt"), live_cache(spark, d))
    return found.select(
        "seq", "prompt_hash", "cache_hit", "verdict", "reasoning", "suggested_label", "explanation",
        F.col("latency_ms").cast("string").alias("latency_ms"),
    )


@query
def cache_misses(spark, d):
    return ca.cache_misses(b.hashed(spark, d).select("seq", "prompt_hash"), live_cache(spark, d), "seq")


@query
def miss_prompts_distinct(spark, d):
    missed = ca.cache_misses(ca.distinct_requests(b.hashed(spark, d)), live_cache(spark, d))
    return missed.select("prompt_hash", "n_rows", "seq", F.md5("prompt").alias("prompt_md5"))


@query
def review_join_back(spark, d):
    batch = review.review_batch(b.samples(spark, d), tables.load_taxonomy(spark))
    return batch.results.select("seq", "sample_id", "prompt_hash", "verdict", "suggested_label", "ground_truth")


@query
def static_confusion(spark, d):
    found = noise.static_confusion(
        b.labelled(spark, d), tables.load_taxonomy(spark), tables.load_patterns(spark), b.SEED
    )
    return found.select("seq", "ground_truth", "confused")


@query
def label_membership(spark, d):
    """Suggestions inside and outside the taxonomy."""
    labels = b.parsed(spark, d).select("seq", F.col("parsed.suggested_label").alias("label"))
    known = tables.load_taxonomy(spark)
    inside = ta.label_membership(labels, "label", known).withColumn("known", F.lit(True))
    return inside.unionByName(ta.label_membership(labels, "label", known, False).withColumn("known", F.lit(False)))


# Aggregations


@query
def verdict_metrics(spark, d):
    return me.verdict_metrics(b.results(spark, d))


@query
def verdict_distribution(spark, d):
    messy = b.samples(spark, d).select(_messy_verdict().alias("verdict"))
    return me.verdict_distribution(messy)


@query
def label_distribution(spark, d):
    return me.label_distribution(b.samples(spark, d))


@query
def pii_summary(spark, d):
    docs = b.documents(spark, d).withColumn("id", noise.sample_ids(b.SEED, F.col("seq")))
    return privacy.pii_summary(docs).withColumn("detected_patterns", joined(F.col("detected_patterns"), ","))


@query
def pii_pattern_counts(spark, d):
    return privacy.pii_pattern_counts(b.documents(spark, d))


@query
def validation_stats(spark, d):
    return responses.validation_stats(b.validated(spark, d))


@query
def cache_stats(spark, d):
    requests = b.hashed(spark, d).groupBy("prompt_hash").agg(F.count("*").alias("n_rows"))
    return ca.cache_stats(requests, live_cache(spark, d))


@query
def success_count(spark, d):
    return me.success_count(b.results(spark, d, failures=True))


@query
def taxonomy_block(spark, d):
    """The list of all sources, eight lines to a part."""
    labels = b.source_taxonomy(spark, d)
    full = ta.taxonomy_block(labels, part_labels=8).withColumn("style", F.lit("full"))
    return full.unionByName(ta.taxonomy_block(labels, True, 8).withColumn("style", F.lit("compact")))


@query
def valid_labels(spark, d):
    return ta.valid_labels(b.source_taxonomy(spark, d))


@query
def generator_metadata(spark, d):
    observed = b.observed_pairs(spark, d)
    labels = tables.load_taxonomy(spark)
    listed = noise.generator_metadata(labels, observed, b.SEED, False)
    return listed.unionByName(noise.generator_metadata(labels, observed, b.SEED, True))


@query
def normalize_results(spark, d):
    """Result rows with fields knocked out, as readers see them."""
    s = b.shape()
    sparse = b.results(spark, d).select(
        "seq",
        F.when(s != 0, F.col("verdict")).alias("verdict"),
        F.when(s != 1, F.col("pred_label")).alias("pred_label"),
        F.when(s != 2, F.col("text")).alias("text"),
        F.when(s != 3, F.col("reasoning")).alias("reasoning"),
    )
    return me.normalize_results(sparse)


# Windows in relational form


@query
def confusion_preview(spark, d):
    labels = tables.load_taxonomy(spark)
    static = ta.static_preview(labels, b.observed_pairs(spark, d)).withColumn("mode", F.lit("static"))
    dynamic = ta.dynamic_preview(labels, b.observed_similarity(spark, d)).withColumn("mode", F.lit("dynamic"))
    return static.unionByName(dynamic).withColumn("confused_with", joined(F.col("confused_with")))


@query
def dynamic_confusion(spark, d):
    found = noise.dynamic_confusion(
        b.labelled(spark, d), tables.load_taxonomy(spark), tables.load_similarity(spark), b.SEED
    )
    return found.select("seq", "ground_truth", "confused")


@query
def first_pattern(spark, d):
    return ta.first_patterns(b.observed_pairs(spark, d))


@query
def similar_labels_topk(spark, d):
    top = ta.similar_labels(b.observed_similarity(spark, d))
    return top.select("actual", "candidate", "weight", F.col("rank").cast("bigint").alias("rank"))


# Sorts and limits


@query
def top_corrections(spark, d):
    return me.top_corrections(b.results(spark, d))


@query
def labels_by_first_seen(spark, d):
    return me.labels_by_first_seen(b.samples(spark, d))


# Set operations and table maintenance


@query
def merge_templates(spark, d):
    return ta.merge_templates(b.document_templates(spark, d), b.benchmark_templates(spark, d))


def _cache_columns(df: DataFrame) -> DataFrame:
    return df.select("prompt_hash", "version", "model", "created_at", "hit_count", "response.verdict", "response.suggested_label")


def _fresh_entries(spark: SparkSession, d: str) -> DataFrame:
    """What a scored batch adds to the cache."""
    reviewer = review.scoring_reviewer(_counting_scorer, concurrency=8)
    batch = review.review_batch(
        b.samples(spark, d), tables.load_taxonomy(spark), reviewer, cache=b.cache(spark, d), now=b.NOW, model=b.MODEL
    )
    return ca.cache_entries(batch.reviews, b.NOW, model=b.MODEL)


@query
def cache_upsert(spark, d):
    return _cache_columns(ca.cache_upsert(b.cache(spark, d), _fresh_entries(spark, d)))


@query
def cache_upsert_side_by_side(spark, d):
    """The variant that keeps entries of other versions and models."""
    key = ("prompt_hash", "version", "model")
    return _cache_columns(ca.cache_upsert(b.cache(spark, d), _fresh_entries(spark, d), key))


@query
def cache_expire(spark, d):
    return _cache_columns(ca.cache_expire(b.cache(spark, d), b.NOW))


@query
def cache_touch(spark, d):
    hits = b.hashed(spark, d).select("prompt_hash").join(
        live_cache(spark, d).select("prompt_hash"), "prompt_hash", "left_semi"
    )
    return _cache_columns(ca.cache_touch(b.cache(spark, d), hits, fixed.PROMPT_VERSION, b.MODEL))


@query
def cache_clear(spark, d):
    full = b.cache(spark, d)
    left = ca.cache_clear(full).agg(F.count("*").alias("n")).scalar()
    return full.agg(F.count("*").alias("n_before")).withColumn("n_after", left)


@query
def cache_upkeep(spark, d):
    """The same on a stored cache: days expire as folders, hits rewrite the folders they meet, answers are stored again."""
    path = fresh_path(spark, "cache")
    cache_table.create_cache(b.cache(spark, d), path)
    cache_table.expire_stored(spark, path, b.NOW)
    live = ca.live_entries(cache_table.open_cache(spark, path, b.NOW), b.NOW, model=b.MODEL)
    hits = b.hashed(spark, d).select("prompt_hash").join(live.select("prompt_hash"), "prompt_hash", "left_semi")
    cache_table.touch_stored(spark, path, hits, fixed.PROMPT_VERSION, b.MODEL)
    return _cache_columns(cache_table.open_cache(spark, path, b.NOW))


@query
def cache_versions(spark, d):
    """Entries per version, and how many a run under each version could use."""
    path = fresh_path(spark, "cache")
    tables.write_cache(b.cache(spark, d), path)
    stored = tables.read_cache(spark, path)
    counts = stored.groupBy("version").agg(F.count("*").alias("n_rows"))
    usable = [
        ca.live_entries(stored, b.NOW, version, b.MODEL).agg(
            F.lit(version).alias("version"), F.count("*").alias("n_usable")
        )
        for version in (b.OLD_VERSION, fixed.PROMPT_VERSION)
    ]
    return counts.join(usable[0].unionByName(usable[1]), "version")


@query
def union_results(spark, d):
    """Cached, fresh and failed rows in one result set."""
    found = b.results(spark, d, failures=True).drop("text")
    hits = ca.cache_lookup(b.hashed(spark, d).drop("prompt", "text"), live_cache(spark, d)).filter("cache_hit")
    missed = found.join(hits.select("seq"), "seq", "left_anti")
    both = review.union_results(
        hits.withColumnRenamed("id", "sample_id").drop("is_misclassified"),
        missed.filter("success"),
        missed.filter("NOT success"),
    )
    return both.select("seq", "sample_id", "cache_hit", "success", "verdict", "reasoning", "suggested_label", "error")


# Noise


@query
def inject_label_noise(spark, d):
    return b.samples(spark, d).drop("text", "id")


@query
def inject_label_noise_dynamic(spark, d):
    return b.samples(spark, d, dynamic=True).drop("text", "id")


@query
def confidence_draw(spark, d):
    noisy = noise.noisy_flag(b.SEED, fixed.NOISE_RATE, F.col("seq"))
    return b.documents(spark, d).select("seq", noise.confidence_draw(b.SEED, noisy, F.col("seq")).alias("confidence"))


@query
def assign_labels(spark, d):
    return b.labelled(spark, d).select("seq", "ground_truth")


@query
def expand_templates(spark, d):
    """One template text per document row; templates are the benchmark texts."""
    rows = b.documents(spark, d).select("seq")
    return noise.expand_templates(rows, b.label_templates(spark, d), tables.load_taxonomy(spark), b.SEED)


@query
def generate_samples(spark, d):
    return noise.generate_samples(
        b.documents(spark, d), b.label_templates(spark, d), tables.load_taxonomy(spark),
        tables.load_patterns(spark), b.SEED,
    )


# Scoring and whole runs


def _counting_scorer():
    """A stand-in for a model: judges by prompt length and refuses some prompts for good."""

    def score(batch):
        if any(len(p) % 11 == 0 for p in batch):
            raise scoring.ScorerError("refused", 404)
        return [f"VERDICT: {fixed.VERDICTS[len(p) % 3]}\nREASONING: {len(p)} characters" for p in batch]

    return score


@query
def score_prompts(spark, d):
    requests = ca.distinct_requests(b.hashed(spark, d))
    return scoring.score_prompts(requests, _counting_scorer, concurrency=8).select(
        "prompt_hash", "n_rows", "raw_response", "error"
    )


@query
def review_batch(spark, d):
    batch = review.review_batch(
        b.samples(spark, d), tables.load_taxonomy(spark), cache=b.cache(spark, d), now=b.NOW, model=b.MODEL
    )
    return _flat_results(batch.results)


@query
def review_batch_scored(spark, d):
    """The same with a Python scorer; refused prompts become error rows."""
    batch = review.review_batch(
        b.samples(spark, d), tables.load_taxonomy(spark), review.scoring_reviewer(_counting_scorer, concurrency=8),
        cache=b.cache(spark, d), now=b.NOW, model=b.MODEL,
    )
    return _flat_results(batch.results.drop("latency_ms"))


@query
def audit_run(spark, d):
    return audit.audit(
        b.samples(spark, d), tables.load_taxonomy(spark), cache=b.cache(spark, d), now=b.NOW, model=b.MODEL
    )


def _audited(spark, d):
    """A whole run with a scorer and a cache."""
    return audit.run_audit(
        b.samples(spark, d), tables.load_taxonomy(spark), fresh_path(spark, "run"), RUN_ID, b.SEED,
        review.scoring_reviewer(_counting_scorer, concurrency=8), b.cache(spark, d), b.NOW, b.MODEL,
    )


@query
def audit_pipeline(spark, d):
    return me.label_verdicts(_audited(spark, d).results)


@query
def audit_next_cache(spark, d):
    """The cache that a run leaves: nothing expired, hits counted, fresh answers stored."""
    left = _audited(spark, d).cache
    return left.select(
        "prompt_hash", "version", "model", "created_at", "hit_count",
        F.col("response.verdict").alias("verdict"), F.col("response.suggested_label").alias("suggested_label"),
    )


@query
def confusion_matrix(spark, d):
    return me.confusion_matrix(b.results(spark, d))


@query
def worst_labels(spark, d):
    return me.worst_labels(b.results(spark, d))


@query
def escalation_queue(spark, d):
    return me.escalation_queue(b.results(spark, d)).select("seq", "sample_id", "pred_label", "confidence", "verdict")


@query
def reviewer_agreement(spark, d):
    return me.reviewer_agreement(b.results(spark, d))


@query
def latency_summary(spark, d):
    return me.latency_summary(b.results(spark, d, failures=True))


@query
def stream_audit(spark, d):
    """Documents read as a stream, checked for injections and personal data, then counted."""
    schema = b.table(spark, d, "documents").schema
    # A pattern, because it meets one file as well as a folder of part files; the stream's own filter only knows file names.
    stream = audit_stream.read_stream(spark, f"{d}/documents.parque[t]", schema, "*")
    rows = responses.detect_injection(stream, "text")
    rows = privacy.with_pii_flags(rows).withColumn("has_pii", privacy.any_flag())
    out = fresh_path(spark, "stream")
    audit_stream.run_available(rows.select("doc_id", "lang", "suspicious", "has_pii"), f"{out}/rows", f"{out}/log")
    done = spark.read.schema("doc_id bigint, lang string, suspicious boolean, has_pii boolean").parquet(f"{out}/rows")
    return done.groupBy("lang", "suspicious", "has_pii").agg(F.count("*").alias("n_rows"))


def _streamed(spark, d) -> str:
    """All samples as a stream, then all of them once more; verdicts are counted after each batch."""
    out = fresh_path(spark, "stream")
    samples = b.samples(spark, d)
    scorer = review.scoring_reviewer(_counting_scorer, concurrency=8)
    for turn in range(2):
        again = samples.withColumn("seq", F.col("seq") + turn * 1_000_000_000)
        again.write.mode("append").option("compression", TEXT_CODEC).parquet(f"{out}/samples")
        stream = audit_stream.read_stream(spark, f"{out}/samples", samples.schema)
        audit_stream.review_stream_cached(
            stream, tables.load_taxonomy(spark), scorer, f"{out}/reviewed", f"{out}/log", lambda k: b.NOW + k, model=b.MODEL
        )
        results = audit_stream.read_stream(spark, f"{out}/reviewed/results", schemas.RESULTS)
        audit_stream.count_available(results, f"{out}/counts", f"{out}/count-log")
    return out


@query
def stream_cached_review(spark, d):
    """Rows per batch of a reviewed stream: the second batch hits what the first one stored."""
    done = spark.read.parquet(f"{_streamed(spark, d)}/reviewed/results")
    return done.groupBy("batch", "verdict", "cache_hit", "success").agg(F.count("*").alias("n_rows"))


@query
def stream_running_verdicts(spark, d):
    """The counts of a reviewed stream after each batch."""
    return spark.read.parquet(f"{_streamed(spark, d)}/counts")


@query
def run_counters(spark, d):
    """Totals, validation and cache counters that a whole run has written into its metrics."""
    path = _audited(spark, d).paths["metrics"]
    names = "total correct incorrect uncertain validation_failures invalid_labels_rejected hits misses persistent_hits cached_prompts rows_done"
    return spark.read.schema(", ".join(f"{n} bigint" for n in names.split()) + ", hit_rate double").json(path)

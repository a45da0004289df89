"""Reviews: the rule-based mock reviewer, result rows and the cached batch review."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from secondlook import fixed, schemas
from secondlook.functions.text import null_if_empty, or_empty
from secondlook.operators import scoring
from secondlook.operators.cache import CACHED_FIELDS, distinct_requests, live_entries
from secondlook.operators.prompts import PROMPT_PARTS, build_prompt, with_prompt_hash
from secondlook.operators.responses import parse_response, validate_output
from secondlook.operators.skew import spread_lookup
from secondlook.session import is_written, stage

SAMPLE_FIELDS = ("seq", "text", "pred_label", "confidence", "ground_truth")


def mock_fields(pred_label: Column, ground_truth: Column, is_misclassified: Column) -> dict[str, Column]:
    """Verdict, suggestion and sentences of the rule-based reviewer."""
    wrong = F.coalesce(is_misclassified, F.lit(False))
    suggested = F.when(wrong, F.coalesce(ground_truth, F.lit(fixed.UNKNOWN_LABEL)))
    before, between, after = fixed.MOCK_WRONG
    head, tail = fixed.MOCK_EXPLANATION
    return {
        "verdict": F.when(wrong, fixed.INCORRECT).otherwise(fixed.CORRECT),
        "reasoning": F.when(
            wrong,
            F.concat(F.lit(before), suggested, F.lit(between), or_empty(pred_label), F.lit(after)),
        ).otherwise(fixed.MOCK_OK),
        "suggested_label": suggested,
        "explanation": F.concat(
            F.lit(head), F.coalesce(null_if_empty(suggested), pred_label, F.lit("")), F.lit(tail)
        ),
    }


def mock_review(samples: DataFrame) -> DataFrame:
    """Review by comparing with the known truth; no prompt, no cache."""
    schemas.require_columns(samples, ("id", "text", "pred_label", "confidence"), "samples")
    for name in schemas.OPTIONAL_SAMPLE_COLUMNS:
        if name not in samples.columns:
            samples = samples.withColumn(name, F.lit(None).cast(schemas.SAMPLES[name].dataType))
    fields = mock_fields(F.col("pred_label"), F.col("ground_truth"), F.col("is_misclassified"))
    return samples.select(
        F.col("id").alias("sample_id"),
        *[c for c in SAMPLE_FIELDS if c in samples.columns],
        *[c.alias(n) for n, c in fields.items()],
        F.lit(True).alias("success"),
        F.lit(True).alias("_untrusted"),
    )


def rendered_answer(fields: dict[str, Column]) -> Column:
    """The four-line answer text a reviewer would send."""
    return F.concat(
        F.lit("VERDICT: "), fields["verdict"],
        F.lit("\nREASONING: "), fields["reasoning"],
        F.lit("\nSUGGESTED_LABEL: "), F.coalesce(fields["suggested_label"], F.lit("None")),
        F.lit("\nEXPLANATION: "), fields["explanation"],
    )


@dataclass(frozen=True)
class Reviewer:
    """How distinct requests get answered.

    ``needs`` names the sample columns a request must carry; ``answer`` adds (raw_response, latency_ms,
    error) to requests that the cache did not answer. ``outside`` names columns that the answer depends on
    though the prompt does not hold them: rows with one prompt but different values there are asked
    separately, and such answers are not for the cache.
    """

    needs: tuple[str, ...]
    answer: Callable[[DataFrame], DataFrame]
    outside: tuple[str, ...] = ()


def _mock_answers(requests: DataFrame) -> DataFrame:
    fields = mock_fields(F.col("pred_label"), F.col("ground_truth"), F.col("is_misclassified"))
    return requests.withColumns(
        {
            "raw_response": rendered_answer(fields),
            "latency_ms": F.lit(0).cast("bigint"),
            "error": F.lit(None).cast("string"),
        }
    )


MOCK_REVIEWER = Reviewer(
    ("pred_label", "ground_truth", "is_misclassified"), _mock_answers, ("ground_truth", "is_misclassified")
)


def scoring_reviewer(make_scorer, **options) -> Reviewer:
    """A reviewer that sends prompts to a scorer; options as in ``score_prompts``."""

    def answer(requests: DataFrame) -> DataFrame:
        return scoring.score_prompts(requests, make_scorer, **options)

    return Reviewer(("prompt",), answer)


def _success_fields() -> dict[str, Column]:
    issues = F.col("checked.issues")
    return {
        "verdict": F.col("checked.verdict"),
        "reasoning": F.col("checked.reasoning"),
        "suggested_label": F.col("checked.label"),
        "explanation": F.col("checked.explanation"),
        "success": F.lit(True),
        "_validation_issues": F.when(F.size(issues) > 0, issues),
    }


def _error_fields() -> dict[str, Column]:
    return {
        "verdict": F.lit(fixed.UNCERTAIN),
        "reasoning": F.concat(F.lit("Error: "), F.col("error")),
        "suggested_label": F.lit(None).cast("string"),
        "explanation": F.lit(fixed.FAILED_EXPLANATION),
        "success": F.lit(False),
        "_validation_issues": F.lit(None).cast("array<string>"),
    }


def assemble_reviews(validated: DataFrame) -> DataFrame:
    """One review per cached, validated or failed answer, without sample fields.

    ``cached`` (null for a miss) wins; failed answers (``error`` set) become Uncertain rows. What the
    check found is not kept in the cache, so hits have no issues.
    """
    cached, failed = F.col("cached"), F.col("error").isNotNull()
    hit = cached.isNotNull()
    good, bad = _success_fields(), _error_fields()
    chosen = {
        name: F.when(hit, cached[name] if name in CACHED_FIELDS else F.lit(None))
        .when(failed, bad[name])
        .otherwise(good[name])
        for name in good
    }
    chosen["latency_ms"] = F.when(hit, cached["latency_ms"]).otherwise(F.col("latency_ms"))
    return validated.withColumns(
        {**chosen, "cache_hit": hit, "_untrusted": F.lit(True)}
    )


def _result_columns(df: DataFrame) -> DataFrame:
    """Project to the result layout; a failed row shows neither hash nor latency."""
    row = {f.name: f.dataType for f in schemas.RESULTS}
    hidden = {n: F.when(F.col("success"), F.col(n)) for n in ("prompt_hash", "latency_ms")}
    picked = []
    for name, kind in row.items():
        value = hidden.get(name, F.col(name)) if name in df.columns else F.lit(None)
        picked.append(value.cast(kind).alias(name))
    return df.select(*picked)


def assemble_results(validated: DataFrame) -> DataFrame:
    """Result rows for freshly scored answers that came with their sample: success and error rows.

    Expects the sample columns with ``sample_id``, ``prompt_hash``, ``latency_ms``, ``error``, ``checked``.
    """
    if "cached" not in validated.columns:
        validated = validated.withColumn("cached", F.lit(None).cast(schemas.CACHE_RESPONSE))
    return _result_columns(assemble_reviews(validated))


def union_results(*parts: DataFrame) -> DataFrame:
    """One result set from cached, fresh and failed rows; columns a part lacks become null."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union


@dataclass(frozen=True)
class BatchReview:
    """``reviews``: one row per distinct request (``n_rows`` samples wait for it); ``results``: one row
    per sample."""

    reviews: DataFrame
    results: DataFrame
    counters: dict


def review_counters() -> list[Column]:
    """Aggregates over reviews: what the check found, and how the cache did."""
    hit, rows = F.col("cache_hit"), F.col("n_rows")
    kept = hit | (F.col("success") & F.col("cacheable"))
    return [
        F.count_if("suspicious").alias("validation_failures"),
        F.count_if("label_rejected").alias("invalid_labels_rejected"),
        F.coalesce(F.sum(F.when(hit, rows)), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(~hit, rows)), F.lit(0)).alias("misses"),
        F.count_if(hit).alias("persistent_hits"),
        F.count_if(kept).alias("cached_prompts"),
        F.coalesce(F.sum(F.when(F.col("success"), rows)), F.lit(0)).alias("rows_done"),
    ]


def _kept_reviews(reviews: DataFrame, path: str | None) -> tuple[DataFrame, dict]:
    """The reviews, written once, and their counters, which are taken while they are written."""
    seen = Observation()
    counted = reviews.observe(seen, *review_counters())
    if path is None:
        return stage(counted, "reviews"), dict(seen.get)
    counted.write.mode("overwrite").parquet(path)
    return reviews.sparkSession.read.schema(reviews.schema).parquet(path), dict(seen.get)


REVIEW_COLUMNS = (
    "request", "prompt_hash", "n_rows", "verdict", "reasoning", "suggested_label", "explanation", "success",
    "latency_ms", "cache_hit", "error", "_untrusted", "_validation_issues", "suspicious", "label_rejected", "cacheable",
)


def request_key(outside: tuple[str, ...]) -> Column:
    """What rows share that get one answer: the prompt, and the columns outside it that the answer depends on."""
    if not outside:
        return F.col("prompt_hash")
    values = F.to_json(F.struct(*outside), {"ignoreNullFields": "false"})
    return F.md5(F.concat(F.col("prompt_hash"), F.lit(":"), values))


#: What all requests keep, whoever answers them.
REQUEST_COLUMNS = ("request", "prompt_hash", "n_rows", "seq")


def carried_columns(needs: tuple[str, ...]) -> list[str]:
    """The sample columns that a request takes along: the parts of a prompt instead of the prompt."""
    parts = PROMPT_PARTS if "prompt" in needs else ()
    return list(dict.fromkeys([*(n for n in needs if n != "prompt"), *parts]))


def answered_requests(
    requests: DataFrame, found: DataFrame | None, reviewer: Reviewer, with_prompt: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Requests with ``cached`` or an answer: only those that the cache lacks get a prompt and reach the reviewer."""
    nothing, new = F.lit(None), ("raw_response", "latency_ms", "error")

    def answered(part: DataFrame) -> DataFrame:
        if "prompt" in reviewer.needs:
            part = with_prompt(part)
        told = reviewer.answer(part.select(*REQUEST_COLUMNS, *[n for n in reviewer.needs if n not in REQUEST_COLUMNS]))
        return told.select(*REQUEST_COLUMNS, *new, nothing.cast(schemas.CACHE_RESPONSE).alias("cached"))

    if found is None:
        return answered(requests)
    hits = requests.join(found, "prompt_hash").select(
        *REQUEST_COLUMNS,
        nothing.cast("string").alias("raw_response"),
        nothing.cast("bigint").alias("latency_ms"),
        nothing.cast("string").alias("error"),
        "cached",
    )
    return answered(requests.join(found, "prompt_hash", "left_anti")).unionByName(hits)


def checked_reviews(answered: DataFrame, taxonomy: DataFrame, strict: bool, cacheable: bool) -> DataFrame:
    """Answers parsed and validated: one row of ``REVIEW_COLUMNS`` per request."""
    fresh = F.col("cached").isNull() & F.col("error").isNull()
    counted = {
        "suspicious": fresh & F.coalesce("checked.suspicious", F.lit(False)),
        "label_rejected": fresh & F.coalesce("checked.label_rejected", F.lit(False)),
        "cacheable": F.lit(cacheable),
    }
    validated = validate_output(parse_response(answered), taxonomy, strict)
    return assemble_reviews(validated).withColumns(counted).select(*REVIEW_COLUMNS)


def review_batch(
    samples: DataFrame,
    taxonomy: DataFrame,
    reviewer: Reviewer = MOCK_REVIEWER,
    cache: DataFrame | None = None,
    now: float | None = None,
    version: str = fixed.PROMPT_VERSION,
    model: str = fixed.DEFAULT_MODEL,
    ttl_seconds: float = fixed.CACHE_TTL_SECONDS,
    strict: bool = True,
    compact: bool = False,
    template: str | None = None,
    reviews_path: str | None = None,
) -> BatchReview:
    """Review all samples: each distinct request is looked up once, and scored once if that fails.

    1. Reduce the samples to distinct requests (map-side, so copies do not travel). They carry a prompt's parts, not the
       prompt, and lie by its hash, so that the lookup does not move them again.
    2. Look the requests up in the cache by their prompts' hashes; ``now`` decides what has expired.
    3. Answer the misses alone, parse, validate, and write the reviews to the shared folder: a lost executor
       must not repeat scoring calls, and the next step reads the reviews more than once. With ``reviews_path`` they are
       kept there, and taken from there if an earlier attempt at the same batch has already written them.
    4. Hand the reviews back to the samples, hot prompts split.
    """
    if cache is not None and now is None:
        raise ValueError("a cache needs the time of the review: pass now")
    hashed = with_prompt_hash(samples, taxonomy, version, compact, template)
    for name in schemas.OPTIONAL_SAMPLE_COLUMNS:
        if name not in hashed.columns:
            hashed = hashed.withColumn(name, F.lit(None).cast(schemas.SAMPLES[name].dataType))
    hashed = hashed.withColumn("request", request_key(reviewer.outside))
    if reviews_path is not None and is_written(samples.sparkSession, reviews_path):
        reviews = samples.sparkSession.read.parquet(reviews_path).select(*REVIEW_COLUMNS)
        counters = reviews.agg(*review_counters()).first().asDict()
    else:
        carried = carried_columns(reviewer.needs)
        if reviewer.outside:
            requests = distinct_requests(hashed, carried, keys=("request", "prompt_hash"))
        else:
            requests = distinct_requests(hashed, carried).withColumn("request", F.col("prompt_hash"))
        found = None
        if cache is not None:
            live = live_entries(cache, now, version, model, ttl_seconds)
            found = live.select("prompt_hash", F.col("response").alias("cached"))
        answered = answered_requests(requests, found, reviewer, lambda r: build_prompt(r, taxonomy, compact, template))
        reviews, counters = _kept_reviews(checked_reviews(answered, taxonomy, strict, not reviewer.outside), reviews_path)

    rows = hashed.withColumnRenamed("id", "sample_id").drop("prompt", "prompt_hash", "is_misclassified")
    sizes = reviews.select("request", "n_rows")
    joined = spread_lookup(rows, reviews.drop("n_rows"), "request", "seq", sizes, how="inner")
    return BatchReview(reviews, _result_columns(joined), counters)

"""The whole audit: scan, review, statistics and artifacts."""

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from secondlook import fixed
from secondlook.operators.cache import cache_entries, cache_expire, cache_touch, cache_upsert
from secondlook.operators.metrics import label_verdicts, verdict_counts, with_shares
from secondlook.operators.privacy import pii_summary
from secondlook.operators.review import MOCK_REVIEWER, Reviewer, mock_review, review_batch
from secondlook.session import TEXT_CODEC, StagedFolders, stage
from secondlook.sources import artifacts


def audit(samples: DataFrame, taxonomy: DataFrame, **options) -> DataFrame:
    """Rows per predicted label and verdict after a full review of all samples."""
    return label_verdicts(review_batch(samples, taxonomy, **options).results)


def next_snapshot(
    cache: DataFrame, reviews: DataFrame, now: float, version: str, model: str, ttl_seconds: float
) -> DataFrame:
    """The cache after a batch: without expired entries, hits counted, fresh answers stored."""
    kept = cache_expire(cache, now, ttl_seconds)
    touched = cache_touch(kept, reviews.filter("cache_hit"), version, model)
    return cache_upsert(touched, cache_entries(reviews, now, version, model))


@dataclass(frozen=True)
class AuditRun:
    summary: DataFrame
    pii: DataFrame
    results: DataFrame
    cache: DataFrame | None
    paths: dict[str, str]
    staged: StagedFolders

    def __enter__(self) -> "AuditRun":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Delete what the run has staged, unredacted texts among it; ``results`` and ``cache`` can't be read any more."""
        self.staged.remove()


def run_audit(
    samples: DataFrame,
    taxonomy: DataFrame,
    run_dir: str,
    run_id: str,
    seed: int = 0,
    reviewer: Reviewer | None = MOCK_REVIEWER,
    cache: DataFrame | None = None,
    now: float | None = None,
    model: str = fixed.DEFAULT_MODEL,
    version: str = fixed.PROMPT_VERSION,
    ttl_seconds: float = fixed.CACHE_TTL_SECONDS,
    redacted: bool = False,
    **options,
) -> AuditRun:
    """Review, report and save a run under ``run_dir``.

    ``reviewer=None`` takes the plain mock review without prompts or cache. The samples are read for their own artifact
    and for the results, which are staged once; totals, validation and cache counters are observed while results and reviews
    are written, and serve manifest, report, metrics and summary. Close the run (or use it in a ``with`` block) to delete
    the staged tables.
    """
    staged = StagedFolders(samples.sparkSession)
    with staged:
        return _run_audit(
            samples, taxonomy, run_dir, run_id, seed, reviewer, cache, now, model, version, ttl_seconds, redacted, options, staged
        )


def _run_audit(
    samples, taxonomy, run_dir, run_id, seed, reviewer, cache, now, model, version, ttl_seconds, redacted, options, staged
) -> AuditRun:
    spark = samples.sparkSession
    begun = time.monotonic()
    now = time.time() if now is None else now
    next_cache, counters = None, {}
    if reviewer is None:
        results = mock_review(samples)
    else:
        batch = review_batch(
            samples, taxonomy, reviewer, cache, now, version, model, ttl_seconds, **options
        )
        results, counters = batch.results, with_hit_rate(batch.counters)
        if cache is not None:
            next_cache = next_snapshot(cache, batch.reviews, now, version, model, ttl_seconds)

    seen = Observation()
    results = stage(results.observe(seen, *verdict_counts()), "results", compression=TEXT_CODEC)
    totals = with_shares(dict(seen.get))
    settings = {
        "run_id": run_id,
        "seed": seed,
        "use_llm": reviewer is not None and reviewer is not MOCK_REVIEWER,
        "model": model,
        "redacted": redacted,
        "strict_validation": options.get("strict", True),
    }
    paths = {
        "manifest": artifacts.save_manifest(samples, run_dir, settings, totals["total"]),
        "samples": artifacts.save_samples(samples, run_dir, redacted),
        "results": artifacts.save_results(results, run_dir, redacted),
        "labeled": artifacts.save_labeled(results, run_dir, redacted),
        "report": artifacts.save_report(results, run_dir, run_id, redacted=redacted, metrics=totals),
        "metrics": artifacts.save_observed_metrics(spark, totals | counters, run_dir, redacted),
    }
    row = {"run_id": run_id, **totals, "seconds": time.monotonic() - begun}
    kinds = {int: "bigint", float: "double", str: "string"}
    summary = spark.range(1).select(*[F.lit(v).cast(kinds[type(v)]).alias(k) for k, v in row.items()])
    return AuditRun(summary, pii_summary(samples), results, next_cache, paths, staged)


def with_hit_rate(counters: dict) -> dict:
    rows = counters["hits"] + counters["misses"]
    return counters | {"hit_rate": counters["hits"] / rows * 100 if rows else 0.0}

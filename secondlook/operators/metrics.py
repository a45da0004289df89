"""Counts and tables over review results."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondlook import fixed
from secondlook.functions.text import null_if_empty
from secondlook.operators.skew import spread_lookup
from secondlook.operators.taxonomy import dense_ordinals
from secondlook.session import stage

READER_DEFAULTS = {"verdict": fixed.UNCERTAIN, "pred_label": fixed.UNKNOWN_LABEL, "text": "", "reasoning": ""}


def normalize_results(results: DataFrame) -> DataFrame:
    """Fill in what readers assume for missing fields."""
    filled = {
        n: F.coalesce(F.col(n), F.lit(d)) if n in results.columns else F.lit(d)
        for n, d in READER_DEFAULTS.items()
    }
    return results.withColumns(filled)


def verdict_metrics(results: DataFrame) -> DataFrame:
    """One row: total, and count and percentage per verdict (all 0 without rows).

    Unknown verdicts count in the total only.
    """
    counts = results.agg(*verdict_counts())
    shares = {
        f"{n}_pct": F.when(F.col("total") > 0, F.col(n) / F.col("total") * 100).otherwise(F.lit(0.0))
        for n in VERDICT_NAMES
    }
    return counts.withColumns(shares)


VERDICT_NAMES = [v.lower() for v in fixed.VERDICTS]


def verdict_counts() -> list[Column]:
    """Aggregates of ``verdict_metrics``, for an aggregation or an observation."""
    verdict = F.coalesce("verdict", F.lit(fixed.UNCERTAIN))
    return [F.count(F.lit(1)).alias("total"), *[F.count_if(verdict == v).alias(n) for v, n in zip(fixed.VERDICTS, VERDICT_NAMES)]]


def with_shares(counts: dict) -> dict:
    """The values of ``verdict_metrics`` from observed counts."""
    total = counts["total"]
    return counts | {f"{n}_pct": counts[n] / total * 100 if total else 0.0 for n in VERDICT_NAMES}


def verdict_distribution(results: DataFrame) -> DataFrame:
    verdict = F.coalesce("verdict", F.lit(fixed.UNCERTAIN)).alias("verdict")
    return results.groupBy(verdict).agg(F.count("*").alias("n_rows"))


def label_distribution(results: DataFrame, order: str = "seq") -> DataFrame:
    """Rows per predicted label and where it was first seen."""
    label = F.coalesce("pred_label", F.lit(fixed.UNKNOWN_LABEL)).alias("label")
    return results.groupBy(label).agg(F.count("*").alias("n_rows"), F.min(order).alias("first_seq"))


def labels_by_first_seen(results: DataFrame, order: str = "seq") -> DataFrame:
    return label_distribution(results, order).orderBy("first_seq")


def label_verdicts(results: DataFrame) -> DataFrame:
    """Rows per predicted label and verdict."""
    return results.groupBy("pred_label", "verdict").agg(F.count("*").alias("n_rows"))


def success_count(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if(F.coalesce("success", F.lit(False))).alias("succeeded"), F.count("*").alias("total")
    )


def failed_rows(results: DataFrame) -> DataFrame:
    return results.filter(~F.coalesce("success", F.lit(False)))


def filter_incorrect(results: DataFrame) -> DataFrame:
    return results.filter(F.col("verdict") == fixed.INCORRECT)


def with_corrected_label(results: DataFrame, only_incorrect: bool = False) -> DataFrame:
    """Add ``corrected_label``: the suggestion if there is one, else the prediction."""
    suggestion = null_if_empty(F.col("suggested_label"))
    if only_incorrect:
        suggestion = F.when(F.col("verdict") == fixed.INCORRECT, suggestion)
    return results.withColumn("corrected_label", F.coalesce(suggestion, "pred_label"))


def labeled_dataset(results: DataFrame, only_incorrect: bool = False) -> DataFrame:
    return with_corrected_label(results, only_incorrect).select(
        F.col("sample_id").alias("id"),
        "text",
        F.col("pred_label").alias("original_label"),
        "verdict",
        "corrected_label",
        "reasoning",
        "ground_truth",
        F.lit(True).alias("_untrusted"),
    )


def correction_snippets(results: DataFrame) -> DataFrame:
    """Short view of the Incorrect rows for a report."""
    return filter_incorrect(results).select(
        "seq",
        F.left(F.coalesce("text", F.lit("")), F.lit(80)).alias("text"),
        F.col("pred_label").alias("predicted"),
        F.col("suggested_label").alias("suggested"),
        F.left(F.coalesce("reasoning", F.lit("")), F.lit(100)).alias("reasoning"),
    )


def top_corrections(results: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` corrections in input order; each task keeps only its own first ``k``."""
    return correction_snippets(results).orderBy("seq").limit(k)


def confusion_matrix(results: DataFrame) -> DataFrame:
    """Rows per predicted and corrected label."""
    corrected = with_corrected_label(results)
    return corrected.groupBy("pred_label", "corrected_label").agg(F.count("*").alias("n_rows"))


def worst_labels(results: DataFrame) -> DataFrame:
    """Predicted labels by their share of Incorrect rows, the highest first; equal shares have one rank.

    Ranks number the distinct shares: these are dealt into ranges and counted per range, so no task sees all of them, and
    each label looks its share's rank up.
    """
    shares = results.groupBy("pred_label").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("verdict") == fixed.INCORRECT).alias("incorrect")
    ).withColumn("incorrect_rate", F.col("incorrect") / F.col("n_rows"))
    shares = stage(shares, "shares")
    rates = shares.groupBy("incorrect_rate").agg(F.count("*").alias("n_rows"))
    places = rates.select("incorrect_rate", F.lit(0).alias("all"), (-F.col("incorrect_rate")).alias("falling"))
    ranks = dense_ordinals(places, "all", "falling").select("incorrect_rate", (F.col("ordinal") + 1).cast("int").alias("rank"))
    return spread_lookup(shares, ranks, "incorrect_rate", "pred_label", sizes=rates)


def escalation_queue(results: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows for a human: Uncertain, or predicted with less confidence than ``threshold``; the least sure first."""
    open_rows = results.filter((F.col("verdict") == fixed.UNCERTAIN) | (F.col("confidence") < threshold))
    return open_rows.orderBy(F.asc_nulls_first("confidence"), "seq")


def reviewer_agreement(results: DataFrame) -> DataFrame:
    """One row: how the reviewer's verdicts and suggestions compare with the known truth (rows without it left out)."""
    wrong = F.col("pred_label") != F.col("ground_truth")
    flagged = F.col("verdict") == fixed.INCORRECT
    counts = results.filter("ground_truth IS NOT NULL AND pred_label IS NOT NULL").agg(
        F.count("*").alias("total"),
        F.count_if(wrong & flagged).alias("true_positives"),
        F.count_if(~wrong & flagged).alias("false_positives"),
        F.count_if(wrong & ~F.coalesce(flagged, F.lit(False))).alias("false_negatives"),
        F.count_if(flagged & (F.col("suggested_label") == F.col("ground_truth"))).alias("right_suggestions"),
    )
    def share(part, of):
        return F.when(of > 0, part / of).otherwise(F.lit(0.0))

    hits = F.col("true_positives")
    return counts.withColumns(
        {
            "precision": share(hits, hits + F.col("false_positives")),
            "recall": share(hits, hits + F.col("false_negatives")),
        }
    )


def latency_summary(results: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One row over freshly scored rows: count, mean, median and 95th percentile, greatest latency.

    The percentiles are values that occur, from a mergeable sketch of bounded size: the rank of each is off by at most a
    1/``accuracy``-th of the rows.
    """
    fresh = results.filter("success AND NOT cache_hit AND latency_ms IS NOT NULL")
    return fresh.agg(
        F.count("*").alias("n_rows"),
        F.avg("latency_ms").alias("mean_ms"),
        F.percentile_approx("latency_ms", 0.5, accuracy).alias("median_ms"),
        F.percentile_approx("latency_ms", 0.95, accuracy).alias("p95_ms"),
        F.max("latency_ms").alias("max_ms"),
    )

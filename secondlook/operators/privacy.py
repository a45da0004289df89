"""Personal-data scan and redaction."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondlook import fixed
from secondlook.functions.patterns import has_digit_run, pii_flags
from secondlook.functions.text import redact

PII_NAMES = tuple(name for name, _ in fixed.PII_PATTERNS)
SYNTHETIC_PREFIXES = ("demo_", "synth_")


def with_pii_flags(df: DataFrame, column: str = "text") -> DataFrame:
    """Add one boolean per personal-data pattern, all in one pass."""
    return (
        df.withColumn("_digit_run", has_digit_run(F.col(column)))
        .withColumns(pii_flags(F.col(column), F.col("_digit_run")))
        .drop("_digit_run")
    )


def any_flag() -> Column:
    return reduce(lambda a, b: a | b, [F.col(n) for n in PII_NAMES])


def filter_pii_rows(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows in which any personal-data pattern occurs; stops at the first pattern found."""
    tests = list(pii_flags(F.col(column)).values())
    return df.filter(reduce(lambda a, b: a | b, tests))


def is_synthetic_id(id_column: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(id_column, F.lit(p)) for p in SYNTHETIC_PREFIXES])


def pii_pattern_counts(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows per pattern: one aggregate, turned into rows afterwards."""
    counts = with_pii_flags(df, column).agg(*[F.count_if(n).alias(n) for n in PII_NAMES])
    return counts.unpivot([], list(PII_NAMES), "pattern", "n_rows")


def pii_summary(df: DataFrame, column: str = "text", id_column: str = "id", order: str = "seq") -> DataFrame:
    """One row: what was found, in order of first detection, and whether all ids look synthetic."""
    first_seen = [F.min(F.when(F.col(n), F.col(order))).alias(f"_{n}") for n in PII_NAMES]
    totals = with_pii_flags(df, column).agg(
        F.count_if(any_flag()).alias("samples_with_pii"),
        F.count("*").alias("total_samples"),
        F.coalesce(
            F.bool_and(F.coalesce(is_synthetic_id(F.col(id_column)), F.lit(False))), F.lit(True)
        ).alias("is_synthetic"),
        *first_seen,
    )
    found = F.array_sort(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        F.col(f"_{n}").isNotNull(),
                        F.struct(F.col(f"_{n}").alias("at"), F.lit(i).alias("ordinal"), F.lit(n).alias("name")),
                    )
                    for i, n in enumerate(PII_NAMES)
                ]
            )
        )
    )
    return totals.select(
        (F.col("samples_with_pii") > 0).alias("has_potential_pii"),
        "is_synthetic",
        F.transform(found, lambda s: s["name"]).alias("detected_patterns"),
        "samples_with_pii",
        "total_samples",
    )


def redact_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: redact(F.col(c)) for c in columns})


def redact_results(results: DataFrame, all_free_text: bool = False) -> DataFrame:
    """Redact text and reasoning; explanation as well when ``all_free_text``."""
    columns = ["text", "reasoning"] + (["explanation"] if all_free_text else [])
    return redact_text(results, *columns)

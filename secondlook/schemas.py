"""Table layouts shared by the operators."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SAMPLES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("pred_label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("ground_truth", T.StringType()),
        T.StructField("is_misclassified", T.BooleanType()),
    ]
)
OPTIONAL_SAMPLE_COLUMNS = ("ground_truth", "is_misclassified")

TAXONOMY = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("definition", T.StringType()),
    ]
)

TEMPLATES = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)

# The part of a review that does not depend on the sample; this is what the cache stores.
CACHE_RESPONSE = T.StructType(
    [
        T.StructField("verdict", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("suggested_label", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("prompt_hash", T.StringType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("_untrusted", T.BooleanType()),
    ]
)

CACHE = T.StructType(
    [
        T.StructField("prompt_hash", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("response", CACHE_RESPONSE),
        T.StructField("created_at", T.DoubleType()),
        T.StructField("hit_count", T.LongType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("pred_label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("ground_truth", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("suggested_label", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("prompt_hash", T.StringType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("cache_hit", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("_untrusted", T.BooleanType()),
        T.StructField("_validation_issues", T.ArrayType(T.StringType())),
    ]
)


def require_columns(df: DataFrame, names, what: str) -> None:
    """Fail before the job starts rather than with nulls in the result."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing column(s) {', '.join(missing)}")

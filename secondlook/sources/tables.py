"""Tables in: samples, taxonomy, templates, confusion tables and cache snapshots."""

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secondlook import fixed, schemas
from secondlook.sources.artifacts import CSV_READ


def read_samples(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Samples in the fixed layout; only the columns a query uses are read.

    ``ground_truth`` and ``is_misclassified`` may be missing and are null then.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        # All columns as text, under the names in the header, whatever their order.
        named = reader.options(**CSV_READ).load(path)
        numbers = {f.name for f in schemas.SAMPLES if not isinstance(f.dataType, T.StringType)}
        blank = {n: F.nullif(F.trim(n), F.lit("")) for n in named.columns if n in numbers}
        return as_samples(named.withColumns(blank))
    if fmt == "json":
        reader = reader.schema(schemas.SAMPLES)
    return as_samples(reader.load(path))


def as_samples(df: DataFrame) -> DataFrame:
    """Project any table with the sample columns to the fixed layout."""
    required = [n for n in schemas.SAMPLES.names if n not in schemas.OPTIONAL_SAMPLE_COLUMNS]
    schemas.require_columns(df, required, "samples")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.SAMPLES
        ]
    )


def local_table(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A small table from Python rows: of known size to the optimizer, and in one partition, so that
    grouping it needs no shuffle."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema.names]
    arrow_types = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}
    arrays = [pa.array(list(c), arrow_types[f.dataType]) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.table(dict(zip(schema.names, arrays))), schema).coalesce(1)


def load_taxonomy(spark: SparkSession, rows=fixed.DEFAULT_TAXONOMY) -> DataFrame:
    """Taxonomy from (name, definition) pairs; no pairs give an empty taxonomy."""
    return local_table(spark, [(i, n, d) for i, (n, d) in enumerate(rows or ())], schemas.TAXONOMY)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy from JSON lines with ordinal, name and definition; a missing file gives no labels."""
    try:
        table = spark.read.schema(schemas.TAXONOMY).json(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return load_taxonomy(spark, ())
    return table.filter(F.col("name").isNotNull())


def load_patterns(spark: SparkSession, pairs=fixed.CONFUSION_PATTERNS) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("ordinal", T.LongType()),
            T.StructField("actual", T.StringType()),
            T.StructField("confused", T.StringType()),
        ]
    )
    return local_table(spark, [(i, a, c) for i, (a, c) in enumerate(pairs)], schema)


def load_similarity(spark: SparkSession, entries=fixed.LABEL_SIMILARITY) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("ordinal", T.LongType()),
            T.StructField("actual", T.StringType()),
            T.StructField("candidate", T.StringType()),
            T.StructField("weight", T.DoubleType()),
        ]
    )
    return local_table(spark, [(i, *e) for i, e in enumerate(entries)], schema)


def load_templates(spark: SparkSession, pairs=fixed.DEFAULT_TEMPLATES) -> DataFrame:
    """Templates from (label, text) pairs, numbered per label in the given order."""
    taken: dict[str, int] = {}
    rows = []
    for label, text in pairs:
        rows.append((label, taken.get(label, 0), text))
        taken[label] = taken.get(label, 0) + 1
    return local_table(spark, rows, schemas.TEMPLATES)


def write_cache(cache: DataFrame, path: str) -> None:
    """Write a cache snapshot, one folder per prompt version, so old versions are never scanned."""
    cache.select(*schemas.CACHE.names).write.partitionBy("version").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CACHE).parquet(path).select(*schemas.CACHE.names)

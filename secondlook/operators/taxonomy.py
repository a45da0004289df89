"""Label taxonomy, confusion tables and text templates.

These tables are small when they come from configuration, but nothing here relies on it: no operator
forces a broadcast, pairs labels with labels, or numbers a whole label in one task. The optimizer
broadcasts them when their known size allows it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secondlook import fixed
from secondlook.operators.skew import spread_lookup
from secondlook.session import TEXT_CODEC, stage


def _label_line(compact: bool) -> tuple[Column, str]:
    if compact:
        short = F.left("definition", F.lit(fixed.COMPACT_DEFINITION_CHARS))
        return F.concat("name", F.lit(":"), short), "|"
    return F.concat(F.lit("- "), "name", F.lit(": "), "definition"), "\n"


def _joined_lines(compact: bool) -> Column:
    line, sep = _label_line(compact)
    lines = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"))))
    return F.array_join(F.transform(lines, lambda s: s["line"]), sep).alias("block")


def prompt_block(taxonomy: DataFrame, compact: bool = False) -> DataFrame:
    """One row: the label list as it appears in prompts; it fits one row because it must fit a prompt."""
    return taxonomy.agg(_joined_lines(compact))


#: Labels of one part of a label list.
PART_LABELS = 256


def taxonomy_block(taxonomy: DataFrame, compact: bool = False, part_labels: int = PART_LABELS) -> DataFrame:
    """(part, block): the label list in parts of ``part_labels`` lines, for taxonomies of any size.

    Joined in the order of ``part``, with the separator between them, the parts are the whole list. Labels are
    numbered in ranges of their ordinals, so neither a task nor a row ever holds more than a range or a part.
    """
    numbered = dense_ordinals(taxonomy.withColumns({"all": F.lit(0), "place": F.col("ordinal")}), "all", "place")
    part = F.floor(F.col("ordinal") / F.lit(part_labels)).cast("bigint")
    return numbered.groupBy(part.alias("part")).agg(_joined_lines(compact))


def valid_labels(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.select("name").distinct()


def label_lookup(taxonomy: DataFrame) -> DataFrame:
    """One row per case-folded name: all exact spellings and the one that stands for the others."""
    return taxonomy.groupBy(F.lower("name").alias("label_key")).agg(
        F.collect_set("name").alias("spellings"),
        F.max_by("name", "ordinal").alias("canonical"),
    )


def label_membership(df: DataFrame, column: str, taxonomy: DataFrame, known: bool = True) -> DataFrame:
    """Rows whose label does (or does not) belong to the taxonomy, exact spelling."""
    names = taxonomy.select(F.col("name").alias(column))
    return df.join(names, column, "left_semi" if known else "left_anti")


def first_patterns(patterns: DataFrame) -> DataFrame:
    """The first confusion pattern of every actual label: (actual, confused)."""
    return patterns.groupBy("actual").agg(F.min_by("confused", "ordinal").alias("confused"))


def distinct_pairs(patterns: DataFrame) -> DataFrame:
    """Each (actual, confused) once with its first ordinal, so that a label's list is bounded by the labels."""
    return patterns.groupBy("actual", "confused").agg(F.min("ordinal").alias("ordinal"))


def static_preview(taxonomy: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per label, everything it may be mistaken for, in pattern order; repeated pairs count once."""
    grouped = distinct_pairs(patterns).groupBy(F.col("actual").alias("name")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", "confused"))), lambda s: s["confused"]
        ).alias("confused_with")
    )
    return _preview(taxonomy, grouped)


def similar_labels(similarity: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most similar candidates per label; ties keep table order."""
    order = W.partitionBy("actual").orderBy(F.desc("weight"), "ordinal")
    return similarity.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dynamic_preview(taxonomy: DataFrame, similarity: DataFrame, k: int = 3) -> DataFrame:
    grouped = (
        similar_labels(similarity, k)
        .groupBy(F.col("actual").alias("name"))
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda s: s["candidate"]
            ).alias("confused_with")
        )
    )
    return _preview(taxonomy, grouped)


def _preview(taxonomy: DataFrame, grouped: DataFrame) -> DataFrame:
    return taxonomy.join(grouped, "name", "left").select(
        "ordinal",
        F.col("name").alias("label"),
        F.coalesce("confused_with", F.array(F.lit(fixed.NO_PATTERN))).alias("confused_with"),
    )


def dense_ordinals(
    df: DataFrame, key: str, order: str, slice_rows: int = 1_000_000, slice_bytes: int = 32_000_000
) -> DataFrame:
    """Number the rows of every key 0, 1, 2, ... by a unique integer column.

    One label may hold any share of the rows, and ids may be dense here and far apart there. So the rows are
    dealt into ranges of (key, order) by a sample of them, about ``slice_rows`` rows or ``slice_bytes`` of text
    each, and staged with their place. A row's number is its place in its range, less the place of its key's first
    row there, plus the key's rows in earlier ranges, which are counted map-side. These shifts, one per range and
    key, are staged too: the optimizer then knows how small they are and leaves the texts where they lie.
    """
    texts = [F.octet_length(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = sum((F.coalesce(n, F.lit(0)) for n in texts), F.lit(0).cast("bigint"))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    n_slices = max(1, -(-rows // slice_rows), -(-size // slice_bytes))
    ranged = df.repartitionByRange(n_slices, key, order).sortWithinPartitions(key, order)
    placed = stage(
        ranged.withColumns({"_slice": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}),
        "ordinals",
        compression=TEXT_CODEC,
    )
    earlier = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = stage(
        placed.groupBy(key, "_slice")
        .agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
        .select(key, "_slice", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")),
        "shifts",
    )
    same = [F.col(f"r.{key}").eqNullSafe(F.col(f"s.{key}")), F.col("r._slice") == F.col("s._slice")]
    return placed.alias("r").join(starts.alias("s"), same).select(
        *[F.col(f"r.`{c}`") for c in df.columns if c != "ordinal"],
        (F.col("r._place") + F.col("s._shift")).cast("bigint").alias("ordinal"),
    )


def merge_templates(base: DataFrame, custom: DataFrame) -> DataFrame:
    """Append custom texts behind the existing ones of a label; unknown labels are added.

    Both tables are (label, ordinal, text); nothing is removed, not even equal texts.
    """
    taken = base.groupBy("label").agg((F.max("ordinal") + 1).alias("_taken"))
    moved = spread_lookup(custom, taken, "label", "ordinal").select(
        "label",
        (F.col("ordinal") + F.coalesce("_taken", F.lit(0))).cast("bigint").alias("ordinal"),
        "text",
    )
    return base.select("label", "ordinal", "text").unionByName(moved)

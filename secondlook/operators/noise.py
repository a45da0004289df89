"""Reproducible label noise and sample generation.

Every random choice is a draw on the row's own ``seq``, so results do not depend on partitioning.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from secondlook import fixed
from secondlook.functions import text as tx
from secondlook.functions.arrays import count_up_to
from secondlook.functions.draws import draw_int, draw_unit
from secondlook.operators.skew import spread_lookup
from secondlook.operators.taxonomy import distinct_pairs, first_patterns


def assign_labels(df: DataFrame, taxonomy: DataFrame, seed: int, key: str = "seq") -> DataFrame:
    """Give every row a uniformly drawn true label: adds ``ground_truth`` (null without any label)."""
    labels = taxonomy.select(F.col("ordinal").alias("_pick"), F.col("name").alias("ground_truth"))
    return (
        df.withColumn("_pick", draw_int(seed, "label", F.col(key), _at_least_one(taxonomy)))
        .join(labels, "_pick", "left")
        .drop("_pick")
    )


def _at_least_one(taxonomy: DataFrame, less: int = 0) -> Column:
    """Number of labels, minus ``less``, but never below one, as a scalar subquery."""
    return taxonomy.agg(F.greatest(F.count("*") - less, F.lit(1))).scalar()


def _with_any_other(df: DataFrame, taxonomy: DataFrame, seed: int, key: str) -> DataFrame:
    """Add ``_any``: a drawn label ordinal other than ``_own``."""
    position = draw_int(seed, "other", F.col(key), _at_least_one(taxonomy, less=1))
    return df.withColumn("_any", position).withColumn(
        "_any", F.col("_any") + F.when(F.col("_any") >= F.col("_own"), 1).otherwise(0)
    )


def static_confusion(
    df: DataFrame, taxonomy: DataFrame, patterns: DataFrame, seed: int, key: str = "seq"
) -> DataFrame:
    """Add ``confused``: the first pattern of the true label, else any other label of the taxonomy.

    Each small table is joined on its own: when one of two joined ones has been broadcast, adaptive execution may take
    their size for a product, and then deals the rows, with their texts, out by label.
    """
    own = taxonomy.select(F.col("name").alias("ground_truth"), F.col("ordinal").alias("_own"))
    first = first_patterns(patterns).select(F.col("actual").alias("ground_truth"), F.col("confused").alias("_pattern"))
    others = taxonomy.select(F.col("ordinal").alias("_any"), F.col("name").alias("_other"))
    targeted = df.join(own, "ground_truth", "left").join(first, "ground_truth", "left")
    return (
        _with_any_other(targeted, taxonomy, seed, key)
        .join(others, "_any", "left")
        .withColumn("confused", F.coalesce(F.when(F.col("_own").isNotNull(), F.col("_pattern")), "_other"))
        .drop("_own", "_pattern", "_any", "_other")
    )


def confusion_weights(taxonomy: DataFrame, similarity: DataFrame) -> DataFrame:
    """Per label with similarity entries: cumulated listed weights and what is left for the rest.

    Returns (actual, listed array<ordinal>, highs array<cumulated weight>, gaps, listed_total, n_rest, rest_total).
    Labels outside the list all weigh the same, so they need no rows of their own and the table stays linear in
    the similarity entries: the k-th of them (from 0) is k plus the number of ``gaps`` up to k. Weights that are null or
    negative count as zero.
    """
    names = taxonomy.select(F.col("name").alias("candidate"), "ordinal")
    own = taxonomy.select(F.col("name").alias("actual"), F.col("ordinal").alias("own"))
    running = W.partitionBy("actual").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    n_others = taxonomy.agg(F.count("*") - 1).scalar()
    skipped = F.array_sort(F.array_distinct(F.concat("listed", F.array("own"))))
    return (
        similarity.select("actual", "candidate", F.greatest("weight", F.lit(0.0)).alias("weight"))
        .filter(F.col("actual") != F.col("candidate"))
        .join(names, "candidate")
        .withColumn("hi", F.sum("weight").over(running))
        .groupBy("actual")
        .agg(
            F.array_sort(F.collect_list(F.struct("ordinal", "hi"))).alias("entries"),
            F.max("hi").alias("listed_total"),
            F.count_distinct("ordinal").alias("_n_listed"),
        )
        .join(own, "actual")
        .withColumns(
            {
                "listed": F.col("entries.ordinal"),
                "highs": F.col("entries.hi"),
                "n_rest": n_others - F.col("_n_listed"),
            }
        )
        .withColumn("rest_total", F.col("n_rest") * F.lit(fixed.UNLISTED_WEIGHT))
        .withColumn("gaps", F.transform(skipped, lambda x, i: x - i))
        .select("actual", "listed", "highs", "gaps", "listed_total", "n_rest", "rest_total")
    )


def dynamic_confusion(
    df: DataFrame, taxonomy: DataFrame, similarity: DataFrame, seed: int, key: str = "seq"
) -> DataFrame:
    """Add ``confused``: another label drawn by similarity weight (0.1 for unlisted pairs).

    A label without any similarity entry draws uniformly among the others. A draw is a binary search in the
    label's cumulated weights, which are sorted once per label and not per row.
    """
    weights = confusion_weights(taxonomy, similarity).withColumnRenamed("actual", "ground_truth")
    own = taxonomy.select(F.col("name").alias("ground_truth"), F.col("ordinal").alias("_own"))
    names = taxonomy.select(F.col("ordinal").alias("_pick"), F.col("name").alias("confused"))

    point = draw_unit(seed, "weight", F.col(key)) * (F.col("listed_total") + F.col("rest_total"))
    beyond = (F.col("_point") - F.col("listed_total")) / F.lit(fixed.UNLISTED_WEIGHT)
    rest = F.least(F.floor(beyond), F.greatest(F.col("n_rest"), F.lit(1)) - 1)
    pick = (
        F.when(F.col("listed").isNull(), F.col("_any"))
        .when(F.col("_place") < F.size("listed"), F.get("listed", F.col("_place")))
        .otherwise(F.col("_rest") + count_up_to(F.col("gaps"), F.col("_rest")))
    )
    weighted = df.join(own, "ground_truth", "left").join(weights, "ground_truth", "left")
    return (
        _with_any_other(weighted, taxonomy, seed, key)
        .withColumn("_point", point)
        .withColumns({"_rest": rest, "_place": count_up_to(F.col("highs"), F.col("_point"))})
        .withColumn("_pick", pick)
        .join(names, "_pick", "left")
        .drop("_own", "listed", "highs", "gaps", "listed_total", "n_rest", "rest_total", "_any", "_point", "_rest", "_place", "_pick")
    )


def noisy_flag(seed: int, rate: float, key: Column) -> Column:
    return draw_unit(seed, "flip", key) < F.lit(float(rate))


def confidence_draw(seed: int, noisy: Column, key: Column) -> Column:
    """Confidence in whole hundredths, lower for corrupted rows."""

    def within(purpose, bounds):
        low, high = bounds
        return (draw_int(seed, purpose, key, high - low + 1) + low) / F.lit(100.0)

    return F.when(noisy, within("unsure", fixed.NOISY_CONFIDENCE)).otherwise(
        within("sure", fixed.CLEAN_CONFIDENCE)
    )


def inject_label_noise(
    df: DataFrame,
    taxonomy: DataFrame,
    confusion: DataFrame,
    seed: int,
    rate: float = fixed.NOISE_RATE,
    dynamic: bool = False,
    key: str = "seq",
) -> DataFrame:
    """Corrupt a share of the true labels: adds ``is_misclassified``, ``pred_label``, ``confidence``.

    ``confusion`` is a pattern table, or a similarity table when ``dynamic`` is set.
    """
    confuse = dynamic_confusion if dynamic else static_confusion
    noisy = F.col("is_misclassified")
    return (
        confuse(df, taxonomy, confusion, seed, key)
        .withColumn("is_misclassified", noisy_flag(seed, rate, F.col(key)))
        .withColumn("pred_label", F.when(noisy, F.col("confused")).otherwise(F.col("ground_truth")))
        .withColumn("confidence", confidence_draw(seed, noisy, F.col(key)))
        .drop("confused")
    )


def sample_ids(seed: int, key: Column) -> Column:
    return F.format_string("demo_%d_%04d", F.lit(seed), key)


def augment_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Seven rows per text, one per variation: adds ``variant`` and ``varied_text``."""
    return (
        df.withColumn("_v", F.explode(tx.variations(F.col(column))))
        .withColumn("variant", F.col("_v.variant"))
        .withColumn("varied_text", F.col("_v.text"))
        .drop("_v")
    )


def vary_text(df: DataFrame, seed: int, column: str = "text", key: str = "seq") -> DataFrame:
    """Rewrite every text in one drawn variation."""
    pick = draw_int(seed, "variation", F.col(key), tx.N_VARIATIONS)
    return df.withColumn("_pick", pick).withColumn(
        column, tx.variation(F.col(column), F.col("_pick"))
    ).drop("_pick")


def expand_templates(
    rows: DataFrame, templates: DataFrame, taxonomy: DataFrame, seed: int, key: str = "seq"
) -> DataFrame:
    """Give every row a drawn label and a drawn template text of that label.

    ``rows`` has a unique integer ``key``; ``templates`` is (label, ordinal, text) with dense ordinals
    for every label of ``taxonomy``. Adds ``ground_truth`` and ``text``.
    """
    # One entry per label; a taxonomy fits into a prompt, so it fits into a map.
    per_label = (
        templates.join(taxonomy.select(F.col("name").alias("label")), "label", "left_semi")
        .groupBy("label")
        .agg(F.count("*").alias("n"))
        .agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("sizes"))
    )
    texts = templates.select(
        F.col("label").alias("ground_truth"), F.col("ordinal").alias("_ordinal"), "text"
    )
    n_texts = F.try_element_at(per_label.scalar(), F.col("ground_truth"))
    labelled = assign_labels(rows, taxonomy, seed, key).withColumn(
        "_ordinal", draw_int(seed, "template", F.col(key), n_texts)
    )
    # A label with few templates repeats each of them often.
    return spread_lookup(labelled, texts, ("ground_truth", "_ordinal"), key).drop("_ordinal")


def generate_samples(
    rows: DataFrame,
    templates: DataFrame,
    taxonomy: DataFrame,
    confusion: DataFrame,
    seed: int,
    rate: float = fixed.NOISE_RATE,
    dynamic: bool = False,
) -> DataFrame:
    """Labelled, varied and partly mislabelled samples: one per row of ``rows`` (column ``seq``)."""
    texts = vary_text(expand_templates(rows.select("seq"), templates, taxonomy, seed), seed)
    noisy = inject_label_noise(texts, taxonomy, confusion, seed, rate, dynamic)
    return noisy.select(
        "seq",
        sample_ids(seed, F.col("seq")).alias("id"),
        "text",
        "pred_label",
        "confidence",
        "ground_truth",
        "is_misclassified",
    )


def generator_metadata(
    taxonomy: DataFrame, patterns: DataFrame, seed: int, dynamic: bool
) -> DataFrame:
    """How a noise run was set up: one row per label, in label order.

    ``confusion_patterns`` lists the label's patterns, each once, or reads "dynamic".
    """
    listed = distinct_pairs(patterns).groupBy(F.col("actual").alias("name")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("ordinal", "confused"))), lambda s: s["confused"]
            ),
            "|",
        ).alias("listed")
    )
    shown = F.lit("dynamic") if dynamic else F.coalesce("listed", F.lit(""))
    return taxonomy.join(listed, "name", "left").select(
        F.lit(seed).cast("bigint").alias("seed"),
        F.col("ordinal").alias("label_ordinal"),
        F.col("name").alias("label"),
        F.lit(dynamic).alias("use_dynamic_confusion"),
        shown.alias("confusion_patterns"),
    )

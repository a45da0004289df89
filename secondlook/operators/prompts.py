"""Review prompts and the hash that identifies them."""

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondlook import fixed, schemas
from secondlook.functions.text import number_text
from secondlook.operators.taxonomy import prompt_block


#: The sample columns that a prompt is made of.
PROMPT_PARTS = ("text", "pred_label", "confidence")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Concatenate the literal parts of a ``str.format`` template with columns."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name])
    return F.concat(*parts)


def build_prompt(
    samples: DataFrame, taxonomy: DataFrame, compact: bool = False, template: str | None = None
) -> DataFrame:
    """Add ``prompt``. The label list is a scalar subquery, so it is built once per query."""
    schemas.require_columns(samples, PROMPT_PARTS, "samples")
    if template is None:
        template = fixed.COMPACT_PROMPT_TEMPLATE if compact else fixed.PROMPT_TEMPLATE
    values = {
        "labels": prompt_block(taxonomy, compact).scalar(),
        "text": F.coalesce("text", F.lit("None")),
        "pred_label": F.coalesce("pred_label", F.lit("None")),
        "confidence": number_text(F.col("confidence")),
    }
    return samples.withColumn("prompt", fill_template(template, values))


def prompt_hash(prompt: Column, version: str = fixed.PROMPT_VERSION, salt: str = "") -> Column:
    """First 16 hex digits of md5("version:prompt"); ``salt`` lets other settings take part."""
    prefix = f"{version}:{salt}:" if salt else f"{version}:"
    return F.substring(F.md5(F.concat(F.lit(prefix), prompt)), 1, 16)


def with_prompt_hash(
    samples: DataFrame,
    taxonomy: DataFrame,
    version: str = fixed.PROMPT_VERSION,
    compact: bool = False,
    template: str | None = None,
    salt: str = "",
) -> DataFrame:
    """Add ``prompt`` and ``prompt_hash``; whoever needs only the hash drops the prompt before a shuffle."""
    built = build_prompt(samples, taxonomy, compact, template)
    return built.withColumn("prompt_hash", prompt_hash(F.col("prompt"), version, salt))

"""Artifacts out: samples, results, labelled data, metrics, manifest and report of a run.

Every artifact is written by the tasks into a folder of its own; only one row of totals and the few
sample corrections of the report pass the driver.
"""

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secondlook import fixed
from secondlook.operators.metrics import (
    label_distribution,
    labeled_dataset,
    top_corrections,
    verdict_metrics,
)
from secondlook.operators.privacy import redact_results, redact_text

# An empty text is written as "" and null as nothing. Reading tells them apart as long as the name for
# "nothing" is no text that occurs.
CSV_OPTIONS = {"header": True, "escape": '"'}
CSV_WRITE = {**CSV_OPTIONS, "emptyValue": '""', "nullValue": ""}
CSV_READ = {**CSV_OPTIONS, "emptyValue": "", "nullValue": "\x00", "multiLine": True}


def artifact_path(run_dir: str, name: str) -> str:
    return f"{run_dir.rstrip('/')}/{fixed.ARTIFACTS[name]}"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that survives line ends and quotes in texts."""
    df.write.options(**CSV_WRITE).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_READ).csv(path)


def save_samples(samples: DataFrame, run_dir: str, redacted: bool = False) -> str:
    path = artifact_path(run_dir, "samples")
    write_csv(redact_text(samples, "text") if redacted else samples, path)
    return path


def save_results(results: DataFrame, run_dir: str, redacted: bool = False) -> str:
    """Results as JSON lines, always marked untrusted."""
    path = artifact_path(run_dir, "results")
    shown = redact_results(results) if redacted else results
    shown.withColumn("_untrusted", F.lit(True)).write.option("ignoreNullFields", False).json(path)
    return path


def save_labeled(results: DataFrame, run_dir: str, redacted: bool = False) -> str:
    path = artifact_path(run_dir, "labeled")
    write_csv(labeled_dataset(redact_results(results) if redacted else results), path)
    return path


def save_metrics(results: DataFrame, run_dir: str, redacted: bool = False, extra: DataFrame | None = None) -> str:
    """Verdict metrics as one JSON line; ``extra`` (one row, e.g. validation counts) is added to it."""
    path = artifact_path(run_dir, "metrics")
    metrics = verdict_metrics(results)
    if extra is not None:
        metrics = metrics.withColumns({c: extra.select(c).scalar() for c in extra.columns})
    metrics.withColumns(
        {"_warning": F.lit(fixed.METRICS_WARNING), "redacted": F.lit(redacted)}
    ).write.json(path)
    return path


def save_observed_metrics(spark: SparkSession, values: dict, run_dir: str, redacted: bool = False) -> str:
    """The same from values that were observed while other artifacts were written."""
    path = artifact_path(run_dir, "metrics")
    row = values | {"_warning": fixed.METRICS_WARNING, "redacted": redacted}
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()]).write.json(path)
    return path


def save_manifest(samples: DataFrame, run_dir: str, settings: dict, n_samples: int | None = None) -> str:
    """How the run was set up, as one JSON line; ``settings`` holds run_id, seed, model and flags.

    The samples are only counted if their number isn't given.
    """
    path = artifact_path(run_dir, "manifest")
    generated = settings.get("generated_at") or datetime.now(timezone.utc).isoformat()
    columns = {k: F.lit(v) for k, v in settings.items() if k != "generated_at"}
    columns["generated_at"] = F.lit(generated)
    columns["_warning"] = F.lit(fixed.RUN_WARNING)
    if n_samples is None:
        counted = samples.agg(F.count("*").alias("n_samples"))
    else:
        counted = samples.sparkSession.range(1).select(F.lit(n_samples).cast("bigint").alias("n_samples"))
    counted.withColumns(columns).write.json(path)
    return path


_BANNER = [
    "> **UNTRUSTED OUTPUT**",
    "> The verdicts, labels and sentences below were produced by an automatic reviewer.",
    "> Have a person check them before they are used for anything that matters.",
    "",
]


def _closing_lines(m: dict) -> list[str]:
    """Where a person should look first, by the figures of this run."""
    return [
        "",
        "## Left for people",
        "",
        f"- {m['uncertain']} predictions stayed undecided.",
        f"- {m['incorrect']} corrections wait for a second opinion.",
    ]


def _opening_lines(m: dict, run_id: str, generated: str) -> list[str]:
    def share(name):
        return f"{m[name + '_pct']:.1f}%"

    return [
        "---",
        "title: Classification Audit Report",
        f"run_id: {run_id}",
        f"generated: {generated}",
        f"samples_reviewed: {m['total']}",
        f"accuracy: {share('correct')}",
        "---",
        "",
        "# Classification Audit Report",
        "",
        f"**{m['total']}** predictions were reviewed; **{m['incorrect']}** ({share('incorrect')}) need a correction.",
        "",
        "## Verdict Distribution",
        "",
        "| Verdict | Count | Percentage |",
        "|---------|-------|------------|",
        *[f"| {v} | {m[v.lower()]} | {share(v.lower())} |" for v in fixed.VERDICTS],
        "",
        "## Label Distribution",
        "",
        "| Label | Count |",
        "|-------|-------|",
    ]


def _correction_lines(corrections: list) -> list[str]:
    lines = ["", "## Sample Corrections", ""]
    if not corrections:
        return lines + ["*No corrections needed*"]
    for i, c in enumerate(corrections, 1):
        lines += [
            f"**{i}. \"{c['text']}...\"**",
            f"- Predicted: `{c['predicted']}`, suggested: `{c['suggested']}`",
            f"- Reason: {c['reasoning']}",
            "",
        ]
    return lines


def report_lines(results: DataFrame, run_id: str, generated: str | None = None, metrics: dict | None = None) -> DataFrame:
    """The report as (part, position, line). The label table, the only part without a fixed length, stays
    a distributed aggregate."""
    spark = results.sparkSession
    generated = generated or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    metrics = metrics or verdict_metrics(results).first().asDict()
    corrections = top_corrections(results).collect()
    # A text may contain line ends; they must not break the report's own lines.
    tail = [re.sub(r"[\r\n]", " ", line) for line in _correction_lines(corrections)] + _closing_lines(metrics)

    def fixed_part(part, lines):
        return [(part, i, line) for i, line in enumerate(lines)]

    ends = spark.createDataFrame(
        fixed_part(0, _BANNER + _opening_lines(metrics, run_id, generated)) + fixed_part(2, tail),
        "part int, position bigint, line string",
    )
    labels = label_distribution(results).select(
        F.lit(1).alias("part"),
        F.col("first_seq").alias("position"),
        F.concat(F.lit("| "), F.regexp_replace("label", r"[\r\n]", " "), F.lit(" | "), F.col("n_rows").cast("string"), F.lit(" |")).alias("line"),
    )
    return ends.unionByName(labels)


def save_report(
    results: DataFrame, run_dir: str, run_id: str, generated: str | None = None, redacted: bool = False, metrics: dict | None = None
) -> str:
    """The Markdown report; its part files in name order are the report's lines in order."""
    path = artifact_path(run_dir, "report")
    shown = redact_results(results) if redacted else results
    report_lines(shown, run_id, generated, metrics).orderBy("part", "position").select("line").write.text(path)
    return path

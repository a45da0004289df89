"""Free-text answers to structured reviews: parsing and the output check."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondlook import fixed
from secondlook.functions.patterns import folded, folded_injection_ordinals, has_injection
from secondlook.functions.text import (
    WS,
    capitalize,
    cut,
    null_if_empty,
    or_empty,
    trim_ws,
    unicode_regex,
)
from secondlook.operators.skew import free_name
from secondlook.operators.taxonomy import label_lookup


def _header_value(raw: Column, header: str) -> Column:
    """First line after the header; whitespace in between, line ends included, is skipped."""
    pattern = unicode_regex(rf"{header}:{WS}*([^\n]*)", ignore_case=True)
    return trim_ws(F.regexp_extract(raw, pattern, 1))


def _line_values(raw: Column, header: str) -> Column:
    """The trimmed remainder of every line that starts with the header, in line order."""
    lines = F.transform(F.split(raw, "\n"), trim_ws)
    headed = F.filter(lines, lambda s: F.upper(F.left(s, F.lit(len(header) + 1))) == header + ":")
    return F.transform(headed, lambda s: trim_ws(F.substring(s, len(header) + 2, 2**31 - 1)))


def parse_response(df: DataFrame, column: str = "raw_response") -> DataFrame:
    """Add the struct ``parsed`` (verdict, reasoning, suggested_label, explanation) of an answer.

    Headers are found anywhere and in any case. If that leaves the verdict Uncertain, lines starting
    with a verdict header are tried again and the last one that is spelled exactly decides. The steps
    are separate columns so that every pattern runs once per row.
    """
    raw = F.col("_raw")
    verdict_word = unicode_regex(rf"VERDICT:{WS}*(\w+)", ignore_case=True)
    exact = F.filter(_line_values(raw, "VERDICT"), lambda v: v.isin(*fixed.VERDICTS))
    named = F.filter(_line_values(raw, "SUGGESTED_LABEL"), lambda v: F.lower(v) != "none")
    suggested = F.when(F.lower("_label") != "none", null_if_empty(F.col("_label")))
    by_line = {
        "verdict": F.coalesce(F.try_element_at(exact, F.lit(-1)), F.lit(fixed.UNCERTAIN)),
        "label": null_if_empty(F.try_element_at(named, F.lit(1))),
    }
    retry = (F.col("_first") == fixed.UNCERTAIN) & F.contains(F.upper(raw), F.lit("VERDICT:"))
    fields = F.struct(
        F.when(F.col("_retry"), by_line["verdict"]).otherwise(F.col("_first")).alias("verdict"),
        _header_value(raw, "REASONING").alias("reasoning"),
        F.coalesce(suggested, F.when(F.col("_retry"), by_line["label"])).alias("suggested_label"),
        _header_value(raw, "EXPLANATION").alias("explanation"),
    )
    return (
        df.withColumn("_raw", or_empty(F.col(column)))
        .withColumn("_word", F.regexp_extract("_raw", verdict_word, 1))
        .withColumn("_word", capitalize(F.col("_word")))
        .withColumn(
            "_first",
            F.when(F.col("_word").isin(*fixed.VERDICTS), F.col("_word")).otherwise(fixed.UNCERTAIN),
        )
        .withColumn("_retry", retry)
        .withColumn("_label", _header_value(raw, "SUGGESTED_LABEL"))
        .withColumn("parsed", fields)
        .drop("_raw", "_word", "_first", "_retry", "_label")
    )


def normalize_verdict(verdict: Column) -> Column:
    """Map any spelling of the three verdicts to the canonical one, everything else to Uncertain."""
    key = F.upper(trim_ws(or_empty(verdict)))
    known = reduce(
        lambda acc, v: acc.when(key == v.upper(), v), fixed.VERDICTS[1:],
        F.when(key == fixed.VERDICTS[0].upper(), fixed.VERDICTS[0]),
    )
    return known.otherwise(fixed.UNCERTAIN)


def validate_label(df: DataFrame, taxonomy: DataFrame, column: str = "suggested_label") -> DataFrame:
    """Add ``valid_label`` and ``label_ok``: exact name, else any-case match, else rejected.

    "none", "n/a", the empty string and null mean "no suggestion" and are fine. Labels are not trimmed.
    """
    label = F.col(column)
    absent = label.isNull() | F.lower(label).isin("none", "n/a", "")
    lookup = label_lookup(taxonomy)
    return (
        # The taxonomy is broadcast when its known size allows; else the join sorts and adaptive
        # execution splits a label that most rows share.
        df.withColumn("label_key", F.when(~absent, F.lower(label)))
        .join(lookup, "label_key", "left")
        .withColumn(
            "valid_label",
            F.when(F.array_contains("spellings", label), label).otherwise(F.col("canonical")),
        )
        .withColumn("label_ok", absent | F.col("valid_label").isNotNull())
        .drop("label_key", "spellings", "canonical")
    )


def _filled(template: str, *values: Column) -> Column:
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def _over(c: Column, limit: int, template: str) -> Column:
    """The issue text when ``c`` is longer than ``limit``, else null."""
    return F.when(F.length(c) > limit, _filled(template, F.length(c), F.lit(limit)))


def checked_text(reasoning: Column, explanation: Column, raw: Column) -> Column:
    """What the injection patterns are run on: uncut fields plus the raw answer."""
    return F.concat_ws(" ", or_empty(reasoning), or_empty(explanation), or_empty(raw))


def check_lengths(df: DataFrame) -> DataFrame:
    """Cut ``reasoning`` and ``explanation`` above their limits and add ``length_issues``."""
    reasoning, explanation = F.col("reasoning"), F.col("explanation")
    issues = F.array_compact(
        F.array(
            _over(F.col("raw_response"), fixed.MAX_RESPONSE_CHARS, fixed.ISSUE_TOO_LONG),
            _over(reasoning, fixed.MAX_REASONING_CHARS, fixed.ISSUE_REASONING),
            _over(explanation, fixed.MAX_EXPLANATION_CHARS, fixed.ISSUE_EXPLANATION),
        )
    )
    return df.withColumns(
        {
            "length_issues": issues,
            "reasoning": cut(reasoning, fixed.MAX_REASONING_CHARS),
            "explanation": cut(explanation, fixed.MAX_EXPLANATION_CHARS),
        }
    )


def detect_injection(df: DataFrame, column: str, word_bounded: bool = False) -> DataFrame:
    """Add ``suspicious``: some injection pattern occurs in the text."""
    return df.withColumn("suspicious", has_injection(F.col(column), word_bounded))


def injection_matches(df: DataFrame, column: str, word_bounded: bool = False) -> DataFrame:
    """One row per text and matching pattern: adds ``pattern_ordinal``.

    The text is folded in a projection of its own, so the tests are compiled code on one column, and single patterns
    are listed only for texts in which some pattern occurs.
    """
    text = free_name("_folded", df)
    # explode_outer: the optimizer would evaluate the patterns of a plain explode a second time, to drop
    # texts without matches before it.
    found = F.explode_outer(folded_injection_ordinals(F.col(text), word_bounded))
    listed = df.withColumn(text, folded(or_empty(F.col(column)))).withColumn("pattern_ordinal", found)
    return listed.drop(text).filter("pattern_ordinal IS NOT NULL")


def validate_output(
    df: DataFrame, taxonomy: DataFrame, strict: bool = True, word_bounded: bool = False
) -> DataFrame:
    """Check ``parsed`` against ``raw_response`` and the taxonomy: adds the struct ``checked``.

    checked = (is_valid, issues, verdict, label, reasoning, explanation, suspicious, label_rejected).
    Any issue makes the row invalid; a rejected label downgrades Incorrect to Uncertain; a suspicious
    text forces Uncertain when ``strict``.
    """
    p = F.col("parsed")
    labelled = validate_label(
        df.withColumn("_suggested", p["suggested_label"]), taxonomy, "_suggested"
    ).withColumn(
        "_suspicious",
        has_injection(
            checked_text(p["reasoning"], p["explanation"], F.col("raw_response")), word_bounded
        ),
    )

    given = F.coalesce(p["verdict"], F.lit(fixed.UNCERTAIN))
    mapped = normalize_verdict(given)
    rejected = ~F.col("label_ok")
    downgraded = rejected & (mapped == fixed.INCORRECT)
    suspicious = F.col("_suspicious")
    issues = F.array_compact(
        F.array(
            _over(F.col("raw_response"), fixed.MAX_RESPONSE_CHARS, fixed.ISSUE_TOO_LONG),
            F.when(~given.isin(*fixed.VERDICTS), _filled(fixed.ISSUE_VERDICT, given, mapped)),
            F.when(rejected, _filled(fixed.ISSUE_LABEL, F.col("_suggested"))),
            F.when(downgraded, F.lit(fixed.ISSUE_DOWNGRADE)),
            _over(p["reasoning"], fixed.MAX_REASONING_CHARS, fixed.ISSUE_REASONING),
            _over(p["explanation"], fixed.MAX_EXPLANATION_CHARS, fixed.ISSUE_EXPLANATION),
            F.when(suspicious, F.lit(fixed.ISSUE_INJECTION)),
        )
    )
    forced = downgraded | suspicious if strict else downgraded
    checked = F.struct(
        (F.size("_issues") == 0).alias("is_valid"),
        F.col("_issues").alias("issues"),
        F.when(forced, fixed.UNCERTAIN).otherwise(mapped).alias("verdict"),
        F.col("valid_label").alias("label"),
        cut(or_empty(p["reasoning"]), fixed.MAX_REASONING_CHARS).alias("reasoning"),
        cut(or_empty(p["explanation"]), fixed.MAX_EXPLANATION_CHARS).alias("explanation"),
        suspicious.alias("suspicious"),
        rejected.alias("label_rejected"),
    )
    return (
        labelled.withColumn("_issues", issues)
        .withColumn("checked", checked)
        .drop("_suggested", "_suspicious", "_issues", "valid_label", "label_ok")
    )


def validation_stats(validated: DataFrame) -> DataFrame:
    """One row: suspicious answers and rejected labels among freshly scored answers."""
    return validated.agg(
        F.count_if(F.col("checked.suspicious")).alias("validation_failures"),
        F.count_if(F.col("checked.label_rejected")).alias("invalid_labels_rejected"),
    )



"""String helpers with the whitespace and number rules of the data model."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from secondlook import fixed

# Whitespace is Unicode whitespace plus the four information separators (U+001C..U+001F).
WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"


def unicode_regex(pattern: str, ignore_case: bool = False) -> str:
    """Spell a pattern for Java so that \\s, \\d, \\w and \\b follow Unicode rules."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern


def trim_ws(c: Column) -> Column:
    """Strip any whitespace from both ends; plain ``trim`` strips only spaces.

    The pattern takes all and gives back trailing whitespace, which is linear even in texts with very
    long runs of blanks.
    """
    return F.regexp_extract(c, rf"(?sU)\A{WS}*(.*{NOT_WS})?", 1)


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2**31 - 1)))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def n_chars(c: Column) -> Column:
    return F.length(c).cast("bigint")


def cut(c: Column, limit: int) -> Column:
    """Cut text above ``limit`` characters and mark the cut."""
    return F.when(
        F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(fixed.TRUNCATION_MARK))
    ).otherwise(c)


def redact(c: Column) -> Column:
    """Hide the middle of a text; short texts are hidden whole, null and empty stay as they are."""
    return (
        F.when(c.isNull() | (c == ""), c)
        .when(F.length(c) <= 20, F.lit(fixed.REDACTED_SHORT))
        .otherwise(
            F.concat(F.left(c, F.lit(10)), F.lit(fixed.REDACTED_MIDDLE), F.right(c, F.lit(10)))
        )
    )


def word_count(c: Column) -> Column:
    words = F.filter(F.split(c, unicode_regex(f"{WS}+")), lambda w: w != "")
    return F.size(words).cast("bigint")


def number_text(c: Column) -> Column:
    """Decimal text of a double as it appears in prompts: 0.85, 1.0, 0.0005, 1e-05.

    Spark switches to exponents below 0.001, prompts only below 0.0001.
    """
    plain = c.cast("string")
    digits = F.regexp_replace(F.regexp_extract(plain, r"^-?([\d.]+)E", 1), r"\.0$", "")
    sign = F.when(c < 0, "-").otherwise("")
    exponent = F.regexp_extract(plain, r"E-(\d+)$", 1)
    fraction = F.concat(sign, F.lit("0.000"), F.replace(digits, F.lit("."), F.lit("")))
    scientific = F.concat(sign, digits, F.lit("e-"), F.lpad(exponent, 2, "0"))
    size = F.abs(c)
    return (
        F.when(c.isNull(), "None")
        .when((size == 0) | (size >= 1e-3), plain)
        .when(size >= 1e-4, fraction)
        .otherwise(scientific)
    )


def _forms(c: Column) -> list[tuple[str, Column]]:
    """The seven ways a template sentence may be written."""
    lowered_start = F.concat(F.lower(F.left(c, F.lit(1))), F.substring(c, 2, 2**31 - 1))
    return [
        ("plain", c),
        ("lower", F.lower(c)),
        ("greeting", F.concat(F.lit("Hi, "), lowered_start)),
        ("thanks", F.concat(c, F.lit(" Thanks."))),
        ("letter", F.concat(F.lit("Hello, "), lowered_start, F.lit(" Best regards."))),
        ("urgent", F.concat(F.lit("URGENT: "), c)),
        ("exclaim", F.replace(c, F.lit("."), F.lit("!"))),
    ]


N_VARIATIONS = 7


def variations(c: Column) -> Column:
    """All forms of a text, as an array of (variant, text)."""
    return F.array(*[F.struct(F.lit(n).alias("variant"), t.alias("text")) for n, t in _forms(c)])


def variation(c: Column, pick: Column) -> Column:
    """The ``pick``-th (0-based) form of a text; only the chosen form is built."""
    chosen = F.when(F.lit(False), c)
    for i, (_, form) in enumerate(_forms(c)):
        chosen = chosen.when(pick == i, form)
    return chosen

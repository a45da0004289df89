"""Injection and personal-data pattern tests."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from secondlook import fixed
from secondlook.functions.text import WS, or_empty, unicode_regex

# Letters outside ASCII that equal an ASCII letter when case is ignored.
_CASE_TWINS = (("\u017f", "s"), ("\u212a", "k"), ("\u0130", "i"), ("\u0131", "i"))


# Per injection pattern, literals of which every match contains one (split by |). A text without them
# cannot match, and looking for a literal is far cheaper than running the pattern. Literals that begin
# with an uncommon letter are found fastest.
_INJECTION_LITERALS = (
    "gnore", "gnore", "gard", "forget", "uction", "verride", "ystem", "you are|act as|pretend to be",
    "[system]", "<", "assistant", "[inst]", "<<sys>>", "utput", "respond", "say", "print", "dan",
    "veloper", "jailbreak", "bypass", "veal", "show", "what", "<script", "javascript:", "click", "onerror",
)

# Per personal-data pattern, what its first character can be; tested before the costly word boundary.
_PII_START = {
    "phone": r"(?=[+(0-9])",
    "ssn": r"(?=\d)",
    "credit_card": r"(?=\d)",
    "ip_address": r"(?=\d)",
    "name_like": r"(?=[mMdD])",
}
_FOUR_DIGITS = r"\p{Nd}{4}"


def folded(c: Column) -> Column:
    """Lower-case text on which case-sensitive ASCII patterns act as case-insensitive ones."""
    has_twin = reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t, _ in _CASE_TWINS])
    untwinned = c
    for twin, plain in _CASE_TWINS:
        untwinned = F.replace(untwinned, F.lit(twin), F.lit(plain))
    return F.lower(F.when(has_twin, untwinned).otherwise(c))


def _injection_tests(text: Column, word_bounded: bool) -> list[Column]:
    """One test per injection pattern on folded text, in pattern order."""
    tests = []
    for pattern, literals in zip(fixed.INJECTION_PATTERNS, _INJECTION_LITERALS, strict=True):
        present = reduce(
            lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in literals.split("|")]
        )
        if pattern == "dan" and word_bounded:
            pattern = r"\bdan\b"
        if pattern != literals:
            present = present & text.rlike(unicode_regex(pattern.replace(r"\s", WS)))
        tests.append(present)
    return tests


def has_injection(c: Column, word_bounded: bool = False) -> Column:
    """True when any injection pattern occurs.

    The text is folded once per row (bound as the lambda's argument), and the first pattern found ends
    the search.
    """
    return F.exists(
        F.array(folded(or_empty(c))),
        lambda text: reduce(lambda a, b: a | b, _injection_tests(text, word_bounded)),
    )


def injection_ordinals(c: Column, word_bounded: bool = False) -> Column:
    """Array with the 1-based positions of all injection patterns that occur."""

    def all_patterns(text: Column) -> Column:
        tests = _injection_tests(text, word_bounded)
        hits = [F.when(t, F.lit(i).cast("bigint")) for i, t in enumerate(tests, 1)]
        return F.array_compact(F.array(*hits))

    return F.flatten(F.transform(F.array(folded(or_empty(c))), all_patterns))


def folded_injection_ordinals(text: Column, word_bounded: bool = False) -> Column:
    """Array with the 1-based positions of all injection patterns that occur in ``folded`` text; null if none does."""
    tests = _injection_tests(text, word_bounded)
    hits = [F.when(t, F.lit(i).cast("bigint")) for i, t in enumerate(tests, 1)]
    return F.when(reduce(lambda a, b: a | b, tests), F.array_compact(F.array(*hits)))


def _pii_regex(c: Column, name: str) -> Column:
    pattern = dict(fixed.PII_PATTERNS)[name].replace(r"\s]", r"\s\x1c-\x1f]").replace(r"\s+", f"{WS}+")
    return c.rlike(unicode_regex(_PII_START.get(name, "") + pattern, ignore_case=True))


def has_digit_run(c: Column) -> Column:
    """Four digits in a row: without them there is no phone, social security or card number."""
    return or_empty(c).rlike(_FOUR_DIGITS)


def pii_flags(c: Column, digit_run: Column | None = None) -> dict[str, Column]:
    """One test per personal-data pattern. ``digit_run`` may hold ``has_digit_run`` computed once."""
    text = or_empty(c)
    digits = has_digit_run(c) if digit_run is None else digit_run
    guards = {
        "email": F.contains(text, F.lit("@")),
        "phone": digits,
        "ssn": digits,
        "credit_card": digits,
        "ip_address": text.rlike(r"\.\p{Nd}"),
    }
    return {
        name: guards[name] & _pii_regex(text, name) if name in guards else _pii_regex(text, name)
        for name, _ in fixed.PII_PATTERNS
    }

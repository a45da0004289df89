"""PII: a skip-chain conditional random field over the entity-like tokens of a document.

Fixed patterns find base spans of four kinds; these stay. The field labels the other tokens that hold a digit or an @,
or repeat the name of an address: each token's shape speaks for or against the kinds, neighbours influence each other
weakly, and tokens that repeat or resemble each other (same last digits, same name) share a potential however far apart
they stand. Base spans are observed. Loopy message passing spreads them, so that a phone number without its plus sign
is found where the document has it in full elsewhere.

The weights are those of a logistic regression over shape and the label of a like token, learned from a bounded
sample: base spans with parts cut off are its positive examples, other tokens its negative ones, those that repeat with
a like token that is none. Every document with such a token goes through the field, with or without base spans or repeats.

Defined cases: null is as the empty text, which has no spans; without training examples only base spans are found.
Offsets count code points. Other columns pass through.
"""

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import give_back, giving_back, table

#: Kinds in the order in which spans that begin together are listed.
KINDS = ("email", "ip", "card", "phone")
#: Training uses at most this many documents with a digit or an @, those with the smallest hashes of their ids.
SAMPLE = 4000
#: Messages have settled when a sweep moves none by more. A group's links form chains, which one sweep settles, and all
#: weights favour agreement, so few sweeps are needed; the bound only ends rounding errors that go on for ever.
SETTLED, SWEEPS = 1e-4, 1000
CHAIN_WEIGHT = 0.2
CERTAIN = 0.6

_DIGIT = re.compile("[0-9]").search
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++").match
# Where a run of digits doesn't match from its first digit, it matches from none: no need to try each.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_NUMBER = re.compile(r"[(0-9](?:[\x20().-]{0,2}[0-9])++").finditer
_NAME = re.compile(r"[A-Za-z0-9._%+@-]++").finditer
# The names that hold a digit or an @; the look-behind lets each run be tried once.
_MARKED = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9._%+@-]*+").finditer
_NOT_DIGITS = re.compile("[^0-9]+").sub

Span = tuple[int, int, int]  # start, end, number of the kind


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of name, @ and domain; found from the @ outwards, so that long runs without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and kind."""
    spans = [(a, z, 0) for a, z in emails(text)] if "@" in text else []
    if _DIGIT(text):
        for m in _IP(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                spans.append((*m.span(), 1))
        for m in _CARD(text):
            digits = _NOT_DIGITS("", m[0])
            if 14 <= len(digits) <= 19 and passes_luhn(digits):
                spans.append((*m.span(), 2))
        if "+" in text:
            for m in _PHONE(text):
                if 10 <= len(_NOT_DIGITS("", m[0])) <= 15:
                    spans.append((*m.span(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2]))


def joined_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, z, k in sorted(spans, key=lambda s: (s[0], s[2])))


# The field


def key_of(token: str) -> str:
    """What like tokens have in common: the last seven digits, else the name before an @."""
    digits = _NOT_DIGITS("", token)
    return digits[-7:] if len(digits) >= 7 else token.partition("@")[0].lower().strip(".-")


def shape(token: str) -> list[float]:
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    return [
        1.0, float("@" in token), float(token.startswith("+")), float("(" in token), min(token.count("."), 4) / 4,
        min(token.count("-"), 4) / 4, min(token.count(" "), 4) / 4, float(letters > 0), float(digits == 0),
        float(1 <= digits <= 4), float(5 <= digits <= 6), float(7 <= digits <= 12), float(13 <= digits <= 19),
    ]


N_SHAPE = len(shape(""))
N_LABELS = len(KINDS) + 1  # the last one is "none"
NONE = len(KINDS)


@dataclass(frozen=True)
class FieldModel:
    shapes: np.ndarray  # (N_SHAPE, N_LABELS)
    like: np.ndarray  # (N_LABELS,): how much a like token with the same label speaks for a label


def other_tokens(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Entity-like tokens that touch no base span, in order and without overlaps."""
    names = {text[a:z].partition("@")[0].lower().strip(".-") for a, z, k in base if k == 0} - {""}
    found = [m.span() for m in _NUMBER(text)] if _DIGIT(text) else []
    if names:
        found += [m.span() for m in _NAME(text) if "@" in m[0] or _DIGIT(m[0]) or m[0].lower().strip(".-") in names]
    elif found or "@" in text:
        found += [m.span() for m in _MARKED(text)]
    taken = sorted((a, z) for a, z, _ in base)
    found = [(a, a + len(text[a:z].rstrip(".-"))) for a, z in found]
    tokens, end, i = [], -1, 0
    for a, z in sorted(found, key=lambda s: (s[0], -s[1])):
        if a < end:
            continue
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i < len(taken) and taken[i][0] < z:
            continue
        tokens.append((a, z))
        end = z
    return tokens


def links_of(keys: list[str], base: list[bool] | None = None) -> list[tuple[int, int]]:
    """Skip links: each token with the one before it that has the same key, and with the nearest base span of that key.

    So a group has at most two links a token, and an observed span is one link away from each of its copies.
    """
    groups: dict[str, list[int]] = defaultdict(list)
    for i, key in enumerate(keys):
        if key:
            groups[key].append(i)
    links = []
    for group in groups.values():
        links += zip(group, group[1:])
        seen = [n for n, i in enumerate(group) if base and base[i]]
        at = 0
        for n in range(len(group) if seen else 0):
            while at + 1 < len(seen) and abs(group[seen[at + 1]] - group[n]) < abs(group[seen[at]] - group[n]):
                at += 1
            if abs(seen[at] - n) > 1 and not base[group[n]]:
                links.append((min(group[n], group[seen[at]]), max(group[n], group[seen[at]])))
    return sorted(links)


def marginals(scores: np.ndarray, links: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loopy belief propagation: label probabilities of tokens with the given scores.

    ``links`` are (from, to, kind) in both directions, each followed by its reverse; ``weights`` (kinds, labels) is
    what agreement in a label adds. One sweep passes messages from the first token to the last and back, so it carries
    evidence along whole chains; sweeps go on until no message moves.
    """
    beliefs = scores.tolist()
    labels = range(scores.shape[1])
    messages = [[0.0] * len(labels) for _ in range(len(links))]
    gains = (np.exp(weights) - 1).tolist()
    ways = np.asarray(links).reshape(-1, 3).tolist()
    ahead, back = [[] for _ in beliefs], [[] for _ in beliefs]
    for number, (source, target, _) in enumerate(ways):
        (ahead if source < target else back)[source].append(number)
    order = range(len(beliefs))
    for _ in range(SWEEPS if ways else 0):
        moved = 0.0
        for tokens, sent in ((order, ahead), (reversed(order), back)):
            for i in tokens:
                for number in sent[i]:
                    _, target, kind = ways[number]
                    out = [b - m for b, m in zip(beliefs[i], messages[number ^ 1])]
                    top = max(out)
                    out = [math.exp(x - top) for x in out]
                    total = sum(out)
                    new = [math.log(total + g * x) for g, x in zip(gains[kind], out)]
                    top = max(new)
                    belief, old = beliefs[target], messages[number]
                    for k in labels:
                        step = new[k] - top - old[k]
                        belief[k] += step
                        moved = max(moved, abs(step))
                    messages[number] = [x - top for x in new]
        if moved < SETTLED:
            break
    belief = np.array(beliefs)
    belief = np.exp(belief - belief.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True)


def all_spans(text: str, base: list[Span], model: FieldModel) -> list[Span]:
    """Base spans and those that the field adds."""
    tokens = other_tokens(text, base)
    if not tokens or not model.shapes.any():  # nothing to label, or nothing was learned
        return base
    nodes = sorted([(a, z, k) for a, z, k in base] + [(a, z, -1) for a, z in tokens])
    words = [text[a:z] for a, z, _ in nodes]
    scores = np.array([shape(w) for w in words]) @ model.shapes
    for i, (_, _, k) in enumerate(nodes):
        if k >= 0:
            scores[i] = -1e3
            scores[i, k] = 0
    skips = links_of([key_of(w) for w in words], [k >= 0 for _, _, k in nodes])
    pairs = [(a, b, 0) for a, b in skips] + [(i, i + 1, 1) for i in range(len(nodes) - 1)]
    links = np.array([way for a, b, k in pairs for way in ((a, b, k), (b, a, k))], np.int64)
    weights = np.stack([model.like, np.full(N_LABELS, CHAIN_WEIGHT)])
    sure = marginals(scores, links, weights)
    added = [
        (a, z, int(p.argmax())) for (a, z, k), p in zip(nodes, sure) if k < 0 and p.argmax() != NONE and p.max() >= CERTAIN
    ]
    return sorted(base + added, key=lambda s: (s[0], s[2]))


# Training


def cut_forms(token: str, kind: int) -> list[str]:
    """What a span may look like where it stands without some of its parts."""
    if kind == 0:
        return [token.partition("@")[0]]
    if kind == 3:
        digits = _NOT_DIGITS("", token)
        return [token[1:], token.partition(" ")[2] or token[1:], digits[-10:]]
    return [token, _NOT_DIGITS("", token)] if kind == 2 else [token]


def examples(texts) -> tuple[np.ndarray, np.ndarray]:
    """Rows of shape and one-hot label of a like token, and the labels."""
    x, y = [], []
    for text in texts:
        base = base_spans(text or "")
        for a, z, k in base:
            for form in cut_forms(text[a:z], k):
                like = [0.0] * N_LABELS
                like[k] = 1.0
                x.append(shape(form) + like)
                y.append(k)
        known = {key_of(text[a:z]) for a, z, _ in base}
        others = [text[a:z] for a, z in other_tokens(text or "", base)]
        repeats = Counter(map(key_of, others))
        for token in others:
            if (key := key_of(token)) not in known:
                like = [0.0] * N_LABELS
                like[NONE] = float(bool(key) and repeats[key] > 1)
                x.append(shape(token) + like)
                y.append(NONE)
    return np.array(x, float).reshape(-1, N_SHAPE + N_LABELS), np.array(y, np.int64)


def fit(sample: pd.DataFrame) -> pd.DataFrame:
    x, y = examples(sample.sort_values("doc_id")["text"])
    w = np.zeros((N_SHAPE + N_LABELS, N_LABELS))
    if len(x) and (y != NONE).any():
        wanted = np.eye(N_LABELS)[y]
        for step in range(300):
            p = x @ w
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w += 2.0 / (1 + step / 100) * (x.T @ (wanted - p) / len(x) - 1e-4 * w)
    return pd.DataFrame({"row": np.arange(len(w)), "w": list(w)})


def _fitted(sample: pd.DataFrame) -> pd.DataFrame:
    found = fit(sample)
    give_back()
    return found


def train(documents: DataFrame, sample: int = SAMPLE) -> FieldModel:
    own = documents.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull())
    ids = own.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(sample)
    # At most ``sample`` ids.
    rows = own.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = rows.withColumn("share", F.lit(0)).groupBy("share").applyInPandas(_fitted, "row long, w array<double>")
    rows = found.toPandas().sort_values("row")
    if rows.empty:
        return FieldModel(np.zeros((N_SHAPE, N_LABELS)), np.zeros(N_LABELS))
    w = np.stack(rows["w"].to_numpy())
    return FieldModel(w[:N_SHAPE], np.maximum(np.diag(w[N_SHAPE:]), 0))


RESULT = (
    "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base:string,base_sha256:string,spans:string,masked:string>"
)
_ARROW = pa.struct(
    [(f"n_{k}", pa.int64()) for k in KINDS] + [(n, pa.string()) for n in ("base", "base_sha256", "spans", "masked")]
)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping ones the first counts."""
    parts, end = [], 0
    for a, z, k in spans:
        if a >= end:
            parts += [text[end:a], f"[{KINDS[k].upper()}]"]
        elif z > end:
            pass  # its rest goes with the span before it
        end = max(end, z)
    return "".join([*parts, text[end:]])


def with_personal_data(
    documents: DataFrame, model: FieldModel, text: str = "text", out: str = "found", masked: bool = True
) -> DataFrame:
    """Add (or replace) the struct ``out``: counts of base spans, base and all spans as text, and the masked text."""

    @F.arrow_udf(RESULT)
    def searched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from giving_back(each(batches))

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows: dict[str, list] = defaultdict(list)
            for t in texts.to_pylist():
                own = t or ""
                base = base_spans(own)
                spans = all_spans(own, base, model)
                for k, kind in enumerate(KINDS):
                    rows[f"n_{kind}"].append(sum(s[2] == k for s in base))
                names = joined_spans(base)
                rows["base"].append(names)
                rows["base_sha256"].append(hashlib.sha256(names.encode()).hexdigest())
                rows["spans"].append(joined_spans(spans))
                rows["masked"].append(None if t is None or not masked else mask(t, spans))
            arrays = [pa.array(rows[f.name], f.type) for f in _ARROW]
            yield pa.StructArray.from_arrays(arrays, fields=list(_ARROW))

    return documents.withColumn(out, searched(F.col(text)))


def op10_skip_chain(spark, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    found = with_personal_data(documents.select("doc_id", "text"), train(documents), masked=False)
    names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]
    return found.select("doc_id", *[F.col(f"found.{n}").alias(n) for n in names])


QUERIES = {"op10_skip_chain": op10_skip_chain}
ORACLES: dict[str, str] = {}

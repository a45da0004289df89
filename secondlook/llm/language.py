"""Language ID: script ranges narrow the candidates, then Viterbi labels the words of mixed-language texts.

Every word gets a score per language (log probabilities of its letter trigrams). Languages whose training texts
hardly use the script of the word are out. Over the words of a text, Viterbi finds the best sequence of languages,
where each switch costs a penalty; runs of one language form spans. The text's language is the one with most
letters, its score the share of letters that have it.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and no spans; without training
texts every text is ``und``; ties go to the language that comes first by name. Other columns pass through.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import fold, giving_back, mixed, table

UNKNOWN = "und"
#: Training uses about this many texts of each language, drawn by the hash of the id.
SAMPLE = 1500
TASKS = 8
BUCKETS = 1 << 16
SWITCH_PENALTY = 12.0
#: A language is a candidate for a script with at least this share of its training letters.
MIN_SHARE = 0.01
#: Characters of a run of texts, times languages when they are scored; a single longer text forms a run of its own.
STEP_CHARS = 1 << 20
#: Words that are scored at once.
CHUNK_WORDS = 1 << 14

#: First code points of script ranges with the script's number; 0 is "any other".
SCRIPT_RANGES = (
    (0x0000, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0750, 6),
    (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0B80, 10), (0x0C00, 11), (0x0E00, 12), (0x0E80, 0),
    (0x10A0, 13), (0x1100, 14), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 1), (0x2C00, 0), (0x3040, 15),
    (0x3100, 16), (0x3130, 14), (0x31A0, 0), (0x3400, 16), (0xA000, 0), (0xAC00, 14), (0xD7B0, 0), (0xF900, 16),
    (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFF21, 1), (0xFF66, 15), (0xFFA0, 14), (0xFFE0, 0),
    (0x20000, 16), (0x40000, 0),
)
SCRIPTS = 17


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    scores: np.ndarray  # (BUCKETS, languages): log probability of a trigram
    candidates: np.ndarray  # (SCRIPTS, languages): whether the language uses the script


@cache
def letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, its lower-case form, its script."""
    every = [chr(i) for i in range(0x110000)]
    letters = np.fromiter((c.isalpha() for c in every), bool, len(every))
    lower = np.arange(len(every), dtype=np.uint32)
    for i in np.flatnonzero(letters):
        small = every[i].lower()
        if len(small) == 1:
            lower[i] = ord(small)
    firsts, scripts = zip(*SCRIPT_RANGES)
    return letters, lower, np.repeat(scripts, np.diff([*firsts, len(every)])).astype(np.int8)


@dataclass
class Words:
    """The words (runs of letters) of a run of texts, and the trigrams at each of their positions."""

    first: np.ndarray  # number of the first word of each text, one more at the end
    starts: np.ndarray  # in the joined texts
    ends: np.ndarray
    offsets: np.ndarray  # where the texts start in the joined texts
    grams: np.ndarray  # bucket of the trigram that ends at each position
    scripts: np.ndarray  # of each word, by its first letter


def words_of(run: list[str]) -> Words:
    letters, lower, script_of = letter_tables()
    points = np.frombuffer("\n".join([*run, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in run])))
    inside = letters[points]
    turns = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = turns[0::2], turns[1::2]
    own = np.where(inside, lower[points], 0).astype(np.uint64)
    before = np.concatenate(([0], own[:-1])).astype(np.uint64)
    before2 = np.concatenate(([0], before[:-1])).astype(np.uint64)
    before2[before == 0] = 0
    grams = mixed(own | before << np.uint64(21) | before2 << np.uint64(42)) & np.uint64(BUCKETS - 1)
    return Words(np.searchsorted(starts, offsets), starts, ends, offsets, grams.astype(np.int64), script_of[points[starts]])


def runs(texts: list[str], limit: int = STEP_CHARS) -> Iterator[list[str]]:
    """Runs of consecutive texts with about ``limit`` characters each."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t) + 1
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram and script counts per language of a task's texts; scripts as negative buckets."""
    grams: dict[str, np.ndarray] = {}
    for batch in batches:
        languages, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for name in set(languages):
            total = grams.setdefault(name, np.zeros(BUCKETS + SCRIPTS, np.int64))
            for run in runs([t or "" for t, own in zip(texts, languages) if own == name]):
                found = words_of(run)
                ends = np.zeros(len(found.grams), np.int64)
                ends[found.starts] += 1
                ends[found.ends] -= 1
                used = np.cumsum(ends) > 0
                used[found.ends] = True  # the trigram that tells how a word ends
                total[:BUCKETS] += np.bincount(found.grams[used], minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(found.scripts, found.ends - found.starts, SCRIPTS).astype(np.int64)
    for name, total in grams.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"]
        )


def train(documents: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from about ``sample`` texts per language outside the held-out fold (all, if there are fewer)."""
    known = documents.select("doc_id", "lang", "text").filter("lang IS NOT NULL").filter(fold("doc_id", 4) != 2)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n_lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    drawn = known.join(F.broadcast(sizes), "lang").filter(draw < F.lit(float(sample)) / F.col("n_lang"))
    counts = (
        drawn.select("lang", "text")
        .repartition(TASKS)
        .mapInArrow(lambda b: giving_back(_counted(b)), "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most BUCKETS + SCRIPTS rows per language
    )
    names = tuple(sorted(counts["lang"].unique()))
    number = {name: i for i, name in enumerate(names)}
    full = np.zeros((BUCKETS + SCRIPTS, len(names)))
    full[counts["bucket"], counts["lang"].map(number)] = counts["n"]
    grams, scripts = full[:BUCKETS], full[BUCKETS:]
    scores = np.log((grams + 0.1) / (grams.sum(0) + 0.1 * BUCKETS))
    return LanguageModel(names, scores.astype(np.float32), scripts >= np.maximum(MIN_SHARE * scripts.sum(0), 1))


def word_scores(found: Words, model: LanguageModel) -> np.ndarray:
    """(words, languages): the summed trigram scores; languages that don't use the word's script get -1e6."""
    scores = np.zeros((len(found.starts), len(model.languages)), np.float32)
    for a in range(0, len(scores), CHUNK_WORDS):
        starts, ends = found.starts[a : a + CHUNK_WORDS], found.ends[a : a + CHUNK_WORDS]
        sums = np.zeros((ends[-1] + 2 - starts[0], len(model.languages)))
        np.cumsum(model.scores[found.grams[starts[0] : ends[-1] + 1]], axis=0, out=sums[1:])
        scores[a : a + CHUNK_WORDS] = sums[ends + 1 - starts[0]] - sums[starts - starts[0]]
    open_to = model.candidates[found.scripts]
    open_to[~open_to.any(1)] = True  # a script that no language uses tells nothing
    scores[~open_to] = -1e6
    return scores


def best_paths(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Viterbi over the words of all texts at once, the texts advancing side by side: a language per word."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    start, n_active = first[order], np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    switched = np.zeros(scores.shape, bool)
    leaders, path = np.zeros(len(scores), np.int8 if scores.shape[1] < 128 else np.int32), np.zeros(len(scores), np.int32)
    value = np.zeros((len(order), scores.shape[1]))  # sums of many words need the longer floats
    for t, n in enumerate(n_active):
        at, v = start[:n] + t, value[:n]
        if t:
            lead = v.argmax(1)
            jump = v[np.arange(n), lead][:, None] - SWITCH_PENALTY
            leaders[at] = lead
            switched[at] = jump > v
            np.maximum(v, jump, out=v)
        v += scores[at]
    last = value.argmax(1)
    for t in range(len(n_active) - 1, -1, -1):
        at = start[: n_active[t]] + t
        path[at] = last[: len(at)]
        if t:
            own = last[: len(at)]
            last[: len(at)] = np.where(switched[at, own], leaders[at], own)
    return path


def identify(texts: list[str], model: LanguageModel, spans: bool) -> list[tuple]:
    """(language, score, spans) for each text; spans are (start, end, language) in code points."""
    if not model.languages:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    results: list[tuple] = []
    for run in runs(texts, max(STEP_CHARS // len(model.languages), 1)):
        found = words_of(run)
        scores = word_scores(found, model)
        found.grams = found.grams[:0]
        results += _summaries(found, best_paths(scores, found.first), model, spans)
    return results


def _summaries(f: Words, path: np.ndarray, model: LanguageModel, spans: bool) -> list[tuple]:
    n, size = len(f.first) - 1, len(model.languages)
    owner = np.repeat(np.arange(n), np.diff(f.first))
    letters = np.bincount(owner * size + path, f.ends - f.starts, n * size).reshape(n, size)
    total, best = letters.sum(1), letters.argmax(1)
    share = letters.max(1) / np.maximum(total, 1)
    results = [(model.languages[b], float(s), []) if t else (UNKNOWN, 0.0, []) for b, s, t in zip(best, share, total)]
    if spans and len(path):
        cuts = np.flatnonzero((np.diff(path) != 0) | (np.diff(owner) != 0)) + 1
        for a, z in zip(np.append(0, cuts), np.append(cuts, len(path))):
            base = f.offsets[owner[a]]
            results[owner[a]][2].append((int(f.starts[a] - base), int(f.ends[z - 1] - base), model.languages[path[a]]))
    return results


RESULT = "struct<lang:string,score:double,spans:array<struct<start:long,stop:long,lang:string>>>"
_ARROW = pa.struct([
    ("lang", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))),
])


def with_language(
    documents: DataFrame, model: LanguageModel, text: str = "text", out: str = "language", spans: bool = True
) -> DataFrame:
    """Add (or replace) the struct column ``out`` with (lang, score, spans); empty spans unless asked for."""

    @F.arrow_udf(RESULT)
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from giving_back(each(batches))

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = identify([t or "" for t in texts.to_pylist()], model, spans)
            languages, scores, parts = zip(*found) if found else ((), (), ())
            named = [[{"start": s, "stop": e, "lang": n} for s, e, n in part] for part in parts]
            columns = [pa.array(c, f.type) for c, f in zip((languages, scores, named), _ARROW)]
            yield pa.StructArray.from_arrays(columns, fields=list(_ARROW))

    return documents.withColumn(out, identified(F.col(text)))


def op4_language(spark, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    found = with_language(documents.select("doc_id", "text"), train(documents), out="found", spans=False)
    return found.select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
    )


QUERIES = {"op4_language": op4_language}
ORACLES: dict[str, str] = {}

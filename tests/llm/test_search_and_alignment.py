"""Word scan, tokenizer spans and pivot tables against brute force, with odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from secondlook.llm import pivot_tables, tokenizer_spans, word_scan
from secondlook.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}
PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table_of(spark, rows):
    """Rows (doc_id, text) with columns that clash with names used inside."""
    given = spark.createDataFrame(rows, "doc_id long, text string")
    clash = {n: F.lit("mine") for n in ("score", "rank", "item_id", "bits", "cell", "row", "pairs", "pair", "n", "term", "label")}
    return given.withColumns(clash)


# Word scan


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, b in bags for t in b)
    merged = {}
    for i, t in items:
        if i is not None:
            merged.setdefault(i, set()).update(terms(t))
    found = []
    for item, own in merged.items():
        scored = []
        for (i, bag), length in zip(bags, lengths):
            score = 0
            for t in own & bag.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * (10 + 90 * length * n // total)))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        found += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=str)


def random_texts(n, seed):
    draw = random.Random(seed)
    pool = ["the", "The", "fox", "É", "é", "日本", "x1", "fo", "foxes", "a", "\x00", "-", "🙂", "_", "ß", "ſ", "K"]
    glue = [" ", "-", "", "\n", "\x00", "`", "@"]
    return ["".join(draw.choice(pool) + draw.choice(glue) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(word_scan, "PIECE", 64)
    monkeypatch.setattr(word_scan, "DOCUMENTS", 7)
    monkeypatch.setattr(word_scan, "SLACK", 1)
    docs = list(enumerate(random_texts(150, 1))) + [(None, "the fox 日本"), (3, "fox"), (3, "fox"), (500, None), (501, ""), (502, "the " * 5000)]
    items = list(enumerate(random_texts(12, 2))) + [(3, "foxes x1"), (20, None), (21, "--"), (None, "fox"), (22, "unheard")]
    given, asked = table_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    expected = brute_search(docs, items)
    for blocks in ({}, {"block_items": 4}, {"block_terms": 6}):
        assert sorted(map(tuple, word_scan.search(given, asked, **blocks).collect()), key=str) == expected
    assert word_scan.search(given.limit(0), asked).count() == 0
    assert word_scan.search(given, asked.limit(0)).count() == 0


def test_best_documents_break_ties_by_id(spark):
    docs = [(i, "same words") for i in range(40, 0, -1)] + [(99, "other")]
    found = word_scan.search(table_of(spark, docs), spark.createDataFrame([(1, "words")], "item_id long, text string"))
    assert [r.doc_id for r in sorted(found.collect(), key=lambda r: r["rank"])] == list(range(1, 11))


def test_word_scan_equals_its_sql(spark, sf):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    theirs = con.sql(entry.oracle_sql()["op11_word_scan"])
    ours = entry.queries()["op11_word_scan"](spark, sf).select(*theirs.columns)
    assert sorted(map(tuple, ours.collect())) == sorted(theirs.fetchall())


# Tokenizer spans


def brute_alignment(texts):
    """Whole texts by both tokenizers, ends of tokens in decoded bytes."""
    one, other = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    one.encode_special_tokens = True
    spelled = tokenizer_spans.byte_of_character()
    entries = {i: e for e, i in one.get_vocab().items()}

    def bytes_a(i):
        return bytes(spelled[c] for c in entries[i])

    def bytes_b(i):
        piece = other.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    rows, linked = [], Counter()
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = other.encode(text) if text else []
        sides = [[bytes_a(i) for i in a], [bytes_b(i) for i in b]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            rows.append(None)
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in sides]
        shared = set(ends[0]) & set(ends[1])
        links = list(zip([i for i, e in zip(a, ends[0]) if e in shared], [i for i, e in zip(b, ends[1]) if e in shared]))
        groups, at = [], [0, 0]
        for e in sorted(shared):
            to = [ends[0].index(e) + 1, ends[1].index(e) + 1]
            groups.append("|".join(",".join(map(str, ids[x:z])) for ids, x, z in zip((a, b), at, to)))
            at = to
        linked.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (_, b), n in linked.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if r is None
        else (*r[:3], len(r[3]), sum(linked[p] == most[p[1]] for p in r[3]), sum(linked[p] for p in r[3]), r[4])
        for r in rows
    ]


@pytest.mark.parametrize("common", [1 << 19, 50])
def test_alignment_equals_whole_texts(spark, common):
    draw = random.Random(3)
    pool = [
        " ", "  ", "\n", "\t", "a", "the", "é", "中", "🙂", "▁", "<s>", "<|endoftext|>", "\x00", "\x85", "\xa0", ".", ",", "123", "'s",
        "Ａ", "\x1c", "word", "ß", "\r\n", "<0x41>", "</s>", "​", "ᄀ", "𝔘",
    ]
    texts = ["".join(draw.choice(pool) for _ in range(draw.randint(1, 25))) for _ in range(600)]
    texts += [" ".join(draw.choice(pool) for _ in range(draw.randint(1, 25))) for _ in range(600)]
    words = ["word", "Word,", "mixing.", "it's", "naïve!", "日本?", "e.g.;", "end:", "x,", "9.", "a.b", "straße,", "),"]
    texts += ["".join(draw.choice(words) + draw.choice(" \n ") for _ in range(draw.randint(1, 40))) for _ in range(400)]
    texts += [None, "", " ", "x" * 20_000, "é" * 3000, "the same text", "the same text"]
    expected = sorted((i, *r) for i, r in enumerate(brute_alignment(texts)))
    assert sum(r[1] > 0 for r in expected) > 500
    found = tokenizer_spans.align(table_of(spark, list(enumerate(texts))), PATH_A, PATH_B, common)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.select(*columns).collect())) == expected


def test_alignment_of_repeated_and_missing_ids(spark):
    given = table_of(spark, [(1, "one text"), (1, "one text"), (None, "one text"), (2, None)])
    rows = tokenizer_spans.align(given, PATH_A, PATH_B).collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in rows) == [(0, 2), (1, 2), (1, 2), (2, 0)]
    assert {r.count_sum for r in rows} == {0, 6} and {r.n_best for r in rows} == {0, 2}
    assert tokenizer_spans.align(given.limit(0), PATH_A, PATH_B).count() == 0


def test_coarse_cuts_are_refined_inside_characters():
    aligner = tokenizer_spans.aligner_of(PATH_A, PATH_B)
    aligner.align({" Ａ①b"})
    n_a, n_b, groups, links, good = aligner.kept[" Ａ①b"]
    sides = [p.split("|") for p in groups.split(";")]
    assert good and len(links) == len(sides)
    assert [sum(len(s[k].split(",")) for s in sides) for k in (0, 1)] == [n_a, n_b]


def test_segments_lose_nothing():
    aligner = tokenizer_spans.aligner_of(PATH_A, PATH_B)
    assert aligner.by_segments and set(aligner.marks) == set(tokenizer_spans.MARKS)
    for text in random_texts(50, 8) + ["a b\nc  d \n e", " a", "\na ", "a\n\nb"]:
        assert "".join(aligner.segments(text)) == " " + text
    assert aligner.segments("a, b\nc") == [" a,", " b", "\nc"]


# Pivot tables


def brute_bits(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_labels(bits):
    """The smallest place that each place reaches by links of at most two bits."""
    label = list(range(len(bits)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    bits = np.array(bits, np.int64).view(np.uint64)
    for i in range(len(bits)):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= 2) + i + 1:
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(bits))]


def near_bits(n, seed):
    """Random fingerprints, chains of small steps away from them, and a crowd around one."""
    draw = np.random.default_rng(seed)
    bits = draw.integers(-(2**63), 2**63 - 1, n, dtype=np.int64).tolist()
    for i in range(n):
        for flips in draw.integers(1, 5, int(draw.integers(0, 4))):
            x = bits[-1] if draw.random() < 0.5 else bits[i]
            for b in draw.choice(64, int(flips), replace=False):
                x ^= int(np.uint64(1 << int(b)).astype(np.int64))
            bits.append(x)
    for _ in range(n):
        x = bits[0]
        for b in draw.choice(24, 4, replace=False):
            x ^= int(np.uint64(1 << int(b)).astype(np.int64))
        bits.append(x)
    return sorted(set(bits))


def test_block_links_equal_brute_force():
    for seed in range(3):
        bits = np.array(near_bits(300, seed), np.int64)
        a, b = pivot_tables.block_links(bits)
        found = dict(zip(a.tolist(), b.tolist()))
        assert [found.get(x, x) for x in bits.tolist()] == [int(bits[i]) for i in brute_labels(bits)]


@pytest.mark.parametrize("cell_rows", [4096, 200, 40])
def test_cells_lose_no_link(spark, cell_rows):
    bits = near_bits(400, 9)
    links = pivot_tables.links(spark.createDataFrame([(b,) for b in bits], "bits long"), cell_rows)
    found = {r.node: r.label for r in components(links).collect()}
    assert [found.get(b, b) for b in bits] == [bits[i] for i in brute_labels(bits)]


def test_near_duplicates_of_texts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_tables, "PIECE", 50)
    draw = random.Random(5)
    rows = [(90, None), (80, ""), (70, " \n "), (60, "one"), (50, "One  two"), (40, "one two"), (None, "one two"), (40, "else where")]
    for i in range(60):
        own = [f"w{draw.randrange(50)}" for _ in range(draw.randint(3, 80))]
        rows.append((100 + 3 * i, " ".join(own)))
        rows.append((101 + 3 * i, "\t".join(own[:-1]).upper()))
        rows.append((102 + 3 * i, " ".join([*own, "more"])))
    bits = [brute_bits(t) for _, t in rows]
    some = [(i, b) for (i, _), b in zip(rows, bits) if i is not None]
    labels = brute_labels([int(np.uint64(b).astype(np.int64)) for _, b in some])
    smallest = {}
    for (i, _), label in zip(some, labels):
        smallest[label] = min(smallest.get(label, i), i)
    expected = sorted((i, f"{b:016x}", smallest[label]) for (i, b), label in zip(some, labels))
    found = [r for r in pivot_tables.near_duplicates(table_of(spark, rows)).collect()]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found if r.doc_id is not None) == expected
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)]
    assert pivot_tables.near_duplicates(table_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("local_links", [1 << 20, 60])
def test_components_equal_brute_force(spark, local_links):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(140)] + [(1000, 1000 + i) for i in range(1, 60)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), local_links).collect()}
    assert all(found.get(x, x) == root(x) for x in list(label))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_runs_of_texts_align_as_whole_texts(monkeypatch):
    """Segments of many texts are found at once: wide white space, NULs, long segments, marks after letters, full stores."""
    draw, letters = random.Random(5), "aB 'é\n\t.,;:!?  　\x85\x1c\x00ß漢x1"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 30))) for _ in range(600)]
    texts += [".", " .", "a.", "x" * 40 + ".", "a" * 14 + ". " + "a" * 15 + " " + "a" * 16, "\n", "a▁b"]
    aligner, whole = tokenizer_spans.Aligner(PATH_A, PATH_B), []
    for n_a, n_b, groups, links, good in aligner.fresh([" " + t for t in texts]):
        whole.append((n_a, n_b, len(links), hashlib.sha256(groups.encode()).hexdigest() if good else "", sorted(links)))
    monkeypatch.setattr(tokenizer_spans, "KEPT", 100)
    for size in (len(texts), 50, 1):
        found = [r for at in range(0, len(texts), size) for r in aligner.aligned(texts[at : at + size])]
        assert [(*r[:4], [p for p, n in zip(r[4], r[5]) for _ in range(n)]) for r in found] == whole
    # A common word with marks of its own is aligned once, not once a mark.
    aligner = tokenizer_spans.Aligner(PATH_A, PATH_B)
    aligner.aligned([" ".join(w + m for w in ("house", "tree", "river") for m in tokenizer_spans.MARKS)])
    assert aligner.units.n <= 4 + len(tokenizer_spans.MARKS)

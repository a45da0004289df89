"""Nulls, empty and odd texts, repeated rows, clashing columns and empty tables, for all operators."""

import hashlib
import random
import re
import zlib
from array import array

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from secondlook.llm import (
    byte_bpe, chosen_path, harmonic_packing, language, log_bilinear, max_score, order_min_hash, skip_chain, toxicity,
    url_filter,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion near the old mill"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, LINE, "en", "a", 9),
        (4, LINE, "en", "a", 9), (5, LINE, "en", "b", 9), (6, "word", None, "b", 4), (7, "x" * 30_000, "en", "b", 9),
        (8, "日本語 テキスト é ñ 🙂", "ja", "c", 9), (None, LINE + " no id", "en", "c", 9), (9, "12 34 ## --", "en", "c", 9),
        (10, "<|endoftext|> it's   spaced  out  ", "en", "c", 9),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_texts(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{path}/documents.parquet")
    rows = [(i, i % 2, int(i == 4)) for i in range(1, 11)] + [(4, None, None), (None, 1, 1)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_max_score_takes_no_unusable_vectors_and_breaks_ties_by_id(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None), (4, [0.1, None]), (5, [nan, 0.0]), (6, [inf, 0.0]),
        (7, [-0.5, 0.1]), (8, []), (9, [0.3]), (0, [0.5, 0.25]), (None, [1.0, 1.0]), (50, [-0.001, -0.2]),
    ]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = max_score.integer_vectors(given)
    found = max_score.top_k(vectors, vectors.filter("id % 50 = 0"), k=5, shard_rows=2, block_rows=1)
    whole = {r.id: r.vector for r in vectors.collect()}
    expected = []
    for q in (0, 50):
        dot = {i: sum(a * b for a, b in zip(whole[q], v)) for i, v in whole.items() if i != q}
        for rank, i in enumerate(sorted(dot, key=lambda i: (-dot[i], i))[:5], 1):
            expected.append((q, rank, i, dot[i]))
    assert sorted(map(tuple, found.collect())) == expected
    assert max_score.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_max_score_equals_brute_force_on_random_vectors(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    x = draw.normal(0, 0.2, (600, 16)).round(3)
    x[300:350] = x[300]  # many equal vectors
    given = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    vectors = max_score.integer_vectors(given)
    found = max_score.top_k(vectors, vectors.filter("id % 50 = 0"), shard_rows=100, block_rows=4).collect()
    ints = np.floor(256 * x).astype(int)
    for q in range(0, 600, 50):
        dot = ints @ ints[q]
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-dot[i], i))[:5]
        assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == [(i, dot[i]) for i in best]


def best_by_brute_force(whole, asked, k=5):
    """(query_id, rank, vec_id, score) in Python's own integers, of unbounded size."""
    expected = []
    for q in asked:
        dot = {i: sum(a * b for a, b in zip(whole[q], v)) for i, v in whole.items() if i != q}
        best = sorted(dot, key=lambda i: (-dot[i], i))[:k]
        expected += [(q, rank, i, dot[i]) for rank, i in enumerate(best, 1)]
    return expected


def test_max_score_hands_every_vector_to_a_task_once(spark, monkeypatch, tmp_path):
    """Before, each block of queries came with a copy of its shard: at 600,000 vectors, gigabytes in one batch."""
    import numpy as np

    frame = type(spark.range(0))
    seen, plain = str(tmp_path / "seen"), frame.mapInArrow

    def watched(self, work, schema, *more):
        def noting(batches):
            def noted():
                for batch in batches:
                    with open(seen, "a") as out:
                        out.write(f"{batch.nbytes}\n")
                    yield batch

            return work(noted())

        return plain(self, noting, schema, *more)

    x = np.random.default_rng(2).normal(0, 0.2, (600, 16)).round(3)
    given = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    vectors = max_score.integer_vectors(given)
    monkeypatch.setattr(frame, "mapInArrow", watched)
    found = max_score.top_k(vectors, vectors.filter("id % 50 = 0"), shard_rows=100, block_rows=1).collect()
    whole = dict(enumerate(np.floor(256 * x).astype(int).tolist()))
    assert sorted(map(tuple, found)) == best_by_brute_force(whole, range(0, 600, 50))
    assert sum(map(int, open(seen))) < 2 * 600 * 16 * 8


@pytest.mark.parametrize("scale", [1, 1 << 9, 1 << 20])
def test_max_score_over_shards_of_one_cell_and_in_all_integers(spark, monkeypatch, scale):
    """Scores rise with the id, many vectors are equal, some components are large; queries come in parts."""
    monkeypatch.setattr(max_score, "CELLS", 2)
    monkeypatch.setattr(max_score, "HELD", 8 * 5)
    draw = random.Random(3)
    whole = {i: [draw.randint(-90, 90) * (1 + i // 40) for _ in range(8)] for i in range(300)}
    whole |= {i: whole[100] for i in range(150, 230)} | {i: [0] * 8 for i in range(235, 240)} | {250: [], 260: [-7], 270: [5] * 20}
    whole = {i - 5: [scale * x for x in v] for i, v in whole.items()}
    vectors = spark.createDataFrame(list(whole.items()), "id long, vector array<long>")
    asked = [i for i in whole if i % 20 == 0] + [max(whole), 245, 255]
    queries = vectors.filter(F.col("id").isin(asked))
    for rows, k in ((16, 5), (1, 3), (7, 400)):
        found = max_score.top_k(vectors, queries, k, shard_rows=rows, block_rows=4)
        assert sorted(map(tuple, found.collect())) == sorted(best_by_brute_force(whole, sorted(asked), k))


def test_toxicity_of_odd_texts_and_without_labels(spark, folder, odd, none):
    found = {(r.doc_id, r.score, r.predicted) for r in toxicity.op2_toxicity(spark, folder).collect()}
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, s, p in found)
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, no_labels)
    scored = toxicity.with_toxicity(odd.withColumn("toxicity", F.lit("old")), model)
    assert {r.toxicity for r in scored.collect()} == {0.0}
    assert toxicity.with_toxicity(none, model).count() == 0


def test_toxicity_learns_words_and_leaves_clean_texts_alone(spark):
    words = LINE.split()
    rows = [(i, " ".join(words[(i * k) % 19] for k in range(1, 12)) + (" dreadful" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.with_toxicity(docs, model).withColumn("held", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"))
    for r in found.filter("held").collect():
        assert (r.toxicity >= 0.3) == (r.doc_id % 4 == 0)


def test_language_cases_and_spans(spark, odd, none):
    french = "les maisons de la ville sont près du fleuve où passent les bateaux"
    rows = [(i, LINE if i % 2 else french, "en" if i % 2 else "fr") for i in range(60)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("en", "fr")
    mixed = f"{LINE}. {french}."
    given = odd.unionByName(spark.createDataFrame([(99, mixed, "en", "x", 1)], DOCS)).withColumn("language", F.lit(1))
    found = {r.doc_id: r.language for r in language.with_language(given, model).collect()}
    assert all(found[i].lang == "und" and found[i].score == 0 and found[i].spans == [] for i in (1, 2, 3, 9))
    assert found[4].lang == "en" and found[4].score == 1
    spans = [(mixed[s.start : s.stop], s.lang) for s in found[99].spans]
    assert [n for _, n in spans] == ["en", "fr"] and spans[0][0].startswith("the quick") and spans[1][0].endswith("bateaux")
    empty = language.train(none)
    assert {r.language.lang for r in language.with_language(odd, empty).collect()} == {"und"}
    assert language.with_language(none, model).count() == 0


def test_viterbi_equals_brute_force():
    import itertools

    import numpy as np

    draw = np.random.default_rng(2)
    scores, first = draw.normal(0, 12, (11, 3)), np.array([0, 5, 5, 11])
    path = language.best_paths(scores, first)
    for a, z in ((0, 5), (5, 11)):
        value = lambda p: sum(scores[a + i, l] for i, l in enumerate(p)) - language.SWITCH_PENALTY * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731, E741
        best = max(itertools.product(range(3), repeat=z - a), key=value)
        assert tuple(path[a:z]) == best


def shingles(text, size):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute_components(rows, size):
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, s in sets:
            for j, t in sets:
                if s and t and 100 * len(s & t) >= 80 * len(s | t) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_near_duplicates_equal_brute_force(spark, odd, none):
    import random

    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(r[0], r[1]) for r in odd_texts()]
    for group in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(20, 90))]
        for copy in range(6):
            own = list(base)
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            rows.append((100 + 10 * group + copy, " ".join(own).upper() if copy == 1 else " ".join(own)))
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("mine"))
    found = chosen_path.near_duplicates(given, size=4).collect()
    expected = brute_components(rows, 4)
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert {r.doc_id: r.n_shingles for r in found}[6] == 1
    assert chosen_path.near_duplicates(none).count() == 0


def test_large_nodes_are_compared_and_branch_further(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "NODE_ROWS", 4)
    monkeypatch.setattr(chosen_path, "RUN_ROWS", 4)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]
    found = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in found.collect()} == {0}


def test_packing_covers_every_id_once(spark, odd, none):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    long_text = " ".join(f"{LINE} {i}" for i in range(900))
    given = odd.unionByName(spark.createDataFrame([(77, long_text, "en", "z", 1)], DOCS)).withColumn("start", F.lit("x"))
    rows = harmonic_packing.pack(given, WORD_BPE).collect()
    texts = {i: (t or "") for i, t, *_ in [*odd_texts(), (77, long_text)]}
    for doc_id in (1, 2, 3, 5, 7, 8, 10, 77):
        ids = tokenizer.encode(texts[doc_id], add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start):
            part = array("I", ids[at : at + r.length]).tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.doc_id == 4 and r.start == 0 for r in rows) == 2
    assert harmonic_packing.pack(none, WORD_BPE).count() == 0


def test_cuts_waste_little():
    for length in range(1, 13_000, 7):
        pieces = harmonic_packing.cuts(length)
        assert sum(pieces) == length and max(pieces) <= 4096
        waste = sum(4096 / (4096 // p) - p for p in pieces)
        assert waste <= 9 + 0.011 * length + len(pieces)


URLS = [
    (1, "HTTP://A.NET/x"), (2, "http://net"), (3, "https://www.Example.Net/en/1"), (4, "http://example.net/fr"),
    (5, "http://b.example.com/de/2?x=/y#z"), (6, "http://example.org/fr/"), (7, None), (8, "no scheme/net/"),
    (9, "http://mynet/en/"), (10, "ftp://q.org?x=http://a.net/"), (11, ""), (12, "http://c.example.com/en/5"), (12, "://"),
]


def test_url_rules_and_method(spark):
    given = spark.createDataFrame(URLS, "page_id long, url string").withColumn("verdict", F.lit(7)).withColumn("_x", F.lit(1))
    found = {(r.page_id, r.url): r for r in url_filter.filter_urls(given, url_filter.train(given)).collect()}
    rules = {i: r.rule for (i, _), r in found.items()}
    assert [rules[i] for i in range(1, 12)] == [
        "net/", None, "example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None,
    ]
    assert (found[10, URLS[9][1]].host, found[10, URLS[9][1]].path) == ("q.org", "")
    assert (found[8, "no scheme/net/"].host, found[7, None].path) == ("", "")
    assert found[3, URLS[2][1]].verdict == "allow" and found[5, URLS[4][1]].verdict == "block"
    assert {r.verdict for r in found.values()} <= {"allow", "block"}
    empty = given.limit(0)
    assert url_filter.filter_urls(empty, url_filter.train(empty)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(given.filter("page_id = 9"), url_filter.train(empty)).collect()} == {"allow"}


def test_url_rules_match_a_plain_loop(spark):
    """Rules over hosts and paths put together at random, against a loop over all rules."""
    draw = random.Random(5)
    labels, paths = ["net", "example", "com", "org", "my", "a", ""], ["", "/", "/de", "/de/", "/fr/x", "/en/1", "/EN/", "/de/?q#f"]
    urls = {
        draw.choice(["http://", "HTTPS://", "://", "//", ""]) + ".".join(draw.choices(labels, k=draw.randint(1, 4))).title()
        + draw.choice(paths) + draw.choice(["", "?u=://net/", "#://example.com/de/"])
        for _ in range(1500)
    }

    def expected(url):
        host = path = ""
        if "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0]
            path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
            host = host.lower()
        best = None
        for rule, verdict in url_filter.RULES:
            of_host, _, of_path = rule.partition("/")
            if (host == of_host or host.endswith("." + of_host)) and path.startswith("/" + of_path):
                best = max(best or ("", ""), (rule, verdict), key=lambda r: len(r[0]))
        return host, path, *(best or (None, None))

    pages = spark.createDataFrame([(u,) for u in sorted(urls)], "url string")
    for r in url_filter.filter_urls(pages, url_filter.train(pages)).collect():
        host, path, rule, verdict = expected(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (rule is None or r.verdict == verdict)


def test_url_filter_passes_clashing_columns_through(spark):
    clashing = ("_last", "_two", "_key", "_row", "_margin", "_salt", "_n_salts", "n_rows", "key", "label", "pair", "_KEY2", "of_two")
    plain = spark.createDataFrame(URLS, "page_id long, url string")
    pages = plain.withColumns({c: F.lit(f"own {c}") for c in clashing})
    model = url_filter.train(pages)
    found = url_filter.filter_urls(pages, model)
    assert found.columns == ["page_id", "url", *clashing, "host", "path", "rule", "verdict"]
    rows = found.collect()
    assert len(rows) == len(URLS) and all(r[c] == f"own {c}" for r in rows for c in clashing)
    wanted = url_filter.filter_urls(plain, model).collect()
    judged = lambda r: (r.page_id, r.url, r.host, r.path, r.rule, r.verdict)
    assert sorted(map(str, map(judged, rows))) == sorted(map(str, map(judged, wanted)))


def test_trees_learn_lexical_features(spark):
    rows = [(i, f"http://s{i % 7}.example.com/{'de' if i % 2 else 'en'}/{'9' * (12 * (i % 2))}{i}") for i in range(200)]
    rows += [(1000 + i, f"http://t{i}.example.net/en/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    model = url_filter.train(pages)
    margins = url_filter.with_block_margin(pages, model).collect()
    assert all((r.margin > 0) == ("/de/" in r.url) for r in margins if "/de/" in r.url or "example.net" in r.url)


def test_every_suffix_keeps_its_share(spark):
    """More suffixes than the 4096 that a capped dictionary held, each with its own share in training and scoring."""
    rules = (("org/aa/", "allow"), ("org/bb/", "block"))
    rows = [(i, f"https://d{i % 5000:04}.org/{'bb' if i % 2 else 'aa'}/") for i in range(10_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    model = url_filter.train(pages, rules=rules)
    asked = spark.createDataFrame([(i, f"https://d{i:04}.org/cc/") for i in range(5000)] + [(9999, "http://new.com/")], "id long, url string")
    found = {r.id: (r._last, r._two) for r in url_filter.with_shares(asked, model.shares, "url").collect()}
    assert len(found) == 5001 and found[9999] == (0.5, 0.5)
    for i in range(5000):
        own = (2 * (i % 2) + 10) / 22
        assert abs(found[i][0] - 0.5) < 1e-9 and abs(found[i][1] - own) < 1e-9
    margins = url_filter.with_block_margin(asked.filter("id < 5000"), model).collect()
    assert all((r.margin > 0) == (r.id % 2 == 1) for r in margins)


def test_copies_of_a_url_do_not_fill_the_sample(spark):
    rules = (("org/good/", "allow"), ("org/bad/", "block"))
    rows = [f"https://a{i}.org/{'bad' if i % 2 else 'good'}/" for i in range(40)]
    order = spark.createDataFrame([(u,) for u in rows], "url string").orderBy(F.xxhash64("url"))
    first = order.first().url
    pages = spark.createDataFrame([(u,) for u in rows + [first] * 200], "url string")
    model = url_filter.train(pages, rules=rules, sample=40)
    assert model.nodes
    margins = url_filter.with_block_margin(pages, model).collect()
    assert len(margins) == 240 and all((r.margin > 0) == ("/bad/" in r.url) for r in margins)


def test_fingerprints_of_odd_texts_match_python(spark, odd, none):
    rows = order_min_hash.fingerprints(odd.withColumn("sign", F.lit("x")).withColumn("edit", F.lit(1))).collect()
    texts = [(i, t or "") for i, t, *_ in odd_texts()]
    ordered = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = []
    for n, (i, t) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)][1]
        half = len(t) // 2
        expected.append((i or -1, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in rows) == sorted(expected)
    by_text = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(dict(texts).get(r.doc_id), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == {""}
    assert {r.near_next for r in rows if r.doc_id == 5} == {1.0}  # the next document is its copy
    assert order_min_hash.fingerprints(none).count() == 0


def test_signature_does_not_depend_on_the_first_pass(spark, monkeypatch):
    words = [f"w{(i * i) % 997}" for i in range(3000)]
    repeated = " ".join(["same line of words again"] * 700)
    given = spark.createDataFrame([(1, " ".join(words)), (2, repeated), (3, " ".join(words[:1500]) + repeated)], "i int, text string")
    quick = given.select("i", order_min_hash.signature(F.col("text")).alias("s")).collect()
    monkeypatch.setattr(order_min_hash, "CANDIDATES", 1 << 20)
    whole = given.select("i", order_min_hash.signature(F.col("text")).alias("s")).collect()
    assert sorted(quick) == sorted(whole)


def test_ranges_link_neighbours_across_their_edges(spark, monkeypatch):
    monkeypatch.setattr(order_min_hash, "RANGE_ROWS", 7)
    rows = [(i * i, f"t{i}") for i in range(100)]
    found = order_min_hash.with_next(spark.createDataFrame(rows, "k long, text string"), "k", ["text"]).collect()
    ordered = sorted(rows, reverse=True)
    assert {(r.text, r.next_text) for r in found} == {(ordered[i][1], ordered[(i + 1) % 100][1]) for i in range(100)}


def test_bpe_equals_the_library_and_decodes(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={}
    )
    for r in byte_bpe.with_digests(odd, path, public_tokenizers.PATTERN).collect():
        ids = library.encode_ordinary(r.text or "")
        assert r.digests.n_tokens == len(ids)
        assert r.digests.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.digests.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    there = byte_bpe.with_ids(odd.withColumn("ids", F.lit(0)), path, public_tokenizers.PATTERN)
    back = byte_bpe.with_text(there, path, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert byte_bpe.with_digests(none, path, public_tokenizers.PATTERN).count() == 0


def test_lm_counts_equal_brute_force(spark, folder):
    import math
    from collections import Counter

    def tokens(t):
        lower = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]

    learned = Counter()
    for i, t, *_ in odd_texts():
        if i is None or zlib.crc32(str(i).encode()) % 10:
            learned.update(tokens(t))
    total, distinct = sum(learned.values()), len(learned)
    rows = log_bilinear.op3_log_bilinear(spark, folder).collect()
    assert len(rows) == len(odd_texts())
    texts = {i: t for i, t, *_ in odd_texts()}
    for r in rows:
        own = tokens(texts[r.doc_id])
        base = sum(math.log10((learned[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(learned[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_lm_learns_from_every_position():
    import numpy as np
    import pyarrow as pa

    nothing = np.zeros(0, np.int64)
    known = log_bilinear.Vocabulary(0, 0, nothing, nothing, nothing, np.zeros(log_bilinear.TOTAL), np.zeros(log_bilinear.TOTAL))
    found = log_bilinear._examples([LINE.encode(), b"", f"{LINE} {LINE}".encode()], known)
    assert found.shape == (3 * len(LINE.split()) + 3, 3)
    texts = pa.RecordBatch.from_arrays([pa.array([LINE, None, LINE + " " + LINE])], ["text"])
    start = log_bilinear.Parameters(known).rows()
    learned = list(log_bilinear._learned(iter([texts]), start, known, 0))
    assert learned[0].column("seen")[0].as_py() == len(found)


def test_lm_looks_up_symbols_and_sums_gradients_in_layers():
    import numpy as np

    draw = np.random.default_rng(0)
    for n in (0, 1, 3, 40, 5_000):
        common = np.sort(draw.integers(-(2**63), 2**63 - 1, n))
        symbols = np.where(draw.random(n) < 0.5, draw.integers(0, log_bilinear.SYMBOLS, n), -1)
        zeros = np.zeros(log_bilinear.TOTAL)
        known = log_bilinear.Vocabulary(9, n, common, np.arange(n) + 1, symbols, zeros, zeros)
        hashes = np.concatenate([common, common + 1, draw.integers(-(2**63), 2**63 - 1, 50), [2**63 - 1, -(2**63)]])
        found = log_bilinear.Tokens(hashes, np.full(len(hashes), log_bilinear.SYMBOLS), np.array([0, len(hashes)]), None)
        place = {t: i for i, t in enumerate(common.tolist())}
        for vocabulary in (known, known.of_symbols()):
            own = [*symbols.tolist(), -1]
            at = [place.get(t, -1) for t in hashes.tolist()]
            at = [i if vocabulary is known or own[i] >= 0 else -1 for i in at]
            symbol, count = log_bilinear.looked_up(found, vocabulary)
            assert symbol.tolist() == [own[i] if own[i] >= 0 else log_bilinear.SYMBOLS for i in at]
            assert count.tolist() == [i + 1 if i >= 0 else -1 for i in at]
    for shape, top in (((70, 300), 90), ((1, 65), 2_000), ((3, 1_600), 1)):
        met = draw.integers(0, top, shape).astype(np.int16)
        rows = draw.normal(size=(shape[1], log_bilinear.DIMENSIONS)).astype(np.float32)
        for numbers, own, *plan in zip(met, *log_bilinear.layers(met), strict=True):
            wanted = np.zeros((top, log_bilinear.DIMENSIONS))
            np.add.at(wanted, numbers, rows)
            assert sorted(own) == np.unique(numbers).tolist()
            assert len(plan[1]) <= log_bilinear.LAYERS
            assert np.allclose(log_bilinear.row_sums(rows, *plan, np.empty_like(rows)), wanted[own], atol=1e-3)


def test_lm_steps_are_those_of_the_plain_formula():
    import numpy as np

    draw = np.random.default_rng(1)
    total, size = log_bilinear.TOTAL, log_bilinear.BATCH
    nothing = np.zeros(0, np.int64)
    known = log_bilinear.Vocabulary(total, total, nothing, nothing, nothing, np.ones(total), np.ones(total))
    p, noise = log_bilinear.Parameters(known), np.full(total, 1 / total)
    columns = draw.integers(0, 50, (3, 2 * size + 7)).astype(np.int16)
    context, target, positions, bias = (x.astype(float) for x in (p.context, p.target, p.positions, p.bias))
    squares = {n: np.full(getattr(p, n).shape, 1e-2, np.float32) for n in p.NAMES}
    log_bilinear.learn(p, noise, columns, 3, squares, log_bilinear.Room())

    met = np.random.default_rng(3).random((3, 4 * log_bilinear.NOISE))
    sums = [np.full(x.shape, 1e-2) for x in (context, target, positions, bias)]
    for k, v in enumerate(np.minimum(np.searchsorted(np.cumsum(noise), met), total - 1)):
        w, one, two = columns[:, k * size : (k + 1) * size]
        q = context[one] * positions[0] + context[two] * positions[1]
        offset = bias - np.log(noise * log_bilinear.NOISE)
        good = 1 / (1 + np.exp((q * target[w]).sum(1) + offset[w]))
        bad = -1 / (1 + np.exp(-(q @ target[v].T + offset[v]))) / 4
        g_q = good[:, None] * target[w] + bad @ target[v]
        gradients = [np.zeros(x.shape) for x in sums]
        np.add.at(gradients[0], one, g_q * positions[0])
        np.add.at(gradients[0], two, g_q * positions[1])
        np.add.at(gradients[1], w, good[:, None] * q)
        np.add.at(gradients[1], v, bad.T @ q)
        gradients[2] = np.stack([(g_q * context[one]).sum(0), (g_q * context[two]).sum(0)])
        np.add.at(gradients[3], w, good)
        np.add.at(gradients[3], v, bad.sum(0))
        for x, s, g in zip((context, target, positions, bias), sums, gradients):
            s += (g / len(w)) ** 2
            x += log_bilinear.RATE * 0.1 * g / len(w) / np.sqrt(s)
    for learned, wanted in zip((p.context, p.target, p.positions, p.bias), (context, target, positions, bias)):
        assert np.allclose(learned, wanted, atol=1e-5)


def test_lm_is_normalised(spark, odd):
    import numpy as np

    counts = log_bilinear.token_counts(odd)
    known = log_bilinear.vocabulary(counts)
    lookup = log_bilinear.tables(log_bilinear.train(odd, known))
    sums = (10.0 ** (lookup.one[3] + lookup.two[7] - lookup.sums[3, 7])).sum()
    assert np.isclose(sums, 1, atol=1e-4)
    empty = log_bilinear.vocabulary(counts.limit(0))
    found = log_bilinear.scores(odd, empty, counts.limit(0), log_bilinear.train(odd.limit(0), empty))
    assert {r.n_known for r in found.collect()} == {0}


def test_personal_data_is_found_and_masked(spark, odd, none):
    text = "call +1 (523) 555-1055 or (523) 555-1055, 4111 1111 1111 1111, 10.0.0.256 9.9.9.9 joe.1@mail.example.com then joe.1"
    learn = spark.createDataFrame([(i, text.replace("523", str(500 + i)) + f" room {i}") for i in range(50)], "doc_id long, text string")
    model = skip_chain.train(learn)
    given = odd.unionByName(spark.createDataFrame([(50, text, "en", "x", 1)], DOCS)).withColumn("found", F.lit(0))
    rows = {r.doc_id: (r.text, r.found) for r in skip_chain.with_personal_data(given, model).collect()}
    found = rows[50][1]
    assert (found.n_email, found.n_ip, found.n_card, found.n_phone) == (1, 1, 1, 1)
    assert set(found.base.split(",")) < set(found.spans.split(","))
    assert "555" not in found.masked and "joe" not in found.masked and "[PHONE] or [PHONE]" in found.masked
    assert rows[1][1].masked is None and rows[2][1].spans == "" and rows[4][1].masked == LINE
    empty = skip_chain.train(none)
    assert skip_chain.with_personal_data(given.filter("doc_id = 50"), empty).first().found.spans == found.base
    assert skip_chain.with_personal_data(none, empty).count() == 0


@pytest.fixture(scope="module")
def phones_and_addresses(spark):
    rows = [(i, f"call +1 ({500 + i}) 555-10{i} in room {i} or 2.{i}, joe{i}@x.com or 1.2.3.{i}") for i in range(10, 60)]
    return skip_chain.train(spark.createDataFrame(rows, "doc_id long, text string"))


def test_the_field_runs_without_base_spans_or_repeats(phones_and_addresses):
    def spans(text):
        return skip_chain.all_spans(text, skip_chain.base_spans(text), phones_and_addresses)

    number = "(523) 555-1055"
    for text in (f"call {number}", f"call {number} or {number}, room 12", f"{number} room 12 1.1.1.1"):
        assert number in {text[a:z] for a, z, k in spans(text) if k == 3}, text
    assert spans("room 12 or 2.13, room 12") == [] and spans("no numbers") == []
    assert [s[2] for s in spans("joe@x.com and then joe, not joey")] == [0, 0]
    for text in ("a1 b @c", "x" * 9 + "1", "é1x-2 ab c@ 12.a"):
        wanted = [m.span() for m in skip_chain._NAME(text) if "@" in m[0] or re.search("[0-9]", m[0])]
        assert [m.span() for m in skip_chain._MARKED(text)] == wanted


def test_evidence_reaches_all_of_many_repeats():
    import numpy as np

    # By its shape a bare number is none (2.5 against 1); a like phone adds 4 to phone.
    shapes = np.zeros((skip_chain.N_SHAPE, skip_chain.N_LABELS))
    shapes[0] = [0, 0, 0, 1, 2.5]
    model = skip_chain.FieldModel(shapes, np.array([0, 0, 0, 4.0, 0]))
    for n, before in ((60, 0), (60, 30), (60, 60), (400, 0)):
        copies = ["523 555 1055; "] * n
        text = "".join([*copies[:before], "+1 523 555 1055; ", *copies[before:]])
        found = skip_chain.all_spans(text, skip_chain.base_spans(text), model)
        assert [k for _, _, k in found] == [3] * (n + 1), (n, before)
    keys = ["a", "b", "a", "a", "a", "a"]
    assert skip_chain.links_of(keys) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert skip_chain.links_of(keys, [True] + [False] * 5) == [(0, 2), (0, 3), (0, 4), (0, 5), (2, 3), (3, 4), (4, 5)]


def test_messages_cross_a_long_chain():
    import numpy as np

    scores = np.zeros((80, 2))
    scores[0] = [0, -1e3]
    ways = np.array([w for i in range(79) for w in ((i, i + 1, 0), (i + 1, i, 0))])
    # On a chain of equal links the pull of the observed end is exactly ((e^w - 1) / (e^w + 1)) ** distance.
    exact = 0.5 + 0.5 * np.tanh(2.5) ** np.arange(80)
    assert np.allclose(skip_chain.marginals(scores, ways, np.array([[5.0, 5.0]]))[:, 0], exact, atol=1e-6)


def test_belief_propagation_is_exact_on_a_chain():
    import itertools

    import numpy as np

    draw = np.random.default_rng(0)
    scores, w = draw.normal(0, 1, (4, 3)), draw.random((2, 3))
    ways = [(0, 1, 0), (1, 0, 0), (1, 2, 1), (2, 1, 1), (2, 3, 0), (3, 2, 0)]
    total = np.zeros((4, 3))
    for labels in itertools.product(range(3), repeat=4):
        value = sum(scores[i, l] for i, l in enumerate(labels))  # noqa: E741
        value += sum(w[k, labels[a]] for a, b, k in ways[::2] if labels[a] == labels[b])
        for i, l in enumerate(labels):  # noqa: E741
            total[i, l] += np.exp(value)
    exact = total / total.sum(1, keepdims=True)
    assert np.allclose(skip_chain.marginals(scores, np.array(ways), w), exact, atol=0.02)


def test_pipeline_keeps_columns_and_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    ids = sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
    assert not {1, 2, 3, 5, 9} & set(ids) and len(ids) == len(set(ids))
    packed = corpus_pipeline.run(spark, folder)
    assert set(r.doc_id for r in packed.collect() if r.doc_id is not None) == set(ids)


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    other = "a wholly different text about rivers and hills that nobody else has written down here before today"
    near = LINE + " again and again until the evening comes at last"
    rows = [(3, LINE), (7, LINE), (7, other), (None, "no id"), (None, "no id"), (8, near), (8, near + " soon"), (9, "twin " + other[::-1]), (9, "twin " + other[::-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()))
    assert [i for i, _ in left] == [0, 0, 3, 7, 8, 9]
    assert (7, other) in left and (3, LINE) in left and left.count((0, "no id")) == 2
    own = docs.withColumns({"_id": F.lit("own"), "_text": F.col("text"), "_ID2": F.lit(2)})
    again = corpus_pipeline.near_dedup(spark, own, "")
    assert again.columns == own.columns
    assert sorted((r.doc_id or 0, r.text) for r in again.collect() if r["_id"] == "own" and r["_text"] == r.text) == left


@pytest.mark.parametrize("name", ["op1_max_score", "op5_chosen_path"])
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours, theirs = entry.queries()[name](spark, sf), con.sql(entry.oracle_sql()[name])
    assert sorted(map(tuple, ours.select(*theirs.columns).collect())) == sorted(theirs.fetchall())


def test_pairs_inside_a_crowd_are_found(spark, monkeypatch):
    """Texts that share half their words crowd the nodes; pairs at the threshold have no other link."""
    monkeypatch.setattr(chosen_path, "NODE_ROWS", 32)
    monkeypatch.setattr(chosen_path, "RUN_ROWS", 8)
    monkeypatch.setattr(chosen_path, "FIRST_CANDIDATES", 1)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(120):
        own = [f"w{i}_{k}" for k in range(120)]
        rows.append((2 * i, " ".join(common + own)))
        rows.append((2 * i + 1, " ".join(common + own[:98] + [f"x{i}_{k}" for k in range(22)])))
    found = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4)
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    sets = [{tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for _, t in rows]
    assert all(100 * len(a & b) >= 80 * len(a | b) for a, b in zip(sets[0::2], sets[1::2]))
    met = sum(got[2 * i + 1] == 2 * i for i in range(120))
    assert all(got[2 * i] == 2 * i for i in range(120)) and met >= 0.99 * 120


def test_packing_ids_equal_the_library_on_all_letters():
    """Letters that normalising takes apart, as in Turkish capitals and Bengali, keep their marks."""
    import random

    tokenizer, ours = Tokenizer.from_file(WORD_BPE), harmonic_packing.WordTokenizer(WORD_BPE)
    texts = ["BELEDİYESİ, 2020", "TAKSİ. yeni", "\u0995\u09df! a", "\u09dc, b", "\u0a5b; c", "Straße.", "ΣΑΣ. ς,", "don't, can't."]
    draw = random.Random(6)
    letters = [chr(c) for c in range(0x80, 0x20000) if chr(c).isalpha()]
    for _ in range(400):
        words = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 4))) + draw.choice(["", ".", ",", "!?", ";", "..."]) for _ in range(12)]
        texts.append(draw.choice([" ", "  "]).join(words))
    for text, ids in zip(texts, ours.encode(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_stores_of_words_forget_and_stay_right(monkeypatch):
    monkeypatch.setattr(harmonic_packing, "KEPT", 5)
    tokenizer, ours = Tokenizer.from_file(WORD_BPE), harmonic_packing.WordTokenizer(WORD_BPE)
    for text in (LINE, "", LINE + " again, and AGAIN.", "  ", "other words", LINE):
        assert ours.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_base_spans_equal_the_plain_patterns():
    import random

    patterns = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(re.sub("[^0-9]", "", m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]

    def luhn(d):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0

    draw = random.Random(7)
    texts = ["".join(draw.choice("0123456789.. -+()@ab") for _ in range(draw.randint(1, 60))) for _ in range(20_000)]
    texts += ["0" * 5000 + ".1.2.3", "1.2.3." + "0" * 4999 + "4", "4111 1111 1111 1111 and +1 (523) 555-1055"]
    for text in texts:
        plain = [(*m.span(), k) for k, (p, ok) in enumerate(patterns) for m in re.finditer(p, text) if ok(m[0])]
        assert skip_chain.base_spans(text) == sorted(plain, key=lambda s: (s[0], s[2])), text


def test_many_languages_and_a_long_text(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    alphabets = ["".join(chr(0x61 + c) for c in draw.permutation(26)[:7]) for _ in range(200)]
    say = lambda k, n: " ".join("".join(draw.choice(list(alphabets[k]), 6)) for _ in range(n))
    rows = [(i, say(i % 200, 60), f"l{i % 200:03}") for i in range(1200)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 200
    found = language.identify([say(k, 40) for k in range(200)] + [say(5, 20_000)], model, False)
    assert np.mean([f[0] == f"l{k:03}" for k, f in enumerate(found[:200])]) > 0.9 and found[200][0] == "l005"


def test_candidates_of_a_crowd_travel_once_a_node(spark, monkeypatch):
    """Texts at 0.75, whose estimates reach the least agreement: all pairs are tested, but none is a row of its own."""
    rows = [(i, " ".join([*(f"c{k}" for k in range(120)), *(f"w{i}_{k}" for k in range(20))])) for i in range(300)]
    rows.append((300, " ".join([*(f"c{k}" for k in range(120)), *(f"w7_{k}" for k in range(16))])))
    moved, stage = {}, chosen_path.stage

    def counted(df, name, **options):
        found = stage(df, name, **options)
        moved[name] = moved.get(name, 0) + found.count()
        return found

    monkeypatch.setattr(chosen_path, "stage", counted)
    monkeypatch.setattr(chosen_path, "RUN_SHINGLES", 30_000)  # two runs, three blocks
    found = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=1)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: 7 if i == 300 else i for i in range(301)}
    assert moved.get("pairs", 0) + moved.get("packets", 0) <= 3 * chosen_path.TREES * len(rows) < 300 * 299 / 2


def test_a_task_gives_freed_memory_back():
    """What a task has freed must not stay with the process, which lives on beside the next stages."""
    import pathlib

    from secondlook.llm.common import giving_back

    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", pathlib.Path("/proc/self/status").read_text())[1]) // 1024

    def task():
        parts, kept = [], []
        for i in range(200_000):
            parts.append(b"x" * 1000)
            if i % 1000 == 0:
                kept.append(bytearray(1000))  # lies between freed parts
        yield len(parts)
        del parts
        yield kept

    before, results = held(), list(giving_back(task()))
    assert results[0] == 200_000 and held() - before < 100


def test_units_of_texts_run_into_no_other(monkeypatch):
    """Cuts at line feeds, NULs, special tokens and the limit of short units; many texts at once and one by one."""
    import random

    tokenizer, ours = Tokenizer.from_file(WORD_BPE), harmonic_packing.WordTokenizer(WORD_BPE)
    draw, letters = random.Random(3), "aB<|>endoftext \n\t.,;'é́İΣ\x00\x85　83dD!?*#$%&"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(2000)]
    texts += ["<|endoftext|>.", "a<|startoftext|>,", "A" * 20 + ".,", "x" * 15 + " " + "x" * 16 + "\n" + "x" * 17, "\n", "", ".", "a\x00 a"]
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in ours.encode(texts)] == expected
    assert [ours.encode([t])[0].tolist() for t in texts] == expected
    # Words that line feeds join are no words of their own: 900 pairs of 30 words are 30 units.
    some = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(30)]
    ours = harmonic_packing.WordTokenizer(WORD_BPE)
    ours.encode([f"{x}\n{y}" for x in some for y in some])
    assert ours.units.n == len(set(some))

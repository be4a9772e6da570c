"""The operators on small tables with nulls, empty and long texts, ties, repeated rows, extra columns and no rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from metasieve.llm import ngram_join, shared
from metasieve.llm.components import connected_components
from metasieve.llm.language import fit_language_model, identify_languages, learn_languages
from metasieve.llm.line_dedup import dedup_lines
from metasieve.llm.media import encode_media, media_digests, media_features, payload_of
from metasieve.llm.mixing import mix_sources, rake
from metasieve.llm.ngram_join import jaccard_components
from metasieve.llm.packing import pack
from metasieve.llm.quality import Vectors, fit_quality_model, learn_quality, score_quality, score_texts
from metasieve.llm.queries import URL_RULES, vocabulary
from metasieve.llm.token_counts import count_tokens, read_cache
from metasieve.llm.url_reputation import Reputation, host_reputation, judge_urls, suffix_and_domain
from metasieve.llm.vector_join import near_vectors

from .test_units import plain_shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, score int, cls int, topic string"


def awkward(long_words=6000):
    """Rows of every awkward kind; the last four columns clash with names that operators use."""
    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice(("the", "of", "und", "der", "les", "abc,", "Zz!", "x")) + str(rng.randint(0, 9)) for _ in range(n))
    base = words(60)
    texts = [None, "", " \n\t ", "one", "two words", base, base, base + " more", base.replace("the", "la", 1), words(long_words), "\n".join(words(6) for _ in range(9))]
    texts += ["\n".join((texts[-1].split("\n") * 2)[2:8]), "日本語 テキスト", "a|b|c | d", "All rights reserved.", "\x00\x0b\x1c", "x" * 5000]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s0", None, "s1")[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[0], (None, base, None, None, 1), (None, None, "en", "s0", None), (3, "another text with the id three", "en", "s0", 5)]
    return [(*r, "d", 1, 2, "t") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7), (None, 3)]
    parent = list(range(3000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_counts(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path, cache = vocabulary("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    library = Tokenizer.from_file(path)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in count_tokens(docs, path, cache).collect())
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in awkward())
    assert got == want
    distinct = len({r[1] or "" for r in awkward()})
    assert read_cache(spark, cache).count() <= distinct + 2
    before = read_cache(spark, cache).count()
    assert count_tokens(docs, path, cache).count() == len(want) and read_cache(spark, cache).count() == before
    other = count_tokens(docs.limit(3), vocabulary("piece_bpe_32k.model"), cache)
    assert other.count() == 3 and read_cache(spark, cache).count() > before
    assert count_tokens(none, path).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = pack(docs, vocabulary("word_bpe_49k.json"), capacity=256).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 256
    want = sorted(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in awkward() if r[0] == 9)
    assert sum(p.length for p in pieces[9]) == want[0]
    joined = b"".join(bytes(p.ids) for p in sorted(pieces[9], key=lambda p: p.start))
    assert np.frombuffer(joined, "<u4").tolist() == [*library.encode(awkward()[9][1], add_special_tokens=False).ids, 2]
    assert sum(r.length for r in rows) == sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in awkward())
    assert pack(none, vocabulary("word_bpe_49k.json")).count() == 0


def test_language(docs, none):
    model = learn_languages(docs, F.lit(True))
    out, names = identify_languages(docs, model)
    assert out.columns[: len(docs.columns)] == docs.columns and names["score"] == "_score"
    rows = out.collect()
    assert len(rows) == len(awkward()) and sorted(str(r.text) for r in rows) == sorted(str(r[1]) for r in awkward())
    for r in rows:
        assert 0 <= r["_score"] <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    empty, _ = identify_languages(none, learn_languages(none, F.lit(True)))
    assert empty.count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(5, 1), (7, 1), (9, 0), (9, 1), (13, 0), (None, 1), (99, 0), (8, None)], "doc_id long, quality int")
    got = score_quality(docs, learn_quality(docs, labels, F.lit(True))).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    model = learn_quality(none, labels.limit(0), F.lit(True))
    assert {r.score for r in score_quality(docs, model).collect()} == {0.5}
    assert score_quality(none, model).count() == 0


def test_quality_of_labels_without_documents(spark, docs):
    labels = spark.createDataFrame([(-5, 1), (-7, 0)], "doc_id long, quality int")
    model = learn_quality(docs, labels, F.lit(True))
    assert {(r.score, r.nearest) for r in score_quality(docs, model).collect()} == {(0.5, 0.0)}


def plain_components(rows):
    sets = [plain_shingles(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = group[i], group[j]
            group = [x if g == y else g for g in group]
    least = {}
    for (k, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (least.get(g), k) if x is not None), default=None)
    return sorted((str(k), len(s), str(least[g])) for (k, _), s, g in zip(rows, sets, group, strict=True))


def near_copies():
    """Chains, stars, copies, hub tokens and unrelated documents."""
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ijklmnop") + str(rng.randint(0, 60))
    rows = []
    for size in (30, 12, 6, 4):
        text = [word() for _ in range(40)]
        for _ in range(size):
            rows.append(" ".join(text))
            if rng.random() < 0.7:
                text = list(text)
                text[rng.randrange(40)] = word()
    common = [word() for _ in range(30)]
    rows += [" ".join(common + [word() for _ in range(rng.randint(1, 12))]) for _ in range(40)]
    rows += [" ".join(word() for _ in range(rng.randint(0, 9))) for _ in range(30)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_jaccard(spark, docs, none):
    rows = near_copies()
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == plain_components(rows)
    rows = [r[:2] for r in awkward(300)]
    got = jaccard_components(spark.createDataFrame(awkward(300), SCHEMA))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == plain_components(rows)
    assert jaccard_components(none).count() == 0


def test_one_large_group_of_near_copies(spark, tmp_path_factory):
    """2,000 near copies of one text, 300 exact ones, many alike but not linked: the joins' rows stay in proportion."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(220)]
    rows = []
    for _ in range(2000):
        text = list(base)
        for _ in range(rng.choice((1, 1, 2, 3, 4, 6))):
            text[rng.randrange(220)] = f"z{rng.randrange(10**9)}"
        rows.append(" ".join(text))
    rows += [" ".join(base)] * 300 + [" ".join(base[:100] + [f"q{rng.randrange(10**9)}" for _ in range(120)]) for _ in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)
    counted = []
    plain = ngram_join._pairs
    ngram_join._pairs = lambda joined, percent, tried: counted.append(plain(joined, percent, []).count()) or plain(joined, percent, tried)
    try:
        got = {r.doc_id: r.component_id for r in jaccard_components(df).collect()}
    finally:
        ngram_join._pairs = plain
    assert sum(counted) < 40 * len(rows) and len(counted) >= 2
    # against all pairs, by a matrix of n-grams
    sets = [plain_shingles(t) for t in rows]
    number = {g: i for i, g in enumerate(sorted({g for s in sets for g in s}))}
    ends = np.cumsum([0, *map(len, sets)])
    there = sparse_rows(sets, number)
    sizes = np.diff(ends)
    group = np.arange(len(rows))
    links = []
    for i in range(len(rows)):
        common = there(i)
        links.append(np.flatnonzero((sizes > 0) & (100 * common >= 80 * (sizes + sizes[i] - common))))
    changed = True
    while changed:
        low = np.array([group[x].min() if len(x) else group[i] for i, x in enumerate(links)])
        changed = bool((low != group).any())
        group = low
    assert [got[i] for i in range(len(rows))] == group.tolist()


def sparse_rows(sets, number):
    """A function from a set's place to the sizes of its intersections with all sets."""
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[number[g]].append(i)
    holders = {g: np.array(v) for g, v in holders.items()}

    def common(i):
        out = np.zeros(len(sets), np.int64)
        for g in sets[i]:
            out[holders[number[g]]] += 1
        return out

    return common


def test_jaccard_without_broadcasts_and_with_repeated_rows(spark, monkeypatch):
    """Null and repeated ids with different and with equal texts; sets and texts by shuffles; several rounds of hubs."""
    monkeypatch.setattr(shared, "MOST_BROADCAST", 0)
    monkeypatch.setattr(ngram_join, "_PAIRS_AN_ENTRY", 0)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t) for k, t in near_copies()]
    rows += rows[:12]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == plain_components(rows)


def test_samples_are_bounded(spark):
    """One id fills a third of the rows, with one text or with many; others are null."""
    rows = [(1, f"same id text{i} alpha", "en") for i in range(400)] + [(2, "same text", "de")] * 400 + [(None, "no id here", "fr")] * 200 + [(i, f"t{i} beta gamma", "de") for i in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    keyed = docs.filter("doc_id IS NOT NULL")
    assert shared.bounded_rows(keyed, 50, "doc_id", "text").count() == 50
    assert shared.bounded_rows(keyed, 5000, "doc_id", "text").distinct().count() == 591 == shared.bounded_rows(keyed, 5000, "doc_id", "text").count()
    model = learn_languages(docs, F.lit(True), sample_docs=100)
    assert set(model.languages) <= {"en", "de"} and model.gram_rows
    labels = spark.createDataFrame([(1, 1), (2, 0)] + [(i, i % 2) for i in range(10, 200)], "doc_id long, quality int")
    assert len(learn_quality(docs, labels, F.lit(True), sample_docs=60).labels) == 60
    assert len(learn_quality(docs, labels, F.lit(True)).labels) == 192
    assert len(learn_quality(docs, labels.filter("doc_id = 1"), F.lit(True)).labels) == 1


def test_models_equal_those_of_plain_counts(spark, docs):
    rows = [r for r in awkward() if r[0] is not None and r[1] is not None and r[2] is not None]
    want = fit_language_model([r[1] for r in sorted({(r[0], r[1], r[2]) for r in rows})], [r[2] for r in sorted({(r[0], r[1], r[2]) for r in rows})])
    got = learn_languages(docs, F.lit(True))
    assert got.languages == want.languages and got.gram_rows == want.gram_rows
    assert np.allclose(got.gram_scores, want.gram_scores) and {k: v.tolist() for k, v in got.scripts.items()} == {k: v.tolist() for k, v in want.scripts.items()}
    texts = {r[0]: r[1] or "" for r in awkward() if r[0] not in (None, 3)}
    labels = {k: k % 2 for k in texts}
    got = learn_quality(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), F.lit(True), dims=8)
    order = sorted(texts, key=lambda k: (hashlib.sha256(texts[k].encode()).hexdigest(), labels[k]))
    want = fit_quality_model([texts[k] for k in order], [labels[k] for k in order], dims=8)
    assert got.shapes == want.shapes and got.labels.tolist() == want.labels.tolist() and np.allclose(got.weight, want.weight)
    asked = [r[1] for r in awkward()]
    assert np.allclose(score_texts(Vectors(got), asked)[0], score_texts(Vectors(want), asked)[0], atol=1e-4)


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        centre = rng.normal(size=8)
        rows += [((centre + rng.normal(size=8) * 0.08).tolist(), label) for _ in range(60)]
        rows += [(rng.normal(size=8).tolist(), label) for _ in range(60)]
    rows += [(rows[0][0], 0), (rows[0][0], 1), ([2 * x for x in rows[1][0]], 0), (None, 0), ([0.0] * 8, 0), ([math.nan] + [1.0] * 7, 0), ([math.inf] + [1.0] * 7, 0), ([None] + [1.0] * 7, 0), ([1.0, 2.0], 0), ([1.0, 2.0], 0), (rows[0][0], None), ([], 0)]
    return [(i, v, g) for i, (v, g) in enumerate(rows)] + [(0, rows[0][0], 0), (None, rows[0][0], 0)]


@pytest.mark.parametrize("cell, block", [(4096, 2048), (20, 8)])
def test_vectors(spark, monkeypatch, cell, block):
    from metasieve.llm import vector_join

    monkeypatch.setattr(vector_join, "CELL", cell)
    monkeypatch.setattr(vector_join, "BLOCK", block)
    rows = vectors()
    good = [v is not None and g is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, g in rows]
    group, links = list(range(len(rows))), [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        (_, v, a), (_, w, b) = rows[i], rows[j]
        if good[i] and good[j] and a == b and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
            links[i], links[j] = links[i] + 1, links[j] + 1
            x, y = group[i], group[j]
            group = [x if g == y else g for g in group]
    least = defaultdict(lambda: None)
    for (k, _, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (least[g], k) if x is not None), default=None)
    want = sorted((str(k), n, str(least[g]), k == least[g]) for (k, _, _), n, g in zip(rows, links, group, strict=True))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, row string, cell int")
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_vectors(df).collect()) == want
    assert near_vectors(df.limit(0)).count() == 0


def test_media(docs, none):
    stored = encode_media(docs)
    rows = media_features(stored).collect()
    assert sorted(bytes(r.thumbnail) for r in rows) == sorted(payload_of(r[1]) for r in awkward())
    digests = media_digests(stored).collect()
    assert sorted(r.tail_crc32 for r in digests) == sorted(zlib.crc32(payload_of(r[1])[-64:]) for r in awkward())
    clash = media_features(stored.withColumn("width", F.lit("mine")).withColumn("thumbnail", F.lit(1)))
    assert [n for n in clash.columns if "width" in n] == ["width", "_width", "thumb_width"] or {"width", "_width", "_thumbnail"} <= set(clash.columns)
    assert sorted(bytes(r._thumbnail) for r in clash.collect()) == sorted(bytes(r.thumbnail) for r in rows)
    assert media_digests(encode_media(none)).count() == 0 and media_features(encode_media(none)).count() == 0


def plain_line_dedup(rows):
    """Of equal windows the least (id, text, place) stays."""
    places = defaultdict(set)
    for k, t in rows:
        lines = [x.strip(" ") for x in t.split("\n") if x.strip(" ")]
        for p in range(len(lines) - 2):
            places[tuple(lines[p : p + 3])].add((k, t, p))
    starts = defaultdict(list)
    for found in places.values():
        for k, t, p in sorted(found)[1:]:
            starts[k, t].append(p)
    out = []
    for k, t in rows:
        covered, n, kept = {p + i for p in starts[k, t] for i in range(3)}, 0, []
        for line in t.split("\n"):
            full = bool(line.strip(" "))
            if not (full and n in covered):
                kept.append(line)
            n += full
        out.append((k, "\n".join(kept), n, len(covered)))
    return sorted(out)


def test_line_dedup(spark, docs, none):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(("a", "b", " a", "c ", "", "d", " ")) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows += [rows[7], rows[8]]
    out, names = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()) == plain_line_dedup(rows)
    out, names = dedup_lines(docs)
    assert out.count() == len(awkward()) and out.columns[: len(docs.columns)] == docs.columns
    assert dedup_lines(none)[0].count() == 0


def test_line_dedup_of_short_texts(spark):
    texts = ["a b", "x\ny", " a b \n\n", "\nx\n y", "y\nx", "x\ny\nz", "a b\nx", "", None, "", "x\ny\nz"]
    df = spark.createDataFrame([*enumerate(texts), (0, "a b")], "doc_id long, text string").repartition(3)
    out = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(df, short_texts=True)[0].collect()}
    gone = {2: ("\n", 1, 1), 3: ("", 2, 2), 10: ("", 3, 3)}
    assert out == {(i, *gone.get(i, (t, len((t or "").split("\n")) if t else 0, 0))) for i, t in enumerate(texts)}
    assert dedup_lines(df)[0].filter("n_removed > 0").count() == 1


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://Www.Example.COM/en/7?q#x", "x://example.com/en/8", "x://badexample.com", "x://example.net/de/81", "x://a.example.net/de/9", "x://y.org?/es/", "x://y.org/es/1", "://h://i/j", "x://bad.test/1", "x://com/en/"]
    pages = spark.createDataFrame([(i, u, "host", None) for i, u in enumerate(urls)] + [(3, urls[3], None, None)], "page_id long, url string, host string, rule string")
    pages = pages.withColumn("bad", F.lit(None).cast("boolean"))
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(pages, pages, URL_RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[4][2:] == ("com/en/", "block") and got[5][2:] == (None, "allow")
    assert got[6][2:] == ("example.net/de/8", "block") and got[7][2:] == ("net/de/", "allow")
    assert got[8] == ("y.org", "", None, "allow") and got[9][2] == "org/es/" and got[10][:2] == ("h:", "//i/j") and got[12][2] == "com/en/"
    assert judge_urls(pages, pages.limit(0), URL_RULES).count() == len(urls) + 1
    assert judge_urls(pages.limit(0), pages.limit(0), URL_RULES).count() == 0


def test_reputation(spark):
    rows = [("spam.a.com", i % 20 != 0) for i in range(200)] + [("good.b.com", i % 20 == 0) for i in range(200)] + [("new.a.com", None), ("tiny.b.com", True), (None, True), ("x", False)]
    got = {r.host: r for r in host_reputation(spark.createDataFrame(rows, "host string, bad boolean"), "host", "bad", Reputation()).collect()}
    assert got["spam.a.com"].blocked and not got["good.b.com"].blocked and not got["tiny.b.com"].blocked
    assert got["new.a.com"].n == 0 and got["new.a.com"].posterior_mean > got["tiny.b.com"].posterior_mean * 0.5
    assert got["tiny.b.com"].posterior_mean < 1 and None not in got


def test_reputation_decides(spark):
    """A url without a rule is blocked by its host's labelled pages, also where one host has a third of all."""
    labelled = [(f"x://bad.test/{i}", i % 3 != 0) for i in range(60)] + [(f"x://big.test/{i}", i % 10 == 0) for i in range(300)] + [(f"x://h{i}.other/1", i % 10 == 0) for i in range(100)]
    outcomes = spark.createDataFrame(labelled, "url string, bad boolean")
    pages = spark.createDataFrame([(1, "x://bad.test/q"), (2, "x://big.test/q"), (3, "x://h5.other/q"), (4, "x://never.seen/q"), (5, "x://bad.test.example.com/en/7")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, outcomes, URL_RULES).collect()}
    assert got == {1: (None, "block"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: ("example.com/en/7", "allow")}


def test_suffixes(spark):
    hosts = ["a.b.co.uk", "co.uk", "b.co.uk:8080", "www.x.com", "x.com", "com", "me@x.com", "10.0.0.1", "10.0.0.1:80", "", "a..b", "[::1]"]
    suffix, domain = suffix_and_domain(F.col("h"), ("co.uk", "uk.co"))
    got = {r.h: (r.s, r.d) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", suffix.alias("s"), domain.alias("d")).collect()}
    assert got["a.b.co.uk"] == got["b.co.uk:8080"] == ("co.uk", "b.co.uk") and got["co.uk"] == ("co.uk", "co.uk")
    assert got["www.x.com"] == got["x.com"] == got["me@x.com"] == ("com", "x.com") and got["com"] == ("com", "com")
    assert got["10.0.0.1"] == got["10.0.0.1:80"] == ("10.0.0.1", "10.0.0.1") and got["[::1]"] == ("[::1]", "[::1]") and got[""] == ("", "")


def test_raking_meets_targets(spark, docs, none):
    cells = spark.createDataFrame([(s, g, t, 10.0 + 7 * i) for i, (s, g, t) in enumerate(itertools.product("ab", "xyz", "pq"))], "source string, lang string, topic string, tokens double")
    targets = {"source": {"a": 3, "b": 1}, "lang": {"x": 1, "y": 1, "z": 2}, "topic": {"p": 0.3, "q": 0.7, "absent": 5}}
    rows = rake(cells, ["source", "lang", "topic"], targets, rounds=8).collect()
    apart = rake(cells, ["source", "lang", "topic"], targets, rounds=8, together=0).collect()
    assert {(r.source, r.lang, r.topic): round(r.weight, 9) for r in rows} == {(r.source, r.lang, r.topic): round(r.weight, 9) for r in apart}
    for d, want in (("source", {"a": 0.75, "b": 0.25}), ("lang", {"x": 0.25, "y": 0.25, "z": 0.5}), ("topic", {"p": 0.3, "q": 0.7})):
        for v, share in want.items():
            assert abs(sum(r.weight for r in rows if r[d] == v) - share) < 1e-4
    out, names = mix_sources(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and names["topic"] == "_topic" and 0 < out.count() <= len(awkward())
    assert all(0 < r.probability <= 1 for r in out.collect())
    everything, _ = mix_sources(docs, token_share=1.0, rounds=4)
    assert everything.count() == len(awkward())
    no_b, names = mix_sources(docs, targets={"source": {"s0": 1}}, rounds=4, tokens=F.col("n_chars"), topic=F.lit("one"))
    assert {(r.source, r[names["topic"]]) for r in no_b.collect()} == {("s0", "one")}
    assert mix_sources(none)[0].count() == 0


def test_sampling_is_calibrated(spark):
    rows = [(i, "word " * (5 if i % 3 else 20), "en", f"s{i % 3}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out, names = mix_sources(df, targets={"source": {"s0": 1, "s1": 1, "s2": 1}}, token_share=0.4)
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(names["n_tokens"]).alias("n")).collect()}
    total = sum(got.values())
    assert abs(total / 60000 - 0.4) < 0.03 and all(abs(n / total - 1 / 3) < 0.04 for n in got.values())

"""Each registered query against its contract, by plain versions, and against its SQL."""

import glob
import hashlib
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from metasieve.llm.queries import ORACLE_SQL, QUERIES, document_of, vocabulary

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def remainder(key, n):
    return zlib.crc32(str(key).encode()) % n


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        duck.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert got == sorted(map(repr, duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()))


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op2_packing"](spark, SMALL).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for k, own in pieces.items():
        ids = [*library.encode(texts[k].text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for places in sequences.values():
        ends = [0]
        for offset, n in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 4096
    assert sum(n for p in sequences.values() for _, n in p) > 0.9 * 4096 * (len(sequences) - 1)


def test_language(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = QUERIES["op3_language"](spark, LARGER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    learned = {r.lang for k, r in docs.items() if remainder(k, 5) and r.lang}
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred in learned if any(c.isalpha() for c in docs[r.doc_id].text or "") else r.lang_pred == "und" for r in rows)
    held = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].lang]
    assert len(held) > 150 and np.mean(held) >= 0.99


def test_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = QUERIES["op4_quality"](spark, LARGER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect())
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert len(held) > 80 and np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) >= 0.98


def test_ngrams(spark, texts):
    from .test_operators import plain_components

    rows = [(k, r.text) for k, r in texts.items()]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in QUERIES["op5_ngram_jaccard"](spark, SMALL).collect())
    assert got == plain_components(rows)


def test_media(spark, texts):
    rows = QUERIES["op7_media"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_text = {}
    for r in rows:
        raw = (texts[r.doc_id].text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and r.media_bytes > len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert by_text.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert len({m for m, _ in by_text.values()}) == len(by_text)


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op10_token_counts"](spark, SMALL).collect()}
    n = {k: len(library.encode(r.text or "", add_special_tokens=False).ids) for k, r in texts.items()}
    assert got == {k: (len((r.text or "").encode()), n[k], n[k] > 512) for k, r in texts.items()}


def test_some_hosts_are_blocked_and_most_are_not(spark):
    rows = [r for r in QUERIES["op9_url_filters"](spark, LARGER).collect() if r.rule is None]
    blocked = {r.host for r in rows if r.verdict == "block"}
    assert blocked and len(blocked) < 0.2 * len({r.host for r in rows})
    assert all(r.verdict == ("block" if r.host in blocked else "allow") for r in rows)


def test_documents_of_urls(spark):
    urls = ["x://h/en/12", "x://h/en/12.html?q=3", "x://h/12/", "x://h/a12", "x://h/12/b", "x://h", None, "x://h/12345678901234567890"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in rows.select(document_of(rows.url)).collect()] == [12, 12, 12, None, None, None, None, None]

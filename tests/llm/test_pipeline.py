"""The pipeline, stage by stage, on awkward rows and on a small table."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from metasieve.llm.language import learn_languages

from .test_operators import SCHEMA, awkward, near_copies, plain_components
from .test_units import plain_label


def test_stages_keep_columns_and_rows(spark, tmp_path):
    docs = spark.createDataFrame(awkward(400), SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{name}")
        assert {r.text for r in docs.collect()} & {None, "", " \n\t "} == set()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(k, t) for k, t in near_copies()] + [(None, "q w e r t z"), (3, near_copies()[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    from metasieve.llm.ngram_join import jaccard_components

    groups = {r.component_id for r in jaccard_components(docs).collect()}
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, groups))


def test_emptied_documents_go(spark):
    rows = [(0, "a\nb\nc", 5), (1, "a\nb\nc", 5), (2, "x\na\nb\nc\ny", 9), (3, "a\nb", 3)]
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.remove_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "").collect()}
    assert out == {0: ("a\nb\nc", 5), 2: ("x\ny", 3), 3: ("a\nb", 3)}


def test_texts_go_to_one_worker_a_task(spark):
    """A filter on what Python returns is not pushed down to a second call of it."""
    docs = spark.createDataFrame([(0, "a\nb\nc", 5), (1, "a\nb\nc", 5)], "doc_id long, text string, n_chars long")
    out = corpus_pipeline.remove_lines(spark, docs, "")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in out.collect()] == [(0, "a\nb\nc", 5)]


def test_near_copies_without_ids_or_with_repeated_ones_go(spark):
    text = [f"w{i}" for i in range(60)]
    near = [" ".join([*text[:59], f"z{i}"]) for i in range(4)]
    other = [" ".join([*(f"v{i}" for i in range(59)), f"z{i}"]) for i in range(3)]
    rows = [(None, near[0]), (None, near[1]), (None, other[0]), (5, other[1]), (None, other[2])]
    rows += [(7, "a b c d e f g"), (7, "h i j k l m n"), (7, "h i j k l m n o"), (None, "p q r s t u v"), (None, "p q r s t u v"), (9, " "), (9, " "), (9, ""), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sorted(str(r) for r in kept if not (r[1] or "").strip()) == ["(9, ' ')", "(9, '')", "(None, None)"]
    kept = [r for r in kept if (r[1] or "").strip()]
    assert sum(t in near for _, t in kept) == 1 and [k for k, t in kept if t in other] == [5]
    assert sum(t.startswith("p") for _, t in kept) == 1 and sum(k == 7 for k, _ in kept) == 3 and len(kept) == 6


def test_short_copies_go(spark):
    rows = [(0, "a", 1), (1, " a", 2), (2, "a\nb", 3), (3, "a\nb", 3), (4, "", 0), (5, "", 0)]
    out = corpus_pipeline.remove_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 4, 5]


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    fills = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("offset").alias("at")).collect()
    assert fills and all(0 < r.n <= 4096 and r.at < r.n for r in fills)


def plain_passages(rows):
    """Later occurrences of three lines, or of all lines of a shorter text, go; emptied texts go too."""
    places = defaultdict(list)
    for k, text in sorted(rows.items()):
        lines = [x.strip(" ") for x in text.split("\n") if x.strip(" ")]
        for p in range(max(len(lines) - 2, 1 if lines else 0)):
            places[len(lines) < 3 and len(lines), tuple(lines[p : p + 3])].append((k, p))
    covered = defaultdict(set)
    for found in places.values():
        for k, p in sorted(found)[1:]:
            covered[k] |= {p, p + 1, p + 2}
    out = {}
    for k, text in rows.items():
        kept, n = [], 0
        for line in text.split("\n"):
            full = bool(line.strip(" "))
            if not full or n not in covered[k]:
                kept.append(line)
            n += full
        if not covered[k] or any(x.strip(" ") for x in kept):
            out[k] = "\n".join(kept)
    return out


def plain_mixture(rows, share=0.7, evenness=0.7):
    """Ids that stay, by raking one cell at a time; rows are id: (text, lang, source)."""
    def cell(text, lang, source):
        words = len(re.findall(r"\S+", text))
        low = text.lower()
        topic = "table" if 10 * text.count("|") > words else "legal" if "license" in low or "rights reserved" in low else "brief" if len(text) < 600 else "article" if len(text) < 6000 else "long"
        return (source, lang, topic), max(words, 1)

    cells, of = Counter(), {}
    for k, r in rows.items():
        of[k], n = cell(*r)
        cells[of[k]] += n
    keys = sorted(cells)
    tokens = np.array([cells[c] for c in keys], float)
    weight = tokens / tokens.sum()
    for _ in range(12):
        for d in range(3):
            values = [c[d] for c in keys]
            goal = {v: sum(t for t, x in zip(tokens, values, strict=True) if x == v) ** evenness for v in values}
            total = sum(goal.values())
            held = {v: sum(w for w, x in zip(weight, values, strict=True) if x == v) for v in values}
            weight = np.array([w * goal[v] / total / held[v] for w, v in zip(weight, values, strict=True)])
    rate, full = weight / tokens, np.zeros(len(keys), bool)
    while True:
        factor = (share * tokens.sum() - tokens[full].sum()) / weight[~full].sum()
        if ((factor * rate > 1) == full).all():
            break
        full = factor * rate > 1
    chance = dict(zip(keys, np.minimum(1, factor * rate), strict=True))
    return {k for k in rows if int(hashlib.md5(f"mix:{k}".encode()).hexdigest()[:8], 16) / 2**32 < chance[of[k]]}


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = learn_languages(docs, F.lit(True))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = before, {r.doc_id: r for r in docs.collect()}
    before, after = kept["language"]
    told = {k: plain_label(model, r.text) for k, r in before.items()}
    assert after.keys() == {k for k, (lang, score, _) in told.items() if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    before, after = kept["line_dedup"]
    assert {k: r.text for k, r in after.items()} == plain_passages({k: r.text for k, r in before.items()})
    assert all(r.n_chars == len(r.text) for r in after.values())
    before, after = kept["ngram_jaccard"]
    groups = plain_components([(k, r.text) for k, r in before.items()])
    assert sorted(map(str, after)) == sorted({g for _, _, g in groups})
    before, after = kept["mixing"]
    assert after.keys() == plain_mixture({k: (r.text, r.lang, r.source) for k, r in before.items()})
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    totals = {r.doc_id: r.doc_tokens for r in pieces}
    assert totals.keys() == after.keys() and sum(totals.values()) == sum(r.length for r in pieces)

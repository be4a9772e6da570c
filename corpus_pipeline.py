"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
it kept; all but the last return the columns of ``documents``. Null, empty and
repeated rows are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasieve.llm.language import UNDETERMINED, identify_languages, learn_languages
from metasieve.llm.line_dedup import dedup_lines
from metasieve.llm.mixing import mix_sources
from metasieve.llm.ngram_join import jaccard_components
from metasieve.llm.packing import pack
from metasieve.llm.queries import packed_digests, vocabulary
from metasieve.llm.shared import broadcast_if_small, discard, fresh_name, stored

#: Documents whose language is less sure than this go.
LEAST_LANGUAGE_SCORE = 0.2


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told."""
    model = learn_languages(docs, F.lit(True))
    found, names = identify_languages(docs, model)
    sure = (F.col(names["lang_pred"]) != UNDETERMINED) & (F.col(names["score"]) >= LEAST_LANGUAGE_SCORE)
    return found.filter(sure).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; a document of which nothing is left goes.

    A text of fewer than three lines is one passage. ``n_chars`` follows the text.
    """
    out, names = dedup_lines(docs, short_texts=True)
    emptied = (F.col(names["n_removed"]) > 0) & (F.col(names["n_removed"]) >= F.col(names["n_lines"]))
    kept = out.filter(~emptied)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(names["n_removed"]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the one with the least id.

    Rows with a null or repeated id are documents of their own; a null id is
    taken where all ids of the group are null. Of rows with the least id, any
    one stays. Rows without words have no near copies; of equal ones one stays.
    """
    row, group, first = (fresh_name(n, docs.columns) for n in ("row_", "group_", "first_"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    numbered = stored(docs.select(*columns, F.monotonically_increasing_id().alias(row)), "numbered")
    groups = jaccard_components(numbered.select(row, "text"), id_col=row)
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\r\x0B\f]")
    same = F.when(~has_words, F.sha2(F.to_json(F.struct(*columns)), 256))
    ids = numbered.select(F.col(row).alias(first), F.col("doc_id").alias("id_"), same.alias("same_"))
    found = stored(groups.select(F.col(row).alias(first), F.col("component_id").alias(group)), "groups")
    order = F.struct(F.col("id_").isNull(), F.col("id_"), F.col(first))
    firsts = found.join(ids, first).groupBy(F.coalesce("same_", F.col(group).cast("string"))).agg(F.min(order).alias("least_")).select(F.col("least_").getField(first).alias(first))
    kept = stored(firsts, "firsts")
    return numbered.join(broadcast_if_small(kept), F.col(row) == F.col(first), "left_semi").select(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens follow the target weights."""
    out, _ = mix_sources(docs)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into training sequences."""
    return packed_digests(pack(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("language", identify),
    ("line_dedup", remove_lines),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: No SQL: language scores and token ids are beyond it. The tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Removal of repeated passages by overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import MOST_BROADCAST, discard, fresh_name, stored, texts_to_python, trimmed

WINDOW = 3


def _lines(text: Column) -> Column:
    """Lines of a text, without spaces at their ends, that are not blank."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda line: F.trim(line)), lambda line: line != "")


def _windows(lines: Column, short_texts: bool) -> Column:
    """Place and 128-bit hash of each run of three lines; with ``short_texts``, fewer lines than that are one run."""

    def window(p: Column, size: int) -> Column:
        run = [F.element_at(lines, (p + i).cast("int")) for i in range(1, size + 1)]
        return F.struct(p.cast("int").alias("p"), F.xxhash64(*run).alias("h1"), F.xxhash64(F.lit(size), *run[::-1]).alias("h2"))

    last = F.size(lines) - WINDOW
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda p: window(p, WINDOW)))
    for size in range(1, WINDOW if short_texts else 1):
        windows = windows.when(F.size(lines) == size, F.array(window(F.lit(0), size)))
    return windows


def remove_covered(text: str, starts: list[int]) -> tuple[str, int, int]:
    """A text without the lines that windows at ``starts`` cover; how many lines are not blank, and how many go."""
    covered = {p + i for p in starts for i in range(WINDOW)}
    kept, n = [], 0
    for line in text.split("\n"):
        if line.strip(" "):
            if n not in covered:
                kept.append(line)
            n += 1
        else:
            kept.append(line)
    return "\n".join(kept), n, sum(p < n for p in covered)


_CUT = pa.struct([("text", pa.string()), ("n_lines", pa.int32()), ("n_removed", pa.int32())])


def _removed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, starts in batches:
        found = [None if t is None or s is None else remove_covered(t, s) for t, s in zip(texts.to_pylist(), starts.to_pylist(), strict=True)]
        yield pa.array([x and dict(zip(_CUT.names, x, strict=True)) for x in found], _CUT)


def _remove(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from trimmed(_removed)(batches)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_texts: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """Removes every later occurrence of three consecutive lines.

    Lines are compared without spaces at their ends; blank lines are passed over
    and stay. Of equal windows, the one in the document with the least id (a
    null id comes first), at the least place there, is the first occurrence; all
    others are later ones, and the lines that any of them covers are removed. A
    line that goes thus stays in an earlier place. Texts that are null stay as
    they are. So do those of fewer than three lines, unless ``short_texts``: then
    all the lines of such a text are one window, equal to no part of a longer one.

    Returns the frame, with ``text_col`` replaced and all other columns kept,
    and the names of the columns added: ``n_lines`` (not blank, before) and
    ``n_removed``, with underscores in front where ``docs`` has such a column.
    Rows with equal id and text are one document: none is a copy of the other.

    The first occurrence of a window is found before the shuffle as far as it
    can be, and occurrences meet it in a join that adaptive execution can split.
    """
    texts_to_python(docs.sparkSession)
    names = {n: fresh_name(n, docs.columns) for n in ("n_lines", "n_removed")}
    own, text = docs.columns, F.col(f"`{text_col}`")
    key = {"id_": F.col(f"`{id_col}`"), "digest_": F.unhex(F.md5(F.coalesce(text, F.lit(""))))}
    places = docs.filter(text.isNotNull()).select(*[c.alias(n) for n, c in key.items()], _lines(text).alias("lines_"))
    places = places.select("id_", "digest_", F.explode(_windows(F.col("lines_"), short_texts)).alias("w")).select("id_", "digest_", "w.*")

    at = F.struct("id_", "digest_", "p")
    firsts = places.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(at).alias("first")).filter("n > 1").drop("n")
    firsts = stored(firsts, "first-windows")
    later = places.join(firsts, ["h1", "h2"]).filter(~at.eqNullSafe(F.col("first")))
    covered = stored(later.groupBy("id_", "digest_").agg(F.collect_set("p").alias("starts_")), "covered")
    discard(firsts)

    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc_"), *[c.alias(f"k{n}") for n, c in key.items()])
    same = F.col("kid_").eqNullSafe(F.col("id_")) & (F.col("kdigest_") == F.col("digest_"))
    # documents with covered lines are sent to the texts if they and their places are few, counted; else a join shuffles both
    n_places = covered.agg(F.sum(F.size("starts_"))).first()[0] or 0
    met = kept.join(F.broadcast(covered) if n_places <= MOST_BROADCAST else covered, same, "left")
    whole = F.col(f"doc_.`{text_col}`")
    # not to be worked out again, by a second worker of the task, where a filter on the result is pushed down
    remove = F.arrow_udf(_remove, "text string, n_lines int, n_removed int").asNondeterministic()
    met = met.withColumn("cut_", remove(F.when(F.col("starts_").isNotNull(), whole), F.col("starts_")))
    columns = [(F.coalesce(F.col("cut_.text"), whole) if c == text_col else F.col(f"doc_.`{c}`")).alias(c) for c in own]
    n_lines = F.coalesce(F.col("cut_.n_lines"), F.size(_lines(whole)), F.lit(0))
    out = met.select(*columns, n_lines.alias(names["n_lines"]), F.coalesce(F.col("cut_.n_removed"), F.lit(0)).alias(names["n_removed"]))
    return out, names

"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (a combination of source, language and topic). Raking
scales the cells' weights to each target marginal in turn, again and again; then
each document is kept with its cell's calibrated probability, by a hash of its
id. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, discard, fresh_name, stored

#: What stands for a null source, language or topic.
NONE = "(none)"
#: Cells that one task rakes at most; more are summed where they lie. Rounds of the former that are planned together.
MOST_TOGETHER, _ROUNDS_TOGETHER = 100_000, 4


def word_tokens(text: Column) -> Column:
    """Tokens of a text for weighing: runs of characters other than white space, one at least."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")), F.lit(1)).cast("long")


def text_topic(text: Column) -> Column:
    """A topic by a text's form: table, legal, brief, article or long."""
    t = F.coalesce(text, F.lit(""))
    bars = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    legal = F.lower(t).like("%license%") | F.lower(t).like("%rights reserved%")
    return F.when(10 * bars > F.regexp_count(t, F.lit(r"\S+")), "table").when(legal, "legal").when(F.length(t) < 600, "brief").when(F.length(t) < 6000, "article").otherwise("long")


def _goals(cells: DataFrame, dim: str, given: dict[str, float] | None, evenness: float) -> DataFrame:
    """The share of each value of a marginal, as ``goal``: as given (0 if not listed), or the corpus share, flattened."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens"))
    if given is None:
        part = F.pow(F.col("tokens"), F.lit(evenness))
    else:
        part = reduce(lambda rest, kv: F.when(F.col(dim) == kv[0], float(kv[1])).otherwise(rest), given.items(), F.lit(0.0))
    parts = stored(sums.select(dim, part.alias("part")), "goals")
    total = parts.agg(F.sum("part")).first()[0]
    return parts.select(dim, (F.col("part") / F.lit(total) if total else F.lit(0.0)).alias("goal"))


def rake(cells: DataFrame, dims: list[str], targets: dict[str, dict[str, float] | None], rounds: int = 12, evenness: float = 0.7, tolerance: float = 1e-12, together: int = MOST_TOGETHER) -> DataFrame:
    """Adds ``weight`` to cells with ``tokens``: scaled to the target marginals of ``dims`` in turn.

    A marginal without a target is the corpus share to the power ``evenness``.
    Targets are normalised over the values present; a value with target 0 gets
    weight 0. There are ``rounds`` rounds at most; they end when no marginal is
    off its target by more than ``tolerance`` of it.

    Where the cells number ``together`` at most, counted, one task does all
    rounds over them. Beyond that a step sums the cells by a marginal's value,
    before any shuffle as far as it can, and joins the sums to the cells: a
    dimension may have any number of values, and no task gathers all cells.
    """
    goals = {d: _goals(cells, d, targets.get(d), evenness) for d in dims}
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    cells = stored(cells.withColumn("weight", F.col("tokens") / F.lit(float(total))), "cells")
    if cells.count() <= together:
        return _raked_together(cells, dims, goals, rounds, tolerance)
    for _ in range(rounds):
        before, off = cells, []
        for d in dims:
            held = cells.groupBy(d).agg(F.sum("weight").alias("held"))
            factor = F.when(F.col("held") > 0, F.col("goal") / F.col("held")).otherwise(0.0)
            steps = stored(held.join(goals[d], d).select(d, factor.alias("factor"), F.when((F.col("held") > 0) & (F.col("goal") > 0), F.abs(F.col("factor") - 1)).otherwise(0.0).alias("off")), "factors")
            off.append(steps)
            cells = cells.join(broadcast_if_small(steps.select(d, "factor")), d).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        cells = stored(cells.select(*before.columns), "cells")
        worst = max(steps.agg(F.max("off")).first()[0] or 0.0 for steps in off)
        discard(before, *off)
        if worst <= tolerance:
            break
    return cells


def _raked_together(cells: DataFrame, dims: list[str], goals: dict[str, DataFrame], rounds: int, tolerance: float) -> DataFrame:
    columns, held = cells.columns, {d: F.sum("weight").over(Window.partitionBy(d)) for d in dims}
    for d in dims:
        cells = cells.join(goals[d].select(d, F.col("goal").alias(f"goal_{d}")), d)
    cells = cells.repartition(1)
    for k in range(rounds):
        for d in dims:
            cells = cells.withColumn("weight", F.when(held[d] > 0, F.col("weight") * F.col(f"goal_{d}") / held[d]).otherwise(0.0))
        if k % _ROUNDS_TOGETHER == _ROUNDS_TOGETHER - 1:
            cells = stored(cells, "cells").repartition(1)
            off = [F.max(F.when(F.col(f"goal_{d}") > 0, F.abs(F.col(f"held_{d}") / F.col(f"goal_{d}") - 1))) for d in dims]
            worst = cells.withColumns({f"held_{d}": held[d] for d in dims}).agg(F.greatest(*off, F.lit(0.0))).first()[0]
            if worst <= tolerance:
                break
    return stored(cells.select(*columns), "cells")


def with_probabilities(cells: DataFrame, token_share: float) -> DataFrame:
    """Adds each cell's ``probability``: proportional to weight by token, 1 at most, for ``token_share`` of the tokens expected.

    The factor leaves to the cells below 1 what those at 1 do not take. It only
    grows from step to step, each a sum over the cells, until no cell more gets
    to 1.
    """
    rate = F.col("weight") / F.col("tokens")
    room = token_share * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    factor, at_one = 0.0, -1
    while True:
        full = F.lit(factor) * rate > 1
        sums = cells.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("tokens"))).alias("tokens"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if sums.n == at_one or not sums.weight:
            break
        at_one, factor = sums.n, (room - float(sums.tokens or 0)) / sums.weight
    one = F.when(F.col("weight") > 0, 1.0).otherwise(0.0)
    return cells.withColumn("probability", one if not sums.weight else F.least(one, F.lit(factor) * rate))


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix_sources(
    docs: DataFrame,
    targets: dict[str, dict[str, float] | None] | None = None,
    token_share: float = 0.7,
    topic: Column | None = None,
    tokens: Column | None = None,
    seed: str = "mix:",
    rounds: int = 12,
    evenness: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> tuple[DataFrame, dict[str, str]]:
    """Samples documents so that their tokens follow the target marginals.

    ``targets`` has for ``source``, ``lang`` and ``topic`` a weight by value;
    without one, a marginal is the corpus share to the power ``evenness``.
    ``token_share`` of all tokens are expected to stay. ``topic`` is an
    expression over ``docs`` (default: :func:`text_topic`), and so is ``tokens``, a
    document's weight (default: its words; a tokenizer's counts serve as well).

    Returns the rows that stay, with all their columns, and the names of those
    added: ``topic, n_tokens, probability``, with underscores in front where
    ``docs`` has such a column. A null source, language or topic is a value of
    its own. Rows with equal ids stay or go together if their cells agree; a
    null id is replaced by the text. A null or empty text weighs one token. An
    empty table gives an empty one.

    A source that holds a third of the rows is summed before the shuffle; cells
    are broadcast to the documents if they number ``MOST_BROADCAST`` at most, else
    adaptive execution splits their join.
    """
    dims = ["source", "lang", "topic"]
    names = {n: fresh_name(n, docs.columns) for n in ("topic", "n_tokens", "probability")}
    text, own = F.col(f"`{text_col}`"), docs.columns
    values = {"source": F.col(f"`{source_col}`"), "lang": F.col(f"`{lang_col}`"), "topic": text_topic(text) if topic is None else topic}
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc_"), (word_tokens(text) if tokens is None else tokens.cast("long")).alias("tokens"),
        *[F.coalesce(v.cast("string"), F.lit(NONE)).alias(d) for d, v in values.items()],
        unit_hash(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.md5(text), F.lit("")), seed).alias("draw_"),
    )
    cells = stored(keyed.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, dims, targets or {}, rounds, evenness)
    chances = stored(with_probabilities(raked, token_share).select(*dims, "probability"), "chances")
    discard(cells, raked)
    stay = keyed.join(broadcast_if_small(chances), dims).filter(F.col("draw_") < F.col("probability"))
    added = [F.col("topic").alias(names["topic"]), F.col("tokens").alias(names["n_tokens"]), F.col("probability").alias(names["probability"])]
    return stay.select(*[F.col(f"doc_.`{c}`").alias(c) for c in own], *added), names

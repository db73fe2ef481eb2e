"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed per cell (one combination of the dimensions' values); the cells are raked
to the target marginals of each dimension in turn; documents are then sampled with probabilities
that follow from their cell's calibrated weight. Everything runs as DataFrame operations on the
cell table, whose size is the number of combinations, not of documents.

Nulls and edges: a null value of a dimension is a value like any other and may have a target. A value
without a target gets no weight, a target without documents is left out and the others are scaled
up. A null text or weight counts 0 tokens; such documents follow the probability of their cell.
Repeated rows are sampled alike, since the draw depends on the id and the seed. An empty table gives
an empty result. Very long texts count by all their words, ties are drawn apart by id, and input columns
may have any name (see ``mix``).
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window, functions as F

from couplet.operators.shared import materialise

TOLERANCE = 1e-12    # raking ends when no marginal share is off by more than this part of its target
REPORT = 1e-9        # an error above this that sweeps no longer lower is reported
SWEEPS_PER_JOB = 4   # sweeps between two looks at the error
STALL = 3            # jobs that together must lower the error by a hundredth
CELLS_PER_TASK = 100_000


def uniform(id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    text = F.concat_ws("/", F.lit(str(seed)), F.coalesce(id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def word_count(text: Column) -> Column:
    """Tokens of a text: its runs of characters that are not white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _over(value: Column, dimension: str) -> Column:
    return value.over(Window.partitionBy(dimension))


def _goal_columns(cells: DataFrame, targets: dict[str, DataFrame | float]) -> DataFrame:
    """Cells with ``__goal_d`` per dimension: the target share of the cell's value, or what a power makes of its tokens."""
    for d, target in targets.items():
        if isinstance(target, DataFrame):
            goal = target.select(F.col("value").alias("__value"), F.col("share").cast("double").alias(f"__goal_{d}"))
            cells = cells.join(goal, cells[d].eqNullSafe(goal["__value"]), "left").drop("__value")
        else:
            cells = cells.withColumn(f"__goal_{d}", F.pow(_over(F.sum("tokens"), d).cast("double"), F.lit(target)))
    return cells


def rake(cells: DataFrame, targets: dict[str, DataFrame | float], sweeps: int | None = None) -> DataFrame:
    """Add ``share`` to a cell table with ``tokens``: the shares that meet the targets of each dimension.

    A target is a DataFrame ``(value, share)``, or a number: the power to which the dimension's token
    shares are raised. Shares start in proportion to the tokens, so ratios within a cell's row stay as the
    data have them as far as the targets allow. Every dimension is raked in turn until all marginals
    are within ``TOLERANCE``, or the error no longer falls: targets that can't be met together give a
    warning with what is left. ``sweeps`` ends this earlier.

    Margins are window sums over the cell table. It is dealt into one part per ``CELLS_PER_TASK``
    cells, so that a table of ordinary size is raked by one task without a shuffle, several sweeps to
    a job, and a larger one shuffles by each dimension in turn.
    """
    dims = list(targets)
    parts = max(1, -(-cells.count() // CELLS_PER_TASK))
    fitted = _goal_columns(cells.coalesce(parts), targets)
    reached = F.least(*[F.coalesce(f"__goal_{d}", F.lit(0.0)) for d in dims], F.lit(1.0)) > 0
    fitted = fitted.withColumn("share", F.when(reached, F.col("tokens").cast("double")).otherwise(F.lit(0.0)))
    live = F.when(F.col("share") > 0, F.lit(1))
    for d in dims:
        fitted = fitted.withColumn(f"__n_{d}", _over(F.count(live), d))
    fitted = materialise(fitted)
    whole = fitted.where("share > 0").agg(F.lit(0).alias("none"), *[F.sum(F.col(f"__goal_{d}") / F.col(f"__n_{d}")).alias(d)
                                                                     for d in dims]).first()
    fitted = fitted.coalesce(parts).select(*cells.columns, "share", *[
        (F.col(f"__goal_{d}") / F.lit(whole[d] or 1.0)).alias(f"__goal_{d}") for d in dims])
    errors, done = [], 0
    while dims and (sweeps is None or done < sweeps):
        turns = SWEEPS_PER_JOB if sweeps is None else min(SWEEPS_PER_JOB, sweeps - done)
        for d in dims * turns:
            share = F.col("share") * F.col(f"__goal_{d}") / F.nullif(_over(F.sum("share"), d), F.lit(0.0))
            fitted = fitted.withColumn("share", F.coalesce(share, F.lit(0.0)))
        for d in dims:
            fitted = fitted.withColumn(f"__off_{d}", F.when(F.col("share") > 0, F.abs(_over(F.sum("share"), d) / F.col(f"__goal_{d}") - 1)))
        fitted = materialise(fitted)
        worst = fitted.agg(F.greatest(F.lit(0.0), *[F.max(f"__off_{d}") for d in dims]).alias("error")).first()
        errors.append(worst["error"])
        done += turns
        fitted = fitted.coalesce(parts).drop(*[f"__off_{d}" for d in dims])
        if errors[-1] <= TOLERANCE or len(errors) > STALL and errors[-1] > 0.99 * errors[-1 - STALL]:
            break
    if errors and errors[-1] > REPORT:
        warnings.warn(f"raking ended after {done} sweeps with a marginal share off by {errors[-1]:.3g} of its target",
                      stacklevel=2)
    total = fitted.agg(F.sum("share")).first()[0] or 1.0
    return fitted.withColumn("share", F.col("share") / F.lit(total)).drop(*[f"__goal_{d}" for d in dims])


def probabilities(cells: DataFrame, fraction: float, rounds: int | None = None) -> DataFrame:
    """Add ``p`` to raked cells: expected tokens are ``fraction`` of all, split as the shares say.

    ``p`` never exceeds 1; what capped cells can't supply goes to the others in proportion,
    until no further cell is capped; ``rounds`` ends this earlier. Each round sends three numbers to the driver.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("share") / F.col("tokens")).otherwise(F.lit(0.0))
    rated = materialise(cells.withColumn("__ratio", ratio))
    budget = fraction * float(rated.agg(F.sum("tokens")).first()[0] or 0)
    scale, capped, done = budget, 0, 0
    while rounds is None or done < rounds:
        full = F.col("__ratio") * scale >= 1
        row = rated.agg(F.count(F.when(full, 1)).alias("full"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("used"),
                        F.sum(F.when(~full, F.col("share")).otherwise(0.0)).alias("open")).first()
        if not row["open"] or done and row["full"] == capped:
            break
        capped, done = row["full"], done + 1
        scale = max(scale, (budget - float(row["used"] or 0)) / row["open"])
    return rated.withColumn("p", F.least(F.lit(1.0), F.col("__ratio") * F.lit(scale))).drop("__ratio")


def mix(docs: DataFrame, targets: dict[str, DataFrame | float], dimensions: dict[str, Column], tokens: Column,
        fraction: float, id: str = "doc_id", seed: int = 17, cells: DataFrame | None = None,
        sweeps: int | None = None, rounds: int | None = None, added: bool = True) -> DataFrame:
    """``docs`` sampled to the targets, with ``__p`` the probability and ``__tokens`` the weight of each.

    ``dimensions`` gives each target's column as an expression over ``docs``; ``cells`` are the
    tokens per combination, if they are known already. Columns of ``docs`` named like an added one are
    replaced; with ``added`` false none is added and all of ``docs`` pass through.
    """
    keys = list(dimensions)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.struct(*[c.alias(d) for d, c in dimensions.items()]).alias("cell"), tokens.alias("tokens"))
    if cells is None:
        cells = materialise(named.groupBy("cell").agg(F.sum("tokens").alias("tokens")).select("cell.*", "tokens"))
    rated = materialise(probabilities(rake(cells, targets, sweeps), fraction, rounds)
                        .select(*[F.col(d).alias(f"at_{d}") for d in keys], "p"))
    match = F.lit(True)
    for d in keys:
        match = match & F.col(f"cell.{d}").eqNullSafe(F.col(f"at_{d}"))
    sampled = named.join(rated, match, "left") \
        .where(uniform(F.col(f"row.`{id}`"), seed) < F.coalesce("p", F.lit(0.0)))
    new = [*[F.col(f"cell.{d}").alias(f"__{d}") for d in keys], F.col("tokens").alias("__tokens"), F.col("p").alias("__p")] \
        if added else []
    taken = {f"__{d}" for d in [*keys, "tokens", "p"]} if added else set()
    return sampled.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in taken], *new)


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target marginal of a dimension: its token shares raised to a power, scaled to 1."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens"))
    raised = materialise(sums.where("tokens > 0").select("value", F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("raised")))
    total = raised.agg(F.sum("raised")).first()[0] or 1.0
    return raised.select("value", (F.col("raised") / F.lit(total)).alias("share"))


def topic_of(text: Column) -> Column:
    """Content class of a text, by marks that tables, symbol noise and shouting leave."""
    return F.when(F.contains(text, F.lit("|")), "table") \
        .when(F.contains(text, F.lit("###")) | F.contains(text, F.lit("$$$")), "symbols") \
        .when(F.contains(text, F.lit("!!")), "shout").otherwise("prose")


# Targets are the token shares of each dimension raised to these powers: below 1 they lift small values.
TEMPERS = {"source": 0.5, "lang": 0.5, "topic": 1.0}


def mix_documents(docs: DataFrame, fraction: float, tempers: dict[str, float] | None = None, text: str = "text",
                  id: str = "doc_id", topic: Column | None = None, tokens: Column | None = None,
                  seed: int = 17, sweeps: int | None = None, rounds: int | None = None, added: bool = True) -> DataFrame:
    """Sample documents towards tempered source, language and topic shares.

    The result has the columns of ``docs`` and, unless ``added`` is false, ``__source``, ``__lang``,
    ``__topic``, ``__tokens`` and ``__p``.
    """
    tempers = TEMPERS if tempers is None else tempers
    body = F.col(f"`{text}`") if text in docs.columns else None
    dimensions = {"source": F.col("source"), "lang": F.col("lang"),
                  "topic": topic_of(body) if topic is None else topic}
    tokens = word_count(body) if tokens is None else tokens
    cells = materialise(docs.groupBy(*[c.alias(d) for d, c in dimensions.items()]).agg(F.sum(tokens).alias("tokens")))
    return mix(docs, {d: tempers[d] for d in dimensions}, dimensions, tokens, fraction, id, seed, cells=cells,
               sweeps=sweeps, rounds=rounds, added=added)

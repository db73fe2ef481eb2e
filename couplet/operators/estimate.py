"""Estimating the (clone, covariate) posterior from counts: archetypes and hierarchical shrinkage."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from couplet.functions.vectors import (
    CONC_FLOOR, PRIOR_EPS, at_least, dirichlet_multinomial, each, is_finite, literal_vector, normalise,
    sanitize, softmax, total,
)
from couplet.operators.shared import WIDE_AGGREGATE, materialise
from couplet.spec import CLONE, COVARIATE, Study

# Default concentrations of the two levels and floors of the fitted direction.
GLOBAL_SCALE = 5.0
LOCAL_SCALE = 3.0
DIRECTION_FLOOR = 1e-8
ARCHETYPE_FLOOR = 1e-8


def pooled_counts(study: Study) -> DataFrame:
    """``clonotype, n_cells, counts`` over all covariates."""
    size = study.size
    ct = study.counts()
    if size <= WIDE_AGGREGATE:
        sums = ct.groupBy(CLONE).agg(F.sum("n_cells").alias("n_cells"),
                                     *[F.sum(F.col("counts")[j]).alias(f"c{j}") for j in range(size)])
        return sums.select(CLONE, "n_cells", F.array(*[F.col(f"c{j}") for j in range(size)]).alias("counts"))
    parts = ct.groupBy(CLONE).agg(F.sum("n_cells").alias("n_cells"), F.collect_list("counts").alias("v"))
    summed = F.aggregate("v", F.array_repeat(F.lit(0.0), size), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return parts.select(CLONE, "n_cells", summed.alias("counts"))


def clone_prior(study: Study) -> DataFrame:
    """Empirical phenotype distribution of each clone, with the pseudo count."""
    shifted = each(study.size, lambda x: x + F.lit(PRIOR_EPS), F.col("counts"))
    return pooled_counts(study).select(CLONE, "n_cells", normalise(shifted, study.size).alias("prior"))


def build_archetypes(study: Study, k: int = 4, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """k-means over clone priors: ``[k, P]`` centroids (on the simplex) and labelled priors."""
    priors = materialise(clone_prior(study))
    n = priors.count()
    if k > n:
        warnings.warn(f"{k} archetypes requested for {n} clones: fitting {n}",
                      UserWarning, stacklevel=2)
        k = n
    features = priors.withColumn("features", array_to_vector("prior"))
    if k < 2:       # one archetype is the mean prior
        means = priors.agg(*[F.avg(F.col("prior")[j]).alias(f"m{j}") for j in range(study.size)]).first()
        centers, labelled = np.array([list(means)]), priors.withColumn("archetype", F.lit(0))
    else:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="archetype").fit(features)
        centers = np.array(model.clusterCenters())
        labelled = model.transform(features).drop("features")
    centers = np.clip(centers, ARCHETYPE_FLOOR, None)
    return centers / centers.sum(axis=1, keepdims=True), labelled


def ordered_archetypes(study: Study, k: int = 4, seed: int = 42) -> dict[str, DataFrame]:
    """Clone priors ordered by archetype, and the centroids, as frames for a heat map."""
    centers, labelled = build_archetypes(study, k, seed)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return {
        "priors": labelled.select(CLONE, "archetype", "prior").orderBy("archetype", CLONE),
        "centroids": study.spark.createDataFrame(rows, "archetype int, center array<double>"),
    }


def uniform_archetype(size: int) -> np.ndarray:
    return np.full((1, size), 1.0 / size)


def _with_clone_mean(rows: DataFrame, archetypes: np.ndarray, global_scale: float) -> DataFrame:
    """Add ``__mean``: a clone's expected distribution under the archetype mixture, given ``pooled``."""
    size = archetypes.shape[1]
    alphas = [[global_scale * float(x) for x in row] for row in archetypes]

    def component(alpha: list[float]) -> Column:
        scale = F.col("__n") + F.lit(float(sum(alpha)))
        return each(size, lambda c, a: (a + c) / scale, F.col("pooled"), literal_vector(alpha))

    if len(alphas) == 1:
        return rows.withColumn("__mean", component(alphas[0]))
    evidence = F.array(*[dirichlet_multinomial(F.col("pooled"), a) for a in alphas])
    rows = rows.withColumn("__evidence", evidence)
    rows = rows.withColumn("__weights", softmax(F.col("__evidence"), len(alphas)))
    weighted = [each(size, lambda x, w=i: x * F.col("__weights")[w], component(a)) for i, a in enumerate(alphas)]
    return rows.withColumn("__mean", each(size, lambda *xs: sum(xs[1:], xs[0]), *weighted))


def shrink_posterior(study: Study, *, archetypes: np.ndarray | None = None, global_scale: float = GLOBAL_SCALE,
                     local_scale: float = LOCAL_SCALE) -> DataFrame:
    """``clonotype, covariate, n_cells, p, conc`` in closed form, without iterating.

    Clone level: archetype mixture updated by the clone's pooled counts. Pair level:
    ``conc = local_scale * clone_mean + pair counts`` and ``p`` its direction. The pair counts are
    part of the pooled ones (empirical Bayes).
    """
    size = study.size
    archetypes = uniform_archetype(size) if archetypes is None else np.asarray(archetypes, float)
    if archetypes.ndim != 2 or archetypes.shape[1] != size:
        raise ValueError(f"archetypes must be [k, {size}], got {archetypes.shape}")
    ct = study.counts()
    per_clone = Window.partitionBy(CLONE)       # at most one row per covariate level
    if size <= WIDE_AGGREGATE:
        pooled = F.array(*[F.sum(F.col("counts")[j]).over(per_clone) for j in range(size)])
        rows = ct.select(CLONE, COVARIATE, "n_cells", "counts", pooled.alias("pooled"))
    else:
        rows = ct.join(pooled_counts(study).select(CLONE, F.col("counts").alias("pooled")), CLONE)
    rows = rows.withColumn("__n", total(F.col("pooled"), size))
    rows = _with_clone_mean(rows, archetypes, global_scale)
    conc = each(size, lambda m, c: m * F.lit(float(local_scale)) + c, F.col("__mean"), F.col("counts"))
    rows = rows.select(CLONE, COVARIATE, "n_cells", conc.alias("conc"))
    return rows.select(CLONE, COVARIATE, "n_cells", normalise(F.col("conc"), size).alias("p"), "conc")


def fit_posterior(study: Study, *, n_archetypes: int | None = None, archetypes: np.ndarray | None = None,
                  global_scale: float = GLOBAL_SCALE, local_scale: float = LOCAL_SCALE, seed: int = 42) -> Study:
    """The study with an estimated posterior attached (a stage table)."""
    if archetypes is None and n_archetypes:
        archetypes, _ = build_archetypes(study, n_archetypes, seed)
    fitted = materialise(shrink_posterior(study, archetypes=archetypes, global_scale=global_scale,
                                          local_scale=local_scale))
    return study.with_posterior(fitted.drop("n_cells"), local_scale=local_scale, check=False)


def sharpen(posterior: DataFrame, size: int, temperature: float) -> DataFrame:
    """Sharpen the direction of ``conc`` by ``1/temperature``; the magnitude is kept.

    ``p`` is the sharpened direction without a floor, ``conc`` carries the floors.
    """
    raw = sanitize(F.col("conc"), size)
    rows = posterior.withColumn("__raw", raw)
    rows = rows.withColumn("__mag", at_least(total(F.col("__raw"), size), 1e-6))
    power = F.lit(1.0 / float(temperature))
    direction = each(size, lambda x: at_least(F.pow(x / F.col("__mag"), power), DIRECTION_FLOOR), F.col("__raw"))
    rows = rows.withColumn("__dir", normalise(direction, size))
    conc = each(size, lambda x: at_least(x * F.col("__mag"), CONC_FLOOR), F.col("__dir"))
    p = normalise(each(size, lambda x: F.pow(x, power), F.col("__raw")), size) if float(temperature) != 1.0 \
        else normalise(F.col("__raw"), size)
    return rows.withColumns({"p": p, "conc": conc}).drop("__raw", "__mag", "__dir")

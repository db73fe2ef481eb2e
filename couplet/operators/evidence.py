"""Per-cell evidence: embedding, phenotype logits, posterior-aware probabilities, cluster baseline."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from couplet.functions.vectors import BASE_EPS, argmax_label, each, fold, softmax
from couplet.operators.joint import checked_logits, combine_weights
from couplet.operators.metrics import check_mode, information_by
from couplet.operators.mixture import assigned, fit_mixture
from couplet.operators.shared import lookup_join, materialise
from couplet.operators.subspace import principal_axes, projected
from couplet.spec import CLONE, COVARIATE, PHENOTYPE, Study, count_table, levels_of


def _as_vector(df: DataFrame, column: str) -> DataFrame:
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return df.withColumn(column, array_to_vector(F.col(column).cast("array<double>")))
    return df


def latent_representation(df: DataFrame, features: str = "features", *, k: int = 10, indices: DataFrame | None = None,
                          on: str = "cell_id", width: int | None = None) -> DataFrame:
    """Add ``latent``: leading principal components of the standardised features, largest variance first.

    ``indices`` limits the returned cells (the embedding is always fitted on all of them). Features may be sparse,
    see ``principal_axes``. An axis points where its largest loading is positive.
    """
    found = principal_axes(df, features, k=k, width=width)
    wanted = df if indices is None else df.join(indices.select(on).distinct(), on, "left_semi")
    return projected(wanted, found, features)


def phenotype_logits(df: DataFrame, phenotypes, *, features: str = "latent", temperature: float = 1.0,
                     max_iter: int = 50, reg_param: float = 1e-3) -> DataFrame:
    """Add ``logits``: multinomial regression of the phenotype on the features, over ``temperature``."""
    levels = list(phenotypes)
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(PHENOTYPE)) - 1
    vectors = _as_vector(df, features).withColumn("__label", position.cast("double"))
    learner = LogisticRegression(family="multinomial", featuresCol=features, labelCol="__label", maxIter=max_iter,
                                 regParam=reg_param, rawPredictionCol="__raw", probabilityCol="__prob",
                                 predictionCol="__pred")
    model = learner.fit(vectors.where("__label >= 0"))
    raw = vector_to_array("__raw")
    slots = [raw[j] / F.lit(float(temperature)) if j < model.numClasses else F.lit(-1e6) for j in range(len(levels))]
    return model.transform(vectors).withColumn("logits", F.array(*slots)).select(*df.columns, "logits")


def _cells_with_base(study: Study, cells: DataFrame | None) -> DataFrame:
    """Each cell next to its own pair's distribution, by key, whatever the order or subset of cells."""
    cells = study.cells if cells is None else cells
    dims, side = study.dims()
    base = dims.select(CLONE, COVARIATE, F.col("p").alias("__p"), F.col("n_cells").alias("__w"))
    cells = cells.drop("__p", "__w").withColumn("logits", checked_logits(study.size))
    joined = lookup_join(cells, base, [CLONE, COVARIATE], "__w", side=side)
    return joined.drop("__w")


def predict(study: Study, cells: DataFrame | None = None) -> DataFrame:
    """Cells with ``probs``: softmax of the gated (or additive) sum of logits and ``log p``.

    The formula is kept in its bound form because callers filter on what they derive from it.
    """
    joined = _cells_with_base(study, cells)
    keep = [c for c in joined.columns if c not in ("__p", "probs")]
    return joined.select(*keep, _probabilities(study).alias("probs"))


def _probabilities(study: Study) -> Column:
    size = study.size
    logit_weight, base_weight = combine_weights(study.gate, 1.0)
    x = each(size, lambda l, p: l * logit_weight + F.ln(p + F.lit(BASE_EPS)) * base_weight,
             F.col("logits"), F.col("__p"))
    return softmax(x, size)


def log_posterior(study: Study, cells: DataFrame | None = None) -> DataFrame:
    """Cells with ``log_posterior = logits + log(p + eps)``, additive whatever the gate."""
    joined = _cells_with_base(study, cells)
    value = each(study.size, lambda l, p: l + F.ln(p + F.lit(BASE_EPS)), F.col("logits"), F.col("__p"))
    return joined.withColumn("log_posterior", value).drop("__p")


def hard_labels(df: DataFrame, phenotypes, probs: str = "probs", out: str = "predicted") -> DataFrame:
    """Label of the largest probability; the first maximum wins."""
    return df.withColumn(out, argmax_label(F.col(probs), list(phenotypes)))


def score_cells(study: Study) -> DataFrame:
    """Cells with ``probs``, ``log_posterior`` and ``predicted``, from one lookup."""
    joined = _cells_with_base(study, None)
    keep = [c for c in joined.columns if c not in ("__p", "probs")]
    additive = each(study.size, lambda l, p: l + F.ln(p + F.lit(BASE_EPS)), F.col("logits"), F.col("__p"))
    scored = joined.select(*keep, additive.alias("log_posterior"), _probabilities(study).alias("probs"))
    return hard_labels(scored, study.phenotypes)


def evidence_summary(study: Study) -> DataFrame:
    """One row: mean KL(prior || probs) in nats, mean entropy in nats, mean ``sum of p**2``."""
    size = study.size
    rows = _cells_with_base(study, None).select("__p", _probabilities(study).alias("__q"))
    kl = fold(size, lambda p, q: F.when((p > 0) & (q > 0), p * F.ln(p / q)).otherwise(F.lit(0.0)), F.col("__p"), F.col("__q"))
    entropy = fold(size, lambda q: -q * F.ln(q + F.lit(BASE_EPS)), F.col("__q"))
    confidence = fold(size, lambda q: q * q, F.col("__q"))
    return rows.agg(F.avg(kl).alias("kl_divergence"), F.avg(entropy).alias("entropy"),
                    F.avg(confidence).alias("confidence"))


def label_agreement(study: Study) -> DataFrame:
    """Share of cells whose most probable label is the observed one."""
    scored = hard_labels(predict(study), study.phenotypes)
    return scored.agg(F.avg((F.col("predicted") == F.col(PHENOTYPE)).cast("double")).alias("agreement"),
                      F.count(F.lit(1)).alias("n_cells"))


def cluster_labels(df: DataFrame, *, k: int, features: str = "features", method: str = "kmeans", seed: int = 0,
                   target_sum: float = 1e4) -> DataFrame:
    """Add ``cluster``: library-size normalise, standardise, then k-means, or from its centres a Gaussian mixture
    with diagonal covariance."""
    if method not in ("kmeans", "gmm"):
        raise ValueError(f"method must be 'kmeans' or 'gmm', got {method!r}")
    vectors = _as_vector(df, features)
    scaled = Pipeline(stages=[
        Normalizer(p=1.0, inputCol=features, outputCol="__unit"),
        StandardScaler(inputCol="__unit", outputCol="__z", withMean=True, withStd=True),
    ]).fit(vectors).transform(vectors)
    # the target library size scales every entry alike, which standardisation removes again
    model = KMeans(k=k, seed=seed, featuresCol="__z", predictionCol="cluster").fit(scaled)
    if method == "kmeans":
        return model.transform(scaled).select(*df.columns, "cluster")
    table = materialise(scaled.select(*df.columns, vector_to_array("__z").alias("__z")))
    mixture = fit_mixture(table, np.stack(model.clusterCenters()), "__z")
    return assigned(table, mixture, "__z").select(*df.columns, "cluster")


def cluster_nmi(df: DataFrame, *, k: int, clone: str = CLONE, features: str = "features", method: str = "kmeans",
                seed: int = 0, normalize_mode: str = "min") -> DataFrame:
    """Information between clones and unsupervised clusters: the baseline a phenotype label must beat."""
    labelled = cluster_labels(df, k=k, features=features, method=method, seed=seed)
    levels = [str(i) for i in range(k)]
    cells = labelled.select(F.col(clone).alias(CLONE), F.col("cluster").cast("string").alias(PHENOTYPE)) \
        .where(F.col(CLONE).isNotNull())
    joint = count_table(cells, levels, [CLONE]).withColumnRenamed("counts", "mass").withColumn("method", F.lit(method))
    info = information_by(joint, ["method"], k)
    return info.select("method", F.lit(k).alias("k"), "mi", F.col(f"nmi_{check_mode(normalize_mode)}").alias("nmi"))

"""Registered queries: each reads whole test tables and returns one DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from couplet.functions.distances import jensen_shannon, kl_divergence, l1_distance
from couplet.functions.vectors import log_gamma, log_sum_exp, temper_power, temper_prior, vector_from_counts
from couplet.operators import auc, diagnose, estimate, evidence, frames, joint, metrics, preprocess, ranks, summarise
from couplet.operators.shared import stage_folder
from couplet.plans import views
from couplet.plans.views import COVARIATES, PRIORITIES, fitted_orders, orders_study
from couplet.sources import session, store, tables
from couplet.spec import CLONE, COVARIATE, PHENOTYPE, register_cells

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}
DIGITS = 8
DRAWS = 50


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: rounded doubles (no ``-0.0``), long integers."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, DIGITS) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(f: Query) -> Query:
    name = f.__name__

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(f(spark, sf_dir))

    run.__name__, run.__doc__ = name, f.__doc__
    _REGISTRY[name] = run
    return run


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _spread(df: DataFrame, column: str, levels, prefix: str) -> DataFrame:
    """An array column as one column per slot."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[F.col(column)[j].alias(f"{prefix}_{j}") for j in range(len(levels))])


def _labelled_joint(df: DataFrame) -> DataFrame:
    return _spread(df.drop("draw"), "mass", PRIORITIES, "m")


def _value(payload: dict, *columns: str) -> DataFrame:
    return payload["result"].select(*columns)


COUNTS = dict(source="counts", weighted=True)
PAIR = dict(cov_from="pre", cov_to="post")


# -- counts and preprocessing -------------------------------------------------------------------------

@query
def joint_counts(spark, sf):
    return _spread(orders_study(spark, sf).counts(), "counts", PRIORITIES, "c")


@query
def joint_counts_lineitem(spark, sf):
    return _spread(views.lineitem_study(spark, sf).counts(), "counts", views.LINE_STATES, "c")


@query
def joint_counts_events(spark, sf):
    return _spread(views.events_study(spark, sf).counts(), "counts", views.EVENT_TYPES, "c")


@query
def ct_registry(spark, sf):
    return tables.registry(orders_study(spark, sf))


@query
def clone_dictionary(spark, sf):
    return tables.dictionary(views.events_study(spark, sf), CLONE).drop("axis")


@query
def phenotype_levels(spark, sf):
    """Level discovery: sorted distinct labels with codes."""
    from couplet.spec import register_cells
    cells = views.order_cells(spark, sf)
    study = register_cells(cells, clonotype_key="o_custkey", phenotype_key="o_orderpriority", covariate_key="period")
    return tables.dictionary(study, PHENOTYPE).unionByName(tables.dictionary(study, COVARIATE))


@query
def clone_prior(spark, sf):
    return _spread(estimate.clone_prior(orders_study(spark, sf)), "prior", PRIORITIES, "prior")


@query
def clone_size(spark, sf):
    return preprocess.clone_size(orders_study(spark, sf)).select("cell_id", CLONE, "clone_size")


@query
def clone_counts(spark, sf):
    return preprocess.clone_counts(orders_study(spark, sf))


def _customer_orders(spark, sf) -> DataFrame:
    places = views.geography(spark, sf, "c_custkey", "customer", "c_nationkey")
    return views.order_cells(spark, sf).drop("logits").join(places, F.col("o_custkey") == F.col("c_custkey"))


@query
def group_singletons(spark, sf):
    out = preprocess.group_singletons(_customer_orders(spark, sf), clonotype_key="o_custkey", groupby="nation")
    return out.select("o_orderkey", "trb_candidate", "trb_unique")


@query
def scope_clones(spark, sf):
    out = preprocess.scope_clones(_customer_orders(spark, sf), "o_custkey", "nation", "scoped")
    return out.groupBy("scoped").agg(F.count(F.lit(1)).alias("n_cells"))


@query
def union_blocks(spark, sf):
    """Cells of two sources stacked by name, each lacking a column of the other."""
    orders = views.read(spark, sf, "orders").select(F.col("o_custkey").alias(CLONE), F.col("o_orderpriority").alias(PHENOTYPE), "o_totalprice")
    events = views.read(spark, sf, "events").select(F.col("user_id").alias(CLONE), F.col("event_type").alias(PHENOTYPE), "value")
    out = tables.union_cells(orders, events)
    return out.groupBy(PHENOTYPE).agg(F.count(F.lit(1)).alias("n_cells"), F.count("o_totalprice").alias("n_priced"),
                                      F.count("value").alias("n_valued"))


@query
def label_vectors(spark, sf):
    """Dense vectors from label counts, missing labels filled with 0, and their log-sum-exp."""
    rows = views.read(spark, sf, "events").groupBy(F.col("user_id").alias(CLONE), "event_type").agg(F.count(F.lit(1)).alias("n"))
    packed = rows.groupBy(CLONE).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    dense = packed.select(CLONE, vector_from_counts(F.col("m"), views.EVENT_TYPES).alias("v"))
    size = len(views.EVENT_TYPES)
    return _spread(dense.withColumn("lse", log_sum_exp(F.col("v"), size)), "v", views.EVENT_TYPES, "v")


@query
def modal_phenotype(spark, sf):
    return preprocess.modal_phenotype(orders_study(spark, sf)).select(CLONE, "modal_phenotype", "n_modal")


@query
def modal_flags(spark, sf):
    return preprocess.modal_flags(orders_study(spark, sf)).select("cell_id", "modal_phenotype", "is_modal")


@query
def dataset_summary(spark, sf):
    return preprocess.dataset_summary(orders_study(spark, sf))


@query
def clone_rank(spark, sf):
    return preprocess.clone_rank(orders_study(spark, sf))


@query
def largest_share(spark, sf):
    return preprocess.largest_share(orders_study(spark, sf))


@query
def clones_per_group(spark, sf):
    return preprocess.clones_per_group(orders_study(spark, sf))


@query
def disjointness(spark, sf):
    """Clones that span groups: parts are sold by suppliers of many nations, so most do."""
    cells = views.read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    places = views.geography(spark, sf, "s_suppkey", "supplier", "s_nationkey")
    cells = cells.join(places, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("all", F.lit("all"))
    study = register_cells(cells, clonotype_key="l_partkey", phenotype_key="l_returnflag", covariate_key="all",
                           replicate="nation")
    return study.spanning_clones("nation")


@query
def split_constant(spark, sf):
    """Nations and whether their region label is constant, as grouped metrics check it."""
    return orders_study(spark, sf).split_ranges("nation", "region") \
        .select(F.col("grp").alias("nation"), (F.col("lo") == F.col("hi")).alias("is_constant"))


@query
def ct_coverage(spark, sf):
    """Pairs that a posterior of the clones seen before the cut leaves uncovered: the check that imports run."""
    study = orders_study(spark, sf)
    early = study.counts().where("covariate = 'pre'").select(
        CLONE, F.explode(F.array(*[F.lit(c) for c in COVARIATES])).alias(COVARIATE), F.col("counts").alias("p"))
    uncovered = tables.missing_pairs(study.with_posterior(early, local_scale=1.0, check=False))
    return uncovered.select(CLONE, F.lit("pre").alias(COVARIATE))


@query
def presence_flags(spark, sf):
    return metrics.clones_at_both(orders_study(spark, sf), "pre", "post", groupby="nation").withColumnRenamed("grp", "nation")


@query
def clone_set_sizes(spark, sf):
    """Intersection, union and symmetric difference of the clone sets of two levels."""
    flags = metrics.clones_at_both(orders_study(spark, sf), "pre", "post")
    both, either = F.col("at_from") & F.col("at_to"), F.col("at_from") | F.col("at_to")
    return flags.agg(F.count_if(both).alias("n_both"), F.count_if(either).alias("n_either"),
                     F.count_if(~both).alias("n_dropped"))


# -- joint ----------------------------------------------------------------------------------------------

@query
def joint_pair_level(spark, sf):
    """Joint without cell evidence: the fitted pair distribution."""
    return _labelled_joint(joint.joint_table(fitted_orders(spark, sf), use_logits=False))


@query
def joint_pair_level_weighted(spark, sf):
    return _labelled_joint(joint.joint_table(fitted_orders(spark, sf), use_logits=False, weighted=True))


@query
def joint_cell_informed(spark, sf):
    return _labelled_joint(joint.joint_table(fitted_orders(spark, sf)))


@query
def joint_cell_informed_weighted(spark, sf):
    return _labelled_joint(joint.joint_table(fitted_orders(spark, sf), weighted=True))


@query
def joint_tempered(spark, sf):
    return _labelled_joint(joint.joint_table(fitted_orders(spark, sf), temperature=0.5))


@query
def joint_gated(spark, sf):
    return _labelled_joint(joint.joint_table(fitted_orders(spark, sf, gate=0.3)))


@query
def joint_wide(spark, sf):
    """Public wide result, one column per phenotype, for one covariate."""
    return joint.joint_distribution(fitted_orders(spark, sf), covariate="post")["result"]


@query
def joint_long(spark, sf):
    df = joint.joint_table(fitted_orders(spark, sf))
    return joint.long(df, PRIORITIES).drop("draw")


@query
def joint_selected_clones(spark, sf):
    """Joint of the customers of the building segment (a clone list given as a table)."""
    wanted = views.read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return _labelled_joint(joint.joint_table(fitted_orders(spark, sf), clones=wanted))


@query
def joint_draws(spark, sf):
    return _labelled_joint_with_draw(joint.joint_table(fitted_orders(spark, sf), n_samples=DRAWS, random_state=7))


def _labelled_joint_with_draw(df: DataFrame) -> DataFrame:
    return _spread(df, "mass", PRIORITIES, "m")


@query
def joint_pair_draws(spark, sf):
    df = joint.joint_table(fitted_orders(spark, sf), n_samples=DRAWS, use_logits=False, random_state=7)
    return _labelled_joint_with_draw(df)


@query
def joint_draw_average(spark, sf):
    df = joint.joint_table(fitted_orders(spark, sf), n_samples=DRAWS, use_logits=False, random_state=7)
    return _spread(joint.averaged(df, len(PRIORITIES)), "mass", PRIORITIES, "m")


@query
def joint_draws_check(spark, sf):
    """Every pair has all its draws, each on the simplex, and they vary."""
    draws = joint.joint_table(fitted_orders(spark, sf), n_samples=DRAWS, random_state=7)
    whole = F.aggregate("mass", F.lit(0.0), lambda a, x: a + x)
    sound = (F.abs(whole - 1) < 1e-9) & (F.array_min("mass") >= 0)
    seen = F.bit_count(F.bit_or(F.expr("shiftleft(1L, draw)"))).cast("long")         # DRAWS fit 64 bits, so draws need no rows of their own
    outside = F.count_if(~F.col("draw").between(0, 63))
    return draws.groupBy(CLONE, COVARIATE).agg((seen + outside).alias("n_draws"), F.bool_and(sound).alias("on_simplex"),
                                               (F.max(F.col("mass")[0]) > F.min(F.col("mass")[0])).alias("varies"))


@query
def joint_average_check(spark, sf):
    """The mean of 400 draws lies within eight standard errors of the posterior mean, in every entry."""
    study, n = fitted_orders(spark, sf), 400
    mean = joint.averaged(joint.joint_table(study, n_samples=n, use_logits=False, random_state=7), len(PRIORITIES))
    total = F.aggregate("conc", F.lit(0.0), lambda a, x: a + x)
    both = mean.join(study.posterior.select(CLONE, COVARIATE, "p", total.alias("total")), [CLONE, COVARIATE])
    near = F.forall(F.arrays_zip("mass", "p"), lambda x: F.abs(x["mass"] - x["p"])
                    <= 8 * F.sqrt(x["p"] * (1 - x["p"]) / ((F.col("total") + 1) * n)) + 1e-6)
    return both.select(CLONE, COVARIATE, near.alias("near_mean"))


# -- information ------------------------------------------------------------------------------------------

_MI = (COVARIATE, "nation", "value")


@query
def mi_by_group(spark, sf):
    return _value(metrics.mutual_information(orders_study(spark, sf), covariate="pre", normalized=False, **COUNTS), *_MI)


@query
def nmi_min(spark, sf):
    return _value(metrics.mutual_information(orders_study(spark, sf), covariate="pre", **COUNTS), *_MI)


@query
def nmi_average(spark, sf):
    return _value(metrics.mutual_information(orders_study(spark, sf), covariate="post", normalize_mode="average", **COUNTS), *_MI)


@query
def nmi_lineitem(spark, sf):
    return _value(metrics.mutual_information(views.lineitem_study(spark, sf), covariate="pre", **COUNTS), *_MI)


@query
def nmi_events(spark, sf):
    return _value(metrics.mutual_information(views.events_study(spark, sf), covariate="pre", **COUNTS), COVARIATE, "value")


@query
def info_summary(spark, sf):
    counts = orders_study(spark, sf).counts("nation").withColumnRenamed("counts", "mass").withColumnRenamed("grp", "nation")
    return metrics.information_summary(counts, [COVARIATE, "nation"], len(PRIORITIES))


@query
def mi_per_sample(spark, sf):
    return metrics.information_per_sample(orders_study(spark, sf), splitby="region")


@query
def mi_per_arm(spark, sf):
    per_sample = metrics.information_per_sample(orders_study(spark, sf), splitby="region")
    return metrics.information_per_arm(per_sample, "region", COVARIATES)


@query
def mi_model(spark, sf):
    return _value(metrics.mutual_information(fitted_orders(spark, sf), covariate="pre"), *_MI)


@query
def mi_model_weighted(spark, sf):
    return _value(metrics.mutual_information(fitted_orders(spark, sf), covariate="pre", weighted=True), *_MI)


@query
def mi_model_tempered(spark, sf):
    return _value(metrics.mutual_information(fitted_orders(spark, sf), covariate="pre", temperature=0.5, normalize_mode="average"), *_MI)


@query
def mi_stats(spark, sf):
    """Contrast of regions, the replicate being the nation."""
    return metrics.mutual_information(orders_study(spark, sf), covariate="pre", splitby="region", **COUNTS)["stats"]


@query
def mi_stats_model(spark, sf):
    return metrics.mutual_information(fitted_orders(spark, sf), covariate="pre", splitby="region")["stats"]


@query
def clonotypic_entropy(spark, sf):
    out = metrics.clonotypic_entropy(orders_study(spark, sf), covariate="pre", **COUNTS)
    return _value(out, COVARIATE, "nation", PHENOTYPE, "value")


@query
def clonotypic_entropy_ref(spark, sf):
    """A common normaliser across groups: the largest group's clone count."""
    study = orders_study(spark, sf)
    ref = metrics.largest_group_clones(study, "pre")
    out = metrics.clonotypic_entropy(study, covariate="pre", n_clones_ref=ref, **COUNTS)
    return _value(out, COVARIATE, "nation", PHENOTYPE, "value")


@query
def clonotypic_entropy_model(spark, sf):
    out = metrics.clonotypic_entropy(fitted_orders(spark, sf), covariate="post", normalized=False)
    return _value(out, COVARIATE, "nation", PHENOTYPE, "value")


@query
def phenotypic_entropy(spark, sf):
    out = metrics.phenotypic_entropy(orders_study(spark, sf), covariate="pre", **COUNTS)
    return _value(out, COVARIATE, "nation", CLONE, "value")


@query
def phenotypic_entropy_model(spark, sf):
    out = metrics.phenotypic_entropy(fitted_orders(spark, sf), covariate="pre", normalized=False)
    return _value(out, COVARIATE, "nation", CLONE, "value")


@query
def phenotypic_entropy_stats(spark, sf):
    """Items are clones, the unit of the contrast is still the nation."""
    return metrics.phenotypic_entropy(orders_study(spark, sf), covariate="pre", splitby="region", **COUNTS)["stats"]


_FLUX = ("cov_from", "cov_to", "nation", CLONE, "value")


@query
def flux_kl(spark, sf):
    return _value(metrics.phenotypic_flux(orders_study(spark, sf), **PAIR, **COUNTS), *_FLUX)


@query
def flux_l1(spark, sf):
    return _value(metrics.phenotypic_flux(orders_study(spark, sf), distance_metric="l1", **PAIR, **COUNTS), *_FLUX)


@query
def flux_jsd(spark, sf):
    return _value(metrics.phenotypic_flux(orders_study(spark, sf), distance_metric="jsd", **PAIR, **COUNTS), *_FLUX)


@query
def flux_custom(spark, sf):
    """A user distance as an Arrow-batched Python function: half the squared difference."""
    half_square = lambda p, q: float(0.5 * np.square(p - q).sum())
    return _value(metrics.phenotypic_flux(orders_study(spark, sf), distance_metric=half_square, **PAIR, **COUNTS), *_FLUX)


@query
def flux_model(spark, sf):
    return _value(metrics.phenotypic_flux(fitted_orders(spark, sf), **PAIR), *_FLUX)


@query
def flux_self(spark, sf):
    """Flux of a level against itself on shared draws: 0 for every clone."""
    out = metrics.phenotypic_flux(fitted_orders(spark, sf), cov_from="pre", cov_to="pre", n_samples=10)
    return out["table"].select(CLONE, "draw", "value").groupBy(CLONE).agg(
        F.max(F.abs("value")).alias("largest"), F.count(F.lit(1)).alias("n_draws"))


_DELTA = ("cov_from", "cov_to", "nation")
_ENDS = ("value", "value_from", "value_to")


@query
def delta_clonotypic(spark, sf):
    out = metrics.delta_clonotypic_entropy(orders_study(spark, sf), **PAIR, **COUNTS)
    return _value(out, *_DELTA, PHENOTYPE, *_ENDS)


@query
def delta_phenotypic(spark, sf):
    out = metrics.delta_phenotypic_entropy(orders_study(spark, sf), **PAIR, **COUNTS)
    return _value(out, *_DELTA, CLONE, *_ENDS)


@query
def delta_clonotypic_model(spark, sf):
    out = metrics.delta_clonotypic_entropy(fitted_orders(spark, sf), **PAIR)
    return _value(out, *_DELTA, PHENOTYPE, *_ENDS)


@query
def delta_phenotypic_model(spark, sf):
    out = metrics.delta_phenotypic_entropy(fitted_orders(spark, sf), **PAIR)
    return _value(out, *_DELTA, CLONE, *_ENDS)


@query
def delta_phenotypic_stats(spark, sf):
    return metrics.delta_phenotypic_entropy(orders_study(spark, sf), splitby="region", **PAIR, **COUNTS)["stats"]


def _drawn(metric, **options) -> Query:
    return lambda spark, sf: metric(fitted_orders(spark, sf), n_samples=DRAWS, random_state=11, **options)["result"]


for _name, _metric, _options in [
    ("mi_draws", metrics.mutual_information, dict(covariate="pre")),
    ("clonotypic_entropy_draws", metrics.clonotypic_entropy, dict(covariate="pre")),
    ("phenotypic_entropy_draws", metrics.phenotypic_entropy, dict(covariate="pre")),
    ("flux_draws", metrics.phenotypic_flux, PAIR),
    ("delta_clonotypic_draws", metrics.delta_clonotypic_entropy, PAIR),
    ("delta_phenotypic_draws", metrics.delta_phenotypic_entropy, PAIR),
]:
    _run = _drawn(_metric, **_options)
    _run.__name__ = _name
    query(_run)


@query
def mi_draws_stats(spark, sf):
    out = metrics.mutual_information(fitted_orders(spark, sf), covariate="pre", splitby="region", n_samples=DRAWS, random_state=11)
    return out["stats"]


# -- summaries and statistics -----------------------------------------------------------------------------

@query
def across_groups(spark, sf):
    per_sample = metrics.information_per_sample(orders_study(spark, sf), splitby="region")
    return summarise.across_groups(per_sample, [COVARIATE, "region"], "empirical_nmi_min")


@query
def across_all_groups(spark, sf):
    per_sample = metrics.information_per_sample(orders_study(spark, sf), splitby="region")
    return summarise.across_groups(per_sample, [], "empirical_mi")


@query
def contrast_less(spark, sf):
    """One-sided contrast of every region against a reference."""
    per_sample = metrics.information_per_sample(orders_study(spark, sf), splitby="region").where("covariate = 'pre'")
    return summarise.compare_groups(per_sample, value="empirical_mi", splitby="region", reference="ASIA", alternative="less")


@query
def contrast_orders(spark, sf):
    """Large-sample contrasts with many ties: line quantities by return flag."""
    rows = views.read(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    return summarise.compare_groups(rows, value="l_quantity", splitby="l_returnflag").drop("p", "stars")


@query
def contrast_orders_p(spark, sf):
    """The same contrasts with their tie-corrected normal p-values."""
    rows = views.read(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    return summarise.compare_groups(rows, value="l_quantity", splitby="l_returnflag").select("level_a", "level_b", "p", "stars")


@query
def contrast_paired(spark, sf):
    """Paired contrast of the two periods over nations."""
    per_sample = metrics.information_per_sample(orders_study(spark, sf)).withColumn("draw", F.lit(0))
    return summarise.compare_paired(per_sample, splitby=COVARIATE, pair_on="nation", value="empirical_mi")


@query
def collapse_replicates(spark, sf):
    out = metrics.phenotypic_entropy(orders_study(spark, sf), covariate="pre", **COUNTS)
    return frames.points(out["result"], groupby="nation", keep=[COVARIATE])


@query
def draw_summary(spark, sf):
    """Mean, sd and HDI of short value arrays: order totals per customer."""
    rows = views.read(spark, sf, "orders").select(F.col("o_custkey").alias(CLONE), (F.col("o_totalprice") / 970.0).alias("value"))
    return summarise.summarise_draws(rows, [CLONE])


@query
def hdi_totalprice(spark, sf):
    """Exact HDI of large groups: order totals per nation."""
    rows = views.read(spark, sf, "orders").join(
        views.geography(spark, sf, "c_custkey", "customer", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return ranks.exact_hdi(rows, "o_totalprice", ["nation"])


@query
def quantiles_quantity(spark, sf):
    """Exact quantiles of a heavily tied column per line state."""
    rows = views.read(spark, sf, "lineitem")
    return ranks.exact_quantiles(rows, "l_quantity", ["l_returnflag"], (0.025, 0.5, 0.975), ("q_low", "median", "q_high"))


@query
def auc_documents(spark, sf):
    return auc.auroc(views.scored_documents(spark, sf), "n_chars", "quality")


@query
def auc_permutation(spark, sf):
    return auc.auc_and_label_permutation(views.scored_documents(spark, sf), "n_chars", "quality")["result"]


@query
def auc_bootstrap(spark, sf):
    return auc.bootstrap_auc(views.scored_documents(spark, sf), "n_chars", "quality")


@query
def auc_permutation_check(spark, sf):
    """The permuted AUROCs have the mean and the tie-corrected variance of the label-permutation law."""
    docs = views.scored_documents(spark, sf)
    out = auc.auc_and_label_permutation(docs, "n_chars", "quality")
    sizes = docs.groupBy("n_chars").agg(F.count(F.lit(1)).cast("double").alias("t"), F.sum("quality").alias("pos"))
    law = sizes.agg(F.sum("t").alias("n"), F.sum("pos").cast("double").alias("pos"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    expected = (F.col("n") + 1 - F.col("ties") / (F.col("n") * (F.col("n") - 1))) / (12 * F.col("pos") * (F.col("n") - F.col("pos")))
    expected = law.select(expected.alias("e")).first()["e"]
    drawn = out["perm_stats"].agg(F.avg("auc").alias("mean"), F.var_samp("auc").alias("var")).first()
    mean_ok = abs(drawn["mean"] - 0.5) < 6 * (expected / 200_000) ** 0.5
    return out["result"].select("auc", "mode", "n_pos", "n_neg", "n_stats", F.col("p").between(0, 1).alias("p_in_range"),
                                F.lit(mean_ok).alias("mean_ok"), F.lit(abs(drawn["var"] / expected - 1) < 0.03).alias("variance_ok"))


@query
def auc_bootstrap_check(spark, sf):
    """The bootstrap interval holds the observed AUROC; all resamples hold both classes."""
    out = auc.bootstrap_auc(views.scored_documents(spark, sf), "n_chars", "quality")
    return out.select("auc", "n_boot", F.col("auc").between(F.col("ci_low"), F.col("ci_high")).alias("holds_auc"))


# -- estimation and evidence --------------------------------------------------------------------------------

@query
def shrink_p_ct(spark, sf):
    fitted = estimate.shrink_posterior(orders_study(spark, sf))
    return _spread(_spread(fitted, "p", PRIORITIES, "p"), "conc", PRIORITIES, "conc")


# Two example archetypes over the five priorities.
TWO_ARCHETYPES = [[0.4, 0.3, 0.1, 0.1, 0.1], [0.1, 0.1, 0.2, 0.3, 0.3]]


@query
def shrink_two_archetypes(spark, sf):
    fitted = estimate.shrink_posterior(orders_study(spark, sf), archetypes=np.array(TWO_ARCHETYPES), local_scale=4.3)
    return _spread(fitted.drop("conc"), "p", PRIORITIES, "p")


@query
def archetypes(spark, sf):
    study = orders_study(spark, sf)
    return _spread(estimate.ordered_archetypes(study, k=4)["centroids"], "center", PRIORITIES, "center")


@query
def ordered_prior(spark, sf):
    """The clone priors behind the ordered heat map."""
    return _spread(estimate.ordered_archetypes(orders_study(spark, sf), k=4)["priors"].drop("archetype"), "prior", PRIORITIES, "pr")


@query
def archetype_assign(spark, sf):
    _, labelled = estimate.build_archetypes(orders_study(spark, sf), k=4)
    return labelled.select(CLONE, "archetype")


@query
def shrink_fitted_archetypes(spark, sf):
    study = estimate.fit_posterior(orders_study(spark, sf), n_archetypes=3)
    return _spread(study.posterior.drop("conc"), "p", PRIORITIES, "p")


@query
def sharpen_posterior(spark, sf):
    study = fitted_orders(spark, sf)
    out = estimate.sharpen(study.posterior, len(PRIORITIES), 0.6)
    return _spread(_spread(out, "p", PRIORITIES, "p"), "conc", PRIORITIES, "conc")


@query
def temper_table(spark, sf):
    prior = estimate.clone_prior(orders_study(spark, sf))
    return _spread(prior.select(CLONE, temper_power(F.col("prior"), len(PRIORITIES), 0.7).alias("t")), "t", PRIORITIES, "t")


@query
def temper_clone_prior(spark, sf):
    prior = estimate.clone_prior(orders_study(spark, sf))
    return _spread(prior.select(CLONE, temper_prior(F.col("prior"), len(PRIORITIES), 2.0).alias("t")), "t", PRIORITIES, "t")


@query
def log_gamma_sizes(spark, sf):
    return preprocess.clone_counts(orders_study(spark, sf)).select(CLONE, log_gamma(F.col("clone_size") + 0.25).alias("lg"))


@query
def pairwise_distances(spark, sf):
    """All three distances between a clone's two fitted distributions."""
    posterior = fitted_orders(spark, sf).posterior
    pre = posterior.where("covariate = 'pre'").select(CLONE, F.col("p").alias("a"))
    both = pre.join(posterior.where("covariate = 'post'").select(CLONE, F.col("p").alias("b")), CLONE)
    a, b, n = F.col("a"), F.col("b"), len(PRIORITIES)
    return both.select(CLONE, kl_divergence(a, b, n).alias("kl"), l1_distance(a, b, n).alias("l1"), jensen_shannon(a, b, n).alias("jsd"))


@query
def predict_cells(spark, sf):
    scored = evidence.hard_labels(evidence.predict(fitted_orders(spark, sf)), PRIORITIES)
    return _spread(scored.select("cell_id", "predicted", "probs"), "probs", PRIORITIES, "q")


@query
def predict_gated(spark, sf):
    scored = evidence.predict(fitted_orders(spark, sf, gate=0.7))
    return _spread(scored.select("cell_id", "probs"), "probs", PRIORITIES, "q")


@query
def log_posterior(spark, sf):
    out = evidence.log_posterior(fitted_orders(spark, sf))
    return _spread(out.select("cell_id", "log_posterior"), "log_posterior", PRIORITIES, "lp")


@query
def evidence_summary(spark, sf):
    return evidence.evidence_summary(fitted_orders(spark, sf))


@query
def label_agreement(spark, sf):
    return evidence.label_agreement(fitted_orders(spark, sf))


@query
def latent_representation(spark, sf):
    out = evidence.latent_representation(views.embedding_cells(spark, sf), k=5)
    return _spread(out, "latent", range(5), "z")


@query
def latent_norms(spark, sf):
    """With as many axes as features the embedding is a rotation: it keeps every cell's squared length."""
    cells = views.embedding_cells(spark, sf)
    width = cells.select(F.size("features")).first()[0]
    out = evidence.latent_representation(cells, k=width)
    return out.select("cell_id", F.round(F.aggregate("latent", F.lit(0.0), lambda a, x: a + x * x), 5).alias("squared"))


@query
def phenotype_logits(spark, sf):
    cells = evidence.latent_representation(views.embedding_cells(spark, sf), k=8)
    levels = [str(i) for i in range(10)]
    return _spread(evidence.phenotype_logits(cells, levels).select("cell_id", "logits"), "logits", levels, "l")


@query
def cluster_nmi(spark, sf):
    cells = views.embedding_cells(spark, sf)
    kmeans = evidence.cluster_nmi(cells, k=6)
    return kmeans


@query
def cluster_nmi_mixture(spark, sf):
    return evidence.cluster_nmi(views.embedding_cells(spark, sf), k=4, method="gmm")


# -- diagnostics -----------------------------------------------------------------------------------------------

@query
def joint_ppc(spark, sf):
    return diagnose.joint_distribution_ppc(fitted_orders(spark, sf))["table"]


@query
def joint_ppc_per_covariate(spark, sf):
    return diagnose.joint_distribution_ppc(fitted_orders(spark, sf), distance_metric="jsd")["per_covariate"]


def _scored_orders(spark, sf) -> DataFrame:
    return evidence.predict(fitted_orders(spark, sf))


@query
def calibration(spark, sf):
    return diagnose.phenotype_calibration(_scored_orders(spark, sf), PRIORITIES)["table"]


@query
def calibration_error(spark, sf):
    return diagnose.phenotype_calibration(_scored_orders(spark, sf), PRIORITIES, n_bins=15)["ece"]


@query
def count_table_compare(spark, sf):
    observed, other = views.line_counts(spark, sf)
    return diagnose.compare_count_tables(observed, other, sim=None)


@query
def permutation_null(spark, sf):
    return diagnose.permutation_null(orders_study(spark, sf), groupby="nation", random_state=3)


@query
def permutation_null_check(spark, sf):
    """p-values are counts over the permutations plus one, and every null varies around a positive mean."""
    out = diagnose.permutation_null(orders_study(spark, sf), groupby="nation", random_state=3)
    steps = F.col("p") * 1001
    return out.select(COVARIATE, "nation", (F.abs(steps - F.round(steps)) < 1e-6).alias("counts"),
                      (steps >= 1 - 1e-6).alias("plus_one"), ((F.col("null_mean") > 0) & (F.col("null_sd") > 0)).alias("varies"))


@query
def permutation_null_observed(spark, sf):
    out = diagnose.permutation_null(orders_study(spark, sf), n_perm=100, random_state=3, normalize_mode="average")
    return out.select(COVARIATE, "observed")


@query
def estimator_errors(spark, sf):
    """Model estimates of MI against the empirical values, per region."""
    study = fitted_orders(spark, sf)
    estimate_ = metrics.mutual_information(study, covariate="pre", weighted=True, splitby="region")["result"]
    truth = metrics.information_per_sample(study, groupby="nation").where("covariate = 'pre'")
    both = estimate_.join(truth.select("nation", F.col("empirical_nmi_min").alias("population")), "nation")
    both = both.withColumns({"realised": F.col("population"), "hdi_low": F.col("value") * 0.5, "hdi_high": F.col("value") * 2})
    return diagnose.estimator_errors(both, ["region"])


@query
def plot_endpoints(spark, sf):
    out = metrics.delta_phenotypic_entropy(orders_study(spark, sf), splitby="region", **PAIR, **COUNTS)
    return frames.endpoints(out["result"], "nation", "region")


@query
def plot_matched_clones(spark, sf):
    out = metrics.phenotypic_flux(orders_study(spark, sf), **PAIR, **COUNTS)
    return frames.matched_clones(out["result"], "nation")


@query
def plot_order(spark, sf):
    out = metrics.clonotypic_entropy(orders_study(spark, sf), covariate="pre", **COUNTS)
    return frames.order_by_median(out["result"], PHENOTYPE)


@query
def plot_contrast_label(spark, sf):
    stats = metrics.mutual_information(orders_study(spark, sf), covariate="pre", splitby="region", **COUNTS)["stats"]
    return frames.contrast_label(stats, "EUROPE", "ASIA")


# -- storage ---------------------------------------------------------------------------------------------------

@query
def stored_result(spark, sf):
    """Computed, written, and read back through the accessor."""
    target = store.ResultStore(spark, f"{stage_folder(spark)}/couplet-results-{uuid.uuid4().hex}")
    metrics.mutual_information(orders_study(spark, sf), covariate="pre", store=target, **COUNTS)
    return store.mutual_information(target).select(*_MI)


@query
def stored_joint(spark, sf):
    """The wide joint, written and read back."""
    target = store.ResultStore(spark, f"{stage_folder(spark)}/couplet-results-{uuid.uuid4().hex}")
    joint.joint_distribution(fitted_orders(spark, sf), covariate="post", store=target)
    return store.joint_distribution(target)


@query
def session_round_trip(spark, sf):
    """Study saved and restored; the restored one is scored."""
    path = f"{stage_folder(spark)}/couplet-session-{uuid.uuid4().hex}"
    session.save_session(fitted_orders(spark, sf), path)
    return _value(metrics.mutual_information(session.load_session(spark, path), covariate="post"), *_MI)


@query
def export_evidence(spark, sf):
    out = tables.export_tables(fitted_orders(spark, sf))["evidence"]
    return _spread(out.select("cell_id", "predicted", "log_posterior"), "log_posterior", PRIORITIES, "lp")


@query
def imported_posterior(spark, sf):
    """A posterior written by someone else, read back, checked, and used."""
    study = fitted_orders(spark, sf)
    path = f"{stage_folder(spark)}/couplet-import-{uuid.uuid4().hex}"
    study.posterior.write.parquet(path)
    imported = tables.import_posterior(orders_study(spark, sf), path, local_scale=3.0)
    return _value(metrics.mutual_information(imported, covariate="pre"), *_MI)

"""Wall-clock of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default the sf0.1 tables), ``BENCH_CPUS`` (default 8) and ``BENCH_REPEATS``
(default 3, the median counts). Every run starts from the parquet tables.
"""

from __future__ import annotations

import contextlib
import json
import os
import statistics
import sys
import time
import warnings

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession

PAIR = dict(cov_from="pre", cov_to="post")


def headline():
    from couplet.operators import auc, diagnose, metrics, preprocess
    from couplet.plans import views
    from couplet.plans.queries import COUNTS, registry

    known = registry()

    def counts(metric, **options):
        return lambda s, d: metric(views.orders_study(s, d), **options, **COUNTS)["result"]

    def draws(metric, **options):
        return lambda s, d: metric(views.fitted_orders(s, d), n_samples=100, random_state=1, **options)["result"]

    return {
        "joint_counts": known["joint_counts"],
        "dataset_summary": known["dataset_summary"],
        "clone_size": lambda s, d: preprocess.clone_size(views.orders_study(s, d)),
        "group_singletons": known["group_singletons"],
        "mutual_information": counts(metrics.mutual_information, covariate="pre"),
        "clonotypic_entropy": counts(metrics.clonotypic_entropy, covariate="pre"),
        "phenotypic_entropy": counts(metrics.phenotypic_entropy, covariate="pre"),
        "phenotypic_flux": counts(metrics.phenotypic_flux, **PAIR),
        "delta_clonotypic_entropy": counts(metrics.delta_clonotypic_entropy, **PAIR),
        "delta_phenotypic_entropy": counts(metrics.delta_phenotypic_entropy, **PAIR),
        "mutual_information_stats": known["mi_stats"],
        "joint_cell_informed": known["joint_cell_informed"],
        "mutual_information_model": known["mi_model"],
        "predict": known["predict_cells"],
        "mutual_information_100_draws": draws(metrics.mutual_information, covariate="pre"),
        "phenotypic_entropy_100_draws": draws(metrics.phenotypic_entropy, covariate="pre"),
        "phenotypic_flux_100_draws": draws(metrics.phenotypic_flux, **PAIR),
        "permutation_null_1000": lambda s, d: diagnose.permutation_null(
            views.orders_study(s, d), groupby="nation", n_perm=1000, random_state=1),
        "auc_permutation_200k": lambda s, d: auc.auc_and_label_permutation(
            views.scored_documents(s, d), "n_chars", "quality")["result"],
        "hdi_large_groups": known["hdi_totalprice"],
    }


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    warnings.simplefilter("ignore")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    with contextlib.redirect_stdout(sys.stderr):
        spark = (
            SparkSession.builder.master(f"local[{cpus}]").appName("couplet-bench")
            .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        wanted = sys.argv[1:]
        chosen = {n: q for n, q in headline().items() if not wanted or n in wanted}
        consume(next(iter(chosen.values()))(spark, sf_dir))        # JVM warm-up
        seconds: dict[str, float] = {}
        for name, run in chosen.items():
            taken = []
            for _ in range(repeats):
                start = time.perf_counter()
                consume(run(spark, sf_dir))
                taken.append(time.perf_counter() - start)
            seconds[name] = round(statistics.median(taken), 3)
            print(name, [round(t, 2) for t in taken], file=sys.stderr, flush=True)
        spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus), "repeats": repeats}))


if __name__ == "__main__":
    main()

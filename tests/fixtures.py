"""Small random studies with ragged clones, and plain-Python references for the formulas."""

from __future__ import annotations

import numpy as np

from couplet.operators.estimate import fit_posterior
from couplet.spec import register_cells

PHENOTYPES = ["p0", "p1", "p2", "p3"]
COVARIATES = ["t0", "t1"]


def cell_rows(seed: int = 0, n_patients: int = 6, cells: int = 120, clones: int = 8, phenotypes=PHENOTYPES):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(n_patients):
        preferred = rng.integers(0, len(phenotypes), clones)
        for i in range(cells):
            c = int(rng.zipf(1.6)) % clones
            j = preferred[c] if rng.random() < 0.6 else rng.integers(0, len(phenotypes))
            t = COVARIATES[int(rng.random() < 0.5)]
            logits = rng.normal(size=len(phenotypes)) + 2.0 * (np.arange(len(phenotypes)) == j)
            rows.append((f"{p}-{i}", f"c{c}@{p}", phenotypes[j], t, f"P{p}", "R" if p % 2 else "NR",
                         [float(x) for x in logits]))
    return rows


SCHEMA = ("id string, clone string, pheno string, time string, patient string, response string, "
          "logits array<double>")


def study(spark, rows=None, phenotypes=PHENOTYPES, covariates=COVARIATES, gate=None, fit=False, **options):
    df = spark.createDataFrame(rows if rows is not None else cell_rows(), SCHEMA)
    out = register_cells(df, clonotype_key="clone", phenotype_key="pheno", covariate_key="time", cell_id_key="id",
                         replicate=options.pop("replicate", "patient"), phenotype_levels=list(phenotypes),
                         covariate_levels=list(covariates), **options).with_evidence(gate=gate)
    return fit_posterior(out) if fit else out


def crosstab(rows, covariate, patient=None, phenotypes=PHENOTYPES):
    table: dict[str, np.ndarray] = {}
    for _, c, ph, t, p, _, _ in rows:
        if t == covariate and (patient is None or p == patient):
            table.setdefault(c, np.zeros(len(phenotypes)))[phenotypes.index(ph)] += 1
    return table


def entropy(v):
    v = np.asarray(v, float)
    v = v[v > 0] / v.sum()
    return float(-(v * np.log2(v)).sum())


def information(joint):
    joint = np.asarray(joint, float)
    return entropy(joint.sum(1)) + entropy(joint.sum(0)) - entropy(joint.ravel())


def fitted(rows, phenotypes=PHENOTYPES):
    """Closed-form posterior with one uniform archetype: ``{(clone, covariate): (p, conc)}``."""
    size = len(phenotypes)
    pooled: dict[str, np.ndarray] = {}
    pair: dict[tuple, np.ndarray] = {}
    for _, c, ph, t, *_ in rows:
        j = phenotypes.index(ph)
        pooled.setdefault(c, np.zeros(size))[j] += 1
        pair.setdefault((c, t), np.zeros(size))[j] += 1
    out = {}
    for (c, t), n in pair.items():
        omega = (5.0 / size + pooled[c]) / (5.0 + pooled[c].sum())
        conc = 3.0 * omega + n
        out[c, t] = (conc / conc.sum(), conc)
    return out


def model_joint(rows, temperature=1.0, gate=None, weighted=False, phenotypes=PHENOTYPES):
    """Cell-informed joint ``{(clone, covariate): vector}`` by an explicit loop over cells."""
    fit = fitted(rows, phenotypes)
    out: dict[tuple, np.ndarray] = {}
    for _, c, _, t, _, _, logits in rows:
        p = fit[c, t][0]
        if temperature != 1.0:
            y = np.log(p + 1e-8) / temperature
            p = np.exp(y - y.max())
            p /= p.sum()
        x = np.log(p + 1e-8)
        x = np.asarray(logits) + x if gate is None else gate * np.asarray(logits) + (1 - gate) * x
        x = x / temperature
        q = np.exp(x - x.max())
        out[c, t] = out.get((c, t), 0) + q / q.sum()
    return out if weighted else {k: v / max(v.sum(), 1e-8) for k, v in out.items()}

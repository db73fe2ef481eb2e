"""Equivalent ANSI SQL of the registered queries, written from the definitions, not from the plans."""

from __future__ import annotations

from couplet.plans.queries import TWO_ARCHETYPES
from couplet.plans.views import EVENT_TYPES, PRIORITIES

R = 8  # digits, as in the queries

_LEVELS = ", ".join(f"({j}, '{x}')" for j, x in enumerate(PRIORITIES))

CELLS = """
cells AS (
  SELECT o_orderkey AS cell_id, o_custkey AS clonotype, o_orderpriority AS phenotype,
         CASE WHEN o_orderdate < TIMESTAMP '1998-04-01' THEN 'pre' ELSE 'post' END AS covariate,
         n_name AS nation, r_name AS region
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

LINE_CELLS = """
cells AS (
  SELECT l_suppkey AS clonotype, l_returnflag || l_linestatus AS phenotype,
         CASE WHEN l_shipdate < TIMESTAMP '1998-04-01' THEN 'pre' ELSE 'post' END AS covariate,
         n_name AS nation, r_name AS region
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

EVENT_CELLS = """
cells AS (
  SELECT event_id AS cell_id, user_id AS clonotype, event_type AS phenotype,
         CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'pre' ELSE 'post' END AS covariate,
         'all' AS nation, 'all' AS region
  FROM events)"""

_LEVELS_CTE = f"levels(j, phenotype) AS (VALUES {_LEVELS})"
_OWN_LEVELS = """levels AS (
  SELECT phenotype, row_number() OVER (ORDER BY phenotype) - 1 AS j FROM (SELECT DISTINCT phenotype FROM cells))"""

CT = """
pairs AS (SELECT clonotype, covariate, nation, region, count(*) AS n_cells FROM cells GROUP BY ALL),
tally AS (SELECT clonotype, covariate, phenotype, count(*) AS n FROM cells GROUP BY ALL),
ct AS (
  SELECT pairs.*, levels.j, levels.phenotype, coalesce(tally.n, 0) AS n
  FROM pairs CROSS JOIN levels
  LEFT JOIN tally ON tally.clonotype = pairs.clonotype AND tally.covariate = pairs.covariate
                 AND tally.phenotype = levels.phenotype)"""

FIT = """
pooled AS (SELECT clonotype, j, sum(n) AS n FROM ct GROUP BY ALL),
omega AS (SELECT clonotype, j, (1 + n) / (5.0 + sum(n) OVER (PARTITION BY clonotype)) AS w FROM pooled),
conc AS (SELECT ct.*, 3.0 * w + ct.n AS conc FROM ct JOIN omega USING (clonotype, j)),
fit AS (SELECT *, conc / sum(conc) OVER (PARTITION BY clonotype, covariate) AS p FROM conc)"""


def _with(*parts: str, cells: str = CELLS, levels: str = _LEVELS_CTE) -> str:
    return "WITH " + ",\n".join([cells.strip(), levels, *[p.strip() for p in parts]]) + "\n"


def _model(temperature: float = 1.0, gate: float | None = None, unit_rows: bool = True) -> tuple[str, ...]:
    """CTEs down to ``probs`` (per cell) and ``joint(clonotype, covariate, nation, region, j, phenotype, m)``."""
    t = temperature
    if t == 1.0:
        base = "base AS (SELECT *, p AS b FROM fit)"
    else:
        base = f"""shifted AS (SELECT *, ln(p + 1e-8) / {t} AS y FROM fit),
risen AS (SELECT *, exp(y - max(y) OVER (PARTITION BY clonotype, covariate)) AS e FROM shifted),
base AS (SELECT * EXCLUDE (y, e), e / sum(e) OVER (PARTITION BY clonotype, covariate) AS b FROM risen)"""
    lw, bw = (1.0, 1.0) if gate is None else (gate, 1.0 - gate)
    scored = f"""scored AS (
  SELECT c.cell_id, c.clonotype, c.covariate, c.nation, c.region, c.phenotype AS observed, base.j,
         base.phenotype AS level, base.p,
         ({lw} * (((c.cell_id * (base.j + 3) + base.j * base.j) % 11) * 2 / 11.0
                  + CASE WHEN c.phenotype = base.phenotype THEN 1.0 ELSE 0.0 END)
          + {bw} * ln(base.b + 1e-8)) / {t} AS x
  FROM cells c JOIN base ON base.clonotype = c.clonotype AND base.covariate = c.covariate)"""
    probs = """lifted AS (SELECT *, exp(x - max(x) OVER (PARTITION BY cell_id)) AS e FROM scored),
probs AS (SELECT *, e / sum(e) OVER (PARTITION BY cell_id) AS q FROM lifted)"""
    raw = """raw AS (SELECT clonotype, covariate, nation, region, j, level AS phenotype, sum(q) AS m FROM probs GROUP BY ALL)"""
    scaled = "m / greatest(sum(m) OVER (PARTITION BY clonotype, covariate), 1e-8)" if unit_rows else "m"
    joint = f"joint AS (SELECT * EXCLUDE (m), {scaled} AS m FROM raw)"
    return CT, FIT, base, scored, probs, raw, joint


COUNT_JOINT = "joint AS (SELECT clonotype, covariate, nation, region, j, phenotype, CAST(n AS DOUBLE) AS m FROM ct)"


def _slots(value: str, prefix: str, size: int = 5, agg: str = "max") -> str:
    return ", ".join(f"round({agg}(CASE WHEN j = {j} THEN {value} END), {R}) AS {prefix}_{j}" for j in range(size))


def _counted(size: int = 5) -> str:
    return ", ".join(f"round(CAST(max(CASE WHEN j = {j} THEN n END) AS DOUBLE), {R}) AS c_{j}" for j in range(size))


def _info(keys: str, where: str = "TRUE", joint: str = "joint", name: str = "info") -> str:
    """CTE ``name(keys, mi, h_clone, h_phenotype, nmi_min, nmi_average)`` by the defining sums."""
    on = " AND ".join(f"r.{k} = a.{k} AND c.{k} = a.{k} AND t.{k} = a.{k}" for k in keys.split(", "))
    a_keys = ", ".join(f"a.{k}" for k in keys.split(", "))

    def entropy(part: str) -> str:
        return f"""SELECT {keys}, -sum(CASE WHEN m > 0 THEN m / s * log2(m / s) ELSE 0 END) AS h
                   FROM {part} JOIN {name}_tot USING ({keys}) GROUP BY {keys}"""

    return f"""
{name}_part AS (SELECT {keys}, clonotype, j, m FROM {joint} WHERE {where}),
{name}_tot AS (SELECT {keys}, sum(m) AS s FROM {name}_part GROUP BY {keys}),
{name}_rows AS (SELECT {keys}, clonotype, sum(m) AS m FROM {name}_part GROUP BY {keys}, clonotype),
{name}_cols AS (SELECT {keys}, j, sum(m) AS m FROM {name}_part GROUP BY {keys}, j),
{name}_mi AS (
  SELECT {a_keys}, sum(a.m / t.s * log2((a.m / t.s) / ((r.m / t.s) * (c.m / t.s)))) AS mi
  FROM {name}_part a JOIN {name}_rows r ON r.clonotype = a.clonotype JOIN {name}_cols c ON c.j = a.j JOIN {name}_tot t ON TRUE
  WHERE a.m > 0 AND {on} GROUP BY {a_keys}),
{name}_hc AS ({entropy(f"{name}_rows")}),
{name}_hp AS ({entropy(f"{name}_cols")}),
{name} AS (
  SELECT {keys}, greatest(mi, 0) AS mi, x.h AS h_clone, y.h AS h_phenotype,
         CASE WHEN least(x.h, y.h) > 1e-12 THEN greatest(mi, 0) / least(x.h, y.h) ELSE 0 END AS nmi_min,
         CASE WHEN x.h + y.h > 1e-12 THEN greatest(mi, 0) / (0.5 * (x.h + y.h)) ELSE 0 END AS nmi_average
  FROM {name}_mi JOIN {name}_hc x USING ({keys}) JOIN {name}_hp y USING ({keys}))"""


def _mi(value: str, covariate: str, *ctes: str, nation: bool = True, **options) -> str:
    keys = "nation" if nation else "covariate"
    label = "nation, " if nation else ""
    return _with(*ctes, _info(keys, f"covariate = '{covariate}'"), **options) + \
        f"SELECT '{covariate}' AS covariate, {label}round({value}, {R}) AS value FROM info"


# Number of orderings per U for five against five values.
_U_WAYS = [1, 1, 2, 3, 5, 7, 9, 11, 14, 16, 18, 19, 20, 20, 19, 18, 16, 14, 11, 9, 7, 5, 3, 2, 1, 1]


def _tail(u: str) -> str:
    ways = "[" + ", ".join(map(str, _U_WAYS)) + "]"
    return f"list_sum(list_slice({ways}, CAST({u} AS BIGINT) + 1, 26)) / 252.0"


_STARS = "CASE WHEN p < 1e-4 THEN '****' WHEN p < 1e-3 THEN '***' WHEN p < 1e-2 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END"


def _stats(per_group: str) -> str:
    """Contrast of regions over ``per_group(nation, region, value)`` (five against five, no ties)."""
    arm = lambda s: ", ".join(f"round({s}.{c}, {R}) AS {c}_{s}" for c in ("mean", "sd", "ci_low", "ci_high")) + f", {s}.n AS n_{s}"
    return f"""
unit AS ({per_group}),
arm AS (SELECT region, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS ci_low,
               quantile_cont(value, 0.975) AS ci_high, count(value) AS n FROM unit GROUP BY region),
duel AS (SELECT x.region AS level_a, y.region AS level_b,
                sum(CASE WHEN x.value > y.value THEN 1.0 WHEN x.value = y.value THEN 0.5 ELSE 0.0 END) AS u
         FROM unit x JOIN unit y ON x.region < y.region GROUP BY ALL),
test AS (SELECT *, least(1.0, 2 * {_tail('greatest(u, 25 - u)')}) AS p FROM duel)
SELECT level_a || ' vs ' || level_b AS region, level_a, level_b, 'nation' AS replicate_unit, {arm('a')}, {arm('b')},
       round(b.mean - a.mean, {R}) AS delta, u AS stat, round(p, {R}) AS p, {_STARS} AS stars
FROM test JOIN arm a ON a.region = level_a JOIN arm b ON b.region = level_b"""


def _entropy_c(where: str, value: str) -> str:
    """Clonotypic entropy per nation and phenotype; ``value`` uses h (bits) and c (supported clones)."""
    return f"""
support AS (SELECT nation, phenotype, m, sum(m) OVER (PARTITION BY nation, phenotype) AS s FROM joint WHERE {where} AND m > 0),
ent AS (SELECT nation, phenotype, -sum(m / s * log2(m / s)) AS h, count(*) AS c FROM support GROUP BY ALL),
ent_value AS (SELECT nation, phenotype, abs({value}) AS value FROM ent)"""


_BY_SUPPORT = "CASE WHEN c > 1 THEN h / log2(c) ELSE h END"


def _entropy_p(normalized: bool) -> str:
    scale = " / log2(5)" if normalized else ""
    return f"""
share AS (SELECT *, m / sum(m) OVER (PARTITION BY clonotype, covariate) AS q FROM joint),
ent AS (SELECT clonotype, covariate, nation, region, abs(sum(CASE WHEN q > 0 THEN -q * log2(q) ELSE 0 END){scale}) AS h
        FROM share GROUP BY ALL)"""


def _flux(expression: str) -> str:
    """Distance over the clip-and-rescale pair ``a`` (pre), ``b`` (post) per clone and slot."""
    return f"""
share AS (SELECT *, m / sum(m) OVER (PARTITION BY clonotype, covariate) AS q FROM joint),
clip AS (SELECT *, greatest(q, 1e-12) AS g FROM share),
dist AS (SELECT clonotype, covariate, nation, j, q, g / sum(g) OVER (PARTITION BY clonotype, covariate) AS d FROM clip),
both_sides AS (SELECT x.clonotype, x.nation, x.d AS a, y.d AS b, x.q AS qa, y.q AS qb
               FROM dist x JOIN dist y ON x.clonotype = y.clonotype AND x.j = y.j
               WHERE x.covariate = 'pre' AND y.covariate = 'post')
SELECT 'pre' AS cov_from, 'post' AS cov_to, nation, clonotype, round({expression}, {R}) + 0.0 AS value
FROM both_sides GROUP BY nation, clonotype"""


_KL = "sum(a * log2(a / b))"
_L1 = "sum(abs(a - b))"
_JSD = "sum(0.5 * a * log2(2 * a / (a + b)) + 0.5 * b * log2(2 * b / (a + b)))"

_BOTH = """
kept AS (SELECT clonotype FROM pairs GROUP BY clonotype HAVING count(DISTINCT covariate) = 2)"""

_DELTA_C = f"""
support AS (SELECT covariate, nation, phenotype, m, sum(m) OVER (PARTITION BY covariate, nation, phenotype) AS s
            FROM joint JOIN kept USING (clonotype) WHERE m > 0),
ent AS (SELECT covariate, nation, phenotype, -sum(m / s * log2(m / s)) AS h, count(*) AS c FROM support GROUP BY ALL),
ends AS (SELECT nation, phenotype, max(CASE WHEN covariate = 'pre' THEN {_BY_SUPPORT} END) AS f,
                max(CASE WHEN covariate = 'post' THEN {_BY_SUPPORT} END) AS t FROM ent GROUP BY ALL)
SELECT 'pre' AS cov_from, 'post' AS cov_to, nation, phenotype, round(t - f, {R}) + 0.0 AS value,
       round(abs(f), {R}) AS value_from, round(abs(t), {R}) AS value_to FROM ends"""

_DELTA_P = f"""
ends AS (SELECT nation, region, clonotype, max(CASE WHEN covariate = 'pre' THEN h END) AS f,
                max(CASE WHEN covariate = 'post' THEN h END) AS t FROM ent JOIN kept USING (clonotype) GROUP BY ALL)"""

_DELTA_P_OUT = f"""
SELECT 'pre' AS cov_from, 'post' AS cov_to, nation, clonotype, round(t - f, {R}) + 0.0 AS value,
       round(f, {R}) AS value_from, round(t, {R}) AS value_to FROM ends"""


def _joint_out(where: str = "TRUE") -> str:
    return f"SELECT covariate, clonotype, {_slots('m', 'm')} FROM joint WHERE {where} GROUP BY covariate, clonotype"


def _hdi(table: str, keys: str, out: str) -> str:
    """Narrowest window over the sorted values of ``table(keys, value)``."""
    return f"""
ranked AS (SELECT {keys}, value, row_number() OVER (PARTITION BY {keys} ORDER BY value) - 1 AS i,
                  count(*) OVER (PARTITION BY {keys}) AS n FROM {table}),
stepped AS (SELECT *, greatest(1, CAST(floor(0.94 * n) AS BIGINT)) AS inc FROM ranked),
wins AS (SELECT a.{keys}, a.n, a.i, a.value AS low, b.value AS high
         FROM stepped a JOIN stepped b ON a.{keys} = b.{keys} AND b.i = a.i + a.inc),
best AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY high - low, i) AS pick FROM wins),
whole AS (SELECT {keys}, count(*) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mean, stddev_samp(value) AS sd
          FROM {table} GROUP BY {keys}),
hdi AS (SELECT whole.*, coalesce(best.low, lo) AS hdi_low, coalesce(best.high, hi) AS hdi_high
        FROM whole LEFT JOIN best ON best.{keys} = whole.{keys} AND best.pick = 1)
{out}"""


def _count_table() -> str:
    """Statistics of both date halves on the shape of the earlier half; absent orders have library size 0."""
    def half(h: str) -> str:
        return f"""
lib_{h} AS (SELECT l_orderkey, sum(x) AS lib FROM half_counts WHERE half = '{h}' GROUP BY l_orderkey),
gap_{h} AS (SELECT CAST(greatest(0, (SELECT nc FROM shape) - count(*)) AS BIGINT) AS k FROM lib_{h}),
pad_{h} AS (SELECT lib FROM lib_{h} UNION ALL SELECT 0.0 FROM (SELECT unnest(range(k)) FROM gap_{h})),
st_{h} AS (SELECT sum(x) / any_value(nc) AS mean_library_size, (SELECT median(lib) FROM pad_{h}) AS median_library_size,
                  1 - count(CASE WHEN x <> 0 THEN 1 END) / any_value(nc * nf) AS dropout_fraction,
                  sum(x) / any_value(nc * nf) AS mean_expression,
                  sum(x * x) / any_value(nc * nf) - pow(sum(x) / any_value(nc * nf), 2) AS var_expression
           FROM half_counts CROSS JOIN shape WHERE half = '{h}')"""

    names = ("mean_library_size", "median_library_size", "dropout_fraction", "mean_expression", "var_expression")
    rows = " UNION ALL ".join(
        f"SELECT '{s}' AS statistic, round(a.{s}, {R}) AS observed, round(b.{s}, {R}) AS simulated, "
        f"round(abs(a.{s} - b.{s}), {R}) AS discrepancy FROM st_pre a CROSS JOIN st_post b" for s in names)
    return f"""
WITH half_counts AS (
  SELECT l_orderkey, l_partkey, CASE WHEN l_shipdate < TIMESTAMP '1998-04-01' THEN 'pre' ELSE 'post' END AS half,
         sum(l_quantity) AS x FROM lineitem GROUP BY ALL),
shape AS (SELECT CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS nc, CAST(count(DISTINCT l_partkey) AS DOUBLE) AS nf
          FROM half_counts WHERE half = 'pre'),{half("pre")},{half("post")}
{rows}"""


def _calibration(n_bins: int, out: str) -> str:
    edges = ", ".join(repr(i * (1.0 / n_bins)) for i in range(1, n_bins))
    return _with(*_model()) .rstrip() + f""",
top AS (SELECT cell_id, any_value(observed) AS observed, max(q) AS conf FROM probs GROUP BY cell_id),
hit AS (SELECT top.cell_id, top.conf, CASE WHEN arg_min(level, j) = any_value(top.observed) THEN 1.0 ELSE 0.0 END AS ok
        FROM top JOIN probs ON probs.cell_id = top.cell_id AND probs.q = top.conf GROUP BY top.cell_id, top.conf),
slot AS (SELECT len(list_filter([{edges}], lambda e: e <= conf)) AS bin, conf, ok FROM hit),
bins AS (SELECT CAST(bin AS BIGINT) AS bin, avg(conf) AS mean_pred, avg(ok) AS emp_freq, count(*) AS n FROM slot GROUP BY bin)
{out}"""


def _two_archetypes() -> str:
    comps = []
    for i, row in enumerate(TWO_ARCHETYPES):
        values = ", ".join(f"({j}, {5.0 * v!r})" for j, v in enumerate(row))
        comps.append(f"""
al_{i}(j, a) AS (VALUES {values}),
ev_{i} AS (SELECT clonotype, lgamma(5.0) - lgamma(5.0 + sum(n)) + sum(lgamma(n + a) - lgamma(a)) AS ev,
                  sum(n) AS total FROM pooled JOIN al_{i} USING (j) GROUP BY clonotype),
mean_{i} AS (SELECT pooled.clonotype, j, (a + n) / (5.0 + total) AS w FROM pooled JOIN al_{i} USING (j) JOIN ev_{i} USING (clonotype))""")
    return _with(CT, "pooled AS (SELECT clonotype, j, sum(n) AS n FROM ct GROUP BY ALL)", *comps) .rstrip() + f""",
mix AS (SELECT a.clonotype, 1 / (1 + exp(b.ev - a.ev)) AS w FROM ev_0 a JOIN ev_1 b USING (clonotype)),
omega AS (SELECT x.clonotype, x.j, mix.w * x.w + (1 - mix.w) * y.w AS w
          FROM mean_0 x JOIN mean_1 y ON x.clonotype = y.clonotype AND x.j = y.j JOIN mix ON mix.clonotype = x.clonotype),
conc AS (SELECT ct.clonotype, covariate, n_cells, ct.j, 4.3 * w + ct.n AS conc FROM ct JOIN omega ON omega.clonotype = ct.clonotype AND omega.j = ct.j),
fit AS (SELECT *, conc / sum(conc) OVER (PARTITION BY clonotype, covariate) AS p FROM conc)
SELECT clonotype, covariate, n_cells, {_slots('p', 'p')} FROM fit GROUP BY clonotype, covariate, n_cells"""


_PRIOR = """
pooled AS (SELECT clonotype, j, sum(n) AS n FROM ct GROUP BY ALL),
prior AS (SELECT clonotype, j, (n + 1e-6) / sum(n + 1e-6) OVER (PARTITION BY clonotype) AS pr FROM pooled)"""


def oracles() -> dict[str, str]:
    counts = (CT, COUNT_JOINT)
    model = _model()
    out: dict[str, str] = {}

    out["joint_counts"] = _with(CT) + f"SELECT clonotype, covariate, n_cells, {_counted()} FROM ct GROUP BY clonotype, covariate, n_cells"
    out["joint_counts_lineitem"] = _with(CT, cells=LINE_CELLS, levels=_OWN_LEVELS) + \
        f"SELECT clonotype, covariate, n_cells, {_counted(6)} FROM ct GROUP BY clonotype, covariate, n_cells"
    out["joint_counts_events"] = _with(CT, cells=EVENT_CELLS, levels=_OWN_LEVELS) + \
        f"SELECT clonotype, covariate, n_cells, {_counted()} FROM ct GROUP BY clonotype, covariate, n_cells"
    out["ct_registry"] = f"WITH {CELLS} SELECT clonotype, covariate, count(*) AS n_cells FROM cells GROUP BY ALL"
    out["clone_dictionary"] = """SELECT CAST(user_id AS VARCHAR) AS label, row_number() OVER (ORDER BY user_id) - 1 AS ordinal
        FROM (SELECT DISTINCT user_id FROM events)"""
    out["phenotype_levels"] = f"""WITH {CELLS}
        SELECT 'phenotype' AS axis, phenotype AS label, row_number() OVER (ORDER BY phenotype) - 1 AS ordinal FROM (SELECT DISTINCT phenotype FROM cells)
        UNION ALL SELECT 'covariate', covariate, row_number() OVER (ORDER BY covariate) - 1 FROM (SELECT DISTINCT covariate FROM cells)"""
    out["clone_prior"] = _with(CT, _PRIOR) + f"""SELECT prior.clonotype, any_value(s.n) AS n_cells, {_slots('pr', 'prior')}
        FROM prior JOIN (SELECT clonotype, count(*) AS n FROM cells GROUP BY clonotype) s ON s.clonotype = prior.clonotype GROUP BY prior.clonotype"""
    out["clone_size"] = f"WITH {CELLS} SELECT cell_id, clonotype, count(*) OVER (PARTITION BY clonotype) AS clone_size FROM cells"
    out["clone_counts"] = f"WITH {CELLS} SELECT clonotype, count(*) AS clone_size FROM cells GROUP BY ALL"
    out["group_singletons"] = f"""WITH {CELLS}, named AS (SELECT cell_id AS o_orderkey, clonotype || '_' || nation AS trb_candidate, nation FROM cells)
        SELECT o_orderkey, trb_candidate, CASE WHEN count(*) OVER (PARTITION BY trb_candidate) < 10
               THEN 'Singleton_' || nation ELSE trb_candidate END AS trb_unique FROM named"""
    out["scope_clones"] = f"WITH {CELLS} SELECT clonotype || '@' || nation AS scoped, count(*) AS n_cells FROM cells GROUP BY ALL"
    out["union_blocks"] = """SELECT phenotype, count(*) AS n_cells, count(p) AS n_priced, count(v) AS n_valued FROM (
        SELECT o_orderpriority AS phenotype, o_totalprice AS p, NULL AS v FROM orders
        UNION ALL SELECT event_type, NULL, value FROM events) GROUP BY phenotype"""
    out["label_vectors"] = f"""WITH c AS (SELECT user_id AS clonotype, {", ".join(
        f"CAST(count(*) FILTER (event_type = '{x}') AS DOUBLE) AS v_{j}" for j, x in enumerate(EVENT_TYPES))} FROM events GROUP BY user_id)
        SELECT *, round(greatest(v_0, v_1, v_2, v_3, v_4) + ln({" + ".join(
        f"exp(v_{j} - greatest(v_0, v_1, v_2, v_3, v_4))" for j in range(5))}), {R}) AS lse FROM c"""
    modal = f"""WITH {CELLS}, tally AS (SELECT clonotype, phenotype, count(*) AS n FROM cells GROUP BY ALL),
        modal AS (SELECT clonotype, phenotype AS modal_phenotype, n AS n_modal FROM tally
                  QUALIFY row_number() OVER (PARTITION BY clonotype ORDER BY n DESC, phenotype) = 1)"""
    out["modal_phenotype"] = modal + " SELECT clonotype, modal_phenotype, n_modal FROM modal"
    out["modal_flags"] = modal + " SELECT cell_id, modal_phenotype, phenotype = modal_phenotype AS is_modal FROM cells JOIN modal USING (clonotype)"
    out["dataset_summary"] = f"""WITH {CELLS}
        SELECT count(*) AS n_cells, count(*) - count(clonotype) AS null_clonotype, count(*) - count(phenotype) AS null_phenotype,
               count(*) - count(covariate) AS null_covariate, count(DISTINCT clonotype) AS n_clones,
               (SELECT max(n) FROM (SELECT count(*) AS n FROM cells GROUP BY clonotype)) AS largest_clone,
               (SELECT count(*) FROM (SELECT DISTINCT clonotype, covariate FROM cells)) AS n_pairs,
               count(DISTINCT covariate) AS n_covariates, count(DISTINCT phenotype) AS n_phenotypes,
               count(DISTINCT nation) AS n_groups FROM cells"""
    sizes = f"WITH {CELLS}, sizes AS (SELECT nation, clonotype, count(*) AS n FROM cells GROUP BY ALL)"
    out["clone_rank"] = sizes + """ SELECT nation, clonotype, n AS clone_size,
        row_number() OVER (PARTITION BY nation ORDER BY n DESC, clonotype) AS rank FROM sizes"""
    out["largest_share"] = sizes + f""" SELECT nation, round(max(n) / sum(n), {R}) AS largest_share, max(n) AS largest_clone,
        CAST(sum(n) AS BIGINT) AS n_cells FROM sizes GROUP BY nation"""
    out["clones_per_group"] = sizes + " SELECT nation, count(*) AS n_clones FROM sizes GROUP BY nation"
    out["disjointness"] = """SELECT l_partkey AS clonotype, min(n_name) AS lo, max(n_name) AS hi FROM lineitem
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY l_partkey HAVING count(DISTINCT n_name) > 1"""
    out["split_constant"] = f"WITH {CELLS} SELECT n_name AS nation, count(DISTINCT r_name) = 1 AS is_constant FROM customer " \
        "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name"
    out["ct_coverage"] = f"""WITH {CELLS} SELECT DISTINCT clonotype, 'pre' AS covariate FROM cells c WHERE covariate = 'post'
        AND NOT EXISTS (SELECT 1 FROM cells d WHERE d.clonotype = c.clonotype AND d.covariate = 'pre')"""
    flags = f"""WITH {CELLS}, flags AS (SELECT clonotype, nation, bool_or(covariate = 'pre') AS at_from,
        bool_or(covariate = 'post') AS at_to FROM cells GROUP BY ALL)"""
    out["presence_flags"] = flags + " SELECT clonotype, nation, at_from, at_to FROM flags"
    out["clone_set_sizes"] = flags + """ SELECT count(*) FILTER (at_from AND at_to) AS n_both, count(*) FILTER (at_from OR at_to) AS n_either,
        count(*) FILTER (NOT (at_from AND at_to)) AS n_dropped FROM flags"""

    pair = "SELECT clonotype, covariate, j, phenotype, {} AS m FROM fit"
    out["joint_pair_level"] = _with(CT, FIT, f"joint AS ({pair.format('p')})") + _joint_out()
    out["joint_pair_level_weighted"] = _with(CT, FIT, f"joint AS ({pair.format('p * n_cells')})") + _joint_out()
    out["joint_cell_informed"] = _with(*model) + _joint_out()
    out["joint_cell_informed_weighted"] = _with(*_model(unit_rows=False)) + _joint_out()
    out["joint_tempered"] = _with(*_model(temperature=0.5)) + _joint_out()
    out["joint_gated"] = _with(*_model(gate=0.3)) + _joint_out()
    wide = ", ".join(f"round(max(CASE WHEN j = {j} THEN m END), {R}) AS \"{x}\"" for j, x in enumerate(PRIORITIES))
    out["joint_wide"] = _with(*model) + f"SELECT clonotype, {wide} FROM joint WHERE covariate = 'post' GROUP BY clonotype"
    out["joint_long"] = _with(*model) + f"SELECT covariate, clonotype, phenotype, CAST(j AS BIGINT) AS ordinal, round(m, {R}) AS value FROM joint"
    out["joint_selected_clones"] = _with(*model) + _joint_out("clonotype IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")

    out["mi_by_group"] = _mi("mi", "pre", *counts)
    out["nmi_min"] = _mi("nmi_min", "pre", *counts)
    out["nmi_average"] = _mi("nmi_average", "post", *counts)
    out["nmi_lineitem"] = _mi("nmi_min", "pre", *counts, cells=LINE_CELLS, levels=_OWN_LEVELS)
    out["nmi_events"] = _mi("nmi_min", "pre", *counts, nation=False, cells=EVENT_CELLS, levels=_OWN_LEVELS)
    out["info_summary"] = _with(*counts, _info("covariate, nation")) + f"""SELECT covariate, nation, round(mi, {R}) AS mi,
        round(h_clone, {R}) AS h_clone, round(h_phenotype, {R}) AS h_phenotype, round(nmi_min, {R}) AS nmi_min,
        round(nmi_average, {R}) AS nmi_average FROM info"""
    per_sample = _with(*counts, _info("covariate, nation, region"))
    out["mi_per_sample"] = per_sample + f"""SELECT nation, region, covariate, c.n_clones, round(mi, {R}) AS empirical_mi,
        round(nmi_min, {R}) AS empirical_nmi_min, round(nmi_average, {R}) AS empirical_nmi_average
        FROM info JOIN (SELECT covariate, nation, count(DISTINCT clonotype) AS n_clones FROM cells GROUP BY ALL) c USING (covariate, nation)"""
    out["mi_per_arm"] = per_sample + f"""SELECT region, round(avg(CASE WHEN covariate = 'pre' THEN nmi_min END), {R}) AS pre,
        round(avg(CASE WHEN covariate = 'post' THEN nmi_min END), {R}) AS post FROM info GROUP BY region"""
    out["mi_model"] = _mi("nmi_min", "pre", *model)
    out["mi_model_weighted"] = _mi("nmi_min", "pre", *_model(unit_rows=False))
    out["mi_model_tempered"] = _mi("nmi_average", "pre", *_model(temperature=0.5))
    unit_mi = "SELECT nation, region, nmi_min AS value FROM info"
    out["mi_stats"] = _with(*counts, _info("nation, region", "covariate = 'pre'"), _stats(unit_mi))
    out["mi_stats_model"] = _with(*model, _info("nation, region", "covariate = 'pre'"), _stats(unit_mi))

    entropy_out = "SELECT '{}' AS covariate, nation, phenotype, round(value, " + str(R) + ") AS value FROM ent_value"
    out["clonotypic_entropy"] = _with(*counts, _entropy_c("covariate = 'pre'", _BY_SUPPORT)) + entropy_out.format("pre")
    out["clonotypic_entropy_ref"] = _with(*counts, """biggest AS (SELECT max(k) AS k FROM (SELECT count(DISTINCT clonotype) AS k FROM cells
        WHERE covariate = 'pre' GROUP BY nation))""", _entropy_c("covariate = 'pre'", "h / log2((SELECT k FROM biggest))")) + entropy_out.format("pre")
    out["clonotypic_entropy_model"] = _with(*model, _entropy_c("covariate = 'post'", "h")) + entropy_out.format("post")
    clone_out = f"SELECT covariate, nation, clonotype, round(h, {R}) AS value FROM ent WHERE covariate = 'pre'"
    out["phenotypic_entropy"] = _with(*counts, _entropy_p(True)) + clone_out
    out["phenotypic_entropy_model"] = _with(*model, _entropy_p(False)) + clone_out
    out["phenotypic_entropy_stats"] = _with(*counts, _entropy_p(True), _stats(
        "SELECT nation, region, avg(h) AS value FROM ent WHERE covariate = 'pre' GROUP BY ALL"))
    out["flux_kl"] = _with(*counts, _flux(_KL))
    out["flux_l1"] = _with(*counts, _flux(_L1))
    out["flux_jsd"] = _with(*counts, _flux(_JSD))
    out["flux_custom"] = _with(*counts, _flux("0.5 * sum((qa - qb) * (qa - qb))"))
    out["flux_model"] = _with(*model, _flux(_KL))
    out["flux_self"] = f"WITH {CELLS} SELECT clonotype, 0.0 AS largest, CAST(10 AS BIGINT) AS n_draws FROM cells WHERE covariate = 'pre' GROUP BY clonotype"
    out["delta_clonotypic"] = _with(*counts, _BOTH, _DELTA_C)
    out["delta_clonotypic_model"] = _with(*model, _BOTH, _DELTA_C)
    out["delta_phenotypic"] = _with(*counts, _entropy_p(True), _BOTH, _DELTA_P) + _DELTA_P_OUT
    out["delta_phenotypic_model"] = _with(*model, _entropy_p(True), _BOTH, _DELTA_P) + _DELTA_P_OUT
    out["delta_phenotypic_stats"] = _with(*counts, _entropy_p(True), _BOTH, _DELTA_P, _stats(
        "SELECT nation, region, avg(t - f) AS value FROM ends GROUP BY ALL"))

    spread = f"round({{v}}, {R}) AS value, round(stddev_samp({{x}}), {R}) AS sd, round(quantile_cont({{x}}, 0.025), {R}) AS ci_low, " \
        f"round(quantile_cont({{x}}, 0.975), {R}) AS ci_high, count({{x}}) AS n_groups"
    out["across_groups"] = per_sample + f"SELECT covariate, region, {spread.format(v='avg(nmi_min)', x='nmi_min')} FROM info GROUP BY covariate, region"
    out["across_all_groups"] = per_sample + f"SELECT {spread.format(v='avg(mi)', x='mi')} FROM info"
    out["contrast_less"] = per_sample.rstrip() + f""",
        unit AS (SELECT nation, region, mi AS value FROM info WHERE covariate = 'pre'),
        arm AS (SELECT region, avg(value) AS mean, count(*) AS n FROM unit GROUP BY region),
        duel AS (SELECT x.region AS level_a, y.region AS level_b, sum(CASE WHEN x.value > y.value THEN 1.0 ELSE 0.0 END) AS u
                 FROM unit x JOIN unit y ON x.region = 'ASIA' AND y.region <> 'ASIA' GROUP BY ALL),
        test AS (SELECT *, {_tail('25 - u')} AS p FROM duel)
        SELECT level_a, level_b, a.n AS n_a, b.n AS n_b, round(a.mean, {R}) AS mean_a, round(b.mean, {R}) AS mean_b,
               round(b.mean - a.mean, {R}) AS delta, u AS "U", round(p, {R}) AS p, {_STARS} AS stars
        FROM test JOIN arm a ON a.region = level_a JOIN arm b ON b.region = level_b"""
    out["contrast_orders"] = f"""WITH flags AS (SELECT DISTINCT l_returnflag AS f FROM lineitem),
        pair AS (SELECT x.f AS level_a, y.f AS level_b FROM flags x JOIN flags y ON x.f < y.f),
        sided AS (SELECT level_a, level_b, l_returnflag = level_a AS is_a, l_quantity AS v FROM lineitem JOIN pair ON l_returnflag IN (level_a, level_b)),
        ranked AS (SELECT *, rank() OVER (PARTITION BY level_a, level_b ORDER BY v)
                   + (count(*) OVER (PARTITION BY level_a, level_b, v) - 1) / 2.0 AS mid FROM sided),
        sums AS (SELECT level_a, level_b, count(*) FILTER (is_a) AS n_a, count(*) FILTER (NOT is_a) AS n_b, avg(v) FILTER (is_a) AS mean_a,
                        avg(v) FILTER (NOT is_a) AS mean_b, sum(mid) FILTER (is_a) AS ra FROM ranked GROUP BY ALL)
        SELECT level_a, level_b, n_a, n_b, round(mean_a, {R}) AS mean_a, round(mean_b, {R}) AS mean_b,
               round(mean_b - mean_a, {R}) AS delta, round(ra - n_a * (n_a + 1) / 2.0, {R}) AS "U" FROM sums"""
    out["contrast_paired"] = per_sample.rstrip() + f""",
        d AS (SELECT x.nation, y.mi - x.mi AS value, 0 AS k FROM info x JOIN info y ON x.nation = y.nation
              WHERE x.covariate = 'post' AND y.covariate = 'pre'),
        {_hdi('d', 'k', '').strip()}
        SELECT 'post' AS level_a, 'pre' AS level_b, round(mean, {R}) AS delta,
               round((SELECT avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) FROM d), {R}) AS p_gt,
               round(1 - (SELECT avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) FROM d), {R}) AS p_lt,
               round(hdi_low, {R}) AS hdi_low, round(hdi_high, {R}) AS hdi_high FROM hdi"""
    out["collapse_replicates"] = _with(*counts, _entropy_p(True)) + \
        f"SELECT nation, covariate, round(avg(h), {R}) AS value FROM ent WHERE covariate = 'pre' GROUP BY ALL"
    out["draw_summary"] = "WITH d AS (SELECT o_custkey AS clonotype, o_totalprice / 970.0 AS value FROM orders)," + _hdi("d", "clonotype", f"""
        SELECT clonotype, round(mean, {R}) AS value, round(sd, {R}) AS sd,
               CASE WHEN n > 1 THEN round(hdi_low, {R}) END AS hdi_low, CASE WHEN n > 1 THEN round(hdi_high, {R}) END AS hdi_high FROM hdi""")
    out["hdi_totalprice"] = """WITH d AS (SELECT n_name AS nation, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey),""" + _hdi("d", "nation", f"""
        SELECT nation, n, round(hdi_low, {R}) AS hdi_low, round(hdi_high, {R}) AS hdi_high FROM hdi""")
    out["quantiles_quantity"] = f"""SELECT l_returnflag, round(quantile_cont(l_quantity, 0.025), {R}) AS q_low,
        round(quantile_cont(l_quantity, 0.5), {R}) AS median, round(quantile_cont(l_quantity, 0.975), {R}) AS q_high
        FROM lineitem GROUP BY l_returnflag"""
    out["auc_documents"] = f"""WITH s AS (SELECT n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)),
        r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS mid FROM s),
        t AS (SELECT sum(CASE WHEN y = 1 THEN mid END) AS ra, count(*) FILTER (y = 1) AS a, count(*) FILTER (y <> 1) AS b FROM r)
        SELECT round((ra - a * (a + 1) / 2.0) / (a * b), {R}) AS auc, a AS n_pos, b AS n_neg FROM t"""

    out["auc_permutation_check"] = out["auc_documents"].replace("SELECT round((ra", "SELECT 'mc' AS mode, 200000 AS n_stats, "
        "TRUE AS p_in_range, TRUE AS mean_ok, TRUE AS variance_ok, round((ra")
    out["auc_bootstrap_check"] = f"SELECT auc, 5000 AS n_boot, TRUE AS holds_auc FROM ({out['auc_documents']}) seen"
    each_pair = f"WITH {CELLS} SELECT DISTINCT clonotype, covariate, "
    out["joint_draws_check"] = each_pair + "50 AS n_draws, TRUE AS on_simplex, TRUE AS varies FROM cells"
    out["joint_average_check"] = each_pair + "TRUE AS near_mean FROM cells"
    out["permutation_null_check"] = f"""WITH {CELLS} SELECT DISTINCT covariate, nation, TRUE AS "counts", TRUE AS plus_one,
        TRUE AS varies FROM cells"""
    out["ordered_prior"] = _with(CT, _PRIOR) + f"SELECT clonotype, {_slots('pr', 'pr')} FROM prior GROUP BY clonotype"
    out["latent_norms"] = """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        s AS (SELECT i, avg(x) AS m, stddev_samp(x) AS sd FROM v GROUP BY i)
        SELECT vec_id AS cell_id, round(sum(CASE WHEN sd > 0 THEN ((x - m) / sd) * ((x - m) / sd) ELSE 0 END), 5) AS squared
        FROM v JOIN s USING (i) GROUP BY vec_id"""

    both = f"{_slots('p', 'p')}, {_slots('conc', 'conc')}"
    out["shrink_p_ct"] = _with(CT, FIT) + f"SELECT clonotype, covariate, n_cells, {both} FROM fit GROUP BY clonotype, covariate, n_cells"
    out["shrink_two_archetypes"] = _two_archetypes()
    out["sharpen_posterior"] = _with(CT, FIT).rstrip() + f""",
        mag AS (SELECT *, greatest(sum(conc) OVER (PARTITION BY clonotype, covariate), 1e-6) AS g FROM fit),
        pw AS (SELECT *, greatest(pow(conc / g, 1 / 0.6), 1e-8) AS d, pow(conc, 1 / 0.6) AS r FROM mag),
        sh AS (SELECT clonotype, covariate, j, r / sum(r) OVER (PARTITION BY clonotype, covariate) AS p,
                      greatest(g * d / sum(d) OVER (PARTITION BY clonotype, covariate), 1e-3) AS conc FROM pw)
        SELECT clonotype, covariate, {both} FROM sh GROUP BY clonotype, covariate"""
    out["temper_table"] = _with(CT, _PRIOR).rstrip() + f""",
        pw AS (SELECT clonotype, j, pow(greatest(pr, 1e-12), 1 / 0.7) AS t FROM prior),
        sc AS (SELECT clonotype, j, t / sum(t) OVER (PARTITION BY clonotype) AS t FROM pw)
        SELECT clonotype, {_slots('t', 't')} FROM sc GROUP BY clonotype"""
    out["temper_clone_prior"] = _with(CT, _PRIOR).rstrip() + f""",
        sh AS (SELECT clonotype, j, (pr + 1e-6) / sum(pr + 1e-6) OVER (PARTITION BY clonotype) AS s FROM prior),
        sc AS (SELECT clonotype, j, sqrt(s) / sum(sqrt(s)) OVER (PARTITION BY clonotype) AS t FROM sh)
        SELECT clonotype, {_slots('t', 't')} FROM sc GROUP BY clonotype"""
    out["log_gamma_sizes"] = f"WITH {CELLS} SELECT clonotype, round(lgamma(count(*) + 0.25), {R}) AS lg FROM cells GROUP BY clonotype"
    out["pairwise_distances"] = _with(CT, FIT, """
        dist AS (SELECT clonotype, covariate, j, p AS d FROM fit),
        both_sides AS (SELECT x.clonotype, x.d AS a, y.d AS b FROM dist x JOIN dist y ON x.clonotype = y.clonotype AND x.j = y.j
                       WHERE x.covariate = 'pre' AND y.covariate = 'post')""") + \
        f"SELECT clonotype, round({_KL}, {R}) AS kl, round({_L1}, {R}) AS l1, round({_JSD}, {R}) AS jsd FROM both_sides GROUP BY clonotype"
    out["predict_cells"] = _with(*model) + f"SELECT cell_id, arg_max(level, (q, -j)) AS predicted, {_slots('q', 'q')} FROM probs GROUP BY cell_id"
    out["predict_gated"] = _with(*_model(gate=0.7)) + f"SELECT cell_id, {_slots('q', 'q')} FROM probs GROUP BY cell_id"
    out["log_posterior"] = _with(*model) + f"SELECT cell_id, {_slots('x', 'lp')} FROM scored GROUP BY cell_id"
    out["export_evidence"] = _with(*model) + f"SELECT cell_id, arg_max(level, (q, -j)) AS predicted, {_slots('x', 'lp')} FROM probs GROUP BY cell_id"
    out["evidence_summary"] = _with(*model) + f"""SELECT round(avg(kl), {R}) AS kl_divergence, round(avg(h), {R}) AS entropy, round(avg(c), {R}) AS confidence
        FROM (SELECT cell_id, sum(p * ln(p / q)) AS kl, sum(-q * ln(q + 1e-8)) AS h, sum(q * q) AS c FROM probs GROUP BY cell_id)"""
    out["label_agreement"] = _with(*model) + f"""SELECT round(avg(CASE WHEN pred = observed THEN 1.0 ELSE 0.0 END), {R}) AS agreement, count(*) AS n_cells
        FROM (SELECT cell_id, any_value(observed) AS observed, arg_max(level, (q, -j)) AS pred FROM probs GROUP BY cell_id)"""

    ppc = """share AS (SELECT clonotype, covariate, j, n / sum(n) OVER (PARTITION BY clonotype, covariate) AS q FROM ct),
        clip_a AS (SELECT *, greatest(q, 1e-12) AS g FROM share), clip_b AS (SELECT *, greatest(m, 1e-12) AS g FROM joint),
        da AS (SELECT clonotype, covariate, j, g / sum(g) OVER (PARTITION BY clonotype, covariate) AS a FROM clip_a),
        db AS (SELECT clonotype, covariate, j, g / sum(g) OVER (PARTITION BY clonotype, covariate) AS b FROM clip_b),
        gap AS (SELECT covariate, clonotype, {} AS distance FROM da JOIN db USING (clonotype, covariate, j) GROUP BY covariate, clonotype)"""
    out["joint_ppc"] = _with(*model, ppc.format(_L1)) + f"SELECT covariate, clonotype, round(distance, {R}) AS distance FROM gap"
    out["joint_ppc_per_covariate"] = _with(*model, ppc.format(_JSD)) + f"SELECT covariate, round(avg(distance), {R}) AS mean_distance FROM gap GROUP BY covariate"
    out["calibration"] = _calibration(10, f"""SELECT r.range AS bin, round(mean_pred, {R}) AS mean_pred, round(emp_freq, {R}) AS emp_freq,
        coalesce(n, 0) AS count FROM range(10) r LEFT JOIN bins ON bins.bin = r.range""")
    out["calibration_error"] = _calibration(15, f"SELECT round(sum(n * abs(emp_freq - mean_pred)) / sum(n), {R}) AS ece FROM bins")
    out["count_table_compare"] = _count_table()
    out["permutation_null_observed"] = _with(*counts, _info("covariate")) + f"SELECT covariate, round(nmi_average, {R}) AS observed FROM info"
    pre = "covariate = 'pre'"
    out["estimator_errors"] = _with(
        *_model(unit_rows=False), COUNT_JOINT.replace("joint AS", "seen AS"), _info("nation, region", pre, name="est"),
        _info("nation, region", pre, joint="seen", name="truth"),
        """gap AS (SELECT region, abs(e.nmi_min - t.nmi_min) AS d, e.nmi_min * 0.5 <= t.nmi_min AND t.nmi_min <= e.nmi_min * 2 AS inside
                   FROM est e JOIN truth t USING (nation, region))""") + f"""
        SELECT region, round(avg(d), {R}) AS mae_population, round(avg(d), {R}) AS mae_realised,
               round(avg(CASE WHEN inside THEN 1.0 ELSE 0.0 END), {R}) AS hdi_coverage, count(*) AS n FROM gap GROUP BY region"""
    out["plot_endpoints"] = _with(*counts, _entropy_p(True), _BOTH, _DELTA_P) + \
        f"SELECT nation, region, round(avg(f), {R}) AS value_from, round(avg(t), {R}) AS value_to FROM ends GROUP BY nation, region"
    out["plot_matched_clones"] = _with(CT, _BOTH) + \
        "SELECT nation, count(DISTINCT clonotype) AS n_matched FROM pairs JOIN kept USING (clonotype) GROUP BY nation"
    out["plot_order"] = _with(*counts, _entropy_c("covariate = 'pre'", _BY_SUPPORT)) + \
        f"SELECT phenotype, round(median(value), {R}) AS median FROM ent_value GROUP BY phenotype"
    out["plot_contrast_label"] = f"SELECT level_a, level_b, stars AS label, p FROM ({out['mi_stats']}) WHERE level_a = 'ASIA' AND level_b = 'EUROPE'"
    out["stored_result"] = out["nmi_min"]
    out["stored_joint"] = out["joint_wide"]
    out["session_round_trip"] = _mi("nmi_min", "post", *model)
    out["imported_posterior"] = out["mi_model"]
    return out

"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

from couplet.llm.host_rules import BASE_RULES, HOST_LIMIT, HOST_RULES
from couplet.llm.mixing import TEMPERS, TOLERANCE

WORD = r"[^\x20\x09-\x0D]+"


def _reach(nodes: str, links: str) -> str:
    """Smallest node that links reach, per node, as common table expressions ending in ``best``."""
    return f"""
    walk AS (SELECT id AS node, id AS seen FROM {nodes}
             UNION SELECT w.node, l.b FROM walk w JOIN {links} l ON l.a = w.seen),
    best AS (SELECT node, min(seen) AS component_id FROM walk GROUP BY node)"""


OP2 = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
    ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
           AND len([x FOR x IN e IF x != 0]) > 0),
    links AS (SELECT p.id AS a, q.id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.id != q.id AND len(p.e) = len(q.e)
              AND list_cosine_similarity(p.e, q.e) >= 0.93), {_reach("v", "links")}
SELECT v.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = v.id) AS n_links, component_id, v.id = component_id AS kept
FROM v JOIN best ON best.node = v.id"""


OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
    s AS (SELECT DISTINCT id, array_to_string(w[i:i + 3], ' ') AS s FROM (
              SELECT id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
    common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.id != y.id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
    {_reach("d", "links")}
SELECT d.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, d.id = component_id AS kept
FROM d JOIN best ON best.node = d.id LEFT JOIN n ON n.id = d.id"""


def _op4() -> str:
    base = " OR ".join(f"({r})" for r in BASE_RULES.values())
    counts = ", ".join(f"sum(({r})::INT)::DOUBLE AS {name}" for name, r in HOST_RULES.items())
    prior, verdicts = [], []
    for r in HOST_RULES:
        prior.append(f"""sum({r}) / sum(n) AS m_{r},
            sum({r} * {r} / n) / sum(n) - (sum({r}) / sum(n)) * (sum({r}) / sum(n))
            - (sum({r}) / sum(n)) * (1 - sum({r}) / sum(n)) * count(*) / sum(n) AS v_{r}""")
        k = f"(CASE WHEN v_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 1.0), total) ELSE greatest(total, 1) END)"
        verdicts.append(f"({r} + m_{r} * {k}) / (n + {k}) >= {HOST_LIMIT}")
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (
                SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
    twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + o) AS c FROM twice, range(0, 8) r(o) GROUP BY doc_id),
    line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS c FROM line WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
    f AS (SELECT doc_id, source, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
              length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.c, 0) AS n_dup_lines,
              coalesce(covered.c, 0) AS n_repeat_words
          FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
    h AS (SELECT source, count(*)::DOUBLE AS n, {counts} FROM f WHERE source IS NOT NULL GROUP BY source),
    p AS (SELECT sum(n) AS total, {", ".join(prior)} FROM h),
    bad AS (SELECT source FROM h, p WHERE {" OR ".join(verdicts)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed,
    source IN (SELECT source FROM bad) AND source IS NOT NULL AS host_rejected,
    NOT ({base}) AND NOT (source IN (SELECT source FROM bad) AND source IS NOT NULL) AS kept
FROM f"""


def _op3(fraction: float = 0.5, seed: int = 17) -> str:
    dims = list(TEMPERS)
    steps = [f"""d AS (SELECT doc_id, source, lang, CASE WHEN contains(text, '|') THEN 'table'
            WHEN contains(text, '###') OR contains(text, '$$$') THEN 'symbols' WHEN contains(text, '!!') THEN 'shout'
            ELSE 'prose' END AS topic, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS tokens FROM documents)""",
             "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)"]
    for x, power in TEMPERS.items():
        steps.append(f"""g_{x} AS (SELECT {x} AS value, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS goal
            FROM c GROUP BY {x} HAVING sum(tokens) > 0)""")
    joins = " ".join(f"LEFT JOIN g_{x} ON g_{x}.value IS NOT DISTINCT FROM c.{x}" for x in dims)
    steps.append("s0 AS MATERIALIZED (SELECT c.*, " + ", ".join(f"g_{x}.goal AS goal_{x}" for x in dims)
                 + f", tokens AS share FROM c {joins})")
    turn = "s"
    for x in dims:
        turn = f"""(SELECT * REPLACE (coalesce(share * goal_{x} / nullif(sum(share) OVER (PARTITION BY {x}), 0), 0) AS share)
            FROM {turn} q)"""
    off = ", ".join(f"coalesce(abs(sum(share) OVER (PARTITION BY {x}) / nullif(goal_{x}, 0) - 1), 0)" for x in dims)
    # One sweep a step, until every marginal is met.
    steps.append(f"""s AS (SELECT 0 AS step, 1e9::DOUBLE AS error, * FROM s0 UNION ALL
        SELECT step + 1, max(e) OVER (), * EXCLUDE (step, error, e) FROM (
            SELECT *, CASE WHEN share > 0 THEN greatest({off}) ELSE 0 END AS e FROM {turn} t WHERE error > {TOLERANCE}) u)""")
    steps.append("""r AS MATERIALIZED (SELECT source, lang, topic, tokens, share / sum(share) OVER () AS share,
        CASE WHEN tokens > 0 THEN share / sum(share) OVER () / tokens ELSE 0 END AS ratio
        FROM s WHERE step = (SELECT max(step) FROM s))""")
    # Cells from the largest ratio down: the first whose ratio stays below 1 once all before it are full sets the scale.
    steps.append(f"""k AS MATERIALIZED (SELECT ratio, ({fraction} * sum(tokens) OVER () - coalesce(sum(tokens) OVER before, 0))
            / nullif(sum(share) OVER () - coalesce(sum(share) OVER before, 0), 0) AS scale,
            row_number() OVER (ORDER BY ratio DESC) AS pos
        FROM r WINDOW before AS (ORDER BY ratio DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
    return "WITH RECURSIVE " + ",\n".join(steps) + f"""
SELECT doc_id, d.source, d.lang, d.topic, d.tokens, round(least(1, ratio * scale), 8) AS p
FROM (SELECT arg_min(scale, pos) AS scale FROM k WHERE ratio * scale < 1) z, d
    JOIN r ON r.source IS NOT DISTINCT FROM d.source AND r.lang IS NOT DISTINCT FROM d.lang AND r.topic = d.topic
WHERE ('0x' || substr(md5('{seed}/' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0 < least(1, ratio * scale)"""


_HOST = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)', 1)), '')"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)', 2)"
OP7 = f"""
WITH c AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, page_id % 365 AS day FROM pages),
    names AS (SELECT host AS pattern FROM c WHERE host IS NOT NULL
              UNION SELECT host || '/' || regexp_extract(path, '^/([^/]+)', 1) FROM c
              WHERE host IS NOT NULL AND regexp_extract(path, '^/([^/]+)', 1) != ''),
    h AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 8))::BIGINT % 100 AS kind, ('0x' || substr(md5(pattern), 9, 8))::BIGINT % 200 AS day,
              ('0x' || substr(md5(pattern), 17, 8))::BIGINT % 90 AS span FROM names),
    iv AS (SELECT pattern, day AS since, CASE WHEN kind < 15 THEN day + 30 + span END AS until FROM h WHERE kind < 30
           UNION ALL SELECT pattern, day + 50 + span, NULL FROM h WHERE kind < 8),
    m AS (SELECT page_id, pattern, since FROM c JOIN iv ON c.day >= since AND (until IS NULL OR c.day < until)
          AND (host = pattern OR ends_with(host, '.' || pattern) OR starts_with(host || path || '/', pattern || '/'))),
    best AS (SELECT page_id, count(*) AS n, min((-length(pattern), pattern, since)) AS b FROM m GROUP BY page_id)
SELECT c.page_id, host, day, coalesce(n, 0) AS n_matches, n IS NOT NULL AS blocked, b[2] AS pattern, b[3] AS since
FROM c LEFT JOIN best USING (page_id)"""


OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    f AS (SELECT *, CASE WHEN strlen(body) >= 100 THEN min(page_id) OVER (PARTITION BY body) ELSE page_id END AS first FROM p)
SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest,
    CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first != page_id THEN first END AS refers_to
FROM f"""


def _op10() -> str:
    marks = r"regexp_replace({0}, '([\\<\[|])', '\1\\', 'g')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (7 + sum(13 + length({marks.format('role')}) + length({marks.format('text')})))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


OP11 = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same,
              coalesce(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]), 0)::BIGINT AS score
          FROM v a JOIN v b ON a.id % 100 = 0 AND a.id != b.id AND len(a.q) = len(b.q)),
    p AS (SELECT anchor, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT anchor AS anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10"""


ORACLES = {
    "op2_near_vectors": OP2,
    "op3_source_mixing": _op3(),
    "op4_host_rules": _op4(),
    "op7_url_lists": OP7,
    "op8_warc": OP8,
    "op9_odd_sketch": OP9,
    "op10_reply_trees": _op10(),
    "op11_hard_negatives": OP11,
}

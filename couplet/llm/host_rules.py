"""Quality rules whose failures are judged per host.

Every document is measured over its whole text. Rule failures are counted per host (one aggregate
with map-side combine), the failure rate of each host is shrunk towards all hosts by an empirical
beta prior, and hosts whose shrunk rate of any rule reaches ``limit`` lose all their documents.

Nulls and edges: a null or empty text has no words and fails the word rule. A document without a
host is judged by the base rules alone. Repeated rows are judged one by one. An input column named
like an added one is replaced; all others pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from couplet.llm.texts import Texts, annotate, sums, windows
from couplet.operators.shared import lookup_join, materialise

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
# A document that fails one of these goes, whatever its host.
BASE_RULES = {"few_words": "n_words < 20", "repeats": "100 * n_repeat_words > 30 * n_words"}
# These count towards the verdict on the host.
HOST_RULES = {**BASE_RULES, "symbols": "10 * n_symbols > n_words",
              "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words"}
# A host goes when the shrunk share of its documents that fail some rule reaches this.
HOST_LIMIT = 0.5


def text_features(column: pa.Array) -> list[np.ndarray]:
    """The columns of ``FEATURES`` for a batch of texts."""
    texts = Texts(column)
    starts, ends = texts.words()
    borders = texts.per_text(starts)
    owner = np.repeat(np.arange(texts.n), np.diff(borders))

    # A code point has one byte that is not a continuation byte.
    lead = np.concatenate([np.zeros(1, np.int64), np.cumsum((texts.data & 0xC0) != 0x80)])
    word_chars = sums(lead[ends] - lead[starts], borders)
    n_symbols = sums(SYMBOLS[texts.data], texts.bounds)

    line_start, line_end, line_owner = texts.lines()
    solid = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_owner = line_start[solid], line_end[solid], line_owner[solid]
    key = texts.hashes(line_start, line_end)
    order = np.lexsort((key, line_owner))
    same = (key[order][1:] == key[order][:-1]) & (line_owner[order][1:] == line_owner[order][:-1])
    n_dup_lines = np.bincount(line_owner[order][1:][same], minlength=texts.n)

    h = texts.hashes(starts, ends)
    key = windows(h, WINDOW)
    inside = owner[:len(key)] == owner[WINDOW - 1:] if len(key) else np.empty(0, bool)
    at = np.flatnonzero(inside)
    key = key[at] + owner[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    found = np.zeros(len(key), bool)
    found[order[1:][equal]] = True
    found[order[:-1][equal]] = True
    opened = np.zeros(len(h), np.int64)
    opened[at[found]] = 1
    running = np.concatenate([np.zeros(WINDOW, np.int64), np.cumsum(opened)])
    covered = running[WINDOW:] > running[:-WINDOW]
    return [np.diff(borders).astype(np.int64), word_chars, n_symbols, n_dup_lines.astype(np.int64),
            sums(covered, borders)]


def shrunk_rates(hosts: DataFrame, rules: list[str]) -> dict[str, Column]:
    """Posterior mean failure rate per rule under a beta prior fitted to all hosts by moments.

    ``hosts`` has ``n`` and one failure count per rule. The prior keeps the variance between hosts
    that sampling alone does not explain; with none left the prior is as strong as all the data.
    """
    totals = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"),
                       *[F.sum(r).alias(f"f_{r}") for r in rules],
                       *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"q_{r}") for r in rules]).first()
    n = totals["n"] or 0
    rates = {}
    for r in rules:
        mean = (totals[f"f_{r}"] / n) if n else 0.0
        spread = mean * (1 - mean)
        between = ((totals[f"q_{r}"] / n - mean * mean) - spread * totals["hosts"] / n) if n else 0.0
        strength = min(max(spread / between - 1, 1.0), float(n)) if between > 0 else float(max(n, 1))
        rates[r] = (F.col(r) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return rates


def host_verdicts(measured: DataFrame, rules: dict[str, str], limit: float) -> DataFrame:
    """``(__host, n, host_rejected)`` of a table with ``__host`` and the features."""
    hosts = materialise(measured.where("__host is not null").groupBy("__host").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.expr(f"cast({rule} as long)")).alias(name) for name, rule in rules.items()]))
    bad = F.lit(False)
    for rate in shrunk_rates(hosts, list(rules)).values():
        bad = bad | (rate >= limit)
    return materialise(hosts.select("__host", "n", bad.alias("host_rejected")))


def base_failure() -> Column:
    return F.expr(" or ".join(f"({rule})" for rule in BASE_RULES.values()))


def host_rules(docs: DataFrame, text: str = "text", host: str = "source", rules: dict[str, str] | None = None,
               limit: float = HOST_LIMIT, keep: list[str] | None = None) -> DataFrame:
    """Documents with features, ``base_failed``, ``host_rejected`` and ``kept``.

    ``keep`` lists the input columns of the result; leaving the text out keeps the stage narrow.
    """
    passed = docs.columns if keep is None else keep
    side = docs.withColumn("__host", F.col(f"`{host}`").cast("string"))
    measured = annotate(side, text, text_features, FEATURES, [*passed, "__host"])
    rest = [c for c in measured.columns if c.lower() not in ("base_failed", "host_rejected", "kept")]
    measured = materialise(measured.select(*[F.col(f"`{c}`") for c in rest], base_failure().alias("base_failed")))
    verdicts = host_verdicts(measured, HOST_RULES if rules is None else rules, limit)
    judged = lookup_join(measured, verdicts, ["__host"], "n", row_bytes=128, keep_unmatched=True)
    rejected = F.coalesce("host_rejected", F.lit(False))
    columns = [c for c in measured.columns if c != "__host"]
    return judged.select(*[F.col(f"`{c}`") for c in columns], rejected.alias("host_rejected"),
                         (~F.col("base_failed") & ~rejected).alias("kept"))


def keep_passing(docs: DataFrame, text: str = "text", host: str = "source", rules: dict[str, str] | None = None,
                 limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that ``host_rules`` keeps, with their own columns.

    Texts are measured twice instead of being written or shuffled: once for the hosts' verdicts and
    once to filter.
    """
    named = docs.withColumn("__host", F.col(f"`{host}`").cast("string"))
    measured = materialise(annotate(named, text, text_features, FEATURES, ["__host"]))
    bad = host_verdicts(measured, HOST_RULES if rules is None else rules, limit).where("host_rejected").select("__host")

    def failed(column: pa.Array) -> list[np.ndarray]:
        n_words, _, _, _, repeated = text_features(column)
        return [(n_words < 20) | (100 * repeated > 30 * n_words)]

    passing = annotate(named, text, failed, "__failed boolean").where("not __failed").drop("__failed")
    return passing.join(bad, "__host", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

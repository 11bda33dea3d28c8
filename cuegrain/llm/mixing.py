"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed to cells of source, language and topic. The cells' weights are raked
until each marginal has its target share of the weighted tokens; weights become inclusion
probabilities that keep a set share of all tokens in expectation, and every document is kept
or left by a hash of its doc_id. A probability stops at 1, so large shares miss the targets;
with ``exact`` the probabilities themselves are raked, and the share is the largest one for
which they meet the targets.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

DIMS = ("source", "lang", "topic")
#: Target shares are shares of tokens to this power, scaled to one, where none are given.
TEMPER = 0.5
SWEEPS = 12
KEEP = 0.5
#: Cells up to which they are raked on the driver and broadcast; beyond, both are done by Spark.
MAX_CELLS = 100_000
#: With exact: how far, of a target share, the expected share may be from it; sweeps of a trial, and trials of the share.
NEAR = 0.005
#: With exact: a target that only a sample of less than this share of the tokens could meet (its value is too rare) is given up: all of the value's tokens stay.
LEAST = 0.1
EXACT_SWEEPS, TRIALS = 300, 14
SPARK_TRIALS = 4
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"


def topic(text: Column, tokens: Column) -> Column:
    """A class of texts by what fills them; the rules are tried in this order."""
    n = lambda s: F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))
    return F.when(n("|") * 4 > tokens, "table").when(n("!") * 2 > tokens, "shout").when((n("#") + n("$") + n("%") + n("&") + n("*")) * 2 > tokens, "symbols").when(tokens >= 500, "long").otherwise("short")


def _margins(keys: list[tuple], tokens: np.ndarray, targets: dict | None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each of DIMS: the number of each cell's value, the target shares, and the values."""
    codes, want, names, total = [], [], [], tokens.sum()
    for d, name in enumerate(DIMS):
        values, code = np.unique(np.array([k[d] for k in keys], object).astype(str), return_inverse=True)
        codes.append(code)
        share = np.bincount(code, tokens) / total
        given = (targets or {}).get(name)
        t = np.array([given.get(v, 0.0) for v in values]) if given else share**TEMPER
        if not t.sum():
            raise ValueError(f"none of the values of {name} that have a target occurs")
        want.append(t / t.sum())
        names.append(values)
    return codes, want, names


def rake_on_driver(keys: list[tuple], tokens: np.ndarray, targets: dict | None, sweeps: int) -> np.ndarray:
    w = np.ones(len(tokens))
    codes, want, _ = _margins(keys, tokens, targets)
    for _ in range(sweeps):
        for code, t in zip(codes, want, strict=True):
            now = np.bincount(code, w * tokens)
            with np.errstate(divide="ignore", invalid="ignore"):
                w = w * np.nan_to_num(t * (w * tokens).sum() / now)[code]
    return w


def _warn(share: float, missed: list[tuple]) -> None:
    if missed:
        said = ", ".join(f"{d} {v}: target {t:.4f}, expected {x:.4f}" for d, v, t, x in missed[:20])
        warnings.warn(f"mixing: {len(missed)} targets are not met by a sample of {share:.4f} of the tokens: {said}", stacklevel=3)


def _within_reach(has: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is too rare for its target, and the targets of the others, scaled to one."""
    rare = np.zeros(len(t), bool)
    while True:
        left = np.where(rare, 0, t) / max(t[~rare].sum(), 1e-300)
        more = has < LEAST * left
        if not more.any():
            return rare, left
        rare |= more


def exact_on_driver(keys: list[tuple], tokens: np.ndarray, targets: dict | None, weights: np.ndarray, keep: float) -> np.ndarray:
    """Probabilities by which the sample's tokens have the target shares, for the largest share of all tokens that allows it (``keep`` at most).

    Cells at 1 stay there while the others are raked to what is left of each target. Values too
    rare for their target (LEAST) are kept whole, and the other values of that dimension share
    the rest in the proportion of their targets. Targets that are not met are named in a warning.
    """
    codes, want, names = _margins(keys, tokens, targets)
    total = tokens.sum()
    has = [np.bincount(c, tokens) / total for c in codes]
    rare, left = zip(*(_within_reach(h, t) for h, t in zip(has, want, strict=True)), strict=True)
    whole = np.any([r[c] for r, c in zip(rare, codes, strict=True)], 0)
    given = [h[r].sum() for h, r in zip(has, rare, strict=True)]

    def rake(share: float) -> tuple[np.ndarray, float]:
        u = np.where(whole, 1e9, weights * scale(weights, tokens, share))
        off = 9.0
        for k in range(EXACT_SWEEPS):
            for code, t, g in zip(codes, left, given, strict=True):
                full = np.bincount(code, np.where(u >= 1, tokens, 0))
                free = np.bincount(code, np.where(u < 1, u * tokens, 0))
                goal = t * (share - g) * total
                with np.errstate(divide="ignore", invalid="ignore"):
                    f = np.where((goal > full) & (free > 0), (goal - full) / free, goal / (full + free))
                u = np.where(whole, 1e9, np.clip(u * np.nan_to_num(f, posinf=1.0)[code], 0, 1e9))
            p, off = np.minimum(1, u), 0.0
            for code, t, g in zip(codes, left, given, strict=True):
                got = np.bincount(code, p * tokens)[t > 0] / ((share - g) * total * t[t > 0])
                off = max(off, float(np.abs(got - 1).max(initial=0)))
            if off <= NEAR:
                break
        return p, off

    # No value can give more tokens than it has.
    high = min([keep, *(float((h[t > 0] / t[t > 0]).min(initial=1)) + g for h, t, g in zip(has, left, given, strict=True))])
    low = share = max(given)
    best, off = rake(high) if high > low else (np.minimum(1, scale(weights, tokens, keep) * weights), 9.0)
    if high > low and off > NEAR:
        for _ in range(TRIALS):
            mid = (low + high) / 2
            p, now = rake(mid)
            if now <= NEAR:
                best, off, low = p, now, mid
            else:
                high = mid
                if off > NEAR and now < off:
                    best, off = p, now
    share = (best * tokens).sum() / total
    shares = [np.bincount(c, best * tokens) / max(share * total, 1e-9) for c in codes]
    _warn(share, [(d, v, t, x) for d, ts, vs, xs in zip(DIMS, want, names, shares, strict=True) for v, t, x in zip(vs, ts, xs, strict=True) if abs(x - t) > 2 * NEAR * t])
    return best


def exact_on_spark(raked: DataFrame, targets: dict | None, keep: float, sweeps: int, scratch: Scratch) -> DataFrame:
    """``exact_on_driver`` for any number of cells; a share that misses targets is lowered by the worst miss, SPARK_TRIALS times at most."""
    spark = raked.sparkSession
    total = raked.agg(F.sum("tokens")).first()[0]
    goals, given, share = {}, {}, keep
    cells = raked.withColumn("whole", F.lit(False))
    for d in DIMS:
        has = raked.groupBy(d).agg((F.sum("tokens") / total).alias("has"))
        if targets and targets.get(d):
            has = has.join(spark.createDataFrame(list(targets[d].items()), f"{d} string, want double"), d, "left").withColumn("want", F.coalesce("want", F.lit(0.0)))
        else:
            has = has.withColumn("want", F.pow("has", F.lit(TEMPER)))
        has = scratch.save(has.withColumn("want", F.col("want") / F.lit(has.agg(F.sum("want")).first()[0])).withColumn("t", F.col("want")), f"goal-{d}")
        rare = F.col("has") < LEAST * F.col("t")
        while has.where(rare).limit(1).count():
            scaled = has.where(~rare).agg(F.sum("t")).first()[0] or 1.0
            has = scratch.save(has.withColumn("t", F.when(rare, 0.0).otherwise(F.col("t") / F.lit(scaled))), f"goal-{d}")
        goals[d] = has.withColumn("rare", (F.col("t") == 0) & (F.col("want") > 0))
        given[d] = goals[d].where("rare").agg(F.sum("has")).first()[0] or 0.0
        share = min(share, given[d] + (goals[d].where("t > 0").agg(F.min(F.col("has") / F.col("t"))).first()[0] or 1.0))
        cells = cells.join(goals[d].select(d, "rare"), d).withColumn("whole", F.col("whole") | F.col("rare")).drop("rare")
    factor = share * total / raked.agg(F.sum(F.col("weight") * F.col("tokens"))).first()[0]
    cells = cells.withColumn("u", F.when(F.col("whole"), 1e9).otherwise(F.col("weight") * F.lit(factor)))
    for trial in range(SPARK_TRIALS):
        goal = {d: F.col("t") * F.lit((share - given[d]) * total) for d in DIMS}
        for _ in range(sweeps):
            for d in DIMS:
                now = cells.groupBy(d).agg(F.sum(F.when(F.col("u") >= 1, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(F.col("u") < 1, F.col("u") * F.col("tokens")).otherwise(0.0)).alias("free"))
                f = F.when((goal[d] > F.col("full")) & (F.col("free") > 0), (goal[d] - F.col("full")) / F.col("free")).otherwise(F.coalesce(F.try_divide(goal[d], F.col("full") + F.col("free")), F.lit(0.0)))
                cells = cells.join(now.join(goals[d], d).select(d, f.alias("f")), d).withColumn("u", F.when(F.col("whole"), 1e9).otherwise(F.least(F.col("u") * F.col("f"), F.lit(1e9)))).drop("f")
            cells = scratch.save(cells, "bounded")
        got = F.sum(F.least(F.lit(1.0), F.col("u")) * F.col("tokens"))
        ratio, missed = 1.0, []
        each = {d: scratch.save(cells.groupBy(d).agg(got.alias("got")).join(goals[d], d).withColumn("r", F.try_divide(F.col("got"), goal[d])), f"got-{d}") for d in DIMS}
        for d in DIMS:
            worst = each[d].where("t > 0").agg(F.min("r"), F.max(F.abs(F.col("r") - 1))).first()
            ratio = min(ratio, worst[0])
            missed.append(worst[1] > NEAR)
        if not any(missed):
            break
        if trial + 1 < SPARK_TRIALS:
            share *= max(0.5, min(ratio, 0.99))
    whole = each[DIMS[0]].agg(F.sum("got")).first()[0]
    shares = F.col("got") / F.lit(whole)
    _warn(whole / total, [(d, r[d], r["want"], r["got"] / whole) for d in DIMS for r in each[d].where(F.abs(shares - F.col("want")) > 2 * NEAR * F.col("want")).limit(20).collect()])
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("u"))).drop("u", "whole")


def rake_on_spark(cells: DataFrame, targets: dict | None, sweeps: int, scratch: Scratch) -> DataFrame:
    """The same for any number of cells: one aggregation and join for each marginal and sweep, saved every sweep."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0]
    want = {}
    for d in DIMS:
        if targets and targets.get(d):
            # Shares of values that don't occur go to the others, in proportion.
            given = spark.createDataFrame(list(targets[d].items()), f"{d} string, t double").join(cells.select(d).distinct(), d)
            s = given.agg(F.sum("t")).first()[0]
            if not s:
                raise ValueError(f"none of the values of {d} that have a target occurs")
            want[d] = given.withColumn("t", F.col("t") / F.lit(s))
        else:
            t = cells.groupBy(d).agg(F.pow(F.sum("tokens") / total, F.lit(TEMPER)).alias("t"))
            want[d] = scratch.save(t.withColumn("t", F.col("t") / F.lit(t.agg(F.sum("t")).first()[0])), f"target-{d}")
    cells = cells.withColumn("weight", F.lit(1.0))
    for _ in range(sweeps):
        for d in DIMS:
            now = cells.groupBy(d).agg(F.sum(F.col("weight") * F.col("tokens")).alias("now"))
            whole = now.agg(F.sum("now")).first()[0]
            now = now.join(want[d], d, "left").select(d, F.coalesce(F.try_divide(F.col("t") * whole, F.col("now")), F.lit(0.0)).alias("f"))
            cells = cells.join(now, d).withColumn("weight", F.col("weight") * F.col("f")).drop("f")
        cells = scratch.save(cells, "raked")
    return cells


def scale(weights: np.ndarray, tokens: np.ndarray, keep: float) -> float:
    """The factor for which min(1, factor * weight) keeps the share ``keep`` of all tokens in expectation."""
    by = np.argsort(-weights, kind="stable")
    w, t = weights[by], tokens[by].astype(float)
    before = np.cumsum(t) - t
    rest = np.cumsum((w * t)[::-1])[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        factor = (keep * t.sum() - before) / rest
    ok = np.flatnonzero(np.nan_to_num(factor * w, nan=9.0) <= 1)
    return float(factor[ok[0]]) if len(ok) else 0.0


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, sweeps: int = SWEEPS, seed: int = 1, max_cells: int = MAX_CELLS, exact: bool = False) -> DataFrame:
    """docs (doc_id, source, lang, topic, n_tokens; other columns stay) with weight, probability and kept, which replace columns by these names.

    Null sources, languages and topics are a value of their own, "(none)". Values without a
    target share get weight 0; shares of values that don't occur go to the others in proportion, and
    targets none of whose values occur are an error. Rows with one doc_id are kept or left together; a null doc_id
    counts as the empty text. A document without tokens has the probability of its cell.
    With ``exact`` the tokens' expected shares are the targets, and ``keep`` is the most that is
    kept; values too rare for their target are kept whole and named in a warning. Without, ``keep``
    holds and cells whose probability stops at 1 fall short. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("weight", "probability", "kept")
    under = "_"
    while any(f"{under}{d}" in docs.columns for d in DIMS):
        under += "_"
    names = [f"{under}{d}" for d in DIMS]
    keyed = docs.withColumns({f"{under}{d}": F.coalesce(F.col(d).cast("string"), F.lit(NONE)) for d in DIMS})
    cells = keyed.groupBy(*names).agg(F.sum("n_tokens").cast("long").alias("tokens"))
    cells = scratch.save(cells.select(*(F.col(f"{under}{d}").alias(d) for d in DIMS), F.greatest("tokens", F.lit(0)).alias("tokens")), "cells")
    if cells.count() <= max_cells:
        rows = sorted(tuple(r) for r in cells.collect())
        tokens = np.array([r[3] for r in rows], float)
        w = rake_on_driver(rows, tokens, targets, sweeps) if tokens.sum() else np.ones(len(rows))
        p = exact_on_driver(rows, tokens, targets, w, keep) if exact and tokens.sum() else np.minimum(1, scale(w, tokens, keep) * w)
        raked = docs.sparkSession.createDataFrame([(*r[:3], float(a), float(b)) for r, a, b in zip(rows, w, p, strict=True)], ", ".join(f"{n} string" for n in names) + ", weight double, probability double")
        out = keyed.join(F.broadcast(raked), names)
    elif exact:
        raked = exact_on_spark(rake_on_spark(cells, targets, sweeps, scratch), targets, keep, sweeps, scratch)
        out = keyed.join(raked.select(*(F.col(d).alias(f"{under}{d}") for d in DIMS), "weight", "probability"), names)
    else:
        raked = rake_on_spark(cells, targets, sweeps, scratch)
        # Cells that reach probability 1 stay there and the others share the rest, until no more do: ``scale`` for any number of cells.
        total, sure, high = raked.agg(F.sum("tokens")).first()[0], F.lit(False), 0.0
        while True:
            whole, rest, n = raked.agg(F.sum(F.when(sure, F.col("tokens")).otherwise(0)), F.sum(F.when(sure, 0.0).otherwise(F.col("weight") * F.col("tokens"))), F.count_if(sure)).first()
            if not rest:
                break
            high = (keep * total - whole) / rest
            now = F.col("weight") * F.lit(high) > 1
            if raked.where(now).count() <= n:
                break
            sure = now
        p = raked.select(*(F.col(d).alias(f"{under}{d}") for d in DIMS), "weight", F.least(F.lit(1.0), F.col("weight") * F.lit(high)).alias("probability"))
        out = keyed.join(p, names)
    u = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"-{seed}"))), 1, 13), 16, 10).cast("double") / float(16**13)
    return out.drop(*names).withColumn("kept", u < F.col("probability"))


def with_topics(docs: DataFrame) -> DataFrame:
    """docs with n_tokens (words of the whole text; null: none) and topic, which replace columns by these names; other columns stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("n_tokens", F.regexp_count(text, F.lit(WORD)).cast("long")).withColumn("topic", topic(text, F.col("n_tokens")))


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = with_topics(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "lang", "topic", "n_tokens")
    out = mix(docs)
    return out.withColumns({"weight": F.round("weight", 6), "probability": F.round("probability", 6)})


def _oracle() -> str:
    n = lambda s: f"(length(text) - length(replace(text, '{s}', '')))"
    ctes = [
        rf"d AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens, coalesce(text, '') AS text FROM documents)",
        f"e AS (SELECT doc_id, source, lang, CAST(n_tokens AS BIGINT) AS n_tokens, CASE WHEN {n('|')} * 4 > n_tokens THEN 'table' WHEN {n('!')} * 2 > n_tokens THEN 'shout' WHEN ({' + '.join(map(n, '#$%&*'))}) * 2 > n_tokens THEN 'symbols' WHEN n_tokens >= 500 THEN 'long' ELSE 'short' END AS topic FROM d)",
        "c0 AS MATERIALIZED (SELECT coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(1 AS DOUBLE) AS weight FROM e GROUP BY ALL)",
    ]
    for d in DIMS:
        ctes.append(f"t_{d} AS MATERIALIZED (SELECT {d}, t / sum(t) OVER () AS t FROM (SELECT {d}, pow(sum(tokens) / (SELECT sum(tokens) FROM c0), {TEMPER}) AS t FROM c0 GROUP BY {d}))")
    k = 0
    for _ in range(SWEEPS):
        for d in DIMS:
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, weight * t * sum(weight * tokens) OVER () / sum(weight * tokens) OVER (PARTITION BY c.{d}) AS weight FROM c{k} c JOIN t_{d} USING ({d}))")
            k += 1
    ctes += [
        f"o AS (SELECT *, ({KEEP} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight * tokens) OVER (ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM c{k})",
        "f AS (SELECT factor FROM o WHERE factor * weight <= 1 ORDER BY weight DESC LIMIT 1)",
        f"p AS (SELECT source, lang, topic, weight, least(1, weight * (SELECT factor FROM f)) AS probability FROM c{k})",
    ]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, e.source, e.lang, e.topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
  CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '-1'), 1, 13) AS BIGINT) AS DOUBLE) / {16**13} < probability AS kept
FROM e JOIN p ON p.source = coalesce(e.source, '(none)') AND p.lang = coalesce(e.lang, '(none)') AND p.topic = e.topic
"""


ORACLE = _oracle()

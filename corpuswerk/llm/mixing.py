"""Records of several sources drawn so that each source has its target share of all tokens.

Every record of a source is wanted equally often: e times, e at most the source's cap. The whole
part of e is taken by each record; the rest is the inclusion probability of one more copy, drawn by
the cube method with the totals of tokens and of records held fixed. Within a block of records the
probabilities move through the null space of the two constraints, three records at a time, until
at most two stay fractional; those go on to the next round of blocks. The last LANDING of a source are
the landing problem: of their outcomes with as many records as wanted, rounded either way, the one
nearest to the token total is taken. So no task sees more than one block, however large a source is,
and the inclusion probabilities hold for all but these last few.

How large the sample is: without a total the most that keeps every share exact under all caps, so
that one small source may hold down the others. With a total the size asked for; a source whose
capped records don't reach its share gives all it can, and `shortfall` tells how many tokens it lacks.

Defined cases: records without tokens, of a null source or of a source that isn't listed aren't
drawn; a listed source without tokens can't have its share, the shares of the others are scaled up
to one; repeated targets of a source are added up with the smallest cap; nulls, negative shares and
caps count as zero; ties are settled by a hash of the record; repeated rows and null ids are records
of their own; extra columns are ignored; empty tables give an empty sample.
"""

from __future__ import annotations

import itertools
import math
import random
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswerk.plans.storage import checked_rows, materialized

BLOCK_ROWS = 10_000
#: Sources a target list may have; it is broadcast.
MAX_SOURCES = 10_000
EDGE = 1e-9
#: Records of a source whose outcomes are tried out together at the end.
LANDING = 12


def flight(p: list[float], x: list[float], rng: random.Random, keep: int = 2) -> list[float]:
    """Move probabilities to 0 or 1, keeping their sum and the sum of p * x; at most keep (from 2) stay in between."""
    p, live = list(p), []
    for k in [i for i, v in enumerate(p) if EDGE < v < 1 - EDGE]:
        live.append(k)
        if len(live) <= keep:
            continue
        a, b, c = moved = live[:3]
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        _step(p, moved, u, rng)
        live = [i for i in live if EDGE < p[i] < 1 - EDGE]
    return p


def _step(p: list[float], live: list[int], u: tuple[float, ...], rng: random.Random) -> None:
    up = min(((1 - p[i]) / v if v > 0 else p[i] / -v) for i, v in zip(live, u) if v)
    down = min((p[i] / v if v > 0 else (1 - p[i]) / -v) for i, v in zip(live, u) if v)
    move = up if rng.random() * (up + down) < down else -down
    for i, v in zip(live, u):
        q = p[i] + move * v
        p[i] = 0.0 if q < EDGE else 1.0 if q > 1 - EDGE else q


def land(p: list[float], x: list[float]) -> list[float]:
    """Settle the few that are left: with their number rounded, the outcome whose sum of p * x is nearest to what it was, fewer records at a tie."""
    p = list(p)
    live = [i for i, v in enumerate(p) if EDGE < v < 1 - EDGE]
    goal, number = sum(p[i] * x[i] for i in live), sum(p[i] for i in live)
    outcomes = [o for o in itertools.product((0.0, 1.0), repeat=len(live)) if abs(sum(o) - number) < 1 - EDGE or len(live) == 1]
    best = min(outcomes, key=lambda o: (abs(sum(v * x[i] for v, i in zip(o, live)) - goal), sum(o)))
    for i, v in zip(live, best):
        p[i] = v
    return p


def _round(last: bool, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "doc_id", "n_tokens"], kind="stable")
        rng = random.Random(f"{seed}:{key[0]}:{key[1]}")
        x = rows["n_tokens"].astype(float).tolist()
        p = flight(rows["p"].tolist(), x, rng, LANDING if last else 2)
        return rows.assign(p=land(p, x) if last else p)

    return run


@dataclass(frozen=True)
class Mix:
    sample: DataFrame
    shares: DataFrame


def plan(stats: list[tuple[str, int, int]], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, float]:
    """Copies wanted of each record, by source: of total tokens, each source capped, or of the most with all shares exact."""
    tokens = {s: t for s, _, t in stats if t}
    share, cap = {}, {}
    for source, w, r in targets:
        if source is not None:
            share[source] = share.get(source, 0.0) + max(w or 0.0, 0.0)
            cap[source] = min(cap.get(source, math.inf), max(r or 0, 0))
    usable = {s: w for s, w in share.items() if w > 0 and cap[s] > 0 and s in tokens}
    whole = sum(usable.values())
    if not usable:
        return {}
    most = min(cap[s] * tokens[s] * whole / w for s, w in usable.items())
    size = most if total is None else total
    return {s: min(cap[s], w / whole * size / tokens[s]) for s, w in usable.items()}


def shortfalls(stats: list[tuple[str, int, int]], targets: list[tuple[str, float, int]], total: float | None) -> dict[str, float]:
    """Tokens that a source lacks of its share of total; none without a total."""
    if total is None:
        return {}
    tokens, wanted = {s: t for s, _, t in stats if t}, plan(stats, targets, total)
    share = {s: sum(max(w or 0.0, 0.0) for x, w, _ in targets if x == s) for s in wanted}
    whole = sum(share.values())
    return {s: max(0.0, total * share[s] / whole - e * tokens[s]) for s, e in wanted.items()}


def mix(records: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1, of_all: float | None = None) -> Mix:
    """records: (doc_id, source, n_tokens); targets: (source, target_share, max_repeats); of_all: the total as a share of all tokens of listed sources."""
    spark = records.sparkSession
    listed = [tuple(r) for r in checked_rows(targets.select("source", "target_share", "max_repeats"), MAX_SOURCES, "the target list")]
    names = F.broadcast(targets.select("source").distinct())
    own = records.select("doc_id", "source", F.col("n_tokens").cast("bigint")).join(names, "source", "left_semi").filter("n_tokens > 0")
    own = materialized(own.select("doc_id", "source", "n_tokens"), "sized")
    stats = [tuple(r) for r in own.groupBy("source").agg(F.count("*"), F.sum("n_tokens")).collect()]  # a row per listed source
    if of_all is not None:
        total = of_all * sum(t for _, _, t in stats)
    wanted = plan(stats, listed, total)
    rows_of = {s: n for s, n, _ in stats}
    schema = "source string, copies double, rows bigint"
    want = spark.createDataFrame([(s, float(e), rows_of[s]) for s, e in wanted.items()], schema)
    # A whole number of copies may be off by a rounding error.
    near = F.when(F.abs(F.col("copies") - F.round("copies")) < EDGE, F.round("copies")).otherwise(F.col("copies"))
    start = own.join(F.broadcast(want), "source").withColumn("copies", near)
    start = start.select("source", "doc_id", "n_tokens", F.floor("copies").cast("int").alias("base"), (F.col("copies") - F.floor("copies")).alias("p"), F.xxhash64("doc_id", "n_tokens", F.spark_partition_id(), F.lit(seed)).alias("h"), "rows")
    decided, left = None, start
    counts = {s: rows_of[s] for s in wanted}
    for depth in itertools.count():
        last = max(counts.values(), default=0) <= BLOCK_ROWS
        n_blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("bigint")
        block = F.pmod(F.xxhash64("h", F.lit(depth)), n_blocks)
        parts = left.withColumn("block", block).groupBy("source", "block")
        kept = "source string, doc_id bigint, n_tokens bigint, base int, p double, h bigint"
        done = materialized(parts.applyInPandas(_drop_extra(_round(last, seed + depth)), kept), "flown")
        settled = f"p <= {EDGE} or p >= {1 - EDGE}"
        here = done.filter(settled)
        decided = here if decided is None else decided.unionByName(here)
        if last:
            break
        left = done.filter(f"not ({settled})")
        before, counts = counts, {r[0]: r[1] for r in left.groupBy("source").count().collect()}  # a row per listed source
        if counts and max(counts.values()) >= max(before.values()):
            raise RuntimeError("a round of the cube method has settled no record")
        sizes = spark.createDataFrame(list(counts.items()), "source string, rows bigint")
        left = left.join(F.broadcast(sizes), "source")
    drawn = decided.withColumn("repeats", F.col("base") + F.round("p").cast("int")).filter("repeats > 0")
    sample = drawn.select("doc_id", "source", "n_tokens", "repeats")
    got = sample.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    everything = got.agg(F.sum("tokens").alias("all_tokens"))
    goal = targets.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    shares = goal.join(got, "source", "left").join(F.broadcast(everything), how="cross")  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    lacking = spark.createDataFrame([(s, round(v, 6)) for s, v in shortfalls(stats, listed, total).items()], "source string, shortfall double")
    shares = shares.join(F.broadcast(lacking), "source", "left")
    shares = shares.select("source", "target_share", "max_repeats", zero("n_docs"), zero("tokens"), zero("most_repeats"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("shortfall", F.lit(0.0)).alias("shortfall"))
    return Mix(sample, shares)


def _drop_extra(run):
    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return run(key, rows)[["source", "doc_id", "n_tokens", "base", "p", "h"]]

    return each

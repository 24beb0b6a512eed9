"""Mixing sources to target weights (problem 4) by entropy balancing.

For each mix and language the blocks get rates (expected copies) that stay as close as possible,
in relative entropy, to one copy each while their tokens add up to the wanted share and no rate
passes the cap: ``rate(n) = min(cap, exp(dual * n / mean))`` for a block of ``n`` tokens. The
dual of that problem is convex, with one unknown for each mix and language; Newton steps,
kept inside a bracket, solve all of them at once. Each step is one distributed aggregation over
the histogram of block sizes, of which only gradient and curvature by (mix, language) reach the
driver. Rates are then rounded to copies by a hash of the block, with one threshold for each
(mix, language) that brings the sum closest to the target.

Whether a target can be reached is read off its dual: where none is finite, all blocks are at their
caps and still give less than wanted.

Defined results: a block delivered more than once counts once, by its id, with the least language
that a delivery states and the most tokens; a null id is no block. Null and empty masks have no tokens. Blocks without a language
count for none. Targets with a null mix or language are left out, a null or negative weight
counts as 0. A language without stock reaches nothing. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Targets up to which the solved duals are broadcast (five numbers each).
BROADCAST_TARGETS = 50_000
_BUCKETS = 4096


def _plain(name: str):
    return F.lower(F.regexp_replace(F.col(name), r"(?U)^\s+|\s+$", ""))


def distinct_blocks(blocks: DataFrame, split: str | None = "train") -> DataFrame:
    """``(id, language, n)``: each block of the split once, with its number of tokens that are not special.

    Deliveries of one block are combined before they move: its language is the least one stated, its
    size the largest.
    """
    n = F.coalesce(F.size(F.filter("special_tokens_mask", lambda x: x == 0)), F.lit(0)).cast("bigint")
    rows = blocks.where("id is not null" if split is None else (F.col("id").isNotNull() & (F.col("split") == split)))
    rows = rows.select("id", F.nullif(_plain("language"), F.lit("")).alias("language"), F.greatest(n, F.lit(0)).alias("n"))
    return rows.groupBy("id").agg(F.min("language").alias("language"), F.max("n").alias("n")).where("language is not null")


def targets_of(targets: DataFrame) -> DataFrame:
    """``(mix, language, cap, share, wanted)``: the tokens that each language should give."""
    t = targets.select(
        "mix", _plain("language").alias("language"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"),
        F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap"), F.coalesce("budget_tokens", F.lit(0)).alias("budget"),
    ).where("mix is not null and language is not null")
    total = t.groupBy("mix").agg(F.sum("weight").alias("total"))
    return t.join(total, "mix").select(
        "mix", "language", "cap",
        F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(0.0).alias("share"),
        F.when(F.col("total") > 0, F.col("weight") / F.col("total") * F.col("budget")).otherwise(0.0).alias("wanted"),
    )


def solve(histogram: DataFrame, targets: DataFrame, tolerance: float = 1e-6, max_steps: int = 200) -> list[dict]:
    """Duals of all targets. ``histogram`` is ``(language, n, blocks)``.

    Each result has ``mix, language, share, wanted, cap, stock, mean, dual, reachable``. A target is
    reachable if a finite dual was met at which the rates give at least what is wanted. If they
    give less although every block is at its cap, no finite dual exists: the target is
    unreachable, its dual infinite. Every target ends as one or the other, or an error is raised.
    """
    spark = histogram.sparkSession
    sums = {r["language"]: r for r in histogram.groupBy("language").agg(F.sum(F.col("n") * F.col("blocks")).alias("stock"), F.sum("blocks").alias("blocks")).collect()}  # one row a language
    found = []
    for r in targets.collect():  # one row for each mix and language
        s = sums.get(r["language"])
        stock = int(s["stock"]) if s else 0
        d = {"stock": stock, "mean": max(1.0, stock / s["blocks"]) if s else 1.0, "dual": 0.0, "reachable": None, "low": -math.inf, "high": math.inf, "stride": 4.0}
        if r["wanted"] <= 0:
            d |= {"dual": -math.inf, "reachable": True}
        found.append(r.asDict() | d)
    for _ in range(max_steps):
        open_ = [i for i, d in enumerate(found) if d["reachable"] is None]
        if not open_:
            return found
        duals = spark.createDataFrame([(i, found[i]["language"], float(found[i]["dual"] / found[i]["mean"]), float(found[i]["cap"])) for i in open_], "i int, language string, slope double, cap double")
        rate = F.exp(F.least(F.col("slope") * F.col("n"), F.lit(60.0)))
        tokens = F.col("n") * F.col("blocks")
        steps = (
            histogram.join(duals, "language")
            .groupBy("i")
            .agg(
                F.sum(tokens * F.least(rate, F.col("cap"))).alias("value"),
                F.sum(F.when(rate < F.col("cap"), tokens * F.col("n") * rate).otherwise(0.0)).alias("slope"),
                F.max((rate < F.col("cap")) & (tokens > 0)).alias("below"),
            )
            .collect()  # one row for each open target
        )
        met = {r["i"]: (r["value"], r["slope"], r["below"]) for r in steps}
        for i in open_:
            _step(found[i], *met.get(i, (0.0, 0.0, False)), tolerance)
    raise RuntimeError(f"no dual after {max_steps} steps: {[(d['mix'], d['language']) for d in found if d['reachable'] is None]}")


def _step(d: dict, value: float, slope: float, below: bool, tolerance: float) -> None:
    """One Newton step of one target, kept inside the bracket of duals tried so far."""
    gap, dual = value - d["wanted"], d["dual"]
    close = abs(gap) <= tolerance * max(1.0, d["wanted"])
    if gap >= 0:
        d["high"] = dual
        if close:
            d["reachable"] = True
            return
    elif not below:  # every block at its cap, and still too little
        d["dual"], d["reachable"] = math.inf, False
        return
    else:
        d["low"] = dual
    if d["high"] - d["low"] <= 1e-13 * max(1.0, abs(dual)):
        d["dual"], d["reachable"] = d["high"], True
        return
    curve = slope / d["mean"]
    move = -gap / curve if curve > 0 else math.copysign(math.inf, -gap)
    if close:  # from below: go past the dual, so that it is known to exist
        move = max(2 * move, 1e-12 * max(1.0, abs(dual)))
    if abs(move) > d["stride"]:
        move = math.copysign(d["stride"], move)
        d["stride"] *= 2
    new = dual + move
    if not d["low"] < new < d["high"]:
        new = (d["low"] + d["high"]) / 2
    d["dual"] = new


def _solved(blocks: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[dict]]:
    once = cut(distinct_blocks(blocks))
    histogram = cut(once.groupBy("language", "n").agg(F.count("*").alias("blocks")))
    return once, solve(histogram, targets_of(targets))


def unreachable(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix, language)`` of the targets that no rates within the caps can reach."""
    _, found = _solved(blocks, targets)
    return blocks.sparkSession.createDataFrame([(d["mix"], d["language"]) for d in found if not d["reachable"]], "mix string, language string")


def _rated(blocks: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    once, found = _solved(blocks, targets)
    rows = [(d["mix"], d["language"], float(d["share"]), float(d["wanted"]), int(d["cap"]), int(d["stock"]), float(max(-1e6, min(1e6, d["dual"])) / d["mean"]), d["reachable"]) for d in found]
    solved = blocks.sparkSession.createDataFrame(
        rows, "mix string, language string, share double, wanted double, cap int, stock bigint, slope double, reachable boolean"
    )
    side = F.broadcast(solved) if len(rows) <= BROADCAST_TARGETS else solved
    exponent = F.greatest(F.least(F.col("slope") * F.col("n"), F.lit(60.0)), F.lit(-700.0))
    u = F.pmod(F.xxhash64("id", "mix"), F.lit(1 << 40)) / float(1 << 40)
    rated = (
        once.join(side, "language")
        .withColumn("rate", F.when(~F.col("reachable"), F.col("cap").cast("double")).otherwise(F.least(F.exp(exponent), F.col("cap").cast("double"))))
        .withColumn("base", F.floor("rate"))
        .withColumn("v", F.when(F.col("rate") >= F.col("cap"), F.lit(2.0)).otherwise(u - (F.col("rate") - F.col("base"))))
    )
    return rated, solved


def _rounded(rated: DataFrame, spark) -> DataFrame:
    """Copies from rates: one more than the floor where the hash falls below a threshold chosen
    from a histogram of fixed size for each (mix, language)."""
    bucket = F.floor((F.col("v") + 1) * (_BUCKETS / 2)).cast("int")
    rows = (
        rated.withColumn("bucket", F.when(F.col("v") <= 1, bucket))
        .groupBy("mix", "language", "bucket")
        .agg(F.sum(F.col("n") * F.col("base")).alias("sure"), F.sum("n").alias("more"), F.first("wanted").alias("wanted"))
        .collect()  # at most _BUCKETS + 2 rows for each mix and language
    )
    by: dict[tuple, dict] = {}
    for r in rows:
        d = by.setdefault((r["mix"], r["language"]), {"sure": 0, "wanted": r["wanted"], "more": {}})
        d["sure"] += r["sure"]
        if r["bucket"] is not None:
            d["more"][r["bucket"]] = r["more"]
    edges = []
    for (mix, language), d in by.items():
        total, best, edge = d["sure"], abs(d["sure"] - d["wanted"]), 0
        for b in sorted(d["more"]):
            total += d["more"][b]
            if abs(total - d["wanted"]) < best:
                best, edge = abs(total - d["wanted"]), b + 1
        edges.append((mix, language, edge))
    side = spark.createDataFrame(edges, "mix string, language string, edge int")
    side = F.broadcast(side) if len(edges) <= BROADCAST_TARGETS else side
    extra = F.when((F.col("v") <= 1) & (bucket < F.col("edge")), 1).otherwise(0)
    return rated.join(side, ["mix", "language"]).withColumn("copies", (F.col("base") + extra).cast("int"))


def mix_copies(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix, id, language, n_tokens, copies)`` of all blocks that take part in a mix (copies above 0)."""
    rated, _ = _rated(blocks, targets)
    return _rounded(rated, blocks.sparkSession).where("copies > 0").select("mix", "id", "language", F.col("n").alias("n_tokens"), "copies")


def mix_report(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: the wanted and reached tokens and shares, stock, cap and most copies."""
    rated, solved = _rated(blocks, targets)
    reached = (
        _rounded(rated, blocks.sparkSession)
        .groupBy("mix", "language")
        .agg(F.sum(F.col("n") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    )
    joined = solved.join(reached, ["mix", "language"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = joined.groupBy("mix").agg(F.sum("tokens").alias("all_tokens"))
    return joined.join(total, "mix").select(
        "mix", "language", F.round("share", 6).alias("share_wanted"), F.round("wanted", 3).alias("tokens_wanted"), F.col("tokens").alias("tokens_reached"),
        F.round(F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0), 6).alias("share_reached"),
        F.col("stock").alias("stock_tokens"), F.col("cap").alias("max_repeats"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "reachable",
    )

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import running as module
from quern.operators.running import running


@pytest.mark.parametrize("others, long", [(False, 10), (True, 10), (False, 10_000), (True, 10_000)])
def test_running_values_against_a_loop(spark, monkeypatch, others, long):
    monkeypatch.setattr(module, "LONG", long)
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([None, rng.randrange(50)])) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(3)
    got = running(df, ["g"], ["i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")), "n": ("next", F.col("v"))}, others)
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((i, v) for x, i, v in rows if x == g)
        for k, (i, _) in enumerate(mine):
            before = [v for _, v in mine[: k if others else k + 1] if v is not None]
            after = [v for _, v in mine[k + 1 if others else k :] if v is not None]
            want[i] = (sum(before), max(before, default=None), before[-1] if before else None, after[0] if after else None)
    assert {r.i: (r.s, r.m, r.l, r.n) for r in got.collect()} == want
    assert got.columns == ["g", "i", "v", "s", "m", "l", "n"] and running(df.limit(0), ["g"], ["i"], {"s": ("sum", F.lit(1))}).count() == 0

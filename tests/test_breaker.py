"""The batch breaker against a plain loop: all events in one batch, slots of any size."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.plans import adapt


def loop(items, limit):
    """{id: processed}, kind of the error that ended it."""
    out, run, by, ended = {}, 0, None, False
    for at, error in sorted(items):
        out[at] = not ended
        run = run + 1 if error else 0
        if not ended and (error in adapt.ABORT or run >= limit):
            ended, by = True, error
    return out, by


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_breaker_equals_a_loop(spark, monkeypatch, width):
    monkeypatch.setattr("tessera.operators.skew.HOT_LEAST", 2)
    rng = random.Random(width)
    batches = {b: [(k, rng.choices([None, "rede", "indisponivel", "quota"], (12, 6, 2, b % 2 * 0.3))[0]) for k in range(rng.choice((1, 9, 40)))] for b in range(40)}
    batches |= {100: [(k, "rede" if k >= 20 else None) for k in range(40)], 101: [(k, "rede" if k % 3 else None) for k in range(60)], 102: [(k, None) for k in range(30)], None: [(k, "rede") for k in range(9)]}
    rows = [(b, k, e) for b, items in batches.items() for k, e in items]
    df = spark.createDataFrame(rows, "batch long, k long, error string").repartition(3)
    slot = F.floor(F.col("k") / width)
    for limit in (3, 5):
        want = {b: loop(items, limit) for b, items in batches.items()}
        got = adapt.breaker(df, "batch", ("k",), limit=limit, slot=slot).collect()
        assert {(r["batch"], r["k"], r["processed"]) for r in got} == {(b, k, p) for b, (told, _) in want.items() for k, p in told.items()} and len(got) == len(rows)
        sums = {r["batch"]: (r["seen"], r["deferred"], r["aborted_by"]) for r in adapt.deferred(df, "batch", ("k",), limit=limit, slot=slot).collect()}
        assert sums == {b: (len(told), sum(not p for p in told.values()), by) for b, (told, by) in want.items()}

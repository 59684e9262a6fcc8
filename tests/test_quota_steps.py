"""The step functions of the quota replay, without Spark: any cuts, any grouping, against counting one by one."""

import random

import numpy as np
import pyarrow as pa

from parapet.operators import quota


def chunk(part, times):
    n = len(times)
    return pa.table({"key": ["k"] * n, "run": pa.array([0] * n, pa.int64()), "part": pa.array([part] * n, pa.int64()),
                     "us": pa.array(times, pa.int64())})


def entries(steps, levels, width, fan):
    if levels == 0:
        walked = quota._walk(pa.concat_tables(steps), quota._BEGINNING, width)
        return dict(zip(walked.column("part").to_pylist(), walked.column("at").to_pylist()))
    groups = {}
    for step in steps:
        groups.setdefault(step.column("part")[0].as_py() // fan, []).append(step)
    above = entries([quota._composed(width, fan)(pa.concat_tables(g)) for g in groups.values()], levels - 1, width, fan)
    out = {}
    for parent, members in groups.items():
        walked = quota._walk(pa.concat_tables(members), above[parent], width)
        out |= dict(zip(walked.column("part").to_pylist(), walked.column("at").to_pylist()))
    return out


def test_openings_for_any_cuts():
    rng = random.Random(5)
    for _ in range(400):
        width, span = rng.choice([5, 10, 60]), rng.choice([50, 300, 2000])
        times = sorted(rng.randint(0, span) for _ in range(rng.randint(1, 200)))
        cuts = rng.sample(range(span), rng.randint(0, 12))
        parts = {}
        for t in times:
            parts.setdefault(sum(c <= t for c in cuts), []).append(t)
        steps = [quota._chunk_steps(width)(chunk(p, ts)) for p, ts in parts.items()]
        at, got = entries(steps, rng.randint(0, 3), width, rng.choice([2, 3, 64])), []
        for p, ts in parts.items():
            ticks = np.unique(ts)
            i = np.searchsorted(ticks, at[p])
            while i < len(ticks):
                got.append(int(ticks[i]))
                i = np.searchsorted(ticks, got[-1] + width)
        wanted = []
        for t in times:
            if not wanted or t - wanted[-1] >= width:
                wanted.append(t)
        assert got == wanted

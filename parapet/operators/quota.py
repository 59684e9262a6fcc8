"""Replay of request quotas: fixed windows anchored at a key's first request.

For every key a window opens with its first request; a request at least one window length after the opening opens the
next one. This is neither a sliding window nor one aligned to the clock, and each opening depends on the one before.
What makes it parallel:

* Cut time into slots one window long. A key opens at most one window per slot, and which slots a key touches is a small
  table (``slots``), summed up before its shuffle; a key with a third of all rows adds no more rows to it than the time
  span has slots.
* A pause of a window length always ends the window, whatever came before. So slots fall into independent *runs*. A run
  of one slot opens at its first request; short runs are folded inside one row each by a Spark aggregate function.
* A long run (a hot key that never pauses) is cut into chunks by time, busy slots into several. A chunk turns the
  earliest time a window may open into the last opening inside it; this step function is computed for all chunks at
  once, composed in groups, level by level, and read back down, so no task ever holds a whole run.
"""

from __future__ import annotations

from itertools import groupby
from math import ceil, log
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from parapet.functions import fixed
from parapet.functions.clock import epoch_micros, from_micros, slot
from parapet.operators.running import running_total
from parapet.policy import QuotaRule
from parapet.sources.session import cut

MICROS = 1_000_000
FOLD_ROWS = 2_048      # runs up to this many requests are folded in one array
CHUNK_ROWS = 200_000   # longer runs are cut after about this many requests
CHUNKS_PER_GROUP = 64  # step functions composed in one task
_BEGINNING = -(2 ** 62)


def scope_key(scope: str) -> Column:
    """The counter a request belongs to under a scope; an unknown scope is one counter for all."""
    known = fixed.QUOTA_KEYS.get(scope.lower())
    if known is None:
        return F.lit(fixed.QUOTA_GLOBAL_KEY)
    prefix, column, missing = known
    return F.concat(F.lit(prefix), F.coalesce(F.col(column).cast("string"), F.lit(missing)))


# --- openings ------------------------------------------------------------------------------------------------------

def _slots(times: DataFrame, width: int) -> DataFrame:
    """Per key and slot: first time, requests, the run it is in, and the requests of the run before it."""
    by_key = Window.partitionBy("key").orderBy("slot")
    by_run = Window.partitionBy("key", "run")
    pause = F.col("first") - F.lag("last").over(by_key)
    upto = by_key.rowsBetween(Window.unboundedPreceding, 0)
    return (times.groupBy("key", "slot")
            .agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n"))
            .withColumns({"opens_run": pause.isNull() | (pause >= width),
                          "before": F.sum("n").over(upto) - F.col("n")})
            .withColumns({"run": F.max(F.when(F.col("opens_run"), F.col("slot"))).over(upto),
                          "run_before": F.max(F.when(F.col("opens_run"), F.col("before"))).over(upto)})
            .withColumn("offset", F.col("before") - F.col("run_before"))
            .withColumns({"run_n": F.sum("n").over(by_run), "run_slots": F.count("*").over(by_run)})
            .select("key", "slot", "first", "n", "run", "run_n", "run_slots", "offset"))


def _folded(times: DataFrame, short: DataFrame, width: int) -> DataFrame:
    """Openings of short runs: one bounded array per run, folded by ``aggregate`` inside the JVM."""
    ticks = (times.join(short.select("key", "slot", "run"), ["key", "slot"])
             .groupBy("key", "run").agg(F.array_sort(F.collect_set("us")).alias("ticks")))
    start = F.struct(F.lit(_BEGINNING).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("all"))
    fold = F.aggregate("ticks", start, lambda acc, t: F.when(
        t >= acc["last"] + width,
        F.struct(t.alias("last"), F.concat(acc["all"], F.array(t)).alias("all"))).otherwise(acc), lambda acc: acc["all"])
    return ticks.select("key", F.explode(fold).alias("opening"))


_STEPS = "key string, run bigint, part bigint, xs array<bigint>, ys array<bigint>"
_ENTRY = "key string, run bigint, part bigint, at bigint"


def _step(xs: np.ndarray, ys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Last opening for each earliest opening time ``at``; -1 where the part opens none."""
    i = np.searchsorted(xs, at, side="left")
    return np.where(i < len(xs), ys[np.minimum(i, len(xs) - 1)], -1)


def _squeezed(xs: np.ndarray, ys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Only the thresholds that matter.

    The window open on entry began no later than the first request here, so the next one may open a window length after
    that at the latest; and of thresholds that lead to the same opening the last one is enough.
    """
    n = int(np.searchsorted(xs, xs[0] + width, side="left")) + 1
    xs, ys = xs[:n], ys[:n]
    keep = np.append(ys[1:] != ys[:-1], True)
    return xs[keep], ys[keep]


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _parts(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    table = table.sort_by("part")
    lists = [[x.values.to_numpy() for x in table.column(name)] for name in ("xs", "ys")]
    return list(zip(table.column("part").to_pylist(), *lists))


def _same(table: pa.Table, count: int, **columns) -> pa.Table:
    """``count`` rows of the group's key and run plus the given columns."""
    first = {name: pa.array([table.column(name)[0].as_py()] * count, kind)
             for name, kind in (("key", pa.string()), ("run", pa.int64()))}
    return pa.table(first | columns)


def _one(table: pa.Table, part: int, xs: np.ndarray, ys: np.ndarray) -> pa.Table:
    kind = pa.list_(pa.int64())
    return _same(table, 1, part=pa.array([part], pa.int64()), xs=pa.array([xs], kind), ys=pa.array([ys], kind))


def _chunk_steps(width: int):
    def steps(table: pa.Table) -> pa.Table:
        ticks = np.unique(_numbers(table, "us"))
        after = np.searchsorted(ticks, ticks + width, side="left")
        last = np.where(after < len(ticks), after, np.arange(len(ticks)))
        while True:  # follow the openings in strides that double
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        return _one(table, table.column("part")[0].as_py(), *_squeezed(ticks, ticks[last], width))

    return steps


def _composed(width: int, fan: int):
    def compose(table: pa.Table) -> pa.Table:
        (part, xs, ys), *others = _parts(table)
        for _, nx, ny in others:
            moved = _step(nx, ny, ys + width)
            # An entry later than all requests so far meets the next part as it is.
            xs, ys = np.append(xs, nx), np.append(np.where(moved >= 0, moved, ys), ny)
            xs, ys = _squeezed(xs, ys, width)
        return _one(table, part // fan, xs, ys)

    return compose


def _walk(table: pa.Table, at: int, width: int) -> pa.Table:
    """Earliest opening time on entry to every part of a group, given that of the group."""
    numbers, entries = [], []
    for part, xs, ys in _parts(table):
        numbers.append(part)
        entries.append(at)
        opened = int(_step(xs, ys, np.array([at]))[0])
        at = opened + width if opened >= 0 else at
    return _same(table, len(entries), part=pa.array(numbers, pa.int64()), at=pa.array(entries, pa.int64()))


def _entries(steps: DataFrame, levels: int, width: int, fan: int) -> DataFrame:
    """Earliest opening time on entry to every part: compose upwards, read back downwards."""
    if levels == 0:
        return steps.groupBy("key", "run").applyInArrow(lambda table: _walk(table, _BEGINNING, width), _ENTRY)
    groups = ["key", "run", "parent"]
    parts = steps.withColumn("parent", F.floor(F.col("part") / fan).cast("bigint"))
    above = cut(parts.groupBy(*groups).applyInArrow(_composed(width, fan), _STEPS))
    given = _entries(above, levels - 1, width, fan).withColumnRenamed("part", "parent")

    def down(table: pa.Table, entry: pa.Table) -> pa.Table:
        return _walk(table, entry.column("at")[0].as_py(), width)

    return parts.groupBy(*groups).cogroup(given.groupBy(*groups)).applyInArrow(down, _ENTRY)


def _chunked(times: DataFrame, long: DataFrame, chunks: int, width: int, fan: int) -> DataFrame:
    """Openings of long runs. Only the depth of the composition depends on the number of chunks."""
    # A request's rank in its run, estimated by its time within the slot: grows with time, so chunks are time ranges.
    rank = F.col("offset") + F.col("n") * (F.col("us") - F.col("slot") * width) / width
    ticks = (times.join(long.select("key", "slot", "run", "offset", "n"), ["key", "slot"])
             .select("key", "run", F.floor(rank / CHUNK_ROWS).cast("bigint").alias("part"), "us")
             .distinct())  # many requests may share one time; a chunk needs every time once
    groups = ["key", "run", "part"]
    steps = cut(ticks.groupBy(*groups).applyInArrow(_chunk_steps(width), _STEPS))
    levels = max(0, ceil(log(max(chunks, 1), fan)) - 1)
    entries = _entries(steps, levels, width, fan)

    def openings(table: pa.Table, entry: pa.Table) -> pa.Table:
        ticks, found = np.unique(_numbers(table, "us")), []
        i = int(np.searchsorted(ticks, entry.column("at")[0].as_py(), side="left"))
        while i < len(ticks):
            found.append(int(ticks[i]))
            i = int(np.searchsorted(ticks, found[-1] + width, side="left"))
        return _same(table, len(found), opening=pa.array(found, pa.int64())).select(["key", "opening"])

    return (ticks.groupBy(*groups).cogroup(entries.groupBy(*groups))
            .applyInArrow(openings, "key string, opening bigint"))


def openings(times: DataFrame, width: int) -> DataFrame:
    """All window openings ``key, opening`` of ``times`` (``key, us, slot``)."""
    slots = cut(_slots(times, width))
    is_long = (F.col("run_slots") > 1) & (F.col("run_n") > FOLD_ROWS)
    longest = slots.agg(F.max(F.when(is_long, F.col("run_n")))).first()[0] or 0
    single = slots.filter("run_slots = 1").select("key", F.col("first").alias("opening"))
    several = slots.filter("run_slots > 1")
    folded = _folded(times, several.filter(F.col("run_n") <= FOLD_ROWS), width)
    found = single.unionByName(folded)
    if longest:  # each run is folded or chunked by its own length; only an empty table of long runs is left out
        found = found.unionByName(_chunked(times, slots.filter(is_long), longest // CHUNK_ROWS + 1, width, CHUNKS_PER_GROUP))
    return found


# --- replay --------------------------------------------------------------------------------------------------------

def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass down a range of requests and openings in order: the opening a request follows, and its number after it.

    Before the first opening of the range the opening is null and numbers count from the head of the range.
    """
    part, opened, count, at = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        us, is_request = batch.column("__us").to_numpy(), batch.column("__request").to_numpy()
        mark = np.maximum.accumulate(np.where(is_request == 1, -1, np.arange(rows)))
        total = np.cumsum(is_request)
        inside = mark >= 0
        opening = np.where(inside, us[mark], 0 if opened is None else opened)
        n = np.where(inside, total - total[mark], total + count)
        known = inside | (opened is not None)
        columns = [np.full(rows, part, np.int32), np.arange(at, at + rows), pa.array(opening, mask=~known), n.astype(np.int64)]
        for name, column in zip(("__range", "__at", "__open", "__n"), columns):
            batch = batch.append_column(name, column if isinstance(column, pa.Array) else pa.array(column))
        yield batch
        opened, count, at = int(opening[-1]) if known[-1] else None, int(n[-1]), at + rows


def replay(df: DataFrame, key: Column, ts: str, request_id: str, limit: int | None = None,
           window_seconds: int = fixed.QUOTA_WINDOW_SECONDS) -> DataFrame:
    """Adds ``quota_key``, ``window_start``, ``n`` (the request's number in its window) and, with a limit, ``denied``.

    Denied requests still count. Requests at the same time are ordered by ``request_id``; those without a time count as
    the earliest. All columns of ``df`` are shuffled with the keys, so leave long texts out (as ``replay_rules`` does).

    Openings are put among the requests as rows of their own and both are dealt out by ranges of (key, time, id), so a hot
    key, and even one timestamp of it, is many ranges. One pass down each range numbers its requests; a window that
    began in an earlier range is continued from a table with one row per range.
    """
    width = window_seconds * MICROS
    rows = df.withColumns({"quota_key": key, "__us": F.coalesce(epoch_micros(df, ts), F.lit(0).cast("bigint")),
                           "__request": F.lit(1)})
    times = rows.select(F.col("quota_key").alias("key"), F.col("__us").alias("us"), slot(F.col("__us"), width).alias("slot"))
    marks = cut(openings(times, width)).select(F.col("key").alias("quota_key"), F.col("opening").alias("__us"), F.lit(0).alias("__request"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["quota_key", "__us", "__request", request_id]
    dealt = both.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in both.schema.fields])
    for name, kind in (("__range", T.IntegerType()), ("__at", T.LongType()), ("__open", T.LongType()), ("__n", T.LongType())):
        schema.add(name, kind)
    passed = cut(dealt.mapInArrow(_numbered, schema))
    tails = passed.groupBy("__range").agg(F.max(F.struct("__at", "__open", "__n")).alias("tail"))
    upto = Window.orderBy("__range")
    tails = tails.withColumn("run", F.count("tail.__open").over(upto))  # ranges since an opening
    since = Window.partitionBy("run").orderBy("__range")
    tails = tails.select("__range", F.first("tail.__open").over(since).alias("open"), F.sum("tail.__n").over(since).alias("n"))
    carried = tails.select("__range", F.lag("open").over(upto).alias("__carried"), F.lag("n").over(upto).alias("__before"))
    late = F.col("__open").isNull()
    placed = passed.filter("__request = 1").join(F.broadcast(carried), "__range")  # a row per range
    out = placed.select(*df.columns, "quota_key", from_micros(F.when(late, F.col("__carried")).otherwise(F.col("__open"))).alias("window_start"),
                        (F.col("__n") + F.when(late, F.col("__before")).otherwise(F.lit(0))).alias("n"))
    return out if limit is None else out.withColumn("denied", F.col("n") > limit)


def _counter(rule: QuotaRule) -> str:
    return fixed.QUOTA_KEYS.get(rule.scope.lower(), (fixed.QUOTA_GLOBAL_KEY,))[0]


def verdicts(limits: Sequence[int]) -> list[tuple[int | None, int]]:
    """Which of several limits on one counter denies the requests of a window: ``(last request, position of the limit)``.

    A request adds one to the counter for every limit it comes to, and stops at the first it exceeds. What it adds falls
    as the counter rises, so a window has at most one stretch of requests per limit, and one in which all pass (position
    ``len(limits)``) before them. Every window begins at 0: the stretches are the same for all. The last has no end (None).
    """
    found: list[tuple[int | None, int]] = []
    counter = requests = 0
    while True:
        stop = next((i for i, limit in enumerate(limits) if counter + i + 1 > limit), len(limits))
        added = min(stop + 1, len(limits))
        # the stretch lasts while no limit before the one that denies is exceeded
        room = [limit - i - 1 - counter for i, limit in enumerate(limits[:stop])]
        if not room:
            return [*found, (None, stop)]
        more = min(room) // added + 1
        counter, requests = counter + more * added, requests + more
        found.append((requests, stop))


def replay_rules(df: DataFrame, rules: Sequence[QuotaRule], ts: str, request_id: str,
                 window_seconds: int = fixed.QUOTA_WINDOW_SECONDS) -> DataFrame:
    """Apply quota rules in order. Adds ``denied``, ``denied_by`` (scope) and ``deny_reason``.

    The first violated rule denies; later rules do not count that request. Rules without a request limit are skipped.
    Neighbouring limits that share a counter (the same scope, or several unknown ones) both count on it, so that a
    request adds as many as it comes to; they are replayed once, together. A counter that comes back after another one's
    limit is refused: its count would hang on decisions of all other keys. Request ids are unique.
    """
    limited = [r for r in rules if r.requests_per_minute is not None]
    groups = [list(own) for _, own in groupby(limited, key=_counter)]
    if len({_counter(g[0]) for g in groups}) != len(groups):
        raise ValueError("limits that share a counter must follow each other")
    # Only ids, times and scope columns go through the counting; the rest of the request (its texts) stays where it is.
    scoped = [fixed.QUOTA_KEYS[g[0].scope.lower()][1] for g in groups if g[0].scope.lower() in fixed.QUOTA_KEYS]
    needed = dict.fromkeys([request_id, ts, *scoped])
    open_rows, denied = df.select(*needed), None
    for own in groups:
        seen = replay(open_rows, scope_key(own[0].scope), ts, request_id, None, window_seconds)
        rule = F.lit(None).cast("int")
        for last, position in reversed(verdicts([r.requests_per_minute for r in own])):
            which = F.lit(position if position < len(own) else None).cast("int")
            rule = which if last is None else F.when(F.col("n") <= last, which).otherwise(rule)
        seen = cut(seen.withColumn("__rule", rule))
        name = F.get(F.array(*[F.lit(r.scope) for r in own]), F.col("__rule"))
        reason = F.get(F.array(*[F.lit(fixed.REASON_ERROR + fixed.REASON_QUOTA % (r.scope, r.requests_per_minute)) for r in own]),
                       F.col("__rule"))
        part = seen.filter("__rule IS NOT NULL").select(request_id, name.alias("denied_by"), reason.alias("deny_reason"))
        denied = part if denied is None else denied.unionByName(part)
        open_rows = seen.filter("__rule IS NULL").select(*needed)
    if denied is None:
        none = F.lit(None).cast("string")
        return df.withColumns({"denied": F.lit(False), "denied_by": none, "deny_reason": none})
    # The denied requests are mostly few: adaptive execution then broadcasts them, by their measured size.
    return df.join(denied, request_id, "left").withColumn("denied", F.col("denied_by").isNotNull())


def usage_budget(df: DataFrame, key: Column, ts: str, request_id: str, cost: Column, tokens: Column,
                 budget: float | None = None) -> DataFrame:
    """Adds running ``spent`` and ``tokens_used`` per key and calendar month, and ``over_budget`` with a budget.

    A month of one key can be a third of all rows; ``running_total`` splits it.
    """
    staged = df.withColumns({"quota_key": key, "month": F.date_format(F.col(ts), "yyyy-MM"),
                             "__us": F.coalesce(epoch_micros(df, ts), F.lit(0).cast("bigint"))})
    staged = staged.withColumn("month", F.coalesce("month", F.lit("unknown")))
    out = running_total(staged, ["quota_key", "month"], "__us", [request_id],
                        {"spent": cost, "tokens_used": tokens}).drop("__us")
    return out if budget is None else out.withColumn("over_budget", F.col("spent") > F.lit(budget))

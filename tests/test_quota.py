import random

import pytest
from pyspark.sql import functions as F

from parapet.operators import quota
from parapet.operators.running import running_total
from parapet.policy import QuotaRule

T0 = 1_704_067_200_000_000
SECOND = 1_000_000


def brute(rows, window):
    out, state = {}, {}
    for key, us, number in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        opened, n = state.get(key, (None, 0))
        opened, n = (us, 1) if opened is None or us - opened >= window * SECOND else (opened, n + 1)
        state[key] = opened, n
        out[number] = opened, n
    return out


def replayed(spark, rows, window=60):
    df = spark.createDataFrame(rows, "k string, us long, id long")
    out = quota.replay(df, F.col("k"), "us", "id", None, window)
    return {r["id"]: (r["w"], r["n"]) for r in out.select("id", F.unix_micros("window_start").alias("w"), "n").collect()}


def random_rows():
    rng = random.Random(7)
    return [(f"u{rng.randint(0, 5)}", T0 + rng.randint(0, 3000) * SECOND, i) for i in range(600)]


def hot_rows():
    """One key with most rows that never pauses, and many quiet ones."""
    rng = random.Random(8)
    hot = [("hot", T0 + rng.randint(0, 3600 * 1000) * 1000, i) for i in range(3000)]
    return hot + [(f"u{i % 40}", T0 + rng.randint(0, 86400) * SECOND, 10_000 + i) for i in range(1000)]


def grid_rows():
    """Requests on and around slot borders, equal times, times before 1970."""
    return ([("seven", T0 + i * 7 * SECOND, i) for i in range(900)]
            + [("minute", i * 60 * SECOND, 2000 + i) for i in range(200)]
            + [("jitter", i * 60 * SECOND - (i * 7919 % 60), 3000 + i) for i in range(200)]
            + [("same", T0, 4000 + i) for i in range(50)]
            + [("old", -90 * SECOND + i * 25 * SECOND, 5000 + i) for i in range(20)])


@pytest.mark.parametrize("rows", [random_rows, hot_rows, grid_rows])
@pytest.mark.parametrize("sizes", [(2048, 200_000, 64), (40, 60, 3)])
def test_replay_is_the_sequential_count(spark, monkeypatch, rows, sizes):
    for name, value in zip(("FOLD_ROWS", "CHUNK_ROWS", "CHUNKS_PER_GROUP"), sizes):
        monkeypatch.setattr(quota, name, value)
    given = rows()
    assert replayed(spark, given) == brute(given, 60)


def test_long_runs_are_composed_over_several_levels(spark, monkeypatch):
    for name, value in (("FOLD_ROWS", 10), ("CHUNK_ROWS", 25), ("CHUNKS_PER_GROUP", 3)):
        monkeypatch.setattr(quota, name, value)
    given = hot_rows()
    assert replayed(spark, given) == brute(given, 60)


def test_busy_slots_are_cut_too(spark, monkeypatch):
    """Hundreds of requests per slot, many at the same time, chunks far shorter than a window."""
    for name, value in (("FOLD_ROWS", 10), ("CHUNK_ROWS", 15), ("CHUNKS_PER_GROUP", 3)):
        monkeypatch.setattr(quota, name, value)
    rng = random.Random(11)
    given = [("hot", T0 + rng.randint(0, 400) * SECOND + rng.choice((0, 0, 0, 1, 7)) * 1000, i) for i in range(2000)]
    given += [("burst", T0 + 59 * SECOND + rng.randint(0, 900) * 1000, 5000 + i) for i in range(300)]
    given += [("burst", T0 + 118 * SECOND + rng.randint(0, 2000) * 1000, 6000 + i) for i in range(300)]
    assert replayed(spark, given) == brute(given, 60)


def test_window_is_anchored_not_sliding(spark):
    got = replayed(spark, [("k", T0, 1), ("k", T0 + 59 * SECOND, 2), ("k", T0 + 60 * SECOND, 3)])
    assert [got[i][1] for i in (1, 2, 3)] == [1, 2, 1]


def test_scope_keys(spark):
    df = spark.createDataFrame([("u", None, "a")], "user_id string, tenant_id string, application_id string")
    keys = [df.select(quota.scope_key(s)).first()[0] for s in ("User", "tenant", "application", "galaxy")]
    assert keys == ["rate:user:u", "rate:tenant:default", "rate:app:a", "rate:global"]
    none = spark.createDataFrame([(None, None, None)], df.schema)
    assert none.select(quota.scope_key("user")).first()[0] == "rate:user:anonymous"


def test_rules_in_order(spark):
    seconds = [("u1", "t", 0), ("u1", "t", 1), ("u1", "t", 2), ("u2", "t", 3), ("u3", "t", 4)]
    df = spark.createDataFrame([(i, u, t, T0 + s * SECOND) for i, (u, t, s) in enumerate(seconds)],
                               "id long, user_id string, tenant_id string, us long")
    rules = [QuotaRule("user", 1), QuotaRule("user", None, 5), QuotaRule("tenant", 2)]
    rows = quota.replay_rules(df, rules, "us", "id").orderBy("id").collect()
    # u1's second and third request are denied by the user rule and never reach the tenant's counter
    assert [r["denied_by"] for r in rows] == [None, "user", "user", None, "tenant"]
    assert rows[4]["deny_reason"] == "Gateway error: Rate limit exceeded for tenant: 2 requests/min"
    with pytest.raises(ValueError):  # a counter that comes back after another one's limit
        quota.replay_rules(df, [QuotaRule("other", 1), QuotaRule("user", 1), QuotaRule("global", 2)], "us", "id")


def test_request_without_time_is_kept(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", T0, 2)], "k string, us long, id long")
    assert quota.replay(df, F.col("k"), "us", "id").count() == 2


def test_running_total_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randint(0, 10_000), i, rng.randint(1, 9)) for i in range(2000)]
    rows += [("hot", 7, i, 1) for i in range(2000, 3000)]  # one key and one time: ties split it
    df = spark.createDataFrame(rows, "k string, us long, id long, v long")
    got = {r["id"]: r["total"] for r in running_total(df, ["k"], "us", ["id"], {"total": F.col("v")}).collect()}
    sums, wanted = {}, {}
    for k, us, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        sums[k] = sums.get(k, 0) + v
        wanted[i] = sums[k]
    assert got == wanted


def test_stream_counts_like_the_batch(spark, tmp_path):
    from parapet.streaming.quota import stream_quota

    given = random_rows()
    schema = "k string, us long, id long"
    for part in range(3):  # three files, one micro-batch each, in time order
        rows = [r for r in given if r[1] // (1000 * SECOND) - T0 // (1000 * SECOND) == part or (
            part == 2 and r[1] >= T0 + 2000 * SECOND and r[1] // (1000 * SECOND) - T0 // (1000 * SECOND) > 2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    counted = stream_quota(stream, F.col("k"), "us", "id", 5)
    query = (counted.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {r["request_id"]: (r["w"], r["n"])
           for r in out.select("request_id", F.unix_micros("window_start").alias("w"), "n").collect()}
    assert got == brute(given, 60)
    assert out.filter("denied <> (n > 5)").count() == 0


def test_idle_keys_leave_the_state():
    import pandas as pd

    from parapet.streaming.quota import _counter

    class State:
        exists, hasTimedOut, get, wait = False, False, None, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutDuration(self, ms):
            self.wait = ms

        def remove(self):
            self.exists, self.get = False, None

    state, count = State(), _counter(60 * SECOND, 90_000)
    rows = pd.DataFrame({"us": [T0, T0 + 59 * SECOND, T0 + 60 * SECOND], "request_id": ["r-1", "r-2", "r-3"]})
    out = pd.concat(count(("k",), iter([rows]), state))
    assert out["n"].tolist() == [1, 2, 1] and out["request_id"].tolist() == ["r-1", "r-2", "r-3"]
    assert state.get == (T0 + 60 * SECOND, 1) and state.wait == 90_000
    state.hasTimedOut = True
    assert not list(count(("k",), iter([]), state)) and not state.exists


@pytest.mark.parametrize("limits", [[3], [0, 4], [5, 3], [2, 2, 2], [10, 7, 8, 1], [1, 100, 3], [6, 1, 9, 4, 4]])
def test_stretches_of_shared_limits(limits):
    stretches, counter = quota.verdicts(limits), 0
    for n in range(1, 60):
        want = len(limits)
        for i, limit in enumerate(limits):
            counter += 1
            if counter > limit:
                want = i
                break
        got = next(position for last, position in stretches if last is None or n <= last)
        assert got == want, (limits, n)


def test_rules_sharing_counters_are_the_sequential_count(spark):
    rng = random.Random(5)
    rows = [(i, T0 + rng.randint(0, 400) * SECOND, rng.choice(["a", *"bcdefghijkl", None]), rng.choice(["x", "y", "z", None]), "t") for i in range(500)]
    rules = [QuotaRule("user", 6), QuotaRule("USER", 5), QuotaRule("tenant", None), QuotaRule("tenant", 6), QuotaRule("odd", 20),
             QuotaRule("other", 34)]
    state, want = {}, {}
    for i, us, user, tenant, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = None
        for rule in rules:
            if rule.requests_per_minute is None:
                continue
            key = {"user": f"u{user}", "tenant": f"t{tenant}"}.get(rule.scope.lower(), "global")
            opened, n = state.get(key, (None, 0))
            opened, n = (us, 1) if opened is None or us - opened >= 60 * SECOND else (opened, n + 1)
            state[key] = opened, n
            if n > rule.requests_per_minute:
                want[i] = rule.scope
                break
    df = spark.createDataFrame(rows, "id long, ts long, user_id string, tenant_id string, quota_text string")
    got = quota.replay_rules(df, rules, "ts", "id")
    assert {r["id"]: r["denied_by"] for r in got.collect()} == want and len(set(want.values())) > 4
    assert got.columns == [*df.columns, "denied_by", "deny_reason", "denied"]


def test_ranges_may_end_anywhere(spark):
    """More ranges than windows: most begin inside one."""
    rows = [("k", T0 + (i // 3) * SECOND, i) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert replayed(spark, rows) == brute(rows, 60) and replayed(spark, rows, 1000) == brute(rows, 1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


class FakeState:
    """What the processor needs of a state handle, with the sizes it was given."""

    def __init__(self):
        self.values, self.maps, self.timers, self.largest = {}, {}, set(), 0

    def getValueState(self, name, schema):
        outer = self

        class Value:
            def exists(self):
                return name in outer.values

            def get(self):
                return outer.values[name]

            def update(self, value):
                outer.values[name] = value

            def clear(self):
                outer.values.pop(name, None)

        return Value()

    def getMapState(self, name, key_schema, value_schema):
        outer = self

        class Map:
            def containsKey(self, key):
                return key in outer.maps

            def getValue(self, key):
                return outer.maps[key]

            def updateValue(self, key, value):
                outer.maps[key] = value

            def removeKey(self, key):
                del outer.maps[key]

            def keys(self):
                return iter(list(outer.maps))

        return Map()

    def registerTimer(self, at):
        self.timers.add(at)


@pytest.mark.parametrize("slice_seconds", [7, 60, 300])
def test_held_requests_are_counted_in_time_order_and_leave(slice_seconds):
    import pandas as pd
    from parapet.streaming.quota import _Ordered

    rng = random.Random(slice_seconds)
    rows = [("k", T0 + rng.randint(0, 4000) * SECOND, i) for i in range(700)]
    want = brute(rows, 60)
    state, processor, got = FakeState(), _Ordered(60 * SECOND, slice_seconds * SECOND, "bigint"), {}
    processor.init(state)

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    arrivals = sorted(rows, key=lambda r: r[1] + rng.randint(0, 200) * SECOND)  # out of order by up to 200 s
    seen = 0
    for at in range(0, len(arrivals), 50):
        frame = pd.DataFrame([(us, i) for _, us, i in arrivals[at:at + 50]], columns=["us", "request_id"])
        assert list(processor.handleInputRows(("k",), iter([frame]), None)) == []
        seen = max(seen, int(frame["us"].max()))
        passed = (seen - 200 * SECOND) // 1000
        for timer in sorted(t for t in state.timers if t <= passed):
            state.timers.discard(timer)
            for out in processor.handleExpiredTimer(("k",), Times(passed), None):
                assert out["us"].max() - out["us"].min() < slice_seconds * SECOND  # no frame above a slice
                got |= {i: (w, n) for i, w, n in zip(out["request_id"], out["window_us"], out["n"])}
    end = (T0 + 10_000 * SECOND) // 1000
    while state.timers:
        timer = min(state.timers)
        state.timers.discard(timer)
        for out in processor.handleExpiredTimer(("k",), Times(end), None):
            got |= {i: (w, n) for i, w, n in zip(out["request_id"], out["window_us"], out["n"])}
    assert got == want
    assert not state.maps and not state.values  # a key without requests has no state


@pytest.mark.parametrize("gathered, piece", [(200_000, 10_000), (40, 10), (1, 1)])
def test_keys_of_a_group_share_their_state(monkeypatch, gathered, piece):
    """400 keys in a group: calls to the state store go by pieces of requests, not by keys and slices."""
    import pandas as pd
    from parapet.streaming import quota as streaming

    monkeypatch.setattr(streaming, "GATHERED", gathered)
    monkeypatch.setattr(streaming, "PIECE", piece)
    rng = random.Random(gathered)
    rows = [(rng.choice([None, "hot", *map(str, range(400))]), T0 + rng.randint(0, 4000) * SECOND, i) for i in range(2000)]
    rows += [("hot", T0 + rng.randint(0, 4000) * SECOND, 5000 + i) for i in range(500)]
    want = brute([(k or "", us, i) for k, us, i in rows], 300)
    state, got, calls = FakeState(), {}, [0]
    make = state.getMapState

    def counted(*given):
        held = make(*given)
        for name in ("getValue", "updateValue", "removeKey"):
            def call(*args, own=getattr(held, name)):
                calls[0] += 1
                return own(*args)
            setattr(held, name, call)
        return held

    state.getMapState = counted
    processor = streaming._Ordered(300 * SECOND, 60 * SECOND, "bigint", "quota_key")
    processor.init(state)

    def fire(passed):
        class Times:
            getCurrentWatermarkInMs = staticmethod(lambda: passed)

        while due := [t for t in state.timers if t <= passed]:
            state.timers.discard(min(due))
            for out in processor.handleExpiredTimer((7,), Times, None):
                assert out["us"].max() - out["us"].min() < 60 * SECOND
                got.update({i: (k, w, n) for k, i, w, n in zip(out["quota_key"], out["request_id"], out["window_us"], out["n"])})

    arrivals, seen = sorted(rows, key=lambda r: r[1] + rng.randint(0, 200) * SECOND), 0
    for at in range(0, len(arrivals), 500):
        own = arrivals[at:at + 500]
        frames = [pd.DataFrame(own[k:k + 100], columns=["quota_key", "us", "request_id"]) for k in range(0, 500, 100)]
        assert list(processor.handleInputRows((7,), iter(frames), None)) == []
        seen = max(seen, max(us for _, us, _ in own))
        fire((seen - 200 * SECOND) // 1000)
    fire((T0 + 10_000 * SECOND) // 1000)
    assert {i: (w, n) for i, (_, w, n) in got.items()} == want and {i: k for i, (k, _, _) in got.items()} == {i: k for k, _, i in rows}
    assert not state.maps and not state.values and not state.timers
    assert gathered < 1000 or calls[0] < 50


def test_parts_of_events_may_be_several_files(spark, monkeypatch):
    from parapet.plans import queries

    monkeypatch.setattr(queries, "ARRIVAL_ROWS", 20)
    sf = "/root/testdata/sf0.001"
    want = {r["request_id"]: tuple(r) for r in queries.registered()["quota_replay"](spark, sf).collect()}
    got = {r["request_id"]: tuple(r) for r in queries.registered()["quota_stream_ordered"](spark, sf).collect()}
    assert len(got) > 0.9 * len(want) and all(want[i] == r for i, r in got.items())

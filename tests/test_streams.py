"""Streams over several micro-batches equal their batch twins."""

import datetime as dt
import random

from loomlight.operators import registry, runs
from loomlight.streaming import changelog, live
from tests.conftest import rows

START = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, event_id bigint, key string, op string"


def events(spark, folder, ops, n=600, files=4, seed=3):
    """Events in time order from file to file, shuffled inside each file."""
    rng = random.Random(seed)
    data = [
        (START + dt.timedelta(seconds=i // 3), i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(7)}", rng.choice(ops))
        for i in range(n)
    ]
    size = n // files
    for f in range(files):
        part = data[f * size : (f + 1) * size]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/f{f}")
    stream = (
        spark.readStream.schema(SCHEMA)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(str(folder))
    )
    return stream, spark.createDataFrame(data, SCHEMA)


def test_registry(spark, tmp_path):
    stream, batch = events(spark, tmp_path / "in", ["connect", "disconnect"])
    table = str(tmp_path / "out")
    live.registry_stream(stream, table, str(tmp_path / "offsets")).awaitTermination()
    counted = registry.registry_refcount(batch)
    columns = ["event_id", "key", "clients", "total_clients"]
    found = spark.read.parquet(f"{table}/calls")
    assert found.select("batch").distinct().count() == 4
    assert sorted(rows(found, *columns)) == sorted(rows(counted, *columns))
    ids = registry.registry_ids(registry.count_scan(batch))
    found = spark.read.parquet(f"{table}/projects")
    assert sorted(rows(found, "key", "project_id", "event_id")) == sorted(rows(ids, "key", "project_id", "event_id"))


def test_run_status(spark, tmp_path):
    stream, batch = events(spark, tmp_path / "in", ["submit", "finish", "fail", "poll", "poll"])
    table = str(tmp_path / "out")
    renamed = stream.withColumnRenamed("key", "run_id")
    live.run_status_stream(renamed, table, str(tmp_path / "offsets")).awaitTermination()
    found = spark.read.parquet(f"{table}/polls")
    expected = runs.run_status_asof(batch.withColumnRenamed("key", "run_id"))
    assert sorted(rows(found, "event_id", "status")) == sorted(rows(expected, "event_id", "status"))


def test_file_index(spark, tmp_path):
    stream, batch = events(spark, tmp_path / "in", ["create", "delete", "modify"])
    files = live.file_index_stream(stream.withColumnRenamed("key", "path"))
    table = str(tmp_path / "out")
    changelog.keep_changes(files, table, str(tmp_path / "offsets")).awaitTermination()
    found = dict(rows(changelog.newest(spark, table, ["path"]), "path", "op"))
    expected = {}
    for r in batch.orderBy("ts", "event_id").collect():
        if r.op != "modify":
            expected[r.key] = r.op
    assert found == expected


def test_recent(spark, tmp_path):
    stream, batch = events(spark, tmp_path / "in", ["open"])
    table = str(tmp_path / "out")
    changelog.keep_changes(live.recent_stream(stream, "key"), table, str(tmp_path / "offsets")).awaitTermination()
    found = changelog.newest(spark, table, ["item"])
    assert sorted(rows(found, "item", "hits")) == sorted(rows(registry.hits(batch, "key")))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """The folder of a batch is written over, so a replay gives the same table."""
    stream, batch = events(spark, tmp_path / "in", ["connect", "disconnect"], files=1)
    table = str(tmp_path / "out")
    for attempt in ("one", "two"):
        live.registry_stream(stream, table, str(tmp_path / attempt)).awaitTermination()
    assert spark.read.parquet(f"{table}/calls").count() == batch.count()


# ---- events out of order, and state by key ---------------------------------

HOUR = dt.timedelta(hours=1)


def batches(spark, folder, parts):
    """A stream of the given batches, one after the other."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/f{i:03d}")
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return read.option("latestFirst", False).parquet(str(folder)), spark.createDataFrame([r for p in parts for r in p], SCHEMA)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def shuffled(ops, n=400, files=6, seed=5, spread=50):
    """Events of which each comes up to ``spread`` minutes later than its time."""
    rng = random.Random(seed)
    data = [(at(i), i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(7)}", rng.choice(ops)) for i in range(n)]
    data.sort(key=lambda r: r[1] + rng.randrange(spread))
    return [data[i::1][: n // files] for i in range(0, n - n % files, n // files)]


def test_late_connect_counts_as_in_the_batch(spark, tmp_path):
    parts = [[(at(2), 2, "k", "disconnect")], [(at(3), 3, "k", "connect")], [(at(1), 1, "k", "connect")]]
    stream, batch = batches(spark, tmp_path / "in", parts)
    clients = live.Registry(str(tmp_path / "out"), HOUR)
    clients.start(stream, str(tmp_path / "offsets")).awaitTermination()
    clients.finish(spark)
    columns = ["event_id", "clients", "total_clients"]
    found = rows(spark.read.parquet(str(tmp_path / "out/calls")), *columns)
    assert sorted(found) == sorted(rows(registry.registry_refcount(batch), *columns)) == [(1, 1, 1), (2, 0, 0), (3, 1, 1)]
    assert clients.late_events(spark).count() == 0


def test_registry_out_of_order(spark, tmp_path):
    stream, batch = batches(spark, tmp_path / "in", shuffled(["connect", "disconnect"]))
    table = str(tmp_path / "out")
    clients = live.Registry(table, HOUR)
    clients.start(stream, str(tmp_path / "offsets")).awaitTermination()
    before = spark.read.parquet(f"{table}/calls").count()
    clients.finish(spark)
    assert 0 < before < batch.count()  # some were answered on the way, some were held back
    columns = ["event_id", "key", "clients", "total_clients"]
    assert sorted(rows(spark.read.parquet(f"{table}/calls"), *columns)) == sorted(rows(registry.registry_refcount(batch), *columns))
    ids = registry.registry_ids(registry.count_scan(batch))
    found = spark.read.parquet(f"{table}/projects")
    assert sorted(rows(found, "key", "project_id", "event_id")) == sorted(rows(ids, "key", "project_id", "event_id"))
    assert clients.late_events(spark).count() == 0


def test_run_status_out_of_order_and_forgotten_runs(spark, tmp_path):
    parts = shuffled(["submit", "finish", "fail", "poll", "poll"], seed=6)
    stream, batch = batches(spark, tmp_path / "in", parts)
    stream, batch = stream.withColumnRenamed("key", "run_id"), batch.withColumnRenamed("key", "run_id")
    for name, keep in (("all", None), ("short", dt.timedelta(minutes=9))):
        table = str(tmp_path / name)
        status = live.RunStatus(table, HOUR, keep)
        status.start(stream, f"{table}-offsets").awaitTermination()
        status.finish(spark)
        expected, last = {}, {}
        for r in batch.orderBy("ts", "event_id").collect():
            if r.op == "poll":
                said, when = last.get(r.run_id, ("unknown", r.ts))
                gone = keep is not None and said in ("finished", "failed") and r.ts - when >= keep
                expected[r.event_id] = "unknown" if gone else said
            else:
                last[r.run_id] = ({"submit": "running", "finish": "finished", "fail": "failed"}[r.op], r.ts)
        assert dict(rows(spark.read.parquet(f"{table}/polls"), "event_id", "status")) == expected
    assert "unknown" in expected.values()


def test_file_index_out_of_order(spark, tmp_path):
    stream, batch = batches(spark, tmp_path / "in", shuffled(["create", "delete", "modify"], seed=7))
    last = {}
    for r in batch.orderBy("ts", "event_id").collect():
        if r.op != "modify":
            last[r.key] = (r.op, r.ts)
    for name, delay in (("any", None), ("held", HOUR)):
        index = live.FileIndex(str(tmp_path / name), delay)
        index.start(stream.withColumnRenamed("key", "path"), str(tmp_path / f"{name}-offsets")).awaitTermination()
        index.finish(spark)
        assert dict(rows(index.files(spark))) == {k: ts for k, (op, ts) in last.items() if op == "create"}


def test_late_events_are_kept_apart_and_counted(spark, tmp_path):
    parts = [[(at(600), 1, "k", "connect")], [(at(700), 2, "k", "connect")], [(at(5), 3, "k", "connect"), (None, 4, "k", "connect")]]
    stream, _ = batches(spark, tmp_path / "in", parts)
    clients = live.Registry(str(tmp_path / "out"), HOUR)
    clients.start(stream, str(tmp_path / "offsets")).awaitTermination()
    clients.finish(spark)
    assert sorted(rows(clients.late_events(spark), "event_id")) == [(3,), (4,)]
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out/calls")), "event_id", "clients")) == [(1, 1), (2, 2)]


def test_a_held_batch_that_runs_again_changes_nothing(spark, tmp_path):
    stream, batch = batches(spark, tmp_path / "in", shuffled(["connect", "disconnect"], n=90, files=3))
    table = str(tmp_path / "out")
    clients = live.Registry(table, HOUR)
    apply, seen = clients.apply, []
    clients.apply = lambda *given: (apply(*given), apply(*given), seen.append(given[1]))
    clients.start(stream, str(tmp_path / "offsets")).awaitTermination()
    clients.finish(spark)
    columns = ["event_id", "clients", "total_clients"]
    assert sorted(rows(spark.read.parquet(f"{table}/calls"), *columns)) == sorted(rows(registry.registry_refcount(batch), *columns))
    assert seen == [0, 1, 2, 3]


def test_a_batch_costs_what_its_keys_cost(spark, tmp_path):
    """Of many live keys, each batch changes three: what 20 batches write stays far below 20 times the keys."""
    from loomlight.streaming.state import KeyedState

    state = KeyedState(spark, str(tmp_path / "state"), "key", "n bigint")
    value = lambda i, n, gone=False: (f"k{i}", n, None, gone)
    schema = "key string, n bigint, expires bigint, gone boolean"
    state.update(0, spark.createDataFrame([value(i, 0) for i in range(2000)], schema))
    want, written = {f"k{i}": 0 for i in range(2000)}, 0
    for batch in range(1, 21):
        changed = [value(batch, batch), value(7, batch), value(100 + batch, 0, gone=True)]
        keys = spark.createDataFrame([(r[0],) for r in changed], "key string")
        before = {r.key: r.n for r in state.look_up(batch, keys).collect()}
        assert before == {k: want[k] for k in (r[0] for r in changed) if k in want}
        state.update(batch, spark.createDataFrame(changed, schema))
        own = [name for name, _, _ in state.runs(batch) if name.startswith(f"{batch}-")]
        written += sum(state.read([name]).count() for name in own)
        for key, n, _, gone in changed:
            want[key] = n
            if gone:
                del want[key]
        assert len([r for r in state.runs(batch) if r[2]]) <= 3 * 4
    assert {r.key: r.n for r in state.all(20).collect()} == want
    assert written < 3 * 2000  # 42,000 if each batch wrote all of them


def test_expired_values_go_with_a_merge(spark, tmp_path):
    from loomlight.streaming.state import KeyedState

    state = KeyedState(spark, str(tmp_path / "state"), "key", "n bigint", fanout=2)
    schema = "key string, n bigint, expires bigint, gone boolean"
    state.update(0, spark.createDataFrame([("a", 1, 10, False), ("b", 2, None, False)], schema), 0)
    assert sorted(rows(state.all(0, 5), "key")) == [("a",), ("b",)] and rows(state.all(0, 10), "key") == [("b",)]
    state.update(1, spark.createDataFrame([("c", 3, None, False)], schema), 20)
    live_runs = [name for name, _, is_live in state.runs(1) if is_live]
    assert live_runs == ["1-1"] and sorted(rows(state.read(live_runs), "key")) == [("b",), ("c",)]

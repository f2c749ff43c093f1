"""Window results against a plain loop over the same calls, with one key that has most of them."""

import datetime as dt
import random

import pytest

from loomlight.operators import registry, runs, trees
from tests.conftest import rows

START = dt.datetime(2024, 1, 1)


def calls(seed, n, keys=6):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(keys)}"
        op = "connect" if rng.random() < 0.45 else "disconnect"
        out.append((START + dt.timedelta(seconds=rng.randrange(n // 2)), i, key, op))
    return out


def replay(data):
    live, ids, next_id, out, begun = {}, {}, 0, {}, []
    for ts, event_id, key, op in sorted(data):
        if op == "connect":
            if live.get(key, 0) == 0:
                ids[key], next_id = next_id, next_id + 1
                begun.append((key, ids[key], event_id))
            live[key] = live.get(key, 0) + 1
        elif live.get(key, 0) > 0:
            live[key] -= 1
        out[event_id] = (live.get(key, 0), sum(live.values()))
    return out, begun, live


def frame(spark, data):
    return spark.createDataFrame(data, "ts timestamp, event_id bigint, key string, op string")


@pytest.mark.parametrize("ranges", [1, 5])
def test_counts_and_ids_equal_a_loop(spark, ranges):
    data = calls(ranges, 700)
    expected, begun, live = replay(data)
    counted = registry.registry_refcount(frame(spark, data), ranges=ranges)
    found = {r.event_id: (r.clients, r.total_clients) for r in counted.collect()}
    assert found == expected
    ids = registry.registry_ids(registry.count_scan(frame(spark, data), ranges=ranges), ranges=ranges)
    assert sorted(rows(ids, "key", "project_id", "event_id")) == sorted(begun)
    finals = registry.final_counts(frame(spark, data), ranges=ranges)
    assert rows(registry.registry_counts(finals)) == [
        (sum(c > 0 for c in live.values()), sum(live.values()))
    ]


def test_six_connects_then_three_disconnects(spark):
    data = [(START + dt.timedelta(seconds=i), i, "p", "connect") for i in range(6)]
    data += [(START + dt.timedelta(seconds=i), i, "p", "disconnect") for i in range(6, 9)]
    counted = registry.count_scan(frame(spark, data)).orderBy("event_id")
    assert [r.clients for r in counted.collect()] == [1, 2, 3, 4, 5, 6, 5, 4, 3]
    assert rows(registry.registry_ids(counted), "key", "project_id") == [("p", 0)]


def test_no_calls(spark):
    finals = registry.final_counts(frame(spark, []))
    assert rows(registry.registry_counts(finals)) == [(0, 0)]


def test_status_at_polls_equals_a_loop(spark):
    rng = random.Random(7)
    ops = ["submit", "finish", "fail", "poll", "poll", "poll"]
    data = [
        (START + dt.timedelta(seconds=rng.randrange(300)), i, "hot" if rng.random() < 0.5 else f"r{rng.randrange(9)}",
         rng.choice(ops))
        for i in range(800)
    ]
    status, expected = {}, {}
    names = {"submit": "running", "finish": "finished", "fail": "failed"}
    for ts, event_id, run, op in sorted(data):
        if op == "poll":
            expected[event_id] = status.get(run, "unknown")
        else:
            status[run] = names[op]
    df = spark.createDataFrame(data, "ts timestamp, event_id bigint, run_id string, op string")
    found = runs.run_status_asof(df, ranges=7)
    assert dict(rows(found, "event_id", "status")) == expected


def test_recent(spark):
    events = spark.createDataFrame([(i,) for i in "aabcccd"], "file string")
    counts = registry.hits(events, "file")
    assert rows(registry.recent_topk(counts, 3)) == [("c", 3), ("a", 2), ("b", 1)]
    old = spark.createDataFrame([("b", 9), ("z", 1)], "item string, hits bigint")
    assert dict(rows(registry.merge_hits(old, counts))) == {"a": 2, "b": 10, "c": 3, "d": 1, "z": 1}


def test_project_rules(spark):
    inventory = trees.path_tree(
        spark.createDataFrame([("/p/build.mos",), ("/p/a.mo",), ("/q/b.mo",)], "path string")
    )
    data = [
        (1, "/p", None), (2, "/p", "build.mos"), (3, "/p", "a.mo"), (4, "/p", "none.mos"),
        (5, "/p/a.mo", None), (6, "unknown-path", None), (7, "unknown-path", "x.mos"), (8, "/q", "/p/build.mos"),
    ]
    projects = spark.createDataFrame(data, "id int, path string, build_script string")
    checked = registry.validate_projects(projects, inventory)
    assert dict(rows(checked, "id", "errors")) == {
        1: [],
        2: [],
        3: ["/p/a.mo isn't a regular *.mos file!"],
        4: ["/p/none.mos isn't a regular *.mos file!"],
        5: ["`/p/a.mo` isn't a directory"],
        6: ["`unknown-path` doesn't exist"],
        7: ["`unknown-path` doesn't exist", "unknown-path/x.mos isn't a regular *.mos file!"],
        8: [],
    }
    assert registry.accepted(checked).count() == 3 and registry.rejected(checked).count() == 5


def test_projects_with_a_final_separator_and_at_the_root(spark):
    inventory = spark.createDataFrame([("/a/b", False), ("/a/b/r.mos", True), ("/s.mos", True)], "path string, is_leaf boolean")
    projects = spark.createDataFrame(
        [(1, "/a/b/", None, "r.mos"), (2, "/", None, "s.mos"), (3, "\\a\\b", None, "/s.mos"), (4, "/a/c/", None, None)],
        "id int, path string, output_dir string, build_script string",
    )
    checked = registry.validate_projects(projects, inventory)
    assert {r.id: r.errors for r in checked.collect()} == {1: [], 2: [], 3: [], 4: ["`/a/c/` doesn't exist"]}

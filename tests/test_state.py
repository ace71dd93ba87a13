"""Keyed state of incremental jobs, cursors, ranks, links and the chunk store."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import cursor as cu
from gleanery.operators import links as ln
from gleanery.operators import ranks
from gleanery.sources import store
from gleanery.streaming import jobs


def test_state_is_a_snapshot_and_the_deltas_since():
    assert jobs.state_paths("f", 0, 3) == [] and jobs.state_paths("f", 2, 3) == ["f/delta/00000000", "f/delta/00000001"]
    assert jobs.state_paths("f", 3, 3) == ["f/snapshot/00000001"]
    assert jobs.state_paths("f", 8, 3) == ["f/snapshot/00000002", "f/delta/00000006", "f/delta/00000007"]
    assert all(len(jobs.state_paths("f", n, 8)) <= 8 for n in range(200))


def test_late_batches_read_the_snapshot_and_forget_the_rest(spark, tmp_path):
    docs, at = f"{tmp_path}/documents.parquet", f"{tmp_path}/job"
    rng, seen = random.Random(1), {}
    add = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(docs)
    run = lambda: {r.content_id: r.first_id for r in jobs.source_stream(spark, docs, at, compact=2, files_a_batch=1).collect()}
    for k in range(7):
        rows = [(10 * k + i, f"text {rng.randint(0, 12)}") for i in range(6)]
        for i, t in rows:
            seen.setdefault(t, i)
        add(rows)
        if k in (0, 3, 6):  # some runs have several batches
            assert sorted(run().values()) == sorted(seen.values())
    assert sorted(run().values()) == sorted(seen.values())
    left = lambda part: sorted(int(n) for n in os.listdir(f"{at}/{part}") if n.isdigit())
    assert left("snapshot") == [2, 3] and left("delta") == [2, 3, 4, 5, 6]
    # what the next batch reads is all that it needs
    assert jobs.state_paths(at, 7, 2) == [f"{at}/snapshot/00000003", f"{at}/delta/00000006"]
    for n in (2, 3, 4, 5):
        store.delete_path(spark, f"{at}/delta/{n:08d}")
    add([(99, "text 0"), (100, "new")])
    assert sorted(run().values()) == sorted(({"text 0": 99} | seen | {"new": 100}).values())


def test_decisions_over_many_batches(spark, tmp_path):
    events, at = f"{tmp_path}/events.parquet", f"{tmp_path}/job"
    rng = random.Random(3)
    rows = [(n, rng.randint(0, 5), datetime.datetime(2024, 1, rng.randint(1, 20)), rng.choice(["purchase", "click", "error", "view"])) for n in range(40)]
    for k in range(5):
        spark.createDataFrame(rows[8 * k : 8 * k + 8], "event_id long, user_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(events)
    got = {(r.source_id, r.decision, r.updated_at) for r in jobs.decision_stream(spark, events, at, compact=2, files_a_batch=1).collect()}
    name = {"purchase": "approved", "click": "held", "error": "discarded", "view": "pending"}
    last = {}
    for n, user, ts, kind in rows:
        last[user] = max(last.get(user, (ts, -1, "")), (ts, n, name[kind]))
    assert got == {(str(u), d, ts) for u, (ts, _, d) in last.items()}


def test_no_files_no_state(spark, tmp_path):
    docs = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(docs)
    assert jobs.source_stream(spark, docs, f"{tmp_path}/job").count() == 0


def test_cursor_goes_on_behind_the_good_prefix(spark):
    status = {("a", 3): "error", ("b", 7): "recovered"}
    rows = [(s, n, status.get((s, n), "ok")) for s, total in (("a", 9), ("b", 8), ("c", 2)) for n in range(total)]
    batches = spark.createDataFrame(rows, "source string, batch long, status string")
    cursor = spark.createDataFrame([("a", "other", 8), ("c", "one", 70), ("gone", "one", 1)], "source string, signature string, next_batch long")
    took = lambda c, sign: {s: sorted(r.batch for r in cu.take(batches, c, sign).collect() if r.source == s) for s in "abc"}
    assert took(cursor, "one") == {"a": [0, 1, 2, 3, 4], "b": [0, 1, 2, 3, 4], "c": []}
    after = cu.advance(batches, cursor, cu.take(batches, cursor, "one"), "one")
    assert {tuple(r) for r in after.collect()} == {("a", "other", 8), ("a", "one", 3), ("b", "one", 5), ("c", "one", 70), ("gone", "one", 1)}
    assert took(after, "one") == {"a": [3, 4, 5, 6, 7], "b": [5, 6, 7], "c": []}
    assert took(after, "other") == {"a": [8], "b": [0, 1, 2, 3, 4], "c": [0, 1]} and took(after, "third")["a"] == [0, 1, 2, 3, 4]
    again = cu.advance(batches, after, cu.take(batches, after, "one"), "one")
    assert {(r.source, r.next_batch) for r in again.where("signature = 'one'").collect()} == {("a", 3), ("b", 7), ("c", 70), ("gone", 1)}


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_of_a_hot_group(spark, parts):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i) for i in rng.sample(range(1000), 400)]
    got = {(r.g, r.i): r.place for r in ranks.ranked(spark.createDataFrame(rows, "g string, i int"), ["g"], ["i"], "place", parts).collect()}
    want = {(g, i): n for g in {g for g, _ in rows} for n, i in enumerate(sorted(i for h, i in rows if h == g))}
    assert got == want
    assert ranks.ranked(spark.createDataFrame([], "g string, i int"), ["g"], ["i"]).count() == 0


def test_links(spark):
    rows = [("a", ["b", " c ", "b", "", "x"], '{"relation":"broader"}'), ("b", ["a"], "{broken"), ("c", None, None), ("d", ["x", "a"], "[]"), ("e", ["a"], None)]
    entries = spark.createDataFrame(rows, "id string, related array<string>, payload string")
    edges = ln.edges(entries)
    got = {(r.src, r.dst): (r.place, r.relation, r.valid) for r in edges.collect()}
    assert got == {("a", "b"): (0, "broader", True), ("a", "c"): (1, "broader", True), ("a", "x"): (4, "broader", True), ("b", "a"): (0, "related", False), ("d", "x"): (0, "related", False), ("d", "a"): (1, "related", False), ("e", "a"): (0, "related", True)}
    log = spark.createDataFrame([("a", 1, 1, "held"), ("a", 3, 2, "approved"), ("a", 2, 3, "discarded")], "source_id string, updated_at int, event_id int, decision string")
    checked = ln.checked(edges, entries, log)
    assert {(r.src, r.dst): (r.known, r.mutual, r.decision) for r in checked.collect()} == {
        ("a", "b"): (True, True, "approved"), ("a", "c"): (True, False, "approved"), ("a", "x"): (False, False, "approved"), ("b", "a"): (True, True, "pending"),
        ("d", "x"): (False, False, "pending"), ("d", "a"): (True, False, "pending"), ("e", "a"): (True, False, "pending"),
    }
    assert [tuple(r) for r in ln.dangling(checked).collect()] == [("x", 2, "a")]


def test_a_source_is_read_from_its_folder_alone(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = [(f"s{i}", i, "x" * 50) for i in range(300)] + [("hot", i, "y") for i in range(500)]
    store.write_by_source(spark.createDataFrame(rows, "source_id string, n int, text string"), path, buckets=16)
    folders = [d for d in os.listdir(path) if d.startswith("bucket=")]
    assert len(folders) == 16  # not one for each source
    one = store.read_source(spark, path, "n int, text string", "s7", buckets=16)
    assert [r.n for r in one.collect()] == [7]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(source_id,s7)" in plan
    assert len({r.f.split("/bucket=")[1].split("/")[0] for r in one.select(F.input_file_name().alias("f")).collect()}) == 1
    before = {f: os.stat(f"{path}/{d}/{f}").st_mtime_ns for d in folders for f in os.listdir(f"{path}/{d}")}
    store.write_by_source(spark.createDataFrame([("s7", 70, "new"), ("s7", 71, "new")], "source_id string, n int, text string"), path, buckets=16)
    assert sorted(r.n for r in store.read_source(spark, path, "n int, text string", "s7", buckets=16).collect()) == [70, 71]
    assert store.read_store(spark, path, "n int, text string").count() == len(rows) + 1
    left = {f for d in folders for f in os.listdir(f"{path}/{d}")}
    assert len(left & set(before)) > len(before) * 0.8  # folders of other hashes stay as they were

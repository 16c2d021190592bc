"""Bucketed snapshots, and the streams that keep their state in them."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from proseaudit.operators import fleet
from proseaudit.sources import snapshots
from proseaudit.streaming import progress


def size_of(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def add(old, new):
    return old.unionByName(new).groupBy("id").agg(F.sum("n").alias("n"))


@pytest.fixture
def table(spark, tmp_path):
    found = snapshots.Snapshot(spark, str(tmp_path / "table"), ["id"], 16)
    found.apply(0, spark.range(500).select("id", F.lit(1).cast("bigint").alias("n")), add)
    return found


def rows(df):
    return {r.id: r.n for r in df.collect()}


def test_only_touched_buckets_are_rewritten(spark, table):
    before = dict(table._current()["folders"])
    change = spark.createDataFrame([(3, 10), (600, 5)], "id bigint, n bigint")
    touched = table.apply(1, change, add)
    after = table._current()["folders"]
    assert len(touched) <= 2 and {int(b) for b in after if after[b] != before.get(b)} == set(touched)
    assert rows(table.read()) == {i: 1 for i in range(500)} | {3: 11, 600: 5}
    assert set(rows(table.read(touched))) == {i for i, b in spark.range(700).select("id", table.bucket().alias("b")).collect() if b in touched and (i < 500 or i == 600)}


def test_a_change_set_counts_once(spark, table):
    change = spark.createDataFrame([(3, 10)], "id bigint, n bigint")
    assert len(table.apply(1, change, add)) == 1 and table.apply(1, change, add) == [] and table.apply(0, change, add) == []
    assert rows(table.read())[3] == 11
    again = snapshots.Snapshot(spark, table.path, ["id"], 16)  # another session of the job
    assert again.apply(1, change, add) == [] and rows(again.read())[3] == 11


def test_a_change_set_that_died_leaves_the_table_as_it_was(spark, table, monkeypatch):
    change = spark.createDataFrame([(3, 10)], "id bigint, n bigint")
    with monkeypatch.context() as m:
        m.setattr(table, "_swap", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.apply(1, change, add)
    assert rows(table.read())[3] == 1
    table.apply(1, change, add)
    assert rows(table.read())[3] == 11


def test_rows_can_go_and_readers_keep_their_version(spark, table):
    held = table.read()
    for i in (1, 2):
        assert len(table.apply(i, spark.createDataFrame([(7 + i, 0)], "id bigint, n bigint"), lambda old, new: old.join(new.select("id"), "id", "left_anti"))) == 1
        if i == 1:
            assert held.count() == 500
    assert 8 not in rows(table.read()) and 9 not in rows(table.read()) and len(table.versions()) == 2


def test_empty_change_sets_and_tables(spark, tmp_path):
    t = snapshots.Snapshot(spark, str(tmp_path / "t"), ["id"], 4)
    with pytest.raises(ValueError):
        t.read()
    nothing = spark.createDataFrame([], "id bigint, n bigint")
    assert t.apply(0, nothing, add) == [] and t.read().count() == 0
    t.apply(1, spark.createDataFrame([(None, 1), (None, 2)], "id bigint, n bigint"), add)
    t.apply(2, spark.createDataFrame([(None, 4)], "id bigint, n bigint"), add)
    assert [r.n for r in t.read().collect()] == [7]


def test_upsert_through_buckets_equals_the_plain_one(spark, tmp_path):
    users = spark.range(300).select(F.col("id").alias("oid"), *[F.lit("x").alias(c) for c in ("email", "display_name", "role")], F.lit(1).alias("created_at"), F.lit(None).cast("int").alias("last_login"), (F.col("id") % 2 == 0).alias("is_active"))
    logins = spark.range(290, 310).select(F.col("id").alias("oid"), F.lit("m").alias("email"), F.lit("n").alias("display_name"), F.lit("admin").alias("role"), F.col("id").cast("int").alias("ts"))
    t = snapshots.Snapshot(spark, str(tmp_path / "users"), ["oid"], 256)
    t.apply(0, users, fleet.upsert_users)
    assert len(t.apply(1, logins, fleet.upsert_users)) <= 20
    assert sorted(map(tuple, t.read().collect())) == sorted(map(tuple, fleet.upsert_users(users, logins).collect()))


EVENT = "file_id string, ts timestamp, progress long, stage string, message string"


def test_state_stays_flat_over_many_batches(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    t = snapshots.Snapshot(spark, str(tmp_path / "state"), ["file_id"], 8)
    fold, kept = progress.fold_state(t), []
    for i in range(20):
        batch = [(f"f{k}", day(i), i, "analyzing", "m") for k in range(40)] + ([("done", day(99), 100, "completed", "m")] if i == 3 else [("done", day(i), 5, "uploading", "late")])
        fold(spark.createDataFrame(batch, EVENT), i)
        kept.append(size_of(tmp_path / "state"))
    fold(spark.createDataFrame(batch, EVENT), 19)  # the last batch once more
    assert max(kept[2:]) <= 1.2 * min(kept[2:])
    got = {r.file_id: (r.stage, r.n_events) for r in progress.merged_state(t.read()).collect()}
    assert got.pop("done") == ("completed", 20) and set(got.values()) == {("analyzing", 20)} and len(got) == 40


@pytest.mark.parametrize("bits", [32_768, 8])
def test_once_per_file_looks_up_only_what_may_be_known(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(progress.OncePerFile, "BITS", bits)
    once = progress.OncePerFile(spark, str(tmp_path / "rows"), str(tmp_path / "filters"), 32)
    size = []
    for i in range(20):
        late = ["f0", "f7"] if i in (5, 19) else []
        batch = spark.createDataFrame([(f"f{k}", k) for k in range(10 * i, 10 * i + 10)] * 2 + [(f, -1) for f in late], "file_id string, event_id int")
        once(batch, i)
        if i == 12:
            once(batch, i)  # sent again after its rows and its filter were written
        size.append(size_of(tmp_path / "filters"))
    found = spark.read.parquet(str(tmp_path / "rows")).collect()
    assert sorted(r.file_id for r in found) == sorted(f"f{k}" for k in range(200)) and min(r.event_id for r in found) == 0
    if bits > 1000:
        assert max(size[2:]) <= 2.2 * size[2] and all(len(b) <= 2 for i, b in once.checked.items() if i != 12)


def test_a_subscription_ends_at_the_first_completion(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    events = [(1, "a", day(1), "uploading"), (2, "a", day(2), "completed"), (3, "a", day(2), "completed"), (4, "a", day(3), "late"), (5, "b", day(9), "x"), (6, None, day(1), "completed")]
    got = progress.until_completed(spark.createDataFrame(events, "event_id int, file_id string, ts timestamp, stage string"))
    assert sorted(r.event_id for r in got.where("file_id IS NOT NULL").collect()) == [1, 2, 5]


def test_late_events_bridge_sessions_of_a_stream(spark, tmp_path):
    from proseaudit.streaming import review as live

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[("a", at(0)), ("a", at(10)), ("b", at(1))], [("a", at(5)), (None, at(3))], [("a", at(100)), ("z", at(200))], [("z", at(201))], [("z", at(400))]]
    for rows in batches:
        spark.createDataFrame(rows, "u string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = live.parquet_stream(spark, str(tmp_path / "e"), files_per_batch=1).withWatermark("ts", "12 hours")
    live.drain(fleet.session_windows(stream, "u", "ts", "6 hours"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in fleet.session_windows(spark.read.parquet(str(tmp_path / "e")), "u", "ts", "6 hours").collect()}
    assert ("a", at(0), at(16), 3) in got and batch - got <= {("z", at(400), at(406), 1)} and got <= batch

"""Key stores, snapshots, streamed decisions and progress."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import events as E
from tallyloom.operators.snapshots import StateStore, micros, state_summary, whole_state
from tallyloom.sources.key_store import KeyStore, bloom, may_hold
from tallyloom.streaming.decisions import latest_status, settle_stream
from tallyloom.streaming.imports import keyed_sink, read_stream, run_available, table_stream
from tallyloom.streaming.progress import metric_totals, run_import


def keys(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "k string")


def test_filters_hold_what_was_added():
    r = np.random.default_rng(1)
    inside, outside = r.integers(-(2**63), 2**63, 5000), r.integers(-(2**63), 2**63, 200_000)
    made = bloom(inside)
    assert may_hold(made, inside).all() and may_hold(made, outside).mean() < 2e-4
    assert not may_hold(bloom(inside[:0]), inside).any()


def test_filters_take_memory_for_some_keys_at_a_time(spark, tmp_path):
    import tracemalloc

    hashes = np.random.default_rng(2).integers(-(2**63), 2**63, 1_000_000)
    tracemalloc.start()
    made = bloom(hashes)
    assert may_hold(made, hashes).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    # The keys of a bucket are dealt to many filters, whatever the number of buckets.
    KeyStore(str(tmp_path / "keys"), "k", buckets=1).add(keys(spark, [f"k{i}" for i in range(5000)]), 0)
    sizes = [r["keys"] for r in spark.read.parquet(str(tmp_path / "keys" / "filters")).select("keys").collect()]
    assert sum(sizes) == 5000 and max(sizes) < 200


@pytest.mark.parametrize("sent", [100, 1])
def test_a_frequent_merchant_does_not_meet_its_category_in_one_task(spark, monkeypatch, sent):
    from tallyloom.operators import classify

    monkeypatch.setattr(classify, "SENT", sent)
    table = spark.createDataFrame([("one", "c", "r", 0.9), ("two", "d", "s", None)], "merchant string, category string, rule_id string, confidence double")
    rows = spark.range(2000).select("id", F.when(F.col("id") < 1900, "one").when(F.col("id") < 1950, "two").when(F.col("id") < 1990, "none").alias("detected_merchant"))
    found = classify.category_of_merchant(rows, table)
    got = {(r.detected_merchant, r.detected_category, r.category_confidence): r.n for r in found.groupBy("detected_merchant", "detected_category", "category_confidence").agg(F.count("*").alias("n")).collect()}
    assert got == {("one", "c", 0.9): 1900, ("two", "d", 0.95): 50, ("none", "uncategorized", 0.3): 40, (None, "uncategorized", 0.3): 10}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) if sent == 100 else ("_piece" in plan)


def test_a_batch_opens_only_files_that_may_hold_its_keys(spark, tmp_path):
    store = KeyStore(str(tmp_path / "keys"), "k", buckets=8)
    for batch in range(5):
        new = keys(spark, [f"b{batch}-{i}" for i in range(300)] + [None])
        found = store.lookup(new, batch)
        assert found.opened == 0 and found.known.count() == 0
        store.add(new, batch)
        store.compact(spark, batch, "string")
    # Batches 0 to 3 are merged by the last compaction, which left the newest alone.
    assert store.segments(spark, 5) == [(0, 3), (4, 4)]
    old = store.lookup(keys(spark, ["b0-7", "b4-9", "new"]), 5)
    assert {r.k for r in old.known.collect()} >= {"b0-7", "b4-9"} and 2 <= old.opened <= 3 < old.files == 16
    # A replayed batch does not see its own segment.
    again = store.lookup(keys(spark, ["b4-9"]), 4)
    assert again.opened == 0
    # Segments out of sight are not looked at.
    near = KeyStore(store.root, "k", 8, look_back=1).lookup(keys(spark, ["b0-7", "b4-9"]), 5)
    assert near.files == 8 and "b0-7" not in {r.k for r in near.known.collect()}


def test_keyed_sink_stores_each_key_once_and_replays(spark, tmp_path):
    looked = {}
    path = str(tmp_path / "ledger")
    sink = keyed_sink(path, "k", buckets=4, looked=lambda b, f: looked.__setitem__(b, (f.files, f.opened)))
    r = random.Random(1)
    seen = set()
    for batch in range(4):
        ids = [f"k{r.randrange(60)}" for _ in range(40)] if batch % 2 else [f"n{batch}-{i}" for i in range(30)]
        frame = keys(spark, ids).withColumn("v", F.lit(batch))
        sink(frame, batch)
        seen |= set(ids)
        before = sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect()))
        sink(frame, batch)
        assert sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect())) == before
    rows = spark.read.parquet(path).collect()
    assert len(rows) == len(seen) and {r.k for r in rows} == seen
    assert looked[0] == (0, 0) and looked[2][1] == 0


def test_a_batch_before_which_nothing_is_known_is_not_held(spark, tmp_path, monkeypatch):
    from tallyloom.functions.skew import first_per_key

    def never(*_):
        raise AssertionError("there is nothing to look up")

    sink = keyed_sink(str(tmp_path / "ledger"), "k", buckets=2)
    monkeypatch.setattr(KeyStore, "lookup", never)
    frame = keys(spark, ["a", "b", "a", None, None]).withColumn("v", F.lit(1))
    sink(frame, 0)
    sink(frame, 0)
    stored = sorted(((r.k or "", r.v) for r in spark.read.parquet(str(tmp_path / "ledger" / "batch_id=0")).collect()))
    assert stored == [("", 1), ("a", 1), ("b", 1)]
    once = first_per_key(frame, ["k"], [F.xxhash64("k", "v")])
    # The key travels once.
    assert once.columns == ["k", "v"] and "struct(k" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert first_per_key(frame.select("k"), ["k"], [F.col("k")]).count() == 3


FIELDS = {"amount": "decimal(18,2)", "note": "string", "flag": "boolean"}


def log(spark, n=400):
    r = random.Random(4)
    rows = []
    for i in range(n):
        kind = r.choice([E.IMPORTED, *E.MERGING, E.DISCREPANCY])
        t = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(20 * 24 * 60))
        body = {E.IMPORTED: f'{{"amount": {i}.5, "note": "n{i}"}}', E.MERGING[0]: f'{{"note": "c{i}"}}', E.MERGING[1]: f'{{"amount": {i}.25}}', E.MERGING[2]: '{"flag": true}'}.get(kind, '{"issue": "x"}')
        rows.append((f"e{i}", i, kind, "transaction", f"t{r.randrange(25)}", t, "a", "s", body, "{}"))
    return spark.createDataFrame(rows, E.EVENT_SCHEMA)


def state(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_state_from_a_snapshot_equals_the_whole_fold(spark, tmp_path):
    events = log(spark)
    store = StateStore(str(tmp_path / "s"), FIELDS)
    assert store.state_at(spark, "2024-01-05 00:00:00").count() == 0
    store.append(events.where("seq < 350"))
    for t in ("2024-01-05 00:00:00", "2024-01-10 12:30:00", "2024-01-15 00:00:00"):
        store.snapshot(spark, t)
    assert store.snapshots(spark) == [micros(t) for t in ("2024-01-05 00:00:00", "2024-01-10 12:30:00", "2024-01-15 00:00:00")]
    early = events.where("seq < 350")
    for t in ("2024-01-03 07:00:00", "2024-01-05 00:00:00", "2024-01-12 01:00:00", "2024-01-10 12:29:59", "2024-02-01 00:00:00"):
        assert state(store.state_at(spark, t)) == state(E.project_state(early, FIELDS, t)), t
    # One snapshot and the days since are read.
    files = store.state_at(spark, "2024-01-12 01:00:00").inputFiles()
    days = {f.split("event_date=")[1].split("/")[0] for f in files if "event_date=" in f}
    assert days <= {"2024-01-10", "2024-01-11", "2024-01-12"} and len({f.split("at=")[1].split("/")[0] for f in files if "/snapshots/" in f}) == 1
    # Late events drop the snapshots that they would change.
    first = events.where("seq >= 350").agg(F.min(F.unix_micros("ts"))).first()[0]
    gone = store.append(events.where("seq >= 350"))
    assert gone == sum(s >= first for s in map(micros, ("2024-01-05 00:00:00", "2024-01-10 12:30:00", "2024-01-15 00:00:00")))
    assert state(store.state_at(spark, "2024-01-16 00:00:00")) == state(E.project_state(events, FIELDS, "2024-01-16 00:00:00"))


def test_whole_state_has_all_event_types(spark):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    tx = spark.createDataFrame([("a", 5.0), ("b", 6.0)], "tx_id string, amount double")
    pairs = spark.createDataFrame([("a", "b", 0.9, True)], "original_id string, duplicate_id string, similarity double, is_duplicate boolean")
    balance = spark.createDataFrame([("acc", 1.0, 2.0, -1.0, False)], "account_id string, calculated double, expected double, difference double, reconciled boolean")
    made = [E.imported(tx, at), E.verified(tx.limit(1), at), E.duplicate_detected(pairs, at), E.duplicate_resolved(pairs, at), E.reconciled(balance, at),
            E.discrepancy(tx.withColumn("issue", F.lit("odd")), at), E.system_event(tx, "import-started", "tx_id", at, ["amount"])]
    events = made[0]
    for more in made[1:]:
        events = events.unionByName(more)
    parts = whole_state(events)
    assert {k: v.count() for k, v in parts.items()} == {"transactions": 2, "duplicates": 1, "verdicts": 1, "reconciliations": 1, "discrepancies": 2}
    assert parts["verdicts"].first().is_duplicate and float(parts["reconciliations"].first().difference) == -1.0
    assert {r.part: r.entries for r in state_summary(events).collect()} == {k: v.count() for k, v in parts.items()}
    assert {r.entries for r in state_summary(events.limit(0)).collect()} == {0}


def stream_of(spark, folder, batches, schema):
    """Files that are read one a micro-batch, in order."""
    import os
    import time

    for i, rows in enumerate(batches):
        name = str(folder / f"f{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.json(name)
        part = next(f for f in os.listdir(name) if f.startswith("part-"))
        os.makedirs(folder / "in", exist_ok=True)
        os.replace(os.path.join(name, part), folder / "in" / f"{i}.json")
        os.utime(folder / "in" / f"{i}.json", (time.time() + i, time.time() + i))
    return read_stream(spark, str(folder / "in"), schema, files_per_trigger=1, fmt="json")


def test_decisions_meet_items_before_after_and_never(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    item_schema = "tx_id string, ts timestamp, detected_merchant string, detected_category string"
    kinds = "tx_id string, ts timestamp, seq long, kind string, decided_by string, merchant string, category string"
    items = [
        [("after", day(1), "M", "C"), ("never", day(1), "M", "C"), ("twice", day(1), "M", None)],
        [("before", day(1, 3), "M", "C"), ("after", day(1, 3), "X", "X")],
        [("clock", day(9), "M", "C")],
        [("late-item", day(1), "M", "C"), ("end", day(9, 2), "M", "C")],
    ]
    decisions = [
        [("before", day(1, 2), 1, "rejected", "ann", None, None), ("alone", day(1), 2, "approved", "ann", None, None)],
        [("after", day(1, 4), 3, "corrected", "bob", "N", None), ("twice", day(1, 5), 5, "approved", "bob", None, None), ("twice", day(1, 4), 4, "rejected", "ann", None, None), ("odd", day(1), 9, "shrug", "x", None, None), (None, day(1), 8, "approved", "x", None, None)],
        [("clock", day(9), 6, "approved", "ann", None, None)],
        [("late", day(1, 2), 7, "approved", "ann", None, None), ("end", day(9, 1), 8, "rejected", "ann", None, None)],
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    rows = settle_stream(stream_of(spark, tmp_path / "a", items, item_schema), stream_of(spark, tmp_path / "b", decisions, kinds), 24, "1 hour")
    out = str(tmp_path / "out")
    run_available(rows, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch_id={n}"), str(tmp_path / "mark"), "settle")
    got = {r.tx_id: (r.status, r.merchant, r.category, r.decided_by) for r in latest_status(spark.read.parquet(out)).collect()}
    assert got == {
        "before": ("rejected", "M", "C", "ann"), "after": ("corrected", "N", "C", "bob"), "never": ("overdue", "M", "C", None), "twice": ("approved", "M", None, "bob"),
        "alone": ("orphaned", None, None, "ann"), "clock": ("approved", "M", "C", "ann"), "end": ("rejected", "M", "C", "ann"),
    }
    changes = sorted((r.tx_id, r.seq, r.status) for r in spark.read.parquet(out).collect())
    assert [c for c in changes if c[0] in ("after", "never")] == [("after", 1, "pending-review"), ("after", 2, "corrected"), ("never", 1, "pending-review"), ("never", 2, "overdue")]


def test_transactions_of_one_bucket_are_settled_one_by_one(spark, tmp_path):
    """All lie in one bucket: what comes for some leaves the wait of the others as it was, and Python is called for buckets and not for transactions."""
    from tallyloom.streaming import decisions as made

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    items = [[("a", at(0), "M", "C"), ("b", at(20), "M", "C")], [("c", at(30), "M", "C")], [("d", at(40), "M", "C")], [("e", at(60), "M", "C")]]
    chosen = [[("x", at(0), 1, "approved", "ann", None, None)], [("b", at(21), 2, "rejected", "ann", None, None)], [("c", at(39), 3, "corrected", "bob", "N", None)], []]
    kinds = "tx_id string, ts timestamp, seq long, kind string, decided_by string, merchant string, category string"
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    rows = settle_stream(stream_of(spark, tmp_path / "a", items, "tx_id string, ts timestamp, detected_merchant string, detected_category string"), stream_of(spark, tmp_path / "b", chosen, kinds), 24, "1 hour", buckets=1)
    assert "bucket" in rows._jdf.queryExecution().analyzed().toString() and made.STATE.startswith("tx_id array")
    out = str(tmp_path / "out")
    run_available(rows, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch_id={n}"), str(tmp_path / "mark"), "buckets")
    got = sorted((r.tx_id, r.seq, r.status, r.merchant) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1, "pending-review", "M"), ("a", 2, "overdue", "M"), ("b", 1, "pending-review", "M"), ("b", 2, "rejected", "M"), ("c", 1, "pending-review", "M"), ("c", 2, "corrected", "N"),
                   ("d", 1, "pending-review", "M"), ("e", 1, "pending-review", "M"), ("x", 1, "orphaned", None)]


@pytest.mark.parametrize("rows", [5, 0])
def test_progress_of_an_import(spark, tmp_path, rows):
    batches = [[(f"t{i}", float(i)) for i in range(3)], [(f"t{i}", float(i)) for i in range(3, rows)]] if rows else [[]]
    (tmp_path / "in").mkdir()
    df = stream_of(spark, tmp_path, batches, "tx_id string, confidence double")
    path = lambda n: str(tmp_path / n)
    run_import(df, keyed_sink(path("ledger"), "tx_id", 2), path("mark"), "load", path("events"), path("metrics"), "feed.json", {"classified": F.count_if(F.col("confidence") > 1)})
    metrics = {r.metric: r.value for r in metric_totals(spark.read.parquet(path("metrics"))).collect()}
    assert metrics == ({"rows": 5, "classified": 3} if rows else {"rows": 0, "classified": 0})
    events = {r.event_type: r.data for r in spark.read.parquet(path("events")).collect()}
    assert set(events) == {"import-started", "import-completed"} and f'"rows":{rows}' in events["import-completed"]


def test_a_table_streams_as_one_file_or_as_a_folder(spark, tmp_path):
    from tallyloom.plans.catalog_events import Q

    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.repartition(3).write.parquet(str(tmp_path / "many" / "labels.parquet"))
    labels.toPandas().to_parquet(tmp_path / "labels.parquet")
    for folder in (tmp_path / "many", tmp_path):
        assert {(r.kind, r.rows) for r in Q["stream_decisions"][0](spark, str(folder)).collect()} == {("rejected", 8), ("approved", 32)}
        seen = []
        run_available(table_stream(spark, str(folder), "labels", labels.schema), lambda batch, n: seen.append(batch.count()), str(tmp_path / f"mark-{folder.name}"), "table")
        assert sum(seen) == 40


def test_a_micro_batch_has_as_many_files_as_keep_them_small(spark, tmp_path, monkeypatch):
    from tallyloom.plans import catalog_state

    rows = spark.range(1000)
    monkeypatch.setattr(catalog_state, "FILE_ROWS", 100)
    folder, lanes = catalog_state._files(rows, "dealt", "id")
    files = [p for p in spark.read.parquet(folder).inputFiles()]
    assert lanes == 3 and len(files) == 12
    assert max(spark.read.parquet(f).count() for f in files) < 200
    seen = []
    run_available(read_stream(spark, folder, rows.schema, files_per_trigger=lanes), lambda batch, n: seen.append(batch.count()), str(tmp_path / "mark"), "dealt")
    assert len(seen) == 4 and sum(seen) == 1000

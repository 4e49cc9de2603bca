"""Snapshots in transactions: replays, writers side by side, what breaks off, and what a batch costs."""

import random
import threading

import pytest
from planwatch.state import lock, snapshot
from planwatch.streaming import ingest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA = "k long, a string, b string, c int, d int, e string, f string, g string, seq long"
RULES = {"a": "overwrite", "b": "keep", "c": "sum", "d": "least", "e": "fill", "f": "with:e", "g": "rank"}
RANKS = {"x": 3, "y": 2, "z": 1}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def listed(df, *names):
    return sorted((tuple(r[n] for n in (names or df.columns)) for r in df.collect()), key=repr)


def batch(rng, n, keys=30):
    pick = lambda: rng.choice(["x", "y", "z", None, "w"])
    return [(rng.randrange(keys), pick(), pick(), rng.choice([None, 1, 2, 3]), rng.choice([None, 5, 7]), pick(), pick(), pick(), i) for i in range(n)]


def test_batches_as_one_merge_of_all(spark, tmp_path):
    """Whatever is folded on the way, the table is the fold of all batches, and older versions stay readable."""
    rng = random.Random(2)
    store, table, all_rows = snapshot.SnapshotStore(spark, str(tmp_path), buckets=3), None, []
    kept = {}
    for k in range(11):
        new = batch(rng, rng.choice([0, 1, 3, 40]), 30 + 5 * k)
        all_rows += [(*r[:-1], r[-1] + 1000 * k) for r in new]
        table = snapshot.merged(table, frame(spark, new), ["k"], RULES, ranks=RANKS)
        table = spark.createDataFrame(table.collect(), table.schema)
        got = store.merge(frame(spark, new), ["k"], RULES, ranks=RANKS)
        whole = snapshot.merged(None, frame(spark, all_rows), ["k"], RULES, ranks=RANKS).drop("is_new")
        assert listed(got.drop("is_new")) == listed(store.read()) == listed(whole)
        assert listed(got, "k", "is_new") == listed(table, "k", "is_new")
        kept[max(store.versions())] = listed(whole)
    assert any(len(store.manifest(v)["buckets"]) and all(len(p) == 1 for p in store.manifest(v)["buckets"].values()) for v in store.versions()[1:])
    for version, want in kept.items():
        assert listed(store.read(version)) == want
    last = listed(store.read())
    assert store.vacuum(older_than=0) and listed(store.read()) == last and len(store.versions()) == 1
    assert store.vacuum(older_than=0) == []


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, str(tmp_path / "s"))
    one = lambda v, n: store.merge(spark.createDataFrame([(1, v, 0)], "k long, v long, seq long"), ["k"], {"v": "sum"}, batch_id=n, writer="w")
    one(5, 0)
    one(2, 1)
    for n in (1, 0):
        assert listed(one(2, n), "v", "is_new") == [(7, False)]
    assert listed(store.read(), "v") == [(7,)]
    assert listed(store.merge(spark.createDataFrame([(1, 2, 0)], "k long, v long, seq long"), ["k"], {"v": "sum"}, batch_id=0, writer="other"), "v") == [(9,)]


def test_a_stream_whose_batch_is_replayed(spark, tmp_path, monkeypatch):
    """The stream breaks off after the store's commit and before its own: the batch comes again and counts once."""
    schema = StructType.fromDDL("k long, v long, at long")
    spark.createDataFrame([(1, 5, 0), (1, 2, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "one"))
    store = snapshot.SnapshotStore(spark, str(tmp_path / "s"))
    run = lambda: ingest.merge_stream(spark, str(tmp_path / "in" / "*"), schema, store, str(tmp_path / "cp"), ["k"], {"v": "sum"}, ["at"]).awaitTermination(120)
    plain = snapshot.SnapshotStore.merge

    def breaks(self, *a, **b):
        plain(self, *a, **b)
        raise RuntimeError("lost")

    monkeypatch.setattr(snapshot.SnapshotStore, "merge", breaks)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(snapshot.SnapshotStore, "merge", plain)
    run()
    assert listed(store.read(), "k", "v") == [(1, 7)]


def test_what_breaks_off_before_the_commit_is_no_part(spark, tmp_path, monkeypatch):
    store = snapshot.SnapshotStore(spark, str(tmp_path))
    one = lambda k: store.merge(spark.createDataFrame([(k, 1, 0)], "k long, v long, seq long"), ["k"], {"v": "sum"})
    one(1)
    with monkeypatch.context() as m:
        m.setattr(snapshot.SnapshotStore, "put", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            one(2)
    assert listed(store.read(), "k") == [(1,)]
    one(3)
    assert listed(store.read(), "k") == [(1,), (3,)] and len(store.vacuum(keep=9, older_than=0)) == 1
    assert listed(store.read(), "k") == [(1,), (3,)]


def test_two_writers_lose_nothing(spark, tmp_path):
    """Each finds its version taken now and then, and adds its piece to the other's version."""
    stores = [snapshot.SnapshotStore(spark, str(tmp_path), buckets=2) for _ in range(2)]
    errors = []

    def work(w):
        try:
            for n in range(5):
                stores[w].merge(spark.createDataFrame([(0, 1, 0), (10 * w + n, 1, 0)], "k long, v long, seq long"), ["k"], {"v": "sum"}, batch_id=n, writer=f"w{w}")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert not errors
    got = dict(listed(stores[0].read(), "k", "v"))
    assert got == {0: 11} | {n: 1 for n in range(1, 5)} | {10 + n: 1 for n in range(5)}


def test_a_taken_version_is_never_overwritten(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, str(tmp_path))
    assert store.files.put("x/y.json", "a") and not store.files.put("x/y.json", "b") and store.files.text("x/y.json") == "a"
    store.merge(spark.createDataFrame([(1, 1, 0)], "k long, v long, seq long"), ["k"], {"v": "sum"})
    with pytest.raises(ValueError):
        store.merge(spark.createDataFrame([(1, 1, 0)], "k long, v long, seq long"), ["k"], {"v": "least"})


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, str(tmp_path), buckets=4)
    rows = lambda start, n: spark.range(start, start + n).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).alias("seq"))
    store.merge(rows(0, 60_000), ["k"], {"v": "overwrite"})
    first = store.files.size("data")
    for n in range(5):
        store.merge(rows(1000 * n, 20), ["k"], {"v": "overwrite"})
    assert store.files.size("data") - first < first / 20 and store.read().count() == 60_000


def test_locks(spark, tmp_path):
    at = str(tmp_path)
    with lock.lock(spark, at):
        assert lock.active(spark, at)
        with pytest.raises(lock.AlreadyRunning), lock.lock(spark, at):
            pass
        assert lock.active(spark, at)
        with lock.lock(spark, at, stale=0):  # taken over from a run that counts as broken off
            assert lock.active(spark, at)
    assert not lock.active(spark, at)
    with pytest.raises(ValueError), lock.lock(spark, at):
        raise ValueError
    assert not lock.active(spark, at)

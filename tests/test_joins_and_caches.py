"""Distance joins, counters of a pass, and caches, against brute force and against what a second run does."""

import math
import random
import time

import pytest
from planwatch.defaults import EARTH_RADIUS_KM
from planwatch.operators import nearby
from planwatch.plans import caches, counters
from planwatch.state import snapshot
from pyspark.sql import functions as F


def km(a, b, x, y):
    a, b, x, y = map(math.radians, (a, b, x, y))
    h = math.sin((x - a) / 2) ** 2 + math.cos(a) * math.cos(x) * math.sin((y - b) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(min(h, 1)))


@pytest.mark.parametrize("most", [0.0, 0.5, 30, 900, 6000, 11_000, 20_100])
def test_pairs_as_by_brute_force(spark, most):
    """Points all over, at the poles, on both sides of the date line, and close together."""
    rng = random.Random(7)
    one = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    one += [(lat, lon) for lat in (-90.0, -89.9999, 0.0, 52.5, 89.9, 90.0) for lon in (-180.0, -179.9999, 0.0, 13.4, 179.9999, 180.0)]
    two = [(min(90.0, max(-90.0, a + rng.uniform(-0.3, 0.3))), b + rng.uniform(-0.3, 0.3)) for a, b in one] + one + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    gone = [(None, 1.0), (1.0, None), (math.nan, 0.0), (91.0, 0.0), (0.0, math.inf)]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(one + gone)], "i int, a double, b double")
    right = spark.createDataFrame([(j, *p) for j, p in enumerate(two + gone)], "j int, x double, y double")
    pairs = nearby.within_km(left, right, most, ("a", "b"), ("x", "y"))
    got = [(r["i"], r["j"]) for r in pairs.collect()]
    sure = {(i, j) for i, p in enumerate(one) for j, q in enumerate(two) if km(*p, *q) <= most - 1e-6}
    may = {(i, j) for i, p in enumerate(one) for j, q in enumerate(two) if km(*p, *q) <= most + 1e-6}
    assert len(got) == len(set(got)) and sure <= set(got) <= may
    plan = pairs._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert nearby.within_km(left.where("false"), right, most, ("a", "b"), ("x", "y")).count() == 0
    with pytest.raises(ValueError):
        nearby.within_km(left, left, most, ("a", "b"), ("a", "b"))


def test_looking_into_few_cells(spark):
    left = spark.range(1000).select("id", (F.rand(1) * 160 - 80).alias("a"), (F.rand(2) * 360 - 180).alias("b"))
    height, bands = nearby.grid(50)
    assert bands * height == pytest.approx(180) and height >= math.degrees(50 / EARTH_RADIUS_KM)
    right = spark.range(100_000).select(F.col("id").alias("j"), (F.rand(3) * 160 - 80).alias("x"), (F.rand(4) * 360 - 180).alias("y"))
    met = nearby.within_km(left, right, 50, ("a", "b"), ("x", "y"))
    assert met.count() == left.crossJoin(right).where(nearby.haversine_km(F.col("a"), F.col("b"), F.col("x"), F.col("y")) <= 50).count()


def test_pairs_of_one_place_are_dealt_over_tasks(spark):
    """Rows of one file that all lie in one cell: no task gets most of the pairs, and none is lost."""
    left = spark.range(40).select("id", (F.rand(1) / 10 + 50).alias("a"), (F.rand(2) / 10 + 10).alias("b"))
    right = spark.range(60_000).coalesce(1).select(F.col("id").alias("j"), (F.rand(3) / 10 + 50).alias("x"), (F.rand(4) / 10 + 10).alias("y"))
    met = nearby.within_km(left, right, 50, ("a", "b"), ("x", "y"))
    tasks = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 40 * 60_000 and max(tasks) < sum(tasks) / 2


@pytest.mark.parametrize("most", [0.002, 20, 750, 4000, 9500, 10_100])
def test_pairs_in_narrow_cells_and_cut_ones(spark, most, monkeypatch):
    """Points gathered at the poles, at the date line and on the edges of bands, with cells cut into parts."""
    monkeypatch.setattr(nearby, "PART", 50)
    rng = random.Random(3)
    height, bands = nearby.grid(most / nearby.BANDS)
    near = math.degrees(most / EARTH_RADIUS_KM)
    lats = lambda: rng.choice([90 - near * rng.random() * 3, near * rng.random() * 3 - 90, -90 + height * rng.randrange(bands + 1), 90 - near, near - 90, rng.choice([-90.0, 90.0])])
    lons = lambda: rng.choice([rng.uniform(-180, 180), 180 - near * rng.random(), near * rng.random() - 180, 180.0, -180.0])
    points = lambda n: [(i, min(90.0, max(-90.0, lats())), lons()) for i in range(n)]
    left, right = spark.createDataFrame(points(150), "i int, a double, b double"), spark.createDataFrame(points(600), "j int, x double, y double")
    want = left.crossJoin(right).withColumn("distance_km", nearby.haversine_km(F.col("a"), F.col("b"), F.col("x"), F.col("y"))).where(F.col("distance_km") <= most)
    got = nearby.within_km(left, right, most, ("a", "b"), ("x", "y"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_counters_of_a_pass(spark, tmp_path):
    spark.range(100).withColumn("x", F.when(F.col("id") % 10 > 0, F.col("id"))).write.parquet(str(tmp_path / "in"))
    c = counters.Counters()
    first = c.on(spark.read.parquet(str(tmp_path / "in")), "read", no_value=F.count_if(F.col("x").isNull()), most=F.max("x"))
    last = c.on(first.where("x > 50"), "kept")
    plan = last._jdf.queryExecution().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan
    last.write.parquet(str(tmp_path / "out"))
    assert c.all() == {"read": {"rows": 100, "no_value": 10, "most": 99}, "kept": {"rows": 45}}
    assert c.gate("kept", rows=45) == {"rows": 45}
    for stage, least in (("kept", {"rows": 46}), ("read", {})):
        with pytest.raises(counters.GateClosed):
            c.gate(stage, **least)
    with pytest.raises(ValueError):
        c.on(first, "read")


def test_counters_of_a_stream(spark, tmp_path):
    spark.range(30).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in" / "*"))
    query = counters.observed(rows, "read", odd=F.count_if(F.col("id") % 2 == 1)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {"rows": 30, "odd": 15} in counters.progress(query, "read")


def listed(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_texts_are_read_once(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(5):
        (folder / f"{i}.txt").write_text(f"page {i}\fpage two")
    (folder / "bad.txt").write_bytes(b"\xff")
    store = snapshot.SnapshotStore(spark, str(tmp_path / "cache"))
    log = tmp_path / "reads"
    log.mkdir()

    def run():
        at = str(log)

        def read(raw):
            import pathlib
            import uuid

            (pathlib.Path(at) / uuid.uuid4().hex).write_bytes(raw)
            return raw.decode().split("\f")

        return listed(caches.texts_of(spark, caches.file_list(spark, str(folder), "*.txt"), store, read), "path", "pages", "error")

    def read_now():
        found = sorted(x.read_bytes() for x in log.iterdir())
        for x in log.iterdir():
            x.unlink()
        return found

    first = run()
    assert [r[1] for r in first if not r[2]] == [[f"page {i}", "page two"] for i in range(5)] and [r[2][:12] for r in first if r[2]] == ["UnicodeDecod"]
    assert len(read_now()) == 6
    assert run() == first and read_now() == [b"\xff"]  # only what couldn't be read
    time.sleep(1.1)
    (folder / "3.txt").write_text("page 3\fpage new")
    (folder / "bad.txt").write_text("mended")
    (folder / "0.txt").unlink()
    got = run()
    assert read_now() == [b"mended", b"page 3\fpage new"]
    assert [r[1] for r in got] == [["page 1", "page two"], ["page 2", "page two"], ["page 3", "page new"], ["page 4", "page two"], ["mended"]]


def test_results_are_worked_out_once(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, str(tmp_path))
    done = spark.sparkContext.accumulator(0)

    def work(rows):
        found = rows.collect()
        done.add(len(found))
        return spark.createDataFrame([(*r, None if r["v"] < 0 else r["v"] * 10) for r in found], rows.schema.add("result", "long"))

    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", -1), (None, 5), (None, 6)], "h string, v long")
    run = lambda valid=None: listed(caches.results_of(rows, store, "h", "result", work, valid), "h", "v", "result")
    want = sorted([("a", 1, 10), ("a", 1, 10), ("b", 2, 20), ("c", -1, None), (None, 5, 50), (None, 6, 60)], key=repr)
    assert run() == want and done.value == 3 + 2
    assert run() == want and done.value == 5 + 1 + 2  # the one without a result, and those without a key
    assert run(F.col("result") < 15) == [(*x[:2], None) if x[0] == "b" else x for x in want] and done.value == 8 + 2 + 2

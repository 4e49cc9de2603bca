"""Stored payloads as a data source, and pages that point at each other."""

import datetime as dt
import random

import pytest
from planwatch.sources import datasource, paging
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    """Three months of two sources and a system; all pages of March, and of source b, break a strict reader."""
    root = tmp_path_factory.mktemp("payloads")
    for system in ("oparl", "rss"):
        for source in ("a", "b"):
            for month in ("2026-01", "2026-02", "2026-03"):
                folder = root / system / source / month
                folder.mkdir(parents=True)
                for i in range(5):
                    (folder / f"{i}.json").write_bytes(b"\xff\xfe" if month == "2026-03" or source == "b" else f'{{"id": "{month}-{i}", "n": {i}}}'.encode())
                (folder / "_SUCCESS").write_bytes(b"")
    return str(root)


def test_range_and_source_are_pushed_down(spark, store, capsys):
    df = datasource.payloads(spark, store, "oparl", "a", dt.date(2026, 1, 20), dt.date(2026, 2, 28), strict="true", pages_per_task="2")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(month,2026-01-01), LessThanOrEqual(month,2026-02-28)" in plan and "EqualTo(source_id,a)" in plan and "Filter (" not in plan
    assert df.rdd.getNumPartitions() == 6  # five pages a month, two to a task
    got = {(r["month"].month, r["page"]) for r in df.collect()}  # others would stop a strict reader
    assert got == {(m, f"{i}.json") for m in (1, 2) for i in range(5)}
    with pytest.raises(PySparkException):
        datasource.payloads(spark, store, "oparl", "a", strict="true").collect()


@pytest.mark.parametrize(
    ("condition", "months"),
    [("month > '2026-01-01'", {2, 3}), ("month < '2026-02-01'", {1}), ("month in ('2026-01-01', '2026-03-01')", {1, 3}), ("month = '2026-02-01'", {2}), ("month > '2027-01-01'", set()), ("month = '2026-02-01' or page = '0.json'", {1, 2, 3}), ("month is null", set()), ("month = null", set())],
)
def test_filters_as_without_pushdown(spark, store, condition, months):
    datasource.register(spark)
    rows = spark.read.format("stored_payloads").load(store)
    assert {r["month"].month for r in rows.where(condition).collect()} == months
    assert rows.where(condition).count() == rows.filter(F.expr(f"rand() >= 0 and ({condition})")).count()


def test_a_broken_page_costs_one_row(spark, tmp_path):
    folder = tmp_path / "oparl" / "a" / "2026-05"
    folder.mkdir(parents=True)
    for i in range(1000):
        (folder / f"{i:04}.json").write_bytes({7: b"\xff", 8: b'{"id": '}.get(i, f'{{"id": "{i}"}}'.encode()))
    sound, failed = datasource.split_errors(datasource.body_as(datasource.payloads(spark, str(tmp_path), "oparl", "a"), "id string"))
    assert sound.count() == 998 and {r["page"] for r in failed.collect()} == {"0007.json", "0008.json"}


def test_wrong_folders_and_options_are_loud(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "x" / "s" / "May").mkdir(parents=True)
    with pytest.raises(PySparkException):
        spark.read.format("stored_payloads").load(str(tmp_path)).collect()
    with pytest.raises(PySparkException):
        spark.read.format("stored_payloads").load().collect()
    assert spark.read.format("stored_payloads").load(str(tmp_path / "none")).count() == 0


def brute(pages, most):
    """What page_order gives, by walking from every page."""
    nxt, split = {}, set()
    for u, v in pages:
        if u is not None:
            if u in nxt and (nxt[u] or "") != (v or ""):
                split.add(u)
            nxt[u] = max(nxt.get(u) or "", v or "") or None
    ends = {}
    for u in nxt:
        way, seen = u, {u}
        while nxt[way] in nxt and nxt[way] not in seen:
            way = nxt[way]
            seen.add(way)
        ends[u] = None if nxt[way] in nxt else (way, len(seen) - 1)
    chains = {}
    for u, end in ends.items():
        if end:
            chains.setdefault(end[0], []).append(u)
    pointers = {u: sum(v == u for v in nxt.values()) for u in nxt}
    out = set()
    for u, end in ends.items():
        if not end:
            out.add((u, None, None, None, "loop"))
            continue
        own = chains[end[0]]
        length = max(ends[x][1] for x in own)
        fork = sum(pointers[x] == 0 for x in own) != 1 or max(pointers[x] for x in own) > 1 or split & set(own)
        missing = nxt[end[0]]
        problem = "missing" if missing else "fork" if fork else "long" if length >= most else None
        out.add((u, end[0], length - end[1], missing, problem))
    return out


def test_page_order_as_by_walking(spark):
    rng = random.Random(3)
    for case in range(6):
        names = [f"p{k}" for k in range(40)]
        pages = [(u, rng.choice([*names, None, "gone", ""]) if rng.random() < 0.3 else (names[k + 1] if k + 1 < len(names) else None)) for k, u in enumerate(names)]
        pages += [pages[3], pages[3], (None, "p1"), ("p5", "p9")][: case + 1]
        df = spark.createDataFrame(pages, "url string, next string").repartition(3)
        assert set(map(tuple, paging.page_order(df, most_pages=12).collect())) == brute(pages, 12)


def test_ten_thousand_pages_and_loud_loops(spark):
    n = 10_000
    df = spark.range(n).select(F.concat(F.lit("p"), "id").alias("url"), F.when(F.col("id") < n - 1, F.concat(F.lit("p"), F.col("id") + 1)).alias("next")).repartition(8)
    got = paging.in_order(df, most_pages=None)
    assert got.where(F.concat(F.lit("p"), F.col("position")) == F.col("url")).count() == n
    for wrong in (df.withColumn("next", F.coalesce("next", F.lit("p0"))), df.where("url <> 'p77'"), df.union(spark.createDataFrame([("x", "p5")], "url string, next string")), df):
        with pytest.raises(PySparkException):
            paging.in_order(wrong, most_pages=500).collect()
    assert paging.in_order(df.where("false")).count() == 0


def test_offsets(spark):
    pages = [("a", 0, 250), ("a", 200, 250), ("b", 0, 100), ("c", 0, 0), ("d", 0, 9000), ("e", 0, 150), ("e", 100, 151)]
    df = spark.createDataFrame(pages, "s string, o long, n long")
    got = sorted(map(tuple, paging.offset_gaps(df, "s", "o", "n").collect()), key=repr)
    assert [x for x in got if x[0] != "d"] == [("a", 100, "missing"), ("e", None, "changed")]
    assert [x for x in got if x[0] == "d"] == sorted([("d", None, "long")] + [("d", k, "missing") for k in range(100, 9000, 100)], key=repr)


def test_lists_newest_first(spark):
    rows = [("x", k, d) for k, d in enumerate([dt.date(2026, 5, 9), dt.date(2026, 5, 7), dt.date(2026, 4, 1), dt.date(2026, 5, 8)])]
    df = spark.createDataFrame(rows, "s string, position long, date date")
    assert sorted(r["position"] for r in paging.newest_until(df, F.col("s"), F.lit(dt.date(2026, 5, 1))).collect()) == [0, 1]

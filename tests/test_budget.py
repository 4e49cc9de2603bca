"""Budgets, brakes and locks against plain loops, with keys that fill many pieces."""

import random
from collections import deque

import pytest
from planwatch.plans import runs
from planwatch.state import budget
from pyspark.sql import functions as F


def listed(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def stops(rows, most):
    out, row = {}, {}
    for key, n, failed in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        row[key] = row.get(key, 0) + 1 if failed else 0
        if row[key] == most:
            out.setdefault(key, n)
    return sorted(out.items(), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_brakes_as_by_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), n, rng.random() < rng.choice([0.5, 0.9])) for n in range(1500)]
    rows += [("never", n, n % 4 > 0) for n in range(90)] + [("all", n, True) for n in range(200)] + [("late", n, n > 180) for n in range(200)]
    df = spark.createDataFrame([(k, n, f if f or n % 7 else None) for k, n, f in rows], "key string, n long, failed boolean").repartition(7)
    for most in (1, 4, 12):
        got = budget.braked_after(df, "key", ["n"], "failed", most)
        assert listed(got.select("key", F.col("stopped_at.n").alias("n")), "key", "n") == stops(rows, most)
    assert budget.braked_after(df.where("false"), "key", ["n"], "failed", 3).count() == 0


def test_one_key_is_spread(spark):
    """A table of one key: no task gets more than a few times its share."""
    df = spark.range(20_000).select(F.lit("x").alias("key"), "id", (F.col("id") % 6 > 0).alias("failed"))
    sizes = [r["count"] for r in budget.in_pieces(df, "key", "id").groupBy("__piece").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 20_000 / 8
    assert budget.braked_after(df, "key", ["id"], "failed", 6).count() == 0 and budget.braked_after(df, "key", ["id"], "failed", 5).first()["stopped_at"]["id"] == 5


def locks(rows, most, seconds, lock_seconds):
    out, held, until = [], {}, {}
    for key, s, n in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1], r[2])):
        q = held.setdefault(key, deque())
        q.append(s)
        while s - q[0] > seconds:
            q.popleft()
        count = len(q)
        if count >= most:
            until[key] = s + lock_seconds
            q.clear()
        end = until.get(key)
        out.append((key, n, count, count >= most, end if end is not None and end >= s else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "most"), [(0, 10), (1, 3), (2, 2), (3, 1), (4, 10)])
def test_locks_as_by_a_loop(spark, seed, most):
    """Among them a key whose attempts fill several pieces without a pause."""
    rng = random.Random(seed)
    rows, s = [], 0
    for n in range(2500):
        s += rng.choice([0, 1, 60, 100, 150, 2000 if n % 100 < 5 else 1])
        rows.append((rng.choice(["hot"] * 9 + ["a", None]) if n < 2000 else f"k{n % 300}", s, n))
    df = spark.createDataFrame(rows, "key string, s long, n long").withColumn("t", F.timestamp_seconds("s")).repartition(5)
    got = budget.locked_out(df, "key", "t", ["n"], most, 900, 700)
    assert listed(got, "key", "n", "failures", "locked", "locked_until") == locks(rows, most, 900, 700)
    assert budget.locked_out(df.where("false"), "key", "t", ["n"], most).count() == 0


def plain_run(rows, per_run, day_rest, per_source, most_errors, run_first=False):
    """Reasons by asking one call after the other."""
    total, by_source, errors, stopped, out = 0, {}, 0, False, {}
    for n, source, failed, fatal in sorted(rows):
        tests = [("day", day_rest is not None and total >= day_rest), ("run", total >= per_run)]
        reasons = [("brake", stopped), *(reversed(tests) if run_first else tests), ("source", per_source is not None and by_source.get(source, 0) >= per_source)]
        out[n] = next((r for r, holds in reasons if holds), None)
        if out[n] is None:
            total += 1
            by_source[source] = by_source.get(source, 0) + 1
            errors = errors + 1 if failed else 0
            stopped = errors >= most_errors or fatal
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_over_days_as_by_a_loop(spark, seed):
    rng = random.Random(seed)
    used = spark.createDataFrame([], "day string, calls long")
    plain = {}
    for run in range(5):
        day = f"2026-05-0{1 + run // 3}"
        fatal = 60 + run if (seed + run) % 4 == 0 else -1
        rows = [(n, rng.choice(["a"] * 6 + ["b", "c", None]), rng.random() < (0.75 if run % 2 else 0.2), n == fatal) for n in range(120)]
        df = spark.createDataFrame([(*r, day) for r in rows], "n long, source string, failed boolean, fatal boolean, day string").repartition(3)
        rest = budget.rest_of(used, day, 90)
        assert rest == max(90 - plain.get(day, 0), 0)
        got = budget.decided(df, ["n"], "failed", 60, rest, "source", 25, 5, "fatal")
        want = plain_run(rows, 60, rest, 25, 5)
        assert dict(listed(got, "n", "reason")) == want
        used = spark.createDataFrame(budget.counted(used, got, "day").collect(), "day string, calls long")
        plain[day] = plain.get(day, 0) + sum(r is None for r in want.values())


@pytest.mark.parametrize(("per_run", "rest"), [(20, 20), (20, 7), (0, 5), (500, None), (30, 0)])
def test_searches_have_no_sources(spark, per_run, rest):
    rng = random.Random(9)
    rows = [(n, None, rng.random() < 0.3, False) for n in range(80)]
    df = spark.createDataFrame([r[:3] for r in rows], "n long, source string, failed boolean")
    for run_first in (True, False):
        got = budget.decided(df, ["n"], "failed", per_run, rest, most_errors=4, run_first=run_first)
        assert dict(listed(got, "n", "reason")) == plain_run(rows, per_run, rest, None, 4, run_first)


def test_jobs_are_sent_until_the_brake(spark):
    jobs = spark.createDataFrame([(f"q{n:02}", n) for n in range(20)], "query string, n long")
    outcomes = spark.createDataFrame([(f"q{n:02}", True, False) for n in (2, 5, 6, 7)] + [("q09", False, True)], "query string, failed boolean, fatal boolean")
    reasons = lambda *a, **b: dict(listed(runs.sent_jobs(jobs, ["n"], outcomes, *a, **b), "n", "reason"))
    assert reasons(50, most_errors=3) == {n: None if n <= 7 else "brake" for n in range(20)}
    assert reasons(50) == {n: None if n <= 9 else "brake" for n in range(20)}
    assert reasons(4, 4) == {n: None if n < 4 else "run" for n in range(20)} and reasons(9, 4)[5] == "day"

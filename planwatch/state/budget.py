"""Admission of calls under budgets, and the brake on errors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed


def admitted(calls: DataFrame, source: str, order: list[str], per_source: int, per_run: int, day_rest: int | None = None) -> DataFrame:
    """calls with admitted boolean: in order (which must be total), at most per_source of a source and per_run (or what the day has left) in all.

    A call that its source's budget refuses doesn't use the common one. Only the first per_source calls of each source are ranked, which
    Spark limits before it shuffles; of them the first of the common budget are found by a top-k. All calls are then held against
    their source's last one and the last of all.
    """
    most = max(per_run if day_rest is None else min(per_run, day_rest), 0)
    at, rank = F.struct(*order), F.row_number().over(Window.partitionBy(source).orderBy(*order))
    through = calls.select(source, *order).withColumn("__n", rank).where(F.col("__n") <= per_source)
    own = through.groupBy(F.col(source).alias("__source")).agg(F.max(at).alias("__own"))
    last = through.orderBy(*order).limit(most).agg(F.max(at).alias("__all"))  # one row
    rows = calls.join(own, F.col(source).eqNullSafe(F.col("__source")), "left").crossJoin(F.broadcast(last))
    return rows.withColumn("admitted", F.coalesce((at <= F.col("__own")) & (at <= F.col("__all")), F.lit(False))).drop("__source", "__own", "__all")


def in_pieces(rows: DataFrame, *order: str) -> DataFrame:
    """rows sorted and cut into ranges of order, with __piece: the number of the range. A key whose rows are many stands in several pieces.

    Checkpointed, as other evaluations could cut elsewhere.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__piece", F.spark_partition_id()))


def braked_after(calls: DataFrame, key: str, order: list[str], failed: str, most: int) -> DataFrame:
    """key, stopped_at: for each key the first call that is the most-th failure in a row; a success starts the count anew.

    stopped_at is a struct of order, which must be total; keys that never stop are absent. A key's calls are cut into pieces, and of each piece a
    summary is made: its leading failures, its trailing ones, and the first stop inside. What summaries carry from piece to piece
    then tells where leading failures reach the limit, so a key with most of the calls is spread over as many tasks as it has pieces.
    """
    rows = in_pieces(calls.select(key, *order, F.coalesce(failed, F.lit(False)).alias("__f")), key, *order)
    at, w = F.struct(*order), Window.partitionBy(key, "__piece").orderBy(*order)
    rows = rows.withColumn("__n", F.sum(F.col("__f").cast("long")).over(w)).withColumn("__reset", F.max(F.when(~F.col("__f"), F.col("__n"))).over(w))
    rows = rows.withColumn("__run", F.col("__n") - F.coalesce("__reset", F.lit(0)))
    leads = F.col("__f") & F.col("__reset").isNull()
    pieces = rows.groupBy(key, "__piece").agg(
        F.count_if(leads).alias("lead"),
        F.sort_array(F.collect_list(F.when(leads & (F.col("__run") <= most), at))).alias("firsts"),
        F.max_by(F.when(F.col("__f"), F.col("__run")).otherwise(0), at).alias("tail"),
        F.count_if(~F.col("__f")).alias("good"),
        F.min(F.when(F.col("__f") & F.col("__reset").isNotNull() & (F.col("__run") == most), at)).alias("inside"),
    )
    # What a piece hands on: its tail, after what it was handed if it has no success.
    v = Window.partitionBy(key).orderBy("__piece")
    pieces = pieces.withColumn("since", F.sum((F.col("good") > 0).cast("int")).over(v))
    pieces = pieces.withColumn("handed", F.sum("tail").over(Window.partitionBy(key, "since").orderBy("__piece")))
    pieces = pieces.withColumn("carry", F.coalesce(F.lag("handed").over(v), F.lit(0)))
    reached = (F.col("carry") < most) & (F.col("carry") + F.col("lead") >= most)
    stop = F.coalesce(F.when(reached, F.get("firsts", (F.lit(most) - 1 - F.col("carry")).cast("int"))), F.col("inside"))
    return pieces.groupBy(key).agg(F.min(stop).alias("stopped_at")).where("stopped_at is not null")


#: Reasons of refusal, in the order in which they are looked for.
BRAKE, DAY, RUN, SOURCE = "brake", "day", "run", "source"


def decided(
    calls: DataFrame, order: list[str], failed: str, per_run: int, day_rest: int | None = None, source: str | None = None, per_source: int | None = None, most_errors: int = 5, fatal: str | None = None, run_first: bool = False
) -> DataFrame:
    """calls of one run with reason: the first of BRAKE, DAY, RUN and SOURCE that refuses the call, null if it is sent.

    failed and fatal say what a call comes to if it is sent: most_errors failures in a row of calls that were sent, or one fatal one, stop all that come later. As
    the brake only takes calls after it, those before it are admitted as without it, and the failures to count are those of calls so admitted. With
    run_first the run's limit is named where the day's is reached with it.
    """
    limit = per_run if day_rest is None else min(per_run, max(day_rest, 0))
    one = calls.withColumn("__one", F.lit(0))
    rows = admitted(one, source or "__one", order, limit if per_source is None else per_source, limit)
    at = F.struct(*order)
    sent = rows.where("admitted")
    last = sent.agg(F.max(at).alias("__last"), F.count("*").alias("__sent"))
    stop = braked_after(sent, "__one", order, failed, most_errors).select(F.col("stopped_at").alias("__stop"))
    if fatal:
        stop = stop.unionByName(sent.where(fatal).agg(F.min(at).alias("__stop")))
    stop = stop.agg(F.min("__stop").alias("__stop"))
    by_day = day_rest is not None and (limit < per_run or (limit == max(day_rest, 0) and not run_first))
    # Once the limit is reached, it refuses every call after the last one sent; until then only a source's budget does.
    full = (F.col("__sent") >= limit) & (F.lit(limit <= 0) | (at > F.col("__last")))
    reason = F.when(at > F.col("__stop"), BRAKE).when(full, DAY if by_day else RUN).when(~F.col("admitted"), SOURCE)
    return rows.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(stop)).withColumn("reason", reason).drop("__one", "admitted", "__last", "__sent", "__stop")


def counted(used: DataFrame, run: DataFrame, day: str) -> DataFrame:
    """used (day, calls) with the calls that a decided run has sent, by the day in its column day; a state to hand to the next run."""
    sent = run.where(F.col("reason").isNull()).groupBy(F.col(day).alias("day")).agg(F.count("*").alias("calls"))
    return used.unionByName(sent).groupBy("day").agg(F.sum("calls").alias("calls"))


def rest_of(used: DataFrame, day: Any, per_day: int) -> int:
    """What the day has left."""
    row = used.where(F.col("day") == F.lit(day)).agg(F.sum("calls")).first()
    return max(per_day - (row[0] or 0), 0)


class Failures:
    """A key's failures in order: the last times, how many since the count was cleared (most - 1 at most), and until when the key is locked."""

    def __init__(self, most: int, seconds: int, lock_seconds: int, times: list[int] | None = None, since: int = 0, until: int | None = None):
        self.limits = most, seconds, lock_seconds
        self.times, self.since, self.until = times or [], since, until

    def take(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
        """failures, locked and locked_until of the next failures, at the seconds s (sorted).

        Only the most - 1 failures before one can matter. One is ready if all of these are near enough; it locks if it is
        the most-th since the last lock or later, so the locks are found by going from ready to ready.
        """
        most, seconds, lock_seconds = self.limits
        n, m = len(s), len(self.times)
        t = np.r_[np.array(self.times, np.int64), s]
        near = np.zeros(n, np.int64)
        for k in range(1, most):
            i = np.arange(max(k - m, 0), n)
            near[i] += t[i + m] - t[i + m - k] <= seconds
        ready = np.flatnonzero(near >= most - 1)
        last = np.full(n + 1, -1)  # the last lock before each failure
        at = np.searchsorted(ready, most - 1 - self.since)
        while at < len(ready):
            last[ready[at] + 1] = ready[at]
            at = np.searchsorted(ready, ready[at] + most)
        locked = last[1:] >= 0
        last = np.maximum.accumulate(last)
        since = np.where(last >= 0, np.arange(n + 1) - last - 1, np.arange(n + 1) + self.since)
        failures = 1 + np.minimum(near, since[:-1])
        until = [self.until if k < 0 else int(s[k]) + lock_seconds for k in last[1:].tolist()]
        shown = [u if u is not None and u >= x else None for u, x in zip(until, s.tolist(), strict=True)]
        if n:
            self.times, self.since, self.until = t[-(most - 1) :].tolist() if most > 1 else [], int(min(since[-1], most - 1)), until[-1]
        return failures, locked, shown


def key_runs(frames: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Runs of one key in sorted frames, and whether each begins a key (or the piece)."""
    held: Any = ...
    for pdf in frames:
        k = pdf[key]
        new = ~((k == k.shift()) | (k.isna() & k.shift().isna())).to_numpy()
        new[:1] = True
        cuts = [*np.flatnonzero(new).tolist(), len(pdf)]
        for i, j in zip(cuts, cuts[1:]):
            own = None if pd.isna(k.iloc[i]) else k.iloc[i]
            yield held is ... or own != held, pdf.iloc[i:j]
            held = own


def locked_out(attempts: DataFrame, key: str, at: str, order: list[str], most: int = 10, seconds: int = 900, lock_seconds: int = 900) -> DataFrame:
    """key, order, failures int, locked boolean, locked_until long of failed attempts: most of them within seconds lock the key for lock_seconds.

    failures counts this attempt and those of the last seconds since the count was last cleared; the attempt that locks clears it. locked_until
    (seconds since 1970) is the end of the lock that this attempt sets or meets, null if there is none.

    A key's attempts are cut into pieces. What matters of earlier pieces is a state of few values: the last times, and how many attempts
    since the last lock, up to most - 1. So a piece that one key fills is summed up by what each of these states becomes
    in it, and the states at the pieces' beginnings follow piece by piece. Of each piece only its summary reaches the driver.
    """
    limits = (most, seconds, lock_seconds)
    rows = attempts.select(key, *order, F.col(at).alias("__at")).withColumn("__s", F.unix_timestamp("__at"))
    rows = in_pieces(rows, key, "__at", *order)
    kinds = dict(rows.dtypes)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for the piece: its first and last key, whether they are one, and the state at its end if its keys begin in it."""
        first, state, last, n, piece = None, Failures(*limits), None, 0, 0
        for begins, run in key_runs(frames, key):
            last = None if pd.isna(run[key].iloc[0]) else run[key].iloc[0]
            if begins:
                state, n = Failures(*limits), n + 1
                first = last if n == 1 else first
            state.take(run["__s"].to_numpy(np.int64))
            piece = int(run["__piece"].iloc[0])
        if n:
            yield pd.DataFrame([(piece, first, last, n == 1, state.times, state.since, state.until)], columns=["piece", "first", "last", "one", "times", "since", "until"])

    pieces = rows.mapInPandas(summed, f"piece int, first {kinds[key]}, last {kinds[key]}, one boolean, times array<long>, since int, until long").collect()
    pieces.sort(key=lambda r: r["piece"])
    handed: dict[int, list[int]] = {}  # the last times before a piece that goes on with a key
    for before, r in zip(pieces, pieces[1:]):
        if before["last"] == r["first"]:
            handed[r["piece"]] = ([*handed.get(before["piece"], []), *before["times"]] if before["one"] else list(before["times"]))[-(most - 1) :] if most > 1 else []
    inner = {r["piece"] for r in pieces if r["one"] and r["piece"] in handed}

    def becomes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of a piece that is one key's, gone on with: what each number since the last lock becomes, and the last lock's end."""
        states: list[Failures] = []
        piece = -1
        for pdf in frames:
            if not len(pdf):
                continue
            piece = int(pdf["__piece"].iloc[0])
            states = states or [Failures(*limits, list(handed[piece]), e) for e in range(most)]
            for state in states:
                state.take(pdf["__s"].to_numpy(np.int64))
        if states:
            yield pd.DataFrame([(piece, [x.since for x in states], [x.until for x in states])], columns=["piece", "since", "until"])

    maps: dict[int, Any] = {}
    if inner:
        maps = {r["piece"]: r for r in rows.where(F.col("__piece").isin(*inner)).mapInPandas(becomes, "piece int, since array<int>, until array<long>").collect()}
    begins: dict[int, tuple[list[int], int, int | None]] = {}
    ended: tuple[int, int | None] = (0, None)
    for r in pieces:
        p = r["piece"]
        if p in handed:
            begins[p] = (handed[p], *ended)
        if p in maps:
            since, until = ended
            ended = maps[p]["since"][since], until if maps[p]["until"][since] is None else maps[p]["until"][since]
        else:
            ended = r["since"], r["until"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for new, part in key_runs(frames, key):
            if state is None and (given := begins.get(int(part["__piece"].iloc[0]))):
                state = Failures(*limits, list(given[0]), given[1], given[2])
            elif new:
                state = Failures(*limits)
            failures, locked, until = state.take(part["__s"].to_numpy(np.int64))
            yield part[[key, *order]].assign(failures=failures.astype(np.int32), locked=locked, locked_until=pd.array(until, "Int64"))

    return rows.mapInPandas(run, ", ".join([f"`{c}` {kinds[c]}" for c in (key, *order)]) + ", failures int, locked boolean, locked_until long")

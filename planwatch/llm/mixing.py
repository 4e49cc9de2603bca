"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, checkpointed, small, stored

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size long, target double from sizes (source, size): a row for each source.

    The sources, by code point and null last, weigh as weights says, repeating, and share
    share * all sizes; a target stops at most * its source's size and the excess goes to the others by weight. That fixed
    point is a water level: sources whose room for their weight is least are full first. The windows
    below run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    full, left = Window.partitionBy(), by_room.rowsBetween(0, Window.unboundedFollowing)
    return (
        per.withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", (share * F.sum("source_size").over(full) - F.col("before")) / F.sum("weight").over(left))
        # The level of the first source that isn't full; where all are, none is above its cap.
        .withColumn("order", F.row_number().over(by_room))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("room"), F.struct("order", "level"))).over(full)["level"])
        .select(
            "source",
            "source_size",
            F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
        )
    )


def balanced(hist: DataFrame, goal: DataFrame, most: float = 2.0, steps: int = 40, near: float = 1e-9) -> DataFrame:
    """source, source_size, target, scale double, dual double: the multipliers that meet the targets.

    A document of size x is taken at the rate most / (1 + exp(-dual * x / scale)): the exponential tilt of
    the even rate that changes entropy least among rates between 0 and most whose tokens add up
    to the target (x / scale is its size against the token-weighted mean of its source). Each Newton step is
    one aggregate over hist (source, size, n) for all sources at once, and stays inside the
    bracket known so far, halving it where Newton would leave it. Sources without words, or at most times their size, have no
    finite dual and need none.
    """
    rate = most / (1 + F.exp(-F.col("dual") * F.col("z")))
    mean = F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size")), F.sum(F.col("n") * F.col("size")))
    scale = hist.groupBy("source").agg(F.coalesce(mean, F.lit(1.0)).alias("scale"))
    state = checkpointed(
        goal.join(scale, goal.source.eqNullSafe(scale.source))
        .select(goal.source, "source_size", "target", "scale", F.lit(0.0).alias("dual"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"))
    )
    for _ in range(steps):
        s = small(state, 100_000).alias("s")
        row = hist.join(s, hist.source.eqNullSafe(F.col("s.source"))).select(
            "s.*", (F.col("size") / F.col("scale")).alias("z"), (F.col("n") * F.col("size")).alias("tokens")
        )
        got = (
            row.groupBy("source", "source_size", "target", "scale", "dual", "low", "high")
            .agg(
                F.sum(F.col("tokens") * rate).alias("now"),
                F.sum(F.col("tokens") * F.col("z") * rate * (1 - rate / most)).alias("slope"),
            )
            .withColumn("gap", F.col("now") - F.col("target"))
            .withColumn("low", F.when(F.col("gap") < 0, F.col("dual")).otherwise(F.col("low")))
            .withColumn("high", F.when(F.col("gap") >= 0, F.col("dual")).otherwise(F.col("high")))
            .withColumn("newton", F.try_divide(-F.col("gap"), F.col("slope")) + F.col("dual"))
            .withColumn(
                "next",
                F.when(F.col("newton").between(F.col("low"), F.col("high")), F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2),
            )
        )
        open_ = (F.abs("gap") > near * F.col("target")) & (F.col("source_size") > 0) & (F.col("target") < most * F.col("source_size"))
        state = checkpointed(
            got.select("source", "source_size", "target", "scale", F.when(open_, F.col("next")).otherwise(F.col("dual")).alias("dual"), "low", "high", open_.alias("open"))
        )
        if not state.where("open").limit(1).count():
            break
        state = state.drop("open")
    return state.select("source", "source_size", "target", "scale", "dual")


#: A class of equal sizes is ordered within so many parts, so that no task orders all of a class.
PARTS = 1024


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes with place long, a row's own mark, and nth long, its number among those of its source and size; both follow from content alone.

    Rows of one content (equal key) are first numbered among themselves, by where they stand: within each part of the table, after
    what earlier parts hold, so that a row repeated without end is counted where it is. Content and that number then give each row a
    place of its own, and the places are counted in PARTS ranges of each size.
    """
    same = ["source", "size", "key"]
    split = sizes.withColumn("part", F.shiftright("row", 33))
    per = split.groupBy(*same, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = stored(per.select(*same, "part", F.coalesce(before, F.lit(0)).alias("before")).where("before > 0"))
    earlier = small(earlier.toDF("s", "z", "k", "p", "before"), 100_000)
    own = F.row_number().over(Window.partitionBy(*same, "part").orderBy("row"))
    rows = (
        split.withColumn("own", own)
        .join(earlier, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("key") == F.col("k")) & (F.col("part") == F.col("p")), "left")
        .withColumn("place", F.xxhash64("key", F.col("own") + F.coalesce("before", F.lit(0))))
        .withColumn("range", F.pmod("place", F.lit(PARTS)))
        .drop("s", "z", "k", "p", "before", "own", "part")
    )
    rows = stored(rows)
    of_range = rows.groupBy("source", "size", "range").agg(F.count("*").alias("n"))
    less = F.sum("n").over(Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    skipped = of_range.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("range").alias("g"), less.alias("skipped")).where("skipped > 0")
    inside = F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("place", "row"))
    return (
        rows.withColumn("inside", inside)
        .join(skipped, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("range") == F.col("g")), "left")
        .withColumn("nth", F.col("inside") + F.coalesce("skipped", F.lit(0)))
        .drop("s", "z", "g", "skipped", "inside", "range")
    )


def with_copies(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """sizes (stored: row long, source, size long, key long and others) with source_size, target and copies int: how often the mix takes each.

    row numbers the rows by where they stand (see placed()), key is a hash of the content. Rates come from balanced(). They
    become whole copies by rounding their running sum, in the order of sizes, to the nearest whole number: the sum is then never more than
    half a copy off, so a source's taken tokens are less than its largest document away from its target, however many rows are equal; made_up()
    then brings them nearer.
    Which of the documents of one size are taken depends on their content alone, so reruns agree. Documents of size 0 are never taken; a
    null source is a source; repeated rows and ids, and null ids, are rows like others. An empty table gives no rows.
    """
    # Equal sizes of a source share a rate, so Newton and the running sum run over a histogram.
    hist = stored(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = checkpointed(targets(hist.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most))
    dual = small(balanced(hist, goal, most).withColumnRenamed("source", "of"), 100_000)
    rate = F.when(F.col("target") >= most * F.col("source_size"), F.lit(float(most))).otherwise(most / (1 + F.exp(-F.col("dual") * F.col("size") / F.col("scale"))))
    before = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    rates = (
        hist.join(dual, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
        .select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "rate", F.coalesce(before, F.lit(0.0)).alias("before"))
    )
    upto = lambda k: F.floor(F.col("before") + k * F.col("rate") + 0.5)
    copies = F.greatest(F.least(upto(F.col("nth")) - upto(F.col("nth") - 1), F.lit(most)), F.lit(0)).cast("int")
    rounded = stored(
        numbered(sizes)
        .join(small(stored(rates), 100_000), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
        .drop("s", "z", "rate", "before", "nth")
    )
    changes = F.broadcast(made_up(rounded, most)) if rounded.select("source").distinct().limit(1001).count() <= 1000 else made_up(rounded, most)
    return (
        rounded.join(changes, F.col("source").eqNullSafe(F.col("s")) & (F.col("place") == F.col("p")), "left")
        .withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0)))
        .drop("s", "p", "step", "place")
    )


def made_up(rounded: DataFrame, most: int) -> DataFrame:
    """s, p (a source and a row's place), step int: single copies to add or take away so that a source's tokens come nearer to its target.

    Of each power of two of sizes two rows that a copy can be added to and two that one can be taken from may serve, some forty a source at most. Largest first, each that fits
    into what is still missing is changed, so the distance only shrinks.
    """
    spare = (
        rounded.where("size > 0")
        .withColumn("class", F.floor(F.log2("size")).cast("int"))
        .withColumn("half", F.pmod("place", F.lit(2)))
        .groupBy("source", "class", "half")
        .agg(*[F.min(F.when(fits, F.struct("place", "size"))).alias(name) for name, fits in (("add", F.col("copies") < most), ("cut", F.col("copies") > 0))])
        .groupBy(F.col("source").alias("of"))
        .agg(*[F.collect_list(F.struct(F.col(f"{k}.size").alias("size"), F.col(f"{k}.place").alias("place"))).alias(k) for k in ("add", "cut")])
    )
    gap = rounded.groupBy("source", "target").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
    given = F.when(F.col("gap") >= 0, F.col("add")).otherwise(F.col("cut"))
    moves = gap.join(spare, F.col("source").eqNullSafe(F.col("of"))).select(
        "source",
        F.abs("gap").alias("gap"),
        F.when(F.col("gap") >= 0, 1).otherwise(-1).alias("step"),
        F.sort_array(F.filter(given, lambda x: x["size"].isNotNull()), asc=False).alias("spare"),
    )
    start = F.struct(F.col("gap").alias("left"), F.array().cast("array<bigint>").alias("places"))

    def nearer(acc: Column, x: Column) -> Column:
        fits = x["size"] <= acc["left"]
        return F.struct(
            F.when(fits, acc["left"] - x["size"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.concat(acc["places"], F.array(x["place"]))).otherwise(acc["places"]).alias("places"),
        )

    return stored(moves.select(F.col("source").alias("s"), F.explode(F.aggregate("spare", start, nearer)["places"]).alias("p"), "step"))


def placed(docs: DataFrame, row: str = "row") -> DataFrame:
    """docs with row long (where each stands: the part of the table in the upper bits), stored, so that the numbers stay what they are."""
    return stored(docs.withColumn(row, F.monotonically_increasing_id()))


def content(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text; a null id isn't an empty text's."""
    return F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull())


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target, copies int, taken long for each row of docs; see with_copies(). A null text has size 0."""
    sizes = placed(
        docs.select(
            F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), content(id_col, text_col).alias("key")
        )
    )
    out = with_copies(sizes).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.select("id", "source", "size", "source_size", "target", "copies", "taken")

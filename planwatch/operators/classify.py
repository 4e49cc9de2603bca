"""Rule-based judging of finds: places, jobs and reasons of rejection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import geo
from ..functions import text as T
from .filters import excluded_domain, small_ownership


def places_within(places: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """places (name, lat, lon, ...) with distance_km, to one decimal, of those at most km away."""
    exact = geo.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return places.withColumn("__km", exact).where(F.col("__km") <= km).withColumn("distance_km", F.round("__km", 1)).drop("__km")


def search_jobs(places: DataFrame, templates: Mapping[str, Sequence[str]]) -> DataFrame:
    """places with phase and query: each place for each template of each phase. The templates are few and given in the call."""
    pairs = [F.struct(F.lit(p).alias("phase"), F.lit(t).alias("template")) for p, ts in templates.items() for t in ts]
    name = F.coalesce(F.col("search_name"), F.col("name")) if "search_name" in places.columns else F.col("name")
    return places.withColumn("__t", F.explode(F.array(*pairs))).withColumn("phase", F.col("__t.phase")).withColumn("query", F.replace(F.col("__t.template"), F.lit("{ort}"), name)).drop("__t")


def match_word(columns: Sequence[str]) -> Column:
    return F.coalesce(F.col("match_word"), F.col("place")) if "match_word" in columns else F.col("place")


def filled(message: str, *values: Column | int) -> Column:
    """A message with values for {0}, {1} and so on."""
    out = F.lit(message)
    for k, v in enumerate(values):
        out = F.replace(out, F.lit(f"{{{k}}}"), v.cast("string") if isinstance(v, Column) else F.lit(str(v)))
    return out


def judged(
    results: DataFrame,
    year: int,
    housing: Sequence[str] = D.HOUSING_WORDS,
    domains: Sequence[str] = D.EXCLUDED_DOMAINS,
    least_units: int = D.OWNERSHIP_LEAST_UNITS,
    excerpt_most: int = D.EXCERPT_MOST,
    starts: Sequence[str] = D.START_WORDS,
    permits: Sequence[str] = D.PERMIT_WORDS,
    future: Sequence[str] = D.FUTURE_WORDS,
    ownership: Sequence[str] = D.OWNERSHIP_WORDS,
    rent: Sequence[str] = D.RENT_WORDS,
) -> DataFrame:
    """results (url, title, content, place and perhaps match_word) with what the text says and reject_reason.

    The first test that fails gives the reason: domain, place, housing word, phase, few homes for sale. A null reason is a find. What only
    later tests ask for isn't worked out: phase is null for a result rejected before it, tenure, units and quote for one without a phase.
    """
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    word = match_word(results.columns)
    rows = results.withColumn("__text", text).withColumn("domain", T.domain(F.col("url")))
    early = (
        F.when(excluded_domain(F.col("domain"), domains), filled(D.REJECT_DOMAIN, F.col("domain")))
        .when(~T.has_word(F.col("__text"), word), filled(D.REJECT_PLACE, word))
        .when(~T.contains_any(F.col("__text"), housing), F.lit(D.REJECT_HOUSING))
    )
    rows = rows.withColumn("__early", early).withColumn("phase", F.when(F.col("__early").isNull(), T.phase(F.col("__text"), year, starts, permits, future)))
    found = lambda x: F.when(F.col("phase").isNotNull(), x)
    rows = (
        rows.withColumn("tenure", found(T.tenure(F.col("__text"), ownership, rent)))
        .withColumn("__units", found(T.unit_count(F.col("__text"))))
        .withColumn("units", F.col("__units.units"))
        .withColumn("quote", F.col("__units.quote"))
    )
    reason = F.when(F.col("__early").isNotNull(), F.col("__early")).when(F.col("phase").isNull(), F.lit(D.REJECT_PHASE)).when(
        small_ownership(F.col("tenure"), F.col("units"), least_units), filled(D.REJECT_OWNERSHIP, F.col("units"), least_units)
    )
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url"))
    return (
        rows.withColumn("reject_reason", reason)
        .withColumn("title", F.substring(title, 1, D.TITLE_MOST))
        .withColumn("excerpt", F.substring("content", 1, excerpt_most))
        .withColumn("key", T.normal_url(F.col("url")))
        .drop("__text", "__units", "__early")
    )


def nearest_place(articles: DataFrame, places: DataFrame, id_col: str, text: Column) -> DataFrame:
    """articles with the nearest of places (name, distance_km and perhaps match_word) that the text names as a word; null if none.

    A place is first looked for by its first word, in an equi-join with the text's words; then as a whole.
    """
    word = F.coalesce(F.col("match_word"), F.col("name")) if "match_word" in places.columns else F.col("name")
    side = places.select(F.col("name").alias("place"), "distance_km", word.alias("__word"))
    side = side.withColumn("__key", F.regexp_extract(F.lower("__word"), r"(?U)\w+", 0))
    words = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower("__text"), F.lit(r"(?U)(\w+)"), F.lit(1))))
    texts = articles.select(F.col(id_col).alias("__id"), text.alias("__text"))
    # Ids and single words meet the places; the texts join only what is left.
    met = texts.select("__id", F.explode(words).alias("__key")).join(F.broadcast(side) if side.limit(10_001).count() <= 10_000 else side, "__key").drop("__key").distinct()
    best = (
        texts.join(met, "__id")
        .where(T.has_word(F.col("__text"), F.col("__word")))
        .groupBy("__id")
        .agg(F.min(F.struct("distance_km", "place")).alias("__best"))
    )
    return articles.join(best, F.col(id_col) == F.col("__id"), "left").withColumn("place", F.col("__best.place")).withColumn("distance_km", F.col("__best.distance_km")).drop("__id", "__best")


def judged_press(articles: DataFrame, places: DataFrame, id_col: str, year: int) -> DataFrame:
    """articles (url, title, content) judged for the nearest place they name; without one that is the reason.

    A title that the content begins with is taken off it; the excerpt is shorter than that of search results.
    """
    content = F.when(F.startswith(F.col("content"), F.col("title")), F.trim(F.substr(F.col("content"), F.length("title") + 1))).otherwise(F.col("content"))
    rows = articles.withColumn("content", content)
    rows = nearest_place(rows, places, id_col, F.concat_ws("\n", "title", "content"))
    out = judged(rows.withColumn("match_word", F.col("place")), year, excerpt_most=D.PRESS_EXCERPT_MOST)
    return out.withColumn("reject_reason", F.when(F.col("place").isNull(), F.lit(D.REJECT_NO_PLACE)).otherwise(F.col("reject_reason"))).drop("match_word")


def by_distance(places: DataFrame, key: str = "name") -> DataFrame:
    """Nearest first."""
    return places.orderBy("distance_km", key)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the first by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

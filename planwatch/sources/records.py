"""Schemas of stored payloads, and expansions of them into meetings and documents.

Meetings: source_id, external_id, committee, date, time, place, url, cancelled. Documents: source_id, external_id, meeting_id,
paper_id, number, title, url, kind, text. Fetching is a client's work; these functions take what it has stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..defaults import ZONE
from ..functions import text as T
from ..operators.classify import first_wins
from .html import NO_TITLE, parsed, plain_text, press_rows, unescaped

FILE = "struct<id string, type string, name string, mimeType string, date string, accessUrl string, downloadUrl string>"
MEETING = (
    "id string, name string, start string, `end` string, location struct<description string, room string, locality string>, "
    f"invitation {FILE}, resultsProtocol {FILE}, auxiliaryFile array<{FILE}>, cancelled boolean, "
    f"agendaItem array<struct<id string, number string, name string, public boolean, consultation string, resolutionFile {FILE}, auxiliaryFile array<{FILE}>>>"
)
CONSULTATION = "id string, paper string"
PAPER = f"id string, reference string, name string, mainFile {FILE}, auxiliaryFile array<{FILE}>"
PACKAGE = "success boolean, result struct<results array<struct<name string, title string, url string, extras array<struct<key string, value string>>, resources array<struct<id string, name string, format string, url string, position int>>>>>"
FEED = "title string, link string, pubDate string, category array<string>, guid struct<_VALUE string>, description string"
MEETING_COLUMNS = ("source_id", "external_id", "committee", "date", "time", "place", "url", "cancelled")
DOCUMENT = ("source_id", "external_id", "meeting_id", "paper_id", "number", "title", "url", "kind", "text")


def json_pages(spark: SparkSession, path: str, schema: str, wrapped: bool = False) -> DataFrame:
    """Stored JSON objects; wrapped: pages whose objects are in data."""
    if wrapped:
        return spark.read.schema(f"data array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline("data"))
    return spark.read.schema(schema).option("multiLine", True).json(path)


def oparl_meetings(meetings: DataFrame, source_id: str, start: Column, end: Column) -> DataFrame:
    """Meetings of stored objects from start to end; the committee's name loses its session number. Day and time are the ones that the object states."""
    named = T.without_session_number(T.normal_space(F.coalesce("name", F.lit(""))))
    place = F.coalesce(F.nullif("location.room", F.lit("")), "location.description")
    rows = meetings.where("id <> '' and start <> ''").withColumn("date", F.to_date(F.substring("start", 1, 10)))
    return rows.where(F.col("date").between(start, end)).select(
        F.lit(source_id).alias("source_id"),
        F.col("id").alias("external_id"),
        named.alias("committee"),
        "date",
        F.coalesce(F.nullif(F.substring("start", 12, 5), F.lit("")), F.lit("00:00")).alias("time"),
        F.nullif(T.normal_space(place), F.lit("")).alias("place"),
        F.col("id").alias("url"),
        F.coalesce("cancelled", F.lit(False)).alias("cancelled"),
    ).where("committee <> ''")


def file_rows(rows: DataFrame, source_id: str, file: Column, kind: Column, paper_id: Column, number: Column, order: Column) -> DataFrame:
    title = F.nullif(T.normal_space(F.coalesce(file["name"], F.lit(""))), F.lit(""))
    return rows.select(
        F.lit(source_id).alias("source_id"), F.nullif(file["id"], F.lit("")).alias("external_id"), F.col("meeting_id"), paper_id.alias("paper_id"), number.alias("number"),
        F.coalesce(title, F.lit(NO_TITLE)).alias("title"), F.coalesce(F.nullif(file["downloadUrl"], F.lit("")), F.nullif(file["accessUrl"], F.lit(""))).alias("url"), kind.alias("kind"), F.lit(None).cast("string").alias("text"), order.alias("position"),
    ).where("external_id is not null and url is not null")


def oparl_documents(meetings: DataFrame, consultations: DataFrame, papers: DataFrame, source_id: str) -> DataFrame:
    """Documents of meetings: invitation, minutes, other files, and per public agenda item the files of its paper, its resolution and its own files.

    An item without a paper (no consultation, none stored, or one that names none) stands for itself: its id and number are the paper's.
    """
    none = F.lit(None).cast("string")
    base = meetings.withColumn("meeting_id", F.col("id"))
    own = [
        file_rows(base, source_id, F.col("invitation"), F.lit("einladung"), none, none, F.lit(0)),
        file_rows(base, source_id, F.col("resultsProtocol"), F.lit("niederschrift"), none, none, F.lit(1)),
        file_rows(base.select("meeting_id", F.posexplode("auxiliaryFile").alias("p", "f")), source_id, F.col("f"), F.lit("anlage"), none, none, F.col("p") + 2),
    ]
    items = (
        base.select("meeting_id", F.posexplode("agendaItem").alias("p", "item"))
        .where(F.coalesce("item.public", F.lit(True)))
        .join(consultations.dropDuplicates(["id"]).select(F.col("id").alias("c"), "paper"), F.col("item.consultation") == F.col("c"), "left")
        .join(papers.dropDuplicates(["id"]).select(F.col("id").alias("q"), "reference", "mainFile", F.col("auxiliaryFile").alias("more")), F.col("paper") == F.col("q"), "left")
    )
    listed = lambda files: F.transform(F.coalesce(files, F.array().cast(f"array<{FILE}>")), lambda f: F.struct(F.lit("anlage").alias("kind"), f.alias("f")))
    one = lambda kind, file: F.array(F.struct(F.lit(kind).alias("kind"), file.alias("f")))
    files = F.concat(one("vorlage", F.col("mainFile")), listed(F.col("more")), one("beschluss", F.col("item.resolutionFile")), listed(F.col("item.auxiliaryFile")))
    number = F.when(F.col("q").isNull(), F.col("item.number")).otherwise(F.col("reference"))
    each = items.select("meeting_id", "p", F.coalesce("q", "item.id").alias("paper_key"), number.alias("paper_number"), F.posexplode(files).alias("n", "x"))
    rows = file_rows(each, source_id, F.col("x.f"), F.col("x.kind"), F.col("paper_key"), F.col("paper_number"), F.col("p") * 1000 + F.col("n") + 100)
    return own[0].unionByName(own[1]).unionByName(own[2]).unionByName(rows)


def extra(extras: Column, key: str) -> Column:
    """The date under the first extra of that key; null if there is none or it is no date."""
    return F.try_to_timestamp(F.substring(F.get(F.filter(extras, lambda e: e["key"] == key), F.lit(0))["value"], 1, 10), F.lit("yyyy-MM-dd")).cast("date")


#: Words in titles and the kinds they stand for, in order; other resources are of the last kind.
RESOURCE_KINDS = (("begründung", "begruendung"), ("bekanntmachung", "bekanntmachung"), ("festsetzung", "festsetzung"), ("planzeichnung", "festsetzung"))
OTHER_RESOURCE = "anlage"
#: The committee that packages are of, and the extra that holds their date.
PACKAGE_COMMITTEE, PACKAGE_DATE = "Bauleitplanung", "publishing_date"


def ckan_packages(pages: DataFrame) -> DataFrame:
    """Packages (p) of stored search pages; a page that reports a failure is an error."""
    sound = checked(pages, F.coalesce("success", F.lit(False)), "a search reported an error")
    return sound.select(F.explode("result.results").alias("p"))


def ckan_documents(pages: DataFrame, source_id: str) -> DataFrame:
    """PDF resources of stored search pages; a package is meeting and paper at once. The kind comes from the first word found in the title."""
    title = F.coalesce(F.nullif(T.normal_space(F.coalesce("r.name", F.lit(""))), F.lit("")), F.lit(NO_TITLE))
    kind = F.lit(OTHER_RESOURCE)
    for word, name in reversed(RESOURCE_KINDS):
        kind = F.when(F.contains(F.lower(title), F.lit(word)), F.lit(name)).otherwise(kind)
    rows = ckan_packages(pages).select("p", F.posexplode("p.resources").alias("position", "r"))
    return rows.where((F.upper(F.trim("r.format")) == "PDF") & (F.col("r.url") != "") & (F.col("r.id") != "")).select(
        F.lit(source_id).alias("source_id"), F.col("r.id").alias("external_id"), F.col("p.name").alias("meeting_id"), F.col("p.name").alias("paper_id"),
        F.lit(None).cast("string").alias("number"), title.alias("title"), F.col("r.url").alias("url"), kind.alias("kind"), F.lit(None).cast("string").alias("text"), "position",
    )


def ckan_meetings(pages: DataFrame, source_id: str, start: Column, end: Column, base_url: str = "") -> DataFrame:
    """A meeting for each package of stored search pages that is dated from start to end: it stands for itself, as it has no calendar."""
    packages = ckan_packages(pages).withColumn("date", extra(F.col("p.extras"), PACKAGE_DATE))
    none = F.lit(None).cast("string")
    return packages.where(F.col("date").between(start, end) & (F.col("p.name") != "")).select(
        F.lit(source_id).alias("source_id"), F.col("p.name").alias("external_id"), F.lit(PACKAGE_COMMITTEE).alias("committee"), "date", none.alias("time"), none.alias("place"),
        F.concat(F.lit(f"{base_url}package_show?id="), F.col("p.name")).alias("url"), F.lit(False).alias("cancelled"),
    )


def checked_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with just the columns of a contract, in its order; a missing one is an error."""
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"an adapter's rows lack {', '.join(missing)}")
    return rows.select(*columns)


def feed_date(x: Column) -> Column:
    """A feed's date in local time; the weekday, which the parser doesn't know, is taken off."""
    at = F.try_to_timestamp(F.regexp_replace(x, r"\A\s*\w+,\s*", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
    return F.to_date(F.from_utc_timestamp(at, ZONE))


def feed_articles(items: DataFrame, source_id: str, start: Column, end: Column, title_patterns: Sequence[str], place_patterns: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Articles of stored feed items from start to end; title, teaser or categories must match one of either list of patterns, if the list has any.

    An article's id is the post's number, else the last part of its address. Items without an address, an id or a date are left out. Of one
    id the first in the order of the columns of order counts, before anything else is asked of it; without them, the one that sorts first.
    """
    post = lambda x: F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), r"[?&]p=(\d+)", 1), F.lit(""))
    link = F.trim(F.coalesce("link", F.lit("")))
    slug = F.regexp_replace(F.regexp_extract(link, r"([^/]*)/*\z", 1), r"(?U)\W+", "-")
    tags = F.transform(F.coalesce("category", F.array().cast("array<string>")), T.normal_space)
    teaser = F.regexp_replace(plain_text(F.coalesce("description", F.lit(""))), r"\s*Source\s*\z", "")
    rows = items.select(
        F.lit(source_id).alias("source_id"), F.coalesce(post(F.col("guid._VALUE")), post(link), slug).alias("external_id"),
        T.normal_space(F.coalesce("title", F.lit(""))).alias("title"), link.alias("url"), feed_date(F.col("pubDate")).alias("date"),
        T.normal_space(teaser).alias("teaser"), tags.alias("categories"), *order,
    ).where("url <> '' and external_id <> '' and date is not null")
    first = first_wins(rows, ["source_id", "external_id"], list(order) or ["date", "title", "url", "teaser", "categories"])
    everything = F.concat_ws(" ", "title", "teaser", F.array_join("categories", " "))
    named = [T.matches_any(everything, p) for p in (title_patterns, place_patterns) if p]
    for condition in (F.col("date").between(start, end), *named):
        first = first.where(condition)
    return first.drop(*order)


def article_text(title: Column, body: Column, categories: Column) -> Column:
    tags = F.when(F.size(categories) > 0, F.concat(F.lit("Schlagworte: "), F.array_join(categories, ", "))).otherwise(F.lit(""))
    return T.joined_text(title, body, tags)


def coverage(articles: DataFrame, start: Column) -> DataFrame:
    """source_id, covered_from and whether a source's articles reach back to start."""
    return articles.groupBy("source_id").agg(F.min("date").alias("covered_from")).withColumn("complete", F.col("covered_from") <= start)


def press_links(pages: DataFrame, source_id: str, link_pattern: str, title_patterns: Sequence[str], order: str = "page_id") -> DataFrame:
    """Links of stored list pages (page_id, html) whose address has an id and a unix time (groups id and ts of link_pattern).

    Links without a text and, if there are title_patterns, those of other titles are passed over; of the rest the first of an id counts, in the
    order of pages and of links. A page without any such link is an error. The day is the time's in local time.
    """
    rows = parsed(pages, [order], press_rows(link_pattern), "external_id string, ts long, title string, url string, position int")
    rows = rows.where("title <> ''")
    if title_patterns:
        rows = rows.where(T.matches_any(F.col("title"), title_patterns))
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("ts"), ZONE))
    return first_wins(rows, ["external_id"], [order, "position"]).select(F.lit(source_id).alias("source_id"), "external_id", day.alias("date"), "title", "url")


def press_documents(links: DataFrame) -> DataFrame:
    """Each press release as a document of its own."""
    own = F.concat(F.lit("pm-"), "external_id")
    return links.select(
        "source_id", own.alias("external_id"), F.col("external_id").alias("meeting_id"), own.alias("paper_id"), F.concat(F.lit("PM "), "external_id").alias("number"), "title", "url",
        F.lit("pressemitteilung").alias("kind"), F.lit(None).cast("string").alias("text"),
    )


def json_ld_body(html: Column) -> Column:
    """The article text in the first JSON-LD block embedded in a page, with normal spaces and all entities resolved; null if there is none."""
    block = F.regexp_extract(html, r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    return F.nullif(unescaped(T.normal_space(F.get_json_object(block, "$.articleBody"))), F.lit(""))


def checked(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, whose reading fails loudly at the first row that breaks the condition: a changed layout isn't passed over."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))

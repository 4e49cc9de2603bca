"""HTML pages: calendars, agendas, lists and articles, read from stored pages.

A page whose layout isn't its system's stops the read with an error, so that a change isn't taken for an empty calendar.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import parse_qs, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end an open one of the kinds beside them.
ENDS = {"tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "li": ("li",), "p": ("p",), "option": ("option",)}


class Node:
    """An element of a page: its name, attributes and what is in it (elements and pieces of text)."""

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.inside: list[Node | str] = []
        self.classes = set((attrs.get("class") or "").split())

    def texts(self) -> Iterator[str]:
        for x in self.inside:
            if isinstance(x, str):
                yield x
            else:
                yield from x.texts()

    def text(self) -> str:
        """What stands in it, with single normal spaces between pieces."""
        return " ".join(" ".join(self.texts()).split())

    def all(self, tag: str = "", css: str = "", **attrs: str) -> Iterator[Node]:
        """Elements inside, in order, of that name, with all those classes and with attributes that match patterns."""
        wanted = set(css.split())
        for x in self.inside:
            if isinstance(x, Node):
                if (not tag or x.tag in tag.split()) and wanted <= x.classes and all(re.search(p, x.attrs.get(a) or "") for a, p in attrs.items()):
                    yield x
                yield from x.all(tag, css, **attrs)

    def first(self, tag: str = "", css: str = "", **attrs: str) -> Node | None:
        return next(self.all(tag, css, **attrs), None)

    def within(self, tag: str) -> Node | None:
        """The nearest element of that name around it."""
        x = self.parent
        while x and x.tag != tag:
            x = x.parent
        return x


class Tree(HTMLParser):
    """Builds the elements of a page; what isn't closed ends with what is around it."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        x = self.at
        while x.parent and x.tag in ENDS.get(tag, ()):
            self.at = x = x.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.inside.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.inside.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        while x.parent and x.tag != tag:
            x = x.parent
        if x.parent:
            self.at = x.parent

    def handle_data(self, data: str) -> None:
        self.at.inside.append(data)


def parsed(pages: DataFrame, keys: list[str], read: Callable[..., Iterator[tuple]], schema: str, html: str = "html") -> DataFrame:
    """Rows that read(root of the page, *keys of the page) yields, with the page's keys before them."""
    kinds = dict(pages.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, *[x.split()[0] for x in schema.split(", ")]]
        for pdf in frames:
            out = [(*own, *row) for *own, page in pdf.itertuples(index=False) for row in read(Tree(page or "").root, *own)]
            yield pd.DataFrame(out, columns=names, dtype=object)

    return pages.select(*keys, F.col(html).alias("html")).mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], schema]))


def query_value(url: str | None, name: str) -> str | None:
    return parse_qs(urlparse(url or "").query).get(name, [None])[0]


def trailing_number(url: str) -> str | None:
    tail = url.rstrip("/").rpartition("-")[2]
    return tail if tail.isdigit() else None


def layout(found: object, what: str) -> None:
    if not found:
        raise ValueError(f"the layout has changed: {what}")


def month_starts(start: Column, end: Column) -> Column:
    return F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))


#: Fixed value: how a cancelled meeting is announced; group 1 is the committee.
CANCELLED = re.compile(r"Die Sitzung des (.+?) fällt aus\.?", re.IGNORECASE)
MEETING = "external_id string, committee string, date date, time string, place string, url string, cancelled boolean"


def calendar_rows(page: Node, month: dt.date) -> Iterator[tuple]:
    """MEETING's values of a month's page: a row a day, with its number, and a cell for a meeting or for the notice that it is cancelled."""
    layout(page.first("meta", name="^sessionnet$"), "no mark of the system")
    table = page.first("table", id="si0040_contenttable")
    layout(table and table.first("tr"), f"no calendar of {month:%Y-%m}")
    for row in table.all("tr"):
        day = row.first("td", "smc_fct_day")
        if day is None or not day.text().isdigit():
            continue
        date = month.replace(day=int(day.text()))
        if gone := row.first("td", "tename"):
            if text := gone.text():
                named = CANCELLED.match(text)
                digest = hashlib.sha1(text.encode()).hexdigest()[:8]
                yield f"abgesagt-{date}-{digest}", named[1] if named else text, date, None, None, None, True
            continue
        cell = row.first("td", "silink")
        name = cell and cell.first("div", "smc-el-h")
        if not name or not (committee := name.text()):
            continue
        link = name.first("a", "smc_datatype_si")
        url = (link.attrs.get("href") or None) if link else None
        made = f"{date}-{re.sub('[^a-z0-9]+', '-', committee.lower()).strip('-')}"
        details = cell.first("ul", "smc-detail-list")
        time, place, *_ = [*[x.text() for x in details.all("li")], None, None] if details else (None, None)
        yield query_value(url, "__ksinr") or made, committee, date, time, place, url, False


def calendar_meetings(pages: DataFrame, source_id: str, start: Column, end: Column) -> DataFrame:
    """Meetings from start to end of stored calendar pages (month date, html).

    The id is in the link; a meeting without one gets its day and the committee's slug, a cancelled one its day and a hash of the notice.
    """
    rows = parsed(pages, ["month"], calendar_rows, MEETING)
    return rows.where(F.col("date").between(start, end)).select(F.lit(source_id).alias("source_id"), *[x.split()[0] for x in MEETING.split(", ")])


#: Codes of document icons, and the kinds they stand for.
KINDS = {"BM": "bekanntmachung", "ÖN": "niederschrift", "N": "niederschrift", "EI": "einladung", "VO": "vorlage"}
NO_TITLE = "(ohne Titel)"
LINK = "external_id string, paper_id string, number string, title string, url string, kind string, position int"


def agenda_rows(page: Node, meeting: str) -> Iterator[tuple]:
    """LINK's values of an agenda's page: documents outside of the table are the meeting's, those of public items ('Ö...') their papers'."""
    layout(page.first("meta", name="^sessionnet$"), "no mark of the system")
    table = page.first("table", "smctablesitzung")
    layout(table, f"no agenda of {meeting}")
    inside = set(map(id, table.all("div", "smc-d-el")))
    found = [(x, None, None) for x in page.all("div", "smc-d-el") if id(x) not in inside]
    for row in table.all("tr", "smc-t-r-l"):
        badge, cell = row.first("span", "badge"), row.first("td", "sidocs")
        if badge and badge.text().startswith("Ö") and cell:
            paper = row.first("a", "smc_datatype_vo")
            of = (query_value(paper.attrs.get("href"), "__kvonr"), paper.text() or None) if paper else (None, None)
            found += [(x, *of) for x in cell.all("div", "smc-d-el")]
    for k, (x, paper, number) in enumerate(found):
        links = list(x.all("a", href=r"^getfile\.php"))
        link = next((a for a in links if a.text()), links[0] if links else None)
        if link and (file := query_value(link.attrs["href"], "id")):
            symbol = x.first(css="smc-doc-symbol")
            title = link.text() or NO_TITLE
            kind = KINDS.get(symbol.text() if symbol else "") or ("anlage" if "anlage" in title.lower() else "unbekannt")
            yield file, paper, number, title, link.attrs["href"], kind, k


def agenda_documents(pages: DataFrame, source_id: str) -> DataFrame:
    """Documents of stored agenda pages (meeting_id, html); of links to one file in a meeting the first counts."""
    from ..operators.classify import first_wins

    rows = parsed(pages.withColumn("meeting_id", F.col("meeting_id").cast("string")), ["meeting_id"], agenda_rows, LINK)
    return first_wins(rows, ["meeting_id", "external_id"], ["position"]).select(
        F.lit(source_id).alias("source_id"), "external_id", "meeting_id", "paper_id", "number", "title", "url", "kind", F.lit(None).cast("string").alias("text"), "position"
    )


#: What rows of lists are, and the name that the system's pages bear.
LIST_ROW, BRAND = "row pt-3 border-top", "BV-HH"


def list_row(page: Node, what: object) -> list[Node]:
    brand = page.first("a", "navbar-brand")
    layout(brand and BRAND in brand.text(), f"no mark of the system on {what}")
    return list(page.all("div", LIST_ROW))


def list_rows(page: Node, number: int) -> Iterator[tuple]:
    rows = list_row(page, f"list page {number}")
    layout(rows or number != 1, "the first list page is empty")
    for k, row in enumerate(rows):
        link, committee = row.first("a", href="/meetings/"), row.first("a", href="/committees/")
        if not link or not committee or not committee.text():
            continue
        url, day = link.attrs["href"], re.search(r"(\d{2})\.(\d{2})\.(\d{4})", link.text())
        if (file := trailing_number(url)) and day:
            around = link.within("div")
            time = re.search(r"\b(\d{1,2}:\d{2})\b", around.text()) if around else None
            yield file, committee.text(), dt.date(*map(int, day.groups()[::-1])), time and time[1], None, url, False, k


def list_meetings(pages: DataFrame, source_id: str, start: Column, end: Column, most_pages: int = 60) -> DataFrame:
    """Meetings from start to end of stored list pages (page_id from 1, html; newest first).

    As the list falls, rows after the first one older than start are left out. More than most_pages pages are an error.
    """
    from .paging import newest_until

    n = pages.limit(most_pages + 1).count()
    if n > most_pages:
        raise ValueError(f"more than {most_pages} list pages")
    rows = parsed(pages.withColumn("page_id", F.col("page_id").cast("long")), ["page_id"], list_rows, f"{MEETING}, row int")
    placed = rows.withColumn("source_id", F.lit(source_id)).withColumn("position", F.struct("page_id", "row"))
    return newest_until(placed, F.col("source_id"), start).where(F.col("date") <= end).select("source_id", *[x.split()[0] for x in MEETING.split(", ")])


def list_agenda_rows(page: Node, meeting: str) -> Iterator[tuple]:
    rows = list_row(page, f"the agenda of {meeting}")
    layout(rows, f"no agenda of {meeting}")
    for k, row in enumerate(rows):
        cells = [x for x in row.inside if isinstance(x, Node) and x.tag == "div"]
        if len(cells) >= 3 and cells[0].text().startswith("Ö") and (link := cells[1].first("a", href="/documents/")):
            if file := trailing_number(link.attrs["href"]):
                number = cells[2].first("a")
                yield file, file, number.text() if number else None, link.text() or NO_TITLE, link.attrs["href"], "drucksache", k


def list_documents(agendas: DataFrame, texts: DataFrame, source_id: str) -> DataFrame:
    """Documents of stored agenda pages (meeting_id, html) with the text of their own pages (url, html); those without a text are left out."""
    from ..operators.classify import first_wins
    from .records import json_ld_body

    rows = parsed(agendas.withColumn("meeting_id", F.col("meeting_id").cast("string")), ["meeting_id"], list_agenda_rows, LINK)
    bodies = texts.dropDuplicates(["url"]).select(F.col("url").alias("of"), json_ld_body(F.col("html")).alias("text")).where("text is not null")
    with_text = rows.join(bodies, F.col("url") == F.col("of"))
    return first_wins(with_text, ["meeting_id", "external_id"], ["position"]).select(
        F.lit(source_id).alias("source_id"), "external_id", "meeting_id", "paper_id", "number", "title", "url", "kind", "text", "position"
    )


def press_rows(pattern: str) -> Callable[..., Iterator[tuple]]:
    known = re.compile(pattern)

    def read(page: Node, *_: object) -> Iterator[tuple]:
        links = [(k, a, m) for k, a in enumerate(page.all("a")) if (m := known.search(a.attrs.get("href") or ""))]
        layout(links, "no link to a press release")
        for k, a, m in links:
            yield m["id"], int(m["ts"]), a.text(), a.attrs["href"], k

    return read


def paragraphs(page: Node, css: str) -> str | None:
    """The paragraphs, headings and list items in the first element of a class, a line each; the whole text if it has none."""
    area = page.first(css=css)
    if area is None:
        return None
    return "\n".join(t for t in (x.text() for x in area.all("p h2 h3 li")) if t) or area.text()


def full_texts(articles: DataFrame, pages: DataFrame, css_class: str) -> DataFrame:
    """articles (url, ...) with text: the paragraphs in the element of a class of the stored page (url, html).

    Pages are joined by address, so only those of the articles that passed are parsed. A page without such an element, or without a text, is an
    error: its layout has changed. An article whose page isn't stored has no text.
    """

    def read(page: Node, url: str) -> Iterator[tuple]:
        text = paragraphs(page, css_class)
        layout(text, f"no text of class {css_class} in {url}")
        yield (text,)

    wanted = pages.join(articles.select("url").distinct(), "url", "left_semi").dropDuplicates(["url"])
    return articles.join(parsed(wanted, ["url"], read, "text string"), "url", "left")


def plain_text(x: Column) -> Column:
    """The text of a piece of HTML, all entities resolved, with normal spaces."""

    def run(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda p: None if p is None else Tree(p).root.text() if "<" in p or "&" in p else " ".join(p.split()))

    return F.pandas_udf(run, "string")(x)


def unescaped(x: Column) -> Column:
    """x with all entities of HTML resolved."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else unescape(t)), "string")(x)

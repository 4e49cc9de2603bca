"""Readers of stored payloads, on pages of the shapes that the systems send."""

import datetime as dt
import json

import pytest
from planwatch.sources import html, records, registry
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

MAY = dt.date(2026, 5, 1)


def day(x):
    return F.lit(x).cast("date")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def calendar(*days, mark='<meta name="sessionnet" content="x">', table="si0040_contenttable"):
    body = "".join(f"<tr><td class='x smc_fct_day'>{n}</td>{cell}" for n, cell in days)
    return f"<html><head>{mark}</head><body><table id='{table}1'><tbody>{body}</tbody></table></body></html>"


def session(name, link="", details="<li>18:00 Uhr<li>Saal 1"):
    inner = f"<a class='smc-link smc_datatype_si' href='{link}'>{name}</a>" if link else name
    return f"<td class='silink'><div class='smc-el-h'>{inner}</div><ul class='smc-detail-list'>{details}</ul></td>"


def test_calendar(spark):
    page = calendar(
        ("", ""),
        (4, session("Bau-  und Umweltausschuss", "si0057.php?__ksinr=12&amp;x=1")),
        (5, session("Rat &Auml;ltester", details="")),
        (6, "<td class='tename'>Die Sitzung des Stadtentwicklungsausschusses f&auml;llt aus.</td>"),
        (7, "<td class='tename'>Sitzung entf&auml;llt</td>"),
        (8, "<td></td>"),
        (30, session("Rat", "si0057.php?__ksinr=13")),
    )
    df = spark.createDataFrame([(MAY, page)], "month date, html string")
    got = records.checked_rows(html.calendar_meetings(df, "q", day("2026-05-01"), day("2026-05-29")), records.MEETING_COLUMNS)
    out = {r["date"].day: r for r in got.collect()}
    assert set(out) == {4, 5, 6, 7}
    assert tuple(out[4])[1:] == ("12", "Bau- und Umweltausschuss", dt.date(2026, 5, 4), "18:00 Uhr", "Saal 1", "si0057.php?__ksinr=12&x=1", False)
    assert tuple(out[5])[1:3] == ("2026-05-05-rat-ltester", "Rat Ältester") and out[5]["url"] is None and out[5]["time"] is None
    assert out[6]["cancelled"] and out[6]["committee"] == "Stadtentwicklungsausschusses" and len(out[6]["external_id"]) == len("abgesagt-2026-05-06-") + 8
    assert out[7]["cancelled"] and out[7]["committee"] == "Sitzung entfällt" and out[6]["external_id"].startswith("abgesagt-2026-05-06-")
    for bad in (calendar((4, ""), mark=""), calendar((4, ""), table="other"), calendar(), None):
        with pytest.raises(PySparkException):
            html.calendar_meetings(spark.createDataFrame([(MAY, bad)], "month date, html string"), "q", day("2026-05-01"), day("2026-05-31")).collect()
    assert [r[0] for r in spark.range(1).select(F.explode(html.month_starts(day("2026-11-20"), day("2027-01-02")))).collect()] == [dt.date(2026, 11, 1), dt.date(2026, 12, 1), dt.date(2027, 1, 1)]


def element(file, title, code=""):
    icon = f"<i class='smc-doc-symbol'>{code}</i>" if code else ""
    return f"<div class='smc-d-el'>{icon}<a href='getfile.php?id={file}&type=do'><img></a><a href='getfile.php?id={file}&type=do'>{title}</a></div>"


def test_agenda(spark):
    item = lambda badge, files, paper="": f"<tr class='smc-t-r-l'><td><span class='badge'>{badge}</span></td><td>{paper}</td><td class='sidocs'>{files}</td></tr>"
    paper = "<a class='smc_datatype_vo' href='vo0050.php?__kvonr=77'> B 26/0100 </a>"
    page = (
        "<meta name='sessionnet'>" + element(1, "Einladung", "EI") + element(2, "Bekanntmachung", "BM") + element(3, "Protokoll", "ÖN") + element(4, "Niederschrift", "N")
        + "<table class='smctablesitzung'><tr class='smc-t-r-l'><td>Öffentlicher Teil</td></tr>"
        + item("Ö 1", element(5, "Beschlussvorlage", "VO") + element(6, "Anlage 1 Plan") + element(1, "Noch einmal"), paper)
        + item("N 2", element(7, "Geheim", "VO")) + item("Ö 3", element(8, "Karte", "ZZ") + "<div class='smc-d-el'><a href='other.php?id=9'>kein</a></div>") + "</table>"
    )
    got = html.agenda_documents(spark.createDataFrame([(12, page)], "meeting_id long, html string"), "q")
    assert rows(got, "external_id", "kind", "title", "paper_id", "number") == [
        ("1", "einladung", "Einladung", None, None), ("2", "bekanntmachung", "Bekanntmachung", None, None), ("3", "niederschrift", "Protokoll", None, None), ("4", "niederschrift", "Niederschrift", None, None),
        ("5", "vorlage", "Beschlussvorlage", "77", "B 26/0100"), ("6", "anlage", "Anlage 1 Plan", "77", "B 26/0100"), ("8", "unbekannt", "Karte", None, None),
    ]
    for bad in ("<meta name='sessionnet'>", page.replace("<meta name='sessionnet'>", "")):
        with pytest.raises(PySparkException):
            html.agenda_documents(spark.createDataFrame([(12, bad)], "meeting_id long, html string"), "q").collect()


BRAND = "<a class='navbar-brand'>BV-HH</a>"


def listed(n, when, time="17:30 Uhr"):
    return f"<div class='row pt-3 border-top'><div><a href='/meetings/planung-{n}'>Mo, {when}</a> {time}</div><div><a href='/committees/3'> Planung </a></div></div>"


def test_list_pages(spark):
    pages = [(1, BRAND + listed(9, "09.05.2026") + listed(8, "08.05.2026", "9:30 Uhr")), (2, BRAND + listed(7, "07.05.2026") + listed(3, "03.04.2026") + listed(6, "06.05.2026")), (3, BRAND + listed(5, "05.05.2026")), (4, BRAND)]
    df = spark.createDataFrame(pages, "page_id long, html string").repartition(3)
    got = records.checked_rows(html.list_meetings(df, "h", day("2026-05-02"), day("2026-05-08")), records.MEETING_COLUMNS)
    assert rows(got, "external_id", "committee", "date", "time") == [("7", "Planung", dt.date(2026, 5, 7), "17:30"), ("8", "Planung", dt.date(2026, 5, 8), "9:30")]
    with pytest.raises(ValueError):
        html.list_meetings(df, "h", day("2026-05-02"), day("2026-05-08"), most_pages=3)
    for bad in ((1, BRAND), (2, listed(7, "07.05.2026"))):
        with pytest.raises(PySparkException):
            html.list_meetings(spark.createDataFrame([bad], "page_id long, html string"), "h", day("2026-05-02"), day("2026-05-08")).collect()


def test_documents_of_list_pages(spark):
    row = lambda badge, link, number="<a>22-1</a>": f"<div class='row pt-3 border-top'><div>{badge}</div><div>{link}</div><div>{number}</div></div>"
    doc = lambda n: f"<a href='/documents/antrag-{n}'>Antrag {n}</a>"
    agenda = BRAND + row("Ö 1", doc(1)) + row("NÖ 2", doc(2)) + row("Ö 3", "nur Text") + row("Ö 4", doc(4), "") + row("Ö 5", doc(1)) + row("Ö 6", doc(6))
    text = lambda body: f"<script type='application/ld+json'>{{}}</script><script type=\"application/ld+json\">{json.dumps({'articleBody': body})}</script>"
    texts = [("/documents/antrag-1", text("Neue  Wohnungen f&uuml;r&nbsp;alle &#8211; &quot;jetzt&quot;")), ("/documents/antrag-4", text("")), ("/documents/antrag-6", "<p>ohne")]
    texts = [(u, p.replace("<script type='application/ld+json'>{}</script>", "")) for u, p in texts]
    got = html.list_documents(spark.createDataFrame([("m", agenda)], "meeting_id string, html string"), spark.createDataFrame(texts, "url string, html string"), "h")
    assert rows(got, "external_id", "number", "kind", "title", "text") == [("1", "22-1", "drucksache", "Antrag 1", 'Neue Wohnungen für\xa0alle – "jetzt"')]


def test_full_texts(spark):
    articles = spark.createDataFrame([("u", "a"), ("v", "b"), ("w", "c")], "url string, title string")
    pages = [("u", '<p>vor</p><div class="x entry"><h2>Kopf</h2><p>eins <b>zwei</b></p><ul><li>drei<li>&Uuml;</ul><br></div><p>nach</p>'), ("w", '<div class="entry">nur  Text</div>'), ("x", "nicht gefragt")]
    df = spark.createDataFrame(pages, "url string, html string")
    assert rows(html.full_texts(articles, df, "entry"), "url", "text") == [("u", "Kopf\neins zwei\ndrei\nÜ"), ("v", None), ("w", "nur Text")]
    for bad in ("gone", "x empty"):
        with pytest.raises(PySparkException):
            html.full_texts(articles, df, bad).collect()


def file(i, name="n", **more):
    return {"id": f"f{i}", "name": f"{name}{i}", "downloadUrl": f"d{i}"} | more


def test_oparl(spark, tmp_path):
    meetings = [
        {"id": "m1", "name": "Rat  (3. Sitzung)", "start": "2026-05-04T17:00:00+02:00", "location": {"description": "Rathaus"}, "invitation": file(1), "resultsProtocol": file(2), "auxiliaryFile": [file(3), {"id": "f0", "name": "ohne Adresse"}],
         "agendaItem": [
             {"id": "t1", "number": "Ö 1", "public": True, "consultation": "c1", "resolutionFile": file(4), "auxiliaryFile": [file(5)]},
             {"id": "t2", "number": "N 2", "public": False, "consultation": "c1", "resolutionFile": file(6)},
             {"id": "t3", "number": "Ö 3", "resolutionFile": file(7, downloadUrl=None, accessUrl="a7"), "auxiliaryFile": [file(8, name="") | {"name": " "}]},
             {"id": "t4", "number": "Ö 4", "consultation": "gone", "auxiliaryFile": [file(9)]},
             {"id": "t5", "number": "Ö 5", "consultation": "c5"},
         ]},
        {"id": "m2", "name": "Rat", "start": "2027-05-04T17:00:00+02:00", "cancelled": True},
        {"id": "m3", "name": "Bauausschuss", "start": "2026-06-01T23:30:00Z", "cancelled": True, "location": {"room": "Saal", "description": "Rathaus"}},
        {"id": "m4", "name": "", "start": "2026-06-01T10:00:00Z"},
        {"id": "m5", "name": "Ohne Tag"},
    ]
    (tmp_path / "m.json").write_text(json.dumps({"data": meetings}))
    df = records.json_pages(spark, str(tmp_path / "m.json"), records.MEETING, wrapped=True)
    got = records.oparl_meetings(df, "o", day("2026-01-01"), day("2026-12-31"))
    assert rows(got, "external_id", "committee", "date", "time", "place", "cancelled") == [("m1", "Rat", dt.date(2026, 5, 4), "17:00", "Rathaus", False), ("m3", "Bauausschuss", dt.date(2026, 6, 1), "23:30", "Saal", True)]
    consultations = spark.createDataFrame([("c1", "p1"), ("c1", "p1"), ("c5", "gone")], records.CONSULTATION)
    (tmp_path / "p.json").write_text(json.dumps([{"id": "p1", "reference": "26/1", "name": "Plan", "mainFile": file(10), "auxiliaryFile": [file(11)]}]))
    docs = records.oparl_documents(df, consultations, records.json_pages(spark, str(tmp_path / "p.json"), records.PAPER), "o")
    assert rows(docs, "external_id", "kind", "paper_id", "number", "title", "url") == sorted(
        [
            ("f1", "einladung", None, None, "n1", "d1"), ("f2", "niederschrift", None, None, "n2", "d2"), ("f3", "anlage", None, None, "n3", "d3"),
            ("f10", "vorlage", "p1", "26/1", "n10", "d10"), ("f11", "anlage", "p1", "26/1", "n11", "d11"), ("f4", "beschluss", "p1", "26/1", "n4", "d4"), ("f5", "anlage", "p1", "26/1", "n5", "d5"),
            ("f7", "beschluss", "t3", "Ö 3", "n7", "a7"), ("f8", "anlage", "t3", "Ö 3", "(ohne Titel)", "d8"), ("f9", "anlage", "t4", "Ö 4", "n9", "d9"),
        ],
        key=repr,
    )


def test_ckan(spark, tmp_path):
    pdf = lambda i, name, kind="PDF", **more: {"id": i and str(i), "name": name, "format": kind, "url": f"u{i}"} | more
    files = [pdf(1, "Begründung zum Plan", "pdf "), pdf(2, "Karte", "GML"), pdf(3, "Blatt  2"), pdf(4, "Planzeichnung"), pdf(5, "Bekanntmachung der Festsetzung"), pdf(6, "Niederschrift"), pdf(7, " "), pdf(8, "x", url=""), pdf(None, "x")]
    package = lambda name, when, resources=(): {"name": name, "title": "Plan", "extras": [{"key": "publishing_date", "value": when}, {"key": "publishing_date", "value": "2020-01-01"}], "resources": list(resources)}
    found = [package("n", "2026-05-04T00:00:00", files), package("late", "2026-06-04"), package("bad", "kein Tag"), package("", "2026-05-04")]
    (tmp_path / "c.json").write_text(json.dumps({"success": True, "result": {"count": 3, "results": found}}))
    pages = records.json_pages(spark, str(tmp_path / "c.json"), records.PACKAGE)
    assert rows(records.ckan_documents(pages, "k"), "external_id", "kind", "title", "meeting_id") == [
        ("1", "begruendung", "Begründung zum Plan", "n"), ("3", "anlage", "Blatt 2", "n"), ("4", "festsetzung", "Planzeichnung", "n"), ("5", "bekanntmachung", "Bekanntmachung der Festsetzung", "n"), ("6", "anlage", "Niederschrift", "n"), ("7", "anlage", "(ohne Titel)", "n"),
    ]
    got = records.ckan_meetings(pages, "k", day("2026-05-04"), day("2026-05-04"), "https://x/")
    assert rows(got, "external_id", "committee", "url") == [("n", "Bauleitplanung", "https://x/package_show?id=n")]
    (tmp_path / "bad.json").write_text(json.dumps({"success": False}))
    with pytest.raises(PySparkException):
        records.ckan_documents(records.json_pages(spark, str(tmp_path / "bad.json"), records.PACKAGE), "k").collect()


def test_feed(spark):
    item = lambda k, guid, title, at, text, tags, link="https://x/Neue-Wörter/": (k, title, link, at, tags, (guid,), text)
    late = "Sun, 03 May 2026 23:30:00 +0000"
    items = [
        item(0, "https://x/?p=1", "Wohnungen &amp; Ring".replace("&amp;", "&"), late, "<p>in Norder&shy;stadt &uuml;ber</p> Norderstadt <a>Source</a>", ["Bau"]),
        item(1, "https://x/?p=1", "Zweite Fassung, Wohnungen", late, "Norderstadt", []),
        item(2, "https://x/?p=2", "Sport", "Mon, 04 May 2026 10:00:00 +0000", "Norderstadt", []),
        item(3, "tag:x", "Neues", "Mon, 04 May 2026 10:00:00 +0000", "120 Wohnungen", ["Norderstadt"]),
        item(4, "https://x/?p=4", "Wohnungen", "Mon, 04 May 2020 10:00:00 +0000", "Norderstadt", []),
        item(5, "https://x/?p=5", "Wohnungen", None, "Norderstadt", []),
        item(6, "https://x/?p=6", "Wohnungen", late, "Norderstadt", [], ""),
    ]
    df = spark.createDataFrame(items, f"position int, {records.FEED.replace('pubDate string, category array<string>, guid', 'pubDate string, category array<string>, guid')}").repartition(4)
    got = records.feed_articles(df, "r", day("2026-05-01"), day("2026-05-31"), ["wohnung"], ["norderstadt"], ["position"])
    assert rows(got, "external_id", "title", "date", "teaser") == [("1", "Wohnungen & Ring", dt.date(2026, 5, 4), "in Norder\xadstadt über Norderstadt"), ("Neue-Wörter", "Neues", dt.date(2026, 5, 4), "120 Wohnungen")]
    assert records.feed_articles(df, "r", day("2026-05-01"), day("2026-05-31"), [], ["norderstadt"]).count() == 3
    assert rows(records.coverage(got, day("2026-05-04")), "source_id", "covered_from", "complete") == [("r", dt.date(2026, 5, 4), True)]
    assert spark.range(1).select(records.article_text(F.lit("T"), F.lit("B"), F.array(F.lit("x"), F.lit("y")))).first()[0] == "T\n\nB\n\nSchlagworte: x, y"


LINKS = r"/media/custom/\d+_(?P<id>\d+)_1\.PDF\?(?P<ts>\d{9,11})"


def test_press_links(spark):
    link = lambda i, text, ts=1777888800: f"<a href='/media/custom/3_{i}_1.PDF?{ts}'>{text}</a>"
    first = link(77, "<img src=x>") + link(77, "Neue <b>Wohnungen</b> f&uuml;r alle") + link(77, "Wohnungen, noch einmal") + link(78, "Fest") + "<a href='/x'>Wohnungen</a>" + link(79, "Fest") + link(79, "Wohnungen")
    df = spark.createDataFrame([(2, link(77, "Wohnungen auf Seite zwei")), (1, first)], "page_id long, html string").repartition(2)
    got = records.press_links(df, "l", LINKS, ["wohnung"])
    assert rows(got, "external_id", "title", "date", "url") == [("77", "Neue Wohnungen für alle", dt.date(2026, 5, 4), "/media/custom/3_77_1.PDF?1777888800"), ("79", "Wohnungen", dt.date(2026, 5, 4), "/media/custom/3_79_1.PDF?1777888800")]
    assert records.press_links(df, "l", LINKS, []).count() == 3
    assert rows(records.press_documents(got), "external_id", "paper_id", "number", "kind")[0] == ("pm-77", "pm-77", "PM 77", "pressemitteilung")
    with pytest.raises(PySparkException):
        records.press_links(spark.createDataFrame([(1, "<a href='/x'>Wohnungen</a>")], "page_id long, html string"), "l", LINKS, []).collect()


def test_registry_and_gates(spark, tmp_path):
    with pytest.raises(PySparkException):
        records.checked(spark.range(2), F.col("id") < 1, "layout").collect()
    assert registry.reader("oparl") is records.oparl_meetings
    with pytest.raises(ValueError):
        registry.reader("fax")
    for system, source, name, page in (
        ("oparl", "o", "1.json", json.dumps({"data": [{"id": "m1", "name": "Rat", "start": "2026-05-04T17:00:00+02:00"}, {"id": "m2", "name": "Rat", "start": "2026-05-30T17:00:00+02:00"}]})),
        ("html_calendar", "c", "may.html", calendar((4, session("Rat", "x?__ksinr=12")))),
        ("html_list", "h", "page-1.html", BRAND + listed(8, "08.05.2026")),
        ("ckan", "k", "1.json", json.dumps({"success": True, "result": {"results": [{"name": "n", "extras": [{"key": "publishing_date", "value": "2026-05-04"}]}]}})),
    ):
        for month in ("2026-04", "2026-05"):
            folder = tmp_path / system / source / month
            folder.mkdir(parents=True)
            (folder / name).write_text(page if month == "2026-05" else "must not be opened \udcff", errors="surrogateescape")
        got = registry.meetings(spark, str(tmp_path), source, system, dt.date(2026, 5, 2), dt.date(2026, 5, 20))
        assert got.columns == list(records.MEETING_COLUMNS) and got.count() == 1
    with pytest.raises(ValueError):
        registry.meetings(spark, str(tmp_path), "r", "rss", MAY, MAY)
    with pytest.raises(ValueError):
        records.checked_rows(spark.range(1), ("source_id",))

"""Readers, merges, runs and columns that no table of the driver reaches, on small rows with known results."""

import datetime as dt
import random
import re
import time

import pytest
from planwatch import config
from planwatch import defaults as D
from planwatch.functions import text as T
from planwatch.functions import time as TM
from planwatch.operators import badges as B
from planwatch.operators import classify as C
from planwatch.operators import excerpt as E
from planwatch.operators import filters as P
from planwatch.operators import reports as R
from planwatch.plans import dashboard, exports, papers, recall, runs
from planwatch.state import budget, snapshot, upserts, window
from planwatch.streaming import ingest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DAY = dt.date(2026, 5, 4)


def day(x):
    return F.lit(x).cast("date")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) if names else tuple(r) for r in df.collect()), key=repr)


def each(spark, use, values, kind="string"):
    """What a column function gives for each of some values."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").orderBy("i")
    return [r["y"] for r in df.select("i", use(F.col("x")).alias("y")).orderBy("i").collect()]


# ---- functions ----


def test_text_columns(spark):
    assert each(spark, T.filename_safe, ["a/b c.pdf", "__x"]) == ["a_b_c_pdf", "x"]
    with pytest.raises(PySparkException):
        each(spark, T.filename_safe, ["///"])
    assert each(spark, T.without_session_number, ["Bauausschuss (7. Sitzung)", "Rat"]) == ["Bauausschuss", "Rat"]
    assert each(spark, T.trailing_id, ["https://x/titel-4711/", "https://x/titel"]) == ["4711", None]
    assert each(spark, T.german_date, ["Mo, 04.05.2026", "31.02.2026", "none"]) == [DAY, None, None]
    assert each(spark, T.german_time, ["ab 18:30 Uhr", "118:300", "9:30 Uhr"]) == ["18:30", None, "9:30"]
    assert each(spark, lambda x: T.fenced(x, "text"), ["a </text> b"]) == ["<text>\na &lt;/text> b\n</text>"]
    assert each(spark, T.number_shown, [2.5, 3.5, None], "double") == ["2", "4", "?"]


def test_unit_count(spark):
    texts = ["Es entstehen 120 neue Wohnungen am Ring", "rund 1.200 Wohneinheiten", "2026 Wohnung", "1 Wohnungen, dann 14 geförderte Mietwohnungen", "keine", None]
    got = each(spark, T.unit_count, texts)
    assert [r["units"] for r in got] == [120, 1200, None, 14, None, None]
    assert got[0]["quote"] == texts[0] and got[4]["quote"] is None


def test_quote_of_a_number_whose_like_stands_before_it(spark):
    """The number of a plan and one out of range look the same as the one that counts."""
    far = "x" * 100
    texts = [f"Im Plan 3.1120 Wohnungen {far} dann 120 Wohnungen neu", f"1 Wohnungen und 9999 Wohnungen {far} 1 Wohnungen {far}\n\t12  Wohnungen {far}", f"ä{far}ö 7 Wohnungen {far}"]
    got = each(spark, T.unit_count, texts)
    for text, found, n, like in zip(texts, got, (120, 12, 7), ("120 Wohnungen neu", "12  Wohnungen", "7 Wohnungen"), strict=True):
        start, end = max(0, text.rindex(like) - 80), min(len(text), text.rindex(like) + len(like.removesuffix(" neu")) + 80)
        assert found["units"] == n
        assert found["quote"] == (("…" if start else "") + " ".join(text[start:end].split()) + ("…" if end < len(text) else ""))[:200]


def test_unit_count_takes_linear_time(spark):
    text = "Plan 3.1120 Wohnungen, 1 Wohnungen und 9999 Wohnungen. " * 18_000 + "Am Ende 77 Wohnungen."
    began = time.perf_counter()
    assert each(spark, T.unit_count, [text])[0]["units"] == 77
    assert len(text) > 900_000 and time.perf_counter() - began < 15


def test_phase(spark):
    texts = ["Der Baubeginn ist für 2028 geplant.", "Der Spatenstich war gestern.", "Baubeginn soll bald sein. Richtfest war am Montag", "Baubeginn 2031", "Die Baugenehmigung liegt vor", "RichtfestRichtfest", None]
    assert each(spark, lambda x: T.phase(x, 2026), texts) == [None, "BAUBEGINN", "BAUBEGINN", None, "BAUGENEHMIGUNG", "BAUBEGINN", None]


def test_clauses(spark):
    text = "wort" * 40 + ", davor " + "a" * 60 + "wort" + "b" * 60
    got = each(spark, lambda x: T.clauses(x, "wort"), [text, "kein", ""])
    want = []
    for i in [k for k in range(len(text)) if text.startswith("wort", k) and (k >= 160 or k % 4 == 0)]:
        before, after = text[max(0, i - 25) : i], text[i + 4 : i + 49]
        want.append(before[before.rfind(",") + 1 :] + "wort" + after.split(",")[0])
    assert got[0] == want and got[1] == got[2] == []


def test_recall_patterns(spark):
    known = spark.createDataFrame([(1, ["76"]), (2, ["Bahnstraße 5"]), (3, ["Am alten Ring"]), (4, ["xy"]), (5, [None, "Uferweg 12"]), (6, [])], "name int, terms array<string>")
    texts = [
        ("project", 1, "p", "Hier entstehen 76 Wohnungen"), ("find", 2, "f", "Bebauungsplan Nr. 76 wird ausgelegt"), ("find", 3, "f", "B-Plan 761"),
        ("find", 4, "f", "Die Hauptbahnstr. 5 wird neu"), ("find", 5, "f", "Bahnstraße 55"), ("find", 6, "f", "was am  ALTEN ring geschah"), ("project", 7, "p", "am alten Ring"),
        ("find", 8, "f", "ein xyz"), ("find", 9, "f", "Uferweg 12a"),
    ]
    got = recall.recall(known, spark.createDataFrame(texts, "kind string, id int, label string, text string"))
    assert rows(got, "name", "found", "kind", "id") == [(1, True, "find", 2), (2, True, "find", 4), (3, True, "project", 7), (4, True, "find", 8), (5, True, "find", 9), (6, False, None, None)]
    assert recall.report(got).splitlines()[0] == "5 of 6 found"
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("letters", [500_000, 12])
def test_recall_as_by_a_loop(spark, monkeypatch, letters):
    """Terms that hold each other, short ones, numbers and plans, in one automaton and in many."""
    monkeypatch.setattr(recall, "TERM_LETTERS", letters)
    rng = random.Random(4)
    words = ["ring", "am ring", "weg 1", "weg 12", "12", "1", "b-plan", "bplan nr. ", "bebauungsplanes nr . ", "alt", "a", "straße", "str.", "  ", "x12", "—"]
    terms = [[" ".join(rng.choices(words, k=rng.randint(1, 2))) for _ in range(rng.randint(0, 3))] for _ in range(40)] + [[None], ["12"], ["1"], ["a"], [""]]
    texts = [(rng.choice(["project", "find"]), i, rng.choice(["l", None]), rng.choice([None, "", *[" ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(9)]])) for i in range(120)]
    norm = lambda t: re.sub(r"\s+", " ", re.sub("[‐-―]", "-", re.sub(r"strasse|str\.", "str", t.lower().replace("ß", "ss")))).strip()

    def pattern(term):
        t = norm(term)
        return (D.PLAN_PATTERN if t.isdigit() else "") + re.escape(t) + (r"(?!\d)" if t[-1:].isdigit() else "")

    want = []
    for name, own in enumerate(terms):
        hits = [(kind != "project", i, n) for kind, i, _, text in texts if text is not None for n, t in enumerate(own) if t is not None and re.search(pattern(t), norm(text))]
        want.append((name, bool(hits), own[min(hits)[2]] if hits else None, min(hits)[1] if hits else None))
    known = spark.createDataFrame(list(enumerate(terms)), "name int, terms array<string>")
    got = recall.recall(known, spark.createDataFrame(texts, "kind string, id int, label string, text string").repartition(5))
    assert rows(got, "name", "found", "term", "id") == sorted(want, key=repr)


def test_time(spark):
    at = F.lit("2026-05-04 09:00:00").cast("timestamp")
    r = spark.range(1).select(
        TM.next_slot(at, 0, 9).alias("same"), TM.next_slot(at, 0, 10).alias("today"), TM.next_slot(at, 2, 8, 30).alias("later"), TM.days_ago(F.lit("2026-05-03 08:00:00").cast("timestamp"), at).alias("ago")
    ).first()
    assert [x.strftime("%d %H:%M") for x in r[:3]] == ["11 09:00", "04 10:00", "06 08:30"] and r["ago"] == "gestern"


# ---- predicates, badges, reports ----


def test_predicates(spark):
    df = spark.createDataFrame(
        [(1, "neu", 0, "EIGENTUM", 8, None, "radar", "s", "Stadt", None), (2, "FEHLER", 3, "EIGENTUM", None, False, None, "s", None, "Norderstadt"), (3, "FEHLER", 2, "UNKLAR", 12, True, "manuell", "s", "Ort", "x"), (4, "RELEVANT", 0, "EIGENTUM", 12, True, "radar", "hand", "Ort", "x")],
        "id int, status string, failures int, tenure string, units int, flag boolean, origin string, source string, municipality string, place string",
    )
    c, ids = F.col, lambda x: [r[0] for r in df.where(x).orderBy("id").select("id").collect()]
    assert ids(P.needs_analysis(c("status"), c("failures"))) == [1, 3]
    assert ids(P.small_ownership(c("tenure"), c("units"))) == [1]
    assert ids(P.is_public(c("flag"))) == [1, 3, 4]
    assert ids(P.unclear([c("units")], c("tenure"))) == [2, 3]
    assert ids(P.found_by_machine(c("source"), c("origin"), ["hand"])) == [1, 2]
    assert ids(P.of_municipality(c("municipality"), c("place"), "stadt")) == [1, 2]
    assert ids(P.within(F.to_date(F.lit("2026-05-04")), day("2026-05-04"), day("2026-05-05"))) == [1, 2, 3, 4]
    assert ids(P.relevant_meeting(F.lit("Ausschuss für Stadtentwicklung"), c("flag"))) == [1, 2]
    assert P.present(df, ["units", "none", "id"]).columns == ["units", "id"]


def test_review_reasons(spark):
    df = spark.createDataFrame([(1, "UNKLAR", 0.3, None, None), (2, None, None, 5, 0.9), (3, "MIETE", None, None, 0.4)], "id int, tenure string, subsidised_share double, units int, confidence double")
    got = {r["id"]: r["r"] for r in df.select("id", B.review_reasons(df).alias("r")).collect()}
    assert [len(got[k]) for k in (1, 2, 3)] == [3, 0, 2]
    assert got[1][0].startswith("Wohnform unklar: Geförderter Anteil bekannt (ca. 30%)") and "ab 6 Miet-/geförderten WE bzw. 12" in got[1][0]
    assert got[1][2].startswith("Die KI war sich unsicher (Konfidenz 0%)") and "Konfidenz 40%" in got[3][1]
    few = df.select("id")
    assert [len(r[0]) for r in few.select(B.review_reasons(few)).collect()] == [2, 2, 2]  # no column: unclear tenure, no count, but sure


def test_badges_and_frames(spark):
    df = spark.createDataFrame([(1, "s", "BAUANTRAG", 4, None), (2, "t", None, None, "Der Bauantrag kommt")], "project_id int, source_id string, stage string, units int, summary string")
    sources = spark.createDataFrame([("s", 2)], "source_id string, tier int")
    got = dashboard.project_frame(df.withColumn("status", F.lit("Neu")).withColumn("units_subsidised", F.lit(1)), sources, {"BAUANTRAG": "Antrag"})
    assert rows(got, "project_id", "tier", "lead", "stage_label", "units_shown") == [(1, "2", D.BADGE_APPLICATION, "Antrag", "4 WE"), (2, "?", D.BADGE_HINT, None, "WE offen")]
    figures, leads = dashboard.overview(df.withColumn("status", F.lit("Neu")).withColumn("units_subsidised", F.lit(1)), sources, {}, ["Neu"])
    assert tuple(figures.first()) == (2, 4, 2, 2, 2) and [r["project_id"] for r in leads.collect()] == [1, 2]
    assert each(spark, lambda x: B.subject(x, "Fund", "Funde"), [1, 3], "int") == ["1 Fund", "3 Funde"]
    assert each(spark, lambda x: B.provenance(x, ["u"], "demo:"), ["u", "demo:1", "v"]) == ["verified", "demo", ""]
    shown = B.dashed(spark.createDataFrame([("a", None, "")], "x string, y string, z string"), "z")
    assert shown.columns == ["x", "y"] and tuple(shown.first()) == ("a", "–")


def test_source_monitor(spark):
    t = lambda s: dt.datetime(2026, 5, s)
    df = spark.createDataFrame([("a", None, None, None), ("b", t(3), t(2), t(3)), ("c", t(3), t(3), t(2))], "name string, last_run timestamp, last_success timestamp, last_error timestamp")
    assert rows(R.source_monitor(df), "name", "state") == [("a", "never run"), ("b", "error"), ("c", "ok")]
    notice = R.last_run_notice(df, F.lit("2026-05-20").cast("timestamp")).first()
    assert notice["last_run"] == t(3) and notice["warn"]
    assert R.last_run_notice(df.where("false"), F.current_timestamp()).first()["warn"]


def test_orders(spark):
    projects = spark.createDataFrame([(1, "Neu", 5), (2, "Alt", 9), (3, "Neu", None), (4, "Neu", 5)], "id int, status string, updated_at int")
    assert [r["id"] for r in R.projects_by_change(projects).collect()] == [2, 1, 4, 3]
    assert [r["id"] for r in R.projects_by_change(projects, "Neu").collect()] == [1, 4, 3]
    log = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 0)], "project_id int, new_status string, changed_at int")
    assert [r["new_status"] for r in R.status_log(log, 1).collect()] == ["a", "b"]
    finds = spark.createDataFrame([(1, 2.0, 1), (2, 1.0, 1), (3, 2.0, 5), (4, None, 1)], "id int, distance_km double, updated_at int")
    assert [r["id"] for r in R.finds_by_distance(finds).collect()] == [4, 2, 3, 1]
    assert [r["name"] for r in R.sources_by_name(spark.createDataFrame([("2", "b"), ("1", "B"), ("3", "a")], "source_id string, name string")).collect()] == ["B", "a", "b"]
    places = spark.createDataFrame([("Nord", 54.0, 10.0), ("Mitte", 53.6, 10.0), ("Fern", 48.0, 10.0)], "name string, lat double, lon double")
    assert [r["name"] for r in C.by_distance(C.places_within(places, 53.5, 10.0, 100)).collect()] == ["Mitte", "Nord"]
    warned = R.distinct_warnings(spark.createDataFrame([("s", "x", 2), ("s", "y", 1), ("s", "x", 0)], "source string, text string, at int"), "source", "text", "at")
    assert warned.first()["warnings"] == ["x", "y"]


def test_documents_of_meetings_without_papers(spark):
    df = spark.createDataFrame([("m1", None, 1, "n"), ("m2", None, 2, None), ("m1", "p", 2, None), ("m1", "p", 1, "7")], "meeting string, paper string, position int, number string")
    got = R.documents_by_paper(df, "paper", "position", ["number"], meeting="meeting")
    assert [(m, p, len(d), n) for m, p, d, n in rows(got, "meeting", "paper", "documents", "number")] == [("m1", "p", 2, "7"), ("m1", None, 1, "n"), ("m2", None, 1, None)]


def test_long_excerpts_take_linear_time(spark):
    """Four thousand pages a row: with each page tested for each page this would take hours."""
    df = spark.range(5).select(F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda i: F.concat(F.lit("page "), i.cast("string"), F.when(i % 1000 == 7, F.lit(" Wohnung")).otherwise(F.lit("")))).alias("pages"))
    assert df.select(E.hit_pages(F.col("pages"), ["wohnung"])).first()[0] == [6, 7, 8, 1006, 1007, 1008, 2006, 2007, 2008, 3006, 3007, 3008]
    assert df.select(E.excerpt(F.col("pages"), ["wohnung"], most=40)).distinct().count() == 1


# ---- configuration ----


def test_config(spark):
    text = "- {id: b, name: B, system: oparl, tier: 2}\n- {id: a, name: A, system: rss, committee_patterns: [x]}\n- {id: c, name: C, system: rss, enabled: false}"
    found = config.sources(text)
    assert [s.id for s in found] == ["a", "b"] and found[0].committee_patterns == ("x",)
    for bad in ("- {id: a, name: A, system: rss, colour: red}", "- {id: a, name: A, system: rss, tier: 9}", "[{id: a, name: A, system: rss}, {id: a, name: B, system: rss}]"):
        with pytest.raises(ValueError):
            config.sources(bad)
    assert rows(config.table(spark, [{"name": "x"}], "name string, km double")) == [("x", None)]
    with pytest.raises(ValueError):
        config.table(spark, [{"nme": "x"}], "name string")
    df = spark.createDataFrame([(1, None), (None, 2), (None, None)], "source_weeks int, region_weeks int")
    assert [r[0] for r in df.select(config.effective("weeks", 6)).collect()] == [1, 2, 6]


# ---- state ----


def test_meeting_takeover(spark):
    schema = "source_id string, external_id string, committee string, date date, time string, place string, url string, cancelled boolean"
    table = spark.createDataFrame([("s", "made", "Rat", DAY, None, None, None, False), ("s", "other", "Bau", DAY, None, None, None, False)], schema)
    batch = spark.createDataFrame([("s", "12", "Rat", DAY, "18:00", None, "u", False, 0)], schema + ", seq int")
    got = upserts.upsert_meetings(table, batch)
    assert rows(got, "external_id", "committee", "url", "is_new") == [("12", "Rat", "u", False), ("other", "Bau", None, False)]
    assert rows(upserts.upsert_meetings(got.drop("is_new"), batch), "external_id", "is_new") == [("12", False), ("other", False)]


def test_papers_known_and_analysed(spark):
    schema = "source_id string, external_id string, content_hash string, status string, failures int, analysed_at int, last_batch int"
    table = spark.createDataFrame([("s", "1", "h", "RELEVANT", 0, 1, None), ("s", "2", "h", "FEHLER", 2, 1, None), ("s", "3", "h", "FEHLER", 3, 1, None)], schema)
    batch = spark.createDataFrame([("s", "1", "h"), ("s", "2", "h"), ("s", "3", "h"), ("s", "1", "new")], "source_id string, external_id string, content_hash string")
    assert rows(upserts.dedup_papers(table, batch), "external_id", "content_hash", "known", "needs_analysis") == [("1", "h", True, False), ("1", "new", False, True), ("2", "h", True, True), ("3", "h", True, False)]
    result = spark.createDataFrame([("s", "2", "h", "FEHLER", 9)], "source_id string, external_id string, content_hash string, status string, analysed_at int")
    once = upserts.analysis_results(table, result, 5)
    assert rows(once, "external_id", "failures", "analysed_at") == [("1", 0, 1), ("2", 3, 9), ("3", 3, 1)]
    assert rows(upserts.analysis_results(once, result, 5)) == rows(once)


def test_projects_and_finds(spark):
    schema = "source_id string, project_key string, source_url string, origin string, seq int, " + ", ".join(f"{c} string" for c in upserts.EXTRACTED)
    row = lambda name, units, seq: ("s", "k", "u", "radar", seq, *[{"name": name, "units": units}.get(c) for c in upserts.EXTRACTED])
    first = upserts.upsert_projects(None, spark.createDataFrame([row("A", "5", 0)], schema))
    kept = upserts.set_values(first, spark.createDataFrame([("k", "mine", 1)], "project_key string, notes string, at int"), "project_key", "notes", "at").drop("is_new")
    got = upserts.upsert_projects(kept, spark.createDataFrame([row("B", None, 0)], schema)).first()
    assert (got["name"], got["units"], got["status"], got["notes"], got["is_new"]) == ("B", None, "Neu", "mine", False)
    schema = "url string, title string, excerpt string, phase string, units int, quote string, published date, tenure string, domain string, place string, state string, distance_km double, query string, seq int"
    find = lambda phase, units, quote, tenure, seq: ("u", f"t{seq}", None, phase, units, quote, None, tenure, "d", "p", None, 1.0, "q", seq)
    table = upserts.upsert_finds(None, spark.createDataFrame([find("BAUBEGINN", 8, "q8", "MIETE", 0)], schema)).drop("is_new")
    got = upserts.upsert_finds(table, spark.createDataFrame([find("BAUGENEHMIGUNG", None, "none", "UNKLAR", 1)], schema)).first()
    assert (got["title"], got["phase"], got["units"], got["quote"], got["tenure"]) == ("t1", "BAUBEGINN", 8, "q8", "MIETE")


def test_setters_and_status_changes(spark):
    projects = spark.createDataFrame([(1, "Neu", "radar"), (2, "Neu", None)], "project_id long, status string, origin string")
    wanted = spark.createDataFrame([(1, "radar", 1), (1, "manuell", 2), (9, "radar", 1)], "project_id long, origin string, at int")
    assert rows(upserts.set_values(projects, wanted, "project_id", "origin", "at", D.ORIGINS), "project_id", "origin") == [(1, "manuell"), (2, None)]
    with pytest.raises(PySparkException):
        upserts.set_values(projects, wanted.withColumn("origin", F.lit("post")), "project_id", "origin", "at", D.ORIGINS).collect()
    log = upserts.status_changes(projects, spark.createDataFrame([(1, "Alt", 7)], "project_id long, status string, at int"), "at")
    assert rows(log) == [(1, "Neu", "Alt", 7)]
    with pytest.raises(PySparkException):
        upserts.status_changes(projects, spark.createDataFrame([(5, "Alt", 7)], "project_id long, status string, at int"), "at").collect()


def test_windows_and_budgets(spark):
    df = spark.createDataFrame([(DAY, DAY, DAY), (None, DAY - dt.timedelta(1), DAY), (DAY, DAY - dt.timedelta(2), DAY)], "covered date, end date, today date")
    assert [r[0] for r in df.select(window.may_move_mark(F.col("covered"), F.col("end"), F.col("today"))).collect()] == [True, False, False]
    calls = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), (None, 6)], "source string, n int")
    went = lambda *x, **y: [r["n"] for r in budget.admitted(calls, "source", ["n"], *x, **y).where("admitted").orderBy("n").collect()]
    assert went(2, 10) == [1, 2, 4, 5, 6] and went(2, 3) == [1, 2, 4] and went(2, 10, day_rest=1) == [1] and went(2, 0) == [] and went(0, 5) == []
    tries = [("k", t, i) for i, t in enumerate([0, 10, 20, 30, 500, 2000, 2010])]
    at = spark.createDataFrame(tries, "key string, t long, i int").withColumn("t", F.timestamp_seconds("t"))
    got = budget.locked_out(at, "key", "t", ["i"], most=3, seconds=900, lock_seconds=900)
    assert rows(got.drop("key")) == [(0, 1, False, None), (1, 2, False, None), (2, 3, True, 920), (3, 1, False, 920), (4, 2, False, 920), (5, 1, False, None), (6, 2, False, None)]


def test_snapshots_and_streams(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, str(tmp_path / "store"))
    assert store.read() is None and store.versions() == []
    schema = "k int, v string, at int"
    rules = {"v": "overwrite", "at": "fill"}

    def land(name, data):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        ingest.merge_stream(spark, str(tmp_path / "in" / "*"), StructType.fromDDL(schema), store, str(tmp_path / "cp"), ["k"], rules, ["at"]).awaitTermination(120)
        return rows(store.read(), "k", "v", "at")

    land("one", [(1, "a", 1), (2, "b", 1), (1, "c", 2)])
    assert run() == [(1, "c", 2), (2, "b", 1)]
    land("two", [(2, None, 3)])
    assert run() == run() == [(1, "c", 2), (2, None, 3)] and store.versions() == [1, 2]
    again = spark.createDataFrame([(2, None, 3, 0)], schema + ", seq int")
    assert rows(store.merge(again, ["k"], rules), "k", "v", "at", "is_new") == [(1, "c", 2, False), (2, None, 3, False)]
    events = spark.createDataFrame([("x", dt.datetime(2026, 5, 4, 9, m)) for m in (0, 59)] + [("x", dt.datetime(2026, 5, 4, 10, 0))], "kind string, at timestamp")
    assert [r["n"] for r in ingest.windowed_counts(events, "at", "kind").orderBy("start").collect()] == [2, 1]


# ---- plans ----

EXTRACT = "struct<" + ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in papers.EXTRACTION.split(", ")) + ">"


def paper_rows(spark):
    home = "Hier werden 40 Wohnungen gebaut, Mietwohnungen im Neubau."
    data = [("s", "1", "h1", [home], 1), ("s", "2", "h2", [], 2), ("s", "3", "h3", ["", " "], 3), ("s", "4", "h4", ["nur Straßen und Brücken in der Stadt"], 4), ("s", "5", "h5", [home], 5), ("s", "6", "h6", ["8 Wohnungen, alles Eigentumswohnung"], 0), ("s", "7", "h7", [home], 7)]
    return spark.createDataFrame(data, "source_id string, paper_id string, content_hash string, pages array<string>, seq int")


def test_analysis_of_papers(spark):
    cached = F.from_json(F.lit('{"units": 3, "tenure": "MIETE", "stage": "UNKLAR", "confidence": 0.9}'), EXTRACT)
    cache = spark.createDataFrame([("h7",)], "content_hash string").withColumn("extraction", cached)
    got = papers.analysed(paper_rows(spark), D.HOUSING_WORDS, papers.rule_triage, papers.rule_extract, cache, per_source=2)
    assert rows(got, "paper_id", "status") == [("1", "RELEVANT"), ("2", "NICHT_RELEVANT"), ("3", "OCR_NOETIG"), ("4", "NICHT_RELEVANT"), ("5", "BUDGET_ERSCHOEPFT"), ("6", "NICHT_RELEVANT"), ("7", "RELEVANT")]
    out = {r["paper_id"]: r for r in got.collect()}
    assert out["1"]["extraction"]["units"] == 40 and out["7"]["extraction"]["units"] == 3 and out["1"]["new_for_cache"]["units"] == 40 and out["7"]["new_for_cache"] is None


def test_one_repair(spark):
    wrong = lambda x: papers.rule_extract(x).withField("confidence", F.lit(7.0))
    one = paper_rows(spark).where("paper_id = '1'")
    run = lambda **kw: papers.analysed(one, D.HOUSING_WORDS, papers.rule_triage, wrong, **kw).first()["status"]
    assert run() == "FEHLER"
    assert run(repair=lambda _, x: x.withField("confidence", F.lit(0.7))) == "RELEVANT"
    assert run(repair=lambda _, x: x) == "FEHLER"


def test_run_of_a_source(spark):
    meetings = spark.createDataFrame([("s", "m1", "Stadtplanung", False), ("s", "m2", "Stadtplanung", True), ("s", "m3", "Kultur", False)], "source_id string, external_id string, committee string, cancelled boolean")
    docs = spark.createDataFrame([("s", "m1", "p1", "d1", "a"), ("s", "m1", "p2", "d2", "b"), ("s", "m1", None, "d3", "c"), ("s", "m2", "p3", "d4", "d"), ("s", "m3", "p4", "d5", "e")], "source_id string, meeting_id string, paper_id string, external_id string, sha256 string")
    pages = spark.createDataFrame([("s", "d1", 2, "mit 30 Wohnungen zur Miete"), ("s", "d1", 1, "Deckblatt der Vorlage, Seite eins"), ("s", "d2", 1, "30 Wohnungen"), ("s", "d3", 1, "Einladung zur Sitzung im Rathaus")], "source_id string, external_id string, page int, text string")
    old = papers.paper_hashes(docs.where("paper_id = 'p2'")).withColumnRenamed("paper_id", "external_id").withColumn("status", F.lit("RELEVANT")).withColumn("failures", F.lit(0))
    got = runs.collected(meetings, docs, pages, old, D.COMMITTEE_PATTERNS, D.HOUSING_WORDS, papers.rule_triage, papers.rule_extract)
    assert rows(got, "external_id", "status") == [("meeting m1", "NICHT_RELEVANT"), ("p1", "RELEVANT")]
    assert {r["external_id"]: r for r in got.collect()}["p1"]["extraction"]["units"] == 30


def test_web_run(spark):
    places = spark.createDataFrame([("Nord", 3.0), ("Süd", 1.0)], "name string, distance_km double")

    def search(jobs):
        text = F.when(F.col("place") == "Nord", F.lit("In Nord war der Spatenstich für 20 Wohnungen")).otherwise(F.lit("Fest am See"))
        return jobs.select(F.concat(F.lit("https://www.x.de/"), F.col("place"), F.lit("/#a")).alias("url"), F.lit("T").alias("title"), text.alias("content"), "place", F.lit("HH").alias("state"), "distance_km", "query", F.lit(0).alias("seq"))

    finds, rejected = runs.web_run(places, {"BAUBEGINN": ["{ort} Baubeginn"]}, search, None, 2026)
    assert rows(finds, "url", "domain", "phase", "units", "status", "is_new") == [("https://www.x.de/Nord", "x.de", "BAUBEGINN", 20, "Neu", True)]
    assert rows(rejected, "reject_reason") == [("Ort Süd nicht genannt",)]
    again, _ = runs.web_run(places, {"BAUBEGINN": ["{ort} Baubeginn"]}, search, finds.drop("is_new"), 2026)
    assert rows(again, "url", "is_new") == [("https://www.x.de/Nord", False)]


def test_errors_stay_with_their_source(spark):
    def run(source):
        if source == "b":
            raise ValueError("layout changed")
        return spark.range(3).where(F.raise_error(F.lit("row")).isNull() if source == "c" else F.lit(True)).count()

    assert rows(runs.each_source(spark, ["a", "b", "c", "d"], run), "source_id", "rows") == [("a", 3), ("b", None), ("c", None), ("d", 3)]
    with pytest.raises(ZeroDivisionError):
        runs.each_source(spark, ["a"], lambda _: 1 // 0)


def test_press_is_judged_by_the_nearest_place(spark):
    places = spark.createDataFrame([("Bad Nord", 9.0), ("Nord", 4.0), ("Süd", 1.0)], "name string, distance_km double")
    articles = spark.createDataFrame([(1, "https://x.de/1", "Neubau", "Neubau in Bad Nord: Richtfest für 30 Wohnungen"), (2, "https://x.de/2", "Fest", "am See"), (3, "https://x.de/3", "Südlich", "Wohnungen in Nordheim")], "id int, url string, title string, content string")
    got = C.judged_press(articles, places, "id", 2026)
    assert rows(got, "id", "place", "distance_km", "reject_reason", "units") == [(1, "Nord", 4.0, None, 30), (2, None, None, "kein Ort im Umkreis genannt", None), (3, None, None, "kein Ort im Umkreis genannt", None)]
    assert C.first_wins(articles.withColumn("k", F.lit(1)), ["k"], ["id"]).first()["id"] == 1


def test_papers_at_hand_and_gold(spark):
    known = spark.createDataFrame([("A", "26/1", None), ("B", None, "P9"), ("C", "26/2", "P9"), ("D", "none", None)], "name string, paper string, press string")
    papers_ = spark.createDataFrame([("p1", "26/1", "m1"), ("p2", "26/1", "m2"), ("p3", "P9", "m2"), ("p4", "26/2", "m1")], "paper_id string, number string, meeting_id string")
    meetings = spark.createDataFrame([("m1", DAY, "Bau"), ("m2", DAY - dt.timedelta(9), "Rat")], "meeting_id string, date date, committee string")
    docs = spark.createDataFrame([("p1", "file", "vorlage"), ("p2", "file", "vorlage"), ("p3", None, "presseartikel"), ("p4", None, "vorlage")], "paper_id string, path string, kind string")
    got = recall.papers_at_hand(known, papers_, meetings, docs)
    assert rows(got, "name", "kind", "date", "committee") == [("A", "Vorlage", DAY - dt.timedelta(9), "Rat"), ("B", "Presse", DAY - dt.timedelta(9), "Rat"), ("C", "Presse", DAY - dt.timedelta(9), "Rat")]
    expected = spark.createDataFrame([(1, 10, "MIETE"), (2, None, "UNKLAR")], "id int, units int, tenure string")
    compared = recall.compared(expected, spark.createDataFrame([(1, 11, "EIGENTUM")], "id int, units int, tenure string"), "id", ["units", "tenure"], {"units": 1.0})
    assert rows(compared, "id", "field", "ok") == [(1, "tenure", False), (1, "units", True), (2, "tenure", False)]


def test_found_texts(spark):
    projects = spark.createDataFrame([(1, "q", None, "Ort", None, "", "Ring", "5", None, "S"), (2, "hand", None, "Ort", None, "N", None, None, None, None)], "id int, source_id string, origin string, municipality string, place string, name string, street string, number string, parcel string, summary string")
    finds = spark.createDataFrame([(7, "Ort", "T", None), (8, "fern", "T", "E")], "id int, place string, title string, excerpt string")
    assert rows(recall.found_texts(projects, finds, "ort", ["hand"]), "kind", "id", "label", "text") == [("find", 7, "T", "T | "), ("project", 1, "Ring 5", "Ring 5 | S")]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("ä – b", 1, None)], "a string, n int, hidden string")
    exports.write_csv(df, str(tmp_path / "csv"), ["a", "n", "gone"])
    text = next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8")
    assert text.splitlines() == ["﻿a,n", "ä – b,1"]
    assert tuple(exports.printable(df, ["a", "n"]).first()) == ("ä ? b", "1")
    assert exports.notice(df.where("false"), ["a"], "New") is None
    assert exports.notice(df, ["a", "hidden"], "New") == "New: 1\nä – b | –"

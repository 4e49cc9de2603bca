"""How much of a known list was found, and for which of the missing the papers are at hand."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import text as T
from ..operators.filters import found_by_machine, of_municipality


def found_texts(projects: DataFrame, finds: DataFrame, municipality: str, manual_sources: list[str]) -> DataFrame:
    """kind, id, label, text of everything found by the machine for a municipality."""
    address = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("street", "number", "parcel")])
    text = F.concat_ws(" | ", *[F.nullif(c, F.lit("")) for c in (F.col("name"), address, F.col("summary"))])
    own = projects.where(found_by_machine(F.col("source_id"), F.col("origin"), manual_sources) & of_municipality(F.col("municipality"), F.col("place"), municipality))
    web = finds.where(of_municipality(F.lit(""), F.col("place"), municipality))
    return own.select(F.lit("project").alias("kind"), "id", F.coalesce(F.nullif("name", F.lit("")), F.nullif(address, F.lit("")), F.lit("(ohne Bezeichnung)")).alias("label"), text.alias("text")).unionByName(
        web.select(F.lit("find").alias("kind"), "id", F.col("title").alias("label"), F.concat_ws(" | ", "title", F.coalesce("excerpt", F.lit(""))).alias("text"))
    )


#: Letters of terms that one automaton holds. A longer list is searched in as many passes.
TERM_LETTERS = 500_000
#: What stands before a plan's number is shorter, as normal spaces are single.
PLAN_LETTERS = 60


def blocks_of(terms: DataFrame) -> list[list[tuple[str, str]]]:
    """The different (plain, rule) of terms in blocks of at most TERM_LETTERS letters, or of one term. Only terms reach the driver, never texts."""
    out: list[list[tuple[str, str]]] = [[]]
    held = 0
    for r in terms.select("plain", "rule").distinct().orderBy("plain", "rule").toLocalIterator():
        if out[-1] and held + len(r["plain"]) > TERM_LETTERS:
            out.append([])
            held = 0
        out[-1].append((r["plain"], r["rule"]))
        held += len(r["plain"])
    return out


def first_hits(texts: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """plain, rank, id, kind, label: of each term the first text of a partition that it is found in (texts: rank, id, kind, label, norm).

    An automaton of all terms reads each text once; where a term stands, what its rule asks of its surroundings is looked at there.
    """
    kinds = dict(texts.dtypes)
    held = texts.sparkSession.sparkContext.broadcast(terms)
    number, plan_before = re.compile(r"(?![0-9])"), re.compile(D.PLAN_PATTERN + r"\Z")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for plain, rule in held.value:
            if plain:
                machine.add_word(plain, (plain, rule))
        machine.make_automaton()
        empty = any(not plain for plain, _ in held.value)
        best: dict[str, tuple] = {}

        def meet(plain: str, row: tuple) -> None:
            order = tuple((x is not None and x == x, x) for x in row)
            if plain not in best or order < best[plain][0]:
                best[plain] = (order, row)

        for pdf in frames:
            for *row, norm in pdf.itertuples(index=False, name=None):
                if norm is None:
                    continue
                if empty:
                    meet("", tuple(row))
                found = set()
                for end, (plain, rule) in machine.iter(norm) if len(machine) else ():
                    if plain in found or (rule != "any" and not number.match(norm, end + 1)):
                        continue
                    begin = end + 1 - len(plain)
                    if rule != "plan" or plan_before.search(norm, max(0, begin - PLAN_LETTERS), begin):
                        found.add(plain)
                        meet(plain, tuple(row))
        yield pd.DataFrame([(plain, *row) for plain, (_, row) in best.items()], columns=["plain", "rank", "id", "kind", "label"]).astype({"rank": "int64"})

    rows = texts.select("rank", "id", "kind", "label", "norm")
    return rows.mapInPandas(run, f"plain string, rank long, id {kinds['id']}, kind string, label string")


def recall(known: DataFrame, texts: DataFrame) -> DataFrame:
    """known (name, terms array) with found, term, kind, id: the first text, projects before finds, that a term's pattern matches.

    All terms are looked for in one pass over the texts (see first_hits), and of each term only the first hit of a partition is shuffled. Terms
    whose letters exceed TERM_LETTERS take further passes, so a task's memory doesn't grow with the list. What a term asks for is
    what recall_pattern says: digits alone are a plan's number, and after a last digit none may follow.
    """
    terms = known.select("name", F.posexplode("terms").alias("n", "term")).where("term is not null").withColumn("plain", T.recall_text(F.col("term")))
    rule = F.when(F.rlike("plain", F.lit(r"\A[0-9]+\z")), "plan").when(F.rlike("plain", F.lit(r"[0-9]\z")), "number").otherwise("any")
    terms = terms.withColumn("rule", rule)
    rows = texts.select(F.when(F.col("kind") == "project", 0).otherwise(1).cast("long").alias("rank"), "id", "kind", "label", T.recall_text(F.col("text")).alias("norm"))
    hits = reduce(DataFrame.unionByName, [first_hits(rows, block) for block in blocks_of(terms)])
    first = (
        terms.join(hits, "plain")
        .groupBy("name")
        .agg(F.min(F.struct("rank", "id", "n", "kind", "label", "term")).alias("hit"))
        .select(F.col("name").alias("__name"), "hit")
    )
    return known.join(first, F.col("name").eqNullSafe(F.col("__name")), "left").select("name", F.col("hit").isNotNull().alias("found"), F.col("hit.term").alias("term"), F.col("hit.kind").alias("kind"), F.col("hit.id").alias("id"), F.col("hit.label").alias("label"))


def papers_at_hand(known: DataFrame, papers: DataFrame, meetings: DataFrame, documents: DataFrame) -> DataFrame:
    """known (name, paper, press) with the earliest meeting whose paper of that number has a file or is a press article; papers before press."""
    with_file = documents.where(F.col("path").isNotNull() | (F.col("kind") == "presseartikel")).select("paper_id").distinct()
    first = (
        papers.join(with_file, "paper_id", "left_semi")
        .join(meetings, "meeting_id")
        .groupBy("number")
        .agg(F.min(F.struct("date", "committee")).alias("at"))
    )
    wanted = known.select("name", F.posexplode(F.array("paper", "press")).alias("n", "number")).where(F.col("number").isNotNull())
    return wanted.join(first, "number").groupBy("name").agg(F.min(F.struct("n", "number", "at")).alias("x")).select("name", F.when(F.col("x.n") == 0, F.lit("Vorlage")).otherwise(F.lit("Presse")).alias("kind"), "x.number", "x.at.date", "x.at.committee")


def recall_counts(result: DataFrame) -> DataFrame:
    return result.agg(F.count_if("found").alias("found"), F.count("*").alias("known"))


def report(result: DataFrame) -> str:
    """The result of a known list, which is small, as text."""
    rows = result.orderBy("name").collect()
    lines = [f"{'+' if r['found'] else '-'} {r['name']}" + (f": {r['label']} ({r['term']})" if r["found"] else "") for r in rows]
    return "\n".join([f"{sum(r['found'] for r in rows)} of {len(rows)} found", *lines])


def compared(expected: DataFrame, got: DataFrame, key: str, fields: list[str], tolerance: dict[str, float]) -> DataFrame:
    """key, field, expected, got, ok: a row for each field that is expected; numbers may differ by their tolerance."""
    def ok(f: str) -> Column:
        a, b = F.col(f"e.{f}"), F.col(f"g.{f}")
        return F.coalesce(F.abs(a - b) <= tolerance[f], F.lit(False)) if f in tolerance else a.eqNullSafe(b)

    rows = expected.alias("e").join(got.alias("g"), key, "left")
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"e.{f}").cast("string").alias("expected"), F.col(f"g.{f}").cast("string").alias("got"), ok(f).alias("ok")) for f in fields]
    return rows.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.*").where("expected is not null")


def gold_hits(cells: DataFrame, key: str) -> DataFrame:
    """One row of what compared() gives: hits (cases of which every expected field is right), total (cases), and the share of fields that are right."""
    cases = cells.groupBy(key).agg(F.min("ok").alias("__right"), F.count("*").alias("__n"), F.count_if("ok").alias("__ok"))
    return cases.agg(F.count_if("__right").alias("hits"), F.count("*").alias("total"), (F.sum("__ok") / F.sum("__n")).alias("fields_right"))

"""The corpus pipeline, stage by stage, against brute force over each stage's own input."""

from collections import Counter

import corpus_pipeline
import pytest
from planwatch.llm import toxicity
from planwatch.llm.queries import LINE_RATIO, LINE_SURE, fold
from pyspark.sql import functions as F
from test_operators import EXTRA, jaccard_groups, water, wilson
from test_operators import rows as odd_rows

from conftest import SF_DIR


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The input and each stage's rows; the small tables' documents."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_toxic_documents_go(spark, steps):
    model = toxicity.train(steps[0], spark.read.parquet(f"{SF_DIR}/labels.parquet").where(fold() != 0), "doc_id", "text", "toxic")
    want = {i for i, r in rows(steps[0]).items() if model.score(r["text"]) < 0.5}
    assert set(rows(steps[1])) == want and 0 < steps[0].count() - len(want)


def test_boilerplate_goes(steps):
    before, after = rows(steps[1]), rows(steps[2])
    pages, on = Counter(r["source"] for r in before.values()), Counter()
    for r in before.values():
        on.update((r["source"], x) for x in {x.strip(" ") for x in (r["text"] or "").split("\n")} if x)
    drop = {k for k, n in on.items() if n > 1 and wilson(n, pages[k[0]], LINE_SURE) > LINE_RATIO}
    for i, r in before.items():
        kept = "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" ")) not in drop)
        assert after[i]["text"] == kept and (kept == r["text"] or after[i]["n_chars"] == len(kept))


def test_one_of_each_group_stays(steps):
    before = sorted((i, r["text"]) for i, r in rows(steps[2]).items())
    groups = jaccard_groups(before)
    want = {before[g][0] for g in groups}
    assert set(rows(steps[3])) == want


def test_mixture_meets_targets(steps):
    words = lambda t: len((t or "").split())
    per, taken, copies = Counter(), Counter(), Counter()
    for r in steps[3].collect():
        per[r["source"]] += words(r["text"])
    for r in steps[4].collect():
        taken[r["source"]] += words(r["text"])
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 2
    for s, goal in water(per).items():
        assert abs(taken[s] - goal) <= 0.02 * goal + 20


def test_packing_holds_all(steps):
    docs = Counter(r["doc_id"] for r in steps[4].select("doc_id").collect())
    pieces, whole = Counter(), {}
    for r in steps[5].collect():
        pieces[r["doc_id"]] += r["length"]
        whole[r["doc_id"]] = r["doc_tokens"]
    assert pieces == {i: n * whole[i] for i, n in docs.items()}


def test_run_gives_the_last_stage(spark, steps):
    assert corpus_pipeline.run(spark, SF_DIR).agg({"length": "sum"}).first() == steps[5].agg({"length": "sum"}).first()


# ---- nulls, empties, repeated rows and ids, long texts, clashing names ----

#: Columns whose names the stages use inside, beside those of single operators.
MORE = "score double, lines_lost long, gone long, doc string, node long, first boolean, of string, source_size long, start long, length long"
LINE = "a line that stands on many pages"


@pytest.fixture(scope="module")
def odd(spark):
    data = [*odd_rows(), *((200 + i, f"page{i} of its own\n {LINE} \nthe end of {i}" if i else LINE, "b") for i in range(12)), (4, None, "b"), (300, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    df = df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", F.when(F.col("doc_id") % 2 == 0, F.length("text")).alias("n_chars"))
    for c in f"{EXTRA}, {MORE}".split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df.checkpoint()


def listed(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def through(name, spark, docs):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF_DIR)
    assert name == "packing" or out.columns == docs.columns
    return out


def test_odd_rows_through_toxicity(spark, odd):
    got = listed(through("toxicity", spark, odd), "doc_id", "text", "source")
    assert not got - listed(odd, "doc_id", "text", "source")
    fate = {}
    for (_, text, _), n in listed(odd, "doc_id", "text", "source").items():
        fate.setdefault(text or "", Counter())[True] += n
    for (_, text, _), n in got.items():
        fate[text or ""][False] += n
    assert all(c[False] in (0, c[True]) for c in fate.values())  # equal texts, nulls and empties share their fate


def test_odd_rows_through_line_dedup(spark, odd):
    want = Counter()
    for (i, text, source, n), times in listed(odd, "doc_id", "text", "source", "n_chars").items():
        if source == "b" and LINE in (text or ""):
            text = "\n".join(x for x in text.split("\n") if x.strip() != LINE)
            n = len(text)
        want[i, text, source, n] += times
    assert listed(through("line_dedup", spark, odd), "doc_id", "text", "source", "n_chars") == want


def test_odd_rows_through_near_dedup(spark, odd):
    data = sorted(((r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None), key=repr)
    root = jaccard_groups(data)
    for k, (i, _) in enumerate(data):  # rows of one id belong together
        for j in range(k):
            if data[j][0] == i and root[j] != root[k]:
                root = [root[j] if r == root[k] else r for r in root]
    least = {}
    for (i, _), r in zip(data, root, strict=True):
        least[r] = min(i, least.get(r, i))
    gone = {i for (i, _), r in zip(data, root, strict=True) if i != least[r]}
    want = Counter({k: n for k, n in listed(odd, "doc_id", "text").items() if k[0] not in gone})
    assert gone and listed(through("simhash_near_dedup", spark, odd), "doc_id", "text") == want


def test_odd_rows_through_mixing(spark, odd):
    got, have = listed(through("mixing", spark, odd), "doc_id", "text", "source"), listed(odd, "doc_id", "text", "source")
    assert all(text and text.split() and n <= 2 * have[i, text, source] for (i, text, source), n in got.items())
    assert {source for _, _, source in got} == {None, "a", "b", "c"}


def test_odd_rows_through_packing(spark, odd):
    pieces = Counter()
    for r in through("packing", spark, odd).collect():
        pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert sum(n // m for (_, m), n in pieces.items()) == odd.count() and not any(n % m for (_, m), n in pieces.items())


@pytest.mark.parametrize("name", dict(corpus_pipeline.STAGES))
def test_no_rows_and_nulls_alone(spark, odd, name):
    assert through(name, spark, odd.where("false")).count() == 0
    nulls = spark.createDataFrame([(None,) * len(odd.columns)] * 3, odd.schema)
    assert through(name, spark, nulls).count() == (0 if name == "mixing" else 3)

"""op12 against scores of all documents for all queries."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from planwatch.llm import ranked
from planwatch.llm.queries import OP12_SQL, op12_ranked_search
from pyspark.sql import functions as F

from conftest import SF_DIR

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, queries, k=50):
    """(item, rank, score) and the sorted (item, doc, score) of what may stand, ids tied at the end being interchangeable."""
    bags = [Counter(TERMS.findall((t or "").translate(UPPER))) for _, t in docs]
    n_docs, total = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in sorted(set(queries), key=repr):
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(TERMS.findall((text or "").translate(UPPER))) if df[t]}
        scored = []
        for (doc, _), bag in zip(docs, bags, strict=True):
            n = sum(bag.values())
            m = 100 - 50 + (50 * n * n_docs) // total if total else 0
            score = sum(w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t, w in weights.items() if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus(n=700):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)] + ["Straße", "ÉTÉ", "漢字", "a_b", "X9"]
    p = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, int(s), p=p / p.sum())) for s in rng.integers(1, 60, n)]
    texts += [None, "", " \n_!", "w3 " * 70_000, "W59 w59-w58", texts[5], texts[5], "rare1 rare2", "rare1"]
    ids = [*range(0, 3 * n, 3), 1, 2, 4, 5, 7, 0, 0, None, None]
    return list(zip(ids, texts, strict=True))


QUERIES = [(1, "w1 w2 W3 w1"), (2, "w59 w58 w57 w40 straße STRASSE été ÉTÉ"), (3, None), (4, ""), (5, "nowhere"), (6, "a_b 漢字 x9"), (6, "a_b 漢字 x9"), (6, "w7"), (None, "w9 w10"), (7, "rare1 rare2 w30"), (8, " ".join(f"w{k}" for k in range(60)))]


def extra(df):
    for name in ("shard", "term", "rank", "score", "query", "block", "id", "word", "df"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize("how", [{}, {"shard_chars": 6000}])
@pytest.mark.parametrize("k", [50, 3])
def test_search_as_brute_force(spark, how, k):
    docs = corpus()
    df = extra(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    asked = extra(spark.createDataFrame(QUERIES, "item_id long, text string"))
    got = ranked.search(ranked.index(df, **how), asked, k=k).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, QUERIES, k)


def test_queries_in_several_turns(spark, monkeypatch):
    monkeypatch.setattr(ranked, "QUERIES", 2)
    docs = corpus(200)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ranked.search(ranked.index(df), spark.createDataFrame(QUERIES, "item_id long, text string")).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, QUERIES)


def shard_of(docs):
    """The documents' numbers and each term's postings list, by way of the index's rows."""
    shard = ranked.Shard()
    for doc, text in docs:
        shard.add(doc, text or "")
    n_docs, n_terms = sum(n > 0 for n in shard.sizes), sum(shard.sizes)
    rows = [r for frame in shard.rows(0, n_docs, n_terms) for r in frame.itertuples(index=False)]
    ids, m = np.frombuffer(rows[0].heads, np.int64).reshape(2, -1)
    return ids, m, {r.term: ranked.Postings(r.heads, r.postings, m) for r in rows[1:]}


def test_blocks_hold_all_postings_and_maxima_bound_them():
    docs = [(i, f"all {'x ' * (1 + i % 3) if i % 5 else ''}{'y ' * 300 if i % 40_000 == 7 else ''}{'far ' if i in (0, 69_999) else ''}") for i in range(70_000)]
    ids, m, lists = shard_of(docs)
    assert ids.tolist() == list(range(70_000))
    for term, p in lists.items():
        want = [i for i, t in docs if term in t.split()]
        got = [p.block(k) for k in range(len(p.last))]
        assert np.concatenate([d for d, _ in got]).tolist() == want
        for k, (d, x) in enumerate(got):
            assert (d[0], d[-1], x.max()) == (p.first[k], p.last[k], p.top[k]) and len(d) <= ranked.BLOCK
        tf = [docs[i][1].split().count(term) for i in want]
        assert np.concatenate([x for _, x in got]).tolist() == [10**9 * t // (1000 * t + 20 * int(m[i])) for t, i in zip(tf, want, strict=True)]


def test_blocks_below_the_threshold_are_never_decompressed():
    rng = np.random.default_rng(0)
    docs = [(i, "common " * int(rng.integers(1, 3)) + "filler " * int(rng.integers(10, 30)) + ("rare " * 5 if 5000 <= i < 5060 else "")) for i in range(20_000)]
    ids, m, lists = shard_of(docs)
    asked = [(lists["rare"], 9000), (lists["common"], 10)]
    best, seen = ranked.best_of(asked, len(ids), 50)
    assert min(best.docs) >= 5000 and max(best.docs) < 5060
    assert seen == sum(len(p.known) for p, _ in asked) < 0.1 * sum(len(p.last) for p, _ in asked)


@pytest.mark.parametrize("chars", [1, 300, ranked.CHARS])
def test_texts_are_cut_together(monkeypatch, chars):
    """However many texts are cut at a time, terms are numbered in the order they are met and texts without any, at any place, have none."""
    monkeypatch.setattr(ranked, "CHARS", chars)
    texts = ["", " \n_!", *(t or "" for _, t in corpus(40)), "\x00a\x1cb\x7f\t c\x0b", "é\x85ü\u2028Ü\u00a0Z", "😀a B😀", "\x00"]
    shard = ranked.Shard()
    for i, text in enumerate(texts):
        shard.add(i, text)
    want = [TERMS.findall(t.translate(UPPER)) for t in texts]
    assert shard.sizes == [*map(len, want)] and not shard.texts
    names, numbers = shard.numbered()
    assert names.tolist() == [*dict.fromkeys(w for ws in want for w in ws)]
    assert names[numbers].tolist() == [w for ws in want for w in ws]
    assert len(shard.words) == (len(texts) if chars == 1 else 1) or chars == 300


def test_terms_in_java_are_those_in_python(spark):
    """Each sign up to U+02FF and some beyond ends a term or doesn't, in the statistics as in the index."""
    signs = [*map(chr, range(0x300)), "\u2028", "\u3000", "漢", "\ud7ff", "\ue000", "\uffff", "\U00010000", "\U0010ffff"]
    rows = [(f"a{c}b", len(TERMS.findall(f"a{c}b"))) for c in signs] + [("", 0), (None, 0)]
    df = spark.createDataFrame(rows, "text string, n int")
    counted = df.select("n", F.coalesce(F.regexp_count("text", F.lit(ranked.TERM)), F.lit(0)).alias("found"))
    assert counted.where("n <> found").count() == 0
    assert ranked.statistics(df) == (len(signs), sum(n for _, n in rows))
    assert [x or 0 for x in ranked.terms_of([t or "" for t, _ in rows]).value_lengths().to_pylist()] == [n for _, n in rows]


def test_empty_tables(spark):
    df = spark.createDataFrame(corpus(20), "doc_id long, text string")
    asked = spark.createDataFrame(QUERIES, "item_id long, text string")
    assert ranked.search(ranked.index(df.where("false")), asked).count() == 0
    assert ranked.search(ranked.index(df.where("text is null")), asked).count() == 0
    assert ranked.search(ranked.index(df), asked.where("false")).count() == 0


def test_query_as_sql(spark, same):
    assert same(op12_ranked_search(spark, SF_DIR), OP12_SQL) == 2000

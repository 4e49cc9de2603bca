"""op11 against a plain count of words, windows and lines."""

import re
from collections import Counter, defaultdict

import numpy as np
from planwatch.llm import quality
from planwatch.llm.queries import OP11_SQL, op11_quality
from pyspark.sql import functions as F

from conftest import SF_DIR

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = [a + b for a in ("ka", "lo", "mi", "nu", "re", "sti", "va", "zon") for b in ("dar", "fel", "gim", "hot", "jus", "pek", "wyn")]


def plain(line):
    return re.sub("[0-9]", "0", " ".join(WORDS.findall(line)).lower())


def brute(rows, most_docs=10, least_share=0.5):
    seen = defaultdict(set)
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            if WORDS.search(line):
                seen[host, plain(line)].add(text)
    out = []
    for i, text, host in rows:
        text = text or ""
        words = WORDS.findall(text)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        dup = sum(x in lines[:k] for k, x in enumerate(lines))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        gone = sum(len(WORDS.findall(x)) for x in lines if len(seen[host, plain(x)]) > most_docs)
        left = len(words) if failed else len(words) - gone
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed, not failed and left >= least_share * len(words), left))
    return out


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB, n))


def corpus():
    rng = np.random.default_rng(8)
    footer, menu = sentence(rng, 8), sentence(rng, 40)
    out = [(i, sentence(rng, int(n)), ["a", "b", None][i % 3]) for i, n in enumerate(rng.integers(1, 200, 60))]
    out += [(100 + i, f"{sentence(rng, 60)}\n{footer.upper()}  page {i:02}\n", "a") for i in range(15)]  # a boilerplate line: kept
    out += [(200 + i, f"{menu}\n {menu} \nArticle {i}\n{sentence(rng, 30)}", "a") for i in range(15)]  # more menu than text: rejected
    out += [(300 + i, f"{menu}\nArticle {i}\n{sentence(rng, 30)}", "b") for i in range(10)]  # as often as the limit allows
    out += [(400 + i, "\n".join(sentence(np.random.default_rng(9), 80).split("mi")), "c") for i in range(30)]  # copies of one text
    text = sentence(rng, 20)
    out += [(500, f"{text} {text} {text} {sentence(rng, 10)}", "a"), (501, f"x #* $%&|<> {sentence(rng, 60)}", "a"), (502, "one\none\n one\none \n\n\n" + sentence(rng, 60), "c")]
    out += [(600, None, "a"), (601, "", None), (602, " \n\t\x0b ", "a"), (603, sentence(rng, 20_000), "a"), (604, "ä b c " * 30, "a"), (605, "w " * 50, "a"), (606, "   " + "é" * 50_000, None)]
    return [*out, (100, *out[60][1:]), (None, out[4][1], "a"), (7, out[61][1], None)]


COLUMNS = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left"]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for name in ("id", "host", "key", "lines", "of", "own", "words", "gone", "kept", "often", "l", "gone_lines"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_quality_as_brute_force(spark):
    rows = corpus()
    want = sorted(brute(rows), key=repr)
    got = quality.judged(frame(spark, rows)).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == want
    verdict = {r[0]: r[7] for r in want}
    assert all(verdict[100 + i] and not verdict[200 + i] for i in range(15)) and all(verdict[300 + i] for i in range(10)) and all(verdict[400 + i] for i in range(30))
    for most_docs, share in ((0, 0.5), (2, 0.9), (1000, 1)):
        got = quality.judged(frame(spark, rows), most_docs=most_docs, least_share=share).select(COLUMNS).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, most_docs, share), key=repr)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(quality, "small", lambda df, most: df.hint("merge"))
    rows = corpus()
    got = quality.judged(frame(spark, rows)).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_cleaned_texts(spark):
    rows = corpus()
    verdicts = {(i, t, h): x[7] for (i, t, h), x in zip(rows, brute(rows), strict=True)}
    df = frame(spark, rows)
    out = quality.cleaned(df)
    assert out.columns == [*df.columns, "cleaned_text"]
    got = {(r["doc_id"], r["text"], r["source"]): r["cleaned_text"] for r in out.collect()}
    assert set(got) == {k for k, kept in verdicts.items() if kept}
    for (i, text, host), new in got.items():
        if i is not None and 100 <= i < 115 and host == "a":
            assert new == text.split("\n")[0] + "\n"
        elif i is None or i < 100 or i >= 300:
            assert new == text


def test_empty_tables(spark):
    df = frame(spark, corpus())
    assert quality.judged(df.where("false")).count() == quality.cleaned(df.where("false")).count() == 0
    got = quality.judged(df.where("text is null")).select(COLUMNS).collect()
    assert [tuple(r) for r in got] == [(600, 0, 0, 0, 0, 0, True, False, 0)]


def test_query_as_sql(spark, same):
    assert same(op11_quality(spark, SF_DIR), OP11_SQL) == 1000

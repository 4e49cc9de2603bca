"""op13 against whole-text encoding and a pairwise comparison of token ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from planwatch.llm import align
from planwatch.llm.queries import op13_alignment
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_DIR

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "  ", " \n\t ", "a", " a", "  a", "a ", "a  b", "a\nB", "a\n\nB", "a \nB", "a\n B", "x\tq", "\tx", "it's we'll they'd", "don 't", "▁x", "a▁b c",
    "\x00a b\x00", "\x1ca \x1cb\x1c \x1d", "a\x85b \x85 c", "a b  ", "a b   c", "é é ﬁ ﬀ", "漢字かな 交じり文", "😀😃 👩‍👩‍👧 x", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "<s>a</s> <unk>",
    "<0x41> <0x0A>", "� ﻿x", "1234567890 12 345", "...!!! --- ,,, \n\n\n ...", "ab" * 3000, "x" + " " * 500 + "y", "a\r\nb\r\n", "naïve Straße Größe", " \U0010ffff",
]


def brute(texts):
    """RESULT's numbers of texts, by their place."""
    a_tok = Tokenizer.from_file(PATHS[0])
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = dict(zip(map(chr, printable), printable, strict=True)) | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    docs, corpus = [], Counter()
    for text in texts:
        docs.append(None)
        if not text:
            continue
        raw = f" {text}".encode()
        e = a_tok.encode(f" {text}", add_special_tokens=False)
        a = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        b = [(i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()) for i in b_tok.encode(text) for p in [b_tok.id_to_piece(i)]]
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            continue
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = []
        k = 0
        for i, s, e_ in spans[0]:
            while spans[1][k][2] <= s:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][1] < e_:
                links.append((i, spans[1][m][0]))
                m += 1
        both = {x[2] for x in spans[0]} & {x[2] for x in spans[1]}
        number = {end: k for k, end in enumerate(sorted(both))}
        groups = [([], []) for _ in both]
        for side, own in enumerate(spans):
            k = 0
            for i, _, end in own:
                groups[k][side].append(i)
                k = number[end] + 1 if end in number else k
        docs[-1] = (len(a), len(b), groups, links)
        corpus.update(links)
    top = Counter()
    for (_, j), n in corpus.items():
        top[j] = max(top[j], n)
    out = []
    for doc in docs:
        if doc is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        n_a, n_b, groups, links = doc
        digest = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest()
        best = sum(corpus[p] == top[p[1]] for p in links)
        out.append((n_a, n_b, len(groups), len(links), best, sum(corpus[p] for p in links), digest, sum(len(x) * len(y) for x, y in groups)))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_products"]


def fuzz(n):
    rng = random.Random(5)
    parts = [" ", " ", "\n", "\t", "  ", "\r", "\x1c", " ", "　", "word", "Wort", "'s", "42", ".", "!", "é", "ß", "漢", "😀", "_", "-", "x", "<s>", "▁"]
    return ["".join(rng.choices(parts[: 23 + (k % 9 == 0)], k=rng.randint(1, 30))) for k in range(n)]


def test_ids_are_those_of_the_vocabulary_files():
    tok = align.Tokenizers(*PATHS)
    own = Tokenizer.from_file(PATHS[0])
    own.encode_special_tokens = True
    for text in [t for t in ODD if t] + fuzz(1500) + [" " * 1_500_000 + "x", "a" * 100_000, "\n" * 5000]:
        a, n_a, b, n_b = tok.encode([text])
        if "▁" in text:
            assert len(a) == len(b) == 0
            continue
        assert a.tolist() == own.encode(f" {text}", add_special_tokens=False).ids and n_a.tolist() == [len(a)]
        assert b.tolist() == tok.b.encode(text) and n_b.tolist() == [len(b)]


@pytest.mark.parametrize("most_chars", [8_000_000, 300])
def test_alignment_as_brute_force(spark, most_chars):
    texts = [*ODD, *fuzz(80), ODD[25], ODD[25], "the cat sat on the mat", "the cat sat on the mat"]
    ids = [None, 7, 7, *range(100, 97 + len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    for name in ("batch", "a", "b", "n", "count", "best", "of", "at", "id", "n_links"):
        df = df.withColumn(name, F.lit("x"))
    got = align.alignment(df, *PATHS, most_chars=most_chars).select("doc_id", *COLUMNS).collect()
    want = [(i, *x) for i, x in zip(ids, brute(texts), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_counts_too_many_to_send_are_joined(spark, monkeypatch):
    monkeypatch.setattr(align, "small", lambda df, most: df.hint("merge"))
    texts = fuzz(60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = align.alignment(df, *PATHS, most_chars=200).select("doc_id", *COLUMNS).collect()
    assert sorted(map(tuple, got)) == [(i, *x) for i, x in enumerate(brute(texts))]


def test_empty_table_and_table_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert align.alignment(df.where("false"), *PATHS).count() == 0
    got = align.alignment(df, *PATHS).select("doc_id", *COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, *[0] * 6, "", 0), (None, *[0] * 6, "", 0)], key=repr)


def test_a_repeated_pair_of_a_document_is_kept_once():
    """What is shuffled of a document grows with its different pairs, not with its links; texts without tokens, first and last too, have none."""
    tokenizers = align.Tokenizers(*PATHS)
    texts = ["", "one word and another", "word " * 40_000, "", "word word", *ODD[3:], ""]
    pdf = pd.DataFrame({"id": range(len(texts)), "text": texts})
    found = align.batch_of(0, pdf, tokenizers)
    n_links, n_pairs = align.numbers(found["counts"], np.int64).reshape(6, -1)[[3, 5]].tolist()
    assert n_links[2] > 39_000 and n_pairs[2] < 5 and len(found["steps"]) + len(found["times"]) < 8_000
    places, times = align.numbers(found["steps"], np.int32).cumsum().tolist(), align.numbers(found["times"], np.int32).tolist()
    total, at = Counter(), 0
    for text, n, m in zip(texts, n_links, n_pairs, strict=True):
        x = align.Aligned(tokenizers, [text])
        want = Counter(x.pairs().tolist())
        assert dict(zip([int(found["a"][k]) << 32 | int(found["b"][k]) for k in places[at : at + m]], times[at : at + m], strict=True)) == want
        assert sum(want.values()) == n
        total += want
        at += m
    assert at == len(places) == len(times)
    assert dict(zip((found["a"].astype(np.int64) << 32 | found["b"]).tolist(), found["n"].tolist(), strict=True)) == total
    none = align.batch_of(0, pdf.iloc[[0, 3]], tokenizers)
    assert align.results(pd.Series(none), *np.zeros((2, 0), np.int64))["n_best"].tolist() == [0, 0]


def test_links_of_texts(spark):
    texts = [t for t in ODD if t and len(t) < 200]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    got = {r["id"]: r for r in align.links(df, *PATHS, with_products=True).collect()}
    assert got[len(texts)]["links"] == []
    for i, x in enumerate(brute(texts)):
        r = got[i]
        assert (len(r["a_ids"]), len(r["b_ids"]), len(r["links"]), len(r["products"])) == (x[0], x[1], x[3], x[7])
        raw, at = f" {texts[i]}".encode(), 0
        for link in r["links"]:
            assert link["start"] == at < link["end"]
            at = link["end"]
        assert not r["links"] or at == len(raw)
        assert {(k["a"], k["b"]) for k in r["links"]} <= {(k["a"], k["b"]) for k in r["products"]}
        assert len({k["group"] for k in r["links"]}) == x[2]


def test_query_over_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = [(r["doc_id"], *x) for r, x in zip(rows, brute([r["text"] for r in rows]), strict=True)]
    got = op13_alignment(spark, SF_DIR).select("doc_id", *COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(want)

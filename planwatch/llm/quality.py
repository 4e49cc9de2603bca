"""Quality rules of a text, and of its lines across the documents of a host."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, free_name, modest, small, stored

SPACE = " \t\n\r\x0b\x0c"
WORD = re.compile(rf"[^{SPACE}]+")
#: What the base rules count as symbols, the least words, and the percentage of repeated ones that fails.
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50
DIGITS = str.maketrans("123456789", "000000000")
MEASURED = "id long, host string, key binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines array<long>, line_words array<int>"


def repeated_words(words: list[str]) -> int:
    """How many words stand in windows of three that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    numbers: dict[str, int] = {}
    at = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    pair = np.unique(at[:-1] * len(numbers) + at[1:], return_inverse=True)[1].astype(np.int64)
    _, window, times = np.unique(pair[:-1] * len(numbers) + at[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def normalised(line: list[str]) -> str:
    """A line's words as they are compared across documents: one space between them, lower case, every digit 0."""
    return " ".join(line).lower().translate(DIGITS)


def measured_text(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; the hashes of its different normalised lines, and the words that stand in each."""
    lines = text.split("\n")
    split = [WORD.findall(x) for x in lines]
    words = [w for x in split for w in x]
    with_words = [x for x, own in zip(lines, split, strict=True) if own]
    in_lines: dict[int, int] = {}
    for own in split:
        if own:
            h = xxhash.xxh64_intdigest(normalised(own)) - (1 << 63)
            in_lines[h] = in_lines.get(h, 0) + len(own)
    symbols = len(re.findall(SYMBOLS, text))
    return len(words), sum(map(len, words)), symbols, len(with_words) - len(set(with_words)), repeated_words(words), list(in_lines), list(in_lines.values())


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """MEASURED's rows, one for each row of docs, stored; nothing is shuffled. key tells different texts of a host apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in MEASURED.split(", ")]
        for pdf in by_size(frames, "text", 2_000_000):
            out = []
            for i, host, text in zip(pdf["id"], pdf["host"], pdf["text"], strict=True):
                n, *rest, lines, words = measured_text(text)
                failed = n < LEAST_WORDS or 100 * rest[-1] > MOST_REPEATED * n
                out.append((i, host, xxhash.xxh128_digest(text), n, *rest, failed, lines, words))
            yield pd.DataFrame(out, columns=names).astype({"id": "Int64"})

    return stored(modest(docs).select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, MEASURED))


def frequent_lines(rows: DataFrame, most_docs: int) -> DataFrame:
    """host, line: lines that more than most_docs different documents of a host have.

    Copies of a text are one document. A document counts a line once, so the lines are pre-aggregated where they are before the shuffle.
    """
    once = rows.where(F.size("lines") > 0).groupBy("host", "key").agg(F.first("lines").alias("lines"))
    return once.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > most_docs).select("host", "line")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_docs: int = 10, least_share: float = 0.5) -> DataFrame:
    """id, host, key, MEASURED's numbers, base_failed, words_left long, gone array<long>, kept boolean: a row for each row of docs.

    The base rules look at a text alone. Then lines on more than most_docs different documents of their host count as removed (gone: their
    hashes), and a document that has less than least_share of its words left is rejected, as is one that failed the base rules.

    A null text has no words and fails; a null host is a host of its own; copies of a text within a host share one verdict and count as one
    document, so a page stored twice doesn't make its lines boilerplate; a row repeated, or with a null id, has its own row; an empty table
    gives none. Of lines only hashes (64 bits) with their words' number are shuffled.
    """
    rows = measured(docs, id_col, text_col, host_col)
    often = small(stored(frequent_lines(rows, most_docs)).select(F.col("host").alias("of"), F.col("line").alias("often")), 100_000)
    each = rows.where("not base_failed").groupBy("host", "key").agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words"))
    each = each.select("host", "key", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    hit = each.join(often, F.col("host").eqNullSafe(F.col("of")) & (F.col("l.lines") == F.col("often")))
    lost = stored(hit.groupBy("host", "key").agg(F.sum("l.line_words").alias("words"), F.collect_set("l.lines").alias("gone")))
    lost = small(lost.select(F.col("host").alias("of"), F.col("key").alias("own"), "words", "gone"), 20_000)
    left = F.col("n_words") - F.coalesce(F.col("words"), F.lit(0))
    return (
        rows.drop("lines", "line_words")
        .join(lost, F.col("host").eqNullSafe(F.col("of")) & (F.col("key") == F.col("own")), "left")
        .withColumn("words_left", left)
        .withColumn("kept", ~F.col("base_failed") & (left >= least_share * F.col("n_words")))
        .drop("of", "own", "words")
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_docs: int = 10, least_share: float = 0.5, new_col: str = "cleaned_text") -> DataFrame:
    """The rows of docs that judged() keeps, with new_col: the text without its host's frequent lines. A column of that name is replaced."""
    found = judged(docs, id_col, text_col, host_col, most_docs, least_share).where("kept")
    verdict, host, key, gone = (free_name(docs, x) for x in ("verdict_host", "own_host", "own_key", "gone_lines"))
    verdicts = stored(found.groupBy(F.col("host").alias(verdict), F.col("key").alias(key)).agg(F.first("gone").alias(gone)))
    names = [c for c in docs.columns if c != new_col]

    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: xxhash.xxh128_digest(t))

    def without(texts: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for text, drop in zip(texts, lines, strict=True):
            hashes = set() if drop is None else set(drop)
            split = ((x, WORD.findall(x)) for x in text.split("\n"))
            out.append("\n".join(x for x, own in split if not own or xxhash.xxh64_intdigest(normalised(own)) - (1 << 63) not in hashes))
        return pd.Series(out)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = modest(docs).withColumn(host, F.col(host_col).cast("string")).withColumn(key + "_of", F.pandas_udf(digest, "binary")(text))
    joined = rows.join(verdicts, F.col(host).eqNullSafe(F.col(verdict)) & (F.col(key + "_of") == F.col(key)))
    return joined.select(*names, F.pandas_udf(without, "string")(text, F.col(gone)).alias(new_col))

"""Alignment of two tokenizers: which of their tokens cover the same bytes of a text."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, expanded, modest, small, squeezed, stored

#: The byte alphabet of byte-level vocabularies, by its rule: printable Latin-1 signs stand for themselves, other bytes for signs from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b if b in PRINTABLE else 256 + sum(x not in PRINTABLE for x in range(b))): b for b in range(256)}
#: Fixed value: where byte-level vocabularies of this kind split texts before they merge.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: From so many spaces in a row a text is split by the slower library, as the faster one's splitter gives up at about a million.
MOST_SPACES = 50_000
LONG_SPACES = re.compile(rf"\s{{{MOST_SPACES}}}")
#: Characters that a worker encodes at a time.
CHARS = 200_000


class Tokenizers:
    """The byte-level tokenizer A and the piece tokenizer B: ids of whole texts, and each id's bytes."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = {bytes(map(BYTE_OF.__getitem__, token)): i for token, i in vocabulary.items() if set(token) <= BYTE_OF.keys()}
        self.path_a = path_a
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # as text in front of a comma or of the end of A's, then B's part of a group
        self.word_a, self.word_b = (np.array([f"{i}{end}" for end in ends for i in range(len(x))], object) for x, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))

    def ids_a(self, text: str) -> list[int]:
        if len(text) < MOST_SPACES or not LONG_SPACES.search(text):
            return self.a.encode_ordinary(text)
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path_a)
        own.encode_special_tokens = True
        return own.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A over all texts, one after the other, and how many each text has; then B's. A text that either tokenizer changes has none."""
        a = [self.ids_a(f" {t}") if t else [] for t in texts]
        b = self.b.encode(texts, num_threads=1)
        raw = [f" {t}".encode() if t else b"" for t in texts]
        whole = b"".join(raw)
        for ids, table in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join([table[i] for own in ids for i in own]) != whole:
                for k, own in enumerate(ids):
                    if b"".join([table[i] for i in own]) != raw[k]:
                        a[k], b[k], raw[k] = [], [], b""
                whole = b"".join(raw)
        return tuple(x for ids in (a, b) for x in (np.array([i for own in ids for i in own], np.int64), np.array(list(map(len, ids)), np.int64)))


class Aligned:
    """Tokens of texts that stand one after the other, and the elementary intervals between neighbouring ends of either tokenizer.

    ends: the intervals' ends; a, b: the tokens that own them; closes: where tokens of both end, which ends a group. Each interval is the
    overlap of one token of A with one of B, and each overlap is one interval.
    """

    def __init__(self, tokenizers: Tokenizers, texts: list[str]):
        self.tokenizers = tokenizers
        self.ids_a, self.n_a, self.ids_b, self.n_b = tokenizers.encode(texts)
        ends_a, ends_b = tokenizers.size_a[self.ids_a].cumsum(), tokenizers.size_b[self.ids_b].cumsum()
        self.ends = np.union1d(ends_a, ends_b)
        self.a, self.b = np.searchsorted(ends_a, self.ends), np.searchsorted(ends_b, self.ends)
        self.closes = ends_a[self.a] == ends_b[self.b] if len(self.ends) else np.empty(0, bool)
        self.last_a, self.last_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
        self.last_a[self.a[self.closes]] = self.last_b[self.b[self.closes]] = True
        # first tokens of each group, and the end of the last
        self.first_a, self.first_b = (np.r_[0, np.flatnonzero(x) + 1] for x in (self.last_a, self.last_b))
        ends = np.r_[0, self.n_a.cumsum()]
        groups, links = np.r_[0, self.last_a.cumsum()], np.r_[0, np.searchsorted(self.a, np.arange(len(ends_a)), "right")]
        products = np.r_[0, (np.diff(self.first_a) * np.diff(self.first_b)).cumsum()]
        self.n_groups, self.n_links, self.n_products = np.diff(groups[ends]), np.diff(links[ends]), np.diff(products[groups[ends]])

    def pairs(self) -> np.ndarray:
        """The two ids of each link as one number."""
        return self.ids_a[self.a] << 32 | self.ids_b[self.b]

    def digests(self) -> list[bytes]:
        """Of each text the digest of its groups' ids as text; b'' without tokens."""
        t = self.tokenizers
        group_a, group_b = self.last_a.cumsum() - self.last_a, self.last_b.cumsum() - self.last_b
        words = np.empty(len(self.ids_a) + len(self.ids_b), object)
        words[np.arange(len(self.ids_a)) + self.first_b[group_a]] = t.word_a[self.ids_a + self.last_a * len(t.bytes_a)]
        words[np.arange(len(self.ids_b)) + self.first_a[group_b + 1]] = t.word_b[self.ids_b + self.last_b * len(t.bytes_b)]
        ends = (self.n_a + self.n_b).cumsum().tolist()
        return [hashlib.sha256("".join(words[i:j].tolist())[:-1].encode()).digest() if i < j else b"" for i, j in zip([0, *ends], ends)]


#: A row for each batch of documents. Arrays of numbers are compressed bytes; a, b and n are the batch's different pairs of ids and their links.
#: steps and times have a number for each document and each of its different pairs: the pair's place in a and b, less that of the number before, and its links.
BATCH = "batch long, ids binary, known binary, counts binary, digests binary, steps binary, times binary, a array<int>, b array<int>, n array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_products long"


def small_bytes(x: np.ndarray) -> bytes:
    return squeezed(x) if len(x) else b""


def numbers(data: bytes, kind: type) -> np.ndarray:
    return expanded(data, kind) if data else np.empty(0, kind)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of values, sizes long each."""
    total = np.r_[0, values.cumsum()]
    ends = sizes.cumsum()
    return total[ends] - total[ends - sizes]


def counted(pairs: np.ndarray, n_links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the links of texts (their pairs of ids; n_links: each text's) the different pairs of each text in order, how often each stands, and how many each text has."""
    own = np.unique(pairs)
    keys = np.repeat(np.arange(len(n_links)) * len(own), n_links)
    keys += np.searchsorted(own, pairs)
    keys, times = np.unique(keys, return_counts=True)
    text, at = np.divmod(keys, max(1, len(own)))
    return own[at], times, np.bincount(text, minlength=len(n_links))


def batch_of(number: int, pdf: pd.DataFrame, tokenizers: Tokenizers) -> dict[str, object]:
    """BATCH's row for the documents of pdf (id, text)."""
    counts: list[np.ndarray] = []
    links: list[tuple[np.ndarray, np.ndarray]] = []
    digests: list[bytes] = []
    for part in by_size(iter([pdf]), "text", CHARS):
        found = Aligned(tokenizers, part["text"].tolist())
        *own, n_pairs = counted(found.pairs(), found.n_links)
        counts.append(np.stack([found.n_a, found.n_b, found.n_groups, found.n_links, found.n_products, n_pairs]))
        links.append(own)
        digests += found.digests()
    every, times = map(np.concatenate, zip(*links, strict=True))
    del links
    pairs = np.unique(every)
    at = np.searchsorted(pairs, every)
    return {
        "batch": number,
        "ids": small_bytes(pdf["id"].fillna(0).to_numpy(np.int64)),
        "known": small_bytes(pdf["id"].notna().to_numpy(np.uint8)),
        "counts": small_bytes(np.concatenate(counts, axis=1).ravel()),
        "digests": b"".join(digests),
        "steps": small_bytes(np.diff(at, prepend=0).astype(np.int32)),
        "times": small_bytes(times.astype(np.int32)),
        "a": (pairs >> 32).astype(np.int32),
        "b": (pairs & 0xFFFFFFFF).astype(np.int32),
        "n": np.bincount(at, times, len(pairs)).astype(np.int64),
    }


def batches(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, most_chars: int) -> DataFrame:
    """BATCH's rows of docs; what one task reads at a time is a batch, so nothing is shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizers = Tokenizers(path_a, path_b)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for number, pdf in enumerate(by_size(frames, "text", most_chars)):
            yield pd.DataFrame([batch_of(first + number, pdf, tokenizers)])

    return modest(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, BATCH)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """a int, b int, count long, best boolean: links of each pair of ids in the whole corpus, and whether no other id of A has more with b."""
    each = encoded.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("count"))
    counts = stored(each.where("count > 0"))
    top = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def results(batch: pd.Series, count: np.ndarray, best: np.ndarray) -> pd.DataFrame:
    """RESULT's rows of a batch, given the corpus's count of each of its pairs and whether it is the best of its b."""
    n_a, n_b, n_groups, n_links, n_products, n_pairs = numbers(batch["counts"], np.int64).reshape(6, -1)
    at, times = numbers(batch["steps"], np.int32).cumsum(dtype=np.int64), numbers(batch["times"], np.int32)
    has = iter([batch["digests"][i : i + 32].hex() for i in range(0, len(batch["digests"]), 32)])
    return pd.DataFrame(
        {
            "doc_id": pd.Series(numbers(batch["ids"], np.int64)).astype("Int64").where(numbers(batch["known"], np.uint8) == 1),
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": n_groups,
            "n_links": n_links,
            "n_best": sums(best[at] * times, n_pairs),
            "count_sum": sums(count[at] * times, n_pairs),
            "groups_sha256": [next(has) if n else "" for n in n_a],
            "n_products": n_products,
        }
    )


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most_chars: int = 4_000_000) -> DataFrame:
    """RESULT: a row for each row of docs, of the tokens of A (path_a, byte-level) and B (path_b, pieces) over a space and the text.

    n_links counts the pairs of tokens that share bytes, n_groups the runs between places where tokens of both end, n_products the
    pairs of tokens within groups, n_best the links whose pair of ids has no fewer links in the corpus than any other pair with
    its id of B, and count_sum adds up the corpus's links of each link's pair. groups_sha256 is the digest of the groups' ids.

    Whole texts are encoded. A text that is null or empty, or that a tokenizer changes, has no tokens: numbers are 0,
    the digest is '', and the corpus's counts don't know it. Repeated rows and ids are documents each; a null id stays null; an
    empty table gives no rows. A batch asks for each of its pairs once, so the join with the counts grows with batches, not links; what
    meets the answers is each document's different pairs with how often they stand, not its links.
    """
    encoded = stored(batches(docs, path_a, path_b, id_col, text_col, most_chars))
    counts = stored(pair_counts(encoded))
    asked = encoded.select(F.col("batch").alias("of"), F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).select("of", "at", "p.a", "p.b")
    told = asked.join(small(counts, 200_000), ["a", "b"]).select("of", "at", "count", "best")
    documents = encoded.select(F.size("a").alias("size"), *(c for c in encoded.columns if c not in ("a", "b", "n")))

    def run(told: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        row = batch.iloc[0]
        count, best = np.zeros((2, row["size"]), np.int64)
        count[told["at"]], best[told["at"]] = told["count"], told["best"]
        return results(row, count, best)

    return told.groupBy("of").cogroup(documents.groupBy("batch")).applyInPandas(run, RESULT)


LINKS = "id long, a_ids array<int>, b_ids array<int>, links array<struct<start:long,end:long,a:int,b:int,group:int>>, products array<struct<a:int,b:int,group:int>>"


def links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_products: bool = False) -> DataFrame:
    """LINKS: of each row of docs its tokens, each overlap (bytes from start to end, numbers of the tokens and of the group), and with
    with_products all pairs of tokens within each group, else null. Offsets count the space put before the text; texts without tokens have empty arrays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizers = Tokenizers(path_a, path_b)
        for pdf in by_size(frames, "text", CHARS):
            out = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                x = Aligned(tokenizers, [text])
                group = x.closes.cumsum() - x.closes
                each = zip(np.r_[0, x.ends[:-1]].tolist(), x.ends.tolist(), x.a.tolist(), x.b.tolist(), group.tolist()) if len(x.ends) else ()
                products = None
                if with_products:
                    of_a = x.last_a.cumsum() - x.last_a
                    size = np.diff(x.first_b)[of_a]
                    left = np.repeat(np.arange(len(of_a)), size)
                    right = np.repeat(x.first_b[of_a], size) + np.arange(size.sum()) - np.repeat(size.cumsum() - size, size)
                    products = list(zip(left.tolist(), right.tolist(), of_a[left].tolist(), strict=True))
                out.append((i, x.ids_a.tolist(), x.ids_b.tolist(), list(each), products))
            yield pd.DataFrame(out, columns=["id", "a_ids", "b_ids", "links", "products"]).astype({"id": "Int64"})

    return modest(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, LINKS)

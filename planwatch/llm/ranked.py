"""Ranked lexical search: Block-Max WAND over shards of compressed posting blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import modest, small, stored

#: Signs that end a term are the ASCII ones other than letters and digits. (Java takes several times as long if the class is written as what it leaves out.)
TERM = r"[a-z0-9A-Z\x{80}-\x{10FFFF}]+"
#: The same on UTF-8: each such byte becomes a space, and A-Z becomes a-z.
TO_TERMS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
#: Postings in a block, queries that visit a shard together, intervals looked at before a query knows a threshold, and characters cut into terms at a time.
BLOCK, QUERIES, SEED, CHARS = 128, 500, 8, 1_000_000
#: What is known of a block without decompressing it: its first and last document, its maximum impact, where its bytes begin, how many
#: postings it has, and how many bytes a gap and a frequency take.
HEAD = np.dtype([("first", "<i4"), ("last", "<i4"), ("top", "<i4"), ("at", "<i4"), ("n", "u1"), ("gap", "u1"), ("tf", "u1")])
INDEX = "shard long, term string, df long, heads binary, postings binary"


def lower(word: Column) -> Column:
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(texts: list[str]) -> pa.Array:
    """Each text's terms as a list; null without terms."""
    return pc.ascii_split_whitespace(pa.array([t.encode().translate(TO_TERMS).strip() or None for t in texts], pa.string()))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score, without its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def written(values: np.ndarray, at: np.ndarray, width: np.ndarray, out: np.ndarray) -> None:
    """Puts each value's low width bytes at its place of out."""
    for k in range(4):
        on = width > k
        if not on.any():
            return
        out[at[on] + k] = (values[on] >> 8 * k) & 255


def posting_lists(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Terms, their numbers of documents, their blocks' heads and their blocks, of postings sorted by term and document; m is each document's."""
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    sizes = np.diff(np.r_[starts, len(term)])
    place = np.arange(len(term)) - np.repeat(starts, sizes)
    begins = np.flatnonzero(place % BLOCK == 0)
    n = np.diff(np.r_[begins, len(term)])
    inside = place % BLOCK
    gap = np.where(inside == 0, 0, np.r_[0, np.diff(doc)])
    width = lambda x: 1 + (x > 255) + 2 * (x > 65535)
    head = np.zeros(len(begins), HEAD)
    head["first"], head["last"], head["n"] = doc[begins], doc[begins + n - 1], n
    head["top"] = np.maximum.reduceat(impact(tf, m[doc]), begins)
    head["gap"], head["tf"] = width(np.maximum.reduceat(gap, begins)), width(np.maximum.reduceat(tf, begins))
    size = n * (head["gap"].astype(np.int64) + head["tf"])
    ends = size.cumsum()
    out = np.zeros(int(ends[-1]), np.uint8)
    own = np.repeat(np.arange(len(begins)), n)
    gap_width, tf_width, base = head["gap"][own].astype(np.int64), head["tf"][own].astype(np.int64), (ends - size)[own]
    written(gap, base + inside * gap_width, gap_width, out)
    written(tf, base + n[own] * gap_width + inside * tf_width, tf_width, out)
    first = np.searchsorted(begins, starts)
    last = np.r_[first[1:], len(begins)]
    start_byte = (ends - size)[first]
    head["at"] = ends - size - np.repeat(start_byte, last - first)
    raw, heads = out.tobytes(), head.tobytes()
    end_byte = np.r_[start_byte[1:], len(raw)]
    return (
        term[starts],
        sizes,
        [heads[i * HEAD.itemsize : j * HEAD.itemsize] for i, j in zip(first.tolist(), last.tolist(), strict=True)],
        [raw[i:j] for i, j in zip(start_byte.tolist(), end_byte.tolist(), strict=True)],
    )


class Shard:
    """Documents on their way into a shard of the index; their texts are cut into terms CHARS at a time, which Arrow numbers."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.known: list[int] = []
        self.words: list[pa.DictionaryArray] = []
        self.chars = 0
        self.texts: list[str] = []
        self.waiting = 0

    def add(self, doc: int | None, text: str) -> None:
        self.ids.append(doc)
        self.texts.append(text)
        self.chars += len(text) + 100
        self.waiting += len(text) + 100
        if self.waiting >= CHARS:
            self.cut()

    def cut(self) -> None:
        """Cuts the texts that wait into terms."""
        if not self.texts:
            return
        lists = terms_of(self.texts)
        self.known += lists.value_lengths().fill_null(0).to_numpy().tolist()
        self.words.append(lists.flatten().dictionary_encode())
        self.texts, self.waiting = [], 0

    @property
    def sizes(self) -> list[int]:
        """How many terms each document has."""
        self.cut()
        return self.known

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """The different terms in the order they are met, and the number of each term of each document."""
        self.cut()
        parts = pa.chunked_array(self.words).unify_dictionaries().chunks
        return parts[0].dictionary.to_numpy(zero_copy_only=False), np.concatenate([x.indices.to_numpy() for x in parts])

    def rows(self, shard: int, n_docs: int, n_terms: int) -> Iterator[pd.DataFrame]:
        """INDEX's rows: one for each term, and one without a term for the documents in the order of their ids (df: how many have a term,
        heads: their ids and m, postings: which have an id)."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sizes = np.array(self.sizes, np.int64)
        m = np.empty(len(order), np.int64)
        m[rank] = 100 - 50 + (50 * sizes * n_docs) // max(n_terms, 1)
        doc_ids = np.array([self.ids[k] or 0 for k in order], np.int64).tobytes() + m.tobytes()
        known = np.array([self.ids[k] is not None for k in order], np.uint8).tobytes()
        yield pd.DataFrame({"shard": [shard], "term": [None], "df": [int((sizes > 0).sum())], "heads": [doc_ids], "postings": [known]})
        if not sizes.sum():
            return
        names, key = self.numbered()
        key = key * np.int64(len(order))
        key += np.repeat(rank, sizes)
        key.sort()
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        tf = np.diff(np.r_[at, len(key)])
        key = key[at]
        term, df, heads, postings = posting_lists(key // len(order), key % len(order), tf, m)
        for i in range(0, len(term), 50_000):
            part = slice(i, i + 50_000)
            yield pd.DataFrame({"shard": shard, "term": names[term[part]], "df": df[part], "heads": heads[part], "postings": postings[part]})


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and the terms of all."""
    n = F.regexp_count(F.col(text_col), F.lit(TERM))
    row = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    return row[0], row[1] or 0


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = 32_000_000) -> DataFrame:
    """INDEX of all documents, stored: shards of what a task reads, up to shard_chars, so that no text is shuffled.

    A term's postings (document, frequency) stand in blocks of BLOCK, each with the maximum impact that a document of it has under
    the corpus's own numbers. Null and empty texts have no terms; repeated rows and ids are documents each.
    """
    n_docs, n_terms = statistics(docs, text_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        shard = Shard()
        for pdf in frames:
            for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                shard.add(None if pd.isna(doc) else int(doc), text)
                if shard.chars >= shard_chars:
                    yield from shard.rows(number, n_docs, n_terms)
                    number, shard = number + 1, Shard()
        if shard.ids:
            yield from shard.rows(number, n_docs, n_terms)

    rows = modest(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored(rows.mapInPandas(run, INDEX))


class Postings:
    """A term's list in a shard: its heads, and blocks that are decompressed when first wanted and then kept."""

    def __init__(self, heads: bytes, postings: bytes, m: np.ndarray):
        self.head, self.raw, self.m = np.frombuffer(heads, HEAD), postings, m
        self.first, self.last, self.top = (self.head[x].astype(np.int64) for x in ("first", "last", "top"))
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block k."""
        found = self.known.get(k)
        if found is None:
            first, _, _, at, n, gap, tf = self.head[k].tolist()
            kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32}
            docs = first + np.frombuffer(self.raw, kinds[gap], n, at).cumsum(dtype=np.int64)
            times = np.frombuffer(self.raw, kinds[tf], n, at + n * gap).astype(np.int64)
            found = self.known[k] = docs, impact(times, self.m[docs])
        return found

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self.block(k) for k in which.tolist()]
        return (found[0] if len(found) == 1 else tuple(map(np.concatenate, zip(*found, strict=True)))) if found else (np.empty(0, np.int64),) * 2


class Best:
    """The k best documents so far; least is what a further one must reach."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.docs, self.scores = np.empty((2, 0), np.int64)

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        on = scores >= self.least
        docs, scores = np.r_[self.docs, docs[on]], np.r_[self.scores, scores[on]]
        order = np.lexsort((docs, -scores))[: self.k]
        self.docs, self.scores = docs[order], scores[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


def best_of(lists: list[tuple[Postings, int]], n_docs: int, k: int) -> tuple[Best, int]:
    """The k best of a shard's documents for a query's lists and weights, and how many blocks it looked into.

    The lists' shallow pointers move over the ends and beginnings of blocks: between two of them no pointer changes its block, so
    the sum of weighted maxima bounds all scores there. First the SEED best-bounded intervals are scored, then the others in the order of
    documents: the pivot is the next interval whose bound reaches the threshold, and all before it are passed without decompressing.
    """
    best = Best(k)
    seen = [np.zeros(len(p.last), bool) for p, _ in lists]
    edges = np.unique(np.concatenate([x for p, _ in lists for x in (p.first, p.last + 1)]))
    begins, ends = edges[:-1], edges[1:]
    at = np.empty((len(lists), len(begins)), np.int64)
    bound = np.zeros(len(begins), np.int64)
    for row, (p, w) in zip(at, lists, strict=True):
        row[:] = np.searchsorted(p.last, begins)
        row[row == len(p.last)] = -1
        row[p.first[row] > begins] = -1
        bound += np.where(row >= 0, w * p.top[row], 0)
    score, inside = np.zeros(n_docs, np.int64), np.zeros(n_docs + 1, np.int64)

    def visit(which: np.ndarray) -> None:
        inside[:] = 0
        inside[begins[which]] += 1
        inside[ends[which]] -= 1
        wanted = inside.cumsum() > 0
        score[:] = 0
        for row, (p, w), own in zip(at, lists, seen, strict=True):
            blocks = np.unique(row[which])
            blocks = blocks[blocks >= 0]
            own[blocks] = True
            docs, parts = p.blocks(blocks)
            score[docs] += w * parts
        docs = np.flatnonzero(wanted[:-1] & (score > 0))
        best.add(docs, score[docs])

    seed = np.sort(np.argsort(-bound, kind="stable")[:SEED])
    visit(seed)
    left = np.ones(len(begins), bool)
    left[seed] = False
    here, stride = 0, 2 * SEED
    while True:
        rest = here + np.flatnonzero(left[here:] & (bound[here:] >= best.least))
        if not len(rest):
            return best, sum(int(x.sum()) for x in seen)
        visit(rest[:stride])
        here, stride = int(rest[:stride][-1]) + 1, 2 * stride


FOUND = "query long, doc_id long, score long, n_blocks long, n_read long"


def search(indexed: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 50) -> DataFrame:
    """item_id, rank int, doc_id, score long of the k best documents of INDEX for each query, with n_blocks and n_read (of the document's shard: the blocks of
    the query's lists, and those it looked into). No document stands twice for a query, and none with score 0.

    A query is a row of queries; equal rows are one, and equal ids with different texts several. One without a known term has no rows.
    Weights meet postings by a join on the term; a shard's lists are visited by QUERIES queries at a time, and only a shard's k best leave it.
    """
    asked = stored(
        queries.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .distinct()
        .select("item_id", F.xxhash64("item_id", "text").alias("query"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lower))).alias("word"))
    )
    n_queries = asked.select("query").distinct().count()
    blocks = max(1, -(-n_queries // QUERIES))
    words = small(stored(asked.select("word").distinct()), 200_000)
    total = indexed.where("term is null").agg(F.sum("df")).first()[0] or 0
    df = indexed.join(words, F.col("term") == F.col("word")).groupBy("word").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(total) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = (
        asked.join(df, "word")
        .select("word", "query", F.pmod("query", F.lit(blocks)).alias("block"), weight.alias("weight"))
        .where("weight > 0")
        .groupBy("word", "block")
        .agg(F.collect_list("query").alias("queries"), F.collect_list("weight").alias("weights"))
    )
    lists = indexed.join(small(stored(weighted), 200_000), F.col("term") == F.col("word")).select("shard", "block", "term", "heads", "postings", "queries", "weights")
    none = F.array().cast("array<long>")
    documents = indexed.where("term is null").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "term", "heads", "postings", none.alias("queries"), none.alias("weights"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["term"].isna()
        ids, m = np.frombuffer(pdf.loc[own, "heads"].iloc[0], np.int64).reshape(2, -1)
        known = np.frombuffer(pdf.loc[own, "postings"].iloc[0], np.uint8).astype(bool)
        by_query: dict[int, list[tuple[Postings, int]]] = {}
        for heads, postings, whose, weights in pdf.loc[~own, ["heads", "postings", "queries", "weights"]].itertuples(index=False):
            p = Postings(heads, postings, m)
            for q, w in zip(whose, weights, strict=True):
                by_query.setdefault(int(q), []).append((p, int(w)))
        out: list[pd.DataFrame] = []
        for q, own_lists in by_query.items():
            best, seen = best_of(own_lists, len(ids), k)
            doc = pd.Series(ids[best.docs]).astype("Int64").where(known[best.docs])
            out.append(pd.DataFrame({"query": q, "doc_id": doc, "score": best.scores, "n_blocks": sum(len(p.last) for p, _ in own_lists), "n_read": seen}))
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in FOUND.split(", ")])

    found = lists.unionByName(documents).groupBy("shard", "block").applyInPandas(run, FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select("query", "item_id").distinct()
    return top.join(names, "query").select("item_id", "rank", "doc_id", "score", "n_blocks", "n_read")

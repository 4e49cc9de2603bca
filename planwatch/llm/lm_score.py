"""Language-model scores by deleted interpolation."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, expanded, from_batch, in_batches, squeezed, stored

#: Outside the range of words, which hold no white space: a text's end, and what stands before its start.
END, START = b"\n", xxhash.xxh64_intdigest(b"\n\n")
#: Steps of the grid on which held-out probabilities are counted, for a factor of 2; beyond it a probability counts as this one.
GRID, LAST = 8, 400


def grid(order: int) -> int:
    """Steps for a factor of 2, fewer for longer n-grams, so that cells stay few."""
    return GRID if order <= 2 else 3


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def packed(hashes: np.ndarray, lead: int, kept: int) -> bytes:
    """Sorted hashes that agree on the lead first bits: the next kept bits, as steps from one to the next."""
    short = (hashes << np.uint64(lead)) >> np.uint64(64 - kept)
    return squeezed(np.diff(short, prepend=np.uint64(0)))


def kept_bits(kind: int, lead: int) -> int:
    """All of a word's hash; of a longer n-gram's 44 bits besides its range: of 10 million one or two then share their count with another."""
    return 64 - lead if kind == 0 else min(44, 64 - lead)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text's followed by its end; where each text's begin, and the whole length."""
    parts, starts = [np.empty(0, np.uint64)], [0]
    for t in texts:  # hashed text by text: the words of a whole batch take several times its bytes
        words = [*t.lower().split(), END]
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        starts.append(starts[-1] + len(words))
    return np.concatenate(parts), np.array(starts)


def grams(tok: np.ndarray, starts: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For n = 1..order the hash of the n tokens that end at each place; before a text's start stands START."""
    back = acc = tok
    yield acc
    for _ in range(1, order):
        back = np.concatenate([[np.uint64(START)], back[:-1]])
        back[starts[:-1]] = START
        acc = mix(back, acc)
        yield acc


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes, sorted, and where each place's is among them, in 4 bytes."""
    found, inverse = np.unique(hashes, return_inverse=True)
    return found, inverse.astype(np.int32)


class Batch:
    """A batch of documents, from blobs: its distinct n-grams, sorted by hash, and where each place's is among them."""

    def __init__(self, pdf: pd.DataFrame, order: int):
        self.ids, texts, train, self.times = from_batch(pdf)
        self.tok, self.starts = tokens(texts)
        self.weight = np.repeat(train * self.times, np.diff(self.starts))
        self.kinds = [distinct(g) for g in grams(self.tok, self.starts, order)]

    def probabilities(self, counts: list[np.ndarray], total: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """[order, places] relative frequencies given the counts of the distinct n-grams, and the longest context's counts.

        A context's count is that of the (n-1)-gram that ends one place before; at a text's start it is the number of texts. In
        a context that training texts don't have, the longest n-grams' frequency is 0 and that of others is the next shorter ones'.
        """
        at = [c[inverse] for c, (_, inverse) in zip(counts, self.kinds, strict=True)]
        p = [at[0] / max(total, 1)]
        context = np.full(len(self.tok), total)
        for n in range(1, len(at)):
            context = np.concatenate([[0], at[n - 1][:-1]])
            context[self.starts[:-1]] = texts
            own = at[n] / np.maximum(context, 1)
            p.append(own if n == len(at) - 1 else np.where(context > 0, own, p[-1]))
        return np.stack(p), context


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Context-frequency buckets: 0 for none, then one for each power of two."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def mixture_weights(hist: DataFrame, order: int, types: int, rounds: int = 60, still: float = 1e-9) -> np.ndarray:
    """[bucket, order + 1] weights of the uniform, unigram, ... estimates by expectation-maximisation on held-out counts.

    hist: bucket, q1..q<order>, n, stored. Each round is one aggregate over it, and only a row a bucket (64 at most) reaches the driver; rounds end when no
    weight moves by more than still. A bucket without held-out tokens takes the weights of the next lower one that has some, or
    of the lowest. The longest n-grams have no weight in bucket 0, where their context is unknown, so that probabilities add up to 1.
    """
    step = 1.0 / grid(order)
    p = [F.lit(1 / (types + 1)), *[F.when(F.col(f"q{k + 1}") >= LAST, 0.0).otherwise(F.pow(F.lit(2.0), -F.col(f"q{k + 1}") * step)) for k in range(order)]]
    cells = hist.select(F.col("bucket").cast("int").alias("bucket"), "n", *[x.alias(f"p{k}") for k, x in enumerate(p)])
    out = np.full((64, order + 1), 1 / (order + 1))
    known: list[int] = []
    for _ in range(rounds):
        table = F.from_json(F.lit(json.dumps(out.tolist())), "array<array<double>>")  # a constant of the plan
        parts = [F.get(F.get(table, F.col("bucket")), F.lit(k)) * F.col(f"p{k}") for k in range(order + 1)]
        row = cells.select("bucket", "n", *[x.alias(f"x{k}") for k, x in enumerate(parts)])
        whole = sum((F.col(f"x{k}") for k in range(1, order + 1)), F.col("x0"))
        got = row.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(f"x{k}") / whole).alias(f"x{k}") for k in range(order + 1)]).collect()
        new = {r["bucket"]: np.array([r[f"x{k}"] for k in range(order + 1)]) / r["n"] for r in got}
        moved = max((abs(w - out[b]).max() for b, w in new.items()), default=0.0)
        for b, w in new.items():
            out[b] = w
        known = sorted(new)
        if moved <= still:
            break
    if not known:
        return np.full((64, order + 1), 1 / (order + 1))
    for b in known:
        out[b] = np.maximum(out[b], [1e-6] + [0] * order)
        out[b] /= out[b].sum()
    for b in range(64):
        out[b] = out[max((k for k in known if k <= b), default=known[0])]
    if order > 1:
        out[0, order] = 0
        out[0] /= out[0].sum()
    return out


def scored(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 2,
    held_part: int = 10,
    batch_bytes: int = 10_000_000,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs; learnt from those where train holds.

    Counts of all n-grams up to order are gathered over the whole corpus. One in held_part of the training documents (by a
    hash of the id) is deleted from the counts to learn how to mix them, by the frequency of the context; the scores then
    use the counts with them. Texts are lower-cased (A-Z) and split at white space; a null text is empty and has one token,
    its end. Repeated rows count and are scored as often as they stand; a null train is false; without training rows all frequencies are 0.

    Documents are dealt, compressed, into batches of about batch_bytes by a hash of id and text, the deleted ones into batches of their own, so that learning
    the mixture reads no others. A batch sends its distinct n-grams, packed, to the hash range that counts them, and gets
    the counts back in the same order, so a frequent n-gram costs each batch one entry. The number of ranges follows that of
    batches, which bounds what a range holds; the less two of them share, the more a message's own few bytes weigh.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("flag"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(total / batch_bytes))
    lead = max(0, math.ceil(math.log2(2 * n)))
    held = F.col("flag") & (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(held_part)) == 0)
    # Batches from n on hold the deleted documents.
    spread = F.xxhash64("doc_id", "text", F.lit("batch"))
    batch_of = F.when(held, n + F.pmod(spread, F.lit(math.ceil(n / held_part)))).otherwise(F.pmod(spread, F.lit(n))).cast("int")
    dealt = rows.withColumn("batch", batch_of)
    held_batch = F.col("batch") >= n

    def cut(hashes: np.ndarray) -> np.ndarray:
        """Where the hash ranges begin in sorted hashes, and their end."""
        if not lead:
            return np.array([0, len(hashes)])
        part = hashes >> np.uint64(64 - lead)
        return np.searchsorted(part, np.arange((1 << lead) + 1, dtype=np.uint64))

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        batch, out = Batch(pdf, order), []
        for k, (hashes, inverse) in enumerate(batch.kinds):
            trained = np.bincount(inverse, batch.weight, len(hashes)).astype(np.uint32)
            at = cut(hashes)
            for p in np.flatnonzero(np.diff(at)):
                s = slice(at[p], at[p + 1])
                out.append((int(p), int(pdf["batch"].iloc[0]), k, packed(hashes[s], lead, kept_bits(k, lead)), squeezed(trained[s])))
        return pd.DataFrame(out, columns=["part", "batch", "kind", "hashes", "trained"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, same in pdf.groupby("kind"):
            lists = [np.cumsum(expanded(x, np.uint64), dtype=np.uint64) for x in same["hashes"]]
            size = np.array([len(x) for x in lists])
            found, inverse = distinct(np.concatenate(lists))
            sent = np.concatenate([expanded(x, np.uint32) for x in same["trained"]])
            own = np.repeat(same["batch"].to_numpy() >= n, size)
            sums = [np.bincount(inverse, x, len(found)).astype(np.int64) for x in (sent, np.where(own, sent, 0))]
            ends = np.cumsum(size)
            for b, lo, hi in zip(same["batch"], ends - size, ends, strict=True):
                got = [squeezed(s[inverse[lo:hi]].astype(np.uint32)) for s in (sums if b >= n else sums[:1])]
                out.append((b, int(pdf["part"].iloc[0]), k, got[0], got[1] if b >= n else b"", 0, 0, 0))
            if k == 0:
                out.append((-1, int(pdf["part"].iloc[0]), k, b"", b"", int((sums[0] > 0).sum()), int(sums[0].sum()), int(sums[1].sum())))
        return pd.DataFrame(out, columns=["batch", "part", "kind", "trained", "deleted", "types", "tokens", "deleted_tokens"])

    counts = stored(
        in_batches(dealt)
        .groupBy("batch")
        .applyInPandas(send, "part int, batch int, kind int, hashes binary, trained binary")
        .groupBy("part")
        .applyInPandas(count, "batch int, part int, kind int, trained binary, deleted binary, types long, tokens long, deleted_tokens long")
    )
    types, all_tokens, deleted_tokens = (x or 0 for x in counts.where("batch < 0").agg(F.sum("types"), F.sum("tokens"), F.sum("deleted_tokens")).first())
    texts, deleted_texts = (x or 0 for x in dealt.agg(F.count_if("flag"), F.count_if(held_batch)).first())
    answers = counts.where("batch >= 0").select("batch", "part", "kind", "trained", "deleted")

    def received(got: pd.DataFrame, column: str) -> list[np.ndarray]:
        got = got.sort_values(["kind", "part"])
        return [np.concatenate([np.empty(0, np.uint32), *(expanded(x, np.uint32) for x in got.loc[got["kind"] == k, column])]).astype(np.int64) for k in range(order)]

    def count_held(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", *(f"q{k + 1}" for k in range(order))]
        if not len(pdf):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in [*names, "n"]})
        batch = Batch(pdf, order)
        kept = [t - d for t, d in zip(received(got, "trained"), received(got, "deleted"), strict=True)]
        p, context = batch.probabilities(kept, all_tokens - deleted_tokens, texts - deleted_texts)
        with np.errstate(divide="ignore"):
            q = np.minimum(np.rint(-grid(order) * np.log2(p)), LAST).astype(np.int64)
        cells = pd.DataFrame(np.vstack([bucket_of(context), q]).T, columns=names).assign(n=np.repeat(batch.times, np.diff(batch.starts)))
        return cells.groupby(names, as_index=False)["n"].sum()

    keys = ", ".join(f"q{k + 1} long" for k in range(order))
    hist = stored(
        in_batches(dealt.where(held_batch))
        .groupBy("batch")
        .cogroup(answers.where(held_batch).groupBy("batch"))
        .applyInPandas(count_held, f"bucket long, {keys}, n long")
        .groupBy("bucket", *(f"q{k + 1}" for k in range(order)))
        .agg(F.sum("n").alias("n"))
    )
    weights = mixture_weights(hist, order, types)

    def score(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in ("doc_id", "n_tokens", "n_known", "base_score", "score")})
        batch, trained = Batch(pdf, order), received(got, "trained")
        p, context = batch.probabilities(trained, all_tokens, texts)
        w = weights[bucket_of(context)].T
        model = np.log10(w[0] / (types + 1) + (w[1:] * p).sum(axis=0))
        c = trained[0][batch.kinds[0][1]]
        base = np.log10((c + 0.5) / (all_tokens + 0.5 * (types + 1)))
        add = lambda x: np.add.reduceat(x, batch.starts[:-1])
        out = pd.DataFrame({"doc_id": batch.ids, "n_tokens": np.diff(batch.starts), "n_known": add((c > 0).astype(np.int64)), "base_score": add(base), "score": add(model)})
        return out.loc[np.repeat(np.arange(len(out)), batch.times)]

    return (
        in_batches(dealt)
        .groupBy("batch")
        .cogroup(answers.drop("deleted").groupBy("batch"))
        .applyInPandas(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
        .select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_tokens", "n_known", F.lit(all_tokens).cast("long").alias("train_tokens"), "base_score", "score")
    )

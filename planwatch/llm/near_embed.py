"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, local_components, meetings, modest, runs, stored, unpartitioned

#: Added to bounds for what single precision rounds off.
SLACK = 1e-4


def rotation(dim: int, k: int, seed: int = 7) -> np.ndarray:
    """The k-th random orthogonal matrix of so many dimensions."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, k]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(n: int, least: float, recall: float, bucket: int) -> tuple[int, int]:
    """(bits a band, bands) so that buckets hold about bucket of n vectors and a pair at the cosine least meets with chance recall.

    With no more than bucket vectors, or where recall is 1, one band of no bits holds them all, and no pair is lost.
    """
    bits = min(24, max(0, math.ceil(math.log2(max(n, 1) / bucket))))
    if not bits or recall >= 1:
        return 0, 1
    same = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def encode(x: np.ndarray, bits: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors x: int8 codes of the first rotation, whose signs are the binary codes; the binary codes' correction
    factors <signs / sqrt(dim), rotated vector>; the length of what the int8 codes miss; and the bits of all bands, from the
    signs of as many rotations as they need.

    The int8 code k stands for the direction of 2 * k + 1, so no component is without a sign.
    """
    dim = x.shape[1]
    first, signs = x @ rotation(dim, 0), []
    for k in range(max(1, math.ceil(bits * bands / dim))):
        signs.append((first if k == 0 else x @ rotation(dim, k)) > 0)
    scale = np.abs(first).max(axis=1, keepdims=True)
    code = np.clip(np.floor(first / scale * 128), -128, 127).astype(np.int8)
    inner = np.einsum("ij,ij->i", direction(code).astype(np.float64), first)
    missed = np.sqrt(np.maximum(1 - inner * inner, 0)) + 1e-6
    return code, np.abs(first).sum(axis=1) / math.sqrt(dim), missed, np.concatenate(signs, axis=1)[:, : bits * bands]


def direction(code: np.ndarray) -> np.ndarray:
    """The unit vectors that int8 codes stand for."""
    out = code.astype(np.float32) * np.float32(2) + np.float32(1)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def thresholds(factor: np.ndarray, missed: float, least: float, dim: int, eps: float) -> np.ndarray:
    """What <signs / sqrt(dim), other> must be at least, for each binary code, if the inner product may be least.

    other is the direction of the other's int8 code, which misses at most missed of it. <signs / sqrt(dim), q> / factor estimates <o, q>
    without bias over rotations; its confidence interval has half the width eps * sqrt((1 - factor^2) / factor^2 / (dim - 1)).
    By the triangle inequality of angles o and q are also never nearer than the angle of q and the code less that of o and the code.
    The sharper of both counts.
    """
    f = np.clip(factor, 1e-6, 1)
    sure = np.cos(np.minimum(np.arccos(f) + math.acos(max(-1.0, min(1.0, least - missed))), math.pi))
    likely = f * (least - missed) - eps * np.sqrt(1 - f * f) / math.sqrt(max(dim - 1, 1))
    return np.maximum(sure, likely) - SLACK


def near(
    vectors: DataFrame,
    id_col: str,
    vec_col: str,
    least: float = 0.9,
    recall: float = 0.9999,
    eps: float = 6.0,
    bucket: int = 4096,
    block: int = 16384,
) -> DataFrame:
    """id, n_links long, component long: links of cosine >= least between vectors, in double precision.

    Vectors that agree on one of the bands of sign bits meet in a bucket (plan() sets how many bands a pair at least needs to
    meet with chance recall; nearer ones meet surer; recall=1 makes all vectors meet, in blocks). There the binary codes' estimates and
    bounds leave few pairs; the int8 codes' error bound decides most of these, and the pairs it can't decide are recomputed
    from the vectors themselves. A pair counts in the first band it meets in. Equal vectors are one node, compared once and
    weighted; buckets of over block nodes are cut into pieces that meet pairwise.

    n_links counts a row's links to other rows; component is the least id that links reach, the row's own included. Null, empty
    and zero vectors and those with null or non-finite components
    link with nothing; vectors of different lengths don't meet. A repeated id is as many vectors as rows, each with its own
    links. A row with a null id is a vector like any other; it names no component, and its own is null if no id is in reach.
    An empty table gives no rows. Other columns are not looked at.
    """
    rows = modest(vectors).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    sound = F.coalesce(
        F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)
    )
    # Equal vectors are known by 128 bits of hash.
    hashed = rows.select("id", F.when(sound, F.col("v")).alias("v")).select("id", "v", *[F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(k), "v")).alias(f"h{k}") for k in (1, 2)])
    grouped = hashed.where("v is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("v").alias("v"), F.count("*").alias("mult"))
    nodes = stored(grouped.withColumn("node", F.monotonically_increasing_id()))
    bits, bands = plan(nodes.count(), least, recall, bucket)
    fields = "node long, mult long, dim int, code binary, factor float, missed float, signs binary"

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, same in pdf.groupby(pdf["v"].map(len), sort=False):
                for at in range(0, len(same), 2000):
                    part = same.iloc[at : at + 2000]
                    x = np.stack(part["v"].to_numpy()).astype(np.float64)
                    unit = x / np.abs(x).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    code, factor, missed, signs = encode(unit, bits, bands)
                    keys = signs.reshape(len(x), bands, bits) @ (1 << np.arange(bits)) if bits else np.zeros((len(x), 1), np.int64)
                    yield pd.DataFrame(
                        {
                            "node": part["node"].to_numpy(), "mult": part["mult"].to_numpy(), "dim": dim, "code": [c.tobytes() for c in code], "factor": factor, "missed": missed,
                            "signs": [b.tobytes() for b in np.packbits(signs, axis=1)], "keys": list(keys.astype(np.int32)),
                        }
                    )

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(frames, "bucket", 5_000):
            got = []
            k = pdf["bucket"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1:
                    part = pdf.iloc[lo:hi]
                    # Buckets are hashes: two could meet in one.
                    for _, same in part.groupby(["dim", "band"]) if part["dim"].nunique() > 1 or part["band"].nunique() > 1 else [(0, part)]:
                        got += linked(same)
            if got:
                yield pd.concat(got, ignore_index=True)

    def linked(part: pd.DataFrame) -> list[pd.DataFrame]:
        """Nodes with their links and the first node that these reach (links 0 or more), and pairs left open (links -1)."""
        dim, band, side, m = int(part["dim"].iloc[0]), int(part["band"].iloc[0]), part["side"].to_numpy(), len(part)
        code = np.frombuffer(b"".join(part["code"]), np.int8).reshape(m, dim)
        other = direction(code)
        binary = np.where(code < 0, np.float32(-1), np.float32(1)) / np.float32(math.sqrt(dim))
        signs = np.unpackbits(np.frombuffer(b"".join(part["signs"]), np.uint8).reshape(m, -1), axis=1, count=bits * bands).reshape(m, bands, bits)
        node, mult, missed = (part[c].to_numpy() for c in ("node", "mult", "missed"))
        wanted = thresholds(part["factor"].to_numpy().astype(np.float64), float(missed.max()), least, dim, eps).astype(np.float32)
        deg, lab, open_a, open_b = np.zeros(m, np.int64), np.arange(m), [], []
        for lo in range(0, m, 256):
            may = binary[lo : lo + 256] @ other[lo:].T >= wanted[lo : lo + 256, None]
            i, j = np.nonzero(np.triu(may, 1))
            i, j = i + lo, j + lo
            meet = (side[i] < 0) | (side[i] != side[j])
            i, j = i[meet], j[meet]
            for at in range(0, len(i), 100_000):
                a, b = i[at : at + 100_000], j[at : at + 100_000]
                inner = np.einsum("ij,ij->i", other[a], other[b])
                off = missed[a] + missed[b] + (missed[a] + missed[b]) ** 2 / 2 + SLACK  # what the codes miss, times each other and the product's own share
                low = inner - off
                near_ = inner + off >= least
                first = ~(signs[a, :band] == signs[b, :band]).all(axis=2).any(axis=1)
                yes, unsure = low >= least, near_ & (low < least) & first
                lab = local_components(lab, a[yes], b[yes])
                new = yes & first
                np.add.at(deg, a[new], mult[b[new]])
                np.add.at(deg, b[new], mult[a[new]])
                open_a.append(node[a[unsure]])
                open_b.append(node[b[unsure]])
        on = (deg > 0) | (lab != np.arange(m))
        out = [pd.DataFrame({"a": node[on], "b": node[lab[on]], "links": deg[on]})]
        if open_a:
            out.append(pd.DataFrame({"a": np.concatenate(open_a), "b": np.concatenate(open_b), "links": -1}))
        return [x for x in out if len(x)]

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            hit = np.zeros(len(pdf), bool)
            for k, (x, y) in enumerate(zip(pdf["x"], pdf["y"], strict=True)):
                x, y = (v.astype(np.float64) / np.abs(v).max() for v in (x, y))
                hit[k] = x @ y / math.sqrt((x @ x) * (y @ y)) >= least
            yield pdf.loc[hit, ["a", "b", "mult_a", "mult_b"]]

    codes = stored(nodes.select("node", "mult", "v").mapInPandas(coded, fields + ", keys array<int>"))
    banded = codes.select(*codes.columns[:-1], F.posexplode("keys").alias("band", "key"))
    cut = meetings(banded, ["dim", "band", "key"], "node", block, codes.select("dim", F.posexplode("keys").alias("band", "key"))).drop("key")
    found = stored(cut.mapInPandas(compare, "a long, b long, links long"))
    of = lambda c, v: nodes.select(F.col("node").alias(c), F.col("v").alias(v), F.col("mult").alias(f"mult_{c}"))
    open_pairs = unpartitioned(found.where("links < 0").select("a", "b"))
    pairs = stored(open_pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").mapInPandas(exact, "a long, b long, mult_a long, mult_b long"))
    each = found.where("links >= 0").select(F.col("a").alias("node"), "links")
    for a, b in (("a", "b"), ("b", "a")):
        each = each.union(pairs.select(a, f"mult_{b}"))
    degree = each.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.where("links >= 0").select("a", "b").union(pairs.select("a", "b"))).select(F.col("node").alias("of"), F.col("component").alias("top"))
    named = nodes.select("h1", "h2", "node", "rep", "mult").join(comp, F.col("node") == F.col("of"), "left").withColumn("top", F.coalesce("top", "node"))
    least_id = named.groupBy("top").agg(F.min("rep").alias("component"))
    named = named.join(degree, "node", "left").join(unpartitioned(least_id), "top").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component")
    return hashed.select("id", "h1", "h2").join(unpartitioned(named), ["h1", "h2"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component")).alias("component")
    )

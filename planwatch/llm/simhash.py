"""SimHash near-duplicate groups by bit-sliced comparison."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, components, dealt, local_components, meetings, modest, runs, small, stored, unpartitioned

#: Odd multipliers that extend a shingle's 64-bit hash to further words of a wide fingerprint.
GOLDEN = 0x9E3779B97F4A7C15
#: Slots in which shingles are counted, and slots to a row.
SLOTS, SLICE = 1 << 20, 1 << 14
#: Hashes that are sorted at a time where sets are compared.
PART = 1 << 20


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle of the text, A-Z lower-cased, repeats included."""
    w = (text or "").encode().lower().split()
    if len(w) > n:
        parts: Iterator[bytes] = map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False))
        return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(w) - n + 1)
    return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], np.uint64)


def fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """Majority bits over the hashes h, as so many uint64; zero if there are none."""
    out = np.zeros(words, np.uint64)
    for k in range(words if len(h) else 0):
        g = h
        if k:
            g = (h ^ (h >> np.uint64(29))) * np.uint64((GOLDEN * (2 * k + 1)) % 2**64)
            g = (g ^ (g >> np.uint64(32))) * np.uint64(GOLDEN)
            g ^= g >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for i in range(0, len(g), 1 << 15):
            bits = np.unpackbits(g[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint32)
        out[k] = np.packbits(2 * ones > len(g), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int, distinct: bool) -> DataFrame:
    """id, fp array<long>: one row per row of docs. A null text counts as empty, with fingerprint zero.

    distinct: each different shingle of a text counts once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fps = []
            for text in pdf["text"]:
                h = shingle_hashes(text, shingle)
                fps.append(fingerprint(np.unique(h) if distinct else h, words).view(np.int64))
            yield pd.DataFrame({"id": pdf["id"], "fp": fps})

    return modest(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, "id long, fp array<long>"
    )


def joined(planes: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row that links of at most radius differing bits reach within its bucket.

    planes: uint8 [bits, rows], a bit plane a row; rows of a bucket stand together. The planes are packed into words of
    64 lanes, and row i is held against row i + d for all i at once: each plane's differences to the plane moved
    by d lanes go into carry-save counters, biased so that the carry out of the top one says that the radius is exceeded. Words
    all of whose lanes exceed it, are joined already or have no partner are abandoned.
    side: where rows have different non-negative sides, only they meet (pairs within a side meet elsewhere).
    """
    bits, n = planes.shape
    top = max(1, math.ceil(math.log2(radius + 1)))
    bias = 2**top - 1 - radius
    full = np.uint64(2**64 - 1)
    words = -(-n // 64)
    packed = np.zeros((bits, 8 * (words + 1)), np.uint8)
    packed[:, : -(-n // 8)] = np.packbits(planes, axis=1, bitorder="little")
    packed = packed.view(np.uint64)
    lab = np.arange(n)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, n])
    room = np.repeat(first + size, size) - np.arange(n)
    sided, d = (side >= 0).any(), 0
    while d + 1 < room.max(initial=0):
        d += 1
        ok = (room[:-d] > d) & (lab[:-d] != lab[d:])
        if sided:
            ok &= (side[:-d] < 0) | (side[:-d] != side[d:])
        mask = np.zeros(8 * words, np.uint8)
        mask[: -(-len(ok) // 8)] = np.packbits(ok, bitorder="little")
        mask = mask.view(np.uint64)
        live = np.flatnonzero(mask)
        over = ~mask[live]
        count = [np.full(len(live), full if bias >> k & 1 else np.uint64(0)) for k in range(top)]
        jump, shift = d // 64, np.uint64(d % 64)
        for p in range(0, bits, 16):
            if not len(live):
                break
            part = packed[p : p + 16]
            near = part[:, np.minimum(live + jump, words)]
            if shift:
                near = near >> shift | part[:, np.minimum(live + jump + 1, words)] << (np.uint64(64) - shift)
            diff = part[:, live] ^ near
            for q in range(0, len(diff) - 1, 2):  # a full adder takes two planes at a time
                half, one = diff[q] ^ diff[q + 1], count[0]
                carry = (diff[q] & diff[q + 1]) | (half & one)
                count[0] = half ^ one
                for k in range(1, top):
                    count[k], carry = count[k] ^ carry, count[k] & carry
                over |= carry
            keep = over != full
            if not keep.all():
                live, over, count = live[keep], over[keep], [c[keep] for c in count]
        if len(live):
            hit = np.unpackbits(over.view(np.uint8), bitorder="little").reshape(-1, 64) == 0
            i = (live[:, None] * 64 + np.arange(64))[hit]
            lab = local_components(lab, i, i + d)
        if d & (d - 1) == 0:  # buckets that are one set by now are done
            low, high = np.minimum.reduceat(lab, first), np.maximum.reduceat(lab, first)
            room[np.repeat(low == high, size)] = 0
    return lab


def bands(bits: int, radius: int) -> list[tuple[int, int]]:
    """Cuts the bits into radius + 1 bands: fingerprints within the radius agree on one at least."""
    cuts = [bits * i // (radius + 1) for i in range(radius + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def links(
    nodes: DataFrame, bits: int, radius: int, keys: list[tuple[int, int]], block: int = 4096
) -> DataFrame:
    """Edges (a long, b long) that join all nodes (id long, fp array<long>) linked within the radius.

    keys: bit ranges; nodes that agree on one of them meet. A bucket of more than block rows is cut
    into pieces, and each pair of pieces is a task's work of its own. Each block gives a spanning forest
    of its links, not all pairs.
    """

    def banded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            fp = np.stack(pdf["fp"].to_numpy()).astype(np.int64)
            plane = np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
            for k, (lo, hi) in enumerate(keys):
                part = np.packbits(plane[:, lo:hi], axis=1, bitorder="little")
                wide = np.zeros((len(part), 8), np.uint8)
                wide[:, : part.shape[1]] = part[:, :8]
                yield pd.DataFrame({"id": pdf["id"], "fp": pdf["fp"], "band": k, "key": wide.view(np.int64)[:, 0]})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(frames, "bucket"):
            fp = np.stack(pdf["fp"].to_numpy()).astype(np.int64)
            planes = np.ascontiguousarray(
                np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little").T
            )
            ids = pdf["id"].to_numpy()
            lab = joined(planes, pdf["bucket"].to_numpy(), pdf["side"].to_numpy(), radius)
            on = lab != np.arange(len(lab))
            if on.any():
                yield pd.DataFrame({"a": ids[on], "b": ids[lab[on]]})

    rows = nodes.mapInPandas(banded, "id long, fp array<long>, band int, key long")
    return meetings(rows, ["band", "key"], "id", block).drop("band", "key").mapInPandas(compare, "a long, b long").distinct()


def grouped(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    shingle: int = 3,
    radius: int = 2,
    words: int = 1,
    distinct: bool = False,
    keys: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """id, fp array<long>, component long: near-duplicate groups by SimHash.

    Fingerprints of 64 * words bits that differ in at most radius bits are linked; component is the
    smallest id that links reach, the row's own included. Equal fingerprints are one node, so copies aren't compared.
    keys: bit ranges on one of which linked fingerprints must agree; by default radius + 1 bands, which
    lose no link. Null and empty texts have fingerprint zero and are linked like any other; repeated
    ids get one row each; an empty table gives none. Other columns are not looked at.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle, words, distinct))
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("id")))
    found = components(links(nodes, 64 * words, radius, keys or bands(64 * words, radius)))
    named = nodes.join(found, nodes.id == found.node, "left").select(
        "fp", F.coalesce("component", "id").alias("component")
    )
    return prints.join(unpartitioned(named), "fp").select("id", "fp", "component")


def near_radius(similarity: float, bits: int, deviations: float = 2.0) -> int:
    """Differing bits of two fingerprints of distinct shingles whose Jaccard similarity is as given: the mean and so many standard deviations."""
    part = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * part + deviations * math.sqrt(bits * part * (1 - part)))


def postings(sets: list[np.ndarray], part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some sets (sorted arrays of hashes) owner, starts and run: the sets that have an element are owner[starts[r] : starts[r + 1]],
    with r from run, which numbers the elements of all sets in turn.

    Elements are sorted about part at a time, by ranges of their values, so this takes little more than its result: the bytes of the sets once again.
    """
    size = np.array([len(x) for x in sets])
    total, first = int(size.sum()), np.cumsum(size) - size
    kind = np.int32 if total < 2**31 - 1 else np.int64
    edges = np.array([(k << 64) // -(-total // part) for k in range(1, -(-total // part))], np.uint64)
    cuts = [np.r_[0, np.searchsorted(x, edges), len(x)] for x in sets] if len(edges) else [(0, k) for k in size]
    owner, run = np.empty(total, kind), np.empty(total, kind)
    starts, done, known = [], 0, 0
    for p in range(len(edges) + 1):
        some = [x[c[p] : c[p + 1]] for x, c in zip(sets, cuts, strict=True)]
        flat = np.concatenate(some)
        if not len(flat):
            continue
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        new = np.r_[True, flat[1:] != flat[:-1]]
        number = np.empty(len(flat), kind)
        number[order] = np.cumsum(new) - 1 + known
        owner[done : done + len(flat)] = np.repeat(np.arange(len(sets), dtype=kind), [len(x) for x in some])[order]
        at = 0
        for k, c in zip(first, cuts, strict=True) if len(edges) else ():
            run[k + c[p] : k + c[p + 1]] = number[at : at + c[p + 1] - c[p]]
            at += c[p + 1] - c[p]
        if not len(edges):
            run = number
        starts.append((np.flatnonzero(new) + done).astype(kind))
        done, known = done + len(flat), known + len(starts[-1])
    return owner, np.concatenate([*starts, np.array([total], kind)]), run


def alike(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> np.ndarray:
    """For each of some sets (sorted arrays) the first that links of at least the given Jaccard similarity reach.

    A set is held against all others by the lists of the sets that have each of its elements, unless all are joined by now. Empty
    sets are linked with each other alone.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    owner, starts, run = postings(sets)
    stop = np.cumsum(size)
    lab = np.arange(n)
    for i in range(n):
        if (lab == lab[0]).all():
            break
        if (lab == lab[i]).all():
            continue
        mine = run[stop[i] - size[i] : stop[i]]
        having = [owner[:0], *(owner[a:b] for a, b in zip(starts[mine], starts[mine + 1], strict=True))]
        common = np.bincount(np.concatenate(having), minlength=n)
        near = common >= similarity * (size[i] + size - common) - 1e-9
        near &= (side[i] < 0) | (side[i] != side)
        near[i] = False
        j = np.flatnonzero(near & (lab != lab[i]))
        lab = local_components(lab, np.full(len(j), i), j)
    return lab


def rarity(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """uint8 [SLOTS]: the class of how many texts have a shingle of the slot (hash modulo SLOTS), four classes to a doubling."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(SLOTS, np.int64)
        for pdf in by_size((f.fillna("") for f in frames), "text", 4_000_000):
            h = np.concatenate([np.unique(shingle_hashes(t, shingle)) for t in pdf["text"]])
            n += np.bincount((h % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        for k in np.unique(np.flatnonzero(n) // SLICE):
            yield pd.DataFrame({"slice": [k], "n": [zlib.compress(n[k * SLICE : (k + 1) * SLICE].tobytes(), 1)]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in frames:
            for k, n in zip(pdf["slice"], pdf["n"], strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(n), np.int64)
        for k, n in total.items():
            yield pd.DataFrame({"slice": [k], "n": [np.ceil(4 * np.log2(1 + n)).astype(np.uint8).tobytes()]})

    out = np.zeros(SLOTS, np.uint8)
    found = dealt(docs.select(F.col(text_col).alias("text")).mapInPandas(count, "slice int, n binary"), "slice")
    for r in found.mapInPandas(add, "slice int, n binary").collect():  # SLOTS bytes in all
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["n"], np.uint8)
    return out


def prefix(h: np.ndarray, rare: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest of the different hashes h, so many that sets of at least the Jaccard similarity have one of them in common."""
    order = np.lexsort((h, rare[(h % np.uint64(SLOTS)).astype(np.int64)]))
    return h[order[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]]


def crossing(docs: DataFrame, id_col: str, text_col: str, named: DataFrame, shingle: int, similarity: float, block: int) -> DataFrame:
    """Edges (a long, b long) between components of named (node long, component long) that have nodes of at least the Jaccard similarity.

    None is lost: in one order of all shingles, such sets have one of their first shingles in common, and what follows its first
    common place is enough for the overlap. The order is rare ones first; shingles that stand in one component alone make no pairs.
    """
    rare = rarity(docs, text_col, shingle)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_size((f.assign(text=f["text"].fillna("")) for f in frames), "text", 4_000_000):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in pdf["text"]]
            heads = [prefix(h, rare, similarity) if len(h) else h for h in sets]
            n = [len(x) for x in heads]
            yield pd.DataFrame(
                {
                    "node": np.repeat(pdf["node"].to_numpy(), n),
                    "component": np.repeat(pdf["component"].to_numpy(), n),
                    "size": np.repeat([len(h) for h in sets], n),
                    "place": np.concatenate([np.arange(k) for k in n]),
                    "hash": np.concatenate(heads).view(np.int64),
                }
            )

    def pair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(frames, "bucket", 5000):
            got, held = [], 0
            cols = [pdf[c].to_numpy() for c in ("node", "component", "size", "place", "side")]
            edge = np.flatnonzero(np.diff(pdf["bucket"].to_numpy())) + 1
            for lo, hi in zip(np.r_[0, edge], np.r_[edge, len(pdf)], strict=True):
                node, comp, size, place, side = (c[lo:hi] for c in cols)
                for i in range(len(node) - 1):
                    j = slice(i + 1, None)
                    rest = np.minimum(size[i] - place[i], size[j] - place[j])
                    on = (comp[j] != comp[i]) & ((side[i] < 0) | (side[j] != side[i]))
                    on &= (1 + similarity) * rest >= similarity * (size[i] + size[j]) - 1e-9
                    k = np.flatnonzero(on) + i + 1
                    if len(k):
                        got.append(np.c_[np.minimum(node[i], node[k]), np.maximum(node[i], node[k])])
                        held += len(k)
                    if held > 200_000:
                        yield pd.DataFrame(np.concatenate(got), columns=["a", "b"]).drop_duplicates()
                        got, held = [], 0
            if got:
                yield pd.DataFrame(np.concatenate(got), columns=["a", "b"]).drop_duplicates()

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(hashes=[np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in pdf["text"]]).drop(columns="text")

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).where("node is not null")
    of_texts = small(stored(unpartitioned(named)), 1_000_000)
    rows = stored(texts.join(of_texts, "node").select("node", "component", "text").mapInPandas(first, "node long, component long, size int, place int, hash long"))
    mixed = stored(rows.groupBy("hash").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("hash"))
    met = stored(rows.join(small(mixed, 1_000_000), "hash"))
    pairs = stored(meetings(met, ["hash"], "node", block).drop("hash").mapInPandas(pair, "a long, b long").distinct())
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = stored(texts.join(unpartitioned(wanted), "node", "left_semi").mapInPandas(hashed, "node long, hashes array<long>"))
    both = (
        unpartitioned(pairs)
        .join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    )
    # The sets meet row by row in the JVM: no task holds more than one pair of them.
    common = F.size(F.array_intersect("x", "y"))
    linked = stored(both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"))
    of = lambda c: unpartitioned(named.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")))
    return linked.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8, recall: float = 0.95, block: int = 1024) -> DataFrame:
    """id, component long: groups of documents linked by sharing at least similarity of their distinct shingles (Jaccard).

    Most links are first found by wide fingerprints, whose number of bits follows the number of documents: a band has bits
    enough for small buckets, and there are bands enough that a long pair at the similarity agrees on one with chance recall. Within
    such a group the shingles themselves decide. Links that the fingerprints miss are then found between the components so far by
    crossing(), which loses none. Equal fingerprints are one document. Nulls, empties, repeated ids (which
    share a component) and empty tables are as in grouped().
    """
    n = modest(docs).count()
    part = math.acos(2 * similarity / (1 + similarity)) / math.pi
    width = max(12, math.ceil(math.log2(max(n, 1) / 64)))
    count = math.ceil(math.log(1 - recall) / math.log(1 - (1 - part) ** width))
    words = math.ceil(count * width / 64)
    keys = [(k * width, (k + 1) * width) for k in range(64 * words // width)]
    rough = stored(grouped(docs, id_col, text_col, shingle, near_radius(similarity, 64 * words), words, True, keys))
    nodes = rough.groupBy("fp").agg(F.min("id").alias("node"), F.min("component").alias("rough"))
    wide = nodes.groupBy("rough").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rough").alias("of"))
    members = stored(nodes.join(unpartitioned(wide), F.col("rough") == F.col("of")).select("node", "rough"))

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "rough": pdf["rough"], "hashes": sets})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(frames, "bucket", 500):
            got = []
            for _, part in pdf.groupby("bucket"):
                if len(part) > 1:
                    lab = alike([np.frombuffer(x, np.uint64) for x in part["hashes"]], part["side"].to_numpy(), similarity)
                    ids = part["node"].to_numpy()
                    got.append(pd.DataFrame({"a": ids, "b": ids[lab]})[lab != np.arange(len(lab))])
            if got:
                yield pd.concat(got)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(members, F.col("id") == F.col("node"))
    sets = texts.dropDuplicates(["node"]).select("node", "rough", "text").mapInPandas(hashed, "node long, rough long, hashes binary")
    # Stored, so that comparing and joining up have no Python workers at the same time in one task.
    found = components(stored(meetings(sets, ["rough"], "node", block, members).drop("rough").mapInPandas(compare, "a long, b long")))
    fast = stored(nodes.join(found, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("component")))
    more = components(crossing(docs, id_col, text_col, fast.select("node", "component").where("node is not null").distinct(), shingle, similarity, block))
    named = fast.join(more.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select("fp", F.coalesce("whole", "component").alias("exact"))
    return rough.join(unpartitioned(named), "fp").select("id", F.col("exact").alias("component"))

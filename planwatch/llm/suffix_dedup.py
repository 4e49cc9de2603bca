"""Removal of repeated long strings by suffix arrays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, from_batch, in_batches, stored, unpartitioned

#: Bytes of the grams whose least hash in a window names it: long enough that ordinary words and phrases don't repeat one.
GRAM = 48
TOP = np.uint64(2**64 - 1)


# ---- suffix arrays ----


def suffix_array(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of pieces laid end to end, and each place's rank, by Larsson and Sadakane's refinement.

    ends: where each place's piece ends. A suffix stops at its piece's end, where an own sign stands that is less than every byte and
    ordered by piece, so no two suffixes are equal. Groups of suffixes that agree on h signs are refined by the ranks h
    places on; groups of one are left alone.
    """
    n = len(text)
    at = np.arange(n, dtype=np.int32)
    key = np.zeros(n, np.uint64)
    padded = np.append(text, np.zeros(4, np.uint8)).astype(np.uint64)
    for k in range(4):
        key = key << np.uint64(9) | np.where(at + k < ends, padded[k : k + n] + np.uint64(1), np.uint64(0))
    key = key << np.uint64(28) | np.where(at + 4 > ends, ends, 0).astype(np.uint64)
    order = np.argsort(key).astype(np.int32)
    same = key[order]
    head = np.r_[True, same[1:] != same[:-1]] if n else np.empty(0, bool)
    del key, same, padded
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    h = 4
    while True:
        grouped = ~(head & np.r_[head[1:], True]) if n else head
        where = np.flatnonzero(grouped)
        if not len(where):
            return order, rank
        part = order[where]
        on = part + h
        inside = on < ends[part]
        # At its end a suffix meets its own sign; further on it can't be in a group.
        follow = np.where(inside, rank[np.minimum(on, n - 1)] + np.int64(n), ends[part] - 1)
        key = rank[part] * np.int64(2 * n) + follow
        sort = np.argsort(key)
        part, key = part[sort], key[sort]
        order[where] = part
        new = np.r_[True, key[1:] != key[:-1]]
        head[where] = new
        rank[part] = np.maximum.accumulate(np.where(new, where, 0))
        h *= 2


def common_prefixes(text: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai's common prefixes of each suffix in order with the one before it.

    By Kasai's rule the value at a place is that at the place before less one if the sign before both suffixes is the same;
    so only the other places' are counted, sign by sign for all at once.
    """
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int32)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    at = np.arange(n, dtype=np.int32)
    starts = np.r_[True, ends[1:] != ends[:-1]]
    same = (before > 0) & ~starts & ~starts[np.maximum(before, 0)] & (text[np.maximum(at - 1, 0)] == text[np.maximum(before - 1, 0)])
    same[0] = False
    same &= np.r_[False, before[:-1] >= 0]
    free = np.flatnonzero(~same & (before >= 0))
    most = np.minimum(ends[free] - free, ends[before[free]] - before[free])
    value, live = np.zeros(len(free), np.int32), np.arange(len(free))
    while len(live):
        live = live[value[live] < most[live]]
        live = live[text[free[live] + value[live]] == text[before[free[live]] + value[live]]]
        value[live] += 1
    plcp = np.zeros(n, np.int32)
    plcp[free] = value
    last = np.maximum.accumulate(np.where(same, 0, at))
    return np.where(same, np.maximum(plcp[last] - (at - last), 0), plcp)[order]


def later_windows(pieces: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the pieces laid end to end: whether a window of length bytes starts there that also starts earlier in one of them.

    The pieces differ; piece i begins at byte starts[i] of document docs[i]; earlier is by document, then by byte.
    """
    text = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    stop = np.cumsum(size)
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
    ends = stop.astype(np.int32)[piece]
    order, _ = suffix_array(text, ends)
    lcp = common_prefixes(text, ends, order)
    linked = np.r_[lcp[1:] >= length, False] | (lcp >= length)
    at = order[linked]
    group = np.cumsum(lcp < length)[linked]
    place = starts[piece[at]] + at - (stop - size)[piece[at]]
    sort = np.lexsort((place, docs[piece[at]], group))
    flag = np.zeros(len(text), bool)
    if len(at):
        flag[at[sort][np.r_[False, group[sort][1:] == group[sort][:-1]]]] = True
    return flag


def merged(shards: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of sorted lists of different keys and their positions, for each list: which keys stand at an earlier position in another.

    Each list is merged into what there is by binary search.
    """
    keys, owner, item, place = shards[0][0], np.zeros(len(shards[0][0]), np.int64), np.arange(len(shards[0][0])), shards[0][1]
    out = [np.zeros(len(k), bool) for k, _ in shards]
    for s, (new, new_place) in enumerate(shards[1:], 1):
        at = np.searchsorted(keys, new)
        known = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == new)
        i = np.flatnonzero(known)
        a = at[i]
        late = new_place[i] > place[a]
        out[s][i[late]] = True
        for o in np.unique(owner[a[~late]]):
            mine = a[~late][owner[a[~late]] == o]
            out[o][item[mine]] = True
        owner[a[~late]], item[a[~late]], place[a[~late]] = s, i[~late], new_place[i[~late]]
        add = np.flatnonzero(~known)
        keys = np.insert(keys, at[add], new[add])
        owner, item, place = np.insert(owner, at[add], s), np.insert(item, at[add], add), np.insert(place, at[add], new_place[add])
    return out


# ---- where repeats can be ----


def gram_hashes(u: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on; places too near to the end get TOP."""
    x = np.append(u, np.zeros(GRAM, np.uint8)).astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | x[k:] << np.uint64(8 * k)
    h = x[: len(u)] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, GRAM, 8):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + x[k : len(u) + k]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h[max(0, len(u) - GRAM + 1) :] = TOP
    return h


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) of each width values in a row."""
    take, k = np.minimum if least else np.maximum, 1
    while 2 * k <= width:
        x = take(x[:-k], x[k:])
        k *= 2
    return take(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


class Windows:
    """The windows of length bytes of some documents, each named by the least hash of its grams."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, span = length, length - GRAM + 1
        self.text = b"".join(texts)
        self.starts = np.cumsum([0, *map(len, texts)])
        n = len(self.text)
        self.grams = gram_hashes(np.frombuffer(self.text, np.uint8))
        self.names = sliding(self.grams, span, True) if n >= length else np.empty(0, np.uint64)
        self.names = np.append(self.names[: max(0, n - length + 1)], np.full(min(n, length - 1), TOP))
        self.sound = np.zeros(n + 1, np.int8)
        for a, b in zip(self.starts[:-1], self.starts[1:], strict=True):
            if b - a >= length:
                self.sound[a] += 1
                self.sound[b - length + 1] -= 1
        self.sound = np.cumsum(self.sound, dtype=np.int8)[:n] > 0

    def anchors(self) -> np.ndarray:
        """Hashes of all grams that name a window."""
        span = self.length - GRAM + 1
        if not self.sound.any():
            return np.empty(0, np.uint64)
        most = sliding(np.append(np.zeros(span - 1, np.uint64), np.where(self.sound, self.names, 0)), span, False)
        return self.grams[(self.grams == most) & (most > 0)]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of neighbouring windows of the same name: first windows, ends, names."""
        if not len(self.sound):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        change = np.r_[True, (self.names[1:] != self.names[:-1]) | (self.sound[1:] != self.sound[:-1])]
        change[self.starts[:-1][self.starts[:-1] < len(change)]] = True
        a = np.flatnonzero(change)
        b = np.r_[a[1:], len(change)]
        keep = self.sound[a]
        return a[keep], b[keep], self.names[a[keep]]


class Batch:
    """A batch of documents in order, from blobs, cut into pieces that fit a processor's cache; copies of other texts left out."""

    def __init__(self, pdf: pd.DataFrame, notes: pd.DataFrame, length: int, piece_bytes: int = 1_000_000):
        self.ids, self.raw, _, self.times = from_batch(pdf)
        self.length = length
        copies: dict[int, set[bytes]] = {}
        for i, mark in notes.loc[notes["kind"] == 0, ["doc_id", "marks"]].itertuples(index=False):
            copies.setdefault(int(i), set()).add(bytes(mark))
        self.copy = [i in copies and hashlib.sha256(r).digest() in copies[i] for i, r in zip(self.ids, self.raw, strict=True)]
        self.pieces: list[list[int]] = [[]]
        size = 0
        for k, raw in enumerate(self.raw):
            if not self.copy[k]:
                self.pieces[-1].append(k)
                size += len(raw)
                if size >= piece_bytes:
                    self.pieces.append([])
                    size = 0

    def windows(self) -> Iterator[tuple[list[int], Windows]]:
        for rows in self.pieces:
            if rows:
                yield rows, Windows([self.raw[k] for k in rows], self.length)

    def regions(self, known: np.ndarray, marks: np.ndarray) -> tuple[dict[bytes, int], list[list[tuple[int, int]]], list[int], list[int]]:
        """The different texts of runs of windows whose name is known, numbered; where each stands, as (row, byte), in order;
        its name, and the name's mark less 1."""
        number: dict[bytes, int] = {}
        places: list[list[tuple[int, int]]] = []
        names: list[int] = []
        often: list[int] = []
        if not len(known):
            return number, places, names, often
        for rows, w in self.windows():
            a, b, name = w.runs()
            at = np.minimum(np.searchsorted(known, name), len(known) - 1)
            hit = known[at] == name
            a, b, at, name = a[hit], b[hit], at[hit], name[hit]
            row = np.searchsorted(w.starts, a, side="right") - 1
            for i, j, r, x, k in zip(a.tolist(), b.tolist(), row.tolist(), name.tolist(), at.tolist(), strict=True):
                n = number.setdefault(w.text[i : j + self.length - 1], len(number))
                if n == len(places):
                    places.append([])
                    names.append(x)
                    often.append(int(marks[k]) - 1)
                places[n].append((rows[r], i - int(w.starts[r])))
        return number, places, names, often


NOTE = "batch int, kind int, doc_id long, part int, marks binary, item binary, place binary, width binary"


def packed_notes(batch: np.ndarray, item: np.ndarray, place: np.ndarray, width: np.ndarray) -> pd.DataFrame:
    """Notes of kind 2, one for each batch: of its texts item, width windows from place on start earlier elsewhere."""
    order = np.argsort(batch, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(batch[order]) != 0]) if len(order) else order
    return pd.DataFrame(
        [
            (int(batch[k[0]]), 2, None, None, None, *(x[k].astype(np.uint32).tobytes() for x in (item, place, width)))
            for k in np.split(order, cuts[1:])
            if len(k)
        ],
        columns=[x.split()[0] for x in NOTE.split(", ")],
    )


def window_hashes(windows: np.ndarray) -> np.ndarray:
    """A hash of each row of a table of bytes."""
    wide = np.zeros((len(windows), -(-windows.shape[1] // 8) * 8), np.uint8)
    wide[:, : windows.shape[1]] = windows
    h = np.zeros(len(windows), np.uint64)
    for word in wide.view(np.uint64).T:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(24)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, batch_bytes: int = 6_000_000, frequent: int = 4096, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept binary if with_text) for each row of docs.

    Removed is each byte of a text (UTF-8, null: empty) that is covered by a string of length bytes that also starts
    earlier: in a document of smaller id, or further ahead in the same one. Copies of a whole text are all removed but the
    first; rows of equal id and text share their result; a null id is less than any other. A text shorter than length keeps everything; an empty table gives no rows.

    A window of length bytes is named by the least hash of its grams, so equal windows have equal names, and only windows
    whose name stands at two places can be repeated. Their runs go, each different text once a batch, to the shard of
    their name. A shard sorts the suffixes of its texts and finds equal windows by common prefixes. Runs of a name that
    stands at more than frequent places are dealt to as many shards as that takes, by batch; the shards' first windows, dealt
    anew by their hash, are then merged by binary search.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(total / batch_bytes))
    # A shard's suffix arrays take some hundred bytes a byte of text, so shards are smaller than batches.
    parts = 1 << max(0, math.ceil(math.log2(8 * n)))
    most_salts = math.ceil(math.log2(n))
    shift = np.uint64(64 - int(math.log2(parts)))
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text", F.lit("batch")), F.lit(n)).cast("int")).withColumn("flag", F.lit(False))
    # Copies of whole texts are known by their SHA-256 alone.
    keys = stored(dealt.where(F.octet_length("text") >= length).select("batch", "doc_id", F.sha2("text", 256).alias("h")))
    first = keys.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("k"), "first")
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("item", "binary"), ("place", "binary"), ("width", "binary"))]
    copies = stored(
        keys.join(unpartitioned(first), F.col("h") == F.col("k"))
        .where("doc_id > first")
        .select("batch", F.lit(0).alias("kind"), "doc_id", F.lit(None).cast("int").alias("part"), F.unhex("h").alias("marks"), *blank)
        .distinct()
    )

    def cut(hashes: np.ndarray) -> np.ndarray:
        if parts == 1:
            return np.array([0, len(hashes)])
        return np.concatenate([[0], np.searchsorted(hashes, np.arange(1, parts, dtype=np.uint64) << shift), [len(hashes)]])

    def send_names(pdf: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf):
            got = [w.anchors() for _, w in Batch(pdf, notes, length).windows()]
            hashes, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *got]), return_counts=True)
            at = cut(hashes)
            for p in np.flatnonzero(np.diff(at)):
                s = slice(at[p], at[p + 1])
                out.append((int(p), int(pdf["batch"].iloc[0]), hashes[s].tobytes(), counts[s].astype(np.uint32).tobytes()))
        return pd.DataFrame(out, columns=["part", "batch", "hashes", "counts"])

    def mark_names(pdf: pd.DataFrame) -> pd.DataFrame:
        """Notes of kind 1, to each batch: its repeated names, each with mark 1 + k if it takes 2 ** k shards."""
        size = pdf["hashes"].map(len).to_numpy() // 8
        hashes = np.frombuffer(b"".join(pdf["hashes"]), np.uint64)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        times = np.bincount(inverse, np.frombuffer(b"".join(pdf["counts"]), np.uint32), len(distinct))
        mark = np.where(times < 2, 0, 1 + np.clip(np.ceil(np.log2(np.maximum(times, 1) / frequent)), 0, most_salts)).astype(np.uint8)
        ends, out = np.cumsum(size), []
        for b, lo, hi in zip(pdf["batch"], ends - size, ends, strict=True):
            m = mark[inverse[lo:hi]]
            if m.any():
                out.append((b, 1, None, int(pdf["part"].iloc[0]), m[m > 0].tobytes(), hashes[lo:hi][m > 0].tobytes(), None, None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in NOTE.split(", ")])

    def regions(batch: Batch, notes: pd.DataFrame) -> tuple[dict[bytes, int], list[list[tuple[int, int]]], list[int], list[int]]:
        got = notes[notes["kind"] == 1].sort_values("part")
        return batch.regions(np.frombuffer(b"".join(got["item"]), np.uint64), np.frombuffer(b"".join(got["marks"]), np.uint8))

    def send_regions(pdf: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf):
            batch, b = Batch(pdf, notes, length), int(pdf["batch"].iloc[0])
            number, places, names, often = regions(batch, notes)
            texts = list(number)
            part = (np.array(names, np.uint64) >> shift).astype(np.int64) if parts > 1 else np.zeros(len(names), np.int64)
            salts = 1 << np.array(often, np.int64)
            shard = (part << 32) + salts + b % salts
            order = np.argsort(shard, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(mine):
                    heads = [places[k][0] for k in mine]
                    out.append(
                        (int(shard[mine[0]]), b, b"".join([texts[k] for k in mine]), np.array([len(texts[k]) for k in mine], np.uint32).tobytes())
                        + (np.array([batch.ids[r] for r, _ in heads], np.int64).tobytes(), np.array([x for _, x in heads], np.int64).tobytes(), mine.astype(np.uint32).tobytes())
                    )
        return pd.DataFrame(out, columns=["shard", "batch", "text", "size", "doc", "start", "item"])

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        """Notes of kind 2 from a shard; of a frequent name also notes of kind 3: the windows that are first in this shard, packed by where they are merged."""
        number: dict[bytes, int] = {}
        which: list[int] = []
        for raw, size in zip(pdf["text"], pdf["size"], strict=True):
            at = 0
            for n in np.frombuffer(size, np.uint32).tolist():
                which.append(number.setdefault(raw[at : at + n], len(number)))
                at += n
        doc, start = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("doc", "start"))
        item = np.frombuffer(b"".join(pdf["item"]), np.uint32)
        batch = np.repeat(pdf["batch"].to_numpy(), pdf["item"].map(len).to_numpy() // 4)
        u = np.array(which)
        order = np.lexsort((start, doc, u))
        head = order[np.r_[True, u[order][1:] != u[order][:-1]]]  # the first place of each text
        texts = list(number)
        size = np.array([len(t) for t in texts])
        flag = later_windows(texts, doc[head], start[head], length)
        edge = np.flatnonzero(np.diff(np.r_[0, flag.view(np.int8), 0]))
        base = np.cumsum(size) - size
        of = np.searchsorted(base, edge[::2], side="right") - 1
        rest = np.ones(len(u), bool)
        rest[head] = False
        out = [
            packed_notes(
                np.r_[batch[rest], batch[head[of]]],
                np.r_[item[rest], item[head[of]]],
                np.r_[np.zeros(rest.sum(), np.int64), edge[::2] - base[of]],
                np.r_[size[u[rest]] - length + 1, edge[1::2] - edge[::2]],
            )
        ]
        shard = int(pdf["shard"].iloc[0])
        salts = 1 << (shard % (1 << 32)).bit_length() - 1
        if salts > 1:
            room = np.concatenate([np.r_[np.ones(n - length + 1, bool), np.zeros(length - 1, bool)] for n in size])
            at = np.flatnonzero(room & ~flag)
            of = np.searchsorted(base, at, side="right") - 1
            windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(texts), np.uint8), length)
            to = np.concatenate([window_hashes(windows[at[i : i + 100_000]]) % np.uint64(salts) for i in range(0, len(at), 100_000)])
            order = np.argsort(to, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                if len(mine):
                    h, off = head[of[mine]], at[mine] - base[of[mine]]
                    places = np.stack([doc[h], start[h] + off, batch[h].astype(np.int64), item[h].astype(np.int64), off])
                    key = (shard >> 32 << 32) + salts + int(to[mine[0]])
                    row = (shard % (1 << 32) - salts, 3, key, None, windows[at[mine]].tobytes(), None, places.tobytes(), None)
                    out.append(pd.DataFrame([row], columns=[x.split()[0] for x in NOTE.split(", ")]))
        return pd.concat(out, ignore_index=True)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Notes of kind 2 from the windows that are first in their shards of a frequent name. batch: the shard's number among the name's."""
        shards, each = [], []
        for salt in np.unique(pdf["batch"]):
            mine = pdf[pdf["batch"] == salt]
            # A sign at the end, as numpy drops zeros there.
            keys = np.frombuffer(b"".join(mine["marks"]), np.uint8).reshape(-1, length)
            keys = np.concatenate([keys, np.ones((len(keys), 1), np.uint8)], axis=1).view(f"S{length + 1}")[:, 0]
            sort = np.argsort(keys)
            shards.append(keys[sort])
            each.append(np.concatenate([np.frombuffer(p, np.int64).reshape(5, -1) for p in mine["place"]], axis=1)[:, sort])
        places = np.concatenate(each, axis=1)
        rank = np.empty(places.shape[1], np.int64)
        rank[np.lexsort((places[1], places[0]))] = np.arange(len(rank))
        ranks = np.split(rank, np.cumsum([len(k) for k in shards])[:-1])
        late = places[:, np.concatenate(merged(list(zip(shards, ranks, strict=True))))]
        return packed_notes(late[2], late[3], late[4], np.ones(late.shape[1], np.int64))

    def remove(pdf: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        if not len(pdf):
            return pd.DataFrame(columns=columns)
        batch = Batch(pdf, notes, length)
        number, places, _, _ = regions(batch, notes)
        gone: dict[int, list[tuple[int, int]]] = {}
        for text, of in zip(number, places, strict=True):
            for row, at in of[1:]:
                gone.setdefault(row, []).append((at, at + len(text)))
        got = notes[notes["kind"] == 2]
        items, offs, counts = (np.frombuffer(b"".join(got[c]), np.uint32).tolist() for c in ("item", "place", "width"))
        for i, off, n in zip(items, offs, counts, strict=True):
            row, at = places[i][0]
            gone.setdefault(row, []).append((at + off, at + off + n + length - 1))
        out: list[tuple] = []
        for k, raw in enumerate(batch.raw):
            spans: list[list[int]] = [[0, len(raw)]] if batch.copy[k] else []
            for a, b in sorted(gone.get(k, [])):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            ends = [0, *(x for s in spans for x in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
            out += [(batch.ids[k], len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else []))] * int(batch.times[k])
        return pd.DataFrame(out, columns=columns)

    by_batch = in_batches(dealt).groupBy("batch")
    marks = (
        by_batch.cogroup(copies.groupBy("batch"))
        .applyInPandas(send_names, "part int, batch int, hashes binary, counts binary")
        .groupBy("part")
        .applyInPandas(mark_names, NOTE)
    )
    marks = stored(marks.union(copies))
    found = stored(
        by_batch.cogroup(marks.groupBy("batch"))
        .applyInPandas(send_regions, "shard long, batch int, text binary, size binary, doc binary, start binary, item binary")
        .groupBy("shard")
        .applyInPandas(find, NOTE)
    )
    again = found.where("kind = 3").groupBy("doc_id").applyInPandas(merge, NOTE)
    notes = marks.union(found.where("kind = 2")).union(again)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return by_batch.cogroup(notes.groupBy("batch")).applyInPandas(remove, schema).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))

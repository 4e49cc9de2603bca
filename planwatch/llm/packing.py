"""Packing documents into training sequences by vector bin packing with a dot-product heuristic."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, modest

#: Parts of texts whose ids a worker remembers before it forgets those not met for as long.
REMEMBERED = 400_000
#: The byte alphabet of byte-level vocabularies, by its rule: printable Latin-1 signs stand for themselves, other bytes for signs from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: b if b in PRINTABLE else 256 + sum(x not in PRINTABLE for x in range(b)) for b in range(256)}


class Remembered(dict):
    """Ids, as bytes of uint32, of the parts of texts between spaces; each met anew is encoded once.

    A part of letters alone is one word to the tokenizer, as are marks after it: these go to the model itself, normalised.
    """

    def __init__(self, tokenizer: Any):
        self.tokenizer, self.model, self.old = tokenizer, tokenizer.model, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.encode(part)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[part] = ids
        return ids

    def encode(self, part: str) -> bytes:
        word = part.rstrip(".,;:!?")
        low = word.lower() if word.isascii() else self.tokenizer.normalizer.normalize_str(word)
        if not low.isalpha():
            return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        tokens = self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(ALPHABET))
        if len(word) < len(part):
            tokens += self.model.tokenize(part[len(word) :])
        return array("I", [t.id for t in tokens]).tobytes()


class Encoder:
    """Ids of whole texts by a lower-casing byte-level tokenizer that splits at white space and between letters, digits and marks."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known = Remembered(Tokenizer.from_file(path))
        self.end = array("I", [end]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, t.replace("\n", " ").split(" "))) + self.end, np.uint32) if t else np.frombuffer(self.end, np.uint32) for t in texts]


class Packer:
    """Fills sequences of at most limits (tokens, segments, loss-bearing tokens) with pieces of documents.

    The open sequence takes the waiting piece with the greatest dot product of its demand and what room is
    left, both as parts of the limits, among those that fit. Where none fits, the largest is cut to fill the sequence (half of
    it, if the room for loss wouldn't let one piece do so); its rest waits on. Where that breaks a limit too, the sequence ends at a power of two of tokens, and what is beyond
    waits on. A piece's first token bears no loss, as nothing in the sequence predicts it, and neither do a document's prompt tokens.
    """

    def __init__(self, limits: tuple[int, int, int], first_id: int):
        self.limits = np.array(limits)
        self.next = first_id
        self.doc: list[int] = []
        self.prompt: list[int] = []
        self.start: list[int] = []
        self.length: list[int] = []

    def add(self, doc: int, tokens: int, prompt: int = 0) -> None:
        """Takes document number doc, whose first prompt tokens bear no loss."""
        self.doc.append(doc)
        self.prompt.append(prompt)
        self.start.append(0)
        self.length.append(tokens)

    def pack(self, last: bool) -> list[tuple[int, int, int, int, int]]:
        """Sequences of what waits, as (doc, start, length, sequence, offset); all of it if last, else as long as full sequences can be had."""
        out: list[tuple[int, int, int, int, int]] = []
        doc, prompt, start, length = (np.array(x, np.int64) for x in (self.doc, self.prompt, self.start, self.length))
        waits = np.ones(len(doc), bool)
        left = int(length.sum())
        while left and (last or left >= 8 * self.limits[0]):
            room, held, at = self.limits.copy(), [], np.flatnonzero(waits)
            demand = length[at]
            free = np.maximum(prompt[at] - start[at], 1)  # a piece's first tokens, without loss
            while room[0] > 0 and room[1] > 0:
                loss = np.maximum(demand - free, 0)
                fits = (demand > 0) & (demand <= room[0]) & (loss <= room[2])
                if fits.any():
                    share = room / self.limits / self.limits  # the dot product of demand and room, both as parts of the limits
                    i = int(np.where(fits, demand * share[0] + share[1] + loss * share[2], -1).argmax())
                    take = int(demand[i])
                elif len(demand) and demand[i := int(demand.argmax())] > 0:
                    most = room[2] + free[i]
                    take = int(min(demand[i], room[0] if room[0] <= most else max(1, min(room[0] // 2, most))))
                else:
                    break
                k = int(at[i])
                held.append((int(doc[k]), int(start[k]), take))
                room -= (take, 1, max(take - int(free[i]), 0))
                start[k] += take
                length[k] -= take
                demand[i] -= take
                free[i] = max(int(free[i]) - take, 1)
                waits[k] = length[k] > 0
            used = int(self.limits[0] - room[0])
            keep = used if used == self.limits[0] else 1 << (used.bit_length() - 1)
            offset, back = 0, []
            for d, s, n in held:
                if (m := min(n, keep - offset)) > 0:
                    out.append((d, s, m, self.next, offset))
                    offset += m
                if m < n:
                    back.append((d, s + max(m, 0), n - max(m, 0)))
            if back:
                d, s, n = (np.array(x, np.int64) for x in zip(*back, strict=True))
                known = dict(zip(doc.tolist(), prompt.tolist(), strict=True))
                p = np.array([known[x] for x in d.tolist()], np.int64)
                doc, prompt, start, length = (np.r_[x[waits], y] for x, y in ((doc, d), (prompt, p), (start, s), (length, n)))
                waits = np.ones(len(doc), bool)
            self.next += 1
            left -= keep
        self.doc, self.prompt, self.start, self.length = (x[waits].tolist() for x in (doc, prompt, start, length))
        return out


def packed(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    segments: int = 256,
    loss_tokens: int | None = None,
    end_id: int = 1,
    with_ids: bool = False,
    prompt_col: str | None = None,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids array<int> if with_ids): a row for each piece.

    capacity, segments and loss_tokens limit the tokens, pieces and loss-bearing tokens of a sequence. Of a document of plain text each
    token but a piece's first bears loss; prompt_col, if named, is how many of a document's first tokens are prompt and bear none.

    Each partition packs its own documents, so nothing is shuffled; a sequence id holds the partition's number. Sequences
    are full or, where the partition's rest is too little, a power of two long. A null or empty text is the end id
    alone; a repeated row is a document of its own; texts of any length are cut into pieces; an empty table gives no rows.
    """
    limits = (capacity, segments, capacity if loss_tokens is None else loss_tokens)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer_path, end_id)
        packer = Packer(limits, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
        docs_held: dict[int, tuple[int | None, np.ndarray]] = {}
        n = 0

        def rows(pieces: list[tuple[int, int, int, int, int]]) -> pd.DataFrame:
            got = [(docs_held[d][0], s, m, zlib.crc32(docs_held[d][1][s : s + m].tobytes()), len(docs_held[d][1]), q, o) for d, s, m, q, o in pieces]
            out = pd.DataFrame(got, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            if with_ids:
                out["ids"] = pd.Series([docs_held[d][1][s : s + m].astype(np.int32) for d, s, m, _, _ in pieces], dtype=object)
            return out

        for pdf in by_size(frames, "text", 2_000_000):
            for doc, prompt, ids in zip(pdf["id"], pdf["prompt"], encoder.encode(pdf["text"].tolist()), strict=True):
                docs_held[n] = (None if pd.isna(doc) else int(doc), ids)
                packer.add(n, len(ids), int(prompt))
                n += 1
            yield rows(packer.pack(False))
            docs_held = {k: docs_held[k] for k in set(packer.doc)}
        if docs_held:
            yield rows(packer.pack(True))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    prompt = F.coalesce(F.col(prompt_col), F.lit(0)).cast("long") if prompt_col else F.lit(0).cast("long")
    return modest(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), prompt.alias("prompt")).mapInPandas(run, schema)

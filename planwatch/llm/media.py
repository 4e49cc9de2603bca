"""Media columns: bytes kept losslessly in the coefficients of progressive JPEG images."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, modest, stored

#: Fixed values of the JPEG format: zigzag position -> row-major position in a block.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
#: Basis of the inverse cosine transform: sample x of frequency u.
BASIS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)], np.float32)
#: The components' blocks across and down in a unit of 6 blocks (luma at full resolution, chroma at half).
SAMPLING = ((2, 2), (1, 1), (1, 1))
SPLIT = 6  # spectral selection: coefficients 1..5, then 6..63


# ---- writing ----


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_table(kind: int, number: int, lengths: list[int], symbols: bytes) -> bytes:
    return segment(0xC4, bytes([kind << 4 | number, *lengths]) + symbols)


def scan(components: list[tuple[int, int]], start: int, end: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *(x for c, t in components for x in (c, t)), start, end, high << 4 | low])
    return segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def put_bits(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """The values' bits, each so many, one after the other, filled up with ones."""
    ends = np.cumsum(lengths)
    which = np.repeat(np.arange(len(values)), lengths)
    bits = (values[which] >> (ends[which] - 1 - np.arange(len(which)))) & 1
    return np.packbits(np.append(bits.astype(np.uint8), np.ones(-len(which) % 8, np.uint8))).tobytes()


def shape_of(blocks: int) -> tuple[int, int]:
    """Units down and across of a nearly square image that holds so many blocks."""
    units = max(1, -(-blocks // 6))
    across = int(np.ceil(np.sqrt(units)))
    return -(-units // across), across


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A progressive JPEG of three components, chroma at half resolution, whose coefficients are the payload's bytes.

    A block holds 64 bytes in zigzag order. The first, less 128, is the DC coefficient. Byte b after it is
    the coefficient b, or b - 255 below 128: just the values of size 8, whose extra bits are b itself. So the
    first AC scans (bits but the last) code each coefficient by one symbol of one bit and 7 extra bits, and the
    refinement scans have one end-of-band symbol and 63 correction bits a block.
    """
    down, across = shape_of(len(payload) // 64)
    raw = np.zeros((down * across * 6, 64), np.uint8)
    raw.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    dc = raw[:, 0].astype(np.int64).reshape(-1, 6) - 128
    high = dc >> 1
    diff = high.copy()
    diff[:, 1:4] -= high[:, :3]
    diff[1:, 0] -= high[:-1, 3]
    diff[1:, 4:] -= high[:-1, 4:]
    diff = diff.ravel()
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    units = raw.reshape(down, across, 6, 64)
    planes = [
        units[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64),
        units[:, :, 4].reshape(-1, 64),
        units[:, :, 5].reshape(-1, 64),
    ]
    frame = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes(x for c, (h, v) in enumerate(SAMPLING) for x in (c + 1, h << 4 | v, 0))
    out = [
        b"\xff\xd8",
        segment(0xFE, struct.pack(">QQ", len(payload), n_bytes)),
        segment(0xDB, bytes([0]) + bytes([1] * 64)),
        segment(0xC2, frame),
        huffman_table(0, 0, [0, 0, 0, 9] + [0] * 12, bytes(range(9))),
        huffman_table(1, 0, [1] + [0] * 15, bytes([0x07])),
        huffman_table(1, 1, [1] + [0] * 15, bytes([0x00])),
        scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1, put_bits(size << size | extra, size + 4)),
    ]
    for lo, hi in ((1, SPLIT), (SPLIT, 64)):
        out += [scan([(c + 1, 0)], lo, hi - 1, 0, 1, (p[:, lo:hi] >> 1).tobytes()) for c, p in enumerate(planes)]
    out.append(scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0, put_bits(dc.ravel() & 1, np.ones(dc.size, np.int64))))
    for c, p in enumerate(planes):
        bits = (p & 1) ^ (p < 128)  # of the magnitude: b, or 255 - b below 128
        bits[:, 0] = 0
        out.append(scan([(c + 1, 1)], 1, 63, 1, 0, np.packbits(bits, axis=1).tobytes()))
    return b"".join(out) + b"\xff\xd9"


# ---- reading ----


class Table:
    """A Huffman table as two look-up arrays over the next 16 bits: code length (0: none) and symbol."""

    def __init__(self, lengths: bytes, symbols: bytes):
        self.length, self.symbol = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
        self.only = symbols[0] if len(symbols) == 1 and lengths[0] == 1 else None
        at, k = 0, 0
        for bits, n in enumerate(lengths, 1):
            for _ in range(n):
                width = 1 << (16 - bits)
                self.length[at : at + width], self.symbol[at : at + width] = bits, symbols[k]
                at, k = at + width, k + 1


TABLES: dict[tuple[bytes, bytes], Table] = {}


def table_of(lengths: bytes, symbols: bytes) -> Table:
    """The table, remembered: images of one writer share theirs."""
    if len(TABLES) > 64:
        TABLES.clear()
    if (lengths, symbols) not in TABLES:
        TABLES[lengths, symbols] = Table(lengths, symbols)
    return TABLES[lengths, symbols]


class Bits:
    """The entropy-coded bits of one restart interval."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.at = 0
        self._bits: np.ndarray | None = None

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.append(np.unpackbits(np.frombuffer(self.data, np.uint8)), np.ones(64, np.uint8)).astype(np.int64)
        return self._bits

    def windows(self) -> np.ndarray:
        b = self.bits
        out = np.zeros(len(b) - 16, np.int64)
        for k in range(16):
            out = out << 1 | b[k : k + len(out)]
        return out

    def take(self, n: int) -> int:
        out = 0
        for bit in self.bits[self.at : self.at + n]:
            out = out << 1 | int(bit)
        self.at += n
        return out

    def decode(self, table: Table) -> int:
        w = int(self.bits[self.at : self.at + 16] @ (1 << np.arange(15, -1, -1)))
        if not table.length[w]:
            raise ValueError("no such Huffman code")
        self.at += int(table.length[w])
        return int(table.symbol[w])


def signed(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of extra bits of so many bits each."""
    return np.where(extra < (1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra) * (size > 0)


def extras(bits: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for k in range(int(size.max(initial=0))):
        more = k < size
        out[more] = out[more] << 1 | bits[at[more] + k]
    return out


def dc_first(data: Bits, tables: list[Table], n: int) -> np.ndarray:
    """n differences, the i-th by the table tables[i % len(tables)]."""
    w = data.windows()
    jump = [(np.arange(len(w)) + t.length[w] + t.symbol[w]).tolist() for t in dict.fromkeys(tables)]
    order = [list(dict.fromkeys(tables)).index(t) for t in tables]
    at, places = 0, []
    for i in range(n):
        places.append(at)
        at = jump[order[i % len(order)]][at]
    place = np.array(places, np.int64)
    size, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, t in enumerate(tables):
        mine = place[k :: len(tables)]
        size[k :: len(tables)], start[k :: len(tables)] = t.symbol[w[mine]], mine + t.length[w[mine]]
    return signed(extras(data.bits, start, size), size)


def ac_first(data: Bits, table: Table, coef: np.ndarray, lo: int, hi: int, low: int) -> None:
    """A first scan of coefficients lo..hi of coef [blocks, 64]."""
    n, width = len(coef), hi - lo + 1
    if table.only is not None and table.only >> 4 == 0 and 0 < (size := table.only & 15) and len(data.data) * 8 >= n * width * (size + 1):
        if size == 7:
            extra = np.frombuffer(data.data, np.uint8, n * width).astype(np.int32)
        else:
            extra = (data.bits[: n * width * (size + 1)].reshape(-1, size + 1)[:, 1:] @ (1 << np.arange(size - 1, -1, -1))).astype(np.int32)
        coef[:, lo : hi + 1] = (np.where(extra < 1 << (size - 1), extra - (1 << size) + 1, extra) << low).reshape(n, width)
        return
    w = data.windows()
    length, symbol = table.length[w], table.symbol[w]
    run, size = symbol >> 4, symbol & 15
    jump = (np.arange(len(w)) + length + np.where(size == 0, np.where(run < 15, run, 0), size)).tolist()
    runs, sizes, where = run.tolist(), size.tolist(), []
    at, b = 0, 0
    while b < n:
        k = lo
        while k <= hi:
            here, r, s = at, runs[at], sizes[at]
            at = jump[at]
            if s:
                k += r
                where.append((b, k, here))
                k += 1
            elif r == 15:
                k += 16
            else:
                b += (1 << r) - 1 + int(extras(data.bits, np.array([here + length[here]]), np.array([r]))[0])
                break
        b += 1
    if where:
        rows, ks, places = (np.array(x) for x in zip(*where, strict=True))
        coef[rows, ks] = signed(extras(data.bits, places + length[places], size[places]), size[places]) << low


def ac_refine(data: Bits, table: Table, coef: np.ndarray, lo: int, hi: int, low: int) -> None:
    """A refinement scan: a correction bit for each coefficient that isn't zero, and new ones."""
    n, width = len(coef), hi - lo + 1
    band = coef[:, lo : hi + 1]
    if table.only == 0 and band.all():
        bits = np.unpackbits(np.frombuffer(data.data, np.uint8))[: n * (width + 1)].reshape(n, width + 1)[:, 1:]
        band += np.where(band < 0, -1, 1).astype(coef.dtype) * (bits.astype(coef.dtype) << low)
        return
    b, step, left = 0, 1 << low, 0

    def correct(block: np.ndarray, k: int) -> None:
        if data.take(1):
            block[k] += step if block[k] > 0 else -step

    for b in range(n):
        block, k = coef[b], lo
        while k <= hi and not left:
            symbol = data.decode(table)
            r, s = symbol >> 4, symbol & 15
            if not s and r < 15:
                left = (1 << r) + data.take(r)
                break
            new = (step if data.take(1) else -step) if s else 0
            while k <= hi:
                if block[k]:
                    correct(block, k)
                elif r == 0:
                    block[k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        if left:
            for k in range(k, hi + 1):
                if block[k]:
                    correct(block, k)
            left -= 1


def coefficients(media: bytes) -> tuple[list[np.ndarray], list[np.ndarray], dict]:
    """Of a progressive JPEG: per component int32 coefficients [block rows, block columns, 64] in zigzag order, and its
    quantisation table; and height, width, sampling and comment.

    Whole images without restart intervals are read; other kinds raise ValueError.
    """
    at, quant, tables, frame, coefs, info = 2, {}, {}, None, [], {"comment": b""}
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while True:
        marker = media[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(media[at + 2 : at + 4], "big")
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            info["comment"] = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = table_of(bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC2:
            height, width, n = struct.unpack(">HHB", body[1:6])
            frame = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(n)]
            hs, vs = max(f[1] for f in frame), max(f[2] for f in frame)
            down, across = -(-height // (8 * vs)), -(-width // (8 * hs))
            coefs = [np.zeros((down * v, across * h, 64), np.int32) for _, h, v, _ in frame]
            info |= {"height": height, "width": width, "down": down, "across": across, "hs": hs, "vs": vs, "frame": frame}
        elif marker == 0xDA:
            n = body[0]
            parts = [([f[0] for f in frame].index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            lo, hi, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            end = at
            while True:
                end = media.index(b"\xff", end)
                if media[end + 1] != 0:
                    break
                end += 2
            data, at = Bits(media[at:end]), end
            if lo == 0:
                read_dc(data, coefs, parts, info, tables, high, low)
            else:
                c, t = parts[0]
                h, w = own_blocks(info, c)
                held = coefs[c][:h, :w].reshape(-1, 64)
                (ac_refine if high else ac_first)(data, tables[1, t & 15], held, lo, hi, low)
                coefs[c][:h, :w] = held.reshape(h, w, 64)
        elif marker in (0xC0, 0xC1, 0xC3, 0xDD, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError(f"marker {marker:x} isn't read")
    return coefs, [quant[f[3]] for f in info["frame"]], info


def own_blocks(info: dict, c: int) -> tuple[int, int]:
    """Block rows and columns of component c in a scan of its own."""
    _, h, v, _ = info["frame"][c]
    return -(-(-(-info["height"] * v // info["vs"])) // 8), -(-(-(-info["width"] * h // info["hs"])) // 8)


def read_dc(data: Bits, coefs: list[np.ndarray], parts: list[tuple[int, int]], info: dict, tables: dict, high: int, low: int) -> None:
    """A DC scan of one component, or of several interleaved by units."""
    down, across = info["down"], info["across"]
    if len(parts) == 1:
        c, t = parts[0]
        (rows, cols), order = own_blocks(info, c), [(c, tables.get((0, t >> 4)), 1)]
        blocks = rows * cols
    else:
        order = [(c, tables.get((0, t >> 4)), info["frame"][c][1] * info["frame"][c][2]) for c, t in parts]
        blocks = down * across * sum(n for _, _, n in order)
    each = sum(n for _, _, n in order)
    if high:
        got = np.unpackbits(np.frombuffer(data.data, np.uint8))[:blocks].astype(np.int32)
    else:
        got = dc_first(data, [t for _, t, n in order for _ in range(n)], blocks)
    got, k = got.reshape(-1, each), 0
    for c, _, n in order:
        mine = got[:, k : k + n].ravel()
        k += n
        if not high:
            mine = np.cumsum(mine)
        mine = (mine << low).astype(np.int32)
        if len(parts) == 1:
            coefs[c][:rows, :cols, 0] = coefs[c][:rows, :cols, 0] + mine.reshape(rows, cols) if high else mine.reshape(rows, cols)
        else:
            _, h, v, _ = info["frame"][c]
            grid = mine.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            coefs[c][:, :, 0] = coefs[c][:, :, 0] + grid if high else grid


def payload_of(coefs: list[np.ndarray], info: dict) -> tuple[bytes, int]:
    """The bytes that encode() put into the coefficients, and their number before padding."""
    down, across = info["down"], info["across"]
    units = np.empty((down, across, 6, 64), np.int32)
    units[:, :, :4] = coefs[0].reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    units[:, :, 4], units[:, :, 5] = coefs[1], coefs[2]
    raw = np.where(units < 0, units + 255, units).astype(np.uint8)
    raw[..., 0] = (units[..., 0] + 128).astype(np.uint8)
    n, n_bytes = struct.unpack(">QQ", info["comment"])
    return raw.tobytes()[:n], n_bytes


def rgb(coefs: list[np.ndarray], quant: list[np.ndarray], info: dict) -> np.ndarray:
    """uint8 [height, width, 3]: inverse transform, chroma upsampled by repetition, and full-range YCbCr to RGB."""
    planes = []
    for (_, h, v, _), c, q in zip(info["frame"], coefs, quant, strict=True):
        rows, cols, _ = c.shape
        block = np.empty((rows * cols, 64), np.float32)
        block[:, ZIGZAG] = c.reshape(-1, 64) * q
        half = (block.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ BASIS
        plane = half.reshape(rows, cols, 8, 8).transpose(0, 3, 1, 2).reshape(rows * 8, cols * 8)
        plane = plane.repeat(info["vs"] // v, axis=0).repeat(info["hs"] // h, axis=1) if (h, v) != (info["hs"], info["vs"]) else plane
        planes.append(plane[: info["height"], : info["width"]] + np.float32(128))
    if len(planes) == 1:
        return np.repeat(np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)[..., None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for k, x in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        np.clip(np.rint(x), 0, 255, out=x)
        out[..., k] = x
    return out


def feature(image: np.ndarray) -> str:
    """Size, mean colour and a 64-bit average hash of an image, as text."""
    h, w, _ = image.shape
    cells = image[: h // 8 * 8, : w // 8 * 8].sum(axis=2, dtype=np.int64).reshape(8, h // 8, 8, w // 8).sum(axis=(1, 3))
    bits = np.packbits((cells * 64 > cells.sum()).ravel())
    return f"{w}x{h}:" + ",".join(f"{image[..., k].sum(dtype=np.int64) / (h * w):.3f}" for k in range(3)) + f":{bits.tobytes().hex()}"


# ---- columns ----


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, media binary: each whole text (null: empty) as UTF-8, padded with zero bytes to a positive multiple of 64, as a progressive JPEG.

    A row for each row of docs; equal texts get equal media; an empty table gives none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_size(frames, "text", 1_000_000):
            raw = [t.encode() for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "media": [encode(b + bytes(-len(b) % 64 if b else 64), len(b)) for b in raw]})

    return modest(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, "id long, media binary")


def kept_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """stored_media() at rest: written as a table in the shared folder, from which the images are read back."""
    return stored(stored_media(docs, id_col, text_col))


def read_media(media: DataFrame, with_payload: bool = False, with_tensor: bool = False) -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of stored media (id, media).

    with_payload adds the bytes read back, with_tensor the RGB tensor (height, width, rgb binary, row-major), at full
    resolution; in a column of a table Spark writes it as it is.
    """
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", payload binary" * with_payload + ", height int, width int, rgb binary" * with_tensor

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_size(frames, "media", 1_000_000):
            rows = []
            for i, m in zip(pdf["id"], pdf["media"], strict=True):
                coefs, quant, info = coefficients(m)
                payload, n = payload_of(coefs, info)
                image = rgb(coefs, quant, info)
                row = [i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(image)]
                rows.append(row + [payload] * with_payload + [info["height"], info["width"], image.tobytes()][: 3 * with_tensor])
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return modest(media).mapInPandas(run, schema)

"""Progressive JPEG: scans of spectral selection and successive approximation, in numpy.

decode() accumulates the scans of a progressive file (SOF2) into coefficient arrays, then dequantises, inverse-transforms,
upsamples chroma and converts to full-resolution RGB. It reads any Huffman-coded progressive file of 8 bits; where a
scan's own Huffman table allows only one kind of symbol, the scan is read as an array instead of symbol by symbol.

encode_payload() stores bytes losslessly as quantised coefficients, 64 bytes a block: byte 0 as the DC coefficient, the
others as AC coefficients whose sign is the byte's top bit and whose magnitude is 128 plus its other bits. All AC
coefficients are then significant from the first scan on, so each first scan has one symbol and each refinement is bare
bits. The last blocks of the image are filled with zero bytes.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

BLOCK = 64
#: A header may claim any size, and coefficients take 4 bytes each: a larger image is not decoded.
MOST_PIXELS = 1 << 26
_DC_SHIFT = 8
_AC_SIZE = 7  # bits of an AC coefficient in its first scan, at point transform 1
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _zigzag() -> np.ndarray:
    """Natural place of each coefficient in zigzag order: along the anti-diagonals, up the even and down the odd ones."""
    places = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))
    return np.array([r * 8 + c for r, c in places])


ZIGZAG = _zigzag()
_UNZIGZAG = np.argsort(ZIGZAG)
_COSINES = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    rows: int = 0  # of blocks, whole MCUs
    cols: int = 0
    own_rows: int = 0  # of blocks that a scan of this component alone covers
    own_cols: int = 0
    zz: np.ndarray = field(default=None, repr=False)  # (rows * cols, 64) int32, zigzag order


@dataclass
class Image:
    height: int
    width: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""

    def plane(self, c: Component) -> np.ndarray:
        """Samples of one component at its own resolution, as float32 around 128."""
        blocks = (c.zz * self.quant[c.table]).astype(np.float32)[:, _UNZIGZAG].reshape(-1, 8)
        half = (blocks @ _COSINES).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8)
        full = (half @ _COSINES).reshape(c.rows, c.cols, 8, 8)  # each block transposed
        return full.transpose(0, 3, 1, 2).reshape(c.rows * 8, c.cols * 8) + np.float32(128)

    def rgb(self) -> np.ndarray:
        """(height, width, 3) uint8."""
        top_h, top_v = max(c.h for c in self.components), max(c.v for c in self.components)
        planes = []
        for c in self.components:
            p = self.plane(c)
            if top_v // c.v > 1:
                p = np.repeat(p, top_v // c.v, 0)
            if top_h // c.h > 1:
                p = np.repeat(p, top_h // c.h, 1)
            planes.append(p[: self.height, : self.width])
        out = np.empty((self.height, self.width, 3), np.uint8)
        put = lambda k, x: np.copyto(out[:, :, k], np.clip(np.rint(x), 0, 255), casting="unsafe")
        if len(planes) == 1:
            for k in range(3):
                put(k, planes[0])
            return out
        y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
        put(0, y + np.float32(1.402) * cr)
        put(1, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr)
        put(2, y + np.float32(1.772) * cb)
        return out


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols, self.codes, code, at = symbols, {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.lengths = {s: n for (n, _), s in self.codes.items()}


class Bits:
    """Bits of one restart interval, most significant first; ones after the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = np.unpackbits(np.frombuffer(data, np.uint8)), 0, len(data) * 8

    def take(self, n: int) -> int:
        v = 0
        for b in self.data[self.at : self.at + n].tolist():
            v = v * 2 + b
        short = max(0, self.at + n - self.end)
        self.at += n
        return (v << short) | ((1 << short) - 1) if short else v

    def array(self, n: int) -> np.ndarray:
        out = self.data[self.at : self.at + n]
        self.at += n
        return out if len(out) == n else np.concatenate([out, np.ones(n - len(out), np.uint8)])

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code * 2 + self.take(1)
            if (s := table.codes.get((length, code))) is not None:
                return s
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


@dataclass
class Scan:
    parts: list[tuple[Component, int, int]]  # component, DC table, AC table
    first: int
    last: int
    high: int
    low: int


def _mcu_blocks(scan: Scan, mcus_x: int, mcus_y: int) -> list[tuple[Component, int, np.ndarray]]:
    """For each component its DC table and its block numbers by MCU: shape (MCUs, blocks a MCU)."""
    if len(scan.parts) == 1:
        c, dc, _ = scan.parts[0]
        return [(c, dc, (np.arange(c.own_rows)[:, None] * c.cols + np.arange(c.own_cols)[None, :]).reshape(-1, 1))]
    out = []
    for c, dc, _ in scan.parts:
        y, x, v, h = np.arange(mcus_y), np.arange(mcus_x), np.arange(c.v), np.arange(c.h)
        rows = y[:, None, None, None] * c.v + v[:, None]
        out.append((c, dc, (rows * c.cols + x[:, None, None] * c.h + h).reshape(mcus_y * mcus_x, c.v * c.h)))
    return out


def _dc(scan: Scan, chunks: list[bytes], mcus: list, interval: int, tables: dict) -> None:
    if scan.high:  # one bare bit a block, in MCU order
        order = np.concatenate([b for _, _, b in mcus], 1) if len(mcus) > 1 else mcus[0][2]
        width, n = order.shape[1], len(order)
        for k, chunk in enumerate(chunks):
            lo, hi = k * interval, min(n, (k + 1) * interval)
            bits = Bits(chunk).array((hi - lo) * width).reshape(hi - lo, width).astype(np.int32) << scan.low
            at = 0
            for c, _, blocks in mcus:
                w = blocks.shape[1]
                c.zz[blocks[lo:hi].ravel(), 0] |= bits[:, at : at + w].ravel()
                at += w
        return
    if all(set(tables[0, dc].symbols) == {0} for _, dc, _ in mcus):  # every difference is nothing
        for c, _, blocks in mcus:
            c.zz[blocks.ravel(), 0] = 0
        return
    for k, chunk in enumerate(chunks):
        bits, last = Bits(chunk), {c.id: 0 for c, _, _ in mcus}
        for m in range(k * interval, min(len(mcus[0][2]), (k + 1) * interval)):
            for c, dc, blocks in mcus:
                for b in blocks[m].tolist():
                    last[c.id] += bits.value(bits.symbol(tables[0, dc]))
                    c.zz[b, 0] = last[c.id] << scan.low


def _ac_first(scan: Scan, zz: np.ndarray, blocks: np.ndarray, chunk: bytes, table: Huffman) -> None:
    s, e = scan.first, scan.last + 1
    only = table.symbols[0] if len(table.symbols) == 1 else 0
    if only and only < 16:  # every coefficient follows at once and has `only` bits
        width, n = table.lengths[only] + only, len(blocks) * (e - s)
        if width == 8:
            raw = np.frombuffer(chunk, np.uint8, n).astype(np.int32)
        else:
            bits = np.unpackbits(np.frombuffer(chunk, np.uint8))[: n * width].reshape(n, width)
            raw = bits.astype(np.int32) @ (1 << np.arange(width - 1, -1, -1))
        raw &= (1 << only) - 1
        value = np.where(raw >> (only - 1), raw, raw - (1 << only) + 1)
        zz[blocks, s:e] = (value << scan.low).reshape(-1, e - s)
        return
    bits, run = Bits(chunk), 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k = s
        while k < e:
            r, size = divmod(bits.symbol(table), 16)
            if size:
                k += r
                zz[b, k] = bits.value(size) * (1 << scan.low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def _ac_refine(scan: Scan, zz: np.ndarray, blocks: np.ndarray, chunk: bytes, table: Huffman) -> None:
    s, e, one = scan.first, scan.last + 1, 1 << scan.low
    bits, at = Bits(chunk), 0

    def correct(own: np.ndarray, start: int) -> None:
        """A bit for each coefficient of these blocks, from `start` on, that is significant already."""
        band = zz[own, start:e]
        where = band != 0
        more = np.zeros(band.shape, np.int32)
        more[where] = bits.array(int(np.count_nonzero(where)))
        zz[own, start:e] = band + np.where(band < 0, -one, one) * more

    while at < len(blocks):
        k, b = s, blocks[at]
        while k < e:
            r, size = divmod(bits.symbol(table), 16)
            if not size and r < 15:
                run = (1 << r) + bits.take(r)
                if k > s:  # the rest of this block, then whole blocks
                    correct(blocks[at : at + 1], k)
                    at, run = at + 1, run - 1
                correct(blocks[at : at + run], s)
                at += run
                break
            new = (one if bits.take(1) else -one) if size else 0
            while k < e:
                if zz[b, k]:
                    if bits.take(1):
                        zz[b, k] += one if zz[b, k] > 0 else -one
                elif r:
                    r -= 1
                else:
                    zz[b, k] = new
                    k += 1
                    break
                k += 1
        else:
            at += 1


def decode(data: bytes, most_pixels: int = MOST_PIXELS) -> Image:
    """The image of a progressive file; ValueError for other kinds, for broken files and for larger images."""
    try:
        return _decode(data, most_pixels)
    except (IndexError, KeyError, OverflowError, struct.error) as e:
        raise ValueError("a broken file") from e


def _decode(data: bytes, most_pixels: int) -> Image:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, quant, tables, image, interval = 2, {}, {}, None, 0
    mcus_x = mcus_y = 0
    orders: dict = {}
    comment = b""
    while True:
        if data[at : at + 1] != b"\xff":
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xFE:
            comment = body
        elif kind == 0xDB:
            while body:
                wide, to = divmod(body[0], 16)
                n = 64 * (1 + wide)
                quant[to] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[divmod(body[0], 16)] = Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif kind == 0xC2:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples are not of 8 bits")
            parts = [Component(body[6 + 3 * i], *divmod(body[7 + 3 * i], 16), body[8 + 3 * i]) for i in range(n)]
            if not (height and width and parts) or any(not (1 <= c.h <= 4 and 1 <= c.v <= 4) for c in parts):
                raise ValueError("a frame without a size")
            if height * width * len(parts) > 3 * most_pixels:
                raise ValueError("the image is too large")
            top_h, top_v = max(c.h for c in parts), max(c.v for c in parts)
            mcus_x, mcus_y = -(-width // (8 * top_h)), -(-height // (8 * top_v))
            for c in parts:
                c.rows, c.cols = mcus_y * c.v, mcus_x * c.h
                c.own_rows, c.own_cols = -(-(-(-height * c.v // top_v)) // 8), -(-(-(-width * c.h // top_h)) // 8)
                c.zz = np.zeros((c.rows * c.cols, 64), np.int32)
            image = Image(height, width, parts, quant)
        elif 0xC0 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("not a progressive Huffman file")
        elif kind == 0xDA:
            if image is None:
                raise ValueError("a scan before the frame")
            by = {c.id: c for c in image.components}
            chosen = [(by[body[1 + 2 * i]], *divmod(body[2 + 2 * i], 16)) for i in range(body[0])]
            first, last, shift = body[-3:]
            if not first <= last < BLOCK or (first and len(chosen) != 1) or not chosen:
                raise ValueError("a scan of no such coefficients")
            scan = Scan(chosen, first, last, *divmod(shift, 16))
            end = m.start() if (m := _MARKER.search(data, at)) else len(data)
            raw, at = data[at:end], end
            chunks = [x.replace(b"\xff\x00", b"\xff") for x in (_RESTART.split(raw) if interval else [raw])]
            key = tuple((c.id, dc) for c, dc, _ in chosen)
            if key not in orders:
                orders[key] = _mcu_blocks(scan, mcus_x, mcus_y)
            mcus = orders[key]
            step = interval or len(mcus[0][2])
            if first == 0:
                _dc(scan, chunks, mcus, step, tables)
            else:
                c, _, ac = chosen[0]
                blocks = mcus[0][2].ravel()
                for k, chunk in enumerate(chunks):
                    (_ac_refine if scan.high else _ac_first)(scan, c.zz, blocks[k * step : (k + 1) * step], chunk, tables[1, ac])
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _table(kind: int, to: int, by_length: dict[int, bytes]) -> bytes:
    counts = bytes(len(by_length.get(n, b"")) for n in range(1, 17))
    return _segment(0xC4, bytes([kind << 4 | to]) + counts + b"".join(by_length[n] for n in sorted(by_length)))


def _sos(ids: list[int], first: int, last: int, high: int, low: int, tables: int) -> bytes:
    return _segment(0xDA, bytes([len(ids)]) + b"".join(bytes([i, tables]) for i in ids) + bytes([first, last, high << 4 | low]))


def _stuffed(bits: np.ndarray) -> bytes:
    if len(bits) % 8:
        bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


#: Huffman tables: DC 0 has the size 0 alone, AC 0 the symbol (0, 7) alone, AC 1 the fifteen runs of block ends.
_TABLES = _table(0, 0, {1: b"\x00"}) + _table(1, 0, {1: bytes([_AC_SIZE])}) + _table(1, 1, {4: bytes(n << 4 for n in range(15))})
_QUANT = _segment(0xDB, b"\x00" + b"\x01" * 64)
_SAMPLING = ((1, 2, 2), (2, 1, 1), (3, 1, 1))


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 file that holds payload, a positive multiple of 64 bytes, in its coefficients."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    mcus = -(-len(payload) // (6 * BLOCK))
    across = int(np.ceil(np.sqrt(mcus)))
    down = -(-mcus // across)
    if max(across, down) * 16 > 65535:
        raise ValueError("the payload is too long for one image")
    all_mcus = across * down
    data = np.zeros((all_mcus * 6, BLOCK), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    counts = [all_mcus * v * h for _, h, v in _SAMPLING]
    comps, at = [], 0
    for n in counts:
        comps.append(data[at : at + n])
        at += n
    out = [
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xFE, struct.pack(">Q", len(payload))), _QUANT,
        _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in _SAMPLING)), _TABLES,
    ]
    ids = [i for i, _, _ in _SAMPLING]
    out += [_sos(ids, 0, 0, 0, _DC_SHIFT, 0x00), _stuffed(np.zeros(6 * all_mcus, np.uint8))]
    y = comps[0][:, 0].reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(all_mcus, 4)
    dc = np.concatenate([y, comps[1][:, :1], comps[2][:, :1]], 1).ravel()
    for low in range(_DC_SHIFT - 1, -1, -1):
        out += [_sos(ids, 0, 0, low + 1, low, 0x00), _stuffed(dc >> low & 1)]
    for i, own in zip(ids, comps, strict=True):
        high = 64 + (own >> 1 & 63)
        code = np.where(own >> 7, 127 - high, high).astype(np.uint8)  # below 128: never a marker
        for first, last in ((1, 5), (6, 63)):
            out += [_sos([i], first, last, 0, 1, 0x00), code[:, first : last + 1].tobytes()]
        parts = []
        for k in range(0, len(own), 32767):
            run = min(32767, len(own) - k)
            n = run.bit_length() - 1
            head = n << n | run - (1 << n)
            parts += [np.array([head >> b & 1 for b in range(n + 3, -1, -1)], np.uint8), (own[k : k + run, 1:] & 1).ravel()]
        out += [_sos([i], 1, 63, 1, 0, 0x01), _stuffed(np.concatenate(parts))]
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(image: Image) -> bytes:
    """The bytes that encode_payload() stored."""
    (length,) = struct.unpack(">Q", image.comment)
    zz = np.concatenate([c.zz for c in image.components])
    out = ((np.abs(zz) & 127) | (zz < 0) << 7).astype(np.uint8)
    out[:, 0] = zz[:, 0]
    return out.tobytes()[:length]

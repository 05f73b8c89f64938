"""Progressive JPEG to full-resolution RGB tensors, in numpy (operator 5)."""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import ready, unused

#: Images of more pixels aren't decoded: coefficients, planes and tensor take some 40 bytes a pixel.
MAX_PIXELS = 1 << 24
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_U = np.arange(8)
DCT = np.where(_U[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _U[None, :] + 1) * _U[:, None] * np.pi / 16))


@functools.lru_cache(maxsize=256)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits the code's length * 256 + symbol; 0 where no code begins so."""
    table, code, k = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            lo = code << (16 - length)
            span = 1 << (16 - length)
            table[lo:lo + span] = [length << 8 | symbols[k]] * span
            code, k = code + 1, k + 1
        code <<= 1
    return table


class Bits:
    """Reader of one entropy-coded segment, of which the stuffed zeros are gone."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.int64)
        self.words = ((raw[:-4] << 32) | (raw[1:-3] << 24) | (raw[2:-2] << 16) | (raw[3:-1] << 8) | raw[4:]).tolist()
        self.at, self.end = 0, 8 * len(data) + 7

    def get(self, n: int) -> int:
        if not n:
            return 0
        v = self.words[self.at >> 3] >> (40 - n - (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the scan ends early")
        return v

    def symbol(self, table: list[int]) -> int:
        e = table[self.words[self.at >> 3] >> (24 - (self.at & 7)) & 0xFFFF]
        if not e:
            raise ValueError("bad code")
        self.at += e >> 8
        if self.at > self.end:
            raise ValueError("the scan ends early")
        return e & 255

    def signed(self, n: int) -> int:
        v = self.get(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, q: int):
        self.ident, self.h, self.v, self.q = ident, h, v, q

    def shape(self, width: int, height: int, hmax: int, vmax: int):
        self.cols, self.rows = -(-width // (8 * hmax)) * self.h, -(-height // (8 * vmax)) * self.v
        self.own_cols, self.own_rows = -(-(-(-width * self.h // hmax)) // 8), -(-(-(-height * self.v // vmax)) // 8)
        self.coef = array("h")

    def room(self):
        """The 16-bit coefficient array, made when the first scan comes, so a header alone takes no memory."""
        if not self.coef:
            self.coef = array("h", bytes(128 * self.cols * self.rows))


def _ac_first(b: Bits, coef, base, table, lo, hi, al, run):
    if run:
        return run - 1
    k = lo
    while k <= hi:
        rs = b.symbol(table)
        r, s = rs >> 4, rs & 15
        if s:
            k += r
            if k > 63:
                raise ValueError("a run leaves the block")
            coef[base + k] = b.signed(s) * (1 << al)
            k += 1
        elif r == 15:
            k += 16
        else:
            return (1 << r) + b.get(r) - 1
    return 0


def _ac_refine(b: Bits, coef, base, table, lo, hi, al, run):
    one, k = 1 << al, lo

    def correct(at):
        if b.get(1) and not abs(coef[at]) & one:
            coef[at] += one if coef[at] > 0 else -one

    if not run:
        while k <= hi:
            rs = b.symbol(table)
            r, s = rs >> 4, rs & 15
            new = 0
            if s:
                if s != 1:
                    raise ValueError("bad refinement")
                new = one if b.get(1) else -one
            elif r < 15:
                run = (1 << r) + b.get(r)
                break
            while k <= hi:
                at = base + k
                if coef[at]:
                    correct(at)
                elif r:
                    r -= 1
                else:
                    if new:
                        coef[at] = new
                    k += 1
                    break
                k += 1
    if run:
        while k <= hi:
            if coef[base + k]:
                correct(base + k)
            k += 1
        return run - 1
    return 0


def _scan(parts: list[bytes], comps, dc, ac, lo, hi, ah, al, restart, width_mcu, height_mcu, progressive):
    """One scan into the coefficient arrays.  parts are the segments between restart markers."""
    for c in comps:
        c.room()
    if len(comps) > 1:
        units = [(my, mx) for my in range(height_mcu) for mx in range(width_mcu)]
    else:
        units = [(y, x) for y in range(comps[0].own_rows) for x in range(comps[0].own_cols)]
    step = restart or len(units)
    for n, part in enumerate(parts[:-(-len(units) // step)]):
        b, pred, run = Bits(part), [0] * len(comps), 0
        for y, x in units[n * step:(n + 1) * step]:
            for i, c in enumerate(comps):
                places = [(y, x)] if len(comps) == 1 else [(y * c.v + v, x * c.h + h) for v in range(c.v) for h in range(c.h)]
                for row, col in places:
                    base = 64 * (row * c.cols + col)
                    if not progressive:
                        pred[i] += b.signed(b.symbol(dc[i]))
                        c.coef[base] = pred[i]
                        if _ac_first(b, c.coef, base, ac[i], 1, 63, 0, 0):
                            raise ValueError("a run of blocks in a sequential scan")
                    elif lo == 0:
                        if ah:
                            c.coef[base] |= b.get(1) << al
                        else:
                            pred[i] += b.signed(b.symbol(dc[i]))
                            c.coef[base] = pred[i] * (1 << al)
                    else:
                        run = (_ac_refine if ah else _ac_first)(b, c.coef, base, ac[i], lo, hi, al, run)
    if len(parts) * step < len(units):
        raise ValueError("the scan ends early")


def _planes(c: Component, q: np.ndarray) -> np.ndarray:
    """Samples of a component: dequantised, inverse-transformed, levels shifted."""
    blocks = np.zeros((c.rows * c.cols, 64))
    c.room()
    blocks[:, ZIGZAG] = np.frombuffer(c.coef, np.int16).astype(np.float64).reshape(-1, 64) * q
    px = DCT.T @ blocks.reshape(-1, 8, 8) @ DCT
    px = np.clip(np.floor(px + 128.5), 0, 255).astype(np.int64)
    return px.reshape(c.rows, c.cols, 8, 8).swapaxes(1, 2).reshape(c.rows * 8, c.cols * 8)


def upsample(p: np.ndarray, fy: int, fx: int) -> np.ndarray:
    """Chroma at full resolution: factor 2 by the triangle filter (3/4 of the nearest sample, 1/4 of the
    next), other whole factors by repeating samples."""
    if fy == 2:
        e = np.pad(p, ((1, 1), (0, 0)), "edge")
        both = np.stack((3 * e[1:-1] + e[:-2], 3 * e[1:-1] + e[2:]), 1)
        p, unit = both.reshape(-1, p.shape[1]), 4
    else:
        p, unit = np.repeat(p, fy, 0), 1
    if fx == 2:
        e = np.pad(p, ((0, 0), (1, 1)), "edge")
        left, right = (8, 7) if unit == 4 else (1, 2)  # half of the divisor, rounded to and fro
        both = np.stack((3 * e[:, 1:-1] + e[:, :-2] + left, 3 * e[:, 1:-1] + e[:, 2:] + right), 2)
        return both.reshape(p.shape[0], -1) // (4 * unit)
    return np.repeat((p + unit // 2) // unit, fx, 1)


def decode(data: bytes, max_pixels: int = MAX_PIXELS) -> np.ndarray:
    """(height, width, 3) uint8 RGB of a JPEG: progressive, or sequential with Huffman codes.

    The scans fill one coefficient array per component, spectral bands and successive bits in any order;
    gray images get three equal channels.  ValueError for what isn't such a file, and for images of more
    than max_pixels, whose tensors a worker couldn't hold."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, huff, comps, restart, adobe = 2, {}, {}, [], 0, None
    width = height = 0
    progressive = scanned = False
    while True:
        while at < len(data) and data[at] == 0xFF and at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        m, at = data[at + 1], at + 2
        if m == 0xD9:
            break
        if m == 0x01 or 0xD0 <= m <= 0xD7:
            continue
        size = int.from_bytes(data[at:at + 2], "big")
        body, at = data[at + 2:at + size], at + size
        if len(body) != size - 2:
            raise ValueError("a segment is cut off")
        if m == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1:65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide:]
        elif m == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _lookup(bytes(body[1:17]), bytes(body[17:17 + n]))
                body = body[17 + n:]
        elif m in (0xC0, 0xC1, 0xC2):
            if body[0] != 8:
                raise ValueError("samples of more than 8 bits")
            progressive = m == 0xC2
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            comps = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            if not width or not height or len(comps) not in (1, 3) or not all(c.h and c.v for c in comps):
                raise ValueError("a size or number of components that isn't read")
            if width * height > max_pixels:
                raise ValueError(f"{width} x {height} pixels are more than {max_pixels}")
            hmax, vmax = max(c.h for c in comps), max(c.v for c in comps)
            if len(comps) == 1:
                comps[0].h = comps[0].v = hmax = vmax = 1
            for c in comps:
                c.shape(width, height, hmax, vmax)
        elif 0xC3 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            raise ValueError("a coding that isn't read")
        elif m == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif m == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif m == 0xDA:
            end, cuts = at, []
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("the scan has no end")
                if data[end + 1] == 0:
                    end += 2
                elif 0xD0 <= data[end + 1] <= 0xD7:
                    cuts.append(end)
                    end += 2
                elif data[end + 1] == 0xFF:
                    end += 1
                else:
                    break
            parts = [data[a:z].replace(b"\xff\x00", b"\xff") for a, z in zip([at] + [c + 2 for c in cuts], cuts + [end])]
            n = body[0]
            by = {c.ident: c for c in comps}
            own = [by[body[1 + 2 * k]] for k in range(n)]
            tables = [body[2 + 2 * k] for k in range(n)]
            lo, hi, a = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            _scan(parts, own, [huff.get(t >> 4) for t in tables], [huff.get(16 | t & 15) for t in tables], lo, hi, a >> 4, a & 15, restart,
                  -(-width // (8 * hmax)), -(-height // (8 * vmax)), progressive)
            at, scanned = end, True
    if not scanned:
        raise ValueError("no scan")
    full = []
    for c in comps:
        p = _planes(c, quant[c.q])
        if (c.h, c.v) != (hmax, vmax):
            if hmax % c.h or vmax % c.v:
                raise ValueError("chroma that isn't a whole part")
            p = upsample(p[:-(-height * c.v // vmax), :-(-width * c.h // hmax)], vmax // c.v, hmax // c.h)
        full.append(p[:height, :width].astype(np.float64))
    if len(full) == 1:
        rgb = np.repeat(full[0][:, :, None], 3, 2)
    elif adobe == 0:
        rgb = np.stack(full, 2)
    else:
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        rgb = np.stack((y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb), 2)
    return np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)


# --- an encoder, for tests and for tables that come without images -----------------------

_DC = (bytes((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)), bytes(range(12)))
_AC = (bytes((0, 0, 0, 0, 0, 0, 0, 254, 2, 0, 0, 0, 0, 0, 0, 0)), bytes(range(256)))


def _codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


_DC_CODES, _AC_CODES = _codes(*_DC), _codes(*_AC)


class _Out:
    def __init__(self):
        self.bits, self.n = 0, 0

    def put(self, v: int, n: int):
        self.bits, self.n = self.bits << n | v, self.n + n

    def sym(self, codes, s: int):
        self.put(*codes[s])

    def signed(self, v: int, n: int):
        if n:
            self.put(v if v > 0 else v + (1 << n) - 1, n)

    def bytes(self) -> bytes:
        pad = -self.n % 8
        return (self.bits << pad | (1 << pad) - 1).to_bytes((self.n + pad) // 8, "big").replace(b"\xff", b"\xff\x00")


def _write_ac(o: _Out, blocks, lo, hi, al):
    run = 0

    def flush():
        nonlocal run
        if run:
            r = run.bit_length() - 1
            o.sym(_AC_CODES, r << 4)
            o.put(run - (1 << r), r)
            run = 0

    for block in blocks:
        zeros = 0
        for v in block[lo:hi + 1]:
            s = abs(v) >> al
            if not s:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                o.sym(_AC_CODES, 0xF0)
                zeros -= 16
            n = s.bit_length()
            o.sym(_AC_CODES, zeros << 4 | n)
            o.signed(s if v > 0 else -s, n)
            zeros = 0
        if zeros:
            run += 1
            if run == 0x7FFF:
                flush()
    flush()


def _write_ac_refine(o: _Out, blocks, lo, hi, al):
    """As _write_ac, with the correction bits of nonzero coefficients put where a reader passes them."""
    run, held = 0, []

    def flush():
        nonlocal run
        if run:
            r = run.bit_length() - 1
            o.sym(_AC_CODES, r << 4)
            o.put(run - (1 << r), r)
            run = 0
        for bit in held:
            o.put(bit, 1)
        held.clear()

    for block in blocks:
        size = [abs(v) >> al for v in block[lo:hi + 1]]
        last = max((k for k, s in enumerate(size) if s == 1), default=-1)
        zeros, bits = 0, []
        for k, s in enumerate(size):
            if not s:
                zeros += 1
                continue
            while zeros > 15 and k <= last:
                flush()
                o.sym(_AC_CODES, 0xF0)
                zeros -= 16
                for bit in bits:
                    o.put(bit, 1)
                bits = []
            if s > 1:
                bits.append(s & 1)
                continue
            flush()
            o.sym(_AC_CODES, zeros << 4 | 1)
            o.put(int(block[lo + k] > 0), 1)
            for bit in bits:
                o.put(bit, 1)
            bits, zeros = [], 0
        if zeros or bits:
            run += 1
            held += bits
            if run == 0x7FFF or len(held) > 900:
                flush()
    flush()


def quantised(rgb: np.ndarray, q: int, sub: tuple[int, int]) -> list[np.ndarray]:
    """Quantised zigzag coefficients (rows, cols, 64) of Y, Cb, Cr, padded to whole MCUs."""
    h, w = rgb.shape[:2]
    x = rgb.astype(np.float64)
    y = x @ (0.299, 0.587, 0.114)
    planes = [y, (x[..., 2] - y) / 1.772 + 128, (x[..., 0] - y) / 1.402 + 128]
    out = []
    for k, p in enumerate(planes):
        p = np.pad(p, ((0, -h % (8 * sub[0])), (0, -w % (8 * sub[1]))), "edge")
        if k:
            p = p.reshape(p.shape[0] // sub[0], sub[0], p.shape[1] // sub[1], sub[1]).mean((1, 3))
        b = (p - 128).reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2)
        c = np.rint((DCT @ b @ DCT.T) / q).astype(np.int64).reshape(*b.shape[:2], 64)
        out.append(c[..., ZIGZAG])
    return out


def encode(rgb: np.ndarray, q: int = 6, sub: tuple[int, int] = (2, 2), restart: int = 0) -> bytes:
    """A progressive JPEG of ten scans: DC in two and AC in three successive approximations."""
    h, w = rgb.shape[:2]
    planes = quantised(rgb, q, sub)
    seg = lambda m, b: bytes((0xFF, m)) + (len(b) + 2).to_bytes(2, "big") + b
    data = [b"\xff\xd8", seg(0xDB, bytes([0] + [q] * 64)),
            seg(0xC2, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3, 1, sub[1] << 4 | sub[0], 0, 2, 0x11, 0, 3, 0x11, 0])),
            seg(0xC4, b"\x00" + _DC[0] + _DC[1] + b"\x10" + _AC[0] + _AC[1])]
    mcus = [(my, mx) for my in range(planes[1].shape[0]) for mx in range(planes[1].shape[1])]
    if restart:
        data.append(seg(0xDD, restart.to_bytes(2, "big")))

    def dc(ah, al):
        parts = []
        for lo in range(0, len(mcus), restart or len(mcus)):
            o, pred = _Out(), [0, 0, 0]
            for my, mx in mcus[lo:lo + (restart or len(mcus))]:
                for i, p in enumerate(planes):
                    v, u = sub if i == 0 else (1, 1)
                    for yy in range(v):
                        for xx in range(u):
                            c = int(p[my * v + yy, mx * u + xx, 0])
                            if ah:
                                o.put(c >> al & 1, 1)
                            else:
                                d = (c >> al) - pred[i]
                                pred[i] = c >> al
                                n = abs(d).bit_length()
                                o.sym(_DC_CODES, n)
                                o.signed(d, n)
            parts.append(o.bytes())
        scan(parts, [1, 2, 3], 0, 0, ah, al)

    def scan(parts, idents, lo, hi, ah, al):
        data.append(seg(0xDA, bytes([len(idents)]) + b"".join(bytes((i, 0)) for i in idents) + bytes((lo, hi, ah << 4 | al))))
        for k, p in enumerate(parts):
            data.append(p + (bytes((0xFF, 0xD0 + k % 8)) if k < len(parts) - 1 else b""))

    def ac(i, lo, hi, ah, al):
        v, u = sub if i == 0 else (1, 1)
        rows, cols = -(-(-(-h * v // sub[0])) // 8), -(-(-(-w * u // sub[1])) // 8)
        blocks = planes[i][:rows, :cols].reshape(-1, 64).tolist()
        parts = []
        for at in range(0, len(blocks), restart or len(blocks)):
            o = _Out()
            some = blocks[at:at + (restart or len(blocks))]
            if ah:
                _write_ac_refine(o, some, lo, hi, al)
            else:
                _write_ac(o, some, lo, hi, al)
            parts.append(o.bytes())
        scan(parts, [i + 1], lo, hi, ah, al)

    dc(0, 1)
    ac(0, 1, 5, 0, 2)
    ac(2, 1, 63, 0, 1)
    ac(1, 1, 63, 0, 1)
    ac(0, 6, 63, 0, 2)
    ac(0, 1, 63, 2, 1)
    dc(1, 0)
    ac(2, 1, 63, 1, 0)
    ac(1, 1, 63, 1, 0)
    ac(0, 1, 63, 1, 0)
    return b"".join(data) + b"\xff\xd9"


# --- tables ------------------------------------------------------------------------------

OUT = "width int, height int, rgb binary, error string"


def decode_media(media: DataFrame, column: str = "jpeg", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """media (jpeg binary, ...) -> the same rows and columns, with width, height, rgb (height * width * 3
    bytes, row by row) and error added.

    Null and empty bytes, and bytes that aren't a whole JPEG of the kinds read, give null tensors, as do images
    of more than max_pixels and ones for which a worker's memory is too small; error says why, and is null
    for null bytes and for images that were read.  Images are decoded whole, rows alone, so repeats and ties
    have no effect.  An empty table stays empty.  Columns width, height, rgb and error are replaced, all
    others are kept whatever their names.  No shuffle."""
    ready(media.sparkSession)
    names, made = [c for c in media.columns if c not in ("width", "height", "rgb", "error")], unused(media, "m")

    @F.pandas_udf(OUT)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raw in batches:
            rows = []
            for b in raw:
                if b is None:
                    rows.append((None, None, None, None))
                    continue
                try:
                    px = decode(bytes(b), max_pixels)
                    rows.append((px.shape[1], px.shape[0], px.tobytes(), None))
                except (ValueError, KeyError, IndexError, TypeError, OverflowError, MemoryError) as e:
                    rows.append((None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["width", "height", "rgb", "error"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    done = media.select(*[F.col(f"`{c}`") for c in names], read(F.col(f"`{column}`")).alias(made))
    return done.select(*[F.col(f"`{c}`") for c in names], f"{made}.*")


def picture(values: np.ndarray, ident: int) -> np.ndarray:
    """A picture of a vector: an 8 x 8 grid of its values as colours, 24 wide and 17 to 24 high."""
    v = np.resize(np.nan_to_num(np.asarray(values, np.float64)), 64).reshape(8, 8)
    v = np.clip(v * 4, -1, 1)
    px = np.stack((v, v.T, -v), 2) * 110 + 128
    return np.repeat(np.repeat(px, 3, 0), 3, 1)[:17 + ident % 8].astype(np.uint8)


def pictures(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding) -> (vec_id, jpeg): each vector drawn and encoded."""
    ready(vectors.sparkSession)

    @F.pandas_udf("binary")
    def draw(ids: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else encode(picture(v, int(i) if i == i and i is not None else 0)) for i, v in zip(ids, rows)], dtype=object)

    return vectors.select("vec_id", draw("vec_id", "embedding").alias("jpeg"))

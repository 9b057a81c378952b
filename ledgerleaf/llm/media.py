"""Media columns: progressive JPEG to full-resolution RGB tensors, and payloads stored losslessly in JPEG coefficients.

Reading: every scan of a progressive image (spectral selection and successive approximation, DC and AC, first and
refining, interleaved or not, with or without restarts) is accumulated into one coefficient array per component; then
numpy dequantises, applies the inverse cosine transform as one matrix product, upsamples chroma to full resolution
and converts to RGB. A first scan of one component depends on no other, and its restart intervals on none of each
other: those of all images of a batch are Huffman-decoded side by side, a symbol of each in every numpy step. Few
intervals, interleaved scans and refining scans with zeros go through the bit-serial reader, with equal results.

Storing: a cosine transform rounds samples, so the format's lossless unit is the quantised coefficient, and a payload
is stored as such: 64 bytes are the 64 coefficients of a block, all but the last bit in the first scans, entropy-coded
with restarts, the last bit in the refining ones. Y, Cb and Cr (4:2:0) take the blocks in turn. Any progressive
decoder can show these files.

Defined results: a null or empty payload is 64 zero bytes; bytes that are no progressive JPEG give nulls when
``strict`` is off and raise otherwise. Repeated rows each get their row; equal payloads give equal files. An image grows
with its payload up to the format's 65535 x 65535 pixels, some 6 GB, more than a column holds; reading takes memory for
one image at a time. An empty table gives no rows; extra columns are ignored unless kept, and none may be kept under
the name of a column that reading makes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerleaf.llm.shared import text_chunks

BLOCK = 64
SAMPLING = ((2, 2), (1, 1), (1, 1))
BANDS = ((1, 5), (6, 63))
#: Units of 16 x 16 pixels across an image unless it is too tall; the most that the format's 65535 pixels hold.
ACROSS, MOST_UNITS = 64, 65535 // 16
#: Media that are read before their rows are handed on: images or bytes.
HELD_IMAGES, HELD_BYTES = 256, 4 << 20
#: Blocks that one end-of-band run holds at most; restart intervals from which on reading side by side is faster than one after another.
MOST_RUN, FEW_LANES = 32767, 12


def zigzag_order() -> np.ndarray:
    """Natural index of each zigzag position: diagonals by turns up and down."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda rc: (rc[0] + rc[1], rc[0] if (rc[0] + rc[1]) % 2 else rc[1]))
    return np.array([8 * r + c for r, c in cells])


def inverse_transform_matrix() -> np.ndarray:
    """64 x 64: zigzag coefficients of a block to its samples in row order."""
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)
    return np.ascontiguousarray(np.kron(basis, basis).T[zigzag_order()].astype(np.float32))


INVERSE = inverse_transform_matrix()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    across: int = 0
    down: int = 0
    wide: int = 0
    tall: int = 0
    coefficients: np.ndarray | None = None
    blocks: np.ndarray | None = None  # those that its own scans have


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


class Bits:
    """Bit-serial reader of one restart interval."""

    def __init__(self, data: bytes) -> None:
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n]:
            value = value << 1 | b
        self.at += n
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code, length = 0, 0
        while length < 16:
            code = code << 1 | self.bits[self.at]
            self.at += 1
            length += 1
            if (found := codes.get((length, code))) is not None:
                return found
        raise ValueError("no such Huffman code")

    def extended(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >= 1 << (size - 1) else value - (1 << size) + 1


_MARKER, _RESTART = re.compile(rb"\xff[^\x00\xd0-\xd7]"), re.compile(rb"\xff[\xd0-\xd7]")


def _intervals(data: bytes, start: int) -> tuple[list[bytes], int]:
    """Entropy-coded restart intervals from ``start``, unstuffed, and where the next marker stands."""
    found = _MARKER.search(data, start)
    if not found:
        raise ValueError("the scan has no end")
    return [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(data[start : found.start()])], found.start()


@lru_cache(64)
def _lookup(codes: tuple[tuple[int, int, int], ...]) -> np.ndarray:
    """For every 16 bits the length and the symbol (length << 8 | symbol) of the code that they begin with; 0 for none."""
    out = np.zeros(1 << 16, np.uint16)
    for length, code, symbol in codes:
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


@dataclass
class FirstScan:
    """A first scan of one component: its restart intervals, code, coefficients, blocks, band and shift."""

    intervals: list[bytes]
    codes: dict[tuple[int, int], int]
    comp: Component
    blocks: np.ndarray
    first: int
    last: int
    low: int
    step: int


class Lanes:
    """Restart intervals of any scans and images, read side by side: each step takes one symbol of every interval."""

    def __init__(self, scans: list[FirstScan]) -> None:
        pieces, owner, start, count, place = [], [], [], [], 0
        for k, scan in enumerate(scans):
            for i, piece in enumerate(scan.intervals):
                n = len(scan.blocks[i * scan.step : (i + 1) * scan.step])
                if n:
                    pieces.append(piece)
                    owner.append(k)
                    start.append(place + i * scan.step)
                    count.append(n)
            place += len(scan.blocks)
        sizes = np.array([len(x) for x in pieces], np.int64)
        data = np.frombuffer(b"".join(x + bytes(4) for x in pieces) + bytes(4), np.uint8).astype(np.uint32)
        self.words = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        begin = np.cumsum(sizes + 4) - sizes - 4
        self.at, self.end = begin * 8, (begin + sizes) * 8
        self.owner, self.scans = np.array(owner, np.int64), scans
        tables: dict[tuple, int] = {}
        of_scan = [tables.setdefault(tuple((n, c, v) for (n, c), v in scan.codes.items()), len(tables)) for scan in scans]
        self.symbols = np.concatenate([_lookup(t) for t in tables])
        self.table = np.array(of_scan, np.int64)[self.owner] << 16
        # Blocks as places in one array of all scans' coefficients.
        bases = np.cumsum([0, *(scan.comp.coefficients.size for scan in scans)])
        self.blocks = np.concatenate([scan.blocks * BLOCK + base for scan, base in zip(scans, bases, strict=False)])
        self.block, self.stop = np.array(start, np.int64), np.array(start, np.int64) + np.array(count, np.int64)
        self.out = np.zeros(bases[-1], np.int32)
        self.bases = bases
        self.broken = np.zeros(len(scans), bool)

    def bits(self, at: np.ndarray) -> np.ndarray:
        """The next 16 bits."""
        return self.words[at >> 3] >> (8 - (at & 7)).astype(np.uint32) & 0xFFFF

    def keep(self, chosen: np.ndarray) -> None:
        for name in ("at", "end", "owner", "table", "block", "stop"):
            setattr(self, name, getattr(self, name)[chosen])

    def symbol(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, whether it could be read) of every interval, and move on; those that can't be read end."""
        found = self.symbols[self.table + self.bits(self.at)]
        self.at = self.at + (found >> 8)
        return (found & 255).astype(np.int64), (found > 0) & (self.at <= self.end)

    def number(self, size: np.ndarray) -> np.ndarray:
        """The next ``size`` bits of each as a number, and move on."""
        value = (self.bits(self.at) >> (16 - size).astype(np.uint32)).astype(np.int64)
        self.at = self.at + size
        return value

    def finish(self) -> np.ndarray:
        """Put what was read into the components; for each scan whether it was broken."""
        for k, scan in enumerate(self.scans):
            if not self.broken[k]:
                band = slice(scan.first, scan.last + 1)
                scan.comp.coefficients[scan.blocks, band] = self.out[self.bases[k] : self.bases[k + 1]].reshape(-1, BLOCK)[scan.blocks, band]
        return self.broken

    def read_dc(self) -> np.ndarray:
        low = np.array([scan.low for scan in self.scans])[self.owner]
        before = np.zeros(len(self.at), np.int64)
        while len(self.at):
            size, good = self.symbol()
            good &= size <= 15
            size = np.where(good, size, 0)
            value = self.number(size)
            before = before + np.where((size > 0) & (value < 1 << np.maximum(size - 1, 0)), value - (1 << size) + 1, value)
            self.broken[self.owner[~good | (self.at > self.end)]] = True
            self.out[self.blocks[self.block]] = before << low
            self.block = self.block + 1
            going = good & (self.block < self.stop)
            if not going.all():
                before, low = before[going], low[going]
                self.keep(going)
        return self.finish()

    def read_ac(self) -> np.ndarray:
        first, last, low = (np.array([getattr(scan, name) for scan in self.scans])[self.owner] for name in ("first", "last", "low"))
        k = first
        while len(self.at):
            symbol, good = self.symbol()
            run, size = symbol >> 4, symbol & 15
            some = size > 0
            ends = ~some & (run < 15)
            value = self.number(np.where(some, size, np.where(ends, run, 0)))
            k = k + np.where(ends, 0, run)
            good &= (k <= last) | ends
            negative = value < 1 << np.maximum(size - 1, 0)
            whole = np.where(negative, -(((1 << size) - 1 - value) << low), value << low)
            here = some & good
            self.out[self.blocks[self.block[here]] + k[here]] = whole[here]
            k = k + 1
            full = ends | (k > last)
            self.block = self.block + np.where(ends, (1 << run) + value, full)
            k = np.where(full, first, k)
            self.broken[self.owner[~good | (self.at > self.end)]] = True
            going = good & (self.block < self.stop)
            if not going.all():
                k, first, last, low = k[going], first[going], last[going], low[going]
                self.keep(going)
        return self.finish()


class Decoder:
    def __init__(self, data: bytes) -> None:
        self.data, self.image = data, Image()
        self.dc: dict[int, dict] = {}
        self.ac: dict[int, dict] = {}
        self.every = 0
        self.firsts: list[FirstScan] = []
        self.later: list[Callable[[], None]] = []

    def read(self) -> Image:
        """Take in all segments. First scans of one component wait in ``firsts``, as they depend on no other scan; the
        others wait in ``later``, in order, until these are read."""
        data, at = self.data, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            if kind == 0xD9:
                return self.image
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                self._quant(body)
            elif kind == 0xC4:
                self._huffman(body)
            elif kind == 0xC2:
                self._frame(body)
            elif kind == 0xDD:
                self.every = struct.unpack(">H", body)[0]
            elif kind == 0xFE:
                self.image.comments.append(body)
            elif kind == 0xDA:
                at = self._scan(body, at)
            elif 0xC0 <= kind <= 0xCF and kind != 0xC8:
                raise ValueError("not a progressive Huffman-coded JPEG")

    def _quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, ident = body[at] >> 4, body[at] & 15
            kind, size = (">u2", 128) if wide else ("u1", 64)
            self.image.quant[ident] = np.frombuffer(body, kind, 64, at + 1).astype(np.float32)
            at += 1 + size

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            kind, ident, counts = body[at] >> 4, body[at] & 15, body[at + 1 : at + 17]
            at += 17
            codes, code = {}, 0
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    codes[length, code] = body[at]
                    code, at = code + 1, at + 1
                code <<= 1
            (self.ac if kind else self.dc)[ident] = codes

    def _frame(self, body: bytes) -> None:
        im = self.image
        precision, im.height, im.width, n = struct.unpack_from(">BHHB", body)
        if precision != 8:
            raise ValueError("only 8-bit samples are read")
        im.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        most_h, most_v = max(c.h for c in im.components), max(c.v for c in im.components)
        mcus_x, mcus_y = -(-im.width // (8 * most_h)), -(-im.height // (8 * most_v))
        for c in im.components:
            c.across, c.down = -(-(-(-im.width * c.h // most_h)) // 8), -(-(-(-im.height * c.v // most_v)) // 8)
            c.wide, c.tall = mcus_x * c.h, mcus_y * c.v
            c.coefficients = np.zeros((c.tall * c.wide, BLOCK), np.int32)
            c.blocks = (np.arange(c.down)[:, None] * c.wide + np.arange(c.across)).ravel()

    def _scan(self, body: bytes, start: int) -> int:
        parts = []
        for i in range(body[0]):
            comp = next(c for c in self.image.components if c.ident == body[1 + 2 * i])
            parts.append((comp, self.dc.get(body[2 + 2 * i] >> 4), self.ac.get(body[2 + 2 * i] & 15)))
        first, last, approx = body[-3:]
        intervals, end = _intervals(self.data, start)
        high, low = approx >> 4, approx & 15
        if len(parts) > 1:
            im = self.image
            units = []
            for m in range((parts[0][0].wide // parts[0][0].h) * (parts[0][0].tall // parts[0][0].v)):
                y, x = divmod(m, im.components[0].wide // im.components[0].h)
                units.append([(k, (y * c.v + j) * c.wide + x * c.h + i) for k, (c, _, _) in enumerate(parts) for j in range(c.v) for i in range(c.h)])
            every = self.every
            self.later.append(lambda: self._dc_serial(parts, units, intervals, high, low, every))
            return end
        comp, dc, ac = parts[0]
        blocks = comp.blocks
        every = self.every or len(blocks)
        if not high:
            self.firsts.append(FirstScan(intervals, (ac if first else dc) or {}, comp, blocks, first, last, low, every))
        elif not first:
            self.later.append(lambda: self._dc_refine(comp, blocks, intervals, low, every))
        else:
            self.later.append(lambda: self._refined(comp, ac, blocks, intervals, first, last, low, every))
        return end

    def read_serially(self, scan: FirstScan) -> None:
        """A first scan bit by bit."""
        for i, piece in enumerate(scan.intervals):
            blocks = scan.blocks[i * scan.step : (i + 1) * scan.step].tolist()
            if scan.first:
                self._ac_first(scan.comp, scan.codes, blocks, Bits(piece), scan.first, scan.last, scan.low)
            else:
                self._dc_serial([(scan.comp, scan.codes, None)], [[(0, b)] for b in blocks], [piece], 0, scan.low, 0)

    def _dc_refine(self, comp: Component, blocks: np.ndarray, intervals: list[bytes], low: int, every: int) -> None:
        for i, piece in enumerate(intervals):
            part = blocks[i * every : (i + 1) * every]
            comp.coefficients[part, 0] |= np.unpackbits(np.frombuffer(piece, np.uint8), count=len(part)).astype(np.int32) << low

    def _refined(self, comp: Component, codes: dict, blocks: np.ndarray, intervals: list[bytes], first: int, last: int, low: int, every: int) -> None:
        for i, piece in enumerate(intervals):
            part = blocks[i * every : (i + 1) * every]
            if not self._ac_all(comp, codes, part, piece, first, last, low):
                self._ac_refine(comp, codes, part.tolist(), Bits(piece), first, last, low)

    def _ac_all(self, comp: Component, codes: dict, blocks: np.ndarray, data: bytes, first: int, last: int, low: int) -> bool:
        """Refine bands without a zero whose blocks end in one run: the run's code, then a bit a coefficient."""
        bits = Bits(data[:8])
        run, size = divmod(bits.symbol(codes), 16)
        n = last - first + 1
        if size or run == 15 or (1 << run) + bits.take(run) != len(blocks):
            return False
        band = comp.coefficients[blocks, first : last + 1]
        if not band.all():
            return False
        more = np.unpackbits(np.frombuffer(data, np.uint8), count=bits.at + len(blocks) * n)[bits.at :].reshape(len(blocks), n)
        comp.coefficients[blocks, first : last + 1] = band + np.sign(band) * (more.astype(np.int32) << low)
        return True

    def _dc_serial(self, parts: list, units: list[list[tuple[int, int]]], intervals: list[bytes], high: int, low: int, every: int) -> None:
        step = every or len(units)
        for i, piece in enumerate(intervals):
            bits, before = Bits(piece), [0] * len(parts)
            for unit in units[i * step : (i + 1) * step]:
                for k, block in unit:
                    comp, codes, _ = parts[k]
                    if high:
                        comp.coefficients[block, 0] |= bits.take(1) << low
                    else:
                        before[k] += bits.extended(bits.symbol(codes))
                        comp.coefficients[block, 0] = before[k] << low

    def _ac_first(self, comp: Component, codes: dict, blocks: list[int], bits: Bits, first: int, last: int, low: int) -> None:
        skip = 0
        for block in blocks:
            if skip:
                skip -= 1
                continue
            k = first
            while k <= last:
                run, size = divmod(bits.symbol(codes), 16)
                if size:
                    k += run
                    value = bits.extended(size)
                    comp.coefficients[block, k] = (value << low) if value >= 0 else -(-value << low)
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    skip = (1 << run) - 1 + (bits.take(run) if run else 0)
                    break

    def _ac_refine(self, comp: Component, codes: dict, blocks: list[int], bits: Bits, first: int, last: int, low: int) -> None:
        skip, one = 0, 1 << low

        def correct(row: np.ndarray, k: int) -> None:
            if bits.take(1):
                row[k] += one if row[k] > 0 else -one

        for block in blocks:
            row, k = comp.coefficients[block], first
            if not skip:
                while k <= last:
                    run, size = divmod(bits.symbol(codes), 16)
                    if not size and run < 15:
                        skip = (1 << run) + (bits.take(run) if run else 0)
                        break
                    new = (one if bits.take(1) else -one) if size else 0
                    while k <= last:
                        if row[k]:
                            correct(row, k)
                        elif run:
                            run -= 1
                        else:
                            break
                        k += 1
                    if k <= last and new:
                        row[k] = new
                    k += 1
            if skip:
                for j in range(k, last + 1):
                    if row[j]:
                        correct(row, j)
                skip -= 1


def read_many(files: list[bytes], strict: bool = True) -> list[Image | None]:
    """All scans of progressive JPEGs, accumulated into their components' coefficients (zigzag order).

    A file that is broken raises, or is None if not ``strict``.
    """
    faults = (ValueError, IndexError, KeyError, StopIteration, TypeError, struct.error)
    out: list[Image | None] = []
    decoders = []
    for data in files:
        decoder = Decoder(data)
        try:
            decoder.read()
        except faults as fault:
            if strict:
                raise ValueError("no readable progressive JPEG") from fault
            decoder.image = None
        decoders.append(decoder)
    good = [d for d in decoders if d.image]
    bad: set[int] = set()
    for wanted, read in ((lambda f: not f.first, Lanes.read_dc), (lambda f: f.first, Lanes.read_ac)):
        scans = [(i, f) for i, d in enumerate(good) for f in d.firsts if wanted(f)]
        if scans and sum(len(f.intervals) for _, f in scans) >= FEW_LANES:
            bad |= {i for (i, _), broken in zip(scans, read(Lanes([f for _, f in scans])), strict=True) if broken}
        else:
            for i, f in scans:
                try:
                    good[i].read_serially(f)
                except faults:
                    bad.add(i)
    for i, decoder in enumerate(good):
        try:
            if i in bad:
                raise ValueError("a scan is broken")
            for scan in decoder.later:
                scan()
        except faults as fault:
            if strict:
                raise ValueError("no readable progressive JPEG") from fault
            decoder.image = None
    return [d.image for d in decoders]


def read_progressive(data: bytes) -> Image:
    return read_many([data])[0]


def to_rgb(im: Image) -> np.ndarray:
    """height x width x 3 bytes; one component is grey."""
    most_h, most_v = max(c.h for c in im.components), max(c.v for c in im.components)
    planes = []
    for c in im.components:
        samples = (c.coefficients * im.quant[c.quant]).astype(np.float32) @ INVERSE
        plane = samples.reshape(c.tall, c.wide, 8, 8).swapaxes(1, 2).reshape(c.tall * 8, c.wide * 8)
        plane = np.clip(np.rint(plane, out=plane) + 128, 0, 255)
        if most_v > c.v:
            plane = plane.repeat(most_v // c.v, 0)
        if most_h > c.h:
            plane = plane.repeat(most_h // c.h, 1)
        planes.append(plane[: im.height, : im.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.empty((im.height, im.width, 3), np.uint8)
    for i, plane in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        rgb[:, :, i] = np.clip(np.rint(plane, out=plane), 0, 255, out=plane)
    return rgb


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _code(kind: int, by_length: dict[int, tuple[int, ...]]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The segment of a Huffman code given as the symbols of each length, and (code, length) of each symbol."""
    counts = bytes(len(by_length.get(n, ())) for n in range(1, 17))
    code, out = 0, {}
    for n in range(1, 17):
        for symbol in by_length.get(n, ()):
            out[symbol] = code, n
            code += 1
        code <<= 1
    return _segment(0xC4, bytes([kind << 4]) + counts + bytes(v for n in sorted(by_length) for v in by_length[n])), out


def _start(ident: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, ident, 0, first, last, high << 4 | low]))


_QUANT = _segment(0xDB, bytes([0, *[1] * 64]))
_SAMPLED = b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(SAMPLING))
#: Blocks a restart interval of the first scans; the others have none.
STEP = 8
#: Sizes of numbers by the length of their code, the commonest in texts first; a refining scan has one run of blocks.
_DC_TABLE, _DC_CODES = _code(0, {3: (3, 4, 5, 6, 7, 2), 4: (1, 0), 5: (8,)})
_AC_TABLE, _AC_CODES = _code(1, {2: (4, 6, 5), 3: (3,), 4: (2,), 5: (1,), 6: (7,)})
_RUN_TABLE, _RUN_CODES = _code(1, {4: tuple(r << 4 for r in range(15))})
_EVERY, _NEVER = _segment(0xDD, struct.pack(">H", STEP)), _segment(0xDD, b"\x00\x00")


def _by_size(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([codes.get(n, (0, 0))[0] for n in range(9)], np.uint32), np.array([codes.get(n, (0, 0))[1] for n in range(9)], np.int64)


_DC_BY_SIZE, _AC_BY_SIZE = _by_size(_DC_CODES), _by_size(_AC_CODES)
_SIZE_OF = np.array([int(i).bit_length() for i in range(256)], np.int64)


def _coded(values: np.ndarray, by_size: tuple[np.ndarray, np.ndarray], intervals: np.ndarray) -> list[bytes]:
    """Rows of numbers, each as its size's code and its bits; rows of an interval (their first rows given) end on a
    whole byte, filled with ones."""
    size = _SIZE_OF[np.abs(values)]
    code, length = by_size[0][size], by_size[1][size] + size
    low = (values + np.where(values < 0, (1 << size) - 1, 0)).astype(np.uint32)
    total = np.add.reduceat(length.sum(1), intervals)
    fill = -total % 8
    # One column more, empty but in an interval's last row, where it is the filling.
    rows = np.append(intervals[1:], len(values)) - 1
    wide, whole = np.zeros((len(values), values.shape[1] + 1), np.int64), np.zeros((len(values), values.shape[1] + 1), np.uint32)
    wide[:, :-1], whole[:, :-1] = length, code << size.astype(np.uint32) | low
    wide[rows, -1], whole[rows, -1] = fill, (1 << fill) - 1
    left = (whole.ravel() << (16 - wide.ravel()).astype(np.uint32)).astype(">u2").view(np.uint8)
    bits = np.unpackbits(left).reshape(-1, 16)[np.arange(16) < wide.reshape(-1, 1)]
    data, ends = np.packbits(bits).tobytes(), np.cumsum(total + fill) // 8
    return [data[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _with_restarts(pieces: list[bytes]) -> bytes:
    return b"".join(x if i == 0 else bytes([0xFF, 0xD0 + (i - 1) % 8]) + x for i, x in enumerate(pieces))


def store_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients are the bytes of ``payload``, a positive multiple of 64 long."""
    return store_many([payload])[0]


def store_many(payloads: list[bytes]) -> list[bytes]:
    """``store_payload`` of each, coded together: the restart intervals of all follow one another."""
    shapes, bounds = [], [0]
    for payload in payloads:
        n = len(payload) // BLOCK
        if not n or len(payload) % BLOCK:
            raise ValueError("a payload is a positive multiple of 64 bytes")
        units = -(-n // 6)
        down = -(-units // max(ACROSS, -(-units // MOST_UNITS)))
        across = -(-units // down)
        if across > MOST_UNITS:
            raise ValueError("a payload of over 6 GB is too large for one image")
        shapes.append((across, down))
        bounds += [bounds[-1] + across * down * k for k in (4, 5, 6)]
    starts = np.array(bounds)
    flat = b"".join(x + bytes(across * down * 6 * BLOCK - len(x)) for x, (across, down) in zip(payloads, shapes, strict=True))
    blocks = np.frombuffer(flat, np.uint8).reshape(-1, BLOCK)
    # No coefficient is 0 after the first scans: bytes from 128 on become 2 and more, the others -2 and less.
    numbers = blocks.astype(np.int32) - np.where(blocks < 128, 129, 126).astype(np.int32)
    per = -(-np.diff(starts) // STEP)  # intervals of each image's component
    cuts = np.concatenate([[0], np.cumsum(per)])
    intervals = np.repeat(starts[:-1], per) + (np.arange(cuts[-1]) - np.repeat(cuts[:-1], per)) * STEP
    dc = numbers[:, 0] >> 1
    change = np.diff(dc, prepend=0)
    change[intervals] = dc[intervals]
    high = np.sign(numbers) * (np.abs(numbers) >> 1)
    parts = [(0, 0, _coded(change[:, None], _DC_BY_SIZE, intervals)), *((first, last, _coded(high[:, first : last + 1], _AC_BY_SIZE, intervals)) for first, last in BANDS)]
    dc_low, ac_low = (numbers[:, 0] & 1).astype(np.uint8), (np.abs(numbers) & 1).astype(np.uint8)
    files = []
    for k, (payload, (across, down)) in enumerate(zip(payloads, shapes, strict=True)):
        out = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), _QUANT, _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + _SAMPLED), _DC_TABLE, _AC_TABLE, _EVERY]
        for i in range(3):
            lo, hi = cuts[3 * k + i], cuts[3 * k + i + 1]
            out += [part for first, last, pieces in parts for part in (_start(i + 1, first, last, 0, 1), _with_restarts(pieces[lo:hi]))]
        out += [_NEVER, _RUN_TABLE]
        for i in range(3):
            a, b = bounds[3 * k + i], bounds[3 * k + i + 1]
            out += [_start(i + 1, 0, 0, 1, 0), np.packbits(dc_low[a:b]).tobytes().replace(b"\xff", b"\xff\x00")]
            out += [part for first, last in BANDS for part in (_start(i + 1, first, last, 1, 0), _refining(ac_low[a:b, first : last + 1]))]
        files.append(b"".join([*out, b"\xff\xd9"]))
    return files


def _refining(low: np.ndarray) -> bytes:
    """Last bits of a band without zeros: runs of blocks, each a code and the bits of its blocks."""
    pieces = []
    for lo in range(0, len(low), MOST_RUN):
        n = min(MOST_RUN, len(low) - lo)
        run = n.bit_length() - 1
        code, length = _RUN_CODES[run << 4]
        lead = f"{code:0{length}b}{n - (1 << run):0{run}b}" if run else f"{code:0{length}b}"
        pieces += [np.frombuffer(lead.encode(), np.uint8) - 48, low[lo : lo + n].ravel()]
    return np.packbits(np.concatenate(pieces)).tobytes().replace(b"\xff", b"\xff\x00")


def stored_payload(im: Image) -> bytes:
    """The payload that ``store_payload`` put into an image, from its coefficients."""
    size = next((int(m[1]) for c in im.comments if (m := re.fullmatch(rb"payload=(\d+)", c))), None)
    if size is None:
        raise ValueError("the image holds no payload")
    c = np.concatenate([x.coefficients for x in im.components])
    return (c + np.where(c < 0, 129, 126)).astype(np.uint8).tobytes()[:size]


def store_texts(docs: DataFrame) -> DataFrame:
    """Every whole text of ``docs`` (doc_id, text) as a stored image: doc_id, n_bytes, media."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                raw, at = data.tobytes(), offsets.tolist()
                media = store_many([raw[a:b] + bytes(-(b - a) % BLOCK or (0 if b > a else BLOCK)) for a, b in zip(at, at[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


MADE = ("height", "width", "means", "payload", "rgb")


def read_media(media: DataFrame, tensors: bool = True, payloads: bool = True, strict: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Read every image of ``media`` (doc_id, media) into a full-resolution RGB tensor.

    Returns doc_id, height, width, means (of R, G and B), payload (null unless asked for and held) and rgb (height x
    width x 3 bytes in row order; null unless asked for), and the columns named in ``keep`` as they are.
    """
    if clash := {"doc_id", "media", *MADE} & set(keep):
        raise ValueError(f"columns made by reading can't be kept: {', '.join(sorted(clash))}")
    chosen = media.select("doc_id", "media", *keep)
    made = "height int, width int, means array<double>, payload binary, rgb binary"
    schema = T.StructType([chosen.schema["doc_id"], *T.StructType.fromDDL(made).fields, *(chosen.schema[c] for c in keep)])

    def one(im: Image | None) -> tuple:
        if im is None:
            return None, None, None, None, None
        rgb = to_rgb(im)
        held = payloads and any(c.startswith(b"payload=") for c in im.comments)
        means = (rgb.reshape(-1, 3).sum(0, dtype=np.int64) / (im.width * im.height)).tolist()
        return im.height, im.width, means, stored_payload(im) if held else None, rgb.tobytes() if tensors else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.binary(), pa.binary()]
        for batch in batches:
            files, lo, held = [], 0, 0
            for i, x in enumerate(batch.column(1)):
                files.append(x.as_py() or b"")
                held += len(files[-1])
                if i + 1 == batch.num_rows or len(files) == HELD_IMAGES or held > HELD_BYTES:
                    rows = [one(im) for im in read_many(files, strict)]
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    kept = [c.slice(lo, len(rows)) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([kept[0], *columns, *kept[2:]], names=schema.names)
                    files, lo, held = [], i + 1, 0

    return chosen.mapInArrow(run, schema)

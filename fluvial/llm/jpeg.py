"""Progressive JPEG in numpy: many images at a time, a lane for each restart interval.

Entropy coding is sequential within a restart interval alone, so all intervals of a scan, of all images with
the same tables and script, are decoded side by side: each step takes one symbol from each lane.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

#: Fixed value: natural position of each zigzag index.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Basis of the inverse transform, scaled to integers, so that sums in double precision are exact.
_SCALE = 1 << 13
_BASIS = np.array([[round(_SCALE * (np.sqrt(0.125) if k == 0 else 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)) for x in range(8)] for k in range(8)], float)
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


@dataclass(frozen=True)
class Component:
    id: int
    h: int
    v: int
    table: int = 0


@dataclass(frozen=True)
class Scan:
    components: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int
    dc: tuple[int, ...] = ()
    ac: tuple[int, ...] = ()


@dataclass
class Frame:
    width: int
    height: int
    components: tuple[Component, ...]
    restart: int = 0
    quant: dict[int, bytes] = field(default_factory=dict)
    comment: bytes = b""
    scans: list[tuple[Scan, bytes, dict]] = field(default_factory=list)

    def grid(self, c: int) -> tuple[int, int, int, int]:
        """Rows and columns of a component's blocks: stored (whole MCUs), and coded when it stands alone."""
        k = self.components[c]
        hmax, vmax = max(x.h for x in self.components), max(x.v for x in self.components)
        mx, my = -(-self.width // (8 * hmax)), -(-self.height // (8 * vmax))
        return my * k.v, mx * k.h, -(-(-(-self.height * k.v // vmax)) // 8), -(-(-(-self.width * k.h // hmax)) // 8)


def parse(data: bytes) -> Frame:
    """Headers, and the entropy-coded bytes of each scan with the Huffman tables that hold there."""
    frame, tables, at = None, {}, 2
    quant, restart, comment = {}, 0, b""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at < len(data):
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15], body = body[: 1 + 64 * wide], body[1 + 64 * wide :]
        elif kind == 0xC4:
            tables = dict(tables)
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = body[1 : 17 + n], body[17 + n :]
        elif kind == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            frame = Frame(width, height, tuple(Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)))
        elif 0xC0 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("only progressive Huffman JPEG is read here")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            comment = body
        elif kind == 0xDA:
            n = body[0]
            numbers = {c.id: i for i, c in enumerate(frame.components)}
            scan = Scan(tuple(numbers[body[1 + 2 * i]] for i in range(n)), body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15, tuple(body[2 + 2 * i] >> 4 for i in range(n)), tuple(body[2 + 2 * i] & 15 for i in range(n)))
            found = _MARKER.search(data, at)
            end = found.start() if found else len(data)
            frame.scans.append((scan, data[at:end], tables))
            at = end
    else:
        raise ValueError("the image has no end")
    frame.quant, frame.restart, frame.comment = quant, restart, comment
    _checked(frame, len(data))
    return frame


def _checked(frame: Frame, size: int) -> None:
    """Raises ValueError where headers can't belong to a whole image of so many bytes."""
    parts = frame.components
    if not frame.scans or len(parts) not in (1, 3) or not frame.width or not frame.height:
        raise ValueError("no image of one or three components")
    if any(not (1 <= c.h <= 4 and 1 <= c.v <= 4) or max(x.h for x in parts) % c.h or max(x.v for x in parts) % c.v for c in parts):
        raise ValueError("sampling that isn't read here")
    if any(len(frame.quant[c.table]) not in (65, 129) or len(frame.quant[c.table]) != 1 + 64 * (1 + (frame.quant[c.table][0] >> 4)) for c in parts):
        raise ValueError("a cut quantisation table")
    # a first scan has a bit a block at least
    if sum(int(np.prod(frame.grid(c)[:2])) for c in range(len(parts))) > 8 * size:
        raise ValueError("fewer bits than blocks")
    for scan, _, tables in frame.scans:
        if not (0 <= scan.first <= scan.last <= 63 and scan.low <= 13) or (scan.first == 0) != (scan.last == 0) or (scan.first and len(scan.components) != 1):
            raise ValueError("a scan that isn't progressive")
        used = [] if scan.first == 0 and scan.high else list(scan.dc) if scan.first == 0 else [16 + scan.ac[0]]
        if any(len(tables[t]) < 16 or len(tables[t]) != 16 + sum(tables[t][:16]) for t in used):
            raise ValueError("a cut Huffman table")
        if any(code >= 1 << length for t in used for _, code, length in _codes(tables[t])) or (scan.first == 0 and any(s > 15 for t in used for s, _, _ in _codes(tables[t]))):
            raise ValueError("no Huffman code")


def _codes(table: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table as its segment states it."""
    code, at, found = 0, 16, []
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            found.append((table[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return found


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: length of the code * 256 + symbol."""
    if table not in _LOOKUPS:
        out = np.zeros(1 << 16, np.int32)
        for symbol, code, length in _codes(table):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
        _LOOKUPS[table] = out
    return _LOOKUPS[table]


def _order(frame: Frame, scan: Scan) -> tuple[list[np.ndarray], int]:
    """Blocks of a scan in coding order, (MCU, place in it) with the component of each place; blocks a MCU."""
    if len(scan.components) == 1:
        _, wide, rows, cols = frame.grid(scan.components[0])
        return [(np.arange(rows)[:, None] * wide + np.arange(cols)).ravel()], 1
    places = []
    for c in scan.components:
        k = frame.components[c]
        high, wide, _, _ = frame.grid(c)
        my, mx = high // k.v, wide // k.h
        for v in range(k.v):
            for h in range(k.h):
                places.append(((np.arange(my)[:, None] * k.v + v) * wide + np.arange(mx) * k.h + h).ravel())
    return places, len(places)


class _Lanes:
    """Restart intervals of one scan of several images: bytes without stuffing, where each begins, its MCUs."""

    def __init__(self, parts: list[bytes], mcus: list[int], restart: list[int]):
        raw = np.frombuffer(b"".join(parts) + b"\0" * 8, np.uint8)
        at = np.cumsum([0] + [len(p) for p in parts])
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[ff + 1]
        marks = ff[(after >= 0xD0) & (after <= 0xD7)]
        drop = np.zeros(len(raw), bool)
        drop[ff[after == 0] + 1] = True
        drop[marks] = drop[marks + 1] = True
        begins = np.sort(np.concatenate([at[:-1], marks + 2]))
        self.image = np.searchsorted(at, begins, "right") - 1
        first = np.searchsorted(self.image, np.arange(len(parts)))
        self.rank = np.arange(len(begins)) - first[self.image]
        every = np.array([r or m for r, m in zip(restart, mcus)])[self.image]
        self.mcus = np.minimum(every, np.array(mcus)[self.image] - self.rank * every)
        self.first_mcu = self.rank * every
        self.start = (begins - np.cumsum(drop)[begins] + drop[begins]) * 8
        self.end = np.append(self.start[1:], (len(raw) - 8 - np.count_nonzero(drop)) * 8)
        self.data = raw[~drop]
        wide = np.concatenate([self.data, np.zeros(8, np.uint8)]).astype(np.int64)
        n = len(self.data)
        self.window = wide[:n] << 32 | wide[1 : n + 1] << 24 | wide[2 : n + 2] << 16 | wide[3 : n + 3] << 8 | wide[4 : n + 4]
        keep = self.mcus > 0
        if not keep.all():
            for name in ("image", "rank", "mcus", "first_mcu", "start", "end"):
                setattr(self, name, getattr(self, name)[keep])


def _within(bit: np.ndarray, end: np.ndarray) -> None:
    if (bit > end).any():
        raise ValueError("the bytes of a scan end too early")


def _dc(scan: Scan, lanes: _Lanes, coefs, blocks, tables) -> None:
    """blocks(place, lane numbers, MCU within the lane): component and block of each."""
    bit = lanes.start.copy()
    places = blocks.places
    last = np.zeros((len(bit), len(coefs)), np.int64)
    for m in range(int(lanes.mcus.max(initial=0))):
        on = np.flatnonzero(lanes.mcus > m)
        for p in range(len(places)):
            c, block = blocks(p, on, m)
            if scan.high:
                value = lanes.data[bit[on] >> 3] >> (7 - (bit[on] & 7)).astype(np.uint8) & 1
                coefs[c][block, 0] |= value.astype(np.int16) << scan.low
                bit[on] += 1
                continue
            shift, window = bit[on] & 7, lanes.window[bit[on] >> 3]
            entry = tables[c][window >> 24 - shift & 0xFFFF]
            length, size = entry >> 8, (entry & 255).astype(np.int64)
            value = window >> 40 - shift - length - size & (1 << size) - 1
            value = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
            last[on, c] += np.where(size > 0, value, 0)
            coefs[c][block, 0] = last[on, c] << scan.low
            bit[on] += length + size
    _within(bit, lanes.end)


_EXTRA = np.array([rs & 15 or (rs >> 4 if rs >> 4 < 15 else 0) for rs in range(256)])


def _ac_first(scan: Scan, lanes: _Lanes, coef: np.ndarray, blocks, table: np.ndarray) -> None:
    flat = coef.reshape(-1)
    lane = np.arange(len(lanes.start))
    bit, number, k = lanes.start.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), scan.first, np.int64)
    todo, ends = lanes.mcus, lanes.end
    place = blocks.flat(lane)
    base = place[number + blocks.begin] << 6
    begin = blocks.begin.copy()
    while len(bit):
        shift, window = bit & 7, lanes.window[bit >> 3]
        entry = table[window >> 24 - shift & 0xFFFF]
        symbol = entry & 255
        used = (entry >> 8) + _EXTRA[symbol]
        size, run = (symbol & 15).astype(np.int64), symbol >> 4
        value = window >> 40 - shift - used
        bit += used
        plain = size > 0
        if plain.all():
            k += run
            if k.max() > scan.last:
                raise ValueError("a coefficient beyond its block")
            value &= (1 << size) - 1
            value -= np.where(value < 1 << size - 1, (1 << size) - 1, 0)
            flat[base + k] = value << scan.low
            k += 1
            over = k > scan.last
            if not over.any():
                continue
            number += over
        else:
            low = (1 << size) - 1
            v = value & low
            v -= np.where(v < 1 << np.maximum(size, 1) - 1, low, 0)
            k += np.where(plain, run, 0)
            if k.max() > scan.last:
                raise ValueError("a coefficient beyond its block")
            flat[(base + k)[plain]] = (v << scan.low)[plain]
            end = ~plain & (run < 15)
            skip = np.where(end, (1 << run) + (value & (1 << run) - 1), 0)
            k += np.where(plain, 1, np.where(end, 0, 16))
            over = (k > scan.last) | end
            number += np.where(end, skip, over)
        k = np.where(over, scan.first, k)
        left = number < todo
        if not left.all():
            _within(bit[~left], ends[~left])
            bit, number, k, todo, begin, ends = bit[left], number[left], k[left], todo[left], begin[left], ends[left]
        base = place[number + begin] << 6


def _ac_refine(scan: Scan, lanes: _Lanes, coef: np.ndarray, blocks, table: np.ndarray) -> None:
    bits = np.unpackbits(lanes.data)
    columns = np.arange(scan.first, scan.last + 1)
    lane = np.arange(len(lanes.start))
    place, begin, todo, ends = blocks.flat(lane), blocks.begin.copy(), lanes.mcus, lanes.end
    bit, number, k, rest = lanes.start.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), scan.first, np.int64), np.zeros(len(lane), np.int64)
    one = np.int16(1 << scan.low)

    def correct(which, rows, block, until):
        """Correction bits of coefficients that aren't 0 from k up to until."""
        there = (rows != 0) & (columns >= k[which, None]) & (columns < until[:, None])
        at = np.cumsum(there, axis=1, dtype=np.int32)
        got = bits[np.minimum(bit[which, None] + at - 1, len(bits) - 1)].astype(bool) & there
        coef[block, scan.first : scan.last + 1] = rows + np.where(got, np.sign(rows) * one, np.int16(0))
        bit[which] += at[:, -1]

    while len(bit):
        fresh = np.flatnonzero(rest == 0)
        if len(fresh):
            shift, window = bit[fresh] & 7, lanes.window[bit[fresh] >> 3]
            entry = table[window >> 24 - shift & 0xFFFF]
            length, run, size = entry >> 8, (entry & 255) >> 4, entry & 15
            end = (size == 0) & (run < 15)
            extra = np.where(end, run, size)
            value = window >> 40 - shift - length - extra & (1 << extra) - 1
            bit[fresh] += length + extra
            rest[fresh] = np.where(end, (1 << run) + value, 0)
            which, go = fresh[~end], ~end
            if len(which):
                block = place[number[which] + begin[which]]
                rows = coef[block, scan.first : scan.last + 1]
                zeros = np.cumsum((rows == 0) & (columns >= k[which, None]), axis=1) > run[go, None]
                target = np.where(zeros[:, -1], zeros.argmax(axis=1) + scan.first, scan.last + 1)
                correct(which, rows, block, target)
                new = (size[go] > 0) & (target <= scan.last)
                coef[block[new], target[new]] = np.where(value[go][new] > 0, one, -one)
                k[which] = target + 1
                over = which[k[which] > scan.last]
                number[over] += 1
                k[over] = scan.first
        tail = np.flatnonzero((rest > 0) & (number < todo))
        if len(tail):
            block = place[number[tail] + begin[tail]]
            correct(tail, coef[block, scan.first : scan.last + 1], block, np.full(len(tail), scan.last + 1))
            rest[tail] -= 1
            number[tail] += 1
            k[tail] = scan.first
        left = number < todo
        if not left.all():
            _within(bit[~left], ends[~left])
            bit, number, k, rest, todo, begin, ends = bit[left], number[left], k[left], rest[left], todo[left], begin[left], ends[left]


class _Blocks:
    """Where the blocks of a scan's lanes are in the arrays of all images' coefficients."""

    def __init__(self, frames: list[Frame], scan: Scan, offsets: dict[int, np.ndarray], lanes: _Lanes):
        self.frames, self.scan, self.offsets, self.lanes = frames, scan, offsets, lanes
        orders, seen = [], {}
        for f in frames:
            key = (f.width, f.height)
            if key not in seen:
                seen[key] = _order(f, scan)[0]
            orders.append(seen[key])
        self.component = [c for c in scan.components for _ in range(frames[0].components[c].h * frames[0].components[c].v if len(scan.components) > 1 else 1)]
        self.places = []
        for p, c in enumerate(self.component):
            self.places.append(np.concatenate([o[p] + offsets[c][i] for i, o in enumerate(orders)]))
        size = np.array([len(o[0]) for o in orders])
        self.begin = (np.cumsum(size) - size)[lanes.image] + lanes.first_mcu

    def __call__(self, place: int, on: np.ndarray, mcu: int):
        return self.component[place], self.places[place][self.begin[on] + mcu]

    def flat(self, lane: np.ndarray) -> np.ndarray:
        """Block of each place of a scan of one component; one more, for lanes that have ended."""
        return np.append(self.places[0], 0)


def coefficients(frames: list[Frame]) -> list[list[np.ndarray]]:
    """For each image and component the coefficients of its stored blocks, (blocks, 64) in zigzag order."""
    groups = defaultdict(list)
    for i, f in enumerate(frames):
        groups[f.components, f.restart, tuple((s, tuple(sorted(t.items()))) for s, _, t in f.scans)].append(i)
    found: list = [None] * len(frames)
    for members in groups.values():
        own = [frames[i] for i in members]
        counts = {c: np.array([np.prod(f.grid(c)[:2]) for f in own]) for c in range(len(own[0].components))}
        offsets = {c: np.cumsum(n) - n for c, n in counts.items()}
        coefs = [np.zeros((int(counts[c].sum()), 64), np.int16) for c in counts]
        for s, (scan, _, tables) in enumerate(own[0].scans):
            sizes = [(f, _order(f, scan)[0]) for f in {(x.width, x.height): x for x in own}.values()]
            mcus = {(f.width, f.height): len(o[0]) for f, o in sizes}
            lanes = _Lanes([f.scans[s][1] for f in own], [mcus[f.width, f.height] for f in own], [f.restart for f in own])
            blocks = _Blocks(own, scan, offsets, lanes)
            if scan.first == 0:
                _dc(scan, lanes, coefs, blocks, {} if scan.high else {c: _lookup(tables[t]) for c, t in zip(scan.components, scan.dc)})
            else:
                c = scan.components[0]
                (_ac_refine if scan.high else _ac_first)(scan, lanes, coefs[c], blocks, _lookup(tables[16 + scan.ac[0]]))
        for i, m in enumerate(members):
            found[m] = [coefs[c][offsets[c][i] : offsets[c][i] + counts[c][i]] for c in counts]
    return found


def samples(coefs: np.ndarray, quant: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Samples of a component: dequantised, inverse-transformed with exact sums, rounded, clipped to 0..255."""
    natural = np.zeros((len(coefs), 64))
    natural[:, ZIGZAG] = coefs * quant.astype(float)
    half = natural.reshape(-1, 8) @ _BASIS  # rows of a block: sums over the horizontal frequency
    half = half.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _BASIS
    full = np.floor((half + (_SCALE * _SCALE // 2)) / (_SCALE * _SCALE)) + 128
    pixels = np.clip(full, 0, 255).astype(np.uint8).reshape(rows, cols, 8, 8)
    return pixels.transpose(0, 3, 1, 2).reshape(rows * 8, cols * 8)  # the last axis now runs down


def quant_table(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], ">u2" if raw[0] >> 4 else np.uint8).astype(np.int64)


def pixels(frame: Frame, coefs: list[np.ndarray]) -> np.ndarray:
    """(height, width, 3) RGB of an image: chroma is repeated up to full size; one component gives grey."""
    hmax, vmax = max(c.h for c in frame.components), max(c.v for c in frame.components)
    planes = []
    for c, (k, own) in enumerate(zip(frame.components, coefs)):
        rows, cols, _, _ = frame.grid(c)
        plane = samples(own, quant_table(frame.quant[k.table]), rows, cols)
        if (hmax // k.h, vmax // k.v) != (1, 1):
            plane = plane.repeat(vmax // k.v, axis=0).repeat(hmax // k.h, axis=1)
        planes.append(plane[: frame.height, : frame.width].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], axis=2)
    return np.clip(rgb + 32768 >> 16, 0, 255).astype(np.uint8)


# ---- writing ----

#: The writer's Huffman tables: 4 bits for each size of a DC difference; of AC symbols one that texts need at
#: every place has 1 bit (no run, 7 bits), the others 9.
DC_TABLE = bytes([0, 0, 0, 12] + [0] * 12 + list(range(12)))
_OTHERS = [r << 4 | s for r in range(16) for s in range(11) if r << 4 | s != 7]
AC_TABLE = bytes([1] + [0] * 7 + [len(_OTHERS)] + [0] * 7 + [7] + _OTHERS)
YCC = (Component(1, 2, 2), Component(2, 1, 1), Component(3, 1, 1))
#: Spectral selection for luma (1-5, 6-63), successive approximation for all: the lowest bit comes last.
SCRIPT = (
    Scan((0, 1, 2), 0, 0, 0, 1, (0, 0, 0), (0, 0, 0)),
    Scan((0,), 1, 5, 0, 1, (0,), (0,)),
    Scan((0,), 6, 63, 0, 1, (0,), (0,)),
    Scan((1,), 1, 63, 0, 1, (0,), (0,)),
    Scan((2,), 1, 63, 0, 1, (0,), (0,)),
    Scan((0, 1, 2), 0, 0, 1, 0, (0, 0, 0), (0, 0, 0)),
    Scan((0,), 1, 63, 1, 0, (0,), (0,)),
    Scan((1,), 1, 63, 1, 0, (0,), (0,)),
    Scan((2,), 1, 63, 1, 0, (0,), (0,)),
)
_SIZE = np.array([int(i).bit_length() for i in range(4096)], np.int64)


def _by_symbol(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, c, n in _codes(table):
        code[s], length[s] = c, n
    return code, length


_DC_CODE, _AC_CODE = _by_symbol(DC_TABLE), _by_symbol(AC_TABLE)


def _pack(value: np.ndarray, bits: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of items' bits, each lane from a byte of its own and filled up with ones; and bytes a lane."""
    end = np.cumsum(bits)
    total = np.bincount(lane, bits, lanes).astype(np.int64)
    size = (total + 7) >> 3
    begin = (np.cumsum(size) - size) * 8
    start = end - bits + (begin - (np.cumsum(total) - total))[lane]
    out = np.zeros(int(size.sum()) + 8)
    shift = start & 7
    wide = value << (40 - bits - shift)
    at = start >> 3
    for j in range(-(-(int(bits.max(initial=0)) + 7) // 8)):
        out += np.bincount(at + j, wide >> (32 - 8 * j) & 255, len(out))
    out = out[: int(size.sum())].astype(np.uint8)
    spare = size * 8 - total
    last = np.cumsum(size) - 1
    out[last[spare > 0]] |= ((1 << spare[spare > 0]) - 1).astype(np.uint8)
    return out, size


def _entropy(data: np.ndarray, size: np.ndarray, image: np.ndarray, rank: np.ndarray, images: int) -> list[bytes]:
    """Each image's bytes: zeros stuffed after FF, and restart markers before all lanes but its first."""
    lane = np.repeat(np.arange(len(size)), size)
    ff = data == 0xFF
    mark = rank > 0
    room = np.bincount(lane, ff, len(size)).astype(np.int64) + size + 2 * mark
    begin = np.cumsum(room) - room
    stuffed = np.cumsum(ff) - ff
    first = np.cumsum(size) - size
    at = np.arange(len(data)) + stuffed
    at += (begin + 2 * mark - first - np.concatenate([stuffed, [0]])[first])[lane]
    out = np.zeros(int(room.sum()), np.uint8)
    out[at] = data
    out[begin[mark]] = 0xFF
    out[begin[mark] + 1] = 0xD0 + (rank[mark] - 1) % 8
    ends = np.cumsum(np.bincount(image, room, images).astype(np.int64))
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _write_scan(scan: Scan, frames: list[Frame], coefs: list[np.ndarray], offsets, restart: int) -> list[bytes]:
    """Entropy-coded bytes of one scan of all images; coefs holds all images' blocks of each component."""
    orders, seen = [], {}
    for f in frames:
        key = (f.width, f.height)
        if key not in seen:
            seen[key] = _order(f, scan)[0]
        orders.append(seen[key])
    mcus = np.array([len(o[0]) for o in orders])
    lanes = -(-mcus // restart)
    image = np.repeat(np.arange(len(frames)), lanes)
    rank = np.arange(len(image)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    mcu_image = np.repeat(np.arange(len(frames)), mcus)
    lane = (np.cumsum(lanes) - lanes)[mcu_image] + (np.arange(len(mcu_image)) - np.repeat(np.cumsum(mcus) - mcus, mcus)) // restart
    component = [c for c in scan.components for _ in range(frames[0].components[c].h * frames[0].components[c].v if len(scan.components) > 1 else 1)]
    places = [np.concatenate([o[p] + offsets[c][i] for i, o in enumerate(orders)]) for p, c in enumerate(component)]
    n = len(image)
    if scan.first == 0:
        each = np.stack([coefs[c][places[p], 0] for p, c in enumerate(component)], axis=1).astype(np.int64)
        if scan.high:
            value, bits, owner = (each >> scan.low & 1).ravel(), np.ones(each.size, np.int64), np.repeat(lane, len(places))
        else:
            each >>= scan.low
            fresh = np.concatenate([[True], lane[1:] != lane[:-1]])
            differ = np.empty_like(each)
            for c in set(component):
                own = [p for p, x in enumerate(component) if x == c]
                run = each[:, own]
                before = np.concatenate([np.zeros((1, 1), np.int64), run[:-1, -1:]])
                before[fresh] = 0
                differ[:, own] = np.diff(np.concatenate([before, run], axis=1), axis=1)
            d = differ.ravel()
            size = _SIZE[np.abs(d)]
            value = _DC_CODE[0][size] << size | (np.where(d < 0, d - 1, d) & (1 << size) - 1)
            bits, owner = _DC_CODE[1][size] + size, np.repeat(lane, len(places))
        return _entropy(*_pack(value, bits, owner, n), image, rank, len(frames))
    band = coefs[component[0]][places[0], scan.first : scan.last + 1]
    whole = np.abs(band) >> scan.low
    if scan.high:
        was = (np.abs(band) >> scan.high) > 0
        if (whole.astype(bool) & ~was).any():
            raise ValueError("the writer can't make a coefficient significant in a refinement")
        blocks = np.bincount(lane, minlength=n)
        power = _SIZE[blocks] - 1
        head = _AC_CODE[0][power << 4] << power | (blocks - (1 << power))
        head_bits = _AC_CODE[1][power << 4] + power
        where = np.flatnonzero(was)
        count = np.bincount(lane, was.sum(axis=1), n).astype(np.int64)
        size = (head_bits + count + 7) >> 3
        begin = (np.cumsum(size) - size) * 8
        row = np.ones(int(size.sum()) * 8, np.uint8)
        for j in range(int(head_bits.max(initial=0))):
            has = head_bits > j
            row[begin[has] + j] = head[has] >> (head_bits[has] - 1 - j) & 1
        at = np.arange(len(where)) + np.repeat(begin + head_bits - (np.cumsum(count) - count), count)
        row[at] = whole.ravel()[where] & 1
        return _entropy(np.packbits(row), size, image, rank, len(frames))
    block, col = np.nonzero(whole)
    magnitude, value = whole[block, col].astype(np.int64), band[block, col]
    new = np.ones(len(block), bool)
    new[1:] = block[1:] != block[:-1]
    run = col - np.where(new, -1, np.concatenate([[0], col[:-1]])) - 1
    size = _SIZE[magnitude]
    symbol = (run & 15) << 4 | size
    bits = np.where(value < 0, (1 << size) - 1 - magnitude, magnitude)
    item, length = _AC_CODE[0][symbol] << size | bits, _AC_CODE[1][symbol] + size
    key = block * 128 + col * 2 + 1
    ends = np.full(len(band), -1)
    ends[block] = col
    short = np.flatnonzero(ends < band.shape[1] - 1)
    if len(short) or (run > 15).any():
        long = np.repeat(np.arange(len(run)), run >> 4)
        key = np.concatenate([key, key[long] - 1, short * 128 + 127])
        order = np.argsort(key, kind="stable")
        item = np.concatenate([item, np.full(len(long), _AC_CODE[0][0xF0]), np.full(len(short), _AC_CODE[0][0])])[order]
        length = np.concatenate([length, np.full(len(long), _AC_CODE[1][0xF0]), np.full(len(short), _AC_CODE[1][0])])[order]
        block = key[order] >> 7
    return _entropy(*_pack(item, length, lane[block], n), image, rank, len(frames))


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def write(frames: list[Frame], coefs: list[np.ndarray], restart: int = 8, script: tuple[Scan, ...] = SCRIPT) -> list[bytes]:
    """Progressive JPEGs of frames with the same components; coefs: all images' blocks, one array a component.

    A coefficient that isn't 0 must not be 0 without the bits that a refinement sends (the payload's never
    are).
    """
    components = frames[0].components
    counts = {c: np.array([np.prod(f.grid(c)[:2]) for f in frames]) for c in range(len(components))}
    offsets = {c: np.cumsum(n) - n for c, n in counts.items()}
    parts = [[_segment(0xFE, f.comment)] for f in frames]
    common = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\0" + DC_TABLE) + _segment(0xC4, b"\x10" + AC_TABLE) + _segment(0xDD, struct.pack(">H", restart))
    shape = b"".join(bytes([c.id, c.h << 4 | c.v, c.table]) for c in components)
    for scan in script:
        head = _segment(0xDA, bytes([len(scan.components)]) + b"".join(bytes([components[c].id, d << 4 | a]) for c, d, a in zip(scan.components, scan.dc, scan.ac)) + bytes([scan.first, scan.last, scan.high << 4 | scan.low]))
        for p, data in zip(parts, _write_scan(scan, frames, coefs, offsets, restart)):
            p += [head, data]
    return [b"\xff\xd8" + common + _segment(0xC2, struct.pack(">BHHB", 8, f.height, f.width, len(components)) + shape) + b"".join(p) + b"\xff\xd9" for f, p in zip(frames, parts)]

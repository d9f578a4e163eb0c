"""The codec against a writer and a reader of one bit at a time."""

import struct

import numpy as np
import pytest
from fluvial.llm import jpeg, media


def codes(table):
    return {s: (c, n) for s, c, n in jpeg._codes(table)}


class Bits:
    def __init__(self):
        self.out = []

    def put(self, value, n):
        self.out += [value >> i & 1 for i in reversed(range(n))]

    def symbol(self, table, s):
        self.put(*codes(table)[s])

    def take(self):
        bits, self.out = self.out, []
        bits += [1] * (-len(bits) % 8)
        raw = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\x00")


def magnitude(b, v):
    n = abs(v).bit_length()
    b.put(v if v > 0 else v + (1 << n) - 1, n)


def scan_bytes(frame, scan, coefs, restart, runs):
    """Entropy-coded bytes of one scan, coefficient by coefficient; runs joins ends of bands over blocks."""
    places, _ = jpeg._order(frame, scan)
    comps = [c for c in scan.components for _ in range(frame.components[c].h * frame.components[c].v if len(scan.components) > 1 else 1)]
    b, out, pred, waiting, mark = Bits(), b"", {}, 0, 0

    def flush():
        nonlocal waiting
        if waiting:
            n = waiting.bit_length() - 1
            b.symbol(jpeg.AC_TABLE, n << 4)
            b.put(waiting - (1 << n), n)
            waiting = 0

    for m in range(len(places[0])):
        if restart and m and m % restart == 0:
            flush()
            out += b.take() + bytes([0xFF, 0xD0 + mark % 8])
            mark, pred = mark + 1, {}
        for p, c in enumerate(comps):
            z = [int(v) for v in coefs[c][places[p][m]]]
            if scan.first == 0:
                v = z[0] >> scan.low
                if scan.high:
                    b.put(v & 1, 1)
                    continue
                d = v - pred.get(c, 0)
                pred[c] = v
                b.symbol(jpeg.DC_TABLE, abs(d).bit_length())
                if d:
                    magnitude(b, d)
                continue
            t = [abs(v) >> scan.low for v in z]
            r, later = 0, []
            if not scan.high:
                for k in range(scan.first, scan.last + 1):
                    if not t[k]:
                        r += 1
                        continue
                    flush()
                    while r > 15:
                        b.symbol(jpeg.AC_TABLE, 0xF0)
                        r -= 16
                    b.symbol(jpeg.AC_TABLE, r << 4 | t[k].bit_length())
                    magnitude(b, t[k] if z[k] > 0 else -t[k])
                    r = 0
                if r:
                    waiting += 1
                    if not runs or waiting == 32767:
                        flush()
                continue
            end = max([k for k in range(scan.first, scan.last + 1) if t[k] == 1], default=-1)
            for k in range(scan.first, scan.last + 1):
                if not t[k]:
                    r += 1
                    continue
                while r > 15 and k <= end:
                    b.symbol(jpeg.AC_TABLE, 0xF0)
                    b.out, later, r = b.out + later, [], r - 16
                if t[k] > 1:
                    later.append(t[k] & 1)
                    continue
                b.symbol(jpeg.AC_TABLE, r << 4 | 1)
                b.put(int(z[k] > 0), 1)
                b.out, later, r = b.out + later, [], 0
            if r or later:
                b.symbol(jpeg.AC_TABLE, 0)
                b.out += later
    flush()
    return out + b.take()


def written(frame, script, coefs, restart, runs=True):
    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes(range(1, 65))) + seg(0xC4, b"\0" + jpeg.DC_TABLE + b"\x10" + jpeg.AC_TABLE)
    head += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    head += seg(0xC2, struct.pack(">BHHB", 8, frame.height, frame.width, len(frame.components)) + b"".join(bytes([c.id, c.h << 4 | c.v, 0]) for c in frame.components))
    for s in script:
        head += seg(0xDA, bytes([len(s.components)]) + b"".join(bytes([frame.components[c].id, 0]) for c in s.components) + bytes([s.first, s.last, s.high << 4 | s.low])) + scan_bytes(frame, s, coefs, restart, runs)
    return head + b"\xff\xd9"


GREY = (jpeg.Component(1, 1, 1),)
Z = (0,)
GREY_SCRIPT = (jpeg.Scan(Z, 0, 0, 0, 2, Z, Z), jpeg.Scan(Z, 1, 5, 0, 2, Z, Z), jpeg.Scan(Z, 6, 63, 0, 2, Z, Z), jpeg.Scan(Z, 0, 0, 2, 1, Z, Z), jpeg.Scan(Z, 1, 63, 2, 1, Z, Z), jpeg.Scan(Z, 0, 0, 1, 0, Z, Z), jpeg.Scan(Z, 1, 63, 1, 0, Z, Z))


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("components, script, size", [(GREY, GREY_SCRIPT, (37, 21)), (jpeg.YCC, jpeg.SCRIPT, (45, 33)), ((jpeg.Component(1, 2, 1), jpeg.Component(2, 1, 1), jpeg.Component(3, 1, 1)), jpeg.SCRIPT, (20, 9))])
def test_reader(components, script, size, restart):
    r = np.random.default_rng(restart)
    images, want = [], []
    for density in (0.02, 0.3, 0.9):
        frame = jpeg.Frame(*size, components)
        coefs = []
        for c in range(len(components)):
            high, wide, rows, cols = frame.grid(c)
            z = np.where(r.random((high * wide, 64)) < density, r.integers(-60, 61, (high * wide, 64)), 0)
            z[:, 0] = r.integers(-300, 300, len(z))
            hidden = np.ones((high, wide), bool)
            hidden[:rows, :cols] = False
            z[hidden.ravel(), 1:] = 0  # blocks beyond the image have no AC scans
            coefs.append(z)
        want.append(coefs)
        images.append(written(frame, script, coefs, restart, runs=density < 0.5))
    frames = [jpeg.parse(x) for x in images]
    for f, found, coefs in zip(frames, jpeg.coefficients(frames), want):
        assert all((a == b).all() for a, b in zip(found, coefs))
        assert jpeg.pixels(f, found).shape == (size[1], size[0], 3)


def test_writer_is_read_bit_by_bit():
    payloads = [bytes(range(256)) * 5, b"\xff" * 64, b"a" * 448]
    for p, j in zip(payloads, media.to_jpegs(payloads)):
        frame = jpeg.parse(j)
        coefs = jpeg.coefficients([frame])[0]
        assert media.payload_of(frame, coefs) == p
        for scan, data, _ in frame.scans:  # the plain writer must give a reader the same coefficients
            again = scan_bytes(frame, scan, coefs, frame.restart, True)
            lanes = [jpeg._Lanes([x], [len(jpeg._order(frame, scan)[0][0])], [frame.restart]) for x in (data, again)]
            assert lanes[0].mcus.tolist() == lanes[1].mcus.tolist()


def test_inverse_transform_and_colours():
    r = np.random.default_rng(0)
    z = r.integers(-40, 40, (3, 64))
    got = jpeg.samples(z, np.full(64, 2), 1, 3)
    scale = lambda k: np.sqrt(0.125) if k == 0 else 0.5
    for b in range(3):
        grid = np.zeros(64)
        grid[jpeg.ZIGZAG] = z[b] * 2
        for y in range(8):
            for x in range(8):
                v = sum(grid[u * 8 + w] * scale(u) * scale(w) * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * w * np.pi / 16) for u in range(8) for w in range(8)) + 128
                assert abs(int(got[y, b * 8 + x]) - min(255, max(0, v))) <= 0.55  # the basis is in integers
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))
    frame = jpeg.Frame(8, 8, (jpeg.Component(1, 1, 1), jpeg.Component(2, 1, 1), jpeg.Component(3, 1, 1)), quant={0: b"\0" + b"\1" * 64})
    flat = [np.zeros((1, 64), np.int16) for _ in range(3)]
    flat[0][0, 0], flat[2][0, 0] = 8 * (100 - 128), 8 * 50  # Y 100, Cr 178
    assert jpeg.pixels(frame, flat)[0, 0].tolist() == [170, 64, 100]


def test_what_is_no_image_gives_nulls(spark):
    foreign = jpeg.write([jpeg.Frame(16, 16, jpeg.YCC, comment=b"64")], [np.full((4, 64), -255, np.int16), np.zeros((1, 64), np.int16), np.zeros((1, 64), np.int16)])[0]
    df = spark.createDataFrame([(1, None, 7), (2, b"no image", 7), (3, b"", 7), (4, bytes(media.to_jpegs([b"x" * 64])[0]), 7), (5, bytes(foreign), 7)], "i int, media binary, width long")
    found = {r.i: (r.width, r.height, r.rgb is None, r.payload) for r in media.decode(df, payload=True).collect()}
    assert found == {1: (None, None, True, None), 2: (None, None, True, None), 3: (None, None, True, None), 4: (16, 16, False, b"x" * 64), 5: (16, 16, False, None)}


def test_damaged_images_give_nulls_and_harm_no_other(spark):
    r = np.random.default_rng(5)
    payload = r.integers(0, 256, 64 * 30).astype(np.uint8).tobytes()
    whole = media.to_jpegs([payload])[0]
    cut = [whole[:n] for n in (*range(0, 700, 7), *range(700, len(whole) - 2, 211))]
    flipped = []
    for at in r.integers(2, len(whole), 150):
        b = bytearray(whole)
        b[at] ^= 1 << int(r.integers(0, 8))
        flipped.append(bytes(b))
    huge = bytearray(whole)
    at = huge.index(b"\xff\xc2")
    huge[at + 5 : at + 9] = b"\xff\xff\xff\xff"
    rows = [(0, whole), *((1, c) for c in cut), *((2, f) for f in flipped), (1, bytes(huge)), (1, b"\xff\xd8\xff\xc2"), (3, whole)]
    found = media.decode(spark.createDataFrame(rows, "kind int, media binary").coalesce(1), payload=True).collect()
    assert len(found) == len(rows)
    assert all(x.payload == payload for x in found if x.kind in (0, 3)) and all(x.width is None and x.payload is None for x in found if x.kind == 1)
    # a changed bit is found, or read as other coefficients
    assert all(x.payload is None or len(x.payload) == len(payload) for x in found if x.kind == 2)


def test_frames_of_any_payload_state_their_size():
    from fluvial.llm import media

    for blocks in (1, 7, 10_000, 1_572_480, 1_572_481, 5_000_000, 100_000_000):
        f = media._frame(blocks, b"")
        assert f.height < 1 << 16 and f.width < 1 << 16 and f.height // 16 * (f.width // 16) * 6 >= blocks

"""Baseline images, made here by a plain coder, against the samples that they were made from."""

import struct

import numpy as np
import pytest

from tidewell.llm import jpeg, media

AC = [0, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]


#: Own tables: all code words have one length, 4 bits for the first coefficient, 8 for the others.
OWN = {0: (bytes([0, 0, 0, 12, *[0] * 12]), bytes(range(12))), 16: (bytes([*[0] * 7, len(AC), *[0] * 8]), bytes(AC))}


def words(counts: bytes, symbols: bytes) -> dict[int, str]:
    """Code words in rising order, one bit more for each length."""
    out, code, at = {}, 0, 0
    for size, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = format(code, f"0{size}b")
            code += 1
        at, code = at + n, code << 1
    return out


def coded(planes: list[np.ndarray], shape: tuple[int, int], factors: list[tuple[int, int]], every: int = 0, own: bool = True) -> bytes:
    """An image with tables of its own, or with the standard ones left out (components after the first use table 1)."""
    place = lambda c: 0 if own or not c else 1
    table = {p: words(*(OWN[p] if own else jpeg.standard(p))) for p in ((0, 16) if own else (0, 1, 16, 17))}
    units = -(-shape[0] // (8 * factors[0][1])), -(-shape[1] // (8 * factors[0][0]))
    segments, bits, last = [], "", [0] * len(planes)

    def number(x):
        s = abs(x).bit_length()
        return s, format(x if x >= 0 else x + (1 << s) - 1, f"0{s}b") if s else ""

    def close():
        whole = bits + "1" * (-len(bits) % 8)
        segments.append(bytes(int(whole[k : k + 8], 2) for k in range(0, len(whole), 8)).replace(b"\xff", b"\xff\x00"))

    for u in range(units[0] * units[1]):
        if every and u and u % every == 0:
            close()
            bits, last = "", [0] * len(planes)
        y, x = divmod(u, units[1])
        for c, (plane, (h, v)) in enumerate(zip(planes, factors, strict=True)):
            for k in range(h * v):
                r, q = 8 * (y * v + k // h), 8 * (x * h + k % h)
                f = np.rint(jpeg.COSINE @ (plane[r : r + 8, q : q + 8].astype(float) - 128) @ jpeg.COSINE.T / 2).astype(int).ravel()[jpeg.ZIGZAG]
                s, tail = number(int(f[0]) - last[c])
                last[c], run = int(f[0]), 0
                bits += table[place(c)][s] + tail
                for z in f[1:].tolist():
                    if not z:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + table[16 + place(c)][0xF0], run - 16
                    s, tail = number(z)
                    bits, run = bits + table[16 + place(c)][run << 4 | s] + tail, 0
                if run:
                    bits += table[16 + place(c)][0]
    close()
    part = lambda mark, body: bytes([255, mark]) + struct.pack(">H", len(body) + 2) + body
    n = len(planes)
    head = part(0xDB, bytes([0] + [2] * 64)) + part(0xC0, struct.pack(">BHHB", 8, *shape, n) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(factors)))
    head += b"".join(part(0xC4, bytes([p]) + counts + symbols) for p, (counts, symbols) in OWN.items()) if own else b""
    head += (part(0xDD, struct.pack(">H", every)) if every else b"") + part(0xDA, bytes([n, *(b for c in range(n) for b in (c + 1, place(c) * 17)), 0, 63, 0]))
    return b"\xff\xd8" + head + b"".join(s + (bytes([255, 0xD0 + k % 8]) if k + 1 < len(segments) else b"") for k, s in enumerate(segments)) + b"\xff\xd9"


@pytest.mark.parametrize(("every", "own"), [(0, True), (2, True), (0, False), (3, False)])
def test_baseline_images(every, own):
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 256, (32, 40), dtype=np.uint8)
    got = jpeg.brightness(coded([grey], (27, 37), [(1, 1)], every, own))
    assert got.shape == (27, 37) and np.abs(got.astype(int) - grey[:27, :37]).max() <= 8
    smooth = np.add.outer(np.arange(32), 3 * np.arange(48)).astype(np.uint8)
    colour = rng.integers(0, 256, (2, 16, 24), dtype=np.uint8)
    got = jpeg.brightness(coded([smooth, *colour], (30, 45), [(2, 2), (1, 1), (1, 1)], every, own))
    assert got.shape == (30, 45) and np.abs(got.astype(int) - smooth[:30, :45]).max() <= 8


def test_standard_tables():
    for p in (16, 17):
        counts, symbols = jpeg.standard(p)
        assert sum(counts) == 162 and sorted(symbols) == sorted(AC)
    for p in (0, 1, 16, 17):  # complete but for the word of ones only, as the format asks
        assert sum(n << (16 - k) for k, n in enumerate(jpeg.standard(p)[0], 1)) < 1 << 16


def test_broken_images():
    image = coded([np.full((16, 16), 77, np.uint8)], (16, 16), [(1, 1)])
    assert (jpeg.brightness(image) == 77).all()
    for bad in (b"", b"\xff\xd8", image[:30], image[:-4], image.replace(b"\xff\xc0", b"\xff\xc2"), image[:2] + b"x" + image[2:]):
        with pytest.raises(ValueError):
            jpeg.brightness(bad)


def test_shots_of_baseline_files(spark):
    dark, light = (coded([np.full((16, 24), x, np.uint8)], (16, 24), [(1, 1)]) for x in (20, 220))
    file = media.write_avi([dark] * 5 + [light] * 4)
    rows = media.clips(spark.createDataFrame([(1, bytearray(file))], "k int, media binary"), "k").orderBy("clip").collect()
    assert [(r.first_frame, r.n_frames, r.error) for r in rows] == [(0, 5, None), (5, 4, None)]

"""Brightness samples of baseline JPEG images, for motion-JPEG files that were not written here.

Only entropy decoding goes coefficient by coefficient; dequantisation and the inverse transform go over all blocks of an image at once.
"""

from __future__ import annotations

import functools
import re

import numpy as np

#: Row-major place of each coefficient in scan order: along anti-diagonals, in turns upwards and downwards.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_K = np.arange(8)
#: Cosine transform: row k is frequency k.
COSINE = np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)
_SCAN_END, _RESTART = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]"), re.compile(rb"\xff[\xd0-\xd7]")


_DC = bytes(range(12))
_AC = {0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))}
# The code tables that motion-JPEG files leave out (the standard's examples): code words of each length, and the symbols of those shorter than 16 bits.
_DC_COUNTS = (bytes.fromhex("00010501010101010100000000000000"), bytes.fromhex("00030101010101010101010000000000"))
_AC_COUNTS = (bytes.fromhex("0002010303020403050504040000017d"), bytes.fromhex("00020102040403040705040400010277"))
_AC_SHORT = (
    bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
    bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
)


def standard(place: int) -> tuple[bytes, bytes]:
    """Counts by length and symbols of the table that place (0, 1: first coefficients; 16, 17: others) has where a file gives none."""
    which = place & 15
    if place < 16:
        return _DC_COUNTS[which], _DC
    return _AC_COUNTS[which], _AC_SHORT[which] + bytes(sorted(_AC - set(_AC_SHORT[which])))


@functools.cache
def _standard(place: int) -> tuple[list[int], list[int]]:
    return _huffman(*standard(place))


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def peek(self) -> int:
        lo = self.at >> 3
        return int.from_bytes(self.data[lo : lo + 4], "big") >> (16 - (self.at & 7)) & 0xFFFF

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        ahead = self.peek()
        self.at += table[0][ahead]
        if not table[0][ahead] or self.at > self.end:
            raise ValueError("broken scan")
        return table[1][ahead]

    def number(self, size: int) -> int:
        """The signed number of `size` bits; a first bit of 0 means a negative one."""
        if not size:
            return 0
        x = self.peek() >> (16 - size)
        self.at += size
        return x if x >> (size - 1) else x - (1 << size) + 1


def _huffman(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """Length and symbol of the code word that each 16 bits begin with; length 0 where none does."""
    lengths, found, k = [], [], 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            lengths += [bits] * (1 << (16 - bits))
            found += [s] * (1 << (16 - bits))
        k += n
    rest = (1 << 16) - len(lengths)
    if rest < 0 or k > len(symbols):
        raise ValueError("broken code table")
    return lengths + [0] * rest, found + [0] * rest


def _block(bits: _Bits, dc, ac, before: int) -> tuple[int, list[tuple[int, int]]]:
    """The first coefficient and (place, value) of the others that are not 0."""
    first, k, others = before + bits.number(bits.symbol(dc) & 15), 1, []
    while k < 64:
        run, size = divmod(bits.symbol(ac), 16)
        if not size and run < 15:
            break
        k += run
        if size:
            if k > 63:
                raise ValueError("broken scan")
            others.append((ZIGZAG[k], bits.number(size)))
        k += 1
    return first, others


def brightness(image: bytes) -> np.ndarray:
    """The samples (height, width), uint8, of the first component of a baseline JPEG image: the brightness, at that component's own resolution. Any size, sampling,
    tables (where it gives none: the standard ones), restart intervals and order of scans; ValueError for other processes and broken images."""
    try:
        return _decode(image)
    except (IndexError, KeyError, TypeError) as e:
        raise ValueError(f"broken image: {e!r}") from e


def _decode(image: bytes) -> np.ndarray:
    if image[:2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    at, quant, codes, frame, every = 2, {}, {}, None, 0
    while at + 4 <= len(image):
        if image[at] != 255:
            raise ValueError("no marker where one must be")
        if image[at + 1] == 255:
            at += 1
            continue
        mark, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body, at = image[at + 4 : at + 2 + size], at + 2 + max(size, 2)
        if mark == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("not 8 bits a sample")
            parts = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)}
            frame = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[6], parts
            if not all(h and v for h, v, _ in parts.values()) or not frame[0] * frame[1]:
                raise ValueError("broken frame header")
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif mark == 0xDD:
            every = int.from_bytes(body[:2], "big")
        elif mark == 0xDA:
            if frame is None:
                raise ValueError("scan before frame header")
            end = _SCAN_END.search(image, at)
            data, at = image[at : end.start() if end else len(image)], end.start() if end else len(image)
            pairs = [(body[k], body[k + 1] >> 4, 16 | body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)]
            tables = [(c, codes.get(dc) or _standard(dc), codes.get(ac) or _standard(ac)) for c, dc, ac in pairs]
            if frame[2] in [t[0] for t in tables]:
                return _scan(data, tables, frame, quant, every)
    raise ValueError("no scan of the first component")


def _scan(data: bytes, tables: list, frame: tuple, quant: dict, every: int) -> np.ndarray:
    height, width, first, parts = frame
    top_h, top_v = max(h for h, _, _ in parts.values()), max(v for _, v, _ in parts.values())
    own_h, own_v, own_q = parts[first]
    rows, cols = -(-height * own_v // top_v), -(-width * own_h // top_h)
    if len(tables) == 1:  # a scan of one component has single blocks
        grid, units = {first: (1, 1)}, (-(-rows // 8), -(-cols // 8))
    else:
        grid, units = {c: parts[c][:2] for c, _, _ in tables}, (-(-height // (8 * top_v)), -(-width // (8 * top_h)))
    h, v = grid[first]
    if units[0] * units[1] > 4 * len(data):  # a block takes two bits at least
        raise ValueError("scan too short for the image")
    blocks = np.zeros((units[0] * v, units[1] * h, 64), np.int64)
    segments, total = iter(_RESTART.split(data)), units[0] * units[1]
    for unit in range(total):
        if unit == 0 or every and unit % every == 0:
            bits, before = _Bits(next(segments, b"").replace(b"\xff\x00", b"\xff")), dict.fromkeys(grid, 0)
        y, x = divmod(unit, units[1])
        for c, dc, ac in tables:
            for k in range(grid[c][0] * grid[c][1]):
                before[c], others = _block(bits, dc, ac, before[c])
                if c == first:
                    own = blocks[y * v + k // h, x * h + k % h]
                    own[0] = before[c]
                    for place, value in others:
                        own[place] = value
    scale = np.empty(64, np.int64)
    scale[ZIGZAG] = quant[own_q]
    samples = COSINE.T @ (blocks * scale).reshape(*blocks.shape[:2], 8, 8) @ COSINE + 128
    return np.clip(np.rint(samples), 0, 255).astype(np.uint8).swapaxes(1, 2).reshape(blocks.shape[0] * 8, -1)[:rows, :cols]

"""Progressive JPEG: coefficients from and to scans, and full-resolution RGB tensors.

``decode`` reads a progressive file: spectral-selection and successive-approximation scans add up in
one coefficient array for each component; the inverse transform is one exact matrix product in numpy,
subsampled chroma is replicated to full resolution, and colours become RGB. ``encode`` writes coefficient
arrays as DC, spectral-band and refinement scans.

Entropy decoding works on arrays: the code at every bit of a stretch is looked up at once, and jumps from
code to code are composed until each goes 32 codes ahead. Where coefficients and runs lie follows from
cumulated sums. In refinement scans of AC coefficients each code is met in turn, its correction bits are
applied at once.

``payload_to_jpeg`` stores any payload losslessly at about 1.14 times its size: its bytes are the
quantized coefficients of a luma and two chroma components, the chroma at half the resolution each way,
under a Huffman table whose code length and extra bits add up to 8 for each coefficient.

Transforms multiply whole numbers that floating point holds exactly, so results do not depend on
batch sizes or machines.

Defined cases: a null text counts as an empty one, whose payload is 64 zero bytes; texts may be of any
length up to what a picture of 65,520 by 65,520 samples holds (6 GB) and are stored whole; equal texts give
equal files and tensors; repeated rows and ties each give a row; an empty table gives none; a null or
damaged file of a media column gives nulls and an error text; other columns are ignored, or kept where the
caller asks, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import schema_of, table, tidy

MOST_SIDE = 4095  # of 16 samples: 65,520
LONGEST_RUN = 32767  # blocks in one end-of-band run


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position: diagonals in turn, alternately upward and downward."""
    cells = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else -c[0]))
    return np.array([u * 8 + v for u, v in cells])


ZIGZAG = _zigzag()
SHIFT = 10


def _inverse(shift: int) -> np.ndarray:
    """64 zigzag coefficients to 64 samples, scaled by 2**shift and rounded to whole numbers."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.where(k == 0, np.sqrt(0.5), 1.0) / 2 * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.rint(np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[ZIGZAG] * (1 << shift))


INVERSE_SMALL = _inverse(SHIFT).astype(np.float32)  # |coefficient| <= 512: sums stay below 2**24
INVERSE = _inverse(SHIFT + 8)  # |coefficient| < 2**20: sums stay below 2**53


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    across: int = 0  # blocks in the coefficient array, a multiple of h
    down: int = 0
    own_across: int = 0  # blocks that scans of this component alone code
    own_down: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""


def frame(width: int, height: int, parts: list[tuple[int, int]]) -> list[Component]:
    """Components with the given sampling factors and empty coefficients."""
    hm, vm = max(h for h, _ in parts), max(v for _, v in parts)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    out = []
    for i, (h, v) in enumerate(parts):
        own = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
        c = Component(i + 1, h, v, int(i > 0), across * h, down * v, *own)
        c.coefficients = np.zeros((c.down, c.across, 64), np.int32)
        out.append(c)
    return out


# Huffman tables: a list of (symbol, length) in order of length; codes count up.


def _codes(table: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    code, last, out = 0, table[0][1] if table else 0, {}
    for symbol, n in table:
        code <<= n - last
        last = n
        out[symbol] = (code, n)
        code += 1
    return out


def even_table(symbols: set[int]) -> list[tuple[int, int]]:
    n = max(1, len(symbols)).bit_length()  # leaves the code of all ones free
    return [(s, n) for s in sorted(symbols)]


#: Lengths such that code and extra bits of each non-zero coefficient make 8 bits.
BYTE_AC = [(s, 8 - s) for s in range(7, 0, -1)]
BYTE_DC = [*BYTE_AC, (0, 8)]
RUNS = [(n << 4, 4) for n in range(15)]


def _byte_values(table: list[tuple[int, int]]) -> np.ndarray:
    """The value of each byte under a table whose codes and extra bits make 8 bits."""
    values = np.zeros(256, np.int32)
    for s, (code, n) in _codes(table).items():
        x = np.arange(1 << s)
        values[(code << s | x) & 255] = _extended(x, np.int64(s))
    return values


STRETCH = 1 << 16  # bytes of scans that are looked up at once
TOGETHER = 1 << 16  # bytes of texts that are stored and read together


_DC_EXTRA = np.arange(256).astype(np.uint8) & 15
_AC_EXTRA = np.array([s & 15 or (s >> 4 if s < 0xF0 else 0) for s in range(256)], np.uint8)


@lru_cache(64)
def _lookup(table: tuple[tuple[int, int], ...], ac: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol and length of the code that each 16 bits begin with, and how far the next code is; length 0: none."""
    symbols, lengths = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for symbol, (code, n) in _codes(list(table)).items():
        symbols[code << (16 - n) : (code + 1) << (16 - n)] = symbol
        lengths[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbols, lengths, lengths + (_AC_EXTRA if ac else _DC_EXTRA)[symbols]


def _windows(data: np.ndarray) -> np.ndarray:
    """The 16 bits that begin at each bit of all but the last two bytes."""
    wide = data.astype(np.uint32)
    wide = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    return (wide[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)).astype(np.uint16).ravel()


PADDING = 8  # bytes behind a scan, so that every code in it is whole


def _padded(segment: bytes) -> np.ndarray:
    return np.frombuffer(segment + bytes(PADDING), np.uint8)


def _bits_at(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits (16 at most) from each place, as numbers."""
    byte = np.minimum(at >> 3, len(data) - 3)
    wide = data[byte].astype(np.int64) << 16 | data[byte + 1].astype(np.int64) << 8 | data[byte + 2]
    return (wide >> (24 - (at & 7) - n)) & ((1 << n) - 1)


def _extended(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n == 0) | (x >= 1 << np.maximum(n - 1, 0)), x, x - (1 << n) + 1)


def _chain(jump: np.ndarray, starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """start, jump[start], and so on while below the end, for each start, with its number: 32 at a time, by jumps of jumps."""
    jumps = [jump]
    for _ in range(5):
        jumps.append(jumps[-1][jumps[-1]])
    anchors, counts, far = [], [], jumps.pop()
    for at, end in zip(starts, ends, strict=True):
        before = len(anchors)
        while at < end:
            anchors.append(at)
            at = int(far[at])
        counts.append(len(anchors) - before)
    out = np.empty((len(anchors), 32), np.int32)
    out[:, 0] = anchors
    for k, by in enumerate(jumps):
        out[:, 1 << k : 2 << k] = by[out[:, : 1 << k]]
    owner = np.repeat(np.arange(len(starts)), counts)
    inside = out < np.array(ends)[owner][:, None] if len(anchors) else np.zeros((0, 32), bool)
    return out[inside], np.repeat(owner, inside.sum(axis=1))


def _jumps(data: np.ndarray, known: list) -> tuple[list[np.ndarray], np.ndarray]:
    """For each table where the code after the one at each bit begins, and the same over all tables in turn; what is no code, or goes beyond the data, leads to the end."""
    seen, jumps = _windows(data), []
    stop = np.int32(len(seen))
    for _, _, step in known:
        ahead = step[seen]
        jump = np.append(np.arange(stop, dtype=np.int32) + ahead, stop)
        jump[:-1][ahead == 0] = stop
        jumps.append(np.minimum(jump, stop, out=jump))
    whole = jumps[0]
    for jump in jumps[1:]:
        whole = jump[whole]
    return jumps, whole


def _places(starts: np.ndarray, jumps: list[np.ndarray]) -> np.ndarray:
    """The places of all codes of turns that begin at starts."""
    places = [starts]
    for jump in jumps[:-1]:
        places.append(jump[places[-1]])
    return np.stack(places, axis=1).ravel() if len(places) > 1 else starts


def _long(segment: bytes, known: list, most: int | None) -> np.ndarray:
    """The places of a segment's codes, a stretch at a time."""
    data, end, at, found, n = _padded(segment), 8 * len(segment), 0, [np.zeros(0, np.int64)], 0
    while at < end and (most is None or n < most):
        low = at >> 3
        jumps, whole = _jumps(data[low : min(low + STRETCH, len(data) - 2) + 2], known)
        starts = _chain(whole, [at - 8 * low], [len(whole) - 1])[0]
        if len(starts) < 2:  # nothing whole: no code here, or the end
            break
        # The last turn may go on beyond this stretch: the next one begins with it.
        found.append(_places(starts[:-1], jumps).astype(np.int64) + 8 * low)
        n += len(found[-1])
        at = int(starts[-1]) + 8 * low
    out = np.concatenate(found)
    return out[out < end][:most]


@dataclass
class _Codes:
    """The codes of some segments in order: symbol, the bits that follow, how many those are, and the segment."""

    symbols: np.ndarray
    bits: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray


def _follow(segments: list[bytes], tables: list, ac: bool, most: list[int] | None) -> _Codes:
    """One code after the other, with the tables in turn, until ``most`` codes of each segment, its end, or what is no code."""
    tables = tables[:1] if all(t is tables[0] for t in tables) else tables
    known = [_lookup(tuple(t), ac) for t in tables]
    turn = len(known)
    data = np.frombuffer(b"".join(x for s in segments for x in (s, bytes(PADDING))), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    starts = 8 * (np.cumsum(sizes + PADDING) - sizes - PADDING)
    if len(data) > STRETCH:
        parts = [_long(s, known, None if most is None else most[i]) + starts[i] for i, s in enumerate(segments)]
        at, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        number = np.concatenate([np.arange(len(x)) for x in parts])
    else:
        jumps, whole = _jumps(data, known)
        chained, owner = _chain(whole, starts.tolist(), (starts + 8 * sizes).tolist())
        at, owner = _places(chained, jumps).astype(np.int64), np.repeat(owner, turn)
        number = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(segments)))[owner]
        inside = at < (starts + 8 * sizes)[owner]
        if most is not None:
            inside &= number < np.array(most, np.int64)[owner]
        at, owner, number = at[inside], owner[inside], number[inside]
    window = _bits_at(data, at, np.int64(16))
    if turn == 1:
        symbols, lengths = known[0][0][window], known[0][1][window]
    else:
        symbols, lengths = (np.choose(number % turn, [k[i][window] for k in known]) for i in (0, 1))
    good = lengths > 0
    if not good.all():
        symbols, lengths, at, owner = symbols[good], lengths[good], at[good], owner[good]
    extra = (_AC_EXTRA if ac else _DC_EXTRA)[symbols].astype(np.int64)
    return _Codes(symbols.astype(np.int64), _bits_at(data, at + lengths, extra), extra, owner)


def _dc_grids(parts: list[tuple[Component, int, int]]) -> list[tuple[Component, int, np.ndarray, np.ndarray]]:
    """For each block of a unit: component, table number, and row and column of the block in each unit of the scan."""
    if len(parts) == 1:
        c, dc, _ = parts[0]
        y, x = np.divmod(np.arange(c.own_down * c.own_across), max(1, c.own_across))
        return [(c, dc, y, x)]
    first = parts[0][0]
    my, mx = np.divmod(np.arange((first.down // first.v) * (first.across // first.h)), max(1, first.across // first.h))
    return [(c, dc, my * c.v + v, mx * c.h + h) for c, dc, _ in parts for v in range(c.v) for h in range(c.h)]


@dataclass
class _Scan:
    parts: list[tuple[Component, int, int]]  # with DC and AC table number
    ss: int
    se: int
    ah: int
    al: int
    segments: list[bytes]
    tables: dict
    interval: int

    def key(self) -> tuple:
        """Scans of equal keys can be read together."""
        used = tuple(tuple(self.tables.get((int(self.ss > 0), ac if self.ss else dc), ())) for _, dc, ac in self.parts)
        return self.ss, self.se, self.ah, self.al, used, tuple((c.id, c.h, c.v) for c, _, _ in self.parts)

    def cuts(self, units: int) -> list[int]:
        """Where the units of each segment begin, and their number."""
        interval = self.interval or max(1, units)
        if len(self.segments) != max(1, -(-units // interval)):
            raise ValueError("the scan has another number of restarts")
        return [*range(0, units, interval), units] if units else [0, 0]


SHORT = "the scan ends too early or has no such Huffman code"


def _read_scans(scans: list[_Scan]) -> None:
    """Adds scans of equal keys, of several files, to their coefficients."""
    (_read_dc if scans[0].ss == 0 else _read_ac)(scans)


def _read_dc(scans: list[_Scan]) -> None:
    grids = [_dc_grids(x.parts) for x in scans]
    wide, al = len(grids[0]), scans[0].al
    cuts = [x.cuts(len(g[0][2])) for x, g in zip(scans, grids, strict=True)]
    if scans[0].ah:
        for x, grid, cut in zip(scans, grids, cuts, strict=True):
            bits = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=(b - a) * wide) for s, a, b in zip(x.segments, cut, cut[1:], strict=False)]).reshape(-1, wide).astype(np.int32)
            for u, (c, _, v, h) in enumerate(grid):
                c.coefficients[v, h, 0] |= bits[:, u] << al
        return
    units = np.array([b - a for cut in cuts for a, b in zip(cut, cut[1:], strict=False)])  # of each segment
    found = _follow([s for x in scans for s in x.segments], [scans[0].tables[0, dc] for _, dc, _, _ in grids[0]], False, (units * wide).tolist())
    if (np.bincount(found.owner, minlength=len(units)) < units * wide).any():
        raise ValueError(SHORT)
    steps = _extended(found.bits, found.sizes).reshape(-1, wide)
    first = np.cumsum(units) - units
    ends = np.cumsum([cut[-1] for cut in cuts]).tolist()
    for number in range(len(scans[0].parts)):
        mine = [u for u, g in enumerate(grids[0]) if g[0] is scans[0].parts[number][0]]
        values = np.cumsum(steps[:, mine].ravel())
        before = np.concatenate([[0], values])[first * len(mine)]  # each segment begins anew
        values = (values - np.repeat(before, units * len(mine))).reshape(-1, len(mine)) << al
        for grid, low, high in zip(grids, [0, *ends], ends, strict=False):
            for k, u in enumerate(mine):
                c, _, v, h = grid[u]
                c.coefficients[v, h, 0] = values[low:high, k]


def _read_ac(scans: list[_Scan]) -> None:
    ss, se, al = scans[0].ss, scans[0].se, scans[0].al
    band = se - ss + 1
    grids = [c.coefficients[: c.own_down, : c.own_across, ss : se + 1] for c in (x.parts[0][0] for x in scans)]
    flat = np.concatenate([g.reshape(-1, band) for g in grids])  # blocks in order: a copy
    ends = np.cumsum([g.shape[0] * g.shape[1] for g in grids]).tolist()
    segments, starts = [], []
    for x, low, high in zip(scans, [0, *ends], ends, strict=False):
        segments += x.segments
        starts += [low + a for a in x.cuts(high - low)[:-1]]
    table = scans[0].tables[1, scans[0].parts[0][2]]
    if scans[0].ah:
        for segment, low, high in zip(segments, starts, [*starts[1:], len(flat)], strict=True):
            _refine_ac(flat[low:high], segment, table, al)
    else:
        _first_ac(flat, segments, np.array(starts), table, al)
    for g, low, high in zip(grids, [0, *ends], ends, strict=False):
        g[:] = flat[low:high].reshape(g.shape)


def _first_ac(flat: np.ndarray, segments: list[bytes], starts: np.ndarray, table: list[tuple[int, int]], al: int) -> None:
    """The first scan of a band. flat: (blocks, band), filled in place. starts: the first block of each segment."""
    n, band = flat.shape
    limits = np.append(starts[1:], n)
    found = _follow(segments, [table], True, None)
    r, s, owner = found.symbols >> 4, found.symbols & 15, found.owner
    reached = starts * band
    if len(owner):
        stops = (s == 0) & (r < 15)  # of a block, and of more
        total = np.cumsum(np.where(stops, 0, np.where(s == 0, 16, r + 1)))
        # Within a stretch the band's places count on; a stop goes to the start of the block after its run; each segment begins anew.
        new = np.append(True, stops[:-1] | (owner[1:] != owner[:-1]))
        at, stretch = np.flatnonzero(new), np.cumsum(new) - 1
        last = np.append(at[1:], len(owner)) - 1
        before = np.append(0, total)[at]
        held = total[last] - before
        run = np.where(stops[last], (1 << r[last]) + found.bits[last], 0)
        passed = np.cumsum(held // band + run)
        begun = np.append(0, passed)[np.searchsorted(owner[at], owner[at])]
        block = starts[owner[at]] + np.append(0, passed[:-1]) - begun
        place = block[stretch] * band + total - before[stretch] - 1
        real = (s > 0) & (place < (limits * band)[owner])
        flat.reshape(-1)[place[real]] = _extended(found.bits[real], s[real]) * (1 << al)
        np.maximum.at(reached, owner[at], np.where(stops[last], (block + held // band + run) * band, block * band + held))
    if (reached < limits * band).any():
        raise ValueError(SHORT)


def _refine_ac(blocks: np.ndarray, segment: bytes, table: list[tuple[int, int]], al: int) -> None:
    """A refinement scan of a band. blocks: (blocks, band), changed in place."""
    n, band = blocks.shape
    flat = blocks.reshape(-1)
    symbols, lengths, _ = _lookup(tuple(table))
    known = flat != 0
    counts = np.append(0, np.cumsum(known))
    zeros = np.flatnonzero(~known)
    bits = np.unpackbits(np.frombuffer(segment, np.uint8))
    at = place = 0  # bit; place in the band's blocks
    corrections, fresh = [], []
    while place < n * band:
        window = int.from_bytes(segment[at >> 3 : (at >> 3) + 5].ljust(5, b"\0")) >> (8 - (at & 7))
        code = window >> 16 & 0xFFFF
        size = int(lengths[code])
        if not size:
            raise ValueError(SHORT)
        at += size
        r, s = divmod(int(symbols[code]), 16)
        more = window >> 16 - size & 0xFFFF
        if s == 0 and r < 15:
            run = (1 << r) + (more >> 16 - r)
            at += r
            to = after = min((place // band + run) * band, n * band)
        else:
            end = (place // band + 1) * band
            skip = place - int(counts[place]) + r
            to = int(zeros[skip]) if skip < len(zeros) and zeros[skip] < end else end
            if s:
                at += 1
                if to < end:
                    fresh.append((to, 1 << al if more >> 15 else -(1 << al)))
            after = min(to + 1, end)
        some = int(counts[to] - counts[place])
        corrections.append(bits[at : at + some])
        if len(corrections[-1]) < some:
            raise ValueError(SHORT)
        at += some
        place = after
    given = np.concatenate(corrections) if corrections else bits[:0]
    values = flat[known]
    flat[known] = values + np.where((given == 1) & ((np.abs(values) >> al) & 1 == 0), np.sign(values) << al, 0)
    for k, value in fresh:
        flat[k] = value


def read(data: bytes) -> Image:
    """The coefficients of a progressive file."""
    return read_many([data])[0]


def read_many(files: list[bytes]) -> list[Image]:
    """The coefficients of progressive files. Scans that are alike are read together, which saves most of the time of small files."""
    parsed = [_parse(f) for f in files]
    left = [(image, scans) for image, scans in parsed if scans]
    step = 0
    while left:
        groups: dict[tuple, list[_Scan]] = {}
        for _, scans in left:
            groups.setdefault(scans[step].key(), []).append(scans[step])
        for group in groups.values():
            _read_scans(group)
        step += 1
        left = [(image, scans) for image, scans in left if len(scans) > step]
    return [image for image, _ in parsed]


def _parse(data: bytes) -> tuple[Image, list[_Scan]]:
    image, tables, interval, at, scans = Image(0, 0, [], {}), {}, 0, 2, []
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return image, scans
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else "u1").astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            specs = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
            image.components = frame(image.width, image.height, [(s[1] >> 4, s[1] & 15) for s in specs])
            for c, s in zip(image.components, specs, strict=True):
                c.id, c.table = s[0], s[2]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError(f"not a progressive file: frame type {marker - 0xC0}")
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                symbols = iter(body[17 : 17 + sum(counts)])
                tables = tables | {(body[0] >> 4, body[0] & 15): [(next(symbols), n + 1) for n, count in enumerate(counts) for _ in range(count)]}
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            n = body[0]
            by_id = {c.id: c for c in image.components}
            parts = [(by_id[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            segments, at = _segments(data, at)
            scans.append(_Scan(parts, ss, se, a >> 4, a & 15, segments, tables, interval))


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded bytes from at up to the next marker, without stuffing, parted at restarts."""
    out, start = [], at
    while True:
        at = data.index(b"\xff", at)
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            at += 2
            start = at
        else:
            out.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            return out, at


def samples(c: Component, quant: np.ndarray) -> np.ndarray:
    """8-bit samples of a component's blocks."""
    flat = c.coefficients.reshape(-1, 64)
    small = (quant == 1).all() and np.abs(flat).max(initial=0) <= 512
    if small:
        x, shift = flat.astype(np.float32) @ INVERSE_SMALL, SHIFT
    else:
        x, shift = (flat * quant).astype(np.float64) @ INVERSE, SHIFT + 8
    x += (1 << (shift - 1)) + (128 << shift)
    x *= 1.0 / (1 << shift)
    np.floor(x, out=x)
    np.clip(x, 0, 255, out=x)
    return x.astype(np.uint8).reshape(c.down, c.across, 8, 8).swapaxes(1, 2).reshape(c.down * 8, c.across * 8)


def rgb(image: Image) -> np.ndarray:
    """The full-resolution (height, width, 3) tensor: one component is grey, three are YCbCr."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        plane = samples(c, image.quant[c.table])
        if (vm // c.v, hm // c.h) != (1, 1):
            plane = plane.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = (p.astype(np.int32) for p in planes)
    cb, cr, half = cb - 128, cr - 128, 1 << 15
    r = y + ((91881 * cr + half) >> 16)  # 1.402, 0.344136, 0.714136 and 1.772 times 65536
    g = y - ((22554 * cb + 46802 * cr + half) >> 16)
    b = y + ((116130 * cb + half) >> 16)
    return np.clip(np.stack([r, g, b], axis=2), 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    return rgb(read(data))


# Writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table_segment(kind: int, number: int, table: list[tuple[int, int]]) -> bytes:
    counts = bytes(sum(n == k for _, n in table) for k in range(1, 17))
    return _segment(0xC4, bytes([kind << 4 | number]) + counts + bytes(s for s, _ in table))


def _head(image: Image) -> bytes:
    out = b"\xff\xd8" + (_segment(0xFE, image.comment) if image.comment else b"")
    for number, q in sorted(image.quant.items()):
        out += _segment(0xDB, bytes([number]) + bytes(q.astype(np.uint8)))
    parts = b"".join(bytes([c.id, c.h << 4 | c.v, c.table]) for c in image.components)
    return out + _segment(0xC2, struct.pack(">BHHB", 8, image.height, image.width, len(image.components)) + parts)


def _scan_head(ids: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(ids)]) + b"".join(bytes([i, 0]) for i in ids) + bytes([ss, se, ah << 4 | al]))


def _pack(items: list[tuple[int, int]]) -> bytes:
    """Bits from (value, number of bits), padded with ones and stuffed."""
    text = "".join(format(v, f"0{n}b") for v, n in items if n)
    text += "1" * (-len(text) % 8)
    return int(text or "0", 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")


def _magnitude(x: int) -> tuple[int, int]:
    n = abs(x).bit_length()
    return (x if x >= 0 else x + (1 << n) - 1), n


def _write_dc(image: Image, al: int) -> list:
    before, out = {}, []
    first = image.components[0]
    alone = len(image.components) == 1
    for my in range(first.own_down if alone else first.down // first.v):
        for mx in range(first.own_across if alone else first.across // first.h):
            for c in image.components:
                h, v = (1, 1) if alone else (c.h, c.v)
                for y in range(v):
                    for x in range(h):
                        now = int(c.coefficients[my * v + y, mx * h + x, 0]) >> al
                        value, n = _magnitude(now - before.get(c.id, 0))
                        before[c.id] = now
                        out += [n, (value, n)]
    return out


def _write_ac(c: Component, ss: int, se: int, ah: int, al: int) -> list:
    """Symbols (numbers) and extra bits (pairs) of one scan."""
    out: list = []
    run, tail = 0, []  # blocks of the current end-of-band run, with their correction bits

    def end_run() -> None:
        nonlocal run, tail
        if run:
            n = run.bit_length() - 1
            out.extend([n << 4, (run - (1 << n), n), *tail])
        run, tail = 0, []

    for block in c.coefficients[: c.own_down, : c.own_across].reshape(-1, 64).tolist():
        sizes = [abs(x) >> al for x in block]
        last = max((k for k in range(ss, se + 1) if (sizes[k] == 1 if ah else sizes[k])), default=0)
        zeros, fixes = 0, []
        for k in range(ss, se + 1):
            if not sizes[k]:
                zeros += 1
                continue
            if not ah and k > last:
                break
            while zeros > 15 and k <= last:
                end_run()
                out.extend([0xF0, *fixes])
                fixes = []
                zeros -= 16
            if ah and sizes[k] > 1:
                fixes.append((sizes[k] & 1, 1))
                continue
            end_run()
            if ah:
                out.extend([zeros << 4 | 1, (int(block[k] > 0), 1), *fixes])
                fixes = []
            else:
                value, n = _magnitude(sizes[k] if block[k] > 0 else -sizes[k])
                out.extend([zeros << 4 | n, (value, n)])
            zeros = 0
        if zeros or fixes:
            run += 1
            tail += fixes
            if run == LONGEST_RUN:
                end_run()
    end_run()
    return out


def encode(image: Image, bands: tuple[tuple[int, int], ...] = ((1, 5), (6, 63)), al: int = 1) -> bytes:
    """A progressive file: DC and AC bands first without their al lowest bits, then refinement scans bit by bit."""
    out = [_head(image)]
    ids = [c.id for c in image.components]

    def scan(kind: int, who: list[int], ss: int, se: int, ah: int, low: int, items: list) -> None:
        table = even_table({x for x in items if isinstance(x, int)})
        codes = _codes(table)
        out.extend([_table_segment(kind, 0, table) if table else b"", _scan_head(who, ss, se, ah, low), _pack([codes[x] if isinstance(x, int) else x for x in items])])

    scan(0, ids, 0, 0, 0, al, _write_dc(image, al))
    for c in image.components:
        for ss, se in bands:
            scan(1, [c.id], ss, se, 0, al, _write_ac(c, ss, se, 0, al))
    for low in range(al - 1, -1, -1):
        dc = [(v >> low & 1, 1) for v in _dc_in_order(image)]
        out.extend([_scan_head(ids, 0, 0, low + 1, low), _pack(dc)])
        for c in image.components:
            scan(1, [c.id], 1, 63, low + 1, low, _write_ac(c, 1, 63, low + 1, low))
    return b"".join(out) + b"\xff\xd9"


def _dc_in_order(image: Image) -> list[int]:
    first, out = image.components[0], []
    if len(image.components) == 1:
        return first.coefficients[: first.own_down, : first.own_across, 0].ravel().tolist()
    for my in range(first.down // first.v):
        for mx in range(first.across // first.h):
            for c in image.components:
                out += c.coefficients[my * c.v : (my + 1) * c.v, mx * c.h : (mx + 1) * c.h, 0].ravel().tolist()
    return out


# Payloads: each byte is one coefficient. AC: 2 to 129 with the top bit as sign, so none is zero at any point transform of one bit.

_BYTES = np.arange(256)
AC_VALUES = _byte_values(BYTE_AC)
_AC_OF = np.where(_BYTES < 128, 2 + _BYTES, -(_BYTES - 126)).astype(np.int32)
_BYTE_OF_AC = np.zeros(512, np.uint8)
_BYTE_OF_AC[_AC_OF + 256] = _BYTES
_CODE_OF = {int(v): b for b, v in enumerate(AC_VALUES) if v and b < 254}
_FIRST_AC = np.array([_CODE_OF[int(np.sign(v) * (abs(v) >> 1))] for v in _AC_OF], np.uint8)
_LOW_AC = (np.abs(_AC_OF) & 1).astype(np.uint8)
_DC_CODES = _codes(BYTE_DC)
_FIRST_DC = np.array([_DC_CODES[_magnitude(d)[1]][0] << _magnitude(d)[1] | _magnitude(d)[0] for d in range(-127, 128)], np.uint8)
_TABLES = _table_segment(0, 0, BYTE_DC) + _table_segment(1, 0, BYTE_AC)
_RUN_TABLE = _table_segment(1, 0, RUNS)


def padded(data: bytes) -> bytes:
    """With zero bytes up to a positive multiple of 64."""
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def payload_to_jpeg(payload: bytes) -> bytes:
    """A file of luma and half-resolution chroma whose coefficients are the bytes of the payload, a positive multiple of 64: each 384 bytes are four blocks of luma, one of each chroma."""
    units = -(-len(payload) // 384)
    across = -(-units // MOST_SIDE)
    down = -(-units // across)
    total = across * down
    data = np.frombuffer(payload + bytes(total * 384 - len(payload)), np.uint8).reshape(total, 6, 64)
    parts = [data[:, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64), data[:, 4], data[:, 5]]
    dc = data[:, :, 0].astype(np.int16) - 128
    high = dc >> 1
    steps = np.concatenate([np.diff(high[:, u].ravel(), prepend=np.int16(0)).reshape(total, -1) for u in (slice(0, 4), slice(4, 5), slice(5, 6))], axis=1)
    stuffed = lambda x: x.replace(b"\xff", b"\xff\x00")
    packed = lambda x: stuffed(np.packbits(np.concatenate([x, np.ones(-len(x) % 8, np.uint8)])).tobytes())
    image = Image(across * 16, down * 16, [Component(1, 2, 2, 0), Component(2, 1, 1, 1), Component(3, 1, 1, 1)], {0: np.ones(64, np.int32), 1: np.ones(64, np.int32)}, b"payload=%d" % len(payload))
    out = [_head(image), _TABLES, _scan_head([1, 2, 3], 0, 0, 0, 1), _FIRST_DC[steps + 127].tobytes()]
    for number, bands in ((1, ((1, 5), (6, 63))), (2, ((1, 63),)), (3, ((1, 63),))):
        first = _FIRST_AC[parts[number - 1]]
        for ss, se in bands:
            out += [_scan_head([number], ss, se, 0, 1), np.ascontiguousarray(first[:, ss : se + 1]).tobytes()]
    out += [_scan_head([1, 2, 3], 0, 0, 1, 0), packed((dc & 1).astype(np.uint8).ravel()), _RUN_TABLE]
    for number, blocks in enumerate(parts, 1):
        low, bits = _LOW_AC[blocks[:, 1:]], []
        for at in range(0, len(blocks), LONGEST_RUN):
            run = min(LONGEST_RUN, len(blocks) - at)
            k = run.bit_length() - 1
            bits += [np.array([int(x) for x in format(k, "04b") + (format(run - (1 << k), f"0{k}b") if k else "")], np.uint8), low[at : at + run].ravel()]
        out += [_scan_head([number], 1, 63, 1, 0), packed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


def jpeg_to_payload(image: Image) -> bytes:
    y, cb, cr = (c.coefficients for c in image.components)
    down, across = cb.shape[:2]
    flat = np.concatenate([y.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64), cb.reshape(-1, 1, 64), cr.reshape(-1, 1, 64)], axis=1).reshape(-1, 64)
    out = _BYTE_OF_AC[flat + 256]
    out[:, 0] = flat[:, 0] + 128
    return out.tobytes()[: int(image.comment.removeprefix(b"payload="))]


def feature(tensor: np.ndarray) -> str:
    """Shape, mean and checksum of an RGB tensor."""
    return f"{tensor.shape[0]}x{tensor.shape[1]}x3 mean={tensor[:, :, 0].mean(dtype=np.float64):.4f},{tensor[:, :, 1].mean(dtype=np.float64):.4f},{tensor[:, :, 2].mean(dtype=np.float64):.4f} crc32={zlib.crc32(np.ascontiguousarray(tensor)):08x}"


def decode_column(df: DataFrame, media: str = "media", kept: tuple[str, ...] = ()) -> DataFrame:
    """Rows (kept columns, height, width, rgb, error): the RGB tensor of each JPEG in row order, as bytes.

    A null or damaged file gives null values and the error's text.
    """
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                try:
                    tensor, error = decode(row.column(0)[0].as_py()), None
                    found = [tensor.shape[0], tensor.shape[1], tensor.tobytes()]
                except Exception as e:
                    found, error = [None, None, None], f"{type(e).__name__}: {e}"
                arrays = [pa.array([x], k) for x, k in zip([*found, error], (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*row.columns[1:], *arrays], names=[*kept, "height", "width", "rgb", "error"])

    return df.select(media, *kept).mapInArrow(tidy(run), schema_of(df, list(kept), "height int, width int, rgb binary, error string"))


def media_columns(docs: DataFrame, with_media: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text stored as a progressive JPEG and read back: sizes, digests and features of the stored form, its full-resolution RGB tensor in row order (height, width, rgb), and the file itself if asked for."""
    spec = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary" + ", media binary" * with_media
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()] + [pa.binary()] * with_media
    names = [part.split()[0] for part in spec.split(", ")]

    def rows(some: list[bytes]) -> list[tuple]:
        files, out = [payload_to_jpeg(padded(data)) for data in some], []
        for data, media, image in zip(some, files, read_many(files), strict=True):
            back, tensor = jpeg_to_payload(image), rgb(image)
            out.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(tensor), *tensor.shape[:2], tensor.tobytes(), *[media] * with_media))
        return out

    def run(batches):
        for batch in batches:
            some, held, first = [], 0, 0
            for i, t in enumerate(batch.column(1).cast(pa.binary())):
                some.append(t.as_py() or b"")
                held += len(some[-1]) + 64
                if held >= TOGETHER or i == batch.num_rows - 1:
                    out = rows(some)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names=[doc_id, *names])
                    some, held, first = [], 0, i + 1

    return docs.select(doc_id, text).mapInArrow(tidy(run), schema_of(docs, [doc_id], spec))


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))

"""A progressive JPEG reader bit by bit and block by block, for comparison: it shares no decoding code with the operator."""

import struct

import numpy as np


def codes_of(table):
    code, last, out = 0, table[0][1] if table else 0, {}
    for symbol, n in table:
        code <<= n - last
        last = n
        out[n, code] = symbol
        code += 1
    return out


class Bits:
    """Reads an entropy-coded segment bit by bit; past the end there are zeros."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            self.held = (self.held << 8) | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.n += 8
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, known: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = (code << 1) | self.take(1)
            if (n, code) in known:
                return known[n, code]
        raise ValueError("no such Huffman code")


def _extend(x: int, n: int) -> int:
    return x if not n or x >= 1 << (n - 1) else x - (1 << n) + 1


def _first_block(bits: Bits, known: dict, block: np.ndarray, ss: int, se: int, al: int, run: int) -> int:
    if run:
        return run - 1
    k = ss
    while k <= se:
        symbol = bits.symbol(known)
        r, s = symbol >> 4, symbol & 15
        if s:
            k += r
            block[k] = _extend(bits.take(s), s) * (1 << al)
        elif r == 15:
            k += 15
        else:
            return (1 << r) + bits.take(r) - 1
        k += 1
    return 0


def _refine_block(bits: Bits, known: dict, block: np.ndarray, ss: int, se: int, al: int, run: int) -> int:
    one = 1 << al

    def correct(k: int) -> None:
        if bits.take(1) and not abs(int(block[k])) & one:
            block[k] += one if block[k] > 0 else -one

    k = ss
    while not run and k <= se:
        symbol = bits.symbol(known)
        r, s = symbol >> 4, symbol & 15
        new = 0
        if s:
            new = one if bits.take(1) else -one
        elif r < 15:
            run = (1 << r) + bits.take(r)
            break
        while k <= se:
            if block[k]:
                correct(k)
            elif r == 0:
                break
            else:
                r -= 1
            k += 1
        if new and k <= se:
            block[k] = new
        k += 1
    if run:
        for k in range(k, se + 1):
            if block[k]:
                correct(k)
        return run - 1
    return 0


def coefficients(data: bytes) -> list[np.ndarray]:
    """The coefficients of each component, padded to whole units."""
    tables, interval, at, parts = {}, 0, 2, {}
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            factors = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)}
            hm, vm = max(h for h, _ in factors.values()), max(v for _, v in factors.values())
            mcus = -(-height // (8 * vm)), -(-width // (8 * hm))
            for c, (h, v) in factors.items():
                own = -(-(-(-height * v // vm)) // 8), -(-(-(-width * h // hm)) // 8)
                parts[c] = np.zeros((mcus[0] * v, mcus[1] * h, 64), np.int32), own, (h, v)
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                symbols = list(body[17 : 17 + sum(counts)])
                tables[body[0] >> 4, body[0] & 15] = codes_of([(symbols.pop(0), n + 1) for n, k in enumerate(counts) for _ in range(k)])
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            n = body[0]
            chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            stop, segments = at, [bytearray()]
            while data[stop] != 0xFF or data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7:
                if data[stop] == 0xFF and data[stop + 1]:
                    segments.append(bytearray())
                    stop += 2
                else:
                    segments[-1].append(data[stop])
                    stop += 2 if data[stop] == 0xFF else 1
            at = stop
            if n == 1:
                c = chosen[0][0]
                units = [[(chosen[0], y, x)] for y in range(parts[c][1][0]) for x in range(parts[c][1][1])]
            else:
                units = [[(who, my * parts[who[0]][2][1] + y, mx * parts[who[0]][2][0] + x) for who in chosen for y in range(parts[who[0]][2][1]) for x in range(parts[who[0]][2][0])] for my in range(mcus[0]) for mx in range(mcus[1])]
            every = interval or len(units)
            for number, segment in enumerate(segments):
                bits, before, run = Bits(bytes(segment)), {}, 0
                for unit in units[number * every : (number + 1) * every]:
                    for (c, dc, ac), y, x in unit:
                        block, ah, al = parts[c][0][y, x], a >> 4, a & 15
                        if ss == 0 and not ah:
                            n_ = bits.symbol(tables[0, dc])
                            before[c] = before.get(c, 0) + _extend(bits.take(n_), n_)
                            block[0] = before[c] << al
                        elif ss == 0:
                            block[0] |= bits.take(1) << al
                        elif not ah:
                            run = _first_block(bits, tables[1, ac], block, ss, se, al, run)
                        else:
                            run = _refine_block(bits, tables[1, ac], block, ss, se, al, run)
    return [p[0] for p in parts.values()]

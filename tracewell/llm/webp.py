"""Lossless WebP (VP8L) pixels in numpy: a full decoder and an encoder.

The decoder reads prefix codes (simple and normal), literals, back-references with the
two-dimensional distance map, the colour cache and meta prefix codes, and inverts the
predictor, cross-colour, subtract-green and palette transforms. Streams of one group of prefix
codes take a vectorised way: what starts at every bit position is looked up at once and only the
chain of positions is walked; pixels that copies and cache hits stand for are found by following
all their sources side by side.

The encoder takes, for each picture, the transforms that its estimate of the coded bits prefers
(palette; or predictor, then cross-colour or subtract-green), replaces repeats by
back-references, and uses the colour cache where that pays.

Pixels are uint8 arrays (height, width, 4) in the order alpha, red, green, blue.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

LIMIT = 13  # longest code that the encoder writes
MAX_CODE = 15
BLOCK_BITS = 1 << 19
GROUPS_AT_ONCE = 1  # streams of more groups of prefix codes are read a symbol at a time
#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
ALPHABETS = (256 + 24, 256, 256, 256, 40)
SIGNATURE = 0x2F
#: The 120 nearest pixels by distance: closer first, then smaller |x|, then the right-hand one.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


# ---- prefix codes ------------------------------------------------------------------------


_REVERSED = np.array([int(f"{k:08b}"[::-1], 2) for k in range(256)], np.uint32)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the given lengths, bit-reversed as they stand in the stream."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[used].astype(np.uint32)
    room = np.uint32(1) << (16 - n)
    straight = np.cumsum(room, dtype=np.uint32) - room  # codes, left-aligned in 16 bits
    codes[used] = (_REVERSED[straight & 255] << 8 | _REVERSED[straight >> 8]) & ((np.uint32(1) << n) - 1)
    return codes


class Code:
    """Lookup tables over `bits` bits of the stream: the symbol and its length."""

    def __init__(self, lengths: np.ndarray, single: int | None = None):
        used = np.flatnonzero(lengths)
        if single is None and len(used) == 1:
            single = int(used[0])
        self.used, self.lengths, self.single = used, lengths[used], single
        if single is not None:
            self.bits, self.symbols, self.sizes = 0, np.array([single], np.uint16), np.array([0], np.uint8)
            self.table = [(single, 0)]
            return
        if not len(used) or (1 << MAX_CODE >> self.lengths.astype(int)).sum() != 1 << MAX_CODE:
            raise ValueError("incomplete prefix code")
        self.bits = int(lengths.max())
        # Left-aligned canonical codes in order fill the table; the stream has them reversed.
        order = used[np.argsort(self.lengths, kind="stable")]
        straight = np.repeat(order, 1 << (self.bits - lengths[order].astype(int)))
        k = np.arange(1 << self.bits, dtype=np.uint32) << (16 - self.bits)
        self.symbols = straight[_REVERSED[k & 255] << 8 | _REVERSED[k >> 8]].astype(np.uint16)
        self.sizes = lengths[self.symbols].astype(np.uint8)

    def __eq__(self, other: object) -> bool:
        return self is other or (self.single == other.single and np.array_equal(self.used, other.used) and np.array_equal(self.lengths, other.lengths))

    def lookup(self) -> list[tuple[int, int]]:
        if not hasattr(self, "table"):
            self.table = list(zip(self.symbols.tolist(), self.sizes.tolist(), strict=True))
        return self.table


@lru_cache(64)
def code_of(lengths: bytes) -> Code:
    """Codes by their lengths without trailing zeros: the colours of a picture often share one."""
    return Code(np.frombuffer(lengths, np.uint8))


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 24, 0
        self.end = len(data) * 8
        self.last: tuple | None = None

    def peek(self) -> int:
        if self.at > self.end:
            raise ValueError("stream ends early")
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        return value

    def symbol(self, code: Code) -> int:
        symbol, size = code.lookup()[self.peek() & ((1 << code.bits) - 1)]
        self.at += size
        return symbol

    def code(self, alphabet: int) -> Code:
        if self.read(1):
            two, wide = self.read(1), self.read(1)
            symbols = [self.read(8 if wide else 1)] + ([self.read(8)] if two else [])
            lengths = np.zeros(256, np.uint8)
            lengths[symbols] = 1
            return Code(lengths, single=symbols[0] if len(set(symbols)) == 1 else None)
        again = self.last  # colours often share their code: the same bits need no second reading
        if again is not None and again[0] == alphabet:
            first = self.at >> 3
            rest = int.from_bytes(self.data[first : first + (again[1] >> 3) + 2], "little") >> (self.at & 7)
            if rest & ((1 << again[1]) - 1) == again[2]:
                self.at += again[1]
                return again[3]
        begun = self.at
        given = bytearray(19)
        for k in range(4 + self.read(4)):
            given[LENGTH_ORDER[k]] = self.read(3)
        given = code_of(bytes(given).rstrip(b"\0"))
        table, mask = given.lookup(), (1 << given.bits) - 1
        tokens = 2 + self.read(2 + 2 * self.read(3)) if self.read(1) else alphabet
        # All the lengths' bits at once: no token takes more than 7 + 7 bits.
        first = self.at >> 3
        rest = int.from_bytes(self.data[first : first + 2 * alphabet + 8], "little") >> (self.at & 7)
        lengths, last, used = [], 8, 0
        while len(lengths) < alphabet and tokens:
            tokens -= 1
            s, size = table[rest & mask]
            rest >>= size
            used += size
            if s < 16:
                lengths.append(s)
                last = s or last
                continue
            size = (2, 3, 7)[s - 16]
            run = (3, 3, 11)[s - 16] + (rest & ((1 << size) - 1))
            rest >>= size
            used += size
            lengths += [last if s == 16 else 0] * run
        if len(lengths) > alphabet:
            raise ValueError("code lengths overrun")
        self.at += used
        size, code = self.at - begun, code_of(bytes(lengths).rstrip(b"\0"))
        rest = int.from_bytes(self.data[begun >> 3 : (self.at >> 3) + 1], "little") >> (begun & 7)
        self.last = alphabet, size, rest & ((1 << size) - 1), code
        return code

    def amount(self, prefix: int) -> int:
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1


# ---- decoding ----------------------------------------------------------------------------


EXTRA = np.array([0, 0, 0, 0] + [(k - 2) >> 1 for k in range(4, 40)])
BASE = np.array([1, 2, 3, 4] + [((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(4, 40)])


def _roots(parent: np.ndarray) -> np.ndarray:
    """Where each chain of sources ends."""
    while True:
        further = parent[parent]
        if np.array_equal(further, parent):
            return parent
        parent = further


@lru_cache(64)
def _near_distances(width: int) -> np.ndarray:
    return np.array([max(1, x + y * width) for x, y in NEAR])


@lru_cache(64)
def _near_codes(width: int) -> dict[int, int]:
    found: dict[int, int] = {}
    for k, d in enumerate(_near_distances(width).tolist(), 1):
        found.setdefault(d, k)
    return found


def _one_group(bits: Bits, codes: list[Code], width: int, n: int, cache_bits: int) -> np.ndarray:
    """n pixels (n, 4) that one group of prefix codes holds."""
    green, red, blue, alpha, far = codes
    data = np.frombuffer(bits.data, np.uint8)
    masks = [np.uint32((1 << c.bits) - 1) for c in codes]
    plain = green.used.max(initial=0) < 256 if green.single is None else green.single < 256
    places, at, left = [], bits.at, n
    while left:
        if at > bits.end:
            raise ValueError("stream ends early")
        first = at >> 3
        b = data[first : first + min(BLOCK_BITS, left * 4 * MAX_CODE + 64) // 8 + 24].astype(np.uint32)
        word = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
        seen = (word[:, None] >> np.arange(8, dtype=np.uint32)).ravel()
        stop = max(0, len(seen) - 128)  # no pixel takes more bits; later positions stay put
        ends = bits.end - 8 * first
        look = seen & masks[0]
        sizes_of = {id(green): green.sizes[look]}
        g, after = green.symbols[look[:stop]], np.arange(stop, dtype=np.int32) + sizes_of[id(green)][:stop]
        p = after
        for k in (1, 2, 3):
            if codes[k].single is None:
                if (own := id(codes[k])) not in sizes_of:
                    sizes_of[own] = codes[k].sizes[seen & masks[k]]
                p = p + sizes_of[own][p]
        size = None
        if not plain:
            p = np.where(g < 280, p, after)
            run = np.flatnonzero((g >= 256) & (g < 280))
            extra = EXTRA[g[run] - 256]
            to = after[run] + extra
            look = seen[to] & masks[4]
            p[run] = to + far.sizes[look] + EXTRA[far.symbols[look]]
            size = np.ones(stop, np.int64)
            size[run] = BASE[g[run] - 256] + (seen[after[run]] & ((np.uint32(1) << extra.astype(np.uint32)) - 1))
        step, at_bit, chain = memoryview(p), at - 8 * first, []
        add = chain.append
        if plain:
            for _ in range(left):
                if at_bit >= stop:
                    break
                add(at_bit)
                at_bit = step[at_bit]
            left -= len(chain)
        else:
            sizes = memoryview(size)
            while left > 0 and at_bit < stop:
                add(at_bit)
                left -= sizes[at_bit]
                at_bit = step[at_bit]
        if not chain or left < 0 or at_bit > ends:
            raise ValueError("stream ends early" if left >= 0 else "back-reference out of range")
        at = 8 * first + at_bit
        chain = np.array(chain)
        s, q = g[chain].astype(np.int64), after[chain]
        literal = s << 8
        for k, shift in ((1, 16), (2, 0), (3, 24)):
            if codes[k].single is not None:
                literal |= codes[k].single << shift
                continue
            look = seen[q] & masks[k]
            literal |= codes[k].symbols[look].astype(np.int64) << shift
            q = q + codes[k].sizes[look]
        if plain:
            places.append((literal, None, None, None))
            continue
        run = np.flatnonzero((s >= 256) & (s < 280))
        q = after[chain[run]] + EXTRA[s[run] - 256]
        look = seen[q] & masks[4]
        prefix, q = far.symbols[look].astype(np.int64), q + far.sizes[look]
        back = BASE[prefix] + (seen[q] & ((np.uint32(1) << EXTRA[prefix].astype(np.uint32)) - 1))
        length, distance = np.ones(len(s), np.int64), np.zeros(len(s), np.int64)
        length[run] = size[chain[run]]
        distance[run] = np.where(back > 120, back - 120, _near_distances(width)[np.minimum(back, 120) - 1])
        places.append((literal, s, length, distance))
    bits.at = at
    literal, s, length, distance = (np.concatenate(c) if c[0] is not None else None for c in zip(*places, strict=True))
    if not plain:
        start = np.cumsum(length) - length
        token = np.repeat(np.arange(len(s)), length)
        here = np.arange(n)
        parent = here - distance[token]
        if (distance > start).any():
            raise ValueError("back-reference out of range")
        pixel = literal[token]
        if cache_bits:
            slot = np.where(s >= 280, s - 280, (CACHE_MULTIPLIER * literal & 0xFFFFFFFF) >> (32 - cache_bits))
            slot = slot[token][_roots(parent)]
            order = np.argsort(slot, kind="stable")
            before = np.full(n, -1)
            same = slot[order[1:]] == slot[order[:-1]]
            before[order[1:][same]] = order[:-1][same]
            hit = np.flatnonzero(s[token] >= 280)
            pixel[hit] = 0  # what a slot holds before anything went in
            parent[hit] = np.where(before[hit] >= 0, before[hit], hit)
        literal = pixel[_roots(parent)]
    return literal.astype(">u4").view(np.uint8).reshape(n, 4)


def _entropy_coded(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The pixels of one entropy-coded image, (height, width, 4)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, block, chosen = 1, 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        meta = _entropy_coded(bits, (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
        chosen = meta[:, :, 1].astype(int) << 8 | meta[:, :, 2]
        groups = int(chosen.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[bits.code(a + (cache_size if k == 0 else 0)) for k, a in enumerate(ALPHABETS)] for _ in range(groups)]
    n = width * height
    if groups <= GROUPS_AT_ONCE:
        return _one_group(bits, codes[0], width, n, cache_bits).reshape(height, width, 4)
    out, cache, i = [0] * n, [0] * cache_size, 0
    fresh = 0  # pixels before this one are in the cache
    while i < n:
        group = codes[chosen[i // width >> block, i % width >> block] if chosen is not None else 0]
        s = bits.symbol(group[0])
        if s < 256:
            red, blue, alpha = bits.symbol(group[1]), bits.symbol(group[2]), bits.symbol(group[3])
            out[i] = alpha << 24 | red << 16 | s << 8 | blue
            i += 1
            continue
        for pixel in out[fresh:i] if cache_size else ():
            cache[(CACHE_MULTIPLIER * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel
        fresh = i
        if s >= 280:
            out[i] = cache[s - 280]
            i += 1
            continue
        run, distance = bits.amount(s - 256), bits.amount(bits.symbol(group[4]))
        if distance > 120:
            distance -= 120
        else:
            x, y = NEAR[distance - 1]
            distance = max(1, x + y * width)
        if distance > i or i + run > n:
            raise ValueError("back-reference out of range")
        for _ in range(run):
            out[i] = out[i - distance]
            i += 1
    return np.array(out, ">u4").view(np.uint8).reshape(height, width, 4)


def _average(a, b):
    return (a + b) >> 1


def _predict(mode: int, left, top, top_left, top_right):
    """Predicted channels from int arrays of four."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        guess = left + top - top_left
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        half = mean - top_left
        return np.clip(mean + (np.abs(half) >> 1) * np.sign(half), 0, 255)
    return np.array([255, 0, 0, 0])


def _undo_predictor(pixels: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    used = np.unique(modes[:, :, 2] & 15).tolist()
    if used in ([1], [2]):  # every pixel adds to its left or upper neighbour
        out = pixels.copy()
        out[0, 0, 0] = (int(out[0, 0, 0]) + 255) & 255
        if used == [1]:
            out[:, 0] = out[:, 0].cumsum(0, dtype=np.uint8)
            return out.cumsum(1, dtype=np.uint8)
        out[0] = out[0].cumsum(0, dtype=np.uint8)
        return out.cumsum(0, dtype=np.uint8)
    out = pixels.astype(np.int64)
    height, width = out.shape[:2]
    for y in range(height):
        for x in range(width):
            if x == 0 and y == 0:
                guess = np.array([255, 0, 0, 0])
            elif y == 0:
                guess = out[y, x - 1]
            elif x == 0:
                guess = out[y - 1, x]
            else:
                right = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                guess = _predict(int(modes[y >> block, x >> block, 2]) & 15, out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], right)
            out[y, x] = (out[y, x] + guess) & 255
    return out.astype(np.uint8)


def _undo_cross(pixels: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    height, width = pixels.shape[:2]
    f = factors[np.arange(height)[:, None] >> block, np.arange(width)[None] >> block].view(np.int8).astype(np.int64)
    green = np.ascontiguousarray(pixels[:, :, 2]).view(np.int8).astype(np.int64)
    red = (pixels[:, :, 1] + (f[:, :, 3] * green >> 5)) & 255
    blue = pixels[:, :, 3] + (f[:, :, 2] * green >> 5) + (f[:, :, 1] * red.astype(np.uint8).view(np.int8) >> 5)
    out = pixels.copy()
    out[:, :, 1], out[:, :, 3] = red, blue & 255
    return out


def _undo_palette(pixels: np.ndarray, table: np.ndarray, pack: int, width: int) -> np.ndarray:
    index = pixels[:, :, 2].astype(np.int64)
    if pack:
        each = 8 >> pack
        x = np.arange(width)
        index = index[:, x >> pack] >> ((x & ((1 << pack) - 1)) * each) & ((1 << each) - 1)
    known = np.zeros((256, 4), np.uint8)
    known[: len(table)] = table
    return known[index]


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4; alpha, red, green, blue) of a lossless WebP file.

    ValueError for anything that is not a whole, valid stream.
    """
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack_from("<I", data, 16)[0]
    if len(data) < 20 + size or data[20] != SIGNATURE:
        raise ValueError("damaged container")
    bits = Bits(data[21 : 20 + size])
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    undo, wide, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform stands twice")
        seen.add(kind)
        if kind in (0, 1):
            block = bits.read(3) + 2
            own = _entropy_coded(bits, (wide + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
            undo.append(lambda p, own=own, block=block, f=(_undo_predictor, _undo_cross)[kind]: f(p, own, block))
        elif kind == 2:
            undo.append(lambda p: p + p[:, :, 2:3] * np.array([0, 1, 0, 1], np.uint8))
        else:
            count = bits.read(8) + 1
            table = _entropy_coded(bits, count, 1, False)[0].cumsum(0, dtype=np.uint8)
            pack = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
            undo.append(lambda p, table=table, pack=pack, wide=wide: _undo_palette(p, table, pack, wide))
            wide = (wide + (1 << pack) - 1) >> pack
    pixels = _entropy_coded(bits, wide, height, True)
    if bits.at > bits.end:
        raise ValueError("stream ends early")
    for f in reversed(undo):
        pixels = f(pixels)
    return pixels


# ---- encoding ----------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Huffman lengths of at most `limit` bits; rare symbols are counted up until they fit."""
    used, lengths, floor = np.flatnonzero(counts), np.zeros(len(counts), np.uint8), 1
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    m = len(used)
    while True:
        # Two queues: the sorted leaves, and the inner nodes in the order they are made.
        weight, up, leaf, node = np.maximum(counts[used], floor).tolist(), [0] * (2 * m - 1), 0, m
        for k in range(m, 2 * m - 1):
            total = 0
            for _ in (0, 1):
                if node >= k or (leaf < m and weight[leaf] <= weight[node]):
                    up[leaf] = k
                    total += weight[leaf]
                    leaf += 1
                else:
                    up[node] = k
                    total += weight[node]
                    node += 1
            weight.append(total)
        depth = [0] * (2 * m - 1)
        for k in range(2 * m - 3, -1, -1):
            depth[k] = depth[up[k]] + 1
        if max(depth) <= limit:
            lengths[used] = depth[:m]
            return lengths
        floor = max(2 * floor, int(counts.sum()) >> limit)


class Writer:
    def __init__(self):
        self.value, self.at, self.done = 0, 0, b""  # bits after the whole bytes in done

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Many values of up to 25 bits."""
        whole = self.at >> 3
        self.done += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
        self.value, self.at = self.value >> 8 * whole, self.at & 7
        at = self.at + np.cumsum(sizes) - sizes
        end = int(at[-1] + sizes[-1]) if len(at) else self.at
        shifted, n = values << (at & 7), (end >> 3) + 1
        widest = int(sizes.max(initial=0)) + 14 >> 3  # bytes that one value reaches
        body = sum(np.bincount((at >> 3) + k, (shifted >> 8 * k & 255).astype(np.float64), n + 4) for k in range(max(1, widest)))[:n].astype(np.uint8)
        body[0] |= self.value
        self.done += body[:-1].tobytes()
        self.value, self.at = int(body[-1]), end & 7

    def bytes(self) -> bytes:
        return self.done + self.value.to_bytes((self.at + 7) // 8, "little")


def _code_tokens() -> tuple[dict[int, int], list[tuple[int, int]]]:
    """The codes of the lengths' own alphabet: 0 to 13 and the runs of zeros, four bits each."""
    own = np.zeros(19, np.uint8)
    own[[*range(14), 17, 18]] = 4
    return dict(enumerate(canonical(own).tolist())), [(0, 1), (15, 4), *((int(own[s]), 3) for s in LENGTH_ORDER), (0, 1)]


TOKEN_CODES, TOKEN_HEAD = _code_tokens()


def _code_bits(lengths: np.ndarray, alphabet: int) -> tuple[int, int]:
    """A prefix code as it stands in the stream: the bits' value and their number."""
    mine = Writer()
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        mine.put(0b101, 3)  # simple, one symbol, eight bits
        mine.put(int(used[0]), 8)
        return mine.value, mine.at
    for value, n in TOKEN_HEAD:
        mine.put(value, n)
    at, ends = 0, [*used.tolist(), alphabet]
    each = lengths[used].tolist()
    for k, stop in enumerate(ends):
        while (run := min(stop - at, 138)) > 0:
            if run >= 11:
                mine.put(TOKEN_CODES[18] | run - 11 << 4, 11)
            elif run >= 3:
                mine.put(TOKEN_CODES[17] | run - 3 << 4, 7)
            else:
                mine.put(TOKEN_CODES[0], 4)
                run = 1
            at += run
        if stop < alphabet:
            mine.put(TOKEN_CODES[each[k]], 4)
            at += 1
    return mine.value, mine.at


#: Least share of the bits that back-references and cache must save beside literals under one
#: code, which take least time to read, and a transform beside none.
LEAST_GAIN = 0.1
#: Share of a picture's runs of three pixels that must have occurred before for either to be tried.
LEAST_REPEATS = 0.05
#: Cross-colour factor (of 32) from which taking green out of red and blue is tried.
LEAST_FACTOR = 10
#: Mean square difference of neighbours, or of a pixel's colours, beside the colours' variance,
#: below which predictor and cross-colour are tried (1.9 to 2 where they are independent).
SMOOTHER = 1.4
#: Pixels below which red and blue share a prefix code (reading it costs more than it saves).
SHARED_BELOW = 1 << 13
#: Fewest pixels that a back-reference stands for, its longest run, and its farthest source.
LEAST_RUN, LONGEST_RUN, FARTHEST = 3, 4096, (1 << 20) - 120
#: Bits that a transform's own data and a used symbol of a prefix code take, about; slots of the
#: colour cache.
TRANSFORM_BITS, SYMBOL_BITS, CACHE_BITS = 90, 5, 8


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, number of extra bits and extra value of lengths or distance codes."""
    symbol = np.searchsorted(BASE, values, "right") - 1
    return symbol, EXTRA[symbol], values - BASE[symbol]


def _repeats(px: np.ndarray) -> list[tuple[int, int, int]]:
    """(first pixel, pixels, distance) of runs that occurred before, in order and apart."""
    n = len(px)
    if n < LEAST_RUN + 1 or (px == px[0]).all():
        return []  # one colour takes no bits anyway
    key = px[:-2] * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) ^ px[1:-1] * np.int64(0x2545F4914F6CDD1D) ^ px[2:] * np.int64(0x2127599BF4325C37)
    order = np.argsort(key, kind="stable")
    now, old = order[1:], order[:-1]
    same = (px[now] == px[old]) & (px[now + 1] == px[old + 1]) & (px[now + 2] == px[old + 2])
    if not same.any() or same.sum() < LEAST_REPEATS * n:
        return []
    distance = np.zeros(n - 1, np.int64)
    distance[now[same]] = (now - old)[same]
    distance[distance > FARTHEST] = 0
    edge = np.flatnonzero(np.concatenate([[True], distance[1:] != distance[:-1]]))
    found, free = [], 0
    for first, stop, d in zip(edge.tolist(), [*edge[1:].tolist(), n - 1], distance[edge].tolist(), strict=True):
        if d:
            first, stop = max(first, free), stop + 2
            while stop - first >= LEAST_RUN:
                found.append((first, min(stop - first, LONGEST_RUN), d))
                first += found[-1][1]
                free = first
    return found


def _cost(*streams: np.ndarray) -> float:
    """Bits of streams of symbols, each under its own prefix code, and of the codes."""
    counts = np.concatenate([np.bincount(x) for x in streams if len(x)])
    c = counts[counts > 0].astype(np.float64)
    return sum(len(x) * np.log2(len(x)) for x in streams if len(x)) - float((c * np.log2(c)).sum()) + SYMBOL_BITS * len(c)


_CHANNELS = np.array([0, 256, 512])


def _colour_cost(pixels: np.ndarray) -> float:
    counts, n = np.bincount((pixels[:, :, 1:] + _CHANNELS).ravel(), minlength=768), pixels.shape[0] * pixels.shape[1]
    c = counts[counts > 0].astype(np.float64)
    return 3 * n * np.log2(n) - float((c * np.log2(c)).sum()) + SYMBOL_BITS * len(c)


def _with_runs(px: np.ndarray, runs: list[tuple[int, int, int]], width: int, main: bool) -> tuple:
    """A picture's symbols with back-references and, where they save bits, cache hits: the bits
    they take, kind (0 literal, 1 back-reference, 2 cache hit), bits of the cache, green symbols,
    pixels, and the lengths' and distances' prefix symbols, extra bits and values."""
    n = len(px)
    start, length, distance = (np.array(x, np.int64) for x in zip(*runs, strict=True))
    covered = np.zeros(n + 1, np.int64)
    covered[start] += 1
    covered[start + length] -= 1
    single = covered[:-1].cumsum() == 0
    single[start] = True
    at = np.flatnonzero(single)
    kind = np.zeros(n, np.int64)
    kind[start] = 1
    kind, p, cache_bits = kind[at], px[at], 0
    code, extra, value = _prefixed(length)
    near = _near_codes(width)
    far = np.array([near.get(d, d + 120) for d in distance.tolist()], np.int64)
    far_code, far_extra, far_value = _prefixed(far)
    green = p >> 8 & 255
    green[kind == 1] = 256 + code
    colours, more = p[kind == 0], float(extra.sum() + far_extra.sum())
    cost = _cost(green, colours >> 16 & 255, colours & 255, far_code) + more
    if main and n >= 64:
        slot = (CACHE_MULTIPLIER * px & 0xFFFFFFFF) >> (32 - CACHE_BITS)
        order = np.argsort(slot, kind="stable")
        hit = np.zeros(n, bool)
        hit[order[1:]] = (px[order[1:]] == px[order[:-1]]) & (slot[order[1:]] == slot[order[:-1]])
        hit = hit[at] & (kind == 0)
        if hit.any():
            other, new = np.where(hit, 280 + slot[at], green), p[(kind == 0) & ~hit]
            cached = _cost(other, new >> 16 & 255, new & 255, far_code) + more
            if cached < cost:
                kind, cost, green, cache_bits = np.where(hit, 2, kind), cached, other, CACHE_BITS
    return cost, kind, cache_bits, green, p, code, extra, value, far_code, far_extra, far_value


def _put_image(out: Writer, pixels: np.ndarray, main: bool) -> None:
    """One entropy-coded image: literals, back-references and, where it pays, cache hits."""
    height, width = pixels.shape[:2]
    px = np.ascontiguousarray(pixels).reshape(-1, 4).view(">u4").ravel().astype(np.int64)
    n, runs = len(px), _repeats(px)
    literals = [px >> 8 & 255, px >> 16 & 255, px & 255]
    counts = np.bincount(np.concatenate(literals), minlength=256)
    kind, cache_bits = np.zeros(n, np.int64), 0  # of each symbol: 0 literal, 1 back-reference, 2 cache hit
    green, p, alike = literals[0], px, (0, 1, 2)  # literals under one code
    code = extra = value = far_code = far_extra = far_value = np.empty(0, np.int64)
    if runs:
        c = counts[counts > 0].astype(np.float64)
        simple = 3 * n * np.log2(3 * n) - float((c * np.log2(c)).sum()) + 3 * SYMBOL_BITS * len(c)
        coded = _with_runs(px, runs, width, main)
        if coded[0] <= (1 - LEAST_GAIN) * simple:
            _, kind, cache_bits, green, p, code, extra, value, far_code, far_extra, far_value = coded
            alike = (1, 2) if n < SHARED_BELOW else ()
    literal = kind == 0
    out.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        out.put(0, 1)  # one group of prefix codes
    colours = p[literal]
    streams = [green, colours >> 16 & 255, colours & 255, colours >> 24, far_code]
    codes: list[tuple] = []
    for k, stream in enumerate(streams):
        alphabet = ALPHABETS[k] + ((1 << cache_bits if cache_bits else 0) if k == 0 else 0)
        if k in alike[1:]:
            codes.append(codes[-1])
        else:
            if k == 0 and alike[:1] == (0,):
                tally = counts
            elif len(stream):
                tally = np.bincount(np.concatenate(streams[1:3]) if k in alike else stream, minlength=256)
            else:
                tally = np.eye(1, 256, dtype=int)[0]
            lengths = code_lengths(tally)
            several = np.count_nonzero(lengths) > 1
            codes.append((lengths, canonical(lengths).astype(np.int64) if several else lengths * 0, lengths.astype(np.int64) if several else lengths * 0))
        if k < 2 or k not in alike:
            bits = _code_bits(codes[k][0], alphabet)
        out.put(*bits)
    codes = [c[1:] for c in codes]
    if 0 in alike and not codes[3][1].any():
        stream = np.stack(literals[:3], 1).ravel()
        out.put_all(codes[0][0][stream], codes[0][1][stream])
        return
    # Up to four fields a symbol: green, red, blue, alpha, or the run's length, its extra bits,
    # the distance's symbol and its extra bits.
    field, size = np.zeros((len(p), 4), np.int64), np.zeros((len(p), 4), np.int64)
    field[:, 0], size[:, 0] = codes[0][0][green], codes[0][1][green]
    for k in (1, 2, 3):
        field[literal, k], size[literal, k] = codes[k][0][streams[k]], codes[k][1][streams[k]]
    run = kind == 1
    field[run, 1], size[run, 1] = value, extra
    field[run, 2], size[run, 2] = codes[4][0][far_code], codes[4][1][far_code]
    field[run, 3], size[run, 3] = far_value, far_extra
    out.put_all(field.ravel(), size.ravel())


def _put_constant(out: Writer, kind: int, values: tuple[int, int, int], height: int, width: int) -> None:
    """A predictor or cross-colour transform with one value (red, green, blue) for all blocks."""
    block = 9
    out.put(1 | kind << 1 | block - 2 << 3, 6)
    own = np.empty((-(-height >> block), -(-width >> block), 4), np.uint8)
    own[:] = [255, *values]
    _put_image(out, own, False)


def _residual(pixels: np.ndarray, mode: int) -> np.ndarray:
    """What is left of each pixel beside its left (1) or upper (2) neighbour."""
    out = pixels.copy()
    if mode == 1:
        out[:, 1:] -= pixels[:, :-1]
        out[1:, 0] -= pixels[:-1, 0]
    else:
        out[1:] -= pixels[:-1]
        out[0, 1:] -= pixels[0, :-1]
    out[0, 0, 0] = (int(out[0, 0, 0]) - 255) & 255
    return out


def _palette(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    flat = np.ascontiguousarray(pixels).reshape(-1, 4).view(">u4").ravel().astype(np.int64)
    if len(flat) > 1024 and len(np.unique(flat[:1024])) > 256:
        return None
    colours, index = np.unique(flat, return_inverse=True)
    if len(colours) > 256:
        return None
    return colours, index.reshape(pixels.shape[:2])


def _factor(to: np.ndarray, by: np.ndarray) -> int:
    """The cross-colour factor (of 32) that takes most of `by` out of `to`."""
    x, y = by.view(np.int8).ravel().astype(np.float64), to.view(np.int8).ravel().astype(np.float64)
    x -= x.mean()
    spread = float(x @ x)
    return int(min(127, max(-128, round(32 * float(x @ y) / spread)))) if spread else 0


def _smooth(rgb: np.ndarray) -> bool:
    """Whether neighbours, or a pixel's colours, tell something of each other: whether their
    differences vary clearly less than the colours do."""
    x = rgb.astype(np.float32)
    least = x.var() * SMOOTHER
    sides = (x[:, 1:] - x[:, :-1], x[1:] - x[:-1], x[:, :, :2] - x[:, :, 1:])
    return any(d.size and float(np.vdot(d, d)) / d.size < least for d in sides)


def encode(rgb: np.ndarray) -> bytes:
    """A lossless WebP file of uint8 (height, width, 3) pixels."""
    height, width = rgb.shape[:2]
    pixels = np.empty((height, width, 4), np.uint8)
    pixels[:, :, 0], pixels[:, :, 1:] = 255, rgb
    out = Writer()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 1 + 3)  # no alpha, version
    found, smooth = _palette(pixels), _smooth(rgb)
    best = _colour_cost(pixels) if found is not None or smooth else 0.0
    if found is not None:
        colours, index = found
        table = np.ascontiguousarray(colours.astype(">u4")).view(np.uint8).reshape(1, -1, 4)
        table[:, 1:] -= table[:, :-1].copy()
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        # Without a repeat a colour costs its table entry; with many, one index.
        if len(colours) > 1 and _cost(index.ravel()) + _colour_cost(table) + TRANSFORM_BITS < (1 - LEAST_GAIN) * best:
            out.put(1 | 3 << 1 | len(colours) - 1 << 3, 11)
            _put_image(out, table, False)
            each, group = 8 >> pack, 1 << pack
            packed = np.zeros((height, -(-width // group)), np.int64)
            for k in range(group):
                part = index[:, k::group]
                packed[:, : part.shape[1]] |= part << k * each
            pixels = np.zeros((*packed.shape, 4), np.uint8)
            pixels[:, :, 0], pixels[:, :, 2] = 255, packed
            best = 0.0
    if best > 4 * TRANSFORM_BITS and smooth:
        left, upper = _residual(pixels, 1), _residual(pixels, 2)
        costs = [best, _colour_cost(left) + TRANSFORM_BITS, _colour_cost(upper) + TRANSFORM_BITS]
        mode = int(np.argmin(costs))
        if costs[mode] < (1 - LEAST_GAIN) * best:
            _put_constant(out, 0, (0, mode, 0), height, width)
            best, pixels = costs[mode], (left, upper)[mode - 1]
        red, green, blue = (np.ascontiguousarray(pixels[:, :, k]) for k in (1, 2, 3))
        by_red, by_blue = _factor(red, green), _factor(blue, green)
        if max(abs(by_red), abs(by_blue)) >= LEAST_FACTOR:
            signed, less, plain = green.view(np.int8).astype(np.int64), pixels.copy(), pixels.copy()
            less[:, :, 1] -= (by_red * signed >> 5).astype(np.uint8)
            less[:, :, 3] -= (by_blue * signed >> 5).astype(np.uint8)
            plain[:, :, 1] -= green
            plain[:, :, 3] -= green
            crossed, plainly = _colour_cost(less) + TRANSFORM_BITS, _colour_cost(plain)
            if min(crossed, plainly) < (1 - LEAST_GAIN) * best:
                if crossed < plainly:
                    _put_constant(out, 1, (0, by_blue & 255, by_red & 255), height, width)
                    pixels = less
                else:
                    out.put(1 | 2 << 1, 3)
                    pixels = plain
    out.put(0, 1)  # no more transforms
    _put_image(out, pixels, True)
    chunk = bytes([SIGNATURE]) + out.bytes()
    padded = chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + padded

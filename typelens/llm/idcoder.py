"""Adaptive context-mixing range coder for token ids below 65,536; many blocks are coded side by side.

The probability of an id is a mixture of three predictions: the id that followed the last two ids before (order 2), the id
that followed the last one (order 1), and the frequencies of ids (order 0).  The weights of the mixture are adaptive:
one set for each pair of confidences (0 to 3) of the order-2 and order-1 predictions, moved after every id towards the
order that was right.  The order-0 frequencies are two factors: the ids are sorted into 8 bands of about equal weight by
their frequency in all blocks coded together (the ``Prior``, which is stored with them); the weights of the bands, given the band
of the last id, adapt inside a block; inside its band an id has its frequency of the prior.  All of an id goes through the
range coder, no bit is stored as it is.

A block starts from a reset model, the prior, and decodes without any other block.  All arithmetic is on integers, so that
it does so alike on every machine.  numpy does one step for all blocks at once: the state of block k is row k of each array.
"""

from __future__ import annotations

import zlib

import numpy as np

BITS = 12
ONE = 1 << BITS
S1, S2 = 128, 256
BANDS = 8
RATE, RATE0 = 4, 5
CONF = 1 << 16
#: Bits of the frequencies inside a band: of a band with few ids, of any other.
FEW, MANY = 12, 16
#: The range coder works on numbers of TOP bits and gives out words of 16 bits when the range is below 2**LEAST; the three steps of an id take 40 bits at most.
TOP, LEAST = 60, 44


def _fours(*rows: tuple[int, ...]) -> np.ndarray:
    """Rows of four 16-bit numbers as 64-bit ones, so that a row is gathered and scattered at once."""
    return np.array(rows, np.int16).view(np.int64).ravel()


#: Where the bounds of the three weights go when order 2, 1 or 0 was right: all but one in 4096 each for the others.
_TO = _fours((0, ONE - 2, ONE - 1, ONE), (0, 1, ONE - 1, ONE), (0, 1, 2, ONE))
#: Weights (of 16) of order 2 and order 1 that a block starts with, by 4 * order-2 confidence + order-1 confidence.
_W2 = [(0, 5, 9, 13)[c2] for c2 in range(4) for c1 in range(4)]
_W1 = [min(15 - w, (0, 4, 8, 11)[k % 4]) for k, w in enumerate(_W2)]
_START = _fours(*((0, (4 * a + 1) * ONE // 68, (4 * (a + b) + 2) * ONE // 68, ONE) for a, b in zip(_W2, _W1)))
#: Where the lower bounds of the bands go when a band was right, 16 bytes a row.
_TO_BAND = np.array([[j + (ONE - BANDS) * (j > s) for j in range(BANDS)] for s in range(BANDS)], np.int16).view(np.complex128).ravel()


class Prior:
    """Order-0 frequencies that the blocks of a group start from."""

    def __init__(self, counts: np.ndarray):
        """counts: 65,536 numbers below 65,536; an id with count 0 can't be coded."""
        self.counts = counts
        by = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        c = counts[by].astype(np.int64)
        total = max(int(c.sum()), 1)
        of = np.minimum((np.cumsum(c) - c // 2 - 1) * BANDS // total, BANDS - 1)
        self.band, self.start, self.width = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
        self.band[by] = of
        self.bits, self.base = np.full(BANDS, FEW, np.int64), np.zeros(BANDS, np.int64)
        slots, weight = [], np.zeros(BANDS)
        for k in range(BANDS):
            ids, own = by[of == k], c[of == k]
            weight[k] = own.sum()
            if len(ids) > 1 << FEW - 3:
                self.bits[k] = MANY
            room = 1 << int(self.bits[k])
            if len(ids):
                w = 1 + own * (room - len(ids)) // own.sum()
                w[0] += room - w.sum()  # the most frequent one
                self.start[ids], self.width[ids] = np.cumsum(w) - w, w
            self.base[k] = sum(map(len, slots))
            slots.append(np.repeat(ids, w).astype(np.uint16) if len(ids) else np.zeros(room, np.uint16))
        self.slot = np.concatenate(slots)
        share = 1 + np.floor(weight / max(weight.sum(), 1) * (ONE - BANDS)).astype(np.int64)
        share[int(np.argmax(share))] += ONE - share.sum()
        self.bounds = (np.cumsum(share) - share).astype(np.int16)

    @classmethod
    def of(cls, blocks: list[np.ndarray]) -> Prior:
        n = np.zeros(1 << 16, np.int64)
        for x in blocks:
            n += np.bincount(x, minlength=1 << 16)
        most = max(int(n.max()), 1)
        return cls(np.where(n > 0, np.maximum(n * min(65535, most) // most, 1), 0))

    def dump(self) -> bytes:
        at = np.flatnonzero(self.counts)
        return zlib.compress(np.concatenate([np.diff(at, prepend=0), self.counts[at]]).astype("<u2").tobytes(), 9)

    @classmethod
    def load(cls, data: bytes) -> Prior:
        gaps, n = np.frombuffer(zlib.decompress(data), "<u2").reshape(2, -1).astype(np.int64)
        counts = np.zeros(1 << 16, np.int64)
        counts[np.cumsum(gaps)] = n
        return cls(counts)


class Lanes:
    """Model state of n blocks."""

    def __init__(self, n: int, prior: Prior):
        self.n, self.prior = n, prior
        self.base1, self.base2, self.base16, self.base8, self.base4 = (np.arange(n) * k for k in (S1, S2, 16, BANDS, 4))
        self.t1, self.t2 = np.zeros(n * S1, np.int32), np.zeros(n * S2, np.int32)  # id + confidence * CONF
        self.weights = np.tile(_START, n)
        self.bands = np.tile(prior.bounds.view(np.complex128), n * BANDS)
        self.p1, self.p2 = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def shrink(self, live: int) -> None:
        """Forget the lanes behind ``live``; lanes are sorted by length, so they are the ones that have ended."""
        self.n = live
        for name in ("base1", "base2", "base16", "base8", "base4", "p1", "p2"):
            setattr(self, name, getattr(self, name)[:live])

    def predict(self) -> np.ndarray:
        """The predicted ids become g1 and g2; returns the bounds of the weights of orders 2, 1 and 0, one row each."""
        h = self.p1 * 40503
        at1, at2 = h >> 6, h + self.p2 * 24593
        at1 &= S1 - 1
        at1 += self.base1
        at2 >>= 5
        at2 &= S2 - 1
        at2 += self.base2
        self.at1, self.at2 = at1, at2
        self.e1, self.e2 = self.t1.take(at1), self.t2.take(at2)
        self.g1, self.g2 = self.e1 & CONF - 1, self.e2 & CONF - 1
        self.k = self.base16 + ((self.e2 >> 16 << 2) + (self.e1 >> 16))
        self.w = self.weights.take(self.k).view(np.int16)
        return self.w

    def decided(self, s: np.ndarray) -> None:
        """Move the weights towards the order that was right."""
        t = _TO.take(s).view(np.int16)
        t -= self.w
        t >>= RATE
        t += self.w
        self.weights[self.k] = t.view(np.int64)

    def bounds(self, who: np.ndarray) -> np.ndarray:
        """Lower bounds of the bands of some lanes, one row each."""
        self.at = self.base8.take(who) + self.prior.band.take(self.p1.take(who))
        self.d = self.bands.take(self.at).view(np.int16)
        return self.d

    def banded(self, k: np.ndarray) -> None:
        """Move the weights of the bands."""
        t = _TO_BAND.take(k).view(np.int16)
        t -= self.d
        t >>= RATE0
        t += self.d
        self.bands[self.at] = t.view(np.complex128)

    def seen(self, x: np.ndarray) -> None:
        """Put the ids (32-bit) into the tables and move the contexts on."""
        for table, at, e, g in ((self.t1, self.at1, self.e1, self.g1), (self.t2, self.at2, self.e2, self.g2)):
            # by products with 0 and 1, which numpy does faster than masks: right ones gain confidence up to 3, others lose it or go
            low, right = e < CONF, g == x
            new = x - e
            new += CONF
            new *= low > right
            new += e
            new -= CONF
            gain = (e < 3 * CONF).view(np.uint8) + np.uint8(1)
            gain *= right
            new += np.left_shift(gain, 16, dtype=np.int32)
            table[at] = new
        self.p2, self.p1 = self.p1, x.astype(np.int64)


def _band_span(d: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of the bands that stand in some cells of the bounds.

    Behind a row's last bound stands the first of a row, which always is 0, as is ONE in the bits that count.
    """
    start = d.take(cell)
    width = d.take(cell + 1, mode="wrap")
    width -= start
    width &= ONE - 1
    return start, width


def encode(blocks: list[np.ndarray], prior: Prior) -> list[bytes]:
    """The range-coded words of each block of ids."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    size = np.array([len(blocks[k]) for k in order])
    n, steps = len(blocks), int(size[0])
    ids = np.zeros((steps, n), np.uint16)
    for lane, k in enumerate(order):
        ids[: size[lane], lane] = blocks[k]
    m = Lanes(n, prior)
    low, rng = np.zeros(n, np.int64), np.full(n, 1 << TOP, np.int64)
    out, size_of = np.zeros((n, 3 * steps + 8), np.uint16), [0] * n
    flat, pos = out.ravel(), np.arange(n) * out.shape[1]

    def carry(lane):
        low[lane] &= (1 << TOP) - 1
        at = pos[lane] - 1
        while len(at):
            flat[at] += 1  # a word that overflows to 0 carries on
            at = at[flat[at] == 0] - 1

    live = n
    for t in range(steps):
        while size[live - 1] <= t:
            live -= 1
        if live < m.n:
            m.shrink(live)
            low, rng, pos = low[:live], rng[:live], pos[:live]
        x = ids[t, :live].astype(np.int32)
        w = m.predict()
        s = x != m.g2
        s = s.view(np.uint8) + (s & (x != m.g1))
        cell = m.base4 + s
        start, end = w.take(cell), w.take(cell + 1)
        end -= start
        r = rng >> BITS
        low += r * start
        rng[:] = r * end
        m.decided(s)
        who = (s == 2).nonzero()[0]
        if len(who):
            y = x.take(who)
            k, d = prior.band.take(y), m.bounds(who)
            start, width = _band_span(d, np.arange(0, d.size, BANDS) + k)
            m.banded(k)
            r = rng.take(who) >> BITS
            add = r * start
            r *= width
            r >>= prior.bits.take(k)
            add += r * prior.start.take(y)
            low[who] += add
            rng[who] = r * prior.width.take(y)
        m.seen(x)
        over = (low >> TOP).nonzero()[0]
        if len(over):
            carry(over)
        small = (rng < 1 << LEAST).nonzero()[0]
        while len(small):
            v, at = low[small], pos[small]
            flat[at] = v >> LEAST
            low[small] = (v & (1 << LEAST) - 1) << 16
            pos[small] = at + 1
            r = rng[small] << 16
            rng[small] = r
            small = small[r < 1 << LEAST]
        if t + 1 == steps or size[live - 1] == t + 1:  # one word more tells a block that ends from all others
            ends = np.flatnonzero(size[:live] == t + 1)
            low[ends] += (1 << LEAST) - 1
            carry(ends[low[ends] >> TOP > 0])
            flat[pos[ends]] = low[ends] >> LEAST
            pos[ends] += 1
            for lane, end in zip(ends.tolist(), pos[ends].tolist()):
                size_of[order[lane]] = end - lane * out.shape[1]
    return [out[lane, : size_of[k]].astype("<u2").tobytes() for k, lane in sorted((k, lane) for lane, k in enumerate(order))]


def decode(coded: list[bytes], sizes: list[int], prior: Prior) -> list[np.ndarray]:
    """The ids of the blocks."""
    if not coded:
        return []
    order = sorted(range(len(coded)), key=lambda k: -sizes[k])
    size = np.array([sizes[k] for k in order])
    n, steps = len(order), int(size[0])
    words = np.zeros((n, max(len(x) for x in coded) // 2 + 8), np.uint16)
    for lane, k in enumerate(order):
        w = np.frombuffer(coded[k], "<u2")
        words[lane, : len(w)] = w
    m = Lanes(n, prior)
    a, b, c, d = (words[:, k].astype(np.int64) for k in range(4))
    code, rng = a << 44 | b << 28 | c << 12 | d >> 4, np.full(n, 1 << TOP, np.int64)
    following = (words[:, 3:-1] << 12 | words[:, 4:] >> 4).ravel()  # 16 bits each behind the first 60
    pos = np.arange(n) * (words.shape[1] - 4)
    ids = np.zeros((steps, n), np.uint16)
    live = n
    for t in range(steps):
        while size[live - 1] <= t:
            live -= 1
        if live < m.n:
            m.shrink(live)
            code, rng, pos = code[:live], rng[:live], pos[:live]
        w = m.predict()
        r = rng >> BITS
        v = code // r
        s = (v >= w[1::4]).view(np.uint8) + (v >= w[2::4])
        cell = m.base4 + s
        start, end = w.take(cell), w.take(cell + 1)
        end -= start
        code -= r * start
        rng[:] = r * end
        m.decided(s)
        x = m.g2 - m.g1
        x *= s == 0
        x += m.g1
        who = (s == 2).nonzero()[0]
        if len(who):
            d = m.bounds(who)
            c, r = code.take(who), rng.take(who) >> BITS
            v = c // r
            cell = np.arange(0, d.size, BANDS)
            for step in (4, 2, 1):  # the last bound that is not over v
                cell += (d.take(cell + step) <= v) * step
            k = cell & BANDS - 1
            start, width = _band_span(d, cell)
            m.banded(k)
            c -= r * start
            r *= width
            r >>= prior.bits.take(k)
            v = c // r
            y = prior.slot.take(prior.base.take(k) + v, mode="clip").astype(np.int64)
            code[who] = c - r * prior.start.take(y)
            rng[who] = r * prior.width.take(y)
            x[who] = y
        ids[t, :live] = x
        m.seen(x)
        small = (rng < 1 << LEAST).nonzero()[0]
        while len(small):
            at = pos[small]
            code[small] = code[small] << 16 | following.take(at, mode="clip")
            pos[small] = at + 1
            r = rng[small] << 16
            rng[small] = r
            small = small[r < 1 << LEAST]
    result: list = [None] * n
    for lane, k in enumerate(order):
        result[k] = ids[: size[lane], lane].copy()
    return result

"""Adaptive context-mixing range coder for token ids, with predictions of order 0 to 2.

A block of ids is laid out in lanes of equal length, which are coded side by side: step t codes the id t of every
lane, so the arithmetic runs on whole arrays.  The model mixes the distributions of three orders: order 2 and order 1
count, for each context (the two ids before, checked by a tag; the one before), the followers, and keep the two
leading ones; order 0 counts all ids.  Mixing weights are learned for each class of contexts: how large the leaders' shares
are, whether there is a second one, and whether the orders agree.  They are adapted at every ``PACE`` steps, the counts at
the steps of ``LEARN``, from what all lanes have coded up to there; the decoder makes the same changes at the same
steps.  All of it is integer arithmetic, and no result depends on the order in which lanes are looked at.

Every block starts from an empty model and carries checksums, so blocks decode alone.  Ids are 32-bit; those of a block
with large ids are numbered densely first.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STEPS = 8192, 256
BLOCK = LANES * STEPS
WEIGHT, CONTEXTS = 8, 18
LOW, DIGIT = 32, 16
#: Largest id that is coded as it stands, and levels of a leader's share.
DENSE, LEVELS = 1 << 18, 6
HEAD = struct.Struct("<4sIIIIIII")
MAGIC = b"SLB2"
I = np.int64
#: The steps before which the counts of contexts and of ids are brought up to date; PACE: that of the weights;
#: RECENT: steps whose ids a context's followers are taken from.
LEARN = sorted({1, 2, 3, 4, 6, 8, 12, 24, *range(16, STEPS, 16)})
COUNT = {1, 2, 4, 8, 16, 32, 64, 96, 128, 160, 192, 224}
PACE, RECENT = 4, 4
#: Packed fields: the level has 8 bits, names of ids (below 2^22) 24 each, counts 16 (a block has fewer steps).
FIRST, SECOND, NAME, COUNTS = 8, 32, (1 << 24) - 1, (1 << 16) - 1


class Followers:
    """The two leading followers of each context with their counts, and how often the context came.

    ``lead`` packs the leaders, each plus one (0: none), and the level of the context; ``tally`` packs the three counts.
    """

    def __init__(self, size: int, tagged: bool) -> None:
        self.lead, self.tally = np.zeros(size, I), np.zeros(size, I)
        self.tag = np.full(size, -1, np.int32) if tagged else None
        self.last = np.full(size, -1, np.int32)

    def learn(self, at: np.ndarray, x: np.ndarray, tag: np.ndarray | None, first: int) -> None:
        """Take in followers x of contexts: for each context, the last one of those given, ``first`` being the number of the first."""
        row = np.arange(first, first + len(at), dtype=np.int32)
        np.maximum.at(self.last, at, row)
        own = np.flatnonzero(self.last.take(at) == row)
        at, x = at.take(own), x.take(own) + 1
        lead, tally = self.lead.take(at), self.tally.take(at)
        if tag is not None:
            tag = tag.take(own)
            known = self.tag.take(at) == tag
            self.tag[at] = tag
            lead, tally = lead * known, tally * known
        a, b = lead >> SECOND & NAME, lead >> FIRST & NAME
        n_a, n_b, n = tally & COUNTS, tally >> 16 & COUNTS, (tally >> 32) + 1
        none, is_a, is_b = a == 0, a == x, b == x
        other = ~(none | is_a | is_b)
        a = np.where(none, x, a)
        b = np.where(other, x, b)
        n_a += is_a | none
        n_b = np.where(other, 1, n_b + is_b)
        swap = n_b > n_a
        a, b, n_a, n_b = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, n_b, n_a), np.where(swap, n_a, n_b)
        level = 2 + (4 * n_a > n) + (2 * n_a > n) + (4 * n_a > 3 * n)
        level = np.where(n == 1, 1, level) + LEVELS * (n_b > 0)
        self.lead[at] = a << SECOND | b << FIRST | level
        self.tally[at] = n_a | n_b << 16 | n << 32


class Model:
    """Counts, predictions and weights; ``size`` is one more than the largest id.  Only a decoder looks shares of the range up."""

    def __init__(self, size: int, decodes: bool) -> None:
        self.size, self.decodes = size, decodes
        #: Bits of the order-0 distribution: every id has a part of it.
        self.order0 = max(20, size.bit_length() + 1)
        self.total = self.order0 + WEIGHT
        self.counts = np.zeros(size, I)
        self.one, self.two = Followers(size + 1, False), Followers(1 << CONTEXTS, True)
        #: Events by class: the leaders of order 2, those of order 1, or none of them.
        self.events = np.full((2 * LEVELS * 2 * LEVELS * 2, 5), 1, I)
        levels = np.arange(len(self.events)) // 2
        of2, of1 = levels // (2 * LEVELS), levels % (2 * LEVELS)
        self.there = np.stack([of2 > 0, of2 >= LEVELS, of1 > 0, of1 >= LEVELS], 1)
        self.events[:, :4][~self.there] = 0
        self.learned = 0
        self.count()
        self.weigh()

    def count(self) -> None:
        """The order-0 distribution from the counts."""
        spare, every = (1 << self.order0) - self.size, int(self.counts.sum())
        f = 1 + (self.counts * spare // every if every else np.full(self.size, spare // self.size, I))
        f[int(self.counts.argmax())] += (1 << self.order0) - int(f.sum())
        # where each id's part begins, and its width; the last entry stands for an id that a prediction has hit
        self.part = np.append((np.cumsum(f) - f) << 32 | f, 1)
        if self.decodes:
            self.symbol = np.repeat(np.arange(self.size, dtype=np.int32), f)

    def weigh(self) -> None:
        """Where each event of a class begins, and its width; that of the last one is to be multiplied by a part of order 0."""
        n = self.events.sum(axis=1, keepdims=True)
        w = np.where(self.there, np.maximum(1, self.events[:, :4] * ((1 << WEIGHT) - 5) // n), 0)
        upto = np.cumsum(w, axis=1)
        left = (1 << WEIGHT) - upto[:, 3:]
        if self.decodes:  # the event that each share of the range means
            self.event_of = np.repeat(np.tile(np.arange(5, dtype=np.int8), len(w)), np.concatenate([w, left], 1).ravel())
        self.begin = np.concatenate([np.zeros((len(w), 1), I), upto], 1).ravel() << self.order0
        self.width = np.concatenate([w << self.order0, left], 1).ravel()

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The four predictions (-1: none) and the class, for the ids two before and one before."""
        at, tag = self._context(a, b)
        of2, of1 = self.two.lead.take(at) * (self.two.tag.take(at) == tag), self.one.lead.take(b)
        p = [(of2 >> SECOND) - 1, (of2 >> FIRST & NAME) - 1, (of1 >> SECOND) - 1, (of1 >> FIRST & NAME) - 1]
        return p, ((of2 & 255) * (2 * LEVELS) + (of1 & 255)) * 2 + (p[0] == p[2])

    @staticmethod
    def _context(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (x >> np.uint64(64 - CONTEXTS)).view(I), ((x >> np.uint64(15)) & np.uint64(0x7FFFFFFF)).astype(np.int32)

    def adapt(self, code: np.ndarray) -> None:
        self.events += np.bincount(code, minlength=self.events.size).reshape(self.events.shape)

    def learn(self, x: np.ndarray, t0: int, t1: int) -> None:
        """Take in the ids of steps t0..t1 of (steps, lanes) ids; followers those of the last ``RECENT`` steps, which win anyway."""
        self.counts += np.bincount(x[t0:t1].ravel(), minlength=self.size)
        if t1 in COUNT:
            self.count()
        t0 = max(t0, t1 - RECENT)
        a, b = _contexts(x, self.size, t0, t1)
        at, tag = self._context(a, b)
        flat = x[t0:t1].ravel()
        self.one.learn(b, flat, None, self.learned)
        self.two.learn(at, flat, tag, self.learned)
        self.learned += len(flat)


def _layout(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, -(-n // STEPS)))
    return lanes, -(-n // lanes)


def _spans(steps: int) -> list[tuple[int, int]]:
    cuts = [0, *[t for t in LEARN if t < steps], steps]
    return list(zip(cuts, cuts[1:], strict=False))


def _contexts(x: np.ndarray, size: int, t0: int, t1: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids two before and one before steps t0..t1 of (steps, lanes) ids; ``size`` stands for none."""
    none = np.full((max(0, 2 - t0), x.shape[1]), size, I)
    padded = np.concatenate([none, x[max(0, t0 - 2) : t1]])
    return padded[: t1 - t0].ravel(), padded[1 : t1 - t0 + 1].ravel()


def encode_block(ids: np.ndarray) -> bytes:
    n = len(ids)
    lanes, steps = _layout(n)
    names = np.empty(0, np.uint32)
    x = np.zeros(lanes * steps, I)
    if int(ids.max()) < DENSE:
        x[:n] = ids
        size = int(ids.max()) + 1
    else:
        names, x[:n] = np.unique(ids, return_inverse=True)
        size = len(names)
    x = np.ascontiguousarray(x.reshape(lanes, steps).T)
    model = Model(size, False)
    out = np.zeros((2 * steps + 8, lanes), I)
    at, low, span = np.zeros(lanes, I), np.zeros(lanes, I), np.full(lanes, 1 << (LOW + DIGIT), I)
    rest, none = (1 << LOW) - 1, np.full(lanes, size, I)
    for t0, t1 in _spans(steps):
        for t in range(t0, t1):
            if t % PACE == 0:
                model.weigh()
            now = x[t]
            p, k = model.look(x[t - 2] if t > 1 else none, x[t - 1] if t else none)
            event = np.full(lanes, 4, I)
            for j in (3, 2, 1, 0):  # the first prediction that hits counts
                event = np.where(p[j] == now, j, event)
            code = k * 5 + event
            part = model.part.take(np.where(event == 4, now, size))
            w = model.width.take(code)
            r = span >> model.total
            low += r * (model.begin.take(code) + (part >> 32) * w)
            span = r * ((part & 0xFFFFFFFF) * w)
            small = np.flatnonzero(span <= 1 << LOW)
            while len(small):
                out[at[small], small] = low[small] >> LOW
                at[small] += 1
                low[small] = (low[small] & rest) << DIGIT
                span[small] <<= DIGIT
                small = small[span[small] <= 1 << LOW]
            model.adapt(code)
        if t1 < steps:
            model.learn(x, t0, t1)
    every = np.arange(lanes)
    for _ in range(3):
        out[at, every] = low >> LOW
        at += 1
        low = (low & rest) << DIGIT
    out = out[: int(at.max())]
    for j in range(len(out) - 1, 0, -1):  # carries
        out[j - 1] += out[j] >> DIGIT
    out = (out & ((1 << DIGIT) - 1)).T
    body = at.astype("<u2").tobytes() + out[np.arange(out.shape[1]) < at[:, None]].astype("<u2").tobytes()
    named = zlib.compress(np.diff(names, prepend=np.uint32(0)).astype("<u4").tobytes()) if len(names) else b""
    body = named + body
    return HEAD.pack(MAGIC, n, lanes, size, len(named), len(body), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def decode_block(data: memoryview, start: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at ``start``, and where the next one begins."""
    magic, n, lanes, size, n_named, length, crc, ids_crc = HEAD.unpack_from(data, start)
    start += HEAD.size
    body = data[start : start + length]
    if magic != MAGIC or len(body) != length or zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    names = np.cumsum(np.frombuffer(zlib.decompress(body[:n_named]), "<u4"), dtype=np.uint32) if n_named else None
    body = body[n_named:]
    steps = -(-n // lanes)
    counts = np.frombuffer(body, "<u2", lanes).astype(I)
    digits = np.concatenate([np.frombuffer(body, "<u2", offset=2 * lanes).astype(I), np.zeros(8, I)])
    at = np.cumsum(counts) - counts
    code = digits[at] << 32 | digits[at + 1] << 16 | digits[at + 2]
    at += 3
    model, x, span = Model(size, True), np.zeros((steps, lanes), I), np.full(lanes, 1 << (LOW + DIGIT), I)
    a, b = np.full(lanes, size, I), np.full(lanes, size, I)
    for t0, t1 in _spans(steps):
        for t in range(t0, t1):
            if t % PACE == 0:
                model.weigh()
            p, k = model.look(a, b)
            r = span >> model.total
            # exact: the quotient's fraction is a multiple of 1 / r, far above the rounding of a double
            v = np.minimum((code / r).astype(I), (1 << model.total) - 1)
            event = model.event_of.take((k << WEIGHT) + (v >> model.order0)).astype(I)
            plain = event == 4
            class_ = k * 5 + event
            begin, w = model.begin.take(class_), model.width.take(class_)
            new = model.symbol.take(np.where(plain, (v - begin) / w, 0).astype(I))
            part = model.part.take(np.where(plain, new, size))
            now = np.where(plain, new, np.where(event < 2, np.where(event == 0, p[0], p[1]), np.where(event == 2, p[2], p[3])))
            c = begin + (part >> 32) * w
            span = r * ((part & 0xFFFFFFFF) * w)
            code -= r * c
            small = np.flatnonzero(span <= 1 << LOW)
            while len(small):
                code[small] = code[small] << DIGIT | digits[at[small]]
                at[small] += 1
                span[small] <<= DIGIT
                small = small[span[small] <= 1 << LOW]
            model.adapt(class_)
            x[t] = now
            a, b = b, now
        if t1 < steps:
            model.learn(x, t0, t1)
    ids = np.ascontiguousarray(x.T).ravel()[:n]
    ids = (names[ids] if names is not None else ids).astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("damaged ids")
    return ids, start + length

"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks of BLOCK that are coded on their own: a block's model starts empty, its coded
bytes carry a checksum of its ids, and it can be decoded alone.  Within a block, ids are known by their
numbers in the order in which they first come.  Three predictions are mixed for each id.  Order 2 and
order 1 put their weight on the id that last followed the two ids, or the one id, before it; a weight is
how often predictions of that confidence came true so far in the block.  Order 0 spreads the remaining
weight over the block's ids by their counts and leaves a share, learned in the block, for an id that it
hasn't had.  Where predictions agree their weights add up, and one range-coder step codes the id with its
mixed share.  The ids themselves follow in the order of their numbers, by a fixed prior that falls with
the id.

A block is read in PARTS parts beside each other, which learn from one another.  Many blocks advance
together, one id of each part at a time, as numpy vectors in which the parts of a block stand side by side,
since they read the same tables.

Order 0 takes up the counts from time to time, when a block has grown by a quarter; ids that are new
since then count once.  So its shares are read from a table with a place for each id of the block so far.

File: header (magic, numbers of documents, ids and blocks), document table, block table (bytes and
checksum of each), coded blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 4096
#: Parts of a block that are coded beside each other (8, as their flags are summed in a 64-bit word), and the ids of each.
PARTS = 8
STEPS = BLOCK // PARTS
#: Blocks that advance together, at most.
GROUP = 1024
#: Ids are under this; the value itself stands for none.
NONE = 65535
MAGIC = b"TWID3\0"
_TOTAL, _NEW = 24, 17  # bits of the range's shares, for numbers and for ids
_TOTAL_BITS, _NEW_BITS = np.uint64(_TOTAL), np.uint64(_NEW)
_SMALL, _U32 = np.uint64(1 << 32), np.uint64(32)
#: Entries of each lane's tables; not a power of two, as lanes would then meet in the processor's cache.
_MASK, _STRIDE, _WIDE = 4095, 4128, 4136
#: The highest weight of a prediction, and of an id that is new.  Every unit of order 0 keeps a share.
_SURE, _NEWEST = 53000, 61440
#: How right predictions of each confidence are at first, and how a confidence moves when one fails or comes true.
_START = np.append(64, 8192 + 2900 * np.arange(1, 16)).astype(np.uint16)
_WRONG = 64
#: A multiple by this has in byte k the sum of bytes 0 to k.
_WORD, _SUMS = np.dtype("<u8"), np.uint64(0x0101010101010101)


def _prior() -> np.ndarray:
    """Where each id's prior share begins, with the end after the last: 1 each, and as much again by 1 / (id + 256)."""
    falling = 1_000_000_000 // (np.arange(1 << 16, dtype=np.int64) + 256)
    share = 1 + (falling << 16) // falling.sum()
    share[0] += (1 << _NEW) - share.sum()
    return np.append(0, np.cumsum(share)).astype(np.uint32)


_PRIOR = _prior()
_PRIOR_ID = np.repeat(np.arange(1 << 16), np.diff(_PRIOR)).astype(np.uint16)


def _refreshes() -> list[int]:
    """The steps at which order 0 takes up the counts: dense at first, then at a quarter more each."""
    steps = [2]
    while steps[-1] < STEPS:
        steps.append(min(STEPS, steps[-1] + max(2, steps[-1] // 4)))
    return steps


_REFRESHES = _refreshes()


def _mask(where: np.ndarray, kind: type) -> np.ndarray:
    """All bits where it holds, none elsewhere."""
    return np.negative(where.astype(kind))


def _either(mask: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`x` where the mask has all bits, `y` where it has none."""
    out = x ^ y
    out &= mask
    out ^= y
    return out


def _upto(flags: np.ndarray) -> np.ndarray:
    """How many flags each block has up to each of its PARTS lanes, its own included."""
    return (flags.view(_WORD) * _SUMS).astype(_WORD, copy=False).view(np.uint8)


class _Model:
    """What each part of each block reads next, in numbers of ids.

    A block's ids are numbered as they come, 0 for its first; parts that have the same new id in one step
    number it twice.  Parts share what their block has learned; how far to trust it is learned in each part.
    """

    def __init__(self, blocks: int, reads: bool):
        """reads: numbers are looked up by their units."""
        n = PARTS * blocks
        self.reads = reads
        self.blocks = blocks
        self.kinds = np.zeros(n, dtype=np.uint16)  # numbers given so far, for each part of a block the same
        self.taken = np.ones(n, dtype=np.int32)  # units of order 0, and one, besides one for each number given
        self.count = np.zeros((blocks, _WIDE), dtype=np.uint16)
        # a number's first unit of order 0, shifted by 16, and how many it has; and the number that has each unit
        self.has, self.slot = np.zeros((blocks, _WIDE), dtype=np.uint32), np.zeros((blocks if reads else 0, _WIDE), dtype=np.uint16)
        self.count_flat, self.has_flat, self.slot_flat = self.count.ravel(), self.has.ravel(), self.slot.ravel()
        self.wide = np.repeat(np.arange(blocks, dtype=np.int64) * _WIDE, PARTS)
        # for orders 2 and 1: the number that is expected, shifted by 4, and how sure that is; 0: nothing is known
        self.table = np.zeros(2 * blocks * _STRIDE, dtype=np.uint16)
        self.base = np.repeat(np.arange(2 * blocks, dtype=np.int64) * _STRIDE, PARTS).reshape(2, n)
        self.right = np.tile(_START, 2 * n)
        self.base16 = np.arange(2 * n, dtype=np.int64).reshape(2, n) << 4
        self.new = np.full(n, 60000, dtype=np.int32)  # share of ids that the block hasn't had, of 1 << 16
        self.last = np.zeros(n, dtype=np.uint16)
        self.mixed = np.zeros(n, dtype=np.uint16)  # hash of the number before the last
        self.at, self.room = np.empty((2, n), dtype=np.int64), np.empty((2, n), dtype=np.int64)
        self._fill(0, PARTS * _REFRESHES[0])

    def _fill(self, ids: int, to: int) -> None:
        """Numbers given after so many ids have a unit each; the one after them stands for a new id."""
        more = np.arange(to - ids + 1)
        if self.reads:
            self.slot[:, ids : to + 1] = self.kinds[::PARTS, None] + more
        self.has_flat[(self.wide + self.kinds)[::PARTS, None] + more] = (ids + more) << 16 | 1

    def refresh(self, columns: np.ndarray, before: int, step: int, to: int) -> None:
        """Order 0 takes up the numbers in the rows of `columns` from `before` to `step`; the next time is `to`."""
        ids, kinds = PARTS * step, int(self.kinds.max())
        np.add.at(self.count_flat, (columns[before:step] + self.wide).ravel(), np.uint16(1))
        count = self.count[:, :kinds].astype(np.uint32)
        self.has[:, :kinds] = (np.cumsum(count, axis=1, dtype=np.uint32) - count) << np.uint32(16) | count
        if self.reads:
            # each number in its first unit, and then in those up to the next one's
            slot = np.zeros((self.blocks, ids), dtype=np.uint16)
            given = np.arange(kinds) < self.kinds[::PARTS, None]
            row, number = np.nonzero(given)
            slot.ravel()[row * ids + (self.has[:, :kinds][given] >> 16)] = number
            np.maximum.accumulate(slot, axis=1, out=self.slot[:, :ids])
        self.taken[:] = ids + 1 - self.kinds.astype(np.int32)
        self._fill(ids, PARTS * to)

    def predict(self) -> None:
        """The numbers that orders 2 and 1 expect and the shares of 1 << _TOTAL: the first has those to `end2`, the second those to `end1`, and the others the rest in units of order 0."""
        at, base = self.at, self.base
        mixed = self.mixed
        mixed ^= self.last * np.uint16(40503)
        mixed >>= 2
        mixed &= _MASK
        np.add(mixed, base[0], out=at[0])
        np.add(self.last, base[1], out=at[1])
        self.state = state = self.table.take(at)
        self.guess = guess = state >> 4
        self.sure = state & 15
        self.p = self.base16 + self.sure
        self.have = have = self.right.take(self.p).astype(np.uint32)
        share2 = have[0] << _TOTAL - 16
        rest = (1 << _TOTAL) - share2
        share1 = rest >> 8
        share1 *= have[1]
        share1 >>= 8
        rest -= share1
        rest >>= 8
        rest *= 65536 - self.new.view(np.uint32)
        rest >>= 8
        self.units = units = self.kinds + self.taken
        # exact: both are far under 2 ** 53
        self.unit = unit = (rest / units).astype(np.int32).view(np.uint32)
        has = self.has_flat.take(np.add(guess, self.wide, out=self.room))
        self.begin = has >> 16
        has &= 0xFFFF
        differ = _mask(guess[0] != guess[1], np.uint32)
        has[1] &= differ
        self.own = has
        part = has * unit
        part[0] += share2
        part[0] += share1
        share1 &= differ
        part[0] -= share1
        part[1] += part[0]
        part[1] += share1
        self.end2, self.end1 = part

    def shares(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the numbers' mixed shares."""
        has = self.has_flat.take(np.minimum(numbers, self.kinds) + self.wide)
        at = has >> 16
        has &= 0xFFFF
        before = _mask(self.begin < at, np.uint32)
        before &= self.own
        at -= before[0]
        at -= before[1]
        at *= self.unit
        at += self.end1
        has *= self.unit
        has = _either(_mask(numbers >= self.kinds, np.uint32), np.uint32(1 << _TOTAL) - at, has)
        self.hit = self.guess == numbers
        hit2, hit1 = _mask(self.hit, np.uint32)
        at = _either(hit1, self.end2, at)
        at &= ~hit2
        return at, _either(hit2, self.end2, _either(hit1, self.end1 - self.end2, has))

    def find(self, code: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers in whose mixed shares the codes lie, with begin and size; a new id has its own number."""
        end2, end1 = self.end2 * span, self.end1 * span
        is2, is1 = code < end2, code < end1
        # the unit of order 0, by a quotient that is under the exact one by less than 1
        beyond, each = code - end1, span * self.unit
        at = beyond / each
        at *= 1 - 2.0**-50
        at = np.minimum(at, 1 << _TOTAL).astype(np.int64)  # damaged codes may lie beyond
        beyond -= at.view(np.uint64) * each
        at += beyond >= each
        at = at.astype(np.int32)
        unit, ends = self.unit.view(np.int32), self.end1.view(np.int32)
        (a, b), (of_a, of_b) = self.begin.view(np.int32), self.own.view(np.int32)
        last = self.units - np.int32(1)
        at = np.minimum(at, last - of_a - of_b)
        skip = of_a * (at + of_b * (b < a) >= a)
        skip += of_b * (at + of_a * (a < b) >= b)
        at += skip
        hit2, hit1 = _mask(is2, np.uint32), _mask(is1, np.uint32)
        at &= ~hit1.view(np.int32)  # others than orders 2 and 1 are looked up
        found = self.slot_flat.take(np.maximum(np.minimum(at, last), 0) + self.wide)
        has = self.has_flat.take(found + self.wide).view(np.int32)
        begin = has >> 16
        begin -= skip
        begin *= unit
        begin += ends
        has &= 0xFFFF
        has *= unit
        begin, has = begin.view(np.uint32), has.view(np.uint32)
        has = _either(_mask(found == self.kinds, np.uint32), np.uint32(1 << _TOTAL) - begin, has)
        number = _either(hit2.astype(np.uint16), self.guess[0], _either(hit1.astype(np.uint16), self.guess[1], found))
        first = _either(hit1, self.end2, begin)
        first &= ~hit2
        size = _either(hit2, self.end2, _either(hit1, self.end1 - self.end2, has))
        # new ids of one step are numbered by their parts
        self.fresh = fresh = number >= self.kinds
        number += (_upto(fresh) - fresh) * fresh
        self.hit = self.guess == number
        return number, first, size

    def update(self, numbers: np.ndarray, fresh: np.ndarray) -> None:
        """Learn what came, and which of it is new."""
        hit = self.hit
        have = self.have.view(np.int32)
        move = hit.astype(np.int32)
        move *= _SURE - _WRONG
        move += _WRONG
        move -= have
        move >>= 5
        move += have
        self.right[self.p] = move.astype(np.uint16)
        more = self.sure + 1
        failed = _either(_mask(self.sure < 2, np.uint16), numbers << 4 | 1, self.state - (more >> 1))
        more >>= 4
        more ^= 1
        more += self.state
        self.table[self.at] = _either(_mask(hit, np.uint16), more, failed)
        step = fresh.astype(np.int32)
        step *= _NEWEST
        step -= self.new
        step >>= 5
        step &= _mask(~(hit[0] | hit[1]), np.int32)
        self.new += step
        self.kinds.reshape(-1, PARTS)[:] += _upto(fresh)[PARTS - 1 :: PARTS, None]
        self.mixed = self.last * np.uint16(60493)
        self.last = numbers


class _Writer:
    """Range coder of each lane, with 64 bits of which 32 leave at once."""

    def __init__(self, lanes: int):
        self.low, self.span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        # an odd number of words, as lanes would else meet in the processor's cache
        self.out = np.zeros((lanes, STEPS + 65), dtype=np.uint32)
        self.flat, self.begin = self.out.ravel(), np.arange(lanes) * self.out.shape[1]
        self.at = self.begin.copy()

    def room(self, words: int) -> None:
        """There is place for so many words more of each lane."""
        width = self.out.shape[1]
        if (need := int((self.at - self.begin).max()) + words) > width:
            self.out = np.pad(self.out, ((0, 0), (0, (need + 64 | 1) - width)))
            self.flat, lanes = self.out.ravel(), self.begin // width
            self.at += lanes * (self.out.shape[1] - width)
            self.begin = lanes * self.out.shape[1]

    def _carry(self, lanes: np.ndarray) -> None:
        at = self.at[lanes] - 1
        while len(at):
            more = self.flat[at] + np.uint32(1)
            self.flat[at] = more
            at = at[more == 0] - 1

    def put(self, first: np.ndarray, size: np.ndarray, bits: np.uint64) -> None:
        """Code a share of 1 << bits in each of the first lanes."""
        n = len(first)
        low, span = self.low[:n], self.span[:n]
        span >>= bits
        move = first * span
        low += move
        over = np.flatnonzero(low < move)
        if len(over):
            self._carry(over)
        span *= size
        small = np.flatnonzero(span < _SMALL)
        if len(small):
            now = low[small]
            at = self.at[small]
            self.flat[at] = now >> _U32
            self.at[small] = at + 1
            low[small] = now << _U32
            span[small] <<= _U32

    def order(self, lanes: np.ndarray) -> None:
        self.low, self.span, self.begin, self.at = self.low[lanes], self.span[lanes], self.begin[lanes], self.at[lanes]

    def end(self) -> list[bytes]:
        """The words of each lane; what lies after them doesn't matter."""
        self.room(1)
        low = self.low + (_SMALL - np.uint64(1))
        self._carry(np.flatnonzero(low < self.low))
        self.flat[self.at] = low >> _U32
        data = self.flat.astype("<u4", copy=False).view(np.uint8).data
        return [bytes(data[4 * a : 4 * b + 4]) for a, b in zip(self.begin.tolist(), self.at.tolist(), strict=True)]


class _Reader:
    """What `_Writer` wrote."""

    def __init__(self, blocks: list[bytes]):
        lanes, width = len(blocks), max(map(len, blocks)) // 4 + 4
        words = np.zeros((lanes, width), dtype=np.uint32)
        for i, b in enumerate(blocks):
            words[i, : len(b) // 4] = np.frombuffer(b, dtype="<u4", count=len(b) // 4)
        self.words = words.ravel()
        self.code = words[:, 0].astype(np.uint64) << _U32 | words[:, 1]
        self.span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        self.at = np.arange(lanes) * width + 2
        self.last = np.arange(1, lanes + 1) * width - 1  # damaged bytes may run past the end

    def take(self, first: np.ndarray, size: np.ndarray) -> None:
        """Go on after a share has been found with a span that `shrink` gave."""
        n = len(first)
        code, span = self.code[:n], self.span[:n]
        code -= first * span
        span *= size
        small = np.flatnonzero(span < _SMALL)
        if len(small):
            at = self.at[small]
            code[small] = code[small] << _U32 | self.words.take(at)
            self.at[small] = np.minimum(at + 1, self.last[small])
            span[small] <<= _U32

    def shrink(self, n: int, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(code, span) of the first n lanes, the span in shares of 1 << bits."""
        self.span[:n] >>= bits
        return self.code[:n], self.span[:n]

    def order(self, lanes: np.ndarray) -> None:
        self.code, self.span, self.at, self.last = self.code[lanes], self.span[lanes], self.at[lanes], self.last[lanes]


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of whole blocks of ids, step by step, the parts of a block side by side; which of them are new)."""
    blocks = len(ids) // BLOCK
    numbers, fresh = np.zeros((blocks, BLOCK), dtype=np.uint16), np.zeros((blocks, BLOCK), dtype=bool)
    place, every = np.zeros(1 << 16, dtype=np.uint16), np.arange(BLOCK, dtype=np.uint16)
    step = every // PARTS * PARTS
    for block, own in enumerate(ids.reshape(blocks, PARTS, STEPS).transpose(0, 2, 1).reshape(blocks, BLOCK)):
        place[own[::-1]] = every[::-1]  # the first place is written last
        at = place.take(own)
        new = at >= step
        at = _either(_mask(new, np.uint16), every, at)
        numbers[block], fresh[block] = (np.cumsum(new, dtype=np.uint16) - np.uint16(1)).take(at), new
    return tuple(x.reshape(blocks, STEPS, PARTS).transpose(1, 0, 2).reshape(STEPS, PARTS * blocks) for x in (numbers, fresh))


def _order(fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts by falling number of new ids, how many have more than 0, 1, ... of them)."""
    n = np.count_nonzero(fresh, axis=0)
    order = np.argsort(-n, kind="stable")
    return order, np.searchsorted(-n[order], -np.arange(int(n.max())), side="left")


def _groups(blocks: int) -> list[tuple[int, int]]:
    """(first, after the last) block of each group; groups are of like sizes, since a small one takes almost as many steps."""
    groups = -(-blocks // GROUP)
    return [(blocks * k // groups, blocks * (k + 1) // groups) for k in range(groups)]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The ids in coded blocks of BLOCK, the last one perhaps shorter."""
    return [b for lo, hi in _groups(-(-len(ids) // BLOCK)) for b in _encode(ids[lo * BLOCK : hi * BLOCK])]


def _encode(ids: np.ndarray) -> list[bytes]:
    blocks = -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1], dtype=np.uint16)
    padded[: len(ids)] = ids
    columns, fresh = _numbered(padded)
    model, coder, before = _Model(blocks, reads=False), _Writer(PARTS * blocks), 0
    for step, to in zip([0, *_REFRESHES[:-1]], _REFRESHES, strict=True):
        if step:
            model.refresh(columns, before, step, to)
        coder.room(to - step)
        for numbers, new in zip(columns[step:to], fresh[step:to], strict=True):
            model.predict()
            coder.put(*model.shares(numbers), _TOTAL_BITS)
            model.update(numbers, new)
        before = step
    order, left = _order(fresh)
    coder.order(order)
    # the new ids of each part, in turn
    each = padded.reshape(-1, STEPS)[fresh.T]
    size = np.count_nonzero(fresh, axis=0)
    first = (np.cumsum(size) - size)[order]
    coder.room(len(left))
    for k, n in enumerate(left.tolist()):
        now = each[first[:n] + k].astype(np.int64)
        begin = _PRIOR.take(now)
        coder.put(begin, _PRIOR.take(now + 1) - begin, _NEW_BITS)
    streams = coder.end()
    of = np.argsort(order).reshape(blocks, PARTS).tolist()
    return [struct.pack(f"<{PARTS}H", *(len(streams[k]) // 4 for k in own)) + b"".join(streams[k] for k in own) for own in of]


def _streams(block: bytes) -> list[bytes]:
    """The coded parts of a block."""
    ends = 2 * PARTS + 4 * np.cumsum([0, *struct.unpack_from(f"<{PARTS}H", block)])
    return [block[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def decode_blocks(blocks: list[bytes], n: int) -> np.ndarray:
    """The n ids of some blocks; all are of BLOCK ids but for the last."""
    groups = [_decode(blocks[lo:hi], min(n, hi * BLOCK) - lo * BLOCK) for lo, hi in _groups(len(blocks))]
    return np.concatenate([np.zeros(0, dtype=np.uint16), *groups])


def _decode(blocks: list[bytes], n: int) -> np.ndarray:
    model, coder, before = _Model(len(blocks), reads=True), _Reader([s for block in blocks for s in _streams(block)]), 0
    columns, fresh = np.zeros((STEPS, PARTS * len(blocks)), dtype=np.uint16), np.zeros((STEPS, PARTS * len(blocks)), dtype=bool)
    for step, to in zip([0, *_REFRESHES[:-1]], _REFRESHES, strict=True):
        if step:
            model.refresh(columns, before, step, to)
        for now in range(step, to):
            model.predict()
            numbers, first, size = model.find(*coder.shrink(len(model.last), _TOTAL_BITS))
            coder.take(first, size)
            columns[now], fresh[now] = numbers, model.fresh
            model.update(numbers, model.fresh)
        before = step
    order, left = _order(fresh)
    coder.order(order)
    new = np.zeros((len(order), len(left)), dtype=np.uint16)
    for k, active in enumerate(left.tolist()):
        code, span = coder.shrink(active, _NEW_BITS)
        new[order[:active], k] = found = _PRIOR_ID.take(np.minimum(code // span, np.uint64((1 << _NEW) - 1)).view(np.int64))
        first = _PRIOR.take(found)
        coder.take(first, _PRIOR.take(found + np.int64(1)) - first)
    ids = np.zeros((STEPS, PARTS * len(blocks)), dtype=np.uint16)
    ids.T[fresh.T] = new[np.arange(len(left)) < np.count_nonzero(fresh, axis=0)[:, None]]
    by_number = np.zeros(len(blocks) * BLOCK, dtype=np.uint16)
    place = columns + np.repeat(np.arange(len(blocks)) * BLOCK, PARTS)
    by_number[place[fresh]] = ids[fresh]
    ids = by_number.take(place)
    ids = ids.T.ravel()
    if (ids[n:] != ids[n - 1]).any():
        raise ValueError("the last block is damaged")
    return ids[:n]


def _packed(x: np.ndarray, kind: str) -> bytes:
    data = zlib.compress(np.asarray(x).astype(kind).tobytes(), 1)
    return struct.pack("<I", len(data)) + data


def _unpacked(data: bytes, at: int, kind: str) -> tuple[np.ndarray, int]:
    (n,) = struct.unpack_from("<I", data, at)
    return np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + n]), dtype=kind), at + 4 + n


def checksum(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4"))


def encode_file(doc_ids: np.ndarray, null: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """doc_ids and null flags and numbers of ids of the documents; all their ids in a row."""
    if len(ids) and int(ids.max()) >= NONE:
        raise ValueError("ids must be under 65535")
    blocks = encode_blocks(ids)
    sums = [checksum(ids[k * BLOCK : (k + 1) * BLOCK]) for k in range(len(blocks))]
    head = MAGIC + struct.pack("<QQQ", len(doc_ids), len(ids), len(blocks))
    tables = [_packed(doc_ids, "<i8"), _packed(null, "u1"), _packed(sizes, "<u8"), _packed([len(b) for b in blocks], "<u4"), _packed(sums, "<u4")]
    return b"".join([head, *tables, *blocks])


def _read(data: bytes) -> tuple[list[np.ndarray], int, list[bytes]]:
    """(document ids, null flags, sizes, checksums), number of ids, coded blocks."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id file")
    _, n, _ = struct.unpack_from("<QQQ", data, len(MAGIC))
    at = len(MAGIC) + 24
    found = []
    for kind in ("<i8", "u1", "<u8", "<u4", "<u4"):
        x, at = _unpacked(data, at, kind)
        found.append(x)
    lengths = found.pop(3)
    ends = at + np.cumsum(np.append(0, lengths.astype(np.int64)))
    return found, n, [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _checked(ids: np.ndarray, sums: np.ndarray, first: int = 0) -> np.ndarray:
    for k, s in enumerate(sums.tolist()):
        if checksum(ids[k * BLOCK : (k + 1) * BLOCK]) != s:
            raise ValueError(f"block {first + k} is damaged")
    return ids


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What `encode_file` was given; raises ValueError where a block's checksum doesn't hold."""
    (doc_ids, null, sizes, sums), n, blocks = _read(data)
    return doc_ids, null.astype(bool), sizes.astype(np.int64), _checked(decode_blocks(blocks, n), sums)


def decode_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block, without the others."""
    (_, _, _, sums), n, blocks = _read(data)
    return _checked(decode_blocks([blocks[block]], min(BLOCK, n - block * BLOCK)), sums[block : block + 1], block)

"""Adaptive context-mixing range coder for token ids; the streams of a block are coded side by side with numpy.

Every block starts from the same empty state and can be decoded alone.  It is cut into streams of ``STREAM_IDS``
consecutive ids; a step codes one id of every stream, and all streams of a block share one model that learns from
every step.  For each id, the id that last followed the same two ids (order 2) and the one that last followed the same
id (order 1) are predicted.  How far to trust them depends on the cell, which is how often both predictions held last
and whether they agree: the records of both orders and of the cell are mixed in the logistic domain, with weights that
learn.  What the predictions leave of the probability is spread over all ids by their adaptive order-0 frequency.  The
range coder codes each id as one interval of that distribution.  All results are whole numbers, so that any machine
decodes what any other has written.
"""

from __future__ import annotations

import zlib
from decimal import Decimal
from functools import cache

import numpy as np

BLOCK_IDS = 1 << 20
STREAM_IDS = 256

_U = np.uint64
_BOTTOM, _UNIT = _U(1 << 32), _U(32)
_ORDER2_BITS = 18
#: Mixed chances are recomputed at every step up to this one, then at every eighth; frequencies ever more rarely.
_EAGER = 16
#: Seen cases above this are halved, so that records follow the text.
_FULL = 1 << 16
_CELL = np.arange(512)
_TRUST1, _TRUST2, _AGREE = _CELL & 15, _CELL >> 4 & 15, _CELL >> 8
#: What becomes of a trust of 0 (no guess) to 15, by ``trust + 16 * held``: it grows, or is halved.
_CHANGE = np.array([*((t >> 1) - t if t > 1 else 0 for t in range(16)), *(1 if t < 15 else 0 for t in range(16))], np.int32)


@cache
def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """stretch: 12-bit probability -> logit * 256; squash: its inverse for -2047 .. 2047.  Exact decimals, rounded."""
    squash = np.array([int(4096 / (1 + (-Decimal(x) / 256).exp())) for x in range(-2047, 2048)], np.int64).clip(1, 4095)
    stretch = np.searchsorted(squash, np.arange(4096), side="left") - 2047
    return stretch.clip(-2047, 2047), squash


class _Model:
    """The adaptive state of a block; encoder and decoder run the same steps on it."""

    def __init__(self, vocabulary: int) -> None:
        if vocabulary > 1 << 19:
            raise ValueError("the coder takes vocabularies of up to 524,288 ids")
        self.vocabulary, self.bits = vocabulary, min(vocabulary.bit_length() + 4, 20)
        # By context, the id + 1 that followed last and, in the low bits, its trust of 1 to 15; 0 is no guess.
        self.guess = [np.zeros(vocabulary + 1, np.int32), np.zeros(1 << _ORDER2_BITS, np.int32)]
        # Records (held, seen): order 1 and 2 by trust, order 2 by cell, order 1 by cell where order 2 did not hold.
        self.record = [np.tile(np.array(r, np.int64)[:, None], n) for r, n in (((1, 4), 16), ((2, 4), 16), ((0, 0), 512), ((0, 0), 512))]
        self.weight = np.array([16000, 24000, 40000], np.int64)
        self.seen = np.zeros(3 * 512, np.int64)
        self.new_ids: list[np.ndarray] = []
        self.counts = np.zeros(vocabulary, np.int64)
        self.next_mix = self.next_count = 0
        self.stretch, self.squash = _logistic()

    def refresh(self, step: int) -> bool:
        """Brings chances and frequencies up to date where that is due; True if frequencies changed."""
        if step >= self.next_mix:
            self.next_mix = step + (1 if step < _EAGER else 8)
            self._learn()
            self._mix()
        if step < self.next_count:
            return False
        self.next_count = step + max(1, step // 4)
        if self.new_ids:
            self.counts += np.bincount(np.concatenate(self.new_ids), minlength=self.vocabulary)
            self.new_ids = []
        spare, total = (1 << self.bits) - self.vocabulary, int(self.counts.sum())
        self.width = 1 + (self.counts * spare // total if total else np.full(self.vocabulary, spare // self.vocabulary))
        self.width[int(self.width.argmax())] += (1 << self.bits) - int(self.width.sum())
        self.start = np.cumsum(self.width) - self.width
        return True

    def _learn(self) -> None:
        two, one, lost = self.seen.reshape(3, 512)
        all_ = two + one + lost
        if not all_.any():
            return
        wrong = (two << 12) - all_ * self.chance
        wrong[_TRUST2 == 0] = 0
        n = int(all_.sum())
        self.weight += ((self.inputs @ wrong) * 6 * min(n, 16) // n + 0x8000) >> 16
        held1 = np.where(_AGREE == 1, two, one)
        for record, held, seen in ((self.record[0], np.bincount(_TRUST1, held1, 16), np.bincount(_TRUST1, all_, 16)), (self.record[1], np.bincount(_TRUST2, two, 16), np.bincount(_TRUST2, all_, 16)),
                                   (self.record[2], two, all_), (self.record[3], one, one + lost)):
            record += np.stack([held, seen]).astype(np.int64)
            record >>= (record[1] > _FULL).astype(np.int64)
        self.seen[:] = 0

    def _mix(self) -> None:
        """Shares of 4096 by cell for the order-2 guess, the order-1 guess and the rest, and where they start."""
        one, two = (((r[0] << 12) // r[1]).clip(1, 4095) for r in self.record[:2])
        by_cell = (((self.record[2][0] << 12) + 8 * two[_TRUST2]) // (self.record[2][1] + 8)).clip(1, 4095)
        self.inputs = np.stack([np.where(_AGREE == 1, self.stretch[one][_TRUST1], 0), self.stretch[two][_TRUST2], self.stretch[by_cell]])
        self.chance = np.minimum(self.squash[((self.weight @ self.inputs) >> 16).clip(-2047, 2047) + 2047], 4093)
        share_two = np.where(_TRUST2 > 0, self.chance, 0)
        rest = 4096 - share_two
        after = (((self.record[3][0] << 12) + 4 * one[_TRUST1]) // (self.record[3][1] + 8)).clip(1, 4095)
        share_one = np.where((_TRUST1 > 0) & (_AGREE == 0), np.minimum(np.maximum(rest * after >> 12, 1), rest - 1), 0)
        left = rest - share_one
        self.after_two, self.after_one, self.left = share_two, share_two + share_one, left
        scale = _U(self.bits)
        # By kind (order 2 held, order 1 held, neither) and cell.
        self.begin = np.concatenate([np.zeros(512, np.int64), share_two, share_two + share_one]).astype(_U) << scale
        self.size = np.concatenate([share_two, share_one, left]).astype(_U)
        self.size[: 2 * 512] <<= scale

    def slots(self, before: np.ndarray, two_before: np.ndarray) -> list[np.ndarray]:
        """Places of the contexts of both orders; the ids before are given as id + 1."""
        return [before, (before * 0x9E3779B1 + two_before * 0x85EBCA6B >> 11) & ((1 << _ORDER2_BITS) - 1)]

    def predict(self, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order-1 guess + 1, order-2 guess + 1, cell); 0 is no guess."""
        self.slot = slots
        self.entry = [self.guess[0].take(slots[0]), self.guess[1].take(slots[1])]
        self.trust = [self.entry[0] & 15, self.entry[1] & 15]
        first, second = self.entry[0] >> 4, self.entry[1] >> 4
        return first, second, self.trust[0] + (self.trust[1] << 4) + ((first == second).astype(np.int32) << 8)

    def update(self, next_: np.ndarray, held: tuple[np.ndarray, np.ndarray], case: np.ndarray) -> None:
        """Learns the ids (as id + 1); where streams share a context the last one's stands."""
        for guess, slot, entry, trust, right in zip(self.guess, self.slot, self.entry, self.trust, held):
            entry = entry + _CHANGE.take(trust + (right.astype(np.int32) << 4))
            np.copyto(entry, (next_ << 4) + 1, where=(trust <= 1) & ~right)
            guess[slot] = entry
        self.seen += np.bincount(case, minlength=3 * 512)
        self.new_ids.append(next_ - 1)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    streams = -(-len(ids) // STREAM_IDS)
    steps = min(STREAM_IDS, len(ids))
    short = len(ids) - STREAM_IDS * (streams - 1)
    grid = np.full(streams * STREAM_IDS, -1, np.int32)
    grid[: len(ids)] = ids
    # Two rows in front are the ids before the first ones, that is none.
    grid = np.concatenate([np.zeros((2, streams), np.int32), grid.reshape(streams, STREAM_IDS).T + 1])
    model = _Model(vocabulary)
    low, span = np.zeros(streams, _U), np.full(streams, ~_U(0), _U)
    out, pos = np.zeros((streams, steps + 1), "<u4"), np.zeros(streams, np.int64)
    shift = _U(12 + model.bits)

    def carry(lane: np.ndarray, at: np.ndarray) -> None:
        while len(lane):
            out[lane, at] += np.uint32(1)
            again = out[lane, at] == 0
            lane, at = lane[again], at[again] - 1

    for k in range(steps):
        n = streams if k < short else streams - 1
        if model.refresh(k):
            start0, width0 = model.start.astype(_U), model.width.astype(_U)
        next_ = grid[k + 2, :n]
        first, second, cell = model.predict(model.slots(grid[k + 1, :n].astype(np.int64), grid[k, :n].astype(np.int64)))
        is_two, is_one = second == next_, first == next_
        case = cell + np.where(is_two, np.int32(0), np.where(is_one, np.int32(512), np.int32(1024)))
        start, width = model.begin.take(case), model.size.take(case)
        lost = np.flatnonzero(case >= 1024)
        if len(lost):
            left, id_ = width[lost], next_[lost] - 1
            start[lost] += left * start0.take(id_)
            width[lost] = left * width0.take(id_)
        part = span[:n] >> shift
        moved = low[:n] + part * start
        over = np.flatnonzero(moved < low[:n])
        if len(over):
            carry(over, pos[over] - 1)
        low[:n] = moved
        np.multiply(part, width, out=span[:n])
        full = np.flatnonzero(span[:n] < _BOTTOM)
        if len(full):
            settled = low[full]
            out[full, pos[full]] = settled >> _UNIT
            pos[full] += 1
            low[full] = settled << _UNIT
            span[full] <<= _UNIT
        model.update(next_, (is_one, is_two), case)
    # One more unit is in every stream's interval, as it is at least a unit wide.
    last = low + (_BOTTOM - _U(1))
    over = np.flatnonzero(last < low)
    carry(over, pos[over] - 1)
    out[np.arange(streams), pos] = last >> _UNIT
    pos += 1
    return pos.astype("<u2").tobytes() + out[np.arange(steps + 1) < pos[:, None]].tobytes()


def _decode_block(n_ids: int, data: bytes, vocabulary: int) -> np.ndarray | None:
    """The ids; None if the lengths of the streams do not fit the data."""
    streams = -(-n_ids // STREAM_IDS)
    steps, short = min(STREAM_IDS, n_ids), n_ids - STREAM_IDS * (streams - 1)
    if len(data) < 2 * streams:
        return None
    pos = np.frombuffer(data[: 2 * streams], "<u2").astype(np.int64)
    if 2 * streams + 4 * int(pos.sum()) != len(data):
        return None
    # Behind the end are zeros: every step reads a unit at most.
    units = np.zeros((streams, max(int(pos.max()), steps + 2)), "<u4")
    units[np.arange(units.shape[1]) < pos[:, None]] = np.frombuffer(data[2 * streams :], "<u4")
    code = (units[:, 0].astype(_U) << _UNIT) | units[:, 1]
    span, at_unit = np.full(streams, ~_U(0), _U), np.full(streams, 2, np.int64)
    model = _Model(vocabulary)
    bits, shift, most = _U(model.bits), _U(12 + model.bits), _U((1 << 12 + model.bits) - 1)
    grid = np.zeros((steps + 2, streams), np.int32)
    for k in range(steps):
        n = streams if k < short else streams - 1
        if model.refresh(k):
            start0, width0 = model.start.astype(_U), model.width.astype(_U)
            by_place = np.repeat(np.arange(1, vocabulary + 1, dtype=np.int32), model.width)
        first, second, cell = model.predict(model.slots(grid[k + 1, :n].astype(np.int64), grid[k, :n].astype(np.int64)))
        part = span[:n] >> shift
        place = np.minimum(code[:n] // part, most)
        share = (place >> bits).astype(np.int64)
        case = cell + np.where(share < model.after_two.take(cell), np.int32(0), np.where(share < model.after_one.take(cell), np.int32(512), np.int32(1024)))
        next_ = np.where(case < 512, second, first)
        start, width = model.begin.take(case), model.size.take(case)
        lost = np.flatnonzero(case >= 1024)
        if len(lost):
            left = width[lost]
            found = by_place.take(((place[lost] - start[lost]) // left).astype(np.int64))
            next_[lost] = found
            start[lost] += left * start0.take(found - 1)
            width[lost] = left * width0.take(found - 1)
        code[:n] -= part * start
        np.multiply(part, width, out=span[:n])
        full = np.flatnonzero(span[:n] < _BOTTOM)
        if len(full):
            code[full] = (code[full] << _UNIT) | units[full, at_unit[full]]
            at_unit[full] += 1
            span[full] <<= _UNIT
        model.update(next_, (first == next_, second == next_), case)
        grid[k + 2, :n] = next_
    return (grid[2:].T - 1).reshape(-1)[:n_ids] if steps == STREAM_IDS else grid[2:, 0] - 1


def encode(ids: np.ndarray, vocabulary: int, block: int = BLOCK_IDS) -> list[tuple[int, int, bytes]]:
    """(number of ids, crc32 of the ids, bytes) of every block of ``block`` consecutive ids."""
    parts = [ids[k : k + block] for k in range(0, len(ids), block)]
    return [(len(part), _crc(part), _encode_block(part, vocabulary)) for part in parts]


def decode(blocks: list[tuple[int, int, bytes]], vocabulary: int) -> np.ndarray:
    """The ids of blocks, one after another; a block whose checksum differs raises."""
    parts = [np.zeros(0, np.int32)]
    for i, (count, crc, data) in enumerate(blocks):
        ids = _decode_block(count, data, vocabulary)
        if ids is None or _crc(ids) != crc:
            raise ValueError(f"block {i} is damaged: its checksum differs")
        parts.append(ids)
    return np.concatenate(parts)

"""Token shards compressed by a grammar: frequent id pairs become nonterminals, again and again.

A frame holds whole documents of a shard, about ``FRAME_TOKENS`` ids. Its ids are rewritten in
rounds: pairs of neighbours are counted, the frequent ones that cannot overlap each other get
a rule each, most frequent first, and all their occurrences are replaced from left to right;
the next round counts pairs of what is left. It ends when no pair occurs ``MIN_COUNT`` times, or
when a round shortens the sequence by less than ``MIN_GAIN`` (rarer pairs cost as much as they
save). With each rule its expansion length is stored, so an id range is decoded without the rest of the frame.

A frame is bytes: the magic, five counts, the document lengths, the rules (two symbols each)
with the number of rules of each round, the expansion lengths, the sequence; symbols take
three bytes. Ids are below FIRST_RULE. Frames travel as rows of a Parquet file, so Spark's
committer decides which attempt counts.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

FIRST_RULE = 1 << 17
FRAME_TOKENS = 1 << 20
#: A pair needs so many occurrences in a frame to get a rule.
MIN_COUNT = 8
#: Rounds end when one shortens the sequence by less than this share.
MIN_GAIN = 0.01
_MAGIC = b"PAIR"
_BITS = 20


def _frequent(keys: np.ndarray, min_count: int) -> np.ndarray:
    """The keys that occur at least ``min_count`` times, most frequent first."""
    ordered = np.sort(keys)
    edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
    counts = np.diff(edges)
    often = counts >= min_count
    found, counts = ordered[edges[:-1][often]], counts[often]
    return found[np.lexsort((found, -counts))]


class _Pairs:
    """Keys of neighbouring symbol codes: 32 bits while the codes fit into 16, else 64."""

    def __init__(self, codes: int):
        self.half = 16 if codes <= 1 << 16 else 32
        self.kind = np.uint32 if self.half == 16 else np.uint64
        self._odd = self.kind(0x9E3779B1 if self.half == 16 else 0x9E3779B97F4A7C15)

    def keys(self, seq: np.ndarray) -> np.ndarray:
        wide = seq.astype(self.kind)
        return wide[:-1] << self.kind(self.half) | wide[1:]

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return keys >> self.kind(self.half), keys & self.kind((1 << self.half) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self._odd) >> self.kind(2 * self.half - _BITS)


def _compatible(pairs: _Pairs, found: np.ndarray) -> np.ndarray:
    """Pairs of which no two can overlap: no symbol ends one and begins another."""
    lefts: set[int] = set()
    rights: set[int] = set()
    slots: set[int] = set()
    taken = []
    left, right = pairs.split(found)
    for key, a, b, slot in zip(found.tolist(), left.tolist(), right.tolist(), pairs.slots(found).tolist()):
        if a in rights or b in lefts or slot in slots or (a == b and (a in lefts or b in rights)):
            continue
        lefts.add(a)
        rights.add(b)
        slots.add(slot)
        taken.append(key)
    return np.array(taken, dtype=pairs.kind)


def compress(ids: np.ndarray, min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sequence, rules (n x 2) and rules per round of an id array."""
    # symbols are numbered densely: the ids that occur, then the rules
    terminals = np.flatnonzero(np.bincount(ids, minlength=1))
    code_of = np.zeros(terminals[-1] + 1 if len(terminals) else 1, dtype=np.uint32)
    code_of[terminals] = np.arange(len(terminals), dtype=np.uint32)
    seq, rules, rounds = code_of[ids], [], []
    table = np.full(1 << _BITS, -1, dtype=np.int32)
    while len(seq) > 1:
        pairs = _Pairs(len(terminals) + sum(rounds))
        keys = pairs.keys(seq)
        taken = _compatible(pairs, _frequent(keys, min_count))
        if not len(taken):
            break
        slots = pairs.slots(taken)
        table[slots] = np.arange(len(taken), dtype=np.int32)
        rule = table[pairs.slots(keys)]
        table[slots] = -1
        at = np.flatnonzero(rule >= 0)
        at = at[taken[rule[at]] == keys[at]]
        # only a pair of equal symbols overlaps itself: every other one of a run counts
        gap = np.concatenate(([True], np.diff(at) != 1))
        if not gap.all():
            run = np.flatnonzero(gap)
            at = at[(np.arange(len(at)) - run[np.cumsum(gap) - 1]) % 2 == 0]
        seq[at] = rule[at].astype(np.uint32) + np.uint32(len(terminals) + sum(rounds))
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(np.stack(pairs.split(taken), axis=1).astype(np.int64))
        rounds.append(len(taken))
        if len(at) < min_gain * len(seq):
            break
    symbol_of = np.concatenate((terminals, FIRST_RULE + np.arange(sum(rounds))))
    return symbol_of[seq], symbol_of[np.concatenate(rules)] if rules else np.empty((0, 2), dtype=np.int64), rounds


def _expand(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    sizes = lengths[symbols]
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[symbols] - ends + sizes, sizes)]


def _packed(symbols: np.ndarray) -> bytes:
    return np.ascontiguousarray(symbols.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(data: memoryview) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), dtype=np.uint8)
    out[:, :3] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3)
    return out.view("<u4").reshape(-1).astype(np.int64)


@dataclass
class Frame:
    """A decoded frame header; ids are expanded on demand."""

    doc_lengths: np.ndarray
    seq: np.ndarray
    rules: np.ndarray
    rounds: list[int]
    rule_lengths: np.ndarray

    def _reached(self, symbols: np.ndarray) -> np.ndarray:
        """Which rules the expansion of ``symbols`` uses; those of a round use earlier ones only."""
        needed = np.zeros(len(self.rules), dtype=bool)
        needed[symbols[symbols >= FIRST_RULE] - FIRST_RULE] = True
        stop = len(self.rules)
        for n in reversed(self.rounds):
            own = self.rules[stop - n : stop][needed[stop - n : stop]].reshape(-1)
            needed[own[own >= FIRST_RULE] - FIRST_RULE] = True
            stop -= n
        return needed

    def _tables(self, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The expansions of the rules needed, one after the other, and where each symbol's starts."""
        starts = np.zeros(FIRST_RULE + len(self.rules), np.int64)
        lengths = np.ones(len(starts), np.int64)
        starts[:FIRST_RULE], lengths[FIRST_RULE:] = np.arange(FIRST_RULE), self.rule_lengths
        flat = np.empty(FIRST_RULE + int(self.rule_lengths[needed].sum()), np.int64)
        flat[:FIRST_RULE] = starts[:FIRST_RULE]
        done, filled = 0, FIRST_RULE
        for n in self.rounds:
            own = done + np.flatnonzero(needed[done : done + n])
            sizes = self.rule_lengths[own]
            starts[FIRST_RULE + own] = filled + np.cumsum(sizes) - sizes
            stop = filled + int(sizes.sum())
            flat[filled:stop] = _expand(self.rules[own].reshape(-1), starts, lengths, flat)
            done, filled = done + n, stop
        return starts, flat

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop``; only the symbols that cover them, and their rules, are expanded."""
        lengths = np.ones(FIRST_RULE + len(self.rules), np.int64)
        lengths[FIRST_RULE:] = self.rule_lengths
        ends = np.cumsum(lengths[self.seq])
        total = int(ends[-1]) if len(ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.empty(0, dtype="<u4")
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        skipped = int(ends[first] - lengths[self.seq[first]])
        covering = self.seq[first : last + 1]
        starts, flat = self._tables(self._reached(covering))
        return _expand(covering, starts, lengths, flat)[start - skipped : stop - skipped].astype("<u4")

    def document(self, number: int) -> np.ndarray:
        before = int(self.doc_lengths[:number].sum())
        return self.ids(before, before + int(self.doc_lengths[number]))


def pack(ids: np.ndarray, doc_lengths: np.ndarray, min_count: int = MIN_COUNT) -> bytes:
    """The bytes of a frame."""
    seq, rules, rounds = compress(ids, min_count)
    lengths = np.ones(FIRST_RULE + len(rules), dtype=np.int64)
    done = FIRST_RULE
    for n in rounds:
        part = rules[done - FIRST_RULE : done - FIRST_RULE + n]
        lengths[done : done + n] = lengths[part[:, 0]] + lengths[part[:, 1]]
        done += n
    head = struct.pack("<4s4I", _MAGIC, len(doc_lengths), len(rules), len(rounds), len(seq))
    return b"".join((
        head, doc_lengths.astype("<u4").tobytes(), np.array(rounds, dtype="<u4").tobytes(),
        lengths[FIRST_RULE:].astype("<u4").tobytes(), _packed(rules.reshape(-1)), _packed(seq),
    ))


def unpack(data: bytes) -> Frame:
    magic, docs, rules, rounds, symbols = struct.unpack_from("<4s4I", data)
    if magic != _MAGIC:
        raise ValueError("not a frame")
    at, parts = 20, []
    for n in (docs, rounds, rules):
        parts.append(np.frombuffer(data, "<u4", n, at).astype(np.int64))
        at += 4 * n
    pairs = _unpacked(memoryview(data)[at : at + 6 * rules]).reshape(-1, 2)
    seq = _unpacked(memoryview(data)[at + 6 * rules : at + 6 * rules + 3 * symbols])
    return Frame(parts[0], seq, pairs, parts[1].tolist(), parts[2])

"""Byte-pair encoding by prefix dynamic programming: the token count of every prefix of a piece of text.

Encoding greedily by merge rank has one property this rests on: the encoding of a prefix is the encoding of a shorter
prefix followed by one token.  Which token is last is the longest vocabulary entry that ends there and stands next to
the shorter prefix's last token unchanged.  So one pass over the bytes fills a table (last token, count) for all
prefixes.  Vocabulary entries that end at a byte come from a suffix automaton over the vocabulary; whether two tokens
stand side by side is found by undoing their merges from the border outwards.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _PairTable:
    """Token pair -> merged token, for arrays of pairs; open addressing with linear steps."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        self.top = np.int64((1 << int(np.ceil(np.log2(4 * len(pairs) + 16)))) - 1)
        self.keys, self.values = np.full(self.top + 1, -1, np.int64), np.full(self.top + 1, -1, np.int32)
        self.longest = 0
        for (a, b), merged in pairs.items():
            key = (a << 20) | b
            slot, steps = self._slot(key), 0
            while self.keys[slot] >= 0:
                slot, steps = (slot + 1) & int(self.top), steps + 1
            self.keys[slot], self.values[slot] = key, merged
            self.longest = max(self.longest, steps)

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) >> 40) & int(self.top)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.top
        out = np.where(self.keys[slot] == key, self.values[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[slot] >= 0))
        for _ in range(self.longest):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.top
            found = self.keys[slot[open_]] == key[open_]
            out[open_[found]] = self.values[slot[open_[found]]]
            open_ = open_[~found & (self.keys[slot[open_]] >= 0)]
        return out


class BytePairs:
    """A byte-level BPE vocabulary: merges, the automaton of its entries, and the prefix tables."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        alphabet = _byte_alphabet()
        # Own numbers: bytes first, then merges by rank, so that a number is a rank.
        number: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        n = 256 + len(merges)
        self.left, self.right, self.length = np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.ones(n, np.int32)
        self.left[:256] = self.right[:256] = np.arange(256)
        content: list[bytes] = [bytes([b]) for b in range(256)]
        pairs: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right = bytes(alphabet[c] for c in a), bytes(alphabet[c] for c in b)
            token = 256 + rank
            content.append(left + right)
            number.setdefault(left + right, token)
            self.left[token], self.right[token], self.length[token] = number[left], number[right], len(left + right)
            pairs.setdefault((number[left], number[right]), token)
        self.pairs, self.table = pairs, _PairTable(pairs)
        self._automaton(content, number)

    @classmethod
    def from_file(cls, path: str) -> BytePairs:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])

    def _automaton(self, content: list[bytes], number: dict[bytes, int]) -> None:
        """States are all beginnings of entries; a state knows the longest entry that its text ends with."""
        state = {b"": 0}
        for entry in content:
            for k in range(1, len(entry) + 1):
                state.setdefault(entry[:k], len(state))
        by_length = sorted(state, key=len)
        self.longest_entry = np.full(len(state), -1, np.int32)
        suffix = np.zeros(len(state), np.int64)
        #: Rows exist for states that have continuations of their own; others move like their suffix state.
        inner = {text[:-1] for text in state if text}
        row = {text: i for i, text in enumerate(t for t in by_length if t in inner)}
        self.row_of = np.zeros(len(state), np.int32)
        self.next = np.zeros((len(row), 256), np.int32)
        children: dict[bytes, list[tuple[int, int]]] = {}
        for text, s in state.items():
            if text:
                children.setdefault(text[:-1], []).append((text[-1], s))
        for text in by_length:
            s = state[text]
            if len(text) > 1:
                suffix[s] = self.next[self.row_of[suffix[state[text[:-1]]]], text[-1]] if len(text) > 1 else 0
            token = number.get(text)
            self.longest_entry[s] = token if token is not None else self.longest_entry[suffix[s]]
            if text in inner:
                r = row[text]
                self.row_of[s] = r
                if text:
                    self.next[r] = self.next[self.row_of[suffix[s]]]
                for byte, child in children[text]:
                    self.next[r, byte] = child
            else:
                self.row_of[s] = self.row_of[suffix[s]]
        #: The next shorter entry that an entry ends with.
        self.shorter = np.full(len(content), -1, np.int32)
        for token, text in enumerate(content):
            self.shorter[token] = self.longest_entry[suffix[state[text]]] if len(text) > 1 else -1

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do the tokens a, b stay as they are when their bytes are encoded together?

        No merge across the border may come before the merges that made the two.  From the border outwards, the
        later merge of the two is undone; a pair that could merge earlier than what was undone last spoils it.
        """
        ok = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.astype(np.int32), b.astype(np.int32)
        limit = np.full(len(a), np.iinfo(np.int32).max, np.int32)
        while len(at):
            merged = self.table.get(a, b)
            bad = (merged >= 0) & (merged < limit)
            ok[at[bad]] = False
            undo_a = (a > b) & (a >= 256)
            undo_b = ~undo_a & (b >= 256)
            undo_a |= ~undo_b & (a >= 256)
            go = ~bad & (undo_a | undo_b)
            # A tie in rank goes to the left merge, which is made first.
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))[go]
            a, b = np.where(undo_a, self.right[a], a)[go], np.where(undo_b, self.left[b], b)[go]
            at = at[go]
        return ok

    def prefix_counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Token counts of all prefixes (of 1, 2, ... bytes) of many pieces, one after another; all pieces step together."""
        out = np.zeros(int(lengths.sum()), np.int32)
        order = np.argsort(-lengths, kind="stable")
        base = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)[order]
        starts, lengths = starts[order], lengths[order]
        last = np.zeros(len(out), np.int32)
        state = np.zeros(len(starts), np.int32)
        for k in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -k, side="left"))
            state = self.next[self.row_of[state[:live]], data[starts[:live] + k]]
            token = self.longest_entry[state].copy()
            open_ = np.arange(live)
            while len(open_):
                t = token[open_]
                before = k - self.length[t]
                at = base[open_] + before
                ok = before < 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self.side_by_side(last[at[inner]], t[inner])
                done = open_[ok]
                last[base[done] + k] = t[ok]
                out[base[done] + k] = np.where(before[ok] >= 0, out[np.maximum(at[ok], 0)], 0) + 1
                open_ = open_[~ok]
                token[open_] = self.shorter[token[open_]]
        return out

    @lru_cache(maxsize=1 << 16)
    def _fits(self, a: int, b: int) -> bool:
        return bool(self.side_by_side(np.array([a]), np.array([b]))[0])

    def prefix_counts_of(self, piece: bytes) -> np.ndarray:
        """The same for one long piece, a byte at a time."""
        out, last = np.zeros(len(piece), np.int32), [0] * len(piece)
        state, longest, shorter, length = 0, self.longest_entry, self.shorter, self.length
        for k, byte in enumerate(piece):
            state = self.next[self.row_of[state], byte]
            token = int(longest[state])
            while (before := k - int(length[token])) >= 0 and not self._fits(last[before], token):
                token = int(shorter[token])
            last[k], out[k] = token, 1 + (out[before] if before >= 0 else 0)
        return out

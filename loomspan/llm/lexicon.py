"""Minimal acyclic transducer: words in, token ids out.

The words, sorted, are added one by one to an automaton in which equal suffixes are shared as soon as
a state can no longer change, so the result is the smallest acyclic automaton of the set.  Every arc
carries the number of words that sort before those it leads to; the sum along a path is the word's
number, and the word's number leads to its ids.  The whole lexicon is one flat file of integers that
workers memory-map; a batch of words is looked up with one vectorised step per byte position.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np

_HEAD = 6


def build(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file of (word, ids) pairs; words must be distinct and not empty."""
    entries = sorted(entries)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]  # states of the last word, not yet shared
    last = b""
    free: list[int] = []

    def share(down_to: int) -> None:
        while len(path) - 1 > down_to:
            state = path.pop()
            key = (final[state], tuple(arcs[state].items()))
            same = register.setdefault(key, state)
            if same != state:
                arcs[path[-1]][last[len(path) - 1]] = same
                arcs[state] = {}
                free.append(state)

    for word, _ in entries:
        common = len(os.path.commonprefix((word, last)))
        share(common)
        last = word
        for byte in word[common:]:
            if free:
                state = free.pop()
                final[state] = False
            else:
                state = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
    share(0)

    count: dict[int, int] = {}

    def words_from(root: int) -> None:
        stack = [(root, False)]
        while stack:
            state, done = stack.pop()
            if state in count:
                continue
            if done:
                count[state] = final[state] + sum(count[t] for t in arcs[state].values())
            else:
                stack.append((state, True))
                stack += [(t, False) for t in arcs[state].values() if t not in count]

    words_from(0)
    number = {s: i for i, s in enumerate(sorted(count))}
    rows = []
    for state in number:
        before = int(final[state])
        for byte in sorted(arcs[state]):
            to = arcs[state][byte]
            rows.append((number[state] * 256 + byte, number[to], before))
            before += count[to]
    table = np.array(rows, dtype=np.int32).reshape(-1, 3)
    table = table[np.argsort(table[:, 0], kind="stable")]
    lengths = np.array([len(ids) for _, ids in entries], dtype=np.int32)
    flat = np.array([i for _, ids in entries for i in ids], dtype=np.int32)
    head = np.array([len(table), len(number), len(entries), len(flat), number[0], max((len(w) for w, _ in entries), default=0)], dtype=np.int32)
    finals = np.array([final[s] for s in number], dtype=np.int32)
    return b"".join(a.tobytes() for a in (head, table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), finals, np.r_[0, np.cumsum(lengths)].astype(np.int32), flat))


class Lexicon:
    """A built file: its path, to be memory-mapped, or a buffer that holds it."""

    def __init__(self, source):
        a = np.memmap(source, dtype=np.int32, mode="r") if isinstance(source, str) else np.frombuffer(source, dtype=np.int32)
        n_arcs, n_states, n_words, n_ids, self.root, self.longest = map(int, a[:_HEAD])
        sizes = (n_arcs, n_arcs, n_arcs, n_states, n_words + 1, n_ids)
        ends = np.cumsum((_HEAD, *sizes))
        self.keys, self.to, self.before, self.final, self.offsets, self.ids = (a[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True))
        self.n_states = n_states

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for words the automaton does not accept."""
        n = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.full(n, self.root, dtype=np.int64)
        out = np.zeros(n, dtype=np.int64)
        alive = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        state[(lengths == 0) | (lengths > self.longest)] = -1
        at = 0
        while len(alive) and len(self.keys):
            key = state[alive] * 256 + data[starts[alive] + at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            state[alive[~hit]] = -1
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.to[arc]
            out[alive] += self.before[arc]
            at += 1
            alive = alive[lengths[alive] > at]
        accepted = (state >= 0) & (self.final[np.maximum(state, 0)] == 1) if self.n_states else np.zeros(n, dtype=bool)
        return np.where(accepted, out, -1)

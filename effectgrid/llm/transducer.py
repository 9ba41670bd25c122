"""Minimal acyclic transducers: a sorted vocabulary as an automaton that gives ordinals.

Built from terms in byte order: what the next term no longer shares is closed, and
a closed state that equals a known one is replaced by it, so the automaton is
minimal when the last term is in. A state knows how many terms end at or below it;
an arc carries the number of terms that come before those it leads to, and the
sum along a term's path is the term's place among all.
"""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np


class Transducer:
    """Arcs by key (state x 256 + byte), with the next state and what they add; state 0 is the first."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, adds: np.ndarray, final: np.ndarray):
        self.keys, self.targets, self.adds, self.final = keys, targets, adds, final

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, keys=self.keys, targets=self.targets, adds=self.adds, final=self.final)
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Transducer:
        with np.load(io.BytesIO(data)) as held:
            return Transducer(held["keys"], held["targets"], held["adds"], held["final"])

    def ordinals(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each word data[start:end], -1 for those that are no term.

        All words take a step at a time; one without an arc is out, so a step
        touches only words that begin like some term.
        """
        out = np.full(len(start), -1, np.int64)
        if not len(self.keys):
            return out
        word = np.arange(len(start))
        at, state, place = start.copy(), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        while len(word):
            ended = at == end[word]
            if ended.any():
                done = ended & self.final[state]
                out[word[done]] = place[done]
                word, at, state, place = (a[~ended] for a in (word, at, state, place))
            key = state * 256 + data[at]
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            known = self.keys[arc] == key
            arc = arc[known]
            word, at, state, place = word[known], at[known] + 1, self.targets[arc], place[known] + self.adds[arc]
        return out


def build(terms: Iterable[bytes]) -> Transducer:
    """The minimal transducer of distinct terms in byte order; no term is empty."""
    # an open state is [final, arcs]; a closed one is its number in `closed`
    known: dict[tuple, int] = {}
    closed: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    below: list[int] = []
    path: list[list] = [[False, []]]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            state = (final, tuple(arcs))
            number = known.get(state)
            if number is None:
                number = known[state] = len(closed)
                closed.append(state)
                below.append(final + sum(below[t] for _, t in arcs))
            path[-1][1].append((last[len(path) - 1], number))

    for term in terms:
        shared = 0
        for a, b in zip(last, term):
            if a != b:
                break
            shared += 1
        close(shared)
        path.extend([False, []] for _ in range(len(term) - shared))
        path[-1][0] = True
        last = term
    close(0)

    # the first state is 0, closed state i is i + 1
    states = [(path[0][0], tuple(path[0][1])), *closed]
    keys, targets, adds = [], [], []
    for number, (final, arcs) in enumerate(states):
        before = int(final)
        for byte, target in arcs:
            keys.append(number * 256 + byte)
            targets.append(target + 1)
            adds.append(before)
            before += below[target]
    return Transducer(*(np.array(a, np.int64) for a in (keys, targets, adds)), np.array([f for f, _ in states], bool))

"""Minimal acyclic transducers: sorted terms to their ordinals, built in one pass, read in batches."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_HEADER = 4


def build(terms: Iterable[bytes]) -> bytes:
    """The transducer of ``terms``, distinct and in ascending byte order, as one byte string.

    States with equal futures are merged as soon as a term leaves them, so the automaton is
    minimal and only the path of the last term is open. An edge's output is the number of terms
    that its state passes before it; outputs along a path add up to the term's ordinal.
    """
    register: dict[tuple, int] = {}
    edges: list[tuple[int, int, int, int]] = []
    final: list[bool] = []
    below: list[int] = []
    # The open path: per state whether a term ends there, and its closed edges.
    ends, outgoing, last = [False], [[]], b""

    def close(depth: int) -> int:
        key = (ends[depth], tuple(outgoing[depth]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(final)
            passed = int(ends[depth])
            for byte, child in outgoing[depth]:
                edges.append((state, byte, child, passed))
                passed += below[child]
            final.append(ends[depth])
            below.append(passed)
        return state

    for term in terms:
        shared = 0
        for x, y in zip(last, term):
            if x != y:
                break
            shared += 1
        for depth in range(len(last), shared, -1):
            outgoing[depth - 1].append((last[depth - 1], close(depth)))
        del ends[shared + 1 :], outgoing[shared + 1 :]
        for _ in range(len(term) - shared):
            ends.append(False)
            outgoing.append([])
        ends[-1] = True
        last = term
    for depth in range(len(last), 0, -1):
        outgoing[depth - 1].append((last[depth - 1], close(depth)))
    root = close(0)
    table = np.array(edges, np.int64).reshape(-1, 4)
    return b"".join(
        [
            np.array([len(final), len(edges), root, below[root]], np.int64).tobytes(),
            ((table[:, 0] << 8) | table[:, 1]).astype(np.int64).tobytes(),
            table[:, 2].astype(np.int32).tobytes(),
            table[:, 3].astype(np.int32).tobytes(),
            np.array(final, np.uint8).tobytes(),
        ]
    )


class Transducer:
    """Reads words through the automaton that ``build`` made."""

    def __init__(self, blob: bytes):
        states, edges, self.root, self.terms = np.frombuffer(blob, np.int64, _HEADER).tolist()
        at = 8 * _HEADER
        self.keys = np.frombuffer(blob, np.int64, edges, at)
        self.targets = np.frombuffer(blob, np.int32, edges, at + 8 * edges)
        self.outputs = np.frombuffer(blob, np.int32, edges, at + 12 * edges)
        self.final = np.frombuffer(blob, np.uint8, states, at + 16 * edges).astype(bool)

    def ordinals(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ordinals of the words ``text[starts : starts + lengths]``; -1 for those it does not hold.

        All words take one byte a step together; a word that has ended or failed takes no more.
        """
        found = np.full(len(starts), -1, np.int64)
        word = np.arange(len(starts))
        state = np.full(len(starts), self.root, np.int64)
        passed = np.zeros(len(starts), np.int64)
        step = 0
        while len(word):
            ended = lengths[word] == step
            if ended.any():
                accepted = ended & self.final[state]
                found[word[accepted]] = passed[accepted]
                word, state, passed = word[~ended], state[~ended], passed[~ended]
            if not len(word) or not len(self.keys):
                break
            wanted = (state << 8) | text[starts[word] + step]
            edge = np.searchsorted(self.keys, wanted)
            edge[edge == len(self.keys)] = 0
            known = self.keys[edge] == wanted
            word, edge = word[known], edge[known]
            state, passed = self.targets[edge].astype(np.int64), passed[known] + self.outputs[edge]
            step += 1
        return found

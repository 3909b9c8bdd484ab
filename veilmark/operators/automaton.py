"""Many phrases found in one run over tokens: a trie with failure links, in flat arrays.

States are numbered by depth; the edge ``e`` of the sorted list of (state, token) pairs leads to state ``e + 1``, so the
trie is one array of keys. A state's counts include those of the phrases that end with it, so each token adds one row of
counts, however many phrases end there. Both the building and the run go step by step over whole arrays: the tokens
are cut into stretches that all advance together, each warmed up on the tokens before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WIDTH = 256


@dataclass(frozen=True)
class Automaton:
    tokens: pa.Array
    keys: np.ndarray
    fail: np.ndarray
    counts: np.ndarray
    longest: int

    def _follow(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The state after each token; 0 is the state of no phrase begun."""
        out = np.zeros(len(state), np.int64)
        open_, state = np.arange(len(state)), state.copy()
        while len(open_):
            key = state * len(self.tokens) + token[open_]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[open_[hit]] = at[hit] + 1
            left = ~hit & (state > 0)
            open_, state = open_[left], self.fail[state[left]]
        return out

    def states(self, token: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """The state after each of the known tokens; a ``fresh`` one begins anew."""
        n, warm = len(token), max(self.longest - 1, 0)
        width = max(_WIDTH, 4 * warm)
        begin = np.arange(0, n, width)
        state, out = np.zeros(len(begin), np.int64), np.zeros(n, np.int64)
        for step in range(-warm, min(width, n)):
            live = np.flatnonzero((begin + step >= 0) & (begin + step < n))
            place = begin[live] + step
            state[live] = self._follow(np.where(fresh[place], 0, state[live]), token[place])
            if step >= 0:
                out[place] = state[live]
        return out

    def count(self, words: pa.ListArray) -> np.ndarray:
        """Per row of tokens and per level: occurrences of the level's phrases, overlapping ones too."""
        sizes = pc.list_value_length(words).fill_null(0).to_numpy()
        out = np.zeros((len(words), self.counts.shape[1]), np.int32)
        if not len(self.keys):
            return out
        code = pc.index_in(words.flatten(), value_set=self.tokens)
        known = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
        row = np.repeat(np.arange(len(words)), sizes)[known]
        fresh = np.ones(len(known), bool)
        fresh[1:] = (np.diff(known) != 1) | (np.diff(row) != 0)
        state = self.states(code.drop_null().to_numpy().astype(np.int64), fresh)
        ends = np.flatnonzero(self.counts.any(axis=1)[state])
        np.add.at(out, row[ends], self.counts[state[ends]])
        return out


def build(phrases: list[tuple[int, list[str]]], levels: int) -> Automaton:
    """The automaton of ``(level, tokens)`` pairs; a pair given twice counts twice, a phrase without tokens never."""
    sizes = np.array([len(t) for _, t in phrases], np.int64)
    level = np.array([k for k, _ in phrases], np.int64)
    coded = pa.array([t for _, tokens in phrases for t in tokens], pa.string()).dictionary_encode()
    token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    words, longest = max(len(coded.dictionary), 1), int(sizes.max(initial=0))
    state, keys, made = np.zeros(len(phrases), np.int64), [], 0
    depth_ends, ended = [1], []
    for depth in range(longest):
        live = np.flatnonzero(sizes > depth)
        key, at = np.unique(state[live] * words + token[start[live] + depth], return_inverse=True)
        keys.append(key)
        state[live] = made + 1 + at
        made += len(key)
        depth_ends.append(made + 1)
        last = live[sizes[live] == depth + 1]
        ended.append((state[last], level[last]))
    counts, fail = np.zeros((made + 1, levels), np.int32), np.zeros(made + 1, np.int64)
    for states, own in ended:
        np.add.at(counts, (states, own), 1)
    done = Automaton(coded.dictionary, np.concatenate(keys) if keys else np.zeros(0, np.int64), fail, counts, longest)
    for first, stop in zip(depth_ends[1:], depth_ends[2:]):
        key = done.keys[first - 1 : stop - 1]
        fail[first:stop] = done._follow(fail[key // words], key % words)
        counts[first:stop] += counts[fail[first:stop]]
    return done

"""A minimal acyclic transducer from words (bytes) to their place in a table of values."""

from __future__ import annotations

import mmap
import struct

import numpy as np

HEADER = struct.Struct("<4sIIII")
MAGIC = b"ACT1"


class _State:
    __slots__ = ("arcs", "final", "number", "below")

    def __init__(self):
        self.arcs: list[tuple[int, _State]] = []
        self.final = False
        self.number = -1
        self.below = 0


def compile_lexicon(entries: list[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The automaton of distinct words with their ids, as one block of bytes.

    Words are added in order; a state is frozen once no later word can change it, and states with the same arcs and
    finality are shared, so common suffixes are stored once. An arc's output is the number of words before those it
    leads to: outputs along a word's path add up to the word's rank, under which its ids stand.
    """
    register: dict[tuple, _State] = {}
    states: list[_State] = []
    root = _State()
    path = [root]
    last = b""

    def freeze(down_to: int):
        while len(path) > down_to:
            state = path.pop()
            key = (state.final, tuple((label, target.number) for label, target in state.arcs))
            known = register.get(key)
            if known is None:
                state.number = len(states)
                state.below = state.final + sum(target.below for _, target in state.arcs)
                states.append(state)
                register[key] = known = state
            if path:
                label, _ = path[-1].arcs[-1]
                path[-1].arcs[-1] = (label, known)

    ordered = sorted(entries)
    for word, _ in ordered:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        freeze(shared + 1)
        for label in word[shared:]:
            state = _State()
            path[-1].arcs.append((label, state))
            path.append(state)
        path[-1].final = True
        last = word
    freeze(0)
    first_arcs, labels, targets, outputs, finals = [], bytearray(), [], [], bytearray()
    for state in states:
        first_arcs.append(len(labels))
        finals.append(state.final)
        before = int(state.final)
        for label, target in state.arcs:
            labels.append(label)
            targets.append(target.number)
            outputs.append(before)
            before += target.below
    first_arcs.append(len(labels))
    starts, ids = [0], []
    for _, values in ordered:
        ids.extend(values)
        starts.append(len(ids))
    numbers = np.array([*first_arcs, *targets, *outputs, *starts, *ids, *labels, *finals], "<u4")
    return HEADER.pack(MAGIC, len(states), len(labels), len(ordered), len(ids)) + numbers.tobytes()


class Lexicon:
    """A compiled automaton, read in place from a memory map outside the Python heap."""

    def __init__(self, block: bytes):
        self.held = mmap.mmap(-1, len(block))
        self.held.write(block)
        _, states, arcs, words, ids = HEADER.unpack_from(self.held)
        self.root = states - 1
        cuts = np.cumsum([0, states + 1, arcs, arcs, words + 1, ids, arcs, states])
        numbers = np.frombuffer(self.held, "<u4", int(cuts[-1]), HEADER.size)
        first, self.targets, self.outputs, self.starts, self.ids, labels, self.finals = (numbers[a:b] for a, b in zip(cuts, cuts[1:]))
        # an arc is found by its state and label, which stand in ascending order
        self.arcs = np.repeat(np.arange(states, dtype=np.int64), np.diff(first)) << 8 | labels

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the table of ids, -1 for words that the lexicon lacks: all words take each step at once."""
        lengths = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        state, rank = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        walking, place = np.arange(len(words)), 0
        while len(walking):
            ended = lengths[walking] == place
            done = walking[ended]
            rank[done] = np.where(self.finals[state[done]] == 1, rank[done], -1)
            walking = walking[~ended]
            wanted = state[walking] << 8 | letters[begin[walking] + place]
            arc = np.searchsorted(self.arcs, wanted)
            there = np.zeros(len(walking), bool)
            inside = arc < len(self.arcs)
            there[inside] = self.arcs[arc[inside]] == wanted[inside]
            rank[walking[~there]] = -1
            walking, arc = walking[there], arc[there]
            rank[walking] += self.outputs[arc]
            state[walking] = self.targets[arc]
            place += 1
        return rank

    def packed(self, rank: int) -> bytes:
        """The ids of the word at ``rank``, little-endian."""
        return self.ids[self.starts[rank] : self.starts[rank + 1]].tobytes()

"""Levenshtein automata of all terms of a lexicon, intersected with its trie.

States of the intersection are sets of (trie node, awaited letter, edits so far); they are made
deterministic when a word first reaches them, and only moves that a word makes
are kept, so that a lexicon of any size and alphabet costs what its words touch.
After that words go column by column: equal moves of all words are one look-up,
for all terms together.
"""

from __future__ import annotations

import numpy as np


# About so many bytes of states and moves are kept; past them a task begins anew with the next words.
MOST_BYTES = 64 << 20
# Words, and characters, that are matched at one time.
_WORDS, _CHARS = 8192, 1 << 20


def edits_allowed(term: str) -> int:
    """Misspellings tolerated in a term of this length."""
    return 0 if len(term) < 4 else 1 if len(term) < 10 else 2


class LexiconAutomaton:
    """Maps words to (term, edits): the nearest term within its tolerance, else term -1."""

    def __init__(self, terms: list[str], edits=edits_allowed, swaps: bool = False):
        """With `swaps`, two neighbouring letters in the wrong order are one edit."""
        self.swaps = swaps
        self.terms = sorted({t for t in terms if t})
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(self.terms))))}
        self.letters = np.array([ord(c) for c in self.alphabet], dtype=np.uint32)
        children: list[dict[int, int]] = [{}]
        ends: list[tuple[int, int] | None] = [None]  # term, tolerance
        for number, term in enumerate(self.terms):
            node = 0
            for c in term:
                nxt = children[node].get(self.alphabet[c])
                if nxt is None:
                    nxt = len(children)
                    children[node][self.alphabet[c]] = nxt
                    children.append({})
                    ends.append(None)
                node = nxt
            ends[node] = (number, edits(term))
        most = [e[1] if e else -1 for e in ends]
        for node in range(len(children) - 1, -1, -1):  # children come after their parents
            for child in children[node].values():
                most[node] = max(most[node], most[child])
        self.longest = max((len(t) + edits(t) for t in self.terms), default=0)

        self.children, self.ends, self.most = children, ends, most
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, int] = {}
        self.size = 0
        self.accept = np.empty((0, 2), dtype=np.int32)
        self.dead = self._number(())
        self.start = self._number(self._closed({(0, 0): 0}) if self.terms else ())

    def _number(self, state: tuple) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
            self.size += 200 + 150 * len(state)
            if number == len(self.accept):
                self.accept = np.concatenate((self.accept, np.full((max(64, number), 2), -1, dtype=np.int32)))
            fit = [(spent, self.ends[n][0]) for (n, wait), spent in state if not wait and self.ends[n] and spent <= self.ends[n][1]]
            if fit:
                self.accept[number] = min(fit)[::-1]
        return number

    def _move(self, move: int) -> int:
        """Target of a move, a state number times the size of the alphabet plus a letter."""
        target = self.moves.get(move)
        if target is None:
            at, letter = divmod(move, len(self.alphabet) + 1)
            target = self.moves[move] = self._number(self._step(self.states[at], letter))
            self.size += 120
        return target

    def _closed(self, reached: dict[tuple[int, int], int]) -> tuple:
        """With letters of the term left out; one edit count, the least, per node and awaited letter."""
        todo = list(reached.items())
        while todo:
            (node, wait), spent = todo.pop()
            if wait or reached.get((node, 0)) != spent:
                continue
            for child in self.children[node].values():
                if spent + 1 <= self.most[child] and spent + 1 < reached.get((child, 0), 99):
                    reached[child, 0] = spent + 1
                    todo.append(((child, 0), spent + 1))
        return tuple(sorted(reached.items()))

    def _step(self, state: tuple, letter: int) -> tuple:
        reached: dict[tuple[int, int], int] = {}

        def put(node: int, spent: int, wait: int = 0) -> None:
            if spent <= self.most[node] and spent < reached.get((node, wait), 99):
                reached[node, wait] = spent

        for (node, wait), spent in state:
            if wait:  # the second half of a swap, or nothing
                if wait == letter:
                    put(node, spent)
                continue
            put(node, spent + 1)  # a letter too many
            for c, child in self.children[node].items():
                put(child, spent if c == letter else spent + 1)
                if self.swaps and c != letter and letter in self.children[child]:
                    put(self.children[child][letter], spent + 1, c)
        return self._closed(reached)

    def match(self, words: list[str]) -> np.ndarray:
        """Rows of (term number, edits), term -1 where none is near."""
        out = np.full((len(words), 2), -1, dtype=np.int32)
        if not self.terms:
            return out
        # Short words first, so that words matched together are of about one length.
        near = sorted((i for i, w in enumerate(words) if 0 < len(w) <= self.longest), key=lambda i: len(words[i]))
        at = 0
        while at < len(near):
            end = min(at + _WORDS, len(near))
            while end > at + 1 and (end - at) * len(words[near[end - 1]]) > _CHARS:
                end = at + (end - at) // 2
            if self.size > MOST_BYTES:
                self._clear()
            out[near[at:end]] = self._match([words[i] for i in near[at:end]])
            at = end
        return out

    def _match(self, words: list[str]) -> np.ndarray:
        lengths = np.array([len(w) for w in words])
        chars = np.array(words, dtype=f"U{lengths.max()}").view(np.uint32).reshape(len(words), -1)
        places = np.searchsorted(self.letters, chars).clip(max=len(self.letters) - 1)
        codes = np.where(self.letters[places] == chars, places + 1, 0).astype(np.int64)
        state = np.full(len(words), self.start, dtype=np.int64)
        live = np.arange(len(words))
        for column in range(chars.shape[1]):
            live = live[(lengths[live] > column) & (state[live] != self.dead)]
            if not len(live):
                break
            moves, back = np.unique(state[live] * (len(self.alphabet) + 1) + codes[live, column], return_inverse=True)
            state[live] = np.array([self._move(m) for m in moves.tolist()], dtype=np.int64)[back]
        return self.accept[state]

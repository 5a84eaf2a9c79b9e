"""Generalised suffix automaton over word numbers."""

from __future__ import annotations


class SuffixAutomaton:
    """All runs of words of a list of items; one state for each set of end positions.

    ``longest(words)`` streams a text and gives at each word the length of the longest run that ends there and
    occurs in an item. ``ends(state)`` gives the places where the state's runs end.
    """

    def __init__(self, items: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.at: list[list[tuple[int, int]]] = [[]]
        for no, item in enumerate(items):
            last = 0
            for pos, word in enumerate(item):
                last = self._extend(last, word)
                self.at[last].append((no, pos))
        self._children: list[list[int]] = [[] for _ in self.link]
        for s in range(1, len(self.link)):
            self._children[self.link[s]].append(s)

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.at.append([])
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of ``q`` for the runs that also end elsewhere; moves from ``p`` up are bent to it."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def longest(self, words: list[int]):
        """Pairs ``(state, length)`` for each word."""
        state, n = 0, 0
        nexts, link, length = self.next, self.link, self.length
        for w in words:
            to = nexts[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nexts[state].get(w)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            yield state, n

    def ends(self, state: int) -> list[tuple[int, int]]:
        """``(item, position of the last word)`` of each occurrence of the state's runs."""
        out, todo = [], [state]
        while todo:
            s = todo.pop()
            out.extend(self.at[s])
            todo.extend(self._children[s])
        return out

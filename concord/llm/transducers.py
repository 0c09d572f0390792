"""Weighted finite-state transducers that write one symbol for each that they read.

An arc reads a symbol, writes one and has a weight. In a composition what the first machine writes the second reads:
its states are pairs, its arcs the matching pairs of arcs, weights multiplied. Each symbol read has a value; a path's
score is the sum of value times weight over its arcs, and of the accepting paths the one of the highest score counts.
A machine may guess what comes later and die if it doesn't, so windows to the right need no second pass.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable

Arc = tuple[Hashable, float, int]  # written, weight, next state


class Transducer:
    """States are numbers from 0, the start; arcs by state and symbol read."""

    def __init__(self, arcs: list[dict[Hashable, list[Arc]]], finals: Iterable[int]) -> None:
        self.arcs, self.finals = arcs, frozenset(finals)

    @classmethod
    def grown(cls, start: Hashable, symbols: Iterable[Hashable], step: Callable, final: Callable = lambda s: True) -> Transducer:
        """From named states: step(state, symbol) -> (written, weight, next state)s; only what the start reaches is kept."""
        number, arcs, todo = {start: 0}, [], [start]
        symbols = list(symbols)
        for state in todo:
            own: dict[Hashable, list[Arc]] = {}
            for x in symbols:
                for y, weight, to in step(state, x):
                    if to not in number:
                        number[to] = len(number)
                        todo.append(to)
                    own.setdefault(x, []).append((y, weight, number[to]))
            arcs.append(own)
        return cls(arcs, (n for s, n in number.items() if final(s)))

    def symbols(self) -> set:
        return {x for own in self.arcs for x in own}

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes."""

        def step(state: tuple[int, int], x: Hashable):
            for y, w, to in self.arcs[state[0]].get(x, ()):
                for z, v, on in other.arcs[state[1]].get(y, ()):
                    yield z, w * v, (to, on)

        return Transducer.grown((0, 0), self.symbols(), step, lambda s: s[0] in self.finals and s[1] in other.finals)

    def best(self, read: Iterable[tuple[Hashable, float]], keep: Callable[[Hashable], bool] = bool) -> tuple[float, list] | None:
        """(score, [(place, written)] of those symbols that `keep` wants) of the best accepting path; None without one.

        Of equal paths the one that is found first in the order of states and arcs counts.
        """
        live: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        arcs = self.arcs
        for place, (x, value) in enumerate(read):
            new: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, path) in live.items():
                for y, weight, to in arcs[state].get(x, ()):
                    s = score + weight * value
                    if to not in new or new[to][0] < s:
                        new[to] = s, ((path, place, y) if keep(y) else path)
            live = new
        ends = [(score, path) for state, (score, path) in live.items() if state in self.finals]
        if not ends:
            return None
        score, path = max(ends, key=lambda e: e[0])
        out = []
        while path is not None:
            path, place, y = path
            out.append((place, y))
        return score, out[::-1]

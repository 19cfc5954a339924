"""Deterministic weighted finite-state transducers over short alphabets, and their composition.

A transducer reads symbols and writes one symbol for each. An arc has a weight; a path's
weight is the sum of its arcs' weights. Symbols without an arc of their own are copied in
the same state with weight 0, or take the state's ``ANY`` arc.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable
from dataclasses import dataclass

ANY = "*"


@dataclass(frozen=True)
class Transducer:
    """``arcs``: (state, symbol) -> (next state, written symbol or ANY for the one read, weight)."""

    start: Hashable
    arcs: dict[tuple[Hashable, str], tuple[Hashable, str, float]]

    def step(self, state: Hashable, symbol: str) -> tuple[Hashable, str, float]:
        to, out, weight = self.arcs.get((state, symbol)) or self.arcs.get((state, ANY)) or (state, ANY, 0.0)
        return to, symbol if out == ANY else out, weight

    def run(self, symbols: Iterable[str]) -> tuple[list[str], float]:
        """What it writes, and the path's weight."""
        state, out, total = self.start, [], 0.0
        for symbol in symbols:
            state, written, weight = self.step(state, symbol)
            out.append(written)
            total += weight
        return out, total


def compose(first: Transducer, second: Transducer, alphabet: Iterable[str]) -> Transducer:
    """One transducer that does what ``second`` does to what ``first`` writes.

    Its states are the pairs that can be reached from the start over ``alphabet``.
    """
    alphabet, start = tuple(alphabet), (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            a, middle, w = first.step(state[0], symbol)
            b, out, v = second.step(state[1], middle)
            arcs[state, symbol] = ((a, b), out, w + v)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Transducer(start, arcs)

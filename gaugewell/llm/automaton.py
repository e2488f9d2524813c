"""Rules compiled into one minimal deterministic automaton over bytes."""

from __future__ import annotations

from re import _parser as patterns  # the parsed form of a pattern, from the standard library

import numpy as np

_MANY = patterns.MAXREPEAT


class _Graph:
    """A nondeterministic automaton: empty moves and moves on byte sets."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def letter(self, letters: frozenset[int], at: int) -> int:
        to = self.state()
        self.moves[at].append((letters, to))
        return to

    def add(self, tree, at: int, fold: bool, backward: bool) -> int:
        """Append what the parsed pattern accepts behind state ``at``; the state it ends in."""
        for operation, value in reversed(list(tree)) if backward else tree:
            name = str(operation)
            if name in ("LITERAL", "IN", "NOT_LITERAL"):
                at = self.letter(_letters(operation, value, fold), at)
            elif name == "SUBPATTERN":
                at = self.add(value[3], at, fold, backward)
            elif name == "BRANCH":
                end = self.state()
                for branch in value[1]:
                    start = self.state()
                    self.empty[at].append(start)
                    self.empty[self.add(branch, start, fold, backward)].append(end)
                at = end
            elif name == "MAX_REPEAT":
                least, most, body = value
                for _ in range(least):
                    at = self.add(body, at, fold, backward)
                if most == _MANY:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(body, loop, fold, backward)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    self.empty[at].append(end)
                    for _ in range(most - least):
                        at = self.add(body, at, fold, backward)
                        self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"a rule cannot use {name}")
        return at


def _letters(operation, value, fold: bool) -> frozenset[int]:
    if str(operation) == "LITERAL":
        found = {value}
    else:
        found = set()
        for kind, item in value:
            if str(kind) == "LITERAL":
                found.add(item)
            elif str(kind) == "RANGE":
                found.update(range(item[0], item[1] + 1))
            else:
                raise ValueError(f"a rule cannot use {kind} in a set")
    if max(found) > 127:
        raise ValueError("rules are over ASCII")
    if fold:
        found |= {c ^ 32 for c in found if chr(c).isalpha()}
    return frozenset(found)


class Automaton:
    """All rules at once. ``search`` lets a match begin anywhere; ``backward`` reads from its end.

    ``table[state + classes[byte]]`` is the next state (states are multiples of the number
    of byte classes, the start is 0) and bit r of ``accepts[state]`` says that rule r ends here.
    """

    def __init__(self, rules: list[tuple[str, bool]], search: bool, backward: bool = False) -> None:
        graph, start, ends = _Graph(), None, {}
        start = graph.state()
        for number, (pattern, fold) in enumerate(rules):
            first = graph.state()
            graph.empty[start].append(first)
            ends[graph.add(patterns.parse(pattern), first, fold, backward)] = number
        if search:
            graph.moves[start].append((frozenset(range(256)), start))
        self.classes, examples = self._byte_classes(graph)
        table, accepts = self._subsets(graph, start, ends, examples)
        table, accepts = self._minimal(table, accepts)
        self.width = len(examples)
        self.accepts = np.repeat(accepts, self.width).astype(np.int16 if len(rules) < 15 else np.int64)
        self.table = (table * self.width).astype(np.int32).ravel()
        back = (table == 0).all(axis=0) & (accepts[0] == 0)
        self.resets = back[self.classes]  # bytes after which nothing is under way, whatever came before

    @staticmethod
    def _byte_classes(graph: _Graph) -> tuple[np.ndarray, list[int]]:
        sets = list({letters for moves in graph.moves for letters, _ in moves})
        known: dict[tuple, int] = {}
        examples, classes = [], np.zeros(256, np.int32)
        for byte in range(256):
            key = tuple(byte in s for s in sets)
            if key not in known:
                known[key] = len(known)
                examples.append(byte)
            classes[byte] = known[key]
        return classes, examples

    @staticmethod
    def _subsets(graph: _Graph, start: int, ends: dict[int, int], examples: list[int]) -> tuple[np.ndarray, np.ndarray]:
        def closed(states) -> int:
            found, todo = set(states), list(states)
            while todo:
                for to in graph.empty[todo.pop()]:
                    if to not in found:
                        found.add(to)
                        todo.append(to)
            return sum(1 << s for s in found)

        # sets of states as bits; what each state leads to, by byte class
        leads: list[list[tuple[int, int]]] = []
        for moves in graph.moves:
            into = [(letters, closed([to])) for letters, to in moves]
            leads.append([(c, to) for c, byte in enumerate(examples) for letters, to in into if byte in letters])
        numbers = {closed([start]): 0}
        queue, table = [closed([start])], []
        for subset in queue:  # grows while it is read
            row = [0] * len(examples)
            for state, moves in enumerate(leads):
                if subset >> state & 1:
                    for c, to in moves:
                        row[c] |= to
            for to in row:
                if to not in numbers:
                    numbers[to] = len(numbers)
                    queue.append(to)
            table.append([numbers[to] for to in row])
        accepts = [sum(1 << r for r in {r for s, r in ends.items() if subset >> s & 1}) for subset in queue]
        return np.array(table, np.int64), np.array(accepts, np.int64)

    @staticmethod
    def _minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States that accept alike and lead to like states become one."""
        part = np.unique(accepts, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        order = np.unique(part, return_index=True)[1]  # the start state becomes 0
        rank = np.empty(len(order), np.int64)
        rank[np.argsort(order)] = np.arange(len(order))
        part, order = rank[part], np.sort(order)
        return part[table[order]], accepts[order]

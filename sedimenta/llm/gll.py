"""A generalised LL parser: any context-free grammar, left recursion and ambiguity included, in polynomial time.

Descriptors (a place in a rule, a stack node, a position) are worked off once each. The stacks of all parses under
way share one graph: its nodes are (nonterminal, position), its edges say where to go on after the nonterminal.
What a node was popped with are the spans its nonterminal covers; from them the cheapest derivation is read back.
A rule has a cost, so error recovery is nothing but dearer rules of the grammar.
"""

from __future__ import annotations

from collections import defaultdict

INFINITE = float("inf")


class Grammar:
    """``rules``: nonterminal -> [(cost, symbols)]; a symbol is a nonterminal's name or a set of token kinds."""

    def __init__(self, start: str, rules: dict[str, list[tuple[float, tuple]]]):
        self.start, self.rules = start, rules

    def spans(self, kinds: str) -> dict[tuple[str, int], set[int]]:
        """(nonterminal, begin) -> ends, for everything met on the way from the start."""
        rules, n = self.rules, len(kinds)
        edges: dict[tuple[str, int], set] = {}
        popped: dict[tuple[str, int], set[int]] = defaultdict(set)
        seen, todo = set(), []

        def add(place: tuple, node: tuple, at: int) -> None:
            if (place, node, at) not in seen:
                seen.add((place, node, at))
                todo.append((place, node, at))

        def call(symbol: str, at: int) -> tuple[str, int]:
            node = (symbol, at)
            if node not in edges:
                edges[node] = set()
                for k in range(len(rules[symbol])):
                    add((symbol, k, 0), node, at)
            return node

        call(self.start, 0)
        while todo:
            (symbol, k, dot), node, at = todo.pop()
            body = rules[symbol][k][1]
            while True:
                if dot == len(body):
                    if at not in popped[node]:
                        popped[node].add(at)
                        for place, parent in edges[node]:
                            add(place, parent, at)
                    break
                part = body[dot]
                if isinstance(part, str):
                    below, back = call(part, at), ((symbol, k, dot + 1), node)
                    if back not in edges[below]:
                        edges[below].add(back)
                        for end in tuple(popped[below]):
                            add(back[0], node, end)
                    break
                if at < n and kinds[at] in part:
                    dot, at = dot + 1, at + 1
                    continue
                break
        return popped

    def parse(self, kinds: str) -> tuple[float, list] | None:
        """Cost and tree (nonterminal, begin, end, children) of the cheapest derivation of the longest start span.

        Costs of all spans fall until none falls any more, shorter spans first; nothing recurses, so the length of
        the input is bounded by memory alone.
        """
        popped = self.spans(kinds)
        if not popped.get((self.start, 0)):
            return None
        spans = sorted(((symbol, i, j) for (symbol, i), ends in popped.items() for j in ends), key=lambda x: (x[2] - x[1], -x[1]))
        cost = dict.fromkeys(spans, INFINITE)
        made: dict[tuple[str, int, int], list] = {}
        changed = True
        while changed:
            changed = False
            for span in spans:
                for own, body in self.rules[span[0]]:
                    found = self._fill(kinds, body, span[1], span[2], popped, cost)
                    if found and own + found[0] < cost[span]:
                        cost[span], made[span], changed = own + found[0], found[1], True
        top = min(((self.start, 0, j) for j in popped[self.start, 0]), key=lambda x: (cost[x], -x[2]))
        if cost[top] == INFINITE:
            return None
        tree: list = [*top, []]
        todo = [tree]
        while todo:
            node = todo.pop()
            node[3] = [[*child, []] for child in made[node[0], node[1], node[2]]]
            todo += node[3]
        return cost[top], tree

    @staticmethod
    def _fill(kinds: str, body: tuple, i: int, j: int, popped: dict, cost: dict) -> tuple[float, list] | None:
        """The cheapest way to cover i..j with a rule's symbols: its cost and the spans of its nonterminals."""
        ways: dict[int, tuple[float, list]] = {i: (0, [])}
        for part in body:
            further: dict[int, tuple[float, list]] = {}
            for at, (paid, children) in ways.items():
                if isinstance(part, str):
                    for end in popped.get((part, at), ()):
                        total = paid + cost[part, at, end]
                        if end <= j and total < further.get(end, (INFINITE,))[0]:
                            further[end] = (total, [*children, (part, at, end)])
                elif at < j and kinds[at] in part and paid < further.get(at + 1, (INFINITE,))[0]:
                    further[at + 1] = (paid, children)
            ways = further
        return ways.get(j)

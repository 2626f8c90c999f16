"""One small graph in plain Python: the brute force that the set-wise searches are held against."""

from __future__ import annotations

from collections import defaultdict, deque
from itertools import combinations

from causalake.schemas import CAUSAL_EDGES, GENETIC, MAX_POOL, MAX_SET


class Digraph:
    """A directed graph as child and parent sets."""

    def __init__(self, pairs) -> None:
        self.children, self.parents = defaultdict(set), defaultdict(set)
        for a, b in pairs:
            self.children[a].add(b)
            self.parents[b].add(a)
        self.nodes = set(self.children) | set(self.parents)

    def without(self, gone: set) -> Digraph:
        return Digraph((a, b) for a in self.nodes for b in self.children.get(a, ()) if a not in gone and b not in gone)

    def without_out_edges(self, node) -> Digraph:
        return Digraph((a, b) for a in self.nodes for b in self.children.get(a, ()) if a != node)

    def closure(self, start, back: bool = False) -> set:
        """All nodes reachable from start, without it unless on a cycle."""
        step = self.parents if back else self.children
        seen, queue = set(), deque(step.get(start, ()))
        while queue:
            n = queue.popleft()
            if n not in seen:
                seen.add(n)
                queue.extend(step.get(n, ()))
        return seen

    def cyclic(self) -> list[set]:
        """Components of mutually reachable nodes, and self-loops."""
        out, seen = [], set()
        for n in sorted(self.nodes):
            if n not in seen and n in (down := self.closure(n)):
                part = {n} | (down & self.closure(n, back=True))
                seen |= part
                out.append(part)
        return out


def separated(graph: Digraph, x, y, given: frozenset) -> bool:
    """Whether given blocks every trail between x and y: search over (node, direction of arrival)."""
    above = set(given)
    for z in given:
        above |= graph.closure(z, back=True)
    seen, queue = set(), deque([(x, "up")])
    while queue:
        n, way = queue.popleft()
        if (n, way) in seen:
            continue
        seen.add((n, way))
        if n == y and n not in given:
            return False
        if way == "up" and n not in given:
            queue.extend((p, "up") for p in graph.parents.get(n, ()))
            queue.extend((c, "down") for c in graph.children.get(n, ()))
        elif way == "down":
            if n not in given:
                queue.extend((c, "down") for c in graph.children.get(n, ()))
            if n in above:
                queue.extend((p, "up") for p in graph.parents.get(n, ()))
    return True


def satisfies_backdoor(graph: Digraph, x, y, given: frozenset) -> bool:
    if y in given or x in given or given & graph.closure(x):
        return False
    return separated(graph.without_out_edges(x), x, y, given)


def is_admissible(edge_type: str, evidence_class: str | None) -> bool:
    return edge_type in CAUSAL_EDGES or (edge_type == "associated_with" and evidence_class in GENETIC)


def identify(edges: list[tuple], scores: dict, x, y, most: int = MAX_SET, pool: int = MAX_POOL) -> dict:
    """The verdict on one pair. edges: (source, target, type, class) of the full graph.

    A route that only leads through a cyclic node is no causal path. Sets are tried smallest first, then in
    the pool's order: node score from the highest, then name.
    """
    nodes = {n for e in edges for n in e[:2]} | set(scores)
    out = {"identifiable": False, "adjustment_set": [], "n_near_miss": 0, "truncated": False}
    if x not in nodes:
        return out | {"reason": "treatment_absent"}
    if y not in nodes:
        return out | {"reason": "outcome_absent"}
    full = Digraph((a, b) for a, b, t, c in edges if is_admissible(t, c))
    loops = set().union(*full.cyclic()) if full.nodes else set()
    if x in loops or y in loops:
        return out | {"reason": "cyclic_component"}
    dag = full.without(loops)
    below = dag.closure(x)
    if y not in below:
        return out | {"reason": "no_causal_path"}
    regulators = {a for a, b, t, c in edges if b == x and a not in (x, y) and t in CAUSAL_EDGES}
    weak = {a for a, b, t, c in edges if b == y and not is_admissible(t, c)}
    out["n_near_miss"] = len(regulators & weak)
    rest = sorted(dag.nodes - below - {x, y}, key=lambda n: (-scores.get(n, 0.0), n))
    out["truncated"] = len(rest) > pool
    rest = rest[:pool]
    for size in range(min(most, len(rest)) + 1):
        for given in combinations(rest, size):
            if satisfies_backdoor(dag, x, y, frozenset(given)):
                return out | {"identifiable": True, "adjustment_set": list(given), "reason": "identifiable_by_adjustment" if given else "identifiable_trivially", "truncated": False}
    out["truncated"] |= len(rest) > most
    return out | {"reason": "no_valid_adjustment_set"}

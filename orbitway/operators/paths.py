"""Search on one road network: trees, components, loops. Networks and requests are what scale out; one network fits in a task."""

from __future__ import annotations

import functools
import heapq
from bisect import insort
from dataclasses import dataclass, field

#: Kind of the edges that trees, components and loops run on.
MAINLINE = "shutoko"
#: From so many edges on, loops come from the catalogue instead of from all simple paths.
EXHAUSTIVE_EDGES = 5_000
#: Edges that all paths found at once may have together.
RETAINED_EDGES = 20_000


@dataclass(frozen=True)
class Limits:
    """Defaults of a search."""

    states: int = 100_000
    beam: int = 200
    loop_edges: int = 2_000
    pairs: int = 10
    candidates: int = 3
    loop_meters: int = 5_000
    access_meters: float = 30_000.0
    retained_edges: int = RETAINED_EDGES


@dataclass
class Budget:
    """States that a search has expanded; truncated once it passes its limit or leaves something out."""

    most: int
    spent: int = 0
    truncated: bool = False

    def take(self, n: int = 1) -> bool:
        if self.spent + n > self.most:
            self.truncated = True
            return False
        self.spent += n
        return True


@dataclass(frozen=True)
class Edge:
    id: str
    source: str
    target: str
    kind: str
    seconds: int
    meters: int
    name: str | None = None


@dataclass
class Network:
    """Edges with their neighbours in the order of edge ids, and the sequences of edges that no path may hold."""

    edges: dict[str, Edge]
    forbidden: list[tuple[str, ...]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.out: dict[str, list[Edge]] = {}
        self.into: dict[str, list[Edge]] = {}
        for e in sorted(self.edges.values(), key=lambda e: e.id):
            self.out.setdefault(e.source, []).append(e)
            self.into.setdefault(e.target, []).append(e)
        self.starts: dict[str, list[tuple[str, ...]]] = {}
        for s in self.forbidden:
            self.starts.setdefault(s[0], []).append(tuple(s))
        self.ends: dict[str, list[tuple[str, ...]]] = {}
        for s in self.forbidden:
            self.ends.setdefault(s[-1], []).append(tuple(s))
        self._catalogues: dict[str, tuple[list[list[Edge]], int]] = {}
        self._sizes: dict[tuple[str, bool], int] = {}
        self._ahead: dict[str, set[str]] = {}
        self._reached: dict[tuple[str, int], set[str]] = {}
        self._loops: dict[tuple[str, int, Limits], tuple[list[list[Edge]], int, bool]] = {}

    # --- legality and sums ---

    def legal(self, path: list[Edge]) -> bool:
        """Whether the path holds no forbidden sequence, at consecutive places."""
        if not self.starts:
            return True
        ids = [e.id for e in path]
        return not any(tuple(ids[i : i + len(s)]) == s for i, x in enumerate(ids) for s in self.starts.get(x, ()))

    def closes(self, ids: list[str], last: str) -> bool:
        """Whether an edge after a legal path completes a forbidden sequence."""
        return any(tuple(ids[len(ids) + 1 - len(s) :]) == s[:-1] for s in self.ends.get(last, ()) if len(s) <= len(ids) + 1)

    # --- trees ---

    def tree(self, root: str, backward: bool = False, within: set[str] | None = None, most: int | None = None) -> tuple[dict[str, int], dict[str, Edge], int]:
        """Seconds to each node from the root (backward: from each node to it), its last (first) edge, and the nodes settled.

        Of edges that are equally short, the one with the smaller id stays. Restrictions don't count.
        within: nodes that may be used; most: seconds.
        """
        cost, via, settled = {root: 0}, {}, 0
        if within is not None and root not in within:
            return {}, {}, 0
        queue = [(0, root)]
        near = self.into if backward else self.out
        done = set()
        while queue:
            c, node = heapq.heappop(queue)
            if node in done:
                continue
            done.add(node)
            settled += 1
            for e in near.get(node, ()):
                other = e.source if backward else e.target
                if e.kind != MAINLINE or within is not None and other not in within or most is not None and c + e.seconds > most:
                    continue
                known = cost.get(other)
                if known is None or c + e.seconds < known:
                    cost[other], via[other] = c + e.seconds, e
                    heapq.heappush(queue, (c + e.seconds, other))
                elif c + e.seconds == known and other != root and e.id < via[other].id:
                    via[other] = e
        return cost, via, settled

    def route(self, via: dict[str, Edge], node: str, root: str, backward: bool = False) -> list[Edge] | None:
        """The tree's path between the root and a node, in the direction of travel; None where there is none."""
        path: list[Edge] = []
        while node != root:
            e = via.get(node)
            if e is None or len(path) > len(via):
                return None
            path.append(e)
            node = e.target if backward else e.source
        return path if backward else path[::-1]

    def reached(self, root: str, most: int) -> set[str]:
        """Nodes within so many seconds; kept for each root and bound."""
        if (root, most) not in self._reached:
            self._reached[root, most] = set(self.tree(root, most=most)[0])
        return self._reached[root, most]

    def components(self) -> dict[str, tuple[str, bool]]:
        """For each node of a mainline edge, the least node of its strongly connected component, and whether that has a cycle."""
        return self._components

    @functools.cached_property
    def _components(self) -> dict[str, tuple[str, bool]]:
        nodes = sorted({n for e in self.edges.values() if e.kind == MAINLINE for n in (e.source, e.target)})
        after = {n: [e.target for e in self.out.get(n, ()) if e.kind == MAINLINE] for n in nodes}
        index: dict[str, int] = {}
        low: dict[str, int] = {}
        stack: list[str] = []
        held: set[str] = set()
        out: dict[str, tuple[str, bool]] = {}
        for first in nodes:
            if first in index:
                continue
            work = [(first, iter(after[first]))]
            index[first] = low[first] = len(index)
            stack.append(first)
            held.add(first)
            while work:
                node, rest = work[-1]
                for n in rest:
                    if n not in index:
                        index[n] = low[n] = len(index)
                        stack.append(n)
                        held.add(n)
                        work.append((n, iter(after[n])))
                        break
                    if n in held:
                        low[node] = min(low[node], index[n])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[node])
                    if low[node] == index[node]:
                        own = []
                        while True:
                            own.append(stack.pop())
                            held.discard(own[-1])
                            if own[-1] == node:
                                break
                        cyclic = len(own) > 1 or node in after[node]
                        out |= dict.fromkeys(own, (min(own), cyclic))
        return out

    @functools.cached_property
    def _condensed(self) -> tuple[dict[str, str], dict[str, list[str]], dict[str, set[str]], dict[str, set[str]]]:
        """The component of each node of a mainline edge, the nodes of each, and those that its edges lead to and come from."""
        part = {n: p for n, (p, _) in self.components().items()}
        own: dict[str, list[str]] = {}
        for n, p in part.items():
            own.setdefault(p, []).append(n)
        after: dict[str, set[str]] = {p: set() for p in own}
        before: dict[str, set[str]] = {p: set() for p in own}
        for e in self.edges.values():
            if e.kind == MAINLINE and (a := part[e.source]) != (b := part[e.target]):
                after[a].add(b)
                before[b].add(a)
        return part, own, after, before

    @property
    def part(self) -> dict[str, str]:
        """The component of each node of a mainline edge, by its least node."""
        return self._condensed[0]

    def _parts(self, start: str, backward: bool = False, within: set[str] | None = None) -> set[str]:
        """The components that a component leads to (backward: that lead to it), itself among them."""
        near = self._condensed[3 if backward else 2]
        seen, queue = {start}, [start]
        while queue:
            for p in near[queue.pop()]:
                if p not in seen and (within is None or p in within):
                    seen.add(p)
                    queue.append(p)
        return seen

    def settled(self, root: str, backward: bool = False) -> int:
        """The nodes that a tree from the root settles, without the tree; kept for each component."""
        part, own, _, _ = self._condensed
        if root not in part:
            return 1
        key = part[root], backward
        if key not in self._sizes:
            self._sizes[key] = sum(len(own[p]) for p in self._parts(part[root], backward))
        return self._sizes[key]

    def leads(self, start: str, goal: str) -> bool:
        """Whether mainline edges lead from one node to another; what a component leads to is kept."""
        part = self._condensed[0]
        if part[start] not in self._ahead:
            self._ahead[part[start]] = self._parts(part[start])
        return part[goal] in self._ahead[part[start]]

    def between(self, start: str, goal: str) -> set[str]:
        """The nodes of all ways from one node to another. Trees from either that stay within them are as any other tree there."""
        part, own, _, _ = self._condensed
        if start not in part or goal not in part:
            return {start} if start == goal else set()
        if part[start] == part[goal]:
            return set(own[part[start]])
        ahead = self._parts(part[start])
        return {n for p in self._parts(part[goal], True, ahead) for n in own[p]} if part[goal] in ahead else set()

    # --- loops ---

    def catalogue(self, anchor: str) -> tuple[list[list[Edge]], int]:
        """For each edge out of the anchor, the loop that goes home by the backward tree, if it is simple and legal; by (seconds, edge ids).

        No loop leaves the anchor's component, so that the tree stays there; the count is that of the nodes of a whole tree.
        """
        if anchor not in self._catalogues:
            settled = self.settled(anchor, backward=True)
            cost, via, _ = self.tree(anchor, backward=True, within=self.between(anchor, anchor))
            loops = []
            for e in self.out.get(anchor, ()):
                home = self.route(via, e.target, anchor, backward=True) if e.kind == MAINLINE and e.target in cost else None
                if home is not None and len({x.source for x in home} | {anchor}) == len(home) + 1 and self.legal([e, *home]):
                    loops.append([e, *home])
            self._catalogues[anchor] = sorted(loops, key=loop_order), settled
        return self._catalogues[anchor]

    def loops(self, anchor: str, most: int, limits: Limits, budget: Budget) -> list[list[Edge]]:
        """Loops at the anchor of at most so many seconds and at least limits.loop_meters; what a full search found is kept, at the states that it took."""
        key = anchor, most, limits
        if key not in self._loops:
            full = Budget(limits.states)
            self._loops[key] = self._search(anchor, most, limits, full), full.spent, full.truncated
        found, spent, cut = self._loops[key]
        if budget.spent + spent > budget.most:
            return self._search(anchor, most, limits, budget)
        budget.spent += spent
        budget.truncated |= cut
        return found

    def _search(self, anchor: str, most: int, limits: Limits, budget: Budget) -> list[list[Edge]]:
        """From the catalogue on a large network; all simple legal loops, level by level, on a small one."""
        if len(self.edges) > EXHAUSTIVE_EDGES:
            found, settled = self.catalogue(anchor)
            if not budget.take(settled):
                return []
            return [x for x in found if len(x) <= limits.loop_edges and seconds(x) <= most and meters(x) >= limits.loop_meters]
        near, found, kept = self.reached(anchor, most), [], 0
        level: list[tuple[int, list[str], list[Edge]]] = [(0, [], [])]
        for depth in range(1, limits.loop_edges + 1):
            following: list[tuple[int, list[str], list[Edge]]] = []
            for spent, ids, path in level:
                visited = {e.target for e in path}
                for e in self.out.get(path[-1].target if path else anchor, ()):
                    if e.kind != MAINLINE:
                        continue
                    if not budget.take():
                        return found
                    if e.target not in near or spent + e.seconds > most or self.closes(ids, e.id):
                        continue
                    if e.target == anchor:
                        if meters(path) + e.meters < limits.loop_meters:
                            continue
                        if len(found) == limits.beam or kept + depth > limits.retained_edges:
                            budget.truncated = True
                            return found
                        kept += depth
                        found.append([*path, e])
                    elif e.target not in visited:
                        if depth == limits.loop_edges or len(following) >= limits.beam:
                            budget.truncated = True
                        else:
                            insort(following, (spent + e.seconds, [*ids, e.id], [*path, e]), key=lambda x: x[:2])
            if not following:
                break
            level = following
        return found

    def closed_walk(self, anchor: str) -> bool:
        """Whether a legal walk of at least one edge leads back to the anchor. A state is a node and the last edges, as far as a forbidden sequence could still go on."""
        longest = max((len(s) for s in self.forbidden), default=1)
        seen: set[tuple[str, ...]] = set()
        queue: list[tuple[str, tuple[str, ...]]] = [(anchor, ())]
        while queue:
            node, tail = queue.pop()
            for e in self.out.get(node, ()):
                if e.kind != MAINLINE:
                    continue
                walk = (*tail, e.id)
                if any(walk[-len(s) :] == s for s in self.forbidden):
                    continue
                if e.target == anchor:
                    return True
                state = (e.target, *walk[-(longest - 1) :]) if longest > 1 else (e.target,)
                if state not in seen:
                    seen.add(state)
                    queue.append((e.target, state[1:]))
        return False


def seconds(path: list[Edge]) -> int:
    return sum(e.seconds for e in path)


def meters(path: list[Edge]) -> int:
    return sum(e.meters for e in path)


def loop_order(path: list[Edge]) -> tuple[int, list[str]]:
    return seconds(path), [e.id for e in path]


def too_alike(a: list[Edge], b: list[Edge]) -> bool:
    """Whether two paths share four fifths of the metres of the edges that either has; the threshold is inclusive."""
    one, two = {e.id: e.meters for e in a}, {e.id: e.meters for e in b}
    shared = sum(m for x, m in one.items() if x in two)
    return shared * 5 >= (sum(one.values()) + sum(two.values()) - shared) * 4

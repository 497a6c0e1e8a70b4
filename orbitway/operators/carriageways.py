"""Labels of the two carriageways of a ring, whose steps depend on their order: growth, levelling, flow, walks, parities.

A ring fits in a task; rings are what scales out. Edges are (id, source, target, metres); they are
looked at in the order of their ids.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable
from typing import NamedTuple

#: The two carriageways, in order.
SIDES = ("inner", "outer")
#: Moves of a levelling, and what an edge carries at most.
SWEEPS, CAPACITY = 24, 64


class Edge(NamedTuple):
    id: str
    source: str
    target: str
    meters: int


def grow(edges: Iterable[Edge], labels: dict[str, str]) -> dict[str, str]:
    """labels and those that grow from them: an edge takes the label that all edges which lead to it have, or else all that it leads to.

    A label counts at once for the edges after it in the same round; rounds go on until nothing changes.
    """
    order, out = sorted(edges), dict(labels)
    into, onward = defaultdict(list), defaultdict(list)
    for e in order:
        into[e.target].append(e.id)
        onward[e.source].append(e.id)
    open_ = [e for e in order if e.id not in out]
    for _ in range(max(1, len(order))):
        before = len(open_)
        left = []
        for e in open_:
            for near in (into[e.source], onward[e.target]):
                said = {out.get(x) for x in near if x != e.id}
                if len(said) == 1 and None not in said:
                    out[e.id] = said.pop()
                    break
            else:
                left.append(e)
        open_ = left
        if len(open_) == before:
            break
    return out


def leading(edges: Iterable[Edge], labels: dict[str, str], exits: Iterable[tuple[str, str]]) -> dict[str, str]:
    """labels without those that lead to none of their direction's exits (direction, node) over edges of that label; directions without an exit keep theirs."""
    ways_in = defaultdict(list)
    for e in edges:
        if e.id in labels:
            ways_in[labels[e.id], e.target].append((labels[e.id], e.source))
    led = set(exits)
    bound, open_ = {side for side, _ in led}, list(led)
    while open_:
        for place in ways_in[open_.pop()]:
            if place not in led:
                led.add(place)
                open_.append(place)
    return {e.id: labels[e.id] for e in edges if e.id in labels and ((labels[e.id], e.target) in led or labels[e.id] not in bound)}


def spread(labels: dict[str, str], pairs: Iterable[tuple[str, str, int, bool]]) -> dict[str, str]:
    """labels and those that pairs (edge, other, metres, whether other heads the opposite way) give, round by round, to edges without one.

    An edge takes the label of the nearest of the edges that got theirs in the round before; of equally near ones the opposite
    one comes first, then the smaller id. The opposite one gives the other label.
    """
    near = defaultdict(list)
    for edge, other, away, flip in pairs:
        near[other].append((edge, (away, not flip, other)))
    known, latest = dict(labels), dict(labels)
    while latest:
        best: dict[str, tuple[int, bool, str]] = {}
        for other in latest:
            for edge, said in near[other]:
                if edge not in known and (edge not in best or said < best[edge]):
                    best[edge] = said
        latest = {x: known[other] if straight else "outer" if known[other] == "inner" else "inner" for x, (_, straight, other) in best.items()}
        known |= latest
    return known


def imbalance(edges: Iterable[Edge], labels: dict[str, str]) -> int:
    """Sum, over sides and nodes, of how far edges out and edges in differ in number."""
    at: Counter = Counter()
    for e in edges:
        if e.id in labels:
            at[labels[e.id], e.source] += 1
            at[labels[e.id], e.target] -= 1
    return sum(abs(v) for (side, _), v in at.items() if side in SIDES)


def level(edges: Iterable[Edge], labels: dict[str, str]) -> dict[str, str]:
    """labels after at most SWEEPS moves, each of which gives one edge another label, or none, and lowers the imbalance most.

    Of equal moves the edge with the smallest id comes first, then no label, then the inner side. The
    imbalance never rises; it ends where no move lowers it. A move's worth is known from its two nodes.
    """
    order, out = sorted(edges), dict(labels)
    at: Counter = Counter()
    for e in order:
        if out.get(e.id) in SIDES:
            at[out[e.id], e.source] += 1
            at[out[e.id], e.target] -= 1

    def worth(e: Edge, side: str | None, sign: int) -> int:
        if side not in SIDES or e.source == e.target:
            return 0
        here, there = at[side, e.source], at[side, e.target]
        return abs(here + sign) - abs(here) + abs(there - sign) - abs(there)

    for _ in range(SWEEPS):
        best = None
        for e in order:
            now = out.get(e.id)
            gone = worth(e, now, -1)
            for rank, side in enumerate((None, *SIDES)):
                if side != now:
                    move = (gone + worth(e, side, 1), e.id, rank, e, side)
                    best = move if best is None or move[:3] < best[:3] else best
        if best is None or best[0] >= 0:
            break
        _, _, _, e, side = best
        for name, sign in ((out.pop(e.id, None), -1), (side, 1)):
            if name in SIDES:
                at[name, e.source] += sign
                at[name, e.target] -= sign
        if side is not None:
            out[e.id] = side
    return out


class _Flow:
    """Least costs of shipping units over arcs: shortest paths one after another, with potentials that keep costs from being negative."""

    def __init__(self) -> None:
        self.end, self.room, self.cost, self.near = [], [], [], defaultdict(list)

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        """The number of the arc; the next number is its way back."""
        number = len(self.end)
        self.end += [b, a]
        self.room += [room, 0]
        self.cost += [cost, -cost]
        self.near[a].append(number)
        self.near[b].append(number + 1)
        return number

    def ship(self, source: int, sink: int, units: int) -> bool:
        """Whether all units get through; of equally short paths the one found first stays."""
        height: Counter = Counter()
        while units:
            far, by, queue = {source: 0}, {}, [(0, source)]
            while queue:
                d, node = heapq.heappop(queue)
                if d > far[node]:
                    continue
                for k in self.near[node]:
                    other = self.end[k]
                    if self.room[k] > 0:
                        to = d + self.cost[k] + height[node] - height[other]
                        if other not in far or to < far[other]:
                            far[other], by[other] = to, k
                            heapq.heappush(queue, (to, other))
            if sink not in by:
                return False
            for node, d in far.items():
                height[node] += d
            trail, node = [], sink
            while node != source:
                trail.append(by[node])
                node = self.end[by[node] ^ 1]
            most = min([units, *(self.room[k] for k in trail)])
            for k in trail:
                self.room[k] -= most
                self.room[k ^ 1] += most
            units -= most
        return True


def balanced(edges: Iterable[Edge], chosen: Iterable[str]) -> list[str] | None:
    """The chosen edges and, at the least metres, as many further passes over edges as make every node's edges in and out equal.

    Edge ids, repeats included; None where edges can't balance them, with CAPACITY passes of an edge at most.
    """
    order, chosen = sorted(edges), sorted(chosen)
    known = {e.id: e for e in order}
    need: Counter = Counter()
    for x in chosen:
        need[known[x].source] += 1
        need[known[x].target] -= 1
    if not any(need.values()):
        return chosen
    number: dict[str, int] = {}
    for e in order:
        for node in (e.source, e.target):
            number.setdefault(node, len(number))
    own, flow = set(chosen), _Flow()
    arcs = {e.id: flow.arc(number[e.source], number[e.target], CAPACITY - (e.id in own), e.meters) for e in order}
    source, sink = len(number), len(number) + 1
    for node in sorted(need):
        if need[node] > 0:  # more edges leave than come: further ones must come
            flow.arc(number[node], sink, need[node], 0)
        elif need[node] < 0:
            flow.arc(source, number[node], -need[node], 0)
    if not flow.ship(source, sink, sum(v for v in need.values() if v > 0)):
        return None
    return [x for x, k in arcs.items() for _ in range(flow.room[k ^ 1] + (x in own))]


def closed_walk(edges: Iterable[Edge], passes: list[str]) -> list[str] | None:
    """A walk that takes each pass once and ends where it began, or None; it begins at the smallest node, and the edges out of a node are taken from the largest id."""
    known = {e.id: e for e in edges}
    out = defaultdict(list)
    for x in sorted(passes):
        out[known[x].source].append(x)
    if not out:
        return None
    walk, trail = [], [(min(out), None)]
    while trail:
        node, came = trail[-1]
        if out[node]:
            x = out[node].pop()
            trail.append((known[x].target, x))
        else:
            trail.pop()
            if came is not None:
                walk.append(came)
    walk.reverse()
    sound = len(walk) == len(passes) and all(known[a].target == known[b].source for a, b in zip(walk, [*walk[1:], walk[0]], strict=True))
    return walk if sound else None


def solve_parities(anchors: dict[str, str], constraints: Iterable[tuple[str, str, str, int]]) -> tuple[dict[str, str], list[tuple[str, str, str, int]]]:
    """Sides that anchors and constraints give, and the constraints that contradict what came before them.

    constraints: (group, left, right, parity) by falling priority; parity 0 says that both are of one
    side, 1 that they are of different ones. Things that constraints connect are a component, whose
    members have the component's side or the other one; an anchor settles which.
    """
    home: dict[str, int] = {}
    turn: dict[str, int] = {}  # 0: of the component's side
    members: dict[int, list[str]] = {}
    side: dict[int, int | None] = {}

    def place(name: str) -> int:
        if name not in home:
            home[name], turn[name] = len(home), 0
            members[home[name]] = [name]
            side[home[name]] = SIDES.index(anchors[name]) if name in anchors else None
        return home[name]

    rejected = []
    for name in sorted(anchors):
        place(name)
    for group, left, right, parity in constraints:
        a, b = place(left), place(right)
        flip = turn[left] ^ turn[right] ^ parity
        if a == b:
            if flip:
                rejected.append((group, left, right, parity))
            continue
        if side[a] is not None and side[b] is not None and side[a] ^ side[b] != flip:
            rejected.append((group, left, right, parity))
            continue
        if len(members[a]) < len(members[b]):
            a, b = b, a
        if side[a] is None and side[b] is not None:
            side[a] = side[b] ^ flip
        for name in members[b]:
            home[name] = a
            turn[name] ^= flip
        members[a] += members.pop(b)
        side.pop(b)
    labels = {name: SIDES[side[k] ^ turn[name]] for name, k in home.items() if side[k] is not None}
    return labels, rejected

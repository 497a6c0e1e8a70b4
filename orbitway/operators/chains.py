"""Orders of relation members, and the first exits of a road: searches whose steps depend on what came before."""

from __future__ import annotations

import heapq
from collections import defaultdict
from typing import NamedTuple

#: States that a search for first exits expands.
EXIT_STATES = 200_000


class Member(NamedTuple):
    """A way of a relation, driven one way."""

    member: int
    way: int
    reverse: bool
    source: int
    target: int
    link: bool


class OrderError(NamedTuple):
    """What keeps a relation's members from an order, at which member, and the way that goes on outside the relation (None: nothing does)."""

    code: str
    way: int
    edge: str | None = None


def choose(members: list[Member], reverse: bool | None) -> list[Member] | OrderError:
    """One piece of each member, as the direction says; reverse None: both ways stay."""
    if reverse is None:
        return members
    fit: dict[int, Member] = {}
    for m in members:
        if m.reverse == reverse:
            fit.setdefault(m.member, m)
    for m in members:
        if m.member not in fit:
            return OrderError("no_edges_of_direction", m.way)
    return [fit[k] for k in dict.fromkeys(m.member for m in members)]


def order_members(members: list[Member], outside: list[tuple[str, int, int]], reverse: bool | None = None) -> list[list[Member]] | OrderError:
    """Directed paths that have each member once, or the first fault.

    members: by their number in the relation. A path begins at the first piece that no unused member leads
    to (or, in a circle, at the first), and goes on while just one unused member follows. Several that
    follow are a fault, unless one of them is a link: then the path ends. It also ends where none follows;
    that is a fault if an edge outside the relation (id, source, target; by id) leads to an unused member.
    """
    pieces = choose(sorted(members, key=lambda m: m.member), reverse)
    if isinstance(pieces, OrderError):
        return pieces
    by_source, by_target, edges = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, m in enumerate(pieces):
        by_source[m.source].append(i)
        by_target[m.target].append(i)
    for x, source, target in sorted(outside):
        edges[source].append((x, target))
    used: set[int] = set()
    free = lambda i, but: pieces[i].member not in used and pieces[i].member != but
    out: list[list[Member]] = []
    while unused := [i for i, m in enumerate(pieces) if m.member not in used]:
        roots = [i for i in unused if not any(free(j, pieces[i].member) for j in by_target[pieces[i].source])]
        at: int | None = (roots or unused)[0]
        path: list[Member] = []
        while at is not None:
            here = pieces[at]
            used.add(here.member)
            path.append(here)
            follow = [i for i in by_source[here.target] if free(i, here.member)]
            if len(follow) > 1 and not any(pieces[i].link for i in follow):
                return OrderError("ambiguous_branch", here.way)
            if not follow:
                for x, target in edges[here.target]:
                    if any(free(i, here.member) for i in by_source[target]):
                        return OrderError("leaves_relation", here.way, x)
            at = follow[0] if len(follow) == 1 else None
        out.append(path)
    return out


def first_exits(roads: list[tuple[str, int, int, int]], exits: list[tuple[str, int, int]], barred: list[tuple[str, ...]], anchor: int, states: int = EXIT_STATES) -> tuple[str, int | None, list[str]]:
    """('ok', metres, ids) of the nearest exits, all that are as near; or 'no_exit', or 'over_budget'.

    roads: (id, source, target, metres), exits: (id, source, metres). Paths from the anchor visit no node
    twice and hold no barred sequence of edges, the exit included; the nearest such path decides, not the
    nearest walk. A state is a node with the nodes visited and as many last edges as a sequence may need.
    """
    onward, off, last = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in roads:
        onward[r[1]].append(r)
    for x in exits:
        off[x[1]].append(x)
    for s in barred:
        last[s[-1]].append(s)
    tail = max((len(s) for s in barred), default=1) - 1

    def legal(path: tuple[str, ...], then: str) -> bool:
        whole = (*path, then)
        return not any(whole[len(whole) - len(s) :] == tuple(s) for s in last[then] if len(s) <= len(whole))

    queue: list = [(0, 0, anchor, (), frozenset([anchor]))]
    known: dict = {}
    best, found, spent, turn = None, set(), 0, 0
    while queue:
        far, _, node, path, seen = heapq.heappop(queue)
        if best is not None and far > best:
            break
        if spent >= states:
            return "over_budget", None, []
        spent += 1
        if far > known.get((node, path, seen), far):
            continue
        for x, _, meters in off[node]:
            if legal(path, x) and (best is None or far + meters <= best):
                found = {x} if best is None or far + meters < best else found | {x}
                best = far + meters
        for x, _, other, meters in onward[node]:
            if other in seen or not legal(path, x) or best is not None and far + meters >= best:
                continue
            state = (other, (*path, x)[-tail:] if tail else (), seen | {other})
            if far + meters < known.get(state, far + meters + 1):
                known[state] = far + meters
                turn += 1
                heapq.heappush(queue, (far + meters, turn, *state))
    return ("no_exit", None, []) if best is None else ("ok", best, sorted(found))

"""Labels, flows, walks, parities, orders and first exits against plain versions on small random rings."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orbitway.operators import carriageways as ways
from orbitway.operators import chains
from orbitway.operators.carriageways import Edge
from orbitway.operators.frontier import paths, reach, within
from orbitway.plans import build_queries, carriageway_queries


def graph(pick, nodes, edges):
    return [Edge(f"e{i:02}", str(pick.randrange(nodes)), str(pick.randrange(nodes)), pick.randrange(1, 9)) for i in range(edges)]


# --- growth and levelling ---


def plain_growth(edges, labels):
    out, order = dict(labels), sorted(e.id for e in edges)
    known = {e.id: e for e in edges}
    for _ in order:
        before = dict(out)
        for x in order:
            if x in out:
                continue
            e = known[x]
            for near in ([y for y in order if y != x and known[y].target == e.source], [y for y in order if y != x and known[y].source == e.target]):
                if near and all(y in out for y in near) and len({out[y] for y in near}) == 1:
                    out[x] = out[near[0]]
                    break
        if out == before:
            break
    return out


def test_growth():
    pick = random.Random(1)
    for _ in range(400):
        edges = graph(pick, pick.randrange(2, 8), pick.randrange(1, 14))
        labels = {e.id: pick.choice(ways.SIDES) for e in edges if pick.random() < 0.3}
        assert ways.grow(pick.sample(edges, len(edges)), labels) == plain_growth(edges, labels)


def test_growth_counts_at_once():
    """The edge in the middle is inner by a, and the next one, in the same round, by it; where the next one comes first it is outer by d."""
    line = lambda middle, end: [Edge("a", "0", "1", 1), Edge(middle, "1", "2", 1), Edge(end, "2", "3", 1), Edge("d", "3", "4", 1)]
    labels = {"a": "inner", "d": "outer"}
    assert ways.grow(line("b", "c"), labels) == labels | {"b": "inner", "c": "inner"}
    assert ways.grow(line("c", "b"), labels) == labels | {"c": "inner", "b": "outer"}


def plain_level(edges, labels):
    out, scores = dict(labels), [ways.imbalance(edges, labels)]
    for _ in range(ways.SWEEPS):
        moves = []
        for e in edges:
            for rank, side in enumerate((None, *ways.SIDES)):
                if side != out.get(e.id):
                    trial = {k: v for k, v in out.items() if k != e.id} | ({e.id: side} if side else {})
                    moves.append((ways.imbalance(edges, trial), e.id, rank, trial))
        best = min(moves, key=lambda m: m[:3])
        if best[0] >= scores[-1]:
            break
        out = best[3]
        scores.append(best[0])
    return out, scores


def test_levelling():
    pick = random.Random(2)
    longest = 0
    for _ in range(200):
        edges = graph(pick, pick.randrange(2, 9), pick.randrange(1, 20))
        labels = {e.id: pick.choice(ways.SIDES) for e in edges if pick.random() < 0.7}
        want, scores = plain_level(edges, labels)
        assert ways.level(pick.sample(edges, len(edges)), labels) == want
        assert scores == sorted(scores, reverse=True) and ways.imbalance(edges, want) == scores[-1]
        longest = max(longest, len(scores))
    assert longest > 4


def test_levelling_stops_after_its_sweeps():
    edges = [Edge(f"e{i:03}", f"a{i}", f"b{i}", 1) for i in range(60)]
    after = ways.level(edges, {e.id: "inner" for e in edges})
    assert sorted(after) == [f"e{i:03}" for i in range(ways.SWEEPS, 60)]


# --- flows and walks ---


def plain_balance(edges, chosen, most=3):
    """The least metres of further passes that balance all nodes, by trying all numbers of passes."""
    best = None
    for extra in itertools.product(range(most), repeat=len(edges)):
        at = Counter()
        for e, k in zip(edges, extra, strict=True):
            n = k + (e.id in chosen)
            at[e.source] += n
            at[e.target] -= n
        if not any(at.values()):
            cost = sum(e.meters * k for e, k in zip(edges, extra, strict=True))
            best = cost if best is None else min(best, cost)
    return best


def test_flow_is_the_least():
    pick = random.Random(3)
    closed = failed = 0
    for _ in range(150):
        edges = graph(pick, pick.randrange(2, 5), pick.randrange(1, 8))
        if pick.random() < 0.5:  # a parallel edge
            edges.append(edges[0]._replace(id="e99", meters=pick.randrange(1, 9)))
        chosen = {e.id for e in edges if pick.random() < 0.4}
        got, want = ways.balanced(pick.sample(edges, len(edges)), chosen), plain_balance(edges, chosen)
        if want is None:
            failed += got is None
            assert got is None or max(Counter(got).values()) > 2
            continue
        count, meters = Counter(got), {e.id: e.meters for e in edges}
        assert chosen <= set(got) and sum(meters[x] * (n - (x in chosen)) for x, n in count.items()) == want
        walk = ways.closed_walk(edges, got)
        if walk:
            closed += 1
            known = {e.id: e for e in edges}
            assert Counter(walk) == count and all(known[a].target == known[b].source for a, b in zip(walk, walk[1:] + walk[:1], strict=True))
    assert closed > 30 and failed > 20


def test_flow_prefers_the_first_of_equals():
    edges = [Edge("a", "0", "1", 5), Edge("b", "1", "0", 4), Edge("c", "1", "0", 4)]
    assert ways.balanced(edges, ["a"]) == ["a", "b"]
    assert ways.balanced(edges, ["a", "b"]) == ["a", "b"]
    assert ways.closed_walk(edges, ["a", "a", "b", "c"]) == ["a", "c", "a", "b"]
    assert ways.closed_walk([*edges, Edge("d", "8", "8", 1)], ["a", "b", "d"]) is None and ways.closed_walk(edges, []) is None
    many = [Edge(f"i{k}", "0", "1", 1) for k in range(70)] + [Edge("back", "1", "0", 1)]
    assert ways.balanced(many, [e.id for e in many[:64]]) is not None and ways.balanced(many, [e.id for e in many[:70]]) is None


# --- parities ---


def satisfiable(anchors, accepted):
    near = {}
    for _, a, b, p in accepted:
        near.setdefault(a, []).append((b, p))
        near.setdefault(b, []).append((a, p))
    side = {}
    for start in sorted({*anchors, *near}, key=lambda x: (x not in anchors, x)):
        if start in side:
            continue
        component, queue = {start: 0}, [start]
        while queue:
            x = queue.pop()
            for y, p in near.get(x, ()):
                if y not in component:
                    component[y] = component[x] ^ p
                    queue.append(y)
                elif component[y] != component[x] ^ p:
                    return None
        base = {component[x] ^ ways.SIDES.index(anchors[x]) for x in component if x in anchors}
        if len(base) > 1:
            return None
        side |= {x: (ways.SIDES[v ^ min(base)] if base else None) for x, v in component.items()}
    return {x: v for x, v in side.items() if v}


def test_parities():
    pick = random.Random(4)
    contradictions = 0
    for _ in range(400):
        names = [f"n{i}" for i in range(pick.randrange(2, 10))]
        anchors = {x: pick.choice(ways.SIDES) for x in names if pick.random() < 0.3}
        constraints = [(g, *pick.sample(names, 2), pick.randrange(2)) for g in ("chain", "opposite", "same") for _ in range(pick.randrange(7))]
        accepted, rejected = [], []
        for c in constraints:
            (rejected if satisfiable(anchors, [*accepted, c]) is None else accepted).append(c)
        labels, skipped = ways.solve_parities(anchors, constraints)
        assert skipped == rejected and labels == satisfiable(anchors, accepted)
        contradictions += len(rejected)
    assert contradictions > 200


# --- members ---


def member(k, source, target, link=False, reverse=False):
    return chains.Member(k, 100 + k, reverse, source, target, link)


def ids(found):
    return [[m.member for m in p] for p in found] if isinstance(found, list) else tuple(found)


def test_members():
    on = lambda members, outside=(), reverse=False: ids(chains.order_members(members, list(outside), reverse))
    assert on([member(2, 1, 2), member(0, 2, 3), member(1, 0, 1)]) == [[1, 2, 0]]
    assert on([member(0, 0, 1), member(1, 5, 6), member(2, 1, 2)]) == [[0, 2], [1]]
    assert on([member(1, 1, 2), member(0, 2, 0), member(2, 0, 1)]) == [[0, 2, 1]]  # a circle begins at its first member
    assert on([member(0, 0, 1), member(1, 1, 2), member(2, 1, 3)]) == ("ambiguous_branch", 100, None)
    assert on([member(0, 0, 1), member(1, 1, 2), member(2, 1, 3, link=True)]) == [[0], [1], [2]]
    assert on([member(0, 0, 1), member(1, 2, 3)], [("x", 1, 2)]) == ("leaves_relation", 100, "x")
    assert on([member(0, 0, 1), member(1, 2, 3)], [("y", 1, 9), ("x", 5, 2)]) == [[0], [1]]
    assert on([member(0, 0, 2), member(1, 1, 2), member(2, 2, 3)]) == [[0, 2], [1]]  # two lead to one: the first takes it
    assert on([member(0, 0, 1), member(1, 1, 2)], reverse=True) == ("no_edges_of_direction", 100, None)
    both = [member(0, 0, 1), member(0, 1, 0, reverse=True), member(1, 2, 1, reverse=True), member(1, 1, 2)]
    assert on(both, reverse=True) == [[1, 0]] and on(both, reverse=None) == [[0, 1]]
    assert on([]) == []


# --- first exits ---


def plain_exits(roads, exits, barred, anchor):
    found = []

    def walk(node, path, seen, far):
        bad = lambda p: any(p[i : i + len(s)] == tuple(s) for s in barred for i in range(len(p)))
        for x, source, meters in exits:
            if source == node and not bad((*path, x)):
                found.append((far + meters, x))
        for x, source, target, meters in roads:
            if source == node and target not in seen and not bad((*path, x)):
                walk(target, (*path, x), seen | {target}, far + meters)

    walk(anchor, (), {anchor}, 0)
    least = min(found, default=(None,))[0]
    return least, sorted({x for m, x in found if m == least})


def test_first_exits():
    pick = random.Random(5)
    outcomes = Counter()
    for _ in range(300):
        n = pick.randrange(2, 7)
        roads = [(f"r{i}", pick.randrange(n), pick.randrange(n), pick.randrange(1, 6)) for i in range(pick.randrange(1, 12))]
        exits = [(f"x{i}", pick.randrange(n), pick.randrange(1, 6)) for i in range(pick.randrange(3))]
        every = [r[0] for r in roads] + [x[0] for x in exits]
        barred = [tuple(pick.choice(every) for _ in range(pick.choice([2, 2, 3]))) for _ in range(pick.randrange(5))]
        outcome, meters, ids_ = chains.first_exits(roads, exits, barred, 0)
        least, want = plain_exits(roads, exits, barred, 0)
        assert (meters, ids_) == (least, want) and outcome == ("no_exit" if least is None else "ok")
        outcomes[outcome] += 1
        over = chains.first_exits(roads, exits, barred, 0, 1)
        assert over[0] in ("over_budget", outcome)
        outcomes[over[0]] += 1
    assert min(outcomes.values()) > 20 and len(outcomes) == 3


def test_no_walk_through_a_node_twice():
    """A walk that goes round a node to avoid a barred turn is shorter, but not a path that visits no node twice."""
    roads = [("a", 0, 1, 1), ("b", 1, 2, 1), ("c", 2, 1, 1), ("d", 1, 3, 10)]
    exits = [("x", 1, 1), ("y", 3, 1)]
    assert chains.first_exits(roads, exits, [("a", "x")], 0) == ("ok", 12, ["y"])


# --- rounds of joins ---


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "edge_id string, source long, target long, meters long")


def test_rounds(spark):
    pick = random.Random(6)
    rows = [(f"e{i}", pick.randrange(30), pick.randrange(30), pick.randrange(1, 20)) for i in range(40)] + [(f"l{i}", 100 + i, 101 + i, 1) for i in range(20)]
    frame = edges_of(spark, rows)
    for backward in (False, True):
        got = {r[0] for r in reach(frame, spark.createDataFrame([(3,), (100 if not backward else 120,), (None,)], "node long"), backward).collect()}
        want, level = set(), {3, 120 if backward else 100}
        while level:
            want |= level
            level = {(a if backward else b) for _, a, b, _ in rows if (b if backward else a) in level} - want
        assert got == want
        far = {(r[0], r[1]): r[2] for r in within(frame, spark.createDataFrame([("p", 3), ("q", 105), ("q", 4)], "key string, node long"), 40, backward).collect()}
        plain = {("p", 3): 0, ("q", 105): 0, ("q", 4): 0}
        for _ in range(60):
            for (key, node), d in list(plain.items()):
                for _, a, b, m in rows:
                    here, there = (b, a) if backward else (a, b)
                    if here == node and d + m <= 40 and d + m < plain.get((key, there), 99):
                        plain[key, there] = d + m
        assert far == plain


def test_paths_stop_when_enough(spark):
    """Of two lanes over eight edges there are 256 paths; a key that has two isn't searched further, and a bound ends the rest."""
    rows = [(f"{lane}{i}", i, i + 1, 1) for i in range(8) for lane in "ab"]
    start = lambda key, at: (key, at, [])
    starts = spark.createDataFrame([start(1, 0), start(2, 5), start(3, 7)], "key int, at long, path array<string>")
    run = lambda **more: paths(edges_of(spark, rows), starts, [], F.lit(True), F.col("at") == 8, F.lit(more.pop("most", 20)), {}, **more)
    assert dict(run().groupBy("key").count().collect()) == {1: 256, 2: 8, 3: 2}
    assert dict(run(most=4).groupBy("key").count().collect()) == {2: 8, 3: 2}


@pytest.mark.parametrize(
    "labels, want",
    [
        ("oiiiiiiii", "iiiiiiii"), ("ooooiiiii", "ooooiiiii"), ("aoiiiiiiiioa", "iiiiiiii"), ("roiiiiiiiior", "roiiiiiiiior"), ("rroooiiiiiiiiioooo", "iiiiiiiiioooo"), ("oo-iiiii", "-iiiii"), ("-oiiiii", "-oiiiii"), ("oi", "oi"), ("iiioo", "iii"),
        ("aooiiiiiiiiiooaa", "iiiiiiiii"), ("", ""), ("ooo", "ooo"), ("---", "---"),
    ],
)
def test_trimming(spark, labels, want):
    """The rarest label goes from both ends, then the one that is rarest now: two rounds and more."""
    runs = [(None if k == "-" else k, len(list(g))) for k, g in itertools.groupby(labels)]
    frame = spark.createDataFrame([(runs,)], "runs array<struct<label:string,n:bigint>>")
    lo, hi, _ = frame.select(build_queries.trimmed("runs").alias("part")).select("part.*").first() if runs else (0, 0, None)
    assert "".join((x or "-") * n for x, n in runs[lo:hi]) == want


def test_pairs_fill_gaps(spark):
    """Side by side flips, in line keeps; the nearest decides, a tie goes to the opposite one, and labels go on round by round."""
    shapes = [("n", "a", 0.0, 0.0, 1.0), ("n", "b", 0.0, 20.5, -1.0), ("n", "c", 250.0, 20.0, -1.0), ("n", "d", 250.0, 75.0, 1.0), ("n", "e", 900.0, 0.0, 1.0), ("m", "f", 0.0, 1.0, 1.0), ("n", "g", 0.0, -20.9, 1.0), ("n", "h", 0.0, 0.1, 0.0)]
    lanegeo = spark.createDataFrame([(n, x, 0, 0, y, px, 0.0 if d else 1.0, d) for n, x, px, y, d in shapes], "net string, edge_id string, source long, target long, y double, x double, dy double, dx double")
    carriage = spark.createDataFrame([(n, x, "inner" if x == "a" else None) for n, x, *_ in shapes], "net string, edge_id string, label string")
    got = dict(carriageway_queries.paired(carriage, lanegeo).select("edge_id", "label").collect())
    assert got == {"a": "inner", "b": "outer", "c": "outer", "d": "inner", "e": None, "f": None, "g": "inner", "h": None}


def test_whole_split(spark):
    """Two full carriageways with a label each become two walks that have every edge once."""
    n = 12
    rows = [("n", f"f:{i:02}", i, (i + 1) % n, 100, "f", i, "inner" if i == 3 else None) for i in range(n)]
    rows += [("n", f"b:{i:02}", -(i + 1) % n - 100, -i % n - 100, 100, "b", -i, "outer" if i == 5 else None) for i in range(n)]
    carriage = spark.createDataFrame(rows, "net string, edge_id string, source long, target long, meters long, segment string, turn int, label string")
    exits = spark.createDataFrame([("n", 0, "inner"), ("n", -100, "outer")], "net string, node long, direction string")
    lanegeo = spark.createDataFrame([("n", r[1], r[2], r[3], float(5000 * i), 0.0, 0.0, 1.0) for i, r in enumerate(rows)], "net string, edge_id string, source long, target long, y double, x double, dy double, dx double")
    walks = {r["side"]: r for r in carriageway_queries.r18_carriageways(carriage, exits, lanegeo).collect()}
    assert {(s, r["outcome"], r["edges"], r["meters"]) for s, r in walks.items()} == {("inner", "closed", n, 1200), ("outer", "closed", n, 1200)}
    assert all(sorted(r["walk"].split(",")) == [f"{s}:{i:02}" for i in range(n)] for s, r in zip("fb", (walks["inner"], walks["outer"]), strict=True))

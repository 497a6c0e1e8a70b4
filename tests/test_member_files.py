"""Faults of membership files, one at a time, and the hash of a file."""

import hashlib
import json

import pytest

from orbitway.plans.member_files import f10_membership_hash, membership_faults

D = "d" * 64
MEMBERS, SEGMENTS = "file string, turn long, membership string, route_id string, direction string, version string", "file string, turn long, seg long, segment string, kind string, relation string, snapshot string, evidence string, odd_hash boolean, indexes string, in_order boolean"
EDGES, KNOWN = "file string, turn long, seg long, place long, edge_id string, hashed_id string", "edge_id string, source long, target long, kind string"
NET = [("a", 1, 2, "shutoko"), ("b", 2, 3, "shutoko"), ("c", 3, 4, "shutoko"), ("x", 9, 2, "entry"), ("y", 4, 8, "exit"), ("z", 8, 7, "exit")]


def sound():
    """Two memberships: one of a relation's segment and a ramp's, one of a relation's. Each row is a dictionary."""
    members = [{"file": "f", "turn": t, "membership": f"route:{r}:inner", "route_id": r, "direction": "inner", "version": "osm-relation-role/v1"} for t, r in ((1, "C1"), (2, "B"))]
    main = {"file": "f", "kind": "relationMainline", "relation": "7", "snapshot": D, "evidence": None, "odd_hash": False, "indexes": "4,5", "in_order": True}
    ramp = main | {"kind": "boundRamp", "relation": None, "evidence": "e", "indexes": None, "in_order": None}
    segments = [main | {"turn": 1, "seg": 0, "segment": "s0"}, ramp | {"turn": 1, "seg": 1, "segment": "s1"}, main | {"turn": 2, "seg": 0, "segment": "s2", "indexes": "9,3", "in_order": False}]
    edges = [{"file": "f", "turn": t, "seg": s, "place": i, "edge_id": x, "hashed_id": x} for t, s, ids in ((1, 0, "abc"), (1, 1, "yz"), (2, 0, "bc")) for i, x in enumerate(ids)]
    return members, segments, edges


def tables(spark, members, segments, edges):
    row = lambda rows, shape: spark.createDataFrame([tuple(r[c.split()[0]] for c in shape.split(", ")) for r in rows], shape)
    return row(members, MEMBERS), row(segments, SEGMENTS), row(edges, EDGES)


def both(i, x):
    return lambda m, s, e: e[i].update(edge_id=x, hashed_id=x)


CASES = {
    "none": (lambda m, s, e: None, {}),
    "membership id": (lambda m, s, e: m[0].update(membership="x" * 257), {1: "membership id"}),
    "route id": (lambda m, s, e: m[1].update(route_id=""), {2: "route id"}),
    "direction": (lambda m, s, e: m[1].update(direction=None), {2: "direction"}),
    "other name": (lambda m, s, e: m[0].update(direction="outer"), {1: "membership"}),
    "twice": (lambda m, s, e: m[1].update(m[0] | {"turn": 2}), {2: "membership"}),
    "version": (lambda m, s, e: m[0].update(version="v0"), {1: "membership"}),
    "no segments": (lambda m, s, e: (s.pop(2), e.__delitem__(slice(5, None))), {2: "membership"}),
    "segment id": (lambda m, s, e: s[1].update(segment=""), {1: "segment id"}),
    "segment twice": (lambda m, s, e: s[2].update(segment="s0"), {2: "segment"}),
    "no edges": (lambda m, s, e: e.__delitem__(slice(5, None)), {2: "segment"}),
    "snapshot hash": (lambda m, s, e: s[0].update(snapshot="D" * 64), {1: "snapshot hash", 2: "snapshot"}),
    "edge hash": (lambda m, s, e: s[1].update(odd_hash=True), {1: "edge hash"}),
    "edges": (lambda m, s, e: e[1].update(hashed_id="q"), {1: "edges"}),
    "snapshot": (lambda m, s, e: s[2].update(snapshot="e" * 64), {2: "snapshot"}),
    "no relation": (lambda m, s, e: s[0].update(relation=None), {1: "source"}),
    "evidence": (lambda m, s, e: s[0].update(evidence="e"), {1: "source"}),
    "no evidence": (lambda m, s, e: s[1].update(evidence=None), {1: "source"}),
    "ramp with places": (lambda m, s, e: s[1].update(indexes="1", in_order=True), {1: "source"}),
    "places twice": (lambda m, s, e: s[0].update(indexes="4,4", in_order=False), {1: "source"}),
    "order": (lambda m, s, e: s[2].update(in_order=True), {2: "source"}),
    "one place": (lambda m, s, e: s[2].update(indexes="3", in_order=True), {}),
    "edge id": (both(0, ""), {1: "edge id"}),
    "edge twice": (both(2, "a"), {1: "edge twice"}),
    "edge unknown": (both(1, "q"), {1: "edge unknown"}),
    "apart": (both(1, "c"), {1: "edges apart"}),
    "ramp in mainline": (both(2, "x"), {1: "edges apart"}),
    "not mainline": (lambda m, s, e: [r.update(edge_id=x, hashed_id=x) for r, x in zip(e[5:], "yz", strict=True)], {2: "edge not mainline"}),
    "not a ramp": (lambda m, s, e: [r.update(edge_id=x, hashed_id=x) for r, x in zip(e[3:5], "ab", strict=True)], {1: "edge not a ramp"}),
    "first of several": (lambda m, s, e: (s[1].update(segment=""), e[1].update(edge_id="q", hashed_id="q")), {1: "edge unknown"}),
}


@pytest.fixture(scope="module")
def found(spark):
    """The faults of all cases, each of which is a file of its own."""
    every = [[], [], []]
    for name, (change, _) in CASES.items():
        parts = sound()
        change(*parts)
        for out, rows in zip(every, parts, strict=True):
            out += [r | {"file": name} for r in rows]
    known = spark.createDataFrame(NET, KNOWN)
    return {(r["file"], r["turn"]): r["fault"] for r in membership_faults(*tables(spark, *every), known).collect()}


@pytest.mark.parametrize("name", CASES)
def test_faults(found, name):
    assert {t: f for (file, t), f in found.items() if file == name and f} == CASES[name][1]
    assert {t for file, t in found if file == name} == {1, 2}


def test_hash(spark):
    members, segments, edges = sound()
    want = []
    for m in members:
        own = []
        for s in segments:
            if s["turn"] == m["turn"]:
                ids = [e["edge_id"] for e in edges if (e["turn"], e["seg"]) == (s["turn"], s["seg"])]
                text = {"segmentId": s["segment"], "sourceKind": s["kind"], "sourceRelationId": s["relation"], "sourceSnapshotSha256": s["snapshot"], "bindingEvidenceId": s["evidence"], "orderedEdgeIds": ids}
                text["orderedEdgeIdsSha256"] = hashlib.sha256(json.dumps(ids, separators=(",", ":")).encode()).hexdigest()
                own.append(text | ({"memberIndexes": [int(x) for x in s["indexes"].split(",")], "memberOrderMatchesRelation": s["in_order"]} if s["indexes"] else {}))
        want.append({"membershipId": m["membership"], "routeId": m["route_id"], "direction": m["direction"], "directionMappingVersion": m["version"], "segments": own})
    text = json.dumps(want, separators=(",", ":"), ensure_ascii=False)
    got = f10_membership_hash(*tables(spark, members, segments, edges)).collect()
    assert [(r["file"], r["sha256"]) for r in got] == [("f", hashlib.sha256(text.encode()).hexdigest())]

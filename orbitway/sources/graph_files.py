"""Readers and writers of the wire forms: graphs of versions 2 to 5, map extracts, requests, tariff catalogues, canonical text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGES = "array<struct<id:string, `from`:string, `to`:string, kind:string, durationSeconds:bigint, distanceMeters:bigint, name:string>>"
GRAPH = f"schemaVersion int, releaseId string, vehicleProfile string, nodeIdDeltas array<bigint>, nodes string, edges {EDGES}, forbiddenTransitions array<array<string>>"
ELEMENT = "type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string, string>, members array<struct<type:string, ref:bigint, role:string>>"
PRICE = "array<struct<status:string, tariffStatus:string, amountYen:bigint, observedDistanceMeters:bigint, effectiveFrom:string, effectiveTo:string, ruleId:string, evidenceId:string, distanceEvidenceId:string>>"
ASSIGNMENT = f"array<struct<assignmentId:string, pairIds:array<string>, entryRampId:string, exitRampId:string, billingDistanceMeters:bigint, prices:{PRICE}>>"
RULE = "array<struct<ruleId:string, distanceUnitMeters:bigint, rateMicrosYenPerUnit:bigint, terminalChargeYen:bigint, taxBasisPoints:bigint, minimumYen:bigint, maximumYen:bigint, minimumDistanceMeters:bigint, effectiveFrom:string, effectiveTo:string>>"
CATALOGUE = f"version int, documents array<struct<documentId:string, edition:string, status:string>>, tariffRules {RULE}, assignments {ASSIGNMENT}"
#: Where a graph may hold a catalogue, and where that may be nested; fields of a request, and its scope.
CATALOGUE_NAMES = ("odTariffs", "tariff", "odTariffsV3", "tariffCatalog", "tariffModel")
NESTED_NAMES = ("catalog", "tariffCatalog", "odTariffs")
REQUEST_FIELDS = ("requestId", "releaseId", "originNodeId", "origin", "entryRampId", "exitRampId", "minMinutes", "maxMinutes", "vehicleProfile", "pricingAt")
SCOPE_FIELDS = ("vehicleClass", "paymentMethod", "fareBasis", "discountsExcluded")


def read_graphs(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graphs, nodes and edges of JSON texts (column text), all versions in one form.

    graphs: release_id, version, state (ok, unsupported, or what is wrong with version 5's positions);
    nodes: release_id, pos, id, lat, lon; edges: release_id, pos, edge_id, from_node, to_node, kind,
    seconds, meters, name. Version 5 has node ids as ascending differences and edge ends as positions;
    its ends outside the nodes are null. Texts of other versions give a graph without rows.
    """
    parsed = texts.select(F.from_json("text", GRAPH, {"mode": "FAILFAST"}).alias("g")).select("g.*").withColumnsRenamed({"releaseId": "release_id", "schemaVersion": "version"})
    known, five = F.col("version").isin(2, 3, 4, 5), F.col("version") == 5
    plain = F.from_json("nodes", "array<struct<id:string, lat:double, lon:double>>")
    pairs = F.when(five, F.from_json("nodes", "array<array<double>>"))
    bent = F.size("nodeIdDeltas") != F.size(pairs)
    state = F.when(~known, "unsupported").when(five & (F.col("nodeIdDeltas").isNull() | bent), "lengths differ").when(five & F.exists("nodeIdDeltas", lambda d: d <= 0), "delta not positive").otherwise("ok")
    graphs = parsed.withColumn("state", state)
    sound = graphs.where("state = 'ok'")
    line = Window.partitionBy("release_id").orderBy("pos")
    new = sound.where(five).select("release_id", F.posexplode(F.arrays_zip(F.col("nodeIdDeltas").alias("delta"), pairs.alias("place"))).alias("pos", "n"))
    new = new.select("release_id", "pos", F.concat(F.lit("n:"), F.sum("n.delta").over(line).cast("string")).alias("id"), F.col("n.place")[0].alias("lat"), F.col("n.place")[1].alias("lon"))
    old = sound.where(~five).select("release_id", F.posexplode(plain).alias("pos", "n")).select("release_id", "pos", "n.id", "n.lat", "n.lon")
    nodes = new.unionByName(old)
    wire = sound.select("release_id", "version", F.posexplode("edges").alias("pos", "e")).select("release_id", "version", "pos", "e.*")
    rest = F.col("id").alias("edge_id"), "kind", F.col("durationSeconds").alias("seconds"), F.col("distanceMeters").alias("meters"), "name"
    as_is = wire.where(~five).select("release_id", "pos", *rest, F.col("from").alias("from_node"), F.col("to").alias("to_node"))
    end = lambda k: new.select("release_id", F.col("pos").cast("string").alias(k), F.col("id").alias(f"{k}_node"))
    decoded = wire.where(five).join(end("from"), ["release_id", "from"], "left").join(end("to"), ["release_id", "to"], "left").select("release_id", "pos", *rest, "from_node", "to_node")
    return graphs.select("release_id", "version", "state"), nodes, as_is.unionByName(decoded)


def write_graphs(nodes: DataFrame, edges: DataFrame, version: int, profile: str) -> DataFrame:
    """release_id, text: graphs of version 4 or 5 as JSON. nodes: release_id, id ('n:' and a number), lat, lon; edges as read_graphs gives them.

    Nodes come in the order of their numbers, edges by id; version 5 has differences and positions.
    """
    number = F.substring("id", 3, 20).cast("long")
    line = Window.partitionBy("release_id").orderBy("number")
    placed = nodes.withColumn("number", number).withColumns({"pos": F.row_number().over(line) - 1, "delta": F.col("number") - F.coalesce(F.lag("number").over(line), F.lit(0).cast("long"))})
    ordered = lambda c, *k: F.transform(F.array_sort(F.collect_list(F.struct(*k, c.alias("value")))), lambda x: x["value"])
    if version == 5:
        end = lambda k: placed.select("release_id", F.col("id").alias(f"{k}_node"), F.col("pos").alias(k))
        edges = edges.join(end("from"), ["release_id", "from_node"]).join(end("to"), ["release_id", "to_node"])
        own = placed.groupBy("release_id").agg(ordered(F.col("delta"), "pos").alias("nodeIdDeltas"), ordered(F.array("lat", "lon"), "pos").alias("nodes"))
    else:
        edges = edges.withColumns({"from": F.col("from_node"), "to": F.col("to_node")})
        own = placed.groupBy("release_id").agg(ordered(F.struct("id", "lat", "lon"), "pos").alias("nodes"))
    edge = F.struct(F.col("edge_id").alias("id"), "from", "to", "kind", F.col("seconds").alias("durationSeconds"), F.col("meters").alias("distanceMeters"), "name")
    lists = edges.groupBy("release_id").agg(ordered(edge, "edge_id").alias("edges"))
    fields = ["nodeIdDeltas"] * (version == 5) + ["nodes", "edges"]
    whole = own.join(lists, "release_id")
    empty = F.from_json(F.lit("[]"), "array<string>")
    return whole.select("release_id", F.to_json(F.struct(F.lit(version).alias("schemaVersion"), F.col("release_id").alias("releaseId"), F.lit(profile).alias("vehicleProfile"), *fields, empty.alias("billingPairs"))).alias("text"))


def read_elements(texts: DataFrame) -> DataFrame:
    """Elements of map extracts (column text: an object with `elements`), one row each; absent parts are null."""
    return texts.select(F.explode(F.from_json("text", f"elements array<struct<{_fields(ELEMENT)}>>", {"mode": "FAILFAST"})["elements"]).alias("e")).select("e.*")


def _fields(ddl: str) -> str:
    """A column list in the form of a struct's."""
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl).simpleString()[7:-1]


def tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def catalogue_state(text: str = "text") -> Column:
    """none, one or multiple: under how many of its names a graph holds a catalogue, at once or nested; invalid where one but the last isn't an object."""
    found, wrong = [], []
    for name in CATALOGUE_NAMES:
        value = F.get_json_object(text, f"$.{name}")
        at = lambda p, n=name: F.get_json_object(text, f"$.{n}{p}")
        both = lambda p: at(f"{p}.assignments").isNotNull() & at(f"{p}.tariffRules").isNotNull()  # noqa: B023, E731
        held = F.when(at(f".{NESTED_NAMES[0]}").isNotNull(), both(f".{NESTED_NAMES[0]}")).when(at(f".{NESTED_NAMES[1]}").isNotNull(), both(f".{NESTED_NAMES[1]}")).when(at(f".{NESTED_NAMES[2]}").isNotNull(), both(f".{NESTED_NAMES[2]}")).otherwise(both(""))
        found.append(F.coalesce(held, F.lit(False)).cast("int"))
        if name not in ("tariffModel", "odTariffs"):
            wrong.append(F.coalesce(~value.startswith("{"), F.lit(False)))
    n = sum(found[1:], found[0])
    bad = wrong[0]
    for w in wrong[1:]:
        bad = bad | w
    return F.when(bad, "invalid").when(n == 0, "none").when(n == 1, "one").otherwise("multiple")


def request_state(text: str, scope: dict[str, str]) -> Column:
    """ok, or what keeps a request's text from being one: no object, a field that it can't have, or a scope other than the product's."""
    fields = F.from_json(text, "map<string, string>")
    strange = F.filter(F.map_keys(fields), lambda k: ~k.isin(*REQUEST_FIELDS, *SCOPE_FIELDS))
    differs = F.lit(False)
    for name, value in scope.items():
        own = F.try_element_at(fields, F.lit(name))
        differs = differs | F.coalesce(own != value, F.lit(False))
    return F.when(fields.isNull() | F.get_json_object(text, "$").isNull(), "invalid JSON").when(differs, "unsupported scope").when(F.size(strange) > 0, "unknown field").otherwise("ok")


def read_catalogues(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules, assignments and prices of tariff catalogues (columns name and text), a row each."""
    parsed = texts.select("name", F.from_json("text", CATALOGUE, {"mode": "FAILFAST"}).alias("c"))
    rules = parsed.select("name", F.explode("c.tariffRules").alias("r")).select("name", "r.*")
    assignments = parsed.select("name", F.explode("c.assignments").alias("a")).select("name", "a.*")
    prices = assignments.select("name", "assignmentId", "billingDistanceMeters", F.posexplode("prices").alias("turn", "p")).select("name", "assignmentId", "billingDistanceMeters", "turn", "p.*")
    return rules, assignments.drop("prices"), prices


def canonical_list(items: Column) -> Column:
    """An array of strings as canonical text: a line each, two spaces in, a line break at the end."""
    return F.concat(F.lit("[\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit('  "'), x, F.lit('"'))), ",\n"), F.lit("\n]\n"))

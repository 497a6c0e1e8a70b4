"""Queries over documents in wire form: written from the road tables, and read again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitway.functions import geo
from orbitway.functions.dialect import DUCK
from orbitway.operators.validate import graph_violation
from orbitway.sources import graph_files as files
from orbitway.sources.networks import PROFILE, graphs, road
from orbitway.sources.road import with_tables

QUERIES, ORACLE = {}, {}
# The product's scope of requests.
SCOPE = {"vehicleClass": "ordinary", "paymentMethod": "etc", "fareBasis": "base_toll_excluding_discounts", "discountsExcluded": "true"}


def query(*tables: str, sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = with_tables(tables, sql, DUCK)
        return f

    return add


def _extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map extract a hundred ways: nodes, ways with tags, and relations, as JSON text."""
    node, way, waynode, member = road(spark, sf_dir, "node", "way", "waynode", "member")
    null = lambda kind: F.lit(None).cast(kind)
    plain = {"type": null("string"), "id": null("long"), "lat": null("double"), "lon": null("double"), "nodes": null("array<long>"), "tags": null("map<string,string>"), "members": null("array<struct<type:string,ref:long,role:string>>")}
    element = lambda **parts: F.struct(*(parts.get(k, v).alias(k) for k, v in plain.items()))
    points = node.select(F.expr("id div 100").alias("part"), element(type=F.lit("node"), id=F.col("id"), lat=F.col("lat"), lon=F.col("lon")).alias("e"))
    lines = waynode.groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("nodes")).join(way, F.col("way") == F.col("id"))
    tags = F.map_filter(F.create_map(*(x for c in ("highway", "service", "oneway", "ref", "name") for x in (F.lit(c), F.col(c)))), lambda _, v: v.isNotNull())
    ways = lines.select(F.expr("id div 100").alias("part"), element(type=F.lit("way"), id=F.col("id"), nodes=F.col("nodes"), tags=tags).alias("e"))
    members = member.groupBy("relation").agg(F.min("way").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind", "way", "role"))), lambda x: F.struct(x["kind"].alias("type"), x["way"].alias("ref"), x["role"].alias("role"))).alias("members"))
    relations = members.select(F.expr("first div 100").alias("part"), element(type=F.lit("relation"), id=F.col("first"), members=F.col("members"), tags=F.create_map(F.lit("type"), F.lit("route"))).alias("e"))
    return points.unionByName(ways).unionByName(relations).groupBy("part").agg(F.collect_list("e").alias("elements")).select(F.to_json(F.struct("elements")).alias("text"))


@query("way", "waynode", "member", "node", sql="""select 'node' as type, id, null as highway, 0 as parts, round(lat, 6) as lat from node union all select 'way', w.id, w.highway, (select count(*) from waynode n where n.way = w.id), null from way w
union all select 'relation', min(way), null, count(*), null from member group by relation""")
def s01_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of map extracts, whatever their kind, with a tag by name, and how many nodes or members they have."""
    found = files.read_elements(_extract(spark, sf_dir))
    parts = F.when(F.col("type") == "node", F.lit(0)).otherwise(F.size(F.coalesce(F.col("nodes"), F.transform("members", lambda m: m["ref"]))))
    return found.select("type", "id", files.tag("highway").alias("highway"), parts.cast("long").alias("parts"), F.round("lat", 6).alias("lat"))


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mainline of each network: version 5 where the anchor is odd, else 4."""
    net, node = road(spark, sf_dir, "net", "node")
    name = lambda c: F.concat(F.lit("n:"), F.col(c).cast("string"))
    nodes = net.join(node, "id").select(F.col("net").alias("release_id"), name("id").alias("id"), "lat", "lon", "anchor")
    ends = net.where("next_id is not null").select(F.col("net").alias("release_id"), "anchor", F.concat(F.lit("e:"), F.col("id").cast("string")).alias("edge_id"), name("id").alias("from_node"), name("next_id").alias("to_node"), F.lit("shutoko").alias("kind"), F.col("secs").alias("seconds"), "meters", F.lit(None).cast("string").alias("name"))
    texts = [files.write_graphs(nodes.where(f"anchor % 2 = {k}").drop("anchor"), ends.where(f"anchor % 2 = {k}").drop("anchor"), version, PROFILE) for k, version in ((0, 4), (1, 5))]
    return texts[0].unionByName(texts[1]).select("text")


@query("net", sql="select net as release_id, case when anchor % 2 = 1 then 5 else 4 end::int as version, concat('e:', cast(id as varchar)) as edge_id, concat('n:', cast(id as varchar)) as from_node, concat('n:', cast(next_id as varchar)) as to_node, secs as seconds, meters from net where next_id is not null")
def s03_read_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of graphs of versions 4 and 5, written and read again: ends as node ids in both."""
    found, _, edges = files.read_graphs(_wire(spark, sf_dir))
    return edges.join(found, "release_id").select("release_id", "version", "edge_id", "from_node", "to_node", "seconds", "meters")


@query("net", "node", sql="select k.net as release_id, concat('n:', cast(k.id as varchar)) as id, cast(row_number() over (partition by k.net order by k.id) - 1 as int) as pos, round(n.lat, 6) as lat, round(n.lon, 6) as lon from net k join node n on n.id = k.id where exists (select 1 from net o where o.net = k.net and o.next_id is not null)")
def s14_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of written graphs, in their order."""
    return files.read_graphs(_wire(spark, sf_dir))[1].select("release_id", "id", F.col("pos").cast("int").alias("pos"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("net", sql="select net as release_id, case anchor % 7 when 0 then 'none' when 1 then 'one' when 2 then 'one' when 3 then 'multiple' when 4 then 'invalid' when 5 then 'none' else 'one' end as state from net where pos = 0")
def s09_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under how many names a graph holds a tariff catalogue: itself or nested; one without rules is none."""
    net, = road(spark, sf_dir, "net")
    whole = '{"assignments":[],"tariffRules":[]}'
    forms = ['{"nodes":[]}', f'{{"tariff":{whole}}}', f'{{"tariffModel":{{"catalog":{whole}}}}}', f'{{"tariff":{whole},"tariffCatalog":{whole}}}', '{"tariffCatalog":"text"}', '{"odTariffs":[{"a":1}],"tariff":{"assignments":[]}}', f'{{"odTariffsV3":{{"odTariffs":{whole}}},"tariffModel":"x"}}']
    text = F.array(*map(F.lit, forms))[(F.col("anchor") % 7).cast("int")]
    return net.where("pos = 0").select(F.col("net").alias("release_id"), text.alias("text")).select("release_id", files.catalogue_state().alias("state"))


@query("request", sql="select request_id, case request_id % 6 when 0 then 'ok' when 1 then 'ok' when 2 then 'unsupported scope' when 3 then 'unknown field' when 4 then 'unsupported scope' else 'invalid JSON' end as state from request")
def s10_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request texts: the four scope fields are split off and must be the product's; other fields must be known."""
    asked, = road(spark, sf_dir, "request")
    ends = ["}", ',"vehicleClass":"ordinary","discountsExcluded":true}', ',"paymentMethod":"cash"}', ',"speed":1}', ',"discountsExcluded":false}', ""]
    text = F.concat(F.lit('{"requestId":"'), F.col("request_id").cast("string"), F.lit('","minMinutes":1'), F.array(*map(F.lit, ends))[(F.col("request_id") % 6).cast("int")])
    return asked.select("request_id", text.alias("text")).select("request_id", files.request_state("text", SCOPE).alias("state"))


_FARE = geo.fare_yen("a.billed", "u", "//")


@query("assignment", "rule", sql=f"select cast(a.assignment_id as varchar) as assignment_id, 'TARIFF_PRICE_CALCULATION_MISMATCH' as code from assignment a where a.assignment_id % 10 = 0 and a.status = 'priced' union all select cast(a.assignment_id as varchar), 'TARIFF_RULE_UNKNOWN' from assignment a where a.assignment_id % 11 = 0 and a.status = 'priced' and a.assignment_id % 10 <> 0")
def v08_tariff_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of catalogues, written as JSON and read again, whose rule isn't there or gives another fare. Every tenth is made wrong, every eleventh names no rule."""
    assignment, rules = road(spark, sf_dir, "assignment", "rule")
    fare = F.expr(geo.fare_yen("billed", "u", "div").replace("u.", ""))
    right = assignment.join(F.broadcast(rules.drop("from_at", "to_at")), "rule_id").withColumn("fare", fare)
    wrong = F.col("fare") + F.when(F.col("assignment_id") % 10 == 0, 10).otherwise(0)
    name = F.when((F.col("assignment_id") % 11 == 0) & (F.col("assignment_id") % 10 != 0), "none").otherwise(F.col("rule_id"))
    price = F.struct(F.col("status"), F.col("status").alias("tariffStatus"), F.when(F.col("status") == "priced", wrong).alias("amountYen"), F.lit("2026-01-01T00:00:00Z").alias("effectiveFrom"), name.alias("ruleId"))
    item = F.struct(F.col("assignment_id").cast("string").alias("assignmentId"), F.array("pair_id").alias("pairIds"), F.col("entry").alias("entryRampId"), F.col("exit").alias("exitRampId"), F.col("billed").alias("billingDistanceMeters"), F.array(price).alias("prices"))
    lists = right.withColumn("name", F.expr("assignment_id div 1000")).groupBy("name").agg(F.collect_list(item).alias("assignments"))
    wire = F.struct(F.col("rule_id").alias("ruleId"), F.col("unit").alias("distanceUnitMeters"), F.col("rate").alias("rateMicrosYenPerUnit"), F.col("terminal").alias("terminalChargeYen"), F.col("tax").alias("taxBasisPoints"), F.col("least").alias("minimumYen"), F.col("most").alias("maximumYen"), F.col("zone").alias("minimumDistanceMeters"))
    every = rules.agg(F.collect_list(wire).alias("tariffRules"))  # one row
    texts = lists.join(F.broadcast(every), F.lit(True)).select(F.col("name").cast("string").alias("name"), F.to_json(F.struct(F.lit(3).alias("version"), "tariffRules", "assignments")).alias("text"))
    read_rules, _, prices = files.read_catalogues(texts)
    known = read_rules.select("name", F.col("ruleId").alias("rule_id"), F.col("distanceUnitMeters").alias("unit"), F.col("rateMicrosYenPerUnit").alias("rate"), F.col("terminalChargeYen").alias("terminal"), F.col("taxBasisPoints").alias("tax"), F.col("minimumYen").alias("least"), F.col("maximumYen").alias("most"), F.col("minimumDistanceMeters").alias("zone"), F.lit(10).cast("long").alias("multiple"))
    asked = prices.where("status = 'priced'").withColumnRenamed("ruleId", "rule_id").withColumn("billed", F.coalesce("observedDistanceMeters", "billingDistanceMeters"))
    checked = asked.join(known.withColumn("known", F.lit(True)), ["name", "rule_id"], "left").withColumn("fare", fare)
    code = F.when(F.col("known").isNull(), "TARIFF_RULE_UNKNOWN").when(F.col("fare") != F.col("amountYen"), "TARIFF_PRICE_CALCULATION_MISMATCH")
    return checked.select(F.col("assignmentId").alias("assignment_id"), code.alias("code")).where("code is not null")


@query("net", sql="select net as release_id, case anchor % 8 when 1 then 'edge' when 2 then 'node place' when 3 then 'node id' when 4 then 'prices overlap' when 5 then 'pair' when 6 then 'header' when 7 then 'forbidden sequence' end as violation from net where pos = 0")
def v01_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a graph breaks. Seven of eight are made wrong: a weight of zero, a place off the earth, a node twice, prices that overlap, a pair of another profile, a version, a sequence that doesn't join."""
    changes = [("", ""), ('"durationSeconds":30', '"durationSeconds":0'), ('"lat":35.', '"lat":95.'), ('"id":"o:', '"id":"n:'), ('"effectiveTo":"2026-10-01T', '"effectiveTo":"2026-11-01T'), ('"verified","vehicleProfile":"', '"verified","vehicleProfile":"x'), ('"schemaVersion":2', '"schemaVersion":7'), ('"forbiddenTransitions":[', '"forbiddenTransitions":[["en:0","en:0"]],"before":[')]
    net, = road(spark, sf_dir, "net")
    anchors = net.where("pos = 0").select(F.col("net").alias("release_id"), "anchor")
    which = (F.col("anchor") % len(changes)).cast("int")
    old, new = (F.array(*(F.lit(c[k]) for c in changes))[which] for k in (0, 1))
    texts = graphs(spark, sf_dir).join(anchors, "release_id").select("release_id", F.when(which == 0, F.col("graph")).otherwise(F.replace("graph", old, new)).alias("graph"))
    return _violations(texts)


def _violations(texts: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for b in batches:
            found = [graph_violation(json.loads(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["release_id", "violation"])

    return texts.select("release_id", "graph").mapInArrow(run, "release_id string, violation string")


@query("edge", sql="select route, sha256(concat('[\n', string_agg(concat('  \"', edge_id, '\"'), ',\n' order by edge_id), '\n]\n')) as sha256, count(*) as lines from edge group by route")
def s13_canonical_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge ids of a route as canonical text (sorted, a line each, a line break at the end), by its hash."""
    edge, = road(spark, sf_dir, "edge")
    lists = edge.groupBy("route").agg(F.array_sort(F.collect_list("edge_id")).alias("ids"))
    return lists.select("route", F.sha2(files.canonical_list(F.col("ids")), 256).alias("sha256"), F.size("ids").cast("long").alias("lines"))


@query("ramp", "edge", sql="select r.ramp_id, r.name, r.kind, e.edge_id, case when e.edge_id is null then 'unbound' else 'bound' end as state from ramp r left join edge e on e.source = r.id and r.status = 'active' and r.id % 5 <> 0")
def s16_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of ramps: every one of the inventory, with its edge where one is bound to it."""
    ramp, edge = road(spark, sf_dir, "ramp", "edge")
    bound = edge.where("source % 5 <> 0").select(F.col("source").alias("id"), "edge_id")
    both = ramp.join(bound, "id", "left").withColumn("edge_id", F.when(F.col("status") == "active", F.col("edge_id")))
    return both.select("ramp_id", "name", "kind", "edge_id", F.when(F.col("edge_id").isNull(), "unbound").otherwise("bound").alias("state"))

"""Queries of evidence, graph and navigation, on evidence made from the star schema: every lineitem is evidence for its supplier,
its part and the fact that one supplies the other, inactive when returned; orders give customers' priorities."""

import pyspark.sql.functions as F

from millrace.operators import evidence as E
from millrace.operators import navigate as N
from millrace.plans.text import table


def evidence(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").filter("l_partkey is not null")
    supplier, part = F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("P"), "l_partkey")
    base = [F.concat(F.lit("o"), "l_orderkey").alias("chunk_hash"), (F.col("l_returnflag") != "R").alias("active"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_linenumber").alias("ordinal")]
    ends = [supplier.alias("subject_name"), F.lit("Supplier").alias("subject_type"), E.entity_key(F.lit("Supplier"), supplier).alias("subject_key"), part.alias("object_name"), F.lit("Part").alias("object_type"), E.entity_key(F.lit("Part"), part).alias("object_key")]
    entity = lambda kind, name: items.select(*base, F.lit("ENTITY").alias("evidence_type"), F.lit(kind).alias("entity_type"), name.alias("entity_name"), E.entity_key(F.lit(kind), name).alias("entity_key"))
    fact = items.select(*base, F.lit("FACT").alias("evidence_type"), E.predicate_key(F.lit(" supplies part ")).alias("predicate"), *ends)
    orders = table(spark, sf_dir, "orders")
    customer = F.concat(F.lit("C"), "o_custkey")
    attribute = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("chunk_hash"), (F.col("o_orderstatus") != "P").alias("active"), F.lit(0.5).alias("confidence"), F.lit(0).alias("ordinal"), F.lit("ENTITY_ATTRIBUTE").alias("evidence_type"), E.entity_key(F.lit("Customer"), customer).alias("entity_key"), F.lit("priority").alias("attr_key"), F.col("o_orderpriority").alias("attr_value"))
    return entity("Supplier", supplier).unionByName(entity("Part", part)).unionByName(fact, allowMissingColumns=True).unionByName(attribute, allowMissingColumns=True)


EV = """
li as (select 'o' || l_orderkey as ch, 'S' || l_suppkey as s, 'P' || l_partkey as p, l_returnflag <> 'R' as active, 1 - l_discount as conf, l_orderkey from lineitem),
ev as (select 'ENTITY' as t, 'supplier:' || s as k, ch, active, l_orderkey as o from li union all select 'ENTITY', 'part:' || p, ch, active, l_orderkey from li
       union all select 'FACT', 'supplier:' || s || '|SUPPLIES_PART|part:' || p, ch, active, l_orderkey from li
       union all select 'ENTITY_ATTRIBUTE', 'customer:C' || o_custkey || '|priority|' || o_orderpriority, 'o' || o_orderkey, o_orderstatus <> 'P', o_orderkey from orders)"""


def responses(spark, sf_dir):
    """Extractor answers about suppliers in five shapes."""
    s = table(spark, sf_dir, "supplier")
    item = F.concat(F.lit('{"evidence_type": "entity", "entity_type": " Supplier ", "entity_name": "'), "s_name", F.lit('"}'))
    fact = F.concat(F.lit('{"evidence_type": "Fact", "subject_type": "Supplier", "subject_name": "'), "s_name", F.lit('", "predicate": "located in", "object_type": "Nation", "object_name": "'), "s_nationkey", F.lit('", "confidence": 0.8}'))
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))
    kind = F.col("s_suppkey") % 6
    body = F.when(kind == 0, F.concat(F.lit("["), item, F.lit(", "), fact, F.lit("]"))).when(kind == 1, item).when(kind == 2, quoted(F.concat(F.lit("["), fact, F.lit("]")))).when(kind == 3, F.concat(F.lit("["), item, F.lit(", "), quoted(fact), F.lit("]"))).when(kind == 4, F.lit("7"))
    text = F.when(body.isNull(), F.lit("no json {broken")).otherwise(F.concat(F.lit('Sure:\n{"evidence_items": '), body, F.lit("}\ndone")))
    return s.select(F.col("s_suppkey").cast("string").alias("chunk_hash"), text.alias("response"))


def g1_parsed(spark, sf_dir):
    return E.parse_items(responses(spark, sf_dir)).groupBy("chunk_hash").agg(F.count("*").alias("items"))


def g2_typed(spark, sf_dir):
    rows = E.typed(E.parse_items(responses(spark, sf_dir)))
    return rows.select("chunk_hash", "evidence_type", F.coalesce("entity_key", F.concat_ws("|", "subject_key", "predicate", "object_key")).alias("key"), "confidence")


def g3_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = E.entity_key(F.concat(F.lit("  "), "p_type", F.lit(" ")), F.concat(F.lit(" "), "p_name"))
    return p.select("p_partkey", k.alias("entity_key"), E.fact_key(k, F.lit(" made by "), F.col("p_brand")).alias("fact_key"))


def g4_affected(spark, sf_dir):
    return E.affected(evidence(spark, sf_dir))


def dropped(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("chunk_hash"))


def g5_deactivated(spark, sf_dir):
    after, keys = E.deactivate(evidence(spark, sf_dir), dropped(spark, sf_dir))
    return keys.join(E.support(after), ["affected_type", "affected_key"], "left").fillna(0, ["support_count"])


def g6_support(spark, sf_dir):
    return E.support(evidence(spark, sf_dir))


def g7_applied(spark, sf_dir):
    before = evidence(spark, sf_dir)
    after, keys = E.deactivate(before, dropped(spark, sf_dir))
    return E.apply_counts(E.support(before), E.support(after), keys)


def g8_tasks(spark, sf_dir):
    _, keys = E.deactivate(evidence(spark, sf_dir), dropped(spark, sf_dir))
    return E.sync_tasks(keys, F.lit("d1"))


def priorities(spark, sf_dir):
    return E.attribute_values(evidence(spark, sf_dir).filter("evidence_type = 'ENTITY_ATTRIBUTE'"))


def g9_primary(spark, sf_dir):
    return priorities(spark, sf_dir).filter("is_primary").select("entity_key", "attr_key", "attr_value", "support_count", "confidence")


def g10_candidates(spark, sf_dir):
    return priorities(spark, sf_dir).select("entity_key", "attr_value", "support_count", "place", "is_primary")


def g11_entity_index(spark, sf_dir):
    return E.entity_records(evidence(spark, sf_dir))


def g12_relation_index(spark, sf_dir):
    return E.relation_records(evidence(spark, sf_dir)).select("subject", "object", "text")


def g14_stats(spark, sf_dir):
    return E.graph_stats(evidence(spark, sf_dir))


def g16_entities(spark, sf_dir):
    return E.entities(evidence(spark, sf_dir))


def g17_purge(spark, sf_dir):
    nodes = E.support(evidence(spark, sf_dir).withColumn("active", F.lit(True))).join(E.support(evidence(spark, sf_dir)).withColumnRenamed("support_count", "live"), ["affected_type", "affected_key"], "left")
    return nodes.select("affected_type", "affected_key", F.col("live").isNull().alias("purged"))


def g18_by_type(spark, sf_dir):
    rows = evidence(spark, sf_dir).filter("active").withColumn("bucket", F.substring("chunk_hash", 1, 2))
    return rows.rollup("bucket", "evidence_type").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")).select(F.coalesce("bucket", F.lit("all")).alias("bucket"), F.coalesce("evidence_type", F.lit("all")).alias("evidence_type"), "n", "level")


def g19_migrated(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    old = s.filter("s_suppkey % 2 = 0").select(F.upper("s_name").alias("name"), F.lit("Supplier").alias("type"))
    links = s.select(F.col("s_name").alias("subject"), F.when(F.col("s_suppkey") % 3 == 0, "is in").alias("predicate"), F.concat(F.lit("n"), "s_nationkey").alias("object"))
    return E.migrate(old, links).select("evidence_type", F.coalesce("entity_key", "subject_key").alias("key"), "predicate", "object_key", "confidence")


def g20_consistency(spark, sf_dir):
    stored = E.support(evidence(spark, sf_dir)).withColumn("support_count", F.when(F.col("affected_key").endswith("7"), F.col("support_count") + 1).otherwise(F.col("support_count"))).filter(~F.col("affected_key").endswith("33"))
    return E.inconsistent(evidence(spark, sf_dir), stored)


def edges(spark, sf_dir):
    """supplier LOCATED_IN nation, nation PART_OF region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S"), "s_suppkey").alias("subject"), F.lit("LOCATED_IN").alias("predicate"), F.col("n_name").alias("object"))
    both = s.unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.lit("PART_OF").alias("predicate"), F.col("r_name").alias("object")))
    return both.select(F.concat_ws("|", "subject", "predicate", "object").alias("fact_key"), "*")


EDGES = """
ed as (select 'S' || s_suppkey as s, 'LOCATED_IN' as p, n_name as o from supplier join nation on s_nationkey = n_nationkey union all select n_name, 'PART_OF', r_name from nation join region on n_regionkey = r_regionkey),
bi as materialized (select s || '|' || p || '|' || o as f, s as a, p, o as b from ed union all select s || '|' || p || '|' || o, o, p, s from ed)"""


def starts(spark, sf_dir):
    names = edges(spark, sf_dir).select(F.col("subject").alias("name"), F.when(F.col("subject").startswith("S"), F.concat(F.lit("Supplier:Nation_"), F.substring("subject", -2, 2))).otherwise(F.concat(F.lit("nation:"), "subject")).alias("entity_key")).distinct()
    terms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("ation_"), "n_nationkey").alias("term"))
    return N.seeds(names, terms)


def h1_seeds(spark, sf_dir):
    return starts(spark, sf_dir)


def hops(spark, sf_dir):
    return N.k_hops(edges(spark, sf_dir), starts(spark, sf_dir))


def h2_hops(spark, sf_dir):
    return hops(spark, sf_dir).select("query_id", "seed", "target", "distance", F.array_join("relations", ",").alias("relations"), "path")


def h3_shortest(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    goal = n.select((F.col("n_nationkey") + 5).alias("near"), F.col("n_name").alias("goal"))  # five further on
    pairs = n.withColumn("near", F.when(F.col("n_nationkey") < 5, F.col("n_nationkey") + F.lit(25)).otherwise(F.col("n_nationkey"))).join(goal, "near").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("source"), "goal")
    return N.shortest_paths(edges(spark, sf_dir), pairs)


def h4_expanded(spark, sf_dir):
    return hops(spark, sf_dir).dropDuplicates(["query_id", "path"]).groupBy("query_id").agg(F.count("*").alias("paths"), F.count_distinct("target").alias("targets"))


def h5_relevant(spark, sf_dir):
    return N.relevant(hops(spark, sf_dir)).select("query_id", "path")


def names(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(F.filter(F.split("text", " "), lambda w: F.length(w) >= 12)).alias("name")).distinct()


def h7_mentions(spark, sf_dir):
    return N.mentions(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), names(spark, sf_dir))


def i3_enriched_query(spark, sf_dir):
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("query"))
    return N.enriched_query(asked, hops(spark, sf_dir).select("query_id", F.col("target").alias("name")))


def i5_graph_context(spark, sf_dir):
    return N.graph_context(hops(spark, sf_dir))


QUERIES = {f.__name__: f for f in (g1_parsed, g2_typed, g3_keys, g4_affected, g5_deactivated, g6_support, g7_applied, g8_tasks, g9_primary, g10_candidates, g11_entity_index, g12_relation_index, g14_stats, g16_entities, g17_purge, g18_by_type, g19_migrated, g20_consistency, h1_seeds, h2_hops, h3_shortest, h4_expanded, h5_relevant, h7_mentions, i3_enriched_query, i5_graph_context)}

HOPS = EDGES + """,
st as (select n_nationkey::bigint as query_id, s as seed from nation, (select distinct s from ed) where contains(lower(s), 'ation_' || n_nationkey) or contains(lower(case when s like 'S%' then 'Supplier:Nation_' || right(s, 2) else 'nation:' || s end), 'ation_' || n_nationkey)),
h1 as (select query_id, seed, b as target, 1 as distance, p as relations, f as used, seed || ' -[' || p || ']-> ' || b as path from st join bi on a = seed),
h2 as (select query_id, seed, b, 2, relations || ',' || p, used, path || ' -[' || p || ']-> ' || b from h1 join bi on a = target where f <> used),
hp as materialized (select * exclude (used) from (select * from h1 union all select * from h2) where seed <> target qualify row_number() over (partition by query_id, seed order by distance, target, path) <= 50)"""
PRIORITY = "pr as (select 'customer:C' || o_custkey as entity_key, o_orderpriority as attr_value, count(*) as support_count, row_number() over (partition by o_custkey order by count(*) desc, o_orderpriority) as place from orders where o_orderstatus <> 'P' group by o_custkey, o_orderpriority)"
DROPPED = "gone as (select t, k, ch, active, active and o % 7 <> 0 as live from ev)"
ENTITIES = EV + ", en as (select k as entity_key, split_part(k, ':', 2) as name, case when k like 'supplier%' then 'Supplier' else 'Part' end as type, count(*) as support_count from ev where t = 'ENTITY' and active group by k)"

SQL = {
    "g1_parsed": "select s_suppkey::varchar as chunk_hash, case when s_suppkey % 6 in (0, 3) then 2 else 1 end::bigint as items from supplier where s_suppkey % 6 < 4",
    "g2_typed": "select s_suppkey::varchar as chunk_hash, 'ENTITY' as evidence_type, 'supplier:' || s_name as key, 0.5::double as confidence from supplier where s_suppkey % 6 in (0, 1, 3) union all select s_suppkey::varchar, 'FACT', 'supplier:' || s_name || '|LOCATED_IN|nation:' || s_nationkey, 0.8 from supplier where s_suppkey % 6 in (0, 2, 3)",
    "g3_keys": "select p_partkey, lower(p_type) || ':' || p_name as entity_key, lower(p_type) || ':' || p_name || '|MADE_BY|' || p_brand as fact_key from part",
    "g4_affected": f"with {EV} select distinct t as affected_type, k as affected_key from ev",
    "g5_deactivated": f"with {EV}, {DROPPED} select t as affected_type, k as affected_key, sum(live::int)::bigint as support_count from gone group by 1, 2 having bool_or(active and not live)",
    "g6_support": f"with {EV} select t as affected_type, k as affected_key, count(*) as support_count from ev where active group by 1, 2",
    "g7_applied": f"with {EV}, {DROPPED} select t as affected_type, k as affected_key, count(*) as support_count from gone where live group by 1, 2",
    "g8_tasks": f"with {EV}, {DROPPED} select sha256(concat_ws(chr(31), 'd1', '1', t, k)) as task_id, 'd1' as doc_id, 1 as doc_version, k as affected_key, t as affected_type, 'UPSERT' as operation, 'PENDING' as status, 0 as retry_count from (select distinct t, k from gone where active and not live)",
    "g9_primary": f"with {PRIORITY} select entity_key, 'priority' as attr_key, attr_value, support_count, 0.5::double as confidence from pr where place = 1",
    "g10_candidates": f"with {PRIORITY} select entity_key, attr_value, support_count, place::int as place, place = 1 as is_primary from pr",
    "g11_entity_index": f"with {ENTITIES} select entity_key, name || ': ' || type as text from en",
    "g12_relation_index": "select distinct 'S' || l_suppkey as subject, 'P' || l_partkey as object, 'S' || l_suppkey || ' SUPPLIES_PART P' || l_partkey as text from lineitem where l_returnflag <> 'R'",
    "g14_stats": f"with {ENTITIES}, c as (select count(distinct case when t = 'FACT' then k end) as f, count(distinct case when t = 'ENTITY_ATTRIBUTE' then k end) as a from ev where active) select (select count(*) from en) as entities, f as facts, a as attributes, 2 * f + a as relations from c",
    "g16_entities": f"with {ENTITIES} select * from en",
    "g17_purge": f"with {EV} select t as affected_type, k as affected_key, not bool_or(active) as purged from ev group by 1, 2",
    "g18_by_type": f"with {EV} select coalesce(b, 'all') as bucket, coalesce(t, 'all') as evidence_type, count(*) as n, grouping_id(b, t)::int as level from (select left(ch, 2) as b, t from ev where active) group by rollup (b, t)",
    "g19_migrated": "select 'ENTITY' as evidence_type, 'supplier:' || upper(s_name) as key, null as predicate, null as object_key, 0.9::double as confidence from supplier where s_suppkey % 2 = 0 union all select 'FACT', case when s_suppkey % 2 = 0 then 'supplier:' else 'unknown:' end || s_name, case when s_suppkey % 3 = 0 then 'IS_IN' else 'RELATES_TO' end, 'unknown:n' || s_nationkey, 0.85 from supplier",
    "g20_consistency": f"with {EV}, c as (select t, k, count(*) as n from ev where active group by 1, 2) select t as affected_type, k as affected_key, n as expected, case when k like '%33' then null else n + 1 end as stored from c where k like '%7' or k like '%33'",
    "h1_seeds": f"with {HOPS} select * from st",
    "h2_hops": f"with {HOPS} select query_id, seed, target, distance, relations, path from hp",
    "h3_shortest": f"""with {EDGES}, q as (select a.n_nationkey::bigint as query_id, a.n_name as s, b.n_name as g from nation a join nation b on b.n_nationkey = case when a.n_nationkey < 5 then a.n_nationkey + 20 else a.n_nationkey - 5 end),
l1 as (select query_id, g, b, s || ' > ' || b as path, p as r, [s, b] as ns from q join bi on a = s), l2 as (select query_id, g, x.b, path || ' > ' || x.b as path, r || ',' || p as r, list_append(ns, x.b) as ns from l1 join bi x on x.a = l1.b where not list_contains(ns, x.b) and l1.b <> g),
l3 as (select query_id, g, x.b, path || ' > ' || x.b as path, r || ',' || p as r, list_append(ns, x.b) as ns from l2 join bi x on x.a = l2.b where not list_contains(ns, x.b) and l2.b <> g),
al as (select query_id, g, b, path, r, 1 as d from l1 union all select query_id, g, b, path, r, 2 from l2 union all select query_id, g, b, path, r, 3 from l3),
ok as (select *, min(d) over (partition by query_id) as m from al where b = g) select query_id, path, d as distance, r as relations from ok where d = m qualify row_number() over (partition by query_id order by path) <= 10""",
    "h4_expanded": f"with {HOPS} select query_id, count(distinct path) as paths, count(distinct target) as targets from hp group by 1",
    "h5_relevant": f"with {HOPS}, f as (select *, contains(relations, 'PART_OF') as l from hp) select query_id, path from (select *, bool_or(l) over (partition by query_id) as s from f) where l or not s",
    "h7_mentions": "with n as (select distinct name from (select unnest(string_split(text, ' ')) as name from benchmark) where length(name) >= 12) select doc_id as chunk_id, name from documents join n on contains(text, name)",
    "i3_enriched_query": f"with {HOPS}, c as (select query_id, string_agg(target, ' ' order by target) as c from (select distinct query_id, target from hp) where true group by 1), t as (select query_id, list(distinct target order by target)[1:15] as l from hp group by 1) select n_nationkey::bigint as query_id, n_name || ' ' || coalesce(array_to_string(l, ' '), '') as query from nation left join t on t.query_id = n_nationkey",
    "i5_graph_context": f"with {HOPS}, d as (select query_id, path from (select distinct query_id, path from hp) qualify row_number() over (partition by query_id order by path) <= 40) select query_id, string_agg('[Graph] ' || path, chr(10) order by path) as context from d group by 1",
}

"""Evidence rows, support counts and the materialised entity, fact and attribute tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from millrace.sources.scratch import sendable, stored

KINDS = ("ENTITY", "FACT", "ENTITY_ATTRIBUTE", "FACT_ATTRIBUTE")
ITEM = "struct<evidence_type:string,entity_type:string,entity_name:string,subject_type:string,subject_name:string,predicate:string,object_type:string,object_name:string,entity_key:string,attr_key:string,attr_value:string,evidence_text:string,confidence:double>"
KEY_COLUMNS = ["entity_key", "subject_key", "predicate", "object_key", "attr_key", "attr_value"]


def entity_key(kind: Column, name: Column) -> Column:
    return F.concat(F.lower(F.trim(kind)), F.lit(":"), F.trim(name))


def predicate_key(predicate: Column) -> Column:
    return F.replace(F.upper(F.trim(predicate)), F.lit(" "), F.lit("_"))


def fact_key(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.concat_ws("|", subject, predicate_key(predicate), object_)


def parse_items(responses: DataFrame) -> DataFrame:
    """responses: (chunk_hash, response). Items of the outermost {...}: evidence_items may be a list, one object, a JSON string of
    either, or a list that mixes objects and JSON strings; whatever else gives nothing."""
    body = F.regexp_extract("response", r"(?s)\{.*\}", 0)
    raw = F.get_json_object(body, "$.evidence_items")
    as_list = F.from_json(raw, "array<string>")
    one = F.when(raw.startswith("{"), F.array(raw))
    listed = F.coalesce(one, as_list)
    items = responses.select("chunk_hash", F.posexplode(listed).alias("ordinal", "item"))
    parsed = items.withColumn("item", F.from_json("item", ITEM)).filter("item.evidence_type is not null")
    return parsed.select("chunk_hash", "ordinal", "item.*")


def typed(items: DataFrame) -> DataFrame:
    """Items as evidence: upper-case kind, keys, confidence 0.5 by default, 200 characters of text; unknown kinds are dropped.
    The id is a hash of chunk, kind, keys and ordinal, so that a second extraction replaces the first."""
    rows = items.withColumn("evidence_type", F.upper(F.trim("evidence_type"))).filter(F.col("evidence_type").isin(*KINDS))
    own = F.when(F.col("evidence_type") == "ENTITY", entity_key(F.col("entity_type"), F.col("entity_name"))).otherwise(F.col("entity_key"))
    rows = rows.withColumn("entity_key", own).withColumn("subject_key", entity_key(F.col("subject_type"), F.col("subject_name"))).withColumn("object_key", entity_key(F.col("object_type"), F.col("object_name")))
    rows = rows.withColumn("predicate", predicate_key(F.col("predicate"))).withColumn("attr_key", F.lower(F.trim("attr_key")))
    rows = rows.withColumn("confidence", F.coalesce("confidence", F.lit(0.5))).withColumn("evidence_text", F.substring(F.coalesce("evidence_text", F.lit("")), 1, 200)).withColumn("active", F.lit(True))
    return rows.withColumn("evidence_id", F.sha2(F.concat_ws("\x1f", "chunk_hash", "evidence_type", *KEY_COLUMNS, F.col("ordinal").cast("string")), 256))


def affected_key(kind: Column) -> Column:
    """The key that a row of evidence supports, as text."""
    fact = F.concat_ws("|", "subject_key", "predicate", "object_key")
    return (
        F.when(kind == "ENTITY", F.col("entity_key")).when(kind == "FACT", fact)
        .when(kind == "ENTITY_ATTRIBUTE", F.concat_ws("|", "entity_key", "attr_key", "attr_value"))
        .otherwise(F.concat_ws("|", fact, "attr_key", "attr_value"))
    )


def affected(evidence: DataFrame) -> DataFrame:
    return evidence.select(F.col("evidence_type").alias("affected_type"), affected_key(F.col("evidence_type")).alias("affected_key")).distinct()


def deactivate(evidence: DataFrame, chunk_hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence with that of the given chunks inactive, and the keys that this changes."""
    gone = chunk_hashes.select("chunk_hash").distinct().withColumn("gone", F.lit(True))
    marked = evidence.join(gone, "chunk_hash", "left")
    hit = F.coalesce("gone", F.lit(False))
    return marked.withColumn("active", F.col("active") & ~hit).drop("gone"), affected(marked.filter(hit & F.col("active")))


def support(evidence: DataFrame) -> DataFrame:
    """(affected_type, affected_key, support_count) over active evidence."""
    live = evidence.filter("active")
    return live.groupBy(F.col("evidence_type").alias("affected_type"), affected_key(F.col("evidence_type")).alias("affected_key")).agg(F.count("*").alias("support_count"))


def apply_counts(stored: DataFrame, counts: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored counts with those of the affected keys replaced; keys without support go."""
    on = ["affected_type", "affected_key"]
    recounted = keys.join(counts, on).select(*on, "support_count")
    return stored.join(keys, on, "left_anti").select(*on, "support_count").unionByName(recounted)


def sync_tasks(keys: DataFrame, doc_id: Column, version: int = 1) -> DataFrame:
    task = F.sha2(F.concat_ws("\x1f", doc_id.cast("string"), F.lit(str(version)), "affected_type", "affected_key"), 256)
    return keys.select(task.alias("task_id"), doc_id.alias("doc_id"), F.lit(version).alias("doc_version"), "affected_key", "affected_type", F.lit("UPSERT").alias("operation"), F.lit("PENDING").alias("status"), F.lit(0).alias("retry_count"))


def attribute_values(evidence: DataFrame, owner: str = "entity_key") -> DataFrame:
    """Values of each (owner, attribute) by support, then mean confidence, then value; the first is primary."""
    grouped = evidence.filter("active").groupBy(owner, "attr_key", "attr_value").agg(F.count("*").alias("support_count"), F.round(F.avg("confidence"), 4).alias("confidence"))
    order = Window.partitionBy(owner, "attr_key").orderBy(F.desc("support_count"), F.desc("confidence"), "attr_value")
    return grouped.withColumn("place", F.row_number().over(order)).withColumn("is_primary", F.col("place") == 1)


def spelled(evidence: DataFrame) -> DataFrame:
    """(entity_key, entity_name, entity_type, n) of active evidence, each combination once: n counts the entity's own rows, not
    those where it is an end of a fact. Sums are kept in hash tables, which the least of texts can't be."""
    live = evidence.filter("active")
    own = live.filter("evidence_type = 'ENTITY'").select("entity_key", "entity_name", "entity_type", F.lit(1).alias("one"))
    end = lambda side: live.filter("evidence_type = 'FACT'").select(F.col(f"{side}_key").alias("entity_key"), F.col(f"{side}_name").alias("entity_name"), F.col(f"{side}_type").alias("entity_type"), F.lit(0).alias("one"))
    return own.unionByName(end("subject")).unionByName(end("object")).groupBy("entity_key", "entity_name", "entity_type").agg(F.sum("one").alias("n"))


def entities(evidence: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Entities with their own support; those known only as ends of facts or owners of attributes have 0. names: what
    ``spelled`` gave, if it is stored."""
    names = spelled(evidence) if names is None else names
    return names.groupBy("entity_key").agg(F.min("entity_name").alias("name"), F.min("entity_type").alias("type"), F.sum("n").alias("support_count"))


def facts(evidence: DataFrame) -> DataFrame:
    return evidence.filter("active and evidence_type = 'FACT'").groupBy("subject_key", "predicate", "object_key").agg(F.count("*").alias("support_count")).withColumn("fact_key", F.concat_ws("|", "subject_key", "predicate", "object_key"))


def entity_records(evidence: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(entity_key, text) of the entity index: name and type."""
    return entities(evidence, names).select("entity_key", F.concat_ws(": ", "name", "type").alias("text"))


def relation_records(evidence: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(subject, predicate, object, text) of the relation index, by the entities' names. An entity of one name has it in its
    facts, so only those of several are joined."""
    names = spelled(evidence) if names is None else names
    name = F.col("entity_name")
    several = names.groupBy("entity_key").agg(F.min(name).alias("name"), F.max(name).alias("last"), F.count(name).alias("named"), F.count("*").alias("all"))
    several = stored(several.filter("entity_key is not null and name is not null and (name <> last or named < all)").select("entity_key", "name"), "several-names")
    rows = evidence.filter("active and evidence_type = 'FACT'").select("subject_key", "subject_name", "predicate", "object_key", "object_name")
    if not several.isEmpty():
        sent = F.broadcast if sendable(several.select(F.concat_ws("", "entity_key", "name").alias("x"))) else lambda x: x
        for side in ("subject", "object"):
            rows = rows.join(sent(several.select(F.col("entity_key").alias(f"{side}_key"), F.col("name").alias(f"{side}_chosen"))), f"{side}_key", "left")
            rows = rows.withColumn(f"{side}_name", F.coalesce(f"{side}_chosen", f"{side}_name"))
    shown = lambda side: F.when(F.col(f"{side}_key").isNotNull(), F.coalesce(f"{side}_name", f"{side}_key")).alias(side)
    return rows.select(shown("subject"), "predicate", shown("object")).distinct().withColumn("text", F.concat_ws(" ", "subject", "predicate", "object"))


def graph_stats(evidence: DataFrame) -> DataFrame:
    """(entities, facts, attributes, relations): relations are two for each fact and one for each attribute."""
    live = evidence.filter("active")
    e, f = entities(evidence).agg(F.count("*").alias("entities")), facts(evidence).agg(F.count("*").alias("facts"))
    a = live.filter("evidence_type = 'ENTITY_ATTRIBUTE'").agg(F.count_distinct("entity_key", "attr_key", "attr_value").alias("attributes"))
    return e.crossJoin(f).crossJoin(a).withColumn("relations", 2 * F.col("facts") + F.col("attributes"))


def inconsistent(evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys whose stored count is not what the evidence gives."""
    on = ["affected_type", "affected_key"]
    both = support(evidence).withColumnRenamed("support_count", "expected").join(stored.select(*on, F.col("support_count").alias("stored")), on, "full_outer")
    return both.filter(~F.col("expected").eqNullSafe(F.col("stored")))


def migrate(entities_: DataFrame, relations: DataFrame) -> DataFrame:
    """Legacy rows (name, type) and (subject, predicate, object) as evidence: types by name without regard to case, Unknown
    where none is known, RELATES_TO for a missing predicate, confidence 0.9 and 0.85."""
    kinds = entities_.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("type").alias("t"))
    own = entities_.select(F.lit("ENTITY").alias("evidence_type"), entity_key(F.col("type"), F.col("name")).alias("entity_key"), F.lit(0.9).alias("confidence"))
    typed_ = relations.join(kinds.toDF("ks", "ts"), F.lower(F.trim("subject")) == F.col("ks"), "left").join(kinds.toDF("ko", "to"), F.lower(F.trim("object")) == F.col("ko"), "left")
    s, o = entity_key(F.coalesce("ts", F.lit("Unknown")), F.col("subject")), entity_key(F.coalesce("to", F.lit("Unknown")), F.col("object"))
    links = typed_.select(F.lit("FACT").alias("evidence_type"), s.alias("subject_key"), predicate_key(F.coalesce("predicate", F.lit("RELATES_TO"))).alias("predicate"), o.alias("object_key"), F.lit(0.85).alias("confidence"))
    return own.unionByName(links, allowMissingColumns=True).withColumn("chunk_hash", F.lit("migrated"))


def overview(evidence: DataFrame, most: int = 500) -> DataFrame:
    """The first facts by key with the names of both ends; ``most`` bounds what a view shows."""
    names = entities(evidence).select("entity_key", "name")
    linked = facts(evidence).join(names.toDF("subject_key", "subject"), "subject_key").join(names.toDF("object_key", "object"), "object_key")
    return linked.orderBy("fact_key").limit(most).select("fact_key", "subject", "predicate", "object", "support_count")


def upsert_records(index: DataFrame, new: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """An index with new records in place of those of equal keys and without the keys of gone."""
    keys = new.select(key).unionByName(gone.select(key)).distinct()
    return index.join(keys, key, "left_anti").unionByName(new.select(*index.columns))


def extraction_report(responses: DataFrame) -> DataFrame:
    """One row for a run over all chunks: chunks, evidence rows, affected keys, and chunks that gave none."""
    rows = typed(parse_items(responses))
    found = rows.agg(F.count("*").alias("evidence"), F.count_distinct("evidence_type", affected_key(F.col("evidence_type"))).alias("keys"), F.count_distinct("chunk_hash").alias("useful"))
    return responses.agg(F.count("*").alias("chunks")).crossJoin(found).select("chunks", "evidence", "keys", (F.col("chunks") - F.col("useful")).alias("without"))

"""Exports: threat-intelligence bundle, training examples, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.evaluate import citation_coverage

#: Namespace of the identifiers of exported objects.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "factloom.invalid")
EPOCH = "2020-01-01T00:00:00.000Z"


def uuid5(key: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Name-based UUID of a text, from the SHA-1 of the namespace's bytes and the text, with version and variant set."""
    digest = F.lower(F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(key, "utf-8"))))
    part = lambda i, n: F.substring(digest, i, n)
    variant = F.lower(F.hex((F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("bigint")))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def object_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}--"), uuid5(key))


def stamp(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(EPOCH))


def attack_patterns(techniques: DataFrame) -> DataFrame:
    """(key, object) of the technique registry."""
    obj = F.struct(
        F.lit("attack-pattern").alias("type"), F.lit("2.1").alias("spec_version"), object_id("attack-pattern", F.concat(F.lit("technique:"), "technique_id")).alias("id"), F.lit(EPOCH).alias("created"),
        F.lit(EPOCH).alias("modified"), "name", "description", F.array(F.struct(F.lit("DISARM").alias("source_name"), F.col("technique_id").alias("external_id"))).alias("external_references"),
        F.array(F.struct(F.lit("disarm").alias("kill_chain_name"), F.lower("phase").alias("phase_name"))).alias("kill_chain_phases"),
    )
    return techniques.select(F.concat(F.lit("1"), "technique_id").alias("key"), F.to_json(obj).alias("object"))


def identities(sources: DataFrame) -> DataFrame:
    """(key, object) of the sources, in order of label."""
    kind = F.when(F.length(F.coalesce("kind", F.lit(""))) > 0, F.concat(F.lit(" ("), "kind", F.lit(")"))).otherwise("")
    obj = F.struct(
        F.lit("identity").alias("type"), F.lit("2.1").alias("spec_version"), object_id("identity", F.concat(F.lit("source:"), "label")).alias("id"), F.lit(EPOCH).alias("created"), F.lit(EPOCH).alias("modified"),
        F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("label")).alias("name"), F.lit("organization").alias("identity_class"),
        F.concat(F.lit("Open-source publisher '"), "label", F.lit("'"), kind, F.lit("; Admiralty source reliability "), "reliability", F.lit(".")).alias("description"),
    )
    return sources.select(F.concat(F.lit("2"), "label").alias("key"), F.to_json(obj).alias("object"))


def reports(narratives: DataFrame) -> DataFrame:
    """(key, object) of the narratives that carry techniques; those without become none."""
    refs = F.transform("disarm", lambda t: object_id("attack-pattern", F.concat(F.lit("technique:"), t["technique_id"])))
    obj = F.struct(
        F.lit("report").alias("type"), F.lit("2.1").alias("spec_version"), object_id("report", F.col("narrative_id")).alias("id"), stamp(F.col("last_seen")).alias("created"), stamp(F.col("last_seen")).alias("modified"),
        F.col("label").alias("name"), F.array(F.lit("threat-report")).alias("report_types"), stamp(F.col("last_seen")).alias("published"), F.coalesce("summary", F.lit("")).alias("description"), refs.alias("object_refs"),
    )
    return narratives.where("disarm is not null and size(disarm) > 0").select(F.concat(F.lit("3"), "narrative_id").alias("key"), F.to_json(obj).alias("object"))


def bundle_objects(techniques: DataFrame, sources: DataFrame, narratives: DataFrame | None = None) -> DataFrame:
    """(key, object): the bundle's objects as lines of JSON, ordered by key; written as text they are the bundle's body."""
    out = attack_patterns(techniques).unionByName(identities(sources))
    return out.unionByName(reports(narratives)) if narratives is not None else out


def bundle(objects: DataFrame, name: str = "all") -> DataFrame:
    """(key, line): a whole bundle as lines in order of key, valid JSON when they are written one after another. Only the
    first object has no comma before it, so no row or task ever holds the bundle."""
    first = objects.agg(F.min("key").alias("_first"))
    body = objects.crossJoin(F.broadcast(first)).select("key", F.concat(F.when(F.col("key") == F.col("_first"), "").otherwise(","), "object").alias("line"))  # first: one row
    spark = objects.sparkSession
    ident = f"bundle--{uuid.uuid5(NAMESPACE, 'bundle:' + name)}"
    ends = spark.createDataFrame([("", f'{{"type":"bundle","id":"{ident}","objects":['), ("\U0010ffff", "]}")], "key string, line string")
    return ends.unionByName(body).orderBy("key")


def write_bundle(objects: DataFrame, path: str, name: str = "all") -> None:
    """The bundle as text files whose names are in order: put together they are one JSON document."""
    bundle(objects, name).select("line").write.text(path)


def training_examples(briefs: DataFrame, system: str, least: float = 1.0) -> DataFrame:
    """(brief_id, messages) of briefs that are fit to learn from: with judgments, citations and a body, and with so large a
    share of judgments cited."""
    fit = (F.size("judgments") > 0) & (F.size("citations") > 0) & (F.trim(F.coalesce("body", F.lit(""))) != "") & (citation_coverage(F.col("judgments")) >= least)
    return briefs.where(F.coalesce(fit, F.lit(False))).select("brief_id", chat_example(system, F.col("query"), F.col("body")).alias("messages"))


def train_valid(rows: DataFrame, key: Column, share: float = 0.2, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """`rows` with `split`: exactly max(1, floor(n x share)) are 'valid' (none of fewer than two), chosen by a hash of the
    key and the seed. Ranks are counted by hash bucket, so no window holds all rows. Keys should be distinct."""
    h = F.xxhash64(key, F.lit(seed))
    tagged = rows.withColumn("_h", h).withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(buckets)).cast("int"))
    sizes = {r._b: r.n for r in tagged.groupBy("_b").agg(F.count("*").alias("n")).collect()}  # at most `buckets` rows
    n = sum(sizes.values())
    want = max(1, int(n * share)) if n > 1 else 0
    seen, last = 0, -1
    for b in range(buckets):
        if seen >= want:
            break
        last, before = b, seen
        seen += sizes.get(b, 0)
    if want == 0:
        return rows.withColumn("split", F.lit("train"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h"))
    edge = tagged.where(F.col("_b") == last).withColumn("_r", rank)
    whole = tagged.where(F.col("_b") != last).withColumn("split", F.when(F.col("_b") < last, "valid").otherwise("train"))
    return whole.unionByName(edge.withColumn("split", F.when(F.col("_r") <= want - before, "valid").otherwise("train")).drop("_r")).drop("_h", "_b")


def chat_example(system: str, user: Column, answer: Column) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", answer))



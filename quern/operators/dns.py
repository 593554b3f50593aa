"""Authoritative name resolution for batches of queries.

A zone is its records (name, type, rdata, ttl). Every hop of a batch is a few equi joins:
exact match, alias, existence, closest encloser, wildcard. Hops are unrolled; a query that is
answered leaves the loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ancestors, dns_name, in_zone, is_visible, lookup_key, ttl_or_default
from . import state

MAX_CHAIN = 8


def normalized(records: DataFrame) -> DataFrame:
    """Visible records with normalized names, upper-case types and lookup keys."""
    out = records.where(is_visible(F.col("disabled"))) if "disabled" in records.columns else records
    return out.withColumn("name", dns_name(F.col("name"))).withColumn("type", F.upper("type")).withColumn("lookup_key", lookup_key(F.col("name"), F.col("type")))


def rrsets(records: DataFrame) -> DataFrame:
    """Record data by lookup key, sorted."""
    return records.groupBy("lookup_key").agg(F.array_sort(F.collect_list("rdata")).alias("rdata"))


def names(records: DataFrame) -> DataFrame:
    return records.select("name").distinct()


def nodes(records: DataFrame, zone: str) -> DataFrame:
    """Names and all names between them and the apex, which is there even if the zone is empty."""
    apex = records.sparkSession.createDataFrame([(zone,)], "node string")
    return names(records).select(F.explode(ancestors(F.col("name"), F.lit(zone))).alias("node")).union(apex).distinct()


def list_zone(records: DataFrame) -> DataFrame:
    """By name and type in the order of the Unicode collation."""
    return normalized(records).orderBy(F.collate("name", "UNICODE"), F.collate("type", "UNICODE"))


def resolve_any(records: DataFrame, name: str, *, disabled: bool = False) -> DataFrame:
    """All records of a name, whatever their type."""
    rows = records if disabled else normalized(records)
    return rows.where(dns_name(F.col("name")) == dns_name(F.lit(name)))


def rdata_target(rdata: Column) -> Column:
    """The target of record data: of an object its member `target`, of a JSON text the text, else the data as they are."""
    v = F.try_parse_json(rdata)
    return F.coalesce(F.try_variant_get(v, "$.target", "string"), F.try_variant_get(v, "$", "string"), rdata)


def prepared(batch: DataFrame, now_ms: int) -> DataFrame:
    """Records to be written (zone, name, type, rdata; ttl, comment and disabled may be lacking), normalized, with their lookup key, times and a verdict:
    `outside` the zone, `no rdata` or `ok`."""
    have = set(batch.columns)
    out = batch.withColumn("zone", dns_name(F.col("zone"))).withColumn("name", dns_name(F.col("name"))).withColumn("type", F.upper("type"))
    out = out.withColumn("ttl", ttl_or_default(F.col("ttl") if "ttl" in have else F.lit(None).cast("string")))
    out = out.withColumn("comment", F.coalesce(F.col("comment") if "comment" in have else F.lit(None), F.lit("")))
    out = out.withColumn("disabled", F.coalesce(F.col("disabled") if "disabled" in have else F.lit(None), F.lit(False)))
    out = out.withColumn("lookup_key", lookup_key(F.col("name"), F.col("type"))).withColumn("created_ms", F.lit(now_ms)).withColumn("updated_ms", F.lit(now_ms))
    inside = F.coalesce(in_zone(F.col("name"), F.col("zone")), F.lit(False))
    return out.withColumn("verdict", F.when(~inside, "outside").when(F.coalesce(F.col("rdata"), F.lit("")) == "", "no rdata").otherwise("ok"))


def put_rrsets(records: DataFrame, batch: DataFrame, now_ms: int) -> DataFrame:
    """The records after those of every name and type in batch are replaced by it, disabled ones too. A row that is not `ok` is an error, for half a set is none."""
    new = prepared(batch, now_ms)
    key = F.when(F.col("verdict") == "ok", F.col("lookup_key")).otherwise(F.raise_error(F.concat(F.lit("record "), F.col("name"), F.lit(": "), F.col("verdict"))))
    new = new.withColumn("lookup_key", key).select(records.columns)
    return delete_rrsets(records, new).unionByName(new)


def delete_rrsets(records: DataFrame, asked: DataFrame) -> DataFrame:
    """The records without those of the names and types asked, disabled ones too."""
    keys = asked.select(lookup_key(F.col("name"), F.col("type")).alias("lookup_key"))
    return records.join(keys, "lookup_key", "left_anti").select(records.columns)


def update_records(records: DataFrame, patches: DataFrame, key: str, now_ms: int) -> DataFrame:
    """Records with patches merged by key; a new name or type gives a new lookup key."""
    out = state.patch(records, patches.withColumn("updated_ms", F.lit(now_ms)), key)
    out = out.withColumn("name", dns_name(F.col("name"))).withColumn("type", F.upper("type"))
    return out.withColumn("lookup_key", lookup_key(F.col("name"), F.col("type"))).select(records.columns)


def refreshed(cache: DataFrame, records: DataFrame, events: DataFrame) -> DataFrame:
    """A cache of visible records after a feed (zone of each event's record, null where there is none): zones with an event are read anew, all of them after one without a record."""
    zones = events.select("zone").distinct()
    if not zones.where("zone is null").isEmpty():
        return normalized(records).select(cache.columns)
    return cache.join(zones, "zone", "left_anti").unionByName(normalized(records).join(zones, "zone", "left_semi").select(cache.columns)).select(cache.columns)


def closest_encloser(asked: DataFrame, tree: DataFrame, zone: str) -> DataFrame:
    """asked (qid, name, ...) with the longest existing name above name; null when name itself exists or none does."""
    rest = [c for c in asked.columns if c != "qid"]
    up = asked.select("qid", F.struct(*rest).alias("row"), F.posexplode_outer(ancestors(F.col("name"), F.lit(zone))).alias("depth", "node"))
    hit = up.join(tree.withColumn("hit", F.lit(True)), "node", "left")
    best = hit.groupBy("qid").agg(F.first("row").alias("row"), F.min_by(F.col("node"), F.when(F.col("hit"), F.col("depth"))).alias("encloser"))
    return best.select("qid", "row.*", F.when(F.col("encloser") != F.col("row.name"), F.col("encloser")).alias("encloser"))


def resolve(asked: DataFrame, records: DataFrame, zone: str, *, max_chain: int = MAX_CHAIN, rfc_nodata: bool = False) -> DataFrame:
    """qid, status, answers, chain: asked has qid (unique), name, type.

    Per hop: outside the zone a referral; an exact record set; an alias (followed, unless an
    alias was asked for); an existing name NODATA; a wildcard at the closest encloser (its
    record set, or NODATA when it has other types only); else NXDOMAIN. An empty
    non-terminal is NXDOMAIN, or NODATA with rfc_nodata. A chain longer than max_chain is
    truncated. Aliases are walked first, one join a hop; what the walk ends at is answered
    once.
    """
    recs = normalized(records).select("name", "type", "lookup_key", "rdata")
    sets, tree = rrsets(recs), nodes(recs, zone)
    info = recs.groupBy("name").agg(F.collect_set("type").alias("types"), F.min(F.when(F.col("type") == "CNAME", dns_name(rdata_target(F.col("rdata"))))).alias("target"))
    cur = asked.select("qid", dns_name(F.col("name")).alias("name"), F.upper("type").alias("type"), F.array().cast("array<string>").alias("chain"))
    follows = in_zone(F.col("name"), F.lit(zone)) & F.col("target").isNotNull() & (F.col("type") != "CNAME") & ~F.array_contains("types", F.col("type"))
    for _ in range(max_chain):
        cur = cur.join(info, "name", "left").withColumn("follows", F.coalesce(follows, F.lit(False)))
        cur = cur.select("qid", F.when(F.col("follows"), F.col("target")).otherwise(F.col("name")).alias("name"), "type", F.when(F.col("follows"), F.concat("chain", F.array("target"))).otherwise(F.col("chain")).alias("chain"))
    r = closest_encloser(cur, tree, zone).join(info, "name", "left").withColumn("follows", F.coalesce(follows, F.lit(False)))
    r = r.withColumn("lookup_key", F.concat_ws("|", "name", "type")).join(sets, "lookup_key", "left")
    r = r.withColumn("wild", F.concat(F.lit("*."), "encloser")).withColumn("wild_key", F.concat(F.col("wild"), F.lit("|"), F.col("type")))
    r = r.join(sets.select(F.col("lookup_key").alias("wild_key"), F.col("rdata").alias("wild_rdata")), "wild_key", "left")
    r = r.join(info.select(F.col("name").alias("wild"), F.lit(True).alias("wild_exists")), "wild", "left")
    status = (
        F.when(~in_zone(F.col("name"), F.lit(zone)), "REFERRAL")
        .when(F.col("rdata").isNotNull(), "NOERROR")
        .when(F.col("follows") & ~in_zone(F.col("target"), F.lit(zone)), "REFERRAL")
        .when(F.col("follows"), "TRUNCATED")
        .when(F.col("types").isNotNull(), "NODATA")
        .when(F.col("wild_rdata").isNotNull(), "NOERROR")
        .when(F.col("wild_exists"), "NODATA")
        .when(F.col("encloser").isNull() & F.lit(rfc_nodata), "NODATA")
        .otherwise("NXDOMAIN")
    )
    r = r.withColumn("status", status)
    answers = F.when(F.col("status") == "NOERROR", F.coalesce("rdata", "wild_rdata"))
    chain = F.when(F.col("follows"), F.concat("chain", F.array("target"))).otherwise(F.col("chain"))
    return r.select("qid", "status", answers.alias("answers"), chain.alias("chain"))

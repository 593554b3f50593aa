"""Queries over the driver's tables, one or more per operator, with their SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar as fn
from .operators import access, changes, dns, objects, query, state
from .schema import Field
from .sources import codec

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

KEY = bytes(range(32))
_INNER, _OUTER = (p.hex() for p in fn.pads(KEY))
LOG_ORDER = ("ts", "event_id")
LOW, HIGH = "1996-01-01 00:00:00", "1996-03-31 00:00:00"
DAY_MS = 86_400_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def registered(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def hmac_sql(text: str) -> str:
    return f"left(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || ({text})::blob))), 32)"


def deleted():
    return F.col("event_type") == "error"


def _fold(spark, sf):
    log = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return state.fold(log, "user_id", LOG_ORDER, deleted())


_FOLD_SQL = """
  select user_id as id, version, event_type, value from (
    select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r, count(*) over (partition by user_id) as version
    from events) where r = 1 and event_type <> 'error'
"""


def _as_state(df):
    return df.select(F.col("user_id").alias("id"), "version", "event_type", "value")


# -- state and log -------------------------------------------------------------


@registered(_FOLD_SQL)
def state_fold(spark, sf):
    return _as_state(_fold(spark, sf))


@registered(f"select count(*) as live from ({_FOLD_SQL})")
def state_count(spark, sf):
    return _fold(spark, sf).agg(F.count("*").alias("live"))


@registered("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as version from events")
def version_numbers(spark, sf):
    return state.versions(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", LOG_ORDER).select("event_id", "user_id", "version")


@registered("select event_id, ts, event_type, value, user_id from events")
def scan_all(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "event_type", "value", "user_id")


@registered("""
  with v as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events),
       s as (select user_id, max(event_id) as last_event, count(*) as mutations, sum(case when event_type = 'error' then 1 else 0 end) as tombstones from events group by 1)
  select count(*) as keys, sum(mutations)::bigint as mutations, sum(tombstones)::bigint as tombstones,
         (select count(*) from v where r = 1 and event_type <> 'error') as live from s
""")
def compaction_stats(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    by = e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(deleted().cast("long")).alias("t"), F.max_by(deleted(), F.struct(*LOG_ORDER)).alias("gone"))
    return by.agg(F.count("*").alias("keys"), F.sum("n").alias("mutations"), F.sum("t").alias("tombstones"), F.sum((~F.col("gone")).cast("long")).alias("live"))


# -- point, equality, range, pages ----------------------------------------------


@registered("select * from orders where o_orderkey = 77")
def point_get(spark, sf):
    return query.get(table(spark, sf, "orders"), "o_orderkey", 77)


@registered(f"select * from ({_FOLD_SQL}) where id = (select min(id) from ({_FOLD_SQL}))")
def point_get_versioned(spark, sf):
    s = _as_state(_fold(spark, sf))
    return s.orderBy("id").limit(1)


@registered("select c_custkey, c_name, c_acctbal from customer where c_mktsegment = 'BUILDING'")
def find_plain(spark, sf):
    return query.find(table(spark, sf, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name", "c_acctbal")


@registered(f"select c_custkey, c_name from customer where {hmac_sql('c_name')} = {hmac_sql(chr(39) + 'Customer#000000042' + chr(39))}")
def find_blind(spark, sf):
    return query.find_blind(table(spark, sf, "customer"), "c_name", "Customer#000000042", KEY).select("c_custkey", "c_name")


@registered(f"select c_custkey, {hmac_sql('c_name')} as bi_name from customer")
def blind_column(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fn.blind(F.col("c_name"), KEY).alias("bi_name"))


@registered("select * from customer where c_mktsegment = 'MACHINERY' order by c_custkey limit 1")
def find_one(spark, sf):
    return query.find_one(table(spark, sf, "customer"), "c_mktsegment", "MACHINERY", "c_custkey")


_RANGE_SQL = f"select o_orderkey, o_orderdate from orders where o_orderdate between timestamp '{LOW}' and timestamp '{HIGH}'"


def _ntz(t):
    return F.lit(t).cast("timestamp_ntz")


@registered(_RANGE_SQL)
def range_inclusive(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").where(F.col("o_orderdate").between(_ntz(LOW), _ntz(HIGH)))


@registered(_RANGE_SQL)
def range_bucketed(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    ms = fn.epoch_ms("o_orderdate")
    hashed = query.with_bucket_hash(o, ms, "rb", DAY_MS, KEY)
    low, high = 820_454_400_000, 828_230_400_000
    return query.range_bucketed(hashed, ms, "rb", low, high, DAY_MS, KEY).select("o_orderkey", "o_orderdate")


@registered("select o_orderkey from orders where false")
def range_inverted(spark, sf):
    return query.find_range(table(spark, sf, "orders"), "o_totalprice", 10, 1).select("o_orderkey")


@registered("select floor(epoch_ms(o_orderdate) / 86400000.0)::bigint as bucket, count(*) as n from orders group by 1")
def bucket_histogram(spark, sf):
    return table(spark, sf, "orders").select(fn.bucket(fn.epoch_ms("o_orderdate"), DAY_MS).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@registered("select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem where l_quantity between 10 and 12 order by l_orderkey, l_linenumber, l_quantity, l_extendedprice limit 50")
def range_plain_limit(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    return query.find_range(table(spark, sf, "lineitem").select(cols), "l_quantity", 10, 12).orderBy(*cols).limit(50)


@registered("select * from orders where o_orderkey > 500 order by o_orderkey limit 100")
def scan_page(spark, sf):
    return query.scan_page(table(spark, sf, "orders"), "o_orderkey", 500)


@registered("select * from orders where o_orderkey > (select max(o_orderkey) - 7 from orders) order by o_orderkey limit 100")
def scan_page_last(spark, sf):
    o = table(spark, sf, "orders")
    top = o.agg(F.max("o_orderkey")).first()[0]
    return query.scan_page(o, "o_orderkey", top - 7)


@registered("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F' order by o_orderkey limit 100")
def row_filter(spark, sf):
    return query.scan_page(access.row_filtered(table(spark, sf, "orders"), "o_orderstatus", "F"), "o_orderkey").select("o_orderkey", "o_orderstatus")


@registered("select o_orderkey, o_orderstatus from (select * from orders order by o_orderkey limit 100) where o_orderstatus = 'F'")
def postfilter_page(spark, sf):
    return query.postfilter_page(table(spark, sf, "orders"), "o_orderkey", None, 100, fn.row_matches(F.col("o_orderstatus"), "F")).select("o_orderkey", "o_orderstatus")


@registered("select c_mktsegment as value, c_custkey as id from customer where c_mktsegment is not null")
def posting_list(spark, sf):
    return state.postings(table(spark, sf, "customer"), "c_mktsegment", "c_custkey")


@registered("select c_mktsegment as value, count(*) as ids from customer group by 1")
def posting_sizes(spark, sf):
    return state.posting_sizes(table(spark, sf, "customer"), "c_mktsegment", "c_custkey")


# -- mutations -------------------------------------------------------------------


@registered("select l_orderkey, l_linenumber, count(*) as holders from lineitem group by 1, 2 having count(*) > 1")
def unique_violations(spark, sf):
    return state.unique_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@registered("""
  with held as (select distinct c_name as v from customer where c_custkey % 3 = 0),
       b as (select c_custkey as id, 'Customer#' || lpad((c_custkey - c_custkey % 2)::varchar, 9, '0') as name from customer)
  select id, name, case when name in (select v from held) then 'taken'
                        when row_number() over (partition by name order by id) > 1 then 'repeated' else 'ok' end as verdict from b
""")
def insert_unique_verdicts(spark, sf):
    c = table(spark, sf, "customer")
    held = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    even = F.col("c_custkey") - F.col("c_custkey") % 2
    batch = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Customer#"), F.lpad(even.cast("string"), 9, "0")).alias("name"))
    return state.insert_unique(held, batch, "id", ["name"], "id")


def _halves(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    base = o.where("o_orderkey % 3 <> 0")
    batch = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return base, batch


@registered("""
  select o_orderkey, case when o_orderkey % 2 = 0 then 'X' else o_orderstatus end as o_orderstatus,
         case when o_orderkey % 2 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice
  from orders where o_orderkey % 3 <> 0 or o_orderkey % 2 = 0
""")
def upsert_merge(spark, sf):
    return state.upsert(*_halves(spark, sf), "o_orderkey")


@registered("""
  select o_orderkey, case when o_orderkey % 2 = 0 then coalesce(nullif('X', o_orderstatus), o_orderstatus) else o_orderstatus end as o_orderstatus, o_totalprice
  from orders where o_orderkey % 3 <> 0
""")
def patch_merge(spark, sf):
    base, batch = _halves(spark, sf)
    return state.patch(base, batch.withColumn("o_totalprice", F.lit(None).cast("double")), "o_orderkey")


@registered("""
  select o_orderkey as id, (o_orderkey % 4)::bigint as expected, version,
         case when version is null then 'missing' when o_orderkey % 4 = 0 or o_orderkey % 4 = version then 'ok' else 'aborted' end as verdict
  from (select o_orderkey, case when o_orderkey % 5 <> 0 then (o_orderkey % 3 + 1)::bigint end as version from orders)
""")
def cas_verdict(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    held = o.where("id % 5 <> 0").withColumn("version", F.col("id") % 3 + 1)
    return state.compare_and_set(held, o.withColumn("expected", F.col("id") % 4), "id")


@registered("select o_custkey as id, max(o_orderkey) as o_orderkey, max_by(o_totalprice, o_orderkey) as o_totalprice from orders group by 1")
def upsert_repeated(spark, sf):
    """A batch with many rows for a key: the last one stays."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_totalprice")
    return state.upsert(o.limit(0), o, "id", "o_orderkey")


@registered("""
  select o_orderkey, expected, version, case when version is null then 'missing' when expected = 0 or (expected = version and first) then 'ok' else 'aborted' end as verdict
  from (select *, o_orderkey = min(o_orderkey) filter (where expected = 0 or expected = version) over (partition by id) as first
        from (select o_custkey as id, o_orderkey, (o_orderkey % 4)::bigint as expected, case when o_custkey % 5 <> 0 then (o_custkey % 3 + 1)::bigint end as version from orders))
""")
def cas_repeated(spark, sf):
    """Several requests for one version: the first one passes."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", (F.col("o_orderkey") % 4).alias("expected"))
    held = o.where("id % 5 <> 0").select("id", (F.col("id") % 3 + 1).alias("version")).distinct()
    return state.compare_and_set(held, o, "id", "o_orderkey").drop("id")


@registered("select o_orderkey, o_orderstatus from orders where o_orderkey not in (select o_orderkey from orders where o_orderpriority = '5-LOW')")
def delete_apply(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return state.delete(o, o.where("o_orderpriority = '5-LOW'"), "o_orderkey").drop("o_orderpriority")


@registered("""
  select distinct value, id from (
    (select c_mktsegment as value, c_custkey as id from customer where c_custkey % 2 = 0 and c_custkey % 7 <> 0)
    union all select c_mktsegment, c_custkey from customer where c_custkey % 5 = 0)
""")
def segment_merge(spark, sf):
    p = state.postings(table(spark, sf, "customer"), "c_mktsegment", "c_custkey")
    return state.merge_segments(p.where("id % 2 = 0"), p.where("id % 5 = 0"), p.where("id % 7 = 0"), ["value", "id"])


# -- change feed -----------------------------------------------------------------


@registered("select event_id, event_type, row_number() over (partition by event_type order by event_id) as coll_seq from events")
def collseq(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return changes.collection_seq(e, "event_type", "event_id")


def _lossy(spark, sf):
    """A feed per kind of event whose counter misses every 13th number and repeats none."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    return changes.collection_seq(e, "event_type", "event_id").where("coll_seq % 13 <> 0")


_LOSSY_SQL = "(select * from (select event_id, event_type, row_number() over (partition by event_type order by event_id) as coll_seq from events) where coll_seq % 13 <> 0)"


@registered(f"""
  select event_id, event_type, coll_seq, coalesce(coll_seq > lag(coll_seq) over w + 1, false) as gap, coalesce(coll_seq = lag(coll_seq) over w, false) as duplicate
  from {_LOSSY_SQL} window w as (partition by event_type order by coll_seq)
""")
def gap_detect(spark, sf):
    return changes.gaps(_lossy(spark, sf), "coll_seq", "event_type")


@registered(f"select event_id, coll_seq > 13 as stale from {_LOSSY_SQL}")
def stale_prefix(spark, sf):
    return changes.stale(_lossy(spark, sf), "coll_seq", "event_type").select("event_id", "stale")


_ARRIVED_SQL = f"(select *, (event_id // 1000) * 1000 + (event_id * 7) % 1000 as arrival from {_LOSSY_SQL})"


def _arrived(spark, sf):
    """The lossy feed in an order of arrival that is not its own."""
    return _lossy(spark, sf).withColumn("arrival", F.floor(F.col("event_id") / 1000) * 1000 + F.col("event_id") * 7 % 1000)


_GAPS_SQL = f"""
  select event_id, coll_seq, arrival, event_type, greatest(coalesce(max(coll_seq) over (partition by event_type order by arrival, event_id rows between unbounded preceding and 1 preceding), 0), 0) as seen
  from {_ARRIVED_SQL}
"""


@registered(f"select event_id, coll_seq > seen + 1 as gap, coll_seq <= seen as duplicate from ({_GAPS_SQL})")
def gap_arrival(spark, sf):
    return changes.gaps(_arrived(spark, sf), "coll_seq", "event_type", arrival="arrival", block=1000).select("event_id", "gap", "duplicate")


@registered(f"select event_id, bool_or(coll_seq > seen + 1) over (partition by event_type order by arrival, event_id rows between unbounded preceding and current row) as stale from ({_GAPS_SQL})")
def stale_arrival(spark, sf):
    return changes.stale(_arrived(spark, sf), "coll_seq", "event_type", arrival="arrival", block=1000).select("event_id", "stale")


@registered("select event_id, user_id, event_type from events where event_id > 100 and event_type = 'click'")
def replay_after(spark, sf):
    return changes.replay(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_id", 100, F.col("event_type") == "click")


@registered("select event_id, ts, event_type from events order by event_id desc limit 1024")
def backlog_tail(spark, sf):
    return changes.backlog(table(spark, sf, "events").select("event_id", "ts", "event_type"), "event_id")


@registered("select min(event_id) as oldest, max(event_id) as newest, count(*) as events from events")
def backlog_bounds(spark, sf):
    return table(spark, sf, "events").agg(F.min("event_id").alias("oldest"), F.max("event_id").alias("newest"), F.count("*").alias("events"))


@registered("""
  select id, event_type, value from (
    select user_id as id, event_type, value, row_number() over (partition by user_id order by event_id desc) as r from events)
  where r = 1 and event_type <> 'error'
""")
def snapshot_plus_delta(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", "event_type", "value")
    half = 100
    snap = state.fold(e.where(F.col("event_id") < half), "id", ["event_id"], deleted(), version=None)
    delta = e.where(F.col("event_id") >= half).withColumn("gone", deleted())
    return changes.merge(snap, delta, "id", "event_id", "gone").drop("event_id")


_SEEN_SQL = "(select user_id, event_id, (event_id * 7919) % 101 as version from events)"


@registered(f"""
  select event_id, user_id, version, highest, coalesce(version < highest, false) as rolled_back from (
    select *, max(version) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as highest from {_SEEN_SQL})
""")
def rollback_detect(spark, sf):
    seen = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") * 7919 % 101).alias("version"))
    return changes.rollbacks(seen, "user_id", "version", "event_id")


@registered("select event_id, user_id % 50 as token, row_number() over (partition by user_id % 50 order by event_id) = 1 as accepted from events")
def single_use_tokens(spark, sf):
    return changes.first_uses(table(spark, sf, "events").select("event_id", (F.col("user_id") % 50).alias("token")), "token", "event_id")


@registered(_FOLD_SQL)
def view_stream(spark, sf):
    """The folded view, maintained by a stream over the events until they are read."""
    from .streaming.views import FoldedView

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        root = f"{shared.rstrip('/')}/quern/view-{uuid.uuid4().hex}"
    else:
        root = tempfile.mkdtemp(prefix="quern-view-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = f"file://{root}"
    path = f"{sf}/events.parquet"
    # a file source wants a folder or a pattern
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/events*.parquet")
    view = FoldedView(spark, root, "user_id", LOG_ORDER, deleted())
    view.start(stream.select("user_id", "ts", "event_id", "event_type", "value")).awaitTermination()
    return view.current().select(F.col("user_id").alias("id"), F.col("events").alias("version"), "event_type", "value")


# -- schema and codec ------------------------------------------------------------

CUSTOMER = [Field(2, "name", "string", blind=True), Field(3, "segment", "string", index=True), Field(4, "balance", "double")]


def _stored_customer(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("f2"), F.col("c_mktsegment").alias("f3"), F.col("c_acctbal").alias("f4"))


@registered("select c_custkey as _id, c_name as full_name, c_mktsegment as segment, c_acctbal as balance from customer")
def schema_rename(spark, sf):
    from .schema import logical, renamed

    return logical(_stored_customer(spark, sf), [renamed(CUSTOMER[0], "full_name"), *CUSTOMER[1:]])


@registered("select c_custkey as _id, c_name as name, c_acctbal as balance, null::bigint as seen_at from customer")
def schema_add_drop(spark, sf):
    from .schema import logical

    return logical(_stored_customer(spark, sf), [CUSTOMER[0], CUSTOMER[2], Field(7, "seen_at", "int64")])


@registered("""
  select * from (values ('rename-field', 2, 'reindex'), ('retype-field', 4, 'breaking'), ('add-field', 5, 'safe'), ('add-field', 6, 'reindex'), ('reuse-reserved', 9, 'breaking'), ('remove-field', 3, 'breaking')) t(kind, no, safety)
""")
def schema_diff(spark, sf):
    from dataclasses import replace

    from .plans.migration import diff

    new = [replace(CUSTOMER[0], name="full_name"), replace(CUSTOMER[2], type="string"), Field(5, "a", "bool"), Field(6, "b", "int64", index=True), Field(9, "c", "string")]
    return spark.createDataFrame([(c.kind, c.no, c.safety) for c in diff(CUSTOMER, new, [9])], "kind string, no int, safety string")


@registered("select event_id, json_extract_string(props, '$.k')::bigint as k, json_extract_string(props, '$.k') in ('true', '1') as flag from events")
def json_coerce(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return e.select("event_id", codec.coerce(F.col("k"), "int64").alias("k"), codec.coerce(F.col("k"), "bool").alias("flag"))


@registered("select c_custkey as _id, c_name as name, c_mktsegment as segment, c_acctbal as balance from customer")
def json_round_trip(spark, sf):
    from .schema import logical

    rec = logical(_stored_customer(spark, sf), CUSTOMER)
    return codec.parse(codec.render(rec, CUSTOMER), "json", CUSTOMER)


# -- access ----------------------------------------------------------------------


@registered("""
  select n.n_name as principal, case when m is null then 0 when m & 128 <> 0 then 255 else m end::int as mask
  from nation n left join (select n_name, (n_nationkey * 37) % 256 as m from nation where n_nationkey % 4 <> 0) a using (n_name)
""")
def acl_effective(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("principal"), "n_nationkey")
    acl = n.where("n_nationkey % 4 <> 0").select("principal", (F.col("n_nationkey") * 37 % 256).alias("mask"))
    return access.effective_masks(n.select("principal"), acl, "principal")


@registered("select n_regionkey as principal, bit_or((n_nationkey * 37) % 256) as mask from nation group by 1")
def acl_roles(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("principal"), (F.col("n_nationkey") * 37 % 256).alias("bits"))
    return access.roles_mask(n, "principal", "bits")


@registered("""
  select * from (
    select r_name as principal, ((case when (r_regionkey * 31 + 5) & 128 <> 0 then 255 else r_regionkey * 31 + 5 end) & ~(case when (r_regionkey * 17) & 128 <> 0 then 255 else r_regionkey * 17 end) & 255)::int as mask
    from region) where mask <> 0
""")
def acl_fold(spark, sf):
    r = table(spark, sf, "region")
    log = r.select(F.col("r_name").alias("principal"), F.lit(1).alias("seq"), F.lit("grant").alias("op"), (F.col("r_regionkey") * 31 + 5).alias("mask"))
    return access.fold_grants(log.unionByName(r.select(F.col("r_name").alias("principal"), F.lit(2).alias("seq"), F.lit("revoke").alias("op"), (F.col("r_regionkey") * 17).alias("mask"))))


@registered("""
  select event_id as jti, case when event_id % 11 = 0 then 'unknown key' when event_id % 7 = 0 then 'bad signature' when event_id % 5 = 0 then 'expired' when event_type = 'view' then 'other collection' when event_id % 4 = 2 then 'out of scope' else 'ok' end as verdict from events
""")
def token_verify(spark, sf):
    e = table(spark, sf, "events")
    t = e.select(F.col("event_id").alias("jti"), (F.col("event_id") % 11 != 0).alias("kid_known"), (F.col("event_id") % 7 != 0).alias("signed"), F.when(F.col("event_id") % 5 == 0, 1).otherwise(100).cast("long").alias("exp"), F.lit("d").alias("db"), F.when(F.col("event_type") == "view", "x").otherwise("c").alias("coll"), F.when(F.col("event_id") % 4 == 2, 2).otherwise(3).alias("scope"), F.lit(True).alias("single_use"), F.col("event_id").alias("seq"))
    return access.token_verdicts(t, now_ms=50, catalog="d", collection="c", needed=1).select("jti", "verdict")


# -- scalar functions ------------------------------------------------------------


@registered("select o_orderkey as k, 1700000000000 + o_orderkey as ms, (o_orderkey % 1024) as worker, (o_orderkey % 4096) as seq from orders")
def snowflake_decode(spark, sf):
    k = F.col("o_orderkey")
    made = fn.id_of(k + fn.ID_EPOCH_MS, k % 1024, k % 4096)
    parts = fn.id_parts(F.col("i"))
    return table(spark, sf, "orders").select(k.alias("k"), made.alias("i")).select("k", *[c.alias(n) for n, c in parts.items()])


@registered("select c_custkey, left(c_name, 4) || '…' || right(c_name, 4) || ' (' || length(c_name) || 'b)' as masked from customer")
def mask_text(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fn.mask_secret(F.col("c_name")).alias("masked"))


@registered("select user_id, event_id - user_id as v from events")
def zigzag_round_trip(spark, sf):
    v = F.col("event_id") - F.col("user_id")
    return table(spark, sf, "events").select("user_id", fn.unzigzag(fn.zigzag(v)).alias("v"))


@registered("""
  select o_orderkey, case when o_orderkey < 128 then printf('%02X', o_orderkey) when o_orderkey < 16384 then printf('%02X%02X', (o_orderkey & 127) | 128, o_orderkey >> 7)
         else printf('%02X%02X%02X', (o_orderkey & 127) | 128, ((o_orderkey >> 7) & 127) | 128, o_orderkey >> 14) end as coded,
         printf('%016X', o_orderkey) as id, left(sha256(o_orderpriority), 16) as print from orders
""")
def wire_values(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.hex(fn.varint(k)).alias("coded"), F.hex(fn.id_bytes(k)).alias("id"), fn.thumbprint(F.col("o_orderpriority")).alias("print"))


@registered("select o_orderkey, case when o_orderkey % 900 = 0 then 300 else (o_orderkey % 900)::int end as ttl from orders")
def ttl_default(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fn.ttl_or_default((F.col("o_orderkey") % 900).cast("string")).alias("ttl"))


# -- objects ---------------------------------------------------------------------


def _objects(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("object_id"), F.col("source").alias("owner"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 4 == 0, "public").otherwise("private").alias("visibility"))


@registered("select doc_id as object_id, source as owner, n_chars as size from documents where source = 'src3'")
def object_list(spark, sf):
    return objects.owned(_objects(spark, sf), "src3").drop("visibility")


@registered("select doc_id as object_id, source as owner from documents where doc_id % 4 = 0 or source = 'src5'")
def object_readable(spark, sf):
    return objects.readable(_objects(spark, sf), "src5").select("object_id", "owner")


@registered("select source as owner, count(*) as objects, sum(n_chars)::bigint as bytes from documents group by 1")
def object_stats(spark, sf):
    return objects.stats(_objects(spark, sf))


@registered("""
  select doc_id as object_id, c::int as chunk_no, (c * 1024)::bigint as "offset", least(1024, n_chars - c * 1024)::bigint as length
  from documents, unnest(range(0, greatest(1, ((n_chars + 1023) // 1024)))) t(c)
""")
def chunk_layout(spark, sf):
    return objects.chunk_layout(_objects(spark, sf), 1024)


@registered("select doc_id as object_id, n_chars as size, greatest(1, (n_chars + 1023) // 1024)::bigint as chunks from documents")
def chunk_totals(spark, sf):
    return objects.totals(objects.chunk_layout(_objects(spark, sf), 1024))


# -- names -----------------------------------------------------------------------

ZONE = "example.com"
_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"
_IN_ZONE = "(h = 'example.com' or h like '%.example.com')"


def _hosts(spark, sf):
    return table(spark, sf, "pages").select(fn.dns_name(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1)).alias("name"), "page_id")


def _zone_hosts(spark, sf):
    return _hosts(spark, sf).where(fn.in_zone(F.col("name"), F.lit(ZONE)))


def _records(spark, sf):
    """One A record per host of the zone (its first page), a wildcard, and aliases al<i> made from hosts."""
    h = _zone_hosts(spark, sf).groupBy("name").agg(F.min("page_id").alias("p"))
    a = h.select("name", F.lit("A").alias("type"), F.concat(F.lit("10.0.0."), F.col("p") % 250).alias("rdata"))
    c = h.select(F.concat(F.lit("al"), "p", F.lit("."), F.lit(ZONE)).alias("name"), F.lit("CNAME").alias("type"), F.col("name").alias("rdata"))
    w = spark.createDataFrame([("*.wild.example.com", "A", "10.9.9.9"), ("*.text.example.com", "TXT", "t"), ("loop.example.com", "CNAME", "loop.example.com")], "name string, type string, rdata string")
    return a.unionByName(c).unionByName(w)


_RECORDS_SQL = f"""
  h0 as (select {_HOST} as h, page_id from pages), h1 as (select h as name, min(page_id) as p from h0 where {_IN_ZONE} group by 1),
  rec as (select name, 'A' as type, '10.0.0.' || (p % 250) as rdata from h1 union all select 'al' || p || '.example.com', 'CNAME', name from h1
          union all values ('*.wild.example.com', 'A', '10.9.9.9'), ('*.text.example.com', 'TXT', 't'), ('loop.example.com', 'CNAME', 'loop.example.com'))
"""


@registered(f"select page_id, {_HOST} as name from pages")
def dns_normalize(spark, sf):
    return _hosts(spark, sf).select("page_id", "name")


@registered(f"with {_RECORDS_SQL} select distinct name from rec")
def dns_names(spark, sf):
    return dns.names(_records(spark, sf))


_NODES_SQL = "nodes as (select distinct node from (select unnest(list_transform(range(1, len(string_split(name, '.')) + 1), lambda i: array_to_string(list_slice(string_split(name, '.'), i, 100), '.'))) as node from rec) where node = 'example.com' or node like '%.example.com')"


@registered(f"with {_RECORDS_SQL}, {_NODES_SQL} select node from nodes")
def dns_nodes(spark, sf):
    return dns.nodes(_records(spark, sf), ZONE)


def _asked(spark, sf):
    h = _zone_hosts(spark, sf)
    return h.select(F.col("page_id").alias("qid"), F.concat(F.lit("no.such."), "name").alias("name"))


@registered(f"""
  with {_RECORDS_SQL}, {_NODES_SQL}
  select page_id as qid, 'no.such.' || h as name, max_by(node, length(node)) as encloser from h0 join nodes on ('no.such.' || h) like '%.' || node
  where {_IN_ZONE} group by 1, 2
""")
def dns_closest_encloser(spark, sf):
    return dns.closest_encloser(_asked(spark, sf), dns.nodes(_records(spark, sf), ZONE), ZONE)


@registered(f"""
  with {_RECORDS_SQL}
  select page_id as qid, case when h in (select name from h1) then 'NOERROR' else 'REFERRAL' end as status,
         case when h in (select name from h1) then '10.0.0.' || ((select p from h1 where name = h) % 250) end as answer, 0 as hops from h0
  union all select 1000000 + p, 'NOERROR', '10.0.0.' || (p % 250), 1 from h1
  union all values (-1, 'NOERROR', '10.9.9.9', 0), (-2, 'NODATA', null, 0), (-3, 'NXDOMAIN', null, 0), (-4, 'TRUNCATED', null, 9), (-5, 'NXDOMAIN', null, 0), (-6, 'NODATA', null, 0), (-7, 'NOERROR', 'loop.example.com', 0)
""")
def dns_resolve(spark, sf):
    h = _zone_hosts(spark, sf).groupBy("name").agg(F.min("page_id").alias("p"))
    asked = _hosts(spark, sf).select(F.col("page_id").alias("qid"), "name", F.lit("a").alias("type"))
    alias = h.select((F.col("p") + 1_000_000).alias("qid"), F.concat(F.lit("AL"), "p", F.lit(f".{ZONE}.")).alias("name"), F.lit("A").alias("type"))
    some = [(-1, "x.wild.example.com", "A"), (-2, "x.text.example.com", "A"), (-3, "nothing.example.com", "A"), (-4, "loop.example.com", "A"), (-5, "wild.example.com", "A"), (-6, "*.text.example.com", "A"), (-7, "loop.example.com", "CNAME")]
    asked = asked.unionByName(alias).unionByName(spark.createDataFrame(some, "qid long, name string, type string"))
    return dns.resolve(asked, _records(spark, sf), ZONE).select("qid", "status", F.array_join("answers", ",").alias("answer"), F.size("chain").alias("hops"))


@registered(f"with {_RECORDS_SQL} select name, type, rdata from rec")
def zone_list(spark, sf):
    return dns.list_zone(_records(spark, sf)).select("name", "type", "rdata")


@registered(f"with {_RECORDS_SQL} select name, type, rdata, ttl from (select name, type, rdata, 0 as ttl from rec where not (name in (select name from h1) and type = 'A') union all select name, 'A', '10.1.0.' || i, 300 from h1, (values (1), (2)) t(i))")
def rrset_replace(spark, sf):
    """All address records of the hosts give way to two new ones each."""
    old = dns.prepared(_records(spark, sf).withColumn("zone", F.lit(ZONE)), 1).drop("verdict").withColumn("ttl", F.lit(0))
    h = _zone_hosts(spark, sf).select("name").distinct()
    new = h.select(F.lit(ZONE).alias("zone"), F.upper("name").alias("name"), F.lit("a").alias("type"), F.explode(F.array(F.lit("10.1.0.1"), F.lit("10.1.0.2"))).alias("rdata"))
    return dns.put_rrsets(old, new, 2).select("name", "type", "rdata", "ttl")


@registered(f"with {_RECORDS_SQL} select name || '|' || type as lookup_key, count(*) as records from rec group by 1")
def rrset_sizes(spark, sf):
    return dns.rrsets(dns.normalized(_records(spark, sf))).select("lookup_key", F.size("rdata").cast("long").alias("records"))


# -- extensions: what the record store lacks and Spark has -------------------------


@registered("select n_name, count(*) as customers, sum(c_acctbal::decimal(18,2))::double as balance from customer join nation on c_nationkey = n_nationkey group by 1")
def ext_join_group(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", F.col("c_acctbal").cast("decimal(18,2)").alias("b"))
    by = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("b").alias("b"))  # before the join
    n = table(spark, sf, "nation")
    return by.join(n, by["c_nationkey"] == n["n_nationkey"]).select("n_name", "customers", F.col("b").cast("double").alias("balance"))


@registered("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def ext_anti_join(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@registered("select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def ext_rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@registered("select * from (select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3")
def ext_top_per_key(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("r")).where("r <= 3")


@registered("select time_bucket(interval '1 hour', ts) as hour, event_type, count(*) as n from events group by 1, 2")
def ext_tumbling(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts")).alias("hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

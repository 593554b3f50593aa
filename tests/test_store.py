"""The commit log, migration rules, codec, blobs and streams."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quern.functions import scalar as fn
from quern.operators import access, changes, dns, objects, query, state, tokens
from quern.plans import migration
from quern.schema import ID, Field, SchemaError, checked
from quern.sources import blobs, codec
from quern.sources.log import Catalog, Collection, CommitConflict, MigrationRefused

USERS = [Field(2, "name", "string", index=True, required=True), Field(3, "email", "string", blind=True), Field(4, "age", "int32")]


def rows(spark, data, schema="_id long, name string, email string, age int"):
    return spark.createDataFrame(data, schema)


def test_log_against_a_dict(spark, tmp_path):
    c = Collection.define(spark, f"file://{tmp_path}/users", USERS)
    rng, model, version = random.Random(1), {}, {}
    for step in range(7):
        kind = rng.choice(["put", "delete", "update", "compact"]) if step else "put"
        ids = rng.sample(range(8), 3)
        if kind == "put":
            c.put(rows(spark, [(i, f"n{step}", None, step) for i in ids]))
            for i in ids:
                model[i], version[i] = (f"n{step}", None, step), version.get(i, 0) + 1
        elif kind == "delete":
            c.delete(spark.createDataFrame([(i,) for i in ids], "_id long"))
            for i in ids:
                if model.pop(i, None):
                    version[i] += 1
        elif kind == "update" and (live := [i for i in ids if i in model]):
            c.update(spark.createDataFrame([(i, step + 100) for i in live], "_id long, age int"))
            for i in live:
                model[i], version[i] = (*model[i][:2], step + 100), version[i] + 1
        elif kind == "compact":
            c.compact()
        c = Collection(spark, f"file://{tmp_path}/users")  # reopened
        got = {r["_id"]: (r["name"], r["email"], r["age"], r["version"]) for r in c.state(with_version=True).collect()}
        assert got == {i: (*v, version[i]) for i, v in model.items()}
    # versions go on after a compaction that covers a deletion
    c.delete(c.state().select("_id").limit(1))
    c.compact()
    gone = [i for i in version if i not in {r["_id"] for r in c.state().collect()}]
    c.put(rows(spark, [(gone[0], "again", None, 1)]))
    assert c.state(with_version=True).where(F.col("_id") == gone[0]).first()["version"] >= version[gone[0]]


def test_writes_refuse(spark, tmp_path):
    c = Collection.define(spark, f"file://{tmp_path}/u", USERS)
    with pytest.raises(ValueError, match="required"):
        c.put(rows(spark, [(1, None, None, None)]))
    c.put(rows(spark, [(1, "a", "x", 5)]))
    verdicts = c.insert_unique(rows(spark, [(2, "a", "y", 1), (3, "b", "z", 1), (4, "b", "w", 1), (5, "", "q", 1)]), ["name"], "_id")
    assert {r["_id"]: r["verdict"] for r in verdicts.collect()} == {2: "taken", 3: "ok", 4: "repeated", 5: "missing"}
    verdicts = c.compare_and_set(spark.createDataFrame([(1, 1, 9), (3, 5, 9), (8, 1, 9)], "_id long, expected long, age int"))
    assert {r["_id"]: r["verdict"] for r in verdicts.collect()} == {1: "ok", 3: "aborted", 8: "missing"}
    assert {r["_id"]: (r["age"], r["version"]) for r in c.state(with_version=True).collect()} == {1: (9, 2), 3: (1, 1)}
    with pytest.raises(KeyError):
        c.update(spark.createDataFrame([(77, 1)], "_id long, age int"))
    c.update(spark.createDataFrame([(1, 7)], "_id long, age int"), unset=["email"])
    assert c.state().where("_id = 1").first()["email"] is None
    # a commit that is claimed by another writer shows nothing
    before = c.head()
    c.files.create(f"commits/{before + 1:012d}.json", "{}")
    head = c.files.create
    c.files.create = lambda name, text: False if name.startswith("commits") else head(name, text)
    with pytest.raises(CommitConflict):
        c.put(rows(spark, [(9, "z", None, None)]))
    assert c.head() == before and c.count() == 2


def test_schema_rules():
    for bad in (Field(1, "x", "bool"), Field(2, "_id", "bool"), Field(2, "x", "date"), Field(2, "x", "bytes", index=True), Field(2, "x", "string", bucket_width=5), Field(2, "x", "int32", bucket_width=0), Field(2, "x", "int32", disk=True), Field(9, "x", "bool")):
        with pytest.raises(SchemaError):
            checked([bad], [9])
    with pytest.raises(SchemaError):
        checked([Field(2, "x", "bool"), Field(2, "y", "bool")])


def test_migration_table():
    name, email, age = USERS
    kinds = lambda new, **k: [(c.kind, c.safety) for c in migration.diff(USERS, new, **k)]
    assert kinds(USERS) == []
    assert kinds([*USERS, Field(5, "a", "bool")]) == [("add-field", "safe")]
    assert kinds([*USERS, Field(5, "a", "bool", index=True)]) == [("add-field", "reindex")]
    assert kinds([name, email, replace(age, type="string", name="y", index=True)]) == [("retype-field", "breaking")]
    assert kinds([name, email, replace(age, name="years")]) == [("rename-field", "safe")]
    assert kinds([replace(name, name="n"), email, age]) == [("rename-field", "reindex")]
    assert kinds([name, email, replace(age, index=True)]) == [("change-index", "reindex")]
    assert kinds([name, email, replace(age, required=True)]) == [("add-required", "safe")]
    assert kinds([name, email]) == [("remove-field", "breaking")]
    assert kinds([*USERS, Field(9, "z", "bool")], reserved=[9]) == [("reuse-reserved", "breaking")]
    p = migration.plan(USERS, [name, email], drop=["age"])
    assert p.allowed and p.reserved == [4] and p.rebuild
    assert not migration.plan(USERS, [*USERS, Field(9, "z", "bool")], [9], allow_retype=True).allowed
    assert migration.describe(migration.plan(USERS, [name, email]).blockers) == "field 4 (age): remove-field"


def test_catalog(spark, tmp_path):
    db = Catalog(spark, f"file://{tmp_path}/db")
    db.define("users", USERS).put(rows(spark, [(1, "a", "x", 5)]))
    assert db.collections() == ["users"]
    renamed = [USERS[0], USERS[1], replace(USERS[2], name="years"), Field(6, "seen", "int64")]
    with pytest.raises(MigrationRefused):
        db.apply_registry({"other": [Field(2, "q", "bool")], "users": USERS[:1]})
    assert db.collections() == ["users"]
    db.define("users", renamed)
    assert db.collection("users").state().first().asDict() == {"_id": 1, "name": "a", "email": "x", "years": 5, "seen": None}
    db.grant("p", fn.READ | fn.WRITE)
    db.revoke("p", fn.WRITE)
    assert db.can("p", fn.READ) and not db.can("p", fn.WRITE)
    db.grant("root", fn.ADMIN)
    assert db.can("root", fn.DROP)


def test_queries(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    total, seen, cursor = o.count(), 0, None
    while True:
        page, cursor = query.page_with_cursor(o, "o_orderkey", cursor, 400)
        seen += len(page)
        if cursor is None:
            break
    assert seen == total
    with pytest.raises(query.QueryError):
        query.find_range(o, "o_totalprice", float("nan"), 1.0)
    with pytest.raises(query.QueryError):
        query.check_indexed(USERS, "age")
    assert query.find_limit(0) == 5000 and query.find_limit(-3) == 1
    assert query.bucket_hashes(0, 10**9, 1, b"k" * 32) is None
    plan = query.find(o, "o_orderstatus", "F")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan


def test_codec(spark):
    fields = [Field(2, "n", "int64"), Field(3, "ok", "bool"), Field(4, "raw", "bytes"), Field(5, "x", "double"), Field(6, "u", "uint64")]
    text = '{"_id": "7", "n": "9007199254740993", "ok": "1", "raw": "AAE=", "x": 1.5, "u": "18446744073709551615", "no": 1}'
    df = spark.createDataFrame([(text,)], "j string")
    r = codec.parse(df, "j", fields).first()
    assert (r["_id"], r["n"], r["ok"], bytes(r["raw"]), r["x"], int(r["u"])) == (7, 9007199254740993, True, b"\0\1", 1.5, 2**64 - 1)
    assert df.select(codec.unknown_keys("j", fields)).first()[0] == ["no"]
    again = codec.parse(codec.render(codec.parse(df, "j", fields), fields), "json", fields).first()
    assert again == r
    loose = spark.createDataFrame([("",), ("true",)], "t string")
    assert [x[0] for x in loose.select(codec.coerce(F.col("t"), "int32", lenient=True)).collect()] == [0, 1]
    for lenient in (False, True):  # words are no numbers
        with pytest.raises(Exception):
            spark.createDataFrame([("abc",)], "t string").select(codec.coerce(F.col("t"), "int32", lenient=lenient)).collect()
    # a bare number that a sender may have rounded is refused
    for text in ('{"_id": "7", "n": 9007199254740993}', '{"_id": 9007199254740993}'):
        with pytest.raises(Exception, match="send as text"):
            codec.parse(spark.createDataFrame([(text,)], "j string"), "j", fields).collect()
    assert codec.parse(spark.createDataFrame([('{"_id": 7, "n": 9007199254740991, "ok": "TRUE"}',)], "j string"), "j", fields).first()[:3] == (7, 2**53 - 1, False)


def test_blobs(spark):
    objects = spark.createDataFrame([(1, bytes(range(256)) * 10), (2, b"")], "object_id long, content binary")
    chunks = blobs.split(objects, 1000)
    totals = chunks.groupBy("object_id").agg(F.count("*").alias("chunks"))
    sealed = blobs.encrypt(chunks, totals, b"k" * 32)
    opened = blobs.decrypt(sealed, b"k" * 32)
    assert {r["object_id"]: (r["chunks"], r["size"]) for r in blobs.complete(opened).collect()} == {1: (3, 2560), 2: (1, 0)}
    assert b"".join(bytes(r["data"]) for r in opened.where("object_id = 1").orderBy("chunk_no").collect()) == bytes(range(256)) * 10
    with pytest.raises(Exception):
        blobs.decrypt(sealed.withColumn("chunk_no", F.col("chunk_no") + 1), b"k" * 32).collect()


def test_blind_hash(spark):
    import hashlib
    import hmac

    for key in (b"k", b"k" * 32, b"k" * 100):
        got = spark.createDataFrame([("é",), (None,)], "v string").select(fn.blind(F.col("v"), key)).collect()
        assert [r[0] for r in got] == [hmac.new(key, "é".encode(), hashlib.sha256).hexdigest()[:32], None]


def test_view_equals_fold(spark, sf):
    import quern.queries as q

    assert sorted(q.view_stream(spark, sf).collect()) == sorted(q.state_fold(spark, sf).collect())


def test_resume(spark):
    feed = spark.createDataFrame([(i,) for i in range(50, 60)], "seq long")
    assert changes.resume_lost(feed, "seq", 10) and changes.resume_lost(feed, "seq", 99) and not changes.resume_lost(feed, "seq", 52)
    assert changes.replay(feed, "seq", 57).count() == 2 and changes.replay(feed, "seq", 0).count() == 0


def test_insert_makes_ids(spark, tmp_path):
    c = Collection.define(spark, f"file://{tmp_path}/i", USERS)
    with pytest.raises(ValueError, match="insert"):
        c.put(rows(spark, [(None, "a", None, 1)]))
    many = spark.range(5000, numPartitions=3).select(F.concat(F.lit("n"), "id").alias("name"))
    first = [r[ID] for r in c.insert(many).collect()]
    again = [r[ID] for r in c.insert(rows(spark, [(None, "x", None, 1), (5, "y", None, 2), (None, "z", None, 3)])).collect()]
    made = [c.generate_id(), c.generate_id()]
    assert len({*first, *again, *made}) == 5005 and 5 in again and c.count() == 5003
    assert max(first) < min(i for i in again if i != 5) and max(again) < made[0] < made[1]


def test_batches_with_repeated_keys(spark, tmp_path):
    c = Collection.define(spark, f"file://{tmp_path}/r", USERS)
    c.put(rows(spark, [(1, "a", None, 1), (1, "b", None, 2), (2, "c", None, 3)]).coalesce(1))
    assert {r[ID]: (r["name"], r["version"]) for r in c.state(with_version=True).collect()} == {1: ("b", 2), 2: ("c", 1)}
    c.update(spark.createDataFrame([(1, "x", None), (1, None, 7), (1, None, 8)], "_id long, email string, age int").coalesce(1))
    assert c.state(with_version=True).where("_id = 1").first()[1:] == ("b", "x", 8, 3)
    asked = spark.createDataFrame([(2, 1, 10), (2, 1, 11), (2, 2, 12)], "_id long, expected long, age int").coalesce(1)
    assert sorted(r["verdict"] for r in c.compare_and_set(asked).collect()) == ["aborted", "aborted", "ok"]
    assert c.state(with_version=True).where("_id = 2").first()[3:] == (10, 2)
    with pytest.raises(Exception, match="null key"):
        state.upsert(c.state(), rows(spark, [(None, "a", None, 1)]), ID).collect()


def test_pins_and_compaction(spark, tmp_path):
    c = Collection.define(spark, f"file://{tmp_path}/p", USERS)
    for k in range(4):
        c.put(rows(spark, [(k, "n", None, k)]))
        if k == 1:
            c.checkpoint()
    assert c.compact(pinned=3)["commits_removed"] == 2
    assert [c.state(v).count() for v in (2, 3, 4)] == [2, 3, 4] and c.feed(2).count() == 2
    c.compact()
    assert c.count() == 4
    for read in (lambda: c.state(2), lambda: c.state(3), lambda: c.feed(1)):
        with pytest.raises(LookupError):
            read()


def test_a_dead_writer(spark, tmp_path):
    import json

    c = Collection.define(spark, f"file://{tmp_path}/d", USERS)
    c.put(rows(spark, [(1, "a", None, 1)]))
    # a writer that died between its claim and the move: the next one finishes it
    c.put(rows(spark, [(2, "b", None, 2)]))
    c.files.move("data/n=2", "staging/left")
    c.files.replace(f"commits/{2:012d}.json", json.dumps({"n": 2, "stage": "staging/left"}))
    other = Collection(spark, f"file://{tmp_path}/d")
    assert other.head() == 2 and other.count() == 2
    # a claim without data is a hole, not a compaction
    c.files.create(f"commits/{3:012d}.json", "{}")
    c.put(rows(spark, [(4, "d", None, 4)]))
    assert c.head() == 4 and c.feed(1).count() == 2


def test_registry_is_applied_whole(spark, tmp_path):
    db = Catalog(spark, f"file://{tmp_path}/w")
    with pytest.raises(SchemaError):
        db.apply_registry({"a": USERS, "b": [Field(2, "x", "date")]})
    assert db.collections() == [] and not db.files.exists("a/manifest.json")
    db.apply_registry({"a": USERS, "b": [Field(2, "x", "bool")]})
    assert db.collections() == ["a", "b"]
    db.collection("a").put(rows(spark, [(1, "n", None, 1)]))
    db.collection("b").put(spark.createDataFrame([(1, True)], "_id long, x boolean"))
    assert {(r["collection"], r["record"]) for r in db.feed({"a": 0, "b": 0}).collect()} == {("a", '{"name":"n","age":1}'), ("b", '{"x":true}')}


def test_feed_in_order_of_arrival(spark):
    feed = spark.createDataFrame([("a", s, k) for k, s in enumerate([1, 3, 2, 4])] + [("b", 3, 0)], "c string, seq long, at long")
    for block in (1, 2, 100):
        got = {(r["c"], r["at"]): (r["gap"], r["duplicate"], r["stale"]) for r in changes.stale(feed, "seq", "c", arrival="at", block=block).collect()}
        assert got == {("a", 0): (False, False, False), ("a", 1): (True, False, True), ("a", 2): (False, True, True), ("a", 3): (False, False, True), ("b", 0): (True, False, True)}
    assert not changes.stale(feed.where("c = 'b'"), "seq", "c", arrival="at", start=2).first()["stale"]
    seqs = changes.collection_seq(feed, "c", "seq", block=2).where("c = 'a'").collect()
    assert all(r["coll_seq"] == r["seq"] for r in seqs)
    assert changes.contiguous(feed.where("c = 'a'"), "seq", 1) == (4, False) and changes.contiguous(feed.where("seq <> 2"), "seq", 1) == (1, True)


def test_tokens(spark):
    ring = tokens.KeyRing(keep=2)
    ids = iter(range(100))
    make = lambda **k: tokens.issue(ring, lambda: next(ids), **({"sub": "u", "db": "d", "scope": 3, "collection": "c", "now_ms": 1000} | k))
    once, many = make(row_filter={"field": "owner", "value": "u"}), make(single_use=False)
    forged = once[:-2] + ("AA" if once[-2:] != "AA" else "BB")
    told = [forged, once, once, many, many, make(ttl_ms=1), make(db="e"), make(collection="x"), make(scope=2), "a.b", None, "..", make(collection="*")]
    old = tokens.verified(spark.createDataFrame([(k, t) for k, t in enumerate(told)], "n long, token string"), ring, seq="n", now_ms=1500, catalog="d", collection="c", needed=1).orderBy("n").collect()
    assert [r["verdict"] for r in old] == ["bad signature", "ok", "used", "ok", "ok", "expired", "other catalog", "other collection", "out of scope", "malformed", "malformed", "malformed", "ok"]
    assert old[1]["claims"]["row_filter"]["field"] == "owner" and old[2]["claims"] is None
    ring.rotate()
    ring.rotate()
    late = tokens.verified(spark.createDataFrame([(1, many)], "n long, token string"), ring, seq="n", now_ms=1500, catalog="d", collection="c", needed=1)
    assert late.first()["verdict"] == "unknown key"
    for bad in ({"scope": 0}, {"collection": "*", "row_filter": {"field": "a", "value": "b"}}):
        with pytest.raises(ValueError):
            make(**bad)
    with pytest.raises(PermissionError):
        make(scope=4, granted=3)


def test_names(spark):
    chain = [(f"a{i}.z.org", "CNAME", f"a{i + 1}.z.org" if i < 8 else "far.net") for i in range(9)]
    recs = spark.createDataFrame([*chain, ("*.w.z.org", "CNAME", '{"target": "h.z.org"}'), ("h.z.org", "A", "1.2.3.4"), ("j.z.org", "CNAME", '{"target": "H.z.org."}')], "name string, type string, rdata string")
    asked = spark.createDataFrame([(1, "a0.z.org", "A"), (2, "a1.z.org", "A"), (3, "x.w.z.org", "A"), (4, "j.z.org", "A")], "qid long, name string, type string")
    got = {r["qid"]: (r["status"], len(r["chain"])) for r in dns.resolve(asked, recs, "z.org").collect()}
    # an alias at a wildcard is no record set of the type asked
    assert got == {1: ("REFERRAL", 9), 2: ("REFERRAL", 8), 3: ("NODATA", 0), 4: ("NOERROR", 1)}
    assert [r[0] for r in dns.nodes(recs.limit(0), "z.org").collect()] == ["z.org"]
    stored = dns.prepared(recs.withColumn("zone", F.lit("Z.org.")), 1).drop("verdict")
    assert stored.count() == 12 and dns.resolve_any(stored, "H.Z.ORG.").count() == 1
    with pytest.raises(Exception, match="outside"):
        dns.put_rrsets(stored, spark.createDataFrame([("z.org", "x.org", "A", "1")], "zone string, name string, type string, rdata string"), 2).collect()
    keyed = stored.withColumn("id", F.col("name"))
    moved = dns.update_records(keyed, spark.createDataFrame([("h.z.org", "Q.z.org")], "id string, name string"), "id", 5).where("id = 'h.z.org'").first()
    assert (moved["name"], moved["lookup_key"], moved["updated_ms"], moved["created_ms"]) == ("q.z.org", "q.z.org|A", 5, 1)
    events = lambda zone: spark.createDataFrame([(zone,)], "zone string")
    assert [dns.refreshed(stored.limit(0), stored, events(z)).count() for z in ("z.org", "y.org", None)] == [12, 0, 12]
    assert [r["name"] for r in dns.list_zone(stored.where("type = 'A' or name = 'j.z.org'")).collect()] == ["h.z.org", "j.z.org"]


def test_small_values(spark):
    values = [0, 1, 127, 128, 300, 2**31, 2**63 - 1, -1]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", fn.varint(F.col("v")).alias("b"), fn.id_bytes(F.col("v")).alias("i")).collect()

    def groups(v):
        v, out = v % 2**64, []
        while v > 127:
            out, v = [*out, v & 127 | 128], v >> 7
        return bytes([*out, v])

    assert all(bytes(r["b"]) == groups(r["v"]) and bytes(r["i"]) == (r["v"] % 2**64).to_bytes(8) for r in got)
    back = spark.createDataFrame([(groups(v), v.to_bytes(8)) for v in values[:-1]], "b binary, i binary").select(fn.unvarint(F.col("b")), fn.bytes_id(F.col("i"))).collect()
    assert [tuple(r) for r in back] == [(v, v) for v in values[:-1]]
    texts = spark.createDataFrame([(None,), ("",), ("short",), ("a longer secret!!",)], "t string")
    assert [r[0] for r in texts.select(fn.mask_secret(F.col("t"))).collect()] == ["", "", "***", "a lo…et!! (17b)"]
    ttl = spark.createDataFrame([("1e3",), ("12.5",), ("0",), ("x",), (None,), ("NaN",)], "t string")
    assert [r[0] for r in ttl.select(fn.ttl_or_default(F.col("t"))).collect()] == [1000, 12, 300, 300, 300, 300]
    due = spark.createDataFrame([(66,), (67,)], "now long").select(fn.renew_due(F.col("now"), F.lit(0), F.lit(100))).collect()
    assert [r[0] for r in due] == [False, True]


def test_scoped_access_and_objects(spark):
    held = spark.createDataFrame([(1, "u"), (2, "v")], "_id long, owner string")
    assert access.get_scoped(held, ID, 1, "owner", "u").count() == 1 and access.get_scoped(held, ID, 2, "owner", "u").count() == 0
    batch = spark.createDataFrame([(1, "u"), (2, "v"), (None, "u")], "_id long, owner string")
    assert [r["verdict"] for r in access.put_scoped(batch, ID, "owner", "u").collect()] == ["ok", "out of scope", "no id"]
    assert [r[0] for r in access.delete_scoped(held, held.select(ID), ID, "owner", "u").collect()] == [1]
    files = spark.createDataFrame([(1, "u", "n", b"abc", None, "public"), (2, "v", "m", b"", "text/plain", None)], "object_id long, owner string, name string, content binary, content_type string, visibility string")
    meta = objects.put(files, 5)
    assert {r["object_id"]: (r["visibility"], r["size"], r["slug"]) for r in meta.collect()} == {1: ("public", 3, "1"), 2: ("private", 0, "")}
    ids = spark.createDataFrame([(1,), (2,), (3,)], "object_id long")
    assert {r[0]: r[1] for r in objects.delete_verdicts(meta, ids, "u").collect()} == {1: "ok", 2: "denied", 3: "missing"}
    assert objects.with_chunks(meta, blobs.split(files.withColumn("k", F.lit(1)), 2)).count() == 3


def test_followed_view(spark, tmp_path):
    from quern.streaming.views import DELTAS, FollowedView

    v = FollowedView(spark, f"file://{tmp_path}/v", "id", "seq", F.col("op") == "delete")
    feed = lambda *events: spark.createDataFrame([(s, i, op, x) for s, i, op, x in events], "seq long, id long, op string, x string")
    rows = lambda: {r["id"]: r["x"] for r in v.current().collect()}
    v._merge(feed((1, 1, "put", "a")), 0)
    assert v.stale  # no snapshot yet
    v.load(feed((2, 1, "put", "a"), (1, 2, "put", "b")), 2)
    v._merge(feed((4, 2, "delete", None), (3, 1, "put", "c"), (3, 1, "put", "c")), 1)
    v._merge(feed((4, 2, "delete", None), (3, 1, "put", "late"), (5, 3, "put", "d")), 2)
    v._merge(feed((6, 9, "put", "again")), 2)  # the same batch once more
    assert (rows(), v.last_seq, v.stale) == ({1: "c", 3: "d"}, 5, False)
    assert v.current().where("id = 1").first()["events"] == 2
    v._merge(feed((6, 1, "put", "e"), (8, 1, "put", "f")), 3)
    v._merge(feed((7, 1, "put", "g")), 4)
    assert (rows(), v.last_seq, v.stale) == ({1: "e", 3: "d"}, 6, True)
    v.load(feed((8, 1, "put", "f")), 8)
    for k in range(DELTAS + 2):
        v._merge(feed((9 + k, 1, "put", str(k))), 5 + k)
    assert (rows(), v.stale) == ({1: str(DELTAS + 1)}, False) and len(v._at()["parts"]) < DELTAS


def test_stream_of_a_collection(spark, tmp_path):
    from quern.streaming.views import FoldedView

    c = Collection.define(spark, f"file://{tmp_path}/s", USERS)
    c.put(rows(spark, [(1, "a", None, 1), (2, "b", None, 2)]))
    view = FoldedView(spark, f"file://{tmp_path}/view", ID, ["commit_seq", "pos"], F.col("op") == "delete")
    view.start(c.stream()).awaitTermination()
    c.delete(spark.createDataFrame([(1,)], "_id long"))
    c.put(rows(spark, [(2, "z", None, 3)]))
    view.start(c.stream()).awaitTermination()
    assert [(r[ID], r["f2"], r["events"]) for r in view.current().collect()] == [(2, "z", 2)]

"""Collections on a commit log.

A commit is a directory of Parquet, staged and then claimed by the exclusive creation of
commits/<n>.json; the number orders all mutations, and readers see complete commits up to a
pinned one. State is the fold of the latest checkpoint and the commits after it. There is one
writer per collection at a time: a lost race raises CommitConflict and nothing is visible. The
claim names the staged data, so what a writer leaves behind between claim and move is finished by
the next reader or writer. Compaction records the last commit it drops: a read that needs an
older one is a LookupError.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import ID_EPOCH_MS, ID_SEQ_BITS, ID_WORKER_BITS, id_of
from ..operators import state as ops
from ..plans import migration
from ..schema import ID, Field, checked, from_json, logical, stored, struct, to_json
from .files import Files


class CommitConflict(RuntimeError):
    """Another writer has claimed the commit."""


class MigrationRefused(ValueError):
    """A schema change with blockers."""


#: One lock for all handles of a collection in this process.
_LOCKS: dict[str, threading.RLock] = {}
#: A place in a scan: partition above these bits, row in it below.
_PLACE_BITS = 33


class Collection:
    def __init__(self, spark: SparkSession, root: str, worker: int = 0):
        """worker tells processes apart that generate ids at the same time."""
        if not 0 <= worker < 1 << ID_WORKER_BITS:
            raise ValueError("no such worker")
        self.spark, self.files, self.worker = spark, Files(spark, root), worker
        self._lock = _LOCKS.setdefault(self.files.root, threading.RLock())
        self._load()

    @classmethod
    def define(cls, spark: SparkSession, root: str, fields: Sequence[Field], *, drop: Sequence[str] = (), allow_retype: bool = False, dry_run: bool = False) -> Collection | migration.Plan:
        """Create a collection or migrate it; with dry_run only the plan."""
        files = Files(spark, root)
        with _LOCKS.setdefault(files.root, threading.RLock()):
            p, manifest = cls._planned(files, fields, drop=drop, allow_retype=allow_retype)
            if dry_run:
                return p
            if not p.allowed:
                raise MigrationRefused(migration.describe(p.blockers))
            if manifest:
                files.replace("manifest.json", manifest)
        return cls(spark, root)

    @staticmethod
    def _planned(files: Files, fields: Sequence[Field], *, drop: Sequence[str] = (), allow_retype: bool = False) -> tuple[migration.Plan, str | None]:
        """The plan, and the manifest to write if there is something to change; a SchemaError if the fields break a rule."""
        meta = json.loads(files.read("manifest.json")) if files.exists("manifest.json") else {"fields": [], "reserved": [], "schema_version": 0}
        p = migration.plan(from_json(meta["fields"]), fields, meta["reserved"], drop=drop, allow_retype=allow_retype)
        if not p.allowed:
            return p, None
        checked(fields, p.reserved)
        new = p.changes or not meta["schema_version"]
        return p, json.dumps({"fields": to_json(fields), "reserved": p.reserved, "schema_version": meta["schema_version"] + 1}) if new else None

    def _load(self) -> None:
        meta = json.loads(self.files.read("manifest.json"))
        self.fields, self.reserved, self.schema_version = from_json(meta["fields"]), meta["reserved"], meta["schema_version"]

    # -- the log ---------------------------------------------------------------

    @property
    def log_type(self) -> T.StructType:
        head = [T.StructField(ID, T.LongType()), T.StructField("op", T.StringType()), T.StructField("version", T.LongType()), T.StructField("commit_seq", T.LongType()), T.StructField("pos", T.LongType())]
        return T.StructType(head + stored(self.fields).fields)

    def _commits(self) -> tuple[int, list[int]]:
        """The highest number claimed, and the complete commits in order.

        A claim whose data are still staged is finished here; one without any data is a hole.
        """
        claims = {int(n.removesuffix(".json")) for n in self.files.names("commits")}
        done = {int(n.removeprefix("n=")) for n in self.files.names("data")}
        low = self.compacted() if claims - done else 0
        for n in sorted(claims - done):
            if n > low and self._finish(n):
                done.add(n)
        return max(claims, default=0), sorted(done)

    def _finish(self, n: int) -> bool:
        stage = json.loads(self.files.read(f"commits/{n:012d}.json")).get("stage")
        if stage and self.files.exists(f"{stage}/_SUCCESS"):
            try:
                self.files.move(stage, f"data/n={n}")
            except Exception:
                if not self.files.exists(f"data/n={n}"):  # else another one has moved it
                    raise
        return self.files.exists(f"data/n={n}")

    def head(self) -> int:
        """The last complete commit; 0 if there is none."""
        return max(self._commits()[1], default=0)

    def compacted(self) -> int:
        """The last commit that compaction has dropped; 0 if there is none."""
        return json.loads(self.files.read("compacted.json"))["upto"] if self.files.exists("compacted.json") else 0

    def checkpoint_at(self, version: int) -> int:
        kept = [int(n.removeprefix("v=")) for n in self.files.names("state")]
        return max((n for n in kept if n <= version and self.files.exists(f"state/v={n}/_SUCCESS")), default=0)

    def log(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """Mutations of the commits in (after, upto]; a LookupError if some of them are compacted."""
        _, done = self._commits()
        upto = max(done, default=0) if upto is None else upto
        gone = min(self.compacted(), upto)
        if after < gone:
            raise LookupError(f"commits up to {gone} are compacted; load a snapshot")
        paths = [self.files.at(f"data/n={n}") for n in done if after < n <= upto]
        return self.spark.read.schema(self.log_type).parquet(*paths) if paths else self.spark.createDataFrame([], self.log_type)

    def latest(self, version: int | None = None, *, only: DataFrame | None = None) -> DataFrame:
        """Latest mutation of every id (or of those in only), deletions too: the checkpoint and the commits after it."""
        version = self.head() if version is None else version
        at = self.checkpoint_at(version)
        rows = self.log(at, version)
        if at:
            rows = rows.unionByName(self.spark.read.schema(self.log_type).parquet(self.files.at(f"state/v={at}")))
        if only is not None:
            rows = rows.join(only.select(F.col(ID).cast("long").alias(ID)), ID, "left_semi")
        last = rows.groupBy(ID).agg(F.max_by(F.struct(*[c for c in rows.columns if c != ID]), F.struct("commit_seq", "pos")).alias("m"))
        return last.select(ID, "m.*")

    def state(self, version: int | None = None, *, with_version: bool = False, only: DataFrame | None = None) -> DataFrame:
        """Live records under their present names, at a pinned commit or the last; of the ids in only, if given."""
        live = self.latest(version, only=only).where("op = 'put'")
        out = logical(live, self.fields)
        return out.join(live.select(ID, "version"), ID) if with_version else out

    def count(self) -> int:
        return self.latest().where("op = 'put'").count()

    def describe(self) -> dict:
        return {"schema": struct(self.fields), "schema_version": self.schema_version, "reserved": self.reserved, "count": self.count()}

    # -- commits ---------------------------------------------------------------

    def _commit(self, mutations: DataFrame) -> int:
        """mutations: _id, op, pos and stored columns."""
        with self._lock:
            n = self._commits()[0] + 1
            known = self.latest(n - 1, only=mutations).select(ID, F.col("version").alias("was"))  # of the batch's ids alone
            step = F.row_number().over(Window.partitionBy(ID).orderBy("pos"))
            rows = mutations.withColumn("step", step).join(known, ID, "left")
            rows = rows.withColumn("version", (F.coalesce("was", F.lit(0)) + F.col("step")).cast("long")).withColumn("commit_seq", F.lit(n).cast("long"))
            rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.log_type.fields])
            stage = f"staging/{uuid.uuid4().hex}"
            rows.write.parquet(self.files.at(stage))
            if not self.files.create(f"commits/{n:012d}.json", json.dumps({"n": n, "stage": stage})):
                self.files.remove(stage)
                raise CommitConflict(f"commit {n} is taken")
            self._finish(n)
            return n

    def _puts(self, records: DataFrame) -> DataFrame:
        """The later of rows with the same id wins; both count for its version."""
        cols = [F.col(f.name).alias(f.column) for f in self.fields if f.name in records.columns]
        return records.select(F.col(ID).cast("long").alias(ID), F.lit("put").alias("op"), F.monotonically_increasing_id().alias("pos"), *cols)

    def _require(self, records: DataFrame) -> None:
        missing = [f.name for f in self.fields if f.required]
        bad = F.lit(False)
        for name in missing:
            bad = bad | (F.col(name).isNull() if name in records.columns else F.lit(True))
        if missing and not records.where(bad).isEmpty():
            raise ValueError(f"required fields are null: {', '.join(missing)}")

    def put(self, records: DataFrame) -> int:
        """Insert or fully replace records (with _id); a null _id is an error."""
        self._require(records)
        if not records.where(F.col(ID).isNull()).isEmpty():
            raise ValueError("records without an id; use insert")
        return self._commit(self._puts(records))

    def _reserve(self, count: int) -> int:
        """The first millisecond of enough of them for count ids that nobody else of this worker gets, however the clock runs."""
        with self._lock:
            name = f"ids/{self.worker}.json"
            last = json.loads(self.files.read(name))["ms"] if self.files.exists(name) else 0
            first = max(time.time_ns() // 1_000_000, last + 1)
            self.files.replace(name, json.dumps({"ms": first + max(count - 1, 0) // (1 << ID_SEQ_BITS)}))
            return first

    def generate_id(self) -> int:
        """A new time-ordered id."""
        return (self._reserve(1) - ID_EPOCH_MS << ID_WORKER_BITS + ID_SEQ_BITS) + (self.worker << ID_SEQ_BITS)

    def insert(self, records: DataFrame) -> DataFrame:
        """Put records, those with a null or no _id under a generated one; returns them with their ids.

        The rows are staged once, so that their places, which number the ids, cannot change.
        """
        self._require(records)
        with self._lock:
            path = self.files.at(f"staging/insert-{uuid.uuid4().hex}")
            given = records if ID in records.columns else records.withColumn(ID, F.lit(None).cast("long"))
            given.select(F.struct(*given.columns).alias("row"), F.monotonically_increasing_id().alias("place")).write.parquet(path)
            rows = self.spark.read.parquet(path)
            part, at = F.shiftright("place", _PLACE_BITS), F.col("place").bitwiseAND((1 << _PLACE_BITS) - 1)
            most = rows.where(F.col(f"row.{ID}").isNull()).agg(F.max(part).alias("part"), F.max(at).alias("at")).first()
            made: Column = F.lit(None).cast("long")
            if most["part"] is not None:
                parts = most["part"] + 1
                first, number = self._reserve((most["at"] + 1) * parts), at * parts + part
                made = id_of(F.lit(first) + F.floor(number / (1 << ID_SEQ_BITS)), F.lit(self.worker), number % (1 << ID_SEQ_BITS))
            out = rows.select(F.coalesce(F.col(f"row.{ID}").cast("long"), made).alias(ID), *[F.col(f"row.`{c}`").alias(c) for c in given.columns if c != ID])
            self._commit(self._puts(out))
            return out

    def update(self, changes: DataFrame, *, unset: Sequence[str] = ()) -> int:
        """Shallow merge into live records; ids without one are an error. Of rows with the same id the later one's fields win."""
        with self._lock:
            state = self.state(only=changes)
            if not changes.join(state.select(ID), ID, "left_anti").isEmpty():
                raise KeyError("update of a record that is not there")
            merged = ops.patch(state, changes, ID, unset=unset)
            self._require(merged)
            return self._commit(self._puts(merged))

    def delete(self, ids: DataFrame) -> int:
        """Tombstones for live ids; others are left alone."""
        with self._lock:
            live = self.latest(only=ids).where("op = 'put'").select(ID)
            gone = ids.select(F.col(ID).cast("long").alias(ID)).distinct().join(live, ID, "left_semi")
            return self._commit(gone.select(ID, F.lit("delete").alias("op"), F.monotonically_increasing_id().alias("pos")))

    def insert_unique(self, records: DataFrame, fields: Sequence[str], order: str) -> DataFrame:
        """Insert the rows whose values of the fields are free; returns all rows with their verdict."""
        with self._lock:
            path = self.files.at(f"staging/verdicts-{uuid.uuid4().hex}")
            ops.insert_unique(self.state(), records, ID, fields, order).write.parquet(path)
            verdicts = self.spark.read.parquet(path)
            self.put(verdicts.where("verdict = 'ok'").select(records.columns))
            return verdicts

    def compare_and_set(self, changes: DataFrame) -> DataFrame:
        """changes (_id, expected, fields): merged where the version is the expected one; the verdicts, decided in the commit's lock.

        Of several requests for a version the first in the scan passes.
        """
        with self._lock:
            path = self.files.at(f"staging/verdicts-{uuid.uuid4().hex}")
            asked = f"{path}-asked"
            changes.withColumn("__place", F.monotonically_increasing_id()).write.parquet(asked)
            asked = self.spark.read.parquet(asked)
            ops.compare_and_set(self.state(with_version=True, only=asked), asked, ID, "__place").write.parquet(path)
            verdicts = self.spark.read.parquet(path)
            ok = verdicts.where("verdict = 'ok'")
            if not ok.isEmpty():
                fields = [c for c in changes.columns if c not in (ID, "expected")]
                self.update(ops.last_fields(ok.select(ID, "__place", *fields), ID, "__place"))
            return verdicts.select(ID, "expected", "version", "verdict")

    def checkpoint(self) -> int:
        """Write the folded state, deletions with their last version included; reads start there."""
        n = self.head()
        if n and not self.checkpoint_at(n) == n:
            self.latest(n).write.mode("overwrite").parquet(self.files.at(f"state/v={n}"))
        return n

    def compact(self, pinned: int | None = None) -> dict:
        """Checkpoint, then drop the commits that it covers but the last; versions go on where they were.

        What a read at the commit `pinned` or a later one needs is kept. Older pins raise a LookupError from then on.
        """
        with self._lock:
            n = self.checkpoint()
            base = n if pinned is None else self.checkpoint_at(pinned)
            low, before = max(min(n - 1, base), 0), self.compacted()
            if low > before:
                self.files.replace("compacted.json", json.dumps({"upto": low}))
            old = [k for k in self._commits()[1] if k <= low]
            for k in old:
                self.files.remove(f"data/n={k}")
                self.files.remove(f"commits/{k:012d}.json")
            for v in self.files.names("state"):
                if int(v.removeprefix("v=")) < base:
                    self.files.remove(f"state/{v}")
            return {"records": self.count(), "commits_removed": len(old)}

    # -- the feed --------------------------------------------------------------

    def feed(self, after: int = 0) -> DataFrame:
        """Change events of the commits after a number; an error if some of them were compacted away."""
        rows = self.log(after)
        return rows.select("commit_seq", "pos", "op", ID, "version", *[F.col(f.column).alias(f.name) for f in self.fields])

    def stream(self) -> DataFrame:
        """The log as a stream; complete commits alone appear in it."""
        return self.spark.readStream.schema(self.log_type).parquet(self.files.at("data/n=*"))


class Catalog:
    """A directory of collections with a manifest of their names and grants."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self._lock = _LOCKS.setdefault(self.files.root, threading.RLock())
        if not self.files.exists("catalog.json"):
            self.files.create("catalog.json", json.dumps({"collections": [], "acl": {}}))
        self._apply_pending()

    def _apply_pending(self) -> None:
        """Finish a registry that was accepted whole and not yet written whole."""
        with self._lock:
            if self.files.exists("pending.json"):
                new = json.loads(self.files.read("pending.json"))
                for name, manifest in new.items():
                    if manifest:
                        self.files.replace(f"{name}/manifest.json", manifest)
                meta = self._meta()
                self.files.replace("catalog.json", json.dumps(meta | {"collections": sorted({*meta["collections"], *new})}))
                self.files.remove("pending.json")

    def _meta(self) -> dict:
        return json.loads(self.files.read("catalog.json"))

    def collections(self) -> list[str]:
        return sorted(self._meta()["collections"])

    def collection(self, name: str) -> Collection:
        return Collection(self.spark, self.files.at(name))

    def define(self, name: str, fields: Sequence[Field], **options) -> Collection | migration.Plan:
        out = Collection.define(self.spark, self.files.at(name), fields, **options)
        meta = self._meta()
        if name not in meta["collections"] and not options.get("dry_run"):
            self.files.replace("catalog.json", json.dumps(meta | {"collections": [*meta["collections"], name]}))
        return out

    def apply_registry(self, registry: dict[str, Sequence[Field]], **consent) -> dict[str, migration.Plan]:
        """All collections' schemas, or none if one is refused."""
        with self._lock:
            plans = {n: Collection._planned(Files(self.spark, self.files.at(n)), f, **consent) for n, f in registry.items()}
            bad = {n: migration.describe(p.blockers) for n, (p, _) in plans.items() if not p.allowed}
            if bad:
                raise MigrationRefused("\n".join(f"{n}: {t}" for n, t in bad.items()))
            self.files.replace("pending.json", json.dumps({n: m for n, (_, m) in plans.items()}))
            self._apply_pending()
            return {n: p for n, (p, _) in plans.items()}

    def feed(self, after: dict[str, int]) -> DataFrame:
        """Change events of several collections, each after a commit of its own: the record as JSON, absent fields left out."""
        parts = []
        for name, since in after.items():
            c = self.collection(name)
            record = F.when(F.col("op") == "put", F.to_json(F.struct(*[f.name for f in c.fields])))
            parts.append(c.feed(since).select(F.lit(name).alias("collection"), "commit_seq", "pos", "op", ID, "version", record.alias("record")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def grant(self, principal: str, mask: int) -> None:
        meta = self._meta()
        meta["acl"][principal] = meta["acl"].get(principal, 0) | mask
        self.files.replace("catalog.json", json.dumps(meta))

    def revoke(self, principal: str, mask: int) -> None:
        expand = lambda m: 255 if m & 128 else m
        meta = self._meta()
        left = expand(meta["acl"].get(principal, 0)) & ~expand(mask)
        meta["acl"] = {k: v for k, v in (meta["acl"] | {principal: left}).items() if v}
        self.files.replace("catalog.json", json.dumps(meta))

    def can(self, principal: str, needed: int) -> bool:
        mask = self._meta()["acl"].get(principal, 0)
        return (255 if mask & 128 else mask) & needed == needed

"""Keyed tables in hash buckets on a shared file system, updated without rewriting them.

A key's hash names its bucket, a folder of Parquet files. An update reads the buckets of its keys, and writes
the changed rows beside them as a delta; a reader takes of every key the row of the last delta. Buckets
without deltas are read as they are. A bucket with more than MOST_DELTAS of them is written anew in the same
commit.

A commit is one small JSON file that names, for all tables of the store, the schema and the folders of every
bucket. It is put in place by a rename that fails where the name exists, so one writer wins a version and
several tables change together or not at all. A writer that lost tries the next version if nobody touched its
buckets meanwhile; otherwise it gets a Conflict and has changed nothing. The number of entries is bounded by
tables * buckets * (MOST_DELTAS + 1), whatever the number of rows.

New columns are added and numbers widened by the commit's schema alone: older files give nulls and wider
numbers when read with it.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

from tilescope.functions.ranking import top_per_key

MOST_DELTAS = 8
BUCKET, SEQ = "_bucket", "_seq"
_WIDER = {ShortType: (IntegerType, LongType), IntegerType: (LongType,), FloatType: (DoubleType,)}


class Conflict(RuntimeError):
    """Another writer changed the same buckets."""


def widened(old: StructType, new: StructType) -> StructType:
    """The old fields, numbers as wide as in either, then the fields that only the new schema has."""
    fields = []
    for f in old:
        other = new[f.name].dataType if f.name in new.names else f.dataType
        wider = isinstance(other, _WIDER.get(type(f.dataType), ()))
        fields.append(StructField(f.name, other if wider else f.dataType))
    return StructType(fields + [StructField(f.name, f.dataType) for f in new if f.name not in old.names])


class BucketStore:
    """Tables with one key column each, under one folder."""

    def __init__(self, spark: SparkSession, folder: str, keys: Mapping[str, str], buckets: int = 16):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), dict(keys), buckets
        jvm, context = spark._jvm, spark.sparkContext
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = context._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))

    # -- commits ---------------------------------------------------------------

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/commits"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v"))

    def state(self, version: int | None = None) -> dict:
        """What a version, by default the last one, consists of."""
        known = self.versions()
        if version is None and not known:
            return {"version": -1, "buckets": self.buckets, "tables": {}, "streams": {}, "touched": {}}
        number = known[-1] if version is None else version
        stream = self._fs.open(self._path(self._commit_path(number)))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if found["buckets"] != self.buckets:
            raise ValueError(f"{self.folder} has {found['buckets']} buckets, not {self.buckets}")
        return found

    def _commit_path(self, number: int) -> str:
        return f"{self.folder}/commits/v{number:012d}.json"

    def _put(self, state: dict) -> bool:
        """Whether this version is now in place; False if the number is taken."""
        jvm = self.spark._jvm
        draft = self._path(f"{self.folder}/commits/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._path(self._commit_path(state["version"]))), how)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    # -- reading ---------------------------------------------------------------

    def bucket_of(self, key: Column) -> Column:
        known = F.when(key.isNull(), F.raise_error(F.lit("a row of a keyed table has no key")).cast("int"))
        return known.otherwise(F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"))

    def read(self, table: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame | None:
        """The rows of a table, or of some of its buckets; None if there is no such table."""
        return self._read(self.state(version), table, buckets)

    def _read(self, state: dict, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        if table not in state["tables"]:
            return None
        schema = StructType.fromJson(state["tables"][table]["schema"])
        files = {int(b): f for b, f in state["tables"][table]["files"].items() if buckets is None or int(b) in buckets}
        clean = [f for own in files.values() if len(own) == 1 for f in own]
        dirty = [f for own in files.values() if len(own) > 1 for f in own]
        reader = self.spark.read.schema(StructType([*schema, StructField(SEQ, LongType())]))
        out = self.spark.createDataFrame([], schema)
        parts = [reader.parquet(*(f"{self.folder}/{f}" for f in clean)).drop(SEQ)] if clean else []
        if dirty:
            both = reader.parquet(*(f"{self.folder}/{f}" for f in dirty))
            parts.append(top_per_key(both, [self.keys[table]], [F.col(SEQ).desc()]).drop(SEQ))
        for k, part in enumerate(parts):
            out = part if k == 0 else out.unionByName(part)
        return out

    # -- writing ---------------------------------------------------------------

    def transaction(self) -> "Transaction":
        return Transaction(self)

    def merge(self, table: str, feed: DataFrame, change: Callable[[DataFrame | None, DataFrame], DataFrame]) -> int:
        """One table's update as a commit of its own."""
        with self.transaction() as t:
            t.merge(table, feed, change)
        return t.version


class Transaction:
    """Changes of several tables that are committed together when the block ends without an error.

    All reads are of the version at the beginning.
    """

    def __init__(self, store: BucketStore):
        self.store, self.base, self.version = store, store.state(), None
        self.changed: dict[str, dict] = {}
        self.stream: tuple[str, int] | None = None

    def __enter__(self) -> "Transaction":
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.version = self._commit()

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        return self.store._read(self.base, table, buckets)

    def seen(self, stream: str, batch: int) -> bool:
        """Whether a stream's batch was committed; if not, this commit records it."""
        if self.base["streams"].get(stream, -1) >= batch:
            return True
        self.stream = (stream, batch)
        return False

    def merge(self, table: str, feed: DataFrame, change: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
        """change(stored rows of the feed's keys, feed) gives these rows anew; the feed has the key column."""
        key = self.store.keys[table]
        touched = [r[0] for r in feed.select(self.store.bucket_of(F.col(key))).distinct().collect()]
        old = self.read(table, touched)
        if old is not None:
            old = old.join(feed.select(key).distinct(), key, "left_semi").select(old.columns)
        self.upsert(table, change(old, feed))

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Insert or replace whole rows, one for every key."""
        if table in self.changed:
            raise ValueError(f"{table} is changed twice in one transaction")
        store, key = self.store, self.store.keys[table]
        known = self.base["tables"].get(table, {"schema": rows.schema.jsonValue(), "files": {}})
        schema = widened(StructType.fromJson(known["schema"]), rows.schema)
        names = {f.name for f in rows.schema}
        given = [(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        added = self._write(rows.select(*given), key)
        files = {b: [*known["files"].get(b, []), path] for b, path in added.items()}
        full = [int(b) for b, own in files.items() if len(own) > MOST_DELTAS]
        if full:
            trial = {"tables": {table: {"schema": schema.jsonValue(), "files": files}}}
            for b, path in self._write(store._read(trial, table, full), key).items():
                files[b] = [path]
        self.changed[table] = {"schema": schema.jsonValue(), "files": files}

    def evolve(self, table: str, columns: str) -> None:
        """Add columns, or widen numbers, by a schema text; no data is written."""
        known = self.base["tables"][table]
        schema = widened(StructType.fromJson(known["schema"]), StructType.fromDDL(columns))
        self.changed[table] = {"schema": schema.jsonValue(), "files": {}}

    def _write(self, rows: DataFrame, key: str) -> dict[str, str]:
        """Folders of the written rows by bucket."""
        store = self.store
        path = f"data/{uuid.uuid4().hex}"
        rows = rows.withColumns({BUCKET: store.bucket_of(F.col(key)), SEQ: F.lit(self.base["version"] + 1).cast("long")})
        # Rebalanced: a bucket larger than a task should hold goes to several, and none waits for others of its hash.
        rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{store.folder}/{path}")
        names = [s.getPath().getName() for s in store._fs.listStatus(store._path(f"{store.folder}/{path}"))]
        return {n.split("=")[1]: f"{path}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    def _commit(self) -> int:
        store = self.store
        if not self.changed and self.stream is None:
            return self.base["version"]
        touched = {t: sorted(c["files"]) for t, c in self.changed.items()}
        while True:
            last = store.state()
            for number in range(self.base["version"] + 1, last["version"] + 1):
                other = store.state(number)
                for t, own in touched.items():
                    theirs = other["touched"].get(t)
                    changed_schema = theirs is not None and other["tables"][t]["schema"] != self.base["tables"].get(t, {}).get("schema")
                    if theirs is not None and (changed_schema or set(own) & set(theirs)):
                        raise Conflict(f"version {number} changed the same part of {t}")
                if self.stream is not None and other["streams"].get(self.stream[0], -1) >= self.stream[1]:
                    raise Conflict(f"version {number} holds the same batch of {self.stream[0]}")
            state = copy.deepcopy(last)
            state.update(version=last["version"] + 1, touched=touched)
            for t, change in self.changed.items():
                entry = state["tables"].setdefault(t, {"schema": change["schema"], "files": {}})
                entry["schema"] = change["schema"]
                entry["files"].update(change["files"])
            if self.stream is not None:
                state["streams"][self.stream[0]] = self.stream[1]
            if store._put(state):
                return state["version"]

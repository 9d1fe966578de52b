"""Versioned Parquet tables.

A run writes the next version of each table and commits it last, with one small
row: the mark. Readers take the last committed version, so a run that dies leaves
nothing visible, and repeating it writes the same version again. A mark also says
which stream batch its version holds, which ``seq`` comes next and which tables
have been written, so neither a batch nor a number is ever taken twice and a
table that is lost is noticed.

Bucketed tables are cut by a hash of their lookup key. A version writes only the
buckets it changes, and its layout names the versions each bucket is made of:
rows with new keys are added to a bucket, and a bucket that holds an earlier row
of a key, or consists of many parts, is written anew. So a batch reads and
writes the buckets of its own keys, however large the table is.

Only a store whose folder of marks does not exist is empty; any other table or
mark that cannot be read is an error.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from ledgerloom import schemas
from ledgerloom.session import materialize

# Bucketed tables: what a row is known by, and what it is looked up by.
ROW_KEYS = {
    "businesses": ["business_id"],
    "identifiers": ["business_id", "key_type", "key_value"],
    "contacts": ["contact_id", "business_id"],
    "business_sources": ["business_id", "source_name"],
    "key_names": ["key_type", "key_value"],
}
LOOKUP_KEYS = {
    "businesses": ["business_id"],
    "identifiers": ["key_type", "key_value"],
    "contacts": ["business_id"],
    "business_sources": ["business_id"],
    "key_names": ["key_type", "key_value"],
}
BUCKETED_TABLES = {
    "businesses": schemas.BUSINESSES,
    "identifiers": schemas.IDENTIFIERS,
    "contacts": schemas.CONTACTS,
    "business_sources": schemas.BUSINESS_SOURCES,
    "key_names": schemas.KEY_NAMES,
}
# Tables to which a version adds rows.
GROWING_TABLES = {
    "field_sources": schemas.FIELD_SOURCES,
    "events": schemas.EVENTS,
    "job_runs": schemas.JOB_RUNS,
    "dnc_requests": schemas.DNC_REQUESTS,
    "rejects": schemas.REJECTS,
}
SCHEMAS = {**BUCKETED_TABLES, **GROWING_TABLES}
MARK = "version long, stream string, batch long, next_seq long, tables array<string>, buckets int"
LAYOUT = "table string, bucket int, versions array<long>"
# Buckets of a new store: to be chosen so that one holds some hundred MB at most.
BUCKETS = 32
# Parts of a bucket from which it is written anew.
MOST_PARTS = 16


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def delete_path(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def same_row(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Whether two rows have the same key; a NULL in it equals a NULL."""
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


class TableStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self.written: set[str] = set()
        self.known_marks: dict[int, Row] = {}
        self.layouts: dict[int, dict[str, dict[int, list[int]]]] = {}
        self.pending: dict[str, dict[int, list[int]]] = {}

    def marks(self) -> DataFrame:
        """One row per committed version."""
        path = f"{self.root}/versions"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], MARK)
        return self.spark.read.schema(MARK).json(f"{path}/*")

    def mark(self) -> Row | None:
        """The last committed mark; None before the first. A mark never changes, so it is read once."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions/v*/part-*")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        versions = [int(f.getPath().getParent().getName()[1:]) for f in found or ()]
        if not versions:
            return None
        last = max(versions)
        if last not in self.known_marks:
            self.known_marks[last] = self.spark.read.schema(MARK).json(f"{self.root}/versions/v{last}").first()
        return self.known_marks[last]

    def version(self) -> int:
        """Last committed version; -1 before the first."""
        last = self.mark()
        return -1 if last is None else last["version"]

    def next_seq(self) -> int:
        """The first number no record of the store has had."""
        last = self.mark()
        return 0 if last is None else last["next_seq"] or 0

    def holds(self, stream: str, batch: int) -> bool:
        """Whether a batch of a stream is in the store already."""
        return not self.marks().where((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty()

    def begin(self) -> int:
        """The next version. What a run that died has left of it is forgotten."""
        last = self.mark()
        version = 0 if last is None else last["version"] + 1
        self.buckets = self.buckets if last is None else last["buckets"]
        self.written, self.pending = set(), {}
        for name in GROWING_TABLES:
            path = f"{self.root}/{name}/version={version}"
            if path_exists(self.spark, path):
                delete_path(self.spark, path)
        return version

    def write(self, name: str, df: DataFrame, version: int) -> None:
        """Rows a version adds to a growing table."""
        columns = [f.name for f in GROWING_TABLES[name].fields]
        self.written.add(name)
        df.select(columns).write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")

    def layout(self, version: int) -> dict[str, dict[int, list[int]]]:
        """Per bucketed table the versions each bucket is made of: a row a bucket."""
        if version < 0:
            return {}
        if version not in self.layouts:
            whole: dict[str, dict[int, list[int]]] = {}
            for row in self.spark.read.schema(LAYOUT).json(f"{self.root}/layouts/v{version}").collect():
                whole.setdefault(row["table"], {})[row["bucket"]] = list(row["versions"])
            self.layouts[version] = whole
        return self.layouts[version]

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*LOOKUP_KEYS[name]), F.lit(self.buckets)).cast("int")

    def buckets_of(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets of some lookup keys: at most as many as there are buckets."""
        last = self.mark()
        self.buckets = self.buckets if last is None else last["buckets"]
        return sorted(r[0] for r in keys.select(self.bucket(name)).distinct().collect())

    def upsert(self, name: str, changed: DataFrame, version: int) -> list[int]:
        """Put rows in place of those of the same key; the buckets written.

        ``changed`` holds at most one row a key. Buckets without an earlier row
        of any of these keys only gain a part.
        """
        keys, columns = ROW_KEYS[name], [f.name for f in BUCKETED_TABLES[name].fields]
        fresh = materialize(changed.select(*columns, self.bucket(name).alias("bucket")), f"upsert-{name}")
        touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())
        before = self.layout(version - 1).get(name, {})
        parts = {b: before.get(b, []) for b in touched}
        old = self.read(name, version - 1, touched).withColumn("bucket", self.bucket(name))
        anew = {b for b, held in parts.items() if len(held) >= MOST_PARTS}
        if any(parts.values()):
            met = old.join(fresh, same_row(old, fresh, keys), "left_semi").select("bucket").distinct()
            anew |= {r[0] for r in met.collect()}
        rows = fresh
        if anew:
            kept = old.where(F.col("bucket").isin(sorted(anew)))
            rows = rows.unionByName(kept.join(fresh, same_row(kept, fresh, keys), "left_anti"))
        if touched:
            # Adaptive execution cuts a bucket of many rows and puts small ones together.
            rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
                f"{self.root}/{name}/version={version}")
        self.written.add(name)
        self.pending[name] = {b: [version] if b in anew else [*held, version] for b, held in parts.items()}
        return touched

    def commit(self, version: int, stream: str | None = None, batch: int | None = None, next_seq: int | None = None) -> None:
        last = self.mark()
        next_seq = self.next_seq() if next_seq is None else next_seq
        tables = sorted(self.written | set(last["tables"] if last else ()))
        before = self.layout(version - 1)
        layout = {name: {**before.get(name, {}), **self.pending.get(name, {})} for name in BUCKETED_TABLES}
        rows = [(name, bucket, versions) for name, held in layout.items() for bucket, versions in held.items()]
        self.spark.createDataFrame(rows, LAYOUT).coalesce(1).write.mode("overwrite").json(f"{self.root}/layouts/v{version}")
        self.spark.createDataFrame([(version, stream, batch, next_seq, tables, self.buckets)], MARK).coalesce(1).write.mode(
            "overwrite").json(f"{self.root}/versions/v{version}")
        self.written, self.pending = set(), {}

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as of a version; of a bucketed one only some buckets, if named (as the last version cuts them)."""
        last = self.mark()
        version = (-1 if last is None else last["version"]) if version is None else version
        schema = SCHEMAS[name]
        path = f"{self.root}/{name}"
        if version < 0 or last is None or name not in last["tables"]:
            return self.spark.createDataFrame([], schema)
        if name in GROWING_TABLES:
            stored = T.StructType([*schema.fields, T.StructField("version", T.LongType())])
            return self.spark.read.schema(stored).parquet(path).where(F.col("version") <= version).drop("version")
        held = self.layout(version).get(name, {})
        places = [
            f"{path}/version={part}/bucket={b}"
            for b, parts in sorted(held.items()) if buckets is None or b in buckets for part in parts]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of some lookup keys in the last version, from their buckets only."""
        by = LOOKUP_KEYS[name]
        asked = keys.select(by).distinct()
        return self.read(name, buckets=self.buckets_of(name, asked)).join(asked, by, "left_semi")

    def rebucket(self, buckets: int) -> int:
        """Write every bucketed table anew in another number of buckets, as the next version."""
        version = self.begin()
        whole = {name: self.read(name, version - 1) for name in BUCKETED_TABLES}
        self.layouts[version - 1], committed = {}, self.layout(version - 1)
        self.buckets = buckets
        try:
            for name, rows in whole.items():
                self.upsert(name, rows, version)
            self.commit(version)
        finally:
            self.layouts[version - 1] = committed
        return version

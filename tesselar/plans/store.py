"""Stored sharded tables: copy-on-write by shard, published by manifests.

A table's rows lie under <root>/<table>/data/shard=<s>/w=<write>.  A manifest names the
folders that make up a version; its number is part of its file name, and a file is
created only if there is none, so of two writers of one version the second is
refused.  Readers see one version or the next.

A write touches the shards that its predicate leaves: an insert adds a folder to each
shard that gets rows, an update or delete rewrites those shards only.  Several writes
become visible together by a transaction: all data is written first (prepared), the
list of manifests is stored, then the manifests are created one by one.  What a lost
driver has left is finished by recover().

Each row is kept once.  Rows whose key has no shard, or is not given, are dealt in turn:
no predicate that prunes can be true of them.  Replicated (omni) tables are one copy.
Counts of affected rows come from what was written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from .catalog import Catalog, RoutingError, round_robin
from .planner import Shards, prune


class Files:
    """The few operations that manifests need, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.path = lambda p: self.jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def create(self, path: str, text: str) -> None:
        """Write a new file; raises if there is one."""
        part = self.path(f"{path}.{uuid.uuid4().hex}.part")
        out = self.fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        # a rename onto a file that exists fails, so the file appears whole and once
        if self.fs.exists(self.path(path)) or not self.fs.rename(part, self.path(path)):
            self.fs.delete(part, False)
            raise RoutingError(f"another writer was first: {path}")

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


@dataclass
class Manifest:
    version: int
    schema: str
    folders: dict[str, list[str]] = field(default_factory=dict)  # by shard, below data

    def text(self) -> str:
        return json.dumps({"version": self.version, "schema": self.schema, "folders": self.folders})


@dataclass(frozen=True)
class Written:
    """What a write did: rows affected over all shards, shards touched, and the rows as written."""

    affected: int
    shards: frozenset[int]
    returning: DataFrame


class Store:
    def __init__(self, spark: SparkSession, root: str, catalog: Catalog):
        self.spark, self.root, self.catalog = spark, root.rstrip("/"), catalog
        self.files = Files(spark, self.root)
        self._open: list[tuple[str, Manifest]] | None = None

    # ------------------------------------------------------------ versions

    def manifest(self, table: str) -> Manifest:
        """The newest version; within a transaction, the one that it has prepared."""
        for name, m in reversed(self._open or []):
            if name == table:
                return m
        versions = [n for n in self.files.names(f"{self.root}/{table}/versions") if n.endswith(".json")]
        if not versions:
            raise RoutingError(f"there is no table {table}")
        return Manifest(**json.loads(self.files.read(f"{self.root}/{table}/versions/{versions[-1]}")))

    def exists(self, table: str) -> bool:
        return bool(self.files.names(f"{self.root}/{table}/versions"))

    def _publish(self, table: str, m: Manifest) -> None:
        if self._open is not None:
            self._open.append((table, m))
        else:
            self.files.create(f"{self.root}/{table}/versions/{m.version:012d}.json", m.text())

    def __enter__(self) -> Store:
        """Begin a transaction: its writes become visible together at the end, or not at all if it raises."""
        if self._open is not None:
            raise RoutingError("a transaction is open")
        self._open = []
        return self

    def __exit__(self, kind, value, trace) -> None:
        done, self._open = self._open, None
        if kind is None and done:
            self.commit(self.prepare(done))

    def prepare(self, manifests: Iterable[tuple[str, Manifest]]) -> str:
        """Phase one: all data is stored already; store what is to be published.  Returns the transaction's name."""
        name = f"{uuid.uuid4().hex}.json"
        self.files.create(f"{self.root}/_transactions/{name}", json.dumps([(t, json.loads(m.text())) for t, m in manifests]))
        return name

    def commit(self, name: str) -> None:
        """Phase two: publish each manifest that is not there yet, then forget the transaction."""
        planned = json.loads(self.files.read(f"{self.root}/_transactions/{name}"))
        open_ = []
        for table, m in planned:
            path, version = f"{self.root}/{table}/versions", f"{m['version']:012d}.json"
            if version not in self.files.names(path):
                open_.append((f"{path}/{version}", m))
            elif json.loads(self.files.read(f"{path}/{version}")) != m:
                # none is published if one cannot be
                self.files.delete(f"{self.root}/_transactions/{name}")
                raise RoutingError(f"another writer was first: {table}")
        for path, m in open_:
            self.files.create(path, json.dumps(m))
        self.files.delete(f"{self.root}/_transactions/{name}")

    def recover(self) -> int:
        """Finish prepared transactions; returns how many there were."""
        names = [n for n in self.files.names(f"{self.root}/_transactions") if n.endswith(".json")]
        for n in names:
            self.commit(n)
        return len(names)

    # ------------------------------------------------------------ reading

    def _frame(self, m: Manifest, table: str, shards: Shards | None = None) -> DataFrame:
        """Rows as stored, with shard."""
        base = f"{self.root}/{table}/data"
        paths = [f"{base}/{f}" for s, folders in sorted(m.folders.items()) if shards is None or int(s) in shards for f in folders]
        schema = StructType.fromJson(json.loads(m.schema))
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("shard", F.lit(0))
        df = self.spark.read.schema(StructType(schema.fields).add("shard", IntegerType()).add("w", StringType())).option("basePath", base).parquet(*paths)
        return df.drop("w")

    def read(self, table: str, predicate: str | None = None, args: dict | None = None) -> DataFrame:
        """Each row once, with its shard; only the folders of the shards that the predicate leaves are listed and read."""
        from ..operators.params import bound

        m, t = self.manifest(table), self.catalog.sharded(table)
        shards = prune(self.spark, t, predicate, args) if t and predicate else None
        df = self._frame(m, table, shards)
        return df.where(bound(predicate, args or {})) if predicate else df

    # ------------------------------------------------------------ writing

    def _place(self, table: str, rows: DataFrame) -> DataFrame:
        """Rows with their shard: by the schema of the table, the key, in turn where that gives none, or the one copy of a replicated table."""
        schema = table.split(".")[0] if "." in table else None
        if schema in self.catalog.schemas:
            s = self.catalog.schemas[schema]
            return rows.withColumn("shard", F.lit(0 if s is None else s))
        t = self.catalog.sharded(table)
        if t is None:
            return rows.withColumn("shard", F.lit(0))
        dealt = round_robin(rows, t.shards)
        return dealt.withColumn("shard", F.coalesce(t.shard_column(), "shard").cast("int")) if t.column in rows.columns else dealt

    def _write(self, table: str, placed: DataFrame) -> dict[str, str]:
        """Folders of the rows, by shard; a shard's rows are brought together by one shuffle, large shards are split."""
        w, base = uuid.uuid4().hex, f"{self.root}/{table}/data"
        placed.hint("rebalance", "shard").withColumn("w", F.lit(w)).write.mode("append").partitionBy("shard", "w").parquet(base)
        shards = [n.removeprefix("shard=") for n in self.files.names(base) if n.startswith("shard=")]
        return {s: f"shard={s}/w={w}" for s in shards if f"w={w}" in self.files.names(f"{base}/shard={s}")}

    def _returned(self, table: str, folders: dict[str, str], schema: StructType) -> Written:
        m = Manifest(0, schema.json(), {s: [f] for s, f in folders.items()})
        rows = self._frame(m, table)
        return Written(rows.count(), frozenset(map(int, folders)), rows)

    def create(self, table: str, rows: DataFrame) -> Written:
        """A new table of the rows; refused where there is one."""
        if self.exists(table):
            raise RoutingError(f"{table} is there already")
        folders = self._write(table, self._place(table, rows))
        self._publish(table, Manifest(1, rows.schema.json(), {s: [f] for s, f in folders.items()}))
        return self._returned(table, folders, rows.schema)

    def _aligned(self, m: Manifest, rows: DataFrame) -> DataFrame:
        """Rows with the table's columns and types; a column that they lack is null, the key stays missing."""
        fields = StructType.fromJson(json.loads(m.schema)).fields
        return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))

    def insert(self, table: str, rows: DataFrame) -> Written:
        m = self.manifest(table)
        folders = self._write(table, self._place(table, self._aligned(m, rows)))
        after = {s: list(f) for s, f in m.folders.items()}
        for s, f in folders.items():
            after.setdefault(s, []).append(f)
        self._publish(table, Manifest(m.version + 1, m.schema, after))
        return self._returned(table, folders, StructType.fromJson(json.loads(m.schema)))

    def _rewrite(self, table: str, shards: Shards | None, change) -> tuple[Manifest, dict[str, str]]:
        """Replace the content of the touched shards by change(their rows); other shards keep their folders."""
        m = self.manifest(table)
        touched = {s for s in m.folders if shards is None or int(s) in shards}
        folders = self._write(table, change(self._frame(m, table, None if shards is None else Shards(map(int, touched))))) if touched else {}
        after = {s: f for s, f in m.folders.items() if s not in touched} | {s: [f] for s, f in folders.items()}
        return Manifest(m.version + 1, m.schema, after), folders

    def update(self, table: str, predicate: str, assign: dict[str, Column]) -> Written:
        """Set columns of the rows that satisfy the predicate; the sharding key is moved by move_row."""
        t = self.catalog.sharded(table)
        if t and t.column in assign:
            raise RoutingError("the sharding key is assigned: use move_row")
        shards = prune(self.spark, t, predicate) if t else None
        hit = F.coalesce(F.expr(predicate), F.lit(False))
        before = self.read(table, predicate)
        returning = before.select(*(assign[c].alias(c) if c in assign else F.col(f"`{c}`") for c in before.columns))
        n = before.count()
        if n:
            m, _ = self._rewrite(table, shards, lambda df: df.select(*(F.when(hit, assign[c]).otherwise(F.col(f"`{c}`")).cast(df.schema[c].dataType).alias(c) if c in assign else F.col(f"`{c}`") for c in df.columns)))
            self._publish(table, m)
        return Written(n, self._touched(table, shards) if n else frozenset(), returning)

    def _touched(self, table: str, shards: Shards | None) -> frozenset[int]:
        return frozenset(range(self.catalog.shards)) if shards is None else frozenset(shards)

    def delete(self, table: str, predicate: str) -> Written:
        t = self.catalog.sharded(table)
        shards = prune(self.spark, t, predicate) if t else None
        gone = self.read(table, predicate)
        n = gone.count()
        if n:
            m, _ = self._rewrite(table, shards, lambda df: df.where(~F.coalesce(F.expr(predicate), F.lit(False))))
            self._publish(table, m)
        return Written(n, self._touched(table, shards) if n else frozenset(), gone)

    def move_row(self, table: str, predicate: str | None, new_key, destructive_fk: bool = False) -> Written:
        """Assign the sharding key of one row: it leaves its shard and enters that of the new key, both at once; returns the new row."""
        t = self.catalog.sharded(table)
        if not predicate:
            raise RoutingError("an update of the sharding key needs WHERE")
        if destructive_fk or self.catalog.destructive(table):
            raise RoutingError("a foreign key would delete dependants of the moved row")
        row = self.read(table, predicate)
        found = row.limit(2).count()
        if found > 1:
            raise RoutingError("an update of the sharding key may touch one row only")
        if not found:
            return Written(0, frozenset(), row)
        m = self.manifest(table)
        moved = row.drop("shard").withColumn(t.column, F.lit(new_key).cast(row.schema[t.column].dataType))
        new = self._write(table, self._place(table, moved))
        after, _ = self._rewrite(table, prune(self.spark, t, predicate), lambda df: df.where(~F.coalesce(F.expr(predicate), F.lit(False))))
        for s, f in new.items():
            after.folders.setdefault(s, []).append(f)
        self._publish(table, after)
        return self._returned(table, new, StructType.fromJson(json.loads(m.schema)))

    def upsert(self, table: str, rows: DataFrame, key: str, order_by: str, where: str | None = None) -> Written:
        """Rows replace those of equal key, others are added; of several rows of a key that with the greatest order_by holds (order_by is no column of the table).

        where is the predicate of a partial unique index, as in ON CONFLICT (key) WHERE: rows that do not satisfy it neither replace nor are replaced.
        """
        m, t = self.manifest(table), self.catalog.sharded(table)
        columns = [f.name for f in StructType.fromJson(json.loads(m.schema)).fields]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), order_by).alias("r")).select("r.*")
        placed = self._place(table, self._aligned(m, last))
        if t and t.column == key:
            shards: Shards | None = Shards(r.shard for r in placed.select("shard").distinct().collect())  # one row per shard
        else:
            shards = None
        new = self._write(table, placed)
        unique = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        kept = self._frame(Manifest(0, m.schema, {s: [f] for s, f in new.items()}), table).where(unique).select(F.col(f"`{key}`").alias("_kept"))
        after, _ = self._rewrite(table, shards, lambda df: df.join(kept, (F.col(f"`{key}`") == F.col("_kept")) & unique, "left_anti").select(*columns, "shard"))
        for s, f in new.items():
            after.folders.setdefault(s, []).append(f)
        self._publish(table, after)
        return self._returned(table, new, StructType.fromJson(json.loads(m.schema)))

    def truncate(self, *tables: str) -> None:
        """Empty tables, all together; of sharded and of unsharded schemas at once is refused."""
        sharded = {t.split(".")[0] in self.catalog.schemas for t in tables}
        if len(sharded) > 1:
            raise RoutingError("TRUNCATE over sharded and other schemas")
        made = [(t, Manifest(self.manifest(t).version + 1, self.manifest(t).schema, {})) for t in tables]
        if self._open is not None:
            self._open += made
        else:
            self.commit(self.prepare(made))

    def vacuum(self, table: str) -> int:
        """Delete the folders that the newest version does not name; returns how many.  No reader of older versions may run."""
        base, m = f"{self.root}/{table}/data", self.manifest(table)
        used = {f for folders in m.folders.values() for f in folders}
        gone = [f"{s}/{w}" for s in self.files.names(base) if s.startswith("shard=") for w in self.files.names(f"{base}/{s}") if f"{s}/{w}" not in used]
        for f in gone:
            self.files.delete(f"{base}/{f}")
        return len(gone)

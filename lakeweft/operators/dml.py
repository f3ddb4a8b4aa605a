"""Writable tables as versioned Parquet folders: INSERT, UPDATE, DELETE and the rest, copy on write.

Each change writes the next version beside the current one and then its manifest, a small
file renamed to the next number.  No manifest is ever replaced, so readers see whole versions,
a failed job changes nothing, and of two writers at once the later one gets an error.  Appends reuse the files of the version before by listing them.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConstraintError(ValueError):
    """A row breaks a key, a reference or a NOT NULL."""


class ConcurrentChange(RuntimeError):
    """Another writer published a version since this one read the table."""


@dataclasses.dataclass
class Reference:
    column: str
    parent: WritableTable
    parent_column: str
    on_delete: str = "restrict"  # restrict, cascade, set null


class WritableTable:
    """One table in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, primary_key: Sequence[str] = (), unique: Sequence[Sequence[str]] = (), auto_increment: str | None = None, defaults: dict[str, Column] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.primary_key, self.unique = list(primary_key), [list(u) for u in unique]
        self.auto_increment, self.defaults = auto_increment, defaults or {}
        self.references: list[Reference] = []
        self.children: list[tuple[WritableTable, Reference]] = []
        self.triggers: list[tuple[str, str, Callable[[DataFrame], DataFrame | None]]] = []
        if self._read() is None:
            self._publish([])

    # ---- versions -------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self) -> int:
        """The number of the newest manifest, -1 without any."""
        jvm, fs = self._fs()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest-*.json"))
        return max((int(x.getPath().getName()[9:-5]) for x in found or []), default=-1)

    def _manifest(self, number: int):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest-{number:012d}.json")

    def _read(self) -> dict | None:
        _, fs = self._fs()
        self._seen = self._latest()
        if self._seen < 0:
            return None
        stream = fs.open(self._manifest(self._seen))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"number": self._seen}
        finally:
            stream.close()

    def _publish(self, parts: list[str], after: int | None = None) -> None:
        """Make ``parts`` the version after number ``after`` (the last one read, if not given)."""
        jvm, fs = self._fs()
        after = self._seen if after is None else after
        text = json.dumps({"parts": parts, "schema": self.schema.jsonValue()})
        temporary = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/.{uuid.uuid4().hex}.json")
        out = fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._manifest(after + 1)
        if fs.exists(target) or not fs.rename(temporary, target):
            fs.delete(temporary, False)
            raise ConcurrentChange("another writer changed the table meanwhile")
        self._seen = after + 1

    def read(self) -> DataFrame:
        state = self._read()
        if not state["parts"]:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{p}" for p in state["parts"]))

    def _write(self, rows: DataFrame) -> str:
        name = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def _replace(self, rows: DataFrame) -> None:
        name = self._write(rows.select(*self.schema.names))
        self._checked(self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}"))
        self._publish([name])

    # ---- constraints ------------------------------------------------------------------

    def refer(self, column: str, parent: WritableTable, parent_column: str, on_delete: str = "restrict") -> None:
        """Declare a foreign key."""
        ref = Reference(column, parent, parent_column, on_delete)
        self.references.append(ref)
        parent.children.append((self, ref))

    def _keys(self) -> list[list[str]]:
        return ([self.primary_key] if self.primary_key else []) + self.unique

    def _checked(self, rows: DataFrame) -> None:
        required = [f.name for f in self.schema if not f.nullable or f.name in self.primary_key]
        if required and not rows.filter(" or ".join(f"`{c}` is null" for c in required)).limit(1).isEmpty():
            raise ConstraintError("a NOT NULL column is NULL")
        for key in self._keys():
            whole = rows.dropna(subset=key)
            if not whole.groupBy(*key).count().filter("count > 1").limit(1).isEmpty():
                raise ConstraintError(f"duplicate key {key}")
        for ref in self.references:
            known = ref.parent.read().select(F.col(ref.parent_column).alias(ref.column))
            if not rows.filter(F.col(ref.column).isNotNull()).join(known, ref.column, "left_anti").limit(1).isEmpty():
                raise ConstraintError(f"{ref.column} refers to no row")

    def on(self, when: str, event: str, action: Callable[[DataFrame], DataFrame | None]) -> None:
        """A trigger over the set of changed rows: 'before' may return other rows, 'after' sees what was written."""
        self.triggers.append((when, event, action))

    def _fire(self, when: str, event: str, rows: DataFrame) -> DataFrame:
        for w, e, action in self.triggers:
            if (w, e) == (when, event):
                rows = action(rows) or rows
        return rows

    # ---- statements ---------------------------------------------------------------------

    def _shaped(self, rows: DataFrame) -> DataFrame:
        have = set(rows.columns)
        columns = []
        for f in self.schema:
            value = F.col(f"`{f.name}`") if f.name in have else self.defaults.get(f.name, F.lit(None))
            if isinstance(f.dataType, (T.LongType, T.IntegerType)) and f.name in have and isinstance(rows.schema[f.name].dataType, T.StringType):
                value = F.coalesce(F.regexp_extract(value, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))
            columns.append(value.cast(f.dataType).alias(f.name))
        out = rows.select(*columns)
        if self.auto_increment:
            c = self.auto_increment
            top = self.read().agg(F.coalesce(F.max(c), F.lit(0)).alias("m")).first()["m"]
            fresh = out.filter(F.col(c).isNull()).drop(c)
            # numbers given by partition, then by place in it: no single-task sort of the new rows
            part = fresh.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
            part = self.spark.read.parquet(f"{self.folder}/{self._write(part)}")
            sizes = part.groupBy("__p").count().withColumn("__before", F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
            numbered = part.join(F.broadcast(sizes.select("__p", F.coalesce("__before", F.lit(0)).alias("__before"))), "__p")  # one row for each partition
            numbered = numbered.withColumn(c, (F.lit(top) + F.col("__before") + F.row_number().over(Window.partitionBy("__p").orderBy("__i"))).cast(self.schema[c].dataType))
            out = out.filter(F.col(c).isNotNull()).unionByName(numbered.select(*self.schema.names))
        return out

    def insert(self, rows: DataFrame, ignore: bool = False, on_duplicate: dict[str, Column] | None = None) -> int:
        """Append rows.  A duplicate key is an error, is passed over (``ignore``), or updates the row that is there.

        In ``on_duplicate`` a column ``new.x`` is the rejected row's value.  A row may clash on any
        key; the first key of primary key and unique keys that clashes decides which row it
        updates.  A key with a NULL in it clashes with none.  Returns the number of new rows.
        """
        new = self._fire("before", "insert", self._shaped(rows))
        name = self._write(new)
        new = self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}")
        state = self._read()
        keys = self._keys()
        if ignore or on_duplicate:
            for key in keys:
                whole = " and ".join(f"`{k}` is not null" for k in key)
                ranked = new.filter(whole).withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*self.schema.names)))
                new = ranked.filter("__r = 1").drop("__r").unionByName(new.filter(f"not ({whole})"))
            old = self.read()
            if on_duplicate and keys:
                updated, fresh = old, new
                for key in keys:
                    hit = updated.alias("old").join(fresh.alias("new"), [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key], "left")
                    matched = F.col(f"new.{key[0]}").isNotNull()
                    updated = hit.select(*(F.when(matched, on_duplicate[f.name]).otherwise(F.col(f"old.{f.name}")).cast(f.dataType).alias(f.name) if f.name in on_duplicate else F.col(f"old.{f.name}") for f in self.schema))
                    fresh = fresh.join(old.select(*key).dropna(), key, "left_anti").select(*self.schema.names)
                n = fresh.count()
                self._replace(updated.unionByName(fresh))
                return n
            fresh = new
            for key in keys:
                fresh = fresh.join(old.select(*key).dropna(), key, "left_anti").select(*self.schema.names)
            name = self._write(fresh)
            new = self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}")
        both = self.read().unionByName(new) if keys else new
        self._checked(both)
        self._publish([*state["parts"], name], state["number"])
        self._fire("after", "insert", new)
        return new.count()

    def _chosen(self, where: Column | None, order: Sequence[Column] | None, limit: int | None) -> tuple[DataFrame, Column]:
        """(rows, flag) where the flag marks the rows a statement concerns."""
        rows = self.read()
        hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        if limit is None:
            return rows.withColumn("__hit", hit), F.col("__hit")
        key = self.primary_key or rows.columns
        first = rows.filter(hit).orderBy(*(order or []), *key).limit(limit).select(*(F.col(k).alias(f"__{k}") for k in key)).withColumn("__hit", F.lit(True))
        marked = rows.join(first, [rows[k].eqNullSafe(first[f"__{k}"]) for k in key], "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
        return marked.select(*rows.columns, "__hit"), F.col("__hit")

    def update(self, values: dict[str, Column], where: Column | None = None, order: Sequence[Column] | None = None, limit: int | None = None) -> int:
        rows, hit = self._chosen(where, order, limit)
        n = rows.filter(hit).count()
        if n:
            new = [F.when(hit, values[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name) for f in self.schema]
            if not any(e == "update" for _, e, _ in self.triggers):
                self._replace(rows.select(*new))
                return n
            # a trigger sees the new values under their names and the old ones as old_x
            changed = rows.filter(hit).select(*new, *(F.col(c).alias(f"old_{c}") for c in self.schema.names))
            changed = self._fire("before", "update", changed)
            changed = self.spark.read.parquet(f"{self.folder}/{self._write(changed)}")
            self._replace(rows.filter(~hit).select(*self.schema.names).unionByName(changed.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))))
            self._fire("after", "update", changed)
        return n

    def update_from(self, other: DataFrame, keys: Sequence[tuple[str, str]], values: dict[str, Column]) -> None:
        """UPDATE of several tables: columns of ``other`` are named ``other_x`` in ``values``, the table's own by their names."""
        right = other.select(*(F.col(c).alias(f"other_{c}") for c in other.columns)).withColumn("__hit", F.lit(True))
        joined = self.read().join(right, [F.col(a) == F.col(f"other_{b}") for a, b in keys], "left")
        self._replace(joined.select(*(F.when(F.col("__hit"), values[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name) for f in self.schema)))

    def delete(self, where: Column | None = None, order: Sequence[Column] | None = None, limit: int | None = None) -> int:
        rows, hit = self._chosen(where, order, limit)
        gone = rows.filter(hit).drop("__hit")
        n = gone.count()
        if n:
            touched = []
            for child, ref in self.children:  # all refusals come before any change
                keys = gone.select(F.col(ref.parent_column).alias("__k")).distinct()
                if child.read().join(keys, F.col(ref.column) == F.col("__k"), "left_semi").limit(1).isEmpty():
                    continue
                if ref.on_delete == "restrict":
                    raise ConstraintError(f"rows still refer to {ref.parent_column}")
                touched.append((child, ref, keys))
            for child, ref, keys in touched:
                member = child.read().join(keys.withColumn("__m", F.lit(True)), F.col(ref.column) == F.col("__k"), "left")
                if ref.on_delete == "cascade":
                    held = member.filter("__m is null").select(*child.schema.names)
                else:
                    held = member.select(*(F.when(F.col("__m"), None).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name == ref.column else F.col(f.name) for f in child.schema))
                child._replace(held)
            self._fire("before", "delete", gone)
            self._replace(rows.filter(~hit).drop("__hit"))
            self._fire("after", "delete", gone)
        return n

    def delete_using(self, other: DataFrame, keys: Sequence[tuple[str, str]]) -> None:
        """DELETE ... USING: rows whose key ``other`` holds go."""
        right = other.select(*(F.col(b).alias(f"__{b}") for _, b in keys)).distinct()
        self._replace(self.read().join(right, [F.col(a) == F.col(f"__{b}") for a, b in keys], "left_anti"))

    def truncate(self) -> None:
        self._publish([])

    def add_column(self, name: str, kind: str, default: Column | None = None) -> None:
        rows = self.read().withColumn(name, (default if default is not None else F.lit(None)).cast(kind))
        self.schema = T.StructType([*self.schema.fields, T.StructField(name, rows.schema[name].dataType, True)])
        self._replace(rows)

    def drop_column(self, name: str) -> None:
        rows = self.read().drop(name)
        self.schema = T.StructType([f for f in self.schema.fields if f.name != name])
        self._replace(rows)

    def change_column(self, name: str, new_name: str, kind: str) -> None:
        rows = self.read().select(*(F.col(c).try_cast(kind).alias(new_name) if c == name else F.col(c) for c in self.schema.names))
        self.schema = T.StructType([T.StructField(new_name, rows.schema[new_name].dataType, True) if f.name == name else f for f in self.schema.fields])
        self._replace(rows)

    def rebuild(self, partitions: int | None = None, range_by: Sequence[str] = ()) -> None:
        """Compaction: few large files, ranged and sorted by ``range_by`` so that file statistics prune scans."""
        rows = self.read()
        n = partitions or max(1, len(self._read()["parts"]))
        self._replace(rows.repartitionByRange(n, *range_by).sortWithinPartitions(*range_by) if range_by else rows.repartition(n))

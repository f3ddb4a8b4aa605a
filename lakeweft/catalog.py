"""Tables, views and the information_schema, as frames over Spark's catalog."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweft.session import engine_session

DRIVER_TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


@dataclasses.dataclass
class Constraint:
    table: str
    name: str
    kind: str  # PRIMARY KEY, UNIQUE, FOREIGN KEY
    columns: tuple[str, ...]
    target: str = ""
    target_columns: tuple[str, ...] = ()
    on_delete: str = "RESTRICT"


class Catalog:
    """The tables an engine session knows: views over frames, and constraints declared on them."""

    def __init__(self, spark: SparkSession, ci_equality: bool = False):
        self.spark, self.ci_equality = spark, ci_equality
        self.frames: dict[str, DataFrame] = {}
        self.views: dict[str, str] = {}
        self.constraints: list[Constraint] = []
        self.comments: dict[tuple[str, str], dict] = {}

    def add(self, name: str, frame: DataFrame) -> DataFrame:
        """Register ``frame`` under ``name``.  With ``ci_equality`` its strings compare without regard to case."""
        if self.ci_equality:
            frame = frame.select(*(F.collate(F.col(f"`{f.name}`"), "UTF8_LCASE").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in frame.schema))
        frame.createOrReplaceTempView(name)
        self.frames[name.lower()] = frame
        return frame

    def add_parquet(self, folder: str, names=DRIVER_TABLES) -> None:
        for n in names:
            self.add(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))

    def add_view(self, name: str, spark_sql: str, replace: bool = False) -> None:
        if not replace and (name.lower() in self.views or name.lower() in self.frames):
            raise ValueError(f"{name} exists")
        frame = self.spark.sql(spark_sql)
        frame.createOrReplaceTempView(name)
        self.views[name.lower()] = spark_sql
        self.frames[name.lower()] = frame

    def drop(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)
        self.frames.pop(name.lower(), None)
        self.views.pop(name.lower(), None)
        self.constraints = [c for c in self.constraints if c.table != name.lower()]

    def rename(self, old: str, new: str) -> None:
        frame = self.frames[old.lower()]
        self.drop(old)
        self.frames[new.lower()] = frame
        frame.createOrReplaceTempView(new)

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name.lower()]

    # ---- information_schema --------------------------------------------------------

    def _frame(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def schemata(self) -> DataFrame:
        return self._frame([("def", "default", "utf8mb4", "utf8mb4_general_ci")], "catalog_name string, schema_name string, default_character_set_name string, default_collation_name string")

    def tables(self) -> DataFrame:
        return self._frame([("def", "default", n, "VIEW" if n in self.views else "BASE TABLE") for n in sorted(self.frames)], "table_catalog string, table_schema string, table_name string, table_type string")

    def columns(self) -> DataFrame:
        rows = []
        for n, frame in sorted(self.frames.items()):
            keys = {c for k in self.constraints if k.table == n and k.kind == "PRIMARY KEY" for c in k.columns}
            for i, f in enumerate(frame.schema, 1):
                extra = self.comments.get((n, f.name), {})
                rows.append((n, f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO", extra.get("default"), "PRI" if f.name in keys else "", extra.get("comment", "")))
        return self._frame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, column_default string, column_key string, column_comment string")

    def key_column_usage(self) -> DataFrame:
        rows = []
        for c in self.constraints:
            for i, col in enumerate(c.columns):
                rows.append((c.name, c.table, col, i + 1, c.target or None, c.target_columns[i] if c.target_columns else None))
        return self._frame(rows, "constraint_name string, table_name string, column_name string, ordinal_position int, referenced_table_name string, referenced_column_name string")

    def referential_constraints(self) -> DataFrame:
        return self._frame([(c.name, c.table, c.target, c.on_delete) for c in self.constraints if c.kind == "FOREIGN KEY"], "constraint_name string, table_name string, referenced_table_name string, delete_rule string")

    def statistics(self) -> DataFrame:
        return self._frame([(c.table, c.name, i + 1, col, 0) for c in self.constraints if c.kind != "FOREIGN KEY" for i, col in enumerate(c.columns)], "table_name string, index_name string, seq_in_index int, column_name string, non_unique int")

    def files(self) -> DataFrame:
        return self._frame([(n, p) for n, f in sorted(self.frames.items()) if n not in self.views for p in f.inputFiles()], "table_name string, file_name string")

    def partitions(self) -> DataFrame:
        return self._frame([(n, i) for n, f in sorted(self.frames.items()) if n not in self.views for i in range(len(f.inputFiles()))], "table_name string, partition_ordinal_position int")

    def register_information_schema(self) -> None:
        """The frames above as views ``information_schema_<name>``, which the dialects' dotted names are mapped to."""
        for n in ("schemata", "tables", "columns", "key_column_usage", "referential_constraints", "statistics", "files", "partitions"):
            getattr(self, n)().createOrReplaceTempView(f"information_schema_{n}")


def open_catalog(spark: SparkSession, folder: str | None = None, ci_equality: bool = False) -> Catalog:
    """A catalog in an engine session of its own, with the tables found under ``folder``."""
    catalog = Catalog(engine_session(spark), ci_equality)
    if folder is not None:
        catalog.add_parquet(folder)
    return catalog

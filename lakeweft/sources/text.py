"""Delimited text, JSON lines with table marks, whole files, and compressed byte streams."""

from __future__ import annotations

import gzip
import io
import json
import lzma
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, delimiter: str = ";", header: bool = True) -> DataFrame:
    """Delimited text as the loader has it: a plain split, no quoting.

    With a schema nothing is scanned twice.  Without one columns are strings, and ``typed``
    gives each its kind in one more pass.
    """
    reader = spark.read.option("sep", delimiter).option("header", header).option("quote", "").option("mode", "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema is not None else reader.csv(path)


def typed(frame: DataFrame) -> DataFrame:
    """String columns as bigint or double where every value is one; the kinds come from one aggregate."""
    names = [f.name for f in frame.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return frame
    checks = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        checks += [F.every(c.isNull() | c.try_cast("bigint").isNotNull()).alias(f"i{i}"), F.every(c.isNull() | c.try_cast("double").isNotNull()).alias(f"d{i}"), F.count(c).alias(f"n{i}")]
    facts = frame.agg(*checks).first()
    kinds = {n: "bigint" if facts[f"i{i}"] else "double" if facts[f"d{i}"] else None for i, n in enumerate(names) if facts[f"n{i}"]}
    return frame.select(*(F.col(f"`{n}`").try_cast(kinds[n]).alias(n) if kinds.get(n) else F.col(f"`{n}`") for n in frame.columns))


def json_line_tables(spark: SparkSession, path: str) -> list[str]:
    """Names that the file's ``#table`` lines give, in order."""
    marks = spark.read.text(path).filter(F.col("value").startswith("#table ")).select(F.trim(F.substring("value", 8, 1000)).alias("name")).distinct()
    return sorted(r["name"] for r in marks.collect())  # one row for each table


def load_json_lines(spark: SparkSession, path: str, table: str | None = None, schema: str | None = None) -> DataFrame:
    """JSON lines; ``#table name`` says where the lines after it belong, other ``#`` lines are comments.

    Lines before any mark belong to the table of no name.  Without a schema it comes from
    the table's first object, as the loader does.  A mark applies to what follows it in its file, so each file is read
    by one task when marks are used.
    """
    wanted = table or ""

    def owned(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for text in b.column("value").to_pylist():
                at = ""
                for line in text.splitlines():
                    if line.startswith("#"):
                        if line.startswith("#table "):
                            at = line[7:].strip()
                    elif line.strip() and at == wanted:
                        out.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["line"])

    if table is None:
        lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.col("value").alias("line"))
    else:
        lines = spark.read.text(path, wholetext=True).mapInArrow(owned, "line string")
    if schema is None:
        first = lines.limit(1).collect()
        if not first:
            return spark.createDataFrame([], "line string")
        fields = [f"`{k}` {_any_kind(v)}" for k, v in json.loads(first[0]["line"]).items()]
        schema = ", ".join(fields)
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def _any_kind(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint"
    if isinstance(value, float):
        return "double"
    return "string"


def load(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Lines of files, or whole files; gzip is read by its extension."""
    return spark.read.text(path, wholetext=whole)


def stream_string(spark: SparkSession, text: str) -> DataFrame:
    """Lines of a text in memory."""
    return spark.createDataFrame([(x,) for x in text.splitlines()], "value string")


def gzip_bytes(data: bytes) -> bytes:
    return gzip.compress(data, mtime=0)


def zcat_bytes(data: bytes) -> bytes:
    return gzip.decompress(data)


def xz_bytes(data: bytes) -> bytes:
    return lzma.compress(data)


def xzcat_bytes(data: bytes) -> bytes:
    return lzma.decompress(data)


def load_xz(spark: SparkSession, path: str) -> DataFrame:
    """Lines of xz files, which Spark has no codec for: each file is unpacked by one task, as a stream."""

    def unpack(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for content in b.column("content").to_pylist():
                lines = []
                for line in io.TextIOWrapper(lzma.LZMAFile(io.BytesIO(content)), encoding="utf-8"):
                    lines.append(line.rstrip("\r\n"))
                    if len(lines) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                        lines = []
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "value string")


def copy_field(c: Column) -> Column:
    """A COPY field: ``\\N`` is NULL, backslash escapes are undone."""
    out = c
    for a, b in ((r"\\t", "\t"), (r"\\n", "\n"), (r"\\r", "\r"), (r"\\\\", r"\\")):
        out = F.regexp_replace(out, a if a != r"\\\\" else r"\\\\", b)
    return F.when(c == r"\N", F.lit(None).cast("string")).otherwise(out)


_CREATE = re.compile(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"`]+)\s*\((.*?)\)\s*;", re.S | re.I)
_COPY = re.compile(r"^COPY\s+([\w.\"]+)\s*(?:\(([^)]*)\))?\s+FROM\s+stdin;\n(.*?)^\\\.$", re.S | re.I | re.M)


def parse_dump(text: str) -> tuple[dict[str, list[tuple[str, str]]], dict[str, tuple[list[str], str]], list[str]]:
    """(tables with their columns, COPY bodies with their columns, INSERT statements) of a dump."""
    from lakeweft.plans.dialect import CAST_TYPES

    name = lambda s: s.split(".")[-1].strip('`" ')
    tables = {}
    for t, body in _CREATE.findall(text):
        columns = []
        for part in re.split(r",(?![^()]*\))", body):
            words = part.split()
            if words and words[0].upper() not in ("PRIMARY", "UNIQUE", "CONSTRAINT", "FOREIGN", "KEY", "CHECK"):
                kind = re.match(r"[A-Za-z]+", words[1])[0].upper() if len(words) > 1 else "TEXT"
                columns.append((name(words[0]), {"CHARACTER": "string"}.get(kind) or CAST_TYPES.get(kind, "string")))
        tables[name(t)] = columns
    copies = {name(t): ([name(c) for c in cols.split(",")] if cols else [], body) for t, cols, body in _COPY.findall(text)}
    inserts = re.findall(r"^INSERT\s+INTO\s.*?;\s*$", text, re.S | re.I | re.M)
    return tables, copies, inserts


def load_dump(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """Frames of the tables of a PostgreSQL dump, from its DDL and COPY bodies."""
    tables, copies, _ = parse_dump(text)
    out = {}
    for t, columns in tables.items():
        names, body = copies.get(t, ([c for c, _ in columns], ""))
        names = names or [c for c, _ in columns]
        raw = stream_string(spark, body) if body else spark.createDataFrame([], "value string")
        split = raw.select(F.split("value", "\t", -1).alias("f"))
        kinds = dict(columns)
        out[t] = split.select(*(copy_field(F.get("f", i)).try_cast(kinds[n]).alias(n) for i, n in enumerate(names) if n in kinds))
    return out


def jdbc_import(spark: SparkSession, url: str, table: str, user: str, password: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A table of another database, read in parallel ranges of ``key`` when its bounds are known.

    The driver jar must be on the class path.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, user=user, password=password, fetchsize="10000")
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def mysql_import(spark: SparkSession, host: str, port: int, user: str, password: str, database: str, table: str, **more) -> DataFrame:
    return jdbc_import(spark, f"jdbc:mysql://{host}:{port}/{database}", table, user, password, **more)


def psql_import(spark: SparkSession, host: str, port: int, user: str, password: str, database: str, schema: str, table: str, **more) -> DataFrame:
    return jdbc_import(spark, f"jdbc:postgresql://{host}:{port}/{database}", f'"{schema}"."{table}"', user, password, **more)


def json_rows(frame: DataFrame) -> DataFrame:
    """One JSON object a row, NULL fields kept: what an HTTP client is sent."""
    return frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))

"""The engine: dialect text in, DataFrame out."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lakeweft.catalog import Catalog, open_catalog
from lakeweft.plans.dialect import DialectError, Rewriter, Token, group_end, literal, parts, tokens
from lakeweft.plans.statements import WORDS, Statements
from lakeweft.plans.triggers import create_trigger, drop_trigger
from lakeweft.rdf.sparql import Sparql


@dataclasses.dataclass
class Compat:
    """Switches for behaviour of the dialects that standard SQL doesn't share."""

    ci_equality: bool = False
    window_order_ignored: bool = False


class Engine:
    """One session: a catalog, session variables and a dialect.

    SELECT, UNION, SET, SHOW, DESCRIBE, EXPLAIN, views and USE are understood here; statements
    that change rows or tables go to ``plans.statements``, on tables under ``warehouse``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, dialect: str = "mysql", compat: Compat | None = None, warehouse: str | None = None):
        self.compat = compat or Compat()
        self.catalog: Catalog = open_catalog(spark, folder, self.compat.ci_equality)
        self.spark = self.catalog.spark
        self.dialect = dialect
        self.warehouse = (warehouse or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
        self.statements = Statements(self)
        self.variables: dict[str, object] = {"version": "8.0", "autocommit": 1, "time_zone": "UTC", "system_time_zone": "UTC"}

    def translate(self, text: str) -> str:
        toks = tokens(text, self.dialect)
        for i in range(len(toks) - 2):
            if toks[i].word == "INFORMATION_SCHEMA" and toks[i + 1].text == ".":
                self.catalog.register_information_schema()
                toks[i : i + 3] = [Token("name", f"information_schema_{toks[i + 2].text.lower()}"), Token("name", ""), Token("name", "")]
        toks = [t for t in toks if t.text]
        return Rewriter(self.dialect, self.compat.window_order_ignored, self.variables).text(toks)

    def sql(self, text: str, args: Sequence | dict | None = None) -> DataFrame:
        """Plan a statement.  ``?`` takes ``args`` in order, ``$n`` the n-th of them."""
        toks = tokens(text, self.dialect)
        if not toks:
            raise DialectError("an empty statement")
        word = toks[0].word
        if word in WORDS:
            return self.statements.run(self._bound(toks, args))
        special = getattr(self, f"_{word.lower()}", None) if word in ("SET", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "CREATE", "DROP", "USE") else None
        if special is not None:
            return special(toks, text)
        spark_text = self.translate(text)
        if args is None:
            return self.spark.sql(spark_text)
        if any(t.kind == "param" and t.text.startswith("$") for t in toks):
            return self.spark.sql(spark_text, args={f"p{i}": a for i, a in enumerate(args, 1)})
        return self.spark.sql(spark_text, args=args if isinstance(args, dict) else list(args))

    def _bound(self, toks: list[Token], args) -> list[Token]:
        """Placeholders of a changing statement as literals."""
        out, i = [], 0
        for t in toks:
            if t.kind == "param" and args is not None:
                value = args[int(t.text[1:]) - 1] if t.text.startswith("$") else args[i]
                i += 1
                out += tokens(literal(value), self.dialect)
            else:
                out.append(t)
        return out

    def sparql(self, text: str, graph: str = "rdf") -> DataFrame:
        """SPARQL over a triple table of the catalog."""
        return Sparql(self.catalog[graph]).query(text)

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "affected bigint")

    def _set(self, toks: list[Token], text: str) -> DataFrame:
        for part in parts(toks[1:]):
            names = [t for t in part if t.word not in ("SESSION", "GLOBAL", "LOCAL")]
            at = next((i for i, t in enumerate(names) if t.text in ("=", ":=")), None)
            if at is None:
                continue
            value = self.spark.sql("select " + Rewriter(self.dialect, False, self.variables).text(names[at + 1 :]) + " as v").first()["v"]
            name = "".join(t.text for t in names[:at]).lstrip("@").lower()
            self.variables[name.removeprefix("session.")] = value
            if name == "time_zone" and value is not None:
                self.spark.conf.set("spark.sql.session.timeZone", str(value))
        return self._none()

    def _use(self, toks: list[Token], text: str) -> DataFrame:
        return self._none()

    def _show(self, toks: list[Token], text: str) -> DataFrame:
        what = toks[1].word if toks[1].word != "FULL" else toks[2].word
        if what == "TABLES":
            return self.catalog.tables().select("table_name", "table_type")
        if what in ("DATABASES", "SCHEMAS"):
            return self.catalog.schemata().select("schema_name")
        if what in ("COLUMNS", "FIELDS"):
            return self._describe([toks[0], toks[-1]], text)
        if what in ("INDEX", "INDEXES", "KEYS"):
            return self.catalog.statistics().filter(f"table_name = {literal(toks[-1].text.strip('`').lower())}")
        if what == "VARIABLES":
            return self.spark.createDataFrame([(k, None if v is None else str(v)) for k, v in sorted(self.variables.items())], "variable_name string, value string")
        if what == "CREATE":
            name = toks[-1].text.strip("`")
            columns = ",\n  ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.catalog[name].schema)
            return self.spark.createDataFrame([(name, f"CREATE TABLE `{name}` (\n  {columns}\n)")], "table string, statement string")
        raise DialectError(f"SHOW {what} is not known")

    def _describe(self, toks: list[Token], text: str) -> DataFrame:
        name = toks[-1].text.strip("`").lower()
        return self.catalog.columns().filter(f"table_name = {literal(name)}").select("column_name", "data_type", "is_nullable", "column_key", "column_default").orderBy("column_name")

    _desc = _describe

    def _explain(self, toks: list[Token], text: str) -> DataFrame:
        """One row per line of Catalyst's plan; EXPLAIN IR gives the logical one."""
        modes = {"IR": "extended", "REORDER": "cost", "COMPILE": "codegen", "PHYSICAL": "formatted"}
        mode = modes.get(toks[1].word, "formatted")
        body = re.sub(r"^\s*EXPLAIN\s+((IR|REORDER|COMPILE|PHYSICAL|CALIBRATE)\s+)*", "", text, flags=re.I)
        return self.spark.sql(f"explain {mode} " + self.translate(body))

    def _create(self, toks: list[Token], text: str) -> DataFrame:
        at = next((i for i, t in enumerate(toks[:5]) if t.word == "VIEW"), None)
        if at is None:
            if any(t.word == "TRIGGER" for t in toks[:3]):
                return create_trigger(self.statements, toks)
            if any(t.word == "INDEX" for t in toks[:3]):
                return self.statements.create_index(toks)
            return self.statements.create_table(toks)
        replace = any(t.word == "REPLACE" for t in toks[:at])
        name = toks[at + 1].text.strip("`")
        body = next(i for i, t in enumerate(toks) if t.word == "AS")
        names = []
        if toks[at + 2].text == "(":
            names = [p[0].text.strip("`") for p in parts(toks[at + 3 : group_end(toks, at + 2)])]
        spark_text = Rewriter(self.dialect, self.compat.window_order_ignored, self.variables).text(toks[body + 1 :])
        self.catalog.add_view(name, f"select * from ({spark_text}) as v({', '.join(names)})" if names else spark_text, replace)
        return self._none()

    def _drop(self, toks: list[Token], text: str) -> DataFrame:
        if toks[1].word == "TRIGGER":
            return drop_trigger(self.statements, toks[-1].text.strip("`").lower())
        if toks[1].word == "TABLE":
            return self.statements.drop_table(toks[-1].text.strip("`").lower(), any(t.word == "EXISTS" for t in toks))
        self.catalog.drop(toks[-1].text.strip("`"))
        return self._none()

    def rows(self, text: str, args: Sequence | None = None):
        """Rows one after another, as a wire client takes them."""
        return self.sql(text, args).toLocalIterator()

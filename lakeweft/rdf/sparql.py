"""SPARQL text -> DataFrames over a triple table (s, p, o) of strings.

Each triple pattern is a filtered projection and shared variables are join keys, so join
order and strategy are Catalyst's.  Transitive paths are closed by iteration with a visited set (see
``closure``).
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweft.rdf.turtle import RDF_TYPE, unescape

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
      |(?P<iri><[^<>\s=]*>)
      |(?P<var>[?$][A-Za-z_]\w*)
      |(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
      |(?P<lang>@[A-Za-z]+(?:-\w+)*)
      |(?P<num>\d+\.\d+|\d+)
      |(?P<name>[A-Za-z_][\w-]*:[\w%.-]*[\w%-]|[A-Za-z_][\w-]*:|:[\w%-]+|:)
      |(?P<word>[A-Za-z_]\w*)
      |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}().;,=<>!*/|+?^-])""",
    re.X,
)


class SparqlError(ValueError):
    """The text isn't a supported query."""


@dataclasses.dataclass(frozen=True)
class Var:
    name: str


@dataclasses.dataclass(frozen=True)
class Path:
    """kind: iri, seq, alt, star, plus, inverse."""

    kind: str
    parts: tuple


Term = Var | str


def closure(edges: DataFrame, include_start: bool = False, max_depth: int = 1000) -> DataFrame:
    """(x, y) for every y reachable from x over ``edges(x, y)``; cycles end by the visited set.

    Paths double each round (reach joins itself), so rounds grow with the logarithm of the
    longest path; each round is written to the checkpoint folder if one is set.
    """
    spark = edges.sparkSession
    keep = (lambda d: d.checkpoint()) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else (lambda d: d.persist())
    step = edges.select("x", "y").distinct()
    reach = keep(step)
    n = reach.count()
    for _ in range(max_depth):
        longer = reach.alias("a").join(reach.alias("b"), F.col("a.y") == F.col("b.x")).select(F.col("a.x").alias("x"), F.col("b.y").alias("y"))
        nxt = keep(reach.unionByName(longer).distinct())
        m = nxt.count()
        reach.unpersist()
        reach = nxt
        if m == n:
            break
        n = m
    if include_start:
        nodes = edges.select("x").union(edges.select("y")).distinct()
        reach = reach.unionByName(nodes.select("x", F.col("x").alias("y"))).distinct()
    return reach


class Sparql:
    def __init__(self, graph: DataFrame):
        self.graph = graph.select("s", "p", "o")

    # ---- entry points ----------------------------------------------------------------

    def query(self, text: str) -> DataFrame:
        """SELECT, ASK (one row ``ask``) or CONSTRUCT (triples)."""
        p = Parser(text)
        p.prologue()
        word = p.word()
        if word == "SELECT":
            return self.select(p)
        if word == "ASK":
            p.take()
            found = self.group(p)
            return found.limit(1).agg((F.count("*") > 0).alias("ask"))
        if word == "CONSTRUCT":
            p.take()
            template = p.template()
            p.take_word("WHERE")
            found = self.group(p)
            parts = [found.select(*(self.made(t).alias(c) for t, c in zip(tr, "spo", strict=True))) for tr in template]
            out = parts[0]
            for x in parts[1:]:
                out = out.unionByName(x)
            return out.dropna().distinct()
        raise SparqlError(f"unknown form {word}")

    def update(self, text: str) -> DataFrame:
        """The graph after INSERT DATA, DELETE DATA, DELETE WHERE, or DELETE/INSERT ... WHERE."""
        p = Parser(text)
        p.prologue()
        gone: list = []
        new: list = []
        where = None
        form = p.word()
        if form in ("INSERT", "DELETE"):
            p.take()
            if p.word() == "DATA":
                p.take()
                rows = self.graph.sparkSession.createDataFrame([tuple(map(str, t)) for t in p.template()], "s string, p string, o string")
                return self.graph.unionByName(rows).distinct() if form == "INSERT" else self.graph.join(rows, ["s", "p", "o"], "left_anti")
            if form == "DELETE" and p.word() == "WHERE":
                p.take()
                at = p.at
                gone = p.template()
                p.at = at
                where = self.group(p)
            else:
                (gone if form == "DELETE" else new).extend(p.template())
                if p.word() == "INSERT":
                    p.take()
                    new.extend(p.template())
                p.take_word("WHERE")
                where = self.group(p)
        if where is None:
            raise SparqlError("an update is wanted")
        build = lambda ts: [where.select(*(self.made(t).alias(c) for t, c in zip(tr, "spo", strict=True))).dropna() for tr in ts]
        out = self.graph
        for rows in build(gone):
            out = out.join(rows, ["s", "p", "o"], "left_anti")
        for rows in build(new):
            out = out.unionByName(rows)
        return out.distinct() if new else out

    def made(self, term: Term) -> Column:
        return F.col(f"`{term.name}`") if isinstance(term, Var) else F.lit(term)

    # ---- patterns -----------------------------------------------------------------------

    def unit(self) -> DataFrame:
        return self.graph.sparkSession.range(1).select()

    def path(self, path: Path | str) -> DataFrame:
        """(x, y) pairs of a predicate path."""
        if isinstance(path, str):
            return self.graph.filter(F.col("p") == path).select(F.col("s").alias("x"), F.col("o").alias("y"))
        made = [self.path(q) for q in path.parts]
        if path.kind == "inverse":
            return made[0].select(F.col("y").alias("x"), F.col("x").alias("y"))
        if path.kind == "seq":
            out = made[0]
            for b in made[1:]:
                out = out.alias("a").join(b.alias("b"), F.col("a.y") == F.col("b.x")).select(F.col("a.x").alias("x"), F.col("b.y").alias("y"))
            return out
        if path.kind == "alt":
            out = made[0]
            for b in made[1:]:
                out = out.unionByName(b)
            return out
        return closure(made[0], path.kind == "star")

    def triple(self, s: Term, p: Term | Path, o: Term) -> DataFrame:
        if isinstance(p, Path):
            rows = self.path(p)
            named = [(s, "x"), (o, "y")]
        else:
            rows = self.graph
            named = [(s, "s"), (p, "p"), (o, "o")]
        seen: dict[str, str] = {}
        columns = []
        for term, c in named:
            if isinstance(term, Var):
                if term.name in seen:
                    rows = rows.filter(F.col(c) == F.col(seen[term.name]))
                else:
                    seen[term.name] = c
                    columns.append(F.col(c).alias(term.name))
            else:
                rows = rows.filter(F.col(c) == term)
        return rows.select(*columns)

    def joined(self, a: DataFrame | None, b: DataFrame, how: str = "inner") -> DataFrame:
        if a is None:
            return b
        shared = [c for c in a.columns if c in b.columns]
        if shared:
            return a.join(b, shared, how)
        if how == "inner":
            return a.crossJoin(b)
        return a.join(b, F.lit(True), how)

    def group(self, p: Parser) -> DataFrame:
        """A braced group; filters hold for the whole group."""
        p.take("{")
        out: DataFrame | None = None
        filters: list = []
        while p.peek()[1] != "}":
            word = p.word()
            if p.peek()[1] == ".":
                p.take()
            elif word == "FILTER":
                p.take()
                if p.word() == "EXISTS" or p.word() == "NOT":
                    negated = p.word() == "NOT"
                    p.take()
                    if negated:
                        p.take_word("EXISTS")
                    filters.append(("anti" if negated else "semi", self.group(p)))
                else:
                    filters.append(("filter", p.expression()))
            elif word == "OPTIONAL":
                p.take()
                out = self.joined(out if out is not None else self.unit(), self.group(p), "left")
            elif word == "BIND":
                p.take()
                p.take("(")
                e = p.expression()
                p.take_word("AS")
                name = p.take()[1][1:]
                p.take(")")
                out = (out if out is not None else self.unit())
                out = out.withColumn(name, self.text(e, out.columns))
            elif word == "VALUES":
                p.take()
                name = p.take()[1][1:]
                p.take("{")
                items = []
                while p.peek()[1] != "}":
                    items.append((p.term(),))
                p.take("}")
                out = self.joined(out, self.graph.sparkSession.createDataFrame(items, f"`{name}` string"))
            elif p.peek()[1] == "{":
                at = p.at
                p.take()
                if p.word() == "SELECT":
                    inner = self.select(p)
                    p.take("}")
                else:
                    p.at = at
                    inner = self.group(p)
                while p.word() == "UNION":
                    p.take()
                    inner = inner.unionByName(self.group(p), allowMissingColumns=True)
                out = self.joined(out, inner)
            else:
                for s, q, o in p.same_subject():
                    out = self.joined(out, self.triple(s, q, o))
        p.take("}")
        out = out if out is not None else self.unit()
        for kind, x in filters:
            if kind == "filter":
                out = out.filter(self.truth(x, out.columns))
            else:
                shared = [c for c in out.columns if c in x.columns]
                out = out.join(x, shared or F.lit(True), f"left_{kind}")
        return out

    # ---- SELECT --------------------------------------------------------------------------

    def select(self, p: Parser) -> DataFrame:
        p.take_word("SELECT")
        distinct = p.word() == "DISTINCT"
        if distinct:
            p.take()
        items: list[tuple] = []
        while p.word() != "WHERE" and p.peek()[1] != "{":
            if p.peek()[1] == ",":
                p.take()
            elif p.peek()[1] == "*":
                p.take()
                items = [("*",)]
            else:
                wrapped = p.peek()[1] == "("
                at = p.at
                if wrapped:
                    p.take()
                e = p.expression()
                name = e[1] if e[0] == "var" else None
                if wrapped and p.peek()[1] == ")" and p.toks[p.at + 1 : p.at + 2] and p.toks[p.at + 1][1].upper() == "AS":
                    p.take(")")
                    wrapped = False
                if p.word() == "AS":
                    p.take()
                    name = p.take()[1][1:]
                if wrapped:
                    p.take(")")
                items.append((name or f"c{at}", e))
        if p.word() == "WHERE":
            p.take()
        found = self.group(p)
        by: list = []
        order: list = []
        limit = offset = None
        while p.word() in ("GROUP", "ORDER", "LIMIT", "OFFSET", "HAVING"):
            word = p.take()[1].upper()
            if word == "GROUP":
                p.take_word("BY")
                while p.peek()[0] == "var":
                    by.append(p.take()[1][1:])
            elif word == "ORDER":
                p.take_word("BY")
                while p.peek()[0] == "var" or p.word() in ("ASC", "DESC"):
                    down = False
                    if p.word() in ("ASC", "DESC"):
                        down = p.take()[1].upper() == "DESC"
                        p.take("(")
                        e = p.expression()
                        p.take(")")
                    else:
                        e = p.expression()
                    order.append((e, down))
                    if p.peek()[1] == ",":
                        p.take()
            elif word == "LIMIT":
                limit = int(p.take()[1])
            else:
                offset = int(p.take()[1])
        if items == [("*",)]:
            items = [(c, ("var", c)) for c in found.columns]
        if by or any(has_aggregate(e) for _, e in items):
            out = found.groupBy(*by).agg(*(self.text(e, found.columns).alias(f"__{i}") for i, (_, e) in enumerate(items)))
            out = out.select(*(F.col(f"__{i}").alias(n) for i, (n, _) in enumerate(items)))
        else:
            keep = [c for c in found.columns if order and c not in {n for n, _ in items}] if not distinct else []
            out = found.select(*(self.text(e, found.columns).alias(n) for n, e in items), *keep)
        if distinct:
            out = out.distinct()
        if order:
            keys = []
            for e, down in order:
                c = self.text(e, out.columns)
                number = c.try_cast("double")
                keys += [number.desc() if down else number.asc(), c.desc() if down else c.asc()]
            out = out.orderBy(*keys)
        if offset:
            out = out.offset(offset)
        if limit is not None:
            out = out.limit(limit)
        return out.select(*(n for n, _ in items))

    # ---- expressions -----------------------------------------------------------------------

    def text(self, e: tuple, columns: list[str]) -> Column:
        kind = e[0]
        if kind == "var":
            return F.col(f"`{e[1]}`") if e[1] in columns else F.lit(None).cast("string")
        if kind == "lit":
            return F.lit(e[1])
        if kind == "num":
            return F.lit(e[1])
        if kind == "call":
            return self.call(e[1], e[2], columns)
        if kind in ("+", "-", "*", "/"):
            a, b = (self.number(x, columns) for x in e[1:])
            value = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[kind]
            return spelled(value)
        return F.when(self.truth(e, columns), "true").otherwise("false")

    def number(self, e: tuple, columns: list[str]) -> Column:
        return self.text(e, columns).try_cast("double")

    def truth(self, e: tuple, columns: list[str]) -> Column:
        kind = e[0]
        if kind == "and":
            return self.truth(e[1], columns) & self.truth(e[2], columns)
        if kind == "or":
            return self.truth(e[1], columns) | self.truth(e[2], columns)
        if kind == "not":
            return ~self.truth(e[1], columns)
        if kind in ("=", "!=", "<", "<=", ">", ">="):
            a, b = self.text(e[1], columns), self.text(e[2], columns)
            x, y = a.try_cast("double"), b.try_cast("double")
            both = x.isNotNull() & y.isNotNull()
            ops = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}
            return F.when(both, ops[kind](x, y)).otherwise(ops[kind](a.cast("string"), b.cast("string")))
        if kind == "call" and e[1] in ("BOUND", "REGEX", "CONTAINS", "STRSTARTS", "STRENDS"):
            return self.call(e[1], e[2], columns, True)
        return self.text(e, columns) == "true"

    def call(self, name: str, args: list, columns: list[str], as_truth: bool = False) -> Column:
        t = lambda i: self.text(args[i], columns)
        if name == "COUNT":
            if args and args[0] == ("star",):
                return F.count("*").cast("string")
            if args and args[0][0] == "distinct":
                return F.count_distinct(self.text(args[0][1], columns)).cast("string")
            return F.count(t(0)).cast("string")
        if name in ("SUM", "AVG"):
            return spelled({"SUM": F.sum, "AVG": F.avg}[name](self.number(args[0], columns)))
        if name in ("MIN", "MAX"):
            f = {"MIN": F.min, "MAX": F.max}[name]
            number = f(self.number(args[0], columns))
            return F.when(F.count(self.number(args[0], columns)) == F.count(t(0)), spelled(number)).otherwise(f(t(0)))
        if name == "GROUP_CONCAT":
            sep = args[1][1] if len(args) > 1 else " "
            return F.array_join(F.array_sort(F.collect_list(t(0))), sep)
        if name == "BOUND":
            found = t(0).isNotNull()
        elif name == "REGEX":
            flags = args[2][1] if len(args) > 2 else ""
            found = F.regexp_like(t(0), F.concat(F.lit("(?i)" if "i" in flags else ""), t(1)))
        elif name == "CONTAINS":
            found = F.contains(t(0), t(1))
        elif name == "STRSTARTS":
            found = F.startswith(t(0), t(1))
        elif name == "STRENDS":
            found = F.endswith(t(0), t(1))
        elif name in ("STR", "IRI", "URI"):
            return t(0).cast("string")
        elif name == "CONCAT":
            return F.concat(*(self.text(a, columns).cast("string") for a in args))
        elif name == "STRLEN":
            return F.char_length(t(0)).cast("string")
        elif name == "UCASE":
            return F.upper(t(0))
        elif name == "LCASE":
            return F.lower(t(0))
        elif name == "COALESCE":
            return F.coalesce(*(self.text(a, columns).cast("string") for a in args))
        elif name == "IF":
            return F.when(self.truth(args[0], columns), t(1).cast("string")).otherwise(t(2).cast("string"))
        else:
            raise SparqlError(f"unknown function {name}")
        return found if as_truth else F.when(found, "true").otherwise("false")


def spelled(value: Column) -> Column:
    """A number as text: whole ones without a point."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "GROUP_CONCAT"}


def has_aggregate(e) -> bool:
    if not isinstance(e, tuple):
        return False
    if e[0] == "call":
        return e[1] in AGGREGATES or any(has_aggregate(a) for a in e[2])
    return any(has_aggregate(x) for x in e[1:])


class Parser:
    def __init__(self, text: str):
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise SparqlError(f"unreadable at {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                self.toks.append((m.lastgroup, m[0]))
        self.at, self.prefixes, self.base = 0, {}, ""

    def peek(self) -> tuple[str, str]:
        return self.toks[self.at] if self.at < len(self.toks) else ("end", "")

    def word(self) -> str:
        return self.peek()[1].upper() if self.peek()[0] == "word" else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if want is not None and t[1] != want:
            raise SparqlError(f"{want} is wanted, not {t[1]!r}")
        self.at += 1
        return t

    def take_word(self, want: str) -> None:
        if self.word() != want:
            raise SparqlError(f"{want} is wanted, not {self.peek()[1]!r}")
        self.at += 1

    def prologue(self) -> None:
        while self.word() in ("PREFIX", "BASE"):
            if self.take()[1].upper() == "PREFIX":
                name = self.take()[1].rstrip(":")
                self.prefixes[name] = self.take()[1][1:-1]
            else:
                self.base = self.take()[1][1:-1]

    def term(self) -> Term:
        kind, t = self.take()
        if kind == "var":
            return Var(t[1:])
        if kind == "iri":
            return self.base + t[1:-1] if self.base and ":" not in t else t[1:-1]
        if kind == "name":
            prefix, _, local = t.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + local
        if kind == "str":
            if self.peek()[0] == "lang":
                self.take()
            elif self.peek()[1] == "^^":
                self.take()
                self.term()
            return unescape(t[1:-1])
        if kind == "num" or t in ("true", "false"):
            return t
        if kind == "word" and t == "a":
            return RDF_TYPE
        raise SparqlError(f"a term is wanted, not {t!r}")

    def path(self) -> Term | Path:
        parts = [self.path_sequence()]
        while self.peek()[1] == "|":
            self.take()
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else Path("alt", tuple(parts))

    def path_sequence(self):
        parts = [self.path_step()]
        while self.peek()[1] == "/":
            self.take()
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else Path("seq", tuple(parts))

    def path_step(self):
        if self.peek()[1] == "^":
            self.take()
            return Path("inverse", (self.path_step(),))
        if self.peek()[1] == "(":
            self.take()
            one = self.path()
            self.take(")")
        else:
            one = self.term()
        if self.peek()[1] in ("*", "+"):
            return Path("star" if self.take()[1] == "*" else "plus", (one,))
        return one

    def same_subject(self) -> list[tuple]:
        out = []
        s = self.term()
        while True:
            p = self.path()
            while True:
                out.append((s, p, self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return out
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "}"):
                return out

    def template(self) -> list[tuple]:
        self.take("{")
        out = []
        while self.peek()[1] != "}":
            if self.peek()[1] == ".":
                self.take()
            else:
                out += self.same_subject()
        self.take("}")
        return out

    # expressions: or > and > comparison > sum > product > unary
    def expression(self) -> tuple:
        e = self.conjunction()
        while self.peek()[1] == "||":
            self.take()
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self) -> tuple:
        e = self.comparison()
        while self.peek()[1] == "&&":
            self.take()
            e = ("and", e, self.comparison())
        return e

    def comparison(self) -> tuple:
        e = self.sum()
        if self.peek()[1] in ("=", "!=", "<", "<=", ">", ">="):
            return (self.take()[1], e, self.sum())
        return e

    def sum(self) -> tuple:
        e = self.product()
        while self.peek()[1] in ("+", "-"):
            e = (self.take()[1], e, self.product())
        return e

    def product(self) -> tuple:
        e = self.unary()
        while self.peek()[1] in ("*", "/"):
            e = (self.take()[1], e, self.unary())
        return e

    def unary(self) -> tuple:
        kind, t = self.peek()
        if t == "!":
            self.take()
            return ("not", self.unary())
        if t == "-":
            self.take()
            return ("-", ("num", "0"), self.unary())
        if t == "(":
            self.take()
            e = self.expression()
            self.take(")")
            return e
        if kind == "word" and self.toks[self.at + 1 : self.at + 2] and self.toks[self.at + 1][1] == "(":
            name = self.take()[1].upper()
            self.take()
            args: list = []
            while self.peek()[1] != ")":
                if self.peek()[1] in (",", ";"):
                    self.take()
                elif self.word() == "SEPARATOR":
                    self.take()
                    self.take("=")
                elif self.word() == "DISTINCT":
                    self.take()
                    args.append(("distinct", self.expression()))
                elif self.peek()[1] == "*":
                    self.take()
                    args.append(("star",))
                else:
                    args.append(self.expression())
            self.take(")")
            return ("call", name, args)
        x = self.term()
        if isinstance(x, Var):
            return ("var", x.name)
        return ("num", x) if kind == "num" else ("lit", x)


def sparql(graph: DataFrame, text: str) -> DataFrame:
    return Sparql(graph).query(text)

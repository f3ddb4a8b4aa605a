"""Turtle text -> (s, p, o) triples of plain strings.

Datatypes and language tags are dropped, prefixes and the base are resolved, blank nodes get
names; ``load_turtle`` reads files by tasks, a whole file each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
SCHEMA = "s string, p string, o string"

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
      |(?P<iri><[^<>\s]*>)
      |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
      |(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
      |(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
      |(?P<blank>_:[\w.-]*\w)
      |(?P<name>[A-Za-z_][\w-]*(?:\.[\w-]+)*:[\w%-]*(?:[.:][\w%-]+)*|:[\w%-]*(?:[.:][\w%-]+)*)
      |(?P<word>[A-Za-z]+)
      |(?P<op>\^\^|[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


class TurtleError(ValueError):
    """The text isn't Turtle."""


def unescape(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), s)


class Turtle:
    """A reader of one text; ``triples`` yields (s, p, o)."""

    def __init__(self, text: str, base: str = ""):
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise TurtleError(f"unreadable at {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                self.toks.append((m.lastgroup, m[0]))
        self.at, self.base, self.prefixes, self.blanks = 0, base, {}, 0
        self.out: list[tuple[str, str, str]] = []

    def peek(self) -> tuple[str, str]:
        return self.toks[self.at] if self.at < len(self.toks) else ("end", "")

    def take(self, want: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if want is not None and t[1] != want:
            raise TurtleError(f"{want} is wanted, not {t[1]!r}")
        self.at += 1
        return t

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:b{self.blanks}"

    def iri(self, text: str) -> str:
        inner = unescape(text[1:-1])
        return urljoin(self.base, inner) if self.base and ":" not in inner.split("/")[0] else inner

    def triples(self) -> list[tuple[str, str, str]]:
        while self.peek()[0] != "end":
            kind, t = self.peek()
            if t.lower() in ("@prefix", "prefix"):
                self.take()
                name = self.take()[1]
                self.prefixes[name.rstrip(":")] = self.iri(self.take()[1])
                if t[0] == "@":
                    self.take(".")
            elif t.lower() in ("@base", "base"):
                self.take()
                self.base = self.iri(self.take()[1])
                if t[0] == "@":
                    self.take(".")
            else:
                lone = t == "["
                subject = self.term()
                if not (lone and self.peek()[1] == "."):
                    self.properties(subject)
                self.take(".")
        return self.out

    def properties(self, subject: str) -> None:
        while True:
            kind, t = self.peek()
            if kind == "word" and t == "a":
                self.take()
                verb = RDF_TYPE
            else:
                verb = self.term()
            while True:
                self.out.append((subject, verb, self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]", ""):
                return

    def term(self) -> str:
        kind, t = self.take()
        if kind == "iri":
            return self.iri(t)
        if kind == "name":
            prefix, _, local = t.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + local
        if kind == "blank":
            return t
        if kind in ("str", "long"):
            n = 3 if kind == "long" else 1
            if self.peek()[0] == "at":
                self.take()
            elif self.peek()[1] == "^^":
                self.take()
                self.term()
            return unescape(t[n:-n])
        if kind == "num" or kind == "word" and t in ("true", "false"):
            return t
        if t == "[":
            node = self.fresh()
            if self.peek()[1] != "]":
                self.properties(node)
            self.take("]")
            return node
        if t == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            rest = RDF + "nil"
            for x in reversed(items):
                node = self.fresh()
                self.out += [(node, RDF + "first", x), (node, RDF + "rest", rest)]
                rest = node
            return rest
        raise TurtleError(f"a term is wanted, not {t!r}")


def parse_turtle(text: str, base: str = "") -> list[tuple[str, str, str]]:
    return Turtle(text, base).triples()


def load_turtle(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Distinct triples of Turtle files.  Blank nodes are named apart by file."""

    def read(batches) -> Iterator:
        import hashlib

        import pyarrow as pa

        for b in batches:
            for name, text in zip(b.column("name").to_pylist(), b.column("value").to_pylist(), strict=True):
                mark = "_:" + hashlib.md5(name.encode()).hexdigest()[:8]
                own = lambda x, mark=mark: mark + x[2:] if x.startswith("_:") else x
                rows = [(own(s), p, own(o)) for s, p, o in parse_turtle(text, base)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["s", "p", "o"])

    from pyspark.sql import functions as F

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value")
    return files.mapInArrow(read, SCHEMA).distinct()


def insert_triples(graph: DataFrame, more: DataFrame) -> DataFrame:
    return graph.unionByName(more).distinct()


def delete_triples(graph: DataFrame, gone: DataFrame) -> DataFrame:
    return graph.join(gone, ["s", "p", "o"], "left_anti")

import lzma

import pytest
from pyspark.sql import functions as F

from lakeweft.rdf import turtle
from lakeweft.rdf.sparql import Sparql, SparqlError
from lakeweft.sources import text as sources
from lakeweft.streaming import event_windows
from lakeweft.streaming.incremental import IncrementalGroups

TTL = """@prefix ex: <http://e.org/> .
@base <http://b.org/x/> .
# a comment
ex:a a ex:Person ; ex:name "Ann"@en, 'A "n" n' ; ex:age 42 ; ex:knows [ ex:name "Bob" ] .
<rel> ex:list ( 1 "two" ) .
_:n ex:note \"\"\"long
text\"\"\" ; ex:kind "5"^^ex:int .
"""


def test_turtle(spark, tmp_path):
    rows = turtle.parse_turtle(TTL)
    assert ("http://e.org/a", turtle.RDF_TYPE, "http://e.org/Person") in rows
    assert ("http://e.org/a", "http://e.org/name", 'A "n" n') in rows
    assert ("_:n", "http://e.org/note", "long\ntext") in rows and ("_:n", "http://e.org/kind", "5") in rows
    assert any(s == "http://b.org/x/rel" for s, _, _ in rows)
    assert sum(p.endswith("#first") for _, p, _ in rows) == 2
    (tmp_path / "g.ttl").write_text(TTL)
    graph = turtle.load_turtle(spark, f"file://{tmp_path}/g.ttl")
    assert graph.count() == len(set(rows))
    got = Sparql(graph).query("PREFIX ex: <http://e.org/> SELECT ?n WHERE { ex:a ex:knows/ex:name ?n }").collect()
    assert [r["n"] for r in got] == ["Bob"]
    assert turtle.delete_triples(graph, graph.limit(2)).count() == graph.count() - 2
    with pytest.raises(turtle.TurtleError):
        turtle.parse_turtle("ex:a ex:b ex:c .")
    with pytest.raises(SparqlError):
        Sparql(graph).query("SELECT ?x WHERE { ?x")


def test_closure_of_a_cycle(spark):
    graph = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("x", "p", "a")], "s string, p string, o string")
    got = {(r["x"], r["y"]) for r in Sparql(graph).query("SELECT ?x, ?y WHERE { ?x <p>+ ?y }").collect()}
    assert got == {(x, y) for x in "abcx" for y in "abc"}
    star = {r["y"] for r in Sparql(graph).query("SELECT ?y WHERE { <x> <p>* ?y }").collect()}
    assert star == {"x", "a", "b", "c"}


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('#table one\n{"id": 1, "v": "x"}\n# note\n#table two\n{"id": 2.5}\n#table one\n{"id": 3, "v": null}\n')
    path = f"file://{tmp_path}/a.jsonl"
    assert sources.json_line_tables(spark, path) == ["one", "two"]
    assert sorted(map(tuple, sources.load_json_lines(spark, path, "one").collect())) == [(1, "x"), (3, None)]
    assert sources.load_json_lines(spark, path, "two").first()["id"] == 2.5


def test_csv_keeps_quotes_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;name;pay\n1;"x";2.5\n2;y;\n')
    got = sources.typed(sources.load_csv(spark, f"file://{tmp_path}/a.csv"))
    assert got.dtypes == [("id", "bigint"), ("name", "string"), ("pay", "double")]
    assert sorted(map(tuple, got.collect())) == [(1, '"x"', 2.5), (2, "y", None)]


def test_compressed_streams(spark, tmp_path):
    assert sources.zcat_bytes(sources.gzip_bytes(b"abc")) == b"abc"
    assert sources.xzcat_bytes(sources.xz_bytes(b"abc")) == b"abc"
    (tmp_path / "a.xz").write_bytes(lzma.compress(b"one\ntwo\n"))
    (tmp_path / "a.gz").write_bytes(sources.gzip_bytes(b"one\ntwo\n"))
    assert sorted(r[0] for r in sources.load_xz(spark, f"file://{tmp_path}/a.xz").collect()) == ["one", "two"]
    assert sources.load(spark, f"file://{tmp_path}/a.gz").count() == 2
    assert sources.stream_string(spark, "a\nb").count() == 2


def test_dump_copy_escapes(spark):
    text = "CREATE TABLE t (a integer, b text, c numeric(8,2));\nCOPY t (a, b, c) FROM stdin;\n1\tx\\ty\t2.5\n\\N\t\\N\t3\n\\.\nINSERT INTO t VALUES (9, 'q', 1);\n"
    tables, copies, inserts = sources.parse_dump(text)
    assert tables["t"] == [("a", "bigint"), ("b", "string"), ("c", "double")] and len(inserts) == 1
    assert sorted(map(tuple, sources.load_dump(spark, text)["t"].collect()), key=str) == [(1, "x\ty", 2.5), (None, None, 3.0)]


def test_incremental_groups_follow_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double").write.parquet(f"{tmp_path}/in/1")
    g = IncrementalGroups(spark, f"file://{tmp_path}/state", ["k"], ["v"])
    stream = spark.readStream.schema("k string, v double").parquet(f"{tmp_path}/in/*")
    g.follow(stream, f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([("a", 5.0), ("c", 2.0)], "k string, v double").write.parquet(f"{tmp_path}/in/2")
    g.follow(spark.readStream.schema("k string, v double").parquet(f"{tmp_path}/in/*"), f"{tmp_path}/cp").awaitTermination()
    got = {r["k"]: (r["n_rows"], r["n_v"], r["sum_v"], r["avg_v"], r["max_v"]) for r in g.groups().collect()}
    assert got == {"a": (3, 3, 9.0, 3.0, 5.0), "b": (1, 0, None, None, None), "c": (1, 1, 2.0, 2.0, 2.0)}
    g.merge(spark.createDataFrame([("c", 2.0, -1)], "k string, v double, change int"), 99)
    assert "c" not in {r["k"] for r in g.groups().collect()}


def test_sessions_match_gaps_and_islands(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    a = event_windows.sessions(e, "ts", "20 minutes", ["user_id"]).count()
    b = event_windows.gaps_and_islands(e, "ts", 20 * 60, ["user_id"]).select("user_id", "session").distinct().count()
    assert abs(a - b) <= 2


def test_watch_reads_new_files(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.txt").write_text("x\ny\n")
    got = event_windows.drain(event_windows.watch(spark, f"file://{tmp_path}/w"), "watched")
    assert got.filter(F.col("value") == "x").count() == 1

import pytest

from lakeweft.engine import Engine
from lakeweft.operators.dml import ConstraintError
from lakeweft.plans.dialect import DialectError


@pytest.fixture
def e(spark, tmp_path):
    return Engine(spark, None, warehouse=f"file://{tmp_path}")


def rows(e, sql):
    return [tuple(r) for r in e.sql(sql).collect()]


def test_mysql_statements(e):
    e.sql("CREATE TABLE `items` (id INT AUTO_INCREMENT PRIMARY KEY, name VARCHAR(20) NOT NULL, qty INT DEFAULT 1, price DECIMAL(8,2), UNIQUE KEY un (name)) ENGINE=InnoDB")
    assert e.sql("INSERT INTO items (name, price) VALUES ('a', 1.5), ('b', 2 + 1), ('c', NULL)").first()[0] == 3
    assert rows(e, "SELECT id, name, qty, price FROM items ORDER BY id") == [(1, "a", 1, 1.5), (2, "b", 1, 3.0), (3, "c", 1, None)]
    e.sql("INSERT INTO items SET name = 'd', qty = 7")
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO items (name) VALUES ('a')")
    assert e.sql("INSERT IGNORE INTO items (id, name) VALUES (1, 'z'), (9, 'i')").first()[0] == 1
    e.sql("INSERT INTO items (id, name, qty) VALUES (2, 'b', 5) ON DUPLICATE KEY UPDATE qty = qty + VALUES(qty)")
    assert rows(e, "SELECT qty FROM items WHERE id = 2") == [(6,)]
    assert e.sql("UPDATE items SET price = COALESCE(price, 0) + 1 WHERE name LIKE 'C' OR id = ?", [1]).first()[0] == 2
    assert e.sql("UPDATE items SET qty = 100 ORDER BY id DESC LIMIT 1").first()[0] == 1
    assert rows(e, "SELECT name FROM items WHERE qty = 100") == [("i",)]
    e.sql("INSERT INTO items (name, qty) SELECT CONCAT(name, '2'), qty FROM items WHERE id <= 2")
    assert e.sql("DELETE FROM items WHERE id IN (SELECT id FROM items WHERE qty > 50)").first()[0] == 1
    e.sql("REPLACE INTO items (id, name, qty, price) VALUES (1, 'aa', 0, 0)")
    assert rows(e, "SELECT name FROM items WHERE id = 1") == [("aa",)]
    e.sql("ALTER TABLE items ADD COLUMN note TEXT DEFAULT 'n', DROP COLUMN price, CHANGE qty amount BIGINT")
    assert e.sql("SELECT * FROM items").columns == ["id", "name", "amount", "note"]
    assert {r[0]: r[3] for r in rows(e, "DESCRIBE items")}["id"] == "PRI"
    e.sql("TRUNCATE TABLE items")
    assert rows(e, "SELECT COUNT(*) FROM items") == [(0,)]
    e.sql("DROP TABLE items")
    e.sql("DROP TABLE IF EXISTS items")
    with pytest.raises(DialectError):
        e.sql("INSERT INTO items VALUES (1)")


def test_foreign_keys(e):
    e.sql("CREATE TABLE p (id INT PRIMARY KEY, v INT)")
    e.sql("CREATE TABLE c (id INT PRIMARY KEY, pid INT, FOREIGN KEY (pid) REFERENCES p (id) ON DELETE SET NULL)")
    e.sql("INSERT INTO p VALUES (1, 1), (2, 2)")
    e.sql("INSERT INTO c VALUES (1, 1), (2, 2), (3, NULL)")
    e.sql("DELETE FROM p WHERE v = 1")
    assert rows(e, "SELECT id, pid FROM c ORDER BY id") == [(1, None), (2, 2), (3, None)]
    assert rows(e, "SELECT table_name, referenced_table_name FROM information_schema.referential_constraints") == [("c", "p")]
    e.sql("CREATE UNIQUE INDEX uv ON p (v)")
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO p VALUES (5, 2)")
    e.sql("RENAME TABLE p TO q")
    assert rows(e, "SELECT COUNT(*) FROM q") == [(1,)]


def test_psql_upsert(spark, tmp_path):
    e = Engine(spark, None, "psql", warehouse=f"file://{tmp_path}")
    e.sql("CREATE TABLE kv (k TEXT PRIMARY KEY, n INTEGER)")
    e.sql("INSERT INTO kv (k, n) VALUES ('a', 1), ('b', 2)")
    e.sql("INSERT INTO kv (k, n) VALUES ('a', 10), ('c', 3) ON CONFLICT (k) DO UPDATE SET n = kv.n + EXCLUDED.n" .replace("kv.n", "n"))
    e.sql("INSERT INTO kv (k, n) VALUES ('b', 99) ON CONFLICT DO NOTHING")
    assert rows(e, "SELECT k, n FROM kv ORDER BY k") == [("a", 11), ("b", 2), ("c", 3)]
    e.sql("CREATE TABLE gone (k TEXT PRIMARY KEY)")
    e.sql("INSERT INTO gone VALUES ('a')")
    e.sql("DELETE FROM kv USING gone WHERE kv.k = gone.k")
    assert rows(e, "SELECT k FROM kv ORDER BY k") == [("b",), ("c",)]


def test_sparql_over_a_catalog_table(e, spark):
    e.catalog.add("rdf", e.spark.createDataFrame([("a", "p", "b")], "s string, p string, o string"))
    assert [r["o"] for r in e.sparql("SELECT ?o WHERE { <a> <p> ?o }").collect()] == ["b"]


def test_http_front_and_dump_replay(e, spark):
    import http.client
    import threading

    from lakeweft.functions.registry import register_python
    from lakeweft.sources import server

    dump = "-- a dump\nCREATE TABLE public.t (id integer NOT NULL, note text);\nINSERT INTO public.t VALUES (1, 'semi;colon');\nCOPY public.t (id, note) FROM stdin;\n2\t\\N\n\\.\nSET x = 1;\n"
    psql = Engine(spark, None, "psql", warehouse=e.warehouse + "/dump")
    assert server.replay(psql, dump) == 3
    psql.catalog.add("rdf", psql.spark.createDataFrame([("a", "p", "b")], "s string, p string, o string"))

    def twice(x):
        return x * 2

    register_python(psql.spark, "twice", twice, "bigint")
    front = server.serve({("psql", "d"): psql, ("rdf", "d"): psql})
    threading.Thread(target=front.serve_forever, daemon=True).start()

    def post(path, body):
        c = http.client.HTTPConnection("127.0.0.1", front.server_port)
        c.request("POST", path, body)
        r = c.getresponse()
        return r.status, r.read().decode()

    assert post("/psql/d", "SELECT id, note, twice(id) AS w FROM t ORDER BY id") == (200, '{"id":1,"note":"semi;colon","w":2}\n{"id":2,"note":null,"w":4}\n')
    assert post("/rdf/d", "SELECT ?o WHERE { <a> <p> ?o }") == (200, '{"o":"b"}\n')
    assert post("/psql/d", "SELECT nothing FROM nowhere")[0] == 400 and post("/sql/x", "SELECT 1")[0] == 404
    front.shutdown()


def test_triggers_as_text(e):
    e.sql("CREATE TABLE acc (id INT PRIMARY KEY, bal INT, kind TEXT)")
    e.sql("CREATE TABLE log (id INT, what TEXT, was INT, now INT)")
    e.sql("CREATE TABLE total (kind TEXT PRIMARY KEY, n INT)")
    e.sql("INSERT INTO total VALUES ('neg', 0), ('pos', 0)")
    e.sql("CREATE TRIGGER t1 BEFORE INSERT ON acc FOR EACH ROW BEGIN IF NEW.bal < 0 THEN SET NEW.kind = 'neg'; ELSE SET NEW.kind = 'pos'; END IF; SET NEW.bal = NEW.bal + 1; END")
    e.sql("CREATE TRIGGER t2 AFTER INSERT ON acc FOR EACH ROW INSERT INTO log (id, what, now) VALUES (NEW.id, CONCAT('in ', NEW.kind), NEW.bal)")
    e.sql("CREATE TRIGGER t3 AFTER UPDATE ON acc FOR EACH ROW BEGIN INSERT INTO log VALUES (NEW.id, 'up', OLD.bal, NEW.bal); UPDATE total SET n = NEW.bal WHERE kind = NEW.kind; END")
    e.sql("CREATE TRIGGER t4 AFTER DELETE ON acc FOR EACH ROW DELETE FROM log WHERE id = OLD.id")
    e.sql("INSERT INTO acc (id, bal) VALUES (1, 5), (2, -5)")
    assert rows(e, "SELECT id, bal, kind FROM acc ORDER BY id") == [(1, 6, "pos"), (2, -4, "neg")]
    e.sql("UPDATE acc SET bal = bal * 10 WHERE id = 2")
    assert rows(e, "SELECT what, was, now FROM log ORDER BY what") == [("in neg", None, -4), ("in pos", None, 6), ("up", -4, -40)]
    assert rows(e, "SELECT n FROM total WHERE kind = 'neg'") == [(-40,)]
    e.sql("DELETE FROM acc WHERE id = 2")
    assert rows(e, "SELECT id FROM log") == [(1,)]
    e.sql("DROP TRIGGER t2")
    e.sql("INSERT INTO acc (id, bal) VALUES (3, 0)")
    assert rows(e, "SELECT COUNT(*) FROM log") == [(1,)]

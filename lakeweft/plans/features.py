"""Registered queries: functions, text search, JSON, vectors, RDF, ingestion, DML, streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweft.engine import Engine
from lakeweft.functions.registry import fold, register, register_aggregate
from lakeweft.operators import vectors
from lakeweft.operators.dml import WritableTable
from lakeweft.plans.kit import Query, engine_for, table, text
from lakeweft.rdf.sparql import Sparql, closure
from lakeweft.sources import text as sources
from lakeweft.streaming import event_windows
from lakeweft.streaming.incremental import IncrementalGroups

TEXTS: dict[str, tuple[str, str | None]] = {
    # predicates
    "between_not_between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 950 AND 1000", None),
    "in_list_three_valued": ("SELECT n_nationkey, n_nationkey IN (1, 2, NULL) AS a, n_nationkey NOT IN (3, 4) AS b FROM nation", None),
    "case_simple_searched": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS s, CASE WHEN o_totalprice > 400000 THEN 'big' WHEN o_totalprice > 200000 THEN 'mid' ELSE 'small' END AS size FROM orders", None),
    "if_ifnull_isnull": ("SELECT n_nationkey, IF(n_nationkey > 10, 'hi', 'lo') AS a, IFNULL(NULLIF(n_regionkey, 2), -1) AS b, ISNULL(NULLIF(n_regionkey, 2)) AS c FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey > 10 THEN 'hi' ELSE 'lo' END AS a, COALESCE(NULLIF(n_regionkey, 2), -1) AS b, CAST(NULLIF(n_regionkey, 2) IS NULL AS INT) AS c FROM nation"),
    "coalesce_null": ("SELECT n_nationkey, COALESCE(NULLIF(n_nationkey, 3), NULLIF(n_regionkey, 3), -1) AS v FROM nation", None),
    "three_valued_logic": ("SELECT n_nationkey, (n_nationkey > 5 AND NULL) AS a, (n_nationkey > 5 OR NULL) AS o, NOT (NULLIF(n_nationkey, 1) = 2) AS n FROM nation", None),
    "like_ilike": ("SELECT p_partkey FROM part WHERE p_name LIKE 'RED%' OR p_name LIKE '_lue%'", "SELECT p_partkey FROM part WHERE p_name ILIKE 'RED%' OR p_name ILIKE '_lue%'"),
    "regexp_match": ("SELECT c_custkey FROM customer WHERE c_name REGEXP '[05]0$' AND c_mktsegment RLIKE '^(BUILD|MACH)'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[05]0$') AND regexp_matches(c_mktsegment, '^(BUILD|MACH)')"),
    "match_against": ("SELECT doc_id FROM documents WHERE MATCH(text, source) AGAINST ('license')", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')"),
    "collate_comparison": ("SELECT r_regionkey FROM region WHERE r_name COLLATE utf8mb4_general_ci = 'asia' OR r_name COLLATE utf8mb4_bin = 'africa'", "SELECT r_regionkey FROM region WHERE lower(r_name) = 'asia' OR r_name = 'africa'"),
    # casts
    "cast_family": ("SELECT n_nationkey, CAST(CONCAT(n_nationkey, '') AS UNSIGNED) AS u, CAST('12.5' AS DECIMAL(10, 2)) AS d, CAST(n_nationkey AS CHAR) AS c, CONVERT('x1', SIGNED) AS bad FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS BIGINT) AS u, 12.5::DOUBLE AS d, CAST(n_nationkey AS VARCHAR) AS c, TRY_CAST('x1' AS BIGINT) AS bad FROM nation"),
    # strings
    "string_family": ("SELECT n_nationkey, UPPER(n_name) AS u, LOWER(n_name) AS l, LENGTH(n_name) AS len, SUBSTR(n_name, 2, 3) AS sub, SUBSTRING(n_name FROM 3 FOR 2) AS sub2, LEFT(n_name, 2) AS le, RIGHT(n_name, 2) AS ri, REPLACE(n_name, 'NATION', 'N') AS rep, REPEAT('ab', 2) AS r2, CONCAT(n_name, '-', n_regionkey) AS cc, TRIM('  x ') AS t, LTRIM('  x') AS lt, RTRIM('x  ') AS rt FROM nation", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, CAST(strlen(n_name) AS INT) AS len, substr(n_name, 2, 3) AS sub, substr(n_name, 3, 2) AS sub2, left(n_name, 2) AS le, right(n_name, 2) AS ri, replace(n_name, 'NATION', 'N') AS rep, repeat('ab', 2) AS r2, concat(n_name, '-', n_regionkey) AS cc, trim('  x ') AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt FROM nation"),
    "string_extras": ("SELECT n_nationkey, LPAD(n_name, 10, '*') AS lp, RPAD(n_name, 10, '*') AS rp, CONCAT_WS('/', n_name, n_regionkey) AS ws, LOCATE('ON', n_name) AS loc, INSTR(n_name, 'I') AS ins, REVERSE(n_name) AS rev, STRCMP(n_name, 'NATION_3') AS cmp, MD5(n_name) AS md, SHA256(n_name) AS sh, TO_BASE64(n_name) AS b64, FROM_BASE64(TO_BASE64(n_name)) AS back FROM nation", "SELECT n_nationkey, lpad(n_name, 10, '*') AS lp, rpad(n_name, 10, '*') AS rp, concat_ws('/', n_name, n_regionkey) AS ws, CAST(instr(n_name, 'ON') AS INT) AS loc, CAST(instr(n_name, 'I') AS INT) AS ins, reverse(n_name) AS rev, CASE WHEN n_name < 'NATION_3' THEN -1 WHEN n_name > 'NATION_3' THEN 1 ELSE 0 END AS cmp, md5(n_name) AS md, sha256(n_name) AS sh, to_base64(n_name::BLOB) AS b64, n_name AS back FROM nation"),
    "regexp_functions": ("SELECT c_custkey, REGEXP_REPLACE(c_name, '0+', '0') AS r, REGEXP_SUBSTR(c_name, '[1-9][0-9]*$') AS s FROM customer", "SELECT c_custkey, regexp_replace(c_name, '0+', '0', 'g') AS r, NULLIF(regexp_extract(c_name, '[1-9][0-9]*$'), '') AS s FROM customer"),
    "encode_functions": ("SELECT n_nationkey, BIN2HEX(n_name) AS h, HEX2BIN(BIN2HEX(n_name)) AS b, URLENCODE(CONCAT(n_name, ' &')) AS u, HTMLENTITIES('<a&b>') AS e, SHA1(n_name) AS s1 FROM nation", "SELECT n_nationkey, lower(hex(n_name)) AS h, n_name AS b, n_name || '+%26' AS u, '&lt;a&amp;b&gt;' AS e, sha1(n_name) AS s1 FROM nation"),
    # numbers
    "math_family": ("SELECT p_partkey, ABS(p_size - 25) AS a, ROUND(p_retailprice / 3, 2) AS r, FLOOR(p_retailprice) AS f, CEIL(p_retailprice) AS c, ROUND(SQRT(p_size), 6) AS s, SQRT(0 - p_size) AS neg, GREATEST(p_size, 20) AS g, LEAST(p_size, 20) AS l, MOD(p_size, 7) AS m, p_size % 0 AS z, p_size / 0 AS dz FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice / 3, 2) AS r, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(sqrt(p_size), 6) AS s, CAST(NULL AS DOUBLE) AS neg, greatest(p_size, 20) AS g, least(p_size, 20) AS l, p_size % 7 AS m, CAST(NULL AS INT) AS z, CAST(NULL AS DOUBLE) AS dz FROM part"),
    "math_extras": ("SELECT p_partkey, POWER(p_size, 2) AS p, ROUND(LN(p_size), 6) AS ln, ROUND(LOG10(p_size), 6) AS l10, ROUND(EXP(p_size / 10), 4) AS e, SIGN(p_size - 25) AS sg, p_size DIV 7 AS dv, p_size & 6 AS ba, p_size | 8 AS bo, p_size ^ 5 AS bx, p_size << 2 AS sl, p_size >> 1 AS sr FROM part", "SELECT p_partkey, power(p_size, 2) AS p, round(ln(p_size), 6) AS ln, round(log10(p_size), 6) AS l10, round(exp(p_size / 10), 4) AS e, CAST(sign(p_size - 25) AS DOUBLE) AS sg, CAST(p_size // 7 AS BIGINT) AS dv, p_size & 6 AS ba, p_size | 8 AS bo, xor(p_size, 5) AS bx, p_size << 2 AS sl, p_size >> 1 AS sr FROM part"),
    # dates
    "date_family": ("SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, QUARTER(o_orderdate) AS q, DAYOFWEEK(o_orderdate) AS dow, WEEKDAY(o_orderdate) AS wd, WEEK(o_orderdate) AS w, DAYOFYEAR(o_orderdate) AS doy, DATE(o_orderdate) AS dt, DATEDIFF(o_orderdate, DATE '1995-01-01') AS dd FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q, CAST(dayofweek(o_orderdate) + 1 AS INT) AS dow, CAST(isodow(o_orderdate) - 1 AS INT) AS wd, CAST(weekofyear(o_orderdate) AS INT) AS w, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(o_orderdate AS DATE) AS dt, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INT) AS dd FROM orders"),
    "date_arithmetic": ("SELECT o_orderkey, DATE_ADD(o_orderdate, INTERVAL 10 DAY) AS a, DATE_SUB(o_orderdate, INTERVAL 2 MONTH) AS s, o_orderdate + INTERVAL 36 HOUR AS h, TIMESTAMPDIFF(DAY, TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS td, TIMESTAMPDIFF(MONTH, TIMESTAMP '1995-01-15 00:00:00', o_orderdate) AS tm FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS a, o_orderdate - INTERVAL 2 MONTH AS s, o_orderdate + INTERVAL 36 HOUR AS h, date_sub('day', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS td, date_sub('month', TIMESTAMP '1995-01-15 00:00:00', o_orderdate) AS tm FROM orders"),
    "date_format_parse": ("SELECT o_orderkey, DATE_FORMAT(o_orderdate, '%d.%m.%Y %H:%i') AS f, CAST(STR_TO_DATE(DATE_FORMAT(o_orderdate, '%Y/%m/%d'), '%Y/%m/%d') AS DATE) AS back, UNIX_TIMESTAMP(o_orderdate) AS u, CAST(FROM_UNIXTIME(UNIX_TIMESTAMP(o_orderdate)) AS DATETIME) AS fu FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS f, CAST(o_orderdate AS DATE) AS back, CAST(epoch(o_orderdate) AS BIGINT) AS u, o_orderdate AS fu FROM orders"),
    "extract_fields": ("SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS m, YEARWEEK(ts) AS yw FROM events", "SELECT event_id, extract(year FROM ts) AS y, extract(hour FROM ts) AS h, extract(minute FROM ts) AS m, CAST(year(ts) * 100 + weekofyear(ts) AS INT) AS yw FROM events"),
    "time_zone_conversion": ("SELECT event_id, CONVERT_TZ(ts, 'UTC', 'Europe/Berlin') AS b FROM events", "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS b FROM events"),
    # JSON, vectors
    "json_extract": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS SIGNED) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "json_group": ("SELECT CAST(get_json_object(props, '$.k') AS SIGNED) % 10 AS bucket, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY CAST(get_json_object(props, '$.k') AS SIGNED) % 10", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS bucket, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1"),
    "vector_functions": ("SELECT vec_id, VECTOR_DIM(embedding) AS dim, ROUND(VECTOR_DISTANCE(embedding, embedding), 3) AS self_dot, ROUND(VECTOR_DISTANCE(embedding, embedding, 'COSINE'), 3) AS self_cos, SIZE(STRING_TO_VECTOR(VECTOR_TO_STRING(embedding))) AS back FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS dim, ROUND(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 3) AS self_dot, 1.0::DOUBLE AS self_cos, CAST(len(embedding) AS INT) AS back FROM embeddings"),
    # lists and dictionaries
    "list_functions": ("SELECT n_nationkey, NTH(LIST(n_nationkey, n_regionkey), 1) AS second, HAS(LIST(1, 2, 3), n_regionkey) AS has, CAR(CDR(LIST(n_nationkey, n_regionkey, 7))) AS cadr, SIZE(MERGE_UNIQUE(LIST(LIST(1, 2), LIST(2, n_regionkey)))) AS mu, aggregate(PRODUCEN(4), 0, (s, v) -> s + v) AS total FROM nation", "SELECT n_nationkey, n_regionkey AS second, list_contains([1, 2, 3], n_regionkey) AS has, n_regionkey AS cadr, CAST(len(list_distinct([1, 2, 2, n_regionkey])) AS INT) AS mu, 6 AS total FROM nation"),
    "dict_functions": ("SELECT n_nationkey, GET_ASSOC(SET_ASSOC(map('a', 1, 'b', 2), 'b', n_nationkey), 'b') AS b, HAS_ASSOC(map('a', 1), 'z') AS z, SIZE(MERGE_ASSOC(map('a', 1, 'b', 2), map('b', 3, 'c', 4))) AS n FROM nation", "SELECT n_nationkey, n_nationkey AS b, FALSE AS z, 3 AS n FROM nation"),
    "session_functions": ("SELECT DATABASE() AS d, USER() IS NOT NULL AS u", "SELECT 'default' AS d, TRUE AS u"),
    "distinct_lines_of_text": ("SELECT source, COUNT(DISTINCT lang) AS langs, SUM(CHAR_LENGTH(text)) AS chars FROM documents GROUP BY source", "SELECT source, COUNT(DISTINCT lang) AS langs, CAST(SUM(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source"),
}


def _scratch(spark) -> str:
    """A folder that executors share: under the checkpoint folder, or a local one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="lakeweft-")
    return f"{base.rstrip('/')}/lakeweft/{uuid.uuid4().hex}"


# ---- vectors ---------------------------------------------------------------------------


def _vector_topk(mode: str) -> Query:
    def run(spark, d) -> DataFrame:
        e = table(spark, d, "embeddings")
        query = e.filter("vec_id = 0").select("embedding").first()["embedding"]
        return vectors.nearest(e, "embedding", query, 10, "vec_id", mode).select("vec_id", F.round("score", 3).alias("score"))

    return run


# ---- RDF -------------------------------------------------------------------------------


def triples(spark, d) -> DataFrame:
    """nation, region and customer as triples."""
    n, r, c = (table(spark, d, x) for x in ("nation", "region", "customer"))
    iri = lambda kind, k: F.concat(F.lit(f"ex:{kind}"), k.cast("string"))
    rows = [
        n.select(iri("n", F.col("n_nationkey")).alias("s"), F.lit("ex:name").alias("p"), F.col("n_name").alias("o")),
        n.select(iri("n", F.col("n_nationkey")), F.lit("ex:in"), iri("r", F.col("n_regionkey"))),
        n.filter("n_nationkey > 0").select(iri("n", F.col("n_nationkey")), F.lit("ex:next"), iri("n", F.floor(F.col("n_nationkey") / 2))),
        r.select(iri("r", F.col("r_regionkey")), F.lit("ex:name"), F.col("r_name")),
        c.select(iri("c", F.col("c_custkey")), F.lit("ex:nation"), iri("n", F.col("c_nationkey"))),
        c.filter("c_acctbal > 0").select(iri("c", F.col("c_custkey")), F.lit("ex:balance"), F.col("c_acctbal").cast("string")),
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.union(x)
    return out


def _sparql(query: str) -> Query:
    return lambda spark, d: Sparql(triples(spark, d)).query(query)


_T = "(SELECT 'ex:n' || n_nationkey AS s, 'ex:in' AS p, 'ex:r' || n_regionkey AS o FROM nation)"

RDF: dict[str, tuple[str, str]] = {
    "sparql_bgp": ("SELECT ?nn, ?rn WHERE { ?n <ex:in> ?r ; <ex:name> ?nn . ?r <ex:name> ?rn }", "SELECT n_name AS nn, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "sparql_optional": ("SELECT ?c, ?b WHERE { ?c <ex:nation> <ex:n3> . OPTIONAL { ?c <ex:balance> ?b } }", "SELECT 'ex:c' || c_custkey AS c, CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS VARCHAR) END AS b FROM customer WHERE c_nationkey = 3"),
    "sparql_filter_exists": ("SELECT ?n WHERE { ?n <ex:in> ?r . FILTER NOT EXISTS { ?c <ex:nation> ?n } FILTER(?r != <ex:r0>) }", "SELECT 'ex:n' || n_nationkey AS n FROM nation WHERE n_regionkey <> 0 AND n_nationkey NOT IN (SELECT c_nationkey FROM customer)"),
    "sparql_union_values": ("SELECT ?x, ?name WHERE { VALUES ?x { <ex:n1> <ex:r1> <ex:n2> } { ?x <ex:in> ?r . ?x <ex:name> ?name } UNION { ?x <ex:name> ?name . FILTER(STRSTARTS(?name, 'A')) } }", "SELECT 'ex:n' || n_nationkey AS x, n_name AS name FROM nation WHERE n_nationkey IN (1, 2) UNION ALL SELECT 'ex:r' || r_regionkey, r_name FROM region WHERE r_regionkey = 1 AND r_name LIKE 'A%'"),
    "sparql_group": ("SELECT ?n, COUNT(?c) AS ?k, MAX(?b) AS ?top WHERE { ?c <ex:nation> ?n . ?c <ex:balance> ?b } GROUP BY ?n", "SELECT 'ex:n' || c_nationkey AS n, CAST(COUNT(*) AS VARCHAR) AS k, CASE WHEN MAX(c_acctbal) = floor(MAX(c_acctbal)) THEN CAST(CAST(MAX(c_acctbal) AS BIGINT) AS VARCHAR) ELSE CAST(MAX(c_acctbal) AS VARCHAR) END AS top FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey"),
    "sparql_order_limit": ("SELECT ?c, ?b WHERE { ?c <ex:balance> ?b } ORDER BY DESC(?b) LIMIT 7 OFFSET 2", "SELECT 'ex:c' || c_custkey AS c, CAST(c_acctbal AS VARCHAR) AS b FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC LIMIT 7 OFFSET 2"),
    "sparql_bind_functions": ("SELECT ?n, ?label WHERE { ?n <ex:in> <ex:r1> . ?n <ex:name> ?m . BIND(CONCAT(STR(?m), '/', STRLEN(?m)) AS ?label) FILTER(REGEX(?m, 'nation', 'i') && CONTAINS(?m, '_')) }", "SELECT 'ex:n' || n_nationkey AS n, n_name || '/' || length(n_name) AS label FROM nation WHERE n_regionkey = 1"),
    "sparql_path_sequence": ("SELECT DISTINCT ?c, ?rn WHERE { ?c <ex:nation>/<ex:in>/<ex:name> ?rn }", "SELECT DISTINCT 'ex:c' || c_custkey AS c, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "sparql_path_plus": ("SELECT ?x, ?y WHERE { ?x <ex:next>+ ?y }", "WITH RECURSIVE r(x, y) AS (SELECT n_nationkey, n_nationkey // 2 FROM nation WHERE n_nationkey > 0 UNION SELECT r.x, r.y // 2 FROM r WHERE r.y > 0) SELECT 'ex:n' || x AS x, 'ex:n' || y AS y FROM r"),
    "sparql_path_star": ("SELECT ?y WHERE { <ex:n13> <ex:next>* ?y }", "WITH RECURSIVE r(y) AS (SELECT 13 UNION SELECT y // 2 FROM r WHERE y > 0) SELECT 'ex:n' || y AS y FROM r"),
    "sparql_path_alternative": ("SELECT ?x, ?y WHERE { ?x <ex:in>|<ex:nation> ?y . FILTER(?y = <ex:r2> || ?y = <ex:n2>) }", "SELECT 'ex:n' || n_nationkey AS x, 'ex:r2' AS y FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'ex:c' || c_custkey, 'ex:n2' FROM customer WHERE c_nationkey = 2"),
    "sparql_subselect": ("SELECT ?name, ?k WHERE { { SELECT ?n, COUNT(?c) AS ?k WHERE { ?c <ex:nation> ?n } GROUP BY ?n } ?n <ex:name> ?name . FILTER(?k > 12) }", "SELECT n_name AS name, CAST(k AS VARCHAR) AS k FROM (SELECT c_nationkey, COUNT(*) AS k FROM customer GROUP BY c_nationkey) JOIN nation ON c_nationkey = n_nationkey WHERE k > 12"),
    "sparql_ask": ("ASK { <ex:n1> <ex:in> ?r }", "SELECT TRUE AS ask"),
    "sparql_construct": ("CONSTRUCT { ?r <ex:holds> ?n } WHERE { ?n <ex:in> ?r }", "SELECT 'ex:r' || n_regionkey AS s, 'ex:holds' AS p, 'ex:n' || n_nationkey AS o FROM nation"),
}


def _sparql_update(spark, d) -> DataFrame:
    g = Sparql(triples(spark, d).filter("p = 'ex:in'"))
    g = Sparql(g.update("INSERT DATA { <ex:n99> <ex:in> <ex:r0> }"))
    g = Sparql(g.update("DELETE { ?n <ex:in> <ex:r1> } INSERT { ?n <ex:in> <ex:r9> } WHERE { ?n <ex:in> <ex:r1> }"))
    return g.update("DELETE DATA { <ex:n0> <ex:in> <ex:r0> }")


def _closure_cycle(spark, d) -> DataFrame:
    edges = table(spark, d, "nation").select(F.col("n_nationkey").alias("x"), ((F.col("n_nationkey") + 3) % 25).alias("y"))
    return closure(edges).groupBy("x").agg(F.count("*").alias("reached"))


# ---- ingestion, DML, streaming -------------------------------------------------------------


def _csv(spark, d) -> DataFrame:
    path = _scratch(spark)
    table(spark, d, "nation").select(F.concat_ws(";", "n_nationkey", "n_name", "n_regionkey").alias("value")).write.text(path)
    return sources.typed(sources.load_csv(spark, path, header=False)).toDF("n_nationkey", "n_name", "n_regionkey")


def _jsonl(spark, d) -> DataFrame:
    path = _scratch(spark)
    n = table(spark, d, "nation")
    lines = spark.createDataFrame([("#table nation", 0), ("# a comment", 1)], "value string, i int").unionByName(n.select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value"), F.lit(2).alias("i")))
    lines.coalesce(1).sortWithinPartitions("i").select("value").write.text(path)
    return sources.load_json_lines(spark, path, "nation")


def _dump(spark, d) -> DataFrame:
    body = "\n".join(f"{r['r_regionkey']}\t{r['r_name'] if r['r_regionkey'] else chr(92) + 'N'}" for r in table(spark, d, "region").orderBy("r_regionkey").collect())
    text_ = f"CREATE TABLE public.region (\n  id integer NOT NULL,\n  name character varying(20),\n  CONSTRAINT pk PRIMARY KEY (id)\n);\nCOPY public.region (id, name) FROM stdin;\n{body}\n\\.\n"
    return sources.load_dump(spark, text_)["region"]


def _dml(spark, d) -> DataFrame:
    """INSERT, upsert, UPDATE with LIMIT, DELETE, ALTER on a copy of ``supplier``."""
    t = WritableTable(spark, _scratch(spark), "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", primary_key=["s_suppkey"])
    t.insert(table(spark, d, "supplier"))
    new = spark.createDataFrame([(0, "again", 1, 5.0), (100_000, "fresh", 2, 6.0)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")
    t.insert(new, on_duplicate={"s_acctbal": F.col("new.s_acctbal") + 1})
    t.update({"s_name": F.lit("poor")}, F.col("s_acctbal") < 1000)
    t.update({"s_name": F.lit("first")}, order=[F.asc("s_suppkey")], limit=2)
    t.delete(F.col("s_nationkey") == 7)
    t.add_column("note", "string", F.lit("n"))
    return t.read()


_DML_SQL = """SELECT s_suppkey, CASE WHEN s_suppkey < 2 THEN 'first' WHEN s_acctbal2 < 1000 THEN 'poor' ELSE s_name END AS s_name, s_nationkey, s_acctbal2 AS s_acctbal, 'n' AS note FROM (SELECT *, CASE WHEN s_suppkey = 0 THEN 6.0 ELSE s_acctbal END AS s_acctbal2 FROM supplier UNION ALL SELECT 100000, 'fresh', 2, 6.0, 6.0) WHERE s_nationkey <> 7"""


def _incremental(spark, d) -> DataFrame:
    """Groups kept over three batches, the last of which takes rows back."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    kept = o.filter("o_orderkey % 7 <> 0")
    g = IncrementalGroups(spark, _scratch(spark), ["o_orderpriority"], ["o_totalprice"], lambda: kept)
    g.merge(o.filter("o_orderkey % 2 = 0"), 0)
    g.merge(o.filter("o_orderkey % 2 = 1"), 1)
    g.merge(o.filter("o_orderkey % 2 = 1"), 1)
    g.merge(o.filter("o_orderkey % 7 = 0").withColumn("change", F.lit(-1)), 2)
    return g.groups().select("o_orderpriority", "n_rows", F.round("sum_o_totalprice", 2).alias("s"), F.col("min_o_totalprice").alias("low"), F.col("max_o_totalprice").alias("high"))


def _streamed(spark, d) -> DataFrame:
    """Tumbling windows over the events table read as a stream."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(d)
    out = event_windows.windowed(stream, "ts", "6 hours", keys=["event_type"], measures=[F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")], late="1 hour")
    return event_windows.drain(out, "w" + uuid.uuid4().hex, "complete")


def _tumbling(spark, d) -> DataFrame:
    return event_windows.windowed(table(spark, d, "events"), "ts", "1 hour", keys=["event_type"], measures=[F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")])


def _sliding(spark, d) -> DataFrame:
    return event_windows.windowed(table(spark, d, "events"), "ts", "2 hours", "1 hour").select("window_start", "n")


def _sessions(spark, d) -> DataFrame:
    return event_windows.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"]).select("user_id", "session_start", "n")


def _custom_functions(spark, d) -> DataFrame:
    """A scalar and an ordered aggregate added to the registry, then used from dialect text."""
    register("DOUBLED", "({0} * 2)")
    register_aggregate("CHAIN_CODE", fold("cast(0 as bigint)", "(s * 7 + v) % 100003", "n_nationkey"))
    return engine_for(spark, d, {"nation"}).sql("SELECT n_regionkey, DOUBLED(n_regionkey) AS twice, CHAIN_CODE(cast(n_nationkey as bigint)) AS code FROM nation GROUP BY n_regionkey")


def _views(spark, d) -> DataFrame:
    e = engine_for(spark, d, {"nation", "region"})
    e.sql("CREATE VIEW big AS SELECT n_name, n_regionkey FROM nation WHERE n_nationkey > 5")
    e.sql("CREATE OR REPLACE VIEW named(nation_name, region_name) AS SELECT n_name, r_name FROM big JOIN region ON n_regionkey = r_regionkey")
    return e.sql("SELECT region_name, COUNT(*) AS n FROM named GROUP BY region_name")


def _information_schema(spark, d) -> DataFrame:
    e = engine_for(spark, d, {"nation", "region", "supplier"})
    return e.sql("SELECT table_name, COUNT(*) AS n FROM information_schema.columns GROUP BY table_name")


def _variables(spark, d) -> DataFrame:
    e: Engine = engine_for(spark, d, {"nation"})
    e.sql("SET @low = 3, @high = 2 + 6")
    return e.sql("SELECT n_nationkey, @high - @low AS span FROM nation WHERE n_nationkey BETWEEN @low AND @high")


def _psql(spark, d) -> DataFrame:
    return text("""SELECT "n_name"::text || '/' || n_regionkey::text AS label, n_nationkey::numeric(10,2) AS k FROM nation WHERE n_name ILIKE 'nation_1%' AND n_name ~ '[0-9]$' AND n_name NOT LIKE 'n%'""", "psql")(spark, d)


DIRECT: dict[str, tuple[Query, str | None]] = {
    "vector_dot_topk": (_vector_topk("dot"), "SELECT vec_id, ROUND(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 3) AS score FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10"),
    "vector_cosine": (_vector_topk("cosine"), "SELECT vec_id, ROUND(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 3) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10"),
    "vector_l2": (_vector_topk("l2"), "SELECT vec_id, ROUND(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 3) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), vec_id LIMIT 10"),
    "sparql_update": (_sparql_update, f"SELECT s, p, CASE WHEN o = 'ex:r1' THEN 'ex:r9' ELSE o END AS o FROM {_T} WHERE s <> 'ex:n0' UNION ALL SELECT 'ex:n99', 'ex:in', 'ex:r0'"),
    "closure_on_cycle": (_closure_cycle, "SELECT n_nationkey AS x, CAST(25 AS BIGINT) AS reached FROM nation"),
    "ingest_csv": (_csv, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
    "ingest_json_lines": (_jsonl, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"),
    "ingest_dump": (_dump, "SELECT CAST(r_regionkey AS BIGINT) AS id, CASE WHEN r_regionkey > 0 THEN r_name END AS name FROM region"),
    "dml_copy_on_write": (_dml, _DML_SQL),
    "incremental_groups": (_incremental, "SELECT o_orderpriority, COUNT(*) AS n_rows, ROUND(SUM(o_totalprice), 2) AS s, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_orderpriority"),
    "events_streamed": (_streamed, "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY ALL"),
    "events_tumbling": (_tumbling, "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY ALL"),
    "events_sliding": (_sliding, "SELECT date_trunc('hour', ts) - to_hours(k) AS window_start, COUNT(*) AS n FROM events, (SELECT CAST(0 AS INT) AS k UNION ALL SELECT 1) GROUP BY 1"),
    "events_sessions": (_sessions, "SELECT user_id, MIN(ts) AS session_start, COUNT(*) AS n FROM (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"),
    "custom_functions": (_custom_functions, "SELECT n_regionkey, n_regionkey * 2 AS twice, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey)), lambda s, v: (s * 7 + v) % 100003) AS BIGINT) AS code FROM nation GROUP BY n_regionkey"),
    "views": (_views, "SELECT r_name AS region_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 5 GROUP BY r_name"),
    "information_schema": (_information_schema, "SELECT * FROM (VALUES ('nation', CAST(3 AS BIGINT)), ('region', 2), ('supplier', 4)) t(table_name, n)"),
    "session_variables": (_variables, "SELECT n_nationkey, 5 AS span FROM nation WHERE n_nationkey BETWEEN 3 AND 8"),
    "psql_dialect": (_psql, "SELECT n_name || '/' || n_regionkey AS label, CAST(n_nationkey AS DOUBLE) AS k FROM nation WHERE n_name ILIKE 'nation_1%' AND n_name NOT LIKE 'n%'"),
}


def queries() -> dict[str, Query]:
    out = {n: text(sql) for n, (sql, _) in TEXTS.items()} | {n: _sparql(q) for n, (q, _) in RDF.items()}
    return out | {n: q for n, (q, _) in DIRECT.items()}


def oracle_sql() -> dict[str, str]:
    out = {n: oracle or sql for n, (sql, oracle) in TEXTS.items()} | {n: o for n, (_, o) in RDF.items()}
    return out | {n: o for n, (_, o) in DIRECT.items() if o}

"""SQL function registry: dialect name -> Spark SQL text.

A template is a string with ``{0}``, ``{1}`` … for the arguments (``{*}`` for all of them),
or a callable on the list of argument texts.  Everything becomes built-in JVM expressions.
Names that Spark already has with the same meaning need no entry.
"""

from __future__ import annotations

from collections.abc import Callable

Template = str | Callable[[list[str]], str]

#: Date format codes of the MySQL dialect that are supported, as Java patterns.
FORMAT_CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "i": "mm", "s": "ss", "T": "HH:mm:ss", "%": "%"}
#: Text layouts that dates are read from.
DATE_LAYOUTS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy")


def java_pattern(mysql_format: str) -> str:
    """A ``%``-format as a Java date pattern; codes that aren't supported are echoed as text."""
    out, text, i = [], "", 0

    def flush() -> None:
        nonlocal text
        if text:
            out.append("'" + text.replace("'", "''") + "'" if any(c.isalpha() or c == "'" for c in text) else text)
        text = ""

    while i < len(mysql_format):
        c = mysql_format[i]
        if c == "%" and i + 1 < len(mysql_format):
            code = mysql_format[i + 1]
            made = FORMAT_CODES.get(code)
            if made is None:
                text += "%" + code
            elif made == "%":
                text += "%"
            else:
                flush()
                out.append(made)
            i += 2
        else:
            text += c
            i += 1
    flush()
    return "".join(out)


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unquoted(literal: str) -> str:
    if not (literal.startswith("'") and literal.endswith("'")):
        raise ValueError(f"a literal format is wanted, not {literal}")
    return literal[1:-1].replace("\\'", "'").replace("\\\\", "\\")


def _date_format(a: list[str]) -> str:
    return f"date_format({a[0]}, {quoted(java_pattern(unquoted(a[1])))})"


def _str_to_date(a: list[str]) -> str:
    return f"try_to_timestamp({a[0]}, {quoted(java_pattern(unquoted(a[1])))})"


def parse_date(a: list[str]) -> str:
    return "coalesce(" + ", ".join(f"try_to_timestamp(cast({a[0]} as string), {quoted(p)})" for p in DATE_LAYOUTS) + ")"


def _timestampdiff(a: list[str]) -> str:
    return f"timestampdiff({a[0]}, {a[1]}, {a[2]})"


def _vector_distance(a: list[str]) -> str:
    mode = unquoted(a[2]).upper() if len(a) > 2 else "DOT"
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> cast(p as double) * cast(q as double)), 0D, (s, v) -> s + v)"
    if mode == "COSINE":
        return f"({dot(a[0], a[1])} / (sqrt({dot(a[0], a[0])}) * sqrt({dot(a[1], a[1])})))"
    if mode == "EUCLIDEAN":
        return f"sqrt({dot(a[0], a[1])})"
    return dot(a[0], a[1])



#: Offset basis (as a signed number) and prime of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325 - (1 << 64), 0x100000001B3

_L2 = "sqrt(aggregate(zip_with({0}, {1}, (p, q) -> power(cast(p as double) - cast(q as double), 2)), 0D, (s, v) -> s + v))"

FUNCTIONS: dict[str, Template] = {
    # predicates and conditionals
    "ISNULL": "cast(({0}) is null as int)", "IFNULL": "coalesce({*})", "IF": "if({*})", "NULLIF": "nullif({*})", "STRCMP": "(case when {0} < {1} then -1 when {0} > {1} then 1 when {0} = {1} then 0 end)",
    # strings
    "LENGTH": "octet_length(cast({0} as string))", "CHAR_LENGTH": "char_length(cast({0} as string))", "CHARACTER_LENGTH": "char_length(cast({0} as string))",
    "SUBSTR": lambda a: f"substring({a[0]}, greatest({a[1]}, 1)" + (f", {a[2]})" if len(a) > 2 else ")"), "SUBSTRING": lambda a: f"substring({a[0]}, greatest({a[1]}, 1)" + (f", {a[2]})" if len(a) > 2 else ")"),
    "UCASE": "upper({0})", "LCASE": "lower({0})", "TO_BASE64": "base64(cast({0} as binary))", "FROM_BASE64": "cast(unbase64({0}) as string)",
    "REGEXP_SUBSTR": "regexp_substr({0}, {1})", "REGEXP_REPLACE": "regexp_replace({*})", "SOUNDEX": "soundex({0})",
    "PASSWORD": "concat('*', upper(sha1(unhex(sha1({0})))))", "SHA256": "sha2({0}, 256)", "BIN2HEX": "lower(hex({0}))", "HEX2BIN": "cast(unhex({0}) as string)", "URLENCODE": "url_encode({0})", "URLDECODE": "url_decode({0})",
    "HTMLENTITIES": "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '\\'', '&#39;')",
    "LOCATE": "locate({*})", "INSTR": "instr({0}, {1})", "SPACE": "space({0})", "TRUNCATE": lambda a: f"(sign({a[0]}) * floor(abs({a[0]}) * power(10, {a[1]})) / power(10, {a[1]}))",
    "STRLIKE_CS": "({0} like {1})", "FNV_HASH": f"lpad(lower(hex(aggregate(transform(if(octet_length(cast({{0}} as string)) = 0, cast(array() as array<int>), sequence(1, octet_length(cast({{0}} as string)))), i -> cast(conv(hex(substring(cast({{0}} as binary), i, 1)), 16, 10) as bigint)), {FNV_OFFSET}L, (h, b) -> (h ^ b) * {FNV_PRIME}L))), 16, '0')",
    # numbers
    "MOD": "try_mod({0}, {1})", "CEIL": "ceil({0})", "CEILING": "ceil({0})", "SQRT": "(case when {0} >= 0 then sqrt({0}) end)", "RANDOM": "rand()", "POW": "power({0}, {1})", "POWER": "power({0}, {1})", "LOG": lambda a: f"ln({a[0]})" if len(a) == 1 else f"log({a[0]}, {a[1]})", "LOG2": "log2({0})", "LOG10": "log10({0})",
    # dates
    "NOW": "current_timestamp()", "CLOCK_TIMESTAMP": "current_timestamp()", "TRANSACTION_TIMESTAMP": "current_timestamp()", "SYSDATE": "current_timestamp()", "CURDATE": "current_date()", "CURTIME": "date_format(current_timestamp(), 'HH:mm:ss')",
    "UTC_TIMESTAMP": "to_utc_timestamp(current_timestamp(), current_timezone())", "UTC_DATE": "to_date(to_utc_timestamp(current_timestamp(), current_timezone()))", "UTC_TIME": "date_format(to_utc_timestamp(current_timestamp(), current_timezone()), 'HH:mm:ss')",
    "DATE": "to_date({0})", "TIME": "date_format({0}, 'HH:mm:ss')", "DAYOFMONTH": "day({0})", "WEEK": "weekofyear({0})", "YEARWEEK": "(year({0}) * 100 + weekofyear({0}))", "DATE_FORMAT": _date_format, "FORMAT_DATE": _date_format, "STR_TO_DATE": _str_to_date, "PARSE_DATE": parse_date,
    "DATE_TRUNC_DAY": "date_trunc('DAY', {0})", "DATEDIFF": "datediff({0}, {1})", "TIMESTAMPDIFF": _timestampdiff, "UNIX_TIMESTAMP": lambda a: f"unix_timestamp({a[0]})" if a else "unix_timestamp()", "FROM_UNIXTIME": "timestamp_seconds({0})", "TO_TIMESTAMP": lambda a: f"timestamp_seconds({a[0]})" if len(a) == 1 else f"to_timestamp({a[0]}, {a[1]})",
    "CONVERT_TZ": "convert_timezone({1}, {2}, cast({0} as timestamp_ntz))",
    # vectors and JSON
    "VECTOR_DISTANCE": _vector_distance, "DOT": _vector_distance, "L2_DISTANCE": _L2, "STRING_TO_VECTOR": "from_json({0}, 'array<double>')", "VECTOR_TO_STRING": "to_json({0})", "VECTOR_DIM": "size({0})", "JSON_ENCODE": "to_json({0})", "JSON_DECODE": "parse_json({0})",
    # lists and dictionaries
    "LIST": "array({*})", "NTH": "get({0}, {1})", "HAS": "array_contains({0}, {1})", "CAR": "get({0}, 0)", "CADR": "get({0}, 1)", "CDR": "slice({0}, 2, greatest(size({0}) - 1, 0))", "CONS": "array_prepend({1}, {0})", "APPEND": "array_append({0}, {1})", "APPEND_UNIQUE": "if(array_contains({0}, {1}), {0}, array_append({0}, {1}))", "ZIP": "arrays_zip({*})", "MERGE": "flatten({0})", "MERGE_UNIQUE": "array_distinct(flatten({0}))",
    "PRODUCEN": "sequence(0, {0} - 1)", "GET_ASSOC": "try_element_at({0}, {1})", "SET_ASSOC": "map_concat(map_filter({0}, (k, v) -> k <> {1}), map({1}, {2}))", "HAS_ASSOC": "map_contains_key({0}, {1})", "MERGE_ASSOC": "map_concat(map_filter({0}, (k, v) -> not map_contains_key({1}, k)), {1})", "MAP_KEYS": "map_keys({0})",
    # session
    "DATABASE": "current_database()", "SCHEMA": "current_database()", "SESSION_USER": "current_user()", "VERSION": "version()",
}

#: Aggregate names users may add: name -> text of a Spark aggregate over ``{0}``.
AGGREGATES: dict[str, Template] = {
    "GROUP_PRODUCT": "aggregate(collect_list(cast({0} as double)), 1D, (s, v) -> s * v)",
    "ANY_OF": "bool_or({0})", "EVERY_OF": "bool_and({0})",
}


def render(template: Template, args: list[str]) -> str:
    if callable(template):
        return template(args)
    out = template.replace("{*}", ", ".join(args))
    for i, a in enumerate(args):
        out = out.replace(f"{{{i}}}", a)
    if "{" in out and any(f"{{{i}}}" in out for i in range(9)):
        raise ValueError(f"too few arguments: {template}")
    return out


def register(name: str, template: Template) -> None:
    """Add a scalar function (the dialects' ``sql_builtins``)."""
    FUNCTIONS[name.upper()] = template


def register_aggregate(name: str, template: Template) -> None:
    """Add an aggregate (the dialects' ``sql_aggregates``): text with ``{0}``, made of Spark aggregates and higher-order functions."""
    AGGREGATES[name.upper()] = template


def fold(neutral: str, step: str, order_by: str | None = None) -> str:
    """Text of an aggregate given as (reduce, neutral): a left fold of a group's values.

    ``step`` is a SQL lambda body over ``s`` (so far) and ``v`` (next).  With ``order_by`` the
    values come in that order, so the fold may be order-sensitive.
    """
    values = "collect_list({0})" if order_by is None else f"transform(array_sort(collect_list(struct({order_by} as k, {{0}} as v))), x -> x.v)"
    return f"aggregate({values}, {neutral}, (s, v) -> {step})"


def register_python(spark, name: str, function, kind: str) -> None:
    """A scalar function over pandas series, for what no built-in expression says; it runs in Arrow batches."""
    from pyspark.sql import functions as F

    spark.udf.register(name, F.pandas_udf(function, kind))

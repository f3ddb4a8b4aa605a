"""Operator 3: secret scans with corpus-wide ownership frequency.

Three base patterns give spans that always stay.  The method proposes more candidates
(tokens of known providers, long random-looking tokens, private-key blocks), hashes every
candidate's value, those of base spans included, and counts, over the whole corpus, in how
many distinct repositories (documents) and owners (sources) it occurs.  A value in many
repositories of many owners is a copied example; any other is a live-looking credential: one
owner may use it in many repositories, and a few copies of a leak don't make an example.
Spans of live-looking values are added to the base ones.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweft.llm.common import begin_task, free_name, map_texts, written

#: The base patterns and their least lengths.
ASSIGN = regex.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", regex.IGNORECASE | regex.ASCII)
ACCESS = regex.compile(r"AKIA[A-Z0-9]+")
HEX = regex.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex")

#: Shapes of published token formats, and private-key blocks.
PROVIDERS = {
    "github": r"\bgh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "google": r"\bAIza[A-Za-z0-9_-]{35}",
    "stripe": r"\b[sr]k_live_[A-Za-z0-9]{16,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
}
PROVIDER = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in PROVIDERS.items()))
#: A cheap look before the pattern above is tried.
HINTS = ("gh", "xox", "AIza", "k_live_", "eyJ", "PRIVATE KEY")
#: ``=`` may stand before a value (KEY=value), behind it only as padding.
RANDOM = regex.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
LEAST_ENTROPY = 3.5
#: A value held by more owners and in more repositories than these is a widely copied example.
MAX_OWNERS, MAX_REPOS = 2, 4
#: Counts of values are broadcast up to this many rows of about 60 bytes; beyond it they are shuffled.
BROADCAST_VALUES = 200_000


def entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base patterns, leftmost without overlap per kind."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX_LONG.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


#: Runs under the least length can't count, so only long ones are looked for; a greedy run is whole either way.
HEX_LONG = regex.compile(r"[0-9a-f]{32,}")


def more_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Candidates of the method: provider formats, then long tokens of mixed kinds and high entropy."""
    out = []
    if any(h in text for h in HINTS):
        out += [(m.start(), m.end(), m.lastgroup, m[0]) for m in PROVIDER.finditer(text)]
    for m in RANDOM.finditer(text):
        v = m[0]
        mixed = any(c.isdigit() for c in v) and any("a" <= c <= "z" for c in v) and any("A" <= c <= "Z" for c in v)
        if mixed and entropy(v) >= LEAST_ENTROPY:
            out.append((m.start(), m.end(), "random", v))
    return out


def spelled(spans: list) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)


def scan(texts: list[str]) -> dict:
    out: dict = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "found")}
    for t in texts:
        base = base_spans(t)
        n = Counter(s[2] for s in base)
        for k in KINDS:
            out[f"n_{k}"].append(n[k])
        out["base"].append(spelled(base))
        taken = [(s[0], s[1]) for s in base]
        more = [s for s in more_spans(t) if not any(a < s[1] and s[0] < b for a, b in taken)]
        out["found"].append([{"start": s[0], "stop": s[1], "kind": s[2], "base": i < len(base), "hash": hashlib.blake2b(s[3].encode(), digest_size=16).hexdigest()} for i, s in enumerate(base + more)])
    return out


SCHEMA = "n_assign long, n_access long, n_hex long, base string, found array<struct<start:long,stop:long,kind:string,base:boolean,hash:string>>"
ORDER = {k: i for i, k in enumerate([*KINDS, *PROVIDERS, "random"])}


def _text_key(names: tuple[str, str, str] = ("id", "t1", "t2")) -> list:
    """Columns that tell a row by its id and 128 bits of its text."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(names[0]), F.xxhash64("text").alias(names[1]), F.xxhash64("doc_id", "text", F.lit(1)).alias(names[2])]


def _judged(docs: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """One row per input row: doc_id, its text's key, base counts and spelling, and ``s``, its spans with both counts and the verdict."""
    owner = F.col("source").cast("string") if "source" in docs.columns else F.col("doc_id").cast("string")
    keyed = docs.select("doc_id", F.coalesce(owner, F.lit("")).alias("owner"), F.col("text").cast("string").alias("text")).select("doc_id", "owner", *_text_key(), "text")
    rows = written(map_texts(keyed, scan, SCHEMA, ["doc_id", "owner", "id", "t1", "t2"]).withColumn("uid", F.monotonically_increasing_id()), "secrets")
    each = rows.where(F.size("found") > 0).select("uid", "owner", F.col("id").alias("repo"), F.explode("found").alias("c"))
    # distinct pairs first, so that a value in a third of all rows is counted in many tasks
    owners = each.select(F.col("c.hash").alias("hash"), "owner").distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    repos = each.select(F.col("c.hash").alias("hash"), "repo").distinct().groupBy("hash").agg(F.count("*").alias("n_repos"))
    # written, so that both sides of the next join are plain shuffles and a hot value's rows can be split
    spread = written(owners.join(repos, "hash"), "ownership")
    few = spread.count() <= BROADCAST_VALUES
    live = ~((F.col("n_owners") > max_owners) & (F.col("n_repos") > max_repos))
    rank = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])
    found = each.select("uid", "c.*").join(F.broadcast(spread) if few else spread, "hash")
    lists = found.select("uid", F.struct("start", rank[F.col("kind")].alias("rank"), "stop", "kind", "base", live.alias("live"), "n_owners", "n_repos").alias("s")).groupBy("uid").agg(F.array_sort(F.collect_list("s")).alias("s"))
    full = rows.drop("found", "owner").join(lists, "uid", "left")
    return full.withColumn("s", F.coalesce("s", F.expr("cast(array() as " + lists.schema["s"].dataType.simpleString() + ")")))


def secret_scan(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, max_owners, max_repos, redact), one row per input row.

    ``spans`` lists kind:start:end of the base spans and of the added live-looking ones by
    start; ``n_live`` and ``n_copied`` count the row's candidates by verdict; a copied example
    has more than ``max_owners`` owners and more than ``max_repos`` repositories.  The columns
    ``max_owners`` and ``max_repos`` are the largest counts among the row's candidates, 0 without
    any; ``redact`` has the live-looking spans as (start, stop) pairs.  A null text has no
    span.  A null source is one owner; without a ``source`` column each document is its own
    owner.  A null id is one repository.  Repeated rows don't raise the counts of distinct
    repositories and owners.  A very long text is one value in one task.  Other columns are not
    read; an empty table gives an empty table.
    """
    full = _judged(docs, max_owners, max_repos)
    shown = F.filter("s", lambda x: x["base"] | x["live"])
    spell = F.transform(shown, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"]))
    live = F.filter("s", lambda x: x["live"])
    most = lambda c: F.coalesce(F.array_max(F.transform("s", lambda x: x[c])), F.lit(0)).alias("max_" + c[2:])
    return full.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), F.array_join(spell, ",").alias("spans"),
        F.size(live).cast("long").alias("n_live"), (F.size("s") - F.size(live)).cast("long").alias("n_copied"), most("n_owners"), most("n_repos"),
        F.transform(live, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).alias("redact"),
    )


def redacted(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live-looking span replaced by ``mark``; all rows and columns stay.

    Base spans are masked, too, unless their value is a copied example by owners and
    repositories together.  Rows that share an id are told apart by their text; rows of null
    id are masked too; a null text stays null.  An empty table gives an empty table.
    """
    names = docs.columns
    keys, held = tuple(free_name(x, names) for x in ("id", "t1", "t2")), free_name("spots", names)
    live = F.transform(F.filter("s", lambda x: x["live"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    found = _judged(docs, max_owners, max_repos).select(*(F.col(a).alias(b) for a, b in zip(("id", "t1", "t2"), keys, strict=True)), live.alias(held)).where(F.size(held) > 0)
    spots = found.dropDuplicates(list(keys))
    joined = docs.select("*", *_text_key(keys)).join(spots, list(keys), "left")

    def mask(batches):
        import pyarrow as pa

        begin_task(__name__)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, spots in enumerate(b.column(held).to_pylist()):
                if spots and texts[i]:
                    at, parts = 0, []
                    for s, e in sorted((x["start"], x["stop"]) for x in spots):
                        if e > at:
                            parts += [texts[i][at : max(s, at)], mark if s >= at else ""]
                            at = e
                    texts[i] = "".join(parts) + texts[i][at:]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names], names)

    return joined.select(*names, held).mapInArrow(mask, docs.schema)

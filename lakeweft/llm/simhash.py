"""Operator 6: SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments.  Two fingerprints at most 4 bits apart
differ by at most one bit in some segment (three segments with two bits each would make
six), so they share a variant of that segment with one bit wiped out.  Each distinct
fingerprint is indexed under its 64 variants; equal keys meet, and the Hamming distance is
verified on the whole fingerprint.

Exact copies collapse to one fingerprint before the index.  Within a bucket only enough
verified links to connect what is connected are given, never all pairs.  A bucket of more
than ``BLOCK`` fingerprints is passed on row by row and compared in pairs of blocks by
as many tasks, so no task holds more than two blocks.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweft.llm.common import begin_task, free_name, map_texts, scratch, written
from lakeweft.llm.components import components, contract

SEGMENTS = ((0, 22), (22, 43), (43, 64))
BLOCK = 4096
#: Runs up to this length are compared row against row, all runs of a batch at once.
SHORT_RUN = 12
SEED = 42


def fingerprint(text: str, words_each: int = 4) -> int:
    """SimHash of the word shingles of a text, A-Z lower-cased; no word gives 0."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - words_each + 1)
    last = ends[words_each - 1 :] if len(words) >= words_each else ends[-1:]
    slices = [joined[a:b] for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)]
    h = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), slices), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = h[at : at + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_each: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(texts: list[str]) -> dict:
        made = np.array([fingerprint(t, words_each) for t in texts], np.uint64)
        return {"fp": pa.array(made.view(np.int64))}

    return map_texts(docs, run, "fp long", ["doc_id"])


def variant_keys(fp: np.ndarray) -> np.ndarray:
    """The 64 index keys of each fingerprint: wiped bit, then the rest of its segment."""
    out = np.empty((len(fp), 64), np.int64)
    for low, high in SEGMENTS:
        part = (fp >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        for bit in range(low, high):
            out[:, bit] = (part & ~np.uint64(1 << (bit - low))).astype(np.int64) | (bit << 22)
    return out


def _distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


#: How two rows are told to be near: at most ``bits`` differing bits and, where sizes are given, a shorter one of at least ``share`` of the longer.
Near = tuple[int, float]


def _is_near(near: Near, fp, other, size, other_size) -> np.ndarray:
    bits, share = near
    close = _distance(fp, other) <= bits
    return close & (np.minimum(size, other_size) >= share * np.maximum(size, other_size) - 1e-9) if share else close


def _connect(fps: np.ndarray, sizes: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within one bucket, by search from one to the unreached."""
    links_a, links_b = [], []
    rest, size = fps, sizes
    while len(rest) > 1:
        front, rest, size = [(rest[0], size[0])], rest[1:], size[1:]
        while front and len(rest):
            x, n = front.pop()
            hit = _is_near(near, rest, x, size, n)
            if hit.any():
                reached = rest[hit]
                links_a.append(np.full(len(reached), x, np.uint64))
                links_b.append(reached)
                front += zip(reached, size[hit], strict=True)
                rest, size = rest[~hit], size[~hit]
    none = np.empty(0, np.uint64)
    return (np.concatenate(links_a), np.concatenate(links_b)) if links_a else (none, none)


def _runs(batches, columns: list[str], block: int = BLOCK):
    """Arrays of whole runs of equal leading columns from sorted batches; a run over ``block`` rows comes in parts.

    Yields (columns, oversize): oversize parts all belong to one run.
    """
    held, over = None, None
    for b in batches:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            held = None
        while len(cols[0]):
            key = cols[0]
            if over is not None:
                n = int(np.searchsorted(key != over, True))
                if n:
                    yield [c[:n] for c in cols], True
                    cols = [c[n:] for c in cols]
                if len(cols[0]):
                    over = None
                continue
            start = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
            if start:
                yield [c[:start] for c in cols], False
                cols = [c[start:] for c in cols]
            if len(cols[0]) > block:
                over = cols[0][0]
                continue
            held = cols
            break
    if held is not None:
        yield held, False


def _compare(key: np.ndarray, fp: np.ndarray, sizes: np.ndarray, near: Near, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of the runs of equal keys in ``key``."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[starts, len(key)])
    of_row = np.repeat(size, size)
    short = of_row <= SHORT_RUN
    a, b = [], []
    for off in range(1, SHORT_RUN):
        if not (size > off).any():
            break
        i = np.flatnonzero(short[:-off] & (key[:-off] == key[off:])) if len(key) > off else np.empty(0, np.int64)
        i = i[_is_near(near, fp[i], fp[i + off], sizes[i], sizes[i + off])]
        a.append(fp[i])
        b.append(fp[i + off])
    for s, n in zip(starts[size > SHORT_RUN].tolist(), size[size > SHORT_RUN].tolist(), strict=True):
        if n <= block:
            x, y = _connect(fp[s : s + n], sizes[s : s + n], near)
        else:
            parts = [(fp[s + i : s + i + block], sizes[s + i : s + i + block]) for i in range(0, n, block)]
            pairs = [_connect(*(np.concatenate([parts[i][k], parts[j][k]]) for k in (0, 1)), near) for i, j in itertools.combinations(range(len(parts)), 2)]
            x, y = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        a.append(x)
        b.append(y)
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


LINK_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64())])
LINK_TYPES = "u long, v long, key long"


def _linker(near: Near, block: int = BLOCK):
    """Links (u, v, null); a row of an oversize bucket passes as (fingerprint, size, key)."""

    def run(batches):
        begin_task(__name__)
        kept_a, kept_b, n = [], [], 0
        for (key, fp, sizes), oversize in _runs(batches, ["key", "fp", "size"], block):
            if oversize:
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(sizes.astype(np.int64)), pa.array(key)], schema=LINK_SCHEMA)
                continue
            a, b = _compare(key, fp.view(np.uint64), sizes, near, block)
            kept_a.append(a.view(np.int64))
            kept_b.append(b.view(np.int64))
            n += len(a)
            if n > 1_000_000:
                x, y = contract(np.concatenate(kept_a), np.concatenate(kept_b))
                kept_a, kept_b, n = [x], [y], 0
                if len(x) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64())], schema=LINK_SCHEMA)
                    kept_a, kept_b = [], []
        if kept_a:
            x, y = contract(np.concatenate(kept_a), np.concatenate(kept_b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64())], schema=LINK_SCHEMA)

    return run


def _expander(batches):
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 2048):
            part = fp[at : at + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(variant_keys(part.view(np.uint64)).ravel()), pa.array(np.repeat(part, 64))], ["key", "fp"])


def links(keyed: DataFrame, bits: int, block: int = BLOCK, share: float = 0) -> DataFrame:
    """(u, v): links between distinct fingerprints that share a key, enough to connect what is connected.

    With ``share`` the rows (key, fp, size) also need sizes of at least that ratio.
    """
    near = (bits, share)
    sized = keyed.select("key", "fp", "size" if share else F.lit(0).alias("size"))
    # one sort column of longs: Spark sorts it by radix
    first = written(sized.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(near, block), LINK_TYPES), "links")
    out = first.where("key is null").select("u", "v")
    large = first.where("key is not null").select("key", F.col("u").alias("fp"), F.col("v").alias("size"))
    sizes = large.groupBy("key").agg(F.ceil(F.count("*") / F.lit(max(1, block // 2))).cast("int").alias("blocks"))
    if sizes.isEmpty():
        return out
    sizes = written(sizes, "large-keys")  # a plain shuffle for the join, which can be split
    blocked = large.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = blocked.select("fp", "size", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("fp", "size", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"))
    # a hash collision only brings more fingerprints together; every link is verified
    more = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(_pair_linker(near), LINK_TYPES)
    return out.union(more.select("u", "v"))


def _pair_linker(near: Near):
    def run(batches):
        held: list = []
        last = None

        def flush():
            fp, size = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            a, b = _connect(fp.view(np.uint64), size, near)
            x, y = contract(a.view(np.int64), b.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64())], schema=LINK_SCHEMA)

        for b in batches:
            key, fp, size = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "size"))
            cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            for s, e in itertools.pairwise(cuts.tolist()):
                if last is not None and key[s] != last:
                    yield flush()
                    held = []
                last = key[s]
                held.append((fp[s:e], size[s:e]))
        if held:
            yield flush()

    return run


def near_duplicates(docs: DataFrame, bits: int = 4, words_each: int = 4, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest doc_id that
    chains of links (at most ``bits`` differing bits, 5 at most) reach, itself included.
    A text without words, null included, has fingerprint zero and links like any other.
    Null ids are passed over when the smallest is taken; a component of null ids alone has
    a null component_id.  Repeated rows stay and share their component.  Other columns of
    ``docs`` are not read; an empty table gives an empty table.
    """
    if not 0 <= bits <= 5:
        raise ValueError("three segments with one wildcard each find at most 5 differing bits")
    marked = written(fingerprints(docs, words_each), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = components(links(distinct.select("fp").mapInArrow(_expander, "key long, fp long"), bits, block))
    rooted = written(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    # written: a plain shuffle on both sides of the join, so that a large component's rows can be split
    lowest = written(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    of_fp = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = 4, words_each: int = 4) -> DataFrame:
    """``docs`` with one document of each group: the one whose doc_id is the component's smallest.

    Decided row by row: where one id stands on several rows, each text is judged by its own
    component, and of rows under a component's smallest id the least text stays.  Repeated
    rows (same id, same text) become one row, the text null counting as empty.  Rows of null
    id stay, as no id tells them apart.  All columns of ``docs`` are kept; an empty table
    gives an empty table.
    """
    names = docs.columns
    component, mark = free_name("component", names), free_name("mark", names)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = free_name("digest", names)
    keyed = docs.where("doc_id is not null").withColumns({mark: F.xxhash64("doc_id", text), digest: F.sha2(text, 256)})
    named = docs.where("doc_id is not null").select(F.struct("doc_id", F.xxhash64("doc_id", text).alias("mark"), F.sha2(text, 256).alias("digest")).alias("doc_id"), "text")
    # components over (id, text) pairs: the smallest pair has the smallest id, then the least text by hash
    with scratch() as keep:
        chosen = near_duplicates(named, bits, words_each).where("doc_id = component_id").select("doc_id.*").distinct()
        stays = keep(written(chosen.select(F.col("doc_id").alias(component), F.col("mark").alias("of_mark"), F.col("digest").alias("of_digest")), "kept-documents"))
    # repeated rows meet where the join has put them, so texts are shuffled once
    joined = keyed.join(stays, [keyed["doc_id"] == stays[component], keyed[mark] == stays["of_mark"], keyed[digest] == stays["of_digest"]], "left_semi")
    return joined.dropDuplicates(["doc_id", mark, digest]).select(*names).unionAll(docs.where("doc_id is null"))

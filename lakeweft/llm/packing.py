"""Operator 8: best-fit packing with a distributed grouping genetic algorithm.

Documents are tokenised and cut into pieces of at most ``CAPACITY`` ids; full pieces are
sequences of their own.  The rest is dealt over blocks of about ``BLOCK`` pieces.  Within a
block pieces of equal length are interchangeable, so a solution is a list of bins of
lengths.  Every block is searched by ``ISLANDS`` tasks with seeds of their own: a
population starts from best-fit orders; crossover injects whole well-filled bins of one
parent into another, removes the bins that hold the same documents and best-fits the
displaced ones.  Between epochs the islands' elites are written to a table and each island
takes in its neighbour's.  A block is done when it meets the lower bound.  Sparse bins of
many blocks are then packed together in the same way, as each block leaves about one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweft.llm.bpe import MARKS, Memo, byte_letters
from lakeweft.llm.common import keeps, map_texts, written

CAPACITY = 4096
BLOCK = 16_384
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 3, 3, 6, 8
#: Blocks whose sparse bins are packed together, and what counts as sparse.
BLOCKS_TOGETHER, SPARSE = 256, 0.97


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    encode, merge = tok.encode, tok.model.tokenize
    letter = {b: c for c, b in byte_letters().items()}

    def make(chunk: str) -> bytes:
        """A lower-case word of letters up to U+00FF is one pre-token that no normaliser changes, so the model is asked at once."""
        if chunk.isalpha() and chunk.islower() and max(chunk) <= "\xff":
            word = chunk if chunk.isascii() else "".join(map(letter.__getitem__, chunk.encode()))
            return array("I", [t.id for t in merge(word)]).tobytes()
        return array("I", encode(chunk, add_special_tokens=False).ids).tobytes()

    memo = Memo(make, 600_000)
    return tok, memo


keeps(_tokenizer.cache_clear, __name__)

#: What ``str.split`` takes for white space and the tokenizer doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"


#: Marks behind a letter are a pre-token of their own, so a space may be put before them: fewer distinct chunks.
#: Only letters up to U+00FF count, as others may fall into a letter and a mark when normalised.
_MARKS_BEHIND = re.compile(rf"(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([{re.escape(MARKS)}]+)(?=\s|$)").sub


def ids_of(text: str, path: str) -> bytes:
    """Ids as unsigned 32-bit numbers.  The vocabulary drops white space, so each chunk between is encoded alone."""
    tok, memo = _tokenizer(path)
    if any(c in text for c in SEPARATORS):
        return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()
    if "<|" not in text:
        try:  # up to U+00FF a letter's lower case is one letter whatever its context
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return b"".join(map(memo.__getitem__, _MARKS_BEHIND(r" \1", text).split()))


def cut(texts: list[str], path: str, capacity: int, end_id: int) -> dict:
    out = []
    tail = array("I", [end_id]).tobytes()
    for t in texts:
        ids = ids_of(t, path) + tail
        out.append([{"piece": k, "start": at // 4, "length": len(x) // 4, "ids_crc32": zlib.crc32(x)} for k, at in enumerate(range(0, len(ids), 4 * capacity)) if (x := ids[at : at + 4 * capacity])])
    return {"p": out}


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each row."""
    made = map_texts(docs, lambda texts: cut(texts, path, capacity, end_id), "p array<struct<piece:int,start:long,length:long,ids_crc32:long>>", ["doc_id"])
    return made.select("doc_id", F.inline("p"))


# ---- one block, on one core -------------------------------------------------------


class Bins:
    """Bins of lengths with best-fit insertion: the open bins lie in stacks by free space."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.free = capacity, [], []
        self.stack: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def _push(self, i: int) -> None:
        f = self.free[i]
        self.stack[f].append(i)
        self.mask |= 1 << f

    def add(self, lengths: list[int]) -> None:
        self.bins.append(lengths)
        self.free.append(self.capacity - sum(lengths))
        self._push(len(self.bins) - 1)

    def insert(self, length: int) -> None:
        fits = self.mask >> length
        if not fits:
            self.add([length])
            return
        f = length + (fits & -fits).bit_length() - 1
        i = self.stack[f].pop()
        if not self.stack[f]:
            self.mask &= ~(1 << f)
        self.bins[i].append(length)
        self.free[i] = f - length
        self._push(i)


def best_fit(lengths, capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    b = Bins(capacity)
    for x in bins or []:
        b.add(list(x))
    for n in lengths:
        b.insert(n)
    return b.bins


def fitness(bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, those whose fill is the most uneven leave more room."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """``a`` with some whole well-filled bins of ``b``; the bins of ``a`` that held their documents go, what they also held is best-fitted."""
    full = [x for x in b if sum(x) >= 0.99 * capacity] or sorted(b, key=sum)[-1:]
    take = [full[i] for i in rng.permutation(len(full))[: max(1, int(len(full) * rng.uniform(0.1, 0.5)))]]
    need: dict[int, int] = {}
    for x in take:
        for n in x:
            need[n] = need.get(n, 0) + 1
    keep, displaced = [], []
    order = sorted(range(len(a)), key=lambda i: sum(a[i]))  # the emptiest bins give first
    for i in order:
        hit = False
        for n in a[i]:
            if need.get(n, 0):
                hit = True
                break
        if not hit:
            keep.append(a[i])
            continue
        for n in a[i]:
            if need.get(n, 0):
                need[n] -= 1
            else:
                displaced.append(n)
    return best_fit(sorted(displaced, reverse=True), capacity, take + keep)


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[list[list[int]]], generations: int = GENERATIONS) -> list[list[int]]:
    """The best solution of one island's epoch."""
    bound = -(-sum(lengths) // capacity)
    rng = np.random.default_rng(seed)
    down = sorted(lengths, reverse=True)
    pool = [list(e) for e in elites]
    if not pool:
        pool.append(best_fit(down, capacity))
    best = max(pool, key=lambda p: fitness(p, capacity))
    if len(best) <= bound:
        return best
    values = np.array(down)
    while len(pool) < POPULATION:
        shaken = values * (1 + rng.normal(0, 0.05 * len(pool), len(values)))
        pool.append(best_fit(values[np.argsort(-shaken)].tolist(), capacity))
    for _ in range(generations):
        i, j = rng.choice(len(pool), 2, replace=False)
        child = crossover(pool[i], pool[j], capacity, rng)
        worst = min(range(len(pool)), key=lambda k: fitness(pool[k], capacity))
        if fitness(child, capacity) > fitness(pool[worst], capacity):
            pool[worst] = child
        if len(child) <= bound:
            break
    return max(pool, key=lambda p: fitness(p, capacity))


# ---- islands ------------------------------------------------------------------------

_SOLUTION = "block long, island int, bound long, n_bins long, flat array<int>, sizes array<int>"


def _packed(bins: list[list[int]]) -> dict:
    return {"n_bins": len(bins), "flat": [n for b in bins for n in b], "sizes": [len(b) for b in bins]}


def _bins(flat, sizes) -> list[list[int]]:
    out, at = [], 0
    flat = [int(x) for x in flat]
    for k in sizes:
        out.append(flat[at : at + int(k)])
        at += int(k)
    return out


def solve(histograms: DataFrame, capacity: int) -> DataFrame:
    """(block, n_bins, flat, sizes): the best bins of each block of (block, length, n).

    A block's histogram has at most ``capacity`` rows, so a group is bounded.
    """

    def epoch(k: int):
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            block, island = int(key[0]), int(key[1])
            own = pdf[pdf["flat"].isna()]
            lengths = np.repeat(own["length"].to_numpy(np.int64), own["n"].to_numpy(np.int64)).tolist()
            elites = [_bins(f, s) for f, s in zip(pdf["flat"], pdf["sizes"], strict=True) if f is not None]
            bins = evolve(lengths, capacity, (block * 31 + island) * 31 + k, elites)
            return pd.DataFrame([{"block": block, "island": island, "bound": -(-sum(lengths) // capacity)} | _packed(bins)])

        return run

    none = "cast(null as array<int>)"
    lanes = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    start = histograms.select("block", F.lit(0).alias("island"), "length", "n", F.expr(none).alias("flat"), F.expr(none).alias("sizes"))
    done = written(start.groupBy("block", "island").applyInPandas(epoch(0), _SOLUTION), "packing")
    for k in range(1, EPOCHS + 1):
        open_blocks = done.groupBy("block").agg(F.min("n_bins").alias("least"), F.min("bound").alias("b")).where("least > b").select("block")
        if open_blocks.isEmpty():
            break
        own = histograms.join(open_blocks, "block", "left_semi").select("block", lanes, "length", "n", F.expr(none).alias("flat"), F.expr(none).alias("sizes"))
        elites = done.join(open_blocks, "block", "left_semi")
        # its own elite stays, and a neighbour's comes in; after epoch 0 there is only island 0's
        moves = elites.select("block", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))).alias("island"), F.lit(0).cast("int").alias("length"), F.lit(0).cast("long").alias("n"), "flat", "sizes")
        grown = own.unionByName(moves).groupBy("block", "island").applyInPandas(epoch(k), _SOLUTION)
        done = written(grown.unionByName(done.join(open_blocks, "block", "left_anti")), "packing")
    first = Window.partitionBy("block").orderBy("n_bins", "island")
    return done.withColumn("r", F.row_number().over(first)).where("r = 1").select("block", "n_bins", "flat", "sizes")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A null or empty text is the end id alone: one piece of length 1.  Null ids pass through
    and repeated rows are packed each for itself.  Offsets are gapless from 0 in every
    sequence.  Other columns of ``docs`` are not read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, path, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.where(F.col("length") == capacity).select(*names, (F.col("uid") + (1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // BLOCK))
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    histograms = written(dealt.groupBy("block", "length").agg(F.count("*").alias("n")).select("block", F.col("length").cast("int"), "n"), "histograms")
    bins = solve(histograms, capacity)

    slot = "block long, bin long, length int, nth long, offset long, fill long"

    def lay(batches):
        """One row for each place in a bin; nth tells places of the same length in a block apart."""
        import pyarrow as pa

        schema = pa.schema([("block", pa.int64()), ("bin", pa.int64()), ("length", pa.int32()), ("nth", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])
        for b in batches:
            for block, flat, sizes in zip(b.column("block").to_pylist(), b.column("flat").to_pylist(), b.column("sizes").to_pylist(), strict=True):
                n = np.array(flat, np.int64)
                if not len(n):
                    continue
                size = np.array(sizes, np.int64)
                which = np.repeat(np.arange(len(size)), size)
                before = np.cumsum(n) - n
                first = np.cumsum(size) - size
                fill = np.add.reduceat(n, first)
                order = np.argsort(n, kind="stable")
                s = n[order]
                starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                nth = np.empty(len(n), np.int64)
                nth[order] = np.arange(len(n)) - np.repeat(starts, np.diff(np.r_[starts, len(n)]))
                cols = [np.full(len(n), block), which, n.astype(np.int32), nth, before - before[first][which], fill[which]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    slots = written(bins.select("block", "flat", "sizes").mapInArrow(lay, slot), "slots")
    if blocks > 1:
        slots = _together(slots, capacity, lay, slot)
    else:
        slots = slots.select("block", "length", "nth", F.col("bin").alias("sequence_id"), "offset")
    mine = Window.partitionBy("block", "length").orderBy("uid")
    placed = dealt.withColumn("nth", (F.row_number().over(mine) - 1).cast("long"))
    joined = placed.join(slots.withColumn("length", F.col("length").cast("long")), ["block", "length", "nth"])
    return joined.select(*names, "sequence_id", "offset").unionByName(whole)


def _together(slots: DataFrame, capacity: int, lay, slot: str) -> DataFrame:
    """Slots after the sparse bins of every BLOCKS_TOGETHER blocks are packed anew, together.

    The new bins are used only where they are fewer; a group is split into as many parts as
    keep it within BLOCK places.
    """
    limit = int(SPARSE * capacity)
    dense = slots.where(F.col("fill") >= limit).select("block", "length", "nth", (F.col("block") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
    sparse = slots.where(F.col("fill") < limit).withColumn("set", F.floor(F.col("block") / BLOCKS_TOGETHER))
    size = sparse.groupBy("set").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"))
    sparse = written(sparse.join(size, "set").withColumn("group", F.col("set") * (1 << 20) + F.pmod(F.xxhash64("block", "bin"), F.col("parts"))).drop("set", "parts"), "sparse")
    again = solve(sparse.groupBy(F.col("group").alias("block"), "length").agg(F.count("*").alias("n")), capacity)
    had = sparse.select("group", "block", "bin").distinct().groupBy("group").agg(F.count("*").alias("had"))
    fewer = again.join(had, again["block"] == had["group"]).where("n_bins < had")
    moved = fewer.select("block", "flat", "sizes").mapInArrow(lay, slot).select(F.col("block").alias("group"), "length", F.col("nth").alias("place"), ((F.lit(1 << 60)) + F.col("block") * (1 << 24) + F.col("bin")).alias("sequence_id"), F.col("offset").alias("new_offset"))
    order = Window.partitionBy("group", "length").orderBy("block", "nth")
    ranked = sparse.withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    out = ranked.join(moved, ["group", "length", "place"], "left").select(
        "block", "length", "nth",
        F.coalesce("sequence_id", F.col("block") * (1 << 24) + F.col("bin")).alias("sequence_id"), F.coalesce("new_offset", "offset").alias("offset"),
    )
    return dense.unionByName(out)

"""Operator 5: fuzzy line dedup over the whole corpus.

Every non-blank line is normalised (lower case, one space between words).  Exact repeats
share a 128-bit hash.  For the others a line of few words is taken as its set of four-byte
runs, a longer one as its words and word pairs (between, both): they give a 64-bit SimHash,
runs or pairs give ``BANDS`` keys of a few MinHash values each.  Two lines are candidates if they share a key and
their fingerprints are at most ``BITS`` bits apart, and linked if their edit similarity,
1 - Levenshtein / longer length, is at least ``SIMILARITY``.  One occurrence of each connected
group stays, the one of the smallest (doc_id, line).  Blank lines always stay.

Each candidate pair is compared by itself, many at once, so false candidates never join lines into
groups that grow faster than the input.  Keys travel as packed arrays, one for each task and part.  The lines of a
key are compared pair by pair up to ``TOGETHER`` of them; those of a more common key are first held
against ``LEADERS`` central lines, then against the ``LEADERS`` nearest lines no link connects them with, and at last all
pairs of them that are still unconnected are compared, in pairs of blocks by as many tasks, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweft.llm.common import begin_task, free_name, keeps, map_texts, scratch, written
from lakeweft.llm.components import components, contract

BITS, SIMILARITY = 20, 0.8
#: Lines of fewer than CHARS_UNDER words are sketched by four-byte runs, lines of WORDS_FROM words or more by words; between, by both.
WORDS_FROM, CHARS_UNDER = 8, 13
#: MinHash values in a key, for runs and for word pairs, and keys of a sketch.
RUN_ROWS, PAIR_ROWS, BANDS = 3, 2, 12
#: Lines of a key of which all pairs are listed, and lines that those of a more common key are first held against.
TOGETHER, LEADERS = 16, 8
#: Lines of a key that one task compares with one another; beyond it pairs of blocks are dealt out.
BLOCK = 4096
#: Bands whose keys are shuffled at once; their shuffle files go before the next ones come.
BANDS_AT_ONCE = 4


#: An odd base of the rolling sum, its inverse modulo 2**64, and the constants of the splitmix64 mixer.
_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_UNDO = pow(_BASE, -1, 1 << 64)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_WHITE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_HASH_BITS = 40


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


keeps(_powers.cache_clear, __name__)


def _powers_to(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(16, int(n).bit_length()))[:n]


#: The bits of a byte as eight bytes of one word, and how many such words add up without overflow.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
_MOST = 255


def _bit_counts(features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``features`` how many have each of the 64 bits set.

    Eight counters lie in one word, so a run is added up in parts of at most ``_MOST``.
    """
    parts = -(-sizes // _MOST)
    first = np.cumsum(parts) - parts
    within = np.arange(int(parts.sum())) - np.repeat(first, parts)
    begins = np.repeat(np.cumsum(sizes) - sizes, parts) + within * _MOST
    octets = features.view(np.uint8).reshape(-1, 8)
    out = np.empty((len(sizes), 64), np.int64)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD.take(octets[:, k]), begins).view(np.uint8).reshape(-1, 8)
        out[:, 8 * k : 8 * k + 8] = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    return out


def _simhashes(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHashes: a bit is 1 if it is set in over half of the features."""
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return ((2 * counts > sizes[:, None]) * weights).sum(1, dtype=np.uint64)


@lru_cache(maxsize=4)
def _factors(n: int) -> list[np.uint32]:
    return [np.uint32(int(x) >> 32 | 1) for x in _mixed(np.arange(1, n + 1, dtype=np.uint64))]


def _bands(features: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
    """A key for each of ``BANDS`` groups of ``rows`` MinHash values of each run of ``features``."""
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), BANDS), np.int64)
    short, held = (features >> np.uint64(32)).astype(np.uint32), np.empty(len(features), np.uint32)
    factors = iter(_factors(BANDS * rows))
    for band in range(BANDS):
        key = np.full(len(sizes), band + 1, np.uint64)
        for _ in range(rows):
            least = np.minimum.reduceat(np.multiply(short, next(factors), out=held), first)
            key = _mixed(key * np.uint64(_BASE) + least)
        out[:, band] = key.view(np.int64)
    return out


def _distinct_features(features: np.ndarray, rank: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Each line's distinct features, and their number by line."""
    short = features >> np.uint64(64 - _HASH_BITS)
    if lines < 1 << (64 - _HASH_BITS):
        both = np.sort(rank.astype(np.uint64) << np.uint64(_HASH_BITS) | short)
        both = both[np.r_[True, both[1:] != both[:-1]]]
        distinct, rank = both & np.uint64((1 << _HASH_BITS) - 1), (both >> np.uint64(_HASH_BITS)).astype(np.int64)
    else:
        order = np.lexsort((short, rank))
        short, rank = short[order], rank[order]
        new = np.r_[True, (short[1:] != short[:-1]) | (rank[1:] != rank[:-1])]
        distinct, rank = short[new], rank[new]
    return _mixed(distinct + np.uint64(_BASE)), np.bincount(rank, minlength=lines)


def _runs_of(raw: np.ndarray, white: np.ndarray, line_no: np.ndarray, start: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of each four-byte run of the normalised bytes, a blank before each word, of the ``short`` lines."""
    used = ~white
    used[start - 1] = True
    used &= short[np.maximum(line_no, 0)]
    spots = np.flatnonzero(used)
    owner = line_no[spots]  # the end of a line counts for the next one
    byte = np.where(white[spots], 32, raw[spots]).astype(np.uint64)
    if len(byte) < 4:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = owner[3:] == owner[:-3]
    runs = byte[:-3] << np.uint64(24) | byte[1:-2] << np.uint64(16) | byte[2:-1] << np.uint64(8) | byte[3:]
    return _mixed(runs[inside] + np.uint64(1)), owner[3:][inside]


def sketched_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(non-blank lines in each text, their numbers, hashes, sizes in characters, sketches), without an object per word.

    The bytes of all texts are one array.  Word hashes are differences of a rolling sum; a
    line's two hashes are sums over its words' hashes by place.  Sketches are (place of the line,
    fingerprint, band keys), one or two for each line, in the order of lines.
    """
    raw = np.frombuffer(("\n" + "\n".join(t.lower() for t in texts)).encode("utf-8", "replace"), np.uint8)
    n = len(raw)
    per_text = np.array([t.count("\n") + 1 for t in texts], np.int64)  # lower-casing makes no line end
    white = _WHITE[raw]
    edge = np.diff(np.r_[True, white, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers_to(_BASE, n), dtype=np.uint64)]
    words = _mixed((total[end] - total[start]) * _powers_to(_UNDO, n + 1)[start] + (end - start).astype(np.uint64))
    line_no = np.cumsum(raw == 10) - 1
    of_line = line_no[start]
    count = np.bincount(of_line, minlength=int(per_text.sum()))
    wanted = np.flatnonzero(count)
    sizes = count[wanted]
    at = np.full(len(count), -1, np.int64)
    at[wanted] = np.arange(len(wanted))
    places, fps, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty((0, BANDS), np.int64)]
    hashes, chars = np.empty((0, 2), np.uint64), sizes
    if len(wanted):
        first = np.cumsum(sizes) - sizes
        begun = np.cumsum((raw & 0xC0) != 0x80)  # characters up to here
        chars = np.add.reduceat(begun[end - 1] - begun[start - 1], first) + sizes - 1
        place = np.arange(len(words)) - np.repeat(first, sizes)
        whole = lambda base: _mixed(np.add.reduceat(words * _powers_to(base, int(sizes.max()))[place], first) + sizes.astype(np.uint64))
        hashes = np.stack([whole(_BASE), whole(_OTHER_BASE)], 1)
        runs, owner = _runs_of(raw, white, line_no, start, count < CHARS_UNDER)
        if len(runs):
            lines, rank = np.unique(owner, return_inverse=True)
            runs, each = _distinct_features(runs, rank, len(lines))
            places.append(at[lines])
            fps.append(_simhashes(_bit_counts(runs, each), each))
            keys.append(_bands(runs, each, RUN_ROWS))
        lines = np.flatnonzero(count >= WORDS_FROM)
        if len(lines):
            many = count[of_line] >= WORDS_FROM
            words, of_line = words[many], of_line[many]
            inside = of_line[1:] == of_line[:-1]
            pairs = _mixed(words[:-1] * np.uint64(_OTHER_BASE) + words[1:])[inside]
            alone, each = _distinct_features(words, np.repeat(np.arange(len(lines)), count[lines]), len(lines))
            places.append(at[lines])
            fps.append(_simhashes(_bit_counts(alone, each) + _bit_counts(pairs, count[lines] - 1), each + count[lines] - 1))
            keys.append(_bands(pairs, count[lines] - 1, PAIR_ROWS))
    places, fps, keys = (np.concatenate(x) for x in (places, fps, keys))
    # a line of under three bytes has no run; its hash stands in
    bare = np.setdiff1d(np.arange(len(wanted)), places)
    places, fps = np.r_[places, bare], np.r_[fps, hashes[bare, 0]]
    keys = np.concatenate([keys, np.repeat(hashes[bare, 1].view(np.int64)[:, None], BANDS, 1)])
    order = np.argsort(places, kind="stable")
    begins = np.cumsum(per_text) - per_text
    text_of = np.searchsorted(begins, wanted, "right") - 1
    return np.bincount(text_of, minlength=len(texts)), wanted - begins[text_of], hashes, chars, (places[order], fps[order], keys[order])


#: Bytes kept of a key in a table; keys that are equal in them by chance only make more candidates.
KEY_BYTES = 4
LINES = "l array<struct<line:int,h1:long,h2:long,size:int,fp:long,other:long,keys:binary>>"


def _lines(texts: list[str]) -> dict:
    """For each text its non-blank lines: number, hash, size, fingerprints (of words, too, where runs come first) and packed keys."""
    n, numbers, hashes, sizes, (places, fps, keys) = sketched_lines(texts)
    offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
    each = np.bincount(places, minlength=len(hashes))
    first = np.cumsum(each) - each
    two = each == 2
    signed = fps.view(np.int64)
    other = pa.array(signed[np.minimum(first + 1, max(0, len(fps) - 1))] if len(fps) else signed, mask=~two)
    packed = pa.Array.from_buffers(pa.binary(), len(hashes), [None, pa.py_buffer(np.r_[0, np.cumsum(each * BANDS * KEY_BYTES)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray((keys >> 32).astype(np.int32)))])
    h1, h2 = (pa.array(np.ascontiguousarray(hashes[:, k]).view(np.int64)) for k in (0, 1))
    columns = [pa.array(numbers.astype(np.int32)), h1, h2, pa.array(sizes.astype(np.int32)), pa.array(signed[first]), other, packed]
    return {"l": pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["line", "h1", "h2", "size", "fp", "other", "keys"]))}


def _unpacked(packed: bytes) -> np.ndarray:
    """The keys of one or more sketches: a band's number above the bytes kept of its key."""
    short = np.frombuffer(packed, np.uint32).astype(np.int64).reshape(-1, BANDS)
    return (short | np.arange(BANDS, dtype=np.int64) << 32).ravel()


#: What a bucket holds of a line: four bytes of the key, size, hash and fingerprint.
ENTRY = np.dtype([("key", "<u4"), ("size", "<u4"), ("h", "<i8"), ("fp", "<u8")])
#: Entries that a task packs at once, and packed rows of a shuffle partition from each.
PACKED, PARTS_EACH = 1 << 19, 4


def _dealt(bands: range, parts: int):
    """(part, entries): packed entries of (h1, size, fp, other, keys) for the given bands; all of one key share a part, each band has ``parts``."""

    def packed(keys: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
        part = (keys % np.uint32(parts) + np.arange(len(bands), dtype=np.uint32) * np.uint32(parts)).ravel()
        order = np.argsort(part, kind="stable")
        out = np.repeat(rest, len(bands))
        out["key"] = keys.ravel()
        out, part = out[order], part[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        blobs = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * ENTRY.itemsize).astype(np.int32)), pa.py_buffer(out.view(np.uint8))])
        return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), blobs], ["part", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(__name__)
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = _unpacked(b"".join(b.column("keys").to_pylist())).reshape(-1, BANDS)[:, bands.start : bands.stop].astype(np.uint32)
            two = b.column("other").is_valid().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(b.num_rows), np.where(two, 2, 1))
            second = np.r_[False, of[1:] == of[:-1]]
            rest = np.zeros(len(of), ENTRY)
            fp = np.where(second, b.column("other").fill_null(0).to_numpy(zero_copy_only=False)[of], b.column("fp").to_numpy(zero_copy_only=False)[of])
            rest["fp"], rest["h"], rest["size"] = fp.view(np.uint64), b.column("h1").to_numpy()[of], b.column("size").to_numpy()[of]
            held.append((keys, rest))
            n += keys.size
            if n >= PACKED:
                yield packed(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
                held, n = [], 0
        if held:
            yield packed(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))

    return run


def _may_link(x: np.ndarray, y: np.ndarray, bits: int, similarity: float) -> np.ndarray:
    """Whether entries, or those of one shape broadcast to another, are near enough to be candidates."""
    least = np.minimum(x["size"], y["size"]) >= similarity * np.maximum(x["size"], y["size"]) - 1e-9
    return least & (np.bitwise_count(x["fp"] ^ y["fp"]) <= bits) & (x["h"] != y["h"])


def _paired(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (u, v), u < v, of the given ones."""
    both = [np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1)]
    u, v = np.minimum(*both), np.maximum(*both)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])][: len(u)]
    return u[new], v[new]


def _bucket_pairs(e: np.ndarray, bits: int, similarity: float, together: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(pairs, entries of keys that more than ``together`` lines have) of whole buckets."""
    e = e[np.argsort(e["key"])]
    same = e["key"][1:] == e["key"][:-1]
    e = e[np.r_[False, same] | np.r_[same, False]] if len(e) else e
    e = e[np.lexsort((e["fp"], e["h"], e["key"]))]
    e = e[np.r_[True, (e["key"][1:] != e["key"][:-1]) | (e["h"][1:] != e["h"][:-1]) | (e["fp"][1:] != e["fp"][:-1])][: len(e)]]  # exact repeats
    begins = np.flatnonzero(np.r_[True, e["key"][1:] != e["key"][:-1]][: len(e)])
    sizes = np.diff(np.r_[begins, len(e)])
    left = np.repeat(begins + sizes, sizes) - np.arange(len(e)) - 1  # lines of the key that follow
    few, out = np.repeat(sizes <= together, sizes), []
    i, off = np.flatnonzero(few & (left > 0)), 1
    while len(i):
        near = i[_may_link(e[i], e[i + off], bits, similarity)]
        out.append((e["h"][near], e["h"][near + off]))
        off += 1
        i = i[left[i] >= off]
    for s, n in zip(begins[sizes > together].tolist(), sizes[sizes > together].tolist(), strict=True):
        run = e[s : s + n]
        middle = _simhashes(_bit_counts(run["fp"].copy(), np.array([n])), np.array([n]))
        rest = run[np.argsort(np.bitwise_count(run["fp"] ^ middle), kind="stable")]  # an original is nearer to the middle than its variants
        for _ in range(LEADERS):
            if len(rest) < 2:
                break
            near = _may_link(rest[1:], rest[0], bits, similarity)
            out.append((np.full(int(near.sum()), rest["h"][0]), rest["h"][1:][near]))
            rest = rest[1:][~near]
    return out, e[~few]


PAIRS = "u long, v long, key long, size int"
PAIR_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("size", pa.int32())])


def _bucketed(bits: int, similarity: float, together: int, first_band: int, parts: int):
    """Candidate pairs (u, v, null, null) of (part, entries); a line of a common key passes as (h, fp, key, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(__name__)
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("entries").to_pylist(), strict=True):
                held.setdefault(part, []).append(np.frombuffer(blob, ENTRY))
        found = []
        for part in sorted(held):
            pairs, common = _bucket_pairs(np.concatenate(held.pop(part)), bits, similarity, together)
            found += pairs
            if len(common):
                key = common["key"].astype(np.int64) | first_band + part // parts << 32
                yield pa.RecordBatch.from_arrays([pa.array(common["h"]), pa.array(common["fp"].view(np.int64)), pa.array(key), pa.array(common["size"].astype(np.int32))], schema=PAIR_SCHEMA)
        u, v = _paired(found)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int32())], schema=PAIR_SCHEMA)

    return run


#: Comparisons of fingerprints made at once.
AT_ONCE = 1 << 20


def _unlinked_pairs(run: np.ndarray, label: np.ndarray, bits: int, similarity: float, nearest: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of different labels among the lines of a key; of each line with the ``nearest`` such lines alone if given."""
    names, kind, count = np.unique(label, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    order = np.argsort(kind == np.argmax(count), kind="stable")  # lines of the commonest label last: they meet the others alone
    run, kind = run[order], kind[order]
    others, step, out = len(run) - int(count.max()), max(1, AT_ONCE // len(run)), []
    for s in range(0, others, step):
        part = slice(s, min(others, s + step))
        near = _may_link(run[part, None], run[None, :], bits, similarity) & (kind[part, None] != kind[None, :])
        if nearest is not None:
            far = np.where(near, np.bitwise_count(run["fp"][part, None] ^ run["fp"][None, :]), 255)
            if far.shape[1] > nearest:
                some = np.argpartition(far, nearest - 1, axis=1)[:, :nearest]
                only = np.zeros_like(near)
                np.put_along_axis(only, some, True, axis=1)
                near &= only
        x, y = np.nonzero(near)
        out.append((run["h"][x + s], run["h"][y]))
    return out


def _unlinked(bits: int, similarity: float, nearest: int | None):
    """Candidate pairs (u, v) that no link connects, from sorted rows (key, h, fp, size, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(__name__)
        held, last, found = [], None, []

        def close() -> None:
            if held:
                e, label, known = (np.concatenate([x[k] for x in held]) for k in (0, 1, 2))
                label[~known] = np.arange(len(e))[~known]
                names = np.unique(np.stack([label, known], 1), axis=0, return_inverse=True)[1].ravel()
                found.extend(_unlinked_pairs(e, names, bits, similarity, nearest))
                held.clear()

        for b in batches:
            key = b.column("key").to_numpy()
            e = np.zeros(b.num_rows, ENTRY)
            e["h"], e["fp"], e["size"] = b.column("h").to_numpy(), b.column("fp").to_numpy().view(np.uint64), b.column("size").to_numpy()
            known, label = b.column("label").is_valid().to_numpy(zero_copy_only=False), b.column("label").fill_null(0).to_numpy(zero_copy_only=False).copy()
            cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)]), len(key)]
            for s, t in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if key[s] != last:
                    close()
                    last = key[s]
                held.append((e[s:t], label[s:t], known[s:t]))
        close()
        u, v = _paired(found)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def normalised(line: str) -> str:
    return b" ".join(line.lower().encode("utf-8", "replace").split()).decode()


def _word_for_word(a: str, b: str) -> float:
    """Edits that make each word the other line's, infinite for unequal numbers of words; never less than the distance."""
    x, y = a.split(" "), b.split(" ")
    return sum(max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q) if len(x) == len(y) else float("inf")


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance is at most ``most``."""
    if a == b:
        return most >= 0
    if abs(len(a) - len(b)) > most:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if max(len(a), len(b)) <= most:
        return True
    if _word_for_word(a, b) <= most:
        return True
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b) <= most
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) & 1023 for s in (a, b))
    gap = np.bincount(x, minlength=1024) - np.bincount(y, minlength=1024)
    if max(gap[gap > 0].sum(), -gap[gap < 0].sum()) > most:
        return False
    return _levenshtein(a, b, most) <= most


def _levenshtein(a: str, b: str, most: int) -> int:
    """Bit-parallel distance (Myers 1999, Hyyro 2003), one long integer for a column; some number over ``most`` where it is over that."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score, hope = full, 0, len(a), len(a) - len(b)
    for c in b:
        if hope > most:
            return hope
        eq = at.get(c, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp = minus | (full & ~(d0 | plus))
        hn = d0 & plus
        step = bool(hp & top) - bool(hn & top)
        score += step
        hope += step + 1  # the distance falls by one at most with each character left
        hp = (hp << 1 | 1) & full
        hn = (hn << 1) & full
        plus = hn | (full & ~(d0 | hp))
        minus = hp & d0
    return score


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    return distance_within(a, b, int((1 - similarity) * longer + 1e-9))


#: Counters of a line's three-character runs.
GRAMS = 1024


class _Grams:
    """Counted three-character runs of lines, made when a line is first asked for.

    An edit takes at most three runs from either line, so two lines that share fewer are refuted
    without comparing them.  Runs of one counter and counts over 255 only make more seem shared.
    """

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.rows = texts, np.zeros((len(texts), GRAMS), np.uint8)
        self.sums = np.full(len(texts), -1, np.int64)

    def _make(self, i: int) -> None:
        code = np.frombuffer(self.texts[i].encode("utf-32-le"), np.uint32).astype(np.uint64)
        if len(code) > 2:
            runs = _mixed((code[:-2] << np.uint64(42)) + (code[1:-1] << np.uint64(21)) + code[2:])
            self.rows[i] = np.minimum(np.bincount((runs % np.uint64(GRAMS)).astype(np.int64), minlength=GRAMS), 255)
        self.sums[i] = self.rows[i].sum(dtype=np.int64)

    def may(self, x: int, places: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether line ``x`` may be within ``most`` edits of each of ``places``."""
        for i in (x, *places[self.sums[places] < 0].tolist()):
            if self.sums[i] < 0:
                self._make(i)
        shared = np.minimum(self.rows[places], self.rows[x]).sum(1, dtype=np.int64)
        return np.maximum(self.sums[places], self.sums[x]) - shared <= 3 * most


#: Longest line compared many at once; steps between two looks at which pairs are decided; cells of a table of characters.
LONGEST, LOOK, TABLE = 4096, 32, 1 << 20


def _padded(codes: np.ndarray, at: np.ndarray, step: int, width: int, last: int) -> np.ndarray:
    return codes[np.clip(at[:, None] + step * np.arange(width), 0, last)]


def _distances_within(patterns: list[np.ndarray], texts: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Whether the Levenshtein distance of each pattern and text, not shorter, is at most ``most``.

    ``_levenshtein`` for many pairs at once: the 64-bit words of all columns stand in one array, each a text
    character behind the word before it, whose carry it takes.  A pair whose distance must be over ``most`` goes early.
    """
    m, n = np.array([len(p) for p in patterns]), np.array([len(t) for t in texts])
    words = -(-m // 64)
    start, total = np.cumsum(words) - words, int(words.sum())
    pair = np.repeat(np.arange(len(m)), words)
    late = np.arange(total) - start[pair]
    flat, of = np.concatenate(patterns), np.repeat(np.arange(len(m)), m)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(m) - m, m)
    known, rank = np.unique(flat, return_inverse=True)
    table = np.zeros((len(known) + 1) * total, np.uint64)  # at last: a character of no pattern
    np.add.at(table, rank * total + start[of] + place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
    flat = np.concatenate(texts)
    rank = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    rows = np.where(known[rank] == flat, rank, len(known)) * total
    at = (np.cumsum(n) - n)[pair] - late
    one, high, full = np.uint64(1), np.uint64(63), ~np.uint64(0)
    out, live, column = np.zeros(len(m), bool), np.arange(len(m)), np.arange(total)
    plus, minus, up, down = np.full(total, full), np.zeros(total, np.uint64), np.zeros(total, np.uint64), np.zeros(total, np.uint64)
    lead, top, bit, score, left = late == 0, start + words - 1, ((m - 1) % 64).astype(np.uint64), m.copy(), n + words - 1
    skew, widest = words - 1, int(words.max())
    for t in range(int(left.max())):
        eq = table.take(rows.take(at, mode="clip") + column)
        at += 1
        up[1:], down[1:] = up[:-1].copy(), down[:-1].copy()
        up[lead], down[lead] = one, 0
        xv = eq | minus
        eq |= down
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp, hn = minus | ~(xh | plus), plus & xh
        score += np.where(skew <= t, (hp[top] >> bit & one).astype(np.int64) - (hn[top] >> bit & one).astype(np.int64), 0)
        one_up, one_down = hp << one | up, hn << one | down
        up, down = hp >> high, hn >> high
        plus, minus = one_down | ~(xv | one_up), one_up & xv
        if t < widest - 1:  # words whose text has not begun
            still = late > t
            plus[still], minus[still], up[still], down[still] = full, 0, 0, 0
        ended = left == t + 1
        if ended.any():
            out[live[ended]] = score[ended] <= most[live[ended]]
        if t % LOOK == LOOK - 1:
            on = (left > t + 1) & (score - (left - t - 1) <= most[live])  # the distance falls by one at most with each character left
            if not on.any():
                break
            if 4 * int(on.sum()) < 3 * len(on):
                stay = on[np.repeat(np.arange(len(on)), words)]
                plus, minus, up, down, at, column, late, lead = (x[stay] for x in (plus, minus, up, down, at, column, late, lead))
                live, words, bit, score, left, skew = (x[on] for x in (live, words, bit, score, left, skew))
                top = np.cumsum(words) - 1
    return out


def similar_rows(a: list[str], b: list[str], similarity: float = SIMILARITY) -> np.ndarray:
    """``similar`` of each line of ``a`` and that of ``b``, many pairs at once."""
    sizes = np.array([[len(x) for x in a], [len(x) for x in b]], np.int64).reshape(2, -1)
    most = ((1 - similarity) * sizes.max(0) + 1e-9).astype(np.int64)
    out = np.zeros(len(a), bool)
    todo = np.abs(sizes[0] - sizes[1]) <= most
    long = np.flatnonzero(todo & (sizes.max(0) > LONGEST))
    for k in long.tolist():
        grams = _Grams([a[k], b[k]])
        out[k] = grams.may(0, np.array([1]), most[k : k + 1])[0] and similar(a[k], b[k], similarity)
    todo[long] = False
    order = np.flatnonzero(todo)
    order = order[np.argsort(sizes.max(0)[order], kind="stable")]
    while len(order):
        width = int(sizes.max(0)[order[min(len(order), 4096) - 1]])
        now, order = order[:4096], order[4096:]
        some = [[side[k] for k in now.tolist()] for side in (a, b)]
        codes = [np.frombuffer("".join(x).encode("utf-32-le"), np.uint32) for x in some]
        size = sizes[:, now]
        at = np.cumsum(size, axis=1) - size
        less = size.min(0)
        if not all(map(len, codes)):
            out[now] = size.max(0) <= most[now]
            continue
        spots = np.arange(width)
        alike = lambda begin, step: np.argmin(np.c_[(_padded(codes[0], begin[0], step, width, len(codes[0]) - 1) == _padded(codes[1], begin[1], step, width, len(codes[1]) - 1)) & (spots < less[:, None]), np.zeros(len(now), bool)], axis=1)  # noqa: E731, B023
        head = alike(at, 1)
        tail = np.minimum(alike(at + size - 1, -1), less - head)
        left = size - head - tail
        out[now] = left.max(0) <= most[now]
        hard = np.flatnonzero(~out[now] & (left.min(0) > 0))
        easy = np.array([_word_for_word(some[0][k], some[1][k]) <= most[now[k]] for k in hard.tolist()], bool)
        out[now[hard[easy]]] = True
        hard = hard[~easy]
        first = np.argmin(left[:, hard], axis=0)
        cut = lambda side, k: codes[side][at[side, k] + head[k] : at[side, k] + head[k] + left[side, k]]  # noqa: E731, B023
        words = np.cumsum(-(-left.min(0)[hard] // 64))
        for part in np.split(np.arange(len(hard)), np.flatnonzero(np.diff(words // max(1, TABLE // (1 + len(np.unique(codes[0])))))) + 1):
            some = hard[part].tolist()
            if len(some) < 8:
                out[now[some]] = [similar(a[k], b[k], similarity) for k in now[some].tolist()]
                continue
            side = first[part].tolist()
            out[now[some]] = _distances_within([cut(i, k) for i, k in zip(side, some, strict=True)], [cut(1 - i, k) for i, k in zip(side, some, strict=True)], most[now[some]])
    return out


def _verifier(similarity: float):
    """Links (u, v) of the rows (u, v, a, b) whose texts are similar, contracted to stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(__name__)
        for b in batches:
            yes = similar_rows(b.column("a").to_pylist(), b.column("b").to_pylist(), similarity)
            x, y = contract(b.column("u").to_numpy()[yes], b.column("v").to_numpy()[yes])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])

    return run


#: A side of a join is broadcast up to this many entries of at most 40 bytes; beyond it both sides are shuffled.
BROADCAST_ENTRIES = 500_000


def _sized(side: DataFrame, entries: int | None = None) -> DataFrame:
    """A written table, broadcast if its counted size allows."""
    return F.broadcast(side) if (side.count() if entries is None else entries) <= BROADCAST_ENTRIES else side


def _row(names: tuple[str, str] = ("row", "row2")) -> list:
    """128 bits that tell a row by its id and text."""
    return [F.xxhash64("doc_id", "text").alias(names[0]), F.xxhash64("text", "doc_id").alias(names[1])]


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, h, text): the normalised lines of ``wanted`` (row, row2, line, id, h), read from their documents."""
    by_row = written(wanted.groupBy("row", "row2").agg(F.collect_list(F.struct("line", "id", "h")).alias("w")), "wanted-lines")
    entries = by_row.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    joined = docs.select(*_row(), "text").join(_sized(by_row, entries), ["row", "row2"]).select("text", "w")

    def run(batches):
        for b in batches:
            rows = []
            for t, w in zip(b.column("text").to_pylist(), b.column("w").to_pylist(), strict=True):
                lines = (t or "").split("\n")
                rows += [(x["id"], x["h"], normalised(lines[x["line"]])) for x in w]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["id", "h", "text"])

    return joined.mapInArrow(run, "id long, h long, text string").dropDuplicates(["id"])


def _similar_pairs(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(links (u, v) by id, names (id, h)) of the written candidate ``pairs`` (u, v) by hash; every pair is compared."""
    ends = written(pairs.select(F.explode(F.array("u", "v")).alias("h")).distinct(), "paired-lines")
    wanted = distinct.join(_sized(ends), distinct["h1"] == ends["h"], "left_semi").select("row", "row2", "line", "id", F.col("h1").alias("h"))
    texts = written(_texts_of(docs, wanted), "line-texts")
    one, other = (texts.select(F.col("h").alias(e), F.col("id").alias(f"{e}_id"), F.col("text").alias(t)) for e, t in (("u", "a"), ("v", "b")))
    both = pairs.join(one, "u").join(other, "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v"), "a", "b")
    return written(both.mapInArrow(_verifier(similarity), "u long, v long"), "similar-lines"), texts.select("id", "h")


#: Links that one task contracts at once (16 bytes each); beyond it the distributed steps do.
LINKS_AT_ONCE = 1_000_000


def _groups(links: DataFrame) -> DataFrame:
    """``components`` of written ``links``, without its steps where their counted number allows."""
    if links.count() > LINKS_AT_ONCE:
        return components(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in contract(*(np.concatenate([f[k] for f in found]) for k in (0, 1)))], ["node", "root"])

    return written(links.coalesce(1).mapInArrow(run, "node long, root long"), "line-components")


def fuzzy_groups(docs: DataFrame, lines: DataFrame, distinct: DataFrame, bits: int = BITS, similarity: float = SIMILARITY, together: int = TOGETHER) -> DataFrame:
    """(id, root) for the lines that link to another.

    ``lines`` has the sketches (h1, size, fp, other, keys), repeats included; ``distinct`` (id, h1, row, row2, line) the place of one occurrence.
    """
    parts = -(-PARTS_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BANDS_AT_ONCE)
    sketches, found = lines.select("h1", "size", "fp", "other", "keys"), None
    for first in range(0, BANDS, BANDS_AT_ONCE):
        packed = sketches.mapInArrow(_dealt(range(first, min(BANDS, first + BANDS_AT_ONCE)), parts), "part int, entries binary")
        part = written(packed.repartition("part").mapInArrow(_bucketed(bits, similarity, together, first, parts), PAIRS), "bucket-pairs")
        found = part if found is None else found.unionAll(part)
    pairs = written(found.where("key is null").select("u", "v").distinct(), "line-pairs")
    links, names = _similar_pairs(docs, distinct, pairs, similarity)
    common = found.where("key is not null").select(F.col("u").alias("h"), F.col("v").alias("fp"), "key", "size")
    if common.isEmpty():
        return _groups(links).select(F.col("node").alias("id"), "root")
    blocks = common.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")).where("blocks > 1")
    blocks = written(blocks.withColumnRenamed("key", "of"), "large-keys")
    for nearest in (LEADERS, None):
        near = _groups(links)
        roots = near.unionAll(near.select(F.col("root").alias("node"), "root")).distinct()
        labels = written(names.join(roots, F.col("id") == F.col("node")).select(F.col("h").alias("named"), F.col("root").alias("label")), "line-labels")
        dealt = common.join(_sized(labels), F.col("h") == F.col("named"), "left").join(_sized(blocks), F.col("key") == F.col("of"), "left").select("key", "h", "fp", "size", "label", F.coalesce("blocks", F.lit(1)).alias("blocks"))
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("h"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # a hash collision only brings more lines together
        key = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
        dealt = dealt.select(key.alias("key"), "h", "fp", "size", "label").repartition("key").sortWithinPartitions("key")
        more = dealt.mapInArrow(_unlinked(bits, similarity, nearest), "u long, v long").distinct().join(pairs, ["u", "v"], "left_anti")
        more = written(more, "line-pairs")
        new, others = _similar_pairs(docs, distinct, more, similarity)
        pairs, links, names = pairs.unionAll(more), links.unionAll(new), names.unionAll(others).distinct()
    return _groups(links).select(F.col("node").alias("id"), "root")


def repeated_lines(docs: DataFrame, bits: int = BITS, similarity: float = SIMILARITY, together: int = TOGETHER) -> DataFrame:
    """(row, row2, drop): for each document that loses lines, its key and the numbers (from 0) of those lines.

    The key is 128 bits of id and text, so exactly repeated rows are one document.
    """
    keyed = docs.select("doc_id", *_row(), "text")
    lines = written(map_texts(keyed, _lines, LINES, ["doc_id", "row", "row2"]).select("doc_id", "row", "row2", F.inline("l")), "lines")
    place = F.struct("doc_id", "row", "row2", "line")
    distinct = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    distinct = written(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-lines")
    with scratch() as keep:
        roots = fuzzy_groups(docs, lines, distinct.select("id", "h1", "first.row", "first.row2", "first.line"), bits, similarity, together)
        roots = keep(written(roots.unionAll(roots.select(F.col("root").alias("id"), "root")).distinct().withColumnRenamed("id", "node"), "line-roots"))
    places = distinct.select("id", "h1", "h2", "first", (F.col("first") != F.col("last")).alias("again"))
    shared = places.join(_sized(roots), F.col("id") == F.col("node"), "left").where("root is not null or again").select("h1", "h2", F.coalesce("root", "id").alias("root"), "first")
    shared = written(shared, "shared-lines")
    kept = written(shared.groupBy("root").agg(F.min("first").alias("kept")), "kept-places")  # a plain shuffle for the join, which can be split
    of_hash = written(shared.join(kept, "root").select("h1", "h2", "kept"), "kept-lines")
    gone = lines.select("row", "row2", "line", "h1", "h2", place.alias("here")).join(_sized(of_hash), ["h1", "h2"]).where(~F.col("here").eqNullSafe(F.col("kept")))
    return gone.groupBy("row", "row2").agg(F.collect_set("line").alias("drop"))


def without_lines(text: str | None, drop: list[int]) -> str | None:
    gone = set(drop)
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)


def line_dedup(docs: DataFrame, bits: int = BITS, similarity: float = SIMILARITY, together: int = TOGETHER) -> DataFrame:
    """``docs`` with every repeated line taken out but for one occurrence in the corpus, all rows and columns kept.

    A null or empty text stays as it is.  Of a group of lines the occurrence of the smallest
    (doc_id, line number) stays; a null id is the smallest.  Exactly repeated rows are one
    document: they lose the same lines.  A ``n_chars`` column of documents is not recounted here.
    """
    names = docs.columns
    row, row2, drop = (free_name(x, names) for x in ("row", "other", "drop"))
    with scratch() as keep:
        drops = keep(written(repeated_lines(docs, bits, similarity, together).withColumnsRenamed({"row": row, "row2": row2, "drop": drop}), "dropped-lines"))
    entries = drops.agg(F.coalesce(F.sum(F.size(drop) + 4), F.lit(0))).first()[0] // 4
    joined = docs.select("*", *_row((row, row2))).join(_sized(drops, entries), [row, row2], "left")

    def run(batches):
        for b in batches:
            texts, gone = b.column("text").to_pylist(), b.column(drop).to_pylist()
            made = [without_lines(t, d) if d and t else t for t, d in zip(texts, gone, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if n == "text" else b.column(n) for n in names], names)

    return joined.select(*names, drop).mapInArrow(run, docs.schema)


def line_report(docs: DataFrame, bits: int = BITS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_lines, n_left, text_sha256): what ``line_dedup`` leaves of each row, as counts and a digest."""
    out = line_dedup(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).cast("long").alias("n_lines")), bits, similarity)
    left = F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return out.select("doc_id", "n_lines", left.alias("n_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))

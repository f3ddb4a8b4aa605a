import itertools
import random

import fixtures
import numpy as np
import pytest
import regex
import xxhash

from lakeweft.llm import components, line_dedup, simhash


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = regex.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    r = roots(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    low: dict = {}
    for (i, _), x in zip(rows, r, strict=True):
        if i is not None:
            low[x] = min(i, low.get(x, i))
    return sorted(((i, f"{f:016x}", low.get(x)) for (i, _), f, x in zip(rows, fps, r, strict=True)), key=str)


def test_simhash_odd_rows(spark):
    got = sorted(map(tuple, simhash.near_duplicates(fixtures.odd(spark)).collect()), key=str)
    assert got == brute_components([(r[0], r[1]) for r in fixtures.odd_rows()])
    assert simhash.near_duplicates(fixtures.empty(spark)).count() == 0


@pytest.mark.parametrize("block", [4096, 8])
def test_simhash_corpus(spark, block):
    docs = fixtures.corpus(300)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(map(tuple, simhash.near_duplicates(frame, block=block).collect()), key=str)
    assert got == brute_components(docs)


@pytest.mark.parametrize("block", [4096, 16])
def test_links_of_a_tight_ball(spark, block):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 250:
        x = rng.choice(sorted(fps)[:40])
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    keyed = spark.createDataFrame([(x,) for x in signed], "fp long").mapInArrow(simhash._expander, "key long, fp long")
    found = {tuple(r) for r in components.components(simhash.links(keyed, 4, block)).collect()}
    want = roots(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    groups: dict = {}
    for s, r in zip(signed, want, strict=True):
        groups.setdefault(r, []).append(s)
    assert found == {(s, min(g)) for g in groups.values() for s in g if s != min(g)}


def test_keep_one(spark):
    rows = fixtures.odd_rows()
    kept = simhash.keep_one(fixtures.odd(spark))
    assert kept.columns == fixtures.odd(spark).columns
    comp = dict((i, c) for i, _, c in brute_components([(r[0], r[1]) for r in rows]) if i is not None)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, c in comp.items() if i == c)
    assert sum(r["doc_id"] is None for r in kept.collect()) == 2
    assert simhash.keep_one(fixtures.empty(spark)).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(500, x) for x in range(501, 900)] + [(7, 7), (3, 2)]
    rng.shuffle(links)
    got = {tuple(r) for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(1, 201)} | {(x, 500) for x in range(501, 900)}
    a, b = components.contract(np.array([5, 3, 9]), np.array([3, 1, 9]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(3, 1), (5, 1)]


# ---- lines ---------------------------------------------------------------------------------


def brute_lines(rows, bits=line_dedup.BITS, similarity=0.8):
    """Texts after line dedup, by comparing every line with every line."""
    entries = []
    docs = {(i, t) for i, t in rows}
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            if line.lower().encode().split():
                entries.append((i, t, k, line_dedup.normalised(line)))
    texts = sorted({e[3] for e in entries})
    fps = [int(line_dedup.sketched_lines([x])[4][1][0]) for x in texts]

    def lev(a, b):
        p = list(range(len(b) + 1))
        for x, c in enumerate(a, 1):
            q = [x]
            for y, d in enumerate(b, 1):
                q.append(min(p[y] + 1, q[-1] + 1, p[y - 1] + (c != d)))
            p = q
        return p[-1]

    near = [(x, y) for x, y in itertools.combinations(range(len(texts)), 2) if (fps[x] ^ fps[y]).bit_count() <= bits]
    group = dict(zip(texts, roots(len(texts), [(x, y) for x, y in near if 1 - lev(texts[x], texts[y]) / max(len(texts[x]), len(texts[y])) >= similarity - 1e-9]), strict=True))
    first: dict = {}
    for i, t, k, line in entries:
        g = group[line]
        place = (i is not None, i if i is not None else 0, k)
        if g not in first or place < first[g][:3]:
            first[g] = (*place, t)
    out = []
    for i, t in rows:
        if not t:
            out.append((i, t))
            continue
        kept = []
        for k, line in enumerate(t.split("\n")):
            n = line_dedup.normalised(line)
            g = group.get(n) if line.lower().encode().split() else None
            if g is None or first[g] == (i is not None, i if i is not None else 0, k, t):
                kept.append(line)
        out.append((i, "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("together", [512, 3])
def test_line_dedup_corpus(spark, together):
    docs = fixtures.corpus(160)
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), together=together)
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines(docs)


def test_line_dedup_odd_rows(spark):
    rows = [r for r in fixtures.odd_rows() if r[0] not in (8, 9)]
    frame = spark.createDataFrame(rows, fixtures.SCHEMA)
    got = line_dedup.line_dedup(frame)
    assert got.columns == frame.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == brute_lines([(r[0], r[1]) for r in rows])
    assert line_dedup.line_dedup(fixtures.empty(spark)).count() == 0
    report = line_dedup.line_report(fixtures.odd(spark))
    assert report.count() == len(fixtures.odd_rows())


def test_short_similar_lines_are_found(spark):
    """Recall against plain edit similarity, with no limit on fingerprints."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))
    pairs = []
    while len(pairs) < 300:
        words = [word() for _ in range(rng.choice((4, 5, 6, 7, 9, 12, 20)))]
        other = list(words)
        for _ in range(max(1, len(words) // 8)):
            other[rng.randrange(len(other))] = word()
        a, b = " ".join(words), " ".join(other)
        if a != b and line_dedup.similar(a, b):
            pairs.append((a, b))
    docs = [(2 * i + k, line) for i, pair in enumerate(pairs) for k, line in enumerate(pair)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert all(got[2 * i] == a for i, (a, _) in enumerate(pairs))
    assert sum(got[2 * i + 1] == "" for i in range(len(pairs))) >= 0.97 * len(pairs)


def test_exact_repeats_of_few_words_go(spark):
    docs = [(1, "Read more\nx"), (2, "read  MORE\n\ny"), (3, "漢字" * 40 + "\nx")] + [(4, "漢字" * 40 + "\nOK")]
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, "Read more\nx"), (2, "\ny"), (3, "漢字" * 40), (4, "OK")]


def test_edit_distance_bound():
    rng = random.Random(6)

    def lev(a, b):
        p = list(range(len(b) + 1))
        for x, c in enumerate(a, 1):
            q = [x]
            for y, d in enumerate(b, 1):
                q.append(min(p[y] + 1, q[-1] + 1, p[y - 1] + (c != d)))
            p = q
        return p[-1]

    for _ in range(800):
        a = "".join(rng.choice("abc é") for _ in range(rng.randint(0, 30)))
        b = "".join(rng.choice("abc é") if rng.random() < 0.2 else c for c in a)[rng.randint(0, 2) :]
        for most in (0, 1, 3, 7):
            assert line_dedup.distance_within(a, b, most) == (lev(a, b) <= most)


def test_variant_keys_meet():
    rng = random.Random(9)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 5)):
            y ^= 1 << b
        keys = simhash.variant_keys(np.array([x, y], np.uint64))
        assert (keys[0] == keys[1]).any()


def test_shared_runs_refute_no_similar_line():
    rng = random.Random(12)
    texts = ["", "a", "ab"]
    for _ in range(40):
        a = "".join(rng.choice("abcde é漢🙂") for _ in range(rng.randint(0, 300)))
        texts += [a, "".join(rng.choice("abcde é漢🙂") + c if rng.random() < 0.1 else "" if rng.random() < 0.05 else c for c in a), a * 6]
    grams, refuted = line_dedup._Grams(texts), 0
    places = np.arange(len(texts))
    for x in range(len(texts)):
        most = np.array([int(0.2 * max(len(texts[x]), len(t)) + 1e-9) for t in texts])
        for y, may in enumerate(grams.may(x, places, most).tolist()):
            refuted += not may
            assert may or not line_dedup.similar(texts[x], texts[y])
    assert refuted > 1000


def left_behind(spark, run):
    """Labels of the tables that ``run`` leaves in the shared folder."""
    from pathlib import Path

    from lakeweft.llm import common

    shared = Path(common.shared_folder(spark).removeprefix("file:")) / "lakeweft"
    before = set(shared.iterdir()) if shared.exists() else set()
    run()
    return sorted(p.name.rpartition("-")[0] for p in set(shared.iterdir()) - before)


def test_dedup_deletes_its_tables(spark):
    frame = spark.createDataFrame(fixtures.corpus(40), "doc_id bigint, text string")
    assert left_behind(spark, lambda: line_dedup.line_dedup(frame, together=4).count()) == ["dropped-lines"]
    assert left_behind(spark, lambda: simhash.keep_one(frame).count()) == ["kept-documents"]


def test_written_tables_leave_no_shuffle_files(spark):
    from lakeweft.llm.common import SHUFFLE_CLEANUP, written

    frame, status = spark.range(1000).repartition(7, "id"), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before, held = spark.conf.get(SHUFFLE_CLEANUP), status.size()
    assert written(frame, "shuffled").count() == 1000
    assert status.size() <= held + 1  # that of the count
    assert spark.conf.get(SHUFFLE_CLEANUP) == before


def test_packed_keys_tell_bands_apart():
    keys = np.arange(2 * line_dedup.BANDS, dtype=np.uint32) % 3
    got = line_dedup._unpacked(keys.tobytes())
    assert len(got) == len(keys) and (got & 0xFFFFFFFF).tolist() == keys.tolist()
    assert (got >> 32).tolist() == [*range(line_dedup.BANDS)] * 2


def test_many_pairs_at_once_are_as_similar_as_one_by_one():
    rng = random.Random(4)
    a, b = ["", "", "ab", "x" * 5000], ["", "a", "ba", "x" * 4000 + "y" * 1000]
    for _ in range(400):
        x = "".join(rng.choice("abcde é漢🙂") for _ in range(rng.choice((1, 5, 63, 64, 65, 130, 400))))
        rate = rng.choice((0.02, 0.15, 0.25, 0.6))
        a.append(x)
        b.append("".join(rng.choice(("", c + "z", rng.choice("abcde é漢🙂"))) if rng.random() < rate else c for c in x))
    got = line_dedup.similar_rows(a, b).tolist()
    assert got == [line_dedup.similar(x, y) for x, y in zip(a, b, strict=True)] and 100 < sum(got) < 350


def test_false_candidates_join_no_lines_into_a_group():
    """A common key's lines in two groups, with near fingerprints: pairs within a group are linked once, those between are left."""
    base = (1 << 64) - 1
    entries = np.zeros(60, line_dedup.ENTRY)
    entries["h"], entries["size"], entries["key"] = np.arange(60), 100, 7
    entries["fp"] = [base ^ (1 << (k % 5)) ^ (k % 2 << 40) for k in range(60)]
    pairs, common = line_dedup._bucket_pairs(entries, 20, 0.8, 16)
    assert len(common) == 60 and sum(len(u) for u, _ in pairs) == 59  # not 60 * 59 / 2
    label = np.arange(60) % 2
    u, v = line_dedup._paired(line_dedup._unlinked_pairs(common, label[common["h"]], 20, 0.8, None))
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == sorted((min(x, y), max(x, y)) for x in range(0, 60, 2) for y in range(1, 60, 2))
    assert line_dedup._unlinked_pairs(common, np.zeros(60, np.int64), 20, 0.8, None) == []

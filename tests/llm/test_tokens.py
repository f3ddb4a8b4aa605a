import hashlib
import random
import zlib
from array import array

import fixtures
import pytest
from tokenizers import Tokenizer

from lakeweft.llm import bpe, bpe_codec, packing, token_counts
from lakeweft.llm.queries import vocabulary

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def noise(seed, n):
    rng = random.Random(seed)
    letters = [chr(c) for c in [*range(0x250), 0x301, 0x3A3, 0x660, 0x2028, 0x3000, 0x4E2D, 0x1F600]] + [" "] * 60 + ["\n"] * 9 + list("abcdeABC's.,!#1") * 6 + ["<|endoftext|>", "<|startoftext|>"] * 3
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_encoding_is_the_librarys(library):
    model = bpe.load(BYTES)
    for t in noise(1, 3000):
        ids = library[0].encode(t, add_special_tokens=False).ids
        assert model.encode(t) == ids
        assert model.decode(ids) == library[0].decode(ids, skip_special_tokens=False)
        assert packing.ids_of(t, WORDS) == array("I", library[1].encode(t, add_special_tokens=False).ids).tobytes()
    assert token_counts.count_tokens(noise(2, 500), BYTES) == [len(library[0].encode(t, add_special_tokens=False).ids) for t in noise(2, 500)]


def test_long_words_merge_in_the_same_order(library):
    rng = random.Random(4)
    for w in ["a" * 700, "ab" * 900, "".join(rng.choice("etaoin") for _ in range(3000))]:
        assert bpe.load(BYTES).encode(w) == library[0].encode(w, add_special_tokens=False).ids


def test_whole_tokens_are_proved():
    model = bpe.load(BYTES)
    assert all(model.merge_word(b) == [i] for b, i in list(model.whole.items())[::97])


def test_counts_on_odd_rows(spark, library):
    got = token_counts.token_counts(fixtures.odd(spark), BYTES, 100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(((r[0], len((r[1] or "").encode()), len(library[0].encode(r[1] or "", add_special_tokens=False).ids)) for r in fixtures.odd_rows()), key=str)
    assert sorted(((r[0], r[1], r[2]) for r in got.collect()), key=str) == want
    assert all(r[3] == (r[2] > 100) for r in got.collect())
    assert token_counts.token_counts(fixtures.empty(spark), BYTES).count() == 0


def test_codec_on_odd_rows(spark, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in fixtures.odd_rows():
        ids = library[0].encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(library[0].decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe_codec.codec_digests(fixtures.odd(spark), BYTES).collect()), key=str) == sorted(want, key=str)
    back = bpe_codec.decode(bpe_codec.encode(fixtures.odd(spark), BYTES), BYTES)
    assert sorted((str(r[0]), r[1]) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in fixtures.odd_rows())
    assert bpe_codec.codec_digests(fixtures.empty(spark), BYTES).count() == 0


def check_packed(rows, texts, library, capacity):
    want = []
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, at, len(x), zlib.crc32(array("I", x).tobytes())) for k, at in enumerate(range(0, len(ids), capacity)) if (x := ids[at : at + capacity])]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(w[3] for w in want)
    return len(bins), -(-total // capacity)


def test_packing_odd_rows(spark, library):
    rows = packing.pack(fixtures.odd(spark), WORDS, capacity=1000).collect()
    n, bound = check_packed(rows, [(r[0], r[1]) for r in fixtures.odd_rows()], library[1], 1000)
    assert bound <= n <= bound + 1
    assert packing.pack(fixtures.empty(spark), WORDS).count() == 0


def test_packing_in_several_blocks(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 60)  # read on the driver
    docs = fixtures.corpus(400)
    rows = packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), WORDS, capacity=256).collect()
    n, bound = check_packed(rows, docs, library[1], 256)
    assert bound <= n <= bound * 1.03 + 2


def test_crossover_keeps_every_document():
    import numpy as np

    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 90, 300).tolist()
    a = packing.best_fit(lengths, 100)
    b = packing.best_fit(sorted(lengths), 100)
    for _ in range(20):
        c = packing.crossover(a, b, 100, rng)
        assert sorted(x for y in c for x in y) == sorted(lengths) and max(map(sum, c)) <= 100
        a, b = b, c
    best = packing.evolve(lengths, 100, 1, [])
    assert sorted(x for y in best for x in y) == sorted(lengths)
    assert len(best) <= len(packing.best_fit(sorted(lengths, reverse=True), 100))

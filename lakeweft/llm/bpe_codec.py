"""Operator 7: BPE encoding and decoding with a contiguous rank array.

``encode`` and ``decode`` keep token ids; ``codec_digests`` derives the digests of a round
trip.  The merge loop is ``bpe.ByteBPE.merge_word``.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame

from lakeweft.llm import bpe
from lakeweft.llm.common import keeps, map_texts


@lru_cache(maxsize=2)
def _memo(path: str) -> bpe.Memo:
    """piece -> (number of ids, its decimal ids joined by commas, its bytes as decoded from those ids)."""
    model = bpe.load(path)

    def make(piece: str) -> tuple[int, str, bytes]:
        two = bpe.word_and_marks(piece)
        if two:
            (n, ids, raw), (k, more, tail) = memo[two[0]], memo[two[1]]
            return n + k, f"{ids},{more}", raw + tail
        ids = model.encode_piece(piece)
        return len(ids), ",".join(map(str, ids)), b"".join(map(model.bytes_of.__getitem__, ids))

    memo = bpe.Memo(make)
    return memo


keeps(_memo.cache_clear, __name__)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the token ids of each text; a null or empty text has none."""
    return map_texts(docs, lambda texts: {"ids": [bpe.load(path).encode(t) for t in texts]}, "ids array<int>", ["doc_id"])


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give the empty text."""
    import pyarrow as pa

    def run(batches):
        model = bpe.load(path)
        for b in batches:
            texts = [model.decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digest(text: str, path: str) -> tuple[int, str, str]:
    model, memo = bpe.load(path), _memo(path)
    n, ids, raw = 0, [], []
    for s in model.segments(text):
        if s in model.special:
            made = [(1, str(model.special[s]), model.bytes_of[model.special[s]])]
        else:
            made = map(memo.__getitem__, model.pieces(s))
        for k, i, r in made:
            n += k
            ids.append(i)
            raw.append(r)
    decoded = b"".join(raw).decode("utf-8", "replace")
    return n, hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def codec_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per input row.

    A null text counts as empty: 0 tokens and the digests of the empty string.  Null or
    repeated ids pass through; other columns of ``docs`` are not read.
    """

    def run(texts: list[str]) -> dict:
        rows = [digest(t, path) for t in texts]
        return {k: [r[i] for r in rows] for i, k in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"])

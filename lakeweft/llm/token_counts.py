"""Operator 1: token counts with the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once per worker, by merging
every vocabulary string.  A pre-token among them counts 1 without any merging; only the
rest goes through the merge loop.  Counts of space-delimited pieces are memoised.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweft.llm import bpe
from lakeweft.llm.common import keeps, map_texts


@lru_cache(maxsize=2)
def _counter(path: str):
    model = bpe.load(path)
    whole, merge_word, pretokens = model.whole, model.merge_word, model.pretokens

    def count_piece(piece: str) -> int:
        two = bpe.word_and_marks(piece)
        if two:
            return memo[two[0]] + memo[two[1]]
        n = 0
        for token in pretokens(piece):
            raw = token.encode()
            n += 1 if raw in whole else len(merge_word(raw))
        return n

    memo = bpe.Memo(count_piece)

    def count(text: str) -> int:
        n = 0
        for s in model.segments(text):
            n += 1 if s in model.special else sum(map(memo.__getitem__, model.pieces(s)))
        return n

    return count


keeps(_counter.cache_clear, __name__)


def count_tokens(texts: list[str], path: str) -> list[int]:
    count = _counter(path)
    return [count(t) for t in texts]


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    A null text counts as empty: 0 bytes, 0 tokens.  Null or repeated ids pass through;
    an empty table gives an empty table; other columns of ``docs`` are not read.
    """

    def run(texts: list[str]) -> dict:
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": count_tokens(texts, path)}

    out = map_texts(docs, run, "n_bytes long, n_tokens long", ["doc_id"])
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

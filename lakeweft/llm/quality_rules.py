"""Operator 4: quality rules by distribution divergence.

Each text's character-class and common-word histograms are set against the reference of
its language: the sums over all documents of that language.  The Jensen-Shannon distance
(square root of the divergence, base 2, 0 to 1) of either must stay within its limit;
texts under the minimum length are not judged by distance, as short counts scatter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweft.llm import textstats as ts
from lakeweft.llm.common import map_texts, written

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A distance counts against a text of n words if it is over floor + slack / sqrt(n): counts of a
#: short text scatter about the reference with the inverse root of its length.
CLASS_FLOOR, CLASS_SLACK, WORD_FLOOR, WORD_SLACK = 0.16, 1.2, 0.2, 3.0
#: Texts of fewer words are never judged by distance.
LEAST_WORDS = 40
#: References are broadcast up to this many languages, of about 1.5 KB each.
BROADCAST_LANGUAGES = 4096
_NC, _NW = len(ts.CLASSES), len(ts.WORDS) + 1


def measure(texts: list[str]) -> dict:
    rows, classes, commons = [], [], []
    for t in texts:
        raw = t.encode("utf-8", "replace")
        words = raw.split()
        rows.append(ts.base_counts(t, words))
        classes.append(ts.class_histogram(raw))
        commons.append(ts.word_histogram(raw.lower().split()))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = {k: [r[i] for r in rows] for i, k in enumerate(names)}
    for name, made, width in (("classes", classes, _NC), ("commons", commons, _NW)):
        flat = np.array(made, np.int64).reshape(-1)
        out[name] = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, np.int32)), pa.array(flat.astype(np.int32)))
    return out


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<int>, commons array<int>"


def js_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise Jensen-Shannon distance of two tables of counts; 0 where either is empty."""
    empty = (a.sum(1) == 0) | (b.sum(1) == 0)
    p = a / np.maximum(a.sum(1, keepdims=True), 1)
    q = b / np.maximum(b.sum(1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(empty, 0, np.sqrt(np.maximum((left + right) / 2, 0)))


def _stack(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def language_references(measured: DataFrame) -> DataFrame:
    """(language, ref_classes, ref_commons): histogram sums over all rows of each language.

    Each task adds up its own rows first, so what is shuffled is a row per task and language.
    """

    def add_up(batches):
        sums: dict = {}
        for b in batches:
            rows = np.hstack([_stack(b.column("classes")), _stack(b.column("commons"))]) if b.num_rows else np.empty((0, _NC + _NW))
            for lang in set(langs := b.column("language").to_pylist()):
                pick = np.fromiter((x == lang for x in langs), bool, len(langs))
                sums[lang] = sums.get(lang, 0) + rows[pick].sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype(np.int64).tolist() for v in sums.values()], pa.list_(pa.int64()))], ["language", "counts"])

    parts = measured.select("language", "classes", "commons").mapInArrow(add_up, "language string, counts array<long>")
    one = parts.select("language", F.posexplode("counts").alias("bin", "n")).groupBy("language", "bin").agg(F.sum("n").alias("n"))
    whole = one.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("c"))
    counts = F.transform("c", lambda x: x["n"])
    return whole.select("language", F.slice(counts, 1, _NC).alias("ref_classes"), F.slice(counts, _NC + 1, _NW).alias("ref_commons"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance).

    One row per input row.  A null text counts as empty: all counts 0, base_failed, not kept,
    distances 0.  A null language is a language of its own; without a ``lang`` column all
    rows share one reference.  Repeated rows count repeatedly.  Other columns are not read.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    keyed = docs.select("doc_id", "text", lang.alias("language"))
    measured = written(map_texts(keyed, measure, SCHEMA, ["doc_id", "language"]), "quality")
    references = written(language_references(measured), "references")
    # a row per language; broadcast where they are counted and few, so that measured rows aren't dealt by language
    few = references.count() <= BROADCAST_LANGUAGES
    joined = measured.join(F.broadcast(references) if few else references, "language")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches):
        for b in batches:
            if not b.num_rows:
                continue
            far = [js_distance(_stack(b.column(x)), _stack(b.column(f"ref_{x}"))) for x in ("classes", "commons")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *map(pa.array, far)], [*names, "class_distance", "word_distance"])

    judged = joined.select(*names, "classes", "commons", "ref_classes", "ref_commons").mapInArrow(judge, f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in names[1:]) + ", class_distance double, word_distance double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    root = F.sqrt(F.greatest("n_words", F.lit(1)))
    far = (F.col("n_words") >= LEAST_WORDS) & ((F.col("class_distance") > CLASS_FLOOR + CLASS_SLACK / root) | (F.col("word_distance") > WORD_FLOOR + WORD_SLACK / root))
    return judged.select(*names, failed.alias("base_failed"), (~failed & ~far).alias("kept"), "class_distance", "word_distance")

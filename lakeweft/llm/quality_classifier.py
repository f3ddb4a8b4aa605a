"""Operator 9: quality classifier by Bradley-Terry pairwise ranking.

Document features go into one linear score.  The weights are learned from preference pairs
(a document labelled 1 over one labelled 0) by the logistic loss on feature differences,
P(a preferred to b) = sigmoid(w . (x_a - x_b)), with Newton steps and an L2 penalty, over all
pairs of all labelled rows.  The cut between accepted and rejected is a quantile of the scores of the labelled rows: the
share of label 0 among them.  The score given out is a sigmoid that puts this cut at
``THRESHOLD``.

Pairs are not listed: what a row adds to the loss's slope depends on its own score and on how
the other label's scores lie, which a grid of counts and sums tells (each score is split between the two
nearest points, ``STEP`` apart).  So each Newton step is two passes over a written table of
features, and what reaches the driver is bounded by the grid and the number of features.
"""

from __future__ import annotations

import dataclasses
import math
import operator
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweft.llm import textstats as ts
from lakeweft.llm.common import begin_task, bounded, map_texts, scratch, written

#: Distance of the grid's points in units of the score, and the most points to either side of zero.
STEP, POINTS = 1 / 32, 4096
#: Tasks of a pass over the features, each of which sends one row to the driver.
TASKS = 64
#: Labels are broadcast up to this many; beyond it documents and labels are joined in a shuffle.
BROADCAST_LABELS = 500_000
#: So many scores or fewer are sorted by the driver.
SORTED = 20_000
THRESHOLD = 0.7
PENALTY = 1e-3
HELD_OUT = 2
FEATURES = (
    "upper share", "digit share", "blank share", "line share", "sentence share", "bracket share", "symbol share", "control share", "accent share", "wide share",
    "words without letter or digit", "all-capital words", "words ending in two marks", "words ending in a symbol", "mean word length", "distinct words", "common words",
    "most frequent word", "most frequent other word", "repeated-line share", "repeated-window share", "log words", "words a line", "lines with a bar", "word equal to the last", "empty",
)
_MARKS = re.compile(rb"[.,;:!?#*$%&|<>]")
_STRIP = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    c = ts.class_histogram(raw)
    chars = max(1, int(c.sum()))
    share = lambda *k: float(sum(c[i] for i in k)) / chars
    seen = Counter(words)
    bare = caps = double = marked = 0
    for w, k in seen.items():
        core = w.strip(_STRIP)
        if not core:
            bare += k
        elif len(core) > 1 and core.isupper():
            caps += k
        if len(w) > 1 and _MARKS.match(w[-1:]):
            if _MARKS.match(w[-2:-1]):
                double += k
            if w[-1:] in b"#*$%&|<>":
                marked += k
    hist = ts.word_histogram(raw.lower().split())
    lines = [x for x in text.split("\n") if x.strip(ts.WHITE)]
    top = seen.most_common(1)[0][1]
    other = max((k for w, k in seen.items() if w not in ts.WORD_BIN), default=0)
    return [
        share(1), share(2), share(3), share(4), share(5), share(6), share(7), share(8), share(9, 10), share(11, 12),
        bare / n, caps / n, double / n, marked / n, sum(len(w) * k for w, k in seen.items()) / n / 10, len(seen) / n, 1 - float(hist[-1]) / n,
        top / n, other / n, 1 - len(set(lines)) / max(1, len(lines)), ts.repeat_words(words) / n, math.log(n) / 10, min(n / max(1, len(lines)), 200) / 100, sum("|" in x for x in lines) / max(1, len(lines)), sum(map(operator.eq, words, words[1:])) / n, 0.0,
    ]


def widened(x: np.ndarray) -> np.ndarray:
    """The features, and the square roots of the shares: rare kinds of junk matter from the first traces."""
    return np.hstack([x, np.sqrt(np.maximum(x, 0))])


@dataclasses.dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((widened(x) - self.mean) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.cut) / self.spread + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _summed(rows: DataFrame, part) -> list[np.ndarray]:
    """The sums over all rows (label, x) of the arrays that ``part(x, label)`` gives for a batch."""

    def run(batches):
        begin_task(__name__)
        held = None
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                made = part(x, b.column("label").to_numpy(zero_copy_only=False))
                held = made if held is None else [p + q for p, q in zip(held, made, strict=True)]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[zlib.compress(np.ascontiguousarray(h, float).tobytes(), 1) for h in held]], pa.list_(pa.binary()))], ["sums"])

    got = None
    for r in rows.select("label", "x").coalesce(TASKS).mapInArrow(run, "sums array<binary>").collect():  # TASKS rows; most of a grid is empty
        parts = [np.frombuffer(zlib.decompress(v)) for v in r["sums"]]
        got = parts if got is None else [p + q for p, q in zip(got, parts, strict=True)]
    return got or []


def _placed(s: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """For each score the grid point under it and the share that goes to the next one."""
    at = np.clip(s / step + POINTS, 0, 2 * POINTS - 1e-6)
    low = at.astype(np.int64)
    return low, at - low


def _grid(model: Model, step: float):
    """Per label and grid point the number of rows and the sums of their features."""

    def part(x: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        z = model.scaled(x)
        low, share = _placed(z @ model.weights, step)
        out = np.zeros((2, 2 * POINTS + 1, z.shape[1] + 1))
        whole = np.hstack([np.ones((len(z), 1)), z])
        for k in (0, 1):
            own = label == k
            np.add.at(out[k], low[own], whole[own] * (1 - share[own])[:, None])
            np.add.at(out[k], low[own] + 1, whole[own] * share[own][:, None])
        return [out.ravel()]

    return part


def _curved(model: Model, step: float, curve: np.ndarray):
    """The sum of the outer products of the rows' features, weighted by ``curve`` (label, grid point) at their scores."""

    def part(x: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        z = model.scaled(x)
        low, share = _placed(z @ model.weights, step)
        v = curve[label, low] * (1 - share) + curve[label, low + 1] * share
        return [((z * v[:, None]).T @ z).ravel()]

    return part


def _of_rank(scores: DataFrame, rank: int) -> float:
    """The score of that rank (from 0) among all of (raw), by counts in ever narrower cells."""
    low, high, n = scores.agg(F.min("raw"), F.max("raw"), F.count("*")).first()
    while low < high:
        inside = scores.where(F.col("raw").between(low, high))
        if n <= SORTED:
            return sorted(r["raw"] for r in inside.collect())[rank]
        cell = F.floor((F.col("raw") - low) / max((high - low) / 4096, 5e-324)).alias("cell")
        for r in inside.groupBy(cell).agg(F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high")).orderBy("cell").collect():
            if rank < r["n"]:
                break
            rank -= r["n"]
        if (low, high) == (r["low"], r["high"]):
            break  # neighbouring numbers
        low, high, n = r["low"], r["high"], r["n"]
    return low


def fit(rows: DataFrame) -> Model:
    """Bradley-Terry weights over all pairs of the rows (label, x) of both labels, and the cut.  Without both labels every text scores alike."""
    width = 2 * len(FEATURES)

    def moments(x: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        wide = widened(x)
        return [np.array([(label == 0).sum(), (label == 1).sum()], float), wide.sum(0)]

    sums = _summed(rows, moments)
    bad, good = (int(k) for k in sums[0]) if sums else (0, 0)
    mean = sums[1] / (bad + good) if sums else np.zeros(width)
    scale = np.maximum(np.sqrt(_summed(rows, lambda x, _: [((widened(x) - mean) ** 2).sum(0)])[0] / (bad + good)), 1e-6) if sums else np.ones(width)
    model = Model(mean, scale, np.zeros(width), 0.0 if good or not bad else 1.0, 1.0)
    if not good or not bad:
        return model
    pairs = float(good) * bad
    for _ in range(30):
        w = model.weights
        step = max(STEP, 8 * float(np.abs(w).sum()) / POINTS)
        grid = _summed(rows, _grid(model, step))[0].reshape(2, 2 * POINTS + 1, width + 1)
        used = [np.flatnonzero(grid[k, :, 0]) for k in (0, 1)]
        curve, slope, cross = np.zeros((2, 2 * POINTS + 1)), PENALTY * w, np.zeros((width, width))
        worse = grid[0, used[0]]
        for at in range(0, len(used[1]), 256):  # a block of grid points of label 1 against all of label 0
            mine = used[1][at : at + 256]
            better = grid[1, mine]
            p = 1 / (1 + np.exp(-np.clip(step * (mine[:, None] - used[0][None, :]), -500, 500)))
            v = p * (1 - p)
            slope = slope + (((p - 1) @ worse[:, 0]) @ better[:, 1:] - (better[:, 0] @ (p - 1)) @ worse[:, 1:]) / pairs
            curve[1, mine] = v @ worse[:, 0]
            curve[0, used[0]] += better[:, 0] @ v
            cross += better[:, 1:].T @ v @ worse[:, 1:]
        own = _summed(rows, _curved(model, step, curve / pairs))[0].reshape(width, width)
        move = np.linalg.solve(own - (cross + cross.T) / pairs + PENALTY * np.eye(width), slope)
        model = dataclasses.replace(model, weights=w - move)
        if np.abs(move).max() < 1e-6:
            break

    def scored(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x))], ["raw"])

    scores = written(rows.select("x").mapInArrow(scored, "raw double"), "labelled-scores")
    # the quantile: the share of label 0
    cut = (_of_rank(scores, bad - 1) + _of_rank(scores, bad)) / 2
    return dataclasses.replace(model, cut=cut, spread=max(scores.agg(F.stddev_pop("raw")).first()[0], 1e-6) / 2)


def _remainder(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 4


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    def run(texts: list[str]) -> dict:
        return {"x": [features(t) for t in texts]}

    return map_texts(docs, run, "x array<double>", keep)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled rows whose remainder isn't HELD_OUT.

    Rows with a null id or a label other than 0 and 1 teach nothing; an id labelled in
    several rows takes its smallest label.
    """
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(_remainder() != HELD_OUT)
    with scratch():
        one = written(usable.groupBy("doc_id").agg(F.min("label").alias("label")), "labels")
        joined = docs.select("doc_id", "text").join(F.broadcast(one) if one.count() <= BROADCAST_LABELS else one, "doc_id")
        return fit(written(measured(joined, ["label"]), "labelled-features"))


def quality_scores(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row, from whole texts alone.

    A null text counts as empty and is scored like any text; a null id counts as the empty
    id for ``held_out``.  Repeated rows get equal scores.  Other columns are not read.
    """

    def run(texts: list[str]) -> dict:
        x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return {"score": pa.array(model.score(x))}

    scored = map_texts(docs, run, "score double", keep or ["doc_id"])
    return scored.withColumns({"held_out": _remainder() == HELD_OUT, "predicted": F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)})


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is predicted 1, all columns kept."""
    bounded(docs.sparkSession)

    def run(batches):
        begin_task(__name__)
        for b in batches:
            x = np.array([features(t or "") for t in b.column("text").to_pylist()], float).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)

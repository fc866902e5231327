"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

The n-grams are single shapes and pairs of shapes of words. A shape is the word with
runs of small letters, capitals and digits written as one sign each, marked if
the word equals the one before it or the one before that. An indicator says
that an n-gram makes up at least some share of its text. Indicators are hashed
into a fixed number of places, so the model has one size for any corpus.

Null and empty texts have no indicators and score by the intercept alone.
Repeated rows are scored one by one and an empty table gives an empty one.
Labels are joined on ``doc_id``; a document with contradicting labels gets the
majority, 1 on a tie, rows with a null id or label teach nothing, and of documents that
repeat an id one teaches. Without rows of both labels there is nothing to
learn, which raises.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.errors import OperationError
from tablewright.llm.chunks import Chunk, appended, hashed, mix, windows

PLACES = 1 << 18
SHARES = (0.0, 0.01, 0.03, 0.1, 0.3, 0.6)

_U = np.uint64
# One class per byte; capitals of Latin-1 are told by their second byte, the first is skipped.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[0x80:] = ord("a")


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # log-count ratio times weight, by place
    intercept: float
    slope: float  # of the score as a function of the margin
    shift: float


def _shapes(chunk: Chunk) -> np.ndarray:
    classes = _CLASS[chunk.data]
    if len(classes) > 1:
        capital = (chunk.data[:-1] == 0xC3) & (chunk.data[1:] >= 0x80) & (chunk.data[1:] <= 0x9E)
        classes[1:][capital] = ord("A")
        classes[:-1][capital] = ord("A")
    keep = np.ones(len(classes), bool)
    keep[1:] = classes[1:] != classes[:-1]
    keep[chunk.starts] = True
    places = np.zeros(len(classes) + 1, np.int64)
    np.cumsum(keep, out=places[1:])
    shapes = hashed(classes[keep], places[chunk.starts], places[chunk.ends])
    words, first = chunk.word_hashes, chunk.word_offsets[chunk.word_rows]
    at = np.arange(len(words))
    with np.errstate(over="ignore"):
        for back in (1, 2):
            same = np.zeros(len(words), bool)
            same[back:] = words[back:] == words[:-back]
            shapes = np.where(same & (at - first >= back), mix(shapes + _U(back)), shapes)
    return shapes


def indicators(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of all indicators, without repeats, by row."""
    shapes, offsets = _shapes(chunk), chunk.word_offsets
    rows, places = [], []
    for size in (1, 2):
        at, grams = windows(shapes, offsets, size)
        owner = chunk.word_rows[at]
        order = np.lexsort((grams, owner))
        owner, grams = owner[order], grams[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(grams)))
        owner, grams = owner[begin], grams[begin]
        share = count / np.bincount(owner, count, len(chunk))[owner]
        with np.errstate(over="ignore"):
            for level, least in enumerate(SHARES):
                here = share >= least
                rows.append(owner[here])
                places.append(mix(grams[here] + _U(level + 8 * size)) % _U(PLACES))
    row, place = np.concatenate(rows), np.concatenate(places).astype(np.int64)
    both = np.unique(row * PLACES + place)
    return both // PLACES, both % PLACES


def _lists(chunk: Chunk) -> pa.Array:
    rows, places = indicators(chunk)
    offsets = np.searchsorted(rows, np.arange(len(chunk) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(places.astype(np.int32)))


def _descend(x: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge loss; an intercept is a feature that is always 1."""
    w, bias = np.zeros(PLACES), 0.0
    alpha = np.zeros(len(x))
    square = np.array([float(scale[i] @ scale[i]) + 1 for i in x])
    draw = np.random.default_rng(0)
    for _ in range(epochs):
        for i in draw.permutation(len(x)):
            here = x[i]
            gradient = y[i] * (float(w[here] @ scale[here]) + bias) - 1
            moved = min(max(alpha[i] - gradient / square[i], 0.0), cost) - alpha[i]
            if moved:
                alpha[i] += moved
                w[here] += moved * y[i] * scale[here]
                bias += moved * y[i]
    return w, bias


def _calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        v = p * (1 - p) + 1e-6
        g = np.array([(margin * (p - label)).sum() + 1e-2 * a, (p - label).sum() + 1e-2 * b])
        h = np.array([[(v * margin * margin).sum() + 1e-2, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return max(a, 1e-3), b


def fit_quality(
    docs: DataFrame, labels: DataFrame, max_rows: int = 6000, cost: float = 1.0, epochs: int = 12, column: str = "text"
) -> QualityModel:
    """Fit on the ``max_rows`` labelled documents whose ids have the smallest hashes.

    ``labels`` has ``doc_id`` and ``quality``. Only ids are compared to find the
    sample, whose bounded number of rows is then picked out of ``docs`` by a broadcast.
    """
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    picked = docs.select("doc_id", column).join(F.broadcast(sample), "doc_id")
    made = appended(picked, "places array<int>", lambda chunk: {"places": _lists(chunk)}, ["doc_id", "label"], column)
    rows = made.groupBy("doc_id", "label").agg(F.min("places").alias("places")).collect()
    rows.sort(key=lambda r: r.doc_id)
    label = np.array([r.label for r in rows], float)
    if len(set(label)) < 2:
        raise OperationError("labelled rows of both classes are needed")
    x = [np.array(r.places, np.int64) for r in rows]
    counts = np.ones((2, PLACES))  # one added to each count
    for i, here in enumerate(x):
        counts[int(label[i]), here] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    # Longer texts have more indicators; the scale keeps margins of all lengths alike.
    scale = ratio / np.sqrt(max(1.0, np.mean([len(here) for here in x])))
    w, bias = _descend(x, 2 * label - 1, scale, cost, epochs)
    weights = w * scale
    margin = np.array([weights[here].sum() + bias for here in x])
    slope, shift = _calibrate(margin, label)
    return QualityModel(weights, bias, slope, shift)


def score_quality(
    docs: DataFrame, model: QualityModel, column: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``score``, the likelihood of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain data, as executors may lack this package

    def measure(chunk: Chunk) -> dict[str, np.ndarray]:
        model = QualityModel(**shared.value)
        rows, places = indicators(chunk)
        margin = np.bincount(rows, model.weights[places], len(chunk)) + model.intercept
        return {"score": 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))}

    return appended(docs, "score double", measure, keep, column)

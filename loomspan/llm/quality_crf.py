"""Quality classifier: a linear-chain conditional random field labels lines, and their marginals add up to a score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged, table

#: Folds of doc_id, the one held out, and the score from which a text is predicted good.
FOLDS, HELD_OUT, GOOD = 5, 0, 0.3
#: The sample that the model is fit on: at most so many labelled texts, all of their lines. A parameter of train and classify.
SAMPLE = 4000
ROUNDS, RATE, RIDGE = 150, 0.1, 1.0
#: Lines whose marginals a worker computes at once.
LINES = 100_000

_SYMBOLS = b"#*$%&|<>{}[]\\^~=_+@`"
_LETTERS, _UPPER, _DIGITS = (UPPER + LOWER).encode(), UPPER.encode(), b"0123456789"
BITS = 27

#: Weights of features, log-potentials of transitions, slope and shift of the calibration.
Model = tuple[np.ndarray, np.ndarray, tuple[float, float]]


def line_bits(text: str) -> tuple[list[int], list[int]]:
    """For each line with a word: its features as bits, and its length in bytes. A text without words is one empty line.

    A feature is a threshold on the share of symbols, exclamations, capitals or digits, on how many words repeat within
    the line or come from earlier lines, on lengths, and on how the line begins and ends.
    """
    bits, sizes = [], []
    seen: set[bytes] = set()
    lines: set[bytes] = set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        w = line.split()
        if not w:
            continue
        n, size = len(w), len(line)
        own = set(w)
        known = len(own & seen) / len(own)
        letters = size - len(line.translate(None, _LETTERS))
        symbols = (size - len(line.translate(None, _SYMBOLS))) / n
        shout = line.count(b"!!") / n
        upper = (size - len(line.translate(None, _UPPER))) / (letters or 1)
        digits = (size - len(line.translate(None, _DIGITS))) / size
        unique, mean = len(own) / n, size / n
        end = w[-1][-1:]
        tests = (
            symbols > 0.05, symbols > 0.3, symbols > 1, shout > 0.05, shout > 0.5, upper > 0.2, upper > 0.6, digits > 0.1, digits > 0.3,
            n >= 6 and unique < 0.8, n >= 6 and unique < 0.6, n >= 6 and unique < 0.35, n >= 6 and unique < 0.1,
            n >= 6 and known > 0.5, n >= 6 and known > 0.8, n >= 6 and known > 0.97, line in lines, n <= 2, n <= 5, n >= 40, n >= 150,
            mean > 12, mean < 3.5, b"|" in line, end in b".!?", w[0][:1].isupper(),
        )
        x = 0
        for i, t in enumerate(tests):
            x |= t << i
        bits.append(x)
        sizes.append(size)
        seen |= own
        lines.add(line)
    return (bits, sizes) if bits else ([1 << (BITS - 1)], [1])


def spread_bits(bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row per line: its features, those of the line before, those of the line after (none at a text's ends), a 1."""
    x = (bits[:, None] >> np.arange(BITS) & 1).astype(np.float32)
    first, last = np.zeros(len(bits), bool), np.zeros(len(bits), bool)
    first[starts] = True
    last[np.append(starts[1:], len(bits)) - 1] = True
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[first], after[last] = 0, 0
    return np.concatenate([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))], 1).astype(np.float32)


def marginals(score: np.ndarray, starts: np.ndarray, counts: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all texts at once: P(line is good), expected transitions (2 x 2), log of all partition sums.

    score: log-potential of good against bad for each line; move[r, s]: of label s after r. Texts run in step, the
    longest first, so that those still running are a prefix.
    """
    order = np.argsort(-counts, kind="stable")
    at, n = starts[order], counts[order]
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(steps), side="left")  # texts with more than t lines
    e = np.empty((len(score), 2))
    top = np.maximum(score, 0)
    e[:, 0], e[:, 1] = np.exp(-top), np.exp(score - top)
    m = np.exp(move)
    fwd, scale = np.empty_like(e), np.empty(len(score))
    for t in range(steps):
        i = at[: active[t]] + t
        a = e[i] if t == 0 else (fwd[i - 1] @ m) * e[i]
        scale[i] = a.sum(1)
        fwd[i] = a / scale[i][:, None]
    bwd, both = np.ones_like(e), np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        i = at[: active[t + 1]] + t
        b = e[i + 1] * bwd[i + 1] / scale[i + 1][:, None]
        both += (fwd[i].T @ b) * m
        bwd[i] = b @ m.T
    good = fwd * bwd
    return good[:, 1] / good.sum(1), both, float(np.log(scale).sum() + top.sum())


def likelihood(x: np.ndarray, y: np.ndarray, starts: np.ndarray, counts: np.ndarray, w: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log of the probability of line labels y, less a ridge, with its gradients by the weights and by the transitions.

    Labels stay the same within a text, so that the transitions observed are those of each label to itself.
    """
    score = x @ w
    p, both, log_z = marginals(score, starts, counts, move)
    first = y[starts]
    observed = np.diag([float((counts[first == s] - 1).sum()) for s in (0, 1)])
    value = float(score @ y + (observed * move).sum() - log_z - RIDGE / 2 * (w @ w + (move * move).sum()))
    return value, x.T @ (y - p) - RIDGE * w, observed - both - RIDGE * move


def fit(bits: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a line's features and log-potentials of transitions, by gradient ascent on the likelihood of labels.

    Only whole texts are labelled, so that each line is given its text's label.
    """
    counts = np.array([len(b) for b in bits])
    starts = np.cumsum(counts) - counts
    x = spread_bits(np.concatenate(bits), starts)
    y = np.repeat(labels, counts).astype(float)
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    first, second = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, ROUNDS + 1):
        _, by_w, by_move = likelihood(x, y, starts, counts, w, move)
        g = np.concatenate([by_w, by_move.ravel()])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        step = RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        w, move = w + step[:-4], move + step[-4:].reshape(2, 2)
    return w, move


def calibrate(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the scores' log-odds that fit the texts' own labels best, by Newton's steps with a ridge.

    Line labels are only a stand-in for those of texts; a text of one line, which no neighbour supports, would else stay
    near the share of good texts.
    """
    z, y = log_odds(scores), labels.astype(float)
    x = np.stack([z, np.ones_like(z)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.1 * (w - [1.0, 0.0])
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -1, 1)
    return float(max(0.1, w[0])), float(w[1])


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model, from at most sample labelled texts outside the held-out fold, the first by a hash of doc_id. None without labels.

    The ids of the sample (16 bytes each) are all that is broadcast, and the features of its lines (8 bytes a line) all
    that comes to the driver, which grows with sample only.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").filter(fold(F.col("doc_id")) != HELD_OUT)
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").cast("int").alias("good"))
    chosen = staged(known.orderBy(F.xxhash64("_id"), "_id").limit(sample), "sample", small=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [line_bits(t.as_py() or "") for t in b.column(1)]
            packed = [np.array(x, np.int32).tobytes() for x in found]  # the bits, then the lengths
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())], ["id", "good", "bits"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "text", "good").mapInArrow(run, "id long, good int, bits binary")
    got = sorted(rows.collect(), key=lambda r: (r["id"], bytes(r["bits"])))
    if not got:
        return None
    bits, good = [np.frombuffer(r["bits"][: len(r["bits"]) // 2], np.int32) for r in got], np.array([r["good"] for r in got])
    model = (*fit(bits, good), (1.0, 0.0))
    sizes = [np.frombuffer(r["bits"][len(r["bits"]) // 2 :], np.int32) for r in got]
    return (*model[:2], calibrate(_scores(bits, sizes, model), good))


def _scores(bits: list[np.ndarray], sizes: list[np.ndarray], model: Model) -> np.ndarray:
    counts = np.array([len(b) for b in bits])
    starts = np.cumsum(counts) - counts
    size = np.concatenate(sizes).astype(float)
    p, _, _ = marginals(spread_bits(np.concatenate(bits), starts) @ model[0], starts, counts, model[1])
    mean = np.add.reduceat(p * size, starts) / np.add.reduceat(size, starts)
    slope, shift = model[2]
    return 1 / (1 + np.exp(-np.clip(slope * log_odds(mean) + shift, -700, 700)))


def score_texts(texts: list[str], model: Model | None) -> list[float]:
    """The length-weighted mean of P(line is good) of each text, calibrated; 0.5 without a model."""
    if model is None:
        return [0.5] * len(texts)
    out: list[float] = []
    held: list[tuple[list[int], list[int]]] = []

    def flush() -> None:
        out.extend(_scores([np.array(b, np.int32) for b, _ in held], [np.array(x, np.int32) for _, x in held], model).tolist())
        held.clear()

    n = 0
    for t in texts:
        held.append(line_bits(t))
        n += len(held[-1][0])
        if n >= LINES:
            flush()
            n = 0
    if held:
        flush()
    return out


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.3, else 0); all columns are kept.

    Only the text is scored; a null text counts as empty, and an empty one as a line without words. Each row is scored on
    its own, without a shuffle, so repeated rows have equal scores. Without labels every score is 0.5; an empty table gives an empty result. A column of docs named score or predicted gives way.
    """
    model = train(docs, labels, sample)
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                got = score_texts([t or "" for t in part.column(names.index("text")).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], [*names, "score"])

    schema = docs.select(*names).schema.add("score", "double")
    return docs.select(*names).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", "predicted")

"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its score reads the line's own features and those of its neighbours, and transitions tie
adjacent lines. Training lines carry the label of their document. Forward-backward gives each line's marginal, the
marginals weighted by line length give the document's share of good text, and a logistic curve fitted on the training
documents turns that share into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample: so many labelled documents, the first by a hash of their identifier.
TRAIN_DOCS = 4000
#: Documents with more characters or lines are left out of the training sample (never out of scoring), so that the
#: sample has at most TRAIN_DOCS * TRAIN_LINES lines.
TRAIN_CHARS = 200_000
TRAIN_LINES = 1000
#: In training a longer document counts as several chains of so many lines.
CHAIN = 64
#: Most iterations of the fit, the steps that its curvature remembers, and the slope at which it ends.
STEPS, MEMORY, FLAT = 120, 8, 1e-5
THRESHOLD = 0.3

_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"#$%&*@^~<>{}[]\\/=+_`"
OWN = ("bias", "length", "upper", "digits", "marks", "bars", "shouts", "repeats", "sameness", "few_words", "seen", "word_length", "sentence_end")
#: Of the neighbours, before and after.
NEAR = ("upper", "marks", "bars", "shouts", "repeats", "sameness")
WIDTH = len(OWN) + 2 * len(NEAR)
_NEAR_AT = [OWN.index(k) for k in NEAR]


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the text's non-blank lines; a text without any counts as one empty line."""
    rows, lengths, seen = [], [], set()
    for line in (text or "").encode("utf-8").split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, k = len(line), len(words)
        letters = n - len(line.translate(None, _LETTERS))
        upper = n - len(line.translate(None, _UPPER))
        digits = n - len(line.translate(None, _DIGITS))
        marks = n - len(line.translate(None, _MARKS))
        repeats = sum(map(eq, words, words[1:])) / k
        sameness = 1 - len(set(words)) / k if k > 7 else 0.0
        rows.append((1.0, min(np.log1p(n), 10.0) / 10, upper / max(letters, 1), digits / n, 5 * marks / n, 10 * line.count(b"|") / n, 10 * line.count(b"!") / n, repeats, sameness, float(k < 3), float(line in seen), min(n / k, 40) / 40, float(line[-1:] in b".!?")))
        lengths.append(n)
        seen.add(line)
    if not rows:
        rows, lengths = [(1.0, *[0.0] * (len(OWN) - 1))], [1]
    own = np.array(rows, dtype=np.float64)
    near = own[:, _NEAR_AT]
    edge = np.zeros((1, len(NEAR)))
    return np.hstack([own, np.vstack([edge, near[:-1]]), np.vstack([near[1:], edge])]), np.array(lengths, dtype=np.float64)


@dataclass(frozen=True)
class LineCrf:
    """weights: score of "good" over "bad" by feature; moves[a][b]: log-weight of a line b after a line a; curve:
    slope and offset of the document's logistic."""

    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def marginals(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """P(good) of every line of every chain of features."""
        if not chains:
            return []
        sizes = np.array([len(c) for c in chains])
        good, _, _ = _forward_backward(np.vstack(chains) @ self.weights, self.moves, _padded(sizes))
        return np.split(good, np.cumsum(sizes)[:-1])

    def shares(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted share of good text of every document."""
        good = self.marginals([x for x, _ in docs])
        return np.array([float(g @ n / n.sum()) for g, (_, n) in zip(good, docs, strict=True)])

    def score(self, texts: list[str | None]) -> np.ndarray:
        share = np.clip(self.shares([line_features(t) for t in texts]), 1e-6, 1 - 1e-6)
        slope, offset = self.curve
        return 1 / (1 + np.exp(-(slope * np.log(share / (1 - share)) + offset)))


def _padded(sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, live) of chains of similar length that run together: places[t, j] is the line at step t of the j-th
    chain among all lines, live whether there is one."""
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    out, at = [], 0
    while at < len(order):
        stop = min(at + 4096, int(np.searchsorted(sizes[order], sizes[order[at]] * 5 // 4 + 4, side="right")))
        group = order[at:stop]
        steps = np.arange(sizes[group[-1]])[:, None]
        live = steps < sizes[group]
        out.append((starts[group] + np.where(live, steps, 0), live))
        at = stop
    return out


def _forward_backward(scores: np.ndarray, moves: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) by line, expected counts of the four moves, log of the sum over all labellings) for lines' scores of
    "good" over "bad" in chains."""
    scores = np.clip(scores, -30, 30)
    up = 1 / (1 + np.exp(-scores))
    top = moves.max()
    factors = np.exp(moves - top)
    good, total, log = np.empty(len(scores)), np.zeros((2, 2)), float(np.log1p(np.exp(scores)).sum())
    for places, live in groups:
        steps, n = places.shape
        emit = np.stack([1 - up[places], up[places]], axis=2)
        emit[~live] = 1.0
        ahead, back = np.empty_like(emit), np.empty_like(emit)
        ahead[0] = state = emit[0]  # already sums to 1
        for t in range(1, steps):
            state = (state @ factors) * emit[t]
            norm = state.sum(axis=1, keepdims=True)
            ahead[t] = state = state / norm
            log += float(np.log(norm[live[t]]).sum()) + top * int(live[t].sum())
        state = np.full((n, 2), 0.5)
        for t in range(steps - 1, -1, -1):
            back[t] = state
            state = (emit[t] * state) @ factors.T
            state /= state.sum(axis=1, keepdims=True)
            if t and not live[t].all():
                state[~live[t]] = 0.5
        both = ahead * back
        good[places[live]] = (both[..., 1] / both.sum(axis=2))[live]
        pairs = ahead[:-1, :, :, None] * factors * (emit[1:] * back[1:])[:, :, None, :]
        pairs /= np.maximum(pairs.sum(axis=(2, 3), keepdims=True), 1e-300)
        total += pairs[live[1:]].sum(axis=0)
    return good, total, log


def _climb(value_and_slope, theta: np.ndarray, steps: int) -> np.ndarray:
    """A maximum of a concave function by limited-memory quasi-Newton steps with halving."""
    value, slope = value_and_slope(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max() < FLAT:
            break
        way, kept = slope.copy(), []
        for moved, bent in reversed(past):
            share = moved @ way / (moved @ bent)
            way -= share * bent
            kept.append((share, moved, bent))
        if past:
            moved, bent = past[-1]
            way *= moved @ bent / (bent @ bent)
        for share, moved, bent in reversed(kept):
            way += (share - bent @ way / (moved @ bent)) * moved
        rise, length = slope @ way, 1.0 if past else min(1.0, 1 / np.abs(slope).sum())
        for _ in range(30):
            new, new_slope = value_and_slope(theta + length * way)
            if new >= value + 1e-4 * length * rise:
                break
            length /= 2
        else:
            break
        moved, bent = length * way, slope - new_slope
        if moved @ bent > 1e-12:
            past = [*past[-(MEMORY - 1) :], (moved, bent)]
        theta, value, slope = theta + moved, new, new_slope
    return theta


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = STEPS, decay: float = 1e-4) -> LineCrf:
    """Maximum likelihood of the lines' labels, then the document curve. One class alone, or no document at all, gives a
    model that scores every text with the share of label 1 (0.5 without documents)."""
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        rate = float(np.clip((y.sum() + 1) / (len(y) + 2), 1e-3, 1 - 1e-3))
        return LineCrf(np.zeros(WIDTH), np.zeros((2, 2)), (0.0, float(np.log(rate / (1 - rate)))))
    chains, truth = [], []
    for (x, _), label in zip(docs, labels, strict=True):
        for a in range(0, len(x), CHAIN):
            chains.append(x[a : a + CHAIN])
            truth.append(label)
    lines, sizes = np.vstack(chains), np.array([len(c) for c in chains])
    gold = np.repeat(np.array(truth, float), sizes)
    gold_moves = np.zeros((2, 2))
    for n, label in zip(sizes, truth, strict=True):
        gold_moves[label, label] += n - 1
    groups = _padded(sizes)

    def value_and_slope(theta: np.ndarray) -> tuple[float, np.ndarray]:
        moves, scores = theta[WIDTH:].reshape(2, 2), lines @ theta[:WIDTH]
        good, total, log = _forward_backward(scores, moves, groups)
        value = (gold @ scores + (gold_moves * moves).sum() - log) / len(lines) - decay * (theta @ theta) / 2
        return value, np.concatenate([lines.T @ (gold - good), (gold_moves - total).ravel()]) / len(lines) - decay * theta

    theta = _climb(value_and_slope, np.zeros(WIDTH + 4), steps)
    model = LineCrf(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))
    share = np.clip(model.shares(docs), 1e-6, 1 - 1e-6)
    z = np.column_stack([np.log(share / (1 - share)), np.ones(len(share))])
    curve = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        curve = curve + np.linalg.solve(hessian, z.T @ (y - p) - 1e-3 * curve)
    return LineCrf(theta[:WIDTH], theta[WIDTH:].reshape(2, 2), (float(curve[0]), float(curve[1])))


def remainder(doc_id):
    """crc32 of the identifier as text, modulo 5."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = TRAIN_DOCS) -> LineCrf:
    """Fit on at most `limit` labelled documents outside the held-out fifth. Null labels and ids are left out, of rows
    that repeat an id the smallest text counts, and of labels that repeat one the largest; texts beyond TRAIN_CHARS or
    TRAIN_LINES are left out. Only line features and labels of the sample reach the driver."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(F.col(id_col)) != 0))
    chosen = chosen.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    sample = sample.where(F.coalesce(F.length("_text"), F.lit(0)) <= TRAIN_CHARS).groupBy("_id").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"), F.max("_label").alias("_label"))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[frame["_text"].str.count("\n") < TRAIN_LINES]
            made = [line_features(t) for t in frame["_text"]]
            yield pd.DataFrame({"key": frame["_id"].astype(str), "label": (frame["_label"] > 0).astype("int32"), "x": [x.astype("<f4").tobytes() for x, _ in made], "n": [n.astype("<f4").tobytes() for _, n in made]})

    got = sorted(sample.mapInPandas(scan, "key string, label int, x binary, n binary").collect(), key=lambda r: (r.key, bytes(r.x)))
    made = [(np.frombuffer(r.x, "<f4").reshape(-1, WIDTH).astype(float), np.frombuffer(r.n, "<f4").astype(float)) for r in got]
    return fit(made, [r.label for r in got])


def scored(df: DataFrame, model: LineCrf, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with a DOUBLE column score_col, in 0..1. Null and empty texts are scored as one empty line."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [model.score(texts.iloc[a : a + 512].tolist()) for a in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return df.withColumn(score_col, score(F.col(text_col)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, held_out, score, predicted).

    held_out is true where the identifier's remainder is 0 (false for a null id); predicted is 1 from THRESHOLD on.
    Equal texts have equal scores, rows that repeat get a row each, and an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col)
    slim = scored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return slim.select(F.col("id").alias(id_col), F.coalesce(remainder(F.col("id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score below THRESHOLD, all columns as they were. Null and empty texts and texts of any
    length are scored like others, rows that repeat stay or go together, an empty table gives an empty result."""
    hidden = "_line_crf_score"
    while hidden in docs.columns:
        hidden += "_"
    return scored(docs, train(docs, labels, id_col, text_col), text_col, hidden).where(F.col(hidden) >= THRESHOLD).drop(hidden)

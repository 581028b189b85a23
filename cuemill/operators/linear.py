"""Linear models by stacked Newton steps: one pass over the rows serves every model at once.

A pass adds up, for each model, the loss, the gradient and the Gram block of the rows that count, per
task and then per model; the tasks that add up a model also solve its Newton system, so the driver
sees one direction of ``p`` numbers a model and pass. A task holds one ``p x p`` block a model: their
size is set by vocabulary and grid, not by the rows.

Both losses are sums, as ``C · Σ weight · loss + ½ · penalty``: the logistic loss with a free intercept,
and the squared hinge with the intercept as one more penalised weight. The squared hinge has no second
derivative at its corner; its generalised Newton step takes the rows inside the margin as the active
set, and a step that changes none of them ends at the optimum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.session import ship_package

#: Rows that a task turns into a dense block at a time.
BLOCK_ROWS = 256
#: The share of the promised decrease that a step must reach, else it is halved.
ARMIJO = 1e-4


@dataclass(frozen=True)
class Loss:
    name: str
    penalised_intercept: bool

    def terms(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss and its first two derivatives by the margin."""
        if self.name == "squared_hinge":
            gap = np.maximum(0.0, 1.0 - margin)
            return gap * gap, -2.0 * gap, 2.0 * (gap > 0)
        p = 1.0 / (1.0 + np.exp(np.clip(margin, -700, 700)))
        return np.logaddexp(0.0, -margin), -p, p * (1.0 - p)


logistic_regression = Loss("logistic", False)
linear_svm = Loss("squared_hinge", True)


@dataclass(frozen=True)
class Space:
    """How a row of raw counts becomes features: the columns to take, their weights, unit length.

    ``held_out`` is the fold whose rows the space's models are not trained on.
    """

    columns: np.ndarray
    scale: np.ndarray
    held_out: int | None = None
    unit: bool = True


@dataclass(frozen=True)
class Task:
    """One model to fit: its space, ``C`` and the weights of class 0 and 1."""

    space: int
    C: float
    weights: tuple[float, float]


@dataclass
class Fit:
    coefficients: np.ndarray
    intercept: float
    passes: int
    converged: bool


def class_weights(class_weight: str | None, counts: dict[float, int]) -> tuple[float, float]:
    """Balanced weights, too, add up to the number of rows."""
    n = sum(counts.values())
    if class_weight != "balanced":
        return 1.0, 1.0
    return tuple(n / (len(counts) * counts[c]) if counts.get(c) else 0.0 for c in (0.0, 1.0))


def _blocks(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Dense blocks of raw counts with their labels and folds."""
    for batch in batches:
        for a in range(0, len(batch), BLOCK_ROWS):
            part = batch.iloc[a:a + BLOCK_ROWS]
            raw = np.zeros((len(part), width))
            sizes = part["at"].map(len).to_numpy()
            if sizes.sum():
                raw[np.repeat(np.arange(len(part)), sizes), np.concatenate(part["at"].to_numpy())] = np.concatenate(
                    part["value"].to_numpy())
            yield raw, part["label"].to_numpy(), part["fold"].to_numpy()


def _features(raw: np.ndarray, space: Space) -> np.ndarray:
    """The space's features with a last column of ones."""
    x = raw[:, space.columns] * space.scale
    if space.unit:
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = x / np.where(norm > 0, norm, 1.0)
    return np.hstack([x, np.ones((len(x), 1))])


def _penalty(loss: Loss, p: int) -> np.ndarray:
    out = np.ones(p)
    if not loss.penalised_intercept:
        out[-1] = 0.0
    return out


def _pass(rows: DataFrame, loss: Loss, spaces: Sequence[Space], tasks: Sequence[Task], width: int,
          points: dict[int, np.ndarray]) -> dict[int, tuple[float, float, np.ndarray]]:
    """Objective, slope and Newton direction of every model at its point: one job."""
    upper = {i: np.triu_indices(len(w)) for i, w in {len(w): w for w in points.values()}.items()}
    by_space: dict[int, list[int]] = {}
    for m in points:
        by_space.setdefault(tasks[m].space, []).append(m)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {m: [0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))] for m, w in points.items()}
        for raw, label, fold in _blocks(batches, width):
            sign = 2.0 * label - 1.0
            for s, models in by_space.items():
                keep = np.ones(len(label), bool) if spaces[s].held_out is None else fold != spaces[s].held_out
                if not keep.any():
                    continue
                x, y = _features(raw[keep], spaces[s]), sign[keep]
                for m in models:
                    weight = tasks[m].C * np.where(y > 0, tasks[m].weights[1], tasks[m].weights[0])
                    value, first, second = loss.terms(y * (x @ points[m]))
                    sums[m][0] += float(weight @ value)
                    sums[m][1] += x.T @ (weight * first * y)
                    curve = weight * second
                    active = curve > 0
                    # A Newton step bears a rounded curvature; the gradient stays exact.
                    half = (x[active] * np.sqrt(curve[active])[:, None]).astype(np.float32)
                    sums[m][2] += half.T @ half
        for m, (value, gradient, gram) in sums.items():
            yield pd.DataFrame({"model": [m], "value": [value], "gradient": [gradient.tobytes()],
                                "gram": [gram[upper[len(gram)]].astype("<f4").tobytes()]})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for batch in batches:
            for m, value, gradient, gram in zip(batch["model"], batch["value"], batch["gradient"], batch["gram"]):
                own = sums.setdefault(m, [0.0, 0.0, 0.0])
                own[0] += value
                own[1] = own[1] + np.frombuffer(gradient)
                own[2] = own[2] + np.frombuffer(gram, "<f4").astype(float)
        for m, (value, gradient, packed) in sums.items():
            w = points[m]
            penalty = _penalty(loss, len(w))
            gram = np.zeros((len(w), len(w)))
            gram[upper[len(w)]] = packed
            gram = np.triu(gram) + np.triu(gram, 1).T + np.diag(penalty)
            if not penalty[-1]:
                gram[-1, -1] += 1e-9 * (1.0 + gram[-1, -1])
            gradient = gradient + penalty * w
            step = -np.linalg.solve(gram, gradient)
            yield pd.DataFrame({"model": [m], "value": [value + 0.5 * float(penalty @ (w * w))],
                                "slope": [float(gradient @ step)], "step": [step.tobytes()]})

    summed = rows.mapInPandas(partial, "model int, value double, gradient binary, gram binary")
    solved = summed.repartition("model").mapInPandas(solve, "model int, value double, slope double, step binary")
    return {r["model"]: (r["value"], r["slope"], np.frombuffer(bytes(r["step"]))) for r in solved.collect()}


def fit_stacked(rows: DataFrame, loss: Loss, spaces: Sequence[Space], tasks: Sequence[Task], width: int,
                max_iter: int = 50, tol: float = 1e-7) -> list[Fit]:
    """All models of ``tasks`` over ``label double, fold int, at array<int>, value array<double>``.

    Each pass serves every model that has not ended. A model ends when a Newton step would lower its
    objective by less than ``tol`` of it; a step that does not lower it enough is halved in the next pass.
    ``max_iter`` bounds the passes; a model that it stops says so in ``converged``. A label column with one
    class only leaves the logistic intercept unbounded: such tasks must not be given (see ``classify``).
    """
    ship_package(rows.sparkSession)
    sizes = [len(spaces[t.space].columns) + 1 for t in tasks]
    at = {m: np.zeros(n) for m, n in enumerate(sizes)}
    best: dict[int, tuple[np.ndarray, float, float, np.ndarray]] = {}
    reach = dict.fromkeys(at, 1.0)
    fits: dict[int, Fit] = {}
    for n in range(1, max_iter + 1):
        found = _pass(rows, loss, spaces, tasks, width, at)
        for m in list(at):
            # Without rows there is only the penalty, and zero is its optimum.
            value, slope, step = found.get(m, (0.0, 0.0, np.zeros(sizes[m])))
            if m in best:
                _, before, promised, direction = best[m]
                if value > before + ARMIJO * reach[m] * promised + 1e-12 * abs(before) and reach[m] > 1e-6:
                    reach[m] /= 2
                    at[m] = best[m][0] + reach[m] * direction
                    continue
            done = -slope / 2 <= tol * max(abs(value), 1e-12)
            if done or n == max_iter:
                w = at.pop(m) + (step if done else 0.0)
                fits[m] = Fit(w[:-1], float(w[-1]), n, done)
                continue
            best[m], reach[m] = (at[m], value, slope, step), 1.0
            at[m] = at[m] + step
        if not at:
            break
    # Halved in the very last pass: the best point so far.
    for m in at:
        w = best[m][0]
        fits[m] = Fit(w[:-1], float(w[-1]), max_iter, False)
    return [fits[m] for m in range(len(tasks))]


def held_out_counts(rows: DataFrame, spaces: Sequence[Space], tasks: Sequence[Task], fits: Sequence[Fit],
                    width: int) -> DataFrame:
    """``model, tp, fp, fn, tn`` of every model on its held-out fold: one pass, a row per model."""
    weights = [np.append(f.coefficients, f.intercept) for f in fits]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(tasks), 4), dtype=np.int64)
        for raw, label, fold in _blocks(batches, width):
            for s, space in enumerate(spaces):
                keep = fold == space.held_out
                models = [m for m, t in enumerate(tasks) if t.space == s]
                if space.held_out is None or not models or not keep.any():
                    continue
                x, y = _features(raw[keep], space), label[keep] > 0
                for m in models:
                    said = x @ weights[m] > 0
                    sums[m] += [np.sum(said & y), np.sum(said & ~y), np.sum(~said & y), np.sum(~said & ~y)]
        yield pd.DataFrame({"model": np.arange(len(tasks)), **{c: sums[:, i] for i, c in enumerate(("tp", "fp", "fn", "tn"))}})

    schema = "model int, tp long, fp long, fn long, tn long"
    return rows.mapInPandas(count, schema).groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])

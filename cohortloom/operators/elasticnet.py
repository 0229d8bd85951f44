"""Many elastic-net logistic models fitted together over partitioned samples.

No model's training rows are gathered anywhere.  In every round each task adds
up, for each model, the weighted cross products of its own samples; Spark sums
them per model; a small solver turns each sum into the next coefficients.  A
round is one pass over the samples for all models, and Newton steps need few
rounds.  Only coefficients return to the driver: models x panel size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import matrix, vector_sum

# Penalty of the classifier.
L1_RATIO, INVERSE_STRENGTH = 0.5, 0.5


@dataclass(frozen=True)
class Model:
    """A fit: panel columns and the rule that says which samples train it.

    ``kind`` is "others" (all cohorts but ``cohort``), "own" (only ``cohort``)
    or "own_but_fold" (``cohort`` without fold ``fold``).
    """

    key: int
    panel: str
    repeat: int
    kind: str
    cohort: str
    fold: int
    columns: tuple[int, ...]

    def trains(self, cohort: np.ndarray, fold: np.ndarray) -> np.ndarray:
        if self.kind == "others":
            return cohort != self.cohort
        own = cohort == self.cohort
        return own if self.kind == "own" else own & (fold != self.fold)

    def tests(self, cohort: np.ndarray, fold: np.ndarray) -> np.ndarray:
        if self.kind == "others":
            return cohort == self.cohort
        return np.ones(len(cohort), bool) if self.kind == "own" else (cohort == self.cohort) & (fold == self.fold)

    @property
    def split(self) -> tuple[str, str, int]:
        return (self.kind, self.cohort, self.fold)


@dataclass(frozen=True)
class Fitted:
    """Coefficients on standardised columns, and the training mean and deviation."""

    model: Model
    intercept: float
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    n_train: int
    converged: bool = True


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (matrix(batch["x"]), batch["condition"].to_numpy().astype(float), np.array(batch["cohort"].to_pylist(), object),
            batch["fold"].to_numpy())


def _keyed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["key", "v"])


def _sums_per_key(rows: DataFrame, partial, key: str = "key") -> list:
    return rows.mapInArrow(partial, f"{key} int, v array<double>").groupBy(key).agg(
        vector_sum(F.col("v")).alias("v")).collect()


def _training_moments(rows: DataFrame, models: Sequence[Model]) -> dict[tuple, np.ndarray]:
    """Per distinct split: [n, positives, column sums, column square sums]."""
    firsts = list({m.split: m for m in models}.values())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, cohort, fold = _arrays(batch)
            for i, m in enumerate(firsts):
                keep = m.trains(cohort, fold)
                part = np.concatenate([[keep.sum(), y[keep].sum()], x[keep].sum(0), (x[keep] ** 2).sum(0)])
                sums[i] = part if i not in sums else sums[i] + part
        if sums:
            yield _keyed(sums)

    return {firsts[r["key"]].split: np.asarray(r["v"]) for r in _sums_per_key(rows, partial)}


def _soft(value: float, cut: float) -> float:
    return np.sign(value) * max(abs(value) - cut, 0.0)


def _settled(h: np.ndarray, c: np.ndarray, start: np.ndarray, l1: float, l2: float) -> np.ndarray | None:
    """The minimum of the quadratic model by solving for the columns in use, starting from those of ``start``.

    On the way to a solution with other signs the best point at which a column
    reaches zero is taken, and that column leaves; of the columns that would gain,
    the first enters.  None if this does not end.
    """
    if h[0, 0] <= 1e-12:
        return None
    ridge, b = h + np.diag(np.append(0.0, np.full(len(start) - 1, l2))), start.copy()
    on, sign = b != 0, np.sign(b)
    on[0], sign[0] = True, 0.0

    def objective(x: np.ndarray) -> float:
        return x @ ridge @ x / 2 - c @ x + l1 * np.abs(x[1:]).sum()

    for _ in range(20 * len(b)):
        new = np.zeros(len(b))
        new[on] = np.linalg.solve(ridge[np.ix_(on, on)], (c - l1 * sign)[on])
        turned = np.flatnonzero(on & (sign != 0) & (np.sign(new) != sign))
        if len(turned):
            points = [np.where(np.arange(len(b)) == j, 0.0, b + (new - b) * (b[j] / (b[j] - new[j]))) for j in turned if b[j] != new[j]]
            b = min([*points, new], key=objective)
            on, sign = b != 0, np.sign(b)
            on[0], sign[0] = True, 0.0
            continue
        b = new
        rest = np.where(on, 0.0, c - h @ b)
        gain = int(np.argmax(np.abs(rest)))
        if abs(rest[gain]) <= l1 * (1 + 1e-9):
            return b
        on[gain], sign[gain] = True, np.sign(rest[gain])
    return None


def _next_weights(h: np.ndarray, c: np.ndarray, start: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Coordinate descent on the quadratic model, ended by a solve as soon as one settles; column 0 is the free intercept.

    Sums grow with the samples and the penalty does not, so on columns that add up
    to zero, as the CLR's do, descent alone needs the more sweeps the more samples there are.
    """
    b = start.copy()
    hb = h @ b
    for sweep in range(500):
        moved = 0.0
        for j in range(len(b)):
            rest = c[j] - hb[j] + h[j, j] * b[j]
            if j == 0:
                new = rest / max(h[0, 0], 1e-12)
            else:
                new = _soft(rest, l1) / (h[j, j] + l2)
            step = new - b[j]
            if step:
                hb += h[:, j] * step
                b[j] = new
                moved = max(moved, abs(step))
        if moved < 1e-10:
            break
        if sweep in (1, 99) and (solved := _settled(h, c, b, l1, l2)) is not None:
            return solved
    return b


def fit_models(rows: DataFrame, models: Sequence[Model], rounds: int = 25, tolerance: float = 1e-7) -> list[Fitted]:
    """Fit every model whose training rows hold both classes.

    ``rows`` has (sample_id, cohort, condition, fold, x) and should be a written
    table, since every round reads it once.  A model still moving after ``rounds``
    keeps the best coefficients that were evaluated and is marked not converged.
    """
    moments = _training_moments(rows, models)
    l1, l2 = L1_RATIO / INVERSE_STRENGTH, (1 - L1_RATIO) / INVERSE_STRENGTH
    splits: dict[tuple, dict] = {}
    for split, v in moments.items():
        if 0 < v[1] < v[0]:
            n, width = v[0], (len(v) - 2) // 2
            mean = v[2:2 + width] / n
            spread = np.sqrt(np.maximum(v[2 + width:] / n - mean ** 2, 0.0))
            spread = np.where(spread > 1e-9 * np.maximum(np.abs(mean), 1e-9), spread, 1.0)
            splits[split] = {"mean": mean, "scale": spread, "n": int(n), "w1": n / (2 * v[1]), "w0": n / (2 * (n - v[1]))}
    live: dict[int, dict] = {}
    for m in models:
        if m.split in splits and m.columns:
            zero = np.zeros(len(m.columns) + 1)
            live[m.key] = {"m": m, "try": zero, "at": zero, "best": np.inf, "done": False}
    for _ in range(rounds):
        active = {k: s for k, s in live.items() if not s["done"]}
        if not active:
            break
        for row in _solve_round(rows, active, splits, l1, l2).collect():
            s = live[row["key"]]
            if row["objective"] > s["best"] * (1 + 1e-12) + 1e-12:
                s["try"] = (s["at"] + s["try"]) / 2
                s["done"] = bool(np.max(np.abs(s["try"] - s["at"])) < tolerance)
                continue
            s["at"], s["best"] = s["try"], row["objective"]
            s["try"] = np.asarray(row["weights"])
            s["done"] = bool(np.max(np.abs(s["try"] - s["at"])) < tolerance)
    for s in live.values():
        s["out"] = s["try"] if s["done"] else s["at"]  # "try" is not evaluated before it is settled
    return [Fitted(m, float(s["out"][0]), s["out"][1:], facts["mean"][list(m.columns)], facts["scale"][list(m.columns)], facts["n"], s["done"])
            for s in live.values() for m in [s["m"]] for facts in [splits[m.split]]]


def _standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Columns by rows, standardised, with a last row of ones: a model takes the rows of its columns, and the last for its intercept."""
    out = np.ones((x.shape[1] + 1, len(x)))
    out[:-1] = ((x - mean) / scale).T
    return out


def _solve_round(rows: DataFrame, active: dict[int, dict], splits: dict[tuple, dict], l1: float, l2: float) -> DataFrame:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, cohort, fold = _arrays(batch)
            shared: dict[tuple, tuple] = {}
            for key, s in active.items():
                m, b = s["m"], s["try"]
                if m.split not in shared:
                    keep, facts = np.flatnonzero(m.trains(cohort, fold)), splits[m.split]
                    zt, t = _standardised(x[keep], facts["mean"], facts["scale"]), y[keep]
                    shared[m.split] = zt, t, np.where(t == 1, facts["w1"], facts["w0"]), {}
                zt, t, cw, start = shared[m.split]
                if not len(t):
                    continue
                at = np.array([len(zt) - 1, *m.columns])
                if not b.any():  # all odds are even: the sums are those of the split's models on all columns
                    if not start:
                        start |= {"loss": np.log(2.0) * cw.sum(), "slope": zt @ (cw * (t - 0.5)), "cross": (zt * (cw / 4)) @ zt.T}
                    loss, slope, cross = start["loss"], start["slope"][at], start["cross"][np.ix_(at, at)]
                else:
                    z = zt[at]
                    eta = b @ z
                    p = 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))
                    loss = float(np.sum(cw * (np.log1p(np.exp(-np.abs(eta))) + np.maximum(eta, 0.0) - t * eta)))
                    slope = z @ (cw * (t - p))
                    z *= np.sqrt(cw * np.maximum(p * (1 - p), 1e-10))
                    cross = z @ z.T
                part = np.concatenate([[loss], slope, cross[np.triu_indices(len(at))]])
                sums[key] = part if key not in sums else sums[key] + part
        if sums:
            yield _keyed(sums)

    starts = {k: s["try"] for k, s in active.items()}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            objective, weights = [], []
            for key, v in zip(batch["key"], batch["v"]):
                b, v = starts[key], np.asarray(v)
                p = len(b)
                g, h = v[1:1 + p], np.zeros((p, p))
                h[np.triu_indices(p)] = v[1 + p:]
                h += np.triu(h, 1).T
                objective.append(v[0] + l1 * np.abs(b[1:]).sum() + l2 / 2 * (b[1:] ** 2).sum())
                weights.append(_next_weights(h, h @ b + g, b, l1, l2))
            yield pd.DataFrame({"key": batch["key"], "objective": objective, "weights": weights})

    summed = rows.mapInArrow(partial, "key int, v array<double>").groupBy("key").agg(vector_sum(F.col("v")).alias("v"))
    return summed.mapInPandas(solve, "key int, objective double, weights array<double>")


def _probabilities(fit: Fitted, columns: np.ndarray) -> np.ndarray:
    """Of every sample, given the columns of ``x``; added up in one order, so that equal samples tie wherever they lie in a batch."""
    eta = np.full(columns.shape[1], fit.intercept)
    for place, weight, mean, scale in zip(fit.model.columns, fit.weights, fit.mean, fit.scale):
        if weight:
            eta += (columns[place] - mean) / scale * weight
    return 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))


def predictions(rows: DataFrame, fitted: Sequence[Fitted]) -> DataFrame:
    """(key, sample_id, cohort, condition, probability) for every tested sample."""
    kind = rows.schema["sample_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, cohort, fold = _arrays(batch)
            for f in fitted:
                test = np.flatnonzero(f.model.tests(cohort, fold))
                if not len(test):
                    continue
                at = pa.array(test)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(test), f.model.key, np.int32)), batch["sample_id"].take(at), batch["cohort"].take(at),
                    pa.array(y[test].astype(np.int32)), pa.array(_probabilities(f, x[test].T))], names)

    names = ["key", "sample_id", "cohort", "condition", "probability"]
    return rows.mapInArrow(score, f"key int, sample_id {kind}, cohort string, condition int, probability double")


def rank_metrics(rows: DataFrame, fitted: Sequence[Fitted]) -> DataFrame:
    """(key, auroc, average_precision) of every fit over its tested samples, as ``class_rank_metrics`` finds them from ``predictions``.

    No row exists for a score: a task sends the sorted scores of its cases and controls for each fit as one compressed
    row, and a task that ranks them holds those of one fit.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, cohort, fold = _arrays(batch)
            tests: dict[tuple, np.ndarray] = {}
            for i in range(0, len(fitted), 256):
                found = []
                for f in fitted[i:i + 256]:
                    if f.model.split not in tests:
                        at = np.flatnonzero(f.model.tests(cohort, fold))
                        tests[f.model.split] = np.ascontiguousarray(x[at].T), y[at] == 1
                    xt, case = tests[f.model.split]
                    if len(case):
                        p = _probabilities(f, xt)
                        found.append((f.model.key, int(case.sum()), int(len(case) - case.sum()), _packed_scores(p[case], p[~case])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                                                     ["key", "n1", "n0", "scores"])

    def metrics(table: pa.Table) -> pa.Table:
        sides = [_unpacked_scores(*row) for row in zip(table["n1"].to_pylist(), table["n0"].to_pylist(), table["scores"])]
        case, control = (np.sort(np.concatenate(side)) for side in zip(*sides))
        auroc = precision = None
        if len(case) and len(control):
            below, upto = (np.searchsorted(control, case, side) for side in ("left", "right"))
            auroc = float((below + upto).sum() / 2 / (len(case) * len(control)))
            hits = len(case) - np.searchsorted(case, case, "left")
            precision = float(np.mean(hits / (hits + len(control) - below)))
        return pa.table({"key": table["key"].slice(0, 1), "auroc": pa.array([auroc], pa.float64()), "average_precision": pa.array([precision], pa.float64())})

    return (rows.mapInArrow(score, "key int, n1 int, n0 int, scores binary").groupBy("key")
            .applyInArrow(metrics, "key int, auroc double, average_precision double"))


def _packed_scores(case: np.ndarray, control: np.ndarray) -> bytes:
    """Positive numbers in order, cases before controls, as compressed steps between their bit patterns."""
    steps = np.diff(np.concatenate([np.sort(case), np.sort(control)]).view(np.uint64), prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked_scores(n1: int, n0: int, packed: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(packed.as_buffer(), (n1 + n0) * 8, codec="zstd"), np.uint8).reshape(8, -1)
    scores = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64).view(np.float64)
    return scores[:n1], scores[n1:]


def coefficient_table(rows: DataFrame, fitted: Sequence[Fitted], names: Sequence[str]) -> DataFrame:
    """(panel, repeat, held_out, feature, weight) of every fit."""
    out = [(f.model.panel, f.model.repeat, f.model.cohort, names[c], float(w))
           for f in fitted for c, w in zip(f.model.columns, f.weights)]
    return rows.sparkSession.createDataFrame(
        out, "panel string, repeat int, held_out string, feature string, weight double")


def feature_weights(coefficients: DataFrame) -> DataFrame:
    """Mean, mean absolute and selected share of a feature's weights over folds."""
    return coefficients.groupBy("feature").agg(
        F.avg("weight").alias("mean_weight"), F.avg(F.abs("weight")).alias("mean_abs_weight"),
        F.avg((F.abs("weight") > 1e-8).cast("double")).alias("selected_fraction"))

"""Per-offer Bayesian logistic regression, fitted on Spark.

Each model keeps a mean and a diagonal precision.  Tasks turn their rows into
one gradient and one Hessian per model with numpy; Spark adds these up; only
the sums, whose size depends on the number of models and features and not on
the number of rows, reach the driver for the small solve.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bound on one step of a weight, bound on the logit.
MAX_STEP = 2.0
LOGIT_BOUND = 35.0
# Fixed value: steps of one diagonal update.
DIAGONAL_STEPS = 3
#: Models are small state held on the driver; more than this is a wrong key.
MAX_MODELS = 10_000
#: Tasks that add up packed sums before the driver does.
TASK_GROUPS = 8

ARM_SCHEMA = "offer_id string, value double, m array<double>, q array<double>"


@dataclass(frozen=True)
class Arm:
    """An offer with the net value of a success and the posterior of its weights."""

    offer_id: str
    value: float
    m: tuple[float, ...] = ()
    q: tuple[float, ...] = ()


def collect_arms(df: DataFrame) -> list[Arm]:
    """Arms in order of their id.  The row count is checked before they are used."""
    rows = df.limit(MAX_MODELS + 1).collect()
    if len(rows) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} offers; offers are expected to be a small dimension")
    found = df.columns
    pick = lambda r, c: tuple(r[c]) if c in found else ()
    arms = [Arm(r["offer_id"], r["value"] if "value" in found else 0.0, pick(r, "m"), pick(r, "q")) for r in rows]
    return sorted(arms, key=lambda a: a.offer_id)


def arms_frame(spark: SparkSession, arms: Iterable[Arm]) -> DataFrame:
    return spark.createDataFrame([(a.offer_id, a.value, list(a.m), list(a.q)) for a in arms], ARM_SCHEMA)


def prior_arms(values: Mapping[str, float], n_features: int, precision: float = 1.0) -> list[Arm]:
    zero, flat = (0.0,) * n_features, (precision,) * n_features
    return [Arm(offer, values[offer], zero, flat) for offer in sorted(values)]


# -- batch Newton -------------------------------------------------------------------------


@dataclass
class Model:
    """Current weights with the Gaussian they are drawn towards."""

    m: np.ndarray
    q: np.ndarray
    w: np.ndarray


@dataclass
class Sums:
    """What one pass over the rows of a model adds up to."""

    n: float
    rewards: float
    loss: float
    gradient: np.ndarray
    hessian: np.ndarray


def _pack(x: np.ndarray, y: np.ndarray, w: np.ndarray, diagonal: bool) -> np.ndarray:
    z = np.clip(x @ w, -LOGIT_BOUND, LOGIT_BOUND)
    p = 1.0 / (1.0 + np.exp(-z))
    loss = np.logaddexp(0.0, z) - y * z
    if diagonal:
        curvature = (p * (1 - p)) @ (x * x)
    else:
        curvature = ((x * (p * (1 - p))[:, None]).T @ x)[np.triu_indices(len(w))]
    return np.concatenate([[len(y), y.sum(), loss.sum()], x.T @ (p - y), curvature])


def _unpack(packed: np.ndarray, d: int) -> Sums:
    if len(packed) == 3 + 2 * d and d > 1:
        return Sums(packed[0], packed[1], packed[2], packed[3 : 3 + d], np.diag(packed[3 + d :]))
    hessian = np.zeros((d, d))
    hessian[np.triu_indices(d)] = packed[3 + d :]
    hessian = hessian + np.triu(hessian, 1).T
    return Sums(packed[0], packed[1], packed[2], packed[3 : 3 + d], hessian)


def newton_sums(rows: DataFrame, weights: Mapping[str, np.ndarray], diagonal: bool = False) -> dict[str, Sums]:
    """Add up gradient and Hessian, or only its ``diagonal``, of each model over ``rows`` (model, x, reward).

    Every task sends one packed row per model; groups of tasks are added up in Arrow
    before the driver adds the groups.  Rows of a model without weights are left out: a send
    of an offer that is not in the offer table says nothing about the others.
    """
    d = len(next(iter(weights.values())))

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column("reward").to_numpy(zero_copy_only=False).astype(float)
            codes = batch.column("model").dictionary_encode()
            index = codes.indices.to_numpy(zero_copy_only=False)
            for code, model in enumerate(codes.dictionary.to_pylist()):
                if model not in weights:
                    continue
                mine = index == code
                part = _pack(x[mine], y[mine], weights[model], diagonal)
                total[model] = total[model] + part if model in total else part
        yield from packed(total)

    def packed(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if total:
            yield pa.RecordBatch.from_pydict(
                {
                    "model": pa.array(list(total), pa.string()),
                    "parts": pa.array(list(total.values()), pa.list_(pa.float64())),
                }
            )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for model, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = part.values.to_numpy()
                total[model] = total[model] + part if model in total else part
        yield from packed(total)

    shape = "model string, parts array<double>"
    parts = rows.select("model", "x", "reward").mapInArrow(per_partition, shape)
    grouped = parts.repartition(TASK_GROUPS, "model", F.pmod(F.monotonically_increasing_id(), F.lit(TASK_GROUPS)))
    out: dict[str, np.ndarray] = {}
    for row in sorted(grouped.mapInArrow(added, shape).collect(), key=lambda r: (r["model"], r["parts"])):
        part = np.array(row["parts"])
        out[row["model"]] = out[row["model"]] + part if row["model"] in out else part
    return {model: _unpack(part, d) for model, part in out.items()}


def fit(
    rows: DataFrame, models: dict[str, Model], max_passes: int = 25, tolerance: float = 1e-8
) -> dict[str, Sums]:
    """Move every model's ``w`` to the mode of its penalised likelihood, all in the same passes.

    Newton with the full Hessian, each coordinate's step bounded.  A step that
    raises the objective is halved.  Returns the sums at each model's last point.
    """
    if len(models) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models in one fit")
    accepted: dict[str, tuple[float, np.ndarray]] = {}
    last: dict[str, Sums] = {}
    open_models = set(models)
    for _ in range(max_passes):
        sums = newton_sums(rows, {k: v.w for k, v in models.items()})
        open_models &= set(sums)
        for key in sorted(open_models):
            model, s = models[key], sums[key]
            away = model.w - model.m
            objective = s.loss + 0.5 * float(np.sum(model.q * away**2))
            if key in accepted and objective > accepted[key][0] + 1e-10 * (1 + abs(objective)):
                model.w = (model.w + accepted[key][1]) / 2
                continue
            accepted[key], last[key] = (objective, model.w.copy()), s
            curvature = s.hessian + np.diag(model.q + 1e-9)
            step = np.clip(np.linalg.solve(curvature, model.q * away + s.gradient), -MAX_STEP, MAX_STEP)
            model.w = model.w - step
            if np.max(np.abs(step)) < tolerance:
                open_models.discard(key)
        if not open_models:
            break
    return last


def update_arms(kept: DataFrame, arms: Sequence[Arm]) -> tuple[list[Arm], dict[str, Sums]]:
    """Posterior of every arm after the outcomes in ``kept`` (model = offer_id, x, reward)."""
    models = {a.offer_id: Model(np.array(a.m), np.array(a.q), np.array(a.m)) for a in arms}
    sums = fit(kept, models)
    updated = []
    for a in arms:
        if a.offer_id in sums:
            q = np.array(a.q) + np.diag(sums[a.offer_id].hessian)
            a = Arm(a.offer_id, a.value, tuple(models[a.offer_id].w.tolist()), tuple(q.tolist()))
        updated.append(a)
    return updated, sums


def diagonal_update(kept: DataFrame, arms: Sequence[Arm], steps: int = DIAGONAL_STEPS) -> tuple[list[Arm], dict[str, Sums]]:
    """Posterior of every arm by a few bounded steps with the diagonal of the Hessian only.

    ``kept`` has model = offer_id, x, reward.  Every pass adds up two numbers per feature and arm;
    the last one, at the new mean, gives the precision.  All rows of a call are one batch.
    """
    at = {a.offer_id: np.array(a.m) for a in arms}
    sums: dict[str, Sums] = {}
    for step in range(steps + 1):
        sums = newton_sums(kept, at, diagonal=True)
        for a in arms if step < steps else ():
            if a.offer_id in sums:
                w, q, s = at[a.offer_id], np.array(a.q), sums[a.offer_id]
                slope = q * (w - np.array(a.m)) + s.gradient
                at[a.offer_id] = w - np.clip(slope / (q + np.diag(s.hessian)), -MAX_STEP, MAX_STEP)
    updated = [
        Arm(a.offer_id, a.value, tuple(at[a.offer_id].tolist()), tuple((np.array(a.q) + np.diag(sums[a.offer_id].hessian)).tolist()))
        if a.offer_id in sums
        else a
        for a in arms
    ]
    return updated, sums


def first_step(design: DataFrame, values: Mapping[str, float], n_features: int, precision: float = 1.0) -> list[Arm]:
    """Posterior of every offer after one diagonal step from a zero mean.

    Two passes: slope and curvature at the prior give the step, the curvature at
    the new mean the precision.  An offer without rows keeps its prior.
    """
    rows = design.select(F.col("offer_id").alias("model"), "x", "reward")
    prior = prior_arms(values, n_features, precision)
    start = newton_sums(rows, {a.offer_id: np.zeros(n_features) for a in prior})
    means = {
        offer: -np.clip(s.gradient / (precision + np.diag(s.hessian)), -MAX_STEP, MAX_STEP) for offer, s in start.items()
    }
    if not means:
        return prior
    curved = newton_sums(rows, means)
    return [
        Arm(a.offer_id, a.value, tuple(means[a.offer_id].tolist()), tuple((precision + np.diag(curved[a.offer_id].hessian)).tolist()))
        if a.offer_id in means
        else a
        for a in prior
    ]


# -- response models ----------------------------------------------------------------------


#: Folds whose models are held at once, and slices a learning replay is cut into.
MAX_FOLDS = 500


def time_slices(rows: DataFrame, column: str = "round_day", most: int = MAX_FOLDS) -> list[tuple]:
    """(low, high): consecutive ranges of a time column, each with rows and both ends included.

    As many as there are different times, if they are at most ``most``; beyond it equal parts by a
    quantile sketch, so that their number does not grow with the data.  Null times are (None, None).
    """
    times = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    unknown = [] if rows.where(F.col(column).isNull()).isEmpty() else [(None, None)]
    if len(times) <= most:
        return unknown + [(t, t) for t in sorted(times)]
    edges = rows.agg(F.percentile_approx(column, [i / most for i in range(1, most + 1)], 20 * most)).first()[0]
    ends = rows.agg(F.min(column), F.max(column)).first()
    cuts = sorted({*edges, ends[1]})
    found = []
    for k, high in enumerate(cuts):
        part = rows.where((F.col(column) > cuts[k - 1]) if k else F.lit(True)).where(F.col(column) <= high)
        low = part.agg(F.min(column)).first()[0]
        if low is not None:
            found.append((low, high))
    return unknown + found


def in_slice(column: str, low, high) -> Column:
    return F.col(column).isNull() if low is None else F.col(column).between(low, high)


def fit_heldout(design: DataFrame, values: Mapping[str, float], n_features: int) -> list[tuple]:
    """Response models of a rolling origin: (round, its models fitted on earlier rounds only).

    A row adds to the sums of every later fold, so all folds of all offers share the same passes.
    """
    days = [low for low, _ in time_slices(design) if low is not None]
    ridge = np.array([0.0] + [1.0] * (n_features - 1))
    zero = np.zeros(n_features)
    models = {f"{o}|{day}": Model(zero, ridge, zero.copy()) for o in values for day in days[1:]}
    if not models:
        return []
    later = F.filter(F.lit(days[1:]), lambda day: day > F.col("round_day"))
    rows = design.select("offer_id", "x", "reward", F.explode(later).alias("fold"))
    fit(rows.select(F.concat_ws("|", "offer_id", "fold").alias("model"), "x", "reward"), models, max_passes=40)
    flat = tuple([1.0] * n_features)
    return [(d, [Arm(o, values[o], tuple(models[f"{o}|{d}"].w.tolist()), flat) for o in sorted(values)]) for d in days[1:]]


def fit_response_models(design: DataFrame, values: Mapping[str, float], n_features: int) -> list[Arm]:
    """One logistic response model per offer: unit ridge on the weights, free intercept.

    The bias is the intercept, so it alone is not drawn to zero.  All offers are
    fitted in the same few passes.
    """
    ridge = np.array([0.0] + [1.0] * (n_features - 1))
    zero = np.zeros(n_features)
    models = {offer: Model(zero, ridge, zero.copy()) for offer in values}
    fit(design.select(F.col("offer_id").alias("model"), "x", "reward"), models, max_passes=40)
    return [Arm(o, values[o], tuple(models[o].w.tolist()), tuple(ridge.tolist())) for o in sorted(models)]

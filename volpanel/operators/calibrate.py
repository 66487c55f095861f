"""Surface calibration of all dates at once.

Nodes are packed once into bounded arrays per (date, salt); a date with many nodes has many packs, spread over
tasks. A round joins the packs with the few numbers that describe where their date stands, evaluates all
candidates of a pack at once, and adds up one short vector per pack: the only exchange of a round.
``lattice_fit`` searches a refining lattice in this way, ``refine_fit`` adds damped Gauss-Newton steps until
every date has converged. Dates do not depend on each other, so there is no warm-start chain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.functions import ssvi
from volpanel.functions.mathx import clip
from volpanel.operators import surface
from volpanel.operators.keys import STATE_KEY
from volpanel.operators.score import HUBER_DELTA
from volpanel.operators.skew import parallelism
from volpanel.session import cut_lineage

# Losses closer than this are ties, broken by candidate number.
LOSS_DIGITS = 13

# A date with more nodes than this is split over several packs.
NODES_PER_PACK = 2000


@dataclass(frozen=True)
class Lattice:
    """Centre and half-width per searched parameter; every round shrinks the widths by ``shrink``.

    ``steps`` gives the points along (rho, log eta, lambda, variance scale) for each round.
    """

    rho: tuple[float, float] = (-0.2, 0.75)
    log_eta: tuple[float, float] = (-0.2, 1.6)
    lam: tuple[float, float] = (0.25, 0.24)
    scale: tuple[float, float] = (1.0, 0.1)
    steps: tuple[tuple[int, int, int, int], ...] = ((7, 7, 5, 5), (7, 7, 5, 5), (7, 7, 5, 5))
    shrink: float = 0.4

    def axes(self, round_no: int) -> list[list[float]]:
        """Offsets from the centre along each parameter."""
        width = self.shrink**round_no
        ranges = (self.rho, self.log_eta, self.lam, self.scale)
        return [
            [o * half * width for o in offsets(n)] for (_, half), n in zip(ranges, self.steps[round_no])
        ]

    def candidates(self, round_no: int) -> np.ndarray:
        """Offsets of every candidate (candidates x 4), the last parameter running fastest."""
        grid = np.meshgrid(*self.axes(round_no), indexing="ij")
        return np.stack([g.ravel() for g in grid], axis=1)


def offsets(steps: int) -> list[float]:
    return [-1.0 + 2.0 * i / (steps - 1) for i in range(steps)]



# --- packs ------------------------------------------------------------------------------------

def pack_nodes(nodes: DataFrame, key: tuple[str, ...], columns: tuple[str, ...], per_pack: int = NODES_PER_PACK) -> DataFrame:
    """Nodes as arrays, one row per (date, ``_salt``) with about ``per_pack`` nodes at most.

    The repartition by date and salt is what spreads a heavy date; grouping by date alone would undo it.
    """
    sizes = nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    salts = F.ceil(F.col("_n") / per_pack).cast("bigint")
    salted = nodes.join(sizes, list(key)).withColumns({"_packs": salts, "_salt": F.pmod(F.xxhash64("m", "tau"), salts)})
    dealt = salted.repartition(parallelism(nodes), *key, "_salt")
    order = ("tau", "m", *[c for c in columns if c not in ("tau", "m")])
    rows = dealt.groupBy(*key, "_salt", "_packs").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_nodes"))
    return rows.select(*key, "_salt", "_packs", *[F.col(f"_nodes.{c}").alias(c) for c in columns])


def beside(packs: DataFrame, dates: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Packs next to the row of their date. The join is on date and salt, so a heavy date stays spread."""
    named = packs.select(*key, "_salt").join(dates, list(key))
    return packs.join(named, [*key, "_salt"])


def summed(parts: DataFrame, key: tuple[str, ...], *carried: str) -> DataFrame:
    """The vectors ``part`` of a date's packs as one array, in pack order; ``carried`` columns are equal in all of them."""
    packs = F.array_sort(F.collect_list(F.struct("_salt", "part")))
    firsts = [F.first(c).alias(c) for c in carried]
    return parts.groupBy(*key).agg(F.transform(packs, lambda p: p["part"]).alias("parts"), *firsts)


def _total(parts) -> np.ndarray:
    return np.stack([np.asarray(p, dtype=float) for p in parts]).sum(axis=0)


def _huber(error: np.ndarray) -> np.ndarray:
    size = np.abs(error)
    return np.where(size <= HUBER_DELTA, 0.5 * error * error, HUBER_DELTA * (size - 0.5 * HUBER_DELTA))


def _eta_cap(top, rho, lam):
    """As ``ssvi.eta_cap``, on arrays."""
    top, tilt = np.maximum(top, ssvi.EPSILON), 1.0 + np.abs(rho)
    slope = 4.0 / np.maximum(tilt * top ** (1.0 - lam), ssvi.EPSILON)
    curve = np.sqrt(4.0 / np.maximum(tilt * top ** (1.0 - 2.0 * lam), ssvi.EPSILON))
    return np.maximum(np.minimum(slope, curve) * ssvi.ETA_SAFETY, ssvi.ETA_FLOOR)


# --- lattice search ---------------------------------------------------------------------------

def admissible(offsets_: np.ndarray, centre: np.ndarray, top: float) -> tuple[np.ndarray, ...]:
    """rho, eta, lambda and variance scale of the candidates around a centre.

    Eta never exceeds its cap, so equal surfaces can occur; ties go to the smaller candidate number.
    """
    rho = np.clip(centre[0] + offsets_[:, 0], -0.98, 0.98)
    lam = np.clip(centre[2] + offsets_[:, 2], ssvi.LAMBDA_LOW, ssvi.LAMBDA_HIGH)
    scale = centre[3] + offsets_[:, 3]
    eta = np.minimum(np.exp(centre[1] + offsets_[:, 1]), _eta_cap(top * scale, rho, lam))
    return rho, eta, lam, scale


def lattice_round(packs: DataFrame, centres: DataFrame, lattice: Lattice, round_no: int, key: tuple[str, ...]) -> DataFrame:
    """Best candidate per date: ``centre`` (rho, log eta, lambda, scale) and ``loss``.

    ``centres`` has ``centre`` and ``top``, the last knot's variance; packs carry ``theta``, the interpolated ATM
    variance at their nodes. A pack's part is its loss under every candidate and its weight.
    """
    grid = lattice.candidates(round_no)

    def losses(m: pd.Series, tau: pd.Series, iv: pd.Series, vega: pd.Series, theta: pd.Series, centre: pd.Series, top: pd.Series) -> pd.Series:
        found = []
        for m_, tau_, iv_, vega_, theta_, centre_, top_ in zip(m, tau, iv, vega, theta, centre, top):
            rho, eta, lam, scale = (x[:, None] for x in admissible(grid, centre_, top_))
            t = theta_[None, :] * scale
            k = eta * t**-lam * m_[None, :]
            root = np.sqrt((k + rho) * (k + rho) + 1.0 - rho * rho)
            error = np.sqrt(0.5 * t * (1.0 + rho * k + root) / tau_[None, :]) - iv_[None, :]
            found.append(np.append((vega_[None, :] * _huber(error)).sum(axis=1), vega_.sum()))
        return pd.Series(found)

    def best(parts: pd.Series, centre: pd.Series, top: pd.Series) -> pd.DataFrame:
        rows = []
        for parts_, centre_, top_ in zip(parts, centre, top):
            total = _total(parts_)
            loss = total[:-1] / total[-1]
            at = int(np.argmin(np.round(loss, LOSS_DIGITS)))
            rho, eta, lam, scale = (float(x[at]) for x in admissible(grid, centre_, top_))
            rows.append((float(loss[at]), [rho, float(np.log(eta)), lam, scale]))
        return pd.DataFrame(rows, columns=["loss", "centre"])

    score = F.pandas_udf(losses, "array<double>")
    choose = F.pandas_udf(best, "loss double, centre array<double>")
    parts = beside(packs, centres.select(*key, "centre", "top"), key).select(
        *key, "_salt", "centre", "top", score("m", "tau", "node_iv", "node_vega", "theta", "centre", "top").alias("part")
    )
    chosen = summed(parts, key, "centre", "top").select(*key, "top", choose("parts", "centre", "top").alias("b"))
    return chosen.select(*key, "top", "b.loss", "b.centre")


def lattice_fit(
    nodes: DataFrame, key: tuple[str, ...] = STATE_KEY, lattice: Lattice = Lattice(), checkpoint: bool = True
) -> DataFrame:
    """Surface state per date from the refining lattice; columns are the parameters and ``loss``."""
    keep = nodes.select(*key, "expiration", "strike", "m", "tau", "node_iv", "node_vega")
    slim = cut_lineage(keep) if checkpoint else keep
    thetas = surface.interpolated_thetas(surface.atm_total_variance(slim, key), key)
    thetas = cut_lineage(thetas) if checkpoint else thetas
    at_nodes = slim.join(thetas, list(key)).select(
        *key, "m", "tau", "node_iv", "node_vega",
        F.greatest(ssvi.theta_curve("tau"), F.lit(ssvi.EPSILON)).alias("theta"),
    )
    packs = pack_nodes(at_nodes, key, ("m", "tau", "node_iv", "node_vega", "theta"))
    packs = cut_lineage(packs) if checkpoint else packs
    start = [lattice.rho[0], lattice.log_eta[0], lattice.lam[0], lattice.scale[0]]
    best = thetas.select(
        *key, F.col(ssvi.THETA_COLUMNS[-1]).alias("top"), F.array(*[F.lit(float(x)) for x in start]).alias("centre")
    )
    for round_no in range(len(lattice.steps)):
        best = lattice_round(packs, best, lattice, round_no, key)
        if checkpoint:
            best = cut_lineage(best)
    fitted = best.join(thetas, list(key)).withColumns(
        {
            **{c: F.col(c) * F.col("centre")[3] for c in ssvi.THETA_COLUMNS},
            "rho": F.col("centre")[0],
            "eta": F.exp(F.col("centre")[1]),
            "lambda": F.col("centre")[2],
        }
    )
    return fitted.select(*key, *ssvi.PARAMETER_COLUMNS, "loss")


# --- distributed Gauss-Newton -----------------------------------------------------------------

STEP_SIZES = (1.0, 0.4, 0.1)
DAMPING = (1e-4, 1e6)
# Weight, as a share of the largest diagonal entry, that ties every parameter to where it stands. Knots and directions that the nodes
# hardly determine then stay put instead of amplifying rounding; determined ones don't feel it. The optimum is the same.
PRIOR = 1e-6
# A date has converged when its loss falls by less than this share, or no damping finds a better step.
LOSS_SHARE = 1e-4
SIZE = len(ssvi.PARAMETER_COLUMNS)
KNOTS = len(ssvi.THETA_COLUMNS)

# Starts are moved this far inside the parameter range, where every derivative is alive.
INNER_RHO = 0.95
INNER_LAMBDA = (0.05, 0.4)


def decode(z: np.ndarray) -> np.ndarray:
    """Latent state to parameters, as ``ssvi.with_constrained``."""
    thetas = np.maximum.accumulate(np.exp(z[:KNOTS]))
    rho = np.clip(np.tanh(z[KNOTS]), -ssvi.RHO_LIMIT, ssvi.RHO_LIMIT)
    lam = np.clip(0.5 / (1.0 + np.exp(-z[KNOTS + 2])), ssvi.LAMBDA_LOW, ssvi.LAMBDA_HIGH)
    eta = min(np.exp(z[KNOTS + 1]), _eta_cap(thetas[-1], rho, lam))
    return np.concatenate([thetas, [rho, eta, lam]])


def encode(p: np.ndarray) -> np.ndarray:
    """Parameters to latent state, as ``ssvi.with_latent``."""
    rho = np.clip(p[KNOTS], -ssvi.RHO_LIMIT, ssvi.RHO_LIMIT)
    share = np.clip(2.0 * p[KNOTS + 2], 1e-6, 1.0 - 1e-6)
    logs = np.log(np.maximum(p[: KNOTS], ssvi.EPSILON))
    return np.concatenate([logs, [np.arctanh(rho), np.log(max(p[KNOTS + 1], ssvi.EPSILON)), np.log(share / (1.0 - share))]])


def normal_equations(p: np.ndarray, m: np.ndarray, tau: np.ndarray, iv: np.ndarray, vega: np.ndarray) -> np.ndarray:
    """Loss, J'WJ and J'We of a pack's nodes at parameters ``p`` (a vector of sums).

    Volatility at a node depends on the two knots around its maturity and on rho, eta and lambda.
    """
    taus, thetas, (rho, eta, lam) = np.asarray(ssvi.KNOT_TAUS), p[:KNOTS], p[KNOTS:]
    left = np.clip(np.searchsorted(taus, tau, side="left") - 1, 0, KNOTS - 2)
    share = np.clip((tau - taus[left]) / (taus[left + 1] - taus[left]), 0.0, 1.0)
    theta = np.maximum(thetas[left] + (thetas[left + 1] - thetas[left]) * share, ssvi.EPSILON)
    km = max(eta, ssvi.EPSILON) * theta**-lam * m
    radical = np.sqrt((km + rho) * (km + rho) + 1.0 - rho * rho)
    w = 0.5 * theta * (1.0 + rho * km + radical)
    model = np.sqrt(w / tau)
    error = model - iv
    bend = rho + (km + rho) / radical
    to_iv = 1.0 / (2.0 * tau * model)
    d_theta = to_iv * (w / theta - 0.5 * lam * km * bend)
    d_eta = to_iv * 0.5 * theta * km * bend
    rows = np.arange(len(m))
    jacobian = np.zeros((len(m), SIZE))
    jacobian[rows, left] = d_theta * (1.0 - share) * thetas[left]
    jacobian[rows, left + 1] = d_theta * share * thetas[left + 1]
    jacobian[:, KNOTS] = to_iv * 0.5 * theta * km * (1.0 + 1.0 / radical) * (1.0 - rho * rho)
    jacobian[:, KNOTS + 1] = d_eta
    jacobian[:, KNOTS + 2] = -d_eta * np.log(theta) * lam * (1.0 - 2.0 * lam)
    size = np.abs(error)
    weight = vega * np.where(size <= HUBER_DELTA, 1.0, HUBER_DELTA / np.maximum(size, HUBER_DELTA))
    weighted = jacobian * weight[:, None]
    return np.concatenate([[(vega * _huber(error)).sum(), vega.sum()], (weighted.T @ jacobian).ravel(), weighted.T @ error])


def next_trials(z: np.ndarray, equations: np.ndarray, damping: float) -> list[np.ndarray]:
    """Latent states along the damped step from ``z``."""
    matrix, gradient = equations[: SIZE * SIZE].reshape(SIZE, SIZE), equations[SIZE * SIZE :]
    diagonal = np.diag(matrix)
    top = max(diagonal.max(), 1e-300)
    ties = damping * np.maximum(diagonal, 1e-12 * top) + PRIOR * top
    step = np.clip(-np.linalg.solve(matrix + np.diag(ties), gradient), -1.0, 1.0)
    start = encode(decode(z))
    return [start + size * step for size in STEP_SIZES]


def _advance(parts, trials, z, loss, damping, steps) -> tuple:
    """One step of a date: take the best trial if it is better, else damp more; propose new trials."""
    width = 2 + SIZE * SIZE + SIZE
    sums = _total(parts).reshape(len(trials), width)
    found = sums[:, 0] / sums[:, 1]
    at = int(np.argmin(np.where(np.isnan(found), np.inf, found)))
    better = loss is None or np.isnan(loss) or found[at] < loss
    fell = np.inf if loss is None or np.isnan(loss) else loss - found[at]
    if better:
        z, loss, equations = np.asarray(trials[at], dtype=float), float(found[at]), sums[at, 2:]
        damping = max(damping / 10.0, 1e-8) if np.isfinite(fell) else damping
    else:
        equations, damping = None, damping * 10.0
    converged = bool((better and fell <= LOSS_SHARE * max(loss, 1e-300)) or damping > DAMPING[1])
    return z, loss, equations, damping, steps + 1, converged


REFINE_SCHEMA = (
    "z array<double>, loss double, equations array<double>, damping double, steps int, converged boolean, "
    "trials array<array<double>>"
)


def refine_fit(nodes: DataFrame, start: DataFrame, key: tuple[str, ...] = STATE_KEY, iterations: int = 500) -> DataFrame:
    """Damped Gauss-Newton from a start state until the loss stops falling; never worse than the start.

    Every iteration evaluates the trial states of the dates that have not converged, with the normal equations at
    each, and adds up one vector per pack. Returns the parameters, ``loss``, ``steps`` and ``converged``; a date
    that is not done after ``iterations`` steps is marked as not converged. A start on the edge of the
    parameter range is moved inside first; the untouched start competes at the end.
    """
    keys = list(key)
    packs = cut_lineage(pack_nodes(nodes.select(*key, "m", "tau", "node_iv", "node_vega"), key, ("m", "tau", "node_iv", "node_vega")))
    given = cut_lineage(start.select(*key, *ssvi.PARAMETER_COLUMNS))
    # Eta follows lambda so that the curvature at the middle knot stays what it was.
    moved_lambda = clip(F.col("lambda"), *INNER_LAMBDA)
    inside = given.withColumns(
        {
            "rho": clip(F.col("rho"), -INNER_RHO, INNER_RHO),
            "eta": F.col("eta") * F.pow(F.col("theta_d152"), moved_lambda - F.col("lambda")),
            "lambda": moved_lambda,
        }
    )
    first = ssvi.with_latent(inside).select(*key, F.array(*ssvi.LATENT_COLUMNS).alias("z"))
    state = first.select(
        *key, "z", F.lit(None).cast("double").alias("loss"), F.array().cast("array<double>").alias("equations"),
        F.lit(DAMPING[0]).alias("damping"), F.lit(0).alias("steps"), F.lit(False).alias("converged"), F.array("z").alias("trials"),
    )

    def evaluate(m: pd.Series, tau: pd.Series, iv: pd.Series, vega: pd.Series, trials: pd.Series) -> pd.Series:
        return pd.Series(
            [
                np.concatenate([normal_equations(decode(np.asarray(t, dtype=float)), *pack) for t in trials_])
                for *pack, trials_ in zip(m, tau, iv, vega, trials)
            ]
        )

    def advance(parts: pd.Series, trials: pd.Series, z: pd.Series, loss: pd.Series, equations: pd.Series, damping: pd.Series, steps: pd.Series) -> pd.DataFrame:
        rows = []
        for parts_, trials_, z_, loss_, held, damping_, steps_ in zip(parts, trials, z, loss, equations, damping, steps):
            z_, loss_, fresh, damping_, steps_, done = _advance(parts_, trials_, np.asarray(z_, dtype=float), loss_, damping_, steps_)
            held = np.asarray(held, dtype=float) if fresh is None else fresh
            ahead = [] if done else [t.tolist() for t in next_trials(z_, held, damping_)]
            rows.append((z_.tolist(), loss_, held.tolist(), damping_, steps_, done, ahead))
        return pd.DataFrame(rows, columns=["z", "loss", "equations", "damping", "steps", "converged", "trials"])

    def solve(m: pd.Series, tau: pd.Series, iv: pd.Series, vega: pd.Series, z: pd.Series) -> pd.DataFrame:
        rows = []
        for *pack, z_ in zip(m, tau, iv, vega, z):
            z_, trials, held, loss, damping, steps, done = np.asarray(z_, dtype=float), None, None, None, DAMPING[0], 0, False
            while not done and steps < iterations:
                trials = [z_] if trials is None else next_trials(z_, held, damping)
                part = np.concatenate([normal_equations(decode(t), *pack) for t in trials])
                z_, loss, fresh, damping, steps, done = _advance([part], trials, z_, loss, damping, steps)
                held = held if fresh is None else fresh
            rows.append((z_.tolist(), loss, steps, done))
        return pd.DataFrame(rows, columns=["z", "loss", "steps", "converged"])

    # A date in one pack is solved where it lies; only the others need an exchange per step.
    solved = F.pandas_udf(solve, "z array<double>, loss double, steps int, converged boolean")
    alone = packs.where("_packs = 1").join(first, keys)
    whole = alone.select(*key, solved("m", "tau", "node_iv", "node_vega", "z").alias("s")).select(*key, "s.*")
    split = packs.where("_packs > 1")
    state = state.join(split.select(*key).distinct(), keys, "left_semi")

    evaluated = F.pandas_udf(evaluate, "array<double>")
    advanced = F.pandas_udf(advance, REFINE_SCHEMA)
    carried = ("trials", "z", "loss", "equations", "damping", "steps")
    finished, moving = [], cut_lineage(state)
    for _ in range(iterations):
        if moving.isEmpty():
            break
        parts = beside(split, moving.select(*key, "trials"), key).select(
            *key, "_salt", evaluated("m", "tau", "node_iv", "node_vega", "trials").alias("part")
        )
        stepped = summed(parts, key).join(moving.select(*key, *carried), keys)
        stepped = cut_lineage(stepped.select(*key, advanced("parts", *carried).alias("s")).select(*key, "s.*"))
        finished.append(stepped.where("converged"))
        moving = stepped.where("NOT converged")
    final = whole
    for part in [moving, *finished]:
        final = final.unionByName(part.drop("trials", "equations", "damping"))
    latent = final.select(*key, "loss", "steps", "converged", *[F.col("z")[i].alias(c) for i, c in enumerate(ssvi.LATENT_COLUMNS)])
    refined = ssvi.with_constrained(latent).select(*key, *ssvi.PARAMETER_COLUMNS, "loss", "steps", "converged")

    # The untouched start competes on its own parameters.
    def start_loss(m: pd.Series, tau: pd.Series, iv: pd.Series, vega: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([normal_equations(np.asarray(p_, dtype=float), *pack)[:2] for *pack, p_ in zip(m, tau, iv, vega, p)])

    at_start = given.select(*key, F.array(*ssvi.PARAMETER_COLUMNS).alias("p"))
    scored = beside(packs, at_start, key).select(
        *key, "_salt", F.pandas_udf(start_loss, "array<double>")("m", "tau", "node_iv", "node_vega", "p").alias("part")
    )
    ratio = F.expr("aggregate(parts, 0D, (s, x) -> s + x[0]) / aggregate(parts, 0D, (s, x) -> s + x[1])")
    starts = given.join(summed(scored, key).select(*key, ratio.alias("_start")), keys)
    both = refined.join(starts.withColumnsRenamed({c: f"_{c}" for c in ssvi.PARAMETER_COLUMNS}), keys)
    keeps = F.col("_start") < F.col("loss")
    return both.select(
        *key,
        *[F.when(keeps, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ssvi.PARAMETER_COLUMNS],
        F.least("loss", "_start").alias("loss"),
        "steps",
        "converged",
    )


def calibrate(nodes: DataFrame, key: tuple[str, ...] = STATE_KEY, lattice: Lattice = Lattice(), iterations: int = 500) -> DataFrame:
    """Lattice start and Gauss-Newton refinement; adds the latent state columns."""
    fitted = lattice_fit(nodes, key, lattice)
    if iterations:
        fitted = refine_fit(nodes, fitted, key, iterations)
    return ssvi.with_latent(fitted)


def fitted_nodes(nodes: DataFrame, states: DataFrame, key: tuple[str, ...] = STATE_KEY) -> DataFrame:
    """Nodes with the volatility of their date's fitted surface."""
    joined = nodes.join(states.select(*key, *ssvi.PARAMETER_COLUMNS), list(key))
    return ssvi.with_implied_vol(joined).drop(*ssvi.PARAMETER_COLUMNS)

"""Run tables: parameter grids, run keys, and the mapping from a row of parameters to a training run."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frank_wolfe import fit_frank_wolfe
from .losses import TableLoss
from .schedules import L2Penalty
from .solvers import Run
from .train import LOCAL, MINIBATCH, Fit, fit_many

# Bytes of the models that are trained at once, and the vectors that a run keeps.
BLOCK_BYTES, VECTORS = 1 << 26, 8

# Defaults of the experiment parameters.
DEFAULTS = {
    "l2reg": 0.1,
    "algorithm": "sgd",
    "lr": 1.0,
    "lr_t": 1.0,
    "L": 1.0,
    "seed": 1234,
    "smoother": None,
    "K": 5,
    "num_passes": 50,
    "warm_start": 3,
    "kappa": 1.0,
    "decay_smoother": "const",
}
WARM_STARTS = {1: "prox-center", 2: "extrapolation", 3: "prev-iterate"}


@dataclass(frozen=True)
class Setup:
    """How an algorithm name becomes a solver: fixed options, options read from run parameters, and the parameters that
    tell two runs of it apart. ``smoothing`` and ``restart`` name those that count only for a smoothed run."""

    solver: str
    fixed: Mapping = field(default_factory=dict)
    read: Mapping[str, str] = field(default_factory=dict)
    rates: tuple[str, ...] = ("L",)
    restart: tuple[str, ...] = ()


_STEP = {"learning_rate": "lr"}
_SGD = {"initial_learning_rate": "lr", "learning_rate_time_factor": "lr_t", "smoothing_coefficient": "smoother"}
_SMOOTHED = {"initial_smoothing": "smoother", "smoothing_rule": "decay_smoother", "warm_start": "warm_start_name"}
SETUPS = {
    "sgd": Setup("sgd", {"learning_rate_scheme": "linear", "averaging": "weighted"}, _SGD, ("lr", "lr_t")),
    "sgd_const": Setup("sgd_const", {"learning_rate_scheme": "const", "averaging": "weighted"}, _SGD, ("lr",)),
    "csvrg": Setup("csvrg", {}, {"lipschitz": "L", **_SMOOTHED}, ("L",), ("warm_start",)),
    "csvrg_lr": Setup("csvrg_lr", {}, {**_STEP, "initial_moreau": "moreau", **_SMOOTHED}, ("lr",), ("warm_start",)),
    "svrg": Setup("svrg", {}, {**_STEP, "smoothing_coefficient": "smoother"}, ("lr",)),
    "pegasos": Setup("pegasos", {"learning_rate_scheme": "pegasos", "averaging": "weighted"}, _SGD),
    "bcfw": Setup("bcfw"),
}
ALGORITHMS = tuple(SETUPS)


def grid(base: DataFrame, options: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the option values for every row of ``base``, one generator per option."""
    out = base
    for name, values in options.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def run_key(runs: DataFrame, size: str = "", out: str = "run_id") -> DataFrame:
    """Key of a run: the parameters that tell runs of its algorithm apart, usable as a partition value.

    Parts that do not count for a run are null, and null parts leave no trace in the key.
    """
    smooth = F.coalesce(F.col("smoother") > 0, F.lit(False))

    def parts(name: str, setup: Setup) -> list:
        decay = F.when(smooth & (F.col("decay_smoother") != "none"), F.col("decay_smoother"))
        smoothing = [F.when(smooth, F.col(c).cast("string")) for c in ("smoother", "K")]
        restart = [F.when(smooth, F.concat(F.lit("option"), F.col(c).cast("string"))) for c in setup.restart]
        return [F.lit(name), decay, F.col("l2reg"), *map(F.col, setup.rates), F.lit(size), F.col("seed"), *smoothing, *restart]

    keys = [F.when(F.col("algorithm") == n, F.concat_ws("_", *[p.cast("string") for p in parts(n, s)])) for n, s in SETUPS.items()]
    return runs.withColumn(out, F.coalesce(*keys))


def run_of(row: Mapping, n: int) -> Run:
    """Training run of one parameter row on ``n`` examples, or as many as the row's own ``n``; the penalty is l2reg / n."""
    given = DEFAULTS | {k: v for k, v in dict(row).items() if v is not None}
    if given["algorithm"] not in SETUPS:
        raise ValueError(f"unknown algorithm: {given['algorithm']}")
    setup, strength = SETUPS[given["algorithm"]], given["l2reg"] / given.get("n", n)
    known = given | {"moreau": strength * given["kappa"], "warm_start_name": WARM_STARTS[given["warm_start"]]}
    options = {**setup.fixed, **{option: known[parameter] for option, parameter in setup.read.items()}}
    return Run(setup.solver, [L2Penalty(strength)], options, seed=given["seed"], run_id=given.get("run_id", given["algorithm"]))


def sweep(loss: TableLoss, rows: Sequence[Mapping], **options) -> list[Fit]:
    """Train every parameter row on one persisted table.

    Stochastic runs share each pass; Frank-Wolfe runs keep their own block tables and follow one by one.
    """
    mode = options.get("mode", LOCAL)
    loss.prepare(options.get("partitions"), options.get("n_buckets", 1) if mode == MINIBATCH else 1, mode == LOCAL)
    runs = [run_of(row, loss.n) for row in rows]
    shared = [r for r in runs if r.algorithm != "bcfw"]
    fits = {f.run_id: f for f in fit_many(loss, shared, **options)} if shared else {}
    kept = {k: v for k, v in options.items() if k in ("num_passes", "n_buckets", "partitions", "dev", "test", "stop", "logging")}
    for run in runs:
        if run.algorithm == "bcfw":
            fits[run.run_id] = fit_frank_wolfe(loss, run, **kept)
    return [fits[run.run_id] for run in runs]


def sweep_table(loss: TableLoss, runs: DataFrame, **options) -> Iterator[list[Fit]]:
    """Train every row of a run table on one persisted table, in blocks whose models fit into BLOCK_BYTES.

    The runs of a block share every pass. What tasks and driver hold is the models of one block, however many runs there are,
    so take what is wanted of each block (``train_log``, ``Fit.weights``) before the next.
    """
    at_once = max(1, BLOCK_BYTES // (VECTORS * 8 * loss.kernel.dim))
    block: list[dict] = []
    for row in runs.toLocalIterator():
        block.append(row.asDict())
        if len(block) == at_once:
            yield sweep(loss, block, **options)
            block = []
    if block:
        yield sweep(loss, block, **options)

"""Gaussian Markov fields on edge tables: precision matrices as sparse tables, and their solution for many draws by conjugate gradients.

A matrix is a table (i, j, q). Nothing of the size of the graph reaches the driver, and nothing dense is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved
from .graphs import laplacian


def identity(nodes: DataFrame, value=1.0) -> DataFrame:
    """Diagonal matrix over nodes (i) with a number or a column of it."""
    return nodes.select("i", F.col("i").alias("j"), (F.lit(float(value)) if isinstance(value, (int, float)) else value).alias("q"))


def added(*parts: DataFrame) -> DataFrame:
    """Sum of matrices."""
    out = parts[0].select("i", "j", "q")
    for part in parts[1:]:
        out = out.unionByName(part.select("i", "j", "q"))
    return out.groupBy("i", "j").agg(F.sum("q").alias("q"))


def scaled(matrix: DataFrame, factor: float) -> DataFrame:
    return matrix.select("i", "j", (F.col("q") * factor).alias("q"))


def transposed(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "q")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two sparse matrices: a join on the inner index."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("q").alias("p")), b.select(F.col("i").alias("k"), "j", "q")
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("q"))


def precision(edges: DataFrame, nodes: DataFrame, kind: str, rho: float = 0.8, kappa: float = 1.0, ridge: float = 0.0, flow: str = "bidirectional") -> DataFrame:
    """Precision matrix of a field over nodes (i) with weighted edges (i, j, w).

    icar and besag: D - W; leroux: rho (D - W) + (1 - rho) I; spde: (kappa^2 I + D - W)^2; sar: (I - rho W)' (I - rho W) with rows of W that sum to
    1; dag: the same with edges to smaller ids only; networkflow: the same with W against, along or both ways of the flow. `ridge` is added to the diagonal.
    """
    unit = identity(nodes)
    weights = edges.select("i", "j", F.col("w").alias("q"))
    if kind in ("icar", "besag", "cyclic"):
        out = added(laplacian(edges), identity(nodes, 0.0))
    elif kind == "leroux":
        out = added(scaled(laplacian(edges), rho), scaled(unit, 1 - rho))
    elif kind == "spde":
        root = added(laplacian(edges), scaled(unit, kappa * kappa))
        out = product(root, root)
    elif kind in ("sar", "dag", "networkflow"):
        if kind == "sar":
            sums = weights.groupBy("i").agg(F.sum("q").alias("s"))
            weights = weights.join(sums, "i").select("i", "j", (F.col("q") / F.col("s")).alias("q"))
        elif kind == "dag":
            weights = weights.filter("j < i")
        elif flow == "upstream":
            weights = transposed(weights)
        elif flow != "downstream":
            weights = scaled(added(weights, transposed(weights)), 0.5)
        root = added(unit, scaled(weights, -rho))
        out = product(transposed(root), root)
    else:
        raise ValueError(f"unknown field {kind}")
    return added(out, identity(nodes, ridge)) if ridge else out


def applied(matrix: DataFrame, values: DataFrame) -> DataFrame:
    """draw, i, value: the matrix times each draw's vector (draw, i, value)."""
    return matrix.join(values.withColumnRenamed("i", "j"), "j").groupBy("draw", "i").agg(F.sum(F.col("q") * F.col("value")).alias("value"))


def solved(matrix: DataFrame, right: DataFrame, tolerance: float = 1e-10, rounds: int = 1000) -> DataFrame:
    """draw, i, value: x with matrix x = right for every draw (draw, i, value), by conjugate gradients scaled with the diagonal.

    The matrix is symmetric and positive definite. A round is one join with the matrix and one aggregation, for all draws at
    once; its four sums per draw, all that reaches the driver, give the step and the next direction. Rounds are written to the shared folder, so a lost executor costs one of them. It ends
    when each draw's scaled residual has fallen by `tolerance`; if it doesn't in `rounds` rounds, that is an error, not a poor result.
    """
    spark = matrix.sparkSession
    matrix = saved(matrix.select("i", "j", "q"))
    diagonal = matrix.filter("i = j").select("i", F.col("q").alias("d"))
    start = right.select("draw", "i", F.col("value").alias("r")).join(diagonal, "i")
    state = saved(start.select("draw", "i", "d", F.lit(0.0).alias("x"), "r", (F.col("r") / F.col("d")).alias("p")))
    first: dict[int, float] = {}
    for _ in range(rounds + 1):
        moved = matrix.join(state.select("draw", F.col("i").alias("j"), "p"), "j").groupBy("draw", "i").agg(F.sum(F.col("q") * F.col("p")).alias("ap"))
        table = saved(state.join(moved, ["draw", "i"]))
        r, p, ap, d = (F.col(c) for c in ("r", "p", "ap", "d"))
        # a row for each draw
        sums = table.groupBy("draw").agg(F.sum(p * ap).alias("pap"), F.sum(r * r / d).alias("rz"), F.sum(r * ap / d).alias("raz"), F.sum(ap * ap / d).alias("aaz")).collect()
        first = first or {s.draw: s.rz for s in sums}
        open_ = [s for s in sums if s.rz > tolerance * tolerance * first[s.draw]]
        if not open_:
            return table.select("draw", "i", F.col("x").alias("value"))
        steps = []
        for s in sums:
            step = s.rz / s.pap if s.pap > 0 else 0.0
            after = max(s.rz - 2 * step * s.raz + step * step * s.aaz, 0.0)
            steps.append((s.draw, step, after / s.rz if s.rz > 0 else 0.0))
        rest = r - F.col("step") * ap
        found = table.join(F.broadcast(spark.createDataFrame(steps, "draw long, step double, turn double")), "draw")
        state = found.select("draw", "i", "d", (F.col("x") + F.col("step") * p).alias("x"), rest.alias("r"), (rest / d + F.col("turn") * p).alias("p"))
    raise ArithmeticError(f"{len(open_)} draws did not settle in {rounds} rounds")


def smoothed(matrix: DataFrame, observed: DataFrame, noise: float, tolerance: float = 1e-10) -> DataFrame:
    """Posterior mean of a field with prior precision `matrix`, from sums (draw, i, n, total): (Q + n / noise^2) x = total / noise^2.

    Every draw has a row for every node, with n = 0 where nothing is observed: such nodes are filled from their neighbours. n is the same in all draws.
    """
    data = observed.groupBy("i").agg((F.max("n") / noise**2).alias("q")).select("i", F.col("i").alias("j"), "q")
    return solved(added(matrix, data), observed.select("draw", "i", (F.col("total") / noise**2).alias("value")), tolerance)

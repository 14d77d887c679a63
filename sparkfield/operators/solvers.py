"""Batched solvers: every row of a table is one problem instance.

A batch of rows is solved at once in numpy, all instances iterating together until each is
done; there is no shuffle, and no instance waits for another partition's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sparkfield.functions.calculus import derivative, simplify
from sparkfield.plans.compile import array

from .systems import System

SUCCESS, MAX_ITER, DIVERGED, INVALID = "SUCCESS", "MAX_ITER", "DIVERGED", "INVALID_SYSTEM"
MESSAGES = {SUCCESS: "Converged successfully", MAX_ITER: "Maximum iterations reached", DIVERGED: "Solution diverged"}


def eliminate(a: np.ndarray, b: np.ndarray, least: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """Solve a batch of n x n systems by elimination with partial pivoting: (solutions, solvable)."""
    a, b = a.copy(), b.copy()
    m, n = b.shape
    each, fine = np.arange(m), np.ones(m, bool)
    for c in range(n):
        p = c + np.abs(a[:, c:, c]).argmax(1)
        a[each, p], a[:, c] = a[:, c].copy(), a[each, p].copy()
        b[each, p], b[:, c] = b[:, c].copy(), b[each, p].copy()
        fine &= np.abs(a[:, c, c]) >= least
        pivot = np.where(fine, a[:, c, c], 1.0)
        for r in range(c + 1, n):
            f = a[:, r, c] / pivot
            a[:, r] -= f[:, None] * a[:, c]
            b[:, r] -= f * b[:, c]
    x = np.zeros_like(b)
    for r in range(n - 1, -1, -1):
        x[:, r] = (b[:, r] - (a[:, r, r + 1 :] * x[:, r + 1 :]).sum(1)) / np.where(fine, a[:, r, r], 1.0)
    return x, fine


def _solve(df: DataFrame, system: System, keys: Sequence[str], guesses: Mapping[str, str | float] | None, step: Callable) -> DataFrame:
    """Run ``step(x, F, env) -> (new x, solvable)`` on each row until it converges, diverges or is invalid.

    A row converges when its residual norm is below the tolerance, which counts as an
    iteration. Divergence is judged on the norm before the update, and then no solution is
    given.
    """
    names = list(system.unknowns)
    guesses = dict(guesses or {})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{u}` double" for u in names] + ["status string", "iterations int", "final_residual double", "message string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = len(pdf)
            env = {k: np.full(m, float(v)) for k, v in (system.parameters or {}).items()}
            env |= {c: pdf[c].to_numpy(float) for c in pdf.columns if c not in keys or pd.api.types.is_numeric_dtype(pdf[c])}
            x = np.stack([env[g] if isinstance(g := guesses.get(u, 0.0), str) else np.full(m, float(g)) for u in names], 1) if names else np.zeros((m, 0))
            status, iterations = np.full(m, MAX_ITER, object), np.zeros(m, np.int32)
            last, message, active = np.full(m, np.nan), np.full(m, MESSAGES[MAX_ITER], object), np.arange(m)
            if not system.is_well_posed:
                status[:], message[:], active = INVALID, "Number of equations does not match number of unknowns", active[:0]
                x[:] = np.nan
            for _ in range(system.max_iterations):
                if not len(active):
                    break
                iterations[active] += 1
                own = {k: v[active] for k, v in env.items()} | {u: x[active, i] for i, u in enumerate(names)}
                with np.errstate(all="ignore"):
                    f = np.stack([np.broadcast_to(array(e, own), len(active)) for e in system.equations], 1)
                    norm = np.sqrt((f * f).sum(1))
                last[active] = norm
                good = norm < system.tolerance
                status[active[good]], message[active[good]] = SUCCESS, MESSAGES[SUCCESS]
                active, f, norm = active[~good], f[~good], norm[~good]
                own = {k: v[~good] for k, v in own.items()}
                with np.errstate(all="ignore"):
                    new, fine = step(x[active], f, own)
                x[active] = new
                bad = active[~fine]
                status[bad], message[bad], x[bad] = INVALID, "Singular Jacobian matrix", np.nan
                wild = fine & ((norm > 1e10) | np.isnan(norm))
                status[active[wild]], message[active[wild]], x[active[wild]] = DIVERGED, MESSAGES[DIVERGED], np.nan
                active = active[fine & ~wild]
            out = {k: pdf[k] for k in keys} | {u: x[:, i] for i, u in enumerate(names)}
            yield pd.DataFrame(out | {"status": status, "iterations": iterations, "final_residual": last, "message": message})

    return df.mapInPandas(run, schema)


def fixed_point(df: DataFrame, system: System, keys: Sequence[str], guesses: Mapping[str, str | float] | None = None, damping: float = 0.5) -> DataFrame:
    """x_i <- x_i - damping * F_i(x), equation i paired with unknown i."""
    return _solve(df, system, keys, guesses, lambda x, f, _: (x - damping * f, np.ones(len(x), bool)))


def newton(df: DataFrame, system: System, keys: Sequence[str], guesses: Mapping[str, str | float] | None = None) -> DataFrame:
    """Newton-Raphson with the symbolic Jacobian, differentiated and simplified once at plan time."""
    jacobian = [[simplify(derivative(e, u)) for u in system.unknowns] for e in system.equations]

    def step(x, f, env):
        m, n = f.shape
        j = np.empty((m, n, n))
        for r, row in enumerate(jacobian):
            for c, e in enumerate(row):
                j[:, r, c] = array(e, env)
        delta, fine = eliminate(j, -f)
        return x + delta, fine

    return _solve(df, system, keys, guesses, step)


def gmres(matvec: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int = 30, tolerance: float = 1e-7) -> tuple[np.ndarray, bool]:
    """min |b - A x| over a Krylov space of at most ``steps`` vectors: (best x, reached).

    Arnoldi by modified Gram-Schmidt; a breakdown means that the space holds the solution.
    """
    n, beta = len(b), float(np.linalg.norm(b))
    if beta < tolerance:
        return np.zeros(n), True
    m = min(steps, n)
    v, h = np.zeros((m + 1, n)), np.zeros((m + 1, m))
    v[0] = b / beta
    used = m
    for j in range(m):
        w = matvec(v[j])
        for i in range(j + 1):
            h[i, j] = w @ v[i]
            w = w - h[i, j] * v[i]
        h[j + 1, j] = np.linalg.norm(w)
        if h[j + 1, j] < 1e-14:
            used = j + 1
            break
        v[j + 1] = w / h[j + 1, j]
        e = np.zeros(j + 2)
        e[0] = beta
        y = np.linalg.lstsq(h[: j + 2, : j + 1], e, rcond=None)[0]
        if np.linalg.norm(h[: j + 2, : j + 1] @ y - e) < tolerance:
            return v[: j + 1].T @ y, True
    e = np.zeros(used + 1)
    e[0] = beta
    y = np.linalg.lstsq(h[: used + 1, :used], e, rcond=None)[0]
    return v[:used].T @ y, bool(np.linalg.norm(h[: used + 1, :used] @ y - e) < tolerance)


def krylov_solve(residual: Callable[[np.ndarray], np.ndarray], x: np.ndarray, tolerance: float = 1e-6, max_iterations: int = 1000, eps: float = 1e-7) -> tuple[np.ndarray, str, int, float]:
    """Jacobian-free Newton-Krylov on one residual function: (x, status, iterations, norm)."""
    norm = float("inf")
    for n in range(1, max_iterations + 1):
        f = residual(x)
        norm = float(np.linalg.norm(f))
        if norm < tolerance:
            return x, SUCCESS, n, norm
        delta, reached = gmres(lambda v, x=x, f=f: (residual(x + eps * v) - f) / eps, -f, tolerance=tolerance * 0.1)
        x = x + (delta if reached else 0.5 * delta)
    return x, MAX_ITER, max_iterations, norm


def gmres_rows(matvec: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int = 30, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """``gmres`` for a batch of small systems, a row each: (best x, reached).

    The Hessenberg matrices are triangulated by rotations as they grow, so that a row's residual
    is known at each step; a row whose triangle is singular is left to ``lstsq``.
    """
    k, n = b.shape
    beta = np.sqrt((b * b).sum(1))
    m = min(steps, n)
    v, h, r = np.zeros((k, m + 1, n)), np.zeros((k, m + 1, m)), np.zeros((k, m + 1, m))
    g, cos, sin = np.zeros((k, m + 1)), np.zeros((k, m)), np.zeros((k, m))
    g[:, 0], used, reached = beta, np.zeros(k, int), beta < tolerance
    v[:, 0] = b / np.where(beta > 0, beta, 1.0)[:, None]
    going = ~reached
    for j in range(m):
        if not going.any():
            break
        w = matvec(v[:, j])
        for i in range(j + 1):
            h[:, i, j] = (w * v[:, i]).sum(1)
            w = w - h[:, i, j, None] * v[:, i]
        size = h[:, j + 1, j] = np.sqrt((w * w).sum(1))
        v[:, j + 1] = w / np.where(size > 0, size, 1.0)[:, None]
        col = h[:, : j + 2, j].copy()
        for i in range(j):
            col[:, i], col[:, i + 1] = cos[:, i] * col[:, i] + sin[:, i] * col[:, i + 1], cos[:, i] * col[:, i + 1] - sin[:, i] * col[:, i]
        long = np.hypot(col[:, j], col[:, j + 1])
        fine = long > 0
        cos[:, j], sin[:, j] = np.where(fine, col[:, j] / np.where(fine, long, 1.0), 1.0), np.where(fine, col[:, j + 1] / np.where(fine, long, 1.0), 0.0)
        col[:, j] = long
        r[:, : j + 1, j] = col[:, : j + 1]
        g[:, j], g[:, j + 1] = np.where(going, cos[:, j] * g[:, j], g[:, j]), np.where(going, -sin[:, j] * g[:, j], g[:, j + 1])
        used[going] = j + 1
        reached |= going & (np.abs(g[:, j + 1]) < tolerance)
        going &= ~reached & (size >= 1e-14)
    y = np.zeros((k, m))
    diagonal = np.abs(r[:, np.arange(m), np.arange(m)])
    inside = np.arange(m) < used[:, None]
    with np.errstate(all="ignore"):
        odd = (np.where(inside, diagonal, np.inf).min(1, initial=np.inf) <= 1e-13 * np.where(inside, diagonal, 0.0).max(1, initial=0.0)) & (used > 0)
        for i in range(m - 1, -1, -1):
            value = (g[:, i] - (r[:, i, i + 1 :] * y[:, i + 1 :]).sum(1)) / np.where(diagonal[:, i] > 0, diagonal[:, i], 1.0)
            y[:, i] = np.where(i < used, value, 0.0)
    for a in np.flatnonzero(odd).tolist():
        e = np.zeros(used[a] + 1)
        e[0] = beta[a]
        part = h[a, : used[a] + 1, : used[a]]
        y[a, : used[a]] = np.linalg.lstsq(part, e, rcond=None)[0]
        reached[a] = np.linalg.norm(part @ y[a, : used[a]] - e) < tolerance
    return (v[:, :m] * y[:, :, None]).sum(1), reached


def newton_krylov(df: DataFrame, system: System, keys: Sequence[str], guesses: Mapping[str, str | float] | None = None, eps: float = 1e-7) -> DataFrame:
    """Jacobian-free Newton-Krylov for scalar unknowns, any number of them: all rows of a batch step together until each is done."""
    names = list(system.unknowns)
    guesses = dict(guesses or {})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{u}` double" for u in names] + ["status string", "iterations int", "final_residual double", "message string"])

    def run(batches):
        for pdf in batches:
            m = len(pdf)
            env = {k: np.full(m, float(v)) for k, v in (system.parameters or {}).items()}
            env |= {c: pdf[c].to_numpy(float) for c in pdf.columns if pd.api.types.is_numeric_dtype(pdf[c])}
            x = np.stack([env[g] if isinstance(g := guesses.get(u, 0.0), str) else np.full(m, float(g)) for u in names], 1)
            status, iterations, last, active = np.full(m, MAX_ITER, object), np.full(m, system.max_iterations, np.int32), np.full(m, np.inf), np.arange(m)

            def residual(x, own):
                with np.errstate(all="ignore"):
                    own = own | {u: x[:, i] for i, u in enumerate(names)}
                    return np.stack([np.broadcast_to(array(e, own), len(x)) for e in system.equations], 1)

            for n in range(1, system.max_iterations + 1):
                if not len(active):
                    break
                own = {k: v[active] for k, v in env.items()}
                f = residual(x[active], own)
                norm = last[active] = np.sqrt((f * f).sum(1))
                good, wild = norm < system.tolerance, ~np.isfinite(norm)
                status[active[good]], status[active[wild]], iterations[active[good | wild]] = SUCCESS, DIVERGED, n
                go = ~(good | wild)
                active, f, own = active[go], f[go], {k: v[go] for k, v in own.items()}
                here = x[active]
                delta, reached = gmres_rows(lambda v, here=here, f=f, own=own: (residual(here + eps * v, own) - f) / eps, -f, tolerance=system.tolerance * 0.1)
                x[active] = here + np.where(reached, 1.0, 0.5)[:, None] * delta
            out = {k: pdf[k] for k in keys} | {u: x[:, i] for i, u in enumerate(names)}
            yield pd.DataFrame(out | {"status": status, "iterations": iterations, "final_residual": last, "message": [MESSAGES[s] for s in status]})

    return df.mapInPandas(run, schema)


def krylov_on_grids(fields: DataFrame, keys: Sequence[str], residual: Callable[[dict[str, np.ndarray]], np.ndarray], unknowns: Sequence[str], index: Sequence[str], tolerance: float = 1e-6, max_iterations: int = 100) -> DataFrame:
    """Newton-Krylov for grid unknowns: each group of ``keys`` is one grid with a row per cell.

    ``residual`` maps the group's columns, as arrays in index order, to the equations' values
    for all unknowns in a row; several unknowns each have their own stretch of the vector.
    """
    kinds = {f.name: f.dataType.simpleString() for f in fields.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (*keys, *index)] + [f"`{u}` double" for u in unknowns] + ["status string", "iterations int", "final_residual double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(index)).reset_index(drop=True)
        env = {c: pdf[c].to_numpy(float) for c in pdf.columns if pd.api.types.is_numeric_dtype(pdf[c])}
        n = len(pdf)
        f = lambda x: residual({**env, **{u: x[i * n : (i + 1) * n] for i, u in enumerate(unknowns)}})
        x, status, used, norm = krylov_solve(f, np.concatenate([env[u] for u in unknowns]), tolerance, max_iterations)
        out = pdf[[*keys, *index]].copy()
        for i, u in enumerate(unknowns):
            out[u] = x[i * n : (i + 1) * n]
        return out.assign(status=status, iterations=np.int32(used), final_residual=norm)

    return fields.groupBy(*keys).applyInPandas(run, schema)


def sor(df: DataFrame, system: System, keys: Sequence[str], guesses: Mapping[str, str | float] | None = None, omega: float | None = None) -> DataFrame:
    """Successive over-relaxation of the linear part, if ``omega`` is given; without it, every row is reported as not implemented."""
    if omega is None:
        none = System(unknowns=system.unknowns, equations=())
        from pyspark.sql import functions as F

        return _solve(df, none, keys, guesses, None).withColumn("message", F.lit("SOR not yet implemented"))
    diagonal = [simplify(derivative(e, u)) for e, u in zip(system.equations, system.unknowns, strict=True)]

    def step(x, f, env):
        env, x = dict(env), x.copy()
        fine = np.ones(len(x), bool)
        for i, u in enumerate(system.unknowns):
            d = np.broadcast_to(array(diagonal[i], env), len(x))
            fine &= np.abs(d) >= 1e-14
            x[:, i] -= omega * np.broadcast_to(array(system.equations[i], env), len(x)) / np.where(fine, d, 1.0)
            env[u] = x[:, i]
        return x, fine

    return _solve(df, system, keys, guesses, step)

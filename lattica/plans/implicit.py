"""Operators whose value is the outcome of a solver, derivatives without automatic differentiation, and
the records that solvers hand to callbacks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from lattica.plans.algebra import LinearOperator, Operator
from lattica.plans.solvers import cg, lbfgs
from lattica.tensor import TensorFrame


@dataclass(frozen=True)
class OptimizerStatus:
    iteration: int
    solution: TensorFrame


@dataclass(frozen=True)
class CGStatus(OptimizerStatus):
    residual: TensorFrame
    preconditioned_residual: TensorFrame | None = None


@dataclass(frozen=True)
class LBFGSStatus(OptimizerStatus):
    residual: np.ndarray


@dataclass(frozen=True)
class PDHGStatus(OptimizerStatus):
    duals: list
    relaxed: TensorFrame
    primal_step: float
    dual_step: float
    objective: Callable | None = None


@dataclass(frozen=True)
class PGDStatus(OptimizerStatus):
    step: float
    objective: Callable | None = None


def with_status(kind: type[OptimizerStatus], f: Callable) -> Callable:
    """A solver's callback that passes one record on."""
    return lambda k, *parts: f(kind(k, *parts))


class EndomorphOperator(Operator):
    """As many results as inputs; a chain of them is one again."""

    def __call__(self, *x):
        out = super().__call__(*x)
        if len(out) != len(x):
            raise ValueError(f"{len(x)} inputs, {len(out)} results")
        return out

    def __matmul__(self, other):
        return _Chain(self, other) if isinstance(other, EndomorphOperator) else super().__matmul__(other)


class _Chain(EndomorphOperator):
    def __init__(self, outer, inner):
        self.outer, self.inner = outer, inner

    def forward(self, *x):
        return self.outer(*self.inner(*x))


class Jacobian(LinearOperator):
    """The derivative of an operator at a point, by central differences of one input along the given
    direction. `adjoint` is for operators that act value by value (signal models, magnitudes): there the
    derivative is four numbers a value, found from the directions 1 and i."""

    def __init__(self, op: Operator, at: TensorFrame, step: float = 1e-5):
        self.op, self.at, self.step = op, at, step

    def forward(self, v: TensorFrame) -> TensorFrame:
        up, down = self.op(self.at + v * self.step)[0], self.op(self.at - v * self.step)[0]
        return (up - down) * (0.5 / self.step)

    def adjoint(self, y: TensorFrame) -> TensorFrame:
        ones = self.at.dense().map(lambda p: p * 0.0 + 1.0)
        parts = []
        for unit in (1.0, 1j):
            d = self.forward(ones * unit)
            right = y.df.withColumnsRenamed({"re": "re2", "im": "im2"})
            rows = d.df.join(right, d.names)
            parts.append(rows.selectExpr(*d.names, "re * re2 + im * im2 as dot"))
        both = parts[0].withColumnRenamed("dot", "re").join(parts[1].withColumnRenamed("dot", "im"), y.names)
        return TensorFrame(both.select(*y.names, "re", "im"), y.axes)

    def taylor(self, x: TensorFrame) -> TensorFrame:
        return self.op(self.at)[0] + self.forward(x - self.at)

    def gauss_newton(self, v: TensorFrame) -> TensorFrame:
        return self.adjoint(self.forward(v))


class ConjugateGradientOp(Operator):
    """x of A x = b, where operator and right-hand side are made from the inputs."""

    def __init__(self, operator: Callable, rhs: Callable, max_iterations: int = 50, tolerance: float = 1e-6, start: Callable | None = None):
        self.operator, self.rhs, self.start = operator, rhs, start
        self.options = {"max_iterations": max_iterations, "tolerance": tolerance}

    def forward(self, *x):
        start = self.start(*x) if self.start else None
        return cg(self.operator(*x), self.rhs(*x), start, **self.options)

    def derivative(self, x: tuple, moved: tuple, step: float = 1e-5) -> TensorFrame:
        """Of the solution along a direction of the inputs: A dx = db - dA x, solved like the problem."""
        at = self.forward(*x).cut()
        near = lambda s: tuple(a + b * s for a, b in zip(x, moved))
        change = lambda f: (f(near(step)) - f(near(-step))) * (0.5 / step)
        right = change(lambda v: self.rhs(*v)) - change(lambda v: self.operator(*v)(at)[0])
        return cg(self.operator(*x), right, **self.options)


class OptimizerOp:
    """The minimizer of a problem with parameters. problem(*parameters) gives value and gradient of a small
    vector; `derivative` solves with the Hessian at the minimum, both by differences of the gradient."""

    def __init__(self, problem: Callable, start: Callable, minimize: Callable = lbfgs, **options):
        self.problem, self.start, self.minimize, self.options = problem, start, minimize, options

    def __call__(self, *parameters) -> np.ndarray:
        return self.minimize(self.problem(*parameters), self.start(*parameters), **self.options)

    def derivative(self, parameters: tuple, moved: tuple, step: float = 1e-5) -> np.ndarray:
        x = self(*parameters)
        gradient = lambda p, v: self.problem(*p)(v)[1]
        near = lambda s: tuple(a + s * b for a, b in zip(parameters, moved))
        hessian = np.stack([(gradient(parameters, x + step * e) - gradient(parameters, x - step * e)) / (2 * step) for e in np.eye(len(x))], 1)
        return -np.linalg.solve(hessian, (gradient(near(step), x) - gradient(near(-step), x)) / (2 * step))

"""Linear operators on TensorFrames and their algebra; composing builds a tree, nothing runs."""

from __future__ import annotations

from lattica.tensor import ShapeError, TensorFrame


class Operator:
    """A map of tensors; calling it returns a tuple."""

    def forward(self, *x):
        raise NotImplementedError

    def __call__(self, *x) -> tuple:
        out = self.forward(*x)
        return out if isinstance(out, tuple) else (out,)

    def __matmul__(self, other):
        return Composition(self, other)

    def __add__(self, other):
        return Sum(self, other)

    def __mul__(self, s):
        return ScaledLeft(self, s)

    def __rmul__(self, s):
        return ScaledRight(self, s)


class Composition(Operator):
    def __init__(self, outer, inner):
        self.outer, self.inner = outer, inner

    def forward(self, *x):
        return self.outer(*self.inner(*x))


class Sum(Operator):
    def __init__(self, *ops):
        self.ops = [p for o in ops for p in (o.ops if isinstance(o, Sum) else [o])]

    def forward(self, *x):
        outs = [o(*x) for o in self.ops]
        return tuple(sum(y[1:], y[0]) for y in zip(*outs))


class ScaledRight(Operator):
    """s * A: the result is scaled."""

    def __init__(self, op, s):
        self.op, self.s = op, s

    def forward(self, *x):
        return tuple(y * self.s for y in self.op(*x))


class ScaledLeft(Operator):
    """A * s: the input is scaled."""

    def __init__(self, op, s):
        self.op, self.s = op, s

    def forward(self, *x):
        return self.op(*(y * self.s for y in x))


class LinearOperator(Operator):
    def adjoint(self, y):
        raise NotImplementedError

    @property
    def H(self) -> LinearOperator:  # noqa: N802
        return Adjoint(self)

    @property
    def gram(self) -> LinearOperator:
        return LinearComposition(self.H, self)

    def __matmul__(self, other):
        if isinstance(other, Identity):
            return self
        if isinstance(other, Zero):
            return other
        return LinearComposition(self, other) if isinstance(other, LinearOperator) else Composition(self, other)

    def __add__(self, other):
        if isinstance(other, Zero):
            return self
        return LinearSum(self, other) if isinstance(other, LinearOperator) else Sum(self, other)

    def __mul__(self, s):
        return LinearScaledLeft(self, s)

    def __rmul__(self, s):
        return LinearScaledRight(self, s)

    def __or__(self, other):
        """Side by side: [A, B], which takes two inputs."""
        return OperatorMatrix([[*(self.rows[0] if isinstance(self, OperatorMatrix) else [self]), other]])

    def __mod__(self, other):
        """One above the other."""
        return OperatorMatrix([*(self.rows if isinstance(self, OperatorMatrix) else [[self]]), [other]])

    def operator_norm(self, start: TensorFrame, steps: int = 20, rtol: float = 1e-4, atol: float = 1e-5) -> float:
        """Largest singular value by power iteration; one number a step reaches the driver."""
        size = start.norm2() ** 0.5
        if size == 0:
            raise ValueError("the start must not be zero")
        x, before = (start * (1 / size)).cut(), 0.0
        for _ in range(steps):
            x = self.gram(x)[0].cut()
            size = x.norm2() ** 0.5
            now = size**0.5
            if size == 0:
                return 0.0
            x = x * (1 / size)
            if abs(now - before) <= atol + rtol * before:
                break
            before = now
        return now


class LinearComposition(LinearOperator):
    def __init__(self, outer, inner):
        self.outer, self.inner = outer, inner

    def forward(self, x):
        return self.outer(*self.inner(x))

    def adjoint(self, y):
        return self.inner.H(*self.outer.H(y))

    @property
    def gram(self):
        return self.inner.H @ self.outer.gram @ self.inner


class LinearSum(LinearOperator, Sum):
    def adjoint(self, y):
        outs = [o.H(y)[0] for o in self.ops]
        return sum(outs[1:], outs[0])


class LinearScaledRight(LinearOperator, ScaledRight):
    def adjoint(self, y):
        return self.op.H(y * _conj(self.s))


class LinearScaledLeft(LinearOperator, ScaledLeft):
    def adjoint(self, y):
        return self.op.H(y)[0] * _conj(self.s)


def _conj(s):
    return s.conj() if isinstance(s, TensorFrame) else s.conjugate()


class Adjoint(LinearOperator):
    def __init__(self, op):
        self.op = op

    def forward(self, y):
        return self.op.adjoint(y)

    def adjoint(self, x):
        return self.op(x)

    @property
    def H(self):  # noqa: N802
        return self.op


class Identity(LinearOperator):
    def forward(self, *x):
        return x

    def adjoint(self, *y):
        return y

    @property
    def H(self):  # noqa: N802
        return self

    @property
    def gram(self):
        return self

    def __matmul__(self, other):
        return other


class Zero(LinearOperator):
    """0 for every input, of the same shape."""

    def forward(self, x):
        return x * 0.0

    adjoint = forward

    def __add__(self, other):
        return other

    def __matmul__(self, other):
        return self


class OperatorMatrix(LinearOperator):
    """Blocks: row i of the result is the sum over j of op[i][j] of input j."""

    def __init__(self, rows):
        if len({len(r) for r in rows}) != 1:
            raise ShapeError("rows of different lengths")
        self.rows = [list(r) for r in rows]

    @classmethod
    def diagonal(cls, *ops):
        return cls([[o if i == j else Zero() for j in range(len(ops))] for i, o in enumerate(ops)])

    @property
    def shape(self):
        return len(self.rows), len(self.rows[0])

    def __getitem__(self, at):
        return self.rows[at[0]][at[1]]

    def _row(self, row, x):
        outs = [o(v)[0] for o, v in zip(row, x) if not isinstance(o, Zero)]
        return sum(outs[1:], outs[0]) if outs else x[0] * 0.0

    def forward(self, *x):
        if len(x) != self.shape[1]:
            raise ShapeError(f"{self.shape[1]} inputs, not {len(x)}")
        return tuple(self._row(r, x) for r in self.rows)

    def adjoint(self, *y):
        return self.H(*y)

    @property
    def H(self):  # noqa: N802
        return OperatorMatrix([[r[j].H if not isinstance(r[j], Zero) else Zero() for r in self.rows] for j in range(self.shape[1])])

    @property
    def gram(self):
        return Composition(self.H, self)

    def __matmul__(self, other):
        if not isinstance(other, OperatorMatrix):
            return OperatorMatrix([[o @ other for o in r] for r in self.rows])
        columns = list(zip(*other.rows))
        out = []
        for r in self.rows:
            out.append([])
            for c in columns:
                terms = [a @ b for a, b in zip(r, c) if not isinstance(a, Zero) and not isinstance(b, Zero)]
                out[-1].append(sum(terms[1:], terms[0]) if terms else Zero())
        return OperatorMatrix(out)

    def operator_norm(self, *starts, **options) -> float:
        """A bound: the largest over columns of the root of the summed squares of the blocks' norms."""
        return max(sum(r[j].operator_norm(s, **options) ** 2 for r in self.rows if not isinstance(r[j], Zero)) ** 0.5 for j, s in enumerate(starts))

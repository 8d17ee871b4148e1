"""Exact derivatives of all models, and minimizers with a table as state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import dual, models
from lattica.plans import fitting, solvers

G = models.GYROMAGNETIC_RATIO_PROTON


def saturated(offset, b0, b1, duration=0.005, nominal=3.7e-6):
    rate, off = nominal * b1 * G, offset - b0
    y = np.pi * duration * np.sqrt(rate * rate + off * off)
    return (rate * np.pi * duration) ** 2 * (np.sin(y) / y) ** 2


def steady(time, tr, m0, t1, fa):
    lost = np.log(np.cos(fa)) / tr
    s = m0 / (1 - t1 * lost)
    return s + (m0 - s) * np.exp(-time * (1 / t1 - lost))


#: Model, arguments and the same with NumPy: derivatives by complex steps, exact to rounding.
CASES = [
    (models.inversion_recovery, dict(ti=0.3, m0=2.0, t1=0.8), lambda ti, m0, t1: m0 * (1 - 2 * np.exp(-ti / t1))),
    (models.saturation_recovery, dict(time=0.3, m0=2.0, t1=0.8), lambda time, m0, t1: m0 * (1 - np.exp(-time / t1))),
    (models.mono_exponential_decay, dict(time=0.3, m0=2.0, decay=0.4), lambda time, m0, decay: m0 * np.exp(-time / decay)),
    (models.molli, dict(ti=0.3, a=2.0, c=1.7, t1=0.8), lambda ti, a, c, t1: a * (1 - (1 + c) * np.exp(-ti / t1 * c))),
    (models.spoiled_gre, dict(flip_angle=0.3, echo_time=0.01, repetition_time=0.02, m0=2.0, t1=0.8, t2star=0.05),
     lambda flip_angle, echo_time, repetition_time, m0, t1, t2star: m0 * np.sin(flip_angle) * (1 - np.exp(-repetition_time / t1)) / (1 - np.cos(flip_angle) * np.exp(-repetition_time / t1)) * np.exp(-echo_time / t2star)),
    (models.transient_steady_state, dict(time=0.3, repetition_time=0.01, m0=2.0, t1=0.8, flip_angle=0.2), lambda time, repetition_time, m0, t1, flip_angle: steady(time, repetition_time, m0, t1, flip_angle)),
    (models.wasabi, dict(offset=90.0, b0_shift=10.0, relative_b1=0.9, c=1.5, a=1.2), lambda offset, b0_shift, relative_b1, c, a: c * (1 - a * saturated(offset, b0_shift, relative_b1))),
    (models.wasabiti, dict(offset=90.0, recovery_time=2.0, b0_shift=10.0, relative_b1=0.9, t1=0.8), lambda offset, recovery_time, b0_shift, relative_b1, t1: (1 - np.exp(-recovery_time / t1)) * (1 - 2 * saturated(offset, b0_shift, relative_b1, nominal=3.75e-6))),
]


@pytest.mark.parametrize("model, arguments, plain", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_derivatives_of_models(spark, model, arguments, plain):
    df = spark.createDataFrame([tuple(arguments.values())], list(arguments))
    got = dual.differentiate(model, list(arguments), **{k: k for k in arguments})
    row = df.select(got.value.alias("value"), *(got.parts[k].alias(f"d_{k}") for k in arguments)).first()
    assert row.value == pytest.approx(plain(**arguments), rel=1e-12)
    for k, v in arguments.items():
        exact = plain(**(arguments | {k: v + 1e-30j})).imag / 1e-30
        assert row[f"d_{k}"] == pytest.approx(exact, rel=1e-10, abs=1e-13), k


def test_sinc_and_unknown_arguments(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1e-5, 0.4, -1.3)], "x double")
    got = dual.differentiate(models.sinc, ["x"], x="x")
    for r in df.select("x", got.value.alias("v"), got.parts["x"].alias("d")).collect():
        y = np.pi * r.x
        assert r.v == pytest.approx(np.sinc(r.x)) and r.d == pytest.approx(np.pi * ((np.cos(y) - np.sinc(r.x)) / y if abs(y) > 1e-3 else -y / 3), abs=1e-9)
    with pytest.raises(ValueError, match="no such"):
        dual.differentiate(models.sinc, ["y"], x="x")


def rosenbrock(x):
    return (1 - x["a"]) ** 2 + (x["b"] - x["a"] * x["a"]) ** 2 * 100


def test_lbfgs_on_a_table(spark):
    """One valley, and many rows at once; each row's minimum is its own."""
    one = spark.createDataFrame([(7,)], "k int")
    r = fitting.lbfgs(one, rosenbrock, {"a": F.lit(0.8), "b": F.lit(0.6)}, max_iterations=25).first()
    assert (r.a, r.b) == (pytest.approx(1, abs=1e-3), pytest.approx(1, abs=2e-3)) and r.k == 7
    many = spark.range(40).select("id", (F.col("id") / 10).alias("goal"))
    seen = []
    got = fitting.lbfgs(many, lambda x: (x["u"] - F.col("goal")) ** 2 * (1 + F.col("goal")), {"u": F.lit(0.0)}, max_iterations=15, callback=lambda k, v: seen.append(v))
    assert all(abs(r.u - r.goal) < 1e-3 for r in got.collect()) and seen == sorted(seen, reverse=True)
    with pytest.raises(ValueError, match="named like"):
        fitting.lbfgs(many, lambda x: x["id"] ** 2, {"id": F.lit(0.0)})
    assert fitting.lbfgs(many.limit(0), lambda x: x["u"] ** 2, {"u": F.lit(1.0)}).count() == 0


def test_recursion_is_the_two_loop_one():
    rng = np.random.default_rng(0)
    s, y, g = rng.normal(size=(3, 6)), rng.normal(size=(3, 6)), rng.normal(size=6)
    y = y + 3 * s
    q, kept = g.copy(), []
    for k in reversed(range(3)):
        kept.append(s[k] @ q / (s[k] @ y[k]))
        q -= kept[-1] * y[k]
    q *= s[2] @ y[2] / (y[2] @ y[2])
    for k, a in zip(range(3), reversed(kept)):
        q += s[k] * (a - y[k] @ q / (s[k] @ y[k]))
    basis = np.concatenate([s, y, g[None]])
    assert np.allclose(fitting._recursion(basis @ basis.T, 3) @ basis, -q)


def test_adam_on_a_table_is_adam(spark):
    """Rows take the steps of the small solver, over more than one round."""
    starts = [(0, 0.8, 0.7), (1, -0.5, 0.2)]
    df = spark.createDataFrame(starts, "k int, a0 double, b0 double")
    got = fitting.adam(df, rosenbrock, {"a": F.col("a0"), "b": F.col("b0")}, max_iterations=25, rate=0.02, decay=0.1, a_round=10)

    def value(v):
        a, c = 1 - v[0], v[1] - v[0] ** 2
        return a * a + 100 * c * c, np.array([-2 * a - 400 * v[0] * c, 200 * c])

    for r in got.collect():
        want = solvers.adam(value, np.array(starts[r.k][1:]), 25, 0.02, decay=0.1)
        assert np.allclose([r.a, r.b], want, atol=1e-9)

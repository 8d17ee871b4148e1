"""Closed-form signal models as column expressions; parameters are columns, names, numbers or dual
numbers (all of them, then: `dual.differentiate`)."""

from __future__ import annotations

import math

from pyspark.sql import Column

from lattica.functions import dual
from lattica.functions.complexpair import column

#: Fixed value: gyromagnetic ratio of the proton in Hz per tesla.
GYROMAGNETIC_RATIO_PROTON = 42.5764e6


def inversion_recovery(ti, m0, t1) -> Column:
    return column(m0) * (1 - 2 * dual.exp(-column(ti) / column(t1)))


def saturation_recovery(time, m0, t1) -> Column:
    return column(m0) * (1 - dual.exp(-column(time) / column(t1)))


def mono_exponential_decay(time, m0, decay) -> Column:
    return column(m0) * dual.exp(-column(time) / column(decay))


def molli(ti, a, c, t1) -> Column:
    return column(a) * (1 - (1 + column(c)) * dual.exp(-column(ti) / column(t1) * column(c)))


def spoiled_gre(flip_angle, echo_time, repetition_time, m0, t1, t2star) -> Column:
    e1 = dual.exp(-column(repetition_time) / column(t1))
    alpha = column(flip_angle)
    return column(m0) * dual.sin(alpha) * (1 - e1) / (1 - dual.cos(alpha) * e1) * dual.exp(-column(echo_time) / column(t2star))


def transient_steady_state(time, repetition_time, m0, t1, flip_angle, scaling=1.0, delay=0.0) -> Column:
    m0, t1 = column(m0), column(t1)
    start = m0 + m0 * (column(scaling) - 1) * dual.exp(-column(delay) / t1)
    lost = dual.log(dual.cos(column(flip_angle))) / column(repetition_time)
    steady = m0 / (1 - t1 * lost)
    return steady + (start - steady) * dual.exp(-column(time) * (1 / t1 - lost))


def sinc(x) -> Column:
    """sin(pi x) / (pi x), 1 at 0."""
    return dual.sinc(column(x) * math.pi)


def _saturated(offset, b0_shift, relative_b1, rf_duration, b1_nominal, gamma) -> Column:
    rate = column(b1_nominal) * column(relative_b1) * gamma
    off = column(offset) - column(b0_shift)
    shape = sinc(column(rf_duration) * dual.sqrt(rate * rate + off * off))
    turn = rate * math.pi * column(rf_duration)
    return turn * turn * shape * shape


def wasabi(offset, b0_shift, relative_b1, c, a, rf_duration=0.005, b1_nominal=3.7e-6, gamma=GYROMAGNETIC_RATIO_PROTON) -> Column:
    return column(c) * (1 - column(a) * _saturated(offset, b0_shift, relative_b1, rf_duration, b1_nominal, gamma))


def wasabiti(offset, recovery_time, b0_shift, relative_b1, t1, rf_duration=0.005, b1_nominal=3.75e-6, gamma=GYROMAGNETIC_RATIO_PROTON) -> Column:
    recovered = 1 - dual.exp(-column(recovery_time) / column(t1))
    return recovered * (1 - 2 * _saturated(offset, b0_shift, relative_b1, rf_duration, b1_nominal, gamma))


MODELS = {f.__name__: f for f in (inversion_recovery, saturation_recovery, mono_exponential_decay, molli, spoiled_gre, transient_steady_state, wasabi, wasabiti)}


class SignalModel:
    """A model as an operator on tables: named parameters in, one signal column out."""

    def __init__(self, expression, *parameters: str, **fixed):
        self.expression, self.parameters, self.fixed = expression, parameters, fixed

    def __call__(self, df, out: str = "signal", **columns):
        """columns: the column of each parameter; those not given are named like the parameter."""
        if unknown := set(columns) - set(self.parameters):
            raise ValueError(f"no such parameters: {sorted(unknown)}")
        return df.withColumn(out, self.expression(*(columns.get(p, p) for p in self.parameters), **self.fixed))

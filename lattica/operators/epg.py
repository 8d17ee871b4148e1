"""Extended phase graphs: spin simulation of block sequences, vectorized over rows in Arrow batches.

A state is (3, states) per row: F+, F-, Z. Sequences are plain lists of blocks, built on the driver;
`simulate` runs them over rows with columns m0, t1, t2 [, b1, t1_rho] and adds the signal's arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lattica.workers import reachable

#: Rows simulated together: 2048 rows of 64 states take about 6 MB.
ROWS = 2048


class Spins:
    """States and parameters of many rows."""

    def __init__(self, m0, t1, t2, b1=None, t1_rho=None, states: int = 20):
        if states < 2:
            raise ValueError("at least two states")
        self.m0, self.t1, self.t2 = m0, t1, t2
        self.b1 = np.ones(len(t1), complex) if b1 is None else np.asarray(b1, complex)
        self.t1_rho = t1_rho
        self.s = np.zeros((len(t1), 3, states), complex)
        self.s[:, 2, 0] = 1
        self.signal: list[np.ndarray] = []

    def pulse(self, angle: float, phase: float = 0.0, ideal: bool = False):
        """ideal: the pulse does not feel b1."""
        b1 = np.ones(len(self.t1)) if ideal else self.b1
        a, p = angle * np.abs(b1), phase + np.angle(b1)
        c2, s2, s, e = np.cos(a / 2) ** 2, np.sin(a / 2) ** 2, np.sin(a), np.exp(1j * p)
        m = np.empty((len(a), 3, 3), complex)
        m[:, 0, 0], m[:, 0, 1], m[:, 0, 2] = c2, e**2 * s2, -1j * e * s
        m[:, 1, 0], m[:, 1, 1], m[:, 1, 2] = e.conj() ** 2 * s2, c2, 1j * e.conj() * s
        m[:, 2, 0], m[:, 2, 1], m[:, 2, 2] = -0.5j * e.conj() * s, 0.5j * e * s, np.cos(a)
        self.s = m @ self.s

    def relax(self, time, recover: bool = True):
        e1, e2 = np.exp(-time / self.t1), np.exp(-time / self.t2)
        self.s[:, :2] *= e2[:, None, None]
        self.s[:, 2] *= e1[:, None]
        if recover:
            self.s[:, 2, 0] += 1 - e1

    def dephase(self):
        plus, minus = self.s[:, 0], self.s[:, 1]
        new = np.empty_like(self.s)
        new[:, 0, 1:], new[:, 0, 0] = plus[:, :-1], minus[:, 1].conj()
        new[:, 1, :-1], new[:, 1, -1] = minus[:, 1:], 0
        new[:, 2] = self.s[:, 2]
        self.s = new

    def spin_lock(self, time):
        """Decay of the locked transverse states."""
        self.s[:, :2] *= np.exp(-time / self.t1_rho)[:, None, None]

    def acquire(self):
        self.signal.append(self.m0 * self.s[:, 0, 0])


class Block:
    duration: float = 0.0

    def run(self, x: Spins) -> None:
        raise NotImplementedError


@dataclass
class Pulse(Block):
    angle: float
    phase: float = 0.0

    def run(self, x):
        x.pulse(self.angle, self.phase)


class Acquire(Block):
    def run(self, x):
        x.acquire()


class Dephase(Block):
    def run(self, x):
        x.dephase()


@dataclass
class Delay(Block):
    duration: float

    def __post_init__(self):
        if self.duration < 0:
            raise ValueError("a delay cannot be negative")

    def run(self, x):
        x.relax(self.duration)


@dataclass
class Fisp(Block):
    """Pulse, wait te, acquire, dephase, wait the rest of tr; for each angle."""

    angles: Sequence[float]
    phases: Sequence[float]
    te: float
    tr: float

    def __post_init__(self):
        if not 0 <= self.te <= self.tr:
            raise ValueError("te must lie between 0 and tr")
        self.duration = self.tr * len(self.angles)

    def run(self, x):
        for a, p in zip(self.angles, self.phases):
            x.pulse(a, p)
            x.relax(self.te)
            x.acquire()
            x.dephase()
            x.relax(self.tr - self.te)


@dataclass
class Tse(Block):
    """90° excitation and a train of refocusing pulses, one echo each."""

    angles: Sequence[float]
    phases: Sequence[float]
    te: float

    def __post_init__(self):
        self.duration = self.te * len(self.angles)

    def run(self, x):
        x.pulse(math.pi / 2, math.pi / 2)
        for a, p in zip(self.angles, self.phases):
            x.relax(self.te / 2)
            x.dephase()
            x.pulse(a, p)
            x.dephase()
            x.relax(self.te / 2)
            x.acquire()


@dataclass
class Inversion(Block):
    """An ideal inversion (as all preparations, it does not feel b1) and a wait."""

    time: float

    def __post_init__(self):
        self.duration = self.time

    def run(self, x):
        x.pulse(math.pi, ideal=True)
        x.relax(self.time)


@dataclass
class T2Prep(Block):
    te: float

    def __post_init__(self):
        self.duration = self.te

    def run(self, x):
        x.pulse(math.pi / 2, 0.0, ideal=True)
        x.relax(self.te / 2)
        x.pulse(math.pi, math.pi / 2, ideal=True)
        x.relax(self.te / 2)
        x.pulse(-math.pi / 2, 0.0, ideal=True)
        x.dephase()  # spoils what is left across


@dataclass
class T1RhoPrep(Block):
    lock: float

    def __post_init__(self):
        self.duration = self.lock

    def run(self, x):
        if x.t1_rho is not None:
            x.pulse(math.pi / 2, 0.0, ideal=True)
            x.spin_lock(self.lock)
            x.pulse(-math.pi / 2, 0.0, ideal=True)
            x.dephase()


@dataclass
class Sequence_(Block):
    blocks: list = field(default_factory=list)

    @property
    def duration(self):
        return sum(b.duration for b in self.blocks)

    def run(self, x):
        for b in self.blocks:
            b.run(x)


def multi_echo_spin_echo(angles, phases, te=0.02) -> Sequence_:
    return Sequence_([Tse(angles, phases, te)])


def triangle(rise: int, flat: int, fall: int, peak: float) -> list[float]:
    return [peak * (k + 1) / rise for k in range(rise)] + [peak] * flat + [peak * (fall - 1 - k) / fall for k in range(fall)]


def ramp_angles(count: int = 500) -> list[float]:
    """Two triangles up to 25 and 75 degrees, then a constant angle. In rad."""
    degrees = triangle(84, 40, 84, 25.0) + triangle(84, 0, 84, 75.0)
    return [math.radians(d) for d in degrees + [8.3333] * (count - len(degrees))]


def inversion_fisp(angles: Sequence[float] | None = None, te: float = 0.0007, tr: float = 0.012, ti: float = 0.02) -> Sequence_:
    angles = ramp_angles() if angles is None else angles
    return Sequence_([Inversion(ti), Fisp(angles, [0.0] * len(angles), te, tr)])


#: Largest angle in degrees of each block of cardiac fingerprinting.
BLOCK_PEAKS = (12.5, 18.75, 25, 25, 25) * 3


def cardiac_fingerprinting(times: Sequence[float] = tuple(range(15)), te: float = 0.0015, tr: float = 0.005, prep: Sequence[float] = (0.03, 0.05, 0.08), per_block: int = 47) -> Sequence_:
    """15 blocks: inversion, no preparation and three T2 preparations in turn, each with angles that
    rise from 4 degrees in 16 steps and then stay. times: of the blocks, or of all readouts."""
    if len(times) == 15 * per_block:
        times = times[::per_block]
    if len(times) != 15:
        raise ValueError(f"15 or {15 * per_block} acquisition times, not {len(times)}")
    out: list[Block] = []
    for k, peak in enumerate(BLOCK_PEAKS):
        angles = [math.radians(4 + (peak - 4) * min(j, 15) / 15) for j in range(per_block)]
        before = [Inversion(0.02), None, *(T2Prep(t) for t in prep)][k % 5]
        block = Sequence_([b for b in (before, Fisp(angles, [0.0] * per_block, te, tr)) if b])
        if k:
            wait = times[k] - times[k - 1] - block.duration
            if wait < 0:
                raise ValueError(f"block {k} would begin before the one before it ends")
            out.append(Delay(wait))
        out.append(block)
    return Sequence_(out)


def simulate(df: DataFrame, sequence: Block, key: str, states: int = 20) -> DataFrame:
    """(key, re, im): the signal of each row as arrays over time."""
    have = [c for c in ("b1", "t1_rho") if c in df.columns]
    reachable(df.sparkSession)
    schema = T.StructType([df.schema[key], *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("re", "im"))])

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at : at + ROWS]
                col = lambda c: part[c].to_numpy(float)  # noqa: B023, E731
                x = Spins(col("m0"), col("t1"), col("t2"), *(col(c) if c in have else None for c in ("b1", "t1_rho")), states=states)
                sequence.run(x)
                s = np.stack(x.signal, 1)
                yield pd.DataFrame({key: part[key].to_numpy(), "re": list(s.real), "im": list(s.imag)})

    return df.select(key, "m0", "t1", "t2", *have).mapInPandas(run, schema)

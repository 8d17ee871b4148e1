"""Trajectories of Pulseq sequence files: event tables, and gradient integrals as a scan over blocks.

A file's sections become rows (one task a file, no more than its text), gradients become polylines. Moments are
two passes: the area of every block, summed up over the blocks before it, then the part of a block before
each sample. An excitation sets k to zero, a refocusing pulse turns its sign: between pulses k is the moment
plus an offset, which is an alternating sum over the pulses since the last excitation.

Read: versions 1.2 to 1.5, traps, arbitrary and extended gradients, delays. Gradients are in 1/m a second,
times in s, k in 1/m. Pulses are excitations unless the file (1.5) or their angle (on request) says otherwise.
Rotations and other extensions are not applied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.workers import reachable

AXES = ("x", "y", "z")
_GRADIENT = "array<double>"
_BLOCKS = "file string, block long, duration double, rf double, refocus boolean, adc_n int, adc_dwell double, adc_delay double, " + ", ".join(f"t_{a} {_GRADIENT}, g_{a} {_GRADIENT}" for a in AXES)


def sections(text: str) -> dict[str, list[list[str]]]:
    """Words of the lines of each section; comments and empty lines go."""
    out: dict[str, list[list[str]]] = {}
    now: list[list[str]] = []
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if line.startswith("["):
            now = out.setdefault(line.strip("[]").upper(), [])
        elif line:
            now.append(line.split())
    return out


def shapes(lines: list[list[str]]) -> dict[int, np.ndarray]:
    """Samples by number; packed shapes are differences in runs: a value twice, then how often it goes on."""
    raw: dict[int, list[float]] = {}
    sizes: dict[int, int] = {}
    now = 0
    for words in lines:
        if words[0].lower() == "shape_id":
            now = int(words[1])
            raw[now] = []
        elif words[0].lower() == "num_samples":
            sizes[now] = int(words[1])
        else:
            raw[now].append(float(words[0]))
    out = {}
    for k, v in raw.items():
        if len(v) == sizes[k]:
            out[k] = np.array(v)
            continue
        steps, i = [], 0
        while i < len(v):
            steps.append(v[i])
            if i + 2 < len(v) and v[i] == v[i + 1]:
                steps += [v[i]] * (1 + int(v[i + 2]))
                i += 2
            i += 1
        out[k] = np.cumsum(steps)
        if len(out[k]) != sizes[k]:
            raise ValueError(f"shape {k} has {len(out[k])} samples of {sizes[k]}")
    return out


def parse(text: str, detect_use: bool = False) -> list[tuple]:
    """The blocks of a file, as rows of _BLOCKS without the file."""
    part = sections(text)
    version = {w[0]: int("".join(c for c in w[1] if c.isdigit())) for w in part.get("VERSION", [])}
    number = (version.get("major", 1), version.get("minor", 0))
    if not (1, 2) <= number <= (1, 5):
        raise ValueError(f"version {number} is not known")
    raster = {w[0]: float(w[1]) for w in part.get("DEFINITIONS", []) if w[0].endswith("Raster") or w[0].endswith("RasterTime")}
    grad, rf_raster, block_raster = raster.get("GradientRasterTime", 1e-5), raster.get("RadiofrequencyRasterTime", 1e-6), raster.get("BlockDurationRaster", 1e-5)
    shape = shapes(part.get("SHAPES", []))
    lines: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in part.get("TRAP", []):
        amplitude, rise, flat, fall, delay = float(w[1]), *(float(v) * 1e-6 for v in w[2:6])
        lines[int(w[0])] = delay + np.cumsum([0, rise, flat, fall]), np.array([0, amplitude, amplitude, 0.0])
    for w in part.get("GRADIENTS", []):
        first = last = None
        if number >= (1, 5):
            first, last, w = float(w[2]), float(w[3]), [w[0], w[1], *w[4:]]
        wave, delay = float(w[1]) * shape[int(w[2])], float(w[-1]) * 1e-6
        timed = int(w[3]) if number >= (1, 4) else 0
        if timed > 0:
            lines[int(w[0])] = delay + shape[timed] * grad, wave
        else:
            step = grad / 2 if timed == -1 else grad
            ends = [first, last] if first is not None else [(3 * wave[0] - wave[1]) / 2, (3 * wave[-1] - wave[-2]) / 2] if len(wave) > 1 else [wave[0]] * 2
            at = delay + (np.arange(len(wave)) + (1.0 if timed == -1 else 0.5)) * step
            lines[int(w[0])] = np.r_[delay, at, at[-1] + step * (1.0 if timed == -1 else 0.5)], np.r_[ends[0], wave, ends[1]]
    pulses = {}
    for w in part.get("RF", []):
        timed = int(w[4]) if number >= (1, 4) else 0
        magnitude = np.abs(shape[int(w[2])])
        at = shape[timed] * rf_raster if timed > 0 else (np.arange(len(magnitude)) + 0.5) * rf_raster
        delay = float(w[6 if number >= (1, 5) else 5 if number >= (1, 4) else 4]) * 1e-6
        center = float(w[5]) * 1e-6 if number >= (1, 5) else float(at[magnitude >= magnitude.max() * 0.99999].mean())
        wave = float(w[1]) * magnitude * np.exp(2j * np.pi * shape[int(w[3])]) if int(w[3]) in shape else float(w[1]) * magnitude
        angle = 360 * abs(np.sum((wave[1:] + wave[:-1]) / 2 * np.diff(at))) if timed > 0 else 360 * abs(wave.sum()) * rf_raster
        pulses[int(w[0])] = delay + center, (w[-1] == "r" if number >= (1, 5) else detect_use and angle > 90.01)
    adcs = {int(w[0]): (int(w[1]), float(w[2]) * 1e-9, float(w[3]) * 1e-6) for w in part.get("ADC", [])}
    delays = {int(w[0]): float(w[1]) * 1e-6 for w in part.get("DELAYS", [])}
    out = []
    for w in part.get("BLOCKS", []):
        k, length, rf, *gradients, adc = (int(v) for v in w[:7])
        own = [lines.get(g, (np.zeros(0),) * 2) for g in gradients]
        pulse, readout = pulses.get(rf), adcs.get(adc)
        if number >= (1, 4):
            duration = length * block_raster
        else:  # the longest event
            duration = max([delays.get(length, 0.0), *(t[-1] for t, _ in own if len(t)), readout[2] + readout[0] * readout[1] if readout else 0.0, pulse[0] if pulse else 0.0])
        out.append((k, duration, *(pulse or (None, None)), *(readout or (None, None, None)), *(v.tolist() for line in own for v in line)))
    return out


def blocks(spark: SparkSession, path: str, detect_use: bool = False) -> DataFrame:
    """A row a block of every .seq file: duration, the center of its pulse, its readout and its gradients as polylines."""
    reachable(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.seq").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        from lattica.sources import pulseq

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = pulseq.parse(raw.decode("utf-8", "replace"), detect_use)
                for a in range(0, len(rows), 4096):
                    columns = list(zip(*rows[a : a + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(columns[0])), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names)

    lists = pa.list_(pa.float64())
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int32(), pa.float64(), pa.float64(), *[lists] * 6]
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    return files.mapInArrow(run, _BLOCKS)


def _moment(t, g, at: np.ndarray) -> np.ndarray:
    """Areas under a polyline up to places."""
    t, g = np.asarray(t, float), np.asarray(g, float)
    if not len(t):
        return np.zeros(len(at))
    area = np.r_[0.0, np.cumsum(np.diff(t) * (g[1:] + g[:-1]) / 2)]
    inside = np.clip(at, t[0], t[-1])
    k = np.clip(np.searchsorted(t, inside, side="right") - 1, 0, len(t) - 2) if len(t) > 1 else np.zeros(len(at), int)
    if len(t) == 1:
        return np.zeros(len(at))
    width = np.where(t[k + 1] > t[k], t[k + 1] - t[k], 1.0)
    here = g[k] + (g[k + 1] - g[k]) * (inside - t[k]) / width
    return area[k] + (inside - t[k]) * (g[k] + here) / 2


def _moments(batches):
    """Of each block the area of its gradients, and the area up to its pulse."""
    for batch in batches:
        rows = batch.to_pylist()
        made = []
        for a in AXES:
            ends = [_moment(r[f"t_{a}"], r[f"g_{a}"], np.array([np.inf, r["rf"] if r["rf"] is not None else np.inf])) for r in rows]
            made += [pa.array([float(e[0]) for e in ends], pa.float64()), pa.array([float(e[1]) for e in ends], pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(f"{n}_{a}" for a in AXES for n in ("area", "pulse"))])


def _samples(batches):
    """Rows of a block's readout: the moment before each sample, and the offset."""
    for batch in batches:
        for r in batch.to_pylist():
            at = r["adc_delay"] + (np.arange(r["adc_n"]) + 0.5) * r["adc_dwell"]
            k = []
            for a in AXES:
                moment = r[f"start_{a}"] + _moment(r[f"t_{a}"], r[f"g_{a}"], at)
                if r["rf"] is None:
                    k.append(moment + r[f"before_{a}"])
                else:  # the pulse of the block itself
                    k.append(np.where(at < r["rf"], moment + r[f"before_{a}"], moment + r[f"offset_{a}"]))
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * n), pa.array([r["first"]] * n) if n == 0 else pa.array(r["first"] + np.arange(n)), *(pa.array(v) for v in k)], ["file", "sample", *(f"k{a}" for a in AXES)])


def kspace(spark: SparkSession, path: str, detect_use: bool = False) -> DataFrame:
    """(file, sample, kx, ky, kz) of all readouts, samples numbered in their order."""
    own = blocks(spark, path, detect_use)
    schema = _BLOCKS + "".join(f", {n}_{a} double" for a in AXES for n in ("area", "pulse"))
    rows = own.mapInArrow(_moments, schema)
    order = Window.partitionBy("file").orderBy("block")  # a row a block, of one file
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"start_{a}": F.coalesce(F.sum(f"area_{a}").over(before), F.lit(0.0)) for a in AXES} | {"first": F.coalesce(F.sum(F.coalesce("adc_n", F.lit(0))).over(before), F.lit(0)), "excited": F.sum(F.when(F.col("rf").isNotNull() & ~F.col("refocus"), 1).otherwise(0)).over(upto)})
    # Pulses since an excitation: the j-th refocusing pulse has the sign (-1)^j.
    since = Window.partitionBy("file", "excited").orderBy("block")
    upto, before = since.rowsBetween(Window.unboundedPreceding, 0), since.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("turns", F.sum(F.when(F.col("refocus"), 1).otherwise(0)).over(upto))
    sign = F.when(F.col("turns") % 2 == 0, 1.0).otherwise(-1.0)
    for a in AXES:
        moment = F.col(f"start_{a}") + F.col(f"pulse_{a}")
        term = F.when(F.col("rf").isNull(), 0.0).when(F.col("refocus"), sign * moment * -2).otherwise(-moment)
        rows = rows.withColumn(f"__term_{a}", term).withColumn(f"offset_{a}", sign * F.sum(f"__term_{a}").over(upto))
    every = Window.partitionBy("file").orderBy("block")
    rows = rows.withColumns({f"before_{a}": F.coalesce(F.lag(f"offset_{a}").over(every), F.lit(0.0)) for a in AXES})
    read = rows.where("adc_n > 0").drop(*(f"__term_{a}" for a in AXES), *(f"{n}_{a}" for a in AXES for n in ("area", "pulse")))
    return read.mapInArrow(_samples, "file string, sample long, kx double, ky double, kz double")


def trajectory(samples: DataFrame, matrix: dict[str, int], n_k0: int) -> DataFrame:
    """(file, other, k0, kz, ky, kx): readouts of n_k0 samples, scaled so that the largest k of an axis is half its
    matrix; an axis without gradients stays zero."""
    most = samples.groupBy("file").agg(*(F.max(F.abs(f"k{a}")).alias(f"__m_{a}") for a in AXES))  # a row a file
    scaled = lambda a: F.when(F.col(f"__m_{a}") > 0, F.col(f"k{a}") * (matrix[a] / 2) / F.col(f"__m_{a}")).otherwise(F.lit(0.0)).alias(f"k{a}")
    return samples.join(most, "file").select("file", F.expr(f"cast(sample div {n_k0} as int)").alias("other"), (F.col("sample") % n_k0).cast("int").alias("k0"), *(scaled(a) for a in reversed(AXES)))

"""Sequence files against written-out integrals."""

import math

import numpy as np
import pytest

from lattica.sources import pulseq

HEAD = "# file\n[VERSION]\nmajor 1\nminor {minor}\nrevision 0\n\n[DEFINITIONS]\nAdcRasterTime 1e-07\nBlockDurationRaster 1e-05\nGradientRasterTime 1e-05\nRadiofrequencyRasterTime 1e-06\nName t\n\n"
SHAPE = "[SHAPES]\n\nshape_id 1\nnum_samples 100\n1\n0\n0\n97\n\nshape_id 2\nnum_samples 100\n0\n0\n98\n\n"  # ones, then zeros, packed


def radial(n: int, samples: int) -> str:
    """Spokes: pulse, prephaser of half the area, readout with samples in its flat part."""
    blocks, traps = [], []
    for k in range(n):
        angle = k * math.pi / n
        for j, amplitude in enumerate((np.cos(angle) * 1000, np.sin(angle) * 1000)):
            traps.append(f"{4 * k + 2 * j + 1} {-amplitude:.9g} 100 400 100 0")
            traps.append(f"{4 * k + 2 * j + 2} {amplitude:.9g} 100 900 100 0")
        blocks += [f"{3 * k + 1} 20 1 0 0 0 0 0", f"{3 * k + 2} 60 0 {4 * k + 1} {4 * k + 3} 0 0 0", f"{3 * k + 3} 110 0 {4 * k + 2} {4 * k + 4} 0 1 0"]
    return HEAD.format(minor=4) + "[BLOCKS]\n" + "\n".join(blocks) + "\n\n[RF]\n1 250 1 2 0 50 0 0\n\n[TRAP]\n" + "\n".join(traps) + f"\n\n[ADC]\n1 {samples} {900_000 // samples} 100 0 0\n\n" + SHAPE


def test_radial(spark, tmp_path):
    n, samples = 5, 30
    (tmp_path / "a.seq").write_text(radial(n, samples))
    rows = pulseq.kspace(spark, str(tmp_path)).orderBy("sample").toPandas()
    assert list(rows["sample"]) == list(range(n * samples))
    at = (np.arange(samples) + 0.5) * 30e-6
    line = -0.5e-3 * 1000 + 1000 * (50e-6 + at)
    for k in range(n):
        own = rows[k * samples : (k + 1) * samples]
        assert np.allclose(own.kx, line * np.cos(k * math.pi / n), atol=1e-6) and np.allclose(own.ky, line * np.sin(k * math.pi / n), atol=1e-6) and not own.kz.any()
    traj = pulseq.trajectory(pulseq.kspace(spark, str(tmp_path)), {"x": 64, "y": 32, "z": 1}, samples).toPandas()
    assert traj.kx.abs().max() == pytest.approx(32) and traj.ky.abs().max() == pytest.approx(16) and len(traj) == n * samples and set(traj.other) == set(range(n))


def test_refocusing_pulses_turn_the_sign(spark, tmp_path):
    """Excitation, gradient, refocusing, gradient, refocusing, readout; then a new excitation."""
    text = HEAD.format(minor=5) + "[BLOCKS]\n1 20 1 0 0 0 0 0\n2 60 0 1 0 0 0 0\n3 20 2 0 0 0 0 0\n4 60 0 1 0 0 0 0\n5 20 2 0 0 0 0 0\n6 60 0 1 0 0 1 0\n7 20 1 0 0 0 1 0\n8 60 0 1 0 0 1 0\n\n"
    text += "[RF]\n1 250 1 2 0 50 50 0 0 0 0 e\n2 500 1 2 0 50 50 0 0 0 0 r\n\n[TRAP]\n1 1000 100 400 100 0\n\n[ADC]\n1 4 50000 200 0 0 0 0 0\n\n" + SHAPE
    (tmp_path / "a.seq").write_text(text)
    rows = pulseq.kspace(spark, str(tmp_path)).orderBy("sample").toPandas()
    inner = 1000 * (50e-6 + (np.array([0.5, 1.5, 2.5, 3.5]) * 50e-6 + 100e-6))
    # After block 2: 0.5; turned -0.5; after block 4: 0; turned 0; then the readout; the pulse in block 7 sets to zero.
    assert np.allclose(rows.kx[:4], inner) and np.allclose(rows.kx[8:], inner) and np.allclose(rows.kx[4:8], 0)


def test_arbitrary_gradients_and_shapes(spark, tmp_path):
    wave = np.sin(np.linspace(0, 3, 50))
    body = "[SHAPES]\n\nshape_id 1\nnum_samples 50\n" + "\n".join(f"{v:.12g}" for v in wave) + "\n\nshape_id 2\nnum_samples 3\n0\n10\n50\n\nshape_id 3\nnum_samples 3\n0\n1\n0.5\n\n"
    text = HEAD.format(minor=4) + "[BLOCKS]\n1 60 0 1 2 0 1 0\n\n[GRADIENTS]\n1 2000 1 0 20\n2 500 3 2 0\n\n[ADC]\n1 10 40000 30 0 0\n\n" + body
    (tmp_path / "a.seq").write_text(text)
    rows = pulseq.kspace(spark, str(tmp_path)).orderBy("sample").toPandas()
    fine = np.linspace(0, 6e-4, 600_001)
    centers = 20e-6 + (np.arange(50) + 0.5) * 1e-5
    g = np.interp(fine, np.r_[20e-6, centers, 520e-6], 2000 * np.r_[(3 * wave[0] - wave[1]) / 2, wave, (3 * wave[-1] - wave[-2]) / 2], left=0, right=0)
    h = np.interp(fine, [0, 1e-4, 5e-4], [0, 500, 250], right=0)
    at = 30e-6 + (np.arange(10) + 0.5) * 40e-6
    for name, v in (("kx", g), ("ky", h)):
        total = np.r_[0, np.cumsum((v[1:] + v[:-1]) / 2 * np.diff(fine))]
        assert np.allclose(rows[name], np.interp(at, fine, total), atol=1e-6)


def test_shapes_and_versions():
    got = pulseq.shapes([["shape_id", "1"], ["num_samples", "5"], ["1"], ["0"], ["0"], ["2"], ["shape_id", "2"], ["num_samples", "2"], ["3"], ["4"]])
    assert got[1].tolist() == [1] * 5 and got[2].tolist() == [3, 4]
    with pytest.raises(ValueError, match="samples"):
        pulseq.shapes([["shape_id", "1"], ["num_samples", "9"], ["1"], ["2"]])
    with pytest.raises(ValueError, match="version"):
        pulseq.parse(HEAD.format(minor=9))

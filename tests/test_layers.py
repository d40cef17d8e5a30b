"""Rings and paths against plain versions."""

import math

import numpy as np
import pandas as pd

from placekit.operators import layers
from placekit.plans import catalogue
from placekit.plans.adapter import view

SF = "/root/testdata/sf0.001"


def test_rings_into_parts():
    rings = pd.DataFrame([(0, 0, 10, 10, 100), (2, 2, 4, 4, 4), (20, 0, 26, 6, 36), (40, 0, 45, 5, 25), (27, 0, 28, 1, 1)], columns=["x0", "y0", "x1", "y1", "area"])
    assert layers.ring_parts(rings).tolist() == [0, 0, 1, 2, 1]
    assert sorted(layers.ring_parts(rings.iloc[::-1]).tolist()) == [0, 0, 1, 1, 2]


def walked(xy, step=0.5):
    """One point at a time."""
    out, carry = [tuple(xy[0])], 0.0
    for vertex in xy[1:]:
        far = math.dist(out[-1], vertex)
        while carry + far >= step:
            go = step - carry
            out.append(tuple(a + (b - a) * go / far for a, b in zip(out[-1], vertex)))
            carry, far = 0.0, math.dist(out[-1], vertex)
        carry += far
    return out if len(out) >= 6 else []


def test_resampled_paths(spark):
    got = {}
    for r in sorted(catalogue.queries()["resample_path"](spark, SF).collect()):
        got.setdefault(r["path"], []).append((r["x"], r["y"]))
    paths = {}
    for r in sorted(view(spark, SF, "O").select("path", "key", "lat", "lng").collect()):
        paths.setdefault(r["path"], []).append(((r["lng"] + 73.5) * 20, (r["lat"] - 41) * 20))
    want = {k: w for k, p in paths.items() if (w := walked(p))}
    assert got.keys() == want.keys() and len(got)
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in got)
    assert len(layers.resample(np.zeros((3, 2)))) == 0


def test_ring_query_keeps_every_ring(spark):
    out = catalogue.queries()["ring_parts"](spark, SF)
    assert out.count() == out.select("ring").distinct().count() == view(spark, SF, "R").count()

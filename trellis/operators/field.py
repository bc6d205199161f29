"""Forces between all points by a grid of fixed size: masses of grid nodes, one convolution, interpolation.

Points give their mass to the four nodes around them; what reaches the driver is the table of
nodes, whose size is a parameter; a fast Fourier transform convolves it with a kernel; points read
their force from the four nodes again. So a step is linear in the points and never compares pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Box:
    """A square grid of ``n`` by ``n`` nodes over all points."""

    def __init__(self, n: int, low: tuple[float, float], width: float):
        self.n, self.low, self.step = n, low, max(width, 1e-9) / (n - 1)

    @staticmethod
    def around(points: DataFrame, n: int) -> Box:
        r = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        x0, y0, x1, y1 = (float(v or 0.0) for v in r)
        side = max(x1 - x0, y1 - y0, 1e-6) * 1.02
        return Box(n, ((x0 + x1 - side) / 2, (y0 + y1 - side) / 2), side)

    def nodes(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(four node numbers, four weights) of each point."""
        u, v = (x - self.low[0]) / self.step, (y - self.low[1]) / self.step
        i, j = (np.clip(np.floor(w).astype(np.int64), 0, self.n - 2) for w in (u, v))
        a, b = np.clip(u - i, 0, 1), np.clip(v - j, 0, 1)
        at = np.stack([i * self.n + j, (i + 1) * self.n + j, i * self.n + j + 1, (i + 1) * self.n + j + 1], 1)
        return at, np.stack([(1 - a) * (1 - b), a * (1 - b), (1 - a) * b, a * b], 1)

    def convolve(self, mass: np.ndarray, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all nodes of mass times ``kernel(dx, dy)``, the offset from the other node, at each node."""
        k = np.fft.fftfreq(2 * self.n, 1 / (2 * self.n)) * self.step
        f = np.fft.rfft2(kernel(k[:, None], k[None, :]))
        wide = np.zeros((2 * self.n, 2 * self.n))
        wide[: self.n, : self.n] = mass
        return np.fft.irfft2(np.fft.rfft2(wide) * f, (2 * self.n, 2 * self.n))[: self.n, : self.n]


def masses(points: DataFrame, box: Box) -> np.ndarray:
    """How many points each node stands for; each task hands on the nodes it met."""

    def run(batches):
        total = np.zeros(box.n * box.n)
        for b in batches:
            at, w = box.nodes(b["x"].to_numpy(), b["y"].to_numpy())
            total += np.bincount(at.ravel(), w.ravel(), minlength=len(total))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"node": used, "m": total[used]})

    out = np.zeros(box.n * box.n)
    for r in points.select("x", "y").mapInPandas(run, "node long, m double").groupBy("node").agg(F.sum("m").alias("m")).collect():
        out[r["node"]] = r["m"]
    return out.reshape(box.n, box.n)


def read(points: DataFrame, box: Box, fields: dict[str, np.ndarray], key: str = "cell") -> DataFrame:
    """(key, x, y, and a column a field) of points, read from the four nodes around them."""
    kind = points.schema[key].dataType.simpleString()
    flat = {n: f.ravel() for n, f in fields.items()}

    def run(batches):
        for b in batches:
            at, w = box.nodes(b["x"].to_numpy(), b["y"].to_numpy())
            yield b.assign(**{n: (f[at] * w).sum(1) for n, f in flat.items()})

    return points.select(key, "x", "y").mapInPandas(run, f"{key} {kind}, x double, y double" + "".join(f", {n} double" for n in fields))

"""Feature maps that let linear models stand in for kernel machines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

KERNELS = ("rbf", "poly", "sigmoid")
POLY_DEGREE = 3
LANDMARKS = 256  # rows the sigmoid kernel is laid out from: a sample of fixed size
CLIP = 1e-8  # eigenvalues below this share of the largest one are left out


class _KernelParams(HasInputCol, HasOutputCol, HasSeed):
    kernel = Param(Params._dummy(), "kernel", "rbf, poly or sigmoid", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "scale, auto or a number", TypeConverters.toString)
    components = Param(Params._dummy(), "components", "number of random features", TypeConverters.toInt)
    inputs = Param(Params._dummy(), "inputs", "length of the input vector", TypeConverters.toInt)
    landmarks = Param(Params._dummy(), "landmarks", "entries of the sampled rows, row by row", TypeConverters.toListFloat)


def sigmoid_basis(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """Maps kernel values against the landmarks to features: the eigenvectors over the root of their eigenvalues.

    tanh(gamma x.z) is not positive definite. Of its matrix the part with positive eigenvalues is kept, which is the
    nearest positive semidefinite one.
    """
    values, vectors = np.linalg.eigh(np.tanh(gamma * landmarks @ landmarks.T))
    kept = values > CLIP * max(values[-1], 0.0)
    return vectors[:, kept] / np.sqrt(values[kept]) if kept.any() else np.zeros((len(landmarks), 1))


def clipping_error(landmarks: np.ndarray, gamma: float) -> float:
    """Share of the landmarks' kernel matrix, in the sum of squares, that clipping leaves out; a root."""
    values = np.linalg.eigvalsh(np.tanh(gamma * landmarks @ landmarks.T))
    lost = values[values <= CLIP * max(values[-1], 0.0)]
    return float(np.sqrt((lost**2).sum() / max((values**2).sum(), 1e-300)))


def projector(kernel: str, gamma: float, size: int, width: int, seed: int, landmarks: np.ndarray | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """The feature map from rows of ``size`` entries. Random draws follow from the seed."""
    if kernel == "sigmoid":
        basis = sigmoid_basis(landmarks, gamma)
        return lambda x: np.tanh(gamma * x @ landmarks.T) @ basis
    rng = np.random.default_rng(seed)
    if kernel == "rbf":
        weights = rng.normal(scale=np.sqrt(2.0 * gamma), size=(size, width))
        phase = rng.uniform(0.0, 2.0 * np.pi, size=width)
        return lambda x: np.sqrt(2.0 / width) * np.cos(x @ weights + phase)
    sketches = []
    for _ in range(POLY_DEGREE):
        table = np.zeros((size, width))
        table[np.arange(size), rng.integers(0, width, size)] = rng.choice([-1.0, 1.0], size)
        sketches.append(table * np.sqrt(gamma))

    def project(x: np.ndarray) -> np.ndarray:
        spectrum = np.ones((len(x), width // 2 + 1), dtype=complex)
        for table in sketches:
            spectrum *= np.fft.rfft(x @ table, axis=1)
        return np.fft.irfft(spectrum, n=width, axis=1)

    return project


def kernel_facts(dataset: DataFrame, column: str, kernel: str, wanted: str, seed: int) -> tuple[float, int, list[float]]:
    """Kernel width, length of the rows, and for the sigmoid kernel the landmarks.

    ``scale`` is 1 / (columns x variance of all entries), ``auto`` 1 / columns. Landmarks are distinct rows, the first
    ``LANDMARKS`` in an order by hash, so that reruns agree.
    """
    if kernel not in KERNELS:
        raise ValueError(f"kernel {kernel!r} is not known; use one of {', '.join(KERNELS)}")
    stats = dataset.agg(Summarizer.metrics("count", "mean", "normL2").summary(F.col(column)).alias("s")).first()["s"]
    mean, squares = stats["mean"].toArray(), stats["normL2"].toArray() ** 2 / max(stats["count"], 1)
    size = len(mean)
    variance = float(squares.mean() - mean.mean() ** 2)
    if wanted == "scale":
        gamma = 1.0 / (size * variance) if variance > 0 else 1.0
    elif wanted == "auto":
        gamma = 1.0 / size
    else:
        gamma = float(wanted)
    landmarks = []
    if kernel == "sigmoid":
        rows = dataset.select(vector_to_array(F.col(column)).alias("v")).distinct()
        rows = rows.orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(LANDMARKS).collect()
        landmarks = [x for r in rows for x in r["v"]]
    return gamma, size, landmarks


class KernelMap(Estimator, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the kernel width, and for the sigmoid kernel the sampled rows it is laid out from."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, kernel="rbf", gamma="scale", components=256, seed=42):
        super().__init__()
        self._setDefault(kernel="rbf", gamma="scale", components=256, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KernelMapModel:
        names = ("inputCol", "outputCol", "kernel", "components", "seed")
        kept = {n: self.getOrDefault(n) for n in names}
        gamma, size, landmarks = kernel_facts(dataset, self.getInputCol(), kept["kernel"], self.getOrDefault("gamma"), kept["seed"])
        return KernelMapModel()._set(**kept, gamma=repr(gamma), inputs=size, landmarks=landmarks)


class KernelMapModel(Model, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Maps a vector to features whose dot product approximates the kernel.

    ``rbf`` uses random Fourier features (Rahimi, Recht 2007), ``poly`` the tensor sketch of degree three (Pham, Pagh
    2013), ``sigmoid`` sampled rows (Nyström) with negative eigenvalues clipped. Only parameters are saved.
    """

    def sampled_rows(self) -> np.ndarray:
        return np.array(self.getOrDefault("landmarks")).reshape(-1, self.getOrDefault("inputs"))

    def error(self) -> float:
        """For the sigmoid kernel what clipping leaves out of the sampled rows' kernel matrix, else 0."""
        if self.getOrDefault("kernel") != "sigmoid":
            return 0.0
        return clipping_error(self.sampled_rows(), float(self.getOrDefault("gamma")))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, width, seed = (self.getOrDefault(n) for n in ("inputs", "components", "seed"))
        rows = self.sampled_rows() if self.getOrDefault("kernel") == "sigmoid" else None
        project = projector(self.getOrDefault("kernel"), float(self.getOrDefault("gamma")), size, width, seed, rows)

        @F.pandas_udf("array<double>")
        def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, size))
                yield pd.Series(list(project(x)))

        vectors = mapped(vector_to_array(F.col(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(vectors))

"""Layers of extract, normalise, encode, pool: trained component by component, run as one fused Arrow stage.

Patches and codes never become rows: a task reads images and gives pooled vectors. What has to be trained sees a seeded
sample of its input, taken at the layer's first component.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions import kernels as K
from patchloom.operators import dictionary as D
from patchloom.operators.linalg import checked_model
from patchloom.operators.sampling import location_sample, patch_draws
from patchloom.operators.tensors import map_images, map_vectors
from patchloom.operators.views import _others

Kernel = Callable[[np.ndarray], np.ndarray]


def encoder(kind: str, model: np.ndarray, b: np.ndarray | None = None, alpha: float = 0.25, twoside: bool | str = True, k: int = 5, reg: float = 1e-4) -> Kernel:
    if kind == "linear_bw":
        return lambda x: (x + b) @ model
    if kind == "linear_wb":
        return lambda x: x @ model + b
    if kind == "inner":
        return lambda x: x @ model.T
    if kind == "vq":
        return lambda x: K.one_hot_nearest(x, model)
    if kind == "threshold":
        return lambda x: K.thresholded(x, model, alpha, twoside)
    if kind == "relu":
        return lambda x: K.thresholded(x, model, 0.0, twoside)
    if kind == "triangle":
        return lambda x: K.triangled(x, model)
    if kind == "llc":
        return lambda x: K.locality_coded(x, model, k, reg)
    raise ValueError(f"unknown encoder {kind}")


def pooler(kind: str, method: str = "max", grid=(2, 2), levels=3, size=(2, 2), kernel=None, stride=(1, 1), full: bool = False) -> Kernel:
    if kind == "spatial":
        return lambda x: K.spatial_pooled(x, tuple(grid), method)
    if kind == "overcomplete":
        return lambda x: K.overcomplete_pooled(x, tuple(grid), method)
    if kind == "pyramid":
        return lambda x: K.pyramid_pooled(x, levels, method)
    if kind == "fixed":
        return lambda x: K.fixed_size_pooled(x, tuple(size), method)
    if kind == "kernel":
        return lambda x: K.kernel_pooled(x, np.asarray(kernel, np.float64), tuple(stride), method, full)
    raise ValueError(f"unknown pooler {kind}")


@dataclass
class Component:
    """role: extract, normalise, encode or pool; spec: what the role's factory takes; model and b: what training made."""

    role: str
    spec: dict
    trainer: str | None = None
    trainer_spec: dict = field(default_factory=dict)
    model: np.ndarray | None = None
    b: np.ndarray | None = None

    def kernel(self) -> Kernel:
        s = dict(self.spec)
        if self.role == "extract":
            if s["kind"] == "identical":
                return lambda x: x
            if s["kind"] == "patches":
                return lambda x: K.patches(x, tuple(s["size"]), s.get("stride", 1))
            if s["kind"] == "sift":
                return lambda x: K.dense_sift(x, s["psize"], s["stride"], s.get("contrast", 1.0), s.get("sigma", 1.0), s.get("most", 0.2))
            if s["kind"] == "gradients":
                return lambda x: K.oriented_gradients(x, s.get("sigma", 1.0), s.get("angles", 8), s.get("alpha", 9.0), s.get("twoside", True))
        if self.role == "normalise":
            return lambda x: K.normalized(x, s["kind"], s.get("reg", K.EPS), s.get("channels", 1))
        if self.role == "encode":
            if self.model is None:
                raise ValueError(f"the {s['kind']} encoder isn't trained")
            return encoder(s.pop("kind"), self.model, self.b, **s)
        if self.role == "pool":
            return pooler(s.pop("kind"), **s)
        raise ValueError(f"unknown component {self.role} {s}")

    def train(self, rows: DataFrame, vector: str, ids: str, seed: int) -> None:
        more = {"reg": K.EPS} if self.trainer in ("pca", "zca") else {"ids": ids, "seed": seed}
        got = getattr(D, self.trainer)(rows, vector, **(more | self.trainer_spec))
        self.model, self.b = got if isinstance(got, tuple) else (got.atoms, None)


class ConvLayer:
    """A chain of components; `prev` feeds it another layer's output."""

    def __init__(self, components: list[Component], prev: ConvLayer | None = None):
        self.components, self.prev = components, prev

    def kernel(self, upto: int | None = None) -> Kernel:
        steps = ([self.prev.kernel()] if self.prev else []) + [c.kernel() for c in self.components[:upto]]

        def run(x: np.ndarray) -> np.ndarray:
            for step in steps:
                x = step(x)
                x = x.reshape(len(x), *([1] * (4 - x.ndim)), *x.shape[1:])
            return x

        return run

    def sample(self, images: DataFrame, n: int, seed: int = 42) -> DataFrame:
        """(draw, feature): n of the first component's features. Patches are cut from drawn places only."""
        first = self.components[0]
        if first.spec["kind"] == "patches" and not self.prev and first.spec["size"][0] == first.spec["size"][1]:
            return patch_draws(images, n, first.spec["size"][0], seed).select("draw", "feature")
        maps = map_images(images, self.kernel(1), *_others(images))
        few = location_sample(maps, n, seed=seed)
        return few.select(F.xxhash64("id", "row", "col").alias("draw"), "feature")

    def train(self, images: DataFrame, n: int, seed: int = 42) -> None:
        """Each component before the first pooler is trained on the sample as the components before it leave it."""
        rows = self.sample(images, n, seed).persist()
        try:
            for c in self.components[1:]:
                if c.role == "pool":
                    break
                if c.trainer:
                    c.train(rows, "feature", "draw", seed)
                kernel = c.kernel()
                rows = map_vectors(rows, "feature", lambda x, f=kernel: f(x[:, None, None, :])[:, 0, 0, :], "draw")
        finally:
            rows.unpersist()

    def process(self, images: DataFrame) -> DataFrame:
        """(..., feature): each image's whole output as one vector, in one stage."""
        kernel = self.kernel()
        return map_images(images, kernel, *_others(images)).select(*_others(images), F.col("data").alias("feature"))

    def sampled_output(self, images: DataFrame, n: int, seed: int = 42) -> DataFrame:
        """n feature vectors of the layer's output locations."""
        return location_sample(map_images(images, self.kernel(), "id"), n, seed=seed)

    def saved(self) -> str:
        """The layer as JSON: specs and models, nothing executable."""
        plain = lambda a: None if a is None else np.asarray(a).tolist()
        parts = [{"role": c.role, "spec": {k: plain(v) if isinstance(v, np.ndarray) else v for k, v in c.spec.items()}, "trainer": c.trainer, "trainer_spec": c.trainer_spec, "model": plain(c.model), "b": plain(c.b)} for c in self.components]
        return json.dumps({"components": parts, "prev": json.loads(self.prev.saved()) if self.prev else None})

    @staticmethod
    def loaded(text: str | dict) -> ConvLayer:
        d = json.loads(text) if isinstance(text, str) else text
        array = lambda a: None if a is None else checked_model(np.array(a, np.float64))
        parts = [Component(c["role"], c["spec"], c["trainer"], c["trainer_spec"], array(c["model"]), array(c["b"])) for c in d["components"]]
        return ConvLayer(parts, ConvLayer.loaded(d["prev"]) if d["prev"] else None)

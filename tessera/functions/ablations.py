"""A registry of ablations: code, level (image or crop) and the kernel that applies it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import kernels


@dataclass(frozen=True)
class Ablation:
    code: str
    level: str
    apply: Callable[..., np.ndarray]


REGISTRY: dict[str, Ablation] = {}


def ablation(code: str, level: str):
    """Register a kernel (image, **parameters) -> image; a new ablation needs no other change."""

    def register(f):
        if code in REGISTRY:
            raise ValueError(f"{code} is registered already")
        REGISTRY[code] = Ablation(code, level, f)
        return f

    return register


@ablation("A3", "crop")
def block_permutation(image: np.ndarray, side: int, rng: np.random.Generator) -> np.ndarray:
    return kernels.permute_blocks(image, side, rng)


@ablation("A4", "image")
def directional_blur(image: np.ndarray, theta: int, length: int) -> np.ndarray:
    return kernels.box_blur(image, theta, length)


@ablation("A5", "crop")
def spectral_slope(image: np.ndarray, alpha: float) -> np.ndarray:
    return kernels.regrade(image, alpha)

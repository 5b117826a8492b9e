"""The type of a tensor from its name, shape and values, in a worker; the rules of operators.routing.detect."""

from __future__ import annotations

import numpy as np

from loomspan.codec import tensors as T
from loomspan.operators.routing import KV_NAMES, NORM_NAMES, OPTIMIZER_NAMES, WEIGHT_NAMES

SAMPLE, MASKED = 65_536, 4096


def _sample(a: np.ndarray, most: int) -> np.ndarray:
    flat = a.ravel()
    return flat[:: max(1, -(-flat.size // most))]


def _mask(a: np.ndarray) -> bool:
    s = a.ravel()[:: max(1, a.size // MASKED)]
    values = np.unique(s)
    return len(values) == 1 or len(values) <= 4 and bool(np.isin(values, [0.0, 1.0, np.inf, -np.inf]).all())


def _gaussian(a: np.ndarray) -> bool:
    s = _sample(a, SAMPLE).astype(float)
    sd = s.std()
    if len(s) < 16 or not np.isfinite(sd) or sd <= 1e-12:
        return False
    z = (s - s.mean()) / sd
    return bool(abs((z**3).mean()) <= 0.5 and 2.0 <= (z**4).mean() <= 4.5)


def _cache_shape(shape: tuple[int, ...]) -> bool:
    return len(shape) >= 4 and any(d >= 64 for d in shape[1:]) and any(2 <= d <= 128 for d in shape[1:-1]) and shape[-1] <= 256


def detect(name: str, a: np.ndarray, ndim: int | None = None, shape: tuple[int, ...] | None = None) -> int:
    """ndim and shape: of the whole tensor, if a is a part of it."""
    low, shape = (name or "").lower(), shape or a.shape
    ndim = len(shape) if ndim is None else ndim
    has = lambda *parts: any(p in low for p in parts)
    rules = (
        (lambda: not a.size, T.UNKNOWN),
        (lambda: has(*OPTIMIZER_NAMES), T.OPTIMIZER_STATE),
        (lambda: a.dtype != np.float32, T.MIXED_PRECISION),
        (lambda: has("embed"), T.EMBEDDING),
        (lambda: ndim >= 2 and _mask(a), T.MASK),
        (lambda: has("bias"), T.BIAS),
        (lambda: ndim == 4 and has(*KV_NAMES), T.KV_CACHE),
        (lambda: has(*WEIGHT_NAMES), T.WEIGHT),
        (lambda: float((np.abs(_sample(a, SAMPLE)) < 1e-6).mean()) > 0.5, T.ACTIVATION),
        (lambda: ndim == 2 and _gaussian(a), T.WEIGHT),
        (lambda: ndim >= 4 and _cache_shape(shape), T.KV_CACHE),
        (lambda: ndim >= 4, T.ACTIVATION),
    )
    return next((kind for test, kind in rules if test()), T.UNKNOWN)


def exact(name: str, nbytes: int) -> bool:
    """Small tensors, and those of normalization layers by name, are kept as they are."""
    low = (name or "").lower()
    norm = any(p in low for p in (*NORM_NAMES, ".ln_", ".norm")) or low.startswith("ln_") or low.endswith(("norm.weight", "norm.bias"))
    return nbytes <= T.EXACT_BYTES or norm

"""Parameter rules and the 32-bit constants derived from them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Params:
    """``eps`` is narrowed to 32 bits; every constant is the 32-bit result of 32-bit arithmetic."""

    eps: float
    min_samples: int
    inv_r: float
    eps_sq: float

    @classmethod
    def of(cls, eps, min_samples) -> Params:
        eps, min_samples = float(eps), int(min_samples)
        if not eps > 0 or not math.isfinite(eps):
            raise ValueError(f"eps must be a finite number > 0, got {eps}")
        if min_samples < 1:
            raise ValueError(f"min_samples must be >= 1, got {min_samples}")
        with np.errstate(over="ignore", under="ignore"):
            narrow = np.float32(eps)
            if not narrow > 0 or not np.isfinite(narrow):
                raise ValueError(f"eps must be > 0 and finite as a float32, got {eps}")
            inverse = np.float32(math.sqrt(2.0)) / narrow
            if not np.isfinite(inverse):
                raise ValueError(f"eps is too small for float32 cells, got {eps}")
            return cls(float(narrow), min_samples, float(inverse), float(narrow * narrow))

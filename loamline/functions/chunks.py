"""Sizes of chunks and batches where arrays are written whole."""

from __future__ import annotations

import math

from loamline.session import EngineError


def chunk_sizes(shape: tuple[int, ...], target_mb: float, bytes_per_value: int) -> tuple[int, ...]:
    """Chunks with the last dimension whole and the others cut to equal sides that keep a chunk below the target size."""
    values = target_mb * 1e6 / bytes_per_value
    side = max(int((values / shape[-1]) ** (1 / max(len(shape) - 1, 1)) + 1e-9), 1)
    return (*(min(side, n) for n in shape[:-1]), shape[-1])


def images_in(memory_gb: float, image_shape: tuple[int, ...], bytes_per_value: int, variables: int = 1) -> int:
    """How many images fit in memory; at least one must."""
    n = math.floor(memory_gb * 1e9 / (math.prod(image_shape) * bytes_per_value * variables))
    if n < 1:
        raise EngineError("not even one image fits in this memory")
    return n

"""Attention rollout of tensor columns: what the first token draws from the grid of the others, through all layers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators.images import TENSOR, _arrays, _grouped, _tensors


def stretched(planes: np.ndarray, height: int, width: int) -> np.ndarray:
    """Planes (..., h, w) at another size, linear between the two nearest centres; beyond the outer ones their value holds."""

    def weights(size: int, out: int) -> np.ndarray:
        at = np.clip((np.arange(out) + 0.5) * size / out - 0.5, 0, size - 1)
        low = np.minimum(at.astype(int), max(size - 2, 0))
        found = np.zeros((out, size))
        found[np.arange(out), low] = 1 - (at - low)
        found[np.arange(out), np.minimum(low + 1, size - 1)] += at - low
        return found

    return weights(planes.shape[-2], height) @ planes @ weights(planes.shape[-1], width).T


def _weights(queries: pa.Array, keys: pa.Array, scale: pa.Array) -> pa.Array:
    out: list[np.ndarray | None] = []
    for q, k, s in zip(_arrays(queries), _arrays(keys), scale.to_pylist()):
        if q is None or k is None:
            out.append(None)
            continue
        if q.ndim != 3 or q.shape != k.shape:
            raise ValueError(f"queries of shape {q.shape} and keys of shape {k.shape}")
        z = (q * (q.shape[2] ** -0.5 if s is None else s)) @ k.transpose(0, 2, 1)
        e = np.exp(z - z.max(-1, keepdims=True))
        out.append((e / e.sum(-1, keepdims=True)).mean(0))
    return _tensors(out)


def weights(queries: Column, keys: Column, scale: Column | None = None) -> Column:
    """(tokens, tokens) weights of a layer, the mean of its heads, from (heads, tokens, width) queries and keys; scale: width ** -0.5 if null."""
    return F.arrow_udf(_weights, TENSOR)(queries, keys, F.lit(None).cast("double") if scale is None else scale)


def _rolled(layers: pa.Array, prefix: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
    x = _arrays(layers)
    settings = list(zip(prefix.to_pylist(), height.to_pylist(), width.to_pylist()))
    out: list[np.ndarray | None] = [None] * len(x)
    for (shape, (first, h, w)), rows in _grouped([None if a is None else (a.shape, s) for a, s in zip(x, settings)]):
        side = math.isqrt(max(shape[-1] - first, 0))
        if len(shape) != 3 or shape[1] != shape[2] or side * side != shape[-1] - first or not side or not shape[0]:
            raise ValueError(f"layers of shape {shape} are no stack of square maps with a square grid behind {first} tokens")
        block = np.stack([x[i] for i in rows]) + np.eye(shape[1])
        block /= block.sum(-1, keepdims=True)
        joint = block[:, 0]
        for layer in range(1, shape[0]):
            joint = block[:, layer] @ joint
        heat = stretched(joint[:, 0, first:].reshape(-1, side, side), h, w)
        low = heat.min((1, 2), keepdims=True)
        heat = (heat - low) / np.maximum(heat.max((1, 2), keepdims=True) - low, np.finfo(np.float32).eps)
        for i, d in zip(rows, heat):
            out[i] = d[None]
    return _tensors(out)


def rollout(layers: Column, height: int, width: int, prefix: int = 1) -> Column:
    """(1, height, width) map from 0 to 1 of (depth, tokens, tokens) weights; null for null.

    Every layer gets the identity added and its rows brought to 1, and the layers
    are multiplied in order, for all rows of a batch at once. Tokens behind the
    first `prefix` must make up a square grid; a flat map is all zero.
    """
    return F.arrow_udf(_rolled, TENSOR)(layers, F.lit(prefix), F.lit(height), F.lit(width))

"""Images as tensor columns: decoding, spectral, Fourier and resampling changes, resizing, and their cache.

A tensor is a struct of its shape (channels, height, width) and its flat values, row by
row. Functions take and give whole Arrow batches; rows of one shape and one
setting are computed together as one array.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

TENSOR = StructType([StructField("shape", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType()))])
_SHAPE, _VALUES = pa.list_(pa.int32()), pa.list_(pa.float64())
# Channel means and deviations of the usual natural-image normalisation.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
GREY = (19595, 38470, 7471)  # 65536ths of red, green and blue in grey
SHARPNESS = -0.5  # of the bicubic kernel


def _arrays(tensors: pa.StructArray) -> list[np.ndarray | None]:
    shapes, values = tensors.field("shape").to_pylist(), tensors.field("values")
    flat = values.values.to_numpy(zero_copy_only=False)
    ends = values.offsets.to_numpy()
    valid = np.asarray(tensors.is_valid()) & np.asarray(values.is_valid())
    return [flat[a:b].reshape(s) if ok and s is not None else None for a, b, s, ok in zip(ends, ends[1:], shapes, valid)]


def _tensors(arrays: list[np.ndarray | None]) -> pa.StructArray:
    shapes = pa.array([None if a is None else list(a.shape) for a in arrays], _SHAPE)
    offsets = np.cumsum([0, *(0 if a is None else a.size for a in arrays)])
    flat = np.concatenate([a.ravel() for a in arrays if a is not None] or [np.zeros(0)])
    nil = np.array([a is None for a in arrays], bool)
    values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(nil, False)), pa.array(flat, pa.float64()))
    return pa.StructArray.from_arrays([shapes, values], ["shape", "values"], mask=pa.array(nil))


def _grouped(keys: list) -> Iterator[tuple[object, list[int]]]:
    """Rows by equal key; rows of key None are left out."""
    by: dict[object, list[int]] = {}
    for i, key in enumerate(keys):
        if key is not None:
            by.setdefault(key, []).append(i)
    yield from by.items()


AT_ONCE = 256  # tensors that a worker computes and passes on at once


def _sliced(f: Callable[..., pa.Array], one: bool = True) -> Callable:
    """f of one or of several columns in slices, passed on one by one: a worker holds a batch of inputs and never one of large outputs."""

    def single(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                yield f(batch.slice(at, AT_ONCE))

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch[0]), AT_ONCE):
                yield f(*[c.slice(at, AT_ONCE) for c in batch])

    return single if one else several


def cubic(x: np.ndarray) -> np.ndarray:
    """Bicubic kernel."""
    x, a = np.abs(x), SHARPNESS
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = (((x - 5) * x + 8) * x - 4) * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def lanczos(x: np.ndarray) -> np.ndarray:
    """Windowed sine of three lobes."""
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def linear(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0.0)


SHAPES = {cubic: 2, lanczos: 3, linear: 1}  # half widths


@lru_cache(maxsize=256)
def kernel(size: int, out: int, shape: Callable[[np.ndarray], np.ndarray] = cubic) -> np.ndarray:
    """Weights (out, size) of a resampling whose kernel widens with the step, so that nothing is skipped when it shrinks."""
    step = size / out
    widened = max(step, 1.0)
    centre = (np.arange(out) + 0.5)[:, None] * step
    places = np.arange(size)[None, :]
    first = np.maximum(np.floor(centre - SHAPES[shape] * widened + 0.5), 0)
    last = np.minimum(np.floor(centre + SHAPES[shape] * widened + 0.5), size)
    weights = np.where((places >= first) & (places < last), shape((places + 0.5 - centre) / widened), 0.0)
    return weights / weights.sum(1, keepdims=True)


def resampled(x: np.ndarray, height: int, width: int, shape: Callable[[np.ndarray], np.ndarray] = cubic) -> np.ndarray:
    """Planes (..., h, w) at another size, one axis after the other."""
    return kernel(x.shape[-2], height, shape) @ x @ kernel(x.shape[-1], width, shape).T


def mixed(source: np.ndarray, donor: np.ndarray, share: float) -> np.ndarray:
    """Planes with the source's phases and amplitudes mixed with the donor's by share, held within 0 and 1."""
    one, two = np.fft.fft2(source), np.fft.fft2(donor)
    amplitude = (1 - share) * np.abs(one) + share * np.abs(two)
    return np.clip(np.fft.ifft2(amplitude * np.exp(1j * np.angle(one))).real, 0.0, 1.0)


def _intervened(source: pa.Array, donor: pa.Array, family: pa.Array, strength: pa.Array, gains: pa.Array) -> pa.Array:
    x, y = _arrays(source), _arrays(donor)
    families, strengths, gained = family.to_pylist(), strength.to_pylist(), gains.to_pylist()
    for a, f, b in zip(x, families, y):
        if a is not None and (a.ndim != 3 or f == "mix" and (b is None or b.shape != a.shape) or f not in ("gain", "mix", "resolution")):
            raise ValueError(f"{f} of a tensor of shape {a.shape} with a donor of shape {None if b is None else b.shape}")
    out: list[np.ndarray | None] = [None] * len(x)
    for (f, s, shape), rows in _grouped([None if a is None else (f, s, a.shape) for a, f, s in zip(x, families, strengths)]):
        block = np.stack([x[i] for i in rows])
        if f == "gain":
            done = np.clip(block * np.array([gained[i] for i in rows], float)[:, :, None, None], 0, 1)
        elif f == "mix":
            done = mixed(block, np.stack([y[i] for i in rows]), s)
        else:
            done = np.clip(resampled(resampled(block, int(s), int(s)), *shape[1:]), 0, 1)
        for i, d in zip(rows, done):
            out[i] = d
    return _tensors(out)


def intervene(source: Column, donor: Column, family: Column, strength: Column, gains: Column) -> Column:
    """The tensor after a change of a family, held within 0 and 1; null for a null source.

    gain: each channel times its element of gains. mix: amplitudes of the planes'
    Fourier transforms mixed with the donor's by strength. resolution: down to
    strength x strength and back, bicubic without aliasing. A donor of another
    shape, a tensor without three dimensions and another family are errors.
    """
    return F.arrow_udf(_sliced(_intervened, False), TENSOR)(source, donor, family, strength.cast("double"), gains)


def _resized(tensors: pa.Array, size: pa.Array) -> pa.Array:
    x, sizes = _arrays(tensors), size.to_pylist()
    out: list[np.ndarray | None] = [None] * len(x)
    for (shape, s), rows in _grouped([None if a is None or s is None else (a.shape, s) for a, s in zip(x, sizes)]):
        for i, d in zip(rows, resampled(np.stack([x[i] for i in rows]), s, s)):
            out[i] = d
    return _tensors(out)


def resize(tensor: Column, size: int | Column) -> Column:
    """The tensor at size x size, bicubic without aliasing."""
    return F.arrow_udf(_sliced(_resized, False), TENSOR)(tensor, F.lit(size) if isinstance(size, int) else size)


def normalise(tensor: Column, mean: tuple[float, ...] = MEAN, deviation: tuple[float, ...] = DEVIATION) -> Column:
    """Each channel less its mean, by its deviation; a tensor of other channels is an error."""
    return F.arrow_udf(_sliced(lambda tensors: _normalised(tensors, mean, deviation)), TENSOR)(tensor)


def preprocessed(tensor: Column, size: int, mean: tuple[float, ...] = MEAN, deviation: tuple[float, ...] = DEVIATION) -> Column:
    """normalise of resize in one pass, so that no batch of resized tensors goes from worker to worker."""
    return F.arrow_udf(_sliced(lambda tensors: _normalised(_resized(tensors, pa.array([size] * len(tensors))), mean, deviation)), TENSOR)(tensor)


def _normalised(tensors: pa.Array, mean: tuple[float, ...], deviation: tuple[float, ...]) -> pa.Array:
    means, sds = (np.array(v)[:, None, None] for v in (mean, deviation))
    return _tensors([None if a is None else (a - means) / sds if len(a) == len(means) else _refused(a) for a in _arrays(tensors)])


def _refused(a: np.ndarray) -> np.ndarray:
    raise ValueError(f"a tensor of shape {a.shape} has other channels")


# --- decoding ----------------------------------------------------------------------------------------------


def unpredicted(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of image lines from their filtered form, of which the first byte names the filter."""
    kinds, out = lines[:, 0], lines[:, 1:].astype(np.int64)
    width = out.shape[1]
    above = np.zeros(width, np.int64)
    for y, kind in enumerate(kinds.tolist()):
        line = out[y]
        if kind == 1:  # the byte before, pixel by pixel
            line[:] = line.reshape(-1, step).cumsum(0).ravel()
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            for i in range(width):
                left = line[i - step] if i >= step else 0
                if kind == 3:
                    line[i] += (left + above[i]) >> 1
                else:
                    up, corner = above[i], above[i - step] if i >= step else 0
                    far = [(abs(up - corner), left), (abs(left - corner), up), (abs(left + up - 2 * corner), corner)]
                    line[i] += min(far, key=lambda p: p[0])[1]
                line[i] &= 255
        elif kind:
            raise ValueError(f"unknown filter {kind}")
        line &= 255
        above = line
    return out.astype(np.uint8)


def decode_png(content: bytes) -> np.ndarray:
    """(3, height, width) from 0 to 1 of a PNG file with 8-bit colour, without palette and interlace; anything else is a ValueError."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, head, data, ended = 8, None, [], False
    while at + 12 <= len(content) and not ended:
        size, name = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or content[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(name + body)):
            raise ValueError(f"chunk {name!r} is cut or changed")
        head = struct.unpack(">IIBBBBB", body) if name == b"IHDR" else head
        data += [body] if name == b"IDAT" else []
        ended, at = name == b"IEND", at + 12 + size
    if head is None or not ended:
        raise ValueError("the file is cut")
    width, height, depth, colour, _, _, interlace = head
    if (depth, interlace) != (8, 0) or colour not in (2, 6):
        raise ValueError("not 8-bit RGB")
    step = 3 if colour == 2 else 4
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError("the pixels are cut or changed") from e
    if len(raw) != height * (width * step + 1):
        raise ValueError("the pixels do not fill the image")
    lines = unpredicted(np.frombuffer(raw, np.uint8).reshape(height, -1), step)
    return lines.reshape(height, width, step)[:, :, :3].transpose(2, 0, 1) / 255.0


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG file of (3, height, width) values from 0 to 1, in 8 bits."""
    lines = np.floor(np.clip(pixels, 0, 1) * 255 + 0.5).astype(np.uint8).transpose(1, 2, 0)
    raw = np.hstack([np.zeros((len(lines), 1), np.uint8), lines.reshape(len(lines), -1)]).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", pixels.shape[2], pixels.shape[1], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _decoded(contents: pa.Array, paths: pa.Array) -> pa.Array:
    out: list[np.ndarray | None] = []
    for content, path in zip(contents.to_pylist(), paths.to_pylist()):
        try:
            out.append(None if content is None else decode_png(content))
        except ValueError as e:
            raise ValueError(f"{path}: {e}") from e
    return _tensors(out)


def decoded(files: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """files (path, content, ...) with image, a tensor; with digests (path, sha256) first held against them.

    A file that is not listed, whose digest differs, or that is no whole PNG with
    8-bit colour is an error that names it.
    """
    if digests is not None:
        told = files.join(digests.select("path", F.col("sha256").alias("_told")), "path", "left")
        wrong = F.raise_error(F.concat(F.lit("digest of "), "path")).cast("binary")
        files = told.withColumn("content", F.when(F.sha2("content", 256).eqNullSafe(F.col("_told")), F.col("content")).otherwise(wrong)).drop("_told")
    return files.withColumn("image", F.arrow_udf(_sliced(_decoded, False), TENSOR)("content", "path"))


def _encoded(tensors: pa.Array) -> pa.Array:
    return pa.array([None if a is None else encode_png(a) for a in _arrays(tensors)], pa.binary())


def encoded(tensor: Column) -> Column:
    """The tensor as a PNG file."""
    return F.arrow_udf(_encoded, BinaryType())(tensor)


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array.astype(np.float32), allow_pickle=False)
    return out.getvalue()


def _npy(tensors: pa.Array) -> pa.Array:
    return pa.array([None if a is None else npy(a) for a in _arrays(tensors)], pa.binary())


def payload(tensor: Column) -> Column:
    """The tensor as an NPY file of 32-bit floats."""
    return F.arrow_udf(_npy, BinaryType())(tensor)


def _fixed_point(size: int, out: int) -> np.ndarray:
    """Weights as whole numbers of 2 ** -22, halves away from zero."""
    w = kernel(size, out, lanczos) * 2.0**22
    return np.trunc(w + np.copysign(0.5, w)).astype(np.int64)


def _in_bytes(sums: np.ndarray) -> np.ndarray:
    return np.clip((sums + (1 << 21)) >> 22, 0, 255)


def _difference_hash(tensors: pa.Array) -> pa.Array:
    out = []
    for a in _arrays(tensors):
        if a is None:
            out.append(None)
            continue
        whole = np.floor(np.clip(a, 0, 1) * 255 + 0.5).astype(np.int64)
        grey = (np.tensordot(GREY, whole, 1) + 32768) >> 16
        wide = _in_bytes(grey @ _fixed_point(a.shape[2], 9).T)
        small = _in_bytes(_fixed_point(a.shape[1], 8) @ wide)
        out.append(int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1], axis=None).tobytes(), "big", signed=True))
    return pa.array(out, pa.int64())


def difference_hash(tensor: Column) -> Column:
    """64 bits of an RGB tensor: whether each of 8 x 9 grey values (whole numbers up to 255) exceeds the one before it in its row."""
    return F.arrow_udf(_difference_hash, "long")(tensor)


def from_vector(values: Column, channels: int, height: int, width: int) -> Column:
    """A flat array as a tensor."""
    return F.struct(F.array(*map(F.lit, (channels, height, width))).cast("array<int>").alias("shape"), values.cast("array<double>").alias("values"))

"""The boundary to models: embeddings, captions, faces and perceptual hashes are functions that the caller supplies.

Each takes a batch at a time. The stand-ins here are deterministic and need no model; they are for tests and for wiring.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_embedding(text: Column, embed: Callable[[list[str]], np.ndarray]) -> Column:
    """array<float> of each text by embed, null for null."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        known = values.notna()
        out = pd.Series([None] * len(values), index=values.index, dtype=object)
        if known.any():
            for i, v in zip(values.index[known], embed(values[known].tolist()), strict=True):
                out[i] = np.asarray(v, dtype=np.float32).tolist()
        return out

    return run(text)


def to_text(content: Column, read: Callable[[bytes], str | None]) -> Column:
    """Text of each binary by read (text recognition, transcripts)."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else read(v))

    return run(content)


def faces(df: DataFrame, key: str, content: str, find: Callable[[bytes], list[tuple[list[int], list[float]]]]) -> DataFrame:
    """key, bounding_box, encoding: none to many rows an image."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, box, v) for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if raw is not None for box, v in find(raw)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.float32()))], ["key", "bounding_box", "encoding"])

    return df.select(F.col(key).alias("key"), content).mapInArrow(run, f"key {kind}, bounding_box array<int>, encoding array<float>").withColumnRenamed("key", key)


def image_embedding(content: Column, embed: Callable[[list[bytes]], np.ndarray]) -> Column:
    """array<float> of each image by embed, null for null."""
    return text_embedding(content, embed)


def exif(content: Column, read: Callable[[bytes], dict[str, str] | None]) -> Column:
    """map<string,string> of each image's EXIF entries by read; null for null and where it finds none."""

    @F.pandas_udf("map<string,string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: (None if v is None else read(v)) or None)

    return run(content)


def exif_columns(entries: Column) -> dict[str, Column]:
    """Columns of media from EXIF entries by their usual names: camera, size, time (local, without a zone), place in degrees."""

    def degrees(name: str) -> Column:
        parts = F.transform(F.split(entries[name], r"[,\s]+"), lambda x: x.try_cast("double"))
        plain = F.get(parts, F.lit(0)) + F.coalesce(F.get(parts, F.lit(1)), F.lit(0.0)) / 60 + F.coalesce(F.get(parts, F.lit(2)), F.lit(0.0)) / 3600
        return F.when(F.upper(entries[f"{name}Ref"]).isin("S", "W"), -plain).otherwise(plain)

    at = F.try_to_timestamp(entries["DateTimeOriginal"], F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")
    size = {c: entries[n].try_cast("int") for c, n in (("width", "PixelXDimension"), ("height", "PixelYDimension"))}
    return {"camera_make": F.nullif(F.trim(entries["Make"]), F.lit("")), "camera_model": F.nullif(F.trim(entries["Model"]), F.lit("")), **size, "occurred_at": at, "latitude": degrees("GPSLatitude"), "longitude": degrees("GPSLongitude")}


def _small(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means of rows x columns equal parts; a side that is too short is repeated."""
    for axis, parts in ((0, rows), (1, columns)):
        cuts = np.linspace(0, image.shape[axis], parts + 1)
        low = np.minimum(cuts[:-1].astype(int), image.shape[axis] - 1)
        high = np.maximum(cuts[1:].astype(int), low + 1)
        sums = np.concatenate([np.zeros_like(image.take([0], axis), dtype=np.float64), np.cumsum(image, axis=axis, dtype=np.float64)], axis=axis)
        shape = [1, 1]
        shape[axis] = parts
        image = (sums.take(high, axis) - sums.take(low, axis)) / (high - low).reshape(shape)
    return image


def _bits(found: np.ndarray) -> int:
    return int(np.packbits(found.reshape(-1)).view(">i8")[0])


def _by_image(content: Column, grey: Callable[[bytes], np.ndarray | None], bits: Callable[[np.ndarray], int]) -> Column:
    def one(raw: bytes | None) -> int | None:
        image = None if raw is None else grey(raw)
        return None if image is None or min(image.shape) < 1 else bits(np.asarray(image, dtype=np.float64))

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one).astype("Int64")

    return run(content)


def perceptual_hash(content: Column, grey: Callable[[bytes], np.ndarray | None]) -> Column:
    """64-bit perceptual hash of each image: of the 8 x 8 lowest frequencies (cosine transform of a 32 x 32 picture), which lie above their median.

    grey gives a matrix of brightness, or null where it can't read one.
    """
    waves = np.cos(np.pi / 32 * (np.arange(32) + 0.5)[None, :] * np.arange(8)[:, None])

    def bits(image: np.ndarray) -> int:
        low = np.round(waves @ _small(image, 32, 32) @ waves.T, 6)
        return _bits(low > np.median(low.reshape(-1)[1:]))

    return _by_image(content, grey, bits)


def difference_hash(content: Column, grey: Callable[[bytes], np.ndarray | None]) -> Column:
    """64-bit difference hash of each image: where brightness grows from left to right."""
    return _by_image(content, grey, lambda image: _bits(np.diff(_small(image, 8, 9), axis=1) > 0))


def stub_embedding(texts: list[str], size: int = 64) -> np.ndarray:
    """Unit vectors that depend on the text alone."""
    out = np.stack([np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).normal(size=size) for t in texts])
    return out / np.linalg.norm(out, axis=1, keepdims=True)

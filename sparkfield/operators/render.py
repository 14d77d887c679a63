"""Colour maps as columns, and frames as bitmap files."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

HEIGHT, VELOCITY, RGB = "height", "velocity", "rgb"


def _byte(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)).cast("int")


def screen_colors(height: Column, vx: Column, vy: Column, mode: str, scale: float) -> dict[str, Column]:
    """Colours for display: height red above and blue below zero; speed gray; or all three around the middle."""
    zero = F.lit(0)
    if mode == HEIGHT:
        v = height * scale
        return {"r": F.when(v > 0, _byte(v * 255)).otherwise(zero), "g": zero, "b": F.when(v > 0, zero).otherwise(_byte(-v * 255))}
    if mode == VELOCITY:
        gray = _byte(F.sqrt(vx * vx + vy * vy) * scale * 255)
        return {"r": gray, "g": gray, "b": gray}
    if mode == RGB:
        return {c: _byte(127.5 + v * scale * 127.5) for c, v in (("r", vx), ("g", vy), ("b", height))}
    raise ValueError(f"unknown mode {mode!r}")


def image_colors(height: Column, vx: Column, vy: Column, mode: str, scale: float) -> dict[str, Column]:
    """Colours for images: truncated to whole numbers, height's signs the other way round."""
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v.cast("int")))
    centred = lambda v, s: clamp(v * s + 127.5)
    zero = F.lit(0)
    if mode == HEIGHT:
        return {"r": F.when(height < 0, clamp(-height * scale)).otherwise(zero), "g": zero, "b": F.when(height < 0, zero).otherwise(clamp(height * scale))}
    if mode == VELOCITY:
        gray = clamp(F.sqrt(vx * vx + vy * vy) * (scale * 2))
        return {"r": gray, "g": gray, "b": gray}
    if mode == RGB:
        return {"b": centred(height, scale), "g": centred(vy, scale * 2), "r": centred(vx, scale * 2)}
    raise ValueError(f"unknown mode {mode!r}")


def with_barriers(df: DataFrame, on_barrier: Column) -> DataFrame:
    """White where a barrier lies."""
    return df.withColumns({c: F.when(on_barrier, F.lit(255)).otherwise(F.col(c)) for c in "rgb"})


def bmp_bytes(rgb: np.ndarray) -> bytes:
    """A 24-bit bitmap of an (height, width, 3) array, first row at the bottom."""
    h, w, _ = rgb.shape
    row = (w * 3 + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * 3] = rgb[:, :, ::-1].reshape(h, w * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + h * row, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, h * row, 2835, 2835, 0, 0) + body.tobytes()


def frames_to_bmp(pixels: DataFrame, by: list[str], region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """One row (by..., bytes) per frame of ``pixels(by..., i, j, r, g, b)``; i runs right and j up.

    ``region`` (i0, j0, i1, j1), ends excluded, crops the frame.
    """
    if region:
        i0, j0, i1, j1 = region
        pixels = pixels.where((F.col("i") >= i0) & (F.col("i") < i1) & (F.col("j") >= j0) & (F.col("j") < j1)).withColumns({"i": F.col("i") - i0, "j": F.col("j") - j0})
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", bytes binary"

    def encode(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rgb = np.zeros((int(pdf.j.max()) + 1, int(pdf.i.max()) + 1, 3), np.uint8)
        for c, name in enumerate("rgb"):
            rgb[pdf.j, pdf.i, c] = pdf[name]
        return pd.DataFrame([[*key, bmp_bytes(rgb)]], columns=[*by, "bytes"])

    return pixels.groupBy(*by).applyInPandas(encode, schema)

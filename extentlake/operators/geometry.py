"""Points and meshes: index checks, exports, drawing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def face_faults(faces: DataFrame, points: DataFrame) -> DataFrame:
    """Faces (mesh, face, a, b, c) that name a point (mesh, index) the mesh lacks, or one point twice."""
    corners = faces.select("mesh", "face", F.explode(F.array("a", "b", "c")).alias("index"))
    lacking = corners.join(points.select("mesh", "index").distinct(), ["mesh", "index"], "left_anti").select("mesh", "face", F.lit("INDEX_OUT_OF_RANGE").alias("fault"))
    flat = faces.where("a = b OR b = c OR a = c").select("mesh", "face", F.lit("DEGENERATE").alias("fault"))
    return lacking.union(flat).distinct()


def coordinate_text(value: str) -> Column:
    """A coordinate as the shortest decimal that gives it back; what isn't finite has no text."""
    v = F.col(value)
    return F.when(F.isnan(v) | v.isin(float("inf"), float("-inf")), None).otherwise(v.cast("string"))


def obj_lines(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh, section, number, line) of OBJ text: points from 1, then faces; sorted by the caller when written."""
    v = points.select("mesh", F.lit(0).alias("section"), F.col("index").alias("number"), F.concat_ws(" ", F.lit("v"), coordinate_text("x"), coordinate_text("y"), coordinate_text("z")).alias("line"))
    f = faces.select("mesh", F.lit(1).alias("section"), F.col("face").alias("number"), F.concat_ws(" ", F.lit("f"), F.col("a") + 1, F.col("b") + 1, F.col("c") + 1).alias("line"))
    return v.union(f)


def shaded(faces: DataFrame, light: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """Faces (ax .. cz) with the cosine of their normal to the light, 0 where they have no area."""
    e = lambda p, q, k: F.col(f"{q}{k}") - F.col(f"{p}{k}")
    n = [e("a", "b", y) * e("a", "c", z) - e("a", "b", z) * e("a", "c", y) for y, z in (("y", "z"), ("z", "x"), ("x", "y"))]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    dot = n[0] * light[0] + n[1] * light[1] + n[2] * light[2]
    return faces.withColumn("shade", F.when(size > 0, F.abs(dot / size)).otherwise(0.0))


def ramp(value: Column, low: float, high: float) -> Column:
    """A colour from blue over green to red as 0xRRGGBB."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low if high > low else 1.0)))
    red, green = F.round(255 * F.greatest(F.lit(0.0), 2 * t - 1)), F.round(255 * (1 - F.abs(2 * t - 1)))
    blue = F.round(255 * F.greatest(F.lit(0.0), 1 - 2 * t))
    return (red * 65536 + green * 256 + blue).cast("long")


def png_rows(pixels: DataFrame, width: int) -> DataFrame:
    """(y, row): each line of an image from pixels (x, y, rgb) as filtered bytes; lines are built apart from one another."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        line = bytearray(1 + 3 * width)
        for x, rgb in zip(group.x, group.rgb, strict=True):
            if 0 <= x < width:
                line[1 + 3 * int(x) : 4 + 3 * int(x)] = int(rgb).to_bytes(3, "big")
        return pd.DataFrame({"y": [key[0]], "row": [bytes(line)]})

    return pixels.select("x", "y", "rgb").groupBy("y").applyInPandas(run, "y long, row binary")


def png(rows: Iterator[tuple[int, bytes]], width: int, height: int) -> bytes:
    """A PNG from its lines in order, those that lack black; the picture's size bounds what is held."""

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = dict(rows)
    packed = zlib.compress(b"".join(lines.get(y, bytes(1 + 3 * width)) for y in range(height)))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", packed) + part(b"IEND", b"")

"""Page location by thumbnails, and pixel operators on arrays that need numpy only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _centred(values: Column) -> Column:
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return F.transform(values, lambda x: x - mean)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def correlation(a: Column | str, b: Column | str, flat: float = 0.0) -> Column:
    """Pearson correlation of two arrays; ``flat`` where one is flat."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    a, b = _centred(a), _centred(b)
    norm = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.when(norm == 0, flat).otherwise(_dot(a, b) / norm)


def locate(pages: DataFrame, target: DataFrame, id_col: str, top_k: int = 10, thumb: str = "thumb", edges: str | None = None, digits: int | None = None, flat: float = 0.0) -> DataFrame:
    """The top_k pages most like the target (one row, column ``target``, and ``target_edges`` where
    edges are given): .7 thumbnail + .3 edge correlation, or the thumbnail alone. With ``digits``
    scores are rounded before they rank, so pages that look alike to so many digits go by id."""
    rows = pages.join(F.broadcast(target.limit(1)))
    image = correlation(thumb, "target", flat)
    edge = correlation(edges, "target_edges", flat) if edges else image
    rows = rows.withColumns({"image_score": image, "edge_score": edge})
    rows = rows.withColumn("score", 0.7 * F.col("image_score") + 0.3 * F.col("edge_score") if edges else F.col("image_score"))
    if digits is not None:
        rows = rows.withColumns({c: F.round(c, digits) for c in ("score", "image_score", "edge_score")})
    return rows.select(id_col, "score", "image_score", "edge_score").orderBy(F.desc("score"), F.desc("image_score"), F.desc("edge_score"), id_col).limit(top_k)


def red_gray(bgr: np.ndarray) -> np.ndarray:
    """The red channel as gray: red stamps turn white."""
    return bgr[..., 2]


def suppress_red(bgr: np.ndarray, least: int = 80, lead: int = 35, dark: int = 90) -> np.ndarray:
    """White where red leads both other channels, except where the pixel is dark (text)."""
    x = bgr.astype(np.int16)
    b, g, r = x[..., 0], x[..., 1], x[..., 2]
    red = (r >= least) & (r - g >= lead) & (r - b >= lead) & ~((r < dark) & (g < dark) & (b < dark))
    out = bgr.copy()
    out[red] = 255
    return out


def thumbnail(gray: np.ndarray, size: int = 64) -> np.ndarray:
    """Box means on a size x size grid, z-scored (zeros where flat)."""
    rows = np.array_split(np.arange(gray.shape[0]), size)
    cols = np.array_split(np.arange(gray.shape[1]), size)
    small = np.array([[gray[np.ix_(r, c)].mean() if len(r) and len(c) else 0.0 for c in cols] for r in rows])
    spread = small.std()
    return (small - small.mean()) / spread if spread > 0 else np.zeros_like(small)

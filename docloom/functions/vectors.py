"""Vector and box arithmetic as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def l2_normalize(a) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(_col(a), lambda x: x.cast("double") / n)).otherwise(F.transform(_col(a), lambda x: x.cast("double")))


def char_bucket_embedding(text, dim: int) -> Column:
    """Counts of characters by code point modulo dim, normalised; null and empty texts give the first unit vector.

    One pass over the text in Arrow batches, whatever dim is.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([_buckets(t, dim) for t in texts])

    return embed(_col(text))


def _buckets(text: str | None, dim: int) -> np.ndarray:
    codes = np.frombuffer((text or "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = np.bincount(codes % dim, minlength=dim).astype(np.float64)
    return counts / np.sqrt((counts * counts).sum())


def bbox_iou(a, b) -> Column:
    """Intersection over union of boxes [x0, y0, x1, y1]; 0 where either is degenerate or missing."""
    a, b = _col(a), _col(b)
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    inter = side(0) * side(1)
    return F.when(inter > 0, inter / (area(a) + area(b) - inter)).otherwise(F.lit(0.0))


def bbox_clamp(box, width, height, least: float = 4.0) -> Column:
    """The box cut to its page; null if less than `least` points of either side remain."""
    box, width, height = _col(box), _col(width), _col(height)
    cut = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    x0, y0, x1, y1 = cut(box[0], width), cut(box[1], height), cut(box[2], width), cut(box[3], height)
    return F.when((x1 - x0 >= least) & (y1 - y0 >= least), F.array(x0, y0, x1, y1))


def bbox_rotate(box, angle, width, height) -> Column:
    """A box found on a page turned by angle (0, 90, 180, 270) back on the page as it was, of the given width and height."""
    b, angle, w, h = _col(box), _col(angle), _col(width), _col(height)
    return (
        F.when(angle == 90, F.array(w - b[3], b[0], w - b[1], b[2]))
        .when(angle == 180, F.array(w - b[2], h - b[3], w - b[0], h - b[1]))
        .when(angle == 270, F.array(b[1], h - b[2], b[3], h - b[0]))
        .otherwise(b)
    )

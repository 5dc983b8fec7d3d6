"""Scalar expressions on columns: labels, bands, intervals, geometry. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that stand for no team; every other label is one. Fixed values.
NO_TEAM = ("", "unknown", "none", "contested")
WILSON_Z = 1.96


def is_team(team: Column) -> Column:
    """Whether a label names a team; a null label doesn't."""
    return F.coalesce(~team.isin(*NO_TEAM), F.lit(False))


def band(confidence: Column) -> Column:
    """high from 0.70, probable from 0.45, else uncertain."""
    return F.when(confidence >= 0.70, "high").when(confidence >= 0.45, "probable").otherwise("uncertain")


def size_bucket(area: Column) -> Column:
    """Object size classes below 150, 400 and 2000 square pixels."""
    return F.when(area < 150, "tiny").when(area < 400, "small").when(area < 2000, "medium").otherwise("large")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; null where the whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def wilson(successes: Column, total: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Lower and upper Wilson score bounds, clamped to [0, 1]; both 0 without trials."""
    n, p = total.cast("double"), successes / total.cast("double")
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    none = total == 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), mid + half))


def project(h: list[Column] | list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a row-major 3x3 homography; null where it goes to infinity."""
    w = h[6] * x + h[7] * y + h[8]
    safe = F.when(F.abs(w) > 1e-8, w)
    return (h[0] * x + h[1] * y + h[2]) / safe, (h[3] * x + h[4] * y + h[5]) / safe


def invert(h: list[Column]) -> list[Column]:
    """Row-major inverse of a 3x3 matrix by its cofactors; every entry null for a singular one."""
    minor = lambda a, b, c, d: h[a] * h[d] - h[b] * h[c]
    cofactors = [minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5), -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5), minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4)]
    det = h[0] * cofactors[0] + h[1] * cofactors[3] + h[2] * cofactors[6]
    return [F.when(det != 0, c / det) for c in cofactors]


def homography_distance(a: list[Column], b: list[Column], width: float, height: float) -> Column:
    """Mean distance between where two homographies map twelve probes of the lower image; infinite if they map none.

    Probes lie at 4 places from 0.1 to 0.9 of the width and 3 from 0.55 to 0.95 of the height, fixed values.
    """
    gaps = []
    for j in range(3):
        for i in range(4):
            x, y = F.lit(width * (0.1 + 0.8 * i / 3)), F.lit(height * (0.55 + 0.2 * j))
            (ax, ay), (bx, by) = project(a, x, y), project(b, x, y)
            gaps.append(F.hypot(ax - bx, ay - by))
    known = F.array_compact(F.array(*gaps))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known)).otherwise(float("inf"))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two corner boxes; 0 where the union is empty."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda q: F.greatest(F.lit(0.0), q[2] - q[0]) * F.greatest(F.lit(0.0), q[3] - q[1])
    union = area(a) + area(b) - width * height
    return F.when(union > 0, width * height / union).otherwise(0.0)


def zone(x: Column, y: Column, length: float = 105.0, width: float = 68.0, margin: float = 2.0) -> Column:
    """Third by channel of the pitch, row-major 0..8; null when further than `margin` outside."""
    inside = x.between(-margin, length + margin) & y.between(-margin, width + margin)
    cut = lambda v, size: F.least(F.lit(2), F.greatest(F.lit(0), F.floor(v / (size / 3)))).cast("int")
    return F.when(inside, cut(y, width) * 3 + cut(x, length))


def hash_fraction(*keys: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the SHA-256 of the keys joined by '/'."""
    return F.conv(F.substring(F.sha2(F.concat_ws("/", *keys), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def distance(dx: Column, dy: Column) -> Column:
    """Root of the sum of squares, as SQL writes it; hypot rounds otherwise, which shows where a distance meets a threshold."""
    return F.sqrt(dx * dx + dy * dy)


def _dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    """Length of an array as a vector."""
    return F.sqrt(_dot(a, a))


def cosine_of(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """cosine() of arrays whose norm() is known."""
    return F.when(norm_a * norm_b > 0, _dot(a, b) / (norm_a * norm_b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null where either is zero."""
    return cosine_of(a, b, norm(a), norm(b))

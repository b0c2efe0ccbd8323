"""Weighted polynomial fits from moments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A determinant below this share of what it would be without cancellation is rounding noise.
_NOISE = 1e-14


def fit(powers: list[Column], products: list[Column], degree: int, at: Column) -> Column:
    """The least-squares polynomial in u, read at ``at``, from powers[k] = sum w u^k and products[k] = sum w u^k y.

    With t = u - mean u the normal equations of y = a + b t + c (t^2 - mean t^2) part into a = mean y and a system of the
    central moments for b and c, solved by Cramer's rule. Samples whose u don't determine a degree get the degree below.
    Null without weight."""
    total = powers[0]
    raw = [p / total for p in powers]
    mean_y = products[0] / total
    if degree == 0:
        return F.when(total > 0, mean_y)
    centre = raw[1]
    t = at - centre
    var = raw[2] - centre * centre
    cov = products[1] / total - centre * mean_y
    line = mean_y + t * cov / var
    best = line
    if degree == 2:
        third = raw[3] - centre * (3 * raw[2] - 2 * centre * centre)
        fourth = raw[4] - centre * (4 * raw[3] - centre * (6 * raw[2] - 3 * centre * centre))
        square = fourth - var * var
        cov_square = products[2] / total - centre * (2 * products[1] / total - centre * mean_y) - var * mean_y
        det = var * square - third * third
        slope = (cov * square - cov_square * third) / det
        bend = (var * cov_square - third * cov) / det
        best = F.when(det > _NOISE * var * raw[4], mean_y + slope * t + bend * (t * t - var)).otherwise(line)
    return F.when(total > 0, F.when(var > _NOISE * raw[2], best).otherwise(mean_y))


def moments(w: Column, u: Column, y: Column, degree: int) -> tuple[list[Column], list[Column]]:
    """The summands of the moments a degree needs."""
    powers = [w]
    for _ in range(2 * degree):
        powers.append(powers[-1] * u)
    return powers, [p * y for p in powers[: degree + 1]]


def translated(m: list[Column], scale: Column, stretch: Column, shift: Column) -> list[Column]:
    """Moments of stretch * u + shift, scaled: Horner's scheme, one factor (u + shift) more for all higher powers each pass."""
    out, factor = [], scale
    for c in m:
        out.append(factor * c)
        factor = factor * stretch
    for done in range(1, len(out)):
        for k in range(len(out) - 1, done - 1, -1):
            out[k] = out[k] + shift * out[k - 1]
    return out

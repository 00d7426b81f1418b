"""Scalar pixel arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def stretched(v: Column, low: Column, high: Column) -> Column:
    """Stretch [low, high] to 0..255, cut off outside, truncated; an empty range counts as one wide."""
    top = F.when(high <= low, low + 1).otherwise(high)
    return ((clip(v, low, top) - low) / (top - low) * 255).cast("int")


def normalized(v: Column, low: Column, high: Column) -> Column:
    """Linear map of [low, high] to [0, 1] with clipping; a range of zero counts as 1."""
    width = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
    return clip((v - low) / width, 0.0, 1.0)


def target_score(channels: list[Column], target: tuple[int, int, int]) -> Column:
    """How much a pixel has the target's colour: smallest channel that is on minus largest that is off, from 0 to 255."""
    on = [c for c, t in zip(channels, target, strict=True) if t > 0]
    off = [c for c, t in zip(channels, target, strict=True) if t == 0]
    low = F.least(*on) if len(on) > 1 else (on[0] if on else F.lit(0))
    high = F.greatest(*off) if len(off) > 1 else (off[0] if off else F.lit(0))
    return clip(low - high, 0, 255).cast("int")


def saturation(channels: list[Column]) -> Column:
    return F.greatest(*channels) - F.least(*channels)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer luma of a colour."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def marker_score(before: list[Column], after: list[Column], target: tuple[int, int, int]) -> Column:
    """How far a pixel moved towards a marker colour between two images (channels over 128 count as on)."""
    diff = [a.cast("double") - b.cast("double") for a, b in zip(after, before, strict=True)]
    on = [d for d, t in zip(diff, target, strict=True) if t > 128]
    off = [F.abs(d) for d, t in zip(diff, target, strict=True) if t <= 128]
    low = (F.least(*on) if len(on) > 1 else on[0]) if on else None
    high = (F.greatest(*off) if len(off) > 1 else off[0]) if off else None
    if low is None:
        return F.sqrt(sum((d * d for d in diff[1:]), diff[0] * diff[0]))
    return low if high is None else low - high


def blended(a: Column, b: Column, alpha: float) -> Column:
    """(1 - alpha) * a + alpha * b, truncated to a whole number."""
    return (a * (1 - alpha) + b * alpha).cast("int")


def signed(v: Column) -> Column:
    """0..255 to -1..1."""
    return v / 127.5 - 1


def valid_label(v: Column) -> Column:
    return (v > 0) & (v != 255)


def noisy(v: Column, sigma: Column, normal: Column) -> Column:
    """A grey value with noise of a spread, cut to 0 .. 255 and truncated."""
    return clip(v + sigma * normal, 0.0, 255.0).cast("int")


def is_grey(r: Column, g: Column, b: Column) -> Column:
    return (r == g) & (g == b)


def augmented(v: Column, mean: Column, brightness, contrast, gamma) -> Column:
    """Brightness, contrast about the mean and gamma of a grey value from 0 to 255 (see noisy for the noise)."""
    lit = clip((v + brightness - (mean + brightness)) * contrast + (mean + brightness), 0.0, 255.0)
    return F.pow(lit / 255, gamma if isinstance(gamma, Column) else F.lit(gamma)) * 255

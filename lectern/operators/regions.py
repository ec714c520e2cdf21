"""Arithmetic of regions, candidate boxes and frames: clipping, padding, scores, and decisions by rule chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.operators.scoring import iou

# Thresholds and weights of the scores.
AREA, ASPECT, RECTANGULARITY = (0.10, 0.98), (0.45, 3.2), 0.55
SOFT_AREA, LOW_AREA, HIGH_AREA = 0.18, 0.28, 0.82
WEIGHTS = {"area": 0.30, "rect": 0.20, "text": 0.25, "stable": 0.15, "occlusion": 0.10}
SAME_HASH, SAME_SSIM, SSIM_HASH = 18, 0.78, 40
CENTER_SHIFT, AREA_CHANGE = 0.28, 0.55


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*[c.cast("long").alias(n) for c, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))])


def clipped(r: Column, frame_w: int, frame_h: int) -> Column:
    """The part of a region inside the frame; null where at most one pixel of a side is left."""
    x1, y1 = F.greatest(F.lit(0), F.least(r["x"], F.lit(frame_w - 1))), F.greatest(F.lit(0), F.least(r["y"], F.lit(frame_h - 1)))
    x2, y2 = F.greatest(F.lit(0), F.least(r["x"] + r["width"], F.lit(frame_w))), F.greatest(F.lit(0), F.least(r["y"] + r["height"], F.lit(frame_h)))
    return F.when((x2 - x1 > 1) & (y2 - y1 > 1), box(x1, y1, x2 - x1, y2 - y1))


def padded(r: Column, frame_w: int, frame_h: int, ratio: float) -> Column:
    """The region with ``ratio`` of its sides around it, half to even, inside the frame."""
    px, py = F.bround(F.greatest(F.lit(1), r["width"]) * ratio), F.bround(F.greatest(F.lit(1), r["height"]) * ratio)
    x1, y1 = F.greatest(F.lit(0), r["x"] - px), F.greatest(F.lit(0), r["y"] - py)
    x2, y2 = F.least(F.lit(frame_w), r["x"] + r["width"] + px), F.least(F.lit(frame_h), r["y"] + r["height"] + py)
    return box(x1, y1, x2 - x1, y2 - y1)


def paired_view(own: Column, other: Column) -> Column:
    """What is cut out of a frame that is compared with another: the median of both regions where they are one
    (IoU of a half or more), else the own one; where only one is known, that one."""
    mid = lambda a, b: F.bround((a + b) / F.lit(2.0))
    edge = lambda r, c, s: r[c] + r[s]
    x1, y1 = mid(own["x"], other["x"]), mid(own["y"], other["y"])
    x2, y2 = mid(edge(own, "x", "width"), edge(other, "x", "width")), mid(edge(own, "y", "height"), edge(other, "y", "height"))
    return F.when(own.isNull(), other).when(other.isNull(), own).when(iou(own, other) >= 0.5, box(x1, y1, x2 - x1, y2 - y1)).otherwise(own)


def acceptable(r: Column, rectangularity: Column, frame_area: float) -> Column:
    """Whether a box can be a board by its share of the frame, its aspect and how far its contour fills it."""
    area, aspect = r["width"] * r["height"] / F.lit(frame_area), r["width"] / r["height"]
    return area.between(*AREA) & aspect.between(*ASPECT) & (rectangularity >= RECTANGULARITY)


def area_score(share: Column) -> Column:
    """Piecewise: small boxes rise to 0.7, boards of the usual size have 0.95, nearly whole frames a little less."""
    rise = 0.15 + 0.55 * (share - SOFT_AREA) / (LOW_AREA - SOFT_AREA)
    return F.when(share <= 0, 0.0).when(share < SOFT_AREA, 0.15 * share / SOFT_AREA).when(share < LOW_AREA, rise).when(share <= HIGH_AREA, 0.95).when(share <= 0.98, 0.88).otherwise(0.75)


def candidate_score(share: Column, rect: Column, text: Column, stable: Column, occlusion: Column) -> Column:
    """Weighted score of a box, less where it is tiny, or bare of text and not stable."""
    clear = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), occlusion / 0.55))
    w = WEIGHTS
    raw = (w["area"] * area_score(share) + w["rect"] * rect + w["text"] * text + w["stable"] * stable + w["occlusion"] * clear) / sum(w.values())
    raw = F.when(share < SOFT_AREA, raw * (0.45 + 0.55 * share / SOFT_AREA)).otherwise(raw)
    raw = F.when((text < 0.10) & (stable < 0.65), raw * 0.35 * text / 0.10).otherwise(raw)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def keyframe_score(sharpness: Column, occlusion: Column, glare: Column) -> Column:
    unit = lambda c, full: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / full))
    return 0.55 * unit(sharpness, 250.0) + 0.35 * (1 - unit(occlusion, 0.45)) + 0.10 * (1 - unit(glare, 0.25))


def text_presence(components: Column, edge_density: Column, area: Column, full_components: int = 8, full_density: float = 0.12) -> Column:
    unit = lambda c: F.least(F.lit(1.0), c)
    return 0.50 * unit(components / full_components) + 0.35 * unit(edge_density / full_density) + 0.15 * unit(area / 0.025)


def page_decision(distance: Column, ssim: Column) -> Column:
    """Whether two frames show one page, and why: by their hashes, by their structure, or by both."""
    by_hash, by_ssim = distance <= SAME_HASH, (ssim >= SAME_SSIM) & (distance <= SSIM_HASH)
    return F.when(by_hash & by_ssim, "phash_and_ssim_similar").when(by_hash, "phash_similar").when(by_ssim, "ssim_similar").otherwise("phash_and_ssim_divergent")


def split_decision(left_text: Column, right_text: Column, similarity: Column, text_similarity: Column, gap: Column) -> Column:
    """Whether the stretch between two samples is sampled again."""
    changed = lambda limit: (similarity < limit) & (1 - similarity > 0.45)
    return F.when(left_text != right_text, True).when(left_text, changed(0.55) & (text_similarity < 0.88)).otherwise(changed(0.94) | (gap > 8000))


def motion(own: Column, before: Column, frame_w: int, frame_h: int) -> tuple[Column, Column]:
    """(shift of the centre over the frame's diagonal, ratio of the areas) from the region before."""
    mid = lambda r, c, s: r[c] + r[s] / F.lit(2.0)
    shift = F.hypot(mid(own, "x", "width") - mid(before, "x", "width"), mid(own, "y", "height") - mid(before, "y", "height")) / F.hypot(F.lit(float(frame_w)), F.lit(float(frame_h)))
    return shift, (own["width"] * own["height"]).cast("double") / F.greatest(before["width"] * before["height"], F.lit(1))


def redetect_reason(own: Column, shift: Column, ratio: Column) -> Column:
    """The first rule that calls for a new detection, else ``ok``; without a tracked region its features don't suffice."""
    return F.when(own.isNull(), "feature_insufficient").when(shift > CENTER_SHIFT, "layout_shift").when(F.abs(ratio - 1) > AREA_CHANGE, "layout_area_change").otherwise("ok")

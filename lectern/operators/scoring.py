"""Evaluation: diarization errors, overlap of regions, one-to-one matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.joins import overlap_pairs


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs x, y, width, height."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    both = (w * h).cast("double")
    return F.coalesce(F.try_divide(both, (a["width"] * a["height"] + b["width"] * b["height"]).cast("double") - both), F.lit(0.0))


def error_parts(reference: DataFrame, hypothesis: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, ref_ms, missed_ms, false_alarm_ms): what of each side the other doesn't cover; clamped for each interval."""
    pairs = overlap_pairs(reference, hypothesis, key)

    def side(df: DataFrame, p: str) -> DataFrame:
        met = pairs.groupBy(F.col(f"{p}_turn_id").alias("turn_id")).agg(F.sum("overlap_ms").alias("got"))
        own = df.select(key, "turn_id", (F.col("end_ms") - F.col("start_ms")).alias("dur")).join(met, "turn_id", "left")
        return own.groupBy(key).agg(F.sum("dur").alias("all_ms"), F.sum(F.greatest(F.lit(0), F.col("dur") - F.coalesce("got", F.lit(0)))).alias("open_ms"))

    ref = side(reference, "l").select(key, F.col("all_ms").alias("ref_ms"), F.col("open_ms").alias("missed_ms"))
    return ref.join(side(hypothesis, "r").select(key, F.col("open_ms").alias("false_alarm_ms")), key, "left").fillna(0, ["false_alarm_ms"])


def speaker_overlaps(reference: DataFrame, hypothesis: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, hyp, ref, ms): overlap of each pair of speakers."""
    return overlap_pairs(reference, hypothesis, key).groupBy(key, F.col("r_speaker_id").alias("hyp"), F.col("l_speaker_id").alias("ref")).agg(F.sum("overlap_ms").alias("ms"))


def diarization_error(reference: DataFrame, hypothesis: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, ref_ms, missed_ms, speaker_error_ms, false_alarm_ms, der): :func:`error_parts`, what is covered by a
    speaker that isn't mapped to the reference's, and the sum of the three over ref_ms; without a reference der is 1."""
    mapped = greedy_speaker_map(reference, hypothesis, key).withColumn("hit", F.lit(True))
    wrong = speaker_overlaps(reference, hypothesis, key).join(mapped, [key, "hyp", "ref"], "left").groupBy(key).agg(F.sum(F.when(F.col("hit"), 0).otherwise(F.col("ms"))).alias("speaker_error_ms"))
    alone = hypothesis.join(reference.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("false_alarm_ms"))
    zero = F.lit(0).cast("long")
    parts = error_parts(reference, hypothesis, key).unionByName(alone.select(key, zero.alias("ref_ms"), zero.alias("missed_ms"), "false_alarm_ms"))
    parts = parts.join(wrong, key, "left").withColumn("speaker_error_ms", F.coalesce("speaker_error_ms", zero))
    errors = (F.col("missed_ms") + F.col("speaker_error_ms") + F.col("false_alarm_ms")).cast("double")
    return parts.select(key, "ref_ms", "missed_ms", "speaker_error_ms", "false_alarm_ms", F.coalesce(F.try_divide(errors, F.col("ref_ms").cast("double")), F.lit(1.0)).alias("der"))


def greedy_speaker_map(reference: DataFrame, hypothesis: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, hyp, ref): speakers matched one to one, the largest overlap first; ties: the larger labels first.

    Only the overlap of speakers, a few rows for each recording, is grouped in Python.
    """
    sums = speaker_overlaps(reference, hypothesis, key)

    def match(part: pd.DataFrame) -> pd.DataFrame:
        h, r, out = set(), set(), []
        for job, hyp, ref, _ in part.sort_values(["ms", "hyp", "ref"], ascending=False)[[key, "hyp", "ref", "ms"]].itertuples(index=False):
            if hyp not in h and ref not in r:
                h.add(hyp), r.add(ref), out.append((job, hyp, ref))
        return pd.DataFrame(out, columns=[key, "hyp", "ref"])

    return sums.groupBy(key).applyInPandas(match, f"{key} string, hyp string, ref string")


def best_iou(references: DataFrame, hypotheses: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """(key, id, n_met, best_iou, hit): each reference's best IoU over the regions of its key with another id; a key holds few.

    Both sides have key, id and region. ``hit``: whether one of the k best reaches the threshold, which for any k the best decides.
    """
    other = hypotheses.select(F.col(key).alias("__key"), F.col("id").alias("__id"), F.col("region").alias("__region"))
    pairs = references.join(other, (F.col(key) == F.col("__key")) & (F.col("id") != F.col("__id")), "left")
    best = F.max(F.when(F.col("__id").isNotNull(), iou(F.col("region"), F.col("__region"))))
    out = pairs.groupBy(key, "id").agg(F.count("__id").alias("n_met"), F.coalesce(best, F.lit(0.0)).alias("best_iou"))
    return out.withColumn("hit", F.col("best_iou") >= threshold)


def keep_boxes(boxes: DataFrame, group: str, threshold: float = 0.55, cap: int = 24) -> DataFrame:
    """(group, id): greedy suppression; the largest box first, boxes over the threshold with a kept one are left out."""
    area = lambda b: b["width"] * b["height"]
    held = boxes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("width") * F.col("height")).alias("order"), "id", "x", "y", "width", "height"))).alias("b"))

    def share(b: Column, k: Column) -> Column:
        w = F.greatest(F.lit(0), F.least(b["x"] + b["width"], k["x"] + k["width"]) - F.greatest(b["x"], k["x"]))
        h = F.greatest(F.lit(0), F.least(b["y"] + b["height"], k["y"] + k["height"]) - F.greatest(b["y"], k["y"]))
        return w * h / F.greatest(F.lit(1e-9), (area(b) + area(k) - w * h).cast("double"))

    add = lambda kept, b: F.when((F.size(kept) < cap) & ~F.exists(kept, lambda k: share(b, k) >= threshold), F.concat(kept, F.array(b))).otherwise(kept)
    kept = F.aggregate("b", F.slice("b", 1, 0), add)
    return held.select(group, F.explode(F.transform(kept, lambda k: k["id"])).alias("id"))

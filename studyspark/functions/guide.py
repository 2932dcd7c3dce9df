"""Expected direction of known gait metrics, looked up by substring of the feature name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric keyword, expected direction (in lookup order), with a short note.
LOWER, HIGHER, VARIABLE = "LOWER in PD", "HIGHER in PD", "VARIABLE"
METRIC_GUIDE = (
    ("velocity", LOWER, "walking speed"),
    ("cadence", LOWER, "steps per minute"),
    ("step_length", LOWER, "distance covered by one step"),
    ("stride_length", LOWER, "distance covered by one stride"),
    ("stride_width", VARIABLE, "base of support"),
    ("stride_time", HIGHER, "duration of one stride"),
    ("step_time", HIGHER, "duration of one step"),
    ("gait_cycle", HIGHER, "duration of the gait cycle"),
    ("stance", HIGHER, "share of time with the foot on the ground"),
    ("swing", LOWER, "share of time with the foot in the air"),
    ("d._support", HIGHER, "double support share"),
    ("double", HIGHER, "time with both feet on the ground"),
    ("single_support", LOWER, "time on one foot"),
    ("egvi", LOWER, "gait variability index"),
    ("fap", LOWER, "functional ambulation profile"),
    ("ambulation", HIGHER, "time needed to cross the walkway"),
    ("cop", VARIABLE, "centre of pressure"),
    ("foot_angle", VARIABLE, "foot angle"),
    ("dop", VARIABLE, "direction of progression"),
    ("pressure", VARIABLE, "integrated foot pressure"),
    ("step_ratio", LOWER, "length to cadence ratio"),
)
UNKNOWN = ("UNKNOWN", "no guidance for this metric")


def normal_key(key: str) -> str:
    """Guide keys in the form normalised column names take."""
    return re.sub(r"[^a-z0-9]+", "_", key.lower()).strip("_")


def expectation(feature: Column) -> tuple[Column, Column]:
    """(direction, note) of the first guide entry whose key occurs in the name.

    Two dozen fixed entries are a CASE chain: no join, whatever the number of features.
    """
    name = F.lower(feature)
    direction, note = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for key, way, text in METRIC_GUIDE:
        hit = name.contains(key) | name.contains(normal_key(key))
        direction, note = direction.when(hit, F.lit(way)), note.when(hit, F.lit(text))
    return direction.otherwise(F.lit(UNKNOWN[0])), note.otherwise(F.lit(UNKNOWN[1]))

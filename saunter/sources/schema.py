"""Column types of the two trial tables, and their fixed-decimal text formats."""

from __future__ import annotations

from pyspark.sql import types as T

#: Name, type and decimals ('d' integer, 's' text) of each column, in file order.
SURFACE = [
    ("n_walkers", "int", "d"), ("n_volume", "double", 0), ("mu", "double", 1), ("lmax", "int", "d"), ("D", "double", 2), ("surface", "double", 2),
    ("TargetShape", "string", "s"), ("n_targets", "int", "d"), ("fixed_target_dist", "double", 1), ("detection_time", "double", 2),
    ("probability", "double", 2), ("surface_selector", "int", "d"), ("first_touch_steps", "int", "d"), ("second_touch_steps", "int", "d"),
    ("delta_selector", "int", "d"), ("delta", "double", 2),
]
FIXED_VOLUME = [
    ("n_walkers", "int", "d"), ("n_volume", "double", 0), ("mu", "double", 1), ("lmax", "int", "d"), ("D", "double", 2), ("TargetShape", "string", "s"),
    ("DiskDiameter", "double", 0), ("n_targets", "int", "d"), ("fixed_target_dist", "double", 1), ("detection_time", "double", 2), ("probability", "double", 2),
]
VARIANTS = {"surface": SURFACE, "fixed_volume": FIXED_VOLUME}
TYPES = {name: kind for v in (SURFACE, FIXED_VOLUME) for name, kind, _ in v}


def schema(variant: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind, _ in VARIANTS[variant]))


def schema_of_header(header: str) -> T.StructType:
    """Known columns get their types, others are text."""
    return T.StructType.fromDDL(", ".join(f"`{n.strip()}` {TYPES.get(n.strip(), 'string')}" for n in header.split(",")))

"""Shapes of slides: places within nested groups, what lies off the slide, and the warnings about it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Deeper nesting is a broken file: a group cannot hold itself, so a walk down ends by itself, but files can lie.
MAX_DEPTH = 64


def placed(shapes: DataFrame, slide_width: float, slide_height: float, keep: Callable[[DataFrame, int], DataFrame] = lambda df, depth: df) -> DataFrame:
    """Where shapes are on their slide: (slide, shape, depth, x, y, width, height, visible).

    ``shapes`` has (slide, shape, parent or null, left, top, width, height) and for groups (off_x, off_y, ext_x, ext_y), the
    frame of its children's coordinates, all null for others. A child's map is its group's map after the group's own scale and
    offset; an extent of 0 or null doesn't scale. Walks down from the outermost shapes, a level at a time, with one join a level; below a
    shape that is off the slide nothing is looked at. ``keep`` gets every level and may write it down.
    """
    number = lambda c: F.col(c).cast("double")
    is_group = F.col("ext_x").isNotNull() | F.col("ext_y").isNotNull()
    own = shapes.select("slide", "shape", "parent", *[number(c).alias(c) for c in ("left", "top", "width", "height", "off_x", "off_y", "ext_x", "ext_y")], is_group.alias("is_group"))
    # Shapes whose parent is nowhere are not reached, as in the file.
    level = own.filter("parent is null").withColumns({"sx": F.lit(1.0), "sy": F.lit(1.0), "ox": F.lit(0.0), "oy": F.lit(0.0)})
    out = None
    for depth in range(MAX_DEPTH):
        x, y, w, h = F.col("ox") + F.col("left") * F.col("sx"), F.col("oy") + F.col("top") * F.col("sy"), F.col("width") * F.col("sx"), F.col("height") * F.col("sy")
        seen = (x + w > 0) & (y + h > 0) & (x < slide_width) & (y < slide_height)
        level = level.withColumns({"x": x, "y": y, "w": w, "h": h}).withColumn("visible", seen)
        level = keep(level.withColumn("depth", F.lit(depth)), depth)
        rows = level.select("slide", "shape", "depth", "x", "y", F.col("w").alias("width"), F.col("h").alias("height"), "visible")
        out = rows if out is None else out.unionByName(rows)
        groups = level.filter("visible and is_group")
        scale = lambda size, extent: F.when(F.coalesce(F.col(extent), F.lit(0.0)) != 0, F.col(size) / F.col(extent)).otherwise(1.0)
        gx, gy = F.col("sx") * scale("width", "ext_x"), F.col("sy") * scale("height", "ext_y")
        maps = groups.select("slide", F.col("shape").alias("parent"), gx.alias("sx"), gy.alias("sy"), (F.col("x") - F.coalesce("off_x", F.lit(0.0)) * gx).alias("ox"), (F.col("y") - F.coalesce("off_y", F.lit(0.0)) * gy).alias("oy"))
        if groups.isEmpty():
            return out
        level = own.join(maps, ["slide", "parent"])
    raise ValueError(f"groups are nested more than {MAX_DEPTH} deep")


def off_slide_warning(identity: Column, number: Column, name: Column) -> Column:
    """The record of a shape that is left out."""
    message = F.concat(F.lit("Excluded fully off-canvas shape '"), name, F.lit("' from native slide "), number.cast("string"), F.lit(" visible semantics"))
    return _warning("pptx_shape_outside_slide", message, identity, number, name, None, None)


def dynamic_field_warning(identity: Column, number: Column, name: Column, field: Column, cached: Column) -> Column:
    """The record of a field whose stored text is not believed."""
    kind = F.coalesce(F.nullif(field, F.lit("")), F.lit("unknown"))
    message = F.concat(F.lit("Excluded non-authoritative cached value for dynamic field '"), kind, F.lit("' on native slide "), number.cast("string"))
    return _warning("pptx_dynamic_field_cached_value", message, identity, number, name, kind, F.coalesce(cached, F.lit("")))


def _warning(code: str, message: Column, identity: Column, number: Column, name: Column, field: Column | None, cached: Column | None) -> Column:
    # Codes, messages and the authority of a stored value.
    none = F.lit(None).cast("string")
    source = F.struct(F.lit("pptx_slide").alias("type"), identity.alias("source_slide_identity"), number.cast("int").alias("native_slide_index"), name.alias("shape_name"))
    return F.struct(F.lit("warning").alias("severity"), F.lit(code).alias("code"), message.alias("message"), source.alias("source_ref"), (none if field is None else field).alias("field_type"), (none if cached is None else cached).alias("cached_value"), (none if cached is None else F.lit("non_authoritative")).alias("cached_value_authority"))

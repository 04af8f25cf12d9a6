"""Text that is still readable under covering annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 2.0
COVERING = ["#000000", "#ff0000"]
#: The smallest cells have sides of 2 to this power.
LEAST_LEVEL = 5


def boxed(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """df with its box (lx, ly, hx, hy) and the level of the cells that fit it: no side of the box is longer than a cell's. Boxes that are not finite go."""
    sides = {"lx": F.least(x0, x1), "ly": F.least(y0, y1), "hx": F.greatest(x0, x1), "hy": F.greatest(y0, y1)}
    whole = [v.isNotNull() & (F.abs(v) < float("inf")) for v in (x0, y0, x1, y1)]
    own = df.where(whole[0] & whole[1] & whole[2] & whole[3]).withColumns(sides)
    return own.withColumn("own", F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly"), F.lit(1.0)))).cast("int")))


def cell(c: Column) -> Column:
    return F.floor(c / F.pow(F.lit(2.0), F.col("level")))


def in_cells(df: DataFrame, other: DataFrame) -> DataFrame:
    """Boxes with each cell (level, cx, cy) that they reach into, four at most at a level: at the levels at which boxes of the other side may meet them, the higher
    of the two boxes' own levels. Which levels the other side has is a subquery of one row with at most some dozens of numbers."""
    levels = other.agg(F.collect_set("own")).scalar()
    at = df.withColumn("levels", levels).withColumn("level", F.explode(F.array_distinct(F.transform("levels", lambda x: F.greatest(x, F.col("own")))))).drop("levels")
    return at.withColumn("cx", F.explode(F.sequence(cell(F.col("lx")), cell(F.col("hx"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("ly")), cell(F.col("hy")))))


def item_boxes(items: DataFrame) -> DataFrame:
    i = items.where(F.trim("str") != "")
    return boxed(i, F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height"))


def area_boxes(annotations: DataFrame, tolerance: float = TOLERANCE, exclude: list[str] | None = None) -> DataFrame:
    """Covering areas, moved by the tolerance: an item touches one where their boxes meet."""
    areas = annotations.where(F.lower("color").isin(COVERING) & ((F.col("opacity") != 0) | F.col("opacity").isNull()))
    if exclude:
        areas = areas.where(~F.lower("annotation_type").isin([x.lower() for x in exclude]))
    t = F.lit(float(tolerance))
    return boxed(areas, F.col("x0") - t, F.col("y0") - t, F.col("x1") - t, F.col("y1") - t)


def sloppy_redactions(items: DataFrame, annotations: DataFrame, tolerance: float = TOLERANCE, exclude: list[str] | None = None) -> DataFrame:
    """(doc_id, page, rect, text, text_rect, annotation_type, color, opacity, n_items): items (doc_id, page, ord, str, x, y, width, height)
    that touch a black or red annotation (doc_id, page, annot_id, x0, y0, x1, y1, color, opacity, annotation_type) of their page.

    Both sides are dealt to cells of their page, so that a page with any number of items and areas is many groups, each of what lies close together; a pair
    counts in the one cell that holds the least corner that its boxes share. Rows without document or page, or with a coordinate that is null or
    not finite, touch nothing. Texts are joined in the order of items; attributes are those of the first hit. No type of annotation is excluded unless named.
    """
    own, covering = item_boxes(items), area_boxes(annotations, tolerance, exclude)
    i = in_cells(own, covering).alias("i")
    a = in_cells(covering, own).alias("a")
    same = [F.col(f"i.{c}") == F.col(f"a.{c}") for c in ("doc_id", "page", "level", "cx", "cy")]
    touch = (F.col("a.x0") - (F.col("i.x") + F.col("i.width")) <= tolerance) & (F.col("a.y0") - (F.col("i.y") + F.col("i.height")) <= tolerance) & (F.col("a.x1") - F.col("i.x") >= tolerance) & (F.col("a.y1") - F.col("i.y") >= tolerance)
    size = F.pow(F.lit(2.0), F.col("i.level"))
    once = (F.col("i.level") == F.greatest("i.own", "a.own")) & (F.col("i.cx") == F.floor(F.greatest("i.lx", "a.lx") / size)) & (F.col("i.cy") == F.floor(F.greatest("i.ly", "a.ly") / size))
    met = i.join(a, same[0] & same[1] & same[2] & same[3] & same[4] & once & touch)
    rect = F.array(*[F.col(f"a.{c}") for c in ("x0", "y0", "x1", "y1")])
    text_rect = F.array(F.col("i.x"), F.col("i.y"), F.col("i.x") + F.col("i.width"), F.col("i.y") + F.col("i.height"))
    order = F.struct(F.col("i.ord"), F.col("a.annot_id"), F.col("i.str"), F.col("i.x"))
    rows = met.select("i.doc_id", "i.page", rect.alias("rect"), order.alias("o"), F.col("i.str").alias("str"), text_rect.alias("text_rect"), "a.annotation_type", "a.color", "a.opacity")
    return rows.groupBy("doc_id", "page", "rect").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "str"))), lambda x: x["str"]), " ").alias("text"),
        F.min_by("text_rect", "o").alias("text_rect"), F.min_by("annotation_type", "o").alias("annotation_type"), F.min_by("color", "o").alias("color"), F.min_by("opacity", "o").alias("opacity"), F.count("*").alias("n_items"),
    )

"""Boxes on pages: which ones overlap, and where a value stands in runs of neighbouring boxes.

Overlaps are a join over the cells of a grid: a box lies in each cell that it touches, boxes of one cell meet, and a pair is
told in one cell only, that of the upper left corner of what the two share. So boxes that are far apart never meet, and no
pair has to be made distinct.

Values are looked for in a page's text as it is read: boxes in lines from top to bottom, in a line from left to right, all
blanks and marks that readers drop left out. A value's run is the boxes that its characters stand in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import half_width

#: Side of a grid's cell, in the boxes' own unit.
CELL = 64.0
_SIDES = ("x0", "y0", "x1", "y1")


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def shared(a: Column, b: Column) -> Column:
    """The box that two boxes share; its area is 0 if they only touch, or are apart."""
    return F.struct(F.greatest(a["x0"], b["x0"]).alias("x0"), F.greatest(a["y0"], b["y0"]).alias("y0"), F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"))


def iou(a: Column, b: Column) -> Column:
    """The shared area's part of the area of both; 0 for boxes without area."""
    both = F.when((F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"])) & (F.least(a["y1"], b["y1"]) > F.greatest(a["y0"], b["y0"])), area(shared(a, b))).otherwise(0.0)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def _in_cells(boxes: DataFrame, page: list[str], box: str, name: str, cell: float) -> DataFrame:
    """A row for each cell that a box touches; `at` has bit 1 in the box's first column of cells, bit 2 in its first row.
    All columns are plain numbers but the page's keys and the box's id: pairs are told without a struct."""
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    own = boxes.where("x0 < x1 AND y0 < y1").select(*page, F.col(box).alias(f"{name}_id"), *(F.col(c).cast("double").alias(f"{name}_{c}") for c in _SIDES), at("x0").alias("fx"), at("y0").alias("fy"), F.explode(F.sequence(at("x0"), at("x1"))).alias("cx"), at("y1").alias("ly"))
    own = own.withColumn("cy", F.explode(F.sequence("fy", "ly")))
    own = own.withColumn(f"{name}_size", (F.col(f"{name}_x1") - F.col(f"{name}_x0")) * (F.col(f"{name}_y1") - F.col(f"{name}_y0")))
    return own.withColumn(f"{name}_at", (F.col("cx") == F.col("fx")).cast("int") + 2 * (F.col("cy") == F.col("fy")).cast("int")).drop("fx", "fy", "ly")


def overlaps(left: DataFrame, right: DataFrame, least: float = 0.0, page: tuple[str, ...] = ("doc_id", "page"), box: str = "box", cell: float = CELL) -> DataFrame:
    """(page, left, right, iou) of each pair of a left and a right box of one page that share an area, and at least `least`
    of their union. Boxes with a null side or without area share none; equal rows are pairs of their own. cell: about the
    size of most boxes; it changes the work and no result."""
    keys = list(page)
    a, b = _in_cells(left, keys, box, "a", cell), _in_cells(right, keys, box, "b", cell)
    # of the cells that two boxes share, the first column is where one of them begins, and so is the first row
    both = a.join(b, [*keys, "cx", "cy"]).where(F.col("a_at").bitwiseOR(F.col("b_at")) == 3).where("a_x0 < b_x1 AND b_x0 < a_x1 AND a_y0 < b_y1 AND b_y0 < a_y1")
    # iou() written out for boxes that overlap: an expression so large that it is not compiled takes ten times as long
    part = F.expr("(least(a_x1, b_x1) - greatest(a_x0, b_x0)) * (least(a_y1, b_y1) - greatest(a_y0, b_y0))")
    union = F.col("a_size") + F.col("b_size") - part
    got = F.when(union > 0, part / union)
    return both.where(got >= least if least > 0 else got > 0).select(*keys, F.col("a_id").alias("left"), F.col("b_id").alias("right"), got.alias("iou"))


def plain(c: Column) -> Column:
    """Text as it is compared: half-width, lower-case, without blanks, commas and currency signs."""
    return F.regexp_replace(F.lower(half_width(c)), r"[\s,，¥￥$]+", "")


def lines(boxes: DataFrame, page: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """boxes with `line` and `place`, from 1, in the order of reading: a box begins a line where its middle lies below the
    lowest of the line's boxes before it begins; lines from top to bottom, boxes in a line from left to right."""
    down = W.partitionBy(*page).orderBy("y0", "x0", "x1", "y1", "text")
    reach = F.max("y1").over(down.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | ((F.col("y0") + F.col("y1")) / 2 >= reach), 1).otherwise(0)
    own = boxes.withColumn("__new", new).withColumn("line", F.sum("__new").over(down)).drop("__new")
    return own.withColumn("place", F.row_number().over(W.partitionBy(*page).orderBy("line", "x0", "y0", "x1", "y1", "text")))


def _spots(text: Column, value: Column) -> Column:
    """Where a value begins in a text, from 0, occurrences that do not overlap."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    ends = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.expr("cast(array() as array<int>)"), lambda a, p: F.array_append(a, F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1) + F.length(value), F.lit(0)) + F.length(p)))
    return F.when(F.length(value) > 0, ends)


def value_boxes(values: DataFrame, boxes: DataFrame, doc: str = "doc_id", field: str = "field", value: str = "value") -> DataFrame:
    """(doc, field, page, line, first, last, exact, x0, y0, x1, y1): the best run of each value that stands on a page.

    Best is a run that is the value and nothing else, then the one of fewest boxes, then of the smallest area, then the
    first in reading. A longer box that holds the value is cut to the value's share of its characters. Values and boxes
    without characters are nowhere; null boxes take no part. boxes: (doc, page, text, x0, y0, x1, y1); a page's boxes are
    read as one text, and so are held together.
    """
    own = boxes.where(F.col("text").isNotNull() & F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()).select(doc, "page", "text", *(F.col(c).cast("double").alias(c) for c in _SIDES))
    placed = lines(own, (doc, "page")).withColumn("t", plain(F.col("text"))).where("t <> ''")
    ahead = W.partitionBy(doc, "page").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.coalesce(F.sum(F.length("t")).over(ahead), F.lit(0)).cast("int"))
    pages = placed.groupBy(doc, "page").agg(F.array_sort(F.collect_list(F.struct("place", "line", "at", "t", *_SIDES))).alias("b"))
    pages = pages.withColumn("all", F.array_join(F.transform("b", lambda x: x["t"]), ""))
    asked = values.select(doc, field, plain(F.col(value)).alias("v")).where("v <> ''").distinct()
    found = pages.join(asked, doc).where(F.contains("all", F.col("v"))).select(doc, field, "page", "b", "v", F.explode(_spots(F.col("all"), F.col("v"))).alias("s"))
    end = F.col("s") + F.length("v")
    run = F.filter("b", lambda x: (x["at"] < end) & (x["at"] + F.length(x["t"]) > F.col("s")))

    def cut(x: Column) -> Column:
        n, w = F.length(x["t"]), x["x1"] - x["x0"]
        return F.struct((x["x0"] + w * F.greatest(F.col("s") - x["at"], F.lit(0)) / n).alias("x0"), x["y0"].alias("y0"), (x["x1"] - w * F.greatest(x["at"] + n - end, F.lit(0)) / n).alias("x1"), x["y1"].alias("y1"))

    found = found.withColumn("r", run).withColumn("k", F.transform("r", cut))
    most = lambda f, c: f(F.transform("k", lambda x: x[c]))
    first, last = F.get("r", F.lit(0)), F.element_at("r", -1)
    sized = found.select(
        doc, field, "page", first["line"].alias("line"), first["place"].alias("first"), last["place"].alias("last"), ((first["at"] == F.col("s")) & (last["at"] + F.length(last["t"]) == end)).alias("exact"),
        most(F.array_min, "x0").alias("x0"), most(F.array_min, "y0").alias("y0"), most(F.array_max, "x1").alias("x1"), most(F.array_max, "y1").alias("y1"),
    )
    order = F.struct((~F.col("exact")).alias("e"), (F.col("last") - F.col("first")).alias("n"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("a"), "page", "first", "line", "last", "exact", *_SIDES)
    return sized.groupBy(doc, field).agg(F.min(order).alias("o")).select(doc, field, "o.page", "o.line", "o.first", "o.last", "o.exact", *(f"o.{c}" for c in _SIDES))

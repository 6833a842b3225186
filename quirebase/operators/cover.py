"""What rectangles cover of lines and regions: hidden text layers, text that images repeat, figures drawn as vectors.

Boxes are rows with page, x1, y1, x2, y2. A page's rectangles are an array beside its lines, so a line keeps its row and the sums stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .greedy import merged

#: Share of a line that must be covered, share of lines that makes a page hidden.
COVERED, HIDDEN = 0.6, 0.5
#: Fixed values for figures: gap of parts, least parts, width and height, margin; shares of a page that are its background, and with a width;
#: share of text in a small region, what is small, share in others; share under images.
GAP, PARTS, WIDTH, HEIGHT, MARGIN = 5.0, 3, 30.0, 20.0, 2.0
PAGE, BACKGROUND, BROAD = 0.96, 0.25, 0.5
SMALL_TEXT, SMALL, TEXT, IMAGES = 0.7, 0.03, 0.25, 0.6


def arrayed(boxes: DataFrame, name: str) -> DataFrame:
    """(page, name): a page's boxes as an array."""
    return boxes.groupBy("page").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias(name))


def beside(df: DataFrame, boxes: DataFrame, name: str) -> DataFrame:
    """Rows with the boxes of their page, an empty array where it has none."""
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    return df.join(arrayed(boxes.select("page", *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]), name), "page", "left").withColumn(name, F.coalesce(name, none))


def area() -> Column:
    return (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))


def under(name: str) -> Column:
    """Area of a row's box under the boxes of an array, each counted for itself."""
    side = lambda b, n: F.greatest(F.least(F.col(f"{n}2"), b[f"{n}2"]) - F.greatest(F.col(f"{n}1"), b[f"{n}1"]), F.lit(0.0))
    return F.aggregate(name, F.lit(0.0), lambda acc, b: acc + side(b, "x") * side(b, "y"))


def share(name: str) -> Column:
    """Covered share of a row's box, 0 of one without area."""
    return F.when(area() > 0, F.least(F.lit(1.0), under(name) / area())).otherwise(0.0)


def hidden_pages(lines: DataFrame, hidden: DataFrame) -> DataFrame:
    """(page, invisible): pages with lines, whether merged hidden rectangles cover half of them on average; false without any."""
    return beside(lines, merged(hidden), "_rects").groupBy("page").agg((F.avg(share("_rects")) >= HIDDEN).alias("invisible"))


def ghosts(lines: DataFrame, images: DataFrame, hidden: DataFrame) -> DataFrame:
    """Lines with `ghost`: 60 % under merged images, centre in one, and 60 % under the merged baked images (column `baked`) or hidden rectangles."""
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    centred = F.exists("_images", lambda b: x.between(b["x1"], b["x2"]) & y.between(b["y1"], b["y2"]))
    both = beside(beside(beside(lines, merged(images), "_images"), merged(images.where("baked")), "_baked"), merged(hidden), "_hidden")
    ghost = (area() > 0) & (share("_images") >= COVERED) & centred & ((share("_baked") >= COVERED) | (share("_hidden") >= COVERED))
    return both.withColumn("ghost", ghost).drop("_images", "_baked", "_hidden")


def figures(shapes: DataFrame, lines: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """Drawn shapes, lines, images and (page, width, height) -> regions (page, x1, y1, x2, y2) that are figures.

    Shapes near one another, without page backgrounds and broad fills, are a region; it needs three shapes, one of them with two
    dimensions, a least size, little text for its size, and no image that covers most of it.
    """
    sheet, w, h = F.col("width") * F.col("height"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    some = shapes.join(pages, "page").where((w > 0) & (h > 0) & (area() <= PAGE * sheet) & ~((w > BROAD * F.col("width")) & (area() > BACKGROUND * sheet)))
    some = some.select("page", "x1", "y1", "x2", "y2")
    within = lambda b: (b["x1"] >= F.col("x1")) & (b["y1"] >= F.col("y1")) & (b["x2"] <= F.col("x2")) & (b["y2"] <= F.col("y2"))
    regions = beside(merged(some, GAP).where((w >= WIDTH) & (h >= HEIGHT)), some, "_shapes").withColumn("_inside", F.filter("_shapes", within))
    flat = F.exists("_inside", lambda b: (b["x2"] - b["x1"] > 1) & (b["y2"] - b["y1"] > 1))
    grown = regions.where((F.size("_inside") >= PARTS) & flat).join(pages, "page").select(
        "page", "width", "height", *[F.greatest(F.col(c) - MARGIN, F.lit(0.0)).alias(c) for c in ("x1", "y1")],
        F.least(F.col("x2") + MARGIN, F.col("width")).alias("x2"), F.least(F.col("y2") + MARGIN, F.col("height")).alias("y2"),
    )
    limit = F.when(area() <= SMALL * sheet, SMALL_TEXT).otherwise(TEXT)
    kept = beside(beside(grown, lines, "_lines"), images, "_images").where((under("_lines") <= limit * area()) & (under("_images") <= IMAGES * area()))
    return kept.select("page", "x1", "y1", "x2", "y2")

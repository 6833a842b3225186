"""The registered queries of the reference's own operators and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cover, formulas, gaps, greedy, markup, queue, rows
from .plans import detection, events, glyphs, parsing, rules  # noqa: F401  their plans register themselves
from .plans import lines as _lines  # noqa: F401
from .plans.catalog import PLANS
from .plans.dialect import DUCK, SPARK
from .plans.views import BOXES, FORMULAS
from .session import TABLES, table
from .streaming import tracker


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    for name in TABLES:
        if name in sql:
            rows = table(spark, sf_dir, name)
            if "stored" in sql:
                rows = rows.withColumn("stored", F.struct("_metadata.file_path", "_metadata.row_index"))
            rows.createOrReplaceTempView(name)


def planned(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = PLANS[name](SPARK)
    views(spark, sf_dir, sql)
    return spark.sql(sql)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = f"WITH {BOXES} SELECT * FROM boxes"
    views(spark, sf_dir, sql)
    return spark.sql(sql)


def a15_merged_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.merged(boxes(spark, sf_dir), 1.0)


def x01_x02_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.split_sentences(table(spark, sf_dir, "documents"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as text pieces: blocks by class, every fourth one blanked glyphs, some several lines high; classes 4 and 5 are links."""
    return boxes(spark, sf_dir).selectExpr("*", "cls AS block", "det % 4 = 0 AS blank", "CASE WHEN det = 7 THEN '(12)' ELSE 'text' END AS text", "h > 30 AS several", "cls > 3 AS is_link")


def a17_clustered_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.clustered(boxes(spark, sf_dir))


def a18_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.corridors(boxes(spark, sf_dir))


def j09_uri_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.claimed(pieces(spark, sf_dir))


def j15_j16_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.grouped(pieces(spark, sf_dir))


def j17_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.flows(boxes(spark, sf_dir).selectExpr("*", "CASE det % 3 WHEN 0 THEN 'Done.' ELSE 'and so' END AS text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the first four classes as lines of text, some erased, some with blanks at an end; det counts a page's."""
    sql = f"WITH {BOXES}, l AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY det, cls, conf, x1, y1, x2, y2) AS INT) AS det, x1, y1, x2 - 10 AS x2, y1 + 12 AS y2 FROM boxes WHERE cls < 4) SELECT *, det % 3 <> 2 AS kept, 8e0 + det AS size, CASE WHEN det % 4 = 1 THEN 3e0 END AS tail, CASE WHEN det % 5 = 3 THEN 2e0 END AS head FROM l"
    views(spark, sf_dir, sql)
    return spark.sql(sql)


def f34_invisible_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.hidden_pages(lines(spark, sf_dir), boxes(spark, sf_dir).where("cls = 4"))


def j19_absorbed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.absorbed(lines(spark, sf_dir))


def j22_ghost_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = boxes(spark, sf_dir).where("cls = 5").withColumn("baked", F.col("det") % 2 == 0)
    return cover.ghosts(lines(spark, sf_dir).select("page", "det", "x1", "y1", "x2", "y2"), images, boxes(spark, sf_dir).where("cls = 4"))


def s31_vector_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes at a quarter of their size as drawn shapes, on pages of 160 by 150."""
    drawn = boxes(spark, sf_dir)
    shapes = drawn.selectExpr("page", "x1", "y1", "x1 + w / 4 AS x2", "y1 + h / 4 AS y2")
    pages = drawn.select("page").distinct().selectExpr("page", "160e0 AS width", "150e0 AS height")
    return cover.figures(shapes, lines(spark, sf_dir).where("det % 3 = 0"), drawn.where("cls = 5 AND det = 1"), pages)


def j21_x61_column_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.spaced(pieces(spark, sf_dir))


def m02_bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as puts into 20 pools of 4 places, purchases as takes of up to 3."""
    log = table(spark, sf_dir, "events").selectExpr("user_id % 20 AS pool", "event_id AS at", "event_id AS seq", "CASE WHEN event_type = 'purchase' THEN 3 END AS take")
    return queue.admitted(log, 4, 10_000)


def w27_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.settled(boxes(spark, sf_dir))


def x12_markup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.texts(table(spark, sf_dir, "pages"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the frames of 64 streams."""
    return boxes(spark, sf_dir).selectExpr("page % 64 AS stream", "page AS frame", "det", "x1", "y1", "x2", "y2", "conf")


def m14_m15_m18_m19_m20_u08_j25_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.tracked(frames(spark, sf_dir))


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised text (item, text), with backslashes."""
    sql = f"WITH {FORMULAS} SELECT item, replace(raw, '§', chr(92)) AS text FROM formulas"
    views(spark, sf_dir, sql)
    return spark.sql(sql)


def x16_marked_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.marked_texts(recognised(spark, sf_dir))


def x19_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.text_lines(recognised(spark, sf_dir))


def x33_folded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.folded_texts(recognised(spark, sf_dir), 120.0, 60.0)


def x47_aligned_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.aligned_texts(recognised(spark, sf_dir))


def x48_split_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.split_texts(recognised(spark, sf_dir))


ORDERED = (a15_merged_rects, a17_clustered_rects, a18_corridors, f34_invisible_layer, j09_uri_claims, j15_j16_row_groups, j17_flows, j19_absorbed_gaps, j21_x61_column_gaps, j22_ghost_text, m02_bounded_queue, s31_vector_figures, w27_settled, x01_x02_sentences, x12_markup_text, x16_marked_formulas, x19_text_lines, x33_folded_boxes, x47_aligned_formulas, x48_split_formulas, m14_m15_m18_m19_m20_u08_j25_tracks)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(planned, name) for name in PLANS} | {f.__name__: f for f in ORDERED}
ORACLES: dict[str, str] = {name: p(DUCK) for name, p in PLANS.items()}

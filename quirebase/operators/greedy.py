"""Order-dependent operators that no plan states: merging boxes to a fixpoint, the sentence scanner."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import DataFrame


def by_group(df: DataFrame, key: str, run: Callable[[object, list], Iterator[tuple]], schema: str) -> DataFrame:
    """run(key, rows) over groups of rows, many groups in each call of a worker; one group is held at a time."""

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        rows = (r for pdf in parts for r in pdf.itertuples(index=False))
        out = (o for k, group in groupby(rows, key=lambda r: getattr(r, key)) for o in run(k, list(group)))
        while some := list(islice(out, 10_000)):
            yield pd.DataFrame(some, columns=names)

    return df.repartition(key).sortWithinPartitions(key).mapInPandas(stream, schema)


Box = list[float]


def within(gap: float) -> Callable[[Box, Box], bool]:
    """Boxes (x1, y1, x2, y2) less than half the gap apart."""
    pad = gap / 2
    return lambda r, o: r[0] < o[2] + pad and o[0] < r[2] + pad and r[1] < o[3] + pad and o[1] < r[3] + pad


def merged(boxes: DataFrame, gap: float = 1.0, near: Callable[[Box, Box], bool] | None = None) -> DataFrame:
    """Boxes near one another, less than half the gap apart if not stated otherwise, become their hull until none are: rows (page, x1, y1, x2, y2)."""
    near = near or within(gap)

    def run(page, rows: list) -> Iterator[tuple]:
        hulls: list[Box] = []
        for r in rows:
            box = [r.x1, r.y1, r.x2, r.y2]
            while close := [h for h in hulls if near(box, h)]:  # a hull that grew may reach others
                hulls = [h for h in hulls if h not in close]
                box = [f(sides) for f, sides in zip((min, min, max, max), zip(box, *close, strict=True), strict=True)]
            hulls.append(box)
        return ((page, *r) for r in sorted(hulls))

    return by_group(boxes.select("page", "x1", "y1", "x2", "y2"), "page", run, "page long, x1 double, y1 double, x2 double, y2 double")


#: Words before a numeral whose full stop ends no sentence, titles before a name, marks that may open a sentence.
NUMBERED = set("fig figs eq eqs sec sect ref refs no nos tab tabs ch chaps app pp vol vols approx et al dept univ".split())
TITLES = set("dr prof mr mrs ms st mt fr jr sr rev gen col lt capt sgt adm rep sen gov corp inc ltd co".split())
OPENERS = "\"'“’("
#: An ideographic full stop by itself, or a run of stops with the closers after it.
_STOP = re.compile(r"([。！？．])|[.!?][.!?…]*[)\]}”’»\"']*")
_LAST = re.compile(r"[A-Za-z]+$")


def _opens(text: str, stop: int, after: int) -> bool:
    """Whether the character at `after` opens a sentence, the stop being at `stop`."""
    c = text[after]
    if not (c.isupper() or c.isdigit() or c in OPENERS):
        return False
    if stop and text[stop - 1].isdigit() and c.isdigit():
        return False
    end = stop
    while end and text[end - 1].isspace():
        end -= 1
    word = _LAST.search(text[max(0, end - 12) : end])
    last = word.group().lower() if word else ""
    return not (last in TITLES or last in NUMBERED and c.isdigit())


def sentences(text: str) -> list[tuple[int, int]]:
    """Intervals [a, b) that cover the text, one for each sentence; blanks after a stop begin the next."""
    cuts = [0]
    for m in _STOP.finditer(text):
        after = m.end()
        if not m.group(1):
            while after < len(text) and text[after].isspace():
                after += 1
            if after < len(text) and not _opens(text, m.start(), after):
                continue
        cuts.append(m.end())
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if a < b]


def split_sentences(blocks: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, at, start, stop)."""

    def run(parts):
        for pdf in parts:
            rows = [(d, i, a, b) for d, t in zip(pdf.doc_id, pdf.text, strict=True) for i, (a, b) in enumerate(sentences(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "at", "start", "stop"])

    return blocks.select("doc_id", "text").mapInPandas(run, "doc_id long, at int, start int, stop int")

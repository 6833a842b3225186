"""HTML blocks as plain text with styled runs and formula intervals."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

#: Tags whose end breaks the line, ends a cell, sets a style.
BREAKS = set("p div li tr h1 h2 h3 h4 h5 h6 blockquote table section article ul ol figure figcaption pre".split())
CELLS = {"td", "th"}
STYLES = {"b": 0, "strong": 0, "i": 1, "em": 1, "sup": 2}


class _Text(HTMLParser):
    """Characters with their style, white space folded as they come; a separator waits until a character follows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.chars: list[tuple[str, tuple]] = []
        self.math: list[tuple[int, int]] = []
        self.depth, self.hidden, self.formula, self.source = [0, 0, 0], 0, 0, []
        self.wait = ""

    def put(self, text: str, style: tuple) -> int | None:
        """Where the first visible character went."""
        first = None
        for c in text:
            if c.isspace():
                self.wait = self.wait or " "
                continue
            if self.wait == "\n" and self.chars and self.chars[-1][0] != "\n" or self.wait == " " and self.chars and self.chars[-1][0] not in " \n" or self.wait == " | ":
                self.chars += [(s, (False,) * 3) for s in self.wait]
            self.wait = ""
            first = len(self.chars) if first is None else first
            self.chars.append((c, style))
        return first

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "math" and not self.hidden:
            self.formula += 1
        elif tag in STYLES and not self.hidden and not self.formula:
            self.depth[STYLES[tag]] += 1
        elif tag == "br" and not self.hidden:
            self.wait = "\n"

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag == "math" and self.formula:
            self.formula -= 1
            if not self.formula:
                start = self.put("".join(self.source).strip(), (False,) * 3)
                self.source = []
                if start is not None:
                    self.math.append((start, len(self.chars)))
        elif self.formula:
            return
        elif tag in STYLES:
            self.depth[STYLES[tag]] = max(0, self.depth[STYLES[tag]] - 1)
        elif tag in BREAKS:
            self.wait = "\n"
        elif tag in CELLS and self.wait in ("", " "):
            self.wait = " | "

    def handle_data(self, data):
        if self.hidden:
            return
        if self.formula:
            self.source.append(data)
        else:
            self.put(data, tuple(d > 0 for d in self.depth))


def text_of(html: str | None) -> tuple[str, list[tuple[str, bool, bool, bool]], list[tuple[int, int]]]:
    """Text, runs (text, bold, italic, raised) that make it up, and its formula intervals; null is empty."""
    p = _Text()
    p.feed(html or "")
    p.close()
    runs = [("".join(c for c, _ in g), *style) for style, g in groupby(p.chars, key=lambda c: c[1])]
    return "".join(c for c, _ in p.chars), runs, p.math


def texts(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> (page_id, text, runs, math)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(i, *text_of(h)) for i, h in zip(pdf.page_id, pdf.html, strict=True)]
            out = [(i, t, [dict(zip(("t", "b", "i", "up"), r, strict=True)) for r in runs], [{"a": a, "b": b} for a, b in math]) for i, t, runs, math in rows]
            yield pd.DataFrame(out, columns=["page_id", "text", "runs", "math"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string, runs array<struct<t:string,b:boolean,i:boolean,up:boolean>>, math array<struct<a:int,b:int>>")

"""Text and tables out of XML and HTML, as Arrow-batched functions over the standard library's parsers."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "title", "row"}
_SILENT = {"script", "style", "head"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.tables, self.silent, self.row, self.cell = [], [], 0, None, None

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag in _BREAKS:
            self.text.append("\n")
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None and self.tables:
            self.tables[-1].append(self.row)
            self.row = None

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.cell is not None:
                self.cell.append(data)


def _read(source: str | None) -> _Reader:
    r = _Reader()
    r.feed(source or "")
    r.close()
    return r


@F.pandas_udf(T.StringType())
def html_text(source: pd.Series) -> pd.Series:
    """Visible text, a line per block, white space folded."""
    return pd.Series([None if s is None else "\n".join(x for x in (" ".join(y.split()) for y in "".join(_read(s).text).split("\n")) if x) for s in source], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_tables(source: pd.Series) -> pd.Series:
    """Each table as <table><row>cell, cell</row>...</table> text."""
    return pd.Series([["<table>" + "".join(f"<row>{', '.join(r)}</row>" for r in t) + "</table>" for t in _read(s).tables] for s in source], dtype=object)


def local(root: ET.Element) -> ET.Element:
    """The tree with local tag names."""
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
    return root


def article_text(source: str) -> str | None:
    """Text of the body (or raw text) without its bibliography; small capitals in upper case."""
    try:
        root = local(ET.fromstring(source))
    except ET.ParseError:
        return None
    body = next((e for e in root.iter() if e.tag in ("body", "rawtext")), None)
    if body is None:
        return None
    out: list[str] = []

    def walk(e: ET.Element, upper: bool) -> None:
        if e.tag in ("bibliography", "ref-list", "references"):
            return
        upper = upper or e.tag in ("sc", "small-caps")
        out.append("\n" if e.tag in _BREAKS or e.tag in ("para", "sec") else "")
        out.append((e.text or "").upper() if upper else e.text or "")
        for child in e:
            walk(child, upper)
            out.append((child.tail or "").upper() if upper else child.tail or "")

    walk(body, False)
    return "\n".join(x for x in (" ".join(y.split()) for y in "".join(out).split("\n")) if x)


@F.pandas_udf(T.StringType())
def xml_text(source: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else article_text(s) for s in source], dtype=object)


@F.pandas_udf(T.StringType())
def xml_abstract(source: pd.Series) -> pd.Series:
    def one(s):
        try:
            e = next((e for e in local(ET.fromstring(s)).iter() if e.tag == "abstract"), None)
        except (ET.ParseError, TypeError):
            return None
        return None if e is None else " ".join("".join(e.itertext()).split())

    return pd.Series([one(s) for s in source], dtype=object)


def _column(name: str | None) -> int | None:
    m = re.search(r"(\d+)", name or "")
    return int(m.group(1)) if m else None


def cals_to_html(source: str | None) -> tuple[str | None, str | None]:
    """(html, label) of a CALS table: spans by column names, row spans by morerows; (null, null) without a group or body."""
    try:
        root = local(ET.fromstring(source))
    except (ET.ParseError, TypeError):
        return None, None
    group = next((e for e in root.iter() if e.tag == "tgroup"), None)
    if group is None or group.find("tbody") is None:
        return None, None
    number = {s.get("colname"): k for k, s in enumerate(group.findall("colspec"), 1)}
    place = lambda n: number.get(n) or _column(n)
    rows = []
    for part, tag in (("thead", "th"), ("tbody", "td")):
        for row in group.findall(f"{part}/row"):
            cells = []
            for e in row.findall("entry"):
                lo, hi = place(e.get("namest")), place(e.get("nameend"))
                attrs = f' colspan="{hi - lo + 1}"' if lo and hi and hi > lo else ""
                attrs += f' rowspan="{int(e.get("morerows")) + 1}"' if (e.get("morerows") or "").isdigit() else ""
                attrs += f' align="{html.escape(e.get("align"))}"' if e.get("align") else ""
                cells.append(f"<{tag}{attrs}>{html.escape(' '.join(''.join(e.itertext()).split()))}</{tag}>")
            rows.append("<tr>" + "".join(cells) + "</tr>")
    label = " ".join(" ".join("".join(e.itertext()).split()) for e in root.iter() if e.tag in ("label", "caption", "title"))
    return "<table>" + "".join(rows) + "</table>", label or None


@F.pandas_udf(T.StructType([T.StructField("html", T.StringType()), T.StructField("label", T.StringType())]))
def cals_table(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cals_to_html(s) for s in source], columns=["html", "label"])

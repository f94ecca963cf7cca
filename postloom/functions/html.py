"""Text of HTML pages, as a tolerant parser sees it: an Arrow UDF over the tokens of the standard library's state machine."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements without content, elements whose text is no part of a page's text, and elements that keep white space.
VOID = set("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
SILENT = {"script", "style", "template", "rt", "rp"}
KEEPING = {"pre", "textarea"}
_SPACES = " \n\t\f\r"


class _Nodes(HTMLParser):
    """The text nodes of a page. A node is what stands between two tags, comments or declarations, with references replaced."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.nodes: list[str] = []
        self.data: list[str] = []
        self.open: list[str] = []
        self.count: dict[str, int] = {}

    def _inside(self, names: set[str]) -> bool:
        return any(self.count.get(n) for n in names)

    def flush(self) -> None:
        text, self.data = "".join(self.data), []
        if not text or self._inside(SILENT):
            return
        if not text.strip(_SPACES) and not self._inside(KEEPING):
            text = "\n" if "\n" in text else " "
        self.nodes.append(text)

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag not in VOID:
            self.open.append(tag)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_endtag(self, tag):
        self.flush()
        if not self.count.get(tag):
            return
        while True:
            last = self.open.pop()
            self.count[last] -= 1
            if last == tag:
                return

    def handle_data(self, data):
        self.data.append(data)

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[:1] in "xX" else int(name)
            self.data.append(bytes([code]).decode("windows-1252") if 128 <= code < 160 else chr(code))
        except UnicodeDecodeError:
            self.data.append(chr(code))
        except (ValueError, OverflowError):
            self.data.append("�")

    def handle_entityref(self, name):
        self.data.append(html5.get(f"{name};", f"&{name}"))

    def handle_comment(self, data):
        self.flush()

    def handle_decl(self, decl):
        self.flush()

    def handle_pi(self, data):
        self.flush()

    def unknown_decl(self, data):
        self.flush()
        if data.upper().startswith("CDATA["):
            self.data.append(data[len("CDATA[") :])
            self.flush()


def text_nodes(html: str) -> list[str]:
    """The text nodes of a page in order; scripts, styles, templates and ruby notes have none."""
    parser = _Nodes()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.nodes


def page_text(html: str | None) -> str:
    """The nodes joined by line ends; three line ends or more become two, and white space at the ends goes."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(text_nodes(html))).strip() if html else ""


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    """``page_text`` of a column; null has no text."""
    return html.map(page_text)


def bare_as_text(html: Column, *known: str) -> Column:
    """Pages whose references without a semicolon are text, but for those of the names ``known``. ``html_text`` alone reads all."""
    kept = "".join(rf"(?!{re.escape(name)}(?![A-Za-z0-9.-]))" for name in known)
    return F.regexp_replace(html, rf"&(?=#?[A-Za-z0-9][A-Za-z0-9.-]*+(?!;)){kept}", "&amp;")

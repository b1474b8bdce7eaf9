"""XML and HTML documents as long tables of sections, paragraphs, table cells and figures.

Nesting and row spans carry state through a document, so documents are parsed whole, one at a time, in Python workers;
malformed XML gives no rows but an error row. Everything after that is plain tables.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = "doc_id string, kind string, id string, parent string, title string, text string, row_index int, column_index int, row_span int, column_span int, is_header boolean, ord int"
FIELDS = [x.split(" ")[0] for x in PARTS.split(", ")]


def local(tag) -> str:
    return str(tag).rpartition("}")[2]


def flat(e: ET.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def child(e: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in e if local(c.tag) == name), None)


def span(raw: str | None) -> int:
    """A positive span, 1 if it reads as none."""
    return max(1, int(raw)) if raw and raw.strip().isdigit() else 1


def grid(rows: list[list[tuple[str, bool, int, int]]]) -> Iterator[tuple[int, int, int, int, bool, str]]:
    """Place cells (text, header, row span, column span) in a grid in which spans of earlier rows hold their places."""
    taken: set[tuple[int, int]] = set()
    for r, cells in enumerate(rows, 1):
        c = 1
        for text, header, down, across in cells:
            while (r, c) in taken:
                c += 1
            taken |= {(r + i, c + j) for i in range(down) for j in range(across)}
            yield r, c, down, across, header, text
            c += across


def _row(doc, kind, id_, parent=None, title=None, text=None, cell=(None,) * 5) -> tuple:
    return (doc, kind, id_, parent, title, text, *cell)


def _cells(doc: str, table_id: str, rows) -> Iterator[tuple]:
    for r, c, down, across, header, text in grid(rows):
        yield _row(doc, "cell", f"{table_id}.R{r}.C{c}", table_id, None, text, (r, c, down, across, header))


def xml_parts(doc: str, xml: str) -> Iterator[tuple]:
    """Sections with dotted numbers and joined titles, their paragraphs, tables with cells and footnotes, figures."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        yield _row(doc, "error", "E1", text=str(e))
        return
    for e in root.iter():
        if local(e.tag) in ("article-title", "title") and flat(e):
            yield _row(doc, "title", "TITLE", text=flat(e))
            break
    for e in root.iter():
        if local(e.tag) == "abstract":
            yield _row(doc, "abstract", "ABSTRACT", text=flat(e))
            break

    def sections(e: ET.Element, number: str, path: str) -> Iterator[tuple]:
        n = 0
        for s in e:
            if local(s.tag) not in ("sec", "div"):
                continue
            n += 1
            own = f"{number}.{n}" if number else f"S{n}"
            head = child(s, "title") if child(s, "title") is not None else child(s, "head")
            title = "/".join(x for x in (path, flat(head)) if x)
            yield _row(doc, "section", own, number or None, title)
            for k, p in enumerate((p for p in s if local(p.tag) == "p"), 1):
                yield _row(doc, "paragraph", f"{own}.p{k}", own, title, flat(p))
            yield from sections(s, own, title)

    for body in (e for e in root.iter() if local(e.tag) == "body"):
        yield from sections(body, "", "")
    tables = [e for e in root.iter() if local(e.tag) == "table-wrap" or (local(e.tag) == "figure" and e.get("type") == "table")]
    for k, t in enumerate(tables, 1):
        table_id = f"T{k}"
        caption = next((flat(c) for c in t.iter() if local(c.tag) in ("caption", "figDesc")), "")
        yield _row(doc, "table", table_id, title=caption)
        rows = []
        for tr in (e for e in t.iter() if local(e.tag) in ("tr", "row")):
            rows.append([(flat(c), local(c.tag) == "th" or c.get("role") == "label", span(c.get("rowspan") or c.get("rows")), span(c.get("colspan") or c.get("cols"))) for c in tr if local(c.tag) in ("td", "th", "cell")])
        yield from _cells(doc, table_id, rows)
        for f, note in enumerate((e for e in t.iter() if local(e.tag) == "fn"), 1):
            yield _row(doc, "footnote", f"{table_id}.F{f}", table_id, None, flat(note))
    k = 0
    for g in root.iter():
        if local(g.tag) == "fig" or (local(g.tag) == "figure" and g.get("type") != "table"):
            k += 1
            parts = dict.fromkeys(flat(c) for c in g.iter() if local(c.tag) in ("label", "caption", "head", "figDesc") and flat(c))  # U04: in order, once
            yield _row(doc, "figure", f"F{k}", text=" ".join(parts))
    named = ([next((flat(x) for x in c.iter() if local(x.tag) == n), "") for n in ("given-names", "surname")] for c in root.iter() if local(c.tag) == "contrib" and c.get("contrib-type") == "author")
    for k, name in enumerate((" ".join(filter(None, parts)) for parts in named if any(parts)), 1):  # X20
        yield _row(doc, "author", f"A{k}", text=name)


def author_lists(found: DataFrame) -> DataFrame:
    """doc_id and authors, the names ("given surname") in the document's order; documents without authors give no row."""
    own = found.where("kind = 'author'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("a"))
    return own.select("doc_id", F.col("a.text").alias("authors"))


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.blocks, self.tables, self.hidden, self.open, self.buffer = "", [], [], 0, None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in ("p", "h1", "h2", "h3", "title", "td", "th", "li"):
            self._close()
            self.open = tag
            if tag in ("td", "th") and self.tables and self.tables[-1]:
                a = dict(attrs)
                self.tables[-1][-1].append(["", tag == "th", span(a.get("rowspan")), span(a.get("colspan"))])
        if tag == "table":
            self.tables.append([])
        if tag == "tr" and self.tables:
            self.tables[-1].append([])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag == self.open:
            self._close()

    def handle_data(self, data):
        if self.open and not self.hidden:
            self.buffer.append(data)

    def _close(self):
        text = " ".join("".join(self.buffer).split())
        if self.open == "title":
            self.title = self.title or text
        elif self.open in ("td", "th") and self.tables and self.tables[-1] and self.tables[-1][-1]:
            self.tables[-1][-1][-1][0] = text
        elif self.open and text:
            self.blocks.append((self.open, text))
        self.open, self.buffer = None, []


def html_parts(doc: str, html: str) -> Iterator[tuple]:
    """The title, headings as sections, their paragraphs, and table cells of a page; bad markup is read as browsers do."""
    p = _Html()
    p.feed(html or "")
    p.close()
    p._close()
    yield _row(doc, "title", "TITLE", text=p.title)
    section = n = k = 0
    title = None
    for tag, text in p.blocks:
        if tag[0] == "h":
            section, k, title = section + 1, 0, text
            yield _row(doc, "section", f"S{section}", None, text)
        else:
            k += 1
            yield _row(doc, "paragraph", f"S{section}.p{k}", f"S{section}", title, text)
    for n, rows in enumerate(p.tables, 1):
        yield _row(doc, "table", f"T{n}")
        yield from _cells(doc, f"T{n}", [[tuple(c) for c in r] for r in rows])


def parts(docs: DataFrame, id_col: str, text_col: str, form: str = "xml") -> DataFrame:
    """All parts of all documents as rows of PARTS; ord counts a document's parts as they come."""
    parse = xml_parts if form == "xml" else html_parts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(*r, k) for doc, text in zip(f["doc"], f["text"], strict=True) for k, r in enumerate(parse(doc, text or ""))]
            out = pd.DataFrame(rows, columns=FIELDS)
            yield out.astype({c: "Int64" for c in ("row_index", "column_index", "row_span", "column_span", "ord")})

    return docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).mapInPandas(run, PARTS)


def document_text(found: DataFrame) -> DataFrame:
    """Title, abstract, section titles and paragraphs joined again, in order."""
    rank = F.when(F.col("kind") == "title", 0).when(F.col("kind") == "abstract", 1).otherwise(2)
    text = F.when(F.col("kind") == "section", F.col("title")).otherwise(F.col("text"))
    own = found.where(F.col("kind").isin("title", "abstract", "section", "paragraph")).select("doc_id", F.struct(rank.alias("r"), "ord", text.alias("t")).alias("s"))
    return own.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("doc_id", F.array_join(F.filter(F.transform("s", lambda x: x["t"]), lambda t: t != ""), "\n\n").alias("text"))

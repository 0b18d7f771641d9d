"""HTML pages: headline, host and links by expressions over the source text, table rows by its tags."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(c: Column) -> Column:
    """Text of a fragment: tags gone, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))


def headline(html: Column) -> Column:
    return F.regexp_extract(html, r"<h1[^>]*>([^<]*)</h1>", 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/:]+)", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1))


class _FirstTable(HTMLParser):
    """Rows of a page's first table: texts of its cells and the links in each row.

    Tags are read as tags wherever quotes, comments or scripts hold their
    signs; a table inside a cell is text and links of that cell, and unclosed
    rows and cells end where the next one begins.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.done, self.rows = 0, False, []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        if self.depth == 1 and tag == "tr":
            self._end_cell()
            self.rows.append(([], []))
        elif self.depth == 1 and tag in ("td", "th"):
            self._end_cell()
            if not self.rows:
                self.rows.append(([], []))
            self.cell = []
        elif self.cell is not None:
            self.cell.append(" ")
            if tag == "a":
                self.rows[-1][1].extend(v for k, v in attrs if k == "href" and v)

    def handle_endtag(self, tag):
        if self.done or not self.depth:
            return
        if self.depth == 1 and tag in ("td", "th", "tr", "table"):
            self._end_cell()
        elif self.cell is not None:
            self.cell.append(" ")
        if tag == "table":
            self.depth -= 1
            self.done = self.depth == 0

    def handle_data(self, data):
        if self.cell is not None and not self.done:
            self.cell.append(data)

    def _end_cell(self):
        if self.cell is not None:
            self.rows[-1][0].append(" ".join("".join(self.cell).split()))
            self.cell = None


def _rows_of(page: str | None, base: str | None):
    parser = _FirstTable()
    parser.feed(page or "")
    parser.close()
    parser._end_cell()
    for n, (cells, hrefs) in enumerate(parser.rows):
        if n:
            pdf = next((u for u in hrefs if u.lower().endswith(".pdf")), None)
            yield n, cells[0] if cells else None, cells[1] if len(cells) > 1 else None, None if pdf is None else urljoin(base or "", pdf)


def table_rows(pages: DataFrame, key: str, html: str, base: Column) -> DataFrame:
    """Rows of each page's first table after its header: number, title, first .pdf link resolved against ``base``, year.

    Pages are read tag by tag over Arrow batches, in time linear in their length.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [(i, *r) for i, (page, url) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())) for r in _rows_of(page, url)]
                cols = list(zip(*found)) if found else [()] * 5
                text = lambda k: pa.array(cols[k], pa.string())
                yield pa.record_batch([part.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), text(2), text(3), text(4)], names=[key, "row", "number", "title", "pdf_url"])

    rows = pages.select(key, html, base.cast("string").alias("__base")).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, row int, number string, title string, pdf_url string")
    return rows.withColumn("year", F.nullif(F.regexp_extract("number", r":\s*(\d{4})", 1), F.lit("")).cast("int"))


def term_filter(df: DataFrame, terms: list[str], *columns: str) -> DataFrame:
    """Rows where any term is in any column, whatever its case; no terms keep everything."""
    if not terms:
        return df
    both = F.lower(F.concat_ws("\n", *columns))
    cond = F.lit(False)
    for term in terms:
        cond = cond | F.contains(both, F.lit(term.lower()))
    return df.filter(cond)

"""Document structure: Markdown and HTML into sections, blocks and cells; checks of their integrity; stable ids."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygrid.common import bound_batches, materialize

HEADING, FENCE = r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", r"^[ \t]*(```+|~~~+)"
_HEADING, _FENCE = re.compile(HEADING), re.compile(FENCE)


def fence_states(lines: list[str]) -> list[tuple[bool, bool]]:
    """For every line whether it is a fence or inside one, and whether it closes one.

    A fence is closed by a line of its own marker that is at least as long.
    """
    out, mark = [], ""
    for line in lines:
        found = _FENCE.match(line)
        closes = bool(found and mark and found[1][0] == mark[0] and len(found[1]) >= len(mark))
        out.append((bool(found or mark), closes))
        if closes:
            mark = ""
        elif found and not mark:
            mark = found[1]
    return out


def _by_document(docs: DataFrame, rows_of, columns: str) -> DataFrame:
    """Rows (doc_id, columns) that ``rows_of`` makes of each text's lines, document by document, without a shuffle; null texts have none."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                out += [(doc_id, *r) for r in rows_of((text.as_py() or "").splitlines())]
                if len(out) >= 4096:
                    yield made(out, batch.schema.field(0).type)
                    out = []
            yield made(out, batch.schema.field(0).type)

    def made(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        types = [id_type, *(_ARROW[t] for _, t in fields)]
        cells = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], ["doc_id", *(n for n, _ in fields)])

    fields = [tuple(c.strip().split(" ")) for c in columns.split(",")]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {columns}")


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 1, line, fenced): ``fenced`` lines are fences or between them."""
    return _by_document(docs, lambda lines: [(i, line, f) for i, (line, (f, _)) in enumerate(zip(lines, fence_states(lines), strict=True), 1)], "line_no int, line string, fenced boolean")


def sections_of(lines: list[str]) -> Iterator[tuple[int, list[str], int, int, int, str]]:
    """(number, heading path, level, first line, last line, content) of the sections that aren't blank."""
    above: list[tuple[int, str]] = []
    heads = [0]  # first lines of the sections
    found: list[tuple[int, tuple[str, ...]]] = [(0, ())]
    for i, (line, (fenced, _)) in enumerate(zip(lines, fence_states(lines), strict=True)):
        head = None if fenced else _HEADING.match(line)
        if head:
            level = len(head[1])
            above = [*(x for x in above if x[0] < level), (level, head[2].strip())]
            heads.append(i)
            found.append((level, tuple(t for _, t in above)))
    for number, ((level, path), lo, hi) in enumerate(zip(found, heads, [*heads[1:], len(lines)], strict=True)):
        content = "\n".join(lines[lo:hi]).strip("\n")
        if content.strip():
            yield number, list(path), level, lo + 1, hi, content


def md_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, heading_path, level, start_line, end_line, content) of Markdown texts (doc_id, text).

    Sections start at ATX headings outside code fences; the path holds the headings above; blank sections are left out, and
    empty lines around a content are cut.
    """
    return _by_document(docs, sections_of, "section_no long, heading_path array<string>, level int, start_line int, end_line int, content string")


def md_frontmatter(docs: DataFrame) -> DataFrame:
    """(doc_id, frontmatter_json, body_start, error): YAML between two ``---`` lines at the start; body_start is a 1-based line."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        def parse(text: str | None) -> tuple:
            lines = (text or "").split("\n")
            if lines[0].strip() != "---":
                return None, 1, None
            end = next((i for i, line in enumerate(lines[1:], 1) if line.strip() == "---"), None)
            if end is None:
                return None, 1, "unclosed"
            try:
                value = yaml.safe_load("\n".join(lines[1:end]))
            except yaml.YAMLError:
                return None, end + 2, "invalid"
            if value is not None and not isinstance(value, dict):
                return None, end + 2, "not_a_mapping"
            return json.dumps(value or {}, default=str, sort_keys=True, ensure_ascii=False), end + 2, None

        for f in frames:
            rows = [parse(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "frontmatter_json": [r[0] for r in rows], "body_start": [r[1] for r in rows], "error": [r[2] for r in rows]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, frontmatter_json string, body_start long, error string")


def doc_title(front: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, title): the front matter's, else the last element of the first heading path that isn't empty."""
    first = sections.where(F.size("heading_path") > 0).groupBy("doc_id").agg(F.min_by(F.element_at("heading_path", -1), "section_no").alias("heading"))
    return front.join(first, "doc_id", "left").select("doc_id", F.coalesce(F.get_json_object("frontmatter_json", "$.title"), "heading").alias("title"))


class _HtmlBlocks(HTMLParser):
    skip = {"script", "style", "nav", "footer", "noscript", "template"}
    kinds = {"p": "paragraph", "li": "list_item", "td": "cell", "th": "cell", "figcaption": "figure", **{f"h{i}": "heading" for i in range(1, 7)}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.title, self.hidden, self.tag, self.parts = [], None, 0, None, []
        self.section, self.row, self.col, self.in_title = -1, -1, -1, False

    def close_block(self):
        text = " ".join("".join(self.parts).split())
        if self.tag and text:
            kind, n = self.kinds[self.tag], len(self.rows)
            level = int(self.tag[1]) if kind == "heading" else None
            if kind == "heading":
                self.section = n
            self.rows.append((n, kind, level, text, self.section, self.row if kind == "cell" else None, self.col if kind == "cell" else None))
        self.tag, self.parts = None, []

    def handle_starttag(self, tag, attrs):
        if tag in self.skip:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag in ("table", "tr"):
            self.close_block()
            self.row, self.col = (-1 if tag == "table" else self.row + 1), -1
        elif tag == "br" and self.tag:
            self.parts.append(" ")
        elif tag == "img" and not self.hidden:
            self.close_block()
            self.rows.append((len(self.rows), "figure", None, dict(attrs).get("alt") or "", self.section, None, None))
        if tag in self.kinds and not self.hidden:
            self.close_block()
            self.col += tag in ("td", "th")
            self.tag = tag

    def handle_endtag(self, tag):
        if tag in self.skip:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == self.tag:
            self.close_block()

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        elif self.tag and not self.hidden:
            self.parts.append(data)


def html_rows(html: str | None) -> tuple[str | None, list[tuple]]:
    """The title of a page and its blocks: (ordinal, kind, level, text, section, row, col)."""
    parser = _HtmlBlocks()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return parser.title, parser.rows


_HTML_SCHEMA = "page_id long, ordinal long, kind string, level int, text string, section long, row int, col int, title string, error string"


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of HTML pages in reading order: heading, paragraph, list_item, cell, figure; one error row for a broken page.

    An open paragraph closes at the next block; script, style and navigation are skipped; a void element needs no end. ``section``
    is the ordinal of the heading that a block is under, ``row`` and ``col`` place a cell in its table.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for page_id, html in zip(f["page_id"], f["html"], strict=True):
                try:
                    title, rows = html_rows(html)
                    out += [(page_id, *r, title, None) for r in rows]
                except (AssertionError, ValueError) as e:
                    out.append((page_id, 0, "error", None, None, None, None, None, None, type(e).__name__))
            names = [c.split(" ")[0] for c in _HTML_SCHEMA.split(", ")]
            frame = pd.DataFrame(out, columns=names)
            for c in ("level", "row", "col"):
                frame[c] = pd.array(frame[c], "Int32")
            frame["section"] = pd.array(frame["section"], "Int64")
            yield frame

    return pages.select("page_id", "html").mapInPandas(run, _HTML_SCHEMA)


def block_types(blocks: DataFrame, col: str = "text") -> DataFrame:
    """Adds block_type (by the first line) and block_labels (all that apply)."""
    first = F.substring_index(F.trim(col), "\n", 1)
    any_line = lambda p: F.exists(F.split(col, "\n"), lambda x: x.rlike(p))
    pipes = any_line(r"^[^|\n]*\|[^|\n]*\|")
    kind = F.when(first.rlike(r"^#{1,6} "), "heading").when(first.rlike(r"^(```|~~~)"), "code").when(first.rlike(r"^([-*+]|[0-9]+[.)]) "), "list").when(pipes, "table").otherwise("paragraph")
    labels = F.array_compact(F.array(F.when(any_line(r"^[ ]*([-*+]|[0-9]+[.)]) "), "list"), F.when(pipes, "table"), F.when(any_line(r"^(```|~~~)"), "code"), F.when(any_line(r"^>"), "quote")))
    return blocks.withColumns({"block_type": kind, "block_labels": labels})


def blocks_of(lines: list[str]) -> Iterator[tuple[int, int, int, str]]:
    """(number from 1, first line, last line, text) of runs of lines between blank ones; fenced code stays whole, and its end ends a block."""
    number, first = 0, None
    states = [*fence_states(lines), (False, False)]
    for i, (line, (fenced, closes)) in enumerate(zip([*lines, ""], states, strict=True)):
        blank = not fenced and not line.strip()
        if not blank and first is None:
            first = i
        if first is not None and (blank or closes or i == len(lines)):
            last = i if closes else i - 1
            number += 1
            yield number, first + 1, last + 1, "\n".join(lines[first : last + 1]).strip("\n")
            first = None


def md_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no, start_line, end_line, text): runs of lines between blank ones; fenced code stays whole."""
    return _by_document(docs, blocks_of, "block_no long, start_line int, end_line int, text string")


def blocks_to_sections(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, text, start_line, end_line): blocks in reading order by section; unknown sections go to the root (null)."""
    known = sections.select("doc_id", "section_id", F.lit(True).alias("known"))
    j = blocks.join(known, ["doc_id", "section_id"], "left").withColumn("section_id", F.when(F.col("known"), F.col("section_id")))
    g = j.groupBy("doc_id", "section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return g.where("text <> ''")


def ir_integrity(sections: DataFrame, blocks: DataFrame, cells: DataFrame, max_depth: int = 32) -> DataFrame:
    """Issues (doc_id, issue, item_id): duplicate ids, missing parents or sections, negative ordinals, cycles, bad spans, overlapping cells.

    ``sections``: doc_id, section_id, parent_id; ``blocks``: doc_id, block_id, section_id, ordinal, start_line, end_line;
    ``cells``: doc_id, table_id, row, col, row_span, col_span, n_rows, n_cols.
    """
    ids = sections.select("doc_id", F.col("section_id").alias("id")).distinct()

    def found(df: DataFrame, issue: str, item: str) -> DataFrame:
        return df.select("doc_id", F.lit(issue).alias("issue"), F.col(item).cast("string").alias("item_id"))

    out = [
        found(sections.groupBy("doc_id", "section_id").count().where("count > 1"), "duplicate_section", "section_id"), found(blocks.groupBy("doc_id", "block_id").count().where("count > 1"), "duplicate_block", "block_id"),
        found(sections.where("parent_id is not null").join(ids.withColumnRenamed("id", "parent_id"), ["doc_id", "parent_id"], "left_anti"), "missing_parent", "section_id"),
        found(blocks.where("section_id is not null").join(ids.withColumnRenamed("id", "section_id"), ["doc_id", "section_id"], "left_anti"), "missing_section", "block_id"),
        found(blocks.where("ordinal < 0"), "negative_ordinal", "block_id"), found(blocks.where("start_line > end_line"), "bad_span", "block_id"),
        found(cells.where("row < 0 or col < 0 or row + row_span > n_rows or col + col_span > n_cols"), "cell_out_of_range", "table_id"),
    ]
    grid = cells.select("doc_id", "table_id", F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1)).alias("r"), "col", "col_span").select("doc_id", "table_id", "r", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)).alias("c"))
    out.append(found(grid.groupBy("doc_id", "table_id", "r", "c").count().where("count > 1").select("doc_id", "table_id").distinct(), "cell_overlap", "table_id"))
    # cycles: who still has an ancestor after max_depth doublings of the parent step
    step = materialize(sections.where("parent_id is not null").select("doc_id", F.col("section_id").alias("node"), F.col("parent_id").alias("up")).distinct(), "ir-parents")
    reach, depth = step, 1
    while depth < max_depth:
        hop = reach.select("doc_id", F.col("node").alias("up"), F.col("up").alias("far"))
        reach = materialize(reach.join(hop, ["doc_id", "up"]).select("doc_id", "node", F.col("far").alias("up")).distinct(), "ir-parents")
        depth *= 2
    out.append(found(reach.select("doc_id", "node").distinct(), "cycle", "node"))
    return reduce(DataFrame.unionByName, out)


def stable_ids(df: DataFrame, cols: Sequence[str], prefix: str = "id", out: str = "stable_id") -> DataFrame:
    """Adds a deterministic id of the named columns, taken in alphabetical order; null and '' differ."""
    parts: list[Column] = [F.coalesce(F.concat(F.lit(f"{c}="), F.col(c).cast("string")), F.lit(f"{c}!")) for c in sorted(cols)]
    return df.withColumn(out, F.concat(F.lit(f"{prefix}_"), F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(32))))

"""Chunking: packing of sections and blocks under size limits, splitting, overlap, enrichment, hierarchies and inventories.

Packing is a fold with resets, so it runs per document over that document's own rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygrid.operators.structure import blocks_of, fence_states

TARGET, MAXIMUM = 1200, 1800
_CHUNK = "doc_id long, chunk_index int, heading_path array<string>, content string, start_line int, end_line int, content_hash string"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


#: How good a place for a cut white space is, best first.
PARAGRAPH, ITEM, SENTENCE, ANYWHERE = range(4)
_GAP, _ITEM_MARK = re.compile(r"\s+"), re.compile(r"(?:[-*+]|\d+\.)(?:\s|$)")
_SENTENCE_ENDS = frozenset(".!?。！？")


def cut_places(text: str) -> list[tuple[int, int, int]]:
    """(rank, begin, end) of every run of white space at which a text may be cut.

    A run that holds an empty line parts paragraphs, one that ends a line before a list mark parts items, and one after a sentence's end parts sentences.
    """
    found = []
    for m in _GAP.finditer(text):
        if "\n\n" in m[0]:
            found.append((PARAGRAPH, *m.span()))
        elif m[0][-1] == "\n" and _ITEM_MARK.match(text, m.end()):
            found.append((ITEM, *m.span()))
        elif m.start() and text[m.start() - 1] in _SENTENCE_ENDS:
            found.append((SENTENCE, *m.span()))
    return found


class Filling:
    """Texts put together with empty lines between them, up to a size, and the lines they come from."""

    def __init__(self, maximum: int):
        self.maximum, self.texts, self.size, self.label = maximum, [], 0, None
        self.first = self.last = None

    def __len__(self) -> int:
        return self.size

    def fits(self, text: str) -> bool:
        return not self.texts or self.size + 2 + len(text) <= self.maximum

    def add(self, text: str, first: int | None = None, last: int | None = None) -> None:
        self.size += len(text) + (2 if self.texts else 0)
        self.first = first if not self.texts else self.first
        self.last = last
        self.texts.append(text)

    def take(self) -> tuple[str, int | None, int | None]:
        """What has come together; the next text begins anew."""
        out = ("\n\n".join(self.texts), self.first, self.last)
        self.__init__(self.maximum)
        return out


def split_text(text: str, maximum: int) -> list[str]:
    """A text cut to pieces of at most ``maximum`` characters: at paragraphs, what is too long at list items, then at sentences, then anywhere.

    Neighbours that a cut of one rank parts come together again while they fit. Code between fences stays whole, whatever its length.
    """
    if len(text) <= maximum or is_code(text):
        return [text]
    places = cut_places(text)

    def pieces(lo: int, hi: int, rank: int) -> Iterator[str]:
        if hi - lo <= maximum:
            yield text[lo:hi]
        elif rank == ANYWHERE:
            yield from (text[i : min(i + maximum, hi)] for i in range(lo, hi, maximum))
        else:
            inner = [(b, e) for r, b, e in places if r <= rank and lo < b and e < hi]
            spans = list(zip([lo, *(e for _, e in inner)], [*(b for b, _ in inner), hi], strict=True))
            if len(spans) == 1:
                yield from pieces(lo, hi, rank + 1)
                return
            held = Filling(maximum)
            for b, e in spans:
                if len(held) and (e - b > maximum or not held.fits(text[b:e])):
                    yield held.take()[0]
                if e - b > maximum:
                    yield from pieces(b, e, rank + 1)
                else:
                    held.add(text[b:e])
            if len(held):
                yield held.take()[0]

    return list(pieces(len(text) - len(text.lstrip()), len(text.rstrip()), PARAGRAPH))


def is_code(text: str) -> bool:
    """Is it a fenced block of code, from its first line to a closing fence?"""
    states = list(fence_states(text.strip().splitlines()))
    return bool(states) and states[0][0] and any(closes for _, closes in states)


def split_section(content: str, first_line: int, maximum: int) -> list[tuple[str, int | None, int | None]]:
    """(text, first line, last line) of the pieces of a long section: its blocks, the long ones split, put together again up to ``maximum``.

    Long code stays whole and alone. A piece that begins or ends inside a block has no lines.
    """
    out, held = [], Filling(maximum)
    for _, lo, hi, block in blocks_of(content.splitlines()):
        parts = split_text(block, maximum)
        for i, part in enumerate(parts):
            alone = len(part) > maximum
            if len(held) and (alone or not held.fits(part.strip())):
                out.append(held.take())
            held.add(part if alone else part.strip(), first_line + lo - 1 if i == 0 else None, first_line + hi - 1 if i == len(parts) - 1 else None)
            if alone:
                out.append(held.take())
    if len(held):
        out.append(held.take())
    return [(t, a, b) if a is not None and b is not None else (t, None, None) for t, a, b in out]


def fold_sections(sections: list[tuple], target: int, maximum: int) -> list[tuple]:
    """(heading path, text, first line, last line) of the chunks of sections (content, heading path, first line, last line) in order."""
    out, held = [], Filling(maximum)

    def close() -> None:
        if len(held):
            label = held.label
            out.append((label, *held.take()))

    for content, path, first, last in sections:
        text = content.strip()
        if not text:
            continue
        over = not held.fits(text)
        if over:
            close()
        if len(text) > maximum:
            close()
            out += [(path, *piece) for piece in split_section(content, first, maximum)]
            continue
        held.add(text, first, last)
        held.label = held.label or path
        if len(held) >= target and not over:  # what didn't fit before stays open
            close()
    close()
    return [(p, t.replace("\r\n", "\n").replace("\r", "\n").strip(), a, b) for p, t, a, b in out if t.strip()]


def split_oversized(sections: DataFrame, maximum: int = MAXIMUM) -> DataFrame:
    """``sections`` (with content) as pieces of at most ``maximum`` characters: adds piece_no, and content is the piece."""

    @F.pandas_udf("array<string>")
    def pieces(column: pd.Series) -> pd.Series:
        return column.map(lambda t: split_text(t or "", maximum))

    cols = [c for c in sections.columns if c != "content"]
    return sections.select(*cols, F.posexplode(pieces("content")).alias("piece_no", "content"))


def _pack(rows: list[tuple], target: int, maximum: int, boundary=None) -> list[list[tuple]]:
    """Consecutive rows (text at 0) in groups: closed at ``target``, never over ``maximum`` unless one row is."""
    groups: list[list[tuple]] = []
    size = 0
    for row in rows:
        n = len(row[0])
        if groups and groups[-1] and size < target and size + 2 + n <= maximum and not (boundary and boundary(groups[-1][-1], row)):
            groups[-1].append(row)
            size += 2 + n
        else:
            groups.append([row])
            size = n
    return groups


def chunk_sections(sections: DataFrame, target: int = TARGET, maximum: int = MAXIMUM) -> DataFrame:
    """Chunks of consecutive sections (doc_id, section_no, heading_path, content, start_line, end_line) of each document.

    Sections are joined by a blank line until the chunk has ``target`` characters, and never beyond ``maximum``. A longer section is
    split by its blocks, list items and sentences (``split_section``); only code in fences may be longer. The heading path is
    that of the first section that has one. A document's sections come together in one row, so a document is what a task holds.
    """
    row = F.sort_array(F.collect_list(F.struct("section_no", "content", "heading_path", "start_line", "end_line")))
    held = sections.groupBy("doc_id").agg(row.alias("s"))
    names = [c.split(" ")[0] for c in _CHUNK.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = [(s["content"] or "", s["heading_path"] or [], s["start_line"], s["end_line"]) for s in parts.as_py()]
                out += [(doc_id, i, list(p), t, a, b, _digest(t)) for i, (p, t, a, b) in enumerate(fold_sections(own, target, maximum))]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return held.mapInArrow(run, _CHUNK)


def chunk_blocks(blocks: DataFrame, target: int = TARGET, maximum: int = MAXIMUM, respect_sections: bool = True) -> DataFrame:
    """Chunks of blocks (doc_id, block_id, ordinal, section_id, block_type, text, page): tables and code stay whole, long text is split.

    Returns provenance: block ids, pages, whether the chunk crosses sections.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in g.sort_values("ordinal").itertuples():
            parts = [r.text] if r.block_type in ("table", "code") else split_text(r.text, maximum)
            rows += [(p, r.block_id, r.section_id, r.page) for p in parts]
        out = []
        for i, group in enumerate(_pack(rows, target, maximum, (lambda a, b: a[2] != b[2]) if respect_sections else None)):
            text = "\n\n".join(r[0] for r in group)
            out.append((g["doc_id"].iloc[0], i, text, list(dict.fromkeys(r[1] for r in group)), sorted({r[3] for r in group}), len({r[2] for r in group}) > 1))
        return pd.DataFrame(out, columns=["doc_id", "chunk_index", "content", "block_ids", "pages", "cross_section"])

    return blocks.groupBy("doc_id").applyInPandas(fold, "doc_id long, chunk_index int, content string, block_ids array<long>, pages array<long>, cross_section boolean")


def heading_enrich(chunks: DataFrame, budget: int = 120) -> DataFrame:
    """Adds inline_text (path before the content) and context: distinct headings, the most specific first, within ``budget`` characters."""
    path = F.array_distinct("heading_path")
    picked = F.aggregate(F.reverse(path), F.array().cast("array<string>"), lambda acc, h: F.when(F.length(F.array_join(F.array_append(acc, h), " > ")) <= budget, F.array_append(acc, h)).otherwise(acc))
    inline = F.when(F.size("heading_path") > 0, F.concat(F.array_join("heading_path", " > "), F.lit("\n\n"), F.col("content"))).otherwise(F.col("content"))
    return chunks.withColumns({"inline_text": inline, "context": F.array_join(picked, " > ")})


#: Variant: target, maximum, by structure, characters of overlap (parameters).
VARIANTS = (("base", 1200, 1800, False, 0), ("structure", 900, 1200, True, 0), ("leaf", 560, 780, True, 0), ("leaf_overlap", 560, 780, True, 96))
_LIST, _TABLE = re.compile(r"[ \t]*([-*+]|\d+[.)])[ \t]"), re.compile(r"[^|\n]*\|[^|\n]*\|")


def _whole(block: str) -> bool:
    """Is it code, a list or a table, that a variant by structure doesn't cut?"""
    lines = block.split("\n")
    return is_code(block) or bool(_LIST.match(lines[0])) or all(_TABLE.match(x) for x in lines)


def fold_structure(sections: list[tuple], target: int, maximum: int, overlap: int = 0) -> list[tuple]:
    """(heading path, text, first line, last line) of chunks by structure: none crosses a heading, and lists, tables and code stay whole.

    With ``overlap`` a chunk begins with the last characters of the one before under the same heading, from a word's start.
    """
    out: list[tuple] = []
    held: list[tuple] = []

    def flush(path) -> None:
        if held:
            out.append((path, "\n\n".join(t for t, _, _ in held), held[0][1], held[-1][2]))
            held.clear()

    size, above = 0, None
    for content, path, first, _ in sections:
        if above != path:
            flush(above)
            above = path
        for _, lo, hi, block in blocks_of(content.splitlines()):
            for part in [block] if len(block) <= maximum or _whole(block) else split_text(block, maximum):
                if held and size + 2 + len(part) > maximum:
                    flush(path)
                size = size + 2 + len(part) if held else len(part)
                held.append((part, first + lo - 1, first + hi - 1))
                if size >= target:
                    flush(path)
    flush(above)
    if not overlap:
        return out
    tails = [None, *((p, t if len(t) <= overlap else re.sub(r"^\S*\s+", "", t[-overlap:]), a) for p, t, a, _ in out)]
    return [(p, f"{before[1]}\n{t}", min(a, before[2]), b) if before and before[0] == p and before[1] else (p, t, a, b) for before, (p, t, a, b) in zip(tails, out, strict=False)]


def chunk_variants(sections: DataFrame, variants=VARIANTS) -> DataFrame:
    """All variants in one pass over each document's sections: (variant, doc_id, chunk_index, content, start_line, end_line)."""
    row = F.sort_array(F.collect_list(F.struct("section_no", "content", "heading_path", "start_line", "end_line")))
    held = sections.groupBy("doc_id").agg(row.alias("s"))
    names = ["variant", "doc_id", "chunk_index", "content", "start_line", "end_line"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = [(s["content"] or "", s["heading_path"] or [], s["start_line"], s["end_line"]) for s in parts.as_py()]
                for name, target, maximum, by_structure, overlap in variants:
                    chunks = fold_structure(own, target, maximum, overlap) if by_structure else fold_sections(own, target, maximum)
                    out += [(name, doc_id, i, t, a, b) for i, (_, t, a, b) in enumerate(chunks)]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return held.mapInArrow(run, "variant string, doc_id long, chunk_index int, content string, start_line int, end_line int")


def chunk_overlap(chunks: DataFrame, n: int = 100) -> DataFrame:
    """Chunks (doc_id, heading_path, chunk_index, content, start_line, end_line) with the last ``n`` characters of the one before in their section, from a word's start."""
    w = Window.partitionBy("doc_id", "heading_path").orderBy("chunk_index")
    before = F.lag("content").over(w)
    tail = F.when(F.length(before) <= n, before).otherwise(F.regexp_replace(F.right(before, F.lit(n)), r"^[^ \n]*[ \n]+", ""))
    out = chunks.withColumns({"overlap": F.coalesce(tail, F.lit("")), "start_line": F.least("start_line", F.coalesce(F.lag("end_line").over(w), F.col("start_line")))})
    return out.withColumn("content", F.when(F.col("overlap") != "", F.concat("overlap", F.lit("\n"), "content")).otherwise(F.col("content")))


def parent_records(chunks: DataFrame, maximum: int = 4000) -> DataFrame:
    """(doc_id, parent_path, child_ids, n_children, text_sha, n_chars): chunks (chunk_id, ...) under the first two headings."""
    g = chunks.groupBy("doc_id", F.slice("heading_path", 1, 2).alias("parent_path")).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content"))).alias("c"))
    text = F.left(F.array_join(F.transform("c", lambda x: x["content"]), "\n\n"), F.lit(maximum))
    return g.select("doc_id", "parent_path", F.transform("c", lambda x: x["chunk_id"]).alias("child_ids"), F.size("c").alias("n_children"), F.sha2(text, 256).alias("text_sha"), F.length(text).alias("n_chars"))


def hierarchy_index(chunks: DataFrame) -> DataFrame:
    """(doc_id, node, parent, kind, orphan): documents, every prefix of a heading path, and chunks; parents that don't exist are orphans."""
    sep = " > "
    docs = chunks.select("doc_id", F.lit("").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("document").alias("kind")).distinct()
    depth = F.explode(F.when(F.size("heading_path") > 0, F.sequence(F.lit(1), F.size("heading_path"))).otherwise(F.array().cast("array<int>")))
    paths = chunks.select("doc_id", "heading_path", depth.alias("k"))
    sections = paths.select("doc_id", F.array_join(F.slice("heading_path", 1, F.col("k")), sep).alias("node"), F.array_join(F.slice("heading_path", 1, F.col("k") - 1), sep).alias("parent"), F.lit("section").alias("kind")).distinct()
    leaves = chunks.select("doc_id", F.concat(F.lit("#"), F.col("chunk_index").cast("string")).alias("node"), F.array_join("heading_path", sep).alias("parent"), F.lit("chunk").alias("kind"))
    nodes = docs.unionByName(sections).unionByName(leaves)
    known = docs.unionByName(sections).select("doc_id", F.col("node").alias("parent"), F.lit(False).alias("known"))
    return nodes.join(known, ["doc_id", "parent"], "left").select("doc_id", "node", "parent", "kind", (F.col("parent").isNotNull() & F.col("known").isNull()).alias("orphan"))


def chunk_inventory(chunks: DataFrame) -> DataFrame:
    """One row for each variant (variant, doc_id, content): counts, lengths, chunks per document, share of repeated texts.

    Texts are told apart by length and SHA-256 and counted in each task first, so a digest is shuffled for each, not the text; percentiles
    are looked up in the counts of the different lengths.
    """
    per = chunks.groupBy("variant", "doc_id").agg(F.count("*").alias("k")).groupBy("variant").agg(F.count("*").alias("n_documents"), F.avg("k").alias("mean_per_document"), F.max("k").alias("max_per_document"), F.avg((F.col("k") == 1).cast("int")).alias("single_share"))
    texts = chunks.groupBy("variant", F.length("content").alias("n"), F.unhex(F.sha2("content", 256)).alias("digest")).agg(F.count("*").alias("k"))
    lengths = texts.groupBy("variant", "n").agg(F.sum("k").alias("k"), F.count("digest").alias("different"))
    known, w = F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0), Window.partitionBy("variant")
    ranked = lengths.withColumns({"upto": F.sum(known).over(w.orderBy("n")), "all": F.sum(known).over(w)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("all") * q), F.lit(1)), F.col("n")))
    out = ranked.groupBy("variant").agg(
        F.sum("k").alias("n_chunks"), F.when(F.max("all") > 0, F.sum(F.col("n") * F.col("k")) / F.max("all")).alias("mean_length"), at(0.5).alias("p50_length"), at(0.95).alias("p95_length"), F.max("n").alias("max_length"), (1 - F.sum("different") / F.sum("k")).alias("repeated_share"))
    return out.join(per, "variant")

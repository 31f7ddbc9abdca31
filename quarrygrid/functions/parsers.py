"""A registry of document parsers by representation, usable as a table function in SQL and over a whole DataFrame.

A parser is a function from a text to rows (ordinal, kind, level, text) in reading order. Register one's own with
``register_parser`` before ``register``; unknown representations give one row of kind ``error``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quarrygrid.operators.structure import HEADING, blocks_of, html_rows

BLOCK_SCHEMA = "ordinal int, kind string, level int, text string"
Parser = Callable[[str], Iterable[tuple]]


def parse_markdown(text: str) -> Iterator[tuple]:
    """Headings, fenced code and paragraphs."""
    ordinal = 0
    for _, _, _, block in blocks_of(text.splitlines()):
        lines = block.split("\n")
        while lines and (head := re.match(HEADING, lines[0])):
            yield ordinal, "heading", len(head[1]), head[2].strip()
            ordinal, lines = ordinal + 1, lines[1:]
        rest = "\n".join(lines).strip("\n")
        if rest:
            yield ordinal, "code" if re.match(r"[ \t]*(```|~~~)", rest) else "paragraph", None, rest
            ordinal += 1


def parse_html(text: str) -> Iterator[tuple]:
    """The blocks of ``html_blocks``."""
    for ordinal, kind, level, block, *_ in html_rows(text)[1]:
        yield ordinal, kind, level, block


def parse_tex(text: str) -> Iterator[tuple]:
    """Sectioning commands as headings; blank lines part paragraphs; comments are left out."""
    levels = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4}
    ordinal = 0
    for block in re.split(r"\n\s*\n", re.sub(r"(?m)(?<!\\)%.*$", "", text)):
        for part in re.split(r"(\\(?:part|chapter|(?:sub)*section)\*?\{[^{}]*\})", block):
            head = re.fullmatch(r"\\(\w+)\*?\{([^{}]*)\}", part.strip())
            if head and head[1] in levels:
                yield ordinal, "heading", levels[head[1]], head[2]
            elif part.strip():
                yield ordinal, "paragraph", None, part.strip()
            else:
                continue
            ordinal += 1


PARSERS: dict[str, Parser] = {"markdown": parse_markdown, "html": parse_html, "tex": parse_tex}
_ALIASES = {"md": "markdown", "htm": "html", "xhtml": "html", "latex": "tex"}


def register_parser(representation: str, parser: Parser) -> None:
    PARSERS[representation.lower()] = parser


def supported_representations() -> tuple[str, ...]:
    return tuple(sorted(PARSERS))


def table_function(parsers: dict[str, Parser] | None = None):
    """The UDTF (representation, content) -> block rows of the given parsers, those registered now by default; null content has no rows."""
    known = dict(PARSERS if parsers is None else parsers)

    @udtf(returnType=BLOCK_SCHEMA)
    class ParseBlocks:
        def eval(self, representation: str, content: str):
            name = (representation or "").strip().lower().lstrip(".")
            parser = known.get(_ALIASES.get(name, name))
            if parser is None:
                yield 0, "error", None, f"unsupported representation: {representation}"
            elif content is not None:
                yield from parser(content)

    return ParseBlocks


def register(spark: SparkSession, name: str = "parse_blocks") -> None:
    """Make the table function known to SQL: ``SELECT * FROM docs, LATERAL parse_blocks(kind, text)``."""
    spark.udtf.register(name, table_function())


def parse_blocks(docs: DataFrame, representation: str = "representation", content: str = "text") -> DataFrame:
    """``docs`` with the rows of each document's blocks (ordinal, kind, level, text as ``block_text``); the content column is dropped."""
    found = table_function()(F.col(representation).outer(), F.col(content).outer())
    names = [c if c != content else "__content" for c in docs.columns]
    return docs.lateralJoin(found).toDF(*names, "ordinal", "kind", "level", "block_text").drop("__content")

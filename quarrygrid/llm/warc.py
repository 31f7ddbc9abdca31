"""WARC archives: writing pages with revisit records, and reading archives in splits.

Writing is a text write whose line separator is the end of a record, so Spark's commit protocol holds. Reading splits the
files at every record magic, also inside payloads. Each task turns the pieces of its file block into candidate records
with the offset of the successor that their headers promise; inside a block the chains are followed at once, between
blocks by pointer jumping from the start of each file. Only records that the chain from the start reaches are kept, so
a magic inside a payload starts no record, and its payload is put together again from the pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygrid.common import bound_batches, drop_scratch, hot_limit, materialize, scratch_path, table

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
REVISIT_BYTES = 100
#: Records in a file, at most: what one file may add to a window.
FILE_RECORDS = 50_000
#: Groups of equal payloads (some 100 bytes each, 20 MB together) up to which they are broadcast. Beyond, pages are shuffled by digest,
#: but for those of the most frequent payloads.
BROADCAST_GROUPS = 200_000


def with_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to) of every page.

    Of equal payloads of ``least_bytes`` or more the one with the smallest page_id is the response that the others refer to.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy(F.unhex("payload_digest").alias("key")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1"), "warc-copies")
    long = F.col("payload_bytes") >= least_bytes
    keyed = rows.withColumn("key", F.when(long, F.unhex("payload_digest")))
    if groups.count() <= BROADCAST_GROUPS:
        joined = keyed.join(F.broadcast(groups.select("key", "first")), "key", "left")
    else:
        # pages of frequent payloads stay where they are, the other long ones are shuffled by digest
        limit = hot_limit(pages.sparkSession, pages.count())
        hot, cold = F.broadcast(groups.where(F.col("n") > limit).select("key", "first")), groups.where(F.col("n") <= limit).select("key", "first")
        joined = keyed.where(long).join(hot, "key").unionByName(keyed.where(long).join(hot.select("key"), "key", "left_anti").join(cold, "key", "left"))
        joined = joined.unionByName(keyed.where(~long).withColumn("first", F.lit(None).cast(pages.schema["page_id"].dataType)))
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first", "key")


def record_text(payload: Column) -> Column:
    """A record without its end: header, then the block with the HTTP header and, for responses, the payload."""
    crlf = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(crlf + crlf))
    block_bytes = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{crlf}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f">{crlf}WARC-Date: 1970-01-01T00:00:00Z{crlf}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""), F.lit(crlf)), F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{crlf}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{crlf}Content-Type: application/http;msgtype=response{crlf}Content-Length: "), block_bytes.cast("string"), F.lit(crlf + crlf),
    )
    return F.concat(header, http, F.when(revisit, F.lit("")).otherwise(payload))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one record for every page to WARC files in the folder ``path`` (it must not exist)."""
    rows = with_revisits(pages).select(record_text(F.col("payload")).alias("value"))
    rows.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


_HEADER = re.compile(rb"^([A-Za-z-]+): ?([^\r\n]*)\r?$", re.M)


def _parsed(piece: bytes) -> tuple | None:
    """Type, page, referred page, declared digest and lengths of a candidate record (without magic); None if it is none."""
    cut = piece.find(b"\r\n\r\n")
    if cut < 0:
        return None
    fields = {k.lower(): v for k, v in _HEADER.findall(piece[:cut])}
    try:
        size = int(fields[b"content-length"])
        if size < 0:
            return None
        kind = fields[b"warc-type"].decode("ascii")
    except (KeyError, ValueError):
        return None
    page = re.fullmatch(rb"<urn:page:(-?\d+)>", fields.get(b"warc-record-id", b""))
    other = re.fullmatch(rb"<urn:page:(-?\d+)>", fields.get(b"warc-refers-to", b""))
    digest = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha256:")
    return kind, page and int(page[1]), other and int(other[1]), digest, cut + 4, size


def _payload_facts(block: bytes) -> tuple[int | None, int, str]:
    """The payload length that the HTTP header states, the payload's own length, and its digest."""
    cut = block.find(b"\r\n\r\n")
    head, payload = (block[:cut], block[cut + 4 :]) if cut >= 0 else (b"", block)
    stated = re.search(rb"(?im)^content-length: ?(\d+)\r?$", head)
    return int(stated[1]) if stated else None, len(payload), hashlib.sha256(payload).hexdigest()


_PIECE = "file string, block long, start long, size long, kind string, page_id long, refers_to long, digest string, successor long, whole boolean, stated long, payload_bytes long, payload_digest string"


def pieces(spark: SparkSession, path: str, with_bytes: bool = False) -> DataFrame:
    """The pieces between magics, in each file block: ``start`` and ``successor`` are relative to the block's first byte read.

    ``whole`` candidates have their entire record in the piece, and so the payload's digest.
    """
    bound_batches(spark)
    lines = spark.read.option("lineSep", MAGIC).text(path).select("value", "_metadata.file_name", "_metadata.file_block_start", "_metadata.file_size")
    magic = len(MAGIC)
    names = [part.split(" ")[0] for part in _PIECE.split(", ")] + (["bytes"] if with_bytes else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for batch in batches:
            out: list[tuple] = []
            values = batch.column(0).cast(pa.binary()).to_pylist()
            for piece, file, block in zip(values, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (file, block) != here:
                    here, at = (file, block), 0
                found = _parsed(piece)
                size = len(piece) + magic
                if found:
                    kind, page, other, digest, head, length = found
                    whole = head + length + len(END) == len(piece)
                    facts = _payload_facts(piece[head : head + length]) if whole else (None, None, None)
                    row = (file, block, at, size, kind, page, other, digest, at + magic + head + length + len(END), whole, *facts)
                else:
                    row = (file, block, at, size, None, None, None, None, None, False, None, None, None)
                out.append((*row, piece) if with_bytes else row)
                at += size
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=False)], names)

    return lines.select("value", "file_name", "file_block_start").mapInArrow(run, _PIECE + (", bytes binary" if with_bytes else ""))


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def _exits(g: pd.DataFrame) -> pd.DataFrame:
    """For every candidate of a block, where its chain leaves the block; -1 where it breaks off."""
    g = g.sort_values("start")
    start, after = g["start"].tolist(), g["successor"].tolist()
    last = start[-1]
    out: dict[int, int] = {}
    for s, n in zip(reversed(start), reversed(after), strict=True):
        if n is None or n != n:
            out[s] = -1
        else:
            n = int(n)
            out[s] = out.get(n, -1) if n <= last else n
    return pd.DataFrame({"file": g["file"], "block": g["block"], "start": start, "exit": [out[s] for s in start]})


def _marked(g: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that its entries reach."""
    g = g.sort_values("start")
    live, out = set(), []
    for s, n, entry in zip(g["start"].tolist(), g["successor"].tolist(), g["entry"].tolist(), strict=True):
        hit = bool(entry) or s in live
        if hit and n == n and n is not None:
            live.add(int(n))
        out.append(hit and n == n and n is not None)
    g["reached"] = out
    return g[["file", "block", "start", "reached"]]


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, block, start, reached) of every piece with absolute offsets; ``candidates``: file, block, start, successor."""
    nodes = materialize(candidates.groupBy("file", "block").applyInPandas(_exits, "file string, block long, start long, exit long"), "warc-exits")
    first = candidates.groupBy("file").agg(F.min("start").alias("start"))
    # entries: what some chain of another block leads to, and the file's start
    targets = nodes.where("exit >= 0").select("file", F.col("exit").alias("start")).unionByName(first).distinct()
    jumps = materialize(nodes.join(targets, ["file", "start"]).select("file", "start", "exit"), "warc-jumps")
    reached = materialize(jumps.join(first, ["file", "start"]).select("file", "start"), "warc-reached")
    while True:  # twice as far each round
        more = reached.join(jumps.where("exit >= 0"), ["file", "start"]).select("file", F.col("exit").alias("start"))
        grown = materialize(reached.unionByName(more).distinct(), "warc-reached")
        done = grown.count() == reached.count()
        drop_scratch(candidates.sparkSession, reached)
        reached = grown
        if done:
            break
        next_hop = jumps.select("file", F.col("start").alias("exit"), F.col("exit").alias("far"))
        wider = jumps.join(next_hop, ["file", "exit"], "left").select("file", "start", F.coalesce("far", F.lit(-1)).alias("exit"))
        wider = materialize(wider, "warc-jumps")
        drop_scratch(candidates.sparkSession, jumps)
        jumps = wider
    entries = reached.withColumn("entry", F.lit(True))
    joined = candidates.join(entries, ["file", "start"], "left").select("file", "block", "start", "successor", F.coalesce("entry", F.lit(False)).alias("entry"))
    return joined.groupBy("file", "block").applyInPandas(_marked, "file string, block long, start long, reached boolean")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, verified) of every record of the archives in ``path``.

    For responses, bytes and digest are those of the payload read; for revisits, those that the record states of the full
    payload. ``verified`` tells whether they are what the record's header declares. A broken file gives the records up to
    the break. Files are read in splits; a record longer than a split is still whole.
    """
    narrow = materialize(pieces(spark, path), "warc-pieces")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = narrow.groupBy("file", "block").agg(F.sum("size").alias("size")).withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    # a piece's record starts with the magic before it; the first piece of a file, before its first magic, is no record
    shift = F.col("base") - F.lit(len(MAGIC))
    placed = narrow.join(blocks, ["file", "block"])
    absolute = placed.withColumns({"relative": F.col("start"), "start": F.col("start") + shift, "successor": F.col("successor") + shift}).where("start >= 0")
    absolute = materialize(absolute, "warc-pieces")
    marks = reachable(absolute.select("file", "block", "start", "successor"))
    known = absolute.join(marks.drop("block"), ["file", "start"])
    owner = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    known = materialize(known.withColumn("owner", F.last(F.when(F.col("reached"), F.col("start")), ignorenulls=True).over(owner)), "warc-known")
    cut = known.where("reached and not whole").select("file", F.col("start").alias("owner"))
    if cut.limit(1).count():
        needed = known.join(cut, ["file", "owner"]).select("file", "block", "relative", "owner", F.col("start").alias("at"))
        content = pieces(spark, path, with_bytes=True).select("file", "block", F.col("start").alias("relative"), "bytes").join(needed, ["file", "block", "relative"])
        joined = content.select("file", "owner", "at", "bytes").groupBy("file", "owner").applyInPandas(_joined, "file string, owner long, stated long, payload_bytes long, payload_digest string")
        joined = joined.select("file", F.col("owner").alias("start"), F.col("stated").alias("j_stated"), F.col("payload_bytes").alias("j_bytes"), F.col("payload_digest").alias("j_digest"))
        known = known.join(joined, ["file", "start"], "left").withColumns({"stated": F.coalesce("j_stated", "stated"), "payload_bytes": F.coalesce("j_bytes", "payload_bytes"), "payload_digest": F.coalesce("j_digest", "payload_digest")})
    revisit = F.col("kind") == "revisit"
    return known.where("reached").select(
        "page_id", F.col("kind").alias("record_type"), "refers_to",
        F.when(revisit, F.col("stated")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        (revisit | ((F.col("digest") == F.col("payload_digest")) & (F.col("stated") == F.col("payload_bytes")))).alias("verified"),
    )


def _joined(g: pd.DataFrame) -> pd.DataFrame:
    """The payload of one record whose pieces a magic in it has parted; as large as that record."""
    g = g.sort_values("at")
    record = MAGIC.encode("ascii").join(bytes(b) for b in g["bytes"])
    _, _, _, _, head, size = _parsed(record)
    stated, length, digest = _payload_facts(record[head : head + size])
    return pd.DataFrame({"file": [g["file"].iloc[0]], "owner": [g["owner"].iloc[0]], "stated": [stated], "payload_bytes": [length], "payload_digest": [digest]})


def op8_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back.

    A null html is an empty payload. Repeated page_ids each have a record; a null page_id is read back as null.
    """
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), f AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
         min(page_id) OVER (PARTITION BY sha256(payload)) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

"""URL filter by Bloom filter cascades.

A cascade answers membership in a listed set exactly for every key of a known universe. Level 1 encodes the listed keys;
level 2 the universe's keys that pass level 1 without being listed; level 3 the listed keys that pass level 2; and so on
until a level has no false positive. The first level's error rate is chosen by the sizes of list and universe, so all
levels together take a few bits for each *listed* key, whatever the size of the corpus.

A rule ``host/path`` is a listed key. Every url has candidate keys (each suffix of its host with each prefix of its path
that has the length of some rule's path); the universe are all candidate keys of the corpus. Pages are judged in one pass
without a join: the cascades are broadcast, and a candidate that passes is a rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid.common import table
from quarrygrid.llm import textkernel as tk

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"
MAX_LEVELS = 64


def key_hashes(keys: Sequence[str]) -> np.ndarray:
    data, offsets = tk.buffers(pa.array(keys, pa.string()))
    return tk.span_hashes(data, offsets[:-1], offsets[1:]) if len(keys) else np.zeros(0, np.uint64)


class Bloom:
    """One level: a bit array and its number of hash functions, salted by the level."""

    def __init__(self, bits: int, hashes: int, salt: int, words: np.ndarray | None = None):
        self.bits, self.hashes, self.salt = bits, hashes, salt
        self.words = np.zeros(bits // 64, np.uint64) if words is None else words

    @classmethod
    def sized(cls, keys: int, error: float, salt: int) -> Bloom:
        error = min(max(error, 1e-9), 0.5)
        bits = max(64, math.ceil(-keys * math.log(error) / math.log(2) ** 2))
        return cls(-(-bits // 64) * 64, max(1, round(-math.log2(error))), salt)

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        a = tk.mix(hashes + np.uint64(self.salt))
        b = tk.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5 + self.salt)) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(self.hashes, dtype=np.uint64)) % np.uint64(self.bits)

    def add(self, hashes: np.ndarray) -> None:
        at = self.positions(hashes).ravel()
        np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        at = self.positions(hashes)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) == 1).all(1)


class Cascade:
    """Levels that alternate between listed keys and false positives."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def passed(self, hashes: np.ndarray) -> np.ndarray:
        """How many levels each key passes before the first that it fails."""
        depth, live = np.zeros(len(hashes), np.int64), np.arange(len(hashes))
        for level in self.levels:
            live = live[level.contains(hashes[live])]
            depth[live] += 1
        return depth

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """Listed keys leave at an even level, or pass all of an odd number of levels."""
        return self.passed(hashes) % 2 == 1


def build_cascade(universe: DataFrame, listed: Iterable[str], key: str = "key") -> Cascade:
    """A cascade of ``listed``, exact for every key of ``universe``: a DataFrame of distinct, non-null strings.

    The universe is scanned once for each even level, and only for what passes all levels before. From a level, its set
    bits come back grouped by 64-bit word: as many rows as the level has words, which is proportional to the list.
    """
    listed = sorted(set(listed))
    own = key_hashes(listed)
    spark = universe.sparkSession
    total = max(universe.count(), 1)
    error = min(0.5, max(len(listed), 1) / (math.sqrt(2) * total))
    cascade = Cascade([Bloom.sized(max(len(listed), 1), error, 1)])
    if not len(own):
        return cascade
    cascade.levels[0].add(own)
    shared_list = spark.sparkContext.broadcast(set(listed))
    while len(cascade.levels) < MAX_LEVELS:
        depth = len(cascade.levels)
        so_far = spark.sparkContext.broadcast(cascade)

        def false_positives(batches: Iterator[pa.RecordBatch], so_far=so_far, depth=depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                through = np.flatnonzero(so_far.value.passed(key_hashes(keys)) == depth)
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in through if keys[i] not in shared_list.value], pa.string())], ["key"])

        if depth % 2:  # keys that aren't listed but pass all levels so far
            wrong = universe.select(F.col(key).alias("key")).mapInArrow(false_positives, "key string")
            n = wrong.count()
            if not n:
                return cascade
            level = Bloom.sized(n, 0.5, depth + 1)

            def word_masks(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    at = level.positions(key_hashes(batch.column(0).to_pylist())).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "mask"])

            for word, mask in wrong.mapInArrow(word_masks, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).collect():
                level.words[word] = np.uint64(mask & 0xFFFFFFFFFFFFFFFF)
        else:  # listed keys that pass the level of false positives
            wrong_listed = own[cascade.passed(own) == depth]
            if not len(wrong_listed):
                return cascade
            level = Bloom.sized(len(wrong_listed), 0.5, depth + 1)
            level.add(wrong_listed)
        cascade.levels.append(level)
    raise RuntimeError("the cascade doesn't end: two keys have equal hashes")


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both are empty for a null url and for one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr(f"substring({url}, instr({url}, '://') + 3)"), "#", 1)).otherwise("")
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    return (
        df.withColumn("__rest", rest).withColumn("__host", F.substring_index("__rest", "/", 1))
        .withColumn("host", F.translate("__host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        .withColumn("path", F.expr("substring(__rest, length(__host) + 1)")).drop("__rest", "__host")
    )


def with_candidates(df: DataFrame, path_lengths: Sequence[int], most_labels: int) -> DataFrame:
    """Adds ``candidates array<string>``: host suffix of at most ``most_labels`` labels and path prefix of every length that a rule has, the longest first."""
    lengths = F.array(*[F.lit(n) for n in sorted(set(path_lengths))]) if path_lengths else F.array().cast("array<int>")
    labels = F.split("host", r"\.", -1)
    last = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - most_labels + 1), F.lit(most_labels)) if most_labels else F.array().cast("array<string>")
    suffixes = F.transform(last, lambda _, i: F.array_join(F.slice(last, i + 1, F.lit(most_labels)), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    # the longest wins; of equally long ones that with the longer host
    keyed = F.array_sort(F.transform(pairs, lambda k: F.struct((-F.length(k)).alias("size"), F.instr(k, "/").alias("slash"), k.alias("key"))), lambda x, y: F.when(x["size"] != y["size"], x["size"] - y["size"]).otherwise(y["slash"] - x["slash"]))
    return df.withColumn("candidates", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(keyed, lambda x: x["key"])))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule decides, and where none
    fits the verdict is ``default``: the url isn't listed. Null, empty and malformed urls have no host and fit no rule; a url
    that ends with its host has an empty path and fits no rule whose path is ``/``. Repeated rows stay.
    The rules are a driver-side list of the filter's own; the universe of keys is distributed.
    """
    parts = with_candidates(url_parts(pages.select("page_id", "url")), [len(p) for _, _, p in rules], max((h.count(".") + 1 for _, h, _ in rules), default=0)).select("page_id", "host", "path", "candidates")
    universe = parts.select(F.explode("candidates").alias("key")).distinct().persist()
    cascades = {v: build_cascade(universe, [h + p for verdict, h, p in rules if verdict == v]) for v in ("block", "allow")}
    universe.unpersist()
    shared = pages.sparkSession.sparkContext.broadcast(cascades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            flat = column.flatten()
            hashes = key_hashes(flat.to_pylist())
            block, allow = (shared.value[v].contains(hashes) for v in ("block", "allow"))
            row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            hit = np.flatnonzero(block | allow)
            where, first = np.unique(row[hit], return_index=True)
            pick = hit[first]
            rule, verdict = np.full(len(column), None, object), np.full(len(column), default, object)
            rule[where] = np.array(flat.take(pa.array(pick)).to_pylist(), object) if len(pick) else []
            verdict[where] = np.where(block[pick], "block", "allow")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def op2_url_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return filter_urls(table(spark, sf_dir, "pages"))


OP2_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, split_part(split_part(coalesce(r, ''), '#', 1), '?', 1) AS r FROM cut
), named AS (
  SELECT page_id, translate(split_part(r, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(r, length(split_part(r, '/', 1)) + 1) AS path FROM parts
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT n.page_id, n.host, n.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY n.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, length(r.rule_host) DESC) AS k
  FROM named n LEFT JOIN rules r
    ON (n.host = r.rule_host OR ends_with(n.host, '.' || r.rule_host)) AND starts_with(n.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""

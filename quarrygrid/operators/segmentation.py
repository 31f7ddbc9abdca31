"""Words of text without spaces: a lexicon counted from the corpus, and the most likely cut of a text into its words."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygrid.common import bound_batches, drop_scratch, materialize, spread_if_small
from quarrygrid.operators.lexical import LOWER, UPPER

RUN = re.compile(r"[^\W\d_]+")
#: Letters outside of Latin, Greek and Cyrillic: most scripts without spaces are among them.
UNSPACED = re.compile(r"[^\W\d_\u0000-ԯ]+")
#: Different pieces that a task counts before it passes their sums on.
HELD_PIECES = 200_000
#: Words of a lexicon: what is broadcast, some 100 bytes each.
LEXICON_WORDS = 200_000
SCALE = 1000
_LOWER = str.maketrans(UPPER, LOWER)


def _counted(docs: DataFrame, text: Column, pieces: Callable[[str], Iterator[str]]) -> DataFrame:
    """(word, n) of the pieces of every text; each task adds up what it can hold first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                found = pieces((t.as_py() or "").translate(_LOWER))
                while some := list(islice(found, 50_000)):
                    held.update(some)
                    if len(held) >= HELD_PIECES:
                        yield flush()
        yield flush()

    bound_batches(docs.sparkSession)
    return spread_if_small(docs.select(text.alias("t"))).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spaced_words(docs: DataFrame, col: str = "text") -> DataFrame:
    """(word, n): the runs of letters in texts with spaces, ASCII-lowered."""

    def pieces(text: str) -> Iterator[str]:
        for m in RUN.finditer(text):
            yield m.group()

    return _counted(docs, F.col(col), pieces)


def cohesive_words(docs: DataFrame, col: str = "text", longest: int = 4, least: int = 2, cohesion: float = 8.0, runs: re.Pattern = UNSPACED) -> DataFrame:
    """(word, n): single characters, and sequences of up to ``longest`` characters in runs that occur at least ``least`` times and hold together.

    A sequence holds together if wherever it is cut in two it is at least ``cohesion`` times as frequent as its parts would meet by chance.
    """

    def pieces(text: str) -> Iterator[str]:
        for m in runs.finditer(text):
            r = m.group()
            for size in range(1, longest + 1):
                for i in range(len(r) - size + 1):
                    yield r[i : i + size]

    spark = docs.sparkSession
    # whatever is part of a frequent sequence is as frequent, so no part is missed below
    counts = materialize(_counted(docs, F.col(col), pieces).where((F.length("word") == 1) | (F.col("n") >= least)), "segment-counts")
    total = counts.where(F.length("word") == 1).agg(F.sum("n").cast("double").alias("total"))
    cuts = counts.where(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    cuts = cuts.select("word", "n", F.expr("substring(word, 1, at)").alias("l"), F.expr("substring(word, at + 1)").alias("r"))
    part = lambda side: counts.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"))
    met = cuts.join(part("l"), "l").join(part("r"), "r").join(F.broadcast(total))
    whole = met.groupBy("word").agg(F.max("n").alias("n"), F.min(F.col("n") * F.col("total") / (F.col("n_l").cast("double") * F.col("n_r"))).alias("together"))
    out = materialize(counts.where(F.length("word") == 1).unionByName(whole.where(F.col("together") >= cohesion).select("word", "n")), "segment-words")
    drop_scratch(spark, counts)
    return out


class Lattice:
    """A prefix automaton of words with their costs: 1000 times the negative logarithm of a word's share of all counts, rounded.

    A character that begins no word stands alone, at the cost of half a count.
    """

    def __init__(self, words: dict[str, int]):
        total = max(sum(words.values()), 1)
        self.unknown = round(SCALE * math.log(2 * total))
        self.step: dict[int, int] = {}
        self.costs = array("q", [-1])
        for word, n in words.items():
            state = 0
            for ch in word:
                key = state << 21 | ord(ch)
                if key not in self.step:
                    self.step[key] = len(self.costs)
                    self.costs.append(-1)
                state = self.step[key]
            if state:
                self.costs[state] = round(SCALE * math.log(total / n))

    def cut(self, text: str) -> list[str]:
        """The words of the cheapest cut, in time of the length by the longest word; of equal ones that whose last word is longest, and so on from the end."""
        size, step, costs, unknown = len(text), self.step.get, self.costs, self.unknown
        codes = [ord(c) for c in text]
        best, start = [1 << 62] * (size + 1), [0] * (size + 1)
        best[0] = 0
        for i in range(size):
            base, state = best[i], 0
            if base + unknown < best[i + 1]:
                best[i + 1], start[i + 1] = base + unknown, i
            for j in range(i, size):
                state = step(state << 21 | codes[j])
                if state is None:
                    break
                cost = costs[state]
                if cost >= 0 and base + cost < best[j + 1]:
                    best[j + 1], start[j + 1] = base + cost, i
        out, end = [], size
        while end:
            out.append(text[start[end] : end])
            end = start[end]
        return out[::-1]


def lattice_of(words: DataFrame, most: int = LEXICON_WORDS) -> Lattice:
    """The lattice of the ``most`` most frequent words of (word, n), in the order of the words among equals."""
    rows = words.where("word is not null and word <> '' and n > 0").orderBy(F.desc("n"), "word").limit(most).collect()
    return Lattice({r.word: r.n for r in rows})


def lattice_segmenter(words: DataFrame, most: int = LEXICON_WORDS, runs: re.Pattern = RUN):
    """A segmenter hook for ``tokenize_text``, ``bm25_topk`` and the others: what is no Latin token is cut into its most likely words."""
    held = words.sparkSession.sparkContext.broadcast(lattice_of(words, most))

    def cut(column: pd.Series) -> pd.Series:
        return pd.Series([[w for m in runs.finditer(t or "") for w in held.value.cut(m.group())] for t in column], dtype=object)

    return cut


def segment_text(df: DataFrame, words: DataFrame, col: str = "text", out: str = "words", most: int = LEXICON_WORDS) -> DataFrame:
    """Adds the words of each text without spaces: its runs of letters, ASCII-lowered, each cut as is most likely by ``words`` (word, n).

    Null and empty texts have no words; a text of any length is cut whole. The lexicon is the most frequent ``most`` words, and is broadcast.
    """
    bound_batches(df.sparkSession)
    hook = lattice_segmenter(words, most)

    @F.pandas_udf("array<string>")
    def cut(column: pd.Series) -> pd.Series:
        return hook(column.map(lambda t: (t or "").translate(_LOWER)))

    return spread_if_small(df).withColumn(out, cut(F.coalesce(F.col(col), F.lit(""))))

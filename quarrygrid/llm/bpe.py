"""Byte-level BPE encoding and decoding with a minimal acyclic transducer of frequent words.

``Encoder`` splits a block of texts into pretokens with array operations, resolves each distinct pretoken once (by the
transducer if it is a frequent word, else by exact merges), and assembles the ids of the block by one gather.
``Lexicon`` is the transducer: states share suffixes, every edge carries a number, and the sum of the numbers along a
word's path is the word's row in a table of ids. It is one flat file that workers map into memory.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid.common import bound_batches, drop_scratch, materialize
from quarrygrid.llm import textkernel as tk

SPECIAL, SPECIAL_ID = b"<|endoftext|>", 50256
#: Suffixes that stay with a single apostrophe before them (fixed by the vocabulary's split pattern).
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
LEXICON_WORDS = 50_000
LONG_WORD = 192
#: Words that a task of ``word_counts`` holds before it passes their counts on.
HELD_WORDS = 100_000
SLOT_BITS = 18
#: The memo of an encoder: slots for words (16 bytes each) and ids (4 bytes each), some 12 MB for a worker at any corpus size.
MEMO_BITS, MEMO_IDS = 18, 1 << 21
NONE = np.iinfo(np.int64).max
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merges and byte strings of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        back = {c: b for b, c in enumerate(byte_symbols())}
        self.byte_id = np.array([vocab[c] for c in byte_symbols()], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in merges], np.int64)
        self.slot_key, self.slot_rank = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.slot_key[slot] >= 0:
                slot = (slot + 1) & ((1 << SLOT_BITS) - 1)
            self.slot_key[slot], self.slot_rank[slot] = key, rank
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank
        self.pieces = [b""] * (max(max(vocab.values()), SPECIAL_ID) + 1)
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token)
        self.pieces[SPECIAL_ID] = SPECIAL

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, from a hash table with linear probing."""
        want = (left << 16) | right
        slot = self._slots(want)
        key = self.slot_key[slot]
        out = np.where(key == want, self.slot_rank[slot], NONE >> 32)
        todo = np.flatnonzero((key != want) & (key >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << SLOT_BITS) - 1)
            key = self.slot_key[slot[todo]]
            hit = key == want[todo]
            out[todo[hit]] = self.slot_rank[slot[todo[hit]]]
            todo = todo[~hit & (key >= 0)]
        return out

    def merge_one(self, word: bytes) -> list[int]:
        """Merges of one long word by a heap over a linked list."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        none = NONE >> 32
        first = self.ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist() if n > 1 else []
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != none]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.merged[r]), False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    s = int(self.ranks(np.array([ids[x]], np.int64), np.array([ids[y]], np.int64))[0])
                    if s != none:
                        heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def merge_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words at once: each round merges the best pair of every word that has one.

        Returns the ids one after another and how many each word has.
        """
        n = len(starts)
        count = np.zeros(n, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # word of each id, ids in order
        long = np.flatnonzero(ends - starts > LONG_WORD)
        for w in long.tolist():
            ids = np.array(self.merge_one(data[starts[w] : ends[w]].tobytes()), np.int64)
            found.append((np.full(len(ids), w), ids))
        short = np.flatnonzero(ends - starts <= LONG_WORD)
        size = (ends - starts)[short]
        head = np.cumsum(size) - size
        word = np.repeat(short, size)
        sym = self.byte_id[data[np.repeat(starts[short] - head, size) + np.arange(len(word))]]
        none = NONE >> 32
        rank = np.full(len(sym), none, np.int64)
        if len(sym) > 1:
            same = word[1:] == word[:-1]
            rank[:-1] = np.where(same, self.ranks(sym[:-1], sym[1:]), none)
        while len(sym):
            new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), new)
            busy = (best >> 32) != none
            if not busy.all():
                size = np.diff(np.concatenate((new, [len(sym)])))
                stay = np.repeat(busy, size)
                found.append((word[~stay], sym[~stay]))
                shift = np.cumsum(stay) - 1
                best = best[busy]
                at = shift[best & 0xFFFFFFFF]
                ranks = best >> 32
                word, sym, rank = word[stay], sym[stay], rank[stay]
                if not len(sym):
                    break
            else:
                at, ranks = best & 0xFFFFFFFF, best >> 32
            sym[at] = self.merged[ranks]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            word, sym, rank = word[keep], sym[keep], rank[keep]
            redo = np.concatenate((at, at[at > 0] - 1))
            right = np.minimum(redo + 1, len(sym) - 1)
            ok = (right > redo) & (word[redo] == word[right])
            rank[redo] = np.where(ok, self.ranks(sym[redo], sym[right]), none)
        if not found:
            return np.zeros(0, np.int64), count
        word = np.concatenate([w for w, _ in found])
        ids = np.concatenate([i for _, i in found])
        count = np.bincount(word, minlength=n)
        return ids[np.argsort(word, kind="stable")], count


class Lexicon:
    """A minimal acyclic transducer from words (bytes) to rows of ids, in flat arrays."""

    FIELDS = ("key", "target", "number", "final", "row_start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays

    @classmethod
    def compile(cls, words: Iterable[bytes], vocabulary: Vocabulary) -> Lexicon:
        """Add the words in order and share equal right languages as soon as they can't change any more."""
        words = sorted({w for w in words if w})
        edges: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path = [0]

        def settle(depth: int, word: bytes) -> None:
            while len(path) > depth + 1:
                state = path.pop()
                signature = (final[state], tuple(edges[state].items()))
                known = register.setdefault(signature, state)
                if known != state:
                    edges[path[-1]][word[len(path) - 1]] = known

        last = b""
        for w in words:
            common = len(os.path.commonprefix((last, w)))
            settle(common, last)
            for byte in w[common:]:
                edges.append({})
                final.append(False)
                edges[path[-1]][byte] = len(edges) - 1
                path.append(len(edges) - 1)
            final[path[-1]] = True
            last = w
        settle(0, last)

        order: list[int] = []  # reachable states, children before parents
        seen, stack = {0}, [(0, iter(edges[0].values()))]
        while stack:
            state, rest = stack[-1]
            child = next((c for c in rest if c not in seen), None)
            if child is None:
                order.append(state)
                stack.pop()
            else:
                seen.add(child)
                stack.append((child, iter(edges[child].values())))
        name = {s: i for i, s in enumerate(reversed(order))}
        below = dict.fromkeys(order, 0)
        key, target, number = [], [], []
        for state in order:
            passed = int(final[state])
            for byte in sorted(edges[state]):
                child = edges[state][byte]
                key.append(name[state] << 8 | byte)
                target.append(name[child])
                number.append(passed)
                passed += below[child]
            below[state] = passed
        sort = np.argsort(np.array(key, np.int64))
        flat = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        ids, count = vocabulary.merge_all(flat, ends - size, ends) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        flags = np.zeros(len(order), np.int64)
        for s, i in name.items():
            flags[i] = final[s]
        return cls({
            "key": np.array(key, np.int64)[sort], "target": np.array(target, np.int64)[sort], "number": np.array(number, np.int64)[sort],
            "final": flags, "row_start": np.concatenate(([0], np.cumsum(count))).astype(np.int64), "ids": ids.astype(np.int64),
        })

    def to_bytes(self) -> bytes:
        head = np.array([len(self.a[f]) for f in self.FIELDS], np.int64)
        return head.tobytes() + b"".join(self.a[f].astype(np.int64).tobytes() for f in self.FIELDS)

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """The transducer in a memory-mapped file; the name is removed at once, so no file stays behind."""
        fd, path = tempfile.mkstemp(suffix=".lexicon")
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        flat = np.memmap(path, np.int64, "r")
        os.unlink(path)
        head = flat[: len(cls.FIELDS)]
        at = len(cls.FIELDS) + np.concatenate(([0], np.cumsum(head)))
        return cls({f: flat[at[i] : at[i + 1]] for i, f in enumerate(cls.FIELDS)})

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each word, -1 where the transducer doesn't accept it; all words walk in step."""
        out = np.full(len(starts), -1, np.int64)
        key, target, number, final = (self.a[f] for f in self.FIELDS[:4])
        if not len(key):
            return out
        live, state, total = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        step = 0
        while len(live):
            done = ends[live] - starts[live] == step
            accepted = done & (final[state] == 1)
            out[live[accepted]] = total[accepted]
            live, state, total = live[~done], state[~done], total[~done]
            want = state << 8 | data[starts[live] + step]
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[at] == want
            live, at = live[hit], at[hit]
            state, total = target[at], total[hit] + number[at]
            step += 1
        return out


_CLASSES: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    if not _CLASSES:
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        out = np.zeros(0x110000, np.uint8)
        split = ByteLevel(add_prefix_space=False).pre_tokenize_str
        for kind, pattern, beside in ((_LETTER, r"\p{L}", "a"), (_NUMBER, r"\p{N}", "1")):
            for c in map(ord, regex.findall(pattern, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))):
                # the library's Unicode version decides about characters that are newer than Python's
                if unicodedata.category(chr(c)) != "Cn" or len(split(beside + chr(c))) == 1:
                    out[c] = kind
        # the characters with the White_Space property (fixed values)
        out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _CLASSES.append(out)
    return _CLASSES[0]


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the pieces that merges never cross, and the pieces before each row."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each code point
    code = data if len(at) == len(data) else np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = char_classes()[code]
    row = np.searchsorted(at, offsets)
    n = len(code)
    first, _ = tk.edge_flags(n, row)
    cut = first.copy()
    cut[1:] |= kind[1:] != kind[:-1]
    # A run of white space before other text gives its last character away: to the text, if it is a plain space.
    gap = np.flatnonzero(cut[1:] & ~first[1:] & (kind[:-1] == _SPACE)) + 1  # text starts here, right after white space
    last = gap - 1
    plain = code[last] == 0x20
    cut[gap[plain]] = False
    cut[last] = True
    # A lone apostrophe that starts a piece takes a contraction's letters.
    quote = np.flatnonzero((code[:-1] == 0x27) & cut[:-1] & cut[1:] & ~first[1:] & (kind[1:] == _LETTER)) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        stop = row[np.searchsorted(row, quote, "right")]
        taken = np.zeros(len(quote), np.int64)
        for suffix in CONTRACTIONS:
            size = len(suffix)
            fits = (taken == 0) & (quote + size < stop)
            for j, byte in enumerate(suffix):
                fits &= code[np.minimum(quote + 1 + j, n - 1)] == byte
            taken[fits] = size
        quote, taken, stop = quote[taken > 0], taken[taken > 0], stop[taken > 0]
        cut[quote + 1] = False
        rest = quote + 1 + taken
        inside = rest < stop
        cut[rest[inside]] = True
    starts = np.flatnonzero(cut)
    before = np.searchsorted(starts, row)
    starts = at[starts]
    ends = np.concatenate((starts[1:], [len(data)]))
    return starts, ends, before


class Encoder:
    """Encodes blocks of texts; remembers words it has resolved.

    The memo is bounded in bytes: one slot for each value of ``MEMO_BITS`` bits of a word's hash, where a new word takes the
    place of the one before it, and ``MEMO_IDS`` ids. Once the ids don't fit any more, it starts anew.
    """

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = Vocabulary(path), lexicon
        self.key, self.start, self.size = np.zeros(1 << MEMO_BITS, np.uint64), np.zeros(1 << MEMO_BITS, np.int32), np.zeros(1 << MEMO_BITS, np.int32)
        self.pool, self.fill = np.zeros(MEMO_IDS, np.int32), 0

    def _words(self, distinct: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, with start and size in it for each distinct word (its hash and an example's bytes)."""
        slot = (distinct >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        start, size = self.start[slot].astype(np.int64), self.size[slot].astype(np.int64)
        fresh = np.flatnonzero((self.key[slot] != distinct) | (size == 0))
        if not len(fresh):
            return self.pool, start, size
        ids, count = self._resolve(data, starts[fresh], ends[fresh])
        start[fresh], size[fresh] = self.fill + np.cumsum(count) - count, count
        if self.fill + len(ids) > len(self.pool):
            pool = np.concatenate((self.pool[: self.fill], ids.astype(np.int32)))
            self.size[:], self.fill = 0, 0
            return pool, start, size
        self.pool[self.fill : self.fill + len(ids)] = ids
        self.fill += len(ids)
        self.key[slot[fresh]], self.start[slot[fresh]], self.size[slot[fresh]] = distinct[fresh], start[fresh], size[fresh]
        return self.pool, start, size

    def _resolve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after another, and their number for each word."""
        if self.lexicon is None:
            return self.vocabulary.merge_all(data, starts, ends)
        row = self.lexicon.rows(data, starts, ends)
        hit, miss = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        where, pool = self.lexicon.a["row_start"], self.lexicon.a["ids"]
        count, source = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        count[hit], source[hit] = where[row[hit] + 1] - where[row[hit]], where[row[hit]]
        merged, sizes = self.vocabulary.merge_all(data, starts[miss], ends[miss])
        count[miss], source[miss] = sizes, len(pool) + np.cumsum(sizes) - sizes
        return gather(np.concatenate((pool, merged)), source, count), count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the offsets of the rows in them."""
        raw = data.tobytes()
        if SPECIAL in raw:
            return self._encode_special(raw, offsets)
        starts, ends, before = pretokens(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        import pandas as pd

        code, distinct = pd.factorize(tk.span_hashes(data, starts, ends))
        example = np.zeros(len(distinct), np.int64)
        example[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        pool, start, size = self._words(distinct, data, starts[example], ends[example])
        size = size[code]
        ids = gather(pool, start[code], size)
        total = np.concatenate(([0], np.cumsum(size)))
        return ids, total[before]

    def _encode_special(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The special token's text is its id; what lies between is encoded as texts of their own."""
        out, sizes = [], []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            parts = raw[lo:hi].split(SPECIAL)
            size = np.array([len(p) for p in parts])
            ids, cut = self.encode(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum(size))))
            for i in range(len(parts)):
                if i:
                    out.append(np.array([SPECIAL_ID], np.int32))
                out.append(ids[cut[i] : cut[i + 1]])
            sizes.append(len(ids) + len(parts) - 1)
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, as the library has it."""
        return b"".join(map(self.vocabulary.pieces.__getitem__, ids)).decode("utf-8", "replace")


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[start[0]:start[0]+size[0]], pool[start[1]:...], ... one after another."""
    shift = start - (np.cumsum(size) - size)
    return pool[np.repeat(shift, size) + np.arange(int(size.sum()))]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each pretoken occurs in all texts: (word binary, n long). Counted per task first, then summed by word."""

    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for _, _, data, offsets in tk.blocks(*tk.buffers(batch.column(0))):
                starts, ends, _ = pretokens(data, offsets)
                code, distinct = pd.factorize(tk.span_hashes(data, starts, ends))
                example = np.zeros(len(distinct), np.int64)
                example[code[::-1]] = np.arange(len(code) - 1, -1, -1)
                raw = data.tobytes()
                for s, e, n in zip(starts[example].tolist(), ends[example].tolist(), np.bincount(code, minlength=len(distinct)).tolist(), strict=True):
                    w = raw[s:e]
                    held[w] = held.get(w, 0) + n
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary_path: str, text: str = "text", size: int = LEXICON_WORDS) -> Lexicon:
    """The transducer of at most ``size`` of the most frequent pretokens.

    Counts fall into bins (eight for each doubling); whole bins are taken from the top as long as they fit, so what reaches
    the driver is bounded by ``size`` words and some hundred bins. Words that occur once or are over 64 bytes are left to the
    merges: they hardly recur.
    """
    counts = materialize(word_counts(docs, text).where((F.col("n") > 1) & (F.length("word") <= 64)).withColumn("bin", F.floor(F.log2("n") * 8)), "bpe-words")
    room, least = size, None
    for b, n in sorted(counts.groupBy("bin").count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        least = b
    words = counts.where(F.col("bin") >= least).select("word").collect() if least is not None else []
    drop_scratch(docs.sparkSession, counts)
    return Lexicon.compile((bytes(r.word) for r in words), Vocabulary(vocabulary_path))


_WORKER: dict[tuple, Encoder] = {}


def worker_encoder(path: str, lexicon: bytes | None = None, key: str = "") -> Encoder:
    """One encoder for each worker process; a new one for another vocabulary file (by path, size and time) or lexicon (by the digest ``key``)."""
    file = os.stat(path)
    own = (path, file.st_size, file.st_mtime_ns, key)
    if own not in _WORKER:
        _WORKER.clear()
        _WORKER[own] = Encoder(path, Lexicon.mapped(lexicon) if lexicon else None)
    return _WORKER[own]


def encode_documents(docs: DataFrame, vocabulary_path: str, text: str = "text", lexicon: Lexicon | None = None, derive=None, schema: str | None = None) -> DataFrame:
    """Adds ``ids array<int>`` to (doc_id, text) rows: the ids of every whole text; null texts count as empty, repeated rows stay.

    ``derive(encoder, ids) -> tuple`` with ``schema`` puts other columns in the place of the ids within the same task, so
    that digests don't carry the ids through Spark. Rows pass in blocks of about a megabyte; there is no shuffle.
    """
    import hashlib

    bound_batches(docs.sparkSession)
    flat = lexicon.to_bytes() if lexicon else None
    shared = docs.sparkSession.sparkContext.broadcast(flat) if lexicon else None
    types = schema or "ids array<int>"
    key = hashlib.sha256(flat).hexdigest() if lexicon else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary_path, shared.value if shared else None, key)
        for batch in batches:
            for lo, hi, data, offsets in tk.blocks(*tk.buffers(batch.column(1))):
                ids, at = encoder.encode(data, offsets)
                rows = [ids[at[i] : at[i + 1]] for i in range(hi - lo)]
                own = [derive(encoder, r) for r in rows] if derive else [(r,) for r in rows]
                columns = list(zip(*own, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c) for c in columns)], ["doc_id", *names])
        tk.release()

    names = [part.strip().split(" ")[0] for part in types.split(",")]
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {types}"
    return docs.select("doc_id", text).mapInArrow(run, out)


def decode_ids(df: DataFrame, vocabulary_path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded string`` to rows with an array of ids; null arrays give null."""

    @F.pandas_udf("string")
    def decode(column):
        encoder = worker_encoder(vocabulary_path)
        return column.map(lambda x: None if x is None else encoder.decode(x))

    return df.withColumn("decoded", decode(ids))


def digests(encoder: Encoder, ids: np.ndarray) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, digest of the text that they decode to."""
    import hashlib

    text = encoder.decode(ids.tolist())
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by the transducer of the corpus's frequent words, decoded again, as digests.

    Null and empty texts have no ids and the digests of no bytes.
    """
    from public_tokenizers import path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vocabulary = path("byte_bpe_50k.json")
    lexicon = build_lexicon(docs, vocabulary)
    return encode_documents(docs, vocabulary, lexicon=lexicon, derive=digests, schema="n_tokens long, ids_sha256 string, decoded_sha256 string")

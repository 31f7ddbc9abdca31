"""The corpus pipeline: every stage against a plain version, and odd rows through all of them."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quarrygrid.llm import quality, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, digest string"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Tables with good and bad texts, near copies, repeated rows, ids that repeat or are null, secrets, and odd texts."""
    rng = random.Random(31)
    good = [" ".join(rng.choice(["the", "river", "winds", "slowly", "past", "old", "mills", "and", "quiet", "farms"]) + ("," if rng.random() < 0.1 else "") for _ in range(60)) for _ in range(60)]
    bad = [" ".join(rng.choice(["$$$", "###", "|", "12", "click", "!!!", "www"]) for _ in range(60)) for _ in range(40)]
    texts = [*good, *bad]
    rows = [(i, t) for i, t in enumerate(texts)]
    near = " ".join(f"n{i}" for i in range(80))
    rows += [(200, near), (201, near.replace("n40", "x")), (202, near.upper()), (200, "another text under a used id " + " ".join(f"q{i}" for i in range(40))), (203, near + " n80"), (203, near + " n80"), (None, near), (None, None), (204, None), (205, ""), (206, "  "), (207, "word")]
    rows += [(210, good[1] + ' token = "9bf31c7ff062936a96e79bf31c7ff062936a96e7" and so on'), (None, good[2] + " password=hunter2hunter2 here"), (211, good[3] + " commit da39a3ee5e6b4b0d3255bfef95601890afd80709 fixed")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "d") for i, t in rows], DOCS).repartition(5)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def cells(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


def test_quality_stage(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    model = quality.fit(docs, labels)
    want = [r for r in docs.collect() if quality_score(model, r.text) >= 0.5]
    assert cells(kept.collect()) == cells(want)
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & set(range(60))) >= 58 and len(ids & set(range(60, 100))) <= 2


def quality_score(model, text):
    import pyarrow as pa

    from quarrygrid.llm import textkernel as tk

    return model.scores(np.minimum(quality.term_counts(*tk.buffers(pa.array([text], pa.string()))), 255))[0]


def plain_groups(rows):
    """The row that stays of each group, by all pairs of shingle sets."""
    def shingles(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()

    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return [sorted(((rows[i][0] is None, rows[i][0] or 0) for i in g))[0] for g in groups.values()]


def test_near_dedup_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    got, rows = kept.collect(), docs.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(plain_groups([(r.doc_id, r.text) for r in rows]))
    assert set(cells(got)) <= set(cells(rows))
    texts = [r.text for r in got]
    assert sum("another text under a used id" in (t or "") for t in texts) == 1 and texts.count(None) == 2
    assert sum((t or "").lower().startswith("n0 n1 n2") for t in texts) == 1


def test_secret_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    masked = corpus_pipeline.secret_stage(spark, docs, sf)
    assert masked.columns == docs.columns
    before, after = (cells(d.drop("text").collect()) for d in (docs, masked))
    assert before == after
    texts = [r.text or "" for r in masked.collect()]
    assert not any("9bf31c7ff062936a96e7" in t or "hunter2hunter2" in t for t in texts)
    assert sum(secrets.MASK in t for t in texts) == 2 and sum("da39a3ee5e6b" in t for t in texts) == 1
    same = [t for t in texts if secrets.MASK not in t]
    assert sorted(same) == sorted(r.text or "" for r in docs.collect() if "9bf31c" not in (r.text or "") and "hunter2hunter2" not in (r.text or ""))


def test_packing_stage(spark, sf):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    got = corpus_pipeline.packing_stage(spark, docs, sf).collect()
    assert sum(r.length for r in got) == sum(want)
    whole = [r for r in got if r.start == 0 and r.length == r.doc_tokens]
    for r in whole:
        assert r.ids_crc32 >= 0
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.where("doc_id < 100").collect()}
    for r in got:
        if r.doc_id in ids:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    offsets = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert offsets.get(r.sequence_id, 0) == r.offset
        offsets[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 for n in offsets.values())


def test_run_chains_the_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
    got = corpus_pipeline.run(spark, sf)
    assert sorted(got.columns) == sorted(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    assert got.agg({"length": "sum"}).first()[0] == docs.agg({"length": "sum"}).first()[0]


def test_empty_tables(spark, sf, tmp_path):
    folder = f"file://{tmp_path}"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    # without labels nothing is rejected
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.quality_stage(spark, docs, folder).count() == docs.count()

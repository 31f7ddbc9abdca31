"""Operators that SQL can't express, on hand-written rows; hooks; streams against their batch forms."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrygrid.operators import answers, chunking, evaluation, graph, lexical, ranking, segmentation, structure, vectors
from quarrygrid.operators.graph_core import min_label_components
from quarrygrid.sources import corpus
from quarrygrid.streaming import jobs

NOTE = """---
title: Note
---
# One
text

## Two
```
# no heading
```
### Four
- a
- b
# Five

"""


def test_sections_and_fences(spark):
    docs = spark.createDataFrame([(1, NOTE), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.heading_path, r.start_line, r.end_line) for r in structure.md_sections(docs).orderBy("section_no").collect()]
    assert got == [([], 1, 3), (["One"], 4, 6), (["One", "Two"], 7, 10), (["One", "Two", "Four"], 11, 13), (["Five"], 14, 15)]


def test_fences_close_by_marker_and_length(spark):
    text = "# A #\n````\n# no\n```\n~~~\n# no\n`````\n## B  ##\n   ~~~ x\n```\n# no\n~~~~\ntail\n\nend\n#C\n#  \n"
    docs = spark.createDataFrame([(1, text), (2, "```\nopen\n# no")], "doc_id long, text string")
    got = [(r.doc_id, r.heading_path, r.level, r.start_line, r.end_line) for r in structure.md_sections(docs).orderBy("doc_id", "section_no").collect()]
    assert got == [(1, ["A"], 1, 1, 7), (1, ["A", "B"], 2, 8, 16), (1, [""], 1, 17, 17), (2, [], 0, 1, 3)]
    blocks = [(r.start_line, r.end_line, r.text.split("\n")[0]) for r in structure.md_blocks(docs).where("doc_id = 1").orderBy("block_no").collect()]
    assert blocks == [(1, 7, "# A #"), (8, 12, "## B  ##"), (13, 13, "tail"), (15, 17, "end")]
    assert [r.line_no for r in structure.text_lines(docs).where("doc_id = 1 and not fenced").orderBy("line_no").collect()] == [1, 8, 13, 14, 15, 16, 17]


def test_sections_are_packed_and_long_ones_split(spark):
    """Cases by hand: packing to the target, no growth beyond the maximum, blocks, code and sentences of a long section."""
    fold = lambda xs, target, maximum: [(p, t, a, b) for p, t, a, b in chunking.fold_sections(xs, target, maximum)]
    s = lambda t, n, path=("h",): (t, path, n, n)
    assert fold([s("aaaa", 1), s("bb", 2), s("  ", 3), s("cccc", 4)], 8, 12) == [(("h",), "aaaa\n\nbb", 1, 2), (("h",), "cccc", 4, 4)]
    assert fold([s("a" * 7, 1), s("b" * 7, 2), s("c", 3)], 6, 12) == [(("h",), "a" * 7, 1, 1), (("h",), "b" * 7, 2, 2), (("h",), "c", 3, 3)]
    # what overflows stays open, even beyond the target
    assert fold([s("a" * 3, 1), s("b" * 9, 2), s("c", 3)], 8, 12) == [(("h",), "a" * 3, 1, 1), (("h",), "b" * 9 + "\n\nc", 2, 3)]
    assert fold([s("a", 1, ()), s("b", 2)], 8, 12) == [(("h",), "a\n\nb", 1, 2)]
    long = "First one. Second!\n\n```\n" + "x" * 20 + "\n```\nlast"
    assert fold([s("pre", 1), (long, ("h",), 2, 7), s("post", 8)], 50, 12) == [
        (("h",), "pre", 1, 1), (("h",), "First one.", None, None), (("h",), "Second!", None, None), (("h",), "```\n" + "x" * 20 + "\n```", 4, 6), (("h",), "last", 7, 7), (("h",), "post", 8, 8),
    ]
    assert chunking.split_text("z" * 25, 10) == ["z" * 10, "z" * 10, "z" * 5]


def test_chunk_variants_by_structure(spark):
    """No chunk crosses a heading, lists and tables stay whole, words keep their order, and sizes hold; the base variant is ``chunk_sections``."""
    rng = random.Random(6)
    table, items = "\n".join("| a | b |" for _ in range(120)), "\n".join(f"- item {i} of a list" for i in range(60))
    rows = []
    for d in range(5):
        for i in range(8):
            body = " ".join(rng.choice(["lorem", "ipsum."]) for _ in range(rng.randrange(1, 400)))
            rows.append((d, i, ["a" if i < 4 else "b"], body if i % 3 else f"{body}\n\n{table}\n\n{items}", 1000 * i + 1, 1000 * i + 990))
    df = spark.createDataFrame(rows, "doc_id long, section_no long, heading_path array<string>, content string, start_line int, end_line int")
    got = {}
    for r in chunking.chunk_variants(df).orderBy("chunk_index").collect():
        got.setdefault((r.variant, r.doc_id), []).append(r)
    base = {d: [r.content for r in chunking.chunk_sections(df).where(f"doc_id = {d}").orderBy("chunk_index").collect()] for d in range(5)}
    for name, target, maximum, by_structure, overlap in chunking.VARIANTS:
        for d in range(5):
            own = got[name, d]
            whole = " ".join(" ".join(r[3] for r in rows if r[0] == d).split())
            if not by_structure:
                assert [r.content for r in own] == base[d]
                continue
            marks = [r for r in own if r.start_line < 4001 <= r.end_line]
            assert not marks
            assert sum(table in r.content for r in own) == 3 and sum(items in r.content for r in own) == 3
            long = [r for r in own if len(r.content) > maximum + overlap + 1]
            assert all(table in r.content or items in r.content for r in long)
            if not overlap:
                assert " ".join(" ".join(r.content for r in own).split()) == whole
            else:
                plain = [r.content for r in got["leaf", d]]
                assert all(b.content.endswith(a) and len(b.content) <= len(a) + overlap + 1 for a, b in zip(plain, own, strict=True))


def test_frontmatter(spark):
    texts = [NOTE, "---\n---\nx", "---\nopen", "---\n- a\n---\n", "---\na: [\n---\n", "plain", None]
    got = structure.md_frontmatter(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.error for r in got] == [None, None, "unclosed", "not_a_mapping", "invalid", None, None]
    assert got[0].frontmatter_json == '{"title": "Note"}' and got[0].body_start == 4 and got[1].frontmatter_json == "{}"


def test_html_blocks(spark):
    html = "<title>T</title><script>var x='</p>'</script><h1>A</h1><p>one<p>two<br>three</p><table><tr><td>1<td>2<tr><td>3</table><ul><li>x</ul><nav><p>no</nav><img alt='pic'>"
    got = structure.html_blocks(spark.createDataFrame([(1, html, "u"), (2, None, "u")], "page_id long, html string, url string")).orderBy("ordinal").collect()
    assert [(r.kind, r.text) for r in got] == [("heading", "A"), ("paragraph", "one"), ("paragraph", "two three"), ("cell", "1"), ("cell", "2"), ("cell", "3"), ("list_item", "x"), ("figure", "pic")]
    assert [(r.row, r.col) for r in got if r.kind == "cell"] == [(0, 0), (0, 1), (1, 0)]
    assert {r.title for r in got} == {"T"}


def test_split_text_keeps_all_words_and_limits():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice(["word ", "end. ", "\n\n", "\n- ", "longerword"]) for _ in range(200)).strip()
        parts = chunking.split_text(text, 120)
        assert all(len(p) <= 120 for p in parts)
        assert "".join("".join(parts).split()) == "".join(text.split())
    assert chunking.split_text("```\n" + "x" * 500 + "\n```", 100) == ["```\n" + "x" * 500 + "\n```"]


def test_chunk_blocks_keeps_tables_whole(spark):
    rows = [(1, i, i, i // 2, "table" if i == 1 else "paragraph", "x " * (600 if i == 1 else 20), 0) for i in range(4)]
    got = chunking.chunk_blocks(spark.createDataFrame(rows, "doc_id long, block_id long, ordinal long, section_id long, block_type string, text string, page long"), 100, 200).orderBy("chunk_index").collect()
    assert [r.block_ids for r in got] == [[0], [1], [2, 3]] and len(got[1].content) == 1200


def test_dedup_is_greedy_not_transitive(spark):
    rows = [(1, 10, 5, 1, 1, 10, "a"), (1, 11, 5, 2, 3, 12, "b"), (1, 12, 5, 3, 5, 14, "c"), (1, 13, 6, 4, 1, 10, "a"), (1, 10, 5, 5, 90, 99, "z"), (1, 14, 5, 6, 50, 60, "a")]
    got = ranking.dedup_candidates(spark.createDataFrame(rows, "query_id long, chunk_id long, doc_id long, rank int, start_line int, end_line int, content_hash string"))
    # 11 overlaps 10 by eight of ten lines and goes; 12 overlaps 11 as much, but 10 by six only, and stays
    assert [r.chunk_id for r in got.orderBy("dedup_rank").collect()] == [10, 12, 13]


def test_context_budget_passes_over_what_does_not_fit(spark):
    rows = [(1, i, d, i, n) for i, (d, n) in enumerate([(1, 60), (1, 50), (2, 30), (2, 5), (2, 5), (3, 5)], 1)]
    got = ranking.context_budget(spark.createDataFrame(rows, "query_id long, chunk_id long, doc_id long, rank int, n_tokens int"), 100, 5, 2).where("context_rank is not null").orderBy("context_rank").collect()
    assert [r.chunk_id for r in got] == [1, 3, 4, 6]


def test_evidence_compose_seeds_protected_lanes(spark):
    rows = [(1, i, i, 0, "graph" if i == 9 else "dense", i) for i in range(1, 10)]
    got = {r.chunk_id: r.reason for r in ranking.evidence_compose(spark.createDataFrame(rows, "query_id long, chunk_id long, doc_id long, section_id long, lane string, rank int")).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 9, 5)] == ["selected_head"] * 3 + ["selected_rank", "selected_protected", "rejected_budget"]


def test_rerank_takes_a_function(spark):
    rows = [(1, i, i, "q", [], "x" * (10 - i)) for i in range(1, 6)]
    cands = spark.createDataFrame(rows, "query_id long, chunk_id long, retrieval_rank int, query_text string, heading_path array<string>, content string")
    got = ranking.rerank(cands, 4, lambda q, p: -p.str.len().astype(float)).orderBy("rerank_rank").collect()
    assert [r.chunk_id for r in got] == [4, 3, 2, 1]


def test_lsh_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 32))
    rows = [(i, (centres[i % 20] + 0.3 * rng.standard_normal(32)).tolist()) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query_vector")
    exact, near = ({(r.query_id, r.vec_id) for r in f(queries, table, 5).collect()} for f in (vectors.vector_topk, vectors.vector_topk_lsh))
    assert len(exact & near) / len(exact) >= 0.9


def test_vector_topk_takes_queries_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.selectExpr("vec_id as query_id", "embedding as query_vector")
    one = sorted(map(tuple, vectors.vector_topk(queries, table, 3).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, vectors.vector_topk(queries, table, 3).collect())) == one
    assert vectors.vector_topk(queries.limit(0), table, 3).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in min_label_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(60):
        for a, b in edges:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_claim_values():
    values = lambda t: sorted(answers.checkable_values(t))
    assert values("Run --fast on 2024-01-02 at 10:30, see https://a.b/c v1.2.3 or 42% of MY_VAR") == sorted(["https://a.b/c", "--fast", "MY_VAR", "v1.2.3", "2024-01-02", "10:30", "42%", "Run"])
    assert values("Edit `git add -A`, src/main.rs or notes.txt in my-tool with snake_case, press C+x; 7 of 12 [C3] JSON5") == sorted(["src/main.rs", "git add -A", "C+x", "JSON5", "snake_case", "my-tool", "notes.txt", "7", "12", "Edit"])
    assert answers.checkable_values("nothing to check here [C12]") == []


def test_claim_support(spark):
    """Values that none of the cited texts holds, against a plain search; a claim without citation has no support."""
    claims = [(1, 0, "uses 42 and my-tool", "C1"), (1, 1, "uses 43 in v2.0", "C1,C2"), (1, 2, "7 alone", ""), (1, 3, "no value", "C1")]
    evidence = [(1, "C1", "42 things in my-tool"), (1, "C2", "v2.0 is out"), (2, "C1", "43")]
    got = answers.claim_support(spark.createDataFrame(claims, "query_id long, claim_no long, claim string, citations string"), spark.createDataFrame(evidence, "query_id long, citation_id string, content string"))
    want = []
    for q, n, claim, cited in claims:
        texts = [t for i, c, t in evidence if i == q and c in cited.split(",")]
        values = answers.checkable_values(claim)
        want.append((q, n, len(values), "|".join(v for v in values if not any(v in t for t in texts)) if cited or values else claim))
    assert sorted(tuple(r) for r in got.select("query_id", "claim_no", "n_values", "unsupported").collect()) == want


def test_checkable_values_of_a_claim():
    """Each kind of value on its own; plain words and signs are none."""
    cases = {
        "It takes 42 steps, 3.5% more.": ["It", "42", "3.5%"], "see https://a.example/x?y=1), ok": ["https://a.example/x?y=1"], "run `make all` with --dry-run": ["make all", "--dry-run"],
        "in src/lib/io.py and setup.cfg": ["src/lib/io.py", "setup.cfg"], "set MAX_ROWS or max_rows": ["MAX_ROWS", "max_rows"], "on 2024-05-17 at 10:30, v1.2.3-rc1": ["2024-05-17", "10:30", "v1.2.3-rc1"],
        "press Ctrl+C [C1]": ["Ctrl+C"], "plain words only - and / or + signs ...": [], "使用42个": ["42"], "": [], "(see Berlin; \"x9\")": ["Berlin", "x9"], "7 and 7": ["7"],
    }
    assert {t: answers.checkable_values(t) for t in cases} == cases


def test_support_of_path_and_heading(spark):
    claims = spark.createDataFrame([(1, 0, "in Setup 7", "C1"), (1, 1, "nothing cited", ""), (1, 2, "no value", "C9")], "query_id long, claim_no long, claim string, citations string")
    evidence = spark.createDataFrame([(1, "C1", "guide/7.md", ["Setup"], "text")], "query_id long, citation_id string, path string, heading_path array<string>, content string")
    got = {r.claim_no: r.unsupported for r in answers.claim_support(claims, evidence).collect()}
    assert got == {0: "", 1: "nothing cited", 2: ""}


def brute_split(text, maximum):
    """The best of all cuts by the rule: at the best rank that a too long text has, its parts put together greedily from the left."""
    marks = {0: r"\s*\n\n\s*", 1: r"\s*\n(?=(?:[-*+]|\d+\.)(?:\s|$))", 2: r"(?<=[.!?。！？])\s+"}

    def cut(t, rank):
        t = t.strip()
        if len(t) <= maximum:
            return [t]
        if rank == 3:
            return [t[i : i + maximum] for i in range(0, len(t), maximum)]
        parts = re.split("|".join(marks[r] for r in range(rank + 1)), t)
        out, held = [], None
        for p in parts:
            if held is not None and len(held) + 2 + len(p) <= maximum and len(p) <= maximum:
                held += "\n\n" + p
                continue
            out += [held] if held is not None else []
            held = None
            if len(p) > maximum:
                out += cut(p, rank + 1)
            else:
                held = p
        return out + ([held] if held is not None else [])

    return [text] if len(text) <= maximum else cut(text, 0)


def test_split_oversized_equals_brute_force(spark):
    rng = random.Random(12)
    bits = ["word", "longer words here", "end. ", "what? ", "\n\n", "\n- item ", "\n2. ", " ", "x" * 40, "句。", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    got = {}
    for r in chunking.split_oversized(rows, 50).orderBy("doc_id", "piece_no").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {i: brute_split(t, 50) for i, t in enumerate(texts)}


def test_reading_order(spark):
    texts = spark.createDataFrame([(1, "aa bb cc dd")], "doc_id long, text string")
    snippets = spark.createDataFrame([(1, 0, "aa"), (1, 1, "cc"), (1, 2, "bb"), (1, 3, "dd")], "doc_id long, ordinal long, snippet string")
    assert evaluation.reading_order(snippets, texts).first().order_fidelity == 0.75


def test_tokenizer_hooks(spark):
    df = spark.createDataFrame([("ﬁle.name Ａ",), ("漢字かな abc",), (None,)], "text string")
    assert sorted(lexical.tokenize_text(df).where("text like '%name%'").first().tokens) == ["a", "file", "file.name", "name"]
    assert lexical.tokenize_text(df, normalizer=None).first().tokens == ["le.name", "le", "name"]
    assert lexical.tokenize_text(df, segmenter=lexical.character_bigrams).collect()[1].tokens == ["abc", "漢字", "字か", "かな"]
    kb = df.selectExpr("'k' AS kb_id", "monotonically_increasing_id() AS chunk_id", "text AS content")
    found = lexical.term_frequencies(kb, segmenter=lexical.character_bigrams)
    assert {r.term for r in found.collect()} == {"file.name", "file", "name", "a", "abc", "漢字", "字か", "かな"}
    queries = spark.createDataFrame([(1, "k", "字か")], "query_id long, kb_id string, text string")
    top = lexical.bm25_topk(queries, kb.selectExpr("*", "'p' AS path", "1 AS start_line"), segmenter=lexical.character_bigrams).collect()
    assert len(top) == 1 and top[0].matched_terms == ["字か"]


def test_tokens_of_any_length(spark):
    """A run of a million characters of joined words passes, in Java and in Python."""
    texts = [mark.join(["a"] * 500_000) for mark in "./-_"] + ["--" + "a-" * 500_000, "a" * 1_000_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    wide = rows.select("doc_id", lexical.tokens(F.col("text")).alias("tokens")).select("doc_id", F.size("tokens").alias("n"), F.element_at("tokens", 1).alias("first"))
    assert {r.doc_id: (r.n, len(r.first)) for r in wide.collect()} == {i: (2 if i < 5 else 1, len(t)) for i, t in enumerate(texts)}
    assert [len(lexical.text_tokens(t)) for t in texts] == [2] * 5 + [1]
    counted = lexical.counted_terms(rows.withColumn("kb_id", F.lit("k")), "doc_id", F.col("text"))
    assert {r.document_length for r in counted.collect()} == {1, 2}


def test_tokens_alike_in_java_and_python(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abZ9é/.-_ \n中") for _ in range(rng.randrange(40))) for _ in range(300)] + ["--", "--a--b", "a..b", "-a", "a.", "--a-/b", "É"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in rows.select("doc_id", lexical.tokens(F.col("text")).alias("tokens")).collect()}
    assert got == {i: lexical.text_tokens(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("cells", "pairs"), [(4_000_000, 4_000_000), (40, 7)])
def test_bm25_equals_plain_scores(spark, monkeypatch, cells, pairs):
    """Several kbs, ties in numbers, chunks without tokens, and blocks so small that bounds pass over many queries."""
    rng = random.Random(cells)
    word = lambda: f"w{int(rng.paretovariate(0.7))}"
    docs = [(kb, i, rng.choice(["a", "b", None]), rng.choice([None, 1, 2]), " ".join(word() for _ in range(rng.randrange(0, 25)))) for kb in ("x", "y") for i in range(120)]
    docs += [("x", 500 + i, "p", i % 3, docs[3][4]) for i in range(60)]
    asked = [(i, rng.choice(["x", "y", "z"]), " ".join(word() for _ in range(rng.randrange(0, 6)))) for i in range(40)]
    chunks = spark.createDataFrame(docs, "kb_id string, chunk_id long, path string, start_line int, content string")
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    got = lexical.bm25_topk(spark.createDataFrame(asked, "query_id long, kb_id string, text string"), chunks, 5)
    got = sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6), r.n_matched) for r in got.collect())
    want = []
    for q, kb, text in asked:
        own = [(c, p, s, t.split()) for k, c, p, s, t in docs if k == kb and t]
        average, found = sum(len(t) for *_, t in own) / max(1, len(own)), []
        for c, p, s, t in own:
            shared = [w for w in set(text.split()) if w in t]
            df = {w: sum(w in x for *_, x in own) for w in shared}
            score = sum(math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / average)) for w in shared)
            if shared:
                found.append((-round(score, 9), p is not None, p or "", s is None, s or 0, c, len(shared)))
        want += [(q, i + 1, f[5], round(-f[0], 6), f[6]) for i, f in enumerate(sorted(found)[:5])]
    assert got == sorted(want)


def test_tokens_of_flags_and_joined_words(spark):
    """Nothing is a stop word; flags and words joined by dots, slashes, hyphens or underscores come whole, then by parts, each once."""
    cases = {
        "the --dry-run flag": ["the", "--dry-run", "dry", "run", "flag"], "src/my_lib/io-utils.py": ["src/my_lib/io-utils.py", "my_lib", "io-utils", "src", "my", "lib", "io", "utils", "py"],
        "a/a and A-a": ["a/a", "a", "and", "a-a", "a"], "Über-Größe": ["Über-größe", "Über", "größe"], "x - y -- z": ["x", "y", "z"], "": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    assert {r.text: sorted(r.tokens) for r in lexical.tokenize_text(df).collect()} == {t: sorted(x) for t, x in cases.items()}


def test_scan_corpus(spark, tmp_path):
    for name in ("a.md", "sub/b.md", ".hidden/c.md", "node_modules/d.md", "e.txt", "sub/skip.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = corpus.scan_corpus(spark, f"file://{tmp_path}", ("md",), ignored_globs=("sub/skip*",)).collect()
    assert sorted(r.relative_path for r in got) == ["a.md", "sub/b.md"]


def test_scan_corpus_gives_failures_as_rows(spark, tmp_path):
    import hashlib

    for name in ("a.md", "deep/er/b.MD", "node_modules/x/d.md", ".git/e.md", "deep/skip/f.md", "deep/big.md", "g.txt", "ü n.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name * (1000 if "big" in name else 1))
    (tmp_path / "empty").mkdir()
    (tmp_path / "broken.md").symlink_to(tmp_path / "nothing.md")
    (tmp_path / "loop").symlink_to(tmp_path)
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        got = {r.relative_path: r for r in corpus.scan_corpus(spark, root, (".md",), ignored_globs=("deep/skip",), max_bytes=5000).collect()}
        assert {p: r.error for p, r in got.items()} == {"a.md": None, "deep/er/b.MD": None, "ü n.md": None, "deep/big.md": "too_large", "broken.md": "broken_symlink"}
        for path in ("a.md", "deep/er/b.MD", "ü n.md"):
            assert (got[path].size, got[path].content_hash, got[path].extension) == (len(path.encode()), hashlib.sha256(path.encode()).hexdigest(), "md")
        assert (got["deep/big.md"].stage, got["deep/big.md"].size, got["broken.md"].stage) == ("metadata", 11000, "discover")
    assert corpus.scan_corpus(spark, str(tmp_path / "empty")).collect() == []
    missing = corpus.scan_corpus(spark, str(tmp_path / "gone")).collect()
    assert [(r.stage, r.error) for r in missing] == [("discover", "FileNotFoundError")]


def test_scan_of_the_tables_equals_brute_force(spark, sf_dir):
    import hashlib
    import pathlib

    from quarrygrid.plans import sources

    paths = [p for p in pathlib.Path(sf_dir).rglob("*.parquet") if p.is_file()]
    want = sorted((p.relative_to(sf_dir).as_posix(), p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in paths)
    assert sorted((r.relative_path, r.size, r.content_hash) for r in sources.scan_corpus(spark, sf_dir).collect()) == want


class Shaky:
    """A file system whose directories and files fail as they are told to."""

    type_name = "shaky"

    def __init__(self, files, changes=0):
        self.files, self.changes, self.opened = files, changes, []

    def get_file_info(self, path):
        import types

        if not isinstance(path, str):
            self.opened.append(path.base_dir)
            raise PermissionError(path.base_dir)
        if path not in self.files:
            raise FileNotFoundError(path)
        self.changes -= 1
        return types.SimpleNamespace(size=len(self.files[path]), mtime=None, mtime_ns=max(self.changes, 0))

    def open_input_stream(self, path):
        import io

        if self.files[path] is None:
            raise PermissionError(path)
        return io.BytesIO(self.files[path])


def test_files_that_vanish_change_or_cannot_be_read(monkeypatch):
    import hashlib

    monkeypatch.setattr(corpus, "BLOCK_BYTES", 3)
    text = b"0123456789"
    store = Shaky({"a": text})
    assert corpus.digest_file(store, "a")[2:] == (hashlib.sha256(text).hexdigest(), None, None, None)
    # changed once: read again; changed each time: an error
    assert corpus.digest_file(Shaky({"a": text}, 3), "a")[2] == hashlib.sha256(text).hexdigest()
    assert corpus.digest_file(Shaky({"a": text}, 9), "a")[3:5] == ("hash", "unstable_file")
    assert corpus.digest_file(store, "b")[3:5] == ("hash", "FileNotFoundError")
    closed = Shaky({"a": text})
    closed.open_input_stream = lambda path: (_ for _ in ()).throw(PermissionError(path))
    assert corpus.digest_file(closed, "a")[3:5] == ("hash", "PermissionError")
    assert corpus.list_directory(store, "/r", "/r/x", {"globs": []}) == ([], [("x", None, None, "discover", "PermissionError", "/r/x")])


def test_ignored_directories_are_not_listed(tmp_path, monkeypatch):
    for name in ("a/b/c.md", "a/.hid/c.md", "node_modules/c.md", "a/out/c.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    listed = []
    whole = corpus.list_directory
    monkeypatch.setattr(corpus, "list_directory", lambda store, base, path, rules: (listed.append(path[len(str(tmp_path)) :]), whole(store, base, path, rules))[1])
    reader = corpus.CorpusListing(str(tmp_path), {"extensions": ["md"], "directories": ["node_modules"], "globs": ["*/out"], "most": None}, 3)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[0] for r in rows] == ["a/b/c.md"] and sorted(listed) == ["", "/a", "/a/b"]


def test_scan_of_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    for name in ("a.md", "sub/b.md", "node_modules/c.md", "sub/skip.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    kept = lambda: sorted((r.relative_path, r.size, r.content_hash, r.error) for r in corpus.scan_corpus(spark, f"file://{tmp_path}", ("md",), ignored_globs=("sub/sk*",)).collect())
    want = kept()
    monkeypatch.setattr(corpus, "open_store", lambda root: None)
    assert len(want) == 2 and kept() == want
    large = corpus.scan_corpus(spark, f"file://{tmp_path}", ("md",), max_bytes=5).collect()
    assert sorted((r.relative_path, r.error) for r in large) == [("a.md", None), ("sub/b.md", "too_large"), ("sub/skip.md", "too_large")]


def test_stream_drops_late_rows_and_replaces_documents(spark, tmp_path):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [[(0, day, "view", 1.0)], [(1, day + dt.timedelta(days=3), "view", 2.0)], [(4, day + dt.timedelta(days=3), "view", 5.0)], [(2, day, "view", 9.0), (3, day + dt.timedelta(days=3), "error", 4.0)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/s/events.parquet", mode="append")
        import time

        time.sleep(1.1)  # files are taken in the order of their times
    out = jobs.run_to_table(jobs.stream_monitor(jobs.read_stream(spark, f"file://{tmp_path}/s", "events", 1)), "late", "update", ["window_start", "event_type"])
    assert sorted((r.window_start.day, r.event_type, r.n_requests) for r in out.collect()) == [(1, "view", 1), (4, "error", 1), (4, "view", 2)]
    for batch in ([(1, "one two", 1), (2, "old words", 1), (3, "new", 2), (3, "old", 1), (4, "kept", 1)], [(1, "three", 2), (2, "...", 2), (5, None, 1)]):
        spark.createDataFrame(batch, "doc_id long, text string, version int").coalesce(1).write.parquet(f"{tmp_path}/s/documents.parquet", mode="append")
        time.sleep(1.1)
    got = jobs.stream_ingest(jobs.read_stream(spark, f"file://{tmp_path}/s", "documents", 1), version="version").collect()
    assert sorted((r.chunk_id, r.term) for r in got) == [(1, "three"), (3, "new"), (4, "kept")]


def test_trace_order_equals_its_batch_form(spark, sf_dir):
    from quarrygrid.plans import sources

    batch = jobs.trace_order(sources._traces(spark.read.parquet(f"{sf_dir}/events.parquet")))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, sources.stream_trace_order(spark, sf_dir).collect()))


def test_graph_edges_are_typed(spark):
    edges = graph.build_edges({"LINKS_TO": spark.createDataFrame([(1, 2), (1, 2), (None, 3)], "source_id long, target_id long")})
    assert [tuple(r) for r in edges.collect()] == [(1, "LINKS_TO", 2, "G1")]


def test_exact_percentiles_and_digest_tree(spark):
    rng = random.Random(3)
    values = [(g, rng.randrange(50)) for g in "ab" for _ in range(301)] + [("c", 7), ("d", None)]
    got = {r.g: r for r in evaluation.latency_summary(spark.createDataFrame(values, "g string, latency_ms int"), ["g"]).collect()}
    for g in "abc":
        own = sorted(v for k, v in values if k == g)
        for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert got[g][name] == own[-(-round(len(own) * q * 100) // 100) - 1]
    assert "d" not in got
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "path long, text string")
    digest = lambda d: corpus.corpus_manifest(d)[1].first().corpus_digest
    assert digest(docs) == digest(docs.orderBy("text").repartition(3)) != digest(docs.where("path <> 3"))


def test_containment_of_short_items_and_leakage_without_candidates(spark):
    docs = [(1, "alpha beta gamma delta epsilon"), (2, "xalphabetagammax"), (3, "one two-three four"), (4, None), (5, "")]
    items = [(1, "beta gamma delta"), (2, "alphabetagamma"), (3, "wo two-three f"), (4, "ne two-three four"), (5, "epsilon zeta eta theta"), (6, "a beta gamma d")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((k, n) for k, x in items for n, t in docs if t and len(x) >= 12 and x in t)
    assert sorted(map(tuple, evaluation.containment_scan(i, d).select("item_id", "doc_id").collect())) == want
    got = sorted(map(tuple, evaluation.leakage_scan(i.unionByName(spark.createDataFrame([(7, "ONE two, three four!"), (8, "alpha beta gamma delta epsilon")], i.schema)), d).collect()))
    assert got == [(7, 3, "normalized"), (8, 1, "exact")]
    assert evaluation.leakage_scan(i.limit(0), d).count() == 0 and evaluation.containment_scan(i, d.limit(0)).count() == 0


def test_parser_table_function(spark):
    from quarrygrid.functions import parsers

    rows = [(1, "md", "# A\ntext\n\n```\n# x\n```"), (2, "HTML", "<h2>B</h2><p>p</p>"), (3, "tex", "\\section{C} one % no\n\ntwo"), (4, "pdf", "%PDF"), (5, "md", None), (6, "md", "")]
    docs = spark.createDataFrame(rows, "doc_id long, representation string, text string")
    want = [(1, 0, "heading", 1, "A"), (1, 1, "paragraph", None, "text"), (1, 2, "code", None, "```\n# x\n```"), (2, 0, "heading", 2, "B"), (2, 1, "paragraph", None, "p"), (3, 0, "heading", 2, "C"), (3, 1, "paragraph", None, "one"), (3, 2, "paragraph", None, "two"), (4, 0, "error", None, "unsupported representation: pdf")]
    got = parsers.parse_blocks(docs).orderBy("doc_id", "ordinal").select("doc_id", "ordinal", "kind", "level", "block_text").collect()
    assert [tuple(r) for r in got] == want
    parsers.register(spark)
    docs.createOrReplaceTempView("parsed_docs")
    assert spark.sql("SELECT b.* FROM parsed_docs d, LATERAL parse_blocks(d.representation, d.text) b").count() == len(want)
    assert parsers.supported_representations() == ("html", "markdown", "tex")


def test_embed_pending_vectors(spark):
    """Only changed and accepted inputs are embedded; the vectors equal a plain hashed bag of words."""
    import zlib

    def plain(text):
        v = np.zeros(64)
        for w in text.split():
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h >> 31 else -1
        return v / np.linalg.norm(v) if v.any() else v

    rows = [(1, 10, "red blue", "h1", None), (1, 11, "red red", "h2", None), (2, 12, "", "h3", None), (2, 13, "green", "h4", "too_long"), (3, 14, "kept text", "h5", None)]
    inputs = spark.createDataFrame(rows, "doc_id long, chunk_id long, input_text string, input_hash string, reject string")
    existing = spark.createDataFrame([(11, "old", [1.0] + [0.0] * 63), (14, "h5", [0.0] * 63 + [1.0])], "chunk_id long, input_hash string, embedding array<float>")
    found, per_doc = vectors.embed_pending(inputs, existing)
    got = {r.chunk_id: (r.fresh, list(r.embedding)) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {10: True, 11: True, 12: True, 14: False}
    for chunk, text in ((10, "red blue"), (11, "red red"), (12, "")):
        assert np.allclose(got[chunk][1], plain(text), atol=1e-6)
    assert {r.doc_id: (r.n_chunks, r.n_embedded, r.complete) for r in per_doc.collect()} == {1: (2, 2, True), 2: (2, 0, False), 3: (1, 1, True)}


def test_embed_pending_counts_row_by_row(spark, tmp_path):
    """Words whose signs cancel each other out, ids that repeat or are null and sources that are null, as in the query's SQL."""
    import zlib

    import duckdb
    import pandas as pd

    from quarrygrid.plans.registry import ORACLE_SQL, QUERIES

    h = zlib.crc32(b"news")
    other = next(w for w in (f"w{i}" for i in range(100_000)) if zlib.crc32(w.encode()) % 64 == h % 64 and zlib.crc32(w.encode()) >> 31 != h >> 31)
    assert np.linalg.norm(vectors.hashed_features(pd.Series([f"news {other}"]))[0]) == pytest.approx(1)
    rows = [(1, other, "news"), (3, "a b", "news"), (3, "c d", "news"), (2, "x", "news"), (2, "y", "news"), (None, "x", "news"), (None, "", "news"), (6, None, "news"), (7, "x", None), (9, "x", "")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["embed_pending"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.execute(ORACLE_SQL["embed_pending"]).fetchall(), key=str)


def test_chunk_inventory_counts_texts_once(spark):
    """No buffer of all lengths for each text, which the job before had; null texts count as chunks, but neither as lengths nor as texts."""
    rng = random.Random(4)
    rows = [(v, d, None if rng.random() < 0.1 else "x" * rng.randrange(9) + rng.choice("ab")) for v in ("p", "q") for d in range(30) for _ in range(rng.randrange(1, 5))] + [("r", 1, None)]
    out = chunking.chunk_inventory(spark.createDataFrame(rows, "variant string, doc_id long, content string"))
    assert "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.variant: r for r in out.collect()}
    for v in "pqr":
        texts = [t for w, _, t in rows if w == v]
        n = sorted(len(t) for t in texts if t is not None)
        nearest = lambda q, n=n: n[max(math.ceil(len(n) * q), 1) - 1] if n else None
        r = got[v]
        assert (r.n_chunks, r.p50_length, r.p95_length, r.max_length) == (len(texts), nearest(0.5), nearest(0.95), max(n, default=None))
        assert r.mean_length == (pytest.approx(sum(n) / len(n)) if n else None)
        assert r.repeated_share == pytest.approx(1 - len({t for t in texts if t is not None}) / len(texts))


def test_lsh_pairs_are_those_of_common_buckets(spark, monkeypatch):
    """Equal to buckets and cosines written out, with several blocks of queries and rows; nothing is written on the way, as pairs were."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 12)) + 0.4
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 50)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 12), (902, [0.0] * 12)], "vec_id long, embedding array<double>")
    queries = table.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query_vector")
    monkeypatch.setattr("quarrygrid.common.scratch_path", lambda *_: pytest.fail("pairs are written"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.similarity) for r in vectors.vector_topk_lsh(queries, table, 4, tables=3, bits=5, flips=2).where("vec_id < 900 and query_id < 900").collect())
    margins = (x @ np.random.default_rng(5).standard_normal((12, 15))).reshape(300, 3, 5)
    signs, unsure = margins > 0, np.argsort(np.abs(margins), axis=2)[..., :2]
    unit, want = x / np.linalg.norm(x, axis=1, keepdims=True), []
    for i in range(0, 300, 20):
        looked = [{tuple(signs[i, t]), *(tuple(signs[i, t] ^ (np.arange(5) == b)) for b in unsure[i, t])} for t in range(3)]
        met = [j for j in range(300) if any(tuple(signs[j, t]) in looked[t] for t in range(3))]
        best = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j in met)[:4]
        want += [(i, n, j, pytest.approx(-s, abs=1e-9)) for n, (s, j) in enumerate(best, 1)]
    assert got == want


def test_parent_child_topk_without_a_join_by_parent(spark, monkeypatch):
    """Equal to cosines written out, with several blocks of queries; children aren't joined by their parent, where all of one came together."""
    rng = np.random.default_rng(8)
    x, label = rng.standard_normal((240, 6)), rng.integers(0, 5, 240)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    table = spark.createDataFrame([(i, v.tolist(), int(p)) for i, (v, p) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    queries = table.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query_vector")
    out = ranking.parent_child_topk(queries, table, "label", k=4)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    means, want = unit(np.array([x[label == p].mean(0) for p in range(5)])), []
    for i in range(0, 240, 20):
        near = sorted((-round(float(unit(x[i]) @ m), 6), p) for p, m in enumerate(means))[:2]
        inside = sorted((-round(float(unit(x[i]) @ unit(x[j])), 6), j) for j in range(240) if label[j] in {p for _, p in near})[:4]
        want += [(i, n, j, int(label[j]), pytest.approx(-s, abs=1e-9)) for n, (s, j) in enumerate(inside, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.label, r.similarity) for r in out.collect()) == want


def test_vector_topk_passes_over_bad_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.selectExpr("vec_id as query_id", "embedding as query_vector")
    got = sorted((r.query_id, r.vec_id) for r in vectors.vector_topk(queries, table, 3).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (4, 4)]
    with pytest.raises(ValueError):
        vectors.vector_topk(queries, table.selectExpr("cast(vec_id as string) as vec_id", "embedding"), 3)


def test_traces_in_any_order_and_batches(spark, tmp_path):
    """Shuffled and repeated events over many batches give what the batch form gives, and come out in order, each once."""
    rng = random.Random(21)
    events = [(t, s, f"p{s}", s == 12) for t in (1, 2, 3) for s in range(1, 13) if (t, s) not in ((2, 5), (3, 1), (3, 7), (3, 8))]
    sent = events * 2
    rng.shuffle(sent)
    schema = "trace_id long, sequence long, payload string, terminal boolean"
    for i in range(0, len(sent), 9):
        spark.createDataFrame(sent[i : i + 9], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    got = jobs.run_to_table(jobs.stream_trace_order(stream.select("trace_id", "sequence")), "traces", "update", ["trace_id"])
    want = jobs.trace_order(spark.createDataFrame(events, schema).select("trace_id", "sequence"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    shown = sorted((r.trace_id, r.position, r.sequence, r.payload) for r in jobs.run_to_table(jobs.stream_trace_events(stream, resume_after=2), "ordered").collect())
    # what waits behind a gap that never closes isn't delivered without a time-out
    assert shown == [(1, i + 1, s, f"p{s}") for i, s in enumerate(range(3, 13))] + [(2, i + 1, s, f"p{s}") for i, s in enumerate((3, 4))] + [(3, i + 1, s, f"p{s}") for i, s in enumerate((3, 4, 5, 6))]


def test_report_of_parts_equals_that_of_the_whole(spark):
    schema = "release string, scope string, terminal string, fallback_required boolean, fallback_success boolean, latency_ms double, leaks int"
    rows = [("a", "ask", "done", True, True, 2.0, 0), ("a", "ask", None, True, None, None, None), ("a", "search", "done", None, True, 4.0, 3), (None, "ask", "lost", False, None, None, 0), ("b", "ask", "done", False, False, 1.0, 0)]
    obs = spark.createDataFrame(rows, schema)
    got = {(r.release, r.scope): r for r in evaluation.release_report(obs, ["leaks"]).collect()}
    assert set(got) == {("a", "ask"), ("a", "search"), ("a", "*"), (None, "ask"), (None, "*"), ("b", "ask"), ("b", "*"), ("*", "*")}
    whole = got["*", "*"]
    assert (whole.n_requests, whole.n_fallbacks, whole.n_fallbacks_done, whole.fallback_rate, whole.leaks, whole.safe) == (5, 2, 1, 0.5, 3, False)
    assert list(whole.terminals.items()) == [("done", 3), ("lost", 1), ("unknown", 1)] and abs(whole.mean_ms - 7 / 3) < 1e-12
    assert (got["b", "*"].fallback_rate, got["b", "*"].safe, got[None, "*"].mean_ms) == (1.0, True, None)
    parts = evaluation.monitor_counts(obs.limit(2), ["scope"], ["leaks"]).unionByName(evaluation.monitor_counts(obs.exceptAll(obs.limit(2)), ["scope"], ["leaks"]))
    want = evaluation.monitor_report(evaluation.monitor_counts(obs, ["scope"], ["leaks"]), ["scope"], ["leaks"])
    assert sorted(map(repr, evaluation.monitor_report(parts, ["scope"], ["leaks"]).collect())) == sorted(map(repr, want.collect()))
    assert evaluation.release_report(obs.limit(0), ["leaks"]).collect() == []


def plain_turns(rows, n, budget):
    """What ``stream_turns`` gives for rows in the order in which they arrive."""
    import hashlib

    sessions, out = {}, []
    for session, request, arrived, text, status in rows:
        turns = sessions.setdefault(session, [])
        mine = [i for i, t in enumerate(turns) if request is not None and t["request"] == request]
        if text is None and status is not None:
            if mine and mine[0] == len(turns) - 1:
                turns[-1]["status"] = status
            continue
        made = (None, None, None)
        if not text:
            outcome, number = "refused_empty", None
        elif mine:
            outcome, number = "repeated", mine[0] + 1
        elif turns and turns[-1]["status"] in ("pending", "running"):
            outcome, number = "refused_active", None
        else:
            past = [t["text"] for t in turns][-n:][::-1]
            past = [past[0][:budget], *past[1:]] if past else []
            fit = max(k for k in range(len(past) + 1) if sum(map(len, past[:k])) <= budget)
            made = (fit, sum(map(len, past[:fit])), hashlib.sha256("\n".join(past[:fit][::-1]).encode()).hexdigest())
            turns.append({"request": request, "status": status or "pending", "text": text})
            outcome, number = "created", len(turns)
        out.append((session, request, arrived, outcome, number, *made))
    return out


def test_turns_in_batches_equal_plain_rules(spark, tmp_path):
    import time

    rng = random.Random(5)
    schema = "session_id long, client_request_id string, arrived long, text string, status string"
    rows = []
    for i in range(240):
        kind = rng.random()
        request = rng.choice([None, *(f"r{j}" for j in range(25))])
        if kind < 0.35:
            rows.append((rng.randrange(4), request, i, None, rng.choice(["completed", "failed", "running"])))
        else:
            rows.append((rng.randrange(4), request, i, rng.choice(["", "a", "bcd" * rng.randrange(1, 9)]), rng.choice([None, "running", "completed", "completed"])))
    for at in range(0, 240, 80):
        part = rows[at : at + 80]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).repartition(3).coalesce(1).write.parquet(f"{tmp_path}/in/{at}")
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    with jobs.stored_states(spark):
        got = jobs.run_to_table(jobs.stream_turns(stream, 3, 30), "turns").collect()
    want = plain_turns(rows, 3, 30)
    assert {r[3] for r in want} == {"created", "repeated", "refused_active", "refused_empty"}
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert spark.conf.get(jobs.PROVIDER, "none").count("RocksDB") == 0


def test_turn_context_by_tokens():
    count = lambda t: len(t.split())
    assert jobs.turn_context(["a b c", "d", "e f"], 3, count)[:2] == (2, 3)
    # the newest turn counts as the budget, whatever its length, and nothing fits beside it
    assert jobs.turn_context(["a", "b c d e"], 3, count)[:2] == (1, 3)
    assert jobs.turn_context([], 3, count)[:2] == (0, 0)


def test_runs_of_sequences():
    assert jobs.merged_runs([(1, 2), (6, 7)], [4, 4, 3, 9]) == [(1, 4), (6, 7), (9, 9)] and jobs.merged_runs([], []) == []


def by_paragraphs(docs):
    parts = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n\n")).alias("i", "content"))
    return parts.select("doc_id", (F.col("doc_id") * 100 + F.col("i")).alias("chunk_id"), "content")


def test_ingest_equals_a_batch_build(spark, tmp_path):
    """After any batches, with changed, unchanged, emptied and repeated documents, replays and compaction, all tables equal those of the last texts alone."""
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta eps".split())
    text = lambda: "\n\n".join(" ".join(word() for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(1, 4)))
    index, state = jobs.Ingest(spark, f"file://{tmp_path}/index", by_paragraphs, compact_every=3), {}
    batches = [[(rng.randrange(8), rng.choice([text(), text(), "", None]), v) for v in range(rng.randrange(0, 6))] + [(None, "x", 9)] for _ in range(8)]
    for n, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, "doc_id long, text string, version long")
        index.apply(batch, n, "version")
        if n in (2, 4, 5):
            index.apply(batch, n, "version")  # a replay
        for d, t, _ in rows:
            if d is not None:
                state[d] = t
    index.apply(spark.createDataFrame(batches[1], "doc_id long, text string, version long"), 1, "version")  # long compacted
    assert len(index._folders("batch")) + len(index._folders("base")) <= 4
    fresh = jobs.Ingest(spark, f"file://{tmp_path}/fresh", by_paragraphs)
    fresh.apply(spark.createDataFrame(list(state.items()), "doc_id long, text string"), 0)
    for name in ("postings", "frequencies", "statistics"):
        a, b = (sorted(map(tuple, getattr(x, name)().collect())) for x in (index, fresh))
        assert a == b and a
    assert sorted((r.doc_id, r.digest, r.n_chunks) for r in index.documents().collect()) == sorted((r.doc_id, r.digest, r.n_chunks) for r in fresh.documents().collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_join_equals_brute_force(spark, seed):
    """Spans of all widths, at the ends of bins, repeated, reversed and null; one document holds most of them."""
    rng = random.Random(seed)

    def some(n):
        rows = []
        for i in range(n):
            start = rng.choice([rng.randrange(-300, 3000), 16 * rng.randrange(20), 256 * rng.randrange(4)])
            rows.append((rng.choice([1, 1, 1, 2, None]), i, None if rng.random() < 0.05 else start, start + rng.choice([0, 1, 15, 16, 17, 255, 256, 5000, -1, 1 << 34])))
        return [*rows, *((d, i + n, s, e) for d, i, s, e in rows[:9])]

    xs, ys = some(120), some(90)
    a = spark.createDataFrame(xs, "doc_id int, i int, s long, e long")
    b = spark.createDataFrame(ys, "doc_id int, j int, t long, u long")
    got = sorted((r.doc_id, r.i, r.j) for r in evaluation.overlap_join(a, b, ["doc_id"], ("s", "e"), ("t", "u")).collect())
    fine = lambda d, s, e: d is not None and s is not None and s <= e
    want = sorted((d, i, j) for d, i, s, e in xs if fine(d, s, e) for f, j, t, u in ys if fine(f, t, u) and d == f and s <= u and t <= e)
    assert got == want and len(want) > 500
    assert evaluation.overlap_join(a.limit(0), b, ["doc_id"], ("s", "e"), ("t", "u")).count() == 0


@pytest.mark.parametrize("gap", [0, 3])
def test_merged_spans_across_blocks(spark, monkeypatch, gap):
    monkeypatch.setattr(evaluation, "MERGE_BLOCK", 8)
    rng = random.Random(gap)
    spans = [(d, s, s + rng.choice([0, 1, 4, 40])) for d in (1, 2) for s in (rng.randrange(400) for _ in range(60))]
    want = []
    for d, s, e in sorted(spans):
        if want and want[-1][0] == d and s <= want[-1][2] + 1 + gap:
            want[-1] = (d, want[-1][1], max(want[-1][2], e), want[-1][3] + 1)
        else:
            want.append((d, s, e, 1))
    got = evaluation.merge_spans(spark.createDataFrame(spans, "doc_id int, start_line int, end_line int"), gap)
    assert sorted((r.doc_id, r.start_line, r.end_line, r.n_spans) for r in got.collect()) == want


def test_percentiles_of_one_group_lie_in_many_ranges(spark):
    """One global group of all distinct values, groups of one row, a null group, repeated values: elements at the nearest rank."""
    rng = random.Random(5)
    rows = [("all", rng.random()) for _ in range(4000)] + [("one", 2.0), (None, 3.0), (None, 1.0), ("gone", None)] + [("same", float(i % 3)) for i in range(50)]
    shares = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "top": 1.0}
    got = {r.g: tuple(r[name] for name in shares) for r in evaluation.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got == {g: tuple(sorted(vs)[max(1, math.ceil(q * len(vs))) - 1] for q in shares.values()) for g, vs in groups.items()}
    plain = evaluation.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), [], "v", {"p50": 0.5}).first()
    assert plain.p50 == sorted(v for vs in groups.values() for v in vs)[math.ceil(sum(map(len, groups.values())) * 0.5) - 1]


@pytest.mark.parametrize("few", [True, False])
def test_leakage_equals_brute_force(spark, monkeypatch, few):
    """Random texts of few words, so that many pairs are near; with broadcasts and without."""
    if not few:
        monkeypatch.setattr(evaluation, "broadcast_if_few", lambda df: df)
    rng = random.Random(9)
    text = lambda: rng.choice([None, "", "!!", " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(1, 9)))])
    items, docs = [(i, text()) for i in range(40)], [(i, text()) for i in range(60)]
    docs += [(100 + i, t) for i, t in items[:20]] + [(200 + i, t and t.upper() + ".") for i, t in items[:20]]
    got = {(r.item_id, r.doc_id, r.kind) for r in evaluation.leakage_scan(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 0.7).collect()}
    norm = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip(" ")
    want = set()
    for i, t in items:
        for d, u in docs:
            x, y = set(norm(t).split()), set(norm(u).split())
            if t is not None and t == u:
                want.add((i, d, "exact"))
            elif norm(t) and norm(t) == norm(u):
                want.add((i, d, "normalized"))
            elif x and len(x & y) >= 0.7 * len(x | y):
                want.add((i, d, "near"))
    assert got == want and {k for _, _, k in want} == {"exact", "normalized", "near"}


def test_few_rows_are_bounded_by_bytes(spark):
    from quarrygrid.common import is_few

    df = spark.range(10).selectExpr("id", "repeat('x', 1000) as text", "array('ab', 'c') as words", "map('k', id) as m")
    assert is_few(df) and not is_few(df, 9) and not is_few(df, 10, 10_000) and is_few(df.limit(0))


def plain_edit_counts(a, b):
    """The whole table of prefixes: (all, -changed, changed, omitted, added), the least of each."""
    table = {(0, 0): (0, 0, 0, 0, 0)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = []
            if i and j:
                t, k, c, o, d = table[i - 1, j - 1]
                ways.append((t, k, c, o, d) if a[i - 1] == b[j - 1] else (t + 1, k - 1, c + 1, o, d))
            if i:
                t, k, c, o, d = table[i - 1, j]
                ways.append((t + 1, k, c, o + 1, d))
            if j:
                t, k, c, o, d = table[i, j - 1]
                ways.append((t + 1, k, c, o, d + 1))
            if ways:
                table[i, j] = min(ways)
    return table[len(a), len(b)][2:]


def test_edit_counts_equal_the_whole_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(30))] for _ in "xy")
        assert evaluation.edit_counts(a, b) == plain_edit_counts(a, b)
    # differences beyond the first band, and long texts with few
    a, b = [str(i) for i in range(70)], [str(i + 35) for i in range(80)]
    assert evaluation.edit_counts(a, b) == plain_edit_counts(a, b)
    long = [str(i % 977) for i in range(50_000)]
    assert evaluation.edit_counts(long, [*long[:100], "x", *long[101:40_000], *long[40_003:], "y"]) == (1, 3, 1)


def many_edit_counts(pairs):
    ids = {}
    x, y = (np.array([ids.setdefault(t, len(ids)) for p in pairs for t in p[i]], np.int64) for i in (0, 1))
    return list(zip(*(v.tolist() for v in evaluation.edit_counts_of_many(x, np.array([len(a) for a, _ in pairs]), y, np.array([len(b) for _, b in pairs]))), strict=True))


def test_edit_counts_in_step_equal_the_whole_table(monkeypatch):
    """Pairs with and without steps back, with many of them (which go through the band), empty and equal ones, and both orders of lengths."""
    rng = random.Random(6)
    pairs = [([rng.choice(letters) for _ in range(rng.randrange(30))], [rng.choice(letters) for _ in range(rng.randrange(30))]) for letters in ("ab", "abcde") for _ in range(150)]
    pairs += [([], []), (["a"] * 40, ["a"] * 40), (list("abcdefgh") * 5, list("bcdefgha") * 5), ([str(i) for i in range(70)], [str(i + 35) for i in range(80)])]
    shifted = [f"u{i}" for i in range(20)] + [f"c{i}" for i in range(100)] + [f"v{i}" for i in range(20)]
    pairs.append((shifted[:120], shifted[20:]))
    banded, calls = evaluation.edit_counts, []
    monkeypatch.setattr(evaluation, "edit_counts", lambda a, b: calls.append(1) or banded(a, b))
    want = [plain_edit_counts(a, b) for a, b in pairs]
    assert sum(min(w[1:]) > 0 for w in want) > 20 and any(min(w[1:]) > 1 for w in want)
    assert many_edit_counts(pairs) == want and calls
    # no fold over the tokens for texts of many words that are broken up, as it was before
    monkeypatch.setattr(evaluation, "edit_counts", lambda a, b: pytest.fail("token by token"))
    long = [str(i % 977) for i in range(20_000)]
    broken = [t for i, x in enumerate(long) for t in ([f"{x}a", f"b{i}"] if i % 50 == 7 else [x])]
    assert many_edit_counts([(long, broken), (broken, long), (long, long[3:])]) == [(400, 0, 400), (400, 400, 0), (0, 3, 0)]


def test_text_corruption(spark):
    a = spark.createDataFrame([(1, "one two three four"), (2, None), (3, ""), (4, "only here"), (6, "a b"), (6, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one too three"), (2, "x"), (3, None), (5, "only there now"), (6, "a c")], "doc_id long, text string")
    got = sorted(tuple(r) for r in evaluation.text_corruption(a, b).collect())
    assert got == [(1, 1, 1, 0, 0.5), (2, 0, 0, 1, 1.0), (3, 0, 0, 0, 0.0), (4, 0, 2, 0, 1.0), (5, 0, 0, 3, 1.0), (6, 1, 0, 0, 0.5), (6, 1, 0, 0, 0.5)]
    assert evaluation.text_corruption(a.limit(0), b.limit(0)).count() == 0


def every_cut(text):
    for mask in range(1 << max(len(text) - 1, 0)):
        ends = [i + 1 for i in range(len(text) - 1) if mask >> i & 1] + [len(text)]
        yield [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@pytest.mark.parametrize("seed", range(6))
def test_cheapest_cut_equals_brute_force(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abc世") for _ in range(rng.randrange(1, 5))): rng.choice([1, 1, 2, 5, 40]) for _ in range(12)}
    lattice, total = segmentation.Lattice(words), sum(words.values())

    def cost(cut):
        known = [round(1000 * math.log(total / words[w])) if w in words else round(1000 * math.log(2 * total)) if len(w) == 1 else 1 << 40 for w in cut]
        return sum(known)

    for size in range(1, 10):
        text = "".join(rng.choice("abc世d") for _ in range(size))
        # among equally cheap cuts the last words are the longest
        assert lattice.cut(text) == min(every_cut(text), key=lambda c: (cost(c), [-len(w) for w in reversed(c)]))
    assert lattice.cut("") == [] and segmentation.Lattice({}).cut("xy") == ["x", "y"]


def test_cut_of_a_million_characters():
    import time

    lattice = segmentation.Lattice({"a" * n: n for n in range(1, 9)} | {"世界": 5, "世": 1})
    for text in ("a" * 1_000_000, "世界x" * 333_334):
        began = time.time()
        cut = lattice.cut(text)
        assert "".join(cut) == text and time.time() - began < 30


def test_lexicon_of_text_without_spaces(spark):
    rng = random.Random(2)
    real = ["数据", "处理", "平台", "学习机", "语言"]
    texts = ["".join(rng.choice([*real, *"天地人和"]) for _ in range(40)) for _ in range(60)] + [None, "", "plain words 12"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = segmentation.cohesive_words(docs, longest=3, least=60, cohesion=4.0)
    found = {r.word: r.n for r in words.collect()}
    assert {w for w in found if len(w) > 1} == {*real, "学习", "习机"} and found["数据"] == sum((t or "").count("数据") for t in texts)
    hook = segmentation.lattice_segmenter(words)
    got = {r.doc_id: r.tokens for r in lexical.tokenize_text(docs, segmenter=hook).collect()}
    assert all("".join(got[i]) == "".join(c for c in texts[i] if c not in lexical.STOP_WORDS) for i in range(60))
    assert {w for i in range(60) for w in got[i]} <= {*real, *"天地人"} and got[60] == got[61] == [] and got[62] == ["plain", "words", "12"]
    queries = spark.createDataFrame([(1, "kb", "学习机")], "query_id long, kb_id string, text string")
    chunks = docs.select(F.lit("kb").alias("kb_id"), F.col("doc_id").alias("chunk_id"), F.lit("p").alias("path"), F.lit(None).cast("int").alias("start_line"), F.col("text").alias("content"))
    best = lexical.bm25_topk(queries, chunks, 3, segmenter=hook).collect()
    assert len(best) == 3 and all(r.matched_terms == ["学习机"] for r in best)


def test_segmented_documents_are_cut_at_least_as_well_as_they_were(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = segmentation.spaced_words(docs)
    held = {r.word: r.n for r in words.collect()}
    texts = {r.doc_id: (r.text or "").translate(segmentation._LOWER) for r in docs.collect()}
    counted = {}
    for t in texts.values():
        for w in segmentation.RUN.findall(t):
            counted[w] = counted.get(w, 0) + 1
    assert held == counted
    total = sum(held.values())
    cost = lambda ws: sum(round(1000 * math.log(total / held[w])) if w in held else round(1000 * math.log(2 * total)) for w in ws)
    joined = docs.select("doc_id", F.regexp_replace("text", r"\s+", "").alias("text"))
    for r in segmentation.segment_text(joined, words).collect():
        own = segmentation.RUN.findall(texts[r.doc_id])
        assert "".join(r.words) == "".join(own) and cost(r.words) <= cost(own)


def test_lsh_recall_on_the_tables(spark, sf_dir):
    from quarrygrid.plans.registry import QUERIES

    exact, near = ({(r.query_id, r.vec_id) for r in QUERIES[name](spark, sf_dir).collect()} for name in ("vector_topk", "vector_topk_lsh"))
    assert len(exact & near) / len(exact) >= 0.9

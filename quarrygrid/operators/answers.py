"""Batch checks of answers and queries: citations, claims, coverage, conflicts, answerability and screening."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygrid.operators.lexical import tokens

FENCED = r"(?s)```.*?(```|$)"
#: A marker with the character after it: a parenthesis there makes it a Markdown link.
MARKER, ODD_MARKER = r"\[C[0-9]+\](?:[^(]|$)", r"\[(?:c[0-9]+|C[ ]+[0-9]+|C[0-9]+[,;][^\]\n]*|C)\]"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def parse_citations(answers: DataFrame) -> DataFrame:
    """(query_id, citations, invalid): distinct ids in the order they are seen, and malformed markers; code and Markdown links don't count."""
    text = F.regexp_replace(F.coalesce("answer_text", F.lit("")), FENCED, " ")
    # a marker takes the character after it along, so neighbouring markers are parted first
    text = F.replace(text, F.lit("]["), F.lit("] ["))
    ids = F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(0)), lambda m: F.regexp_extract(m, "C[0-9]+", 0))
    return answers.select("query_id", F.array_distinct(ids).alias("citations"), F.array_distinct(F.regexp_extract_all(text, F.lit(ODD_MARKER), F.lit(0))).alias("invalid"))


def citation_coverage(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, n_paragraphs, n_cited, coverage): paragraphs of 20 characters or more, and those with an available citation."""
    known = evidence.groupBy("query_id").agg(F.collect_set("citation_id").alias("known"))
    paragraphs = answers.select("query_id", F.explode(F.split(F.regexp_replace(F.coalesce("answer_text", F.lit("")), FENCED, " "), r"\n[ \t]*\n")).alias("p")).where(F.length(F.trim("p")) >= 20).join(known, "query_id", "left")
    ids = F.regexp_extract_all("p", F.lit(r"\[(C[0-9]+)\]"), F.lit(1))
    cited = F.coalesce(F.arrays_overlap(ids, F.col("known")), F.lit(False))
    g = paragraphs.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(cited.cast("int")).alias("c"))
    return answers.select("query_id").join(g, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_paragraphs"), F.coalesce("c", F.lit(0)).alias("n_cited"), F.coalesce(F.col("c") / F.col("n"), F.lit(0.0)).alias("coverage"))


def citation_check(answers: DataFrame, evidence: DataFrame, min_citations: int = 1, min_coverage: float = 0.5) -> DataFrame:
    """(query_id, valid, reason): the first reason why the citations of (query_id, answer_text, structured array) fail."""
    known = evidence.groupBy("query_id").agg(F.collect_set("citation_id").alias("known"))
    j = parse_citations(answers).join(answers.select("query_id", F.coalesce("structured", F.array().cast("array<string>")).alias("structured")), "query_id").join(known, "query_id", "left").join(citation_coverage(answers, evidence), "query_id")
    j = j.withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    reason = (
        F.when(F.size("invalid") > 0, "malformed").when((F.size("citations") == 0) & (min_citations > 0), "missing").when(F.size(F.array_except("citations", "known")) > 0, "unknown")
        .when((F.size(F.array_except("citations", "structured")) > 0) | (F.size(F.array_except("structured", "citations")) > 0), "mismatch").when(F.size("citations") < min_citations, "too_few").when(F.col("coverage") < min_coverage, "coverage")
    )
    return j.select("query_id", reason.isNull().alias("valid"), reason.alias("reason"))


def split_claims(answers: DataFrame) -> DataFrame:
    """(query_id, claim_no, claim, citations): sentences of each line without list markers; a claim without citation takes the next cited one's of its line."""
    lines = answers.select("query_id", F.posexplode(F.split(F.coalesce("answer_text", F.lit("")), "\n")).alias("line_no", "line"))
    body = F.regexp_replace("line", r"^[ ]*(?:[-*+]|[0-9]+[.)])[ ]+", "")
    marked = F.regexp_replace(body, r"([.!?。！？](?:[ ]*\[C[0-9]+\])*)[ ]*", "$1\n")
    claims = lines.select("query_id", "line_no", F.posexplode(F.split(marked, "\n")).alias("part", "claim")).withColumn("claim", F.trim("claim")).where("claim <> ''")
    own = F.regexp_extract_all("claim", F.lit(r"\[(C[0-9]+)\]"), F.lit(1))
    w = Window.partitionBy("query_id", "line_no").orderBy("part").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    claims = claims.withColumn("own", F.when(F.size(own) > 0, F.array_join(own, ",")))
    claims = claims.withColumn("citations", F.coalesce(F.first("own", ignorenulls=True).over(w), F.lit("")))
    return claims.select("query_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("line_no", "part")) - 1).alias("claim_no"), F.trim(F.regexp_replace("claim", r"[ ]*\[C[0-9]+\]", "")).alias("claim"), "citations")


#: Characters that never belong to a value: brackets, quotes, marks of lists, and all that is not printable ASCII.
_PIECE = re.compile(r"[!#$%&*+\-./0-9:=?@A-Z^_a-z|~]+")
_LINK, _CITED, _QUOTED = re.compile(r"https?://\S+"), re.compile(r"\[C[0-9]+\]"), re.compile(r"`([^`\n]+)`")
_EDGE = ".:!?=*#|~^&@$"


def is_checkable(piece: str) -> bool:
    """Does a piece of text between blanks and brackets state something that its source has to hold word for word?

    So it is for what holds a digit (numbers, shares, dates, times, versions, identifiers), for flags, for words with capitals (names, acronyms, settings,
    keys), and for words joined by dots, slashes, underscores, hyphens or plus signs (paths, files, names in code, key combinations).
    """
    if len(piece) < 2 and not piece.isdigit():
        return False
    if not any(c.isalnum() for c in piece):
        return False
    joined = any(a.isalnum() and mark in "._/-+:" and b.isalnum() for a, mark, b in zip(piece, piece[1:], piece[2:], strict=False))
    return joined or piece.startswith("--") or any(c.isdigit() or c.isupper() for c in piece)


def checkable_values(text: str) -> list[str]:
    """The distinct checkable values of a claim without its citations, in order: links, what stands between backquotes, and checkable pieces."""
    found: list[str] = []

    def take(m: re.Match) -> str:
        found.append((m[1] if m.re is _QUOTED else m[0].rstrip(".,;:!?)]}>'\"")).strip())
        return " "

    rest = _QUOTED.sub(take, _LINK.sub(take, _CITED.sub(" ", text)))
    found += [p for p in (m.strip(_EDGE).removesuffix("/") for m in _PIECE.findall(rest)) if is_checkable(p)]
    return [v for v in dict.fromkeys(found) if v]


def claim_support(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, claim_no, n_values, unsupported): values of each claim that none of the evidence that it cites holds.

    Evidence is its content, and its path and heading_path where there are such columns. A claim without citation has no support, so all of its values are
    unsupported; the claim itself is if it has none.
    """

    @F.pandas_udf("array<string>")
    def values(column: pd.Series) -> pd.Series:
        return column.map(lambda t: checkable_values(t or ""))

    heads = [F.col("path")] if "path" in evidence.columns else []
    heads += [F.concat_ws(" ", "heading_path")] if "heading_path" in evidence.columns else []
    known = evidence.select("query_id", "citation_id", F.concat_ws(" ", *heads, "content").alias("support"))
    rows = claims.select("query_id", "claim_no", "claim", values("claim").alias("values"), F.explode_outer(F.split("citations", ",")).alias("citation_id"))
    g = rows.join(known, ["query_id", "citation_id"], "left").groupBy("query_id", "claim_no").agg(
        F.first("values").alias("values"), F.first("claim").alias("claim"), F.concat_ws("\n", F.collect_list("support")).alias("support"), F.max(F.coalesce("citation_id", F.lit("")) != "").alias("cited"))
    missing = F.filter("values", lambda v: ~F.contains(F.col("support"), v))
    missing = F.when(F.col("cited"), missing).when(F.size("values") > 0, F.col("values")).otherwise(F.array(F.coalesce("claim", F.lit(""))))
    return g.select("query_id", "claim_no", F.size("values").alias("n_values"), F.array_join(missing, "|").alias("unsupported"))


def query_coverage(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, n_terms, n_found, coverage): distinct query terms that stand anywhere in the evidence, also inside words."""
    text = evidence.groupBy("query_id").agg(F.lower(F.concat_ws("\n", F.collect_list("content"))).alias("support"))
    terms = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("terms")).join(text, "query_id", "left")
    found = F.size(F.filter("terms", lambda t: F.coalesce(F.contains(F.col("support"), t), F.lit(False))))
    return terms.select("query_id", F.size("terms").alias("n_terms"), found.alias("n_found"), F.when(F.size("terms") > 0, found / F.size("terms")).otherwise(0.0).alias("coverage"))


def conflicting_values(queries: DataFrame, evidence: DataFrame, min_terms: int = 2) -> DataFrame:
    """(query_id, n_values, conflict): evidence items that share query terms and hold exactly one number each, but not the same."""
    q = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("terms"))
    e = evidence.join(q, "query_id").withColumn("numbers", F.array_distinct(F.regexp_extract_all("content", F.lit(NUMBER), F.lit(0))))
    e = e.where((F.size("numbers") == 1) & (F.size(F.array_intersect("terms", tokens(F.col("content")))) >= min_terms))
    g = e.groupBy("query_id").agg(F.count_distinct(F.col("numbers")[0]).alias("n_values"))
    return queries.select("query_id").join(g, "query_id", "left").select("query_id", F.coalesce("n_values", F.lit(0)).alias("n_values"), (F.coalesce("n_values", F.lit(0)) > 1).alias("conflict"))


def answerability(signals: DataFrame, min_items: int = 1, min_chars: int = 40, min_sources: int = 1, min_score: float = 0.2, full: float = 0.8, partial: float = 0.4) -> DataFrame:
    """(query_id, status, reason, confidence): an ordered table over one row of signals for each query.

    ``signals``: query_id, n_items, n_chars, n_invalid, n_sources, degraded, exact_missing, inference, false_premise, conflict, top_score, coverage.
    """
    rules: list[tuple[Column, str, str]] = [
        (F.col("n_items") < min_items, "unanswerable", "no_evidence"), (F.col("degraded"), "uncertain", "degraded_retrieval"), (F.col("n_chars") < min_chars, "unanswerable", "too_little_context"), (F.col("n_invalid") > 0, "uncertain", "invalid_items"),
        (F.col("n_sources") < min_sources, "uncertain", "too_few_sources"), (F.col("exact_missing"), "unanswerable", "missing_exact_value"), (F.col("inference"), "unanswerable", "unsupported_inference"), (F.col("false_premise"), "correct_premise", "false_premise"),
        (F.col("conflict"), "uncertain", "conflicting_evidence"), (F.col("top_score") < min_score, "unanswerable", "low_score"), (F.col("coverage") >= full, "answerable", "full_coverage"), (F.col("coverage") >= partial, "partial", "partial_coverage"),
    ]
    status = F.coalesce(*[F.when(c, F.lit(s)) for c, s, _ in rules], F.lit("unanswerable"))
    reason = F.coalesce(*[F.when(c, F.lit(r)) for c, _, r in rules], F.lit("low_coverage"))
    confidence = F.when(status == "answerable", F.col("coverage")).when(status == "partial", F.col("coverage") * 0.8).when(status == "uncertain", 0.5).otherwise(1 - F.col("coverage"))
    return signals.select("query_id", status.alias("status"), reason.alias("reason"), confidence.alias("confidence"))


#: Kinds of forbidden content (fixed values), in patterns that Java and RE2 read alike.
SCREEN_RULES = (
    ("sql", r"(?i)(select[ ].+[ ]from[ ]|drop[ ]+table|insert[ ]+into)"), ("shell", r"(?i)(rm -rf|sudo[ ]|curl[ ]+http|[|][ ]*sh($|[ ]))"), ("url", r"(?i)https?://"), ("injection", r"(?i)(ignore (all )?previous|system prompt|you are now)"),
    ("secret", r"(?i)((token|password|api_key)[ ]*[=:]|AKIA[0-9A-Z]{16})"), ("email", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z.]+"),
)


def query_screen(queries: DataFrame, rules: Sequence[tuple[str, str]] = SCREEN_RULES) -> DataFrame:
    """(query_id, flags, blocked, digest, n_chars): what a query is flagged for; only digest and length go to logs."""
    flags = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in rules]))
    return queries.select("query_id", F.array_join(flags, ",").alias("flags"), (F.size(flags) > 0).alias("blocked"), F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars"))

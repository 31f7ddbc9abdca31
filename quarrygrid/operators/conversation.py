"""Conversations: bounded context, follow-up rewriting, idempotent turns, life cycle rules, citations of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Starts of follow-up questions (fixed values).
FOLLOW_UP = r"(?i)^(and|also|what about|how about|why|then|it|this|that|they|is it|the same)([ ,?]|$)"


def conversation_context(turns: DataFrame, n: int = 6, budget: int = 1200) -> DataFrame:
    """(session_id, turn_number, n_context, context_chars, context_sha): the previous turns that fit, oldest first.

    From the newest back, at most ``n`` turns, up to the first that would go over ``budget`` characters; the newest is cut to the budget.
    """
    text = F.coalesce("text", F.lit(""))
    w = Window.partitionBy("session_id").orderBy("turn_number").rowsBetween(-n, -1)
    rows = turns.select("session_id", "turn_number", F.collect_list(F.struct("turn_number", text.alias("text"))).over(w).alias("before"))
    newest = F.transform(F.reverse(F.array_sort("before")), lambda x, i: F.when(i == 0, F.left(x["text"], F.lit(budget))).otherwise(x["text"]))
    fold = F.aggregate(
        newest, F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("over")),
        lambda acc, t: F.struct(
            F.when(acc["over"] | (acc["used"] + F.length(t) > budget), acc["kept"]).otherwise(F.array_append(acc["kept"], t)).alias("kept"),
            F.when(acc["over"] | (acc["used"] + F.length(t) > budget), acc["used"]).otherwise(acc["used"] + F.length(t)).alias("used"), (acc["over"] | (acc["used"] + F.length(t) > budget)).alias("over")),
    )
    rows = rows.withColumn("f", fold)
    return rows.select("session_id", "turn_number", F.size("f.kept").alias("n_context"), F.col("f.used").alias("context_chars"), F.sha2(F.array_join(F.reverse("f.kept"), "\n"), 256).alias("context_sha"))


def followup_rewrite(turns: DataFrame, markers: str = FOLLOW_UP, max_chars: int = 80) -> DataFrame:
    """(session_id, turn_number, is_followup, standalone): a follow-up is put after the question that it goes back to and the ones between.

    A follow-up starts with a marker or mentions a citation and has at most ``max_chars`` characters; the first turn is none.
    """
    w = Window.partitionBy("session_id").orderBy("turn_number")
    text = F.coalesce("text", F.lit(""))
    short = F.length(text) <= max_chars
    rows = turns.select("session_id", "turn_number", text.alias("text"), (short & (text.rlike(markers) | text.rlike(r"\[C[0-9]+\]")) & (F.row_number().over(w) > 1)).alias("is_followup"))
    rows = rows.withColumn("anchor", F.sum((~F.col("is_followup")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("session_id", "anchor").orderBy("turn_number").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chain", F.collect_list("text").over(chain)).select("session_id", "turn_number", "is_followup", F.array_join("chain", " ").alias("standalone"))


def turn_idempotency(requests: DataFrame) -> DataFrame:
    """(session_id, client_request_id, turn_number, turn_count): one turn for each request id, numbered by arrival.

    ``requests``: session_id, client_request_id, arrived; a repeated request keeps its first arrival.
    """
    first = requests.groupBy("session_id", "client_request_id").agg(F.min("arrived").alias("arrived"))
    w = Window.partitionBy("session_id")
    return first.select("session_id", "client_request_id", F.row_number().over(w.orderBy("arrived", "client_request_id")).alias("turn_number"), F.count("*").over(w).alias("turn_count"))


def turn_lifecycle(turns: DataFrame) -> DataFrame:
    """Issues (session_id, turn_number, issue) of (session_id, turn_number, status, completed, error_code)."""
    w = Window.partitionBy("session_id").orderBy("turn_number")
    terminal, active = F.col("status").isin("completed", "failed", "abstained"), F.col("status").isin("pending", "running")
    known = terminal | active
    earlier = F.coalesce(F.max(active.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    rules = (
        (~known, "unknown_status"), (terminal & ~F.col("completed"), "missing_completion"), (active & F.col("completed"), "early_completion"), ((F.col("status") == "failed") & F.col("error_code").isNull(), "missing_error"),
        ((F.col("status") != "failed") & F.col("error_code").isNotNull(), "unexpected_error"), (earlier, "previous_turn_active"),
    )
    rows = turns.select("session_id", "turn_number", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])).alias("i"))
    return rows.select("session_id", "turn_number", F.explode("i").alias("issue"))


def turn_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds source_status to citations (chunk_id, content_hash, ...): current, changed, or deleted."""
    c = chunks.select("chunk_id", F.col("content_hash").alias("now"), F.lit(True).alias("there"))
    return citations.join(c, "chunk_id", "left").withColumn("source_status", F.when(F.col("there").isNull(), "deleted").when(~F.col("content_hash").eqNullSafe(F.col("now")), "changed").otherwise("current")).drop("now", "there")

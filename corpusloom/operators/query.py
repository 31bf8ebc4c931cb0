"""Question analysis: bounded conversation context, labels, intents, periods and alias expansion, as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vocab
from corpusloom.functions.text import period, strip


def labels(c: Column, patterns: dict[str, list[str]]) -> Column:
    """Labels, in the order of `patterns`, one of whose phrases stands in the text as whole words. Patterns are tried only on
    texts that have a phrase at all, which is much cheaper to find."""
    low = F.lower(c)
    hit = lambda ps: reduce(Column.__or__, [low.contains(p) for p in ps]) & low.rlike(r"(?U)(?<!\w)(?:" + "|".join(re.escape(p) for p in ps) + r")(?!\w)")
    return F.filter(F.array(*[F.when(hit(ps), F.lit(n)) for n, ps in patterns.items()]), lambda x: x.isNotNull())


def tax_labels(c: Column, patterns=None, broad: str = vocab.BROAD_LABEL, specific=tuple(vocab.SPECIFIC_LABELS)) -> Column:
    names = F.array(*map(F.lit, specific))
    kept = lambda found: F.when(F.arrays_overlap(found, names), F.filter(found, lambda x: x != broad)).otherwise(found)
    return F.element_at(F.transform(F.array(labels(c, patterns or vocab.TAX_LABELS)), kept), 1)  # labels are found once


def expand_aliases(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """The text with the long form of every alias in it appended."""
    low = F.lower(c)
    long = [F.when(low.contains(a.lower()) & c.rlike(f"(?i)(?<![A-Za-z0-9]){re.escape(a)}(?![A-Za-z0-9])"), F.lit(x)) for a, x in (aliases or vocab.ALIASES).items()]
    return F.concat_ws(" ", c, *long)


def procedural(c: Column, verbs=tuple(vocab.PROCEDURAL_VERBS)) -> Column:
    return c.rlike(r"(?i)\b(?:" + "|".join(verbs) + r")\b")


def matches(c: Column, words: str) -> Column:
    return c.rlike(rf"(?i)\b(?:{words})\b")


def user_questions(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, question, retrieval_text) of each user message, with at most two user messages before it.

    Earlier messages are added where the question is a follow-up or has fewer than eight words; the window never
    looks further back than two rows, so a conversation of any length costs one sort of its user messages.
    """
    users = messages.where(F.lower(F.col(role)) == "user").select(key, turn, strip(F.col(text)).alias("question")).where("question <> ''")
    before = Window.partitionBy(key).orderBy(turn).rowsBetween(-2, -1)
    out = users.withColumn("before", F.collect_list("question").over(before))
    context = (F.size(F.split(F.col("question"), r"(?U)\s+")) < 8) | matches(F.col("question"), vocab.FOLLOW_UP)
    return out.select(
        key, turn, "question",
        F.when(context, F.array_join(F.concat("before", F.array("question")), "\n")).otherwise(F.col("question")).alias("retrieval_text"),
    )


def analyze(questions: DataFrame, text: str = "retrieval_text") -> DataFrame:
    """`questions` with period, tax_types, taxpayer_types, intents and the expanded retrieval text."""
    c = F.col(text)
    return questions.withColumns({
        "tax_year": period(c), "tax_types": tax_labels(c), "taxpayer_types": labels(c, vocab.TAXPAYER_LABELS),
        "procedural_intent": procedural(c), "historical_intent": matches(c, vocab.HISTORICAL), text: expand_aliases(c),
    })


def validate_requests(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      max_messages: int = 50, max_chars: int = 8000) -> DataFrame:
    """One row for each conversation: sizes and whether it may be answered. One partial aggregation."""
    empty = strip(F.coalesce(F.col(text), F.lit(""))) == ""
    known = F.coalesce(F.col(role).isin("user", "assistant"), F.lit(False))
    out = messages.groupBy(key).agg(
        F.count("*").alias("n_messages"), F.sum(F.coalesce(F.length(text), F.lit(0))).cast("bigint").alias("n_chars"),
        F.max_by(role, turn).alias("last_role"), F.sum((~known).cast("bigint")).alias("bad_roles"),
            F.sum(empty.cast("bigint")).alias("empty_messages"),
    )
    return out.withColumns({
        "valid": (F.col("bad_roles") == 0) & (F.col("empty_messages") == 0) & (F.col("last_role") == "user") & F.col("n_messages").between(1,
            max_messages),
        "too_large": F.col("n_chars") > max_chars,
    })


def history(messages: DataFrame, limit: int = 12, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last `limit` messages of each conversation."""
    last = Window.partitionBy(key).orderBy(F.col(turn).desc())
    return messages.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= limit).drop("_n")

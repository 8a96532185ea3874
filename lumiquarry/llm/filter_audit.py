"""Filter interaction audit: what each filter removes, in every order in which the filters can be applied.

Documents become cells, counts by part and by the set of filters they fail, so that the orders are worked on some dozens
of rows a part whatever the corpus. A recursive common table expression extends prefixes of filter orders letter by letter.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiquarry.operators.joins import hub_join
from lumiquarry.session import table, written

#: Words: what white space parts.
WORD = r"[^\x20\x09-\x0D]+"
#: The letter of the filter that fails copies of an earlier document; the others look at a text alone.
COPY = "E"
#: Orders of more letters have more rows than a recursive expression may make.
MOST_LETTERS = 6


def text_filters(text: Column) -> dict[str, Column]:
    """The production filters by letter: whether a text (not null) fails.

    A: fewer than 100 words; B: under 80 % of the words distinct; C: over 10 % of the characters in A-Z; D: a character of #$%&*|.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: Mapping[str, Column] | None = None, copies: str | None = COPY) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters they fail, bit k of ``mask`` for the k-th letter.

    ``filters`` are conditions over the column ``text`` (null texts are empty there); ``copies`` is the letter, the last, of
    the filter that a document fails whose text a smaller id has, or None. ``good`` and ``toxic`` count those with a label
    row of quality 1 or toxic 1. Null parts are the empty string. A null id is smaller than none and has no label; rows
    that repeat an id and its text count each and are no copies of one another; labels may repeat. Further columns are not
    read. An empty table gives no cells.

    Texts are read once and only digests are shuffled, repeated rows as one; the first id of a text comes back by
    ``hub_join``, so a text that a third of the documents share stays where it is read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    filters = dict(filters or text_filters(F.col("text")))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0)).cast("int")
    rows = base.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask")).groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("c"))
    if copies:
        rows = written(rows, "failures")
        first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        rows = hub_join(rows, first, "digest", "n", rows.count())
        rows = rows.withColumn("mask", F.when(F.col("id") > F.col("first"), F.col("mask") + (1 << len(filters))).otherwise(F.col("mask")))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.select("id", "part", "mask", "c").join(marks, "id", "left")
    return rows.groupBy("part", "mask").agg(F.sum("c").alias("n"), *[F.sum(F.when(F.col(x), F.col("c")).otherwise(0)).alias(x) for x in ("good", "toxic")])


def orders(masks: DataFrame, letters: str) -> DataFrame:
    """(prefix, letter, step, mask, kept, removed, redundant, only) of every prefix of every order and every one of ``masks``.

    Each level of the recursion appends an unused letter to each prefix, for each cell, and says what that step does with
    it; ``applied`` carries the bits of the letters so far.
    """
    bits = ", ".join(f"('{x}', {1 << k})" for k, x in enumerate(letters))
    return masks.sparkSession.sql(
        f"""
        WITH RECURSIVE filters(letter, bit) AS (VALUES {bits}),
        grown(prefix, letter, step, applied, mask, kept, removed, redundant, only) AS (
            SELECT '', '', 0, 0, mask, true, false, false, false FROM {{masks}}
            UNION ALL
            SELECT concat(g.prefix, f.letter), f.letter, g.step + 1, g.applied | f.bit, g.mask,
                   g.mask & (g.applied | f.bit) = 0,
                   g.mask & f.bit <> 0 AND g.mask & g.applied = 0,
                   g.mask & f.bit <> 0 AND g.mask & g.applied <> 0,
                   g.mask = f.bit
            FROM grown g JOIN filters f ON g.applied & f.bit = 0
        )
        SELECT prefix, letter, step, mask, kept, removed, redundant, only FROM grown WHERE step > 0
        """,
        masks=masks,
    )


def interaction_audit(cells: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders.

    ``cells`` is what ``failure_cells`` gives; bit k of a mask is the k-th of ``letters``, six at most. Every part has a row
    for each order and step, zeros included. ``shapley``: what the step's filter removes, summed over all orders, so that a
    prefix counts once for each order it begins. Only the sets of failures, 2 ** letters at most, go through the
    recursion, and its rows are broadcast; the parts' counts meet them afterwards.
    """
    if len(letters) > MOST_LETTERS or len(set(letters)) < len(letters):
        raise ValueError(f"{letters!r}: up to {MOST_LETTERS} different letters")
    spark = cells.sparkSession
    steps = written(orders(spark.range(1 << len(letters)).select(F.col("id").cast("int").alias("mask")), letters), "orders")
    count = lambda flag, n="n": F.sum(F.when(F.col(flag), F.col(n)).otherwise(0))
    per = cells.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "letter", "step").agg(
        count("kept").alias("kept"), count("removed").alias("removed"), count("redundant").alias("redundant"), count("only").alias("unique_fails"),
        count("removed", "good").alias("good_lost"), count("removed", "toxic").alias("toxic_lost"),
    )
    weight = F.element_at(F.array(*[F.lit(math.factorial(len(letters) - k)) for k in range(1, len(letters) + 1)]), F.col("step"))
    shapley = per.groupBy("part", "letter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    whole = steps.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    at = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(len(letters))))).select("filter_order", F.expr("substring(filter_order, 1, k)").alias("prefix"))
    return per.join(F.broadcast(at), "prefix").join(shapley, ["part", "letter"]).select("part", "filter_order", "step", "letter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_interaction_audit(spark, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over every whole text of ``documents``, by language. See ``failure_cells`` for nulls and repeats."""
    cells = failure_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interaction_audit(written(cells, "cells"), "ABCD" + COPY)

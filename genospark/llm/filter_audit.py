"""Filter interaction audit: what each filter removes under every order of filters, and its Shapley value.

A state is the set of filters applied so far, an edge adds one filter to a state.  What an edge removes does not depend
on the order that led to its state, so all k! orders share k 2^(k-1) edges.  Forward path counts say how many orders
reach a state, backward counts how many leave it; their product along an edge is the number of orders that take it,
which weighs what it removes into the Shapley value.  Each order's steps are read from the same edges.

The documents are met once: they become counts by part and set of failed filters, at most 2^k rows a part.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filters at most: the result has k k! rows a part.
MAX_FILTERS = 7
FILTERS = ("A", "B", "C", "D", "E")
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT, MARKS = 200, 50, 2, "#$%&*|"
#: What is counted of the documents in a state.
COUNTS = ("n", "good", "toxic")


def lattice(k: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders that take this edge) of every edge; states are bit sets of the filters applied."""
    edges = [(state, f) for state in range(1 << k) for f in range(k) if not state >> f & 1]
    forward, backward = [1] + [0] * ((1 << k) - 1), [0] * ((1 << k) - 1) + [1]
    for state, f in edges:  # a state is smaller than those that it leads to
        forward[state | 1 << f] += forward[state]
    for state, f in reversed(edges):
        backward[state] += backward[state | 1 << f]
    return [(state, f, forward[state] * backward[state | 1 << f]) for state, f in edges]


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The filters that look at one text, by name: whether it fails."""
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words),
        "C": 100 * upper.cast("long") > MOST_UPPER_PERCENT * F.length(text),
        "D": text.rlike(f"[{MARKS}]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the set of FILTERS that they fail.

    E fails where a smaller doc_id has an identical text (by SHA-256), anywhere in the table.  Null texts are empty, a
    null part is the empty string.  A null doc_id is neither smaller nor larger than any, and has no label; rows that
    repeat an id count each, and labels that repeat one say 1 where any of them does.  An empty table has no rows.
    """
    read = docs.select("doc_id", F.coalesce(part_col, F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = read.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    failed = text_failures(F.col("text"), F.col("words"))
    mask = sum((F.when(failed[f], 1 << FILTERS.index(f)).otherwise(0) for f in failed), F.lit(0))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    narrow = split.select("doc_id", "part", mask.alias("mask"), digest.alias("digest"))
    # Rows without an id meet no label; their digests spread them.
    narrow = narrow.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    flag = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    met = narrow.join(known, ["doc_id", "salt"], "left")
    # One row an id, text and part; then by text and part, with those of the smallest id set apart.  Both combine on the
    # map side, so a text with very many copies is a row a part.
    added = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS[1:]]
    rows = met.groupBy("doc_id", "salt", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"), *added)
    lone = F.col("doc_id").isNull().alias("lone")
    sums, firsts = [F.sum(c).alias(c) for c in COUNTS], [F.min_by(c, "doc_id").alias(f"first_{c}") for c in COUNTS]
    texts = rows.groupBy("digest", "part", "mask", lone).agg(F.min("doc_id").alias("least"), *sums, *firsts)
    smallest = F.expr("min(least) over (partition by digest)")  # a row a part of each text
    texts = texts.withColumn("smallest", smallest)
    free = lambda c: F.when(F.col("lone"), F.col(c)).when(F.col("least") == F.col("smallest"), F.col(f"first_{c}")).otherwise(0)
    repeated = F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E")))
    both = F.array(
        F.struct(F.col("mask").alias("mask"), *[free(c).alias(c) for c in COUNTS]),
        F.struct(repeated.alias("mask"), *[(F.col(c) - free(c)).alias(c) for c in COUNTS]),
    )
    split = texts.select("part", F.explode(both).alias("s")).select("part", "s.*").where("n > 0")
    return split.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


def audit(counts: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """A row for each part, order of ``filters`` (names of one letter) and step, from (part, mask, n, good, toxic).

    kept, removed, redundant, unique_fails, good_lost and toxic_lost are those of the step's filter applied after the
    ones before it; shapley is what it removes over all orders together.  Zeros are rows like others.
    """
    k = len(filters)
    if not 0 < k <= MAX_FILTERS:
        raise ValueError(f"from 1 to {MAX_FILTERS} filters")
    spark = counts.sparkSession
    numbers = lambda *x: F.struct(*[F.lit(v).alias(n) for n, v in zip(("state", "filter", "paths"), x, strict=True)])
    edges = counts.select("*", F.explode(F.array(*[numbers(*e) for e in lattice(k)])).alias("e")).select(*counts.columns, "e.*")
    own = F.expr("shiftleft(1, filter)")
    fails = F.col("mask").bitwiseAND(own) != 0
    passed = F.col("mask").bitwiseAND(F.col("state")) == 0
    total = lambda c, when, name: F.sum(F.when(when, F.col(c)).otherwise(0)).alias(name)
    edges = edges.groupBy("part", "state", "filter", "paths").agg(
        total("n", ~fails & passed, "kept"), total("n", fails & passed, "removed"), total("n", fails & ~passed, "redundant"),
        total("n", F.col("mask") == own, "unique_fails"), total("good", fails & passed, "good_lost"), total("toxic", fails & passed, "toxic_lost"),
    )
    edges = edges.withColumn("shapley", F.expr("sum(paths * removed) over (partition by part, filter)"))
    steps = [
        ("".join(filters[f] for f in order), step, sum(1 << f for f in order[: step - 1]), order[step - 1])
        for order in permutations(range(k)) for step in range(1, k + 1)
    ]
    read = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, state int, filter int"))  # k k! rows
    return edges.join(read, ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )

"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only.

1. Every input partition is a run: its rows, by number, with the digest of their text. The text
   itself is read once and never shuffled. A run is merged in itself first: one entry for each of
   its texts, with the count of its rows and the row that stays.
2. Rounds of a binomial tree of ``fan`` children: the runs ``fan * k`` … ``fan * k + fan - 1`` send
   their entries to run ``k``, cut by digest, so a node of the tree is spread over all tasks. Each
   piece is sorted by digest and its neighbours are merged. After log(runs) rounds there is one.
3. The root's entries go back to the runs' entries, and those to the rows.

Runs are ordered by a 64-bit digest. Every merge verifies it: entries become one only if the
SHA-256 and the length of their texts are the same too. A text that holds a third of all rows
is at most one entry per run, ``fan`` rows of a key in a round, one row per run on the way
back, and its rows are met run by run. Every round is a table in the shared folder, so a lost
executor costs tasks only.

Defined results: a null text is an empty one; A-Z count as a-z and nothing else is folded. Of
equal texts the largest identifier stays (``keep="smallest"``: the smallest), any identifier
before a null one; of repeated rows exactly one stays. An empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabbridge.llm.staging import Scratch, result, scratch

#: children of a node of the tree
FAN = 16
_TEXT = ["digest", "sha", "length"]


def normalised(text: Column) -> Column:
    """A-Z in lower case; null as the empty text."""
    plain = F.coalesce(text, F.lit(""))
    return F.translate(plain, string.ascii_uppercase, string.ascii_lowercase)


def _leaves(docs: DataFrame, id: str, text: str) -> DataFrame:
    """One row per document: its run, its number and the digests of its text."""
    folded = docs.select(F.col(id).alias("doc_id"), normalised(F.col(text)).alias("text"))
    return folded.select(
        "doc_id",
        F.spark_partition_id().cast("long").alias("run"),
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64("text").alias("digest"),
        F.unhex(F.sha2("text", 256)).alias("sha"),
        F.octet_length("text").alias("length"),
    )


def _stays(keep: str) -> Column:
    """The (doc_id, row) that stays of the rows of an entry."""
    if keep == "largest":
        return F.max("best")
    known = F.min(F.when(F.col("best.doc_id").isNotNull(), F.col("best")))
    return F.coalesce(known, F.min("best"))


def _merge(entries: DataFrame, keep: str) -> DataFrame:
    """Sorted runs of one node, merged: neighbours with the same digest and the same proof."""
    together = entries.repartition("run", "digest").sortWithinPartitions("run", *_TEXT)
    return together.groupBy("run", *_TEXT).agg(_stays(keep).alias("best"), F.sum("size").alias("size"))


def merge_runs(runs: DataFrame, tables: Scratch, fan: int = FAN, keep: str = "largest") -> DataFrame:
    """The root of the tree over entries (run, digest, sha, length, best, size) of the runs."""
    left = (runs.agg(F.max("run")).first()[0] or 0) + 1
    current = runs
    while left > 1:
        last, left = current, -(-left // fan)
        raised = last.withColumn("run", F.floor(F.col("run") / fan))
        current = tables.put(_merge(raised, keep))
        if last is not runs:
            tables.drop(last)
    return current


def equal_texts(
    docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "largest", fan: int = FAN
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; other columns are not read."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    if fan < 2:
        raise ValueError("a node needs two children at least")
    with scratch(docs.sparkSession, "digests") as tables:
        rows = tables.put(_leaves(docs, id, text))
        each = rows.select("run", *_TEXT, F.struct("doc_id", "row").alias("best"), F.lit(1).cast("long").alias("size"))
        # a run lies in one partition, so its rows are merged before they are shuffled
        runs = tables.put(each.groupBy("run", *_TEXT).agg(_stays(keep).alias("best"), F.sum("size").alias("size")))
        root = merge_runs(runs, tables, fan, keep)
        # the tree's answer for each entry of a run, then for each row of the run
        answers = runs.select("run", *_TEXT).join(root.select(*_TEXT, "best", "size"), _TEXT)
        return result(
            rows.join(answers, ["run", *_TEXT]).select(
                "doc_id",
                F.col("best.doc_id").alias("keep_id"),
                F.col("size").alias("group_size"),
                (F.col("best.row") == F.col("row")).alias("kept"),
                F.lower(F.hex("sha")).alias("text_sha256"),
            ),
            "digests",
        )


"""Shared steps for operators that look for keys several documents have in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabbridge.llm.staging import Scratch

KEYED = "key long, salt int, id long"


class HotKeys:
    """Salts for keys that a task meets more than ``limit`` times.

    The rows beyond the limit go to a part of the key that only this task feeds, together
    with one earlier row of the key, so every part is tied to the rest of its key and a key
    with a third of all rows is spread over as many parts as there are tasks.
    """

    def __init__(self, limit: int = 500):
        self.limit, self.count = limit, np.zeros(1 << 18, np.int64)
        self.seen: dict[int, list[int]] = {}
        context = TaskContext.get()
        self.salt = 1 + (context.partitionId() if context else 0)

    def route(self, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slots = (keys >> np.uint64(46)).astype(np.int64)
        self.count += np.bincount(slots, minlength=len(self.count))
        salts, extra = np.zeros(len(keys), np.int32), []
        for i in np.flatnonzero(self.count[slots] > self.limit):
            key, state = int(keys[i]), None
            state = self.seen.setdefault(key, [0, int(ids[i])])
            state[0] += 1
            if state[0] > self.limit:
                salts[i] = self.salt
                if state[0] == self.limit + 1:
                    extra.append((key, state[1]))
        if extra:
            more_keys, more_ids = (np.array(x, t) for x, t in zip(zip(*extra), (np.uint64, ids.dtype)))
            keys, ids = np.concatenate([keys, more_keys]), np.concatenate([ids, more_ids])
            salts = np.concatenate([salts, np.full(len(extra), self.salt, np.int32)])
        return keys, salts, ids


def keyed_batch(keys: np.ndarray, salts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(salts), pa.array(ids.view(np.int64))], names=["key", "salt", "id"]
    )


def seen_before(known: set[int], ids: np.ndarray, most: int = 1_000_000) -> np.ndarray:
    """Which ids this task has met already; the set starts anew when it is full."""
    out = np.zeros(len(ids), bool)
    for i, x in enumerate(ids.tolist()):
        if x in known:
            out[i] = True
        else:
            known.add(x)
    if len(known) > most:
        known.clear()
    return out


def by_key(rows: DataFrame) -> DataFrame:
    """Rows of a (key, salt) together and in order of id."""
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "id")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, salt, id, first row of each run) of sorted batches, distinct rows.

    The last run of a batch may go on in the next one: its key and id are carried by the caller.
    """
    for batch in batches:
        key, salt, id = (batch.column(n).to_numpy() for n in ("key", "salt", "id"))
        if not len(key):
            continue
        start = np.empty(len(key), bool)
        start[0] = True
        start[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        yield key, salt, id, start


def _stars(edges: DataFrame) -> bool:
    """Whether every id hangs on one smaller id that hangs on none."""
    once = edges.agg(F.count("*"), F.count_distinct("a")).first()
    hanging = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
    return once[0] == once[1] and not hanging.limit(1).count()


def components(links: DataFrame, tables: Scratch) -> DataFrame:
    """(id, component): connected components of ``links`` (a, b), by the smallest id.

    Alternates large-star and small-star steps; every step moves at most one row per link and
    the links are staged between the steps.
    """
    edges = tables.put(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while edges.limit(1).count() and not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = tables.put(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(least, "a")
        small = (
            kept.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        last, edges = edges, tables.put(small)
        tables.drop(last, large)
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return tables.put(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots))

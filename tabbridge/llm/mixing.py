"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies in the mix. The rates stay as
close as possible, in bounded relative entropy, to "each document once", under one token
constraint for each source: the sizes of its documents times their rates add up to the
source's target. The dual of that problem is convex with one multiplier per source, and the
rate of a document is an exponential tilt of its size:

    rate = cap / (1 + (cap - 1) * exp(-tilt * size / mean size of the source))

Safeguarded Newton steps on the dual run as distributed aggregates over the histogram of
(source, size), so neither a source nor its documents pass through one task or the driver;
the driver sees one number for each step, the largest remaining error. Rates become whole
copies by priority sampling: the fractional part of a rate is weighed against a hash of the
document, and the cut of a source is the hash priority at which its tokens meet the target.

Defined results: a null text has size 0; null is a source of its own; documents of size 0
have rate 1; a source without tokens has target 0; rows that repeat a document id and size are
numbered, and each is rounded by itself; an empty table gives no rows. Columns of the input
named like a result column are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabbridge.llm.staging import Scratch, scratch

WORD = r"[^\x20\x09-\x0D]+"
BINS = 1024
_LIMIT = 80  # Newton steps with bisection as a safeguard end long before


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: null is told apart from every name."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def source_targets(
    sizes: DataFrame, tables: Scratch, weights: Sequence[float], share: float, cap: float
) -> DataFrame:
    """(key, source_size, target): the share of all tokens dealt by weight, capped.

    Sources take the weights in turn, by code point with null last. A target stops at
    ``cap`` times its source's size; what is above is dealt again by weight until none is
    above. Works on one row per source; numbering them is the only one-task step.
    """
    by_name = Window.orderBy(F.col("key") == "", "key")
    totals = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    state = tables.put(totals.withColumn("weight", weight).withColumn("capped", F.lit(False)))
    ceiling = F.col("source_size") * F.lit(float(cap))
    while True:
        sums = state.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(F.col("capped"), ceiling)).alias("held"),
            F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("open"),
        ).first()
        level = (share * (sums["all"] or 0) - (sums["held"] or 0)) / (sums["open"] or 1)
        above = ~F.col("capped") & (F.col("weight") * F.lit(level) > ceiling)
        if not state.where(above).limit(1).count():
            break
        last, state = state, tables.put(state.withColumn("capped", F.col("capped") | above))
        tables.drop(last)
    target = F.when(F.col("capped"), ceiling).otherwise(F.col("weight") * F.lit(level))
    return state.select("key", "source_size", target.alias("target"))


def rate(cap: float) -> Column:
    """Of a row with ``size`` and its source's ``full``, ``tilt`` and ``mean_size``."""
    tilted = F.lit(float(cap)) / (
        1 + F.lit(cap - 1.0) * F.exp(-F.col("tilt") * F.col("size") / F.col("mean_size"))
    )
    return (
        F.when(F.col("size") == 0, F.lit(1.0))
        .when(F.col("full"), F.lit(float(cap)))
        .otherwise(tilted)
    )


def solve_tilts(
    sizes: DataFrame, targets: DataFrame, tables: Scratch, cap: float, tolerance: float = 1e-9
) -> DataFrame:
    """One dual multiplier (``tilt``) per source, by Newton steps over the histogram."""
    histogram = tables.put(sizes.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")))
    documents = histogram.groupBy("key").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size")
    )
    start = targets.join(documents, "key", "left").select(
        "key", "source_size", "target",
        F.coalesce("mean_size", F.lit(1.0)).alias("mean_size"),
        (F.col("target") >= F.col("source_size") * F.lit(float(cap))).alias("full"),
        F.lit(0.0).alias("tilt"),
        F.lit(float("-inf")).alias("low"),
        F.lit(float("inf")).alias("high"),
        F.lit(1.0).alias("error"),
    )
    state = tables.put(start)
    for step in range(_LIMIT + 1):
        if step == _LIMIT:
            raise RuntimeError(f"the mix has not converged in {_LIMIT} steps")
        r, u = rate(cap), F.col("size") / F.col("mean_size")
        sums = (
            histogram.join(state.where("not full"), "key")
            .groupBy("key")
            .agg(
                F.sum(F.col("n") * F.col("size") * r).alias("mass"),
                F.sum(F.col("n") * F.col("size") * u * r * (1 - r / cap)).alias("slope"),
            )
        )
        gap = F.col("mass") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.col("slope")
        reach = 1 + F.abs("tilt")
        newton = F.greatest(F.least(newton, F.col("tilt") + reach), F.col("tilt") - reach)
        newton = F.when(F.isnan(newton), F.col("tilt") - F.signum(gap) * reach).otherwise(newton)
        bounded = (F.col("low1") > float("-inf")) & (F.col("high1") < float("inf"))
        inside = (F.col("next") > F.col("low1")) & (F.col("next") < F.col("high1"))
        error = F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
        stepped = (
            state.join(sums, "key", "left")
            .withColumn("error1", F.coalesce(error, F.lit(0.0)))
            .withColumn("low1", F.when(F.isnotnull("mass"), low).otherwise(F.col("low")))
            .withColumn("high1", F.when(F.isnotnull("mass"), high).otherwise(F.col("high")))
            .withColumn("next", newton)
            .withColumn(
                "next",
                F.when(F.col("error1") <= tolerance, F.col("tilt"))
                .when(bounded & ~inside, (F.col("low1") + F.col("high1")) / 2)
                .otherwise(F.col("next")),
            )
        )
        last, state = state, tables.put(
            stepped.select(
                "key", "source_size", "target", "mean_size", "full",
                F.coalesce("next", "tilt").alias("tilt"),
                F.col("low1").alias("low"), F.col("high1").alias("high"),
                F.col("error1").alias("error"),
            )
        )
        tables.drop(last)
        if (state.agg(F.max("error")).first()[0] or 0.0) <= tolerance:
            break
    tables.drop(histogram)
    return state


def number_repeats(rows: DataFrame, tables: Scratch, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows`` with ``repeat``: 0, or the number of a row among those of its (doc_id, size).

    Numbers run on over the partitions a group lies in, so no task sees more of a group than
    one partition holds of it, or one count for each partition. Which of a group's equal rows
    has which number does not matter. ``keep`` stages what the result still reads (default: ``tables``).
    """
    keep = keep or tables.put
    same = ["doc_id", "size"]
    groups = keep(rows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(f"of_{c}") for c in same]))
    if not groups.limit(1).count():
        return rows.withColumn("repeat", F.lit(0).cast("long"))
    is_one = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("size") == F.col("of_size"))
    marked = rows.withColumn("part", F.spark_partition_id()).join(groups.withColumn("many", F.lit(True)), is_one, "left")
    marked = marked.drop("of_doc_id", "of_size")
    many = tables.put(marked.where("many").drop("many"))  # both uses see the same parts
    earlier = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = many.groupBy(*same, "part").agg(F.count("*").alias("n")).select(
        *[F.col(c).alias(f"of_{c}") for c in same], F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    at = F.row_number().over(Window.partitionBy(*same, "part").orderBy(F.lit(0))) - 1
    placed = many.withColumn("at", at).join(counts, is_one & (F.col("part") == F.col("of_part")))
    numbered = keep(placed.withColumn("repeat", F.col("before") + F.col("at")).select(*rows.columns, "repeat"))
    single = marked.where("many IS NULL").withColumn("repeat", F.lit(0).cast("long")).select(*rows.columns, "repeat")
    return single.unionByName(numbered)


def priority(seed: int) -> Column:
    """Hash of the row in (0, 1) over the fractional part of its rate; null if that is 0."""
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("repeat")).bitwiseAND(F.lit((1 << 52) - 1))
    part = F.col("rate") - F.floor("rate")
    return F.when((F.col("size") > 0) & (part > 0), (draw + F.lit(0.5)) / F.lit(float(1 << 52)) / part)


def rounding_cuts(rated: DataFrame, tilts: DataFrame, tables: Scratch) -> DataFrame:
    """(key, cut): documents with a priority below ``cut`` take the copy their rate's fraction offers.

    Two histograms of the priority, the second inside the bin where a source's tokens
    cross its target. The cut is the edge that comes nearest; no window ever sees more
    than one source's bins.
    """
    whole = rated.groupBy("key").agg(F.sum(F.col("size") * F.floor("rate")).alias("whole"))
    open_rows = rated.where(F.col("priority").isNotNull()).select(
        "key", "size", F.least("priority", F.lit(2.0 - 2.0**-40)).alias("p")
    )
    need = tilts.join(whole, "key").select("key", (F.col("target") - F.col("whole")).alias("need"))
    upto = Window.partitionBy("key").orderBy("bin")

    def crossing(rows: DataFrame, bin: Column) -> DataFrame:
        return (
            rows.groupBy("key", bin.alias("bin"))
            .agg(F.sum("size").alias("tokens"))
            .withColumn("upto", F.sum("tokens").over(upto))
        )

    first = F.floor(F.col("p") * (BINS // 2))
    crossed = (
        crossing(open_rows, first)
        .join(need, "key")
        .where(F.col("upto") > F.col("need"))
        .groupBy("key")
        .agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("tokens")).alias("before"), "need"), "bin").alias("at"))
        .select("key", F.col("at.bin").alias("at_bin"), F.col("at.before").alias("before"), F.col("at.need").alias("need"))
    )
    crossed = tables.put(crossed)
    second = F.floor((F.col("p") * (BINS // 2) - F.col("at_bin")) * BINS)
    inside = open_rows.join(crossed, "key").where(first == F.col("at_bin"))
    edges = crossing(inside, second).join(crossed, "key")
    after = edges.select(
        "key",
        ((F.col("at_bin") + (F.col("bin") + 1) / BINS) / (BINS // 2)).alias("cut"),
        F.abs(F.col("need") - F.col("before") - F.col("upto")).alias("off"),
    )
    start = crossed.select(
        "key", (F.col("at_bin") / (BINS // 2)).alias("cut"), F.abs(F.col("need") - F.col("before")).alias("off")
    )
    best = after.unionByName(start).groupBy("key").agg(
        F.min_by("cut", F.struct("off", "cut")).alias("cut")
    )
    return tables.put(best)


def plan_mix(
    docs: DataFrame,
    tables: Scratch,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): staged (doc_id, source, size, key, repeat) and what each source was given."""
    rows = tables.put(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn(
            "key", source_key(F.col("source"))
        )
    )
    rows = tables.put(number_repeats(rows, tables))
    targets = source_targets(rows, tables, weights, share, cap)
    tilts = solve_tilts(rows, targets, tables, cap)
    rated = rows.join(tilts, "key").withColumn("rate", rate(cap)).withColumn("priority", priority(seed))
    cuts = rounding_cuts(rated, tilts, tables)
    sources = tables.put(tilts.join(cuts, "key", "left").withColumn("cut", F.coalesce("cut", F.lit(float("inf")))))
    return rows, sources


def copies(sized: DataFrame, sources: DataFrame, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """Rows with doc_id, size, key and repeat, plus their source's figures, ``rate`` and ``copies``.

    A rate of exactly ``cap`` is whole; otherwise the fraction's copy is given below the cut.
    """
    return (
        sized.join(sources, "key")
        .withColumn("rate", rate(cap))
        .withColumn("priority", priority(seed))
        .withColumn(
            "copies",
            (F.floor("rate") + F.coalesce(F.col("priority") < F.col("cut"), F.lit(False)).cast("long")).cast("long"),
        )
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its copies say, same columns.

    The plan is made and staged now, with the rows of repeated (doc_id, size); the others are
    taken from ``docs`` when the mix is read.
    """
    from tabbridge.llm.staging import result

    def keep(table: DataFrame) -> DataFrame:
        return result(table, "mix")

    spark, names = docs.sparkSession, docs.columns
    with scratch(spark, "mix") as tables:
        sources = keep(plan_mix(docs, tables, **options)[1])
        own = {"cap": options.get("cap", 2.0), "seed": options.get("seed", 0)}
        packed = docs.select(
            F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"),
            "doc_id",
            word_count(F.col("text")).alias("size"),
            source_key(F.col("source")).alias("key"),
        )
        dealt = copies(number_repeats(packed, tables, keep), sources, **own)
    return (
        dealt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
        .where(F.col("copies") > 0)
        .select("row.*")
    )

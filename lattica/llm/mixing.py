"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every document of a source is queued in a keyed shuffled order, and the queue is served
again until the source's cap. A queue entry's virtual finish time is the source's words up
to and including it, divided by the source's weight. Serving entries by finish time and
stopping when the budget is spent gives every source its weighted share; a source that
runs out leaves its share to the others, which is water-filling.

Nothing needs one task to see a source or the whole queue. Running totals take two levels:
within a hash bucket of a source by a window, between buckets by totals of buckets. The
global order takes ranges of virtual time, as many as keep RANGE_ROWS entries in one: fair queueing spends words evenly over
virtual time, so ranges of equal width hold about equal numbers of words. To decide what is served (``mix``)
only the range in which the budget runs out is ordered to the row; ``mixture`` sorts all of it by range partitions.
The plan has one row a source, and is made by windows over sources: their number, not that of
documents, must fit a task.

Edge cases: null text or no word has size 0, is never served and takes 0; a null source is
a source of its own, last in order; an empty table gives an empty result; repeated rows are
separate documents; very long texts are counted whole; extra columns are kept by ``mixture``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
BUCKETS = 1024
#: Ranges of virtual time at least, and entries in one.
RANGES, RANGE_ROWS = 4096, 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """From (source, source_size): weight, target and the virtual time at which the budget is spent.

    Weights repeat over sources in code point order, null last. In order of the virtual
    time at which a source is exhausted, the first source that outlasts an even share of
    what is left fixes the final virtual time.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = Window.orderBy("exhausted", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("weight", pick.cast("long"))
        .withColumn("cap", F.col("source_size") * F.lit(cap))
        .withColumn("exhausted", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("share", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("ended", F.min(F.when(F.col("share") <= F.col("exhausted"), F.struct("exhausted", "share"))).over(everything)["share"])
        .withColumn("ended", F.coalesce(F.col("ended"), F.max("exhausted").over(everything)))
        .withColumn("target", F.least(F.col("weight") * F.col("ended"), F.col("cap").cast("double")))
        .drop("share")
    )


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str, key: int, carry: bool) -> DataFrame:
    """Narrow rows, or with all of the row in ``__row``: size, shuffled place and bucket of each document."""
    base = docs.select(
        F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("source"), common.n_words(F.col(f"`{text_col}`")).alias("size"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if carry else []),
    )
    base = base.withColumn("__order", F.xxhash64(F.lit(key), F.col("__id")))
    return base.withColumn("__bucket", F.pmod(F.xxhash64(F.col("__order")), F.lit(BUCKETS)).cast("int"))


def _queue(base: DataFrame, offsets: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds what the plan has for the source, and the virtual finish time of the first copy."""
    within = Window.partitionBy("source", "__bucket").orderBy("__order", "__id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = base.withColumn("__within", F.sum("size").over(within))
    at = offsets.select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), "__ahead")
    queued = queued.join(at, queued["source"].eqNullSafe(at["__s"]) & (queued["__bucket"] == at["__b"]), "left").drop("__s", "__b")
    queued = common.attach(queued, plan.select("source", "source_size", "weight", "target"), "source", "__id")
    return queued.withColumn("virtual_finish", (F.col("__ahead") + F.col("__within")) / F.col("weight"))


def _place(finish, source="source", order="__order"):
    """What entries are served by: virtual finish time, then source (null last), then shuffled place."""
    return F.struct(finish.alias("finish"), F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(order).alias("place"))


def _copies(queued: DataFrame, end: dict, cap: int) -> DataFrame:
    """Adds copies (0 to cap): how many of a document's entries come before the cut-off."""
    finish = [F.col("virtual_finish") + F.lit(k) * F.col("source_size") / F.col("weight") for k in range(cap)]
    before = lambda f: F.lit(True)
    if end["cut"] is not None:
        cut = F.struct(*[F.lit(end["cut"][c]).alias(c) for c in ("finish", "none", "source", "place")])
        before = lambda f: _place(f) < cut
    served = sum((F.when((f <= F.lit(end["last"])) & before(f), 1).otherwise(0) for f in finish), F.lit(0))
    return queued.withColumn("copies", F.when(F.col("size") > 0, served).otherwise(0).cast("int"))


def _schedule(base: DataFrame, weights: tuple[int, ...], budget: float, cap: int) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Bucket offsets, the plan of sources, the queue and where it is cut. ``base`` is cut already."""
    buckets = common.cut(base.groupBy("source", "__bucket").agg(F.sum("size").alias("bucket_size")))
    plan = common.cut(targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, budget, cap))
    ahead = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("source", "__bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("__ahead"))
    queued = common.cut(_queue(base, offsets, plan))
    ended = plan.agg(F.max("ended").alias("ended"), F.max("budget").alias("budget")).first()
    if not ended["budget"]:
        return offsets, plan, queued, {"last": 0.0, "cut": None}

    #: Entries served by the final virtual time never exceed the budget; one more range holds what rounding leaves.
    parts = max(RANGES, cap * queued.count() // RANGE_ROWS)
    width, last = ended["ended"] / parts, ended["ended"] * (1 + 1 / parts)
    copies = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: F.col("virtual_finish") + k * F.col("source_size") / F.col("weight"))
    entries = queued.where("size > 0").select(F.explode(copies).alias("finish"), "source", "__order", "__id", "size").where(F.col("finish") <= F.lit(last))
    entries = entries.withColumn("range", F.floor(F.col("finish") / F.lit(width)))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = entries.groupBy("range").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(upto))
    edge = ranges.where(F.col("upto") > F.lit(ended["budget"])).orderBy("range").first()
    if edge is None:
        return offsets, plan, queued, {"last": last, "cut": None}
    serve = Window.partitionBy("range").orderBy(_place(F.col("finish")), "__id", "size").rowsBetween(Window.unboundedPreceding, 0)
    over = entries.where(F.col("range") == edge["range"]).withColumn("total", F.lit(edge["upto"] - edge["n"]) + F.sum("size").over(serve))
    cut = over.where(F.col("total") > F.lit(ended["budget"])).agg(F.min(_place(F.col("finish"))).alias("cut")).first()["cut"]
    return offsets, plan, queued, {"last": last, "cut": cut}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP, key: int = 42) -> DataFrame:
    """A row for each document: id, source, size, source_size, target, copies, taken, weight, virtual_finish."""
    base = common.cut(_base(docs, id_col, text_col, source_col, key, carry=False))
    _, _, queued, end = _schedule(base, weights, budget, cap)
    return _copies(queued, end, cap).select(
        F.col("__id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), "weight", "virtual_finish",
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP, key: int = 42, ordered: bool = True) -> DataFrame:
    """The mixture itself: the rows of ``docs``, repeated ones repeated, in global order of virtual finish time.

    The plan is made from narrow rows; whole rows go through one shuffle for their place in
    their bucket, and through the global range sort unless ``ordered`` is false.
    """
    base = common.cut(_base(docs, id_col, text_col, source_col, key, carry=False))
    offsets, plan, _, end = _schedule(base, weights, budget, cap)
    whole = _copies(_queue(_base(docs, id_col, text_col, source_col, key, carry=True), offsets, plan), end, cap).where("copies > 0")
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    if ordered:
        whole = whole.withColumn("finish", F.col("virtual_finish") + F.col("copy") * F.col("source_size") / F.col("weight")).orderBy(_place(F.col("finish")))
    return whole.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])

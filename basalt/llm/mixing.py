"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Document rates r are as close as possible (in relative entropy) to one copy each, at most `cap`, and meet
each source's token target. The dual is convex with one multiplier for each source: r = min(cap, exp(l * x)) with x the
document's size over its source's mean size. Newton's iterations find l for all sources at once; each is one
aggregation over the counts of (source, size), which are gathered once, so a source that holds a third of all
rows is a few thousand counts.

Rates become whole copies by carrying the rounding along sizes: cells of (source, size, salt), at most about `cell_rows` rows each,
get the whole number by which the running sum of rates steps over them; within a cell the rows with
the smallest hashes get one copy more. What tokens still miss then goes to the
shortest documents. So taken tokens differ from the target by less than a short document, and reruns agree.

Defined results: a null or empty text has size 0 and is taken 0 tokens; null sources are one source, the last;
a source without tokens has target 0; repeated rows each count; rows alike in id and size are interchangeable; an empty
table gives an empty table; extra columns are ignored (`with_copies` keeps them all, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import WORD, cut, pick, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
CELL_ROWS = 4096
#: Classes and cells (numbers of some 100 bytes a row) are broadcast up to so many rows, else joined by shuffle.
BROADCAST_ROWS = 500_000
MOST_ROUNDS = 80
TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked_sources(per: DataFrame) -> DataFrame:
    """per with `rank`, a source's place by code point from 0, null last: its place in its partition of one global sort, and the rows of the partitions before."""
    held = cut(per.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = held.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("k"))
    # One row for each partition of the sort, however many sources there are.
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("p", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    ranked = held.join(F.broadcast(starts), part == F.col("p"))
    return ranked.withColumn("rank", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "p", "start")


def source_targets(counts: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, rows, target from counts of (source, size, n).

    Targets fill like water: level * weight, but never above cap * source_size. Each round finds the sources that the level fills and shares what they leave among
    the others, until no more are full; a round is one aggregation to one row. No task sees all sources.
    """
    per = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = cut(ranked_sources(per).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap)))
    level, full = 0.0, -1
    while True:
        filled = F.col("most") < F.lit(level) * F.col("weight")
        of = lambda column, rows: F.coalesce(F.sum(F.when(rows, F.col(column))), F.lit(0.0))
        total, held, over, now = per.agg(of("source_size", F.lit(True)), of("most", filled), of("weight", ~filled), F.count(F.when(filled, 1))).first()
        if now <= full or not over:
            break
        level, full = (total * share - held) / over, now
    return per.select("source", "source_size", "rows", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def tilts(counts: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """source, l: the dual's solution by safeguarded Newton iterations, l null where all rates are the cap."""
    top = F.log(F.lit(cap))
    mean = F.col("source_size") / F.col("rows")
    state = targets.where("source_size > 0").select(
        "source",
        "target",
        mean.alias("mean"),
        F.lit(-1e4).alias("low"),
        F.lit(1e4).alias("high"),
        F.log(F.greatest(F.least(F.col("target") / F.col("source_size"), F.lit(cap * 0.95)), F.lit(1e-6))).alias("l"),
        (F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12))).alias("full"),
    )
    state = cut(state.select("*", F.col("full").alias("done")))
    for _ in range(MOST_ROUNDS):
        if state.where("not done").limit(1).count() == 0:
            break
        open_ = state.where("not done").select(F.col("source").alias("s"), "l", "mean")
        x = F.col("size") / F.col("mean")
        at = F.col("l") * x
        rate = F.exp(F.least(at, top))
        sums = (
            counts.join(open_, F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.when(at < top, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"))
        )
        miss = F.col("got") - F.col("target")
        low = F.when(miss < 0, F.col("l")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("l")).otherwise(F.col("high"))
        step = F.col("l") - miss / F.when(F.col("slope") > 0, F.col("slope"))
        middle = F.when(high - low > 100, F.signum(F.col("l")) * F.least(F.abs(F.col("l")) * 4 + 1, F.lit(9e3))).otherwise((low + high) / 2)
        inside = step.isNotNull() & (step > low) & (step < high)
        met = (F.abs(miss) <= F.col("target") * TOLERANCE + 1e-9) | (high - low < 1e-13)
        new = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source",
            "target",
            "mean",
            F.when(F.col("got").isNull(), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("got").isNull(), F.col("high")).otherwise(high).alias("high"),
            F.when(F.col("got").isNull() | met, F.col("l")).when(inside, step).otherwise(middle).alias("l"),
            "full",
            (F.col("done") | F.coalesce(met, F.lit(False))).alias("done"),
        )
        state = cut(new)
    return state.select("source", F.when(~F.col("full"), F.col("l")).alias("l"), "mean")


def with_copies(df: DataFrame, id_col: str, source_col: str, size: Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, cell_rows: int = CELL_ROWS) -> DataFrame:
    """row (df's row as a struct), size, source_size, target, rate, copies. df is read three times."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    at = lambda c: F.col(f"c{names.index(c)}")
    units = plain.select(F.struct(*plain.columns).alias("row"), at(id_col).alias("id"), at(source_col).alias("source"), size.alias("size"))
    counts = cut(units.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = cut(source_targets(counts, weights, share, cap))
    solved = tilts(counts, targets, cap)
    known = targets.join(solved.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rate = F.when(F.col("size") == 0, 0.0).otherwise(F.coalesce(F.exp(F.least(F.col("l") * F.col("size") / F.col("mean"), F.log(F.lit(cap)))), F.lit(cap)))
    classes = counts.join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "source_size", "target", rate.alias("rate"), F.ceil(F.col("n") / cell_rows).alias("salts"))
    classes = cut(classes.select(*[F.col(c).alias(f"k_{c}") for c in classes.columns]))
    few = lambda table_: F.broadcast(table_) if table_.count() <= BROADCAST_ROWS else table_
    classes = few(classes)
    salted = units.join(classes, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size"))).select(
        "row", F.col("source"), "size", F.col("k_source_size").alias("source_size"), F.col("k_target").alias("target"), F.col("k_rate").alias("rate"), F.xxhash64("id", F.lit("mix")).alias("h"), F.pmod(F.xxhash64("id", F.lit("salt")), F.col("k_salts")).alias("salt")
    )
    # A cell's first row sees the cell's size, and the running sum goes over cells only.
    narrow = units.drop("row").join(classes, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size")))
    cells = narrow.groupBy("source", "size", F.pmod(F.xxhash64("id", F.lit("salt")), F.col("k_salts")).alias("salt")).agg(F.count(F.lit(1)).alias("m"), F.first("k_rate").alias("r"), F.first("k_target").alias("target"))
    upto = F.sum(F.col("m") * F.col("r")).over(Window.partitionBy("source").orderBy("size", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prior = Window.partitionBy("source").orderBy("size", "salt")
    cells = cells.withColumn("whole", F.floor(upto + 0.5)).withColumn("whole", F.col("whole") - F.coalesce(F.lag("whole").over(prior), F.lit(0)))
    cells = cells.withColumn("whole", F.least(F.col("whole"), F.floor(F.col("m") * F.lit(cap))))
    # What tokens still miss goes to the shortest documents, whose copies come closest.
    miss = F.col("target") - F.sum(F.col("whole") * F.col("size")).over(Window.partitionBy("source"))
    room = F.when(F.col("size") == 0, 0).when(miss > 0, F.floor(F.col("m") * F.lit(cap)) - F.col("whole")).otherwise(F.col("whole"))
    cells = cells.withColumn("miss", miss).withColumn("room", room)
    before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(prior.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.least(F.floor((F.abs("miss") - before) / F.when(F.col("size") > 0, F.col("size")) + 0.5), F.col("room")), F.lit(0))
    cells = cells.select(F.col("source").alias("k_source"), F.col("size").alias("k_size"), F.col("salt").alias("k_salt"), "m", (F.col("whole") + F.signum("miss") * F.coalesce(more, F.lit(0))).cast("bigint").alias("whole"))
    joined = salted.join(few(cut(cells)), F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size")) & (F.col("salt") == F.col("k_salt")))
    nth = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("h"))
    each = F.floor(F.col("whole") / F.col("m"))
    more = F.when(nth <= F.col("whole") - each * F.col("m"), 1).otherwise(0)
    return joined.select("row", "size", "source_size", "target", "rate", (each + more).cast("bigint").alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df's rows, each as often as the mix takes it."""
    names = df.columns
    made = with_copies(df, id_col, source_col, word_count(F.col(f"c{names.index(text_col)}")))
    often = made.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return often.select(*[F.col(f"row.c{i}").alias(n) for i, n in enumerate(names)])


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words of it that the mix takes."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", source="source", text="text")
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    made = with_copies(sized, "doc_id", "source", F.col("c2"))
    return made.select(F.col("row.c0").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate")

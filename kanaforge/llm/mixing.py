"""Mixing sources to target weights by Pfair scheduling. DataFrame and SQL functions only.

Each source's documents, in an order given by a hash of the id, are cut into blocks. With weight w, the j-th
block of a source is released at slot floor((j-1) / w) and due at ceil(j / w), and each slot goes to the released
block that is due first: at full load this keeps every source within one block of its weight at every slot.

Nothing repeats, so nothing drifts: weights are whole multiples of 1 / UNIT that add up to one, and windows are worked
out in whole numbers over the entire run. What a slot gets depends on the slots before it, but only through which
blocks are still waiting. So the run is cut into frames that are scheduled side by side, each from a guess of what
waits at its start (the blocks that are due last). A frame whose guess differs from the end of the frame before it is
scheduled again from that end, until none differs: the schedule is the one that a single pass would give. Two
schedules of one frame soon agree, as they run the same block whenever it is the most urgent for both.

Defined cases: every row is kept once. When a source runs out its weight cannot be met any more: `balanced` marks
the rows before its first block that is missing or not full, and all other blocks follow in the order of their
virtual times (j - 1/2) / w; a null source is a source of its own; repeated ids are ordered next to each other; an
empty table gives an empty one. Any number of sources is mixed. Columns of any name pass through with their values, but
for those named like the outputs of positions(), which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kanaforge.llm.common import drop, materialize, packed, table

#: Weights are multiples of 1 / UNIT; a frame's slots times UNIT stay below 2^63.
UNIT = 1 << 48
#: Slots of a frame at least and at most; between them eight for each source, so that schedules have room to agree.
FRAME, LONGEST_FRAME = 1024, 1 << 14
#: Documents of a block.
BLOCK = 16
#: Rows that are numbered together, about.
BUCKET_ROWS = 50_000
#: Blocks that one row of a plan is spread into.
SPREAD = 1 << 16
LEAST_STRETCH = 256
NO_SOURCE = "\0"
OUTPUTS = ["mix_block", "mix_slot", "mix_pos", "balanced"]


def tempered(counts: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Target weights in proportion to a power of the sources' sizes."""
    return {s: n**power for s, n in counts.items()}


def units(weights: dict[str, float]) -> dict[str, int]:
    """Weights as multiples of 1 / UNIT, one at least, that add up to UNIT."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    total = sum(map(Fraction, weights.values()))
    out = {s: max(1, int(Fraction(w) * UNIT / total)) for s, w in weights.items()}
    most = min(out, key=lambda s: (-out[s], s))
    out[most] += UNIT - sum(out.values())
    return out


def _array(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" for v in values) + ")"


def guessed(starts: DataFrame, w: str, frame: int) -> DataFrame:
    """(frame, used): what each source has run before a frame, taking the waiting blocks to be those due last."""
    begun = F.expr(f"transform({w}, u -> cast(frame * {frame} AS decimal(19,0)) * cast(u AS decimal(19,0)))")
    shared = starts.select("frame", begun.alias("x"))
    shared = shared.select("frame", F.expr(f"transform(x, x -> x div {UNIT}bd)").alias("whole"), F.expr(f"transform(x, x -> cast(x % {UNIT}bd AS bigint))").alias("rest"))
    due = f"array_sort(filter(transform({w}, (u, i) -> if(rest[i] > 0, named_struct('due', ({UNIT}L - rest[i] + u - 1) div u, 'i', i), NULL)), x -> x IS NOT NULL))"
    many = f"cast(frame * {frame} - aggregate(whole, 0L, (s, x) -> s + x) AS int)"
    first = shared.select("frame", "whole", F.expr(f"transform(slice({due}, 1, {many}), x -> x.i)").alias("first"))
    return first.select("frame", F.expr("transform(whole, (x, i) -> x + if(array_contains(first, i), 1L, 0L))").alias("used"))


def scheduled(starts: DataFrame, w: str, frame: int) -> DataFrame:
    """(frame, used, after, runs): the slots of each frame by earliest deadline first, from what was used before."""
    begun = F.expr(f"transform({w}, u -> cast(frame * {frame} AS decimal(19,0)) * cast(u AS decimal(19,0)))")
    rows = starts.select("frame", "used", begun.alias("x"))
    rows = rows.select("frame", "used", F.expr(f"transform(x, x -> x div {UNIT}bd)").alias("whole"), F.expr(f"transform(x, x -> cast(x % {UNIT}bd AS bigint))").alias("rest"))
    # block whole + l of a source is released by slot t of the frame if (l * UNIT - rest) / u < t + 1
    due = f"""array_min(filter(transform({w}, (u, i) -> if(s.l[i] * {UNIT}L - rest[i] < (t + 1) * u,
        named_struct('due', ((s.l[i] + 1) * {UNIT}L - rest[i] + u - 1) div u, 'i', i), NULL)), x -> x IS NOT NULL)).i"""
    fold = f"""aggregate(sequence(0L, {frame - 1}L),
        named_struct('l', zip_with(used, whole, (a, b) -> a - b), 'runs', cast(array() AS array<struct<kind:int,block:bigint>>)),
        (s, t) -> transform(array({due}), p -> named_struct(
            'l', transform(s.l, (x, i) -> if(i = p, x + 1, x)),
            'runs', concat(s.runs, array(named_struct('kind', p, 'block', whole[p] + s.l[p])))))[0])"""
    done = rows.select("frame", "used", "whole", F.expr(fold).alias("s"))
    return done.select("frame", "used", F.expr("zip_with(whole, s.l, (a, b) -> a + b)").alias("after"), "s.runs")


def slots_of(spark: SparkSession, weights: list[int], slots: int) -> DataFrame:
    """(kind, mix_block, mix_slot) of the first slots, and up to a frame more; kind: the number of a weight."""
    frame = min(LONGEST_FRAME, max(FRAME, 8 * len(weights)))
    w = _array(weights)
    made, path = materialize(scheduled(guessed(spark.range(-(-slots // frame)).select(F.col("id").alias("frame")), w, frame), w, frame))
    while True:
        ends = made.select((F.col("frame") + 1).alias("frame"), F.col("after").alias("right"))
        wrong, wrong_path = materialize(made.join(ends, "frame").where("used <> right").select("frame", F.col("right").alias("used")))
        if wrong.isEmpty():
            drop(spark, wrong_path)
            break
        better, better_path = materialize(made.join(wrong.select("frame"), "frame", "left_anti").unionByName(scheduled(wrong, w, frame)))
        drop(spark, path)
        drop(spark, wrong_path)
        made, path = better, better_path
    return made.select("frame", F.posexplode("runs").alias("t", "r")).select("r.kind", F.col("r.block").alias("mix_block"), (F.col("frame") * frame + F.col("t")).alias("mix_slot"))


def plan_of(spark: SparkSession, counts: dict[str, int], weights: dict[str, int], block: int) -> tuple[DataFrame, int]:
    """(mix_source, mix_block, mix_slot) of every block that has a row, and the first slot that is not balanced."""
    names = sorted(weights)
    w, full = [weights[s] for s in names], [counts[s] // block for s in names]
    # the first block that is not full is due, and so runs, before this slot
    slots = table(slots_of(spark, w, min(-(-(n + 1) * UNIT // u) for n, u in zip(full, w, strict=True))))
    end = slots.where(F.expr(f"mix_block >= {_array(full)}[kind]")).agg(F.min("mix_slot")).first()[0]
    begun = slots.where(F.col("mix_slot") < end)
    done = {r["kind"]: r["count"] for r in begun.groupBy("kind").count().collect()}  # a row for each source
    rows = [(i, s, done.get(i, 0), -(-counts[s] // block), weights[s]) for i, s in enumerate(names)]
    kinds = F.broadcast(spark.createDataFrame(rows, "kind int, mix_source string, done long, blocks long, w long"))
    run = begun.join(kinds, "kind").select("mix_source", "mix_block", "mix_slot")
    parts = kinds.where("done < blocks").select("mix_source", "w", "blocks", F.explode(F.expr(f"sequence(done, blocks - 1, {SPREAD}L)")).alias("from")).repartition("mix_source", "from")
    tail = parts.select("mix_source", "w", F.explode(F.expr(f"sequence(from, least(from + {SPREAD - 1}, blocks - 1))")).alias("mix_block"))
    timed = tail.select("mix_source", "mix_block", ((F.col("mix_block") + 0.5) / F.col("w")).alias("time"))
    later = numbered(timed, ["time", "mix_source", "mix_block"], "mix_slot").select("mix_source", "mix_block", (F.col("mix_slot") + end).alias("mix_slot"))
    return run.unionByName(later), end


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number, from 0, in an order: each range of the order is numbered by itself."""
    laid = table(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = laid.groupBy("_range").count()
    before = sizes.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return laid.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_range", "_own", "_before")


def placed(docs: DataFrame, weigh: Callable[[dict[str, int]], dict[str, float]], block: int) -> DataFrame:
    """(row, OUTPUTS): each whole row of docs as a struct, so that no name of its columns matters, with its place."""
    spark = docs.sparkSession
    named = docs.select(packed(docs).alias("row"), "doc_id", F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("mix_source"))
    counts = {r["mix_source"]: r["count"] for r in named.groupBy("mix_source").count().collect()}
    if not counts:
        return named.select("row", *[F.lit(None).cast("boolean" if c == "balanced" else "long").alias(c) for c in OUTPUTS])
    plan, end = plan_of(spark, counts, units(weigh(counts)), block)
    bits = max(8, (sum(counts.values()) // BUCKET_ROWS).bit_length())
    keyed = named.withColumn("key", F.xxhash64("doc_id")).withColumn("bucket", F.expr(f"shiftrightunsigned(key, {64 - bits})").cast("int"))
    sizes = keyed.groupBy("mix_source", "bucket").agg(F.count("*").alias("n"))
    running = Window.partitionBy("mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("mix_source", "bucket", "n", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    # each bucket gets the slots of its own blocks, so that the rows need no exchange to find theirs
    spread = before.select("mix_source", "bucket", "before", F.expr(f"before div {block}").alias("from"), F.explode(F.expr(f"sequence(before div {block}, (before + n - 1) div {block})")).alias("mix_block"))
    slotted = spread.join(plan, ["mix_source", "mix_block"]).groupBy("mix_source", "bucket", "before", "from")
    lists = table(slotted.agg(F.transform(F.array_sort(F.collect_list(F.struct("mix_block", "mix_slot"))), lambda x: x["mix_slot"]).alias("slots")))
    order = Window.partitionBy("mix_source", "bucket").orderBy(F.expr(f"key & {(1 << (64 - bits)) - 1}"), "doc_id")
    ranked = keyed.withColumn("n", F.row_number().over(order)).join(lists, ["mix_source", "bucket"]).withColumn("rank", F.col("before") + F.col("n") - 1)
    found = ranked.withColumn("mix_block", F.expr(f"rank div {block}")).withColumn("mix_slot", F.expr("slots[cast(mix_block - from AS int)]"))
    return found.select("row", "mix_block", "mix_slot", (F.col("mix_slot") * block + F.col("rank") % block).alias("mix_pos"), (F.col("mix_slot") < end).alias("balanced"))


def positions(docs: DataFrame, weigh: Callable[[dict[str, int]], dict[str, float]] = tempered, block: int = BLOCK) -> DataFrame:
    """docs with mix_block (number of the block within its source), mix_slot, mix_pos and balanced.

    mix_pos orders the mixture. Columns of these names are replaced."""
    return placed(docs, weigh, block).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in OUTPUTS], *OUTPUTS)


def mixed(docs: DataFrame, weigh: Callable[[dict[str, int]], dict[str, float]] = tempered, block: int = BLOCK) -> DataFrame:
    """docs with the same columns, laid out in the order of the mixture: each stretch of it in one task, in order.

    There are about four stretches for each shuffle partition, of LEAST_STRETCH rows at least."""
    stretch = max(LEAST_STRETCH, docs.count() // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = placed(docs, weigh, block).withColumn("stretch", F.expr(f"mix_pos div {stretch}"))
    return rows.repartition("stretch").sortWithinPartitions("stretch", "mix_pos").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

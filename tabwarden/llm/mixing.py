"""Mixing sources to target weights along a low-discrepancy schedule, in DataFrame functions only.

Each source's documents, shuffled by a hash and laid end to end, are one stream of words, read over
again up to `most` times and cut into blocks of BLOCK words.  The mix is a row of slots: slot i maps the
golden-ratio point frac(i / phi) through the sources' cumulative weights to a source, and the slots of a
source, ranked, take the blocks of its stream in order.  Joining slots with the documents that a block
covers gives the pieces (slot, document, words).

Targets: weights share all words; a target stops at `most` times its source's size and the excess goes to
the others by weight.  A source takes as many blocks as its target holds, the last one cut to fit; where
the schedule gives it a slot or two fewer, they follow at the end.

Ranks and running sums over a source are taken in two levels, within hashed parts and over the parts'
sums, so that no task holds a source's rows.

Defined cases.  A null text has no words; null is a source, the last.  Documents without words are in no
piece and take 0.  Of repeated rows, each has its own place in the stream.  An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.llm.tables import written

BLOCK = 64
WEIGHTS = (5, 2, 1)
#: Slots and documents of a part, about, in two-level ranks and sums.
PART = 20_000
DOC_PART = 2_000
#: 2**31 / phi, made odd: multiples modulo 2**31 are the golden-ratio points in integers.
_GOLDEN, _UNIT = 1327217885, 1 << 31
_CELLS = 4096


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, size) rows -> (source, source_no, source_size, weight, target), one row a source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()  # over sources, not over documents
    numbered = by_source.withColumn("source_no", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    weighed = numbered.withColumn("weight", weight).withColumn("most", (F.col("source_size") * most).cast("double"))
    # the sources that reach their limit first come first; each is held against the level that those before it leave
    before = everything.orderBy(F.col("most") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = weighed.withColumn("level", left / share).withColumn("full", F.col("level") * F.col("weight") > F.col("most"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "source_no", "level"))).over(everything)["level"]
    return levelled.select("source", "source_no", "source_size", "weight", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def _streams(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Documents with words, with `at`: where each begins in its source's shuffled stream."""
    # a part has a fixed share of the hashes; their number follows the number of rows
    parts = max(64, sizes.count() // DOC_PART)
    placed = sizes.where("size > 0").withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "size"))
    placed = placed.withColumn("part", F.pmod("draw", F.lit(parts)))
    sums = placed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    starts = sums.withColumn("part_at", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.join(plan, starts["source"].eqNullSafe(plan["source"])).select("source_no", "part", "part_at", "source_size", "words_due", starts["source"].alias("source"))
    own = Window.partitionBy("source", "part").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("in_part", F.coalesce(F.sum("size").over(own), F.lit(0)))
    joined = within.join(starts, within["source"].eqNullSafe(starts["source"]) & (within["part"] == starts["part"]))
    return joined.select("doc_id", "size", "source_no", "source_size", "words_due", (F.col("part_at") + F.col("in_part")).alias("at"))


def _slots(plan: DataFrame, block: int) -> DataFrame:
    """(slot, source_no, block_no): which block of which source each slot of the mix takes."""
    spark = plan.sparkSession
    blocks = plan.where("words_due > 0").select("source_no", F.ceil(F.col("words_due") / block).cast("long").alias("blocks"))
    total = blocks.agg(F.coalesce(F.sum("blocks"), F.lit(0)).cast("long").alias("n")).first()["n"]
    upto = F.sum("blocks").over(Window.partitionBy().orderBy("source_no"))  # over sources
    bounds = blocks.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("blocks"))
    cell = lambda c: F.expr(f"least({_CELLS - 1}, cast(floor({c} / {max(1, total)}D * {_CELLS}) as long))")
    cells = bounds.withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi"))))
    points = spark.range(total).select(F.col("id").alias("slot"), (((F.col("id") % _UNIT) * _GOLDEN % _UNIT) / F.lit(float(_UNIT))).alias("u"))
    points = points.withColumn("cell", F.expr(f"cast(floor(u * {_CELLS}) as long)"))
    at = F.col("u") * total
    drawn = points.join(cells, "cell").where((at >= F.col("lo")) & (at < F.col("hi"))).select("slot", "source_no", "blocks", F.expr(f"slot div {PART}").alias("part"))
    drawn = written(drawn, "slots")
    sums = drawn.groupBy("source_no", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("source_no", "part").orderBy("slot")) - 1)
    ranked = ranked.join(sums.withColumn("before", before).drop("n"), ["source_no", "part"])
    ranked = ranked.select("slot", "source_no", (F.col("rank") + F.col("before")).alias("block_no"), "blocks").where("block_no < blocks").drop("blocks")
    got = sums.groupBy("source_no").agg(F.sum("n").alias("got"))
    short = blocks.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < blocks")
    late = short.select("source_no", F.explode(F.expr("sequence(got, blocks - 1)")).alias("block_no"))  # a few a source
    late = late.select((F.row_number().over(Window.partitionBy().orderBy("block_no", "source_no")) - 1 + F.lit(total)).alias("slot"), "source_no", "block_no")
    return ranked.unionByName(late)


def schedule(sizes: DataFrame, plan: DataFrame, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """(slot, source_no, block_no, doc_id, size, at, first, words): the mix, piece by piece; first: the piece's first word in the document."""
    plan = plan.withColumn("words_due", F.round("target").cast("long"))
    docs = _streams(sizes, plan, seed).where("words_due > 0")
    rounds = docs.withColumn("round", F.explode(F.expr("sequence(0L, (words_due - 1) div source_size)")))
    rounds = rounds.withColumn("from", F.col("round") * F.col("source_size") + F.col("at")).where("from < words_due")
    rounds = rounds.withColumn("to", F.least(F.col("from") + F.col("size"), "words_due"))
    pieces = rounds.withColumn("block_no", F.explode(F.expr(f"sequence(from div {block}, (to - 1) div {block})")))
    pieces = pieces.join(_slots(plan, block), ["source_no", "block_no"])
    begin, end = F.greatest("from", F.col("block_no") * block), F.least("to", (F.col("block_no") + 1) * block)
    return pieces.select("slot", "source_no", "block_no", "doc_id", "size", "at", (begin - F.col("from")).alias("first"), (end - begin).alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """(id_col, size, source_size, target, taken) for every row of `docs`."""
    sizes = written(sized(docs, id_col, text_col, source_col), "sizes")
    plan = written(targets(sizes, weights, most), "plan")
    pieces = schedule(sizes, plan, block, seed)
    taken = pieces.groupBy("source_no", "at").agg(F.sum("words").alias("taken"))
    due = plan.withColumn("words_due", F.round("target").cast("long"))
    # a document with words is known by its source and its place there
    streams = _streams(sizes, due, seed).join(taken, ["source_no", "at"], "left").select("source_no", "doc_id", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    idle = sizes.where("size = 0").join(plan, sizes["source"].eqNullSafe(plan["source"])).select("source_no", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    out = streams.unionByName(idle).join(plan.select("source_no", "source_size", "target"), "source_no")
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken")

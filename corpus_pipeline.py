"""The corpus pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwarden.llm import decontaminate, mixing, near_dup, quality, token_output
from tabwarden.llm.queries import END_ID, VOCABULARY
from tabwarden.llm.tables import table, written

# Stages keep the columns of documents; rows are known by their place or number within the stage, since
# ids may be null or repeat.  A place needs no shuffle; a number follows the rows' contents and not their
# files, which the mix's draws need so that reruns agree.

#: Files whose numbers are broadcast, at most, at some 200 bytes each.
FILES = 100_000


def _free(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have."""
    while name.lower() in map(str.lower, docs.columns):
        name = "_" + name
    return name


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _placed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(`docs` with each row's place, that column's name): the number of its file and its own number there.

    Both come from the files, so they stay the same in every scan, whatever its splits.  What isn't read
    from Parquet is written first.
    """
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        docs = written(docs, f"{name}-rows")
    about = docs.metadataColumn("_metadata")
    file, place = _free(docs, "_file"), _free(docs, "_place")
    paths = docs.select(about["file_path"].alias(file)).distinct()
    files = written(paths.withColumn("no", F.row_number().over(Window.partitionBy().orderBy(file)).cast("long")), f"{name}-files")  # a row a file
    few = files.count() < FILES
    files = files.select(file, F.shiftleft("no", 40).alias(_free(docs, "_first")))
    rows = docs.select("*", about["file_path"].alias(file), about["row_index"].alias(place)).join(F.broadcast(files) if few else files, file)
    rows = rows.select(*(rows[_quoted(c)] for c in docs.columns), (F.col(files.columns[1]) + F.col(place)).alias(place))
    return rows if few else written(rows, f"{name}-rows"), place


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with each row's number in the order of ids, null last, and then of texts and whole rows, in the column `_free(docs, "_row")`.

    It depends on the rows only, not on their files; among equal rows any order is the same.
    """
    row = docs.select(F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias("r"))
    keys = [F.col("r.doc_id").asc_nulls_last(), F.xxhash64("r.text"), F.md5(F.to_json("r"))]
    placed = row.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, f"{name}-placed").withColumn("part", F.shiftright("at", 33))
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())  # a row a partition
    offsets = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    before = docs.sparkSession.createDataFrame(offsets, "part long, before long")
    numbered = placed.join(F.broadcast(before), "part")
    return numbered.select(*(F.col("r")[c].alias(c) for c in docs.columns), F.expr(f"(at & {(1 << 33) - 1}) + before").alias(_free(docs, "_row")))


def _only(rows: DataFrame, kept: DataFrame, place: str) -> DataFrame:
    """The rows whose place is in kept."""
    return rows.join(kept.select(place), place, "left_semi").drop(place)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier rejects go."""
    rows, place = _placed(docs, "quality")
    return _only(rows, quality.classify(rows, id_col=place).where("kept"), place)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of the smallest id stays, a null one only if there is no other."""
    rows, place = _placed(docs, "near-dedup")
    groups = near_dup.near_duplicates(rows, id_col=place).select(place, "component_id")
    member = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), place).alias("m")
    least = rows.select(place, member).join(groups, place).groupBy("component_id").agg(F.min("m").alias("m"))
    return _only(rows, least.select(F.col("m")[place].alias(place)), place)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows, place = _placed(docs, "decontamination")
    return _only(rows, decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), id_col=place).where("NOT contaminated"), place)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated as often as the mix takes its words, to the nearest whole; words it doesn't take leave it out."""
    rows, row, taken = _numbered(docs, "mixing"), _free(docs, "_row"), _free(docs, "_times")
    times = mixing.mix(rows, id_col=row).select(row, F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int").alias(taken)).where(F.col(taken) > 0)
    copies = rows.join(times, row).withColumn(_free(docs, "_copy"), F.explode(F.sequence(F.lit(1), F.col(taken))))
    return copies.select(*(F.col(_quoted(c)) for c in docs.columns))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary files, read back."""
    return token_output.token_output(docs, public_tokenizers.path(VOCABULARY), END_ID)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token output", token_stage),
]

#: The stages learn, hash and link, which SQL can't express; tests/llm/test_pipeline.py holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

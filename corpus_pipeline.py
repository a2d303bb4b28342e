"""The corpus pipeline: quality rules, near-duplicate join, PII, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``, whatever further columns it has and whatever they are called.  ``docs`` is a table of files
(``source_mix`` tells rows apart by their place in them).  ``run`` writes each stage's rows as Parquet and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.llm import mixing, packing, pii, quality
from prismframe.llm.common import broadcast_if_small, materialize, table, words
from prismframe.llm.jaccard_join import jaccard_components


#: Words to a shingle and the least similarity of near duplicates.
WIDTH, SIMILARITY = 5, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold; the others go.

    The row itself is carried in one struct, so its columns may have any names."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("document"), F.col("text").cast("string").alias("text"))
    # the row number keeps the filter above the judging, whose long expressions it would otherwise repeat
    judged = quality.judge(rows, model).withColumn("row", F.monotonically_increasing_id())
    return judged.where("kept and row >= 0").select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by ``WIDTH``-word shingles at ``SIMILARITY``: the one with the smallest id.

    Rows without an id stay; rows that share an id go by their own texts, the smallest of a group stays."""
    join = lambda rows: jaccard_components(rows, WIDTH, SIMILARITY, count_links=False)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").limit(1)
    if repeated.isEmpty():
        found = join(docs).select("doc_id", "component_id")
        dropped = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
        return docs.join(broadcast_if_small(dropped), "doc_id", "left_anti").select(*docs.columns)
    # each row is a document of its own; rows without words are groups of one, or copies if they share an id
    rows = materialize(docs.select(F.struct("*").alias("document"), F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias("row")), "rows")
    found = join(rows.select(F.col("row").alias("doc_id"), "document.text")).where("doc_id is not null")
    order = F.struct(*(F.col("document")[c] for c in ("doc_id", "text", *docs.columns)), "row")
    placed = rows.join(found.select(F.col("doc_id").alias("row"), "component_id", "n_shingles"), "row")
    group = F.when(F.col("n_shingles") > 0, F.struct(F.lit(0).alias("none"), F.col("component_id").alias("id"))).otherwise(F.struct(F.lit(1).alias("none"), F.col("document.doc_id").cast("long").alias("id")))
    first = materialize(placed.groupBy(group.alias("g")).agg(F.min_by("row", order).alias("row")).select("row"), "first")
    kept = rows.join(broadcast_if_small(first), "row", "left_semi")
    return kept.union(rows.where("row is null").select(*kept.columns)).select("document.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the personal data in its text replaced by the kinds' names in brackets."""
    found = pii.find_pii(docs).select("doc_id", "h", F.array_union("spans", "more").alias("spans")).where("size(spans) > 0").dropDuplicates(["doc_id", "h"])
    found = broadcast_if_small(materialize(found, "spans"))
    rows = docs.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("h")), "left")
    text = F.when(F.col("spans").isNotNull(), pii.redact(F.col("document.text"), F.col("spans"))).otherwise(F.col("document.text"))
    out = joined.withColumn("clean", text)
    return out.select(*_with_text(docs, F.col("clean")))


def _with_text(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of ``docs`` out of the struct ``document``, with another text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new.get(c, F.col("document")[c]).alias(c) for c in docs.columns]


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each whole round of a document and for each run of words cut from it (words then
    parted by one space).  Documents of which nothing is taken go.

    The mix is computed on sizes alone and joined back to the texts by their place in the stage's file."""
    rows = docs.select(F.struct("*").alias("document"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = rows.select(F.xxhash64("file", "row").alias("doc_id"), F.col("document.source").alias("source"), mixing.word_count(F.col("document.text")).alias("size"), "file", "row")
    taken = mixing.mix(materialize(sizes, "sizes")).where("taken > 0").select("file", "row", "size", "rounds", "cut_from", "cut_to", "wrap_to")
    mixed = rows.join(broadcast_if_small(materialize(taken, "taken")), ["file", "row"])
    whole = (F.col("cut_from") == 0) & (F.col("cut_to") == F.col("size"))
    text = F.col("document.text")
    cut = lambda start, end: F.array_join(F.slice(words(text), start + F.lit(1), end - start), " ")
    none = F.expr("cast(array() as array<string>)")
    run = F.when(~whole & (F.col("cut_to") > F.col("cut_from")), F.array(cut(F.col("cut_from").cast("int"), F.col("cut_to").cast("int")))).otherwise(none)
    wrap = F.when(F.col("wrap_to") > 0, F.array(cut(F.lit(0), F.col("wrap_to").cast("int")))).otherwise(none)
    rounds = (F.col("rounds") + whole.cast("long")).cast("int")
    out = mixed.withColumn("part", F.explode(F.concat(F.array_repeat(text, rounds), run, wrap)))
    return out.select(*_with_text(docs, F.col("part")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of at most 2048 tokens, a row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", pack),
]

#: Hashes and a fitted model decide several stages: tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs

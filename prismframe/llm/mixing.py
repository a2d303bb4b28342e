"""Operator 3 [native]: mix sources to target weights with Sainte-Lague apportionment.

Each source gets a target in words: its weight's share of the mix, never above ``most`` times its own
size, the excess going to the others by weight.  The mix is counted in blocks of equal numbers of words
and the blocks are allotted to sources by the highest quotients target / (2 s + 1); each source's blocks are
allotted in the same way to its shards by their sizes.  A shard lays its documents out in seeded
order as a stream cut into blocks and takes its quota as a run of blocks from a seeded start, around
the stream's end if need be; whole rounds come before the run.  What a document gives is its overlap
with the run, in closed form, so nothing is exploded per block.

Large sources have many shards, so no group holds a large part of the corpus.  Only source totals are
ever ranked in one task.  The source table is broadcast only while it has at most ``SMALL`` rows;
beyond that it is a shuffled join.

Null texts have size 0 and give nothing; null sources are one source, last in order; null ids are
carried.  Repeated rows are separate documents with adjacent places.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismframe.llm.common import WORD_RE, materialize, table

SMALL = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def sainte_lague(shares: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """Whole ``quota`` for each key of a group: its ``seats`` go to the highest weight / (2 s + 1).

    The result differs from the fair share q by at most (n q / seats + 1) / 2 for n keys, so only quotients in
    that range are ranked and the seats below it are given at once: about 2 rows for each key.
    """
    all_of = Window.partitionBy(*group)
    fair = shares.where(f"{weight} > 0 and {seats} > 0").withColumns({"_n": F.count("*").over(all_of), "_w": F.sum(weight).over(all_of)})
    fair = fair.withColumns({"_q": F.col(seats) * F.col(weight) / F.col("_w"), "_d": (F.col("_n") * F.col(weight) / F.col("_w") + 1) / 2})
    fair = fair.withColumns({"_lo": F.greatest(F.lit(0), F.floor(F.col("_q") - F.col("_d")) - 1), "_hi": F.ceil(F.col("_q") + F.col("_d")) + 1})
    fair = fair.withColumn("_left", F.col(seats) - F.sum("_lo").over(all_of))
    ranked = (
        fair.select(*group, key, "_lo", "_left", weight, F.explode(F.expr("sequence(_lo, _hi)")).alias("_s"))
        .withColumn("_rank", F.row_number().over(all_of.orderBy(F.desc(F.col(weight) / (2 * F.col("_s") + 1)), key)))
        .groupBy(*group, key)
        .agg((F.first("_lo") + F.count_if(F.col("_rank") <= F.col("_left"))).cast("long").alias("quota"))
    )
    return shares.join(ranked, [*group, key], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sources(source, source_size) -> with ``weight`` and ``target`` (water filling below the caps)."""
    everything = Window.partitionBy(F.lit(0))
    cycle = F.array(*map(F.lit, [float(w) for w in weights]))
    order = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    out = sources.withColumn("weight", F.get(cycle, (order - 1) % len(weights)))
    out = out.withColumns({"_cap": most * F.col("source_size"), "_all": share * F.sum("source_size").over(everything)})
    rising = everything.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    out = out.withColumns(
        {
            "_before": F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_rest": F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = (F.col("_all") - F.col("_before")) / F.col("_rest")
    open_level = F.when(F.col("_cap") > F.col("weight") * level, level)
    out = out.withColumn("_level", F.first(open_level, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return out.select("source", "source_size", "weight", F.coalesce(F.least("_cap", F.col("weight") * F.col("_level")), "_cap").alias("target"))


def mix(
    sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 42, shard_words: int = 4_000_000
) -> DataFrame:
    """Rows of ``sized`` (doc_id, source, size, ...) with source_size, target, rounds, cut_from,
    cut_to and taken.  A document is taken ``rounds`` times whole, and once more its words from
    ``cut_from`` up to ``cut_to`` or, where the run goes around the stream's end within it, also those
    up to ``wrap_to``.  Further columns are carried; those named like a result are replaced."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    outputs = ["source_size", "target", "rounds", "cut_from", "cut_to", "wrap_to", "taken"]
    carried = [c for c in sized.columns if c not in outputs]
    docs = sized.select(F.struct(*carried).alias("_all"), "doc_id", "source", "size", key.alias("_key"))
    sources = materialize(docs.groupBy("_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), "sources")
    n, least = sources.agg(F.count("*"), F.min(F.when(F.col("source_size") > 0, F.col("source_size")))).first()
    block = max(1, min(1024, (least or 1) // 2000))
    targets = source_targets(sources.drop("_key"), weights, share, most).withColumn("_key", key)
    targets = targets.withColumns({"_g": F.lit(0), "_seats": F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long")})
    quotas = sainte_lague(targets, ["_g"], "_key", "target", "_seats").select(
        "_key", "source_size", "target", F.col("quota").alias("_blocks"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).alias("_shards")
    )
    quotas = materialize(quotas, "quotas")
    small = F.broadcast(quotas) if n <= SMALL else quotas
    placed = docs.join(small, "_key").withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("_shards")))
    cells = placed.groupBy("_key", "_shard").agg(F.first("_blocks").alias("_blocks"), F.sum("size").alias("_words"))
    cells = sainte_lague(cells, ["_key"], "_shard", "_words", "_blocks").select("_key", "_shard", "quota", "_words")
    stream = Window.partitionBy("_key", "_shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), "doc_id", "size")
    out = placed.withColumn("_b", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0))).join(cells, ["_key", "_shard"])
    out = out.withColumn("_a", F.col("_b") - F.col("size")).withColumn("_nb", F.greatest(F.lit(1), F.ceil(F.col("_words") / block)))
    out = out.withColumn("_k", F.least("quota", most * F.col("_nb")))
    out = out.withColumns({"rounds": F.expr("_k div _nb"), "_r": F.expr("_k % _nb"), "_s": F.pmod(F.xxhash64(F.lit(seed + 2), "_key", "_shard"), F.col("_nb"))})
    # the run: words [from, to) of the stream and, around its end, [0, wrap)
    out = out.withColumns(
        {
            "_from": F.col("_s") * block,
            "_to": F.least(F.col("_words"), F.least("_nb", F.col("_s") + F.col("_r")) * block),
            "_wrap": F.greatest(F.lit(0), F.col("_s") + F.col("_r") - F.col("_nb")) * block,
        }
    )
    within = lambda c: F.least(F.greatest(F.col(c) - F.col("_a"), F.lit(0)), F.col("size"))
    out = out.withColumns({"cut_from": within("_from"), "cut_to": within("_to"), "wrap_to": within("_wrap")})
    taken = F.col("rounds") * F.col("size") + F.col("cut_to") - F.col("cut_from") + F.col("wrap_to")
    return out.withColumn("taken", taken.cast("long")).select("_all.*", *outputs)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    return mix(materialize(docs, "sizes")).select("doc_id", "source", "size", "source_size", "target", "taken")

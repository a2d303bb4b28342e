"""Operator 4 [native]: quality rules and a hashed n-gram log-likelihood ratio.

Two multinomials over ``BUCKETS`` hashed unigrams and bigrams are fitted: *target* on trusted documents
(labelled quality 1; at most ``trusted_most`` of them, those with the smallest seeded hash) and *raw* on
every document of the corpus.  A document's score is the mean over its n-grams of
log(target / raw), which is its log-likelihood ratio made independent of its length.  The threshold is fixed before
any document is judged: the middle of the best plateau of (share of bad documents caught) - care *
(share of good ones lost) over a histogram of the labelled documents' scores.  The same threshold then holds for every document.

N-grams are runs of letters and digits or runs of ASCII punctuation, so decorated words share their
decoration's bucket.  The base rules are exact: see ``base_columns``.

Null and empty texts have no words and fail the base rule.  Without trusted documents all scores are 0
and the threshold too: only the base rules decide.  Null labels are ignored; repeated rows are judged
alike; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.llm.common import WORD_RE, table, words

BUCKETS = 8192
BINS = 2000
_TOKEN = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]+"


def base_columns(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("_w", words(F.col("text")))
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
            "_lines": F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))),
            "_h": F.transform("_w", lambda w: F.xxhash64(w)),
        }
    ).drop("_w")
    window = "transform(sequence(0, n_words - 5), i -> xxhash64(_h[i], _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4]))"
    out = out.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_g": F.when(F.col("n_words") > 5, F.expr(window.replace("n_words - 5", "cast(n_words - 5 as int)"))),
        }
    ).drop("_lines", "_h")
    # most texts repeat no window; the others sort their windows with their places
    twice = """
        aggregate(
            array_sort(flatten(transform(sequence(0, size(_s) - 1), k ->
                if((k > 0 and _s[k].h = _s[k - 1].h) or (k < size(_s) - 1 and _s[k].h = _s[k + 1].h), array(_s[k].i), array())))),
            named_struct('n', 0L, 'end', -1),
            (acc, i) -> named_struct('n', acc.n + i + 5 - greatest(i, acc.end), 'end', i + 5),
            acc -> acc.n)
    """
    repeats = F.col("_g").isNotNull() & (F.size(F.array_distinct("_g")) < F.size("_g"))
    out = out.withColumn("_s", F.when(repeats, F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_g")
    out = out.withColumn("n_repeat_words", F.when(F.col("_s").isNotNull(), F.expr(twice)).otherwise(F.lit(0)).cast("long")).drop("_s")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def ngrams(text: Column) -> Column:
    """The hashes of a text's tokens, of which ``_PAIR`` and ``score`` make unigrams and bigrams."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


_PAIR = f"zip_with(_t, slice(_t, 2, greatest(size(_t), 1)), (a, b) -> {{}})"
_UNI, _BI = f"cast(pmod(a, {BUCKETS}) as int)", f"cast(pmod(xxhash64(a, b), {BUCKETS}) as int)"


class QualityModel:
    """log(target / raw) of each bucket, and the threshold on a document's mean."""

    def __init__(self, ratios: list[float], threshold: float):
        self.ratios, self.threshold = ratios, threshold

    def score(self, docs: DataFrame) -> DataFrame:
        """docs(text, ...) with ``score``: the mean log ratio of the text's n-grams (0 without any)."""
        known = any(self.ratios)
        if not known:
            return docs.withColumn("score", F.lit(0.0))
        table_ = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in self.ratios) + "]"), "array<double>")
        out = docs.withColumn("_t", ngrams(F.col("text")))
        size = F.size("_t")
        pairs = F.zip_with("_t", F.slice("_t", 2, F.greatest(size, F.lit(1))), lambda a, b: F.get(table_, F.pmod(a, F.lit(BUCKETS)).cast("int")) + F.get(table_, F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int")))
        total = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)
        return out.withColumn("score", F.when(size > 0, total / (2 * size)).otherwise(F.lit(0.0))).drop("_t")


def fit(docs: DataFrame, labels: DataFrame, trusted_most: int = 50_000, seed: int = 42, smooth: float = 1.0, care: float = 10.0) -> QualityModel:
    """The model of all ``docs`` against those labelled quality 1."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pick = lambda q: known.where(F.col("quality") == q).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(trusted_most)
    sample = F.broadcast(pick(1).union(pick(0)))  # at most 2 * trusted_most rows of two numbers
    texts = docs.select("doc_id", "text")
    flagged = texts.join(sample, "doc_id", "left").select("quality", ngrams(F.col("text")).alias("_t"))
    counts = (
        flagged.select((F.col("quality") == 1).alias("trusted"), F.explode(F.expr(_PAIR.format(f"struct({_UNI} as u, {_BI} as b)"))).alias("g"))
        .select(F.coalesce("trusted", F.lit(False)).alias("trusted"), F.explode(F.array("g.u", "g.b")).alias("bucket"))
        .groupBy("bucket", "trusted")
        .count()
        .groupBy("bucket")
        .agg(F.sum("count").alias("raw"), F.sum(F.when(F.col("trusted"), F.col("count")).otherwise(0)).alias("target"))
    )
    rows = {r["bucket"]: r for r in counts.collect()}  # at most BUCKETS rows
    raw, target = sum(r["raw"] for r in rows.values()), sum(r["target"] for r in rows.values())
    if not target:
        return QualityModel([0.0] * BUCKETS, 0.0)
    ratio = lambda r: math.log((r["target"] + smooth) / (target + smooth * BUCKETS)) - math.log((r["raw"] + smooth) / (raw + smooth * BUCKETS))
    model = QualityModel([round(ratio(rows[b]), 6) if b in rows else 0.0 for b in range(BUCKETS)], 0.0)
    scored = model.score(texts.join(sample, "doc_id"))
    bins = scored.groupBy("quality", F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") * BINS / 4))).alias("bin")).count().collect()
    good, bad = ({r["bin"]: r["count"] for r in bins if r["quality"] == q} for q in (1, 0))
    model.threshold = _plateau(good, bad, care)
    return model


def _plateau(good: dict[int, int], bad: dict[int, int], care: float) -> float:
    """The middle of the widest run of bin edges with the best (share of bad caught) - ``care`` *
    (share of good lost); far below all scores if there is nothing to tell apart."""
    all_good, all_bad = sum(good.values()), sum(bad.values())
    if not all_good or not all_bad:
        return -1e9
    lost = caught = 0
    best, runs = -1.0, []
    for edge in range(-BINS, BINS + 2):
        value = caught / all_bad - care * lost / all_good
        if value > best + 1e-12:
            best, runs = value, [[edge, edge]]
        elif value > best - 1e-12:
            if runs[-1][1] == edge - 1:
                runs[-1][1] = edge
            else:
                runs.append([edge, edge])
        lost += good.get(edge, 0)
        caught += bad.get(edge, 0)
    low, high = max(runs, key=lambda r: r[1] - r[0])
    return (low + high) / 2 * 4 / BINS


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs(text, ...) with the base columns, score and kept.  Further columns are carried, whatever their
    names; those named like a result are replaced."""
    carried = [c for c in docs.columns if c not in RESULTS]
    scored = model.score(base_columns(docs.select(F.struct(*carried).alias("carried_row"), F.col("text").cast("string").alias("text"))))
    judged = scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold)))
    return judged.select("carried_row.*", *RESULTS)


def op4_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    model = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")

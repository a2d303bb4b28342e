"""Operator 8: URL filters by rules and gradient-boosted trees on lexical features.

Rules name a host (with its subdomains) and a path prefix; the longest fitting rule decides.  Other
URLs are judged by gradient-boosted trees over lexical features: lengths, depth, digit ratio, character
entropy, parameter counts and the block rates of the host's suffixes.  The trees are fitted on a
bounded sample (``sample_most`` rows, by seeded hash) of labelled URLs; in the query the labelled URLs
are those that a rule decides.  Every URL is judged.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are judged by their
features.  Without labelled URLs of both kinds everything not ruled is allowed.  Repeated rows are judged alike; other
columns are carried whatever their names, but for those of the results; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.llm.common import materialize, table


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

FEATURES = (
    "url_chars", "host_chars", "path_chars", "query_chars", "depth", "labels", "hyphens", "digit_ratio", "entropy",
    "parameters", "longest_part", "has_fragment", "secure", "suffix1_rate", "suffix2_rate", "folder_rate",
)


def split_url(url: Column) -> dict[str, Column]:
    """host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))}


def apply_rules(urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """urls(host, path, ...) with rule and ruled, the longest fitting rule and its verdict (else null)."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, ruled = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(ruled)
    return urls.withColumns({"rule": rule, "ruled": ruled})


def lexical(urls: DataFrame) -> DataFrame:
    """urls(url, host, path, ...) with the features that need no labels, and the suffixes."""
    u = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    entropy = F.expr(
        "aggregate(array_distinct(split(coalesce(url, ''), '')), 0D, (acc, c) -> acc + if(c = '', 0D, "
        "(length(url) - length(replace(url, c, ''))) / length(url) * -ln((length(url) - length(replace(url, c, ''))) / length(url))))"
    )
    labels = F.split("host", r"\.")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return urls.withColumns(
        {
            "url_chars": F.length(u),
            "host_chars": F.length("host"),
            "path_chars": F.length("path"),
            "query_chars": F.length(query),
            "depth": F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))),
            "labels": F.size(labels),
            "hyphens": F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit(""))),
            "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n,
            "entropy": F.coalesce(entropy, F.lit(0.0)),
            "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
            "longest_part": F.array_max(F.transform(F.split(u, "[/.?&=#-]"), lambda p: F.length(p))),
            "has_fragment": F.instr(u, "#").cast("boolean").cast("int"),
            "secure": u.startswith("https").cast("int"),
            "suffix1": F.element_at(labels, -1),
            "suffix2": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."),
            "folder": F.substring_index(F.substring_index("path", "/", 2), "/", -1),
        }
    )


class UrlModel:
    """Trees and the suffix rates that they were fitted with."""

    def __init__(self, trees, rates: dict[str, dict[str, float]], prior: float):
        self.trees, self.rates, self.prior = trees, rates, prior

    def features(self, urls: DataFrame) -> DataFrame:
        for key, rates in self.rates.items():
            if rates:  # at most one entry for each sampled row
                lookup = F.from_json(F.lit(_json(rates)), "map<string,double>")
                rate = F.try_element_at(lookup, F.col(key))
            else:
                rate = F.lit(None).cast("double")
            urls = urls.withColumn(f"{key}_rate", F.coalesce(rate, F.lit(self.prior)))
        return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(urls)

    def block_probability(self, urls: DataFrame) -> DataFrame:
        """urls (with lexical features) and ``p_block``."""
        if self.trees is None:
            return urls.withColumn("p_block", F.lit(0.0))
        out = self.trees.transform(self.features(urls))
        return out.withColumn("p_block", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "_prediction")


def _json(rates: dict[str, float]) -> str:
    import json

    return json.dumps(rates)


def fit(labelled: DataFrame, sample_most: int = 20_000, keys_most: int = 200, seed: int = 42, rounds: int = 12, depth: int = 3) -> UrlModel:
    """labelled(url, host, path, ..., blocked 0.0 or 1.0, lexical features) -> model.

    Suffix rates are smoothed block rates of the ``keys_most`` most frequent suffixes of the sample."""
    sample = labelled.orderBy(F.xxhash64(F.lit(seed), "url"), "url").limit(sample_most)
    sample = materialize(sample.coalesce(1), "urls")
    n, blocked = sample.agg(F.count("*"), F.sum("blocked")).first()
    prior = (blocked or 0.0) / n if n else 0.0
    rates = {}
    for key in ("suffix1", "suffix2", "folder"):
        rows = sample.groupBy(key).agg(F.count("*").alias("n"), F.sum("blocked").alias("b")).orderBy(F.desc("n"), key).limit(keys_most).collect()
        rates[key] = {r[key]: round((r["b"] + 5 * prior) / (r["n"] + 5), 6) for r in rows}
    model = UrlModel(None, rates, prior)
    if n and 0 < blocked < n:
        trees = GBTClassifier(featuresCol="_features", labelCol="blocked", predictionCol="_prediction", maxIter=rounds, maxDepth=depth, seed=seed, checkpointInterval=-1)
        model.trees = trees.fit(model.features(sample))
    return model


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, **fitting) -> DataFrame:
    """pages(url, ...) with host, path, rule, verdict and p_block, which replace columns of these names."""
    results = ["host", "path", "rule", "verdict", "p_block"]
    own = [c for c in pages.columns if c.lower() not in results]
    urls = pages.select("url", F.struct(*(F.col(f"`{c}`") for c in own)).alias("_page"))
    urls = apply_rules(urls.withColumns(split_url(F.col("url"))), rules)
    labelled = urls.where("ruled is not null").select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("blocked"))
    model = fit(lexical(labelled), **fitting)
    out = model.block_probability(lexical(urls))
    verdict = F.coalesce("ruled", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).select(*(F.col("_page")[c].alias(c) for c in own), *results)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")

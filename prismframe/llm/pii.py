"""Operator 5 [native]: personal data by bootstrapped contextual extraction.

Seeds are the exact base entities (email, ip, card, phone).  Phrases of words with digits or ``@`` are candidate
instances; each occurrence carries lexical patterns: its shape, and its contexts (the word before, the two words before, the word
after, the words on both sides; neighbouring words are taken whole, missing ones make no pattern).  Instances and patterns form a graph that
Spark scores for ``rounds`` rounds.

A context counts for a kind once ``support`` positive instances stand in it and make up ``share`` of its distinct instances.  Its confidence is
their weight over that weight, its known negatives and one; instances without a label are no negatives as such.  Known negatives are positives
of other kinds and unlabelled instances of a cold shape, one that more often than not stands outside all contexts that count.  A shape's confidence is
the positive weight over all its instances and one.  An instance's weight is the largest of its shape's confidence, of its two-sided context's,
and of the noisy-or of its best left and its right context.  Unseen instances of shapes that are not cold and of weight ``accept`` or above join
the positives of the next round.  In the end all their occurrences that touch no base span are added as spans of that kind.

Offsets are code points, end exclusive.  Null texts are empty.  A text is identified by (doc_id, hash of the text), so
repeated rows get the same spans; null ids work alike.  An empty table gives no rows.  Other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")
#: Sides of patterns.
SHAPE, LEFT, RIGHT, BOTH = range(4)
_WS = r"\x20\x09-\x0D"
# The contracts' patterns, with possessive repeats and look-behinds that change no match but keep the
# search linear and free of recursion.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PHRASE = rf"(?<![^{_WS}])[^{_WS}0-9@]*+[0-9@][^{_WS}]*+(?:\x20[^{_WS}0-9@]*+[0-9@][^{_WS}]*+)*+"
_WORD = rf"[^{_WS}]++"
_LAST = rf"(?<![^{_WS}])({_WORD})[{_WS}]*+\z"
_LAST_BUT_ONE = rf"(?<![^{_WS}])({_WORD})[{_WS}]++{_WORD}[{_WS}]*+\z"
_FIRST = rf"^[{_WS}]*+({_WORD})"
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[1-9]|)"
_SPANS = "array<struct<s:int,e:int,m:string>>"


#: Matches of a text that are placed one after another; longer lists are placed in runs of so many, each from its own start.
_RUN = 256


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for the value, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _matches(pattern: str) -> str:
    """SQL for the (start, end, match) of the leftmost non-overlapping matches in column ``text``: the
    gaps between matches come from ``split``, the matches from ``regexp_extract_all``; places are running sums, taken in runs, so the
    cost grows in proportion to the matches."""
    pieces = f"filter(zip_with(split(text, r'{pattern}'), regexp_extract_all(text, r'{pattern}', 0), (g, m) -> named_struct('g', length(g), 'n', length(m), 'm', m)), x -> x.m is not null)"
    runs = _let("z", pieces, f"transform(sequence(0, greatest(size(z) - 1, 0) div {_RUN}), k -> slice(z, k * {_RUN} + 1, {_RUN}))")
    lengths = "transform(rs, r -> aggregate(r, 0, (acc, x) -> acc + x.g + x.n))"
    starts = _let("ls", lengths, "transform(sequence(0, size(ls) - 1), k -> aggregate(slice(ls, 1, k), 0, (acc, x) -> acc + x))")
    placed = f"""aggregate(r, named_struct('at', at0, 'out', cast(array() as {_SPANS})), (acc, x) -> named_struct(
        'at', acc.at + x.g + x.n, 'out', concat(acc.out, array(named_struct('s', acc.at + x.g, 'e', acc.at + x.g + x.n, 'm', x.m)))), acc -> acc.out)"""
    return _let("rs", runs, f"flatten(zip_with(rs, {starts}, (r, at0) -> {placed}))")


def _base(kind: int, guard: str, pattern: str, test: str) -> str:
    return f"if({guard}, transform(filter({_matches(pattern)}, y -> {test}), y -> named_struct('k', {kind}, 's', y.s, 'e', y.e)), array())"


def _scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, h, spans, phrases): only texts with digits or @ are searched."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumns({"h": F.xxhash64("text"), "_at": F.contains("text", F.lit("@")), "_digit": F.rlike("text", F.lit("[0-9]"))})
    card = "regexp_replace(y.m, '[ -]', '')"
    spans = ", ".join(
        (
            _base(0, "_at", _EMAIL, "true"),
            _base(1, "_digit", _IP, rf"rlike(y.m, r'^{_OCTET}(?:\.{_OCTET}){{3}}$')"),
            _base(2, "_digit", _CARD, f"length({card}) between 13 and 19 and luhn_check({card})"),
            _base(3, "_digit", _PHONE, "length(regexp_replace(y.m, '[^0-9]', '')) between 9 and 15"),
        )
    )
    phrases = F.expr(f"if(_at or _digit, {_matches(_PHRASE)}, cast(array() as {_SPANS}))")
    # what is before a phrase, as far back as two words can lie, and what is after it: gaps and other phrases, whole
    before = "concat_ws('', get(_m, i - 2).m, get(_g, i - 1), get(_m, i - 1).m, get(_g, i))"
    after = "concat_ws('', get(_g, i + 1), get(_m, i + 1).m)"
    return (
        out.withColumn("spans", F.expr(f"cast(concat({spans}) as array<struct<k:int,s:int,e:int>>)"))
        .withColumns({"_m": phrases, "_g": F.expr(f"if(_at or _digit, split(text, r'{_PHRASE}'), array(''))")})
        .withColumn(
            "phrases",
            F.expr(rf"""transform(_m, (x, i) -> named_struct(
                's', x.s + length(regexp_extract(x.m, r'^[^A-Za-z0-9+@]*', 0)),
                'core', regexp_replace(x.m, r'^[^A-Za-z0-9+@]*+|(?<![^A-Za-z0-9])(?=[^A-Za-z0-9]*+$)[^A-Za-z0-9]++$|(?<=[A-Za-z0-9])[^A-Za-z0-9]++$', ''),
                'l1', lower(regexp_extract({before}, r'{_LAST}', 1)),
                'l2', lower(regexp_extract({before}, r'{_LAST_BUT_ONE}', 1)),
                'r1', lower(regexp_extract({after}, r'{_FIRST}', 1))))"""),
        )
        .select("doc_id", "h", "spans", "phrases")
    )


def _occurrences(scan: DataFrame) -> DataFrame:
    """One row for each phrase: where it is, its instance, its patterns, the kind of the base span that it is."""
    # phrases go out in runs that carry only the spans near them
    runs = f"""transform(sequence(0, (size(phrases) - 1) div {_RUN}), k -> {_let("r", f"slice(phrases, k * {_RUN} + 1, {_RUN})",
        "named_struct('p', r, 'near', filter(spans, x -> x.s < element_at(r, -1).s + length(element_at(r, -1).core) and x.e > r[0].s))")})"""
    one = scan.where("size(phrases) > 0").select("doc_id", "h", F.explode(F.expr(runs)).alias("r"))
    one = one.select("doc_id", "h", F.col("r.near").alias("spans"), F.explode("r.p").alias("p"))
    one = one.select("doc_id", "h", "spans", F.col("p.s").alias("s"), F.expr("p.s + length(p.core)").alias("e"), F.lower("p.core").alias("core"), "p.l1", "p.l2", "p.r1")
    shape = F.regexp_replace(F.regexp_replace("core", "[0-9]", "9"), r"[a-z\x{80}-\x{10FFFF}]+", "a")
    one = one.withColumn("shape", shape)
    there = lambda *words: reduce(lambda a, b: a & b, [F.col(w) != "" for w in words])
    found = ((SHAPE, F.lit(True), ["shape"]), (LEFT, there("l1"), ["l1"]), (LEFT, there("l1", "l2"), ["l1", "l2"]), (RIGHT, there("r1"), ["r1"]), (BOTH, there("l1", "r1"), ["l1", "r1"]))
    patterns = F.filter(F.array(*(F.when(on, F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(side), F.lit(len(of)), *of).alias("pattern"))) for side, on, of in found)), lambda x: x.isNotNull())
    seed = F.expr("try_element_at(filter(spans, x -> x.s = s and x.e = e), 1).k")
    touched = F.expr("exists(spans, x -> x.s < e and x.e > s)")
    return one.select("doc_id", "h", "s", "e", F.xxhash64("core").alias("instance"), F.xxhash64("shape").alias("shape"), patterns.alias("patterns"), seed.alias("kind"), touched.alias("touched"))


def bootstrap(occurrences: DataFrame, rounds: int = 3, support: int = 3, accept: float = 0.9, share: float = 0.2) -> DataFrame:
    """occurrences -> (instance, kind) of the unseen instances that were accepted."""
    edges = materialize(occurrences.select("instance", "shape", F.explode("patterns").alias("p")).select("instance", "shape", "p.side", "p.pattern").distinct(), "edges")
    sizes = materialize(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support), "sizes")
    # each instance has one pattern of its shape alone
    shapes = edges.where(F.col("side") == SHAPE).groupBy("shape").agg(F.count("*").alias("of_shape"))
    seeds = occurrences.where("kind is not null").select("instance", "kind").distinct().withColumn("weight", F.lit(1.0))
    positive = seeds = materialize(seeds, "seeds")
    for _ in range(rounds):
        counted = edges.join(positive, "instance").groupBy("pattern", "side", "kind").agg(F.sum("weight").alias("p")).where(F.col("p") >= support).join(sizes, "pattern")
        counted = materialize(counted.where((F.col("side") == SHAPE) | (F.col("p") >= share * F.col("n"))), "counted")
        warm = edges.where(F.col("side") != SHAPE).join(counted.select("pattern").distinct(), "pattern", "left_semi")
        hot = warm.select("instance", "shape").distinct().groupBy("shape").agg(F.count("*").alias("hot"))
        cold = materialize(shapes.join(hot, "shape", "left").where(2 * F.coalesce("hot", F.lit(0)) < F.col("of_shape")).select("shape", F.lit(True).alias("cold")), "cold")
        told = warm.join(positive, "instance", "left").join(cold, "shape", "left")
        told = told.groupBy("pattern").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("positives"), F.count_if(F.col("kind").isNull() & F.coalesce("cold", F.lit(False))).alias("negatives"))
        against = F.greatest(F.col("positives") - F.col("p"), F.lit(0.0)) + F.col("negatives")
        c = F.when(F.col("side") == SHAPE, F.col("p") / (F.col("n") + 1)).otherwise(F.col("p") / (F.col("p") + against + 1))
        confident = counted.join(told, "pattern", "left").select("pattern", "kind", c.alias("c")).where("c >= 0.5")
        best = lambda side: F.max(F.when(F.col("side") == side, F.col("c")).otherwise(0.0))
        weight = F.greatest(best(SHAPE), best(BOTH), 1 - (1 - best(LEFT)) * (1 - best(RIGHT)))
        weighed = edges.join(confident, "pattern").groupBy("instance", "shape", "kind").agg(weight.alias("weight")).where(F.col("weight") >= accept)
        new = weighed.join(cold, "shape", "left_anti").join(seeds.select("instance").distinct(), "instance", "left_anti").select("instance", "kind", "weight")
        positive = materialize(seeds.unionByName(new), "positive")
    found = positive.join(seeds.select("instance").distinct(), "instance", "left_anti")
    return found.groupBy("instance").agg(F.max_by("kind", F.struct("weight", -F.col("kind"))).alias("kind"))


def find_pii(documents: DataFrame, rounds: int = 3, support: int = 3, accept: float = 0.9) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, h, spans, more): base spans and added spans, each an array of (k, s, e)
    in order of kind and start; ``h`` is the hash of the text.  One row for each row of documents."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = materialize(_scan(docs), "scan")
    occurrences = materialize(_occurrences(scan), "occurrences")
    accepted = bootstrap(occurrences, rounds, support, accept)
    more = (
        occurrences.where("not touched").drop("kind").join(accepted, "instance")
        .groupBy("doc_id", "h")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("kind").alias("k"), "s", "e"))).alias("more"))
    )
    same = scan["doc_id"].eqNullSafe(more["doc_id"]) & (scan["h"] == more["h"])
    return scan.join(more, same, "left").select(scan["doc_id"], scan["h"], "spans", F.coalesce("more", F.expr("cast(array() as array<struct<k:int,s:int,e:int>>)")).alias("more"))


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    step = lambda acc, x: F.when(x["e"] <= acc["at"], acc).otherwise(
        F.struct(
            x["e"].alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), F.when(x["s"] >= acc["at"], F.get(labels, x["k"])).otherwise("")).alias("out"),
        )
    )
    done = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, done)).otherwise(text)


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.k = {i})) as long)").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    every = F.array_sort(F.array_union("spans", "more"))
    return found.select("doc_id", *counts, F.sha2(_written(F.col("spans")), 256).alias("base_sha256"), _written(every).alias("spans"), F.size("more").cast("long").alias("n_added"))

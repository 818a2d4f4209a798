"""Quality rules whose thresholds come from quantile sketches per language and source.

A sketch is a table of counts per logarithmic bucket (relative error 1 %), so
sketches merge by adding counts: the groups' sketches give those of each
language and of the corpus without a second pass over the texts. A rule's
threshold in a group is a fence beyond the upper or lower quartile, its width
taken from the same sketch. Thresholds of small groups say little, so each is
averaged with its language's, and a language's with the corpus's, with weights
that follow the number of documents: a group of ``prior`` documents counts for
half. The thresholds are then joined to the documents and filter them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialise
from .text_stats import bound, counts, counts_sql

GAMMA = 1.02
PRIOR = 200
FENCE = 3.0
#: rule -> (side of the fence, least width of the interquartile range in natural log units)
RULES: dict[str, tuple[str, float]] = {
    "symbol_rate": ("high", 0.5),
    "upper_rate": ("high", 0.25),
    "repetition": ("high", 0.10),
    "word_length_high": ("high", 0.06),
    "word_length_low": ("low", 0.06),
}
ALL = "*"


def _statistics(c: Column) -> Column:
    """Positive statistics; the constants pull short texts, which say little, towards common values.

    The rates have a floor, so all texts without symbols (capitals) are alike, however long.
    """
    length = (c["chars"] + 250) / (c["words"] + 40)
    return F.struct(
        (c["symbols"] / (c["chars"] + 100) + 0.015).alias("symbol_rate"),
        (c["uppers"] / (c["chars"] + 100) + 0.02).alias("upper_rate"),
        (F.pow(c["words"] + 20, F.lit(0.85)) / (c["distinct_words"] + 20)).alias("repetition"),
        length.alias("word_length_high"),
        length.alias("word_length_low"),
    )


def statistics(text: Column) -> Column:
    return bound(counts(text), _statistics)


def bucket(value: Column) -> Column:
    """Index of the logarithmic bucket; the 9 decimals make engines agree at bucket borders."""
    return F.floor(F.round(F.log(value) / F.lit(math.log(GAMMA)), 9)).cast("int")


def sketches(buckets: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n) from rows of (lang, source, b: a struct of a bucket per rule).

    Counting by bucket combines on the map side: what is shuffled follows the number of groups and buckets.
    """
    items = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col("b")[r].alias("bucket")) for r in RULES]))
    return buckets.select("lang", "source", items.alias("x")).groupBy("lang", "source", "x.rule", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame) -> DataFrame:
    """The groups' sketches with those of each language (source ``*``) and of the corpus (both ``*``)."""
    at = lambda lang, source: sketch.groupBy(lang.alias("lang"), source.alias("source"), "rule", "bucket").agg(F.sum("n").alias("n"))
    star = F.lit(ALL)
    return sketch.select("lang", "source", "rule", "bucket", "n").unionByName(at(F.col("lang"), star)).unionByName(at(star, star))


def thresholds(sketch: DataFrame, fence: float = FENCE) -> DataFrame:
    """(lang, source, n, rule, cut): the fence of each rule at each level, in buckets."""
    g = W.partitionBy("lang", "source", "rule")
    ranked = merged(sketch).select("*", F.sum("n").over(g.orderBy("bucket")).alias("upto"), F.sum("n").over(g).alias("total"))
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), F.col("bucket")))
    q = ranked.groupBy("lang", "source", "rule").agg(F.max("total").alias("n"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    unit = math.log(GAMMA)
    least = F.create_map(*[x for r, (_, w) in RULES.items() for x in (F.lit(r), F.lit(w / unit))])
    width = F.greatest((F.col("q3") - F.col("q1")).cast("double"), least[F.col("rule")])
    high = F.col("rule").isin(*[r for r, (side, _) in RULES.items() if side == "high"])
    return q.select("lang", "source", "n", "rule", F.when(high, F.col("q3") + fence * width).otherwise(F.col("q1") - fence * width).alias("cut"))


def _group_cuts(sketch: DataFrame, fence: float, prior: float) -> DataFrame:
    """One row per (lang, source): a cut per rule, its own averaged with its language's, and that with the corpus's."""
    cuts = thresholds(sketch, fence).groupBy("lang", "source").agg(F.max("n").cast("double").alias("n"), *[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(r) for r in RULES])
    at = lambda lang, source: cuts.where((F.col("lang") == ALL if lang else F.col("lang") != ALL) & (F.col("source") == ALL if source else F.col("source") != ALL))
    own = at(False, False).select("lang", "source", F.struct("n", *RULES).alias("own"))
    wide = at(False, True).select("lang", F.struct("n", *RULES).alias("wide"))
    corpus = at(True, True).select(F.struct("n", *RULES).alias("corpus"))
    mean = lambda level, r, above: (F.col(level)["n"] * F.col(level)[r] + prior * above) / (F.col(level)["n"] + prior)
    level = F.struct(*[mean("own", r, mean("wide", r, F.col("corpus")[r])).alias(r) for r in RULES])
    return own.join(wide, "lang").crossJoin(F.broadcast(corpus)).select("lang", "source", level.alias("cut"))


def _group(c: str) -> Column:
    """Group name with a mark in front, so that no value can be mistaken for ``*`` and null is a group of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def _passes(b: Column, cut: Column) -> Column:
    ok = F.lit(True)
    for r, (side, _) in RULES.items():
        ok = ok & ((b[r] <= cut[r]) if side == "high" else (b[r] >= cut[r]))
    return ok


def _failed(b: Column, cut: Column) -> Column:
    bad = [F.when((b[r] > cut[r]) if side == "high" else (b[r] < cut[r]), F.lit(r)) for r, (side, _) in RULES.items()]
    return F.concat_ws(",", *bad)


def _bucketed(docs: DataFrame, keep: list[Column], text: str, lang: str, source: str) -> DataFrame:
    as_buckets = lambda s: F.struct(*[bucket(s[r]).alias(r) for r in RULES])
    return docs.select(*keep, _group(lang).alias("lang"), _group(source).alias("source"), bound(statistics(F.col(text)), as_buckets).alias("b"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", fence: float = FENCE, prior: float = PRIOR) -> DataFrame:
    """One row per document: ``doc_id``, ``keep`` and ``failed`` (rules broken, comma-separated, '' if none).

    Null languages and sources are groups of their own; a null text counts as
    ''. A text at a threshold passes. Repeated rows each count in the sketches,
    are judged alike and are all returned; a null id is an id. Texts are
    measured whole. Extra columns are not read, whatever their names; an empty
    table gives an empty result.
    """
    rows = materialise(_bucketed(docs, [F.col(doc_id).alias("__doc")], text, lang, source), "rules")
    cuts = materialise(_group_cuts(materialise(sketches(rows), "rule-sketches"), fence, prior), "rule-cuts")
    joined = rows.join(cuts, ["lang", "source"])
    return joined.select(F.col("__doc").alias(doc_id), _passes(F.col("b"), F.col("cut")).alias("keep"), _failed(F.col("b"), F.col("cut")).alias("failed"))


def keep_passing(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", fence: float = FENCE, prior: float = PRIOR) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns as they are, whatever their names.

    Null, empty and very long texts, ties, repeated rows and empty tables are treated as there.
    """
    sketch = materialise(sketches(_bucketed(docs, [], text, lang, source)), "rule-sketches")
    cuts = materialise(_group_cuts(sketch, fence, prior), "rule-cuts")
    as_buckets = lambda s: F.struct(*[bucket(s[r]).alias(r) for r in RULES])
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), _group(lang).alias("lang"), _group(source).alias("source"))
    joined = rows.join(cuts, ["lang", "source"])
    passing = bound(F.struct(bound(statistics(F.col("text")), as_buckets).alias("b"), F.col("cut").alias("cut")), lambda x: _passes(x["b"], x["cut"]))
    return joined.where(passing).select("row.*")


def judge_sql(table: str = "documents", fence: float = FENCE, prior: float = PRIOR) -> str:
    """DuckDB SQL for the rows of :func:`judge`."""
    unit = math.log(GAMMA)
    value = {
        "symbol_rate": "symbols / (chars + 100) + 0.015::DOUBLE",
        "upper_rate": "uppers / (chars + 100) + 0.02::DOUBLE",
        "repetition": "pow(words + 20, 0.85) / (distinct_words + 20)",
        "word_length_high": "(chars + 250) / (words + 40)",
        "word_length_low": "(chars + 250) / (words + 40)",
    }
    buckets = ", ".join(f"floor(round(ln({v}) / {unit!r}, 9))::INTEGER AS {r}" for r, v in value.items())
    items = " UNION ALL ".join(f"SELECT g_lang, g_source, '{r}' AS rule, {r} AS bucket FROM b" for r in RULES)
    least = "CASE rule " + " ".join(f"WHEN '{r}' THEN {w / unit!r}::DOUBLE" for r, (_, w) in RULES.items()) + " END"
    high = ", ".join(f"'{r}'" for r, (side, _) in RULES.items() if side == "high")
    wide = ", ".join(f"max(CASE WHEN rule = '{r}' THEN cut END) AS {r}" for r in RULES)
    mean = lambda level, r, above: f"({level}.n * {level}.{r} + {float(prior)!r}::DOUBLE * {above}) / ({level}.n + {float(prior)!r}::DOUBLE)"
    chosen = ", ".join(f"{mean('o', r, mean('w', r, f'a.{r}'))} AS c_{r}" for r in RULES)
    broken = ", ".join(f"CASE WHEN {r} {'>' if side == 'high' else '<'} c_{r} THEN '{r}' END" for r, (side, _) in RULES.items())
    return f"""WITH c AS (SELECT doc_id, coalesce('=' || lang, 'null') AS g_lang, coalesce('=' || source, 'null') AS g_source,
       {counts_sql()} FROM {table}),
b AS (SELECT doc_id, g_lang, g_source, {buckets} FROM c),
s AS (SELECT g_lang, g_source, rule, bucket, count(*) AS n FROM ({items}) GROUP BY ALL),
m AS (SELECT * FROM s UNION ALL SELECT g_lang, '*', rule, bucket, sum(n) FROM s GROUP BY ALL
      UNION ALL SELECT '*', '*', rule, bucket, sum(n) FROM s GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY g_lang, g_source, rule ORDER BY bucket) AS upto,
             sum(n) OVER (PARTITION BY g_lang, g_source, rule) AS total FROM m),
q AS (SELECT g_lang, g_source, rule, max(total) AS n, min(CASE WHEN upto >= 0.25 * total THEN bucket END) AS q1,
             min(CASE WHEN upto >= 0.75 * total THEN bucket END) AS q3 FROM r GROUP BY ALL),
t AS (SELECT g_lang, g_source, n, rule, CASE WHEN rule IN ({high}) THEN q3 + {fence!r}::DOUBLE * greatest((q3 - q1)::DOUBLE, {least})
             ELSE q1 - {fence!r}::DOUBLE * greatest((q3 - q1)::DOUBLE, {least}) END AS cut FROM q),
p AS (SELECT g_lang, g_source, max(n)::DOUBLE AS n, {wide} FROM t GROUP BY g_lang, g_source),
l AS (SELECT o.g_lang, o.g_source, {chosen} FROM p o
      JOIN p w ON w.g_lang = o.g_lang AND w.g_source = '*' JOIN p a ON a.g_lang = '*' AND a.g_source = '*'
      WHERE o.g_lang <> '*' AND o.g_source <> '*'),
f AS (SELECT b.doc_id, concat_ws(',', {broken}) AS failed FROM b JOIN l USING (g_lang, g_source))
SELECT doc_id, failed = '' AS keep, failed FROM f"""

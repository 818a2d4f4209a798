"""Per-document statistics as plain column expressions, shared by the quality operators.

Every statistic is a function of the row alone and runs inside the JVM. Words
are maximal runs without space, tab or line breaks. A null text counts as ''.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOL_CLASS = r"[*#%&$!|{}<>=~^@\\]+"

COUNTS = ("chars", "words", "distinct_words", "symbols", "uppers", "digits")


def _without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it and wherever the optimizer moves it."""
    return F.transform(F.array(value), use)[0]


def counts(text: Column) -> Column:
    """Struct of COUNTS as doubles; ``distinct_words`` compares words as written."""
    flat = F.coalesce(text, F.lit(""))
    for blank in "\n\r\t":
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    words = bound(F.array_remove(F.split(flat, " "), ""), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))
    chars = bound(
        F.coalesce(text, F.lit("")),
        lambda t: F.struct(
            F.char_length(t).alias("chars"),
            _without(t, SYMBOL_CLASS).alias("symbols"),
            _without(t, r"\p{Lu}+").alias("uppers"),
            _without(t, "[0-9]+").alias("digits"),
        ),
    )

    def both(x: Column) -> Column:
        n = x["c"]["chars"]
        return F.struct(
            n.cast("double").alias("chars"),
            x["w"]["all"].cast("double").alias("words"),
            x["w"]["distinct"].cast("double").alias("distinct_words"),
            *[(n - x["c"][k]).cast("double").alias(k) for k in ("symbols", "uppers", "digits")],
        )

    return bound(F.struct(words.alias("w"), chars.alias("c")), both)


def counts_sql(text: str = "text") -> str:
    """DuckDB select items for the same counts."""
    t = f"coalesce({text}, '')"
    flat = f"replace(replace(replace({t}, chr(10), ' '), chr(13), ' '), chr(9), ' ')"
    words = f"list_filter(string_split({flat}, ' '), lambda w: w <> '')"
    cut = lambda p: f"(length({t}) - length(regexp_replace({t}, '{p}', '', 'g')))::DOUBLE"
    return f"""length({t})::DOUBLE AS chars, len({words})::DOUBLE AS words,
       len(list_distinct({words}))::DOUBLE AS distinct_words, {cut(SYMBOL_CLASS)} AS symbols,
       {cut(chr(92) + "p{Lu}+")} AS uppers, {cut("[0-9]+")} AS digits"""

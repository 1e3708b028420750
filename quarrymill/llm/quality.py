"""Quality rules: a table of thresholds compiled into one projection over the text, without user functions or shuffles.

Measures of one text are taken with array functions inside the row. Repeated word windows are found by sorting the
hashes of the windows with their positions, so a text of n words takes n log n steps.

Defined results: a null text has no words and fails; all other columns pass as they are; repeated rows count each time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it that for was on with as by at from or an be this are not he she they you we have has "
    "der die das und ist in den von zu mit auf für des im dem nicht ein eine als auch es an wird sich aus bei sie er "
    "le la les de des et en un une du que qui dans pour sur pas par est au avec ce il elle plus ne se "
    "el los las del y que es por con para una su al lo como más o pero sus"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Keeps a row if low <= measure <= high; a bound that is None isn't tested."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The verdict for texts that pass the base rules.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 1.5, 25.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.005, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("longest_word_chars", None, 5000),
)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + x)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base measures n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and those of the rules.

    Each step is a column of its own, so that later ones reuse it.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACES), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_replace(x, SPACES, "") != "")
    out = df.withColumns({"_words": words, "_lines": lines})
    n = F.size("_words")
    windows = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2)).alias("h"), i.alias("at"))),
    ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.regexp_replace(t, SPACES, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_lines": F.size("_lines"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "longest_word_chars": F.coalesce(F.array_max(F.transform("_words", lambda w: F.length(w))), F.lit(0)).cast("long"),
            "_sorted": F.sort_array(windows),
        }
    )
    m = F.size("_sorted")
    hash_at = lambda i: F.get("_sorted", i)["h"]
    twice = F.filter("_sorted", lambda x, i: (hash_at(i - 1) == x["h"]) | (hash_at(i + 1) == x["h"]))
    out = out.withColumn("_at", F.when(m > 1, F.sort_array(F.transform(twice, lambda x: x["at"]))).otherwise(F.array().cast("array<int>")))
    # a window covers three words, or as many as there are up to the next repeated window
    covered = _sum(F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3))).cast("long")))
    out = out.withColumn("n_repeat_words", covered)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = out.withColumns({"mean_word_chars": share("word_chars", "n_words"), "symbol_ratio": share("n_symbols", "n_words"), "stop_word_ratio": share("n_stop_words", "n_words"), "dup_line_ratio": share("n_dup_lines", "_n_lines")})
    return out.drop("_words", "_lines", "_n_lines", "_sorted", "_at")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules of the table as one boolean column."""
    kept = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            kept = kept & (F.col(rule.measure) >= rule.low)
        if rule.high is not None:
            kept = kept & (F.col(rule.measure) <= rule.high)
    return kept


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the base measures, base_failed, kept, and the measures of the rules."""
    out = measures(docs.select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & verdict(rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "n_stop_words", "longest_word_chars")

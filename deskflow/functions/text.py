"""Text features as column expressions (#28-#35).

All functions take and return ``Column``s built from Spark's own functions, so
no Python runs per row. Keyword counts are higher-order functions over literal
lists, which Spark evaluates outside generated code; a sum of one ``contains``
per keyword, inside it, was measured slower.
Null text is treated as the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .formatting import let

# FIXED VALUE: the characters Python's ``str.split()`` / ``str.strip()`` treat as
# white space, as one regex class valid in Java and RE2 alike.
WS_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_or_empty(col) -> Column:
    return F.coalesce(_c(col), F.lit(""))


def lower_text(col) -> Column:
    return F.lower(text_or_empty(col))


def clean_text(col) -> Column:
    """#28: lower case, every run of non a-z characters -> one space, trimmed."""
    return F.trim(F.regexp_replace(lower_text(col), "[^a-z]+", " "))


def strip_ws(col) -> Column:
    """Python-style ``strip()``: remove leading/trailing Unicode white space."""
    return F.regexp_replace(text_or_empty(col), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def words(col) -> Column:
    """Python-style ``split()``: maximal runs of non white space."""
    return F.filter(F.split(text_or_empty(col), f"{WS_CLASS}+"), lambda w: w != "")


def text_length(col) -> Column:
    return F.length(text_or_empty(col))


def word_count(col) -> Column:
    return F.size(words(col))


def avg_word_length(col) -> Column:
    """Mean word length; 0.0 when there are no words.

    The total length of all words is the count of non-white-space characters,
    so no per-word aggregate is needed.
    """
    n = word_count(col)
    letters = F.length(F.regexp_replace(text_or_empty(col), WS_CLASS, ""))
    return F.when(n > 0, letters.cast("double") / n).otherwise(F.lit(0.0))


def has_question(col) -> Column:
    return F.when(F.instr(text_or_empty(col), "?") > 0, 1).otherwise(0)


def exclamation_count(col) -> Column:
    t = text_or_empty(col)
    return F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyword_array(keywords: list[str]) -> Column:
    """A literal string array, built as one SQL expression (one call into the
    JVM instead of one per keyword; the lists are used hundreds of times)."""
    return F.expr("array(" + ", ".join(_sql_str(k) for k in keywords) + ")")


def count_contained(lowered: Column, keywords: list[str]) -> Column:
    """Number of distinct list entries that occur as substrings (#30 semantics).

    One higher-order ``filter`` over a literal array keeps the expression small
    however long the list is (236 routing keywords would otherwise blow the
    generated-method size limit); ``contains`` is a plain byte search, several
    times faster than ``instr``, which also computes a character position.
    """
    return F.size(F.filter(keyword_array(keywords), lambda k: F.contains(lowered, k)))


def any_contained(lowered: Column, keywords: list[str]) -> Column:
    return F.exists(keyword_array(keywords), lambda k: F.contains(lowered, k))


def urgency_score(col) -> Column:
    return let(lower_text(col), lambda low: count_contained(low, L.URGENCY_KEYWORDS))


def negative_word_count(col) -> Column:
    return let(lower_text(col), lambda low: count_contained(low, L.NEGATIVE_WORDS))


def positive_word_count(col) -> Column:
    return let(lower_text(col), lambda low: count_contained(low, L.POSITIVE_WORDS))


def sentiment_lexicon(col) -> Column:
    """#31: whole-word overlap with the sentiment sets on cleaned text."""
    toks = F.split(clean_text(col), " ")
    pos = F.size(F.array_intersect(toks, keyword_array(L.SENTIMENT_POSITIVE_SET)))
    neg = F.size(F.array_intersect(toks, keyword_array(L.SENTIMENT_NEGATIVE_SET)))
    return F.when(pos > neg, "Positive").when(neg > pos, "Negative").otherwise("Neutral")


def sentiment_score_label(score: Column) -> Column:
    """#32: score > 1 Positive, < -1 Negative, else Neutral."""
    return F.when(score > 1, "Positive").when(score < -1, "Negative").otherwise("Neutral")


def priority_from_urgency(urgency: Column) -> Column:
    """#33: urgency >= 3 Critical, >= 2 High, >= 1 Medium, else Low."""
    return (F.when(urgency >= 3, "Critical").when(urgency >= 2, "High")
            .when(urgency >= 1, "Medium").otherwise("Low"))


def priority_from_keywords(col) -> Column:
    """#34: any high keyword -> High, else any medium keyword -> Medium, else Low."""
    return let(lower_text(col), priority_from_lowered)


def priority_from_lowered(low: Column) -> Column:
    """#34 over an already lower-cased text column."""
    return (F.when(any_contained(low, L.HIGH_PRIORITY_KEYWORDS), "High")
            .when(any_contained(low, L.MEDIUM_PRIORITY_KEYWORDS), "Medium").otherwise("Low"))


def is_greeting(col) -> Column:
    """#35 backend form: exact greeting, or one of six greetings plus a space."""
    return let(F.lower(strip_ws(col)), lambda t: t.isin(*L.GREETINGS) | F.exists(
        keyword_array(L.GREETING_PREFIXES), lambda g: t.startswith(g)))


def is_greeting_ui(col) -> Column:
    """#35 chat-window form: any greeting alone or followed by space, comma or '!'."""
    prefixes = [g + s for g in L.GREETINGS for s in L.UI_GREETING_SEPARATORS]
    return let(strip_ws(F.lower(text_or_empty(col))), lambda t: t.isin(*L.GREETINGS) | F.exists(
        keyword_array(prefixes), lambda g: t.startswith(g)))


ENGINEERED_FEATURES = [
    "text_length", "word_count", "avg_word_length", "urgency_score",
    "negative_word_count", "positive_word_count", "sentiment_score",
    "has_question", "exclamation_count",
]


def feature_columns(col) -> dict[str, Column]:
    """#29 + #30: the nine engineered features as named columns."""
    pos = positive_word_count(col)
    neg = negative_word_count(col)
    return {
        "text_length": text_length(col),
        "word_count": word_count(col),
        "avg_word_length": avg_word_length(col),
        "urgency_score": urgency_score(col),
        "negative_word_count": neg,
        "positive_word_count": pos,
        "sentiment_score": pos - neg,
        "has_question": has_question(col),
        "exclamation_count": exclamation_count(col),
    }


def with_features(df, text_col: str, names: list[str] | None = None):
    """Add engineered feature columns to ``df``.

    The text is lower-cased once into a helper column that the keyword counts
    share (inside a lambda an inline ``lower`` would run once per keyword).
    """
    keep = names or ENGINEERED_FEATURES
    low = F.col("_low")
    counts = {
        "urgency_score": count_contained(low, L.URGENCY_KEYWORDS),
        "negative_word_count": count_contained(low, L.NEGATIVE_WORDS),
        "positive_word_count": count_contained(low, L.POSITIVE_WORDS),
    }
    plain = {
        "text_length": text_length(text_col),
        "word_count": word_count(text_col),
        "avg_word_length": avg_word_length(text_col),
        "has_question": has_question(text_col),
        "exclamation_count": exclamation_count(text_col),
    }
    need_counts = [c for c in counts if c in keep or ("sentiment_score" in keep and c != "urgency_score")]
    staged = df.select("*", lower_text(text_col).alias("_low"))
    out = staged.select(*df.columns, *[plain[c].alias(c) for c in keep if c in plain],
                        *[counts[c].alias(c) for c in need_counts])
    if "sentiment_score" in keep:
        out = out.withColumn("sentiment_score", F.col("positive_word_count") - F.col("negative_word_count"))
    extra = [c for c in need_counts if c not in keep]
    order = [c for c in df.columns] + [c for c in ENGINEERED_FEATURES if c in keep]
    return out.drop(*extra).select(*order)

"""Quality rules: a threshold table compiled into one projection, with no user function.

``RULES`` is the table: a metric, the least and the most value it may have (None: no bound).  ``metrics`` gives
the counts as built-in expressions over the whole text, ``verdict`` turns the table into one boolean expression.

Defined results: a null text counts as empty; an empty text has no words, fails the base rule and is not kept; ratios
over no words or no lines are null and break no rule; repeated rows each get their own row; columns of the input whose
names clash with the results are replaced by the results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import let
from tessera.llm.common import text_of

SYMBOLS = "#*$%&|<>"

# Stop words: the most frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on are as with be by at from or an this have not but had his they which",
    "de": "der die das und in zu den ist von mit ein eine nicht auf für im dem des sich auch als an es werden bei",
    "fr": "le la les de et des un une du en est que pour dans qui sur pas au avec il ce par plus se",
    "es": "el la los las de y que en un una es por con no para del se al lo como más su sus o",
}


@dataclass(frozen=True)
class Rule:
    metric: str
    least: float | None = None
    most: float | None = None


#: metric, least, most
RULES = (
    Rule("n_words", 50, 10_000_000),
    Rule("mean_word_chars", 1.5, 25),
    Rule("symbols_per_word", None, 0.2),
    Rule("exclaims_per_word", None, 0.5),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_ratio", None, 0.5),
    Rule("ellipsis_line_ratio", None, 0.6),
    Rule("bullet_line_ratio", None, 0.95),
)


def stop_words(languages=tuple(STOP_WORDS)) -> list[str]:
    words = {w for lang in languages for w in STOP_WORDS[lang].split()}
    return sorted(words | {w[0].upper() + w[1:] for w in words} | {w.upper() for w in words})


WORD_BREAK = "[ \t\n\x0b\x0c\r]+"
WORD_CHAR = "[^ \t\n\x0b\x0c\r]"


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than blank and tab to carriage return."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more in the text, the first finding included.

    A text whose window hashes all differ holds no window twice and stops after one hash set.  Else equal windows,
    held by 96 bits of two hash functions, are neighbours after a sort, and their positions are united.
    """
    def windows(w, *functions):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.struct(*[f(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias(f"h{n}")
                                                for n, f in enumerate(functions)], i.alias("i")))

    def same(a, b):
        return (a["h0"] == b["h0"]) & (a["h1"] == b["h1"])

    def repeated(w):
        return let(F.sort_array(windows(w, F.xxhash64, F.hash)), lambda s: F.size(F.array_distinct(F.flatten(F.transform(
            F.filter(s, lambda e, j: same(F.get(s, j - 1), e) | same(F.get(s, j + 1), e)),
            lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))))

    def all_differ(w):
        return let(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
                   lambda h: F.size(F.array_distinct(h)) == F.size(h))

    return F.when(F.size(words) < 4, 0).when(all_differ(words), 0).otherwise(repeated(words))


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of each whole text as long columns: one projection, no shuffle."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD_CHAR))
    stops = stop_words()
    per_words = let(words_of(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.filter(w, lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
        repeat_words(w).cast("long").alias("n_repeat_words")))
    per_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, lambda s: F.rtrim(s).endswith("...") | F.rtrim(s).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter(x, lambda s: F.ltrim(s).rlike("^[-*•]"))).cast("long").alias("n_bullet_lines")))
    new = {
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_exclaims": F.regexp_count(t, F.lit("[!?]")).cast("long"),
        "__llm_words": per_words, "__llm_lines": per_lines,
    }
    out = df.withColumns(new)
    names = ("n_words", "word_chars", "n_stop_words", "n_repeat_words"), ("n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines")
    return out.withColumns({n: F.col(f"{s}.{n}") for s, ns in zip(("__llm_words", "__llm_lines"), names) for n in ns}).drop("__llm_words", "__llm_lines")


def _per(count: str, total: str) -> Column:
    return F.when(F.col(total) > 0, F.col(count) / F.col(total))


RATIOS = {
    "n_words": ("n_words", None), "mean_word_chars": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
    "exclaims_per_word": ("n_exclaims", "n_words"), "stop_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"), "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
}


def verdict(rules=RULES) -> Column:
    """The table as one boolean expression over the columns of ``metrics``."""
    ok = F.lit(True)
    for r in rules:
        count, total = RATIOS[r.metric]
        value = F.col(count) if total is None else _per(count, total)
        if r.least is not None:
            ok = ok & F.coalesce(value >= r.least, F.lit(True))
        if r.most is not None:
            ok = ok & F.coalesce(value <= r.most, F.lit(True))
    return ok


def apply_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of each row."""
    out = metrics(df, text)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))

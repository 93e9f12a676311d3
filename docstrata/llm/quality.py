"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text of a row, so the operator
is a single scan without shuffle, Python or a limit on text length. Repeated three-word
windows are found by sorting their 64-bit hashes inside the row (two of n windows collide
with a probability below n * n / 2 ** 65); only a row that repeats many sorts their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import WHITE, text_of

# Frequent function words of the languages that are measured.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with his they at be this have from or had by not but",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
    "it": "di e il la che è per un in una non sono da del con si le dei nel al come ma lo alla anche",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele",
    "nl": "de van een het en in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit worden",
}
#: Fewer words than this, or letters mostly of other scripts, tell nothing about stop words.
STOP_WORDS_FROM = 20

#: (rule, measure, comparison that rejects, threshold). A measure that is null rejects nothing.
#: The rules are lenient: they reject junk that no clean prose of any length comes near.
RULES = [
    ("word_length_low", "mean_word", "<", 2.0),
    ("word_length_high", "mean_word", ">", 16.0),
    ("symbols", "symbol_ratio", ">", 0.07),
    ("stop_words", "stop_ratio", "<", 0.01),
    ("alphabetic", "alpha_ratio", "<", 0.50),
    ("repeated_lines", "dup_line_ratio", ">", 0.50),
    ("bullet_lines", "bullet_ratio", ">", 0.90),
    ("ellipsis_lines", "ellipsis_ratio", ">", 0.50),
]
FEW = 16  # repeated windows up to which places are found by looking each window up


def quality_rules(docs: DataFrame, rules=RULES, min_words: int = 50, max_repeat: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, the base measures, the ratios and the verdict.

    base_failed: fewer than min_words words, or more than max_repeat of the words in
    repeated three-word windows. failed_rules names the table's rules that reject the
    row; kept is true where neither rejects.

    Null and empty texts have no words and fail the base. A null doc_id is returned as
    null. Repeated rows are judged each for itself. Other columns of docs are not read
    and cannot clash; those named in carry come back inside the struct row_. An empty table
    gives an empty result.
    """
    row = [F.struct(*carry).alias("row_")] if carry else []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text_"), *row)
    bare = F.btrim("text_", F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{WHITE}]+"))
    lines = F.filter(F.split("text_", "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    split = base.withColumns({"words_": words, "lines_": lines})
    n = F.size("words_").cast("long")
    word_chars = F.length(F.translate("text_", " \t\n\x0b\x0c\r", "")).cast("long")
    symbols = (F.length("text_") - F.length(F.translate("text_", "#*$%&|<>", ""))).cast("long")
    hashed = F.transform("words_", lambda w: F.xxhash64(w))
    window = lambda i: F.xxhash64(F.get("hashed_", i), F.get("hashed_", i + 1), F.get("hashed_", i + 2))
    windows = F.when(F.size("words_") >= 3, F.transform(F.sequence(F.lit(0), F.size("words_") - 3), window))
    letters = F.regexp_replace("text_", r"\P{L}+", "")
    split = split.withColumns({"hashed_": hashed, "letters_": letters})
    counted = split.select(
        *(["row_"] if carry else []),
        "doc_id",
        n.alias("n_words"),
        word_chars.alias("word_chars"),
        symbols.alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        windows.alias("win_"),
        F.size("lines_").alias("n_lines_"),
        F.size(F.filter("lines_", lambda x: x.rlike(rf"^[{WHITE}]*[-*+•]"))).alias("bullets_"),
        F.size(F.filter("lines_", lambda x: x.rlike(rf"(\.\.\.|…)[{WHITE}]*$"))).alias("ellipses_"),
        F.length("letters_").alias("letters_"),
        F.length(F.regexp_replace("letters_", r"[^\x00-\x{24F}]+", "")).alias("latin_"),
        F.size(F.filter("words_", lambda w: F.lower(w).isin(stop))).alias("stops_"),
    )
    counted = counted.withColumn("sorted_", F.sort_array("win_"))
    twice = F.array_distinct(F.filter("sorted_", lambda x, k: F.coalesce(x == F.get("sorted_", k - 1), F.lit(False))))
    counted = counted.withColumn("twice_", twice).drop("sorted_")
    placed = F.sort_array(F.transform("win_", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    counted = counted.withColumn("placed_", F.when(F.size("twice_") > FEW, placed))
    same = lambda x, y: x["w"] == y["w"]
    meets = lambda x, k: F.coalesce(same(x, F.get("placed_", k - 1)), F.lit(False)) | F.coalesce(same(x, F.get("placed_", k + 1)), F.lit(False))
    many = F.sort_array(F.transform(F.filter("placed_", meets), lambda x: x["i"]))
    few = F.filter(F.transform("win_", lambda x, i: F.when(F.array_contains("twice_", x), i)), lambda i: i.isNotNull())
    starts = F.when(F.size("twice_") == 0, F.array().cast("array<int>")).when(F.col("placed_").isNull(), few).otherwise(many)
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    ratio = lambda x, y: F.try_divide(F.col(x).cast("double"), F.col(y).cast("double"))
    measured = counted.withColumns(
        {
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "mean_word": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "word_chars"),
            "stop_ratio": F.when((F.col("n_words") >= STOP_WORDS_FROM) & (2 * F.col("latin_") >= F.col("letters_")), ratio("stops_", "n_words")),
            "alpha_ratio": ratio("letters_", "word_chars"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines_"),
            "bullet_ratio": ratio("bullets_", "n_lines_"),
            "ellipsis_ratio": ratio("ellipses_", "n_lines_"),
        }
    )
    failed = F.filter(
        F.array(*(F.when(F.expr(f"{m} {op} {limit!r}D"), F.lit(name)) for name, m, op, limit in rules)),
        lambda x: x.isNotNull(),
    )
    judged = measured.withColumns(
        {
            "base_failed": (F.col("n_words") < min_words)
            | (100 * F.col("n_repeat_words") > 100 * max_repeat * F.col("n_words")),
            "failed_rules": F.array_join(failed, ","),
        }
    )
    # A filter on the verdict must not be pushed below: it would repeat the measures for each rule.
    judged = judged.withColumn("tick_", F.monotonically_increasing_id()).where("tick_ >= 0")
    return judged.select(
        *(["row_"] if carry else []), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "failed_rules",
        "mean_word", "symbol_ratio", "stop_ratio", "alpha_ratio", "dup_line_ratio", "bullet_ratio", "ellipsis_ratio",
    )

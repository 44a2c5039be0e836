"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every rule names a ratio and the range it has to lie in; ``compiled`` turns the table into
Column expressions, so that a whole rule set is one narrow stage without user functions.
Nulls count as texts without words. A text without words has all ratios 0 and fails on length.
Rows are judged one by one: repeated rows get repeated verdicts, an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import SPACES, let, space_words, text_or_empty

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for on was be with as this by are from it at "
    "der die das und ein eine den dem des zu von mit ist nicht auf für im als an auch sich "
    "le la les de des un une et est en dans que qui pour pas sur par au avec il "
    "el los las del y por con una para su al lo como se no es"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high]; None leaves a side open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Ratios in words or lines. A document is kept if all hold.
RULES = (
    Rule("n_words", low=50),
    Rule("repeat_ratio", high=0.5),
    Rule("symbol_ratio", high=0.1),
    Rule("mean_word_chars", low=2.0, high=12.0),
    Rule("dup_line_ratio", high=0.4),
    Rule("stop_ratio", low=0.01),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _repeat_words(words: Column, hashes: Column, n: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are sorted by a 64-bit hash of their words' hashes whose lowest bits give way to the position: as many
    bits as the word count needs. That brings equal windows together, so no map and no
    nested loop is needed; windows next to each other are then compared word by word. Up to two other windows of the
    same hash may stand between equal ones.
    """
    bits = F.ceil(F.log2(n + F.lit(1))).cast("int")

    def covered(bits: Column) -> Column:
        def packed(i: Column) -> Column:
            h = F.xxhash64(*(F.get(hashes, i + j) for j in range(3)))
            return F.call_function("shiftleft", F.call_function("shiftright", h, bits), bits).bitwiseOR(i.cast("long"))

        def twice(s: Column) -> Column:
            head = lambda x: F.call_function("shiftright", x, bits)
            low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
            at = lambda x, k: F.get(words, x.bitwiseAND(low).cast("int") + k)

            def equal(x: Column, y: Column) -> Column:
                return head(x).eqNullSafe(head(y)) & (at(x, 0) == at(y, 0)) & (at(x, 1) == at(y, 1)) & (at(x, 2) == at(y, 2))

            def same(x: Column, j: Column) -> Column:
                back, on = F.get(s, j - 1), F.get(s, j + 1)
                beside = head(x).eqNullSafe(head(back)) | head(x).eqNullSafe(head(on))  # false for most windows, which are done with then
                others = [equal(x, F.get(s, j + k)) for k in (-1, 1, -2, 2, -3, 3)]
                return beside & reduce(lambda a, b: a | b, (F.coalesce(e, F.lit(False)) for e in others))

            return F.array_sort(F.transform(F.filter(s, same), lambda x: x.bitwiseAND(low)))

        runs = let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), packed)), twice)
        start = F.struct(F.lit(0).cast("long").alias("until"), F.lit(0).cast("long").alias("words"))
        step = lambda acc, p: F.struct((p + 3).alias("until"), (acc["words"] + p + 3 - F.greatest(acc["until"], p)).alias("words"))
        return F.aggregate(runs, start, step, lambda acc: acc["words"])

    return F.when(n >= 3, let(bits, covered)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of counts of one text; nested lets evaluate each part once."""

    def of_words(text: Column, words: Column) -> Column:
        n = F.size(words)
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
        count = lambda c: c.cast("long")
        return let(
            lines,
            lambda lines: F.struct(
                count(n).alias("n_words"),
                count(F.length(F.translate(text, SPACES, ""))).alias("word_chars"),
                count(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
                count(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
                let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _repeat_words(words, h, n)).alias("n_repeat_words"),
                count(F.size(lines)).alias("n_lines"),
                count(F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))).alias("n_stop_words"),
            ),
        )

    return let(text, lambda t: let(space_words(t), lambda w: of_words(t, w)))


def metrics(m: Column) -> dict[str, Column]:
    return {
        "n_words": m["n_words"].cast("double"),
        "repeat_ratio": _ratio(m["n_repeat_words"], m["n_words"]),
        "symbol_ratio": _ratio(m["n_symbols"], m["n_words"]),
        "mean_word_chars": _ratio(m["word_chars"], m["n_words"]),
        "dup_line_ratio": _ratio(m["n_dup_lines"], m["n_lines"]),
        "stop_ratio": _ratio(m["n_stop_words"], m["n_words"]),
    }


def compiled(m: Column, rules=RULES) -> Column:
    """The conjunction of all rules as one boolean Column."""
    by_name, verdict = metrics(m), F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (by_name[r.metric] >= F.lit(float(r.low)))
        if r.high is not None:
            verdict = verdict & (by_name[r.metric] <= F.lit(float(r.high)))
    return verdict


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES, name: str = "quality") -> DataFrame:
    """``docs`` with a struct of counts, base_failed and kept; it takes the place of a column of its name."""
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)
        return F.struct(*(m[f].alias(f) for f in fields), failed.alias("base_failed"), (~failed & compiled(m, rules)).alias("kept"))

    # One let over all: a filter on the verdict, pushed below the projection, still measures each text once.
    return docs.withColumn(name, let(measures(text_or_empty(text)), judged))

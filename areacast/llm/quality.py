"""Quality rules: a table of thresholds compiled into one projection of ratios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areacast.llm.text import word_array

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in is that for it was with as on by this be from or are not an at "
    "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch "
    "le la les de des et un une du en que qui dans est pour par sur ce il au "
    "el los las y a del se con una su es lo como para más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must stay within ``low`` and ``high``; None leaves an end open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The default table.  Ratios are per word, per line or per letter as METRICS says.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", high=0.5),
    Rule("exclaim_ratio", high=0.5),
    Rule("dup_line_ratio", high=0.4),
    Rule("letter_word_ratio", low=0.7),
    Rule("stop_word_ratio", low=0.02),
)


def _metrics() -> dict[str, Column]:
    n_words, n_lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / n_words,
        "symbol_ratio": F.col("n_symbols") / n_words,
        "exclaim_ratio": F.col("n_exclaim") / n_words,
        "dup_line_ratio": F.col("n_dup_lines") / n_lines,
        "letter_word_ratio": F.col("n_letter_words") / n_words,
        "stop_word_ratio": F.col("n_stop_words") / n_words,
    }


def quality_rules(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Counts, ratios and verdicts for every row of ``docs``.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` are counts over the
    whole text; ``base_failed`` is true under 20 words or with over 30% of the words
    in repeated windows of 8 words; ``broken`` lists the metrics of ``rules`` that are
    out of bounds, and ``kept`` is true if neither applies.  A missing or empty text
    counts 0 everywhere and fails.  Each row stands for itself, repeated or not; the
    id may be missing; other columns are not read.
    """
    t = F.col("t")
    parts = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).select(
        "id",
        "t",
        word_array(t).alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    w, lines = F.col("w"), F.col("lines")
    codes = F.col("codes")
    last = F.size(codes) - WINDOW
    windows = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*(F.get(codes, i + k) for k in range(WINDOW))),
        ),
    )
    stop = sorted(set(STOP_WORDS))
    counted = parts.select(
        "id",
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclaim"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size(
            F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(stop))
        ).cast("long").alias("n_stop_words"),
        F.transform(w, lambda x: F.xxhash64(x)).alias("codes"),
    ).withColumn("h", windows).drop("codes")
    # Places are sorted by window only where a window stands twice.
    h, s, p = F.col("h"), F.col("s"), F.col("p")
    by_window = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    counted = counted.withColumn(
        "s", F.when(F.size(F.array_distinct(h)) < F.size(h), by_window)
    ).drop("h")
    twice = F.filter(
        F.transform(
            s,
            lambda x, j: F.when(
                (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    placed = counted.withColumn("p", F.sort_array(twice)).drop("s")
    covered = F.aggregate(
        F.transform(
            p, lambda i, j: F.coalesce(F.least(F.get(p, j + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    repeated = placed.withColumn(
        "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")
    ).drop("p")
    # Through a generator, so that a caller's filter is not evaluated inside the counts.
    repeated = repeated.select(F.inline(F.array(F.struct(*repeated.columns))))
    metrics = _metrics()
    broken = F.filter(
        F.array(
            *(
                F.when(_outside(metrics[r.metric], r), F.lit(r.metric))
                for r in rules
            )
        ).cast("array<string>"),
        lambda x: x.isNotNull(),
    )
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return repeated.select(
        F.col("id").alias(id),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        broken.alias("broken"),
        *(m.alias(k) for k, m in metrics.items()),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def _outside(metric: Column, rule: Rule) -> Column:
    out = F.lit(False)
    if rule.low is not None:
        out = out | (metric < rule.low)
    if rule.high is not None:
        out = out | (metric > rule.high)
    return out

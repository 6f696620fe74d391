"""Text-quality rules as a short-circuit cascade of native expressions.

Every figure is an expression over the row's own text, so nothing is shuffled: lines and words live in arrays, and
repeated 5-word windows are found by sorting the windows' hashes within the row. The rules beyond the base run as one
nested CASE, whose order is chosen by what a small sample shows: the rule that rejects most rows for its cost comes first, and a row that a rule rejects is not looked at by later rules. The order changes the cost
and the name of the first failing rule, never the verdict."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), "")


def chars_in(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, width: int = 5) -> Column:
    """How many words lie in a window of ``width`` words that occurs twice or more."""
    zero = F.lit(0).cast("int")

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(sorted_pairs: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(sorted_pairs, k)["h"] == x["h"], F.lit(False))
            met = F.filter(sorted_pairs, lambda x, k: same(x, k - 1) | same(x, k + 1))
            places = F.array_sort(F.transform(met, lambda x: x["i"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda at, k: F.when(k == 0, F.lit(width)).otherwise(F.least(F.lit(width), at - F.get(p, k - 1)))), zero, lambda a, b: a + b))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), zero).otherwise(let(pairs, twice))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) < width, zero).otherwise(let(windows, covered))


@dataclass(frozen=True)
class Rule:
    """``rejects``: from the columns text, words, lines, n_words, n_lines and the base figures to a boolean. ``passes``: how
    dear it is a character of the text, in steps of a plain scan for single characters; 0 if it only compares figures that
    the base has made."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]
    passes: float = 0.0


def _adjacent(words: Column) -> Column:
    return F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))


#: The rules beyond the base, with their limits and steps. The seconds that each took over sf0.1 on one core
#: by those of one translate() (0.92 s), rounded; rules that only compare figures took none that could be told from noise.
RULES = (
    Rule("symbols", lambda c: c["n_symbols"] * 10 > c["n_words"]),
    Rule("duplicate_lines", lambda c: (c["n_dup_lines"] >= 2) & (c["n_dup_lines"] * 100 > c["n_lines"] * 35)),
    Rule("word_length", lambda c: (c["word_chars"] < c["n_words"] * 2) | (c["word_chars"] > c["n_words"] * 15)),
    Rule("exclamation", lambda c: chars_in(c["text"], "!") * 2 > c["n_words"], 1.0),
    Rule("capitals", lambda c: F.length(F.regexp_replace(c["text"], r"\P{Lu}+", "")) * 10 > F.length(c["text"]) * 4, 0.3),
    Rule("letters", lambda c: F.length(F.regexp_replace(c["text"], r"[^\p{L}]+", "")) * 2 < c["word_chars"], 0.7),
    Rule("stuttering", lambda c: _adjacent(c["words"]) * 5 > c["n_words"], 1.0),
    Rule("ellipsis_lines", lambda c: F.size(F.filter(c["lines"], lambda x: x.rlike(r"(\.\.\.|…)\s*$"))) * 10 > c["n_lines"] * 4, 1.0),
    Rule("bullet_lines", lambda c: (c["n_lines"] >= 5) & (F.size(F.filter(c["lines"], lambda x: x.rlike(r"^\s*[-*•‣]"))) * 10 > c["n_lines"] * 9), 0.2),
)


def figures(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of a text that is not null."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("rep")))
    return let(
        F.struct(of_lines.alias("l"), of_words.alias("w")),
        lambda s: F.struct(s["w"]["n"].cast("long").alias("n_words"), F.length(F.translate(text, _SPACE, "")).cast("long").alias("word_chars"), chars_in(text, _SYMBOLS).cast("long").alias("n_symbols"), s["l"]["dup"].cast("long").alias("n_dup_lines"), s["w"]["rep"].cast("long").alias("n_repeat_words"), s["l"]["n"].cast("long").alias("n_lines")),
    )


def _scope(text: Column, base: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return {"text": text, "words": words_of(text), "lines": lines} | {k: base[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")}


def _rejects(rule: Rule, text: Column, base: Column) -> Column:
    """The rule's verdict, its words and lines split once for the row and only if the rule runs."""
    scope = _scope(text, base)
    if rule.name == "stuttering":
        return let(scope["words"], lambda w: rule.rejects(scope | {"words": w}))
    return rule.rejects(scope)


def base_failed(base: Column) -> Column:
    return (base["n_words"] < 10) | (base["n_repeat_words"] * 100 > base["n_words"] * 20)


def cheapest_first(patterns: dict[tuple[bool, ...], tuple[int, list[float]]]) -> list[int]:
    """An order of rules: each next one rejects most per cost, both of the rows that those before it let pass, ties going
    to the rule stated first. ``patterns``: for the verdicts of all rules, how many rows have them and what each rule
    costs on these."""
    left, order = dict(patterns), []
    rules = len(next(iter(patterns))) if patterns else 0
    while len(order) < rules:
        gain = {r: (sum(n for verdicts, (n, _) in left.items() if verdicts[r]) + 0.5) / (sum(costs[r] for _, costs in left.values()) + 1.0) for r in range(rules) if r not in order}
        order.append(min(gain, key=lambda r: (-gain[r], r)))
        left = {verdicts: x for verdicts, x in left.items() if not verdicts[order[-1]]}
    return order


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, text_column: str = "text") -> list[Rule]:
    """``rules`` ordered by rejection per cost, given the rules before, both estimated on at most ``sample_rows`` rows that
    pass the base. They are taken from the first partitions that yield them, so the sample's cost does not grow with the
    table. A rule's cost on a row is one step, and its steps a character on the sample's text: timing it would have the
    machine's noise in the order. The order decides what the cascade costs, never a verdict; without rows it is as stated."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    found = docs.select(text.alias("text")).sample(0.2, 7).where(~base_failed(figures(F.col("text")))).take(sample_rows)
    sample = spark.createDataFrame([(r.text,) for r in found], "text string").select("text", F.explode(F.array(figures(F.col("text")))).alias("base"))
    verdicts = F.array(*[_rejects(r, F.col("text"), F.col("base")) for r in rules])
    size = F.length("text").cast("double")
    seen = sample.groupBy(verdicts.alias("verdicts")).agg(F.count(F.lit(1)).alias("rows"), F.array(*[F.sum(1.0 + size * r.passes) for r in rules]).alias("costs")).collect()  # at most sample_rows
    order = cheapest_first({tuple(bool(v) for v in r.verdicts): (r.rows, r.costs) for r in seen})
    return [rules[i] for i in order] or list(rules)


def judge(docs: DataFrame, order: list[Rule] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id column, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule).

    failed_rule: 'base', or the first rule in the cascade's order that rejects, or null. Null and empty texts have no
    words and fail the base; rows that repeat get a row each; an empty table gives an empty result; other columns are
    ignored."""
    order = plan(docs, text_column=text_column) if order is None else order
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    # exploding the one-element array keeps the optimizer from writing the figures out once per use
    rows = rows.select("id", "text", F.explode(F.array(figures(F.col("text")))).alias("base"))
    text, base = F.col("text"), F.col("base")
    failed = F.when(base_failed(base), F.lit("base"))
    for rule in order:
        failed = failed.when(_rejects(rule, text, base), F.lit(rule.name))
    rows = rows.select("id", "base", F.explode(F.array(failed)).alias("failed_rule"))
    return rows.select(F.col("id").alias(id_column), *[base[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(base).alias("base_failed"), F.col("failed_rule").isNull().alias("kept"), "failed_rule")

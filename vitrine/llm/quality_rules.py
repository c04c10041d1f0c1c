"""Quality rules as a short-circuit cascade of column expressions.

A rule is a column that is true for a text to reject. The cost (seconds a row)
and the selectivity (share of rows rejected) of each rule are measured on a
sample; the rules then run in falling order of rejections per second, as the
branches of one CASE expression, so a row that an early rule rejects never pays
for a later one. The order changes the cost only: a text is kept if no rule
rejects it. Built-in expressions only: no Python runs on the rows.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: a null text has no words, like
an empty one, and is rejected; ids may be null or repeat, each row is judged by
itself; an empty table gives an empty result; columns beside id and text are
ignored by ``judge`` and returned as they are by ``keep_good``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import cut, let

SPACES = " \t\n\x0b\f\r"
SAMPLE_ROWS = 2_000             # the bound of the sample that orders the rules
SAMPLE_SEED = 7

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50           # per cent of the words
MAX_SYMBOLS_PER_100_WORDS = 10
MAX_DUP_LINE_SHARE = 40         # per cent of the lines with a word
MIN_LETTER_SHARE = 40           # per cent of the characters in words
MIN_MEAN_CHARS, MAX_MEAN_CHARS = 2, 15


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+"))


def word_chars(ws: Column) -> Column:
    return F.length(F.array_join(ws, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def n_dup_lines(ls: Column) -> Column:
    return (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")


def n_repeat_words(ws: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Window hashes are sorted with their positions; equal neighbours mark the
    repeated windows, whose union in the order of positions is then measured.
    Texts without an equal pair of windows stop after one distinct count."""
    n = F.size(ws)

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def measure(s: Column) -> Column:
            def twin(e: Column, j: Column) -> Column:
                return (F.get(s, j - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(e["h"]))

            starts = F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            return F.aggregate(
                starts, zero,
                lambda acc, i: F.struct((i + 3).alias("end"),
                                        (acc["n"] + 3 - F.greatest(F.lit(0), acc["end"] - i)).alias("n")),
                lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, measure))

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                              lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(windows, covered)

    return F.when(n < 4, F.lit(0)).otherwise(let(ws, of)).cast("long")


def metrics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the base columns of every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.withColumn("w", words(F.col("t"))).withColumn("l", lines(F.col("t")))
    return base.select("doc_id", "t", F.size("l").cast("long").alias("n_lines"),
                       F.size("w").cast("long").alias("n_words"), word_chars(F.col("w")).alias("word_chars"),
                       n_symbols(F.col("t")).alias("n_symbols"), n_dup_lines(F.col("l")).alias("n_dup_lines"),
                       n_repeat_words(F.col("w")).alias("n_repeat_words"))


def letters(text: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(text, rf"[^\p{{{kind}}}]+", "")).cast("long")


def base_fails(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat * 100 > n_words * MAX_REPEAT_SHARE)


def method_rules(text: Column, n_words: Column, chars: Column, symbols: Column, n_lines: Column,
                 dup_lines: Column) -> list[Rule]:
    """The rules beside the base ones, over a text's columns."""
    return [
        Rule("symbols", symbols * 100 > n_words * MAX_SYMBOLS_PER_100_WORDS),
        Rule("dup_lines", dup_lines * 100 > n_lines * MAX_DUP_LINE_SHARE),
        Rule("word_length", (chars < n_words * MIN_MEAN_CHARS) | (chars > n_words * MAX_MEAN_CHARS)),
        Rule("letters", letters(text, "L") * 100 < chars * MIN_LETTER_SHARE),
        Rule("capitals", letters(text, "Lu") > letters(text, "Ll")),
    ]


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows, spread over the whole table."""
    n = docs.count()
    return cut(docs.sample(fraction=min(1.0, rows / max(n, 1)), seed=SAMPLE_SEED))


def ranked(sample: DataFrame, rules: list[Rule]) -> list[tuple[str, float, float]]:
    """(rule, seconds a row, share rejected), best rejection per cost first."""
    n = max(1, sample.count())
    found = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sample.where(F.coalesce(rule.rejects, F.lit(False))).count()
        found.append((rule.name, max(1e-9, (time.perf_counter() - began) / n), rejected / n))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0]))


def cascade(rules: list[Rule], order: list[str]) -> Column:
    """The name of the first rule that rejects, in this order; null if none."""
    by = {r.name: r.rejects for r in rules}
    out = None
    for name in order:
        hit = F.coalesce(by[name], F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base columns, base_failed, kept and rejected_by (a rule that
    rejects, the first in the measured order; "base" for the base rules)."""
    def rules() -> list[Rule]:
        return method_rules(F.col("t"), F.col("n_words"), F.col("word_chars"), F.col("n_symbols"),
                            F.col("n_lines"), F.col("n_dup_lines"))

    few = metrics(sample_of(docs.select(id_col, text_col), sample_rows), id_col, text_col)
    order = [name for name, _, _ in ranked(cut(few), rules())]
    base = base_fails(F.col("n_words"), F.col("n_repeat_words"))
    out = metrics(docs, id_col, text_col).withColumn("base_failed", base)
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(
        cascade(rules(), order)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", F.col("rejected_by").isNull().alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows that a rule rejects. Here every rule, the base
    ones too, is part of the cascade and computes its own columns, so that a
    rejected row skips the dearer ones."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def rules(ws: Column, ls: Column) -> list[Rule]:
        n = F.size(ws).cast("long")
        return [Rule("few_words", n < MIN_WORDS),
                Rule("repeats", n_repeat_words(ws) * 100 > n * MAX_REPEAT_SHARE),
                *method_rules(text, n, word_chars(ws), n_symbols(text), F.size(ls), n_dup_lines(ls))]

    def bound(body) -> Column:
        """``body`` of the text's words and lines, each split once."""
        return let(words(text), lambda ws: let(lines(text), lambda ls: body(ws, ls)))

    names = [r.name for r in rules(F.lit(None), F.lit(None))]
    alone = [Rule(name, bound(lambda ws, ls, k=k: rules(ws, ls)[k].rejects)) for k, name in enumerate(names)]
    order = [name for name, _, _ in ranked(sample_of(docs, sample_rows), alone)]
    return docs.where(bound(lambda ws, ls: cascade(rules(ws, ls), order)).isNull())

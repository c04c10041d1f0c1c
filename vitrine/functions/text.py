"""Text analysis as Column expressions.

Index analyzer: word tokens -> lowercase -> ASCII folding -> synonyms (every
word of a group, at the same position) -> stop words. The query analyzer is the
same without synonyms: a typed word, or a part or a misspelling of it, meets the
index under its own spelling. Everything is a JVM-side array expression; the
fold table is generated once from Unicode decompositions (a rule, not a list).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The index's synonym groups (every word of a group matches
# every other: the index holds them all) and the default English stop
# word set of the `stop` token filter.
SYNONYM_GROUPS = [
    ["phone", "mobile", "smartphone", "cell"],
    ["laptop", "computer", "notebook"],
    ["headphones", "earphones", "earbuds"],
    ["tv", "television"],
    ["car", "automobile", "vehicle"],
]
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into",
              "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then",
              "there", "these", "they", "this", "to", "was", "will", "with"]
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
NO_TOKEN_PATTERN = r"[^\p{L}\p{N}]+"
#: Words that a task keeps the terms of.
MEMO_WORDS = 1 << 18
EDGE_MIN, EDGE_MAX = 2, 20
# letters whose folded form is more than one character
MULTI_CHAR_FOLDS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}


def _fold_table() -> tuple[str, str]:
    """Single-character folds for Latin-1 and Latin Extended-A lower-case
    letters: the base letter of the canonical decomposition."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0180):
        ch = chr(cp)
        if ch != ch.lower() or ch in MULTI_CHAR_FOLDS:
            continue  # upper case is lowered before folding
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and base.isascii():
            src.append(ch)
            dst.append(base)
    extra = {"ø": "o", "đ": "d", "ħ": "h", "ł": "l", "ŧ": "t", "ı": "i"}
    for k, v in extra.items():
        if k not in src:
            src.append(k)
            dst.append(v)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_table()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(s: Column) -> Column:
    """ASCII folding of lower-case text."""
    for k, v in MULTI_CHAR_FOLDS.items():
        s = F.replace(s, F.lit(k), F.lit(v))
    return F.translate(s, FOLD_FROM, FOLD_TO)


def _synonym_map() -> Column:
    items = []
    for group in SYNONYM_GROUPS:
        for word in group:
            items += [F.lit(word), F.array(*map(F.lit, group))]
    return F.create_map(*items)


def raw_tokens(text) -> Column:
    """Word tokens (letters and digits), lower-cased and folded, before
    synonyms and stop words: array<string>."""
    lowered = fold(F.lower(_c(text)))
    return F.regexp_extract_all(lowered, F.lit(f"({TOKEN_PATTERN})"), 1)


def with_synonyms(term: Column) -> Column:
    """Every word of the term's synonym group (or the term alone): array."""
    return F.coalesce(_synonym_map()[term], F.array(term))


def is_stop(term: Column) -> Column:
    return term.isin(STOP_WORDS)


def analyze_query(text) -> Column:
    """X1 of a query: terms as typed (stop words removed): array<string>."""
    return F.filter(raw_tokens(text), lambda t: ~is_stop(t))


def analyze_query_positions(text) -> Column:
    """``analyze_query`` with positions: array<struct<pos:int, term:string>>;
    removed stop words leave gaps in positions, as the index does."""
    with_pos = F.transform(raw_tokens(text), lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
    return F.filter(with_pos, lambda s: ~is_stop(s["term"]))


def analyze(text) -> Column:
    """Indexed terms, synonyms included: array<string>."""
    return F.flatten(F.transform(analyze_query(text), with_synonyms))


def analyze_positions(text) -> Column:
    """X1 with positions; the words of a synonym group share theirs."""
    return F.flatten(F.transform(analyze_query_positions(text), lambda s: F.transform(
        with_synonyms(s["term"]), lambda t: F.struct(s["pos"].alias("pos"), t.alias("term")))))


class WordTerms(dict):
    """X1 of single words, lower-cased and free of other characters: word -> the terms it is indexed under. At most
    MEMO_WORDS words are kept."""

    def __init__(self):
        super().__init__()
        self.table = str.maketrans(FOLD_FROM, FOLD_TO)
        self.stops = {"", *STOP_WORDS}
        self.groups = {word: group for group in SYNONYM_GROUPS for word in group}

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        term = word
        for k, v in MULTI_CHAR_FOLDS.items():
            term = term.replace(k, v)
        term = term.translate(self.table)
        self[word] = terms = [] if term in self.stops else self.groups.get(term, [term])
        return terms


def analyze_sku(sku) -> Column:
    """Keyword tokenizer + lowercase + folding: one term."""
    return fold(F.lower(_c(sku)))


def edge_ngrams(term) -> Column:
    """Prefixes of length 2..20 of a letters/digits token (autocomplete)."""
    t = _c(term)
    n = F.least(F.length(t), F.lit(EDGE_MAX))
    return F.when(n >= EDGE_MIN, F.transform(F.sequence(F.lit(EDGE_MIN), n),
                                             lambda i: t.substr(F.lit(1), i))
                  ).otherwise(F.array().cast("array<string>"))


def fuzzy_edits(term) -> Column:
    """X12 AUTO fuzziness: 0 edits up to 2 characters, 1 up to 5, else 2."""
    n = F.length(_c(term))
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)

"""Personal data: rules for the plain formats, and a character-level
bidirectional LSTM with CRF transitions for formats beyond them.

The tagger is trained in numpy from labelled spans: rule matches in slices of a
bounded sample of the documents, and values of many written forms set into such
slices, beside look-alikes that are none. A text is cut into overlapping
windows. Each kind's check needs a digit, an at sign or an "at" in brackets; the
windows that hold one are decoded, then those that meet a span found, until there
are no more, so the result is that of decoding every window. Spans of neighbouring windows are reconciled over the whole text:
overlapping ones of a kind unite, so a span that a window's edge cuts is whole
again, and of overlapping kinds the longest span stays. A span of the tagger is
added if it passes its kind's check (digits, parts, Luhn sum) and touches no
rule span. Rule spans always stay.

Offsets are code points, ends exclusive. Defined cases: a null text is an empty
one, without spans (``redact`` leaves it null); ids may be null or repeat, each
row is judged by itself; an empty table gives an empty result and the tagger is
then trained on set values only; extra columns are ignored by ``find`` and
returned as they are by ``redact``.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.bilstm_crf import Tagger
from vitrine.session import ship_package

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 64
BATCH_WINDOWS = 1024
SAMPLE_ROWS = 1_000             # documents whose slices the tagger sees: the bound of the fit
SLICE = 600
TRAIN_WINDOW, TRAIN_BATCH, TRAIN_STEPS, HIDDEN = 56, 64, 420, 16
SEED = 11

Span = tuple[str, int, int]

# -- rules -------------------------------------------------------------------------------
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"[(\[]at[)\]]")
_ANY = re.compile(r"[0-9@]|" + _AT.pattern)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Rule matches, leftmost and non-overlapping per kind, by kind and start."""
    out: list[Span] = []
    after = 0
    at = text.find("@")
    while at >= 0:                      # the local part is the run before the at sign
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    for m in _DOTTED.finditer(text):    # four parts at a time
        parts, pos = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            end = pos + sum(map(len, parts[k:k + 4])) + 3
            if all(map(_byte, parts[k:k + 4])):
                out.append(("ip", pos, end))
            pos = end + 1
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# -- checks of the tagger's spans ----------------------------------------------------------
_EDGE = " \t\r\n.,;:!?\"'*#$%&<>[]{}|=/"
_EMAIL_LIKE = re.compile(r"[^\s@]+(?:@| ?[(\[]at[)\]] ?)[^\s@.]+(?:\.[^\s@.]+)+")
_PHONE_LIKE = re.compile(r"(?:\+|00)?[0-9(][0-9\x20()./-]*[0-9]")
_DATE = re.compile(r"[0-9]{1,4}([./-])[0-9]{1,2}\1[0-9]{1,4}")
_THOUSANDS = re.compile(r"[0-9]{1,3}(?:[ .][0-9]{3})+")


def checked(kind: str, s: str) -> bool:
    """Whether a span of the tagger can be of its kind."""
    if kind == "email":
        return bool(_EMAIL_LIKE.fullmatch(s))
    digits = _digits(s)
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte(p) for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not s.strip("0123456789 -") and digits.strip(digits[0]) != ""
    groups = re.findall(r"[0-9]+", s)
    return (bool(_PHONE_LIKE.fullmatch(s)) and 9 <= len(digits) <= 15
            and not _DATE.fullmatch(s) and not _THOUSANDS.fullmatch(s)
            and (len(groups) >= 3 or s[0] == "+" or s[:2] == "00"))


# -- training data --------------------------------------------------------------------------
def _value(r: random.Random, kind: str) -> str:
    """A value of one of the kind's written forms."""
    def n(k):
        return "".join(r.choice("0123456789") for _ in range(k))

    def word(a=2, b=9):
        return "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(a, b)))

    if kind == "email":
        local = r.choice([word(), f"{word()}.{word()}", f"{word()}_{n(2)}", f"{word()}.{n(2)}", f"{word()}-{word()}+{word()}"])
        host = ".".join([r.choice([word(), f"{word()}{n(1)}"]) for _ in range(r.randint(1, 2))])
        at = r.choice(["@", "@", "@", "@", " (at) ", "[at]"])
        return f"{local}{at}{host}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'example.com'])}"
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        size = r.choice([16, 16, 16, 15])
        body = r.choice("3456") + n(size - 2)
        digits = next(body + d for d in "0123456789" if luhn(body + d))
        if r.random() < 0.5:
            return digits
        cuts = (4, 10) if size == 15 else (4, 8, 12)
        sep = r.choice([" ", "-"])
        return sep.join(digits[a:b] for a, b in zip((0, *cuts), (*cuts, size)))
    area, mid, last = n(3), n(3), n(4)
    return r.choice([f"+1 ({area}) {mid}-{last}", f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}",
                     f"+{n(2)} {n(2)} {n(4)} {n(4)}", f"00{n(2)} {n(3)} {n(3)} {n(3)}", f"+{n(11)}", f"0{n(3)}/{n(3)} {n(4)}"])


def _lookalike(r: random.Random) -> str:
    """A value that resembles personal data and is none."""
    def n(a, b=None):
        return "".join(r.choice("0123456789") for _ in range(r.randint(a, b or a)))

    return r.choice([
        f"Version {n(1)}.{n(1)}", f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', n(1, 6), n(20, 30),
        f"{n(4)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{n(4)}",
        f"{n(1, 3)}.{n(1, 3)}.{n(1, 3)}", f"{n(2)}:{n(2)}", f"{n(1, 3)} 000 000", f"#{n(3, 5)}", f"@{n(2)}", "a @ b",
        f"{n(1, 4)}.{n(2)} %", f"BY-NC {n(1)}.0", f"{n(3)}-{n(3)}", f"{n(4)}-{n(4)}", f"({n(2)})", f"{n(1, 3)},{n(3)},{n(3)}"])


_CLASSES = np.full(129, 1, np.int64)
for _k, _group in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "@", ".", "-",
                             "_", "+", "(", ")", " ", "\n\t\r", "%", ":", "/", "=", '"', "#*$&|", ",;!?"), 2):
    for _c in _group:
        _CLASSES[ord(_c)] = _k
_CLASSES[128] = 22
N_CLASSES = 23                      # 0 pads, 1 other ASCII, 22 beyond ASCII


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASSES[np.minimum(codes, 128)]


def _example(r: random.Random, slices: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of one training window."""
    text = r.choice(slices)
    k = r.randrange(max(1, len(text) - TRAIN_WINDOW))
    text = text[k:k + TRAIN_WINDOW]
    spans: list[Span] = base_spans(text)
    what = r.random()
    if what < 0.8:
        kind = r.choice(KINDS) if what < 0.5 else None
        value = _value(r, kind) if kind else _lookalike(r)
        before = text[:r.randrange(max(1, TRAIN_WINDOW - len(value)))]
        edge = r.random()
        before = before.rstrip() + (" " if edge < 0.7 else r.choice(["(", '"', ": ", "\n", ", ", "## "])) if before else ""
        tail = r.choice([" ", " ", ". ", ", ", "\n", "!! ", "%%% "]) + text[len(before):]
        spans = base_spans(before) + ([(kind, len(before), len(before) + len(value))] if kind else [])
        text = (before + value + tail)[:TRAIN_WINDOW]
    x, y = np.zeros(TRAIN_WINDOW, np.int64), np.zeros(TRAIN_WINDOW, np.int64)
    x[:len(text)] = symbols(text)
    for kind, a, b in spans:
        y[a:min(b, len(text))] = 2 + 2 * KINDS.index(kind)
        if a < len(text):
            y[a] -= 1
    return x, y


def train(texts: list[str], steps: int = TRAIN_STEPS, seed: int = SEED) -> Tagger:
    r = random.Random(seed)
    slices = [t for t in texts if t and len(t) > 20] or ["the quick brown fox jumps over the lazy dog " * 4]
    tagger = Tagger(N_CLASSES, len(KINDS), HIDDEN, seed)

    def batches():
        for _ in range(steps):
            some = [_example(r, slices) for _ in range(TRAIN_BATCH)]
            yield np.stack([x for x, _ in some], 1), np.stack([y for _, y in some], 1)

    tagger.fit(batches())
    return tagger


def sample_slices(docs: DataFrame, text_col: str, rows: int = SAMPLE_ROWS) -> list[str]:
    """A slice of SLICE characters of each of about ``rows`` documents, spread
    over the whole table: at most 2 * rows are ever collected."""
    n = docs.count()
    text = F.col(f"`{text_col}`")
    at = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - SLICE, F.lit(1))).cast("int") + 1
    some = docs.where(text.isNotNull()).select(F.substring(text, at, F.lit(SLICE)).alias("s"))
    return sorted(x.s for x in some.sample(min(1.0, rows / max(n, 1)), SEED).limit(2 * rows).collect())


# -- decoding --------------------------------------------------------------------------------
def window_spans(tags: np.ndarray, start: int) -> list[Span]:
    """The spans of one window's tags; offsets in the whole text."""
    out: list[Span] = []
    k, n = 0, len(tags)
    while k < n:
        if tags[k]:
            kind = (int(tags[k]) - 1) // 2
            j = k + 1
            while j < n and tags[j] == 2 + 2 * kind:
                j += 1
            out.append((KINDS[kind], start + k, start + j))
            k = j
        else:
            k += 1
    return out


def reconcile(found: list[Span]) -> list[Span]:
    """Spans of overlapping windows as spans of the text."""
    united: list[list] = []
    for kind, a, b in sorted(found, key=lambda s: (s[0], s[1], s[2])):
        if united and united[-1][0] == kind and a < united[-1][2]:
            united[-1][2] = max(united[-1][2], b)
        else:
            united.append([kind, a, b])
    kept: list[Span] = []
    for kind, a, b in sorted(united, key=lambda s: (s[1] - s[2], s[1], s[0])):
        if all(b <= x or y <= a for _, x, y in kept):
            kept.append((kind, a, b))
    return kept


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(rule spans, all spans) of each text; windows of many texts are decoded
    together."""
    out = [([], []) for _ in texts]
    found: dict[int, list[Span]] = {}
    asked: dict[int, set[int]] = {}
    waiting: list[tuple[int, int]] = []

    def ask(doc: int, first: int, last: int):
        """The windows that hold a part of the blocks from first to last."""
        for k in range(max(0, first - 1), last + 1):
            if k not in asked[doc]:
                asked[doc].add(k)
                waiting.append((doc, k * STRIDE))

    def decode():
        some = waiting[:BATCH_WINDOWS]
        del waiting[:BATCH_WINDOWS]
        parts = [symbols(texts[doc][start:start + WINDOW]) for doc, start in some]
        x = np.zeros((WINDOW, len(some)), np.int64)
        for k, s in enumerate(parts):
            x[:len(s), k] = s
        tags = tagger.decode(x)
        for k, (doc, start) in enumerate(some):
            spans = window_spans(tags[:len(parts[k]), k], start)
            found[doc].extend(spans)
            for _, a, b in spans:
                ask(doc, a // STRIDE, (b - 1) // STRIDE)

    for doc, text in enumerate(texts):
        if not _ANY.search(text):
            continue
        found[doc], asked[doc] = [], set()
        s = symbols(text)
        for k in np.unique(np.flatnonzero((s == 2) | (s == 6)) // STRIDE).tolist():
            ask(doc, k, k)
        for m in _AT.finditer(text):
            ask(doc, m.start() // STRIDE, (m.end() - 1) // STRIDE)
        while len(waiting) >= BATCH_WINDOWS:
            decode()
    while waiting:
        decode()
    order = {k: i for i, k in enumerate(KINDS)}
    for doc, spans in found.items():
        text = texts[doc]
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in taken]
        added = []
        for kind, a, b in reconcile(spans):
            while a < b and text[a] in _EDGE:
                a += 1
            while b > a and text[b - 1] in _EDGE:
                b -= 1
            if text[a - 1:a].isdigit() or text[b:b + 1].isdigit():
                continue                # a part of a longer number
            near = np.searchsorted(starts, b)
            if checked(kind, text[a:b]) and all(y <= a for _, y in taken[max(0, near - len(KINDS)):near]):
                added.append((kind, a, b))
        out[doc] = (base, sorted(base + added, key=lambda x: (order[x[0]], x[1])))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (rule
    spans), base_sha256 (of the rule spans), spans (all)."""
    ship_package(docs.sparkSession)
    tagger = train(sample_slices(docs, text_col, sample_rows))

    def run(batches):
        for batch in batches:
            got = all_spans([t or "" for t in batch.column(1).to_pylist()], tagger)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS]
            shas = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, shas, pa.array([_joined(s) for _, s in got], pa.string())],
                                             ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                "base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by its first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars",
           sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with personal data in the text masked as [EMAIL], [IP], [CARD]
    or [PHONE]; ``chars_col``, if there, is the new length where a text changes."""
    ship_package(docs.sparkSession)
    tagger = train(sample_slices(docs, text_col, sample_rows))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        got = all_spans([t or "" for t in texts], tagger)
        return pd.Series([masked(t, spans) if spans else t for t, (_, spans) in zip(texts, got)], dtype=object)

    old = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), clean(old).alias("new"))

    def value(c: str) -> Column:
        own = F.col("row").getField(c)
        if c == text_col:
            return F.col("new").alias(c)
        if c == chars_col:
            changed = ~F.col("new").eqNullSafe(F.col("row").getField(text_col))
            return F.when(changed, F.length("new").cast("long")).otherwise(own).alias(c)
        return own.alias(c)

    return rows.select(*[value(c) for c in docs.columns])

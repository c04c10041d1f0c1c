"""Token ids of whole texts by a rank file and its pattern, for the operators
that need ids fast and not the encoding method itself."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np

from vitrine.llm.byte_bpe import read_ranks
from vitrine.session import ship_package

_KNOWN: dict[str, tuple] = {}
#: A run of white space from this length on is encoded by itself: the library's
#: pattern engine walks back over a run and gives up on very long ones.
LONG_BLANK = 4096
#: White space as the patterns' \\s has it.
_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_BLANK)


def added_tokens(json_path: str) -> dict[str, int]:
    """Ids of the added tokens of a ``tokenizers`` file, which are found in a
    text before it is split by the pattern."""
    with open(json_path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take their surroundings are not supported")
    return {t["content"]: t["id"] for t in added}


def share_ranks(spark, ranks_path: str, pattern: str, added: dict[str, int] | None = None):
    """(key, broadcast): the vocabulary, whose size is that of its file, and the
    added tokens."""
    ship_package(spark)
    ranks, added = read_ranks(ranks_path), added or {}
    # longer ones first, where one begins with another
    added = dict(sorted(added.items(), key=lambda x: (-len(x[0]), x[0])))
    ranks = {token: i for token, i in ranks.items() if i not in added.values()}
    key = hashlib.sha256(repr((ranks_path, pattern, len(ranks), added)).encode()).hexdigest()
    return key, spark.sparkContext.broadcast((ranks, pattern, added))


def library(key: str, shared):
    """(encoding, bytes of each id) of the worker; kept between its tasks."""
    if key not in _KNOWN:
        import tiktoken

        ranks, pattern, added = shared.value
        sizes = np.zeros(max([*ranks.values(), *added.values()], default=-1) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            sizes[i] = len(token)
        _KNOWN.clear()
        _KNOWN[key] = (tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added),
                       sizes)
    return _KNOWN[key]


def encode(encoding, text: str, added: bool = False) -> np.ndarray:
    """The ids of a whole text; ``added``: with the encoding's added tokens.

    A run of white space is one pre-token up to its last character, which goes
    with what follows, or up to its end where the text or an added token ends it."""
    options = {"allowed_special": "all"} if added else {}
    if len(text) < LONG_BLANK or not _BLANK.search(text):
        return encoding.encode_to_numpy(text, disallowed_special=(), **options)
    names = sorted(encoding.special_tokens_set, key=len, reverse=True) if added else []
    out = []
    for part in re.split("(" + "|".join(map(re.escape, names)) + ")", text) if names else [text]:
        at = 0
        for m in _BLANK.finditer(part):
            end = m.end() if m.end() == len(part) else m.end() - 1
            out.append(encoding.encode_to_numpy(part[at:m.start()], disallowed_special=(), **options))
            out.append(np.array(encoding._encode_single_piece(part[m.start():end]), np.uint32))
            at = end
        out.append(encoding.encode_to_numpy(part[at:], disallowed_special=(), **options))
    return np.concatenate(out)

"""Operator 3: line-first cleaning.

Each line is judged first: navigation bars, boilerplate, shouting, and lines cut up
by symbols are failures; a line without any sentence mark fails unless it is short
enough to be a heading. Failed lines are removed; a document is rejected
when it then has lost more than ``max_lost`` of its word characters, or has fewer
than ``min_words`` words left, or failed the base rules (too few words, too much
repetition).

A null text has no words and no lines and is rejected by the base rules; so is an
empty one. Every row is judged by itself, so repeated rows, null ids and extra
columns pass through. One very long text is held by one task, as one row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.tokens import slices

#: The symbols that are counted, ASCII capitals, separators of navigation bars.
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BARS = frozenset(x.encode() for x in "|>»•·")
_MARKS = re.compile(r"[.!?…。！？](?:\s|$|[\"'”’»)\]])|[:;\"'”’»)\]]\s*$")
#: Phrases of navigation and boilerplate, in the languages of the corpus: fixed values.
BOILERPLATE = (
    r"cookie|javascript|all rights reserved|terms of (use|service)|privacy policy|copyright ©|click here|log ?in|sign ?(in|up)|subscribe|read more|share this|"
    r"lorem ipsum|tous droits réservés|mentions légales|alle rechte vorbehalten|datenschutz|impressum|todos los derechos reservados|aviso legal"
)
_BOILERPLATE = re.compile(BOILERPLATE, re.IGNORECASE)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A larger share of its word characters lost with failed lines rejects a document.
    max_lost: float = 0.5
    #: Words that a line without a sentence mark may have.
    heading_words: int = 12
    #: Shares of a line's words that fail it.
    max_symbol_words: float = 0.3
    max_shouted: float = 0.6
    #: Separators ("|", ">", "»", "•") from which on a line is a navigation bar.
    bars: int = 3


def repeat_words(words: list) -> int:
    """Words that lie in a window of three found twice or more."""
    if len(words) < 4 or len(set(zip(words, words[1:], words[2:]))) == len(words) - 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def without(raw: bytes, unwanted: bytes) -> bytes:
    return raw.translate(None, unwanted)


def line_fault(line: str, raw: bytes, words: list[bytes], rules: Rules) -> str | None:
    """Why a line, with its UTF-8 bytes and their words, fails; or None."""
    n = len(words)
    if len(without(raw, _SYMBOLS)) < len(raw) and sum(len(without(w, _SYMBOLS)) < len(w) for w in words) > rules.max_symbol_words * n:
        return "symbols"
    if n >= rules.bars and sum(map(_BARS.__contains__, words)) >= rules.bars:
        return "navigation"
    if n <= 2 * rules.heading_words and _BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 4 and (line.isupper() or len(raw) - len(without(raw, _CAPITALS)) > rules.max_shouted * len(raw)):
        return "shouting"
    if n > rules.heading_words and not _MARKS.search(line):
        return "punctuation"
    return None


def clean(text: str | None, rules: Rules = Rules()) -> dict:
    """The base counts, the verdict and the cleaned text of one document.

    Words are runs of anything but ASCII white space; bytes.split() splits at just that.
    """
    text = text or ""
    whole = text.encode()
    chars = len(text) - (len(whole) - len(without(whole, b" \t\n\v\f\r")))
    words: list[bytes] = []
    seen: set[str] = set()
    dup = faults = lost = left_words = 0
    left: list[str] = []
    for line in text.split("\n"):
        raw = line.encode()
        own = raw.split()
        if not own:
            left.append(line)
            continue
        words += own
        dup += line in seen
        seen.add(line)
        if line_fault(line, raw, own, rules):
            faults += 1
            lost += len(line) - (len(raw) - len(without(raw, b" \t\n\v\f\r")))
        else:
            left.append(line)
            left_words += len(own)
    n, repeats = len(words), repeat_words(words)
    base_failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    kept = not base_failed and lost <= rules.max_lost * chars and left_words >= rules.min_words
    return {
        "n_words": n, "word_chars": chars, "n_symbols": len(whole) - len(without(whole, _SYMBOLS)), "n_dup_lines": dup, "n_repeat_words": repeats,
        "base_failed": base_failed, "kept": kept, "n_failed_lines": faults, "lost_chars": lost, "cleaned": "\n".join(left),
    }


_FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_failed_lines bigint, lost_chars bigint, cleaned string"


def judge(df: DataFrame, text: str = "text", with_text: bool = False, rules: Rules = Rules()) -> DataFrame:
    """df with the fields of ``clean``; the original text only if asked for.

    Fields replace columns of the same names.
    """
    fields = [f.split()[0] for f in _FIELDS.split(", ")]
    source = df.drop(*[c for c in fields if c != text])
    stay = [f for f in source.schema if with_text or f.name != text]
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, text):
            out = [clean(t, rules) for t in texts]
            arrays = [pa.array([o[name] for o in out], kinds[f.split()[1]]) for name, f in zip(fields, _FIELDS.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(f.name)) for f in stay] + arrays, [f.name for f in stay] + fields)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in stay) + _FIELDS
    return source.mapInArrow(run, schema)

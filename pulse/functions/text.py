"""Column expressions for short-text cleaning and tokenizing.

All of them are built-in Spark expressions (regexp_replace, regexp_extract_all,
split, ...), so they run inside whole-stage codegen with no Python in the loop.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These patterns define the results and must stay as they are.
# ---------------------------------------------------------------------------
# Cleaning after lower(): keep a-z and white space (batch and stream jobs).
CLEAN_ASCII = r"[^a-z\s]"
# Cleaning used before augmentation: keep a-z, digits and white space.
CLEAN_ASCII_DIGITS = r"[^a-z0-9\s]"
# White space as Python's str.split() and re's \s see it (Unicode), written
# out so Java regex and RE2 (the SQL oracle) agree with it.
PY_SPACE = (r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
            r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Markup removed before counting words: links (http...), mentions (@...) and
# hashtags (#...), each up to the next white space. The reference's Python
# pattern is  http\S+|@\S+|#\S+  with Unicode \S; this is the same match
# with \S written out as "not PY_SPACE" (Java's and RE2's \S are ASCII-only).
MARKUP = rf"http[^{PY_SPACE}]+|@[^{PY_SPACE}]+|#[^{PY_SPACE}]+"
# Letters a word may hold.
WORD_LETTERS = "a-záéíóúñü"
# A word starts at the text start or after a char that is not a Unicode word
# char (letter, digit, underscore), the meaning of \b before a letter: the
# reference's Python pattern  \b[a-záéíóúñü]+  (capture group 1 is the word).
TOKEN = rf"(?:^|[^\p{{L}}\p{{N}}_])([{WORD_LETTERS}]+)"
# A hashtag: '#' and a run of Unicode word chars (Python's  #\w+ ).
HASHTAG = r"#[\p{L}\p{N}_]+"
# Known class labels, compared case-folded.
KNOWN_LABELS = ["positive", "negative", "neutral", "irrelevant", "pos", "neg", "neu"]
# Class names.
CLASSES = ["Positive", "Negative", "Neutral", "Irrelevant"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c, mode: str = "ascii") -> Column:
    """lower() then delete every char outside the kept set.

    ``ascii``: a-z and white space; NULL stays NULL.
    ``ascii_digits``: a-z, 0-9 and white space; NULL becomes ''.
    """
    c = _col(c)
    if mode == "ascii":
        return F.regexp_replace(F.lower(c), CLEAN_ASCII, "")
    if mode == "ascii_digits":
        return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), CLEAN_ASCII_DIGITS, "")
    raise ValueError(f"unknown clean mode {mode!r}")


def strip_markup(c) -> Column:
    """lower() and remove links, mentions and hashtags."""
    return F.regexp_replace(F.lower(_col(c)), MARKUP, "")


def tokens(c) -> Column:
    """Words of a text: strip markup, then every run of word letters that
    starts a Unicode word. NULL gives NULL (no words)."""
    return F.regexp_extract_all(strip_markup(c), F.lit(TOKEN), 1)


def hashtags(c) -> Column:
    """Hashtags as written (case kept)."""
    return F.regexp_extract_all(_col(c), F.lit(HASHTAG), 0)


def words(c) -> Column:
    """Split on white space as Python's str.split() does (no empty words)."""
    return F.array_remove(F.split(_col(c), f"[{PY_SPACE}]+"), "")


def text_length(c) -> Column:
    """Length in characters (code points)."""
    return F.length(_col(c))

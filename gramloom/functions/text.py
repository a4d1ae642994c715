"""Column -> Column text functions (strip, normalise, symbol removal,
word test, cacheable test).  All are built-in Spark SQL expressions, so they
stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gramloom import constants as K

# The exact set of characters Python's ``str.strip()``/``str.split()`` treat
# as whitespace, written with \x{...} escapes that both Java regex and RE2
# understand.  ``trim()`` would only remove U+0020.
WS_CLASS = (
    r"[\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                             0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPLIT_WS_PATTERN = f"{WS_CLASS}+"
# Unicode general categories P* and S*.
SYMBOL_PATTERN = r"[\p{P}\p{S}]"
# Universal newlines: CRLF, CR, LF.
NEWLINE_PATTERN = "\r\n|\r|\n"
# Exactly one character that is neither a letter nor a number.
NON_ALNUM_CHAR = r"^[^\p{L}\p{N}]$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """B1: remove Unicode whitespace at both ends (``btrim`` looks at the
    ends only; a pattern would be tried at every character)."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def normalize_line(col) -> Column:
    """Strip, delete the six CJK punctuation marks, strip again."""
    return strip(F.translate(strip(col), K.NORMALIZE_DELETE, ""))


def strip_symbols(col) -> Column:
    """Delete every punctuation or symbol character; keep whitespace."""
    return F.regexp_replace(_c(col), SYMBOL_PATTERN, "")


def clean_piece(col) -> Column:
    """Drop the word-boundary mark, then symbols."""
    return strip_symbols(F.replace(_c(col), F.lit(K.SPACE_MARK), F.lit("")))


def is_cacheable_piece(piece, token_id=None) -> Column:
    """A token is cacheable when something other than symbols,
    whitespace and the boundary mark is left; sentinels never are."""
    p = _c(piece)
    core = strip_symbols(strip(F.replace(p, F.lit(K.SPACE_MARK), F.lit(""))))
    ok = p.isNotNull() & (F.length(p) > 0) & (F.length(core) > 0)
    if token_id is not None:
        ok = ok & ~_c(token_id).isin(K.BOS_ID, K.EOS_ID)
    return ok


def is_word_like(col) -> Column:
    """Empty -> false; particle -> true; 2+ characters -> true; a single
    character is word-like unless it is a letter or a number."""
    t = _c(col)
    return (
        F.when(t.isNull() | (F.length(t) == 0), F.lit(False))
        .when(t.isin(*K.SINGLE_CHAR_WORDS), F.lit(True))
        .when(F.length(t) >= 2, F.lit(True))
        .otherwise(t.rlike(NON_ALNUM_CHAR))
    )


def valid_prompt(col) -> Column:
    """A prompt must be present and not blank."""
    t = _c(col)
    return t.isNotNull() & (F.length(strip(t)) > 0)


def split_lines(col) -> Column:
    """A1 for a text column: universal-newline split."""
    return F.split(_c(col), NEWLINE_PATTERN)


def word_tokens(col) -> Column:
    """Whitespace tokens of an already stripped line (empty line -> [])."""
    t = _c(col)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(
        F.split(t, SPLIT_WS_PATTERN))


def char_tokens(col) -> Column:
    """One token per Unicode code point."""
    return F.regexp_extract_all(_c(col), F.lit("(?s)."), F.lit(0))

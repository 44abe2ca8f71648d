"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace of Python strings (strip, split and \s agree on it) as characters and
# as a pattern, the letters and digits that make a text more than symbols, and the words of the TF-IDF
# tokeniser.
SPACES = "".join(
    map(
        chr,
        [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
WHITESPACE = r"(?U)[\s\x1c-\x1f]"
LETTER_OR_DIGIT = r"[a-zA-Z0-9\u00C0-\u024F]"
WORD = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    """Drop whitespace at both ends. Spark's ``trim`` only drops plain spaces."""
    return F.btrim(text, F.lit(SPACES))


def collapse_whitespace(text: Column) -> Column:
    """Turn each run of whitespace into one space."""
    return F.regexp_replace(text, f"{WHITESPACE}+", " ")


def strip_and_collapse(text: Column) -> Column:
    return collapse_whitespace(strip(text))


def char_length(text: Column) -> Column:
    """Length in code points."""
    return F.char_length(text)


def word_count(collapsed: Column) -> Column:
    """Words of a text whose whitespace is already collapsed and stripped; 0 for the empty text."""
    spaces = F.char_length(collapsed) - F.char_length(F.replace(collapsed, F.lit(" "), F.lit("")))
    return F.when(collapsed == "", F.lit(0)).otherwise(spaces + 1)


def special_only(text: Column) -> Column:
    """True for a non-empty text without any letter or digit."""
    return (text != "") & ~text.rlike(LETTER_OR_DIGIT)


def words(text: Column) -> Column:
    """Lower-case words of two or more word characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def one_and_two_grams(tokens: Column) -> Column:
    """All words and all pairs of neighbouring words joined by a space.

    The pairs are made inside the row, so no shuffle or window over token positions is needed. The
    outer ``transform`` binds the tokens to a variable: written as plain columns, the optimiser would
    run the tokeniser once per mention. ``slice`` to length 0 keeps texts of 0 or 1 words right.
    """

    def with_pairs(words_: Column) -> Column:
        n_pairs = F.greatest(F.size(words_) - 1, F.lit(0))
        pairs = F.zip_with(
            F.slice(words_, 1, n_pairs),
            F.slice(words_, 2, n_pairs),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        return F.concat(words_, pairs)

    return F.flatten(F.transform(F.array(tokens), with_pairs))


def digest(text: Column) -> Column:
    """32-byte stand-in for a text of any length, for grouping equal texts with narrow shuffles."""
    return F.unhex(F.sha2(text, 256))


def truncate(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)

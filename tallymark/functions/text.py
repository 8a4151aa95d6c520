"""Text cleaning: Column -> Column, JVM-side only."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from ..constants import (BLANK_TOKENS, KNOWN_FLAGS, NULL_TOKENS, REVIEW_WORDS, STATUS_BLANK,
                         STATUS_FOLD, STATUS_ORDER)

CONTROL = r"[\x00-\x1f\x7f]"
# --- fixed value: the Unicode white space characters -------------------------
WHITE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
         "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"     # the same set, one property test per letter
ASCII_SPACE = r"[\s\x1c-\x1f]"


def quoted(name: str) -> Column:
    """Column by exact name, whatever punctuation the header carries."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(c: Column, dtype: T.DataType) -> Column:
    """Any column as text; nested values as JSON."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")


def bind(c: Column, then) -> Column:
    """``then`` of a value computed once. For the rarer shapes of a value: it is
    evaluated out of line, which keeps the generated code of the rest small."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def strip(c: Column) -> Column:
    """Trim any Unicode white space at both ends; looks at the ends only."""
    return F.btrim(c, F.lit(WHITE))


def strip_cell(c: Column) -> Column:
    """``strip`` of a plain column, which it names several times: a cell between two visible ASCII
    characters, told by its first and last byte, is passed on as it is."""
    last = F.substring(c.cast("binary"), -1, 1)
    bare = (c >= "!") & (c < "\x7f") & (last >= F.lit(b"!")) & (last < F.lit(b"\x7f"))
    return F.when(bare, c).otherwise(strip(c))


def holds_text(dtype: T.DataType) -> bool:
    """Text or nested: the types whose text can need cleaning. The text of a
    number, date or boolean is tidy as Spark writes it."""
    return not isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType,
                                  T.TimestampNTZType))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def replace_space(c: Column, shape: str, new: str) -> Column:
    """Replace by a pattern in which ``S`` stands for any white space. Plain
    ASCII text takes a pattern Java matches by table, several times faster."""
    return (F.when(is_ascii(c), F.regexp_replace(c, shape.replace("S", ASCII_SPACE), new))
            .otherwise(F.regexp_replace(c, shape.replace("S", SPACE), new)))


# Possessive: one pass without a step back, and no call per word of a long text.
_TIDY = r"^(?:[!-~]++(?: [!-~]++)*+)?\z"


def tidy(c: Column) -> Column:
    """Drop control characters, collapse white space, trim. ASCII text that is
    tidy already costs one match and is passed on as it is."""
    as_is = c.rlike(_TIDY)
    bare = F.regexp_replace(c, CONTROL, "")
    # ASCII has no white space but blanks once the control characters are gone.
    spaced = (F.when(is_ascii(c), F.regexp_replace(bare, "  +", " "))
              .otherwise(F.regexp_replace(bare, SPACE + "+", " ")))
    return F.when(as_is, c).otherwise(F.trim(spaced))


def null_words(c: Column) -> Column:
    return F.when(~c.isin(*NULL_TOKENS), c)


def clean_text(c: Column) -> Column:
    """R01. Over many columns apply ``tidy`` and ``null_words`` in two selects:
    the second names the text twice."""
    return null_words(tidy(c))


def is_blank(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Null, NaN, or text that trims to one of the blank spellings."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    if isinstance(dtype, T.StringType):
        return F.coalesce(strip_cell(c), F.lit("")).isin(*BLANK_TOKENS)
    return c.isNull()


def is_blank_tidy(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """``is_blank`` of a cell without outer white space, as ``tidy`` leaves it."""
    if not isinstance(dtype, T.StringType):
        return is_blank(c, dtype)
    return F.coalesce(c, F.lit("")).isin(*BLANK_TOKENS)


_BLANK_ONCE_CLEAN = ("^" + SPACE + "*(?:" + "|".join(
    re.escape(t) for t in sorted({*NULL_TOKENS, *BLANK_TOKENS} - {""})) + ")?" + SPACE + "*$")


def is_blank_once_clean(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """``is_blank(clean_text(c))`` read off the raw cell: it mentions the cell
    once, so a filter pushed below the cleaning stays small and cheap."""
    if not isinstance(dtype, T.StringType):
        return is_blank(c, dtype)
    return (F.regexp_replace(F.coalesce(c, F.lit("")), CONTROL, "")
            .rlike(_BLANK_ONCE_CLEAN))


def is_missing(c: Column) -> Column:
    """Null or empty, the test the row rules use after cleaning."""
    return c.isNull() | (c == "")


# ``is_tidy`` tells that a cell comes from ``tidy``: its white space is single inner spaces,
# so it is neither trimmed nor collapsed again.
def client_id(c: Column, is_tidy: bool = False) -> Column:
    """Upper case, one '-' for any dash or underscore, single spaces."""
    dashed = F.regexp_replace(c if is_tidy else replace_space(c, "S+", " "), " ?[-_] ?", "-")
    return F.upper(dashed if is_tidy else strip(dashed))


def reference(c: Column, is_tidy: bool = False) -> Column:
    return F.upper(c) if is_tidy else strip(F.upper(c))


def status_key(c: Column, is_tidy: bool = False) -> Column:
    spaced = c if is_tidy else replace_space(strip(c), "S+", " ")
    return F.lower(F.regexp_replace(spaced, "[ -]+", "_"))


def known_status(c: Column, is_tidy: bool = False) -> Column:
    """The payment status a raw word folds to, else null."""
    vocabulary = F.create_map(*[F.lit(x) for pair in STATUS_FOLD.items() for x in pair])
    return F.try_element_at(vocabulary, status_key(c, is_tidy))


def status(c: Column, is_tidy: bool = False) -> Column:
    """Fold the payment vocabulary, keep other words, name the blanks."""
    bare = F.coalesce(c, F.lit(""))
    bare = bare if is_tidy else strip(bare)
    return F.when(bare == "", STATUS_BLANK).otherwise(F.coalesce(known_status(c, is_tidy), bare))


def status_rank(c: Column) -> Column:
    """Report position: the canonical statuses first, everything else after."""
    ranked = F.create_map(*[F.lit(x) for i, s in enumerate(STATUS_ORDER) for x in (s, i)])
    return F.coalesce(F.try_element_at(ranked, c), F.lit(99))


def email(c: Column, is_tidy: bool = False) -> Column:
    return F.lower(F.replace(c, F.lit(" "), F.lit("")) if is_tidy else replace_space(c, "S+", ""))


def phone(c: Column, country_code: str = "+27") -> Column:
    """Digits and '+', a leading 0 or bare country code made international."""
    digits = F.regexp_replace(c, r"(?U)[^\d+]", "")
    digits = F.regexp_replace(digits, "^0", F.lit(country_code))
    return F.regexp_replace(digits, "^" + country_code.lstrip("+"), F.lit(country_code))


def title_case(c: Column) -> Column:
    """A capital after every non-letter (``initcap`` looks at spaces only)."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    capital = F.transform(tokens, lambda t: F.concat(F.upper(F.substring(t, 1, 1)),
                                                     F.substring(t, 2, 2 ** 31 - 1)))
    # ASCII: a mark and a space make ``initcap`` begin a word after every other character
    # too. A pass over an array of tokens is interpreted for each row.
    marked = F.initcap(F.regexp_replace(c, "([^A-Za-z ])(?=[A-Za-z])", "$1\x00 "))
    return (F.when(c.rlike(r"^[\x20-\x7e]*+\z"), F.replace(marked, F.lit("\x00 "), F.lit("")))
            .otherwise(F.array_join(capital, "")))


def proper_name(c: Column, is_tidy: bool = False) -> Column:
    """Title case with the company suffixes written their usual way."""
    name = title_case(c if is_tidy else strip(replace_space(c, "S+", " ")))
    suffixed = F.regexp_replace(name, r"\(Pty\)|\bPty\b", "(Pty)")
    suffixed = F.regexp_replace(F.regexp_replace(suffixed, r"\bCc\b", "CC"), r"\bNpc\b", "NPC")
    return F.when(c.rlike("(?i)pty|cc|npc"), suffixed).otherwise(name)


def labels(slots: list[tuple[str, Column]]) -> Column:
    """The labels whose condition holds, in order, as array<string>. Arrays of one label are joined:
    a filter over an array is interpreted for each row, and so is all that it reads."""
    empty = F.slice(F.array(F.lit("")), 1, 0)
    return F.concat(*[F.when(test, F.array(F.lit(label))).otherwise(empty) for label, test in slots])


def needs_review(*texts: Column) -> Column:
    """True when the joined text holds one of the review words."""
    if not texts:
        return F.lit(False)
    joined = F.lower(F.concat_ws(" ", *texts))
    hit = F.lit(False)
    for word in REVIEW_WORDS:
        hit = hit | joined.contains(word)
    return hit


def compose_notes(flags: Column, note: Column, is_tidy: bool = False) -> Column:
    """Flags in rule order, then the source note unless it is only a null word."""
    bare = F.coalesce(note, F.lit(""))
    bare = bare if is_tidy else strip(bare)
    keep = ~F.lower(bare).isin("", "nan", "none", "<na>")
    empty = F.array().cast("array<string>")
    return F.array_join(F.concat(flags, F.when(keep, F.array(bare)).otherwise(empty)), " | ")


def note_tokens(notes: Column) -> Column:
    """Split notes on '|', trimmed, without empties, first occurrence kept."""
    parts = F.transform(F.split(F.coalesce(notes, F.lit("")), r"\|"), lambda t: strip(t))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def known_flag_tokens(tokens: Column) -> Column:
    return F.array_intersect(tokens, F.array(*[F.lit(x) for x in KNOWN_FLAGS]))


def free_text_tokens(tokens: Column) -> Column:
    return F.array_except(tokens, F.array(*[F.lit(x) for x in KNOWN_FLAGS]))


def row_badge(flagged: Column, review: Column) -> Column:
    return (F.when(flagged, "FLAGGED").when(review, "NEEDS REVIEW").otherwise("CLEAN"))


def status_badge(c: Column) -> Column:
    """REVIEW, one of the canonical statuses, or CUSTOM."""
    shown = F.when(is_missing(strip(c)), STATUS_BLANK).otherwise(strip(c))
    return (F.when(needs_review(shown), "REVIEW")
            .when(shown.isin(*STATUS_ORDER), shown).otherwise("CUSTOM"))

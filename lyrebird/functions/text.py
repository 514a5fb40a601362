"""Text columns: cleaning, normalising, counting, splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def trimmed(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


#: Letters whose capital is one character only in simple case mapping: sharp s, and Greek ones with iota below.
_WITH_IOTA = [*(lo + i for lo in (0x1F80, 0x1F90, 0x1FA0) for i in range(8)), 0x1FB3, 0x1FC3, 0x1FF3]
_SMALL = "ß" + "".join(map(chr, _WITH_IOTA))
_CAPITAL = "ẞ" + "".join(chr(i + (8 if i < 0x1FB0 else 9)) for i in _WITH_IOTA)


def capitalised(c: Column) -> Column:
    """The first character by simple case mapping, which keeps it one character: no SS for a sharp s, no FI for a ligature."""
    first = F.substring(c, 1, 1)
    upper = F.upper(first)
    return F.concat(F.when(F.length(upper) > 1, F.translate(first, _SMALL, _CAPITAL)).otherwise(upper), F.substr(c, F.lit(2)))


def clean_transcript(c: Column) -> Column:
    """White space collapsed, then [..] and (..) out, no blank before and one after a sentence mark, first letter upper; null is empty."""
    c = collapse(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(F.regexp_replace(c, r"\[[^\]\n]*\]", ""), r"\([^)\n]*\)", "")
    c = F.regexp_replace(c, r"\s+([.!?])", "$1")
    c = F.regexp_replace(c, r"([.!?])\s*([A-Z])", "$1 $2")
    return capitalised(trimmed(c))


def clean_segment(c: Column) -> Column:
    """Trimmed, collapsed, and closed by a full stop if longer than 20 and open-ended."""
    c = collapse(trimmed(c))
    return F.when((F.length(c) > 20) & ~c.rlike(r"[.!?:]$"), F.concat(c, F.lit("."))).otherwise(c)


def normalise_query(c: Column) -> Column:
    return collapse(trimmed(F.lower(c)))


def words(c: Column) -> Column:
    """White-space separated words, none empty."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def token_estimate(c: Column) -> Column:
    """Whole tokens at 1.33 a word."""
    return F.floor(word_count(c) * 1.33).cast("long")


def word_blocks(c: Column, size: int) -> Column:
    """Consecutive blocks of ``size`` words, joined by blanks; an empty array without words."""
    # inside the lambda the words are a value; outside they would be split again for each block

    def blocks(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size)), lambda i: i < F.size(w))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))

    return F.flatten(F.transform(F.array(words(c)), blocks))


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def highlight(c: Column, query: str, tag: str = "mark") -> Column:
    """Terms of more than two characters, whatever their case, inside a tag; terms are taken literally."""
    for term in dict.fromkeys(query.split()):
        if len(term) > 2:
            quoted = term.replace("\\E", "\\E\\\\E\\Q")
            c = F.regexp_replace(c, rf"(?i)(\Q{quoted}\E)", f"<{tag}>$1</{tag}>")
    return c


def fix_terms(c: Column, terms: list[tuple[str, str]]) -> Column:
    """Ordered, case-sensitive replacements."""
    for old, new in terms:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escaped_like(term: str) -> str:
    """A LIKE pattern that finds the term itself; % and _ in it are no wildcards."""
    return "%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def inline_citations(c: Column) -> Column:
    """Citations like [id@m:ss] in a text, as 'id@m:ss'."""
    return F.regexp_extract_all(c, F.lit(r"\[([^@\[\]]+@\d+:\d+)\]"), 1)


def is_non_verbal(c: Column) -> Column:
    return F.lower(c).rlike(r"\[(music|applause|laughter|silence)\]")

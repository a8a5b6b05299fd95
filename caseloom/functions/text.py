"""Text functions as column expressions, all inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case words; whatever is no letter, digit or underscore parts them."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")), r"\s+"), lambda w: w != "")


def ascii_terms(text: Column, stop: Sequence[str] = (), longer_than: int = 2) -> Column:
    """Terms of the ASCII letters and digits, without short and stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) > longer_than) & ~w.isin(*stop) if stop else F.length(w) > longer_than)


def trimmed(text: Column) -> Column:
    """Without the Unicode space separators at both ends, as SQL's ``trim`` has it; Spark's own takes plain blanks only."""
    return F.trim(text, F.lit("\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """1.3 tokens a word, rounded down."""
    return F.floor(word_count(text) * F.lit(1.3)).cast("bigint")


def sentences(text: Column) -> Column:
    """Parts between full stops, exclamation and question marks that are not blank."""
    return F.filter(F.transform(F.split(text, r"[.!?]"), lambda s: F.trim(s)), lambda s: s != "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def text_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256 over the whole collapsed lower-case text."""
    return F.substring(F.sha2(F.lower(collapsed(text)), 256), 1, 16)


def raw_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def title_key(text: Column, words: int = 8) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.lower(text)), r"\s+"), 1, words), " ")


def redacted(text: Column, terms: Sequence[str], mark: str = "[REDACTED]") -> Column:
    """Every whole-word occurrence of ``terms`` replaced, whatever its letter case.

    A word ends where no ASCII letter, digit or underscore follows, so that a
    term beside an accent, dash or garbled character is masked too.
    """
    return F.regexp_replace(text, r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(terms) + r")(?![A-Za-z0-9_])", mark)


def head_tail(text: Column, head: int, tail: int, mark: str = "\n[...]\n") -> Column:
    return F.when(F.length(text) > head + tail, F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(tail)))).otherwise(text)


def clean_lines(text: Column, noise: Sequence[str]) -> Column:
    """Without blank lines and those that match one of the patterns; lines may end in any of CR LF, LF and CR."""
    pattern = "|".join(f"(?:{p})" for p in noise)
    return F.array_join(F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: (F.trim(x) != "") & ~x.rlike(pattern)), "\n")


def first_class(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Name of the first rule whose pattern the text matches."""
    out = F.lit(default)
    for name, pattern in reversed(list(rules)):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def signal_score(text: Column, positive: Sequence[str], negative: Sequence[str], penalty: float = 0.75) -> Column:
    """Matched positive patterns less ``penalty`` for each negative one."""
    total = F.lit(0.0)
    for p in positive:
        total = total + F.coalesce(text.rlike(p).cast("double"), F.lit(0.0))
    for p in negative:
        total = total - F.coalesce(text.rlike(p).cast("double"), F.lit(0.0)) * penalty
    return total


def non_empty(value: Column) -> Column:
    """Null for null and blank text."""
    return F.nullif(F.trim(value), F.lit(""))


def number_or_null(value: Column) -> Column:
    """A double of a text or number; null for what is none, NaN and infinities."""
    x = value.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)

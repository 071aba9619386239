"""Text scores as column expressions; everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions import phrases

#: Letters and digits as the patterns mean them: ASCII, whatever the regex engine's word class is.
_WORD = "[A-Za-z0-9_]"
_DATE = rf"(?i)(?<!{_WORD})({phrases.DATE}|{'|'.join(phrases.MONTHS)})(?!{_WORD})"
_NUMBER = rf"{phrases.MONEY}|{phrases.SHARE}|(?<!{_WORD}){phrases.LONG_NUMBER}(?!{_WORD})"


def words(text: Column) -> Column:
    """Lower-case words split at white space, edge blanks kept as empty words. Give it a column of its
    own before scoring: every term reads it."""
    return F.split(F.lower(text), r"\s+", -1)


def terms(query: str) -> list[str]:
    """Query terms: lower-case, longer than two characters, repeats kept."""
    return [t for t in query.lower().split() if len(t) > 2]


def keyword_score(words_: Column, query: str) -> Column:
    """Term share times a damped rarity, summed over the terms, times 5, at most 1."""

    def share(term: str) -> Column:
        return F.size(F.filter(words_, lambda w: w.contains(term))).cast("double") / F.size(words_)

    parts = [(tf := share(t)) * F.log(1 + F.lit(10.0) / (1 + tf * 10)) for t in terms(query)]
    return F.least(F.lit(1.0), reduce(Column.__add__, parts) * 5) if parts else F.lit(0.0)


def count_of(text: Column, phrases_: list[str]) -> Column:
    """How many of the phrases the text contains, as substrings."""
    return reduce(Column.__add__, [text.contains(p).cast("int") for p in phrases_])


def has_any(text: Column, phrases_: list[str]) -> Column:
    return reduce(Column.__or__, [text.contains(p) for p in phrases_])


def rounded(x: Column) -> Column:
    """Two decimals, half up on the binary value."""
    return F.floor(x * 100 + 0.5) / 100


def importance(text: Column) -> Column:
    """Importance heuristic, 0 to 1."""
    low = F.lower(text)
    score = F.lit(0.5) + count_of(low, phrases.HIGH_SIGNAL) * F.lit(0.08) - count_of(low, phrases.LOW_SIGNAL) * F.lit(0.08)
    score = score + F.when(text.rlike(_DATE), 0.07).otherwise(0.0) + F.when(text.rlike(_NUMBER), 0.05).otherwise(0.0)
    score = score + F.when(F.length(text) > 200, 0.05).otherwise(0.0) - F.when(F.length(text) < 30, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), rounded(score)))


def parsed_importance(reply: Column, fallback: Column) -> Column:
    """A model's reply as importance: a leading decimal number, clamped and rounded, else the fallback."""
    found = F.regexp_extract(F.trim(reply), phrases.LEADING_NUMBER, 1)
    number = F.when(found != "", found).try_cast("double")
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), rounded(number)))
    return F.coalesce(F.when(number.isNotNull(), value), fallback)


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens longer than three characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^A-Za-z0-9_]+", -1), lambda t: F.length(t) > 3))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set's size."""
    return F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.size(a), F.size(b), F.lit(1))


def contradicts(new: Column, old: Column, new_tokens: Column, old_tokens: Column) -> Column:
    """Similar statements with a shared preference word of which exactly one is negated."""
    a, b = F.lower(new), F.lower(old)
    both = reduce(Column.__or__, [a.contains(p) & b.contains(p) for p in phrases.PREFERENCES])
    return (overlap(new_tokens, old_tokens) > 0.3) & both & (has_any(a, phrases.NEGATORS) != has_any(b, phrases.NEGATORS))


def trimmed(text: Column, also: str = "") -> Column:
    """Without white space (and other characters) at both ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"^[\s{also}]+", ""), rf"[\s{also}]+$", "")


def exact_match(answer: Column, expected: Column) -> Column:
    """Either contains the other, case aside; an empty answer matches everything."""
    a, b = F.lower(answer), F.lower(expected)
    return a.contains(b) | b.contains(a)


def like_any(text: Column, query: str) -> Column | None:
    """LIKE %term% of any term, wildcards in terms kept; None without terms."""
    found = [F.lower(text).like("%" + t.replace("\\", "\\\\") + "%") for t in terms(query)]
    return reduce(Column.__or__, found) if found else None


def temporal_question(text: Column) -> Column:
    return has_any(F.lower(text), phrases.TEMPORAL)

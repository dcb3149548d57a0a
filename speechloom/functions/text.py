"""Text expressions shared by the operators.

``SPACE`` is one character that a Unicode-aware whitespace split breaks on,
no-break space and the four information separators included; the flag makes
one category lookup of it where a list of ranges would try each in turn.
``WORD`` is the inside of a class of letters, numbers and underscore.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U:[\s\x1C-\x1F])"
WORD = r"\p{L}\p{N}_"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze_space(c: Column | str) -> Column:
    """Every run of whitespace becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(_col(c), f"{SPACE}+", " "))


def strip_space(c: Column | str) -> Column:
    """Drop leading and trailing whitespace of any kind."""
    return F.regexp_replace(_col(c), rf"^{SPACE}+|{SPACE}+\z", "")


def space_tokens(c: Column | str) -> Column:
    """Whitespace-separated tokens, never empty strings."""
    return F.filter(F.split(_col(c), f"{SPACE}+"), lambda t: t != "")


def word_tokens(c: Column | str, min_chars: int = 1) -> Column:
    """Lower-case word tokens of at least ``min_chars`` characters."""
    count = "+" if min_chars == 1 else f"{{{min_chars},}}"
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(f"[{WORD}]{count}"), F.lit(0))


def _extended(shorter: Column, tokens: Column, n: int) -> Column:
    """The n-grams, from the (n-1)-grams and the token that follows each."""
    room = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    return F.zip_with(
        F.slice(shorter, F.lit(1), room),
        F.slice(tokens, F.lit(n), room),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def ngrams(tokens: Column | str, n: int) -> Column:
    """Space-joined n-grams. ``tokens`` should be a plain column."""
    tokens = _col(tokens)
    return tokens if n == 1 else _extended(ngrams(tokens, n - 1), tokens, n)


def runs(tokens: Column | str, longest: int) -> Column:
    """All n-grams up to the longest: the tokens, then the pairs, and so on."""
    tokens = _col(tokens)

    def from_length(n: int, grams: Column) -> Column:
        if n == longest:
            return grams
        longer = let(_extended(grams, tokens, n + 1), lambda g: from_length(n + 1, g))
        return F.concat(grams, longer)

    return from_length(1, tokens)


def counted(terms: Column) -> Column:
    """Each distinct term of an array with how often it stands there: an array of
    (term, tf). Equal terms are neighbours once the array is sorted."""

    def ends_of_runs(ordered: Column) -> Column:
        places = F.when(F.size(ordered) > 0, F.sequence(F.lit(1), F.size(ordered)))
        last = F.filter(
            places,
            lambda i: (i == F.size(ordered)) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            F.coalesce(last, F.array().cast("array<int>")),
            lambda ends: F.transform(
                ends,
                lambda end, k: F.struct(
                    F.get(ordered, end - 1).alias("term"),
                    (end - F.coalesce(F.get(ends, k - 1), F.lit(0))).alias("tf"),
                ),
            ),
        )

    return F.when(terms.isNotNull(), let(F.sort_array(terms), ends_of_runs))


def phrase_pattern(phrase: str) -> str:
    """Regex with the meaning of ``LIKE '%phrase%'``: ASCII letters match in
    either case, ``%`` and ``_`` are wildcards, everything else is literal."""
    wild = {"%": ".*", "_": "."}
    parts = re.split("([%_])", phrase)
    return "(?is)" + "".join(wild.get(p) or re.escape(p) for p in parts)


def mentions(text: Column | str, phrase: str) -> Column:
    """Whether the text mentions the phrase. One compiled pattern scans the
    text as it is, so no folded copy of the text is made."""
    return _col(text).rlike(phrase_pattern(phrase))


def mentions_any(text: Column | str, phrases: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (mentions(text, p) for p in phrases))


def remove_all(text: Column | str, patterns: Iterable[str]) -> Column:
    """Delete what matches each pattern, one after another."""
    return reduce(lambda c, p: F.regexp_replace(c, p, ""), patterns, _col(text))


def _any_phrase(phrases: Sequence[str]) -> str:
    """Regex that finds a text with at least one of the literal phrases. If each has
    words after a space, it is looked for at its first one: few characters of a text
    are spaces, and of these few are followed by the right three characters."""
    whole = "|".join(map(re.escape, phrases))
    ends = [p.partition(" ")[2] for p in phrases]
    if not all(ends):
        return f"(?:{whole})"
    firsts = zip(*(e[:3] for e in ends))
    start = "".join("[" + "".join(map(re.escape, sorted(set(c)))) + "]" for c in firsts)
    return f" (?={start})(?:{'|'.join(map(re.escape, ends))})(?<={whole})"


def delete_phrases(text: Column | str, phrases: Iterable[str]) -> Column:
    """Delete literal phrases in order, also inside longer words."""
    phrases = list(phrases)
    if not phrases:
        return _col(text)

    def delete(text: Column, phrase: str) -> Column:
        # to look for a phrase costs less than to replace none
        return let(text, lambda t: F.when(t.contains(phrase), F.replace(t, F.lit(phrase), F.lit(""))).otherwise(t))

    # one search tells which texts have none of them and stay as they are
    return let(_col(text), lambda t: F.when(t.rlike(_any_phrase(phrases)), reduce(delete, phrases, t)).otherwise(t))


def delete_numbers(text: Column | str) -> Column:
    """Delete digit runs that stand alone as words."""
    # a digit first, then what stands before it: most characters fail at once
    pattern = rf"\p{{Nd}}(?<![{WORD}]\p{{Nd}})\p{{Nd}}*+(?![{WORD}])"
    return F.regexp_replace(_col(text), pattern, "")


def is_one_of(c: Column | str, values: Iterable[str]) -> Column:
    return _col(c).isin(sorted(set(values)))

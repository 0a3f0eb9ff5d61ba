"""Column functions on text: tokens, stems, set similarities, digests, folds, lines and renderings. Built-in functions, but for `tokens_of`."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that define the token rules.
WORD = r"[A-Za-z0-9_]+(?:[.-][A-Za-z0-9_]+)*"
SEPARATOR = r"[._-]"
CAMEL_PART = r"[A-Z]+[0-9]*(?![a-z])|[A-Z]?[a-z]+[0-9]*|[0-9]+"
PLURALS = (("ies", "y"), ("es", ""), ("s", ""))
SHORTEST_PLURAL = 5


def words(text: Column) -> Column:
    """The words of a text, as written."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_tokens(word: Column) -> Column:
    """A word's tokens, lower-cased: the whole, its segments where they differ, and the camel-case parts where there are several.

    Most words are plain and are their own only token; they skip the higher-order functions.
    """
    whole = F.lower(word)
    none = F.array().cast("array<string>")

    def of_segment(s: Column) -> Column:
        parts = F.regexp_extract_all(s, F.lit(CAMEL_PART), F.lit(0))
        return F.concat(F.when(F.lower(s) != whole, F.array(F.lower(s))).otherwise(none), F.when(F.size(parts) > 1, F.transform(parts, F.lower)).otherwise(none))

    segments = F.filter(F.split(word, SEPARATOR), lambda s: s != "")
    split = F.concat(F.array(whole), F.flatten(F.transform(segments, of_segment)))
    return F.when(word.rlike("^[A-Z]?[a-z]+$"), F.array(whole)).otherwise(split)


_SEPARATOR, _CAMEL_PART = re.compile(SEPARATOR), re.compile(CAMEL_PART)


@lru_cache(maxsize=1 << 17)
def tokens_of(word: str) -> tuple[str, ...]:
    """As `word_tokens`, of one word in a batch."""
    whole, found = word.lower(), []
    if word[1:].islower() and word.isalpha():
        return (whole,)
    for segment in filter(None, _SEPARATOR.split(word)):
        parts = _CAMEL_PART.findall(segment)
        found += [segment.lower()] * (segment.lower() != whole) + [p.lower() for p in parts] * (len(parts) > 1)
    return (whole, *found)


def tokens(text: Column) -> Column:
    """All tokens of a text, in order, repeats kept."""
    return F.flatten(F.transform(words(text), word_tokens))


def singular(token: Column) -> Column:
    """The first plural ending that fits gives way, for tokens of five letters or more."""
    out = token
    for ending, instead in reversed(PLURALS):
        fits = (F.length(token) >= SHORTEST_PLURAL) & token.endswith(ending)
        out = F.when(fits, F.concat(F.substring(token, F.lit(1), F.length(token) - len(ending)), F.lit(instead))).otherwise(out)
    return out


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(tokens(text), singular))


def content_stems(text: Column, stopwords: Column) -> Column:
    """Stems of the tokens that are no stopwords; stopwords go before stemming."""
    return F.array_distinct(F.transform(F.filter(tokens(text), lambda t: ~F.array_contains(stopwords, t)), singular))


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two sets; 0 if both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)


def share(found: Column, total: Column) -> Column:
    """The share of `total` that `found` has; 0 if it is empty."""
    n = F.size(F.array_distinct(total))
    return F.when(n > 0, F.size(F.array_intersect(total, found)) / n).otherwise(0.0)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def fold(text: Column, folds: int = 5) -> Column:
    """The first four bytes of the digest, as a number, by the number of folds."""
    return (F.conv(F.substring(digest(text), 1, 8), 16, 10).cast("long") % folds).cast("int")


def lines(text: Column) -> Column:
    """Only a newline ends a line; a carriage return before it goes; an empty text has no lines."""
    body = F.regexp_replace(text, r"\n\z", "")
    cut = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def parent_name(name: Column) -> Column:
    """A dotted name without its last part; null for a name of one part."""
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", ""))


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def version_order(version: Column) -> Column:
    """Version text as an array of numbers, which sorts as versions do."""
    return F.transform(F.split(version, "[.]"), lambda p: p.cast("decimal(38,0)"))


def first_sentence(paragraph: Column) -> Column:
    """Up to the first full stop, question or exclamation mark that white space or the end follows; else the whole."""
    found = F.regexp_extract(paragraph, r"(?s)^(.*?[.!?])(?=\s|$)", 1)
    return F.when(found != "", found).otherwise(paragraph)


def without_comment(line: Column) -> Column:
    return F.regexp_replace(line, r"#.*$", "")


def balance(line: Column, opening: str = "(", closing: str = ")") -> Column:
    """Opening minus closing brackets of a line."""
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    return count(opening) - count(closing)


def counted(n: Column, noun: str) -> Column:
    """`1,234 things`: a number with separators and its noun."""
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, F.lit(noun)).otherwise(F.lit(noun + "s")))


def shortened(text: Column, limit: int = 12) -> Column:
    """The first lines of a text, and an ellipsis where more follow."""
    all_lines = lines(text)
    return F.when(F.size(all_lines) > limit, F.concat(F.array_join(F.slice(all_lines, 1, limit), "\n"), F.lit("\n…"))).otherwise(F.array_join(all_lines, "\n"))


def alias(package: Column, module: Column) -> Column:
    """The import alias: the module's base name in Pascal case, of `main` the package's; `P` if empty, `M` before anything but a letter."""
    base = F.when(F.substring_index(module, "/", -1) == "main", package).otherwise(F.substring_index(module, "/", -1))
    parts = F.filter(F.split(base, "[^A-Za-z0-9]+"), lambda p: p != "")
    pascal = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")
    return F.when(pascal == "", F.lit("P")).when(~pascal.rlike("^[A-Za-z]"), F.concat(F.lit("M"), pascal)).otherwise(pascal)

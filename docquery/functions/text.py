"""Column functions on text that Spark lacks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks put around matches, of the characters that Unicode has for use within a
#: program. replace_matches takes them out of texts, pieces_at spells them.
START, END = "\ufdd0", "\ufdd1"
#: How a text's own marks are spelled, the sign that spells them first.
_SPELLED = {"\ufdd3": "\ufdd3\ufdd4", START: "\ufdd3\ufdd5", END: "\ufdd3\ufdd6"}


def named(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where value is computed once, however often of uses it: a
    column that is put in twice is computed twice within higher-order functions."""
    return F.transform(F.array(value), of)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def flatten_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def mask_line(c: Column) -> Column:
    """A line for comparison: digits become #, white space single spaces."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"\d", "#"), r"(?U)\s+", " ")


def delete_all(c: Column, patterns: Sequence[str]) -> Column:
    """Deletes the matches of each pattern, in this order."""
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), patterns, c)


def unmarked(c: Column) -> Column:
    return F.translate(c, START + END, "")


def spelled(c: Column) -> Column:
    """Without marks, and so that unspelled gives the same text again."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), _SPELLED.items(), c)


def unspelled(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[1]), F.lit(p[0])), reversed(_SPELLED.items()), c)


def replace_matches(c: Column, pattern: str, of: Callable[[Column], Column], group: int = 0) -> Column:
    """Replaces each match by of(the group's text), where SQL's replacement
    strings can't depend on what matched. Matches are marked, the text is split
    at the marks, and each piece starts with its match."""
    marked = F.regexp_replace(unmarked(c), pattern, f"{START}${group}{END}")

    def done(pieces: Column) -> Column:
        replaced = F.transform(
            F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
            lambda p: F.concat(named(F.substring_index(p, END, 1), of), F.substring_index(p, END, -1)),
        )
        return F.concat(F.element_at(pieces, 1), F.array_join(replaced, ""))

    return named(F.split(marked, START), done)


def pieces_at(c: Column, pattern: str, key_group: int) -> Column:
    """Array of (key, body, start) of the stretches that begin at matches of
    pattern: key is the group, body runs from the match to the next one, start
    is its offset. What lies before the first match is left out."""
    marked = F.split(F.regexp_replace(spelled(c), pattern, f"{START}${key_group}{END}$0"), START)
    parts = F.transform(marked, lambda p: F.struct(unspelled(F.substring_index(p, END, 1)).alias("key"), unspelled(F.substring_index(p, END, -1)).alias("body")))

    def found(parts: Column) -> Column:
        starts = F.aggregate(
            parts,
            F.array(F.lit(0)),
            lambda a, p: F.array_append(a, F.element_at(a, -1) + F.length(p["body"])),
        )
        all_ = F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), lambda p, s: F.struct(p["key"].alias("key"), p["body"].alias("body"), s.alias("start")))
        return named(all_, lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))))

    return named(parts, found)


def roman_value(c: Column) -> Column:
    """Value of a Roman numeral of the letters IVXLCDM; null outside 1 to 3999.
    Read from the right, a letter below the greatest so far is subtracted."""
    values = F.transform(F.split(F.reverse(c), ""), lambda x: F.element_at(F.create_map(*(F.lit(v) for p in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000)) for v in p)), x))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    total = F.aggregate(
        values, zero,
        lambda a, v: F.struct((a["total"] + F.when(v < a["top"], -v).otherwise(v)).alias("total"), F.greatest(a["top"], v).alias("top")),
        lambda a: a["total"],
    )
    return F.when((total > 0) & (total < 4000), total)

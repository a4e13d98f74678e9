"""Lines, characters, contexts and places of file contents, as column expressions.

Character positions count code points.  Java's regular expressions run with the
Unicode flag, so that word boundaries and white space mean the same for all
scripts.
"""

from __future__ import annotations

import functools
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import EMOJI_RANGES


def in_ranges(cp: Column, ranges) -> Column:
    """Whether a code point lies in one of the inclusive (first, last) ranges."""
    found = F.lit(False)
    for first, last in ranges:
        found = found | cp.between(first, last)
    return found


def char_class(ranges) -> str:
    """The ranges as a character class of a Java regular expression."""
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def anchor(pattern: str) -> str | None:
    """A literal that every match of the pattern holds, the longest one that stands outside classes; of alternatives in a group their common beginning."""
    plain = re.sub(r"\\[bsdwS][*+]?|\[[^\]]*\][*+]?|\\u\\\{|\\.", " ", pattern)
    plain = re.sub(r"\((?:\?:)?([^()]*)\)", lambda m: f" {os.path.commonprefix(m[1].split('|'))} ", plain)
    return None if "|" in plain else max(re.findall(r"\w{2,}", re.sub(r".[?*{]", " ", plain)), key=len, default=None)


def matches(text: Column, patterns) -> Column:
    """Whether any pattern is found, with Unicode classes; texts without any pattern's literal are told by a plain search."""
    found = text.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))
    literals = [anchor(p) for p in patterns]
    return found if None in literals else functools.reduce(Column.__or__, (text.contains(x) for x in dict.fromkeys(literals))) & found


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, though a lambda of the body names it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def byte_column(text: Column, pattern: str) -> Column:
    """1-based byte offset of the pattern's first match; null without one.  What stands before is only looked for where there is a match."""
    before = F.regexp_extract(text, f"(?Us)^(.*?)(?:{pattern})", 1)
    return F.when(text.rlike(f"(?U){pattern}"), F.octet_length(before) + 1).cast("long")


def line_array(content: Column) -> Column:
    """array<struct<line, text>>: split at U+000A, one U+000D before it removed, no empty last line."""

    def cut(parts: Column) -> Column:
        last = F.size(parts) - 1

        def one(x: Column, i: Column) -> Column:
            text = F.when((i < last) & x.endswith("\r"), F.left(x, F.length(x) - 1)).otherwise(x)
            return F.when((i < last) | (x != ""), F.struct((i + 1).cast("long").alias("line"), text.alias("text")))

        return F.array_compact(F.transform(parts, one))

    return let(F.split(content, "\n", -1), cut)


def lines(files: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """(*keep, line, text) of every line; the content itself is not carried along."""
    return files.select(*keep, F.explode(line_array(F.col("content"))).alias("_l")).select(*keep, "_l.*")


#: Word characters of identifiers, and how many of them are looked at to each side before the whole rest of the line is.
WORD = r"[\p{IsAlphabetic}\p{N}_]"
_NEAR = 64


def _word_around(cells: Column, at: Column) -> Column:
    """The run of word characters that holds the character number ``at`` (from 0)."""
    part = lambda first, n: F.array_join(F.slice(cells, first, n), "")
    head = lambda text: F.regexp_extract(text, f"^({WORD}*)", 1)
    grown = lambda near, far: F.when(F.length(near) < _NEAR, near).otherwise(far)
    begin = F.greatest(at - _NEAR, F.lit(0))
    left = grown(head(F.reverse(part(begin + 1, at - begin))), head(F.reverse(part(F.lit(1), at))))
    right = grown(head(part(at + 2, F.lit(_NEAR))), head(part(at + 2, F.size(cells))))
    return F.concat(F.reverse(left), F.get(cells, at), right)


def chars(line_rows: DataFrame, wanted: str, keep: tuple[str, ...] = ("path", "line"), words: str | None = None) -> DataFrame:
    """(*keep, column, cp, character, before, after, context, word) of the characters in the class ``wanted``, all of them beyond ASCII.

    Lines without such a character are dropped first; in the others only the
    wanted characters become rows, with the few neighbours they need, so that a
    long line is never copied.  ``context`` has 20 characters to each side, with
    ellipses where it is cut; ``word`` is the identifier around a character in the
    class ``words``, else null.
    """
    n = F.size("_chars")

    def hit(c: Column, i: Column) -> Column:
        beside = lambda step: F.ascii(F.get("_chars", i + step))
        first, last = F.greatest(i - 20, F.lit(0)), F.least(i + 20, n)
        context = F.concat(F.when(i > 20, "...").otherwise(""), F.array_join(F.slice("_chars", first + 1, last - first), ""), F.when(i + 20 < n, "...").otherwise(""))
        word = F.when(c.rlike(words), _word_around(F.col("_chars"), i)) if words else F.lit(None).cast("string")
        row = F.struct(
            (i + 1).cast("long").alias("column"), F.ascii(c).cast("long").alias("cp"), c.alias("character"), beside(-1).alias("before"), beside(1).alias("after"), context.alias("context"), word.alias("word")
        )
        return F.when((F.ascii(c) > 127) & c.rlike(wanted), row)

    split = line_rows.where(F.col("text").rlike(wanted)).select(*keep, F.split("text", "").alias("_chars"))
    return split.select(*keep, F.explode(F.array_compact(F.transform("_chars", hit))).alias("_c")).select(*keep, "_c.*")


def beside_emoji() -> Column:
    """Whether the previous or the next character of the line is an emoji."""
    return F.coalesce(in_ranges(F.col("before"), EMOJI_RANGES), F.lit(False)) | F.coalesce(in_ranges(F.col("after"), EMOJI_RANGES), F.lit(False))


def place_of(prefix: Column) -> tuple[Column, Column]:
    """1-based (line, column) that follows ``prefix``; only U+000A ends lines."""
    line = F.regexp_count(prefix, F.lit("\n")) + 1
    return line.cast("long"), (F.length(F.substring_index(prefix, "\n", -1)) + 1).cast("long")


def short_line(text: Column, most: int = 200) -> Column:
    return F.when(F.octet_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)

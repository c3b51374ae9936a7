"""Expressions over recognised text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

CJK = r"^[㐀-鿿]$"
CJK_COMMON = r"^[一-鿿]$"
#: Marks read in place of a bullet, and doubled degree signs with what they stand for.
BULLETS = "：:，,）)·.、;；"
DEGREES = (("°℃", "℃"), ("°°", "°"), ("℃C", "℃"))
TICK = r"^-?\d{1,3}(,\d{3})*(\.\d+)?%?$|^-?\d+(\.\d+)?%?$"


def tick_value(text: Column) -> Column:
    """The number on an axis label, or null. A percent sign is dropped and not applied."""
    t = F.translate(F.replace(F.trim(text), F.lit(" "), F.lit("")), "，−–", ",--")
    return F.when(t.rlike(TICK), F.regexp_replace(t, "[%,]", "").try_cast("double"))


def clean(text: Column) -> Column:
    """Doubled degree signs are mended; leading bullet marks go if more than one character follows."""
    fixed = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), DEGREES, text)
    bare = F.regexp_replace(fixed, f"^[{BULLETS}]+", "")
    return F.when((F.length(bare) < F.length(fixed)) & (F.length(bare) > 1), bare).otherwise(fixed)


def is_subsequence(short: Column, long: Column) -> Column:
    """All characters of short occur in long in order."""
    found = lambda at, c: F.call_function("locate", c, long, at)
    end = F.aggregate(chars(short), F.lit(1), lambda at, c: F.when((at == 0) | (found(at, c) == 0), 0).otherwise(found(at, c) + 1))
    return end > 0


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    sizes = F.filter(F.sequence(F.lit(0), n), lambda k: F.left(a, k) == F.left(b, k))
    return F.array_max(sizes)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chars(text: Column) -> Column:
    """The characters of a text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def multiset_difference(text: Column, less: Column) -> Column:
    """The characters of text, sorted, without one for each character of less."""
    one, other = chars(text), chars(less)
    count = lambda array, c: F.size(F.filter(array, lambda x: x == c))
    kept = F.flatten(F.transform(F.array_sort(F.array_distinct(one)), lambda c: F.array_repeat(c, F.greatest(F.lit(0), count(one, c) - count(other, c)))))
    return F.array_join(kept, "")


def word_windows(text: Column, longest: int = 4) -> Column:
    """All substrings of 2 to `longest` characters with their 0-based starts."""
    n = F.length(text)
    each = F.transform(F.sequence(F.lit(2), F.lit(longest)), lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda a: F.struct(a.alias("start"), k.alias("size"), F.substring(text, a + 1, k).alias("part")))))
    return F.flatten(F.filter(each, lambda x: x.isNotNull()))


def char_weight(c: Column) -> Column:
    """Width of a character against a full one."""
    return F.when(F.ascii(c) > 255, 1.0).when(c.rlike(r"^\s$"), 0.28).when(c.rlike(r"^[\p{L}\p{N}]$"), 0.55).otherwise(0.48)


def joins_with_space(before: Column, after: Column) -> Column:
    """A space goes between two words only if both neighbouring characters are ASCII."""
    ascii_char = lambda c: (F.ascii(c) < 128) & (F.length(c) > 0)
    return ascii_char(F.right(before, F.lit(1))) & ascii_char(F.left(after, F.lit(1))) & ~F.right(before, F.lit(1)).rlike(r"^\s$")


def short_tall_mixed(text: Column, w: Column, h: Column) -> Column:
    """A line of up to three characters with a Latin letter, taller than wide: vertical text that was read across."""
    t = F.trim(text)
    return F.length(t).between(1, 3) & (h > w * 1.2) & (h > 60) & F.rlike(t, F.lit("[A-Za-z]"))


def icon_like_character(text: Column, w: Column, h: Column, score: Column, least: float = 0.9) -> Column:
    """A single tall CJK character of low score: rather an icon than text."""
    return F.rlike(F.trim(text), F.lit("^[\\u3400-\\u9fff]$")) & (h > w * 1.2) & (h > 60) & (score < least)

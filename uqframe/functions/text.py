"""Column helpers for strings and for numbers as they are printed in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from uqframe.functions import vectors as V

MINUS = "−"


def strip(text: Column) -> Column:
    """White space, Unicode's too, off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squash(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def without_urls(text: Column) -> Column:
    return squash(F.regexp_replace(text, r"https?://\S+|www\.\S+", " "))


def fixed(x: Column, places: int, plus: bool = False) -> Column:
    """``places`` decimals of the exact binary value, half to even; a Unicode minus, never a negative zero; n/a for none.

    Java's own formatting rounds the shortest decimal form half up, so the value is rounded exactly first.
    """
    none = "0." + "0" * places if places else "0"

    def signed(v: Column, shown: Column) -> Column:
        sign = F.when((v < 0) & (shown != none), MINUS).when(F.lit(plus) & (shown != none) & (v > 0), "+").otherwise("")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "n/a").otherwise(F.concat(sign, shown))

    # named once, a value is computed once, and the code of long reports stays small
    return V.let(x, lambda v: V.let(F.format_string(f"%.{places}f", F.abs(_half_even(v, places))), lambda shown: signed(v, shown)))


def _half_even(x: Column, places: int) -> Column:
    """``x`` rounded by its exact binary value. The size is cut into a high part of 26 bits and the rest, so the distance from
    the middle between two neighbours is computed without error. Sizes beyond 2^53 / (2 * 10^places), 4.5e11 for four
    decimals, are rounded by their shortest decimal form."""
    double = 2.0 * 10**places

    def of(v: Column, size: Column, below: Column) -> Column:
        scaled = size * F.lit(134217729.0)
        high = scaled - (scaled - size)
        off = (high * double - (2.0 * below + 1.0)) + (size - high) * double
        up = V.let(off, lambda d: F.when((d > 0) | ((d == 0) & (below % 2 == 1)), 1.0).otherwise(0.0))
        rounded = F.when(size < 2.0**53 / double, (below + up) / F.lit(10.0**places)).otherwise(F.bround(size.cast("decimal(38,10)"), min(places, 10)).cast("double"))
        return V.let(rounded, lambda r: F.when(v < 0, -r).otherwise(r))

    return V.let(x, lambda v: V.let(F.abs(v), lambda size: V.let(F.floor(size * F.lit(10.0**places)).cast("double"), lambda below: of(v, size, below))))


def fmt_metric(x: Column) -> Column:
    return fixed(x, 4)


def fmt_ci(lo: Column, hi: Column, places: int = 4) -> Column:
    return F.concat(F.lit("["), fixed(lo, places), F.lit(", "), fixed(hi, places), F.lit("]"))


def fmt_metric_ci(x: Column, lo: Column, hi: Column) -> Column:
    return F.concat(fmt_metric(x), F.lit(" "), fmt_ci(lo, hi))


def fmt_pp(x: Column) -> Column:
    """A difference in percentage points, always with its sign."""
    return fixed(x * 100.0, 2, plus=True)


def fmt_pp_ci(x: Column, lo: Column, hi: Column) -> Column:
    return F.concat(fmt_pp(x), F.lit(" "), fmt_ci(lo * 100.0, hi * 100.0, 2))


def fmt_p(p: Column) -> Column:
    """Three significant digits; below 0.001 only that."""
    out = fixed(p, 2)
    for exponent, places in ((-1, 3), (-2, 4), (-3, 5)):  # a carry into the next digit drops a place
        here = p < 10.0 ** (exponent + 1)
        carried = _half_even(p, places) >= 10.0 ** (exponent + 1)
        out = F.when(here, F.when(carried, fixed(p, places - 1)).otherwise(fixed(p, places))).otherwise(out)
    return F.when(p.isNull() | F.isnan(p), "n/a").when(p < 0.001, "< 0.001").otherwise(out)


def p_phrase(p: Column, label: str = "p") -> Column:
    shown = fmt_p(p)
    return F.when(shown.startswith("<"), F.concat(F.lit(label + " "), shown)).otherwise(F.concat(F.lit(label + " = "), shown))


def fmt_temp(x: Column) -> Column:
    return fixed(x, 2)


def fmt_cov(x: Column) -> Column:
    return fixed(x, 3)


def fmt_aurc(x: Column) -> Column:
    """A hundred times the area, with two decimals."""
    return fixed(x * 100.0, 2)


def markdown_row(cells: list[Column]) -> Column:
    """One line of a Markdown table; bars in cells are escaped, line ends become spaces, nulls are empty."""
    own = [F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "[\r\n]+", " ") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *own), F.lit(" |"))


def fmt_int(x: Column) -> Column:
    return F.when(x.isNull(), "n/a").otherwise(F.format_number(x, 0))


def compare_formatted(a: Column, b: Column, shown_a: Column, shown_b: Column) -> Column:
    """-1, 0 or 1 as a is below, equal to or above b; 0 if both print the same."""
    return F.when(shown_a == shown_b, 0).when(a > b, 1).otherwise(-1)


def join_english(items: Column) -> Column:
    """"a", "a and b", "a, b, and c"."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.get(items, 0)).when(n == 2, F.concat(F.get(items, 0), F.lit(" and "), F.get(items, 1))).otherwise(F.concat(head, F.lit(", and "), F.get(items, n - 1)))


def clean_list(text: Column, separator: str = r"\|") -> Column:
    """Parts of a separated list without empty ones, each once, in order."""
    return F.array_distinct(F.filter(F.split(text, separator), lambda x: x != ""))


def slash_path(path: Column, prefix: str) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^" + prefix, "")


#: Fixed words of small numbers, and abbreviations after which no sentence ends.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
ABBREVIATIONS = (r"\bvs\.", r"\bal\.", r"e\.g\.", r"i\.e\.", r"\bcf\.", r"\bFig\.")


def number_word(n: Column) -> Column:
    """Zero to nine in words, other whole numbers with thousands separators."""
    words = F.array(*[F.lit(w) for w in NUMBER_WORDS])
    return F.when(n.between(0, len(NUMBER_WORDS) - 1), F.get(words, n.cast("int"))).otherwise(fmt_int(n))


def sign4(x: Column) -> Column:
    """Four decimals behind a plus or a true minus; zero has a plus."""
    return F.concat(F.when(x >= 0, "+").otherwise(MINUS), fixed(F.abs(x), 4))


def sentences(text: Column) -> Column:
    """Parts of a text, cut after . ! ? before a capital letter, a bracket or a quotation mark, but not after an abbreviation."""
    not_after = "".join(f"(?<!{a})" for a in ABBREVIATIONS)
    return F.split(text, rf'(?<=[.!?]){not_after}\s+(?=[A-Z("“])')


def tag_parts(tag: Column) -> Column:
    """image and text of a tag ``image__text``; null if it hasn't exactly two parts that aren't empty."""
    parts = F.split(tag, "__")
    return F.when((F.size(parts) == 2) & ~F.array_contains(parts, ""), F.struct(F.get(parts, 0).alias("image"), F.get(parts, 1).alias("text")))


def listed_tags(text: Column) -> Column:
    """The tags of a list with commas: trimmed, each once, in order, empty ones left out."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def in_order(text: Column, order: tuple[str, ...]) -> Column:
    """Which names of ``order`` a list with commas has, in that order; null for an empty list or an unknown name."""
    asked = listed_tags(text)
    every = F.array(*[F.lit(o) for o in order])
    return F.when((F.size(asked) > 0) & (F.size(F.array_except(asked, every)) == 0), F.filter(every, lambda x: F.array_contains(asked, x)))


def display_name(name: Column, names: dict[str, str]) -> Column:
    """A name as reports show it; one that isn't known stays as it is."""
    out = name
    for a, b in names.items():
        out = F.when(name == a, F.lit(b)).otherwise(out)
    return out

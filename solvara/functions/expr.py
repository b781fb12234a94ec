"""Scalar building blocks: each takes and returns columns, and stays inside Catalyst."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: Column | str, den: Column | str, default: float | None = 0.0) -> Column:
    """``num / den``; a zero or null denominator, or a null numerator, gives ``default``."""
    value = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(float(low))), F.lit(float(high)))


def logistic(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def softplus(x: Column | str) -> Column:
    """log(1 + exp(x)) without overflow."""
    x = col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softmax(values: Column | str) -> Column:
    """Softmax of an array column."""
    values = col(values)
    top = F.array_max(values)
    e = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def normal_tail(x: Column | str) -> Column:
    """The upper tail of the standard normal distribution, off by less than 1e-14 and less than 1e-4 of itself."""
    x = col(x)
    a = F.abs(x)
    # fixed values: rational approximation of Hart as published by West (2005)
    up = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    down = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
    top, bottom, far = F.lit(up[0]), F.lit(down[0]), a + 0.65
    for c in up[1:]:
        top = top * a + c
    for c in down[1:]:
        bottom = bottom * a + c
    for k in (4.0, 3.0, 2.0, 1.0):
        far = a + k / far
    density = F.exp(-a * a / 2.0)
    tail = F.when(a < 7.07106781186547, density * top / bottom).otherwise(density / far / 2.5066282746310002)
    return F.when(x >= 0, tail).otherwise(1.0 - tail)


def normal_cdf(x: Column | str) -> Column:
    """Standard normal distribution function."""
    return normal_tail(-col(x))


def chi2_tail(x: Column | str, df: int) -> Column:
    """The upper tail of the chi-squared distribution with a whole number of degrees (finite sums)."""
    x = F.greatest(col(x), F.lit(0.0))
    half, total = x / 2.0, F.lit(0.0)
    if df % 2 == 0:
        term = F.exp(-half)
        for k in range(df // 2):
            total = total + term
            term = term * half / (k + 1.0)
        return total
    term = F.sqrt(half) * F.exp(-half) / math.gamma(1.5)
    for k in range(1, (df - 1) // 2 + 1):
        total = total + term
        term = term * half / (k + 0.5)
    return 2.0 * normal_tail(F.sqrt(x)) + total


def ks_tail(gap: Column | str, root: Column) -> Column:
    """The asymptotic p-value of a two-sample gap; ``root`` is the root of n * m / (n + m)."""
    x = root * col(gap)
    total = F.lit(0.0)
    for k in range(1, 101):
        total = total + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * x * x)
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def parse_timestamp(x: Column | str, formats: Sequence[str] | Mapping[str, str]) -> Column:
    """The first format that fits, else null; a leading weekday name is taken off.

    A mapping gives a pattern for each format; the format is only tried on texts that fit it.
    """
    text = F.regexp_replace(F.trim(col(x)), r"^[A-Za-z]{3},\s*", "")
    tried = {f: F.try_to_timestamp(text, F.lit(f)) for f in formats}
    return F.coalesce(*[F.when(text.rlike(formats[f]), t) if isinstance(formats, Mapping) else t for f, t in tried.items()])


_WHOLE = r"^[\x00-\x20\x7F]*[+-]?[0-9]+[\x00-\x20\x7F]*$"
_DECIMAL = r"^[\x00-\x20]*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[fFdD]?|0[xX][0-9a-fA-F.]+[pP][+-]?[0-9]+[fFdD]?|(?i:nan|inf|infinity))[\x00-\x20]*$"
#: What a text must look like to be a number of a type; every text that the cast takes does.
NUMBER_PATTERNS = {"tinyint": _WHOLE, "smallint": _WHOLE, "int": _WHOLE, "bigint": _WHOLE, "float": _DECIMAL, "double": _DECIMAL}


def tried(text: Column | str, kind: str) -> Column:
    """A text tried as a type, null where it does not fit.

    Numbers are only tried on texts that look like one: a failed try costs an exception, many times the rest.
    """
    text = col(text)
    made = text.try_cast(kind)
    return F.when(text.rlike(NUMBER_PATTERNS[kind]), made) if kind in NUMBER_PATTERNS else made


def word_count(x: Column | str) -> Column:
    """Words between white space; 0 for null and blank texts."""
    text = F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\s+", " "))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def word_pattern(words: Sequence[str]) -> str:
    """A pattern for any of some whole words, ignoring case; letters, digits and _ of all scripts are parts of words."""
    return r"(?iu)(?<![\pL\pN_])(?:" + "|".join(words) + r")(?![\pL\pN_])"


def title_and_summary(title: Column | str, summary: Column | str) -> Column:
    """Title and summary as one text; a missing summary, "nan" or a repeated title adds nothing."""
    t, s = F.trim(col(title)), F.trim(F.coalesce(col(summary), F.lit("")))
    return F.when((s == "") | (F.lower(s) == "nan") | (F.lower(s) == F.lower(t)), t).otherwise(F.concat_ws(". ", t, s))


def name_ticker(name: Column | str) -> Column:
    """A stand-in ticker: the letters of a name's first word, upper case, if there are two or more."""
    letters = F.upper(F.regexp_replace(F.split(F.trim(col(name)), " ")[0], "[^A-Za-z]", ""))
    return F.when(F.length(letters) >= 2, letters)


def valid_ticker(x: Column | str, longest: int = 7) -> Column:
    return col(x).rlike(r"^[A-Za-z0-9.\-]+$") & (F.length(col(x)) <= longest)


def ladder(x: Column | str, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """The name of the first step whose bound ``x`` reaches, from the highest down; else ``last``."""
    x, out = col(x), None
    for bound, name in steps:
        out = F.when(x >= bound, name) if out is None else out.when(x >= bound, name)
    return out.otherwise(last)


def ranges(x: Column | str, bands: Sequence[tuple[int, int, str]], default: str) -> Column:
    """The name of the closed range that holds ``x``."""
    x, out = col(x), None
    for low, high, name in bands:
        out = F.when(x.between(low, high), name) if out is None else out.when(x.between(low, high), name)
    return out.otherwise(default)


#: Divisions of the Standard Industrial Classification.
SIC_DIVISIONS = (
    (100, 999, "Agriculture"),
    (1000, 1499, "Mining"),
    (1500, 1799, "Construction"),
    (2000, 3999, "Manufacturing"),
    (4000, 4999, "Transport and utilities"),
    (5000, 5199, "Wholesale"),
    (5200, 5999, "Retail"),
    (6000, 6799, "Finance"),
    (7000, 8999, "Services"),
    (9100, 9729, "Public administration"),
)


def sic_division(code: Column | str) -> Column:
    return ranges(code, SIC_DIVISIONS, "Other")


def phrase_any(text: Column | str, phrases: Sequence[str]) -> Column:
    """Whether any phrase stands in the lower-case text."""
    return F.lower(F.coalesce(col(text), F.lit(""))).rlike("|".join(re.escape(p) for p in phrases))


def money(x: Column | str) -> Column:
    """An amount as text in B, M or K, with its sign."""
    x = col(x).cast("double")
    a, sign = F.abs(x), F.when(x < 0, "-").otherwise("")
    scaled = lambda by, unit: F.concat(sign, F.lit("$"), F.format_number(a / by, 2), F.lit(unit))
    return F.when(a >= 1e9, scaled(1e9, "B")).when(a >= 1e6, scaled(1e6, "M")).when(a >= 1e3, scaled(1e3, "K")).otherwise(scaled(1.0, ""))


def inflation_level(x: Column | str, rule: str = "base") -> Column:
    """An index level from a value that may be a yearly rate in percent.

    base: rates up to 25 scale a base index of 236.468; signed: from -50 to 25; linear: 200 + 15 x.
    """
    x = col(x).cast("double")
    level = 236.468 * (1.0 + x / 100.0)
    if rule == "base":
        return F.when(x <= 25, level).otherwise(x)
    if rule == "signed":
        return F.when(x.between(-50, 25), level).otherwise(x)
    return x * 15.0 + 200.0


def _alternation(patterns: Sequence[str]) -> str:
    """One regular expression for any of the patterns.  Those that begin with a word boundary and a letter share the
    boundary and their first letter, so that most places of a text are passed over after one look."""
    by: dict[str, list[str]] = {}
    rest = []
    for p in patterns:
        plain = re.match(r"\\b([a-z])(?![?*+{])(?!.*\\Q)", p)
        depth = other = 0
        for token in re.findall(r"\\.|\[(?:\\.|[^\]])*\]|[()|]", p):
            depth += (token == "(") - (token == ")")
            other += token == "|" and depth == 0
        if plain and not other:
            by.setdefault(plain[1], []).append(p[3:])
        else:
            rest.append(p)
    shared = [rf"\b(?:{'|'.join(f'{letter}(?:' + '|'.join(found) + ')' for letter, found in by.items())})"] if by else []
    return "(?:" + "|".join(shared + rest) + ")"


def intensity(text: Column | str, patterns: Mapping[str, float]) -> Column:
    """The largest weight among the regular expressions found in the text, ignoring case; else 0.

    One alternation of all patterns decides first whether any of them is there, which most texts end
    with; then patterns of one weight are tried together, from the heaviest down, to the first hit.
    """
    by: dict[float, list[str]] = {}
    for pattern, weight in patterns.items():
        by.setdefault(weight, []).append(pattern)
    text, out = F.coalesce(col(text), F.lit("")), None
    any_of = lambda found: text.rlike("(?i)" + _alternation(found))
    weights = sorted(by, reverse=True)
    for weight in weights[:-1]:
        out = F.when(any_of(by[weight]), F.lit(weight)) if out is None else out.when(any_of(by[weight]), F.lit(weight))
    last = F.lit(weights[-1])
    return F.when(any_of(list(patterns)), last if out is None else out.otherwise(last)).otherwise(0.0)

"""Unicode-safe text columns: blank tests, stripping, tokens, scripts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}\p{M}_]+)"
#: White space as Python strips it, for Java's regular expressions.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white space alone."""
    return text.isNull() | (stripped(text) == "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits, marks and underscores; null counts as empty. Text must be NFKC already."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def normalized(df: DataFrame, column: str, form: str = "NFKC") -> DataFrame:
    """``df`` with a column in a Unicode normal form, in Arrow batches: Spark has no such function. Only texts beyond ASCII travel."""

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: x if x is None else unicodedata.normalize(form, x))

    wide = F.when(F.col(column).rlike(r"[^\x00-\x7F]"), F.col(column))
    return df.withColumn(column, F.coalesce(apply(wide), F.col(column)))


def script(text: Column) -> Column:
    """LATIN, DEVANAGARI or TAMIL if letters of that script alone occur, MIXED for several, else UNKNOWN."""
    found = [text.rlike(p) for p in ("[A-Za-z]", "[ऀ-ॿ]", "[஀-௿]")]
    n = sum((f.cast("int") for f in found[1:]), found[0].cast("int"))
    ladder = F.when(n > 1, "MIXED").when(found[0], "LATIN").when(found[1], "DEVANAGARI").when(found[2], "TAMIL")
    return F.when(text.isNull(), "UNKNOWN").otherwise(ladder.otherwise("UNKNOWN"))


def number(value: Column) -> Column:
    """A double as Python prints it: the fewest digits that give it back, between 1e-04 and 1e+16 plain, else with an exponent.

    Java's own text has a digit too many for some numbers, so one and 15 to 17 digits are tried first.
    """
    tried = [F.translate(F.format_string(f"%.{n - 1}e", value), "e+", "E") for n in (1, 15, 16, 17)]
    text = F.coalesce(*(F.when(x.try_cast("double") == value, x) for x in tried), value.cast("string"))
    part = lambda k: F.regexp_extract(text, r"^-?(\d+)(?:\.(\d+))?(?:E(-?\d+))?$", k)
    sign = F.when(text.startswith("-"), "-").otherwise("")
    both = F.concat(part(1), part(2))
    head = F.regexp_replace(both, "^0+", "")
    digits = F.regexp_replace(head, "0+$", "")
    n = F.length(digits)
    point = F.length(part(1)) + F.coalesce(part(3).try_cast("int"), F.lit(0)) - (F.length(both) - F.length(head))
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(n <= point, F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(".0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    )
    power = point - 1
    short = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    shown = F.when(n == 0, "0.0").when(power.between(-4, 15), plain).otherwise(short)
    return F.when(F.isnan(value), "NaN").when(F.abs(value) == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, shown))

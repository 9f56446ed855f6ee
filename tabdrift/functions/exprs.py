"""Scalar expressions over cell values, all as columns (no Python at run time)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm15(n: Column) -> Column:
    """A number rounded to 15 significant digits; zeros are one, tiny and non-finite numbers stay as they are."""
    size = F.abs(n)
    scale = F.pow(F.lit(10.0), F.lit(14.0) - F.floor(F.log10(size)))
    plain = n.isNull() | F.isnan(n) | (size < 1e-290) | (size > 1e290)
    return F.when(n == 0, F.lit(0.0)).when(plain, n).otherwise(F.round(n * scale) / scale)


def same_number(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b) | norm15(a).eqNullSafe(norm15(b))


def letters(col: Column) -> Column:
    """Column name in bijective base 26 of a zero-based index below 18,278."""
    n = col + 1
    one = lambda x: F.char((x % 26 + 65).cast("int"))
    last = one(n - 1)
    middle = one(F.floor((n - 27) / 26))
    first = one(F.floor((n - 703) / 676))
    return F.when(n <= 26, last).when(n <= 702, F.concat(middle, last)).otherwise(F.concat(first, middle, last))


def a1(row: Column, col: Column) -> Column:
    return F.concat(letters(col), (row + 1).cast("string"))


def normal_text(text: Column) -> Column:
    """LF line ends, no blanks at line ends, one final line end."""
    lf = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    return F.concat(F.regexp_replace(F.regexp_replace(lf, "[ \t]+\n", "\n"), "[ \t\n]+$", ""), F.lit("\n"))


def digest(*values: Column) -> Column:
    """128-bit signature of values in order; null differs from the empty text."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(v.cast("string"), F.lit("\x00")) for v in values]))

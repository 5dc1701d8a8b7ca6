"""Text scalars with Python ``str`` semantics, as native Spark expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points for which Python's str.isspace() is true; str.strip() removes
# exactly these from both ends (Spark's trim() alone would only remove the blank).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")

# Tokens that make a text field count as missing when combining fields.
MISSING_TEXT_TOKENS = ("nan", "none", "")

# Separator used to join text fields.
TEXT_FIELD_SEPARATOR = ". "


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace from both ends."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def clean_text(c) -> Column:
    """lower + strip; a non-string (NULL) gives ''."""
    return F.coalesce(py_strip(F.lower(_c(c))), F.lit(""))


def text_field(c) -> Column:
    """One field for combining: stripped, or NULL when missing / 'nan' / 'none' / blank."""
    s = py_strip(_c(c).cast("string"))
    # the length test comes first so a long body is never lower-cased just to compare it
    longest = max(len(t) for t in MISSING_TEXT_TOKENS)
    missing = (F.length(s) <= longest) & F.lower(s).isin(*MISSING_TEXT_TOKENS)
    return F.when(missing, F.lit(None).cast("string")).otherwise(s)


def combine_text(*cols) -> Column:
    """Join the usable fields with '. '; no usable field gives ''."""
    return F.concat_ws(TEXT_FIELD_SEPARATOR, *[text_field(c) for c in cols])


def is_blank(c) -> Column:
    return py_strip(_c(c)) == F.lit("")


def parse_published_at(c) -> Column:
    """Lenient timestamp parse (no time zone); anything unparsable becomes NULL.

    Every row is parsed on its own (date, date-time, fractional seconds, 'T' separator), so the
    surviving rows do not depend on which format the first row had.
    """
    return py_strip(_c(c)).try_cast("timestamp_ntz")


def normalize_category(c) -> Column:
    """string, lower, strip ('' is a legal class)."""
    return py_strip(F.lower(_c(c).cast("string")))

"""Small text and hashing helpers, all native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that Python's str.strip() removes, as text and as a regex class body.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def strip_text(c: Column) -> Column:
    """Python's strip(): blanks of every script, not only U+0020."""
    return F.btrim(c, F.lit(SPACES))


def split_words(c: Column) -> Column:
    """Python's split() without arguments: no empty words.

    The blanks of SPACE_CLASS, written as Java's Unicode blanks and four control characters: these are
    told by the kind of a character, and the pattern, which is compiled for each text, is short.
    """
    return F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def hash_pick(n: Column, *parts) -> Column:
    """A repeatable choice in 0..n-1 from the md5 of `parts`; null when n is 0."""
    key = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    value = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return F.try_mod(value, n.cast("bigint"))


def normalise_prediction(c: Column) -> Column:
    """Line ends become blanks, then lower case and strip."""
    flat = F.replace(F.replace(c, F.lit("\n\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    return strip_text(F.lower(flat))

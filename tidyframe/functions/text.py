"""Text functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The characters that count as white space.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_whitespace(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def lowercase(c: Column) -> Column:
    return F.lower(strip_whitespace(c))


def uppercase(c: Column) -> Column:
    return F.upper(strip_whitespace(c))


def _capital(t: Column) -> Column:
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


def capitalize(c: Column) -> Column:
    """Stripped, first character upper, the rest lower."""
    return _capital(F.lower(strip_whitespace(c)))


def title_case(c: Column) -> Column:
    """Stripped; a letter is upper if no letter stands before it, else lower."""
    runs = F.regexp_extract_all(F.lower(strip_whitespace(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, _capital), "")


def text_length(c: Column) -> Column:
    return F.char_length(c.cast("string")).cast("bigint")


def java_replacement(text: str) -> str:
    r"""A replacement written with \1 or \g<1>, as Java's with $1."""
    out, i = [], 0
    while i < len(text):
        m = re.compile(r"\\(\d)|\\g<(\d+)>").match(text, i)
        if m:
            out.append(f"${m[1] or m[2]}")
            i = m.end()
        elif text.startswith("\\\\", i):
            out.append("\\\\")
            i += 2
        else:
            out.append("\\" + text[i] if text[i] in "$\\" else text[i])
            i += 1
    return "".join(out)


def replace_text(c: Column, find: str, replacement: str, regex: bool = False) -> Column:
    return F.regexp_replace(c, find, java_replacement(replacement)) if regex else F.replace(c, F.lit(find), F.lit(replacement))


def split_text(c: Column, delimiter: str, max_splits: int = -1, regex: bool = False) -> Column:
    """Array of parts; max_splits n > 0 gives n + 1 parts at most."""
    return F.split(c, delimiter if regex else "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", max_splits + 1 if max_splits > 0 else -1)

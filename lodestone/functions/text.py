"""Text expressions: snippets, clean-up of extracted text, the normaliser in front of WordPiece."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Code point ranges of CJK ideographs that get spaces around them.
CJK = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{2B820}-\\x{2CEAF}\\x{F900}-\\x{FAFF}\\x{2F800}-\\x{2FA1F}"


def snippet(content: Column, runes: int = 150) -> Column:
    """White space collapsed and trimmed, cut to `runes` code points with '...' where it is longer."""
    flat = F.trim(F.regexp_replace(content, r"(?U)\s+", " "))
    return F.when(F.char_length(flat) > runes, F.concat(F.substring(flat, 1, runes), F.lit("..."))).otherwise(flat)


def label(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def line_breaks(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def clean_extracted(text: Column) -> Column:
    """Spaces and tabs off the end of each line; runs of empty lines become one."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.rtrim(x, F.lit(" \t")))
    # each line with the one before it: an empty line after an empty one goes
    before = F.concat(F.array(F.lit("x")), F.slice(lines, F.lit(1), F.size(lines) - 1))
    pairs = F.zip_with(lines, before, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.filter(pairs, lambda p: (p["a"] != "") | (p["b"] != ""))
    return F.array_join(F.transform(kept, lambda p: p["a"]), "\n")


def page_marked(page: Column, text: Column) -> Column:
    return F.concat(F.lit("--- page "), page.cast("string"), F.lit(" ---\n"), clean_extracted(text), F.lit("\n"))


def space_out_cjk(text: Column) -> Column:
    return F.regexp_replace(text, f"([{CJK}])", " $1 ")


def clean_text(text: Column) -> Column:
    """Control characters but tab, LF and CR, NUL and U+FFFD dropped; each white-space character one space."""
    return F.regexp_replace(F.regexp_replace(text, "[\\p{Cc}\\x{FFFD}&&[^\t\n\r]]", ""), "[\t\n\r\\p{Zs}]", " ")


def pre_tokens(text: Column) -> Column:
    """Words and single punctuation characters."""
    spaced = F.regexp_replace(text, "([!-/:-@\\[-`{-~\\p{P}])", " $1 ")
    return F.filter(F.split(spaced, " "), lambda x: x != "")


@F.pandas_udf(T.StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def file_uri(path: Column) -> Column:
    """file:// and the path, percent-encoded but for letters, digits, / - _ . ~ and $ & + , : ; = @, which a path may hold."""
    out = F.url_encode(path)
    for code, char in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"), ("*", "%2A")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.concat(F.lit("file://"), out)


def elapsed(seconds: Column) -> Column:
    """'12.3s' under a minute, else '2m05s'."""
    whole = F.floor(seconds).cast("long")
    return F.when(seconds < 60, F.format_string("%4.1fs", seconds.cast("double"))).otherwise(F.format_string("%dm%02ds", F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60)).cast("long")))


def hyperlink(path: Column, shown: Column) -> Column:
    """The text as a terminal link (OSC 8) to the file."""
    return F.concat(F.lit("\x1b]8;;"), file_uri(path), F.lit("\x1b\\"), shown, F.lit("\x1b]8;;\x1b\\"))

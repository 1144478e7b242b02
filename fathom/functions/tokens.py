"""The indicator-preserving tokenizer as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as an indicator, in this order, and the longest word.
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
INDICATORS = (
    rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}(?:/(?:3[0-2]|[12]\d|[0-9])(?!\d))?",
    r"(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}",
    r"CVE-\d{4}-\d{4,7}",
    r"MS\d{2}-\d{3,4}",
    r"T\d{4}(?:\.\d{3})?",
    r"[0-9a-fA-F]{64}",
    r"[0-9a-fA-F]{40}",
    r"[0-9a-fA-F]{32}",
    r"(?:[A-Za-z0-9\-]+\.)+(?:com|net|org|io|gov|edu|mil|int|ru|cn|uk|de|fr|jp|info|biz|co)",
)
LONGEST = 64
PATTERN = "(?i)(" + "|".join(INDICATORS) + ")"
#: The same for engines without look-ahead.
PORTABLE = PATTERN.replace(r"(?!\d)", r"\b")

_DOMAIN = INDICATORS[-1].replace(r"-]+\.", r"-]++\.")
_HEX = r"[0-9a-fA-F]{32}(?:[0-9a-fA-F]{8}(?:[0-9a-fA-F]{24})?)?"
#: The same matches in linear time. A domain can begin only where a run of its characters does or where the last match
#: ended, as anywhere else it would have begun a character earlier; labels hold no dot, so they need no backing off; the
#: three lengths of hashes are one, each made longer where it can be. The first test is of two characters alone.
FAST = rf"(?i:(?=\d|[cmt][vsd\d]|[0-9a-f]{{2}})(?:{'|'.join(INDICATORS[:5])}|{_HEX})|(?:\G|(?<![A-Za-z0-9\-])){_DOMAIN})"
#: A run of up to 31 letters in which no indicator can begin: what follows is no part of one, and the shortest hash has 32.
PLAIN = r"\p{L}{1,31}+(?![\p{L}\p{N}_:\-]|\.[A-Za-z0-9\-])"
#: A plain run, an indicator, or a run of letters, digits and underscores up to the next indicator.
TOKEN = rf"{PLAIN}|{FAST}|(?:(?!{FAST})[\p{{L}}\p{{N}}_])+"


@F.pandas_udf(StringType())
def normal_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, which takes ligatures apart and wide forms to plain ones."""
    for s in batches:
        yield s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def indicators(text: Column) -> Column:
    """Indicators in order of appearance, lower-cased, repeats included."""
    found = F.regexp_extract_all(text, F.lit(f"{PLAIN}|({FAST})"), 1)
    return F.transform(F.filter(found, lambda x: x != ""), F.lower)


def words(prose: Column) -> Column:
    """Runs of 2 to LONGEST letters, digits and underscores, lower-cased."""
    return F.transform(F.filter(F.split(prose, r"[^\p{L}\p{N}_]+"), lambda w: F.length(w).between(2, LONGEST)), F.lower)


def _steady_ranges() -> list[tuple[int, int]]:
    """Ranges of characters that NFKC keeps, whatever stands beside them: none that it replaces, and none that joins with what stands before."""
    joins = {int(d.split()[1], 16) for c in range(sys.maxunicode + 1) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    joins |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # fixed values: vowels and finals of Hangul syllables
    kept = lambda c: c not in joins and not 0xD800 <= c < 0xE000 and not unicodedata.combining(chr(c)) and unicodedata.normalize("NFKC", chr(c)) == chr(c)
    ranges: list[list[int]] = []
    for c in filter(kept, range(sys.maxunicode + 1)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return [(a, b) for a, b in ranges]


@lru_cache(maxsize=1)
def steady() -> str:
    """A pattern of a run of steady characters, of which a text is that is its own normal form.

    Each class is short, as an engine tests its ranges one after the other: Latin-1 first, which it looks up in a table, then
    the wide ranges, which hold most scripts, then the rest."""
    ranges = _steady_ranges()
    latin = "".join(f"\\x{{{c:x}}}" for a, b in ranges for c in range(a, min(b, 255) + 1))
    rest = sorted(((max(a, 256), b) for a, b in ranges if b > 255), key=lambda r: r[0] - r[1])
    classes = ["".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in sorted(rest[i : i + 12])) for i in range(0, len(rest), 12)]
    return f"(?:[{latin}]++|" + "|".join(f"[{c}]++" for c in classes) + ")*+"


def is_odd(text: Column) -> Column:
    """Whether the normal form may change a text. A run that is not given back ends at the first odd character."""
    return ~F.coalesce(text, F.lit("")).rlike(rf"\A{steady()}\z")


def tokenize(text: Column, prose: Column | None = None) -> Column:
    """The bag of tokens of a text: indicators whatever their length, and words of 2 to LONGEST characters, all lower-cased.

    Null has none. One pass: only a domain can be longer than LONGEST, and a word has no dot. Where ``prose`` is given,
    words are those of it, and the text gives indicators alone."""
    if prose is not None:
        return F.concat(indicators(text), words(prose))
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)
    kept = F.filter(found, lambda w: (F.length(w) >= 2) & ((F.length(w) <= LONGEST) | F.contains(w, F.lit("."))))
    return F.transform(kept, F.lower)


def tokenized(df: DataFrame, text: str, name: str, deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with the tokens of a text column, its words in NFKC. ``deal`` may deal the rows anew after the step in
    Python, beyond which Spark does not know how rows lie.

    Texts that the normal form may change, such as those with ligatures or wide forms, pass through Python where they are
    read; of all others Python sees a null. No text is moved but by ``deal``."""
    odd = (F.octet_length(text) != F.length(text)) & is_odd(F.col(text))  # ASCII is its own normal form
    rows = df.withColumn("_prose", normal_form(F.when(odd, F.regexp_replace(F.col(text), FAST, " "))))
    rows = rows if deal is None else deal(rows)
    tokens = F.when(F.col("_prose").isNull(), tokenize(F.col(text))).otherwise(tokenize(F.col(text), F.col("_prose")))
    return rows.withColumn(name, tokens).drop("_prose")

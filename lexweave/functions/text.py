"""Text scalar functions as Column expressions. Null in gives null out unless a function says otherwise.

White space means Unicode white space, as (?U) makes it. Patterns avoid look-behind where a plain rewrite exists.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ENDS = r"(?U)^\s+|\s+$"
# White space beyond ASCII's, and the separators FS to US that count as white space too.
WIDE = "\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, ENDS, "")


def normalize(c: Column) -> Column:
    """Extracted text: no soft hyphens, plain spaces, LF ends, words joined over line-end hyphens, blanks squeezed."""
    c = F.translate(c, " ­", " ")
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, r"(?U)(?<=\w)-\n(?=\w)", "")
    c = F.regexp_replace(c, "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def line(c: Column) -> Column:
    """All white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(c, WIDE, " " * len(WIDE)), "[ \t\n\x0b\f\r]+", " "))


def display(c: Column) -> Column:
    """line() with null as ''."""
    return F.coalesce(line(c), F.lit(""))


def _compatible() -> tuple[str, str]:
    """By rule: the characters of the basic plane whose compatibility form is one other character, and these forms."""
    pairs = [(ch, unicodedata.normalize("NFKC", ch)) for ch in map(chr, range(0xA0, 0xFFF0)) if not 0xD800 <= ord(ch) < 0xE000]
    pairs = [(x, y) for x, y in pairs if len(y) == 1 and x != y and x not in WIDE]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


_FORMS = _compatible()
# Characters whose form is longer than one, of those that European text has: expanded in the JVM.
LONGER = "\u2026\ufb00\ufb01\ufb02\ufb03\ufb04\ufb05\ufb06\u00bc\u00bd\u00be\u2116\u2122\u2025\u00df"


def canonical(c: Column) -> Column:
    """Compatibility forms (NFKC) in place of ligatures, full-width letters, superscripts and the like, no soft hyphens, white space
    squeezed, lower case; null gives ''. Texts with combining marks or rarer expansions need canonical_nfkc(), which calls Python for them."""
    x = F.translate(c, WIDE + _FORMS[0] + "\u00ad", " " * len(WIDE) + _FORMS[1])  # the soft hyphen has no counterpart, so it goes
    for ch in LONGER:  # x is named once: copies of it would be worked out again
        x = F.replace(x, F.lit(ch), F.lit(unicodedata.normalize("NFKC", ch).casefold()))
    return F.coalesce(F.lower(F.trim(F.regexp_replace(x, "[ \t\n\x0b\f\r]+", " "))), F.lit(""))


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).replace("­", "").split()).casefold())


def canonical_nfkc(c: Column) -> Column:
    """NFKC, case-folded form. Only rows with a non-ASCII character go to Python; the others stay in the JVM."""
    ascii_only = c.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(c.isNull() | ascii_only, canonical(c)).otherwise(_fold(F.when(~ascii_only, c)))


def canonical_dash(c: Column) -> Column:
    """canonical() with dashes and curly apostrophes in ASCII."""
    return F.translate(canonical(c), "–—’", "--'")


def canonical_alnum(c: Column) -> Column:
    """Words of a-z0-9 divided by single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(canonical(F.translate(c, "–—’“”", "--'\"\"")), r"[^a-z0-9\s]", " "), " +", " "))


def tokens(c: Column) -> Column:
    """Distinct runs of a-z0-9 of the canonical form, sorted; null gives []."""
    return F.array_sort(F.array_distinct(F.filter(F.split(canonical(c), "[^a-z0-9]+"), lambda w: w != "")))


def content_hash(c: Column) -> Column:
    return F.sha2(canonical(c), 256)


def json_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with keys in order; nulls are left out of the JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def stable_id(c: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.left(content_hash(c), F.lit(16)))


def safe_name(c: Column, default: str = "unnamed") -> Column:
    """Letters, digits, _ . - only, others as _; no _ at the ends; `default` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def truncate_words(c: Column, n: int = 45) -> Column:
    w = F.split(line(c), " ")
    return F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")).otherwise(c)


def parse_percent(c: Column) -> Column:
    """'12.3%' -> 12.3; null, empty or unreadable -> 0."""
    return F.coalesce(F.trim(F.replace(c, F.lit("%"), F.lit(""))).try_cast("double"), F.lit(0.0))


def display_name(id_: Column, name: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The display name of the first rule whose text occurs in the upper-cased name or id (rules hold in order); else the default."""
    both = F.upper(F.concat_ws(" ", id_, name))
    return first_containing(both, rules, F.lit(default).cast("string"))


def context(*parts: tuple[str, Column]) -> Column:
    """Labelled parts of a text for a model, one after the other; a part without a value is left out."""
    return F.concat_ws(" ", *[F.when(display(c) != "", F.concat(F.lit(f"{name}: "), display(c))) for name, c in parts])


def level(c: Column) -> Column:
    """High, Medium or Low; anything else is Medium."""
    s = F.lower(F.trim(c))
    return F.when(s == "high", "High").when(s == "low", "Low").otherwise("Medium")


def first_containing(c: Column, table: list[tuple[str, str]], default: Column) -> Column:
    """The value of the first key that c contains, in the table's order."""
    out = None
    for key, value in table:
        out = (F if out is None else out).when(F.contains(c, F.lit(key)), F.lit(value))
    return default if out is None else out.otherwise(default)


def name_from_file(c: Column, overrides: dict[str, str]) -> Column:
    """The label of the longest override key in the file's stem, else the stem in upper snake case."""
    stem = F.regexp_replace(c, r"\.[^.]*$", "")
    snake = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    table = sorted(overrides.items(), key=lambda x: -len(x[0]))
    fallback = F.when(snake == "", F.lit("UNKNOWN_SOURCE")).otherwise(F.upper(snake))
    return first_containing(F.lower(snake), [(k.lower().replace("-", "_"), v) for k, v in table], fallback)

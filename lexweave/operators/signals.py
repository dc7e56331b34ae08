"""Signals: predicates and lexicon or regex projections over one text. All are Column expressions.

A null text counts as ''. Terms are substrings of the canonical text, so 'use' is found in 'because'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions import lexicons as L
from lexweave.functions import text as T


def whole(c: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches the whole of c, in any case."""
    return c.rlike(r"(?is)\A(?:" + "|".join(patterns) + r")\z")


def any_term(c: Column, terms: list[str]) -> Column:
    """Give it a column, not an expression: c is read once for each term."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def terms_found(c: Column, terms: list[str]) -> Column:
    """The terms that c contains, in the list's order."""
    return F.array_compact(F.array(*[F.when(F.contains(c, F.lit(t)), F.lit(t)) for t in terms]))


def categories_found(c: Column, lexicon: dict[str, list[str]]) -> Column:
    """The categories of which c contains a term, in the lexicon's order."""
    return F.array_compact(F.array(*[F.when(any_term(c, terms), F.lit(k)) for k, terms in lexicon.items()]))


def reasons_found(c: Column, table: list[tuple[str, str]], flags: str = "(?is)") -> Column:
    return F.array_compact(F.array(*[F.when(c.rlike(flags + p), F.lit(r)) for p, r in table]))


def junk(c: Column, patterns: list[str] = L.JUNK_POLICY) -> Column:
    """Navigation or nothing at all."""
    return flat_junk(T.display(c), patterns)


def flat_junk(s: Column, patterns: list[str] = L.JUNK_POLICY) -> Column:
    """junk() of a display() column."""
    return (s == "") | whole(s, patterns)


def heading(c: Column, longest: int = 140, letters: int = 100) -> Column:
    return flat_heading(T.display(c), longest, letters)


def flat_heading(s: Column, longest: int = 140, letters: int = 100) -> Column:
    """heading() of a display() column."""
    return (F.length(s) <= longest) & ~s.rlike(r"[.;:?!]\z") & s.rlike(r"\A" + L.HEADING % letters + r"\z")


def bullet(c: Column) -> Column:
    return T.display(c).rlike(L.BULLET)


def boilerplate_reason(c: Column, table: list[tuple[str, str]] = L.BOILERPLATE) -> Column:
    """The first matching reason, else ''. c is a display() column."""
    s, out = c, None
    for pattern, reason in table:
        out = (F if out is None else out).when(whole(s, [pattern]), F.lit(reason))
    return out.otherwise("")


def administrative(c: Column, head: Column) -> Column:
    """Reasons (one for each pattern found, and one for the heading)."""
    of_text = reasons_found(F.coalesce(c, F.lit("")), L.ADMINISTRATIVE)
    by_head = F.when(any_term(T.canonical(head), L.ADMINISTRATIVE_HEADINGS), F.array(F.lit("administrative-sounding heading")))
    return F.concat(of_text, F.coalesce(by_head, F.array().cast("array<string>")))


def administrative_level(reasons: Column) -> Column:
    n = F.size(reasons)
    return F.when(n == 0, "none").when(n == 1, "weak").otherwise("possible")


def with_heading(c: Column, head: Column) -> Column:
    return T.canonical(F.concat(F.coalesce(head, F.lit("")), F.lit(" "), F.coalesce(c, F.lit(""))))


def relevance(s: Column, lexicon: dict[str, list[str]] = L.RELEVANCE, control: list[str] = L.CONTROL_WORDS) -> Column:
    """Categories found in a with_heading() column, with the control words as one more."""
    more = F.when(any_term(s, control), F.array(F.lit("normative_or_conditional_language"))).otherwise(F.array().cast("array<string>"))
    return F.concat(categories_found(s, lexicon), more)


def relevance_level(score: Column) -> Column:
    return F.when(score >= 4, "high").when(score >= 2, "medium").when(score == 1, "low").otherwise("unknown")


def statutory(s: Column, lexicon: dict[str, list[str]] = L.STATUTORY) -> Column:
    """Categories found in a with_heading() column."""
    return categories_found(s, lexicon)


def normative(s: Column, terms: list[str] = L.NORMATIVE) -> Column:
    return any_term(s, terms)


def statutory_score(categories: Column, is_normative: Column) -> Column:
    n = F.size(categories)
    return n + F.when(is_normative & (n > 0), 1).otherwise(0)


def statutory_level(score: Column) -> Column:
    return F.when(score >= 3, "high").when(score >= 1, "medium").otherwise("low")


def domain(name: Column) -> Column:
    s = F.lower(F.coalesce(name, F.lit("")))
    return F.when(any_term(s, L.PRIVACY_NAMES), "data_privacy").when(any_term(s, L.COMMERCIAL_NAMES), "commercial_advertising").otherwise("platform_governance")


def quality(c: Column, shortest: int, **present: Column) -> Column:
    """Flags in order of a display() column; present: flag name -> column that must hold more than white space."""
    s = c
    flags = [F.when(s == "", "empty_clause_text"), F.when(F.length(s) < shortest, "very_short_text"), F.when(F.length(s) > 5000, "very_long_text")]
    flags += [F.when(F.trim(F.coalesce(v.cast("string"), F.lit(""))) == "", F.lit(k)) for k, v in present.items()]
    return F.array_compact(F.array(*flags))


def statute_queue(flags: Column, score: Column, admin: Column) -> Column:
    return (
        F.when(F.size(flags) > 0, "quality_review")
        .when(score >= 2, "normal_or_high_relevance_review")
        .when(admin == "possible", "administrative_review_optional")
        .otherwise("standard_review")
    )


def policy_queue(flags: Column, is_boilerplate: Column, score: Column, of: Column, high: int = 2) -> Column:
    private = of == "data_privacy"
    return (
        F.when(F.size(flags) > 0, "quality_check")
        .when(is_boilerplate, "boilerplate_review")
        .when((score >= high) & private, "high")
        .when((score >= 1) | private, "medium")
        .otherwise("low")
    )

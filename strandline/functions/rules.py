"""Rule tables compiled to Columns.

A rule table is data (a dict or list of phrases).  Small tables become literal
expressions inside whole-stage codegen; large ones go through
``strandline.operators.joins`` as broadcast joins instead.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_text(*parts: Column) -> Column:
    """Lower-cased concatenation with single spaces; nulls become empty strings."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def lower_present(*parts: Column) -> Column:
    """Like ``lower_text`` but empty parts leave no extra space."""
    return F.lower(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]))


def sql_str(v: str) -> str:
    """A SQL string literal."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(map(sql_lit, v)) + ")" if v else "cast(array() as array<string>)"
    return sql_str(v) if isinstance(v, str) else str(v)


def lit_array(values) -> Column:
    """A literal array from one expression: cheap to build however long the list is."""
    return F.expr(sql_lit(list(values)))


def lit_map(table: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_lit(k)}, {sql_lit(v)}" for k, v in table.items()) + ")")


# Phrase rules take the text as a column *name* or as a Column.  A name compiles to one chain
# of ``contains`` inside whole-stage codegen; a Column goes through a higher-order function.
Text = Column | str


def sql_any(text: str, phrases, whole_word: bool = False) -> str:
    if not phrases:
        return "false"
    if whole_word:
        pattern = "(?<!\\w)(?:" + "|".join(re.escape(p) for p in phrases) + ")(?!\\w)"
        return f"({text} RLIKE {sql_str(pattern)})"
    return "(" + " OR ".join(f"contains({text}, {sql_str(p)})" for p in phrases) + ")"


def any_phrase(text: Text, phrases, whole_word: bool = False) -> Column:
    if isinstance(text, str):
        return F.expr(sql_any(text, phrases, whole_word))
    if not phrases:
        return F.lit(False)
    if whole_word:
        return text.rlike(r"(?<!\w)(?:" + "|".join(re.escape(p) for p in phrases) + r")(?!\w)")
    return F.exists(lit_array(phrases), lambda p: F.contains(text, p))


def phrase_match(text: Text, any_of=(), required=(), none_of=(), whole_word: bool = False) -> Column:
    tests = [any_phrase(text, [p], whole_word) for p in required]
    if any_of:
        tests.append(any_phrase(text, any_of, whole_word))
    if none_of:
        tests.append(~any_phrase(text, none_of, whole_word))
    return reduce(and_, tests) if tests else F.lit(True)


def phrase_count(text: Text, phrases, cap: int, weight: int, whole_word: bool = False) -> Column:
    """Distinct phrases present, capped, times ``weight``."""
    phrases = list(dict.fromkeys(phrases))
    if isinstance(text, str):
        hits = " + ".join(f"int({sql_any(text, [p], whole_word)})" for p in phrases) or "0"
        return F.expr(f"least({hits}, {cap}) * {weight}")
    hit = (lambda p: F.contains(text, p)) if not whole_word else (
        lambda p: F.regexp_like(text, F.concat(F.lit(r"(?<!\w)\Q"), p, F.lit(r"\E(?!\w)"))))
    return F.least(F.size(F.filter(lit_array(phrases), hit)), F.lit(cap)) * weight


def labels(text: Text, rules: dict, whole_word: bool = False) -> Column:
    """Names of the rules with a phrase in ``text``, in rule order."""
    if isinstance(text, str):
        cases = ", ".join(f"CASE WHEN {sql_any(text, ps, whole_word)} THEN {sql_str(n)} END" for n, ps in rules.items())
        return F.expr(f"array_compact(array({cases}))")
    return F.array_compact(F.array(*[
        F.when(any_phrase(text, phrases, whole_word), F.lit(name)) for name, phrases in rules.items()]))


def first_label(text: Text, rules, whole_word: bool = False) -> Column:
    """Name of the first matching rule of [(name, phrases)], or null."""
    if isinstance(text, str):
        whens = " ".join(f"WHEN {sql_any(text, ps, whole_word)} THEN {sql_str(n)}" for n, ps in rules)
        return F.expr(f"CASE {whens} ELSE cast(NULL AS string) END")
    return F.coalesce(*[F.when(any_phrase(text, phrases, whole_word), F.lit(name))
                        for name, phrases in rules], F.lit(None).cast("string"))


def lookup(c: Column, table: dict, default=None) -> Column:
    """Map-literal lookup with a default."""
    value = F.element_at(lit_map(table), c)
    return value if default is None else F.coalesce(value, F.lit(default))


def lookup_array(c: Column, table: dict) -> Column:
    """Map-literal lookup of string arrays; unknown keys give an empty array."""
    return F.coalesce(F.element_at(lit_map(table), c), F.array().cast("array<string>"))


def or_default(arr: Column, value: str) -> Column:
    return F.when(F.size(arr) > 0, arr).otherwise(F.array(F.lit(value)))


def first_items(arr: Column, n: int | None) -> Column:
    """The first ``n`` items, or all."""
    return arr if n is None else F.slice(arr, 1, n)


def first_chars(c: Column, n: int | None) -> Column:
    """The first ``n`` characters, or all."""
    return c if n is None else F.substring(c, 1, n)


def vocab_intersect(arr: Column, vocab, limit: int | None = None) -> Column:
    """Values of the vocabulary, lower-cased with ``-`` as ``_``, distinct; all, or the first ``limit``."""
    empty = F.array().cast("array<string>")
    norm = F.transform(F.coalesce(arr, empty), lambda v: F.replace(F.lower(v), F.lit("-"), F.lit("_")))
    return first_items(F.array_intersect(norm, lit_array(vocab)), limit)


def pick_one(value: Column, vocab, fallback: str = "unknown") -> Column:
    v = F.replace(F.lower(F.coalesce(value, F.lit(""))), F.lit("-"), F.lit("_"))
    return F.when(F.array_contains(lit_array(vocab), v), v).otherwise(F.lit(fallback))


def enum_exact(value: Column, vocab, fallback: str = "unknown") -> Column:
    return F.when(F.array_contains(lit_array(vocab), value), value).otherwise(F.lit(fallback))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    shared = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when(total == 0, F.lit(both_empty)).otherwise(shared / total)


def flags(*pairs) -> Column:
    """array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, name if isinstance(name, Column) else F.lit(name))
                                     for name, cond in pairs]))


def points(*pairs, base: int = 0) -> Column:
    """Sum of ``value`` for each (condition, value); a null condition adds nothing."""
    return reduce(lambda acc, p: acc + F.when(p[0], F.lit(p[1])).otherwise(F.lit(0)), pairs, F.lit(base))


def ladder(value: Column, steps, default):
    """First (threshold, result) with ``value >= threshold``; thresholds descend."""
    out = None
    for limit, result in steps:
        out = F.when(value >= limit, F.lit(result)) if out is None else out.when(value >= limit, F.lit(result))
    return out.otherwise(F.lit(default))


def text_length(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit("")))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""

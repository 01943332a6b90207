"""Rule predicates as Columns: each is true, false or null-safe false, never null."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, functions as F

from emberwatch.functions.literals import FOLDED_FROM, FOLDED_TO, required_literals
from emberwatch.model import PROMOTED

# Java flags giving the usual case-insensitive, Unicode-aware, line-based search.
REGEX_FLAGS = "(?iuUd)"


def as_values(expected: Any) -> list[str]:
    values = expected if isinstance(expected, (list, tuple)) else [expected]
    return [str(v) for v in values]


def resolve_field(name: str) -> Column:
    """A promoted attribute, or the raw payload key of that exact name."""
    column = F.col(name) if name in PROMOTED else F.col("raw")[name]
    return column if name not in ("event_id", "process_id", "timestamp") else column.cast("string")


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests) if tests else F.lit(False)


def all_of(tests: list[Column]) -> Column:
    return reduce(and_, tests) if tests else F.lit(False)


def pred_equals(c: Column, expected: Any) -> Column:
    return F.lower(c).isin(*[v.lower() for v in as_values(expected)])


def pred_contains(c: Column, expected: Any) -> Column:
    return any_of([F.lower(c).contains(v.lower()) for v in as_values(expected)])


def pred_startswith(c: Column, expected: Any) -> Column:
    return any_of([F.lower(c).startswith(v.lower()) for v in as_values(expected)])


def pred_endswith(c: Column, expected: Any) -> Column:
    return any_of([F.lower(c).endswith(v.lower()) for v in as_values(expected)])


def pred_regex(c: Column, expected: Any) -> Column:
    return any_of([c.rlike(REGEX_FLAGS + v) for v in as_values(expected)])


PREDICATES = {
    "equals": pred_equals, "contains": pred_contains, "startswith": pred_startswith,
    "endswith": pred_endswith, "re": pred_regex,
}


def pred_not(test: Column) -> Column:
    """Negation in which a missing field is false before, hence true after."""
    return ~F.coalesce(test, F.lit(False))


# -- the same tests as SQL text ------------------------------------------------
# A rule set has thousands of expression nodes. Built one call at a time they take
# seconds to cross into the JVM; as text they are parsed there in one go.

def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def field_ref(name: str, lowered: dict[str, str] | None = None) -> str:
    """Column reference of a rule field; `lowered` names columns holding its lower-case text."""
    if lowered is not None and name in lowered:
        return lowered[name]
    ref = f"`{name}`" if name in PROMOTED else f"raw[{sql_text(name)}]"
    ref = f"string({ref})" if name in ("event_id", "process_id", "timestamp") else ref
    return ref if lowered is None else f"lower({ref})"


def folded_ref(name: str) -> str:
    """Lower-case text of a field with the letters that caseless matching equates made plain."""
    text = field_ref(name)
    odd = " OR ".join(f"contains({text}, '{ch}')" for ch in FOLDED_FROM)
    return f"IF({odd}, lower(translate({text}, '{FOLDED_FROM}', '{FOLDED_TO}')), lower({text}))"


def _regex_sql(name: str, pattern: str, folded: dict[str, str]) -> str:
    test = f"{field_ref(name)} RLIKE {sql_text(REGEX_FLAGS + pattern)}"
    needed = required_literals(pattern) if name in folded else []
    gate = " OR ".join(f"contains({folded[name]}, {sql_text(text)})" for text in needed)
    return f"(({gate}) AND {test})" if gate else test


def field_sql(
    spec: str, expected: Any, lowered: dict[str, str] | None = None, folded: dict[str, str] | None = None
) -> str:
    """`field|operator[|not]` against one value or a list of alternatives, as a boolean SQL expression.

    `lowered` and `folded` name columns that hold a field's lower-case text; with
    `folded`, an expression runs only where a text it needs occurs.
    """
    name, *modifiers = spec.split("|")
    operators = [m for m in modifiers if m != "not"]
    operator = operators[0] if operators else "equals"
    if len(operators) > 1 or operator not in PREDICATES:
        raise ValueError(f"unknown operator in {spec!r}")
    values = as_values(expected)
    text = field_ref(name, lowered or {})
    if operator == "equals":
        test = f"{text} IN ({', '.join(sql_text(v.lower()) for v in values)})"
    elif operator == "re":
        test = " OR ".join(_regex_sql(name, v, folded or {}) for v in values)
    else:
        test = " OR ".join(f"{operator}({text}, {sql_text(v.lower())})" for v in values)
    test = f"coalesce({test}, false)" if values else "false"
    return f"NOT {test}" if "not" in modifiers else test


def field_test(spec: str, expected: Any) -> Column:
    return F.expr(field_sql(spec, expected))


# -- wildcards ---------------------------------------------------------------

def _glob_shape(pattern: str) -> tuple[str, str]:
    if pattern == "**":
        return "contains", ""
    core = pattern.strip("*")
    if "?" in pattern or "*" in core or pattern.strip("*") == "" and "*" in pattern:
        return "re", ""
    lead, trail = pattern.startswith("*"), pattern.endswith("*")
    if pattern.count("*") != lead + trail:
        return "re", ""
    return {(0, 0): "equals", (1, 0): "endswith", (0, 1): "startswith", (1, 1): "contains"}[lead, trail], core


def _glob_regex(pattern: str) -> str:
    body = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in pattern)
    return f"^{body}$"


def glob_match(c: Column, patterns: Any) -> Column:
    """Whole-string wildcard match (`*`, `?`), case-insensitive, any pattern."""
    values = as_values(patterns)
    if not values:
        raise ValueError("empty value list")
    shapes = {_glob_shape(v)[0] for v in values}
    if len(shapes) == 1 and "re" not in shapes:
        test = PREDICATES[shapes.pop()](c, [_glob_shape(v)[1] for v in values])
    else:
        test = pred_regex(c, [_glob_regex(v) for v in values])
    return F.coalesce(test, F.lit(False))

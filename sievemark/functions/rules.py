"""Tagging rules as data: a rule set is a list of rows, and turns into one column expression.

A change of subject is a change of rows. A rule fires if any of its keys is found, and, where it has guards,
if every guard (a list of keys, any of which must be found) holds and none of its exclusions is found.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.text import compact, compact_key, text


#: Rules that a table may hold.
MAX_RULES = 2_000


@dataclass(frozen=True)
class Rule:
    """``name`` is given to texts with any of ``keys``; ``all_of`` are guards, ``none_of`` exclusions.

    A key with a backslash or ``.*`` is a regular expression on the raw text, any other is looked for in the
    compact text.
    """

    name: str
    keys: tuple[str, ...] = ()
    all_of: tuple[tuple[str, ...], ...] = ()
    none_of: tuple[str, ...] = ()
    fold: bool = field(default=False)

    @staticmethod
    def of(rows: list[tuple[str, list[str]]], fold: bool = False) -> list[Rule]:
        return [Rule(name, tuple(keys), fold=fold) for name, keys in rows]


def rules_from(df: DataFrame) -> list[Rule]:
    """Rules from a small table with ``ord``, ``name``, ``keys`` (array), ``all_of`` (array of arrays) and ``none_of`` (array)."""
    rows = df.orderBy("ord", "name").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: they become one expression")
    return [Rule(r["name"], tuple(r["keys"] or ()), tuple(tuple(g) for g in r["all_of"] or ()), tuple(r["none_of"] or ())) for r in rows]


def has_any(raw: Column, keys: tuple[str, ...] | list[str], packed: Column | None = None) -> Column:
    """True if any key is found in the text."""
    packed = compact(raw) if packed is None else packed
    tests = [text(raw).rlike(k) if "\\" in k or ".*" in k else packed.contains(compact_key(k)) for k in keys]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def fires(rule: Rule, raw: Column, packed: Column | None = None) -> Column:
    """True where the rule gives its name."""
    if rule.fold:
        raw, keys = F.lower(text(raw)), [k.lower() for k in rule.keys]
        found = reduce(lambda a, b: a | b, [raw.contains(k) for k in keys])
    else:
        found = has_any(raw, rule.keys, packed) if rule.keys else F.lit(True)
    for guard in rule.all_of:
        found = found & has_any(raw, guard, packed)
    return found & ~has_any(raw, rule.none_of, packed) if rule.none_of else found


def tags(rules: list[Rule], raw: Column, packed: Column | None = None) -> Column:
    """The names of the rules that fire, in rule order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(fires(r, raw, packed), F.lit(r.name)) for r in rules])))


@dataclass(frozen=True)
class Case:
    """A row of a cascade: ``result`` for texts with any of ``any_of`` and, where given, any of ``also`` and none of ``none_of``,
    longer than ``longer``, and (with any of ``named`` in the raw text, or shorter than ``shorter``)."""

    result: str
    any_of: tuple[str, ...]
    also: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    longer: int | None = None
    named: tuple[str, ...] = ()
    shorter: int | None = None


def case_holds(case: Case, raw: Column, packed: Column) -> Column:
    """True where the row of the cascade holds."""
    test = has_any(raw, case.any_of, packed)
    if case.also:
        test = test & has_any(raw, case.also, packed)
    if case.none_of:
        test = test & ~has_any(raw, case.none_of, packed)
    if case.longer is not None:
        test = test & (F.length(raw) > case.longer)
    if case.named or case.shorter is not None:
        some = [raw.contains(n) for n in case.named] + ([F.length(raw) < case.shorter] if case.shorter is not None else [])
        test = test & reduce(lambda a, b: a | b, some)
    return test


def first_case(cases: list[Case], raw: Column, packed: Column, default: Column | str) -> Column:
    """The result of the first row of a cascade that holds."""
    return cascade([(case_holds(c, raw, packed), c.result) for c in cases], default)


def cascade(cases: list[tuple[Column, str]], default: Column | str) -> Column:
    """The value of the first case that holds."""
    out = None
    for test, value in cases:
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    default = F.lit(default) if isinstance(default, str) else default
    return default if out is None else out.otherwise(default)

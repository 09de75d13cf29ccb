"""Ordered rules as data, compiled to one expression.

A condition is built from fields of a record by name; a RuleSet compiles its rules over given columns either to the first
that holds, with its outputs, or to the labels of all that hold, in generated code.

Rules look for each of their terms by itself, and the first that holds ends the search. Where many sets read one text,
``one_scan`` finds the terms of all of them in one pass by an automaton, and the same rules then look at what was found.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import text as T

Columns = Mapping[str, Column]


@dataclass(frozen=True)
class Condition:
    """A test of a record; conditions combine by &, | and ~."""

    build: Callable[[Columns, str], Column]
    #: Fields and the terms that are looked for in them.
    terms: frozenset[tuple[str, str]] = frozenset()

    def __and__(self, other: Condition) -> Condition:
        return Condition(lambda c, m: self.build(c, m) & other.build(c, m), self.terms | other.terms)

    def __or__(self, other: Condition) -> Condition:
        return Condition(lambda c, m: self.build(c, m) | other.build(c, m), self.terms | other.terms)

    def __invert__(self) -> Condition:
        return Condition(lambda c, m: ~self.build(c, m), self.terms)


class Scanned(dict):
    """Columns by name, and for fields that were scanned the column of found terms with all terms of that scan."""

    def __init__(self, columns: Columns, found: Mapping[str, tuple[Column, tuple[str, ...]]]):
        super().__init__(columns)
        self.found = found

    def any(self, field_: str, terms: tuple[str, ...]) -> Column:
        """Whether a term is among those found in the field."""
        column, scanned = self.found[field_]
        if missing := set(terms) - set(scanned):
            raise ValueError(f"terms that were not looked for: {sorted(missing)}")
        return reduce(lambda a, b: a | b, [F.array_contains(column, t) for t in terms])


def has(field_: str, *terms: str) -> Condition:
    """A term is in the field: anywhere, or as whole words if the rule set matches words."""

    def build(c: Columns, match: str) -> Column:
        if match == "word":
            return c[field_].rlike("(?U)\\b(?:" + "|".join(map(re.escape, terms)) + ")\\b")
        if isinstance(c, Scanned) and field_ in c.found:
            return c.any(field_, terms)
        return T.contains_any(c[field_], terms)

    return Condition(build, frozenset((field_, t) for t in terms))


def like(field_: str, *patterns: str) -> Condition:
    return Condition(lambda c, m: c[field_].rlike("(?iU)(?:" + "|".join(patterns) + ")"))


def equals(field_: str, *values: str) -> Condition:
    return Condition(lambda c, m: c[field_].isin(*values))


def test(make: Callable[[Columns], Column]) -> Condition:
    """A condition of one's own."""
    return Condition(lambda c, m: make(c))


@dataclass(frozen=True)
class Rule:
    label: str
    when: Condition
    extras: tuple[str, ...] = ()


@dataclass(frozen=True)
class RuleSet:
    """rules in their order; ``default`` is the outcome if none holds. Outcomes have ``outputs``, the label first."""

    rules: tuple[Rule, ...]
    default: tuple[str, ...]
    outputs: tuple[str, ...] = ("label",)
    match: str = field(default="substring")

    def first(self, columns: Columns) -> Column:
        """The first rule that holds: its label, or a struct if there are more outputs. Unknown counts as not holding."""
        made = self._outcome(self.default)
        for rule in reversed(self.rules):
            made = F.when(rule.when.build(columns, self.match), self._outcome((rule.label, *rule.extras))).otherwise(made)
        return made

    def all(self, columns: Columns) -> Column:
        """Labels of all rules that hold, in order."""
        return F.array_compact(F.array(*(F.when(r.when.build(columns, self.match), F.lit(r.label)) for r in self.rules)))

    def terms(self, field_: str) -> set[str]:
        """Terms that the rules look for anywhere in a field."""
        return {t for r in self.rules for f, t in r.when.terms if f == field_ and self.match == "substring"}

    def _outcome(self, values: tuple[str, ...]) -> Column:
        if len(self.outputs) == 1:
            return F.lit(values[0])
        return F.struct(*(F.lit(v).alias(n) for n, v in zip(self.outputs, values, strict=True)))


def rule_table(rules: Mapping[str, tuple[str, ...]], field_: str = "text") -> tuple[Rule, ...]:
    """Rules of label and terms."""
    return tuple(Rule(label, has(field_, *terms)) for label, terms in rules.items())


def one_scan(frame: DataFrame, columns: Columns, sets: Iterable[RuleSet], field_: str = "text") -> tuple[DataFrame, Columns, str]:
    """The frame with a column of the terms of all sets that are found in a field, the columns that let sets read it, and its name.

    The added column is made in one pass over the text, is to be dropped at the end, and has a name that the frame has not.
    Rules give what they give without it: null texts stay unknown, and sets of words keep their patterns.
    """
    name = "_found"
    while name.lower() in map(str.lower, frame.columns):
        name += "_"
    terms = tuple(sorted(set().union(*(s.terms(field_) for s in sets))))
    return frame.withColumn(name, T.terms_found(columns[field_], terms)), Scanned(columns, {field_: (F.col(name), terms)}), name

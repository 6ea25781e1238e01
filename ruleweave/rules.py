"""Rules with exceptions and their translation to Spark column conditions.

A theory has rules for its target, OR-ed together, and exception rules whose heads
(``ab0``, ``ab1`` ...) are used negated inside rule bodies. Exceptions may use further
exceptions. Rules are driver-side objects; their number is bounded by what a person can
read. The cases they speak about are columns of a DataFrame:

* an attribute with one value per case is a plain column,
* an attribute with several values per case is an array column,
* a property without value (``penguin(X)``) is a column that is null when it is absent.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_LITERALS_SCHEMA = (
    "rule_id int, head string, lit_no int, pred string, val string, negated boolean"
)


#: Constants that need no quotes; a bare word with a capital or underscore is a variable.
BARE = r"[a-z0-9.+-][^,()'\s]*"


def quoted(value: str) -> str:
    """A constant as a term: in quotes where it would read as a variable or as several."""
    return value if re.fullmatch(BARE, value) else "'" + value.replace("'", "''") + "'"


def unquoted(term: str) -> str:
    """The value of a constant term."""
    return term[1:-1].replace("''", "'") if len(term) > 1 and term[0] == term[-1] == "'" else term


def is_variable(term: str) -> bool:
    return term[:1].isupper() or term[:1] == "_"


@dataclass(frozen=True)
class Literal:
    """A condition ``pred = val`` on a case, or the negated name of an exception."""

    pred: str
    val: str | None = None
    negated: bool = False

    def text(self, var: str = "A") -> str:
        inner = f"{self.pred}({var})" if self.val is None else f"{self.pred}({var},{quoted(self.val)})"
        return f"not({inner})" if self.negated else inner


@dataclass(frozen=True)
class Rule:
    head: str
    body: tuple[Literal, ...]

    def text(self, var: str = "A") -> str:
        body = ",".join(lit.text(var) for lit in self.body) or "true"
        return f"{self.head}({var}):-{body}."

    def without(self, position: int) -> Rule:
        return replace(self, body=self.body[:position] + self.body[position + 1 :])


@dataclass(frozen=True)
class Theory:
    target: str
    rules: tuple[Rule, ...]
    exceptions: tuple[Rule, ...] = ()
    #: Exceptions given as explicit case ids: head -> DataFrame(case_id).
    listed: dict[str, DataFrame] = field(default_factory=dict, compare=False)
    #: On grouped cases, whose ids are gone: head -> weight of the side that it lists.
    listed_side: dict[str, str] = field(default_factory=dict, compare=False)

    def exception_bodies(self, head: str) -> list[Rule]:
        return [r for r in self.exceptions if r.head == head]

    def is_exception(self, name: str) -> bool:
        return name in self.listed or name in self.listed_side or any(r.head == name for r in self.exceptions)

    def reachable(self) -> Theory:
        """Drop exception rules that no kept rule leads to."""
        used: set[str] = set()
        frontier = list(self.rules)
        while frontier:
            rule = frontier.pop()
            for lit in rule.body:
                if self.is_exception(lit.pred) and lit.pred not in used:
                    used.add(lit.pred)
                    frontier.extend(self.exception_bodies(lit.pred))
        return replace(
            self,
            exceptions=tuple(r for r in self.exceptions if r.head in used),
            listed={h: d for h, d in self.listed.items() if h in used},
            listed_side={h: w for h, w in self.listed_side.items() if h in used},
        )

    def lines(self) -> list[str]:
        """Readable form: rules, an empty line, exceptions."""
        return [r.text() for r in self.rules] + [""] + [r.text() for r in self.exceptions]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per body literal; rules first, then exceptions."""
        rows = [
            (rule_id, rule.head, lit_no, lit.pred, lit.val, lit.negated)
            for rule_id, rule in enumerate((*self.rules, *self.exceptions))
            for lit_no, lit in enumerate(rule.body)
        ]
        return spark.createDataFrame(rows, RULE_LITERALS_SCHEMA)


def theory_from_rows(rows: Iterable, target: str) -> Theory:
    """Rebuild a theory from collected ``rule_literals`` rows (bounded by the rules)."""
    by_rule: dict[int, list] = {}
    for row in rows:
        by_rule.setdefault(row["rule_id"], []).append(row)
    rules = []
    for rule_id in sorted(by_rule):
        lits = sorted(by_rule[rule_id], key=lambda r: r["lit_no"])
        body = tuple(Literal(r["pred"], r["val"], r["negated"]) for r in lits)
        rules.append(Rule(lits[0]["head"], body))
    return Theory(
        target,
        tuple(r for r in rules if r.head == target),
        tuple(r for r in rules if r.head != target),
    )


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def literal_condition(
    lit: Literal, df: DataFrame, theory: Theory | None = None, side: str | None = None
) -> Column:
    """Condition of one literal, never null: what cannot be shown does not hold.

    ``side`` names the weight that is counted on grouped cases: an exception that lists
    cases holds for all of the side it lists, within the clause it belongs to, and for none
    of the other.
    """
    if theory is not None and theory.is_exception(lit.pred):
        if side is not None and lit.pred in theory.listed_side:
            holds = F.lit(theory.listed_side[lit.pred] == side)
        elif lit.pred in theory.listed:
            holds = F.coalesce(F.col(lit.pred), F.lit(False))
        else:
            holds = any_of(
                [rule_condition(r, df, theory, side) for r in theory.exception_bodies(lit.pred)]
            )
    elif lit.val is None:
        holds = F.col(lit.pred).isNotNull()
    elif isinstance(df.schema[lit.pred].dataType, T.ArrayType):
        holds = F.coalesce(F.array_contains(lit.pred, lit.val), F.lit(False))
    else:
        holds = F.coalesce(F.col(lit.pred) == F.lit(lit.val), F.lit(False))
    return ~holds if lit.negated else holds


def rule_condition(
    rule: Rule, df: DataFrame, theory: Theory | None = None, side: str | None = None
) -> Column:
    """The body of ``rule`` as one boolean column, innermost exceptions first."""
    return all_of([literal_condition(lit, df, theory, side) for lit in rule.body])

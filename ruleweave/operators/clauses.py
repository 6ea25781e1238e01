"""Programs of clauses over relations: views and exceptions, derived stratum by stratum.

A clause ``head :- body`` derives a relation from others: its body is a chain of equi joins on
shared variables, negated atoms are anti joins. A relation is derived after all that its
clauses name, so that negation sees whole relations; relations that depend on themselves are
refused. A relation that several later clauses use is written once and read by all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import is_variable, unquoted
from ..session import materialize
from .relational import Atom, Tables, atom_table, bind


@dataclass(frozen=True)
class Clause:
    """``head :- body``; the head's places are variables of the body, or constants."""

    head: Atom
    body: tuple[Atom, ...]

    def text(self) -> str:
        return f"{self.head.text()}:-{','.join(a.text() for a in self.body) or 'true'}."


def clauses_from_rows(rows: Iterable) -> list[Clause]:
    """Clauses from collected rows of ``readers.parse_clauses``; rules are what a person reads."""
    by_rule: dict[str, list] = {}
    for row in rows:
        by_rule.setdefault(row["rule_text"], []).append(row)
    out = []
    for lits in by_rule.values():
        lits.sort(key=lambda r: r["lit_no"])
        body = tuple(Atom(r["pred"], tuple(r["args"]), r["negated"]) for r in lits)
        out.append(Clause(Atom(lits[0]["head"], tuple(lits[0]["head_args"])), body))
    return out


def joinable(body: Sequence[Atom], known: Iterable[str] = ()) -> list[Atom]:
    """The body in an order in which every atom shares a variable with those before it.

    Negated atoms come as soon as the positive ones have bound their variables. A body that
    falls into parts without shared variables would be a cross product and is refused.
    """
    rest, bound, out = list(body), set(known), []
    while rest:
        usable = [
            a for a in rest
            if (set(a.variables) & bound or (not out and not bound and not a.negated))
            and (not a.negated or not {v for b in rest if not b.negated for v in b.variables} & set(a.variables) - bound)
        ]
        if not usable:
            raise ValueError("no shared variable joins " + ", ".join(a.text() for a in rest))
        atom = next((a for a in usable if a.negated), usable[0])
        rest.remove(atom)
        out.append(atom)
        if not atom.negated:
            bound |= set(atom.variables)
    return out


@dataclass(frozen=True)
class Program:
    clauses: tuple[Clause, ...]

    def strata(self) -> list[str]:
        """Derived relations, each after those its clauses name."""
        needs: dict[str, set[str]] = {}
        heads = {c.head.pred for c in self.clauses}
        for clause in self.clauses:
            needs.setdefault(clause.head.pred, set()).update(a.pred for a in clause.body if a.pred in heads)
        order: list[str] = []
        while needs:
            ready = sorted(p for p, before in needs.items() if before <= set(order))
            if not ready:
                raise ValueError("relations depend on themselves: " + ", ".join(sorted(needs)))
            order += ready
            for p in ready:
                del needs[p]
        return order

    def derive(self, tables: Tables, domains: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """``tables`` and the derived relations, with columns a0, a1 ... and distinct rows.

        ``domains`` has the bindings a relation's head variables range over, one column per
        variable; such a relation needs no positive atom for them.
        """
        # Rows with nulls are no facts.
        named = {a.pred for c in self.clauses for a in c.body} | {c.head.pred for c in self.clauses}
        known, domains = {p: t.dropna() if p in named else t for p, t in tables.items()}, domains or {}
        uses: dict[str, int] = {}
        for clause in self.clauses:
            for atom in clause.body:
                uses[atom.pred] = uses.get(atom.pred, 0) + 1
        for name in self.strata():
            parts = [self._head(c, known, domains.get(name)) for c in self.clauses if c.head.pred == name]
            facts = [known[name]] if name in known else []
            whole = reduce(DataFrame.unionByName, [*facts, *parts]).distinct()
            known[name] = materialize(whole) if uses.get(name, 0) > 1 else whole
        return known

    @staticmethod
    def _head(clause: Clause, known: Tables, domain: DataFrame | None) -> DataFrame:
        if domain is not None:
            body, bound = joinable(clause.body, domain.columns), domain
        else:
            first, *body = joinable(clause.body)
            bound = atom_table(first, known).distinct()
        bound = bind(bound, body, known)
        missing = [a for a in clause.head.args if is_variable(a) and a not in bound.columns]
        if missing:
            raise ValueError(f"{clause.text()} leaves {', '.join(missing)} open")
        return bound.select(*[
            (F.col(a) if is_variable(a) else F.lit(unquoted(a))).alias(f"a{i}") for i, a in enumerate(clause.head.args)
        ]).distinct()

"""Greedy rule learning with exceptions.

The driver loop holds rules and one candidate at a time. Every step is one Spark
aggregation over the grouped cases (see ``gain.weigh``): a filter for what the current
clause covers, then counts of all candidate literals at once. Plans stay one scan deep,
however many rules have been learned.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.gain import (
    Bias,
    Weighted,
    argmax_literal,
    bias_filter,
    candidate_counts,
    derive_bias,
    mdl_accept,
    weigh,
    with_gain,
    with_negated,
)
from ..operators.prep import CaseTable
from ..rules import Literal, Rule, Theory, any_of, literal_condition, rule_condition


@dataclass(frozen=True)
class LearnSettings:
    """``min_accuracy`` keeps a clause, ``stop_accuracy`` ends its growth early.

    ``max_depth`` bounds exceptions of exceptions (None: they end by themselves, as each
    level works on fewer cases than the one above it); ``max_rules`` bounds the rules per
    head (None: until nothing is left to explain or nothing more can be learned).

    ``negation`` proposes negated literals too. With ``exceptions_alone`` a theory may begin
    with "all but": where no literal gains, exceptions of the clause without a body are
    looked for. With ``listed`` the negatives that a clause still covers, and for which no
    exception is found, are listed by their ids.
    """

    target: str = "positive"
    min_accuracy: float = 0.99
    stop_accuracy: float = 0.99
    max_depth: int | None = None
    use_mdl: bool = True
    max_rules: int | None = None
    negation: bool = False
    exceptions_alone: bool = False
    listed: bool = False


@dataclass(frozen=True)
class Side:
    """An example set: rows that pass ``where``, counted by the column ``weight``."""

    weight: str
    where: Column

    @property
    def count(self) -> Column:
        return F.when(self.where, F.col(self.weight)).otherwise(F.lit(0).cast("bigint"))

    def within(self, condition: Column) -> Side:
        return replace(self, where=self.where & condition)


class GreedySearch:
    """Sequential covering over grouped cases."""

    def __init__(self, base: Weighted, bias: Bias, settings: LearnSettings):
        self.base = base
        self.df = base.df.persist(StorageLevel.MEMORY_AND_DISK)
        self.bias = bias
        self.settings = settings
        self.exceptions: list[Rule] = []
        #: Exceptions that list cases: head -> the side they are on.
        self.listed: dict[str, Side] = {}
        self.next_ab = 0
        p, n = self.count(Side("p_w", F.lit(True)), Side("n_w", F.lit(True)))
        self.total = p + n

    def close(self) -> None:
        self.df.unpersist()

    # -- pieces -------------------------------------------------------------

    @property
    def listed_side(self) -> dict[str, str]:
        return {head: side.weight for head, side in self.listed.items()}

    def condition(self, body: list[Literal], side: Side) -> Column:
        """The body on the cases of a side: listed exceptions differ between the two."""
        theory = Theory(self.settings.target, (), tuple(self.exceptions), listed_side=self.listed_side)
        return rule_condition(Rule(self.settings.target, tuple(body)), self.df, theory, side.weight)

    def count(self, *sides: Side) -> list[int]:
        row = self.df.agg(*[F.sum(s.count).alias(f"c{i}") for i, s in enumerate(sides)]).first()
        return [int(v or 0) for v in row]

    def gains(
        self, body: list[Literal], pos: Side, neg: Side, n_pos: int, n_neg: int
    ) -> DataFrame:
        """All candidate literals for ``body`` with counts and gain."""
        active = self.df.where((pos.count > 0) | (neg.count > 0))
        attrs = self.bias.open_attrs(body)
        counts = bias_filter(
            candidate_counts(active, attrs, pos.count, neg.count, self.base.unary), self.bias
        )
        if self.settings.negation:
            counts = with_negated(counts, n_pos, n_neg)
        return with_gain(counts, n_pos, n_neg)

    @property
    def literal_bits(self) -> float:
        """Bits to name a literal; one more tells whether it is negated."""
        return self.bias.literal_bits + self.settings.negation

    def best_literal(
        self, body: list[Literal], pos: Side, neg: Side, n_pos: int, n_neg: int
    ) -> tuple[Literal, int, int] | None:
        """Best candidate and what it covers; None if none gains or none pays."""
        if not self.bias.open_attrs(body):
            return None
        row = argmax_literal(self.gains(body, pos, neg, n_pos, n_neg)).first()
        if row is None:
            return None
        if self.settings.use_mdl and not mdl_accept(
            self.total, row["p_cov"], self.literal_bits, len(body) + 1
        ):
            return None
        negated = self.settings.negation and row["negated"]
        return Literal(row["pred"], row["val"], negated), row["p_cov"], row["n_cov"]

    # -- the loop -----------------------------------------------------------

    def grow(self, pos: Side, neg: Side, depth: int) -> list[Literal] | None:
        """Body of one new clause, or None if no clause is good enough."""
        n_pos, n_neg = self.count(pos, neg)
        body: list[Literal] = []
        while n_pos > 0:
            found = self.best_literal(body, pos, neg, n_pos, n_neg)
            if found is None:
                break
            lit, n_pos, n_neg = found
            body.append(lit)
            holds = literal_condition(lit, self.df)
            pos, neg = pos.within(holds), neg.within(holds)
            if n_pos / (n_pos + n_neg) > self.settings.stop_accuracy:
                return body
        # "All but" is for the target itself: an exception of everything would be its opposite.
        alone = self.settings.exceptions_alone and depth == 0 and n_neg > 0
        if n_pos == 0 or not (body or alone):
            return None
        accuracy = n_pos / (n_pos + n_neg)
        if (self.settings.max_depth is None or depth < self.settings.max_depth) and n_neg > 0:
            head = self.learn_exceptions(body, pos, neg, n_pos, n_neg, depth)
            if head is not None:
                body = [*body, Literal(head, None, True)]
                p_left, n_left = self.count(
                    pos.within(self.condition(body[-1:], pos)), neg.within(self.condition(body[-1:], neg))
                )
                accuracy = (p_left + n_neg - n_left) / (n_pos + n_neg)
        return body if body and accuracy >= self.settings.min_accuracy else None

    def learn_exceptions(
        self, body: list[Literal], pos: Side, neg: Side, n_pos: int, n_neg: int, depth: int
    ) -> str | None:
        """Rules for the negatives a clause covers, with the roles of the sets swapped; their
        list, if there is no pattern in them and lists are wanted."""
        bodies: list[list[Literal]] = []
        if self.best_literal(body, neg, pos, n_neg, n_pos) is not None:
            bodies = self.cover(neg, pos, depth + 1)
        if not bodies and not (self.settings.listed and body):
            return None
        head = f"ab{self.next_ab}"
        self.next_ab += 1
        if not bodies:
            self.listed[head] = neg
        self.exceptions.extend(Rule(head, tuple(b)) for b in bodies)
        return head

    def cover(self, pos: Side, neg: Side, depth: int) -> list[list[Literal]]:
        """Learn clauses until the positives are explained or no clause is found.

        A failed attempt changes nothing, so one failure ends the loop.
        """
        bodies: list[list[Literal]] = []
        done: list[Column] = []
        limit = self.settings.max_rules
        while limit is None or len(bodies) < limit:
            body = self.grow(pos.within(~any_of(done)), neg, depth)
            if body is None:
                break
            bodies.append(body)
            done.append(self.condition(body, pos))
        return bodies

    def run(self) -> Theory:
        bodies = self.cover(Side("p_w", F.lit(True)), Side("n_w", F.lit(True)), 0)
        target = self.settings.target
        rules = tuple(Rule(target, tuple(b)) for b in bodies)
        return Theory(target, rules, tuple(self.exceptions), listed_side=self.listed_side).reachable()

    def with_ids(self, theory: Theory, cases: CaseTable) -> Theory:
        """The theory with the ids its lists hold, found by one filter of the cases each."""
        listed = {}
        for head in theory.listed_side:
            side = self.listed[head]
            mine = F.coalesce(F.col("is_pos"), F.lit(False)) == F.lit(side.weight == "p_w")
            listed[head] = cases.df.where(side.where & mine).select("case_id")
        return replace(theory, listed=listed)


def grouped_bias(base: Weighted) -> Bias:
    """Modes read off grouped cases, which hold every literal of the cases."""
    return derive_bias(CaseTable(base.df, base.attrs, base.unary))


def learn_rules(
    cases: CaseTable | Weighted,
    bias: Bias | None = None,
    settings: LearnSettings | None = None,
    post_prune: bool = True,
) -> Theory:
    """Learn a theory for the positive cases."""
    from .prune import prune

    settings = settings or LearnSettings()
    if settings.listed and isinstance(cases, Weighted):
        raise ValueError("grouped cases have no ids to list")
    base = cases if isinstance(cases, Weighted) else weigh(cases)
    bias = bias or grouped_bias(base)
    search = GreedySearch(base, bias, settings)
    try:
        theory = search.run()
        if post_prune:
            theory = prune(search.df, theory)
        return search.with_ids(theory, cases) if theory.listed_side else theory
    finally:
        search.close()


def grow_steps(
    cases: CaseTable, bias: Bias, steps: int, settings: LearnSettings | None = None
) -> list[tuple[Literal, int, int]]:
    """The first literals of the first clause, with what they cover."""
    search = GreedySearch(weigh(cases), bias, settings or LearnSettings())
    try:
        pos, neg = Side("p_w", F.lit(True)), Side("n_w", F.lit(True))
        n_pos, n_neg = search.count(pos, neg)
        taken: list[tuple[Literal, int, int]] = []
        while len(taken) < steps:
            found = search.best_literal([t[0] for t in taken], pos, neg, n_pos, n_neg)
            if found is None:
                break
            taken.append(found)
            lit, n_pos, n_neg = found
            holds = literal_condition(lit, search.df)
            pos, neg = pos.within(holds), neg.within(holds)
        return taken
    finally:
        search.close()

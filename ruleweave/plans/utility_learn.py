"""Rules from high-utility itemsets of feature attributions.

The literals that pushed a case towards its class are a transaction with the size of the
push as utility. The best itemset of the positives in play becomes a rule body; the
negatives it covers are explained by itemsets of their own, which become exceptions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import to_utility
from ..operators.coverage import prefix_coverage
from ..operators.prep import CaseTable
from ..operators.utility import mine, with_after
from ..rules import Literal, Rule, Theory, any_of, rule_condition
from ..session import materialize
from .learn import Side
from .prune import prune


@dataclass(frozen=True)
class UtilitySettings:
    """``min_accuracy`` keeps a rule. Exceptions are added until at most ``leftover`` of
    the covered negatives remain. ``max_failures`` rejected itemsets in a row end the
    search; ``max_rules`` ends it earlier. ``lookahead`` itemsets are mined at once.
    """

    target: str = "positive"
    min_accuracy: float = 0.8
    leftover: float = 0.3
    max_failures: int | None = None
    max_rules: int | None = None
    top_per_case: int | None = None
    lookahead: int = 5
    truncate: bool = False


def utility_base(cases: CaseTable, top: int | None = None, truncate: bool = False) -> DataFrame:
    """Cases grouped by attributes, class and items: ``u_<attr>`` sums, ``p_w``, ``n_w``.

    ``cases`` carries ``phi_<attr>``. An item is present when its attribution points to
    the case's own class; with more than ``top`` of them the largest stay. Cases that
    agree in attributes and items are one row.
    """
    utils: dict[str, Column] = {}
    for a in cases.attrs:
        phi = F.col(f"phi_{a}")
        towards = (F.col("is_pos") & (phi > 0)) | (~F.col("is_pos") & (phi < 0))
        utils[a] = F.when(towards & F.col(a).isNotNull(), to_utility(phi, truncate))
    df = cases.df.select("is_pos", *[F.col(a).cast("string").alias(a) for a in cases.attrs],
                         *[u.alias(f"u_{a}") for a, u in utils.items()])
    if top is not None and len(cases.attrs) > top:
        order = F.array_sort(
            F.array_compact(
                F.array(
                    *[
                        F.when(F.col(f"u_{a}").isNotNull(),
                               F.struct((-F.col(f"u_{a}")).alias("neg"), F.lit(a).alias("attr")))
                        for a in cases.attrs
                    ]
                )
            )
        )
        df = df.withColumn("kept__", F.transform(F.slice(order, 1, top), lambda e: e["attr"]))
        df = df.withColumns(
            {f"u_{a}": F.when(F.array_contains("kept__", a), F.col(f"u_{a}")) for a in cases.attrs}
        )
    present = [F.col(f"u_{a}").isNotNull().alias(f"has_{a}") for a in cases.attrs]
    pos = F.col("is_pos").cast("bigint")
    grouped = df.groupBy("is_pos", *cases.attrs, *present).agg(
        F.sum(pos).alias("p_w"),
        F.sum(1 - pos).alias("n_w"),
        *[F.sum(f"u_{a}").alias(f"u_{a}") for a in cases.attrs],
    )
    return materialize(grouped)


def trim_length(prefix_weights: dict[int, int], size: int) -> int:
    """Shortest prefix that covers no more than the whole body, at least one literal.

    ``prefix_weights`` maps the first failing position to the weight of such cases.
    """
    best = prefix_weights.get(size, 0)
    covered = best
    keep = size
    for length in range(size - 1, 0, -1):
        covered += prefix_weights.get(length, 0)
        if covered > best:
            break
        keep = length
    return keep


class UtilitySearch:
    def __init__(self, base: DataFrame, attrs: Sequence[str], settings: UtilitySettings):
        self.df = base.persist(StorageLevel.MEMORY_AND_DISK)
        self.attrs = list(attrs)
        self.settings = settings
        self.used: set[tuple[str, ...]] = set()
        self.exceptions: list[Rule] = []
        self.next_ab = 0
        # Mined itemsets stay valid while the positives in play do not change.
        self.mined: tuple[object, list[tuple[str, ...]], DataFrame | None] = (None, [], None)

    def close(self) -> None:
        self.df.unpersist()

    def count(self, *sides: Side) -> list[int]:
        row = self.df.agg(*[F.sum(s.count).alias(f"c{i}") for i, s in enumerate(sides)]).first()
        return [int(v or 0) for v in row]

    def condition(self, body: Sequence[Literal]) -> Column:
        theory = Theory(self.settings.target, (), tuple(self.exceptions))
        return rule_condition(Rule(self.settings.target, tuple(body)), self.df, theory)

    # -- itemsets -----------------------------------------------------------

    def items(self) -> Column:
        """The items of a row, in one order for all rows."""
        return F.array_compact(
            F.array(
                *[
                    F.when(
                        F.col(f"has_{a}"),
                        F.struct(
                            F.concat(F.lit(f"{a}="), F.col(a)).alias("item"),
                            F.col(f"u_{a}").alias("util"),
                        ),
                    )
                    for a in self.attrs
                ]
            )
        )

    def transactions(self, side: Side) -> DataFrame:
        """Mining rows of an example set."""
        active = self.df.where(side.count > 0).select(self.items().alias("items"))
        tails = active.where(F.size("items") > 0).select(with_after(F.col("items")).alias("tail"))
        return materialize(tails)

    def next_body(self, side: Side, state: object) -> tuple[str, ...] | None:
        """The best itemset not used before, in the order of item weight; marks it used.

        ``state`` identifies the example set: itemsets are mined again only when it
        changed, each time deep enough to go past all used ones.
        """
        mined_state, queue, rows = self.mined
        fresh = [s for s in queue if s not in self.used]
        if mined_state != state or not fresh:
            rows = self.transactions(side)
            k = len(self.used) + self.settings.lookahead
            found = mine(rows, k, merged=True).collect()  # k rows at most
            found.sort(key=lambda r: (-r["util"], len(r["itemset"]), r["itemset"]))
            queue = [tuple(r["itemset"]) for r in found]
            self.mined = (state, queue, rows)
            fresh = [s for s in queue if s not in self.used]
        if not fresh:
            return None
        self.used.add(fresh[0])
        if len(fresh[0]) == 1:
            return fresh[0]
        weights = self.item_weights(rows, fresh[0])
        return tuple(sorted(fresh[0], key=lambda i: (weights[i], i)))

    def item_weights(self, rows: DataFrame, items: tuple[str, ...]) -> dict[str, int]:
        """Summed totals of the transactions that hold each of the items."""
        total = F.aggregate("tail", F.lit(0).cast("bigint"), lambda acc, e: acc + e["util"])
        names = F.transform("tail", lambda e: e["item"])
        row = rows.select(total.alias("total"), names.alias("names")).agg(
            *[
                F.sum(F.when(F.array_contains("names", item), F.col("total"))).alias(f"w{i}")
                for i, item in enumerate(items)
            ]
        ).first()
        return {item: row[f"w{i}"] for i, item in enumerate(items)}

    def clause(self, pos: Side, neg: Side, state: object) -> list[Literal] | None:
        """Body from the next itemset; literals at its end go while no negative enters."""
        items = self.next_body(pos, state)
        if items is None:
            return None
        body = [Literal(*item.split("=", 1)) for item in items]
        if len(body) == 1:
            return body
        weights = prefix_coverage(self.df, Rule(self.settings.target, tuple(body)), neg.count)
        per_length = {r["len"]: int(r["weight"] or 0) for r in weights.collect()}
        return body[: trim_length(per_length, len(body))]

    # -- the loop -----------------------------------------------------------

    def rule(self, pos: Side, neg: Side, state: object) -> tuple[list[Literal] | None, bool]:
        """(body or None if rejected, whether an itemset was left to try)."""
        body = self.clause(pos, neg, state)
        if body is None:
            return None, False
        holds = self.condition(body)
        pos, neg = pos.within(holds), neg.within(holds)
        n_pos, n_neg = self.count(pos, neg)
        if n_pos / (n_pos + n_neg) >= self.settings.min_accuracy:
            return body, True
        saved = self.mined
        bodies = self.exception_bodies(pos, neg, n_pos, n_neg, (state, tuple(body)))
        self.mined = saved
        if not bodies:
            return None, True
        head = f"ab{self.next_ab}"
        self.next_ab += 1
        self.exceptions.extend(Rule(head, tuple(b)) for b in bodies)
        body = [*body, Literal(head, None, True)]
        limited = self.condition(body[-1:])
        p_left, n_left = self.count(pos.within(limited), neg.within(limited))
        accuracy = (p_left + n_neg - n_left) / (n_pos + n_neg)
        if accuracy >= self.settings.min_accuracy:
            return body, True
        self.exceptions = [r for r in self.exceptions if r.head != head]
        return None, True

    def exception_bodies(
        self, pos: Side, neg: Side, n_pos: int, n_neg: int, state: object
    ) -> list[list[Literal]]:
        """Itemsets of the covered negatives until few are left, by the number of positives."""
        limit = max(1.0, self.settings.leftover * n_pos)
        bodies: list[list[Literal]] = []
        left, remaining = neg, n_neg
        while remaining > limit:
            body = self.clause(left, pos, (state, len(bodies)))
            if body is None:
                break
            bodies.append(body)
            left = left.within(~self.condition(body))
            remaining = self.count(left)[0]
        return bodies

    def run(self) -> Theory:
        pos, neg = Side("p_w", F.lit(True)), Side("n_w", F.lit(True))
        rules: list[Rule] = []
        done: list[Column] = []
        failures = 0
        limit = self.settings.max_rules
        while (self.settings.max_failures is None or failures < self.settings.max_failures) and (limit is None or len(rules) < limit):
            left = pos.within(~any_of(done))
            if self.count(left)[0] == 0:
                break
            body, more = self.rule(left, neg, len(rules))
            if body is None:
                failures += 1
                if not more:
                    break
                continue
            failures = 0
            rules.append(Rule(self.settings.target, tuple(body)))
            done.append(self.condition(body))
        return Theory(self.settings.target, tuple(rules), tuple(self.exceptions)).reachable()


def learn_utility_rules(
    cases: CaseTable, settings: UtilitySettings | None = None, post_prune: bool = True
) -> Theory:
    """Learn rules from the attributions ``phi_<attr>`` of a case table."""
    settings = settings or UtilitySettings()
    base = utility_base(cases, settings.top_per_case, settings.truncate)
    search = UtilitySearch(base, cases.attrs, settings)
    try:
        theory = search.run()
        return prune(search.df, theory) if post_prune else theory
    finally:
        search.close()


def first_clause(cases: CaseTable, settings: UtilitySettings | None = None) -> list[Literal]:
    """Body of the first clause, before any exception."""
    settings = settings or UtilitySettings()
    search = UtilitySearch(utility_base(cases, settings.top_per_case), cases.attrs, settings)
    try:
        return search.clause(Side("p_w", F.lit(True)), Side("n_w", F.lit(True)), 0) or []
    finally:
        search.close()

"""Clauses over several tables: literals with variables are equi joins.

``tables`` maps a predicate to a DataFrame with columns ``a0``, ``a1`` ... Arguments are
terms: a bare word that starts with a capital or an underscore is a variable, any other is a
constant, in quotes where it has to be (``rules.quoted``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import is_variable, unquoted
from .prep import CaseTable

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Atom:
    """``pred(args)``, possibly negated; the domain table of a literal with variables."""

    pred: str
    args: tuple[str, ...]
    negated: bool = False

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(a for a in self.args if is_variable(a)))

    def text(self) -> str:
        inner = f"{self.pred}({','.join(self.args)})"
        return f"not({inner})" if self.negated else inner


def unify(df: DataFrame, *columns: str) -> DataFrame:
    """Keep the rows in which all these places hold the same value."""
    for other in columns[1:]:
        df = df.where(F.col(columns[0]) == F.col(other))
    return df


def atom_table(atom: Atom, tables: Tables) -> DataFrame:
    """Bindings of one atom by itself: one column per variable."""
    df = tables[atom.pred]
    for i, arg in enumerate(atom.args):
        if not is_variable(arg):
            df = df.where(F.col(f"a{i}") == F.lit(unquoted(arg)))
    places: dict[str, list[str]] = {}
    for i, arg in enumerate(atom.args):
        if is_variable(arg):
            places.setdefault(arg, []).append(f"a{i}")
    for columns in places.values():
        df = unify(df, *columns)
    return df.select(*[F.col(cols[0]).alias(var) for var, cols in places.items()])


def bind(bindings: DataFrame, body: Sequence[Atom], tables: Tables, once: bool = False) -> DataFrame:
    """All bindings that prove the body, one column per variable.

    Negated atoms are anti joins on the variables bound so far. ``once`` tells that no table
    holds a fact twice.
    """
    for atom in body:
        own = atom_table(atom, tables)
        shared = [v for v in atom.variables if v in bindings.columns]
        if not shared:
            raise ValueError(f"{atom.text()} shares no variable with the clause")
        if atom.negated:
            bindings = bindings.join(own.select(*shared).distinct(), shared, "left_anti")
        elif len(shared) == len(atom.variables):
            bindings = bindings.join(own if once else own.distinct(), shared, "left_semi")
        else:
            bindings = bindings.join(own if once else own.distinct(), shared)
    return bindings


def covered_bindings(
    examples: DataFrame, head_vars: Sequence[str], body: Sequence[Atom], tables: Tables
) -> DataFrame:
    """Examples for which the body can be proved: each once, however many proofs it has.

    Proofs are collected from the last atom backwards: an atom whose new variables are
    used by later atoms is first reduced by them, so every join with the examples is a
    semi join and no example is multiplied.
    """
    chain, rest = _split_existential(head_vars, body)
    if rest is not None:
        # Later atoms share variables with several earlier ones: bind, then keep heads.
        proved = bind(examples, body, tables).select(*head_vars).distinct()
        return examples.join(proved, list(head_vars), "left_semi")
    for atom, inner in chain:
        own = atom_table(atom, tables)
        if inner:
            own = covered_bindings(own.distinct(), atom.variables, inner, tables)
        shared = [v for v in atom.variables if v in head_vars]
        how = "left_anti" if atom.negated else "left_semi"
        # Distinct keys: however often a key occurs, each task sends it once.
        examples = examples.join(own.select(*shared).distinct(), shared, how)
    return examples


def _split_existential(
    head_vars: Sequence[str], body: Sequence[Atom]
) -> tuple[list[tuple[Atom, list[Atom]]], list[Atom] | None]:
    """Split a body into atoms on head variables, each with the atoms hanging off it.

    The second part is not None when the body is not such a tree.
    """
    chain: list[tuple[Atom, list[Atom]]] = []
    owner: dict[str, int] = {}
    for atom in body:
        new = [v for v in atom.variables if v not in head_vars]
        on_head = any(v in head_vars for v in atom.variables)
        owners = {owner[v] for v in new if v in owner}
        if on_head and not owners:
            chain.append((atom, []))
            owner.update({v: len(chain) - 1 for v in new if not atom.negated})
        elif not on_head and len(owners) == 1:
            index = owners.pop()
            chain[index][1].append(atom)
            owner.update({v: index for v in new if not atom.negated})
        else:
            return [], list(body)
    return chain, None


def clause_counts(
    examples: DataFrame, head_vars: Sequence[str], body: Sequence[Atom], tables: Tables
) -> DataFrame:
    """(p_cases, p_tuples, n_tuples): covered positives, and proofs on either side.

    Proofs are counted, not cases, once a clause binds new variables.
    """
    bound = bind(examples, body, tables)
    per_case = bound.groupBy(*head_vars, "is_pos").agg(F.count(F.lit(1)).alias("proofs"))
    zero = F.lit(0).cast("bigint")
    return per_case.agg(
        F.count_if("is_pos").alias("p_cases"),
        F.coalesce(F.sum(F.when(F.col("is_pos"), F.col("proofs"))), zero).alias("p_tuples"),
        F.coalesce(F.sum(F.when(~F.col("is_pos"), F.col("proofs"))), zero).alias("n_tuples"),
    )


def constant_candidates(
    bindings: DataFrame, pred: str, key_var: str, tables: Tables, case_var: str
) -> DataFrame:
    """Counts of ``pred(key_var, v)`` for every constant v in one pass.

    Returns (pred, val, p_cases, p_tuples, n_tuples) over the current bindings.
    """
    own = tables[pred].select(F.col("a0").alias(key_var), F.col("a1").alias("val")).distinct()
    joined = bindings.join(own, key_var)
    # Only positive cases are counted, so that the proofs of all negatives go together.
    case = F.when(F.col("is_pos"), F.col(case_var)).alias("case__")
    per_case = joined.groupBy(case, "val", "is_pos").agg(F.count(F.lit(1)).alias("proofs"))
    zero = F.lit(0).cast("bigint")
    return per_case.groupBy("val").agg(
        F.count_if("is_pos").alias("p_cases"),
        F.coalesce(F.sum(F.when(F.col("is_pos"), F.col("proofs"))), zero).alias("p_tuples"),
        F.coalesce(F.sum(F.when(~F.col("is_pos"), F.col("proofs"))), zero).alias("n_tuples"),
    ).select(F.lit(pred).alias("pred"), "val", "p_cases", "p_tuples", "n_tuples")


def determinacy(bindings: DataFrame, atom: Atom, tables: Tables, once: bool = False) -> DataFrame:
    """How many ways an atom extends the bindings: (p_min, p_max, n_max).

    The atom's own table is counted per key first, so a hot key is one row before the
    join; bindings without a match count as zero. ``once`` as for ``bind``.
    """
    shared = [v for v in atom.variables if v in bindings.columns]
    own = atom_table(atom, tables)
    keys = (own if once else own.distinct()).groupBy(*shared).agg(
        F.count(F.lit(1)).alias("ways")
    )
    counted = bindings.join(keys, shared, "left").withColumn(
        "ways", F.coalesce("ways", F.lit(0))
    )
    return counted.agg(
        F.min(F.when(F.col("is_pos"), F.col("ways"))).alias("p_min"),
        F.max(F.when(F.col("is_pos"), F.col("ways"))).alias("p_max"),
        F.max(F.when(~F.col("is_pos"), F.col("ways"))).alias("n_max"),
    )


def is_determinate(bindings: DataFrame, atom: Atom, tables: Tables, once: bool = False) -> bool:
    """Binds something new, exactly one way on positives and at most one on negatives."""
    if atom.negated or all(v in bindings.columns for v in atom.variables):
        return False
    row = determinacy(bindings, atom, tables, once).first()
    return row["p_min"] == 1 and row["p_max"] == 1 and (row["n_max"] or 0) <= 1


def determinate_literals(
    bindings: DataFrame, candidates: Sequence[Atom], tables: Tables, bound: int
) -> tuple[DataFrame, list[Atom]]:
    """Determinate atoms reachable in at most ``bound`` steps, and the bindings with them.

    Each step tests the atoms that touch a known variable and joins those that qualify;
    their new variables open the next step. Such joins never multiply rows. Negatives
    without a match keep nulls, so that no case is lost for later rules.
    """
    added: list[Atom] = []
    for _ in range(bound):
        step = [
            atom
            for atom in candidates
            if atom not in added
            and any(v in bindings.columns for v in atom.variables)
            and is_determinate(bindings, atom, tables)
        ]
        if not step:
            break
        for atom in step:
            shared = [v for v in atom.variables if v in bindings.columns]
            bindings = bindings.join(atom_table(atom, tables).distinct(), shared, "left")
        added.extend(step)
    return bindings, added


def closed_world_counts(
    positives: DataFrame, proved: DataFrame, head_vars: Sequence[str], domain_sizes: Mapping[str, int]
) -> DataFrame:
    """(p_cov, n_cov) of a clause with several head variables in a closed world.

    ``proved`` holds the bindings of the head variables the body speaks about. Head
    variables it leaves open range over their whole domain, so the covered pairs are
    counted by multiplication; the product of the domains is never built.
    """
    bound_vars = [v for v in head_vars if v in proved.columns]
    free = 1
    for v in head_vars:
        if v not in bound_vars:
            free *= domain_sizes[v]
    distinct = proved.select(*bound_vars).distinct()
    covered_total = distinct.agg((F.count(F.lit(1)) * F.lit(free)).alias("cov"))
    p_cov = positives.select(*head_vars).distinct().join(distinct, bound_vars, "left_semi").agg(
        F.count(F.lit(1)).alias("p_cov")
    )
    # Two single-row aggregates put side by side by a constant key.
    one = F.lit(1).alias("one")
    return (
        covered_total.select(one, "cov")
        .join(p_cov.select(one, "p_cov"), "one")
        .select("p_cov", (F.col("cov") - F.col("p_cov")).alias("n_cov"))
    )


def relational_cases(
    bindings: DataFrame,
    case_var: str,
    attributes: Mapping[str, tuple[str, str]],
    tables: Tables,
) -> CaseTable:
    """A case table from bindings: attribute -> (predicate, variable it describes).

    Predicates with several values per key become set-valued attributes. This is how
    rules over related tables are learned: reach the tables by determinate literals,
    then learn on the attributes found there.
    """
    df = bindings.withColumnRenamed(case_var, "case_id")
    for attr, (pred, var) in attributes.items():
        key = "case_id" if var == case_var else var
        values = tables[pred].select(F.col("a0").alias(key), F.col("a1").alias("v")).distinct()
        per_key = values.groupBy(key).agg(F.array_sort(F.collect_set("v")).alias(attr))
        df = df.join(per_key, key, "left")
    return CaseTable(df.select("case_id", "is_pos", *attributes), tuple(attributes))



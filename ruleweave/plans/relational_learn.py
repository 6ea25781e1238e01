"""Greedy learning of clauses over several tables.

A clause's state is its binding table: one row per proof, with a column for every variable.
Candidates are atoms whose places are old variables of the place's type, new variables or
constants. Patterns that look only at head variables are counted by one join on cases, all others
by one join on proofs: bindings send a row per choice of old variables with their values, tables
a row per kind of pattern with those places' values and constants and in how many ways the rest
can be filled, which is counted once per search. Only counts per candidate reach the driver; the
chosen atom then extends the binding table.

Where nothing gains, literals that bind something new in exactly one way may be added, so
that the search can go on in the tables they lead to; and negatives that stay covered can be
told apart by exceptions, which are learned by the same search with the sides swapped, or be
listed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import information_gain, quoted_term
from ..operators.clauses import Clause, Program
from ..operators.relational import Atom, Tables, bind, covered_bindings, is_determinate
from ..session import materialize


@dataclass(frozen=True)
class Place:
    """An argument place: a variable or a constant of some type."""

    kind: str
    type: str


@dataclass(frozen=True)
class RelationalModes:
    """The target's argument types, and the places of every predicate a body may use."""

    head: tuple[str, ...]
    predicates: Mapping[str, tuple[Place, ...]]


def modes_from_rows(modes: DataFrame) -> RelationalModes:
    """Modes from declarations (pred, arg_no, kind, type, is_head), which a person writes."""
    rows = sorted(modes.collect(), key=lambda r: (r["pred"], r["arg_no"]))
    head = tuple(r["type"] for r in rows if r["is_head"])
    preds: dict[str, tuple[Place, ...]] = {}
    for r in rows:
        if not r["is_head"]:
            preds[r["pred"]] = (*preds.get(r["pred"], ()), Place(r["kind"], r["type"]))
    return RelationalModes(head, preds)


@dataclass(frozen=True)
class RelationalSettings:
    """``negation`` proposes negated literals too, ``det_bound`` is the number of steps of
    determinate literals tried where nothing gains, ``exceptions`` learns exceptions for
    negatives that stay covered and ``listed`` lists them if there is no pattern in them.
    With ``rising`` a literal must gain more than the one before it, or exceptions are looked
    for; without it any gain will do, and literals with new variables may go on gaining a
    little forever unless ``max_literals`` ends them. ``max_rules`` bounds the rules per head
    (None: until nothing is left to explain or nothing more can be learned).
    """

    target: str = "positive"
    min_accuracy: float = 0.99
    negation: bool = False
    det_bound: int = 0
    exceptions: bool = True
    listed: bool = False
    rising: bool = True
    max_literals: int | None = None
    max_rules: int | None = None
    max_depth: int | None = None


@dataclass(frozen=True)
class Pattern:
    """An atom without its constants: ``args`` has None at constant places."""

    pred: str
    args: tuple[str | None, ...]
    new: tuple[tuple[str, str], ...]  # (variable, type)

    @property
    def old_places(self) -> list[int]:
        fresh = {v for v, _ in self.new}
        return [i for i, a in enumerate(self.args) if a is not None and a not in fresh]

    @property
    def key(self) -> tuple[str, ...]:
        """The old variables, place by place."""
        return tuple(self.args[i] for i in self.old_places)

    @property
    def shape(self) -> tuple:
        """What tables need to know: the predicate, its old places, and equal new ones."""
        fresh = [v for v, _ in self.new]
        return self.pred, tuple("c" if a is None else fresh.index(a) if a in fresh else "o" for a in self.args)


def patterns(
    modes: RelationalModes, variables: Mapping[str, str], new_names: Sequence[str], allow_new: bool = True,
    body: Sequence[Atom] = (),
) -> list[Pattern]:
    """All patterns that share a variable with the clause, without the atoms of its ``body``:
    those change no count."""
    out: list[Pattern] = []

    def fill(pred: str, places: Sequence[Place], args: tuple, new: tuple) -> Iterator[Pattern]:
        if len(args) == len(places):
            if any(a is not None and a in variables for a in args):
                yield Pattern(pred, args, new)
            return
        place = places[len(args)]
        if place.kind == "const":
            yield from fill(pred, places, (*args, None), new)
            return
        for name, kind in (*variables.items(), *new):
            if kind == place.type:
                yield from fill(pred, places, (*args, name), new)
        if allow_new:
            name = new_names[len(new)]
            yield from fill(pred, places, (*args, name), (*new, (name, place.type)))

    for pred, places in modes.predicates.items():
        out += [p for p in fill(pred, places, (), ()) if None in p.args or Atom(p.pred, p.args) not in body]
    return out


def prepared_tables(tables: Tables, modes: RelationalModes) -> dict[str, DataFrame]:
    """The relations a body may use, as text and without repeated or incomplete facts.

    Each is written once, so that views are not derived anew for every literal.
    """
    return {
        p: materialize(
            tables[p].select(*[F.col(f"a{i}").cast("string").alias(f"a{i}") for i in range(len(places))])
            .dropna().distinct()
        )
        for p, places in modes.predicates.items()
    }


def _key(values: Sequence[Column]) -> Column:
    """Values as one text that tells them apart; null if one is missing."""
    texts = [v.cast("string") for v in values]
    return texts[0] if len(texts) == 1 else F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts])


def is_open(shape: tuple) -> bool:
    """Whether a pattern of this shape has places for new variables."""
    return any(isinstance(slot, int) for slot in shape[1])


def ways_to_fill(shape: tuple, tables: Tables) -> DataFrame:
    """(key, consts, ways): per filling of old places and constants, the ways to fill the rest,
    from prepared tables. A hot key is one row."""
    pred, slots = shape
    same = F.lit(True)
    for slot in {s for s in slots if isinstance(s, int)}:
        first, *others = [i for i, s in enumerate(slots) if s == slot]
        for other in others:
            same &= F.col(f"a{first}") == F.col(f"a{other}")
    consts = F.array(*[F.col(f"a{i}") for i, s in enumerate(slots) if s == "c"]).cast("array<string>")
    filled = tables[pred].where(same).select(
        _key([F.col(f"a{i}") for i, s in enumerate(slots) if s == "o"]).alias("key"), consts.alias("consts")
    )
    # Where nothing is left open, a fact fills the pattern, and facts are distinct.
    if not is_open(shape):
        return filled.withColumn("ways", F.lit(1).cast("bigint"))
    return filled.groupBy("key", "consts").agg(F.count(F.lit(1)).alias("ways"))


def _families(found: Sequence[Pattern]) -> dict[tuple, int]:
    """Numbers for ("key", old variables) and ("shape", shape): the same where patterns link them."""
    family: dict[tuple, int] = {}
    for p in found:
        mine = family.setdefault(("key", p.key), len(family))
        other = family.setdefault(("shape", p.shape), len(family))
        family = {name: mine if number == other else number for name, number in family.items()}
    return family


def extension_counts(
    bindings: DataFrame, head_vars: Sequence[str], found: Sequence[Pattern], tables: Tables, negation: bool = False,
    counted: Mapping[tuple, DataFrame] | None = None, totals: tuple[int, int, int] | None = None,
    cases: DataFrame | None = None,
) -> DataFrame:
    """Counts of every candidate: (pattern, consts, negated, p_cases, p_tuples, n_tuples).

    ``bindings`` has a row per proof with ``is_pos``, ``tables`` are prepared. Negated candidates hold where the atom
    cannot be proved; their counts are what the clause has less what the atom takes away, so
    they need no scan of their own. ``counted`` has what ``ways_to_fill`` gives for some shapes, ``totals`` what
    ``clause_totals`` and ``cases`` what ``proofs_by_case`` gives, where they are known.
    """
    cases = proofs_by_case(bindings, head_vars) if cases is None else cases
    # A negated candidate looks at whole cases, so that cases without a name take no part.
    seen, seen_cases = (
        df.dropna(subset=list(head_vars)) if negation else df for df in (bindings, cases)
    )
    sides = [*head_vars, "is_pos"]
    proofs = F.count(F.lit(1)).alias("proofs")

    def met(rows: DataFrame, chosen: Sequence[int], whole_cases: bool) -> DataFrame:
        """(head variables, is_pos, pattern, consts, proofs, ways) of the chosen patterns."""
        some = [found[i] for i in chosen]
        family = _families(some)
        keys, shapes = list(dict.fromkeys(p.key for p in some)), list(dict.fromkeys(p.shape for p in some))
        wanted = F.array(*[
            F.struct(
                _key([F.col(v) for v in key]).alias("key"), F.lit(family["key", key]).alias("family"), F.lit(i).alias("slot")
            )
            for i, key in enumerate(keys)
        ])
        # Only positive cases are counted, so that the proofs of all negatives go together.
        case = [F.when(F.col("is_pos"), F.col(v)).alias(v) for v in head_vars]
        more = ["proofs"] if whole_cases else []
        keyed = rows.select(*sides, *more, F.explode(wanted).alias("w")).select(*case, "is_pos", *more, "w.*")
        if not whole_cases:
            # Proofs that agree in all a candidate can see are counted before the join.
            keyed = keyed.groupBy(*sides, "key", "family", "slot").agg(proofs)
        sources = reduce(DataFrame.unionByName, [
            ((counted or {}).get(shape) or ways_to_fill(shape, tables)).withColumns(
                {"family": F.lit(family["shape", shape]), "shape": F.lit(j)}
            )
            for j, shape in enumerate(shapes)
        ])
        number = {(p.key, p.shape): i for i, p in zip(chosen, some, strict=True)}
        numbers = F.array(*[F.lit(number.get((key, shape))).cast("int") for key in keys for shape in shapes])
        # Keys are texts and lead the join's order, so that rows are sorted by their first bytes.
        return keyed.join(sources, ["key", "family"]).withColumn(
            "pattern", F.get(numbers, F.col("slot") * len(shapes) + F.col("shape"))
        ).where(F.col("pattern").isNotNull())

    by_case = [i for i, p in enumerate(found) if set(p.key) <= set(head_vars)]
    by_proof = [i for i in range(len(found)) if i not in by_case]
    tuples, parts = F.col("proofs") * F.col("ways"), []
    if by_case:
        # A case, a pattern and constants meet once: there is nothing to add up.
        parts.append(met(seen_cases, by_case, True).select(
            *sides, "pattern", "consts", tuples.alias("tuples"), "proofs"
        ))
    if by_proof:
        parts.append(met(seen, by_proof, False).groupBy(*sides, "pattern", "consts").agg(
            F.sum(tuples).alias("tuples"), F.sum("proofs").alias("proofs")
        ))
    per_case = reduce(DataFrame.unionByName, parts)
    zero = F.lit(0).cast("bigint")

    def total(value: str, side: Column) -> Column:
        return F.coalesce(F.sum(F.when(side, F.col(value))), zero)

    pos, neg = F.col("is_pos"), ~F.col("is_pos")
    if negation:
        # Cases all of whose proofs are taken away are no longer covered.
        all_proofs = cases.groupBy(*head_vars).agg(F.sum("proofs").alias("all_proofs"))
        per_case = per_case.join(all_proofs, list(head_vars), "left")
    else:
        per_case = per_case.withColumn("all_proofs", F.lit(-1))
    counts = per_case.groupBy("pattern", "consts").agg(
        F.count_if(pos).alias("p_cases"),
        total("tuples", pos).alias("p_tuples"),
        total("tuples", neg).alias("n_tuples"),
        total("proofs", pos).alias("p_met"),
        total("proofs", neg).alias("n_met"),
        F.count_if(pos & (F.col("proofs") == F.col("all_proofs"))).alias("p_gone"),
    )
    plain = counts.select("pattern", "consts", F.lit(False).alias("negated"), "p_cases", "p_tuples", "n_tuples")
    if not negation:
        return plain
    n_cases, p, n = totals or clause_totals(bindings, head_vars, cases)
    return plain.unionByName(
        counts.select(
            "pattern", "consts", F.lit(True).alias("negated"),
            (F.lit(n_cases) - F.col("p_gone")).alias("p_cases"),
            (F.lit(p) - F.col("p_met")).alias("p_tuples"),
            (F.lit(n) - F.col("n_met")).alias("n_tuples"),
        )
    )


def proofs_by_case(bindings: DataFrame, head_vars: Sequence[str]) -> DataFrame:
    """(head variables, is_pos, proofs): one row per covered case."""
    return bindings.groupBy(*head_vars, "is_pos").agg(F.count(F.lit(1)).alias("proofs"))


def clause_totals(
    bindings: DataFrame, head_vars: Sequence[str], cases: DataFrame | None = None
) -> tuple[int, int, int]:
    """Covered positive cases, and proofs of positives and negatives; ``cases`` is what
    ``proofs_by_case`` gives, where it is known."""
    row = (proofs_by_case(bindings, head_vars) if cases is None else cases).agg(
        F.count_if("is_pos").alias("cases"),
        F.sum(F.when(F.col("is_pos"), F.col("proofs"))).alias("p"),
        F.sum(F.when(~F.col("is_pos"), F.col("proofs"))).alias("n"),
    ).first()
    return row["cases"], row["p"] or 0, row["n"] or 0


def ranked_extensions(
    bindings: DataFrame, head_vars: Sequence[str], found: Sequence[Pattern], tables: Tables, negation: bool = False,
    counted: Mapping[tuple, DataFrame] | None = None, totals: tuple[int, int, int] | None = None,
    cases: DataFrame | None = None,
) -> DataFrame:
    """Candidates that gain: (literal, pattern, consts, negated, counts, gain), best first.

    Ties go to fewer new variables, to plain literals, then by text. ``counted``, ``totals`` and
    ``cases`` as for ``extension_counts``.
    """
    totals = totals or clause_totals(bindings, head_vars, cases)
    _, p, n = totals
    spark = bindings.sparkSession
    names = spark.createDataFrame(
        [(i, f.pred, list(f.args), len(f.new)) for i, f in enumerate(found)],
        "pattern int, pred string, args array<string>, n_new int",
    )
    counts = extension_counts(bindings, head_vars, found, tables, negation, counted, totals, cases)
    info = information_gain(F.col("p_tuples"), F.col("n_tuples"), F.lit(p), F.lit(n))
    # The gain weighs the change of information by retained cases, not by proofs.
    gain = F.when(F.col("p_tuples") > 0, info / F.col("p_tuples") * F.col("p_cases")).otherwise(0.0)
    named = counts.join(F.broadcast(names), "pattern")
    placed = F.aggregate(
        "args",
        F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).alias("nth")),
        lambda acc, a: F.struct(
            F.concat(acc["done"], F.array(F.coalesce(a, quoted_term(F.get(F.col("consts"), acc["nth"]))))).alias("done"),
            (acc["nth"] + a.isNull().cast("int")).alias("nth"),
        ),
    )["done"]
    atom = F.concat("pred", F.lit("("), F.array_join(placed, ","), F.lit(")"))
    literal = F.when(F.col("negated"), F.concat(F.lit("not("), atom, F.lit(")"))).otherwise(atom)
    return (
        named.withColumns({"literal": literal, "terms": placed, "gain": F.round(gain, 9)})
        .where("gain > 0")
        .orderBy(F.desc("gain"), "n_new", "negated", "literal")
        .select("literal", "pattern", "terms", "negated", "p_cases", "p_tuples", "n_tuples", "gain")
    )


@dataclass
class State:
    """A clause under construction: its atoms, variables with types, and bindings.

    ``cases`` has what ``proofs_by_case`` gives for the bindings, ``steps`` has the determinate literals that changed no count, with what they bind.
    """

    body: tuple[Atom, ...]
    variables: dict[str, str]
    bindings: DataFrame
    cases: DataFrame | None = None
    totals: tuple[int, int, int] = (0, 0, 0)
    steps: Mapping[Atom, frozenset[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class RelationalTheory:
    """Clauses for the target, exception clauses, and exceptions listed by case."""

    target: str
    head_vars: tuple[str, ...]
    clauses: tuple[Clause, ...]
    exceptions: tuple[Clause, ...] = ()
    listed: Mapping[str, DataFrame] = field(default_factory=dict, compare=False)

    def lines(self) -> list[str]:
        return [c.text() for c in self.clauses] + [""] + [c.text() for c in self.exceptions]

    def covered(self, cases: DataFrame, tables: Tables) -> DataFrame:
        """The cases (head variables and whatever else they have) that some clause covers."""
        known = {**tables, **self.listed}
        head = list(self.head_vars)
        domain = cases.select(*head).distinct()
        known = Program(self.exceptions).derive(known, {c.head.pred: domain for c in self.exceptions})
        proved = [covered_bindings(domain, head, c.body, known) for c in self.clauses]
        if not proved:
            return cases.limit(0)
        return cases.join(reduce(DataFrame.unionByName, proved).distinct(), head, "left_semi")


class Prepared:
    """Examples and relations of a search, each written once, and the ways to fill open shapes
    counted so far. Searches that differ only in their settings can share them.
    """

    def __init__(self, examples: DataFrame, head_vars: Sequence[str], tables: Tables, modes: RelationalModes):
        cases = examples.where(F.col("is_pos").isNotNull()).select(
            *[F.col(v).cast("string").alias(v) for v in head_vars], "is_pos"
        ).distinct()
        self.head_vars = list(head_vars)
        self.examples = materialize(cases)
        self.tables = prepared_tables(tables, modes)
        self.modes = modes
        self.counted: dict[tuple, DataFrame] = {}

    def count(self, shapes: Iterable[tuple]) -> None:
        """Counts the open ones of these shapes that have not been counted yet."""
        for shape in dict.fromkeys(shapes):
            if is_open(shape) and shape not in self.counted:
                self.counted[shape] = materialize(ways_to_fill(shape, self.tables))


class RelationalSearch:
    """Sequential covering over clauses of several tables."""

    def __init__(self, prepared: Prepared, settings: RelationalSettings):
        self.prepared = prepared
        self.head_vars, self.examples = prepared.head_vars, prepared.examples
        self.tables, self.modes = prepared.tables, prepared.modes
        self.settings = settings
        self.exceptions: list[Clause] = []
        self.listed: dict[str, DataFrame] = {}
        self.found: dict[str, DataFrame] = {}  # exception relations, once derived
        self.next_ab = 0

    # -- pieces -------------------------------------------------------------

    def start(self, cases: DataFrame) -> State:
        """The empty clause; ``cases`` has no row twice, so that each has one proof."""
        state = State((), dict(zip(self.head_vars, self.modes.head, strict=True)), cases)
        return self.measured(state, cases.withColumn("proofs", F.lit(1).cast("bigint")))

    def measured(self, state: State, cases: DataFrame | None = None) -> State:
        if cases is None:
            cases = materialize(proofs_by_case(state.bindings, self.head_vars))
        return replace(state, cases=cases, totals=clause_totals(state.bindings, self.head_vars, cases))

    def new_names(self, state: State) -> list[str]:
        """Names that are free in the clause, as many as one atom may need."""
        letters = (chr(ord("A") + i) if i < 26 else f"V{i}" for i in range(len(state.variables) + 26))
        return [v for v in letters if v not in state.variables]

    def extended(self, state: State, atom: Atom) -> State:
        """The clause with one more literal; its new variables get the types of their places."""
        variables = dict(state.variables)
        if not atom.negated:
            for arg, place in zip(atom.args, self.modes.predicates[atom.pred], strict=True):
                if place.kind == "var":
                    variables.setdefault(arg, place.type)
        bound = materialize(bind(state.bindings, [atom], self.tables, once=True))
        return self.measured(replace(state, body=(*state.body, atom), variables=variables, bindings=bound))

    def best(self, state: State, least: float = 0.0) -> tuple[Atom, float] | None:
        """The best literal and its gain, if that is more than ``least``."""
        found = patterns(self.modes, state.variables, self.new_names(state), body=state.body)
        if not found:
            return None
        self.prepared.count(p.shape for p in found)
        row = ranked_extensions(
            state.bindings, self.head_vars, found, self.tables, self.settings.negation, self.prepared.counted,
            state.totals, state.cases,
        ).first()
        if row is None or row["gain"] <= least:
            return None
        return Atom(found[row["pattern"]].pred, tuple(row["terms"]), row["negated"]), row["gain"]

    def determinate(self, state: State) -> State | None:
        """The clause with the literals that bind something new in exactly one way, within
        ``det_bound`` steps; None if there are none."""
        before = state
        for _ in range(self.settings.det_bound):
            step = state
            for p in patterns(self.modes, state.variables, self.new_names(state)):
                known = any(
                    b.pred == p.pred and not b.negated and all(b.args[i] == p.args[i] for i in p.old_places)
                    for b in step.body
                )
                if not p.new or None in p.args or known:
                    continue
                names = dict(zip([v for v, _ in p.new], self.new_names(step), strict=False))
                atom = Atom(p.pred, tuple(names.get(a, a) for a in p.args))
                if is_determinate(state.bindings, atom, self.tables, once=True):
                    wider = self.extended(step, atom)
                    idle = wider.totals == step.totals
                    steps = {**step.steps, atom: frozenset(names.values())} if idle else step.steps
                    step = replace(wider, steps=steps)
            if step is state:
                break
            state = step
        return None if state is before else state

    # -- the loop -----------------------------------------------------------

    def accuracy(self, state: State) -> float:
        _, p, n = state.totals
        return p / (p + n) if p + n else 0.0

    def grow(
        self, cases: DataFrame, depth: int, begun: tuple[State, tuple[Atom, float]] | None = None
    ) -> Clause | None:
        """One new clause, or None if no clause is good enough; ``begun`` has the empty clause
        and its best literal, where they are known."""
        state, first = begun or (self.start(cases), None)
        settings, went_on, gained = self.settings, False, 0.0
        while state.totals[1] and state.totals[2]:
            if settings.max_literals is not None and len(state.body) >= settings.max_literals:
                break
            found, first = first or self.best(state, gained if settings.rising else 0.0), None
            if found is not None:
                state, gained = self.extended(state, found[0]), found[1]
                continue
            further = None if went_on or not settings.det_bound else self.determinate(state)
            if further is None:
                break
            state, went_on = further, True
        if not state.body or not state.totals[1]:
            return None
        if state.totals[2] and settings.exceptions and (settings.max_depth is None or depth < settings.max_depth):
            name = self.learn_exceptions(state, depth)
            if name is not None:
                atom = Atom(name, tuple(self.head_vars), True)
                limited = bind(state.bindings, [atom], self.derived())
                state = self.measured(replace(state, body=(*state.body, atom), bindings=limited))
        if self.accuracy(state) < settings.min_accuracy:
            return None
        return Clause(Atom(settings.target, tuple(self.head_vars)), self.needed(state))

    @staticmethod
    def needed(state: State) -> tuple[Atom, ...]:
        """The body without determinate literals that change no count and lead nowhere."""
        kept: list[Atom] = []
        for atom in reversed(state.body):
            if atom in state.steps and not {v for a in kept for v in a.variables} & state.steps[atom]:
                continue
            kept.insert(0, atom)
        return tuple(kept)

    def derived(self) -> dict[str, DataFrame]:
        """The prepared tables and the exception relations learned so far."""
        return {**self.tables, **self.found}

    def learn_exceptions(self, state: State, depth: int) -> str | None:
        """Clauses for the negatives a clause covers, with the sides swapped."""
        swapped = materialize(
            state.bindings.select(*self.head_vars, (~F.col("is_pos")).alias("is_pos")).distinct()
        )
        clauses: list[Clause] = []
        start = self.start(swapped)
        first = self.best(start)
        if first is not None:
            clauses = self.cover(swapped, depth + 1, (start, first))
        if not clauses and not self.settings.listed:
            return None
        name = f"ab{self.next_ab}"
        self.next_ab += 1
        if clauses:
            head = Atom(name, tuple(self.head_vars))
            mine = tuple(Clause(head, c.body) for c in clauses)
            self.exceptions += mine
            domain = self.examples.select(*self.head_vars)
            self.found[name] = materialize(Program(mine).derive(self.derived(), {name: domain})[name])
        else:
            self.found[name] = self.listed[name] = swapped.where("is_pos").select(
                *[F.col(v).alias(f"a{i}") for i, v in enumerate(self.head_vars)]
            )
        return name

    def cover(
        self, cases: DataFrame, depth: int, begun: tuple[State, tuple[Atom, float]] | None = None
    ) -> list[Clause]:
        """Clauses until the positives are covered or none is found; ``begun`` is for the first."""
        clauses: list[Clause] = []
        limit = self.settings.max_rules
        while limit is None or len(clauses) < limit:
            clause, begun = self.grow(cases, depth, begun), None
            if clause is None:
                break
            clauses.append(clause)
            done = covered_bindings(
                cases.where("is_pos").select(*self.head_vars), self.head_vars, clause.body, self.derived()
            )
            left = cases.where("is_pos").join(done, self.head_vars, "left_anti")
            cases = materialize(left.unionByName(cases.where(~F.col("is_pos"))))
            if cases.where("is_pos").isEmpty():
                break
        return clauses

    def run(self) -> RelationalTheory:
        clauses = self.cover(self.examples, 0)
        used: set[str] = set()
        open_bodies = [c.body for c in clauses]
        while open_bodies:
            for atom in open_bodies.pop():
                if atom.negated and atom.pred not in used and atom.pred not in self.tables:
                    used.add(atom.pred)
                    open_bodies += [c.body for c in self.exceptions if c.head.pred == atom.pred]
        return RelationalTheory(
            self.settings.target,
            tuple(self.head_vars),
            tuple(clauses),
            tuple(c for c in self.exceptions if c.head.pred in used),
            {n: df for n, df in self.listed.items() if n in used},
        )


def learn_clauses(
    examples: DataFrame, head_vars: Sequence[str], tables: Tables, modes: RelationalModes,
    settings: RelationalSettings | None = None, prepared: Prepared | None = None,
) -> RelationalTheory:
    """Learn clauses for the positive examples.

    Values are compared as text. An example with a null head variable meets nothing, rows
    with nulls in a table prove nothing, repeated facts count once. No positive examples
    give no clauses. ``prepared`` is made of the same arguments, where several searches share it.
    """
    prepared = prepared or Prepared(examples, head_vars, tables, modes)
    return RelationalSearch(prepared, settings or RelationalSettings()).run()

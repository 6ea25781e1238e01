"""Readers for case tables and for the line-based text forms of facts, modes, items,
transactions, attributions and rules.

Each ``parse_*`` takes a DataFrame with a column ``value`` (one line per row), so parsing
is a projection that splits with the files; ``read_*`` applies it to a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import unquoted_term
from ..session import materialize

# Fixed patterns of the text formats.
FACT = r"^\s*(\w+)\(\s*([\w.]+)\s*(?:,\s*([^()]+?)\s*)?\)\s*\.\s*(?:%.*)?$"
MODE = r"^\s*#mode([hb])\((?:\s*(\d+)\s*,)?\s*(\w+)\((.*)\)\s*\)\s*$"
MODE_ARG = r"(var|const)\((\w+)\)"
CONSTANT = r"^\s*#constant\(\s*(\w+)\s*,\s*(.+?)\s*\)\s*$"
ATOM = r"(\w+)\(((?:'(?:[^']|'')*'|[^()'])*)\)\s*\."
SKIPPED = r"^\s*(?:%|:-|foil_\w+\(|$)"
VIEW = r"^\s*(\w+)\(\s*([A-Z]\w*)\s*\)\s*:-\s*(\w+)\(\s*([A-Z]\w*)\s*\)\s*\.\s*(?:%.*)?$"
ITEM = r"^\s*(\d+)->(\w+)\(\w+,(.*)\)\s*$"
ATTRIBUTION = r"^\s*data\(([^)]+)\):(\w+)\(\w+,([^)]*)\):(\S+)\s*$"
TRANSACTION = r"^\w+\(([^)]*)\)::\s*([^:]*?)\s*:\s*(\d*)\s*:\s*([^:]*?)\s*$"
TERM = r"'(?:[^']|'')*'|[^,()']+"
ANY_ATOM = r"\w+\((?:'(?:[^']|'')*'|[^()'])*\)"
HEAD_ARG = r"(?:[A-Z_]\w*|'(?:[^']|'')*')"
RULE = rf"^\s*(\w+)\(\s*({HEAD_ARG}(?:\s*,\s*{HEAD_ARG})*)\s*\)\s*:-(.*)\.\s*(?:%.*)?$"
RULE_LITERAL = rf"(?:not\b|\\\+)\s*\(?\s*{ANY_ATOM}|{ANY_ATOM}"


def read_cases(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Case table from CSV with a header; ``?`` is a missing value."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="?", enforceSchema=False)


def read_cases_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def parse_facts(lines: DataFrame) -> DataFrame:
    """Ground facts (pred, case_id, val); directives, comments and rules are skipped."""
    is_fact = F.col("value").rlike(FACT) & ~F.col("value").rlike(r"^\s*(%|:-|foil_\w+\()")
    return lines.where(is_fact).select(
        F.regexp_extract("value", FACT, 1).alias("pred"),
        F.regexp_extract("value", FACT, 2).alias("case_id"),
        _blank_to_null(F.regexp_extract("value", FACT, 3)).alias("val"),
    )


def parse_atoms(lines: DataFrame) -> DataFrame:
    """Every ground fact (pred, args) of any number of arguments, several per line too.

    Quoted arguments lose their quotes. Directives, comments and rules are skipped; see
    ``rejected_lines`` for what cannot be read.
    """
    plain = lines.where(~F.col("value").rlike(SKIPPED) & ~F.col("value").contains(":-"))
    atoms = plain.select(F.explode(F.regexp_extract_all("value", F.lit(ATOM), F.lit(0))).alias("atom"))
    args = F.regexp_extract_all(F.regexp_extract("atom", ATOM, 2), F.lit(f"({TERM})"), F.lit(1))
    return atoms.select(
        F.regexp_extract("atom", ATOM, 1).alias("pred"),
        F.transform(F.filter(args, lambda a: F.trim(a) != ""), lambda a: unquoted_term(F.trim(a))).alias("args"),
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither facts nor comments, directives or rules: (value)."""
    left = F.trim(F.regexp_replace("value", ATOM, ""))
    return lines.where(
        ~F.col("value").rlike(SKIPPED) & ~F.col("value").contains(":-") & (left != "") & ~left.startswith("%")
    ).select("value")


def relation_tables(atoms: DataFrame, arity: dict[str, int]) -> dict[str, DataFrame]:
    """One table per named predicate with columns a0, a1 ..., as relational clauses use them.

    The facts are written once, a predicate apart, so that a table does not read the text of
    all of them each time it is used.
    """
    facts = materialize(atoms.where(F.col("pred").isin(*arity)).select("pred", "args"), "pred")
    return {
        pred: facts.where((F.col("pred") == pred) & (F.size("args") == n)).select(
            *[F.col("args")[i].alias(f"a{i}") for i in range(n)]
        )
        for pred, n in arity.items()
    }


def parse_views(lines: DataFrame) -> DataFrame:
    """Rules that pass one variable on, ``bird(X) :- penguin(X).``: (head, source)."""
    heads = (F.regexp_extract("value", VIEW, i) for i in (1, 3))
    same = F.regexp_extract("value", VIEW, 2) == F.regexp_extract("value", VIEW, 4)
    head, source = heads
    return lines.where(F.col("value").rlike(VIEW) & same).select(head.alias("head"), source.alias("source"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return parse_facts(_lines(spark, path))


def split_labels(
    facts: DataFrame, positive: str = "positive", negative: str = "negative"
) -> tuple[DataFrame, DataFrame]:
    """Attribute facts, and the examples named by the label facts."""
    is_label = F.col("pred").isin(positive, negative) & F.col("val").isNull()
    examples = facts.where(is_label).select(
        "case_id", (F.col("pred") == positive).alias("is_pos")
    )
    return facts.where(~is_label), examples


def parse_modes(lines: DataFrame) -> DataFrame:
    """Mode declarations, one row per argument place."""
    modes = lines.where(F.col("value").rlike(MODE)).select(
        F.regexp_extract("value", MODE, 3).alias("pred"),
        (F.regexp_extract("value", MODE, 1) == "h").alias("is_head"),
        F.coalesce(
            F.regexp_extract("value", MODE, 2).try_cast("int"), F.lit(1)
        ).alias("recall"),
        F.regexp_extract_all(F.regexp_extract("value", MODE, 4), F.lit(MODE_ARG), 0).alias("args"),
    )
    places = modes.select("pred", "is_head", "recall", F.posexplode("args").alias("arg_no", "arg"))
    return places.select(
        "pred",
        "arg_no",
        F.regexp_extract("arg", MODE_ARG, 1).alias("kind"),
        F.regexp_extract("arg", MODE_ARG, 2).alias("type"),
        "recall",
        "is_head",
    )


def parse_constants(lines: DataFrame) -> DataFrame:
    """Declared constants (type, val); ``nan`` is no value."""
    return lines.where(F.col("value").rlike(CONSTANT)).select(
        F.regexp_extract("value", CONSTANT, 1).alias("type"),
        F.regexp_extract("value", CONSTANT, 2).alias("val"),
    ).where("val <> 'nan'")


def read_bias(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(modes, constants) of a mode declaration file."""
    lines = _lines(spark, path)
    return parse_modes(lines), parse_constants(lines)


def parse_items(lines: DataFrame) -> DataFrame:
    """Item dictionary (item_id, pred, val)."""
    return lines.where(F.col("value").rlike(ITEM)).select(
        F.regexp_extract("value", ITEM, 1).cast("int").alias("item_id"),
        F.regexp_extract("value", ITEM, 2).alias("pred"),
        F.regexp_extract("value", ITEM, 3).alias("val"),
    )


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return parse_items(_lines(spark, path))


def parse_transactions(lines: DataFrame) -> DataFrame:
    """Utility transactions (tid, item, util) from ``label(id)::items:total:utils``.

    Comments, metadata, empty lines and transactions without items give no rows.
    """
    text = F.trim("value")
    data = lines.where(text.rlike(TRANSACTION))
    tid, items, utils = (F.regexp_extract(text, TRANSACTION, group) for group in (1, 2, 4))
    pairs = F.arrays_zip(F.split(items, " +").alias("item"), F.split(utils, " +").alias("util"))
    rows = data.where(items != "").select(tid.alias("tid"), F.inline(pairs))
    return rows.select(
        "tid", F.col("item").cast("int").alias("item"), F.col("util").cast("bigint").alias("util")
    )


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return parse_transactions(_lines(spark, path))


def parse_attributions(lines: DataFrame) -> DataFrame:
    """Attributions (case_id, pred, val, phi)."""
    return lines.where(F.col("value").rlike(ATTRIBUTION)).select(
        F.regexp_extract("value", ATTRIBUTION, 1).alias("case_id"),
        F.regexp_extract("value", ATTRIBUTION, 2).alias("pred"),
        F.regexp_extract("value", ATTRIBUTION, 3).alias("val"),
        F.regexp_extract("value", ATTRIBUTION, 4).cast("double").alias("phi"),
    )


def read_attributions(spark: SparkSession, path: str) -> DataFrame:
    return parse_attributions(_lines(spark, path))


def parse_clauses(lines: DataFrame) -> DataFrame:
    """Rules of every kind: (rule_text, head, head_args, lit_no, pred, args, negated).

    One row per body literal. ``args`` are terms: variables are bare words that begin with a
    capital or underscore, constants may be in quotes. Commented lines are no rules.
    """
    rules = lines.where(F.col("value").rlike(RULE)).select(
        F.trim("value").alias("rule_text"),
        F.regexp_extract("value", RULE, 1).alias("head"),
        F.regexp_extract_all(F.regexp_extract("value", RULE, 2), F.lit(f"({HEAD_ARG})"), 1).alias("head_args"),
        F.regexp_extract_all(F.regexp_extract("value", RULE, 3), F.lit(f"({RULE_LITERAL})"), 1).alias("body"),
    )
    lits = rules.select("rule_text", "head", "head_args", F.posexplode("body").alias("lit_no", "lit"))
    atom = rf"(\w+)\(((?:'(?:[^']|'')*'|[^()'])*)\)$"
    terms = F.regexp_extract_all(F.regexp_extract("lit", atom, 2), F.lit(f"({TERM})"), 1)
    return lits.select(
        "rule_text",
        "head",
        "head_args",
        "lit_no",
        F.regexp_extract("lit", atom, 1).alias("pred"),
        F.transform(F.filter(terms, lambda t: F.trim(t) != ""), lambda t: F.trim(t)).alias("args"),
        F.col("lit").rlike(r"^(not\s*\(|not\s|\\\+)").alias("negated"),
    )


def rejected_rules(lines: DataFrame) -> DataFrame:
    """Lines that look like rules and cannot be read as such: (value)."""
    body = F.regexp_extract("value", RULE, 3)
    left = F.regexp_replace(F.regexp_replace(body, RULE_LITERAL, ""), r"[\s,()]", "")
    is_rule = F.col("value").contains(":-") & ~F.col("value").rlike(r"^\s*(?:%|:-)")
    return lines.where(is_rule & (~F.col("value").rlike(RULE) | ~left.isin("", "true"))).select("value")


def _is_variable(term: Column) -> Column:
    return term.rlike("^[A-Z_]")


def _joined_texts(clauses: DataFrame) -> DataFrame:
    """Texts of the rules with a variable in another place than the first of a literal."""
    later = F.slice("args", 2, F.greatest(F.size("args") - 1, F.lit(0)))
    joins = F.exists(later, _is_variable) | (F.size("head_args") > 1) | (F.size("args") > 2)
    return clauses.where(joins).select("rule_text").distinct()


def joined_rules(lines: DataFrame) -> DataFrame:
    """Rules over several variables, whole: (value). They are clauses of relations."""
    return _joined_texts(parse_clauses(lines)).select(F.col("rule_text").alias("value"))


def parse_rules(lines: DataFrame) -> DataFrame:
    """Rules about one case as (rule_text, head, lit_no, pred, val, negated), per literal.

    ``h(A):-b1(A,x),b2(A,'X'),not(ab0(A)).`` Rules that join through further variables are
    clauses of relations: ``joined_rules`` has exactly those, ``parse_clauses`` reads both
    kinds, and ``rejected_rules`` has what neither reads.
    """
    clauses = parse_clauses(lines)
    return clauses.join(_joined_texts(clauses), "rule_text", "left_anti").select(
        "rule_text",
        "head",
        "lit_no",
        "pred",
        F.when(F.size("args") > 1, unquoted_term(F.col("args")[1])).alias("val"),
        "negated",
    )


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule literals of a rule file with ``rule_id`` in the order of the lines.

    The number of rules is what a person can read, so numbering them by text position in
    one place is bounded.
    """
    lines = _lines(spark, path).select("value", F.monotonically_increasing_id().alias("line"))
    keyed = lines.where(F.col("value").rlike(RULE)).select("line", F.trim("value").alias("rule_text"))
    numbers = keyed.collect()
    ids = [(r["rule_text"], i) for i, r in enumerate(sorted(numbers, key=lambda r: r["line"]))]
    first: dict[str, int] = {}
    for text, i in ids:
        first.setdefault(text, i)
    order = spark.createDataFrame(sorted(first.items(), key=lambda e: e[1]), "rule_text string, rule_id int")
    parsed = parse_rules(lines).distinct()
    return parsed.join(F.broadcast(order), "rule_text").select(
        "rule_id", "head", "lit_no", "pred", "val", "negated"
    )

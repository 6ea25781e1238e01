"""Text forms of facts, modes, items, transactions, attributions, itemsets and rules.

Each ``render_*`` returns a DataFrame with a column ``value`` (one line per row); the
``write_*`` functions store such lines as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import norm_value, quoted_term
from ..rules import Theory


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store lines in parallel; ``path`` becomes a folder of text files."""
    lines.select("value").write.mode(mode).text(path)


def _value(val: Column, normalize: bool) -> Column:
    return norm_value(val) if normalize else val.cast("string")


def render_facts(facts: DataFrame, prefix: str = "p", normalize: bool = True) -> DataFrame:
    """``attr(p12,value).`` per fact."""
    case = F.concat(F.lit(prefix), F.col("case_id").cast("string"))
    val = _value(F.col("val"), normalize)
    inner = F.when(F.col("val").isNull(), case).otherwise(F.concat_ws(",", case, val))
    return facts.select(F.concat(F.col("pred"), F.lit("("), inner, F.lit(").")).alias("value"))


def render_examples(examples: DataFrame, prefix: str = "p") -> DataFrame:
    """``positive(p12).`` or ``negative(p12).`` per case."""
    label = F.when(F.col("is_pos"), "positive").otherwise("negative")
    return examples.select(
        F.concat(label, F.lit(f"({prefix}"), F.col("case_id").cast("string"), F.lit(").")).alias("value")
    )


def write_facts(facts: DataFrame, examples: DataFrame, path: str, **options) -> None:
    """Labels and facts of one split."""
    write_lines(render_examples(examples).unionByName(render_facts(facts)), path, **options)


def render_modes(modes: DataFrame) -> DataFrame:
    """``#modeh(...)`` and ``#modeb(recall,...)`` lines."""
    arg = F.concat("kind", F.lit("("), "type", F.lit(")"))
    per_pred = modes.groupBy("pred", "is_head", "recall").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("arg_no", arg.alias("arg")))),
                lambda s: s["arg"],
            ),
            ",",
        ).alias("args")
    )  # a predicate has few argument places
    head = F.concat(F.lit("#modeh("), "pred", F.lit("("), "args", F.lit("))"))
    body = F.concat(
        F.lit("#modeb("), F.col("recall").cast("string"), F.lit(","), "pred", F.lit("("), "args",
        F.lit("))"),
    )
    return per_pred.select(F.when(F.col("is_head"), head).otherwise(body).alias("value"))


def render_constants(constants: DataFrame, normalize: bool = True) -> DataFrame:
    """``#constant(type,value)`` lines."""
    val = _value(F.col("val"), normalize)
    return constants.select(
        F.concat(F.lit("#constant("), "type", F.lit(","), val, F.lit(")")).alias("value")
    )


def write_bias(modes: DataFrame, constants: DataFrame, path: str, **options) -> None:
    write_lines(render_modes(modes).unionByName(render_constants(constants)), path, **options)


def render_attributions(attributions: DataFrame, prefix: str = "p") -> DataFrame:
    """``data(p12):attr(A,value):phi`` lines."""
    return attributions.select(
        F.concat(
            F.lit(f"data({prefix}"), F.col("case_id").cast("string"), F.lit("):"), "pred",
            F.lit("(A,"), norm_value("val"), F.lit("):"), F.col("phi").cast("string"),
        ).alias("value")
    )


def write_attributions(attributions: DataFrame, path: str, **options) -> None:
    write_lines(render_attributions(attributions), path, **options)


def render_transactions(tx: DataFrame, cases: DataFrame | None = None, prefix: str = "p") -> DataFrame:
    """``positive(p12)::items:total:utils`` lines, items by utility, largest first.

    A transaction holds at most one entry per literal of its case. With ``cases`` (tid)
    those without any item are written as empty transactions.
    """
    per_tid = tx.groupBy("tid").agg(
        F.sum("util").alias("total"),
        F.array_sort(
            F.collect_list(F.struct((-F.col("util")).alias("order"), "item", "util"))
        ).alias("items"),
    )
    if cases is not None:
        per_tid = cases.select("tid").join(per_tid, "tid", "left")
    empty = F.array().cast("array<string>")

    def listed(name: str) -> Column:
        texts = F.transform("items", lambda e: e[name].cast("string"))
        return F.array_join(F.coalesce(texts, empty), " ")

    return per_tid.select(
        F.concat(
            F.lit(f"positive({prefix}"), F.col("tid").cast("string"), F.lit(")::"), listed("item"),
            F.lit(":"), F.coalesce("total", F.lit(0)).cast("string"), F.lit(":"), listed("util"),
        ).alias("value")
    )


def write_transactions(tx: DataFrame, path: str, cases: DataFrame | None = None, **options) -> None:
    write_lines(render_transactions(tx, cases), path, **options)


def render_items(items: DataFrame) -> DataFrame:
    """``id->attr(A,value)`` lines."""
    return items.select(
        F.concat(
            F.col("item_id").cast("string"), F.lit("->"), "pred", F.lit("(A,"), norm_value("val"),
            F.lit(")"),
        ).alias("value")
    )


def write_items(items: DataFrame, path: str, **options) -> None:
    write_lines(render_items(items), path, **options)


def render_itemsets(itemsets: DataFrame) -> DataFrame:
    """``i j k #UTIL: u`` lines."""
    names = F.transform("itemset", lambda i: i.cast("string"))
    return itemsets.select(
        F.concat(F.array_join(names, " "), F.lit(" #UTIL: "), F.col("util").cast("string")).alias("value")
    )


def write_itemsets(itemsets: DataFrame, path: str, **options) -> None:
    write_lines(render_itemsets(itemsets), path, **options)


def render_relation(pred: str, table: DataFrame) -> DataFrame:
    """``pred(x,y,'Z').`` lines of a relation; rows with nulls are no facts."""
    args = F.array(*[quoted_term(F.col(c).cast("string")) for c in table.columns])
    return table.dropna().select(F.concat(F.lit(f"{pred}("), F.array_join(args, ","), F.lit(").")).alias("value"))


def render_rules(rule_literals: DataFrame) -> DataFrame:
    """(rule_id, value): ``h(A):-b1(A,x),not(ab0(A)).`` per rule."""
    atom = F.concat(
        "pred", F.when(F.col("val").isNull(), "(A)").otherwise(F.concat(F.lit("(A,"), quoted_term("val"), F.lit(")")))
    )
    lit = F.when(F.col("negated"), F.concat(F.lit("not("), atom, F.lit(")"))).otherwise(atom)
    body = F.transform(
        F.array_sort(F.collect_list(F.struct("lit_no", lit.alias("text")))), lambda s: s["text"]
    )  # a rule body is short
    return rule_literals.groupBy("rule_id", "head").agg(F.array_join(body, ",").alias("body")).select(
        "rule_id", F.concat("head", F.lit("(A):-"), "body", F.lit(".")).alias("value")
    )


def render_hypothesis(spark, theory: Theory, covered: int | None = None, positives: int | None = None) -> DataFrame:
    """(line, value): rules, an empty line, exceptions, and the coverage if given."""
    lines = theory.lines()
    if covered is not None:
        lines.append(f"Total Coverage: {covered} out of {positives}")
    return spark.createDataFrame(list(enumerate(lines)), "line int, value string")


def write_rules(spark, theory: Theory, path: str, covered: int | None = None,
                positives: int | None = None, mode: str = "errorifexists") -> None:
    """Write a hypothesis as one ordered text file; it has as many lines as rules."""
    lines = render_hypothesis(spark, theory, covered, positives)
    lines.coalesce(1).sortWithinPartitions("line").select("value").write.mode(mode).text(path)

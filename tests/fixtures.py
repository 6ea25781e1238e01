"""Small hand-written data shared by the tests."""

from ruleweave.operators.prep import CaseTable, from_facts

FLY = "abefgh"
ANIMALS = [*"abcdefghkm", "c1"]
PROPERTIES = {
    "superpenguin": "ef",
    "penguin": "cdef",
    "bird": "abcdef",
    "plane": "ghkm",
    "damaged": "km",
}


def flying(spark) -> CaseTable:
    """Birds, penguins and planes; superpenguins and undamaged planes fly."""
    facts = spark.createDataFrame(
        [(p, c, None) for p, cs in PROPERTIES.items() for c in cs],
        "pred string, case_id string, val string",
    )
    examples = spark.createDataFrame([(c, c in FLY) for c in ANIMALS], "case_id string, is_pos boolean")
    return from_facts(facts, examples, unary=list(PROPERTIES))


def cars(spark, copies: int = 3) -> CaseTable:
    """Good cars are safe, unless they have two seats, except when they are cheap."""
    rows, n = [], 0
    for _ in range(copies):
        for safety in ("high", "med", "low"):
            for seats in ("2", "4", "more"):
                for price in ("low", "high"):
                    good = safety == "high" and (seats != "2" or price == "low")
                    rows.append((n, good, safety, seats, price))
                    n += 1
    df = spark.createDataFrame(
        rows, "case_id int, is_pos boolean, safety string, seats string, price string"
    )
    return CaseTable(df, ("safety", "seats", "price"))

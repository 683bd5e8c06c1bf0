import pytest
from pyspark.sql import functions as F

from cartloom.functions import fixed_values as fixed
from cartloom.functions import rules, scores, text


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(row) for row in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def column(spark, data, kind, expression):
    """``expression`` of column x over the values, in order."""
    df = spark.createDataFrame(list(enumerate(data)), f"i int, x {kind}")
    return [row.y for row in df.select("i", expression.alias("y")).orderBy("i").collect()]


def test_discount_at_every_cut(spark):
    got = column(spark, [30000, 29999, 10000, 9999, 4000, 3999], "long", rules.discount(F.col("x")))
    assert got == ["Save $1", "Save $2", "Save $2", "Save $3", "Save $3", "Save $4"]


def test_confidence_at_every_cut(spark):
    got = column(spark, [20000, 19999, 6000, 5999], "long", rules.confidence(F.col("x")))
    assert got == ["High", "Medium", "Medium", "Low"]


@pytest.mark.parametrize(
    "rate, units, count, impact, offer",
    [
        (0.59, 90000, 90000, fixed.IMPACT_TRIAL, fixed.OFFER_TRIAL),
        (0.60, 50000, 20000, fixed.IMPACT_BASKET, fixed.OFFER_TWO + "Save $2"),
        (0.60, 49999, 20000, fixed.IMPACT_ATTACH, fixed.OFFER_ONE + "Save $2"),
        (0.60, 50000, 19999, fixed.IMPACT_ATTACH, fixed.OFFER_TWO + "Save $2"),
        (0.60, 50000, 6000, fixed.IMPACT_ATTACH, fixed.OFFER_TWO + "Save $3"),
        (0.60, 50000, 5999, fixed.IMPACT_DISCOVERY, fixed.OFFER_TWO + "Save $3"),
        (None, None, 30000, fixed.IMPACT_TRIAL, fixed.OFFER_TRIAL),
    ],
)
def test_impact_and_offer(spark, rate, units, count, impact, offer):
    r, u, c = F.col("r"), F.col("u"), F.col("c")
    got = values(
        spark,
        [(rate, units, count)],
        "r double, u long, c long",
        impact=rules.expected_impact(r, u, c),
        offer=rules.offer(r, u, c),
    )
    assert got == [(impact, offer)]


def test_theme(spark):
    got = values(
        spark,
        [
            (0, "Greek Yogurt", ["Lime"]),
            (1, "Veggie Burger", ["Lime"]),
            (2, "Bread", ["Lime", "Soda"]),
            (3, "Bread", ["Almond", "Milk"]),
            (4, "Bread", ["Soda", None]),
            (5, "Bread", ["Rice", ""]),
            (6, None, ["Rice"]),
        ],
        "i int, a string, n array<string>",
        i=F.col("i"),
        theme=rules.theme(F.col("a"), F.col("n")),
    )
    breakfast = "Healthy Breakfast / Smoothie"
    assert dict(got) == {
        0: breakfast,
        1: "Breakfast Essentials",
        2: "Fresh Prep / Cooking (Guac & Sides)",
        3: breakfast,
        4: "Snack & Beverage",
        5: "Everyday Staples",
        6: "Everyday Staples",
    }


def test_placement(spark):
    got = column(
        spark,
        ["Breakfast Essentials", "Fresh Prep / Cooking (Guac & Sides)", "Snack & Beverage"],
        "string",
        rules.placement(F.col("x")),
    )
    assert [spots[0] for spots in got] == ["Cart upsell", "Recipe/meal page", "Cart upsell"]
    assert [spots[1] for spots in got] == ["Product detail page (PDP)", "Cart upsell", "PDP"]


def test_family(spark):
    cases = {
        "Organic Avocado": "avocado",
        "Veggie Burger": "eggs",
        "Milk Chocolate": "milk",
        "Organic Whole Oat Drink": "oat drink",
        "Strawberry Jam": "strawberries",
        "of": "other",
        "": "other",
        "Café au Lait": "caf lait",
        "Éof Brand": "brand",
        "Extraordinarily Longwinded Productname Indeed": "extraordinarily longwinded pro",
    }
    assert column(spark, list(cases), "string", text.family_key(F.col("x"))) == list(cases.values())
    assert column(spark, [None], "string", text.family_key(F.col("x"))) == ["other"]


def test_anchor_score(spark):
    def score(query, name, units=0, rate=0.0):
        row = values(
            spark,
            [(query, name, units, rate)],
            "q string, n string, u long, r double",
            s=scores.anchor_score(F.col("q"), F.col("n"), F.col("u"), F.col("r")),
        )
        return row[0][0]

    assert score(" Eggs ", "Eggs") == 50000 - 100
    assert score("banana", "Bananas") == 40000 - 175
    assert score("banana", "Banana Chips") == 15000 - 300
    assert score("two words", "Two Words") == -225
    assert score("x", "Strawberry Vanilla Tub", 10, 0.5) == 10 + 5000 - 550 - 24000


def test_addon_score(spark):
    def score(name, exempt, department=1, anchor=1):
        row = values(
            spark,
            [(name, exempt, department, anchor)],
            "n string, e boolean, d int, a int",
            s=scores.addon_score(
                F.lit(100), F.lit(0.5), F.lit(9000), F.col("d"), F.col("a"), F.col("n"), F.col("e")
            ),
        )
        return row[0][0]

    assert score("Rice", False) == 100 + 100 + 100 + 5000
    assert score("Rice", False, None, None) == 5300
    assert score("Rice", False, 1, None) == 300
    assert score("Bananas", False) == 1300
    assert score("Bananas", True) == 5300


def test_lines_as_python_splits_them(spark):
    breaks = ["\n", "\r\n", *text.RARE_BREAKS]
    cases = ["", "\n", "a", "a\n", "a\n\n", "\n\na", "a\r\n", "a\r\n\r\nb", "a\n\rb", "a b\tc"]
    cases += [f"x{b}y{b}" for b in breaks] + [f"{b}x" for b in breaks]
    assert column(spark, cases, "string", text.split_lines(F.col("x"))) == [
        case.splitlines() for case in cases
    ]


def test_paths(spark):
    paths = ["a/b.py", "b.tar.gz", "/x/.bashrc", "dir.d/name", "a/.b.c", "Dir/NAME.PY"]
    assert column(spark, paths, "string", text.file_stem(F.col("x"))) == [
        "b", "b.tar", ".bashrc", "name", ".b", "NAME",
    ]
    assert column(spark, paths, "string", text.file_suffix(F.col("x"))) == [
        ".py", ".gz", "", "", ".c", ".py",
    ]


def test_hash_parts(spark):
    import hashlib

    got = values(
        spark,
        [("ab", "c", None)],
        "a string, b string, n string",
        plain=text.content_hash(F.col("a"), F.col("b"), F.col("n")),
        apart=text.content_hash(F.col("a"), F.col("b"), sep="|"),
    )
    assert got == [
        (hashlib.sha256(b"abc").hexdigest(), hashlib.sha256(b"ab|c").hexdigest())
    ]


def test_query_words(spark):
    cases = ["  Two\t Words ", "one", " \n ", ""]
    assert column(spark, cases, "string", text.query_words(F.col("x"))) == [
        ["two", "words"], ["one"], [], [],
    ]

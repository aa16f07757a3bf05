import re
from dataclasses import replace
from functools import reduce
from operator import or_
from random import Random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions import text, values
from tagloom.functions.dialect import BLANKS, SQUEEZE, matches, replaced
from tagloom.operators import extraction


def apply(spark, shape, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", shape(F.col("t")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def test_price_heading_eats_blanks(spark):
    cases = {
        "MRP 399": "MRP399", "MRP Rs 50": "MRPRs 50", "MRP: Rs. 50": "MRP: Rs. 50", "MRP ₹50": "MRP ₹50", "M.R.P. 50": "MRP. 50", "M.R.P.50": "MRP50", "M R P\n399": "MRP399",
        "Net Wt. 250": "NET WEIGHT. 250", "Net Wt.250": "NET WEIGHT250",
    }
    assert apply(spark, text.headings, list(cases)) == list(cases.values())


def test_normal_form_of_odd_texts(spark):
    cases = {None: "", "": "", " \n\t": "", "ﬁne ①": "fine 1", "a​b — c¦d": "ab - c|d", "250 gms": "250 G", "1.5ltr": "1.5 L", "12|08|2026": "12/08/2026", "x  \n\n y .": "x y."}
    assert apply(spark, text.normal, list(cases)) == list(cases.values())


def test_dotted_headings_in_view_form(spark):
    assert apply(spark, text.view_form, ["Net Wt.\n250 g", "M R P\n\n  5", None]) == ["Net Wt.250 g", "MRP\n5", ""]


def test_lines_and_tokens(spark):
    assert apply(spark, text.normal_lines, ["a gm\n\n MRP 5 \r\nz", None]) == [["a gm", "MRP5", "z"], []]
    assert apply(spark, text.tokens, ["Rs.50/- a@b.c, (x)"]) == [["Rs.50/-", "a@b.c", "x"]]


def plain_units(t):
    for p, n in (("KGS?", "KG"), ("KG", "KG"), ("GMS?", "G"), ("MG", "MG"), ("ML", "ML"), ("LTRS?", "L"), ("LIT(?:RE|ER)", "L"), ("L", "L")):
        t = re.sub(rf"(?<=[0-9])\s*{p}\b", f" {n}", t, flags=re.I | re.A)
    return re.sub(r"\s+", " ", t, flags=re.A).strip()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789 .gGmMkKlLtTrReEiIsS\n", max_size=25), min_size=20, max_size=40))
def test_units_equal_plain_statement(spark, texts):
    assert apply(spark, text.units, texts) == [plain_units(t) for t in texts]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789.,-₹ Rs", max_size=14), min_size=20, max_size=40))
def test_prices_equal_plain_statement(spark, texts):
    def plain(t):
        m = re.search(r"(?<!\d)(\d{1,7}(?:\.\d{1,2})?)(?!\d)", t)
        return f"₹{m[1]}" if m and float(m[1]) > 0 and not 1900 <= float(m[1]) <= 2100 else None

    assert apply(spark, values.price, texts) == [plain(t) for t in texts]


def test_values(spark):
    assert apply(spark, values.plain_price, ["₹399.00", "399,50", "1999", "0", "x", None, "12345678", "7.50/-"]) == ["₹399", "₹39950", None, None, None, None, None, "₹7.5"]
    assert apply(spark, values.quantity, ["250GM", "1 litre", "5", None, "2.5 kgs"]) == ["250 G", "1 L", None, None, "2.5 KG"]


@pytest.mark.parametrize(("status", "icon"), [("pass", "✅"), ("NON-COMPLIANT", "❌"), ("review", "⚠️"), (None, "ℹ️"), ("n/a", "⚪")])
def test_icons(spark, status, icon):
    assert apply(spark, text.status_icon, [status]) == [icon]


def test_shown_and_valid(spark):
    assert apply(spark, text.shown, [None, " ", " a "]) == ["Not found", "Not found", "a"]
    assert apply(spark, text.is_valid, [None, "a", "ab", "a!?;:,.!?b", "....", "x1"]) == [False, False, True, False, False, True]


PARTS = [
    " ", "  ", "\t", "\n", "\r", "\x0b", "​", " ", "\u0085", "¦", "—", ".", ",", ":", "&", "|", "12", "5", "M", "R", "P", "mrp", "NET", "WT", "W7", "QTY", "QUANT1TY", "CONTENTS", "MFD", "mfg", "BY", "DATE",
    "MANUFACTURED", "AND", "MARKETED", "PACKED", "PKD", "MKT", "EXP", "USE", "BEST", "BEFORE", "FSSAI", "LIC", "LICENSE", "LICENCE", "NO", "R5", "Rs", "RS", "INR", "KGS", "kg", "GMS", "gm", "mg", "ML", "LTRS", "litre", "L", "x",
]


def test_gates_change_nothing(spark):
    """Texts of parts that headings, units and white space are made of, with and without gates; each step alone too."""
    random = Random(7)
    cases = ["".join(random.choices(PARTS, k=random.randint(0, 14))) for _ in range(3000)]
    plain = [replace(s, gate="") for s in text.NORMAL_FORM]
    assert apply(spark, lambda x: replaced(x, text.NORMAL_FORM), cases) == apply(spark, lambda x: replaced(x, plain), cases)
    held = spark.createDataFrame([(c,) for c in cases], "t string").cache()
    for gate in {s.gate for s in text.NORMAL_FORM if s.gate}:
        behind = [s for s in plain if any(s == replace(g, gate="") and g.gate == gate for g in text.NORMAL_FORM)]
        changed = [replaced(F.col("t"), [s]) != F.col("t") for s in behind]
        assert held.where(~F.col("t").rlike(gate) & reduce(or_, changed)).isEmpty(), gate


def test_white_space_equals_plain_statement(spark):
    random = Random(8)
    cases = ["".join(random.choices(" \t\n\r\x0b\x0cab", k=random.randint(0, 12))) for _ in range(500)]
    assert apply(spark, lambda x: replaced(x, [SQUEEZE]), cases) == [re.sub(r"[ \t\n\r\x0b\x0c]+", " ", c) for c in cases]
    assert apply(spark, lambda x: replaced(x, [BLANKS]), cases) == [re.sub(r"[ \t]+", " ", c) for c in cases]


def test_every_heading_is_found_by_its_gate(spark):
    """Lines of parts of headings: one with a heading always holds what any heading holds."""
    random = Random(9)
    words = ["MRP", "M.", "R.", "P", "MAX", "MAXIMUM", "RETAIL", "PRICE", "NET", "QUANTITY", "wt.", "MANUFACTURER", "MANUFACTURED", "MANUFACTURING", "BY", "&", "AND", "MARKETED", "PACKED", "MFG.", "mfd", "ADDRESS", "REGISTERED", "CORPORATE", "OFFICE", "x"]
    cases = [random.choice(["", " "]).join(random.choices(words, k=random.randint(1, 5))) for _ in range(2000)]
    anything = "|".join(f"(?:{h})" for h in extraction.ALL_HEADINGS)
    found = apply(spark, lambda x: matches(x, anything) & ~matches(x, extraction.ANY_HEADING), cases)
    assert not any(found) and any(apply(spark, lambda x: matches(x, anything), cases))
    names = ["Nutrition facts", "packed", "x packed", "NET  weight 5", "date of", "a date of", "mrp", "", "Ingredients: a", "ingredient"]
    plain = "|".join(f"(?:{h})" for h in extraction.NOT_A_NAME)
    assert apply(spark, extraction.is_no_name, names) == apply(spark, lambda x: matches(x, plain), names)

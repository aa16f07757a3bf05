"""Chains of regular-expression replacements, as Column expressions and as the same chain in the SQL of the oracle's engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import replace as changed
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """pattern and replacement as Java has them; oracle: (pattern, replacement) pairs where the other dialect lacks look-around or back-references.
    gate: a pattern that is found in every text which this step changes; neighbouring steps of one gate are passed over together where it isn't found."""

    pattern: str
    replacement: str
    any_case: bool = True
    oracle: tuple[tuple[str, str], ...] = ()
    gate: str = ""


def gated(gate: str, steps: list[Step]) -> list[Step]:
    """steps behind one gate. If no step finds anything in the text as it is, none will after the others; so the gate has to hold for single steps only."""
    return [changed(s, gate=gate) for s in steps]


def _each(text: Column, steps: list[Step]) -> Column:
    for s in steps:
        text = F.regexp_replace(text, ("(?i)" if s.any_case else "") + s.pattern, s.replacement)
    return text


def _behind(gate: str, steps: list[Step]) -> Callable[[Column], Column]:
    return lambda t: F.when(t.rlike(gate), _each(t, steps)).otherwise(t)


def replaced(text: Column, steps: list[Step]) -> Column:
    for gate, own in groupby(steps, lambda s: s.gate):
        text = once(text, _behind(gate, list(own))) if gate else _each(text, list(own))
    return text


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled_sql(text: str = "text") -> str:
    return f"coalesce({text}, '')"


def replaced_sql(text: str, steps: list[Step]) -> str:
    for s in steps:
        for pattern, replacement in s.oracle or ((s.pattern, s.replacement.replace("$", "\\")),):
            text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(replacement)}, {quoted('gi' if s.any_case else 'g')})"
    return text


def matches(text: Column, pattern: str, any_case: bool = True) -> Column:
    return text.rlike(("(?i)" if any_case else "") + pattern)


def matches_sql(text: str, pattern: str, any_case: bool = True) -> str:
    return f"regexp_matches({text}, {quoted(pattern)}, {quoted('i' if any_case else 'c')})"


STRIP = Step(r"^\s+|\s+$", "", False)
#: One blank for each run of white space, or of blanks and tabs. A single blank isn't a match, so that not every gap between words is written anew.
SQUEEZE = Step(r"\s{2,}|[^\S ]", " ", False)
BLANKS = Step(r"[ \t]{2,}|\t", " ", False)


def steady(x: Column, digits: int) -> Column:
    """Rounded half up; first to eight digits, so that the last bits of sums in another order don't decide ties."""
    return F.round(F.round(x, 8), digits)


def quickly(x: Column, digits: int, exact: Column) -> Column:
    """exact, which is x rounded to so many digits (4 at most, perhaps by way of more), without its decimal arithmetic where that can't matter: for values of usual size that aren't near the middle between two results."""
    scaled = x * float(10**digits)
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(plain, F.floor(scaled + 0.5) / float(10**digits)).otherwise(exact)


def steady_sql(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28, 8)), {digits}) AS DOUBLE)"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated a single time, wherever the optimizer moves or copies what is made of it; it also keeps generated code small."""
    return F.get(F.transform(F.array(value), use), 0)


def where_once(rows: DataFrame, name: str, value: Column, test: Callable[[Column], Column]) -> DataFrame:
    """rows with value as column `name` (in place of one of that name), where test(value) holds. The value is evaluated a single time: an ordinary filter would be moved below
    the column and repeat what it is made of."""
    others = [c for c in rows.columns if c != name]
    kept = F.explode(F.filter(F.array(value), test)).alias(name)
    return rows.select(*[kept if c == name else F.col(c) for c in rows.columns]) if len(others) < len(rows.columns) else rows.select("*", kept)

"""Fields of a label from its lines: name, price, quantity, maker and address.

A heading may have its value behind it or in one of the next lines. All of it is array expressions over a label's lines, so it
stays in one stage and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.dialect import BLANKS, SQUEEZE, STRIP, Step, filled_sql, matches, matches_sql, once, quoted, replaced, replaced_sql
from tagloom.functions.values import price, price_sql, quantity, quantity_sql

# Headings, words and lines that the extraction knows.
PRICE_HEADINGS = [r"\bMRP\b", r"\bM\.?\s*R\.?\s*P\.?\b", r"\bMAXIMUM\s+RETAIL\s+PRICE\b", r"\bMAX\.?\s*RETAIL\s+PRICE\b"]
QUANTITY_HEADINGS = [r"\bNET\s+QUANTITY\b", r"\bNET\s+QTY\b", r"\bNET\s+WEIGHT\b", r"\bNET\s+WT\.?\b", r"\bNET\s+WT\b"]
MAKER_HEADINGS = [
    r"\bMANUFACTURER\b", r"\bMANUFACTURED\s+BY\b", r"\bMANUFACTURED\s*&\s*MARKETED\s+BY\b", r"\bMANUFACTURED\s+AND\s+MARKETED\s+BY\b", r"\bPACKED\s+BY\b",
    r"\bPACKED\s*&\s*MARKETED\s+BY\b", r"\bPACKED\s+AND\s+MARKETED\s+BY\b", r"\bMARKETED\s+BY\b", r"\bMFG\.?\s*BY\b", r"\bMFD\.?\s*BY\b",
]
ADDRESS_HEADINGS = [r"\bADDRESS\b", r"\bREGISTERED\s+OFFICE\b", r"\bCORPORATE\s+OFFICE\b", r"\bMANUFACTURING\s+ADDRESS\b"]
ALL_HEADINGS = [*PRICE_HEADINGS, *QUANTITY_HEADINGS, *MAKER_HEADINGS, *ADDRESS_HEADINGS]
#: Is found in every line with a heading.
ANY_HEADING = r"\b(?:M\.?\s*R|MAX|NET\s|MANUFACTUR|PACKED|MARKETED|MF[GD]|ADDRESS|REGISTERED|CORPORATE)"
CONTACT = r"\b(?:customer\s+care|email|phone|mobile)\b"
CONTACT_OR_ADDRESS = r"\b(?:address|customer\s+care|email|phone|mobile)\b"
ADDRESS_WORDS = [
    "road", "rd", "street", "st.", "lane", "ln", "industrial", "area", "phase", "sector", "plot", "floor", "building", "nagar", "market",
    "delhi", "mumbai", "kolkata", "chennai", "bengaluru", "bangalore", "hyderabad", "india",
]
PIN = r"\b\d{6}\b"
NOT_A_NAME = [
    r"^nutrition\s+facts?$", r"^suggested\s+serving", r"^amount\s+per", r"^ingredients?$", r"^country\s+of\s+origin", r"^storage", r"^storage\s+information", r"^packed", r"^manufactured",
    r"^marketed", r"^customer\s+care", r"^email", r"^like\s+us", r"^net\s+weight", r"^net\s+quantity", r"^mrp", r"^usp", r"^batch", r"^date\s+of", r"^use\s+by", r"^best\s+before",
]
NEVER_A_NAME = ["NUTRITION", "NUTRITION FACTS", "SUGGESTED USES", "PROMISE", "INGREDIENTS"]
ONLY_NUMBERS = r"^[\d\s.,:/()\-]+$"
PRICE_ANYWHERE = r"(?:MRP|M\.?\s*R\.?\s*P\.?)\s*[:\-]?\s*(?:₹|RS\.?|INR)?\s*[\(\[]?\s*(\d+(?:\.\d{1,2})?)"
QUANTITY_ANYWHERE = r"\b(?:NET\s+WEIGHT|NET\s+QUANTITY|NET\s+QTY|NET\s+WT\.?)\s*[:\-]?\s*((?:\d+(?:\.\d+)?)\s*(?:kg|kgs|g|gm|gms|mg|ml|l|ltr|litre|liter))\b"

FIELDS = ["product_name", "mrp", "net_quantity", "manufacturer", "address"]

CLEAN_TEXT = [Step(r"\r", "\n", False), Step(r"\t", " ", False), BLANKS, Step(r"\n\s*\n+", "\n", False), STRIP]
EDGES = Step(r"^[ :\-–—|]+|[ :\-–—|]+$", "", False)
CLEAN_VALUE = [STRIP, EDGES, SQUEEZE, STRIP]
CLEAN_MAKER = [*CLEAN_VALUE, Step(r"[.,:;\-]+$", "", False)]
CLEAN_ADDRESS = [SQUEEZE, EDGES]
CURRENCY_LETTERS = Step(r"\bR[S5]\.?\b", "Rs")


def _filled(text: Column) -> Column:
    """Null if empty; the text is evaluated once."""
    return F.get(F.filter(F.array(text), lambda x: x != ""), 0)


def clean_lines(text: Column) -> Column:
    """The lines of a label without blank ones, marks at the edges and repeated blanks."""
    raw = F.split(replaced(F.coalesce(text, F.lit("")), CLEAN_TEXT), "\n")
    return F.filter(F.transform(raw, lambda x: replaced(x, CLEAN_VALUE)), lambda x: x != "")


def is_heading(line: Column, headings: list[str]) -> Column:
    return matches(line, ANY_HEADING) & matches(line, "|".join(f"(?:{h})" for h in headings))


def is_no_name(line: Column) -> Column:
    """One anchor for all patterns, so that they are tried at the start of the line only."""
    return matches(line, "^(?:" + "|".join(h.removeprefix("^") for h in NOT_A_NAME) + ")")


def value_after(line: Column, headings: list[str]) -> Column:
    """What stands behind a heading. The headings are tried in their order; one with nothing behind it is passed over."""
    return F.coalesce(*[_filled(replaced(F.regexp_extract(line, f"(?is)^.*?(?:{h})(.*)$", 1), CLEAN_VALUE)) for h in headings])


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), 0)


def _places(lines: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (F.size(lines) > 0) & test(F.get(lines, F.greatest(i, F.lit(0)))))


def _next(lines: Column, i: Column, n: int) -> Column:
    return F.slice(lines, i + 2, n)


def next_value(lines: Column, i: Column, most: int = 4) -> Column:
    """The first of the lines behind place i that is no heading, among `most`; null if there is none."""
    return F.get(F.filter(_next(lines, i, most), lambda x: ~is_heading(x, ALL_HEADINGS)), 0)


def _until(lines: Column, stop: Callable[[Column], Column], most: int | None = None) -> Column:
    """The lines before the first at which to stop."""
    at = F.array_position(F.transform(lines, stop), True)
    n = F.when(at == 0, F.size(lines)).otherwise(at - 1).cast("int")
    return F.slice(lines, 1, F.least(n, F.lit(most)) if most else n)


def _under_heading(lines: Column, headings: list[str], parse: Callable[[Column], Column]) -> Column:
    """For the first heading that gives a value: parsed from behind it, else from the first of four next lines that parses."""
    here = lambda i: F.coalesce(parse(value_after(F.get(lines, i), headings)), _first(F.transform(_next(lines, i, 4), parse)))
    return _first(F.transform(_places(lines, lambda x: is_heading(x, headings)), here))


def _price(text: Column) -> Column:
    return price(replaced(text, [CURRENCY_LETTERS]))


def extract_price(lines: Column) -> Column:
    anywhere = F.regexp_extract(F.array_join(lines, " "), "(?i)" + PRICE_ANYWHERE, 1)
    return F.coalesce(_under_heading(lines, PRICE_HEADINGS, _price), F.when(anywhere != "", F.concat(F.lit("₹"), anywhere)))


def extract_quantity(lines: Column) -> Column:
    return F.coalesce(_under_heading(lines, QUANTITY_HEADINGS, quantity), quantity(_filled(F.regexp_extract(F.array_join(lines, " "), "(?i)" + QUANTITY_ANYWHERE, 1))))


def extract_maker(lines: Column) -> Column:
    stop = lambda x: is_heading(x, ALL_HEADINGS) | matches(x, CONTACT_OR_ADDRESS)
    clean = lambda x: _filled(replaced(x, CLEAN_MAKER))
    here = lambda i: F.coalesce(clean(value_after(F.get(lines, i), MAKER_HEADINGS)), clean(F.array_join(_until(_next(lines, i, 4), stop, 2), " ")))
    return _first(F.transform(_places(lines, lambda x: is_heading(x, MAKER_HEADINGS)), here))


def looks_like_address(line: Column) -> Column:
    words = once(F.lower(line), lambda x: F.exists(F.array(*map(F.lit, ADDRESS_WORDS)), lambda w: F.contains(x, w)))
    return line.rlike(PIN) | words | line.rlike(r"\d+\s*[-,/]")


def extract_address(lines: Column, maker: Column, pin: Column) -> Column:
    """maker, pin: places of the first maker heading and the first postal code, or null. Under its own heading; else behind the maker; else the lines up to the first one with a postal code."""
    stop = lambda x: is_heading(x, ALL_HEADINGS) | matches(x, CONTACT)
    clean = lambda x: _filled(replaced(x, CLEAN_ADDRESS))
    headed = lambda i: F.coalesce(clean(value_after(F.get(lines, i), ADDRESS_HEADINGS)), clean(F.array_join(_until(_next(lines, i, 5), stop), " ")))
    own = _first(F.transform(_places(lines, lambda x: is_heading(x, ADDRESS_HEADINGS)), headed))
    behind = F.filter(_until(F.slice(lines, F.coalesce(maker, F.lit(0)) + 3, 6), stop), looks_like_address)
    behind = F.when(maker.isNotNull(), clean(F.array_join(behind, " ")))
    first = F.greatest(F.coalesce(pin, F.lit(0)) - 3, F.lit(0))
    above = F.filter(F.slice(lines, first + 1, F.coalesce(pin, F.lit(0)) - first + 1), looks_like_address)
    return F.coalesce(own, behind, F.when(pin.isNotNull(), clean(F.array_join(above, " "))))


def extract_name(lines: Column) -> Column:
    """The first of ten candidate lines with five characters and a letter that isn't a section title, else the first candidate."""
    candidates = F.filter(lines, lambda x: ~is_no_name(x) & (F.length(x) >= 3) & ~x.rlike(ONLY_NUMBERS))
    named = F.filter(F.slice(candidates, 1, 10), lambda x: (F.length(x) >= 5) & x.rlike("[A-Za-z]") & ~F.upper(x).isin(*NEVER_A_NAME))
    return F.coalesce(F.get(named, 0), F.get(candidates, 0))


def extract(labels: DataFrame, text: str = "text") -> DataFrame:
    """labels with product_name, mrp, net_quantity, manufacturer and address; each null where nothing was found. A null text has no lines."""
    def details(lines: Column) -> Column:
        places = F.struct(F.get(_places(lines, lambda x: is_heading(x, MAKER_HEADINGS)), 0).alias("maker"), F.get(_places(lines, lambda x: x.rlike(PIN)), 0).alias("pin"))
        return F.struct(
            extract_name(lines).alias("product_name"), extract_price(lines).alias("mrp"), extract_quantity(lines).alias("net_quantity"), extract_maker(lines).alias("manufacturer"),
            once(places, lambda x: extract_address(lines, x.maker, x.pin)).alias("address"),
        )

    found = labels.withColumn("_found", once(clean_lines(F.col(text)), details))
    return found.withColumns({n: F.col(f"_found.{n}") for n in FIELDS}).drop("_found")


# The same in SQL.


def _any_sql(line: str, headings: list[str]) -> str:
    return matches_sql(line, "|".join(f"(?:{h})" for h in headings))


def _after_sql(line: str, headings: list[str]) -> str:
    rests = [replaced_sql(f"regexp_extract({line}, {quoted(f'^.*?(?:{h})(.*)$')}, 1, 'is')", CLEAN_VALUE) for h in headings]
    return "coalesce(" + ", ".join(f"nullif({r}, '')" for r in rests) + ")"


def _first_sql(values: str) -> str:
    return f"list_filter({values}, lambda v: v IS NOT NULL)[1]"


def _until_sql(lines: str, stop: str, most: int) -> str:
    """stop: SQL over s."""
    return f"list_slice({lines}, 1, least(coalesce(list_position(list_transform({lines}, lambda s: {stop}), true) - 1, {most}), {most}))"


def _places_sql(test: str) -> str:
    """test: SQL over lines[i]."""
    return f"list_filter(range(1, len(lines) + 1), lambda i: {test})"


def next_value_sql(lines: str, i: str, most: int = 4) -> str:
    """i counts from 1."""
    return f"list_filter({lines}[{i} + 1:{i} + {most}], lambda n: NOT {_any_sql('n', ALL_HEADINGS)})[1]"


def clean_lines_sql(text: str) -> str:
    raw = f"string_split({replaced_sql(filled_sql(text), CLEAN_TEXT)}, chr(10))"
    return f"list_filter(list_transform({raw}, lambda r: {replaced_sql('r', CLEAN_VALUE)}), lambda r: r <> '')"


def extracted_sql(labels: str, *keys: str) -> str:
    """Over labels with a column text."""
    money = lambda x: price_sql(replaced_sql(x, [CURRENCY_LETTERS]))

    def headed(headings: list[str], parse: Callable[[str], str]) -> str:
        behind = _first_sql(f"list_transform(lines[i + 1:i + 4], lambda n: {parse('n')})")
        value = f"coalesce({parse(_after_sql('lines[i]', headings))}, {behind})"
        return _first_sql(f"list_transform({_places_sql(_any_sql('lines[i]', headings))}, lambda i: {value})")

    joined = "array_to_string(lines, ' ')"
    anywhere = f"regexp_extract({joined}, {quoted(PRICE_ANYWHERE)}, 1, 'i')"
    some = quantity_sql(f"regexp_extract({joined}, {quoted(QUANTITY_ANYWHERE)}, 1, 'i')")
    stop_maker = f"({_any_sql('s', ALL_HEADINGS)} OR {matches_sql('s', CONTACT_OR_ADDRESS)})"
    stop = f"({_any_sql('s', ALL_HEADINGS)} OR {matches_sql('s', CONTACT)})"
    clean_maker = lambda x: f"nullif({replaced_sql(x, CLEAN_MAKER)}, '')"
    clean_address = lambda x: f"nullif({replaced_sql(x, CLEAN_ADDRESS)}, '')"
    join = lambda x: f"array_to_string({x}, ' ')"
    maker = f"coalesce({clean_maker(_after_sql('lines[i]', MAKER_HEADINGS))}, {clean_maker(join(_until_sql('lines[i + 1:i + 4]', stop_maker, 2)))})"
    maker = _first_sql(f"list_transform({_places_sql(_any_sql('lines[i]', MAKER_HEADINGS))}, lambda i: {maker})")
    words = " OR ".join(f"contains(lower(a), {quoted(w)})" for w in ADDRESS_WORDS)
    like = f"({matches_sql('a', PIN)} OR {words} OR {matches_sql('a', r'[0-9]+[ ]*[-,/]')})"
    own = f"coalesce({clean_address(_after_sql('lines[i]', ADDRESS_HEADINGS))}, {clean_address(join(_until_sql('lines[i + 1:i + 5]', stop, 5)))})"
    own = _first_sql(f"list_transform({_places_sql(_any_sql('lines[i]', ADDRESS_HEADINGS))}, lambda i: {own})")
    at = f"{_places_sql(_any_sql('lines[i]', MAKER_HEADINGS))}[1]"
    behind_lines = f"lines[{at} + 2:{at} + 7]"
    behind = f"CASE WHEN {at} IS NOT NULL THEN {clean_address(join(f'list_filter({_until_sql(behind_lines, stop, 6)}, lambda a: {like})'))} END"
    pin = f"{_places_sql(matches_sql('lines[i]', PIN))}[1]"
    above = f"CASE WHEN {pin} IS NOT NULL THEN {clean_address(join(f'list_filter(lines[greatest({pin} - 3, 1):{pin}], lambda a: {like})'))} END"
    candidate = f"list_filter(lines, lambda c: NOT {_any_sql('c', NOT_A_NAME)} AND length(c) >= 3 AND NOT {matches_sql('c', ONLY_NUMBERS)})"
    blocked = ", ".join(map(quoted, NEVER_A_NAME))
    named = f"list_filter(({candidate})[1:10], lambda d: length(d) >= 5 AND {matches_sql('d', '[A-Za-z]', False)} AND upper(d) NOT IN ({blocked}))[1]"
    return f"""
    SELECT {", ".join(keys)}, coalesce({named}, {candidate}[1]) AS product_name,
      coalesce({headed(PRICE_HEADINGS, money)}, CASE WHEN {anywhere} <> '' THEN concat('₹', {anywhere}) END) AS mrp,
      coalesce({headed(QUANTITY_HEADINGS, quantity_sql)}, {some}) AS net_quantity, {maker} AS manufacturer, coalesce({own}, {behind}, {above}) AS address
    FROM (SELECT *, {clean_lines_sql("text")} AS lines FROM ({labels}))"""

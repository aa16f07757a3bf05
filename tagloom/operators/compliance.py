"""Rules over packages: one check for each rule, and what follows from the checks.

The rules are few, so each package's checks are one array expression: no join, no shuffle. Explode it for one row for each check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.dialect import once, quoted, replaced_sql
from tagloom.functions.text import RULE_FORM, is_present, rule_form
from tagloom.sources.rules import RULES, Rule

PASS, FAIL, REVIEW, NOT_APPLICABLE = "PASS", "FAIL", "REVIEW", "NOT_APPLICABLE"
GRAVE = ("CRITICAL", "HIGH")
# Messages.
NOT_NEEDED = "This requirement does not apply to this package."
MEASURE = "Physical measurement is required. This cannot be verified from an image alone."
REGISTER = "External registration verification is required."


def applies(applicability: str, columns: list[str]) -> Column:
    """Whether rules of that kind apply to a package. A column that isn't there, or null, says nothing; kinds that aren't known apply."""
    kind = F.lower(F.col("package_type")) if "package_type" in columns else F.lit(None).cast("string")
    if applicability == "retail_package":
        return F.coalesce(kind, F.lit("retail")) != "wholesale"
    if applicability == "wholesale_package":
        return F.coalesce(kind, F.lit("")) == "wholesale"
    if applicability == "imported_package":
        imported = F.coalesce(F.col("imported"), F.lit(False)) if "imported" in columns else F.lit(False)
        return imported | (is_present(F.col("country_of_origin")) if "country_of_origin" in columns else F.lit(False))
    return F.lit(True)


def _check(rule: Rule, pos: int, columns: list[str], text: Column) -> Column:
    field = is_present(F.col(rule.key)) if rule.key in columns else F.lit(False)
    patterns = [p for p in rule.detection_patterns if p.strip()]
    seen = F.lit(False)
    for p in patterns:
        seen = seen | F.contains(text, rule_form(F.lit(p)))
    outcome = [(~applies(rule.applicability, columns), NOT_APPLICABLE, NOT_NEEDED)]
    if rule.verification_method == "physical_measurement":
        last = (REVIEW, MEASURE)
    elif rule.verification_method == "external_database_or_document":
        last = (REVIEW, REGISTER)
    else:
        outcome += [(field, PASS, f"{rule.name} detected."), (seen, PASS, f"{rule.name} detected in label text.")]
        last = (FAIL, rule.failure_message or f"{rule.name} was not detected.") if rule.required else (REVIEW, f"{rule.name} could not be automatically verified.")

    def cascade(place: int) -> Column:
        case = F.lit(last[place - 1])
        for x in reversed(outcome):
            case = F.when(x[0], x[place]).otherwise(case)
        return case

    return F.struct(
        F.lit(pos).alias("rule_pos"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.key).alias("field"), F.lit(rule.name).alias("name"), cascade(1).alias("status"),
        F.lit(rule.severity).alias("severity"), F.lit(rule.rule_reference).alias("rule_reference"), cascade(2).alias("message"),
    )


def with_checks(packages: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """packages with `checks`: an array with one element for each rule, in the rules' order. Columns named after a rule's field hold what was extracted."""
    columns = packages.columns
    every = lambda t: F.array(*[_check(r, i, columns, t) for i, r in enumerate(rules)])
    return packages.withColumn("checks", once(rule_form(F.col(text)), every))


def overall(checks: Column) -> Column:
    """NON_COMPLIANT if something grave failed, else REVIEW if anything needs review, else COMPLIANT."""
    return (
        F.when(F.exists(checks, lambda c: (c.status == FAIL) & c.severity.isin(*GRAVE)), "NON_COMPLIANT").when(F.exists(checks, lambda c: c.status == REVIEW), REVIEW).otherwise("COMPLIANT")
    )


def with_status(checked: DataFrame) -> DataFrame:
    """Adds overall_status, total_checks, passed, failed, review and not_applicable."""
    count = lambda status: F.size(F.filter("checks", lambda c: c.status == status)).cast("long")
    return checked.withColumns({
        "overall_status": overall(F.col("checks")), "total_checks": F.size("checks").cast("long"),
        "passed": count(PASS), "failed": count(FAIL), "review": count(REVIEW), "not_applicable": count(NOT_APPLICABLE),
    })


def violations(checks: Column) -> Column:
    """The messages of failed checks in the rules' order."""
    return F.transform(F.filter(checks, lambda c: c.status == FAIL), lambda c: c.message)


def check_rows(checked: DataFrame, *keys: str) -> DataFrame:
    """One row for each check."""
    return checked.select(*keys, F.explode("checks").alias("c")).select(*keys, "c.*")


# The same in SQL: rules as a table, joined to every package.


def _values(rules: list[Rule]) -> str:
    row = lambda i, r: f"({i}, {quoted(r.rule_id)}, {quoted(r.key)}, {quoted(r.name)}, {quoted(r.applicability)}, {quoted(r.severity)}, {quoted(r.rule_reference)}, {r.required}, {quoted(r.verification_method or '')}, CAST([{', '.join(map(quoted, r.detection_patterns))}] AS VARCHAR[]), {quoted(r.failure_message)})"
    return "(VALUES " + ", ".join(row(i, r) for i, r in enumerate(rules)) + ") AS r(rule_pos, rule_id, field, name, applicability, severity, rule_reference, required, method, patterns, failure_message)"


def checks_sql(packages: str, fields: list[str], rules: list[Rule] = RULES) -> str:
    present = "CASE r.field " + " ".join(f"WHEN '{f}' THEN coalesce(trim({f}) <> '', false)" for f in fields) + " ELSE false END"
    text = replaced_sql("lower(coalesce(text, ''))", RULE_FORM)
    pattern = replaced_sql("lower(x)", RULE_FORM)
    cases = f"""
    CASE WHEN NOT CASE applicability WHEN 'retail_package' THEN package_type <> 'wholesale' WHEN 'wholesale_package' THEN package_type = 'wholesale'
      WHEN 'imported_package' THEN imported OR coalesce(trim(country_of_origin) <> '', false) ELSE true END THEN 1
    WHEN method = 'physical_measurement' THEN 2 WHEN method = 'external_database_or_document' THEN 3
    WHEN {present} THEN 4 WHEN len(list_filter(patterns, lambda x: contains(rule_text, {pattern}))) > 0 THEN 5 WHEN required THEN 6 ELSE 7 END"""
    return f"""
    SELECT *, CASE outcome WHEN 1 THEN 'NOT_APPLICABLE' WHEN 2 THEN 'REVIEW' WHEN 3 THEN 'REVIEW' WHEN 4 THEN 'PASS' WHEN 5 THEN 'PASS' WHEN 6 THEN 'FAIL' ELSE 'REVIEW' END AS status,
      CASE outcome WHEN 1 THEN {quoted(NOT_NEEDED)} WHEN 2 THEN {quoted(MEASURE)} WHEN 3 THEN {quoted(REGISTER)} WHEN 4 THEN concat(name, ' detected.') WHEN 5 THEN concat(name, ' detected in label text.')
        WHEN 6 THEN failure_message ELSE concat(name, ' could not be automatically verified.') END AS message
    FROM (SELECT *, {cases} AS outcome FROM (SELECT *, {text} AS rule_text FROM ({packages})) p CROSS JOIN {_values(rules)})"""


def status_sql(checks: str, *keys: str) -> str:
    names = ", ".join(keys)
    return f"""
    SELECT {names}, CASE WHEN bool_or(status = 'FAIL' AND severity IN ('CRITICAL', 'HIGH')) THEN 'NON_COMPLIANT' WHEN bool_or(status = 'REVIEW') THEN 'REVIEW' ELSE 'COMPLIANT' END AS overall_status,
      count(*) AS total_checks, count_if(status = 'PASS')::BIGINT AS passed, count_if(status = 'FAIL')::BIGINT AS failed, count_if(status = 'REVIEW')::BIGINT AS review, count_if(status = 'NOT_APPLICABLE')::BIGINT AS not_applicable
    FROM ({checks}) GROUP BY {names}"""

"""Which line of a label declares which field: by aliases, patterns and the line that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.dialect import STRIP, filled_sql, matches_sql, quoted, replaced, replaced_sql, steady, steady_sql
from tagloom.functions.text import VIEW_FORM, view_form, words_only

# Aliases, patterns, weights and required declarations.
ALIASES = {
    "mrp": ["mrp", "m.r.p", "maximum retail price", "max retail price", "retail price", "incl all taxes", "inclusive of all taxes"],
    "net_quantity": ["net quantity", "net qty", "net weight", "net wt", "net volume", "contents", "quantity", "weight", "volume"],
    "manufacturer": ["manufactured by", "manufactured & marketed by", "manufactured and marketed by", "manufacturer", "manufactured for", "packed by", "packer", "packed for"],
    "address": ["address", "registered office", "corporate office", "manufactured at", "packed at"],
    "manufacturing_date": ["mfg", "mfd", "manufactured on", "manufacturing date", "date of manufacture", "month and year of manufacture"],
    "best_before": ["best before", "best-before", "use by", "use-by", "expiry", "expires", "expiry date"],
    "batch": ["batch no", "batch number", "batch code", "lot no", "lot number"],
    "product_name": ["product", "product name", "name of product", "common name", "generic name"],
    "country_of_origin": ["country of origin", "made in", "origin"],
    "consumer_care": ["consumer care", "customer care", "care number", "toll free", "helpline", "customer service"],
}
_DATE = r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{1,2}[-/][A-Za-z]{3,9}[-/]\d{2,4}|[A-Za-z]{3,9}[-/]\d{2,4})\b"
PATTERNS = {
    "mrp": r"\b(?:mrp|maximum retail price)\b\s*[:\-]?\s*(?:rs\.?|₹)?\s*\d",
    "net_quantity": r"\b\d+(?:\.\d+)?\s*(?:kg|g|mg|l|ml|cl|pcs?|pieces?)\b",
    "manufacturing_date": _DATE,
    "best_before": _DATE,
    "batch": r"\b(?:batch|lot)\s*(?:no|number|code)?\s*[:\-]?\s*[A-Za-z0-9-]+",
    "consumer_care": r"(?:\+?\d[\d ()-]{7,}\d|toll[\s-]*free|helpline)",
}
SEMANTIC, PATTERN, CONTEXT, PARTIAL, NEXT_LINE, LEAST = 0.55, 0.30, 0.15, 0.75, 0.85, 0.35
REQUIRED = {
    "product_name": "Product/common or generic name", "net_quantity": "Net quantity", "mrp": "MRP", "manufacturer": "Manufacturer/packer/importer details", "address": "Address",
    "manufacturing_date": "Manufacturing date", "consumer_care": "Consumer-care information",
}
IF_IMPORTED = {"country_of_origin": "Country of origin"}


def _words(alias: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in alias.lower()).split())


def alias_score(words: Column, field: str) -> Column:
    """words: the line's words in lower case. One for an alias as a whole; of several words the share that occurs, at a discount."""
    scores = [F.lit(0.0)]
    for alias in dict.fromkeys(map(_words, ALIASES[field])):
        parts = sorted(set(alias.split()))
        partial = F.lit(0.0)
        if len(alias.split()) >= 2:
            share = F.size(F.array_intersect(F.split(words, " "), F.array(*map(F.lit, parts)))) / F.lit(float(len(parts)))
            partial = share * PARTIAL
        scores.append(F.when(F.contains(words, F.lit(alias)), 1.0).otherwise(partial))
    return F.greatest(*scores)


def pattern_score(lowered: Column, field: str) -> Column:
    return F.when(lowered.rlike(PATTERNS[field]), 1.0).otherwise(0.0) if field in PATTERNS else F.lit(0.0)


def classify_lines(labels: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, field, text, score, semantic_score, pattern_score, context_score, line_index: for each field the line with the highest score, if it is at least 0.35; of equals the first line.

    Everything happens in arrays of one label; a null text has no lines.
    """
    lines = F.filter(F.transform(F.split(view_form(F.col(text)), "\n"), lambda x: replaced(x, [STRIP])), lambda x: x != "")
    held = labels.select(*keys, lines.alias("_lines"))
    lined = held.select(
        *keys,
        F.transform(
            "_lines",
            lambda x, i: F.struct(i.cast("long").alias("at"), x.alias("line"), F.lower(x).alias("lowered"), words_only(x).alias("words"), F.lower(F.concat(x, F.lit(" "), F.get("_lines", i + 1))).alias("both")),
        ).alias("_lines"),
    )

    def scored(field: str) -> Column:
        def one(x: Column) -> Column:
            semantic, pattern = alias_score(x.words, field), pattern_score(x.lowered, field)
            context = F.coalesce(pattern_score(x.both, field) * NEXT_LINE, F.lit(0.0))
            return F.struct(semantic.alias("semantic"), pattern.alias("pattern"), F.when(x.both.isNotNull(), context).otherwise(0.0).alias("context"), x.at.alias("at"), x.line.alias("line"))

        def total(s: Column) -> Column:
            score = F.least(F.lit(1.0), s.semantic * SEMANTIC + s.pattern * PATTERN + s.context * CONTEXT)
            return F.struct(score.alias("raw"), steady(score, 4).alias("score"), (-s.at).alias("order"), s.semantic, s.pattern, s.context, s.line)

        kept = F.filter(F.transform(F.transform("_lines", one), total), lambda s: s.raw >= LEAST)
        best = F.array_max(F.transform(kept, lambda s: F.struct(s.score.alias("score"), s.order.alias("order"), s.semantic.alias("semantic"), s.pattern.alias("pattern"), s.context.alias("context"), s.line.alias("line"))))
        return F.transform(F.filter(F.array(best), lambda b: b.isNotNull()), lambda b: F.struct(F.lit(field).alias("field"), b.alias("b")))

    found = lined.select(*keys, F.explode(F.flatten(F.array(*map(scored, ALIASES)))).alias("c"))
    return found.select(
        *keys, F.col("c.field").alias("field"), F.col("c.b.line").alias("text"), F.col("c.b.score").alias("score"), F.round("c.b.semantic", 4).alias("semantic_score"),
        F.round("c.b.pattern", 4).alias("pattern_score"), F.round("c.b.context", 4).alias("context_score"), (-F.col("c.b.order")).alias("line_index"),
    )


def band(confidence: Column) -> Column:
    return F.when(confidence >= 80, "HIGH").when(confidence >= 60, "MEDIUM").otherwise("REVIEW")


def with_confidence(classified: DataFrame, ocr_confidence: Column) -> DataFrame:
    """Adds confidence_percent, review_required and band; a null recognition confidence counts as none."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    value = 0.35 * unit(F.coalesce(ocr_confidence, F.lit(0.0))) + 0.25 * F.col("semantic_score") + 0.20 * F.col("pattern_score") + 0.10 * F.col("context_score") + 0.10 * F.col("score")
    out = classified.withColumn("confidence_percent", steady(unit(value) * 100, 1))
    return out.withColumns({"review_required": F.col("confidence_percent") < 70, "band": band(F.col("confidence_percent"))})


def missing_declarations(labels: DataFrame, classified: DataFrame, key: str, imported: Column) -> DataFrame:
    """key, field, declaration: what each label should declare and no line does."""
    everything = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(d).alias("declaration"), F.lit(f in IF_IMPORTED).alias("extra")) for f, d in {**REQUIRED, **IF_IMPORTED}.items()])
    wanted = labels.select(key, F.explode(F.filter(everything, lambda x: ~x.extra | F.coalesce(imported, F.lit(False)))).alias("w")).select(key, "w.field", "w.declaration")
    return wanted.join(classified.select(key, "field"), [key, "field"], "left_anti")


# The same in SQL.


def classified_sql(labels: str, key: str) -> str:
    lines = f"list_filter(list_transform(string_split({replaced_sql(filled_sql(), VIEW_FORM)}, chr(10)), lambda x: {replaced_sql('x', [STRIP])}), lambda x: x <> '')"
    semantic, pattern, context = ([], [], [])
    for field, aliases in ALIASES.items():
        scores = []
        for alias in dict.fromkeys(map(_words, aliases)):
            parts = sorted(set(alias.split()))
            partial = f"len(list_intersect(string_split(words, ' '), [{', '.join(map(quoted, parts))}])) / CAST({len(parts)} AS DOUBLE) * CAST({PARTIAL} AS DOUBLE)" if len(alias.split()) >= 2 else "CAST(0 AS DOUBLE)"
            scores.append(f"CASE WHEN contains(words, {quoted(alias)}) THEN CAST(1 AS DOUBLE) ELSE {partial} END")
        semantic.append(f"WHEN '{field}' THEN greatest({', '.join(scores)})")
        hit = lambda t, f=field: f"CASE WHEN {matches_sql(t, PATTERNS[f], False)} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" if f in PATTERNS else "CAST(0 AS DOUBLE)"
        pattern.append(f"WHEN '{field}' THEN {hit('lowered')}")
        context.append(f"WHEN '{field}' THEN {hit('both_lines')}")
    fields = ", ".join(f"('{f}')" for f in ALIASES)
    return f"""
    SELECT {key}, field, line AS text, score, {steady_sql('semantic', 4)} AS semantic_score, pattern AS pattern_score, {steady_sql('context', 4)} AS context_score, line_index FROM (
      SELECT *, {steady_sql('raw', 4)} AS score, row_number() OVER (PARTITION BY {key}, field ORDER BY {steady_sql('raw', 4)} DESC, line_index) AS place FROM (
        SELECT *, least(CAST(1 AS DOUBLE), semantic * CAST({SEMANTIC} AS DOUBLE) + pattern * CAST({PATTERN} AS DOUBLE) + context * CAST({CONTEXT} AS DOUBLE)) AS raw FROM (
          SELECT *, CASE field {" ".join(semantic)} END AS semantic, CASE field {" ".join(pattern)} END AS pattern,
            CASE WHEN both_lines IS NULL THEN CAST(0 AS DOUBLE) ELSE (CASE field {" ".join(context)} END) * CAST({NEXT_LINE} AS DOUBLE) END AS context
          FROM (
            SELECT {key}, i AS line_index, lines[i + 1] AS line, lower(lines[i + 1]) AS lowered, trim(regexp_replace(lower(lines[i + 1]), '[^a-z0-9]+', ' ', 'g')) AS words,
              lower(lines[i + 1] || ' ' || lines[i + 2]) AS both_lines
            FROM (SELECT {key}, {lines} AS lines FROM ({labels})), unnest(range(len(lines))) AS u(i)
          ) CROSS JOIN (VALUES {fields}) AS f(field)
        )
      ) WHERE raw >= CAST({LEAST} AS DOUBLE)
    ) WHERE place = 1"""


def confidence_sql(classified: str, key: str, ocr: str) -> str:
    """ocr: SQL over (key, confidence)."""
    value = "0.35::DOUBLE * greatest(0, least(1, coalesce(confidence, 0)))::DOUBLE + 0.25::DOUBLE * semantic_score + 0.20::DOUBLE * pattern_score + 0.10::DOUBLE * context_score + 0.10::DOUBLE * score"
    return f"""
    SELECT *, confidence_percent < 70 AS review_required, CASE WHEN confidence_percent >= 80 THEN 'HIGH' WHEN confidence_percent >= 60 THEN 'MEDIUM' ELSE 'REVIEW' END AS band
    FROM (SELECT c.*, {steady_sql(f"greatest(0::DOUBLE, least(1::DOUBLE, {value})) * 100", 1)} AS confidence_percent FROM ({classified}) c LEFT JOIN ({ocr}) o ON o.{key} = c.{key})"""


def missing_sql(labels: str, classified: str, key: str, imported: str) -> str:
    values = ", ".join(f"('{f}', {quoted(d)}, {f in IF_IMPORTED})" for f, d in {**REQUIRED, **IF_IMPORTED}.items())
    return f"""
    SELECT l.{key}, field, declaration FROM ({labels}) l CROSS JOIN (VALUES {values}) AS w(field, declaration, extra)
    WHERE (NOT extra OR coalesce({imported}, false)) AND NOT EXISTS (SELECT 1 FROM ({classified}) c WHERE c.{key} = l.{key} AND c.field = w.field)"""

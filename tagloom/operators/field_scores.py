"""Fields of single detections: by keyword, pattern, format and by what stands near.

Scores of all fields are one array in the order of FIELDS, so a detection is scored in place; only neighbours need a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import geometry
from tagloom.functions.dialect import matches_sql, once, quickly, quoted, replaced, replaced_sql, steady, steady_sql, where_once
from tagloom.functions.similarity import fuzzy_scores
from tagloom.functions.text import NORMAL_FORM, compacted, compatible, searchable

# Fields, their keywords, patterns, formats, priors and weights.
FIELDS = [
    "product_name", "mrp", "net_quantity", "manufacturer", "address", "batch_number", "manufacturing_date", "expiry_date", "fssai_license", "ingredients", "country_of_origin", "customer_care", "email",
]
UNKNOWN = "unknown"
KEYWORDS = {
    "product_name": [],
    "mrp": ["mrp", "maximum retail price", "max retail price", "max. retail price", "retail price", "maximum retail"],
    "net_quantity": ["net quantity", "net qty", "net weight", "net wt", "net content", "quantity", "weight", "contents", "content"],
    "manufacturer": [
        "manufactured by", "manufactured and marketed by", "manufactured & marketed by", "packed by", "packed and marketed by", "packed & marketed by", "marketed by", "mfd by", "mfg by", "packer", "manufacturer",
    ],
    "address": ["address", "registered office", "corporate office", "manufacturing address", "factory address", "unit address"],
    "batch_number": ["batch", "batch no", "batch number", "batch code", "lot no", "lot number", "lot code"],
    "manufacturing_date": ["manufacturing date", "manufacture date", "mfg date", "mfd date", "date of manufacture", "date of mfg", "date of mfd"],
    "expiry_date": ["expiry", "expiry date", "expiration", "expiration date", "use by", "best before", "best before end"],
    "fssai_license": ["fssai", "fssai license", "fssai licence", "fssai lic", "food safety license", "food safety licence"],
    "ingredients": ["ingredients", "ingredient", "contains", "composition"],
    "country_of_origin": ["country of origin", "country of origin:", "made in", "manufactured in", "product of"],
    "customer_care": ["customer care", "customer service", "consumer care", "helpline", "toll free", "contact us"],
    "email": ["email", "e-mail"],
}
PATTERNS = {
    "mrp": [r"\bmrp\b", r"maximum\s+retail\s+price", r"max(?:imum)?\.?\s+retail\s+price"],
    "net_quantity": [r"net\s+(?:quantity|qty|weight|wt|content)"],
    "manufacturer": [r"manufactured\s+by", r"manufactured\s+(?:and|&)\s+marketed\s+by", r"packed\s+by", r"packed\s+(?:and|&)\s+marketed\s+by", r"marketed\s+by", r"\bmfd\.?\s+by\b", r"\bmfg\.?\s+by\b"],
    "address": [r"\baddress\b", r"registered\s+office", r"corporate\s+office", r"manufacturing\s+address"],
    "batch_number": [r"\bbatch\b", r"batch\s+(?:no|number|code)", r"lot\s+(?:no|number|code)"],
    "manufacturing_date": [r"manufacturing\s+date", r"manufacture\s+date", r"mfg\.?\s+date", r"mfd\.?\s+date", r"date\s+of\s+manufacture"],
    "expiry_date": [r"\bexpiry\b", r"expiry\s+date", r"expiration\s+date", r"\buse\s+by\b", r"best\s+before"],
    "fssai_license": [r"\bfssai\b", r"food\s+safety\s+(?:license|licence)"],
    "ingredients": [r"\bingredients?\b", r"\bcontains\b", r"\bcomposition\b"],
    "country_of_origin": [r"country\s+of\s+origin", r"\bmade\s+in\b", r"product\s+of"],
    "customer_care": [r"customer\s+care", r"customer\s+service", r"consumer\s+care", r"helpline", r"toll\s*free"],
    "email": [r"\bemail\b", r"\be-mail\b", r"[\w.+-]+@[\w-]+\.[\w.-]+"],
}
_DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}[/-]\d{4}|\d{4}[/-]\d{1,2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{2,4})\b"
#: field: (pattern, worth, any case), the first that occurs counts.
FORMATS = {
    "mrp": [(r"(?:₹|rs\.?|inr)?\s*\d{1,7}(?:[.,]\d{1,2})?\s*(?:/-)?", 0.85, True)],
    "net_quantity": [(r"\d+(?:\.\d+)?\s*(?:kg|kgs|g|gm|gms|mg|ml|l|ltr|litre|liter)\b", 0.90, True)],
    "manufacturing_date": [(_DATE, 0.75, True)],
    "expiry_date": [(_DATE, 0.75, True)],
    "fssai_license": [("fssai", 0.85, True), (r"\b\d{10,14}\b", 0.40, False)],
    "email": [(r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b", 1.0, False)],
    "address": [(r"\b[1-9]\d{5}\b", 0.90, False)],
    "customer_care": [(r"(?:\+91[\s-]?)?[6-9]\d{9}\b", 0.70, False)],
}
PRIORS = {
    "mrp": 0.10, "net_quantity": 0.10, "manufacturer": 0.08, "address": 0.05, "batch_number": 0.04, "manufacturing_date": 0.04, "expiry_date": 0.04, "fssai_license": 0.04,
    "ingredients": 0.03, "country_of_origin": 0.03, "customer_care": 0.02, "email": 0.02, "product_name": 0.02,
}
NOT_A_NAME = [
    "nutrition facts", "ingredients", "mrp", "net weight", "net quantity", "manufactured by", "packed by", "marketed by", "batch", "fssai", "expiry", "best before", "customer care", "address", "email", "country of origin",
]
SAME, INSIDE, FUZZY = 1.0, 0.85, [(0.90, 0.80), (0.78, 0.60)]
LEAST_DIRECT, LEAST_VALUE = 0.20, 0.15
REASONS = ("field keyword match", "field pattern match", "value format match")


def _key(keyword: str) -> str:
    """A keyword in searchable normal form; of these only the abbreviations of headings change."""
    known = {"net wt": "net weight", "net qty": "net quantity", "mfd by": "manufactured by", "mfg by": "manufactured by", "mfg date": "manufacturing date", "mfd date": "manufacturing date", "date of mfg": "date of manufacturing",
             "manufactured & marketed by": "manufactured and marketed by", "packed & marketed by": "packed and marketed by"}
    return known.get(keyword, keyword)


def keys(field: str) -> list[str]:
    return list(dict.fromkeys(_key(k) for k in KEYWORDS[field]))


def _compact_key(keyword: str) -> str:
    return "".join(c for c in keyword if c.isascii() and c.isalnum())


def keyword_score(found: Column, field: str) -> Column:
    """found: searchable normal form. One if a keyword is all of it, 0.85 if one occurs in it."""
    own = keys(field)
    if not own:
        return F.lit(0.0)
    inside = F.exists(F.array(*map(F.lit, own)), lambda k: F.contains(found, k))
    return F.when(found.isin(*own), SAME).when((found != "") & inside, INSIDE).otherwise(0.0)


def regex_score(found: Column, field: str) -> Column:
    return F.when(found.rlike("(?i)" + "|".join(PATTERNS[field])), 1.0).otherwise(0.0) if field in PATTERNS else F.lit(0.0)


def format_score(text: Column, field: str) -> Column:
    """text: normal form."""
    score = F.lit(0.0)
    for pattern, worth, any_case in reversed(FORMATS.get(field, [])):
        score = F.when(text.rlike(("(?i)" if any_case else "") + pattern), worth).otherwise(score)
    return score


def name_score(text: Column) -> Column:
    """How much a text in normal form looks like a product's name."""
    lowered = searchable(text)
    letters, digits = F.length(F.regexp_replace(text, "[^A-Za-z]", "")), F.length(F.regexp_replace(text, r"\D", ""))
    shouted = (F.upper(text) == text) & (F.lower(text) != text)
    some = lambda test, worth: F.when(test, worth).otherwise(0.0)
    score = 0.30 + some(F.length(text).between(4, 80), 0.20) + some(letters >= digits, 0.20) + some(F.size(F.split(text, r"\s+")) >= 2, 0.15) + some(shouted, 0.10)
    out = (F.length(text) < 3) | F.exists(F.array(*map(F.lit, NOT_A_NAME)), lambda w: F.contains(lowered, w)) | text.rlike(r"^[\d\s.,:/()\-]+$") | (letters == 0)
    return F.when(out, 0.0).otherwise(steady(F.least(F.lit(1.0), score), 4))


def scored(detections: DataFrame, fuzzy: bool = True, ascii_only: bool = False) -> DataFrame:
    """detections (text, ...) in normal form, without empty ones, with `scores`, an array in the order of FIELDS of (keyword, pattern, format), and `name_score`.

    fuzzy: keywords also count if the text is nearly one (in Arrow batches). ascii_only: texts hold no compatibility characters, all stays in the JVM.
    """
    held = detections.withColumn("_text", F.coalesce("text", F.lit("")) if ascii_only else compatible(F.col("text")))
    if fuzzy:
        near = {f: [_compact_key(k) for k in keys(f)] for f in FIELDS}
        held = held.withColumn("_fuzzy", fuzzy_scores(compacted(replaced(F.col("_text"), NORMAL_FORM)), near, FUZZY))

    def every(text: Column) -> Column:
        def one(found: Column, i: int, field: str) -> Column:
            keyword = keyword_score(found, field)
            if fuzzy:
                keyword = F.greatest(keyword, F.get("_fuzzy", F.lit(i)))
            return F.struct(keyword.alias("keyword"), regex_score(found, field).alias("pattern"), format_score(text, field).alias("format"))

        scores = once(searchable(text), lambda found: F.array(*[one(found, i, f) for i, f in enumerate(FIELDS)]))
        return F.struct(text.alias("text"), scores.alias("scores"), name_score(text).alias("name_score"))

    held = where_once(held, "_scored", once(replaced(F.col("_text"), NORMAL_FORM), every), lambda x: x.text != "").drop("_text", "_fuzzy")
    out = held.withColumns({"text": F.col("_scored.text"), "scores": F.col("_scored.scores"), "name_score": F.col("_scored.name_score")})
    return out.drop("_scored")


def direct_candidates(detections: DataFrame) -> DataFrame:
    """From scored detections: adds `candidates`, an array of (field, score, reasons) by falling score, best_field and field_score."""
    priors = F.array(*[F.lit(PRIORS[f]) for f in FIELDS])
    names = F.array(*map(F.lit, FIELDS))

    def one(s: Column, i: Column) -> Column:
        raw = s.keyword * 0.50 + s.pattern * 0.20 + s.format * 0.20 + F.get(priors, i) * 0.10
        reasons = F.filter(F.array(F.when(s.keyword > 0, REASONS[0]), F.when(s.pattern > 0, REASONS[1]), F.when(s.format > 0, REASONS[2])), lambda r: r.isNotNull())
        return F.struct((-steady(F.least(raw, F.lit(1.0)), 4)).alias("order"), i.alias("place"), F.get(names, i).alias("field"), reasons.alias("reasons"), raw.alias("raw"))

    found = F.array_sort(F.filter(F.transform("scores", one), lambda c: F.round(c.raw, 8) >= LEAST_DIRECT))
    out = detections.withColumn("candidates", F.transform(found, lambda c: F.struct(c.field.alias("field"), (-c.order).alias("score"), c.reasons.alias("reasons"))))
    return out.withColumns({
        "best_field": F.coalesce(F.get("candidates", 0).getField("field"), F.lit(UNKNOWN)), "field_score": F.coalesce(F.get("candidates", 0).getField("score"), F.lit(0.0)),
    })


def nearby(detections: DataFrame, longer_side: Column) -> DataFrame:
    """image_id, det_idx, other_idx, distance: pairs of an image whose centers are at most 0.12 of the longer side apart, both ways round.

    detections: image_id, det_idx, box. Images are cut into cells as wide as that distance and only neighbouring cells are joined, so that a crowded image gives few pairs.
    """
    radius = longer_side * geometry.NEARBY
    held = detections.where(F.col("box").isNotNull()).select("image_id", "det_idx", geometry.center(F.col("box")).alias("c"), radius.alias("r"))
    cell = lambda axis: F.floor(F.col("c")[axis] / F.col("r"))
    held = held.withColumns({"cx": cell("x"), "cy": cell("y")})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    probe = held.withColumn("s", F.explode(steps)).select("image_id", "det_idx", "c", "r", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    other = held.select("image_id", F.col("det_idx").alias("other_idx"), F.col("c").alias("oc"), "cx", "cy")
    met = probe.join(other, ["image_id", "cx", "cy"]).where("det_idx != other_idx").withColumn("distance", geometry.distance(F.col("c"), F.col("oc")))
    return met.where("distance <= r").select("image_id", "det_idx", "other_idx", "distance")


def value_candidates(detections: DataFrame, longer_side: float, places: DataFrame | None = None) -> DataFrame:
    """image_id, det_idx, text, field, score, format_score, relationship_score: detections that may be a field's value, from scored detections with boxes.

    A neighbour speaks for a field by being near, and more if it reads like the field's heading; the best neighbour counts. Pairs are found once for all fields.
    places: the detections (image_id, det_idx, box) before they were scored, so that pairs are found without scoring; more rows than in `detections` don't matter.
    """
    # Both joins read the same columns of one shuffle, so scores are evaluated once.
    detections = detections.select("image_id", "det_idx", "text", "scores", *([] if places is not None else ["box"])).repartition("image_id", "det_idx")
    direct = F.when(F.col("text").isNotNull(), F.transform("scores", lambda s: F.greatest(s.keyword, s.pattern)))
    heading = detections.select("image_id", F.col("det_idx").alias("other_idx"), direct.alias("heading"))
    near = nearby(detections if places is None else places, F.lit(float(longer_side))).join(heading, ["image_id", "other_idx"])
    share = 0.60 * (1 - F.col("distance") / (longer_side * geometry.RELATED))
    best = near.groupBy("image_id", "det_idx").agg(*[F.max(share + 0.40 * F.get("heading", F.lit(i))).alias(f"r{i}") for i in range(len(FIELDS))])
    held = detections.select("image_id", "det_idx", "text", "scores").join(best, ["image_id", "det_idx"], "left")
    rows = held.select("image_id", "det_idx", "text", F.posexplode(F.array(*[F.coalesce(f"r{i}", F.lit(0.0)) for i in range(len(FIELDS))])).alias("i", "relationship"), "scores")
    s = F.get("scores", F.col("i"))
    raw = s["format"] * 0.40 + F.greatest(s["keyword"], s["pattern"]) * 0.20 + F.col("relationship") * 0.40
    out = rows.withColumns({"raw": raw, "format_score": steady(s["format"], 4)}).where(F.round("raw", 8) >= LEAST_VALUE)
    return out.select(
        "image_id", "det_idx", "text", F.get(F.array(*map(F.lit, FIELDS)), F.col("i")).alias("field"), steady(F.least("raw", F.lit(1.0)), 4).alias("score"), "format_score", steady(F.col("relationship"), 4).alias("relationship_score"),
    )


def _of_texts(texts: DataFrame, fuzzy: bool, ascii_only: bool) -> DataFrame:
    """raw, text (its normal form), name_score, and what a text says about fields: own (format and heading in the weights of a value, for each field), headings and direct (place and score, only fields that have one)."""
    priors = F.array(*[F.lit(PRIORS[f]) for f in FIELDS])

    def one(s: Column, i: Column) -> Column:
        raw = s.keyword * 0.50 + s.pattern * 0.20 + s.format * 0.20 + F.get(priors, i) * 0.10
        score = F.when(F.round(raw, 8) >= LEAST_DIRECT, steady(F.least(raw, F.lit(1.0)), 4))
        return F.struct(i.alias("place"), score.alias("score"))

    heading = lambda s: F.greatest(s.keyword, s.pattern)
    headings = F.transform("scores", lambda s, i: F.struct(i.alias("place"), heading(s).alias("score")))
    return scored(texts.withColumn("raw", F.col("text")), fuzzy, ascii_only).select(
        "raw", "text", "name_score", F.transform("scores", lambda s: s.format * 0.40 + heading(s) * 0.20).alias("own"),
        F.filter(headings, lambda h: h.score > 0).alias("headings"), F.filter(F.transform("scores", one), lambda c: c.score.isNotNull()).alias("direct"),
    )


def field_map(detections: DataFrame, longer_side: float, fuzzy: bool = True, ascii_only: bool = False) -> DataFrame:
    """image_id, field, rank, kind, det_idx, text, score: all candidates of each field, best first; of equals headings, then values, then names, each in the order of detections.

    detections: image_id, det_idx (once in an image), text, box; fuzzy and ascii_only as in scored. Candidates are those of direct_candidates and value_candidates, and names. Each different text is scored once. Then all
    rows of an image are in one partition; neighbours come from a window over bands as high as the distance that counts, so pairs aren't shuffled.
    """
    radius = F.lit(float(longer_side)) * geometry.NEARBY
    place = F.when(F.col("image_id").isNotNull() & F.col("box").isNotNull(), geometry.center(F.col("box")))
    # texts are few bytes with much work, so they are dealt out again: else they would be put together in a task or two
    texts = detections.select("text").distinct().repartition(int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = detections.select("image_id", "det_idx", F.col("text").alias("raw"), place.alias("c")).join(_of_texts(texts, fuzzy, ascii_only), "raw").drop("raw")
    rows = rows.repartition("image_id").withColumn("band", F.floor(F.col("c.y") / radius))
    around = Window.partitionBy("image_id").orderBy("band").rangeBetween(-1, 1)
    rows = rows.withColumn("near", F.collect_list(F.struct("det_idx", "c", "headings")).over(around))

    measured = F.transform("near", lambda n: F.struct(n.det_idx.alias("det_idx"), geometry.distance(F.col("c"), n.c).alias("distance"), n.headings.alias("headings")))
    others = F.filter(measured, lambda n: (n.det_idx != F.col("det_idx")) & (n.distance <= radius))
    share = lambda n: 0.60 * (1 - n.distance / (longer_side * geometry.RELATED))
    rows = rows.withColumn("near", F.transform(others, lambda n: F.struct(share(n).alias("share"), n.headings.alias("headings"))))
    told = F.flatten(F.transform("near", lambda n: F.transform(n.headings, lambda h: F.struct(h.place.alias("place"), (n.share + 0.40 * h.score).alias("score")))))
    rows = rows.select("image_id", "det_idx", "text", "name_score", "own", "direct", F.array_max(F.transform("near", lambda n: n.share)).alias("nearest"), told.alias("told"))

    nearest = F.coalesce("nearest", F.lit(0.0))
    value = lambda own, i, related: F.struct(i.alias("place"), F.lit(1).alias("k"), (own + related * 0.40).alias("score"))
    best = lambda i: F.array_max(F.transform(F.filter("told", lambda h: h.place == i), lambda h: h.score))
    plain = F.transform("own", lambda own, i: value(own, i, nearest))
    values = F.when(F.size("told") == 0, plain).otherwise(F.transform("own", lambda own, i: value(own, i, F.greatest(nearest, best(i)))))
    direct = F.transform("direct", lambda c: F.struct(c.place.alias("place"), F.lit(0).alias("k"), c.score.alias("score")))
    name = F.array(F.struct(F.lit(FIELDS.index("product_name")).alias("place"), F.lit(2).alias("k"), F.col("name_score").alias("score")))
    every = rows.select("image_id", "det_idx", "text", F.explode(F.concat(direct, values, name)).alias("c")).select("image_id", "det_idx", "text", "c.*")
    enough = (F.col("score") > LEAST_VALUE + 1e-6) | (F.col("score") > LEAST_VALUE - 1e-6) & (F.round("score", 8) >= LEAST_VALUE)
    every = every.where(F.when(F.col("k") == 1, enough).otherwise(F.col("score") > 0))
    bounded = F.least("score", F.lit(1.0))
    every = every.withColumn("score", F.when(F.col("k") == 1, quickly(bounded, 4, steady(bounded, 4))).otherwise(F.col("score")))
    order = Window.partitionBy("image_id", "place").orderBy(F.desc("score"), "k", "det_idx")
    named = lambda names, i: F.get(F.array(*map(F.lit, names)), F.col(i))
    ranked = every.withColumn("rank", F.row_number().over(order))
    return ranked.select("image_id", named(FIELDS, "place").alias("field"), "rank", named(("heading_or_direct", "value", "product_name"), "k").alias("kind"), "det_idx", "text", "score")


# The same in SQL, without fuzzy keywords.


def scored_sql(detections: str) -> str:
    """detections with text in normal form, and kw_i, re_i, fm_i for each field."""
    columns = []
    for i, field in enumerate(FIELDS):
        own = keys(field)
        inside = " OR ".join(f"contains(found, {quoted(k)})" for k in own)
        columns.append(f"CASE WHEN found IN ({', '.join(map(quoted, own))}) THEN 1.0::DOUBLE WHEN {inside} THEN {INSIDE}::DOUBLE ELSE 0::DOUBLE END AS kw_{i}" if own else f"0::DOUBLE AS kw_{i}")
        columns.append(f"CASE WHEN {matches_sql('found', '|'.join(PATTERNS[field]))} THEN 1::DOUBLE ELSE 0::DOUBLE END AS re_{i}" if field in PATTERNS else f"0::DOUBLE AS re_{i}")
        whens = " ".join(f"WHEN {matches_sql('text', p, c)} THEN {w}::DOUBLE" for p, w, c in FORMATS.get(field, []))
        columns.append(f"CASE {whens} ELSE 0::DOUBLE END AS fm_{i}" if whens else f"0::DOUBLE AS fm_{i}")
    normal_text = replaced_sql("coalesce(text, '')", NORMAL_FORM)
    letters, digits = "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))", "length(regexp_replace(text, '[^0-9]', '', 'g'))"
    ignored = " OR ".join(f"contains(found, {quoted(w)})" for w in NOT_A_NAME)
    some = lambda test, worth: f"CASE WHEN {test} THEN {worth}::DOUBLE ELSE 0 END"
    tests = [("length(text) BETWEEN 4 AND 80", 0.20), (f"{letters} >= {digits}", 0.20), ("len(string_split_regex(text, '[ ]+')) >= 2", 0.15), ("upper(text) = text AND lower(text) <> text", 0.10)]
    score = steady_sql(f"least(1, 0.30::DOUBLE + {' + '.join(some(*t) for t in tests)})", 4)
    only_numbers = matches_sql("text", r"^[0-9\s.,:/()\-]+$")
    columns.append(f"CASE WHEN length(text) < 3 OR {ignored} OR {only_numbers} OR {letters} = 0 THEN 0 ELSE {score} END AS name_score")
    return f"SELECT *, {', '.join(columns)} FROM (SELECT * REPLACE ({normal_text} AS text), trim(lower({normal_text})) AS found FROM ({detections})) WHERE text <> ''"


def direct_sql(scored_rows: str, *keys_: str) -> str:
    """One row for each candidate."""
    per_field = " UNION ALL ".join(
        f"SELECT {', '.join(keys_)}, {i} AS place, '{f}' AS field, kw_{i} * 0.5::DOUBLE + re_{i} * 0.2::DOUBLE + fm_{i} * 0.2::DOUBLE + {PRIORS[f]}::DOUBLE * 0.1::DOUBLE AS raw FROM s" for i, f in enumerate(FIELDS)
    )
    names = ", ".join(keys_)
    return f"""
    WITH s AS ({scored_rows})
    SELECT {names}, field, {steady_sql('least(raw, 1)', 4)} AS score, row_number() OVER (PARTITION BY {names} ORDER BY {steady_sql('least(raw, 1)', 4)} DESC, place)::INTEGER AS rank
    FROM ({per_field}) WHERE round(raw, 8) >= {LEAST_DIRECT}::DOUBLE"""


def nearby_sql(detections: str, longer_side: int) -> str:
    return f"""
    SELECT a.image_id, a.det_idx, b.det_idx AS other_idx, sqrt(pow(a.x + a.w / 2 - b.x - b.w / 2, 2) + pow(a.y + a.h / 2 - b.y - b.h / 2, 2)) AS distance
    FROM ({detections}) a JOIN ({detections}) b ON a.image_id = b.image_id AND a.det_idx <> b.det_idx
    WHERE sqrt(pow(a.x + a.w / 2 - b.x - b.w / 2, 2) + pow(a.y + a.h / 2 - b.y - b.h / 2, 2)) <= {longer_side * geometry.NEARBY}::DOUBLE"""


def values_sql(detections: str, longer_side: int) -> str:
    parts = " UNION ALL ".join(
        f"SELECT s.image_id, s.det_idx, s.text, '{f}' AS field, s.fm_{i} AS format, greatest(s.kw_{i}, s.re_{i}) AS direct, coalesce(r.r_{i}, 0) AS relationship FROM s LEFT JOIN r ON s.image_id = r.image_id AND s.det_idx = r.det_idx"
        for i, f in enumerate(FIELDS)
    )
    best = ", ".join(f"max(0.6::DOUBLE * (1 - distance / {longer_side * geometry.RELATED}::DOUBLE) + 0.4::DOUBLE * greatest(h.kw_{i}, h.re_{i})) AS r_{i}" for i in range(len(FIELDS)))
    return f"""
    WITH s AS MATERIALIZED ({scored_sql(detections)}), n AS ({nearby_sql(detections, longer_side)}),
    r AS (SELECT n.image_id, n.det_idx, {best} FROM n JOIN s h ON h.image_id = n.image_id AND h.det_idx = n.other_idx GROUP BY 1, 2)
    SELECT image_id, det_idx, text, field, {steady_sql('least(raw, 1)', 4)} AS score, format AS format_score, {steady_sql('relationship', 4)} AS relationship_score
    FROM (SELECT *, format * 0.4::DOUBLE + direct * 0.2::DOUBLE + relationship * 0.4::DOUBLE AS raw FROM ({parts})) WHERE round(raw, 8) >= {LEAST_VALUE}::DOUBLE"""


def map_sql(detections: str, longer_side: int) -> str:
    rows = scored_sql(detections)
    direct = f"SELECT image_id, det_idx, text, field, score, 'heading_or_direct' AS kind, 0 AS k FROM ({direct_sql(rows, 'image_id', 'det_idx')}) JOIN ({rows}) USING (image_id, det_idx)"
    value = f"SELECT image_id, det_idx, text, field, score, 'value' AS kind, 1 AS k FROM ({values_sql(detections, longer_side)})"
    name = f"SELECT image_id, det_idx, text, 'product_name' AS field, name_score AS score, 'product_name' AS kind, 2 AS k FROM ({rows}) WHERE name_score > 0"
    return f"""
    SELECT image_id, field, row_number() OVER (PARTITION BY image_id, field ORDER BY score DESC, k, det_idx)::INTEGER AS rank, kind, det_idx, text, score
    FROM ({direct} UNION ALL {value} UNION ALL {name})"""

"""The table of declaration rules, and a reader for rules in JSON."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "struct<field:string,name:string,applicability:string,severity:string,rule_reference:string,required:boolean,verification_method:string,detection_patterns:array<string>,failure_message:string>"
TABLE_SCHEMA = "rule_pos int, rule_id string, field string, name string, applicability string, severity string, rule_reference string, required boolean, verification_method string, detection_patterns array<string>, failure_message string"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    applicability: str
    severity: str
    rule_reference: str
    failure_message: str | None
    detection_patterns: tuple[str, ...] = ()
    required: bool = True
    verification_method: str | None = None
    field: str = field(default="")

    @property
    def key(self) -> str:
        return self.field or self.rule_id


# The declarations a package needs, in the order of evaluation.
RULES = [
    Rule("product_name", "Common / Generic Name", "retail_package", "HIGH", "Rule 6", "Common or generic name of the commodity was not detected.", ("product", "product name", "generic name", "common name", "commodity", "item")),
    Rule(
        "manufacturer_packer_importer", "Manufacturer / Packer / Importer", "as_applicable", "HIGH", "Rule 6", "Applicable manufacturer, packer or importer information was not detected.",
        ("manufactured by", "manufactured & marketed by", "manufactured and marketed by", "mfd by", "mfg by", "manufactured for", "packed by", "packed & marketed by", "packed and marketed by", "imported by", "importer", "marketed by"),
    ),
    Rule("manufacturer_address", "Manufacturer / Packer / Importer Address", "as_applicable", "HIGH", "Rule 6", "Required address information was not detected."),
    Rule("country_of_origin", "Country of Origin", "imported_package", "HIGH", "Rule 6", "Country of origin was not detected for an imported product.", ("country of origin", "made in", "product of", "origin")),
    Rule("net_quantity", "Net Quantity", "retail_package", "CRITICAL", "Rule 6 / Rule 13", "Net quantity was not detected.", ("net quantity", "net qty", "net weight", "net wt", "net volume", "net vol", "quantity", "contents")),
    Rule("quantity_unit", "Standard Unit", "when_quantity_is_declared", "HIGH", "Rule 13", "Quantity unit is missing or could not be validated."),
    Rule("manufacture_date", "Month and Year of Manufacture", "retail_package", "HIGH", "Rule 6", "Month and year of manufacture were not detected.", ("mfd", "mfg", "manufactured", "date of manufacture", "manufacturing date", "month and year", "m", "dom")),
    Rule("packing_date", "Packing / Pre-packing Information", "as_applicable", "MEDIUM", "Rule 6", "Packing information could not be detected where applicable.", ("pkd", "packed on", "packing date", "packed"), required=False),
    Rule(
        "best_before_use_by", "Best Before / Use By", "commodities_that_may_become_unfit_for_human_consumption", "CRITICAL", "Rule 6", "Best-before or use-by information was not detected where applicable.",
        ("best before", "best before end", "use by", "expiry", "exp", "date of expiry"),
    ),
    Rule("mrp", "Maximum Retail Price", "retail_package", "CRITICAL", "Rule 6", "Maximum Retail Price was not detected.", ("mrp", "maximum retail price", "retail price", "rs", "₹")),
    Rule("mrp_inclusive_of_taxes", "MRP Tax Inclusion", "retail_package", "HIGH", "Rule 6", "Required MRP tax-inclusive wording was not detected.", ("inclusive of all taxes", "incl of all taxes", "inclusive taxes", "all taxes"), field="mrp_tax_statement"),
    Rule("consumer_care", "Consumer Care Details", "retail_package", "HIGH", "Rule 6", "Consumer care details were not detected.", ("consumer care", "consumer complaint", "customer care", "customer service", "toll free", "helpline", "contact us", "email")),
    Rule("dimensions", "Dimensions", "where_size_or_dimensions_are_relevant", "MEDIUM", "Rule 6", "Required dimensions were not detected.", ("size", "dimensions", "length", "width", "height", "diameter")),
    Rule("unit_sale_price", "Unit Sale Price", "pre_packaged_commodity", "HIGH", "Rule 6(11)", "Unit sale price was not detected."),
    Rule("number_of_items", "Number / Unit / Piece / Pair / Set", "items_sold_by_number", "HIGH", "Rule 13", "Required number or unit declaration was not detected.", ("number", "no.", "pcs", "pieces", "piece", "pair", "set", "units")),
    Rule("promotional_group", "Promotional Retail Group", "promotional_offer_group", "HIGH", "Rule 4(2)", "One or more packages in the promotional group may not contain required Rule 6 declarations."),
    Rule("declaration_legibility", "Declaration Legibility", "retail_package", "MEDIUM", "Rule 8 / Rule 9", "One or more declarations may not be sufficiently legible."),
    Rule("declaration_language", "Declaration Language", "retail_package", "MEDIUM", "Rule 10", "Required declaration language could not be verified."),
    Rule("wholesale_package", "Wholesale Package Declarations", "wholesale_package", "HIGH", "Rule 24", "Required wholesale package declarations were not detected.", field="wholesale_declarations"),
    Rule("registration", "Manufacturer / Packer / Importer Registration", "registered_entity", "CRITICAL", "Rule 27", "Registration status requires external verification.", verification_method="external_database_or_document"),
    Rule("quantity_accuracy", "Quantity Accuracy / Maximum Permissible Error", "physical_quantity_verification", "CRITICAL", "First Schedule / applicable quantity provisions", "Physical measurement is required to verify quantity accuracy.", verification_method="physical_measurement"),
]


def rule_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    rows = [(i, r.rule_id, r.key, r.name, r.applicability, r.severity, r.rule_reference, r.required, r.verification_method, list(r.detection_patterns), r.failure_message) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, TABLE_SCHEMA)


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules from a JSON file with an object `rules` by rule id, in the file's order. A missing file raises, and so does one without that object."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.rules"), f"map<string,{RULE_SCHEMA}>")).alias("rule_pos", "rule_id", "r"))
    rows = parsed.select("rule_pos", "rule_id", "r.*").orderBy("rule_pos").collect()
    if not rows:
        raise ValueError(f"no rules in {path}")
    return [
        Rule(r.rule_id, r.name or r.rule_id, r.applicability or "", r.severity or "MEDIUM", r.rule_reference or "", r.failure_message, tuple(r.detection_patterns or ()), bool(r.required), r.verification_method, r.field or "")
        for r in rows
    ]

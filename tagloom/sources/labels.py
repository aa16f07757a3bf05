"""Label texts, detections and rule inputs derived from the part, supplier and nation tables, as one query in two dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STYLES = """
CASE p.p_partkey % 8
 WHEN 0 THEN concat(p_name, nl, 'MRP: Rs. ', price, nl, 'Inclusive of all taxes', nl, 'Net Weight: ', q, ' g', nl, 'Manufactured By: ', s_name, ' Foods', nl, 'Address: ', addr, nl, 'Customer Care: 98765', lpad(CAST(k AS {text}), 5, '0'))
 WHEN 1 THEN concat('Nutrition Facts', nl, p_name, nl, 'M.R.P.', nl, '(', price, '/-)', nl, 'Net Wt.', nl, q, 'GM', nl, 'Packed & Marketed By:', nl, s_name, ' Private Limited', nl, 'Address:', nl, addr)
 WHEN 2 THEN concat(p_name, nl, 'MRP ', price, nl, 'Net Qty ', q, ' ml', nl, 'Mfd. By ', s_name, nl, addr)
 WHEN 3 THEN concat(p_name, nl, 'M.R.P.', price, nl, 'Net Wt.', q, 'GMS', nl, 'Mfg By: ', s_name, nl, 'MFG 08/2026', nl, 'Best Before 6 months')
 WHEN 4 THEN concat(p_name, nl, 'MRP: 1999', nl, 'Rs ', price, nl, 'Net Weight: ', q, nl, 'EXP 12/03/2027')
 WHEN 5 THEN concat(p_name, nl, 'Maximum Retail Price: INR ', price, nl, q, ' kgs', nl, 'Marketed By', nl, 'Customer Care 9876543210', nl, addr, nl, 'email: care@example.com')
 WHEN 6 THEN concat(p_name, nl, 'MRP: ', price, nl, 'Net Quantity: ', q, ' Ltr', nl, 'Manufacturer: ', s_name, nl, 'Country of Origin: ', n_name, nl, 'Batch No: NTZ26092', nl, 'FSSAI Lic No. 12345678901234')
 ELSE concat('12.50', nl, upper(p_name), nl, 'Ingredients', nl, p_type, ' ', p_brand)
END
"""

_LABELS = """
SELECT p.p_partkey AS label_id, p.p_type AS segment, {styles} AS text
FROM (SELECT p0.*, chr(10) AS nl, {money} AS price, CAST(p_size * 10 AS {text}) AS q, p_partkey % makers AS maker FROM {{part}} p0 CROSS JOIN (SELECT count(*) AS makers FROM {{supplier}}) c) p
JOIN (
  SELECT s_suppkey AS k, s_name, n_name,
    concat('Plot ', CAST(s_suppkey AS {text}), ', Phase-1, ', n_name, ' - ', CAST(110000 + s_suppkey AS {text})) AS addr
  FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
) m ON m.k = p.maker
"""

SPARK_LABELS = _LABELS.format(styles=_STYLES.format(text="string"), text="string", money="format_string('%.2f', p_retailprice)")
ORACLE_LABELS = _LABELS.format(styles=_STYLES.format(text="VARCHAR"), text="VARCHAR", money="printf('%.2f', p_retailprice)").format(part="part", supplier="supplier", nation="nation")

#: Rule inputs besides product_name.
RULE_FIELDS = [
    "manufacturer_packer_importer", "manufacturer_address", "country_of_origin", "net_quantity", "quantity_unit", "manufacture_date", "best_before_use_by", "mrp", "mrp_tax_statement",
    "consumer_care", "dimensions", "unit_sale_price", "number_of_items", "promotional_group", "declaration_legibility", "declaration_language", "wholesale_declarations",
]

_RULE_INPUT = (
    "SELECT label_id, segment, text, 'x' AS product_name, CASE WHEN label_id % 5 = 0 THEN 'wholesale' ELSE 'retail' END AS package_type, label_id % 3 = 0 AS imported, "
    + ", ".join(f"CASE WHEN label_id % 4 < 2 THEN 'x' END AS {c}" for c in RULE_FIELDS)
    + " FROM {labels}"
)
ORACLE_RULE_INPUT = _RULE_INPUT.format(labels=f"({ORACLE_LABELS})")

#: One row for each line of a label; copies shifted a little with one letter lost stand for second readings.
_DETECTIONS = """
SELECT label_id AS image_id, i AS det_idx, text, CAST((label_id * 37 + i * 11) % 100 AS DOUBLE) / 100 AS confidence,
  CAST(40 + 420 * (i % 2) AS DOUBLE) AS x, CAST(30 + 60 * CAST(floor(i / 2) AS BIGINT) + label_id % 7 AS DOUBLE) AS y, CAST(12 * length(text) AS DOUBLE) AS w, CAST(24 AS DOUBLE) AS h, 'full' AS source
FROM ({lines})
UNION ALL
SELECT label_id, i + 1000, concat(substr(text, 1, length(text) - 1), '#'), CAST((label_id * 37 + i * 11 + 50) % 100 AS DOUBLE) / 100,
  CAST(43 + 420 * (i % 2) AS DOUBLE), CAST(32 + 60 * CAST(floor(i / 2) AS BIGINT) + label_id % 7 AS DOUBLE), CAST(12 * length(text) AS DOUBLE), CAST(24 AS DOUBLE), 'tile_0_0'
FROM ({lines}) WHERE label_id % 3 = 0
"""
SPARK_DETECTIONS = _DETECTIONS.format(lines="SELECT label_id, posexplode(split(text, chr(10))) AS (i, text) FROM {labels}")
ORACLE_DETECTIONS = _DETECTIONS.format(lines=f"SELECT label_id, i, t[i + 1] AS text FROM (SELECT label_id, string_split(text, chr(10)) AS t FROM ({ORACLE_LABELS})), unnest(range(len(t))) AS u(i)")
IMAGE_WIDTH, IMAGE_HEIGHT = 1000, 1400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label_id, segment, text."""
    return spark.sql(SPARK_LABELS, part=table(spark, sf_dir, "part"), supplier=table(spark, sf_dir, "supplier"), nation=table(spark, sf_dir, "nation"))


def rule_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with the fields that rules look at."""
    return spark.sql(_RULE_INPUT, labels=labels(spark, sf_dir))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, det_idx, text, confidence, x, y, w, h (of an upright box) and source."""
    return spark.sql(SPARK_DETECTIONS, labels=labels(spark, sf_dir))

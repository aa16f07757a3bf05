"""A Merkle manifest of a dataset: a digest for each row, for each source and for the table, and each row's proof.

Levels are made by windows. A window over a parent's children, in order and over the full frame, collects their digests: put together they
are the parent's preimage, and without a child's own they are its siblings. Of each window one row is kept as the parent, which goes
to the next level. Levels shrink by `FAN`. Proofs then go down from the root, a level at a time, so that no join has a key with more than `FAN` rows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.common import checkpointed, documents
from tagloom.llm.places import numbered

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"


def preimage(fields: dict[str, Column]) -> Column:
    """Each value with its length in bytes before it, a null as a dash; so no two rows of different values have one preimage."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.concat(*parts)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and tampered: the leaf once the text's line feeds are gone, null for rows that aren't tampered with or whose leaf stays."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("long" if c == "n_chars" else "string").alias(c) for c in FIELDS[1:]])
    own = {c: F.col(c) for c in FIELDS}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    return held.select(
        "doc_id", "source", digest(preimage(own)).alias("leaf"),
        F.when(hit, digest(preimage(own | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}))).alias("tampered"),
    )


def _level(nodes: DataFrame, group: str) -> DataFrame:
    """nodes (group, idx, count, digest) with left and right, their siblings' digests put together, and with their parent's digest in above."""
    run = F.floor(F.col("idx") / FAN)
    family = Window.partitionBy(group, run).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = (F.col("idx") % FAN).cast("int")
    met = nodes.withColumn("family", F.collect_list("digest").over(family))
    left = F.array_join(F.slice("family", F.lit(1), place), "")
    right = F.array_join(F.slice("family", place + 2, F.lit(FAN)), "")
    return met.select(group, "idx", "count", "digest", left.alias("left"), right.alias("right"), digest(F.array_join("family", "")).alias("above"))


def levels(leaves: DataFrame, group: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels from the leaves up (see _level; each is written), and (group, top): each group's last digest.

    leaves: group, idx from 0 in each group, count and digest. A group ends where one node is left; a lone leaf is its own top.
    """
    most = leaves.agg(F.max("count")).first()[0] or 0
    found, tops, nodes = [], leaves.where("count = 1").select(group, F.col("digest").alias("top")), leaves.where("count > 1")
    while most > 1:
        level = checkpointed(_level(nodes, group))
        found.append(level)
        up = level.where(F.col("idx") % FAN == 0).select(group, F.floor(F.col("idx") / FAN).alias("idx"), F.ceil(F.col("count") / FAN).alias("count"), F.col("above").alias("digest"))
        tops = tops.unionByName(up.where("count = 1").select(group, F.col("digest").alias("top")))
        nodes, most = up.where("count > 1"), -(-most // FAN)
    return found, tops


def proofs(found: list[DataFrame], group: str, above: DataFrame, carried: list[str]) -> DataFrame:
    """(group, idx, steps, carried...) for each leaf of groups with several: steps are (left, right) from the leaf's level up, then those of `above`.

    above: (group, steps, carried...), one row for each group: what comes beyond its top.
    """
    steps = F.concat(F.array(F.struct("left", "right")), "steps").alias("steps")
    known = None
    for level in reversed(found):
        here = level.select(F.col(group).alias("own"), F.col("idx").alias("at"), "count", "left", "right")
        shown = lambda met: met.select(F.col("own").alias(group), F.col("at").alias("idx"), steps, *carried)
        made = shown(here.where(F.col("count") <= FAN).join(above, F.col("own").eqNullSafe(F.col(group))))  # their parent is the group's top
        if known is not None:
            rest = here.where(F.col("count") > FAN).join(known, F.col("own").eqNullSafe(F.col(group)) & (F.floor(F.col("at") / FAN) == F.col("idx")))
            made = made.unionByName(shown(rest))
        known = made
    return known


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf's digest gives with its siblings."""
    return F.aggregate(steps, start, lambda held, step: digest(F.concat(step.left, held, step.right)))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root and verified for each row of docs (doc_id, source, lang, n_chars, text).

    Nulls are values of their own: a null source is the first source, a null doc_id comes first in its source and isn't tampered with (it has no decimal digits to check). Rows with an equal doc_id
    are ordered by leaf; equal rows are leaves of their own. Empty and very long texts are hashed whole. Other columns are ignored; an empty table gives no row.
    """
    placed = checkpointed(numbered(checkpointed(leaves(docs)), "source", ["doc_id", "leaf"]))
    trees, subroots = levels(placed.select("source", "idx", "count", F.col("leaf").alias("digest")), "source")
    subroots = checkpointed(subroots.withColumnRenamed("top", "subroot"))
    ordered = checkpointed(numbered(subroots.withColumn("all", F.lit(0)), "all", ["source"]))
    top, roots = levels(ordered.select("all", "idx", "count", F.col("subroot").alias("digest")), "all")
    # one row for each source from here on
    last = roots.select("all", F.array().cast(_STEPS).alias("steps"), F.col("top").alias("root"))
    beyond = proofs(top, "all", last, ["root"]) if top else last.withColumn("idx", F.lit(0))
    by_source = checkpointed(ordered.join(beyond.drop("all"), "idx").select("source", "subroot", "steps", "root"))
    siblings = F.array_join(F.flatten(F.transform("steps", lambda s: F.array(s.left, s.right))), "")
    shown = lambda rows: rows.select(
        "doc_id", "source", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
    single = by_source.withColumnRenamed("source", "of")
    alone = placed.where("count = 1")
    alone = shown(alone.join(single, F.col("source").eqNullSafe(F.col("of"))))
    if not trees:
        return alone
    many = proofs(trees, "source", by_source, ["subroot", "root"]).withColumnsRenamed({"source": "of", "idx": "at"})
    several = placed.where("count > 1").join(many, F.col("source").eqNullSafe(F.col("of")) & (F.col("idx") == F.col("at")))
    return shown(several).unionByName(alone)


def tampered_with(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 2 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir)).drop("source")


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_concat([ascii(c)::BIGINT], [0::BIGINT, 0, 0, 0, 0, 0, 0])))"
    step = "lambda a, v: xor(xor(a, v) >> 1, CASE WHEN xor(a, v) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce({bits}, {step}, 4294967295::BIGINT), 4294967295)"


def _preimage_sql(text: str) -> str:
    fields = [("doc_id", "doc_id"), ("source", "source"), ("lang", "lang"), ("n_chars", "n_chars"), ("text", text)]
    return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v}::VARCHAR END" for c, v in fields)


ORACLE = f"""
WITH RECURSIVE own AS MATERIALIZED (
  SELECT doc_id, source, sha256({_preimage_sql('text')}) AS leaf,
    sha256({_preimage_sql("CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END")}) AS given
  FROM (SELECT *, doc_id IS NOT NULL AND {crc32_sql("coalesce(doc_id, 0)::VARCHAR")} % 2 = 0 AS hit FROM documents)
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM own
), tree(source, k, idx, n, digest) AS (
  SELECT source, 0, idx, n, leaf FROM placed
  UNION ALL
  SELECT source, k + 1, idx // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY source, k, idx // {FAN}, n
), subroots AS MATERIALIZED (
  SELECT source, k AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1
), top(k, idx, n, digest) AS (
  SELECT 0, place, n, subroot FROM subroots
  UNION ALL
  SELECT k + 1, idx // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY k, idx // {FAN}, n
), low AS MATERIALIZED (
  SELECT source, k, idx, n, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY source, k, idx // {FAN} ORDER BY idx)
), high AS MATERIALIZED (
  SELECT k, idx, n, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM top WHERE n > 1 WINDOW w AS (PARTITION BY k, idx // {FAN} ORDER BY idx)
), fold(doc_id, source, leaf, subroot, place, height, part, k, idx, proof, held) AS (
  SELECT p.doc_id, p.source, p.leaf, s.subroot, s.place, s.height, CASE WHEN s.height = 0 THEN 1 ELSE 0 END, 0, CASE WHEN s.height = 0 THEN s.place ELSE p.idx END, '', p.given
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
  UNION ALL
  SELECT * FROM (
    SELECT f.doc_id, f.source, f.leaf, f.subroot, f.place, f.height, CASE WHEN f.k + 1 = f.height THEN 1 ELSE 0 END, CASE WHEN f.k + 1 = f.height THEN 0 ELSE f.k + 1 END, CASE WHEN f.k + 1 = f.height THEN f.place ELSE f.idx // {FAN} END, f.proof || l.l || l.r, sha256(l.l || f.held || l.r)
    FROM fold f JOIN low l ON l.source IS NOT DISTINCT FROM f.source AND l.k = f.k AND l.idx = f.idx WHERE f.part = 0
    UNION ALL
    SELECT f.doc_id, f.source, f.leaf, f.subroot, f.place, f.height, 1, f.k + 1, f.idx // {FAN}, f.proof || h.l || h.r, sha256(h.l || f.held || h.r)
    FROM fold f JOIN high h ON h.k = f.k AND h.idx = f.idx WHERE f.part = 1
  )
), root AS (SELECT k, digest AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, held AS folded_root, held = root AS verified FROM fold JOIN root ON part = 1 AND fold.k = root.k
"""

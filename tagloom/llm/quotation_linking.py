"""Chat formatting: quotation linking, with DataFrame functions only.

Messages may quote earlier ones with lines that begin with ">" marks, one for each level. Quoted passages are normalised and hashed, and
looked up among the passages of earlier messages of the conversation; the message that most of a reply's outermost quotes come from is the one it replies
to. A message that quotes nothing known replies to the one before it. Conversations are then ordered by replies, without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.common import NULL_ID, checkpointed

LINE_BREAK = r"\r\n|\r|\n"
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: A line that announces a quote goes with it.
ANNOUNCEMENT = r"(?i)^.*\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def _normal(text: Column) -> Column:
    """Letters and digits in lower case, with one blank for what is between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, pos (place in the conversation from 1), own (text without quotes), levels (deepest quote), lines and runs (depth, body).

    A null text is empty. Messages are ordered by turn (null first), then role and text; equal messages keep places of their own.
    """
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    m = messages.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    m = m.withColumn("pos", F.row_number().over(order))
    lines = F.transform(
        F.split("text", LINE_BREAK),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("depth"), F.regexp_replace(x, MARKS, "").alias("body")),
    )
    m = m.withColumn("lines", lines)
    announces = lambda x, i: (x.depth == 0) & x.body.rlike(ANNOUNCEMENT) & (F.coalesce(F.get("lines", i + 1).depth, F.lit(0)) > 0)
    own = F.filter("lines", lambda x, i: (x.depth == 0) & ~announces(x, i))
    # neighbouring lines of one depth make a run
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get("lines", i - 1).depth != F.get("lines", i).depth))
    m = m.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(1))), F.array(F.size("lines")))
    runs = F.zip_with(
        "starts", ends,
        lambda a, b: F.struct(F.get("lines", a).depth.alias("depth"), F.array_join(F.transform(F.slice("lines", a + 1, b - a), lambda x: x.body), " ").alias("body")),
    )
    return m.select(
        "conv", "conv_id", "turn", "role", "pos", "lines",
        F.regexp_replace(F.array_join(F.transform(own, lambda x: x.body), "\n"), r"^\s+|\s+$", "").alias("own"),
        F.array_max(F.transform("lines", lambda x: x.depth)).alias("levels"),
        F.when(F.exists("lines", lambda x: x.depth > 0), runs).alias("runs"),
    )


def links(messages: DataFrame) -> DataFrame:
    """conv, pos, depth, source_pos: for each quoting message and level the earlier message that most of its quoted text comes from; of equals the latest.

    A passage is a line, a run of lines of one depth, or a message's whole own text; it counts with its length, and it comes from the latest earlier message that has it.
    """
    quoting = messages.where("levels > 0")
    body = lambda x: F.struct(x.depth.alias("depth"), _normal(x.body).alias("passage"))
    quoted = quoting.select("conv", "pos", F.explode(F.array_distinct(F.concat(F.transform(F.filter("lines", lambda x: x.depth > 0), body), F.transform(F.filter("runs", lambda x: x.depth > 0), body)))).alias("q"))
    quoted = quoted.where("q.passage != ''").select("conv", "pos", F.col("q.depth").alias("depth"), F.xxhash64("q.passage").alias("hash"), F.length("q.passage").alias("chars"))
    there = messages.join(quoting.select("conv").distinct(), "conv", "left_semi")
    own = F.filter("lines", lambda x: x.depth == 0)
    passages = F.array_distinct(F.concat(F.transform(own, lambda x: _normal(x.body)), F.array(_normal(F.col("own")))))
    originals = there.select("conv", "pos", F.explode(passages).alias("passage")).where("passage != ''")
    originals = originals.select("conv", "pos", F.lit(0).alias("depth"), F.xxhash64("passage").alias("hash"), F.length("passage").alias("chars"))
    # one pass over the passages in order, not a join of quotes with all places of a passage
    before = Window.partitionBy("conv", "hash", "chars").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    met = quoted.unionByName(originals).withColumn("source_pos", F.max(F.when(F.col("depth") == 0, F.col("pos"))).over(before))
    found = met.where("depth > 0 and source_pos is not null").groupBy("conv", "pos", "depth", "source_pos").agg(F.sum("chars").alias("chars"))
    return found.groupBy("conv", "pos", "depth").agg(F.max_by("source_pos", F.struct("chars", "source_pos")).alias("source_pos"))


def _branch_orders(marked: DataFrame) -> DataFrame:
    """conv, branch, path: where each branch but the first stands. A path names for each branch on the way down where it leaves and where it begins; later leaves come first."""
    starts = marked.where("pos = branch and linked is not null and branch > 1")
    at = marked.select(F.col("conv"), F.col("pos").alias("linked"), F.col("branch").alias("up"))
    table = checkpointed(starts.select("conv", "branch", "linked").join(at, ["conv", "linked"]).select("conv", "branch", "up", F.array(-F.col("linked"), F.col("branch")).alias("path")))
    while not table.where("up > 1").isEmpty():  # each round doubles the way that is known
        above = table.select("conv", F.col("branch").alias("up"), F.col("up").alias("next"), F.col("path").alias("upper"))
        table = checkpointed(table.join(above, ["conv", "up"], "left").select("conv", "branch", F.coalesce("next", F.lit(1)).alias("up"), F.concat(F.coalesce("upper", F.array().cast("array<int>")), "path").alias("path")))
    return table.select("conv", "branch", "path")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, position (from 1), turn, role, reply_to (turn, null for a first message), quoted (whether by a quote), levels, text (without quotes) of each message.

    messages: conv_id, turn, role, text; other columns are ignored. Depth first: a message, what follows it, then what branches off, latest branching first. Nulls: see parsed; rows with a null conv_id are one conversation.
    """
    m = checkpointed(parsed(messages))
    outer = links(m).where("depth = 1").select("conv", "pos", F.col("source_pos").alias("linked"))
    order = Window.partitionBy("conv").orderBy("pos")
    turned = F.when(F.col("linked") != F.col("pos") - 1, F.col("pos"))
    marked = m.drop("lines", "runs").join(outer, ["conv", "pos"], "left")
    marked = marked.withColumn("branch", F.coalesce(F.max(turned).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1)))
    marked = marked.withColumn("previous", F.lag("turn").over(order))
    turns = m.select("conv", F.col("pos").alias("linked"), F.col("turn").alias("linked_turn"))
    placed = marked.join(_branch_orders(marked.select("conv", "pos", "branch", "linked")), ["conv", "branch"], "left").join(turns, ["conv", "linked"], "left")
    path = F.coalesce("path", F.array().cast("array<int>"))
    position = F.row_number().over(Window.partitionBy("conv").orderBy(path, "pos"))
    return placed.select(
        "conv_id", position.alias("position"), "turn", "role",
        F.when(F.col("linked").isNotNull(), F.col("linked_turn")).otherwise(F.col("previous")).alias("reply_to"),
        F.col("linked").isNotNull().alias("quoted"), "levels", F.col("own").alias("text"),
    )


def chats(messages: DataFrame) -> DataFrame:
    """conv_id and messages (array of position, role, text in order): one row for each conversation, for chats that fit into a row."""
    ordered = reply_ordered(messages)
    return ordered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("messages"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _normal_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


ORACLE = f"""
WITH RECURSIVE m AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS pos
  FROM (SELECT coalesce(conv_id, {NULL_ID}) AS conv, conv_id, turn, role, coalesce(text, '') AS text FROM conversations)
), l AS MATERIALIZED (
  SELECT conv, pos, i, length(regexp_replace(regexp_extract(ls[i], '{MARKS}', 1), '[^>]', '', 'g')) AS depth, regexp_replace(ls[i], '{MARKS}', '') AS body
  FROM (SELECT conv, pos, string_split_regex(text, '{LINE_BREAK}') AS ls FROM m), unnest(range(1, len(ls) + 1)) AS u(i)
), a AS (
  SELECT *, lead(depth) OVER w AS after, CASE WHEN depth = lag(depth) OVER w THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY conv, pos ORDER BY i)
), own AS MATERIALIZED (
  SELECT conv, pos, regexp_replace(string_agg(body, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS own
  FROM a WHERE depth = 0 AND NOT (regexp_matches(body, '{ANNOUNCEMENT}') AND coalesce(after, 0) > 0) GROUP BY conv, pos
), runs AS (
  SELECT conv, pos, depth, string_agg(body, ' ' ORDER BY i) AS body FROM (SELECT *, sum(new) OVER (PARTITION BY conv, pos ORDER BY i) AS run FROM a) GROUP BY conv, pos, run, depth
), quoted AS (
  SELECT DISTINCT conv, pos, depth, {_normal_sql('body')} AS passage FROM (SELECT conv, pos, depth, body FROM l UNION ALL SELECT * FROM runs) WHERE depth > 0
), originals AS (
  SELECT DISTINCT conv, pos, {_normal_sql('body')} AS passage FROM (SELECT conv, pos, body FROM l WHERE depth = 0 UNION ALL SELECT * FROM own)
), met AS (
  SELECT q.conv, q.pos, q.passage, max(o.pos) AS source FROM quoted q JOIN originals o ON o.conv = q.conv AND o.passage = q.passage AND o.pos < q.pos
  WHERE q.depth = 1 AND q.passage <> '' GROUP BY q.conv, q.pos, q.passage
), linked AS (
  SELECT conv, pos, arg_max(source, [chars, source]) AS linked FROM (SELECT conv, pos, source, sum(length(passage))::BIGINT AS chars FROM met GROUP BY conv, pos, source) GROUP BY conv, pos
), marked AS MATERIALIZED (
  SELECT m.*, linked, coalesce(max(CASE WHEN linked <> m.pos - 1 THEN m.pos END) OVER w, 1) AS branch, lag(turn) OVER w AS previous
  FROM m LEFT JOIN linked k ON k.conv = m.conv AND k.pos = m.pos WINDOW w AS (PARTITION BY m.conv ORDER BY m.pos)
), starts AS (
  SELECT s.conv, s.branch, s.linked, u.branch AS up FROM marked s JOIN marked u ON u.conv = s.conv AND u.pos = s.linked WHERE s.pos = s.branch AND s.branch > 1
), paths AS (
  SELECT conv, branch, [-linked, branch] AS path FROM starts WHERE up = 1
  UNION ALL SELECT s.conv, s.branch, list_concat(p.path, [-s.linked, s.branch]) FROM paths p JOIN starts s ON s.conv = p.conv AND s.up = p.branch
)
SELECT k.conv_id, row_number() OVER (PARTITION BY k.conv ORDER BY coalesce(p.path, []), k.pos)::INTEGER AS position, k.turn, k.role,
  CASE WHEN k.linked IS NOT NULL THEN t.turn ELSE k.previous END AS reply_to, k.linked IS NOT NULL AS quoted, d.levels, coalesce(o.own, '') AS text
FROM marked k JOIN (SELECT conv, pos, max(depth)::INTEGER AS levels FROM l GROUP BY conv, pos) d ON d.conv = k.conv AND d.pos = k.pos
LEFT JOIN own o ON o.conv = k.conv AND o.pos = k.pos LEFT JOIN paths p ON p.conv = k.conv AND p.branch = k.branch LEFT JOIN m t ON t.conv = k.conv AND t.pos = k.linked
"""

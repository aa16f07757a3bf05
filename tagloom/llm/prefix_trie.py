"""The trie of all conversations' prefixes, merged family first.

Conversations with one base id (conv_id less its remainder by `FAMILY`) are a family. A cogroup brings a family's turns together with the first turns of its base; there
the conversations are rebuilt and made into a small trie, whose nodes hold counts. Only such combined nodes are shuffled again, by what identifies a prefix, and merged over all families.

A prefix is identified by two 64-bit numbers: the sums modulo 2 (exclusive or) of hashes of (place, role, text) over its turns. So a family can be dealt in blocks of `BLOCK` turns of depth,
of which each needs only the sum before it: a conversation that holds much of the table is no large group.

In the merged trie a node is named by its smallest member and its depth. The nodes of one smallest member are a chain that ends where that conversation ends. Sums over
subtrees are made over the tree of chains by doubling: after k rounds a chain knows the sums of chains less than 2**k below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.common import checkpointed, in_arrow, ranges
from tagloom.llm.merkle_manifest import crc32_sql
from tagloom.llm.places import joined, place, placed

#: Conversations of a family have ids of one such range; so many turns at most are taken from its base.
FAMILY, HEADS = 100, 6
#: Turns of depth by which families, and chains, are dealt; turns taken from a base all lie in the first block.
BLOCK = 4096

_TURN = "kind int, conv long, depth long, last long, one long, two long, chars long"
_NODE = "one long, two long, depth long, up_one long, up_two long, conv long, n_convs long, chars long, base long, ends string"
_MERGED = "one long, two long, depth long, up_one long, up_two long, conv long, n_convs long, chars long, ends_sha256 string"
START, TURN, HEAD = 0, 1, 2


def turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, conv, block, kind, depth, last, one, two, chars) of all families' own turns and starts, and (h_base, h_depth, h_one, h_two, h_chars) of the first turns of bases.

    Own turns (kind TURN) stand at their depth in the rebuilt conversation. A START names a conversation in each of its blocks: depth is what comes before the block's own turns, one and two
    the sum at the block's start, last the conversation's last depth.
    """
    said = F.struct(F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = messages.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), said.alias("said"))
    # the length of the role keeps (role, text) apart; texts stay behind from here on
    short = F.md5(F.concat(F.length("said.role").cast("string"), F.lit(":"), "said.role", "said.text").cast("binary"))
    held = held.select("conv", "turn", F.col("said.role").alias("role"), short.alias("print"), F.length("said.text").cast("long").alias("chars"))
    dealt, pieces = placed(held, "conv", ["turn", "role", "print"])
    pieces = checkpointed(pieces)
    base = F.col("conv") - F.col("conv") % FAMILY
    convs = pieces.groupBy("of_group").agg(F.max("count").alias("n"))
    heads_wanted = F.crc32(F.col("of_group").cast("string").cast("binary")) % HEADS
    convs = convs.select(F.col("of_group").alias("whose"), "n", (F.col("of_group") - F.col("of_group") % FAMILY).alias("base"), heads_wanted.alias("h"))
    roots = convs.select(F.col("whose").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(roots, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.select("whose", "base", "h", taken.alias("k"), (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("last"))
    convs = checkpointed(convs)
    shown = pieces.join(convs, F.col("of_group") == F.col("whose")).select("of_part", "of_group", "first", "before", "h", "k", "last")
    numbered = joined(dealt, shown, "conv").withColumn("at", place() + 1)
    sums = lambda depth: [F.xxhash64(depth, "print").alias("one"), F.xxhash64("print", depth, F.lit("two")).alias("two")]
    depth = F.col("k") + F.col("at") - F.col("h")
    own = numbered.where("at > h").select(base.alias("base"), "conv", depth.alias("depth"), "last", *sums(depth), "chars")
    head_sums = [x.alias(f"h_{n}") for n, x in zip(("one", "two"), sums(F.col("at")), strict=True)]
    heads = numbered.where((F.col("conv") == base) & (F.col("at") < HEADS)).select(F.col("conv").alias("h_base"), F.col("at").alias("h_depth"), *head_sums, F.col("chars").alias("h_chars"))
    block = lambda d: F.floor((d - 1) / BLOCK)
    zero = F.lit(0).cast("long")
    first = convs.select("base", F.col("whose").alias("conv"), zero.alias("block"), F.lit(START).alias("kind"), F.col("k").cast("long").alias("depth"), "last", zero.alias("one"), zero.alias("two"), zero.alias("chars"))
    # only conversations with several blocks have later starts
    long = own.where(F.col("last") > BLOCK)
    before = long.where(F.col("depth") <= F.floor((F.col("last") - 1) / BLOCK) * BLOCK).groupBy("base", "conv", "last", block(F.col("depth")).alias("block")).agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
    lead = convs.where(F.col("last") > BLOCK).join(heads, (F.col("base") == F.col("h_base")) & (F.col("h_depth") <= F.col("k")))
    lead = lead.groupBy("base", F.col("whose").alias("conv"), "last").agg(F.bit_xor("h_one").alias("one"), F.bit_xor("h_two").alias("two"))
    parts = before.unionByName(lead.withColumn("block", zero))
    run = Window.partitionBy("conv").orderBy("block").rangeBetween(Window.unboundedPreceding, 0)
    later = parts.withColumns({"one": F.bit_xor("one").over(run), "two": F.bit_xor("two").over(run)}).dropDuplicates(["conv", "block"])
    later = later.select("base", "conv", (F.col("block") + 1).alias("block"), F.lit(START).alias("kind"), ((F.col("block") + 1) * BLOCK).alias("depth"), "last", "one", "two", zero.alias("chars"))
    own = own.select("base", "conv", block(F.col("depth")).alias("block"), F.lit(TURN).alias("kind"), "depth", "last", "one", "two", "chars")
    return own.unionByName(first).unionByName(later), heads


def _family(left: pa.Table, right: pa.Table) -> pa.Table:
    """The combined nodes of one block of a family."""
    if not len(left):
        return pa.Table.from_pylist([], schema=_schema(_NODE))
    base, block = left.column("base")[0].as_py(), left.column("block")[0].as_py()
    take = lambda table, names: [table.column(c).to_numpy() for c in names]
    kind, conv, depth, last, one, two, chars = take(left, ["kind", "conv", "depth", "last", "one", "two", "chars"])
    starts = np.flatnonzero(kind == START)
    starts = starts[np.argsort(conv[starts], kind="stable")]
    own = np.flatnonzero(kind == TURN)
    convs, before, ends = conv[starts], depth[starts], last[starts]
    # before its own turns a conversation has its start and, in the first block, turns of its base
    lead_depth, lead_one, lead_two, lead_chars = (np.zeros(0, np.int64) for _ in range(4))
    lead_of = np.zeros(0, np.int64)
    if block == 0:
        h_depth, h_one, h_two, h_chars = take(right, ["h_depth", "h_one", "h_two", "h_chars"])
        order = np.argsort(h_depth, kind="stable")
        taken = ranges(np.zeros(len(convs), np.int64), before)
        lead_of = np.repeat(np.arange(len(convs)), before)
        lead_depth, lead_one, lead_two, lead_chars = h_depth[order][taken], h_one[order][taken], h_two[order][taken], h_chars[order][taken]
        before = np.zeros(len(convs), np.int64)
    of = np.concatenate([np.arange(len(convs)), lead_of, np.searchsorted(convs, conv[own])])
    depths = np.concatenate([before, lead_depth, depth[own]])
    firsts = np.concatenate([one[starts], lead_one, one[own]])
    seconds = np.concatenate([two[starts], lead_two, two[own]])
    sizes = np.concatenate([np.zeros(len(convs), np.int64), lead_chars, chars[own]])
    order = np.lexsort((depths, of))
    of, depths, firsts, seconds, sizes = of[order], depths[order], firsts[order], seconds[order], sizes[order]
    begin = np.searchsorted(of, np.arange(len(convs)))
    firsts, seconds = _running(firsts, begin, of), _running(seconds, begin, of)
    at_start = np.zeros(len(of), bool)
    at_start[begin] = True
    keep = np.flatnonzero(~at_start | (depths == 0))
    above = np.where(at_start[keep], keep, keep - 1)
    # equal prefixes are one node: sorted by (depth, sums), members ascending
    order = np.lexsort((of[keep], seconds[keep], firsts[keep], depths[keep]))
    keep, above = keep[order], above[order]
    new = np.ones(len(keep), bool)
    new[1:] = (depths[keep][1:] != depths[keep][:-1]) | (firsts[keep][1:] != firsts[keep][:-1]) | (seconds[keep][1:] != seconds[keep][:-1])
    lead = np.flatnonzero(new)
    node = np.cumsum(new) - 1
    n_convs = np.diff(np.append(lead, len(keep)))
    here = ends[of[keep]] == depths[keep]
    names: list[list[str]] = [[] for _ in lead]
    for number, member in zip(node[here].tolist(), convs[of[keep[here]]].tolist(), strict=True):
        names[number].append(str(member))
    rows, up = keep[lead], above[lead]
    arrays = [firsts[rows], seconds[rows], depths[rows], firsts[up], seconds[up], convs[of[rows]], n_convs, sizes[rows], np.full(len(rows), base)]
    return pa.Table.from_arrays([*[pa.array(x.astype(np.int64)) for x in arrays], pa.array([",".join(x) for x in names], pa.string())], schema=_schema(_NODE))


def _running(values: np.ndarray, begin: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums modulo 2 within each conversation."""
    if not len(values):
        return values
    whole = np.bitwise_xor.accumulate(values)
    return whole ^ np.where(begin > 0, whole[begin - 1], 0)[of]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def family_nodes(messages: DataFrame) -> DataFrame:
    """The nodes of each family's trie: one, two (the prefix), depth, up_one, up_two (its parent), conv (smallest member), n_convs, chars (of its last text), base, ends (members that end here)."""
    own, heads = turns(messages)
    left = own.groupBy("base", "block")
    right = heads.withColumn("h_block", F.lit(0).cast("long")).groupBy("h_base", "h_block")
    return left.cogroup(right).applyInArrow(_family, _NODE)


def merged(nodes: DataFrame) -> DataFrame:
    """Nodes of all families as one trie. The ids that end at a node are hashed as they come, families ascending, so they are never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last node met: its values, and the digest so far
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(8)]
            ends = batch.column("ends").to_pylist()
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
            lead = np.flatnonzero(new)
            smallest, members = np.minimum.reduceat(columns[5], lead).tolist(), np.add.reduceat(columns[6], lead).tolist()
            first = [c[lead].tolist() for c in columns]
            out = []
            for i, (a, b) in enumerate(zip(lead.tolist(), [*lead[1:].tolist(), batch.num_rows], strict=True)):
                key = tuple(c[i] for c in first[:5])
                if held is None or held[0][:3] != key[:3]:
                    if held is not None:
                        out.append(_done(held))
                    held = [key, smallest[i], 0, first[7][i], hashlib.sha256(), False]
                held[1], held[2] = min(held[1], smallest[i]), held[2] + members[i]
                for text in ends[a:b]:
                    if text:
                        held[4].update(f"{',' if held[5] else ''}{text}".encode())
                        held[5] = True
            if out:
                yield _batch(out)
        if held is not None:
            yield _batch([_done(held)])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.repartition(parts, "one", "two", "depth").sortWithinPartitions("one", "two", "depth", "base")
    return in_arrow(dealt, run, _MERGED)


def _done(held: list) -> tuple:
    key, conv, n_convs, chars, ends, _ = held
    return (*key, conv, n_convs, chars, ends.hexdigest())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], schema=_schema(_MERGED))


def _below(chains: DataFrame) -> DataFrame:
    """conv, saved, leaves of each chain with all chains below it; chains: conv, up (the chain that it hangs on, null for the first), saved, leaves."""
    table = checkpointed(chains)
    while not table.where("up is not null").isEmpty():
        sums = table.where("up is not null").groupBy(F.col("up").alias("to")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))
        beyond = table.select(F.col("conv").alias("to"), F.col("up").alias("next"))
        grown = table.join(sums, F.col("conv") == F.col("to"), "left").select("conv", "up", (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"))
        table = checkpointed(grown.join(beyond, F.col("up") == F.col("to"), "left").select("conv", F.col("next").alias("up"), "saved", "leaves"))
    return table.select("conv", "saved", "leaves")


def trie(messages: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of the trie of rebuilt conversations.

    messages: conv_id, turn, role, text; other columns are ignored. A null role or text is empty, a null turn comes first; turns of one number are ordered by role and then by the text's digest, equal rows are
    turns of their own. Rows with a null conv_id belong to no conversation and take no part. A remainder has its id's sign. Texts of any length are hashed and counted whole. An empty table has no node.
    """
    nodes = checkpointed(merged(family_nodes(messages)))
    ups = nodes.select(F.col("one").alias("p_one"), F.col("two").alias("p_two"), F.col("depth").alias("p_depth"), F.col("conv").alias("parent"))
    same = (F.col("up_one") == F.col("p_one")) & (F.col("up_two") == F.col("p_two")) & (F.col("depth") - 1 == F.col("p_depth"))
    weight = (F.col("n_convs") - 1) * F.col("chars")
    named = nodes.join(ups, same, "left").select("conv", "depth", "parent", "n_convs", weight.alias("weight"), "ends_sha256")
    named = checkpointed(named)
    chains = named.groupBy("conv").agg(F.min("depth").alias("top"), F.max("depth").alias("end"), F.sum("weight").alias("saved"), F.min_by("parent", "depth").alias("up"))
    chains = checkpointed(chains)
    # where other chains hang on a chain
    hung = chains.where("up is not null").groupBy(F.col("up").alias("h_conv"), (F.col("top") - 1).alias("h_depth"))
    at_end = hung.count().select("h_conv", "h_depth")
    leaf = chains.join(at_end, (F.col("conv") == F.col("h_conv")) & (F.col("end") == F.col("h_depth")), "left").select("conv", "up", "saved", F.when(F.col("h_conv").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    below = _below(leaf).select(F.col("conv").alias("c"), F.col("saved").alias("b_saved"), F.col("leaves").alias("b_leaves"))
    sums = chains.where("up is not null").join(below, F.col("conv") == F.col("c")).groupBy(F.col("up").alias("h_conv"), (F.col("top") - 1).alias("h_depth"))
    sums = sums.agg(F.sum("b_saved").alias("b_saved"), F.sum("b_leaves").alias("b_leaves"), F.count(F.lit(1)).alias("branches"))
    rows = named.join(chains.select(F.col("conv").alias("c"), "end"), F.col("conv") == F.col("c")).drop("c")
    rows = rows.join(sums, (F.col("conv") == F.col("h_conv")) & (F.col("depth") == F.col("h_depth")), "left")
    going_on = (F.col("depth") < F.col("end")).cast("long")
    branches = F.coalesce("branches", F.lit(0))
    rows = rows.select(
        "conv", "depth", "parent", "n_convs", "ends_sha256", (branches + going_on).alias("n_children"), F.floor(F.col("depth") / BLOCK).alias("block"),
        (F.col("weight") + F.coalesce("b_saved", F.lit(0))).alias("saved"), (F.coalesce("b_leaves", F.lit(0)) + F.when(branches + going_on == 0, 1).otherwise(0)).alias("leaves"),
    )
    return _summed(rows).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256"
    )


def _summed(rows: DataFrame) -> DataFrame:
    """saved and leaves summed from each node down its chain; chains are summed by blocks first, so no window holds more than a block or one row for each of a chain's blocks."""
    rows = checkpointed(rows)
    deeper = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    rest = blocks.select(F.col("conv").alias("r_conv"), F.col("block").alias("r_block"), F.sum("s").over(deeper).alias("r_saved"), F.sum("l").over(deeper).alias("r_leaves")).where("r_saved is not null")
    within = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({"saved": F.sum("saved").over(within), "leaves": F.sum("leaves").over(within)})
    met = summed.join(rest, (F.col("conv") == F.col("r_conv")) & (F.col("block") == F.col("r_block")), "left")
    return met.withColumns({"saved": F.col("saved") + F.coalesce("r_saved", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("r_leaves", F.lit(0))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = f"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS MATERIALIZED (
  SELECT conv, conv - conv % {FAMILY} AS base, {crc32_sql('conv::VARCHAR')} % {HEADS} AS h FROM (SELECT DISTINCT conv FROM t)
), r AS MATERIALIZED (
  SELECT conv, role, text, row_number() OVER (PARTITION BY conv ORDER BY own, pos) AS depth FROM (
    SELECT c.conv, 0 AS own, b.pos, b.role, b.text FROM c JOIN t b ON b.conv = c.base AND b.pos <= c.h
    UNION ALL
    SELECT c.conv, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv = c.conv AND t.pos > c.h
  )
), p(conv, depth, path, chars) AS (
  SELECT conv, 0::BIGINT, md5(''), 0::BIGINT FROM c
  UNION ALL
  SELECT p.conv, r.depth, md5(p.path || length(r.role) || ':' || r.role || r.text), length(r.text) FROM p JOIN r ON r.conv = p.conv AND r.depth = p.depth + 1
), m AS MATERIALIZED (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv) AS ends, lag(path) OVER (PARTITION BY conv ORDER BY depth) AS up FROM p
), n AS MATERIALIZED (
  SELECT path, depth, any_value(up) AS up, min(conv) AS conv, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY path, depth
), k AS MATERIALIZED (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up, depth),
full_nodes AS MATERIALIZED (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n.n_convs - 1) * n.chars AS saved, CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END AS leaf
  FROM n LEFT JOIN k ON k.up = n.path AND k.depth = n.depth
), anc(path, depth, up, saved, leaf) AS (
  SELECT path, depth, up, saved, leaf FROM full_nodes
  UNION ALL
  SELECT f.path, f.depth, f.up, a.saved, a.leaf FROM anc a JOIN full_nodes f ON f.path = a.up AND f.depth = a.depth - 1
), s AS (SELECT path, depth, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM anc GROUP BY path, depth)
SELECT f.conv AS conv_id, f.depth, u.conv AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_nodes f JOIN s ON s.path = f.path AND s.depth = f.depth LEFT JOIN full_nodes u ON u.path = f.up AND u.depth = f.depth - 1
"""

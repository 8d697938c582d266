"""A Merkle manifest of a table: hash trees by group, upper proofs by butterfly exchange between aligned partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, python_tasks, table

FANOUT = 8
#: Levels of the tree inside one aligned partition: 8**4 leaves.
LEVELS = 4
#: Partitions of one group that one task joins with the proof of the group's subroot.
SALT_ROWS = 1024


def field(c: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*cols: Column) -> Column:
    """sha256 of a record's fields as lowercase hex."""
    return F.sha2(F.concat(*map(field, cols)).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof (array of left, right) lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


# ---- leaves in order -------------------------------------------------------------------------------------------

def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``idx``, the place of a row in its ``grp`` from 0 by ``order``, and ``total``, the rows of the group.

    Rows are range partitioned by group and order, so a group of any size is cut into balanced partitions; the number of
    each (partition, group) stretch is added up over partitions. There are at most as many stretches as partitions and groups.
    """
    by = ["grp", *order]
    ordered = materialize(leaves.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "merkle-order") \
        .withColumn("part", F.shiftright("at", 33))
    group = Window.partitionBy("grp")
    upto = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = ordered.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).select(
        "part", "grp", (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total"))
    return ordered.join(stretches, ["part", "grp"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


# ---- trees inside partitions -----------------------------------------------------------------------------------

def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parents(nodes: list[str]) -> list[str]:
    return [_h("".join(nodes[k:k + FANOUT])) for k in range(0, len(nodes), FANOUT)]


def local_levels(leaves: list[str], total: int, height: int) -> list[list[str]]:
    """Levels of one partition's subtree from the leaves up; of a group with one partition only as far as nodes remain."""
    levels = [leaves]
    while len(levels) <= height and (total > FANOUT ** height or len(levels[-1]) > 1):
        levels.append(parents(levels[-1]))
    return levels


def local_steps(levels: list[list[str]], k: int) -> list[tuple[str, str]]:
    """Siblings (left, right) of leaf ``k`` on each level of the subtree but the top."""
    out = []
    for nodes in levels[:-1]:
        first = k - k % FANOUT
        out.append(("".join(nodes[first:k]), "".join(nodes[k + 1:first + FANOUT])))
        k //= FANOUT
    return out


def partitions(rows: DataFrame, names: list[str], height: int) -> DataFrame:
    """One row per aligned partition of 8**height leaves: grp, block, total, one array per column of ``names``, node (its subtree's root).

    The first of ``names`` is the leaf's digest (32 bytes). A partition has 4,096 rows at most at a height of 4, whatever the group.
    """
    fields = [rows.schema[n].dataType.simpleString() for n in names]
    schema = "grp string, block long, total long, " + ", ".join(f"{n} array<{t}>" for n, t in zip(names, fields)) + ", node string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]
        key = None

        def flush(arrow: list[pa.DataType]) -> pa.RecordBatch:
            top = local_levels([x.hex() for x in held[0]], key[2], height)[-1][0]
            columns = [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()),
                       *(pa.array([x], pa.list_(t)) for x, t in zip(held, arrow)), pa.array([top], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["grp", "block", "total", *names, "node"])

        for b in batches:
            arrow = [b.schema.field(n).type for n in names]
            for grp, block, total, *values in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ["grp", "block", "total", *names])):
                if key is not None and key[:2] != (grp, block):
                    yield flush(arrow)
                    held = [[] for _ in names]
                key = (grp, block, total)
                for x, v in zip(held, values):
                    x.append(v)
        if key is not None:
            yield flush(arrow)

    python_tasks(rows.sparkSession)
    dealt = rows.withColumn("block", F.expr(f"idx div {FANOUT ** height}")).select("grp", "block", "idx", "total", *names)
    return dealt.repartition("grp", "block").sortWithinPartitions("grp", "block", "idx").drop("idx").mapInArrow(run, schema)


# ---- butterfly exchange ----------------------------------------------------------------------------------------

def exchange(blocks: DataFrame, height: int) -> DataFrame:
    """grp, block, blocks, node (the group's subroot), path: each partition's proof above its own subtree.

    In round r the partitions whose numbers differ in digit r to the base 8 alone swap the roots of their subtrees of 8**r
    partitions; each then hashes the ancestor itself, so all partitions below a node hold it and no pass leads down again.
    The last subtree of a group may be short: its partitions serve the missing numbers in turn. A swap has 8 rows at most.
    """
    spark = blocks.sparkSession
    step = "array<struct<left: string, right: string>>"
    state = materialize(blocks.select("grp", "block", F.expr(f"(total + {FANOUT ** height - 1}) div {FANOUT ** height}").alias("blocks"), "node",
                                      F.array().cast(step).alias("path")), "merkle-state")
    widest, size, round_ = state.agg(F.max("blocks")).first()[0] or 0, 1, 0
    while size < widest:
        swap = state.withColumns({"own": F.expr(f"block div {size}"), "low": F.col("block") % size}).withColumns({
            "digit": F.col("own") % FANOUT, "high": F.expr(f"own div {FANOUT}"),
            "served": F.least(F.lit(size), F.col("blocks") - F.col("own") * size)})
        more = F.col("blocks") > size
        alone = F.col("own") * size + size >= F.col("blocks")
        reach = F.when(alone & (F.col("digit") == 0), F.col("served")).otherwise(F.lit(size))
        sent = swap.where(more).select("grp", "high", "digit", "node", F.explode(F.sequence("low", reach - 1, "served")).alias("low"))
        runs = sent.groupBy("grp", "high", "low").agg(F.sort_array(F.collect_list(F.struct("digit", "node"))).alias("run"))

        def side(keep):
            return F.array_join(F.transform(F.filter("run", keep), lambda x: x["node"]), "")

        joined = swap.join(runs, ["grp", "high", "low"], "left")
        state = materialize(joined.select(
            "grp", "block", "blocks", F.when(more, F.sha2(side(lambda x: F.lit(True)).cast("binary"), 256)).otherwise(F.col("node")).alias("node"),
            F.when(more, F.concat("path", F.array(F.struct(side(lambda x: x["digit"] < F.col("digit")).alias("left"),
                                                           side(lambda x: x["digit"] > F.col("digit")).alias("right"))))).otherwise(F.col("path")).alias("path")),
            f"merkle-round-{round_}")
        size, round_ = size * FANOUT, round_ + 1
    return state


def opened(blocks: DataFrame, paths: DataFrame, names: list[str], keep: list[str], height: int) -> DataFrame:
    """Rows of all partitions again: ``names``, ``keep`` (columns of ``paths``) and proof, from the leaf to the end of ``paths``' path."""
    step = "proof array<struct<left: string, right: string>>"
    schema = ", ".join(f"{n} {blocks.schema[n].dataType.elementType.simpleString()}" for n in names) + "".join(f", {k} string" for k in keep) + ", " + step
    pair = pa.struct([("left", pa.string()), ("right", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                one = b.slice(row, 1).to_pylist()[0]
                levels = local_levels([x.hex() for x in one[names[0]]], one["total"], height)
                upper = [(s["left"], s["right"]) for s in one["path"]]
                for at in range(0, len(levels[0]), 512):
                    proofs = [local_steps(levels, k) + upper for k in range(at, min(at + 512, len(levels[0])))]
                    flat = [s for p in proofs for s in p]
                    lists = pa.ListArray.from_arrays(pa.array([i * (len(proofs[0])) for i in range(len(proofs) + 1)], pa.int32()),
                                                     pa.StructArray.from_arrays([pa.array([s[i] for s in flat], pa.string()) for i in (0, 1)], fields=list(pair)))
                    columns = [b.column(b.schema.get_field_index(n)).slice(row, 1).flatten().slice(at, len(proofs)) for n in names]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array([one[k]] * len(proofs), pa.string()) for k in keep), lists], names=[*names, *keep, "proof"])

    return blocks.select("grp", "block", "total", *names).join(paths.select("grp", "block", "path", *keep), ["grp", "block"]).mapInArrow(run, schema)


def manifest(rows: DataFrame, group: Column, order: list[str], leaf: str, carried: list[str], height: int = LEVELS) -> DataFrame:
    """``carried`` columns, leaf, subroot, root and proof (array of left and right siblings, from the leaf to the root) of each row.

    Rows of a group ascend by ``order`` (nulls first), then by digest; rows equal in all that are exchangeable, but stay
    rows of their own. Runs of 8 nodes become one, level by level, to the group's subroot; the subroots, ordered by
    group (null first, bytewise), lead to the root in the same way. ``leaf`` names the digest (hex). Empty input gives an
    empty result.
    """
    grp = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group))
    names = ["leaf", *[c for c in carried if c != "leaf"]]
    leaves = materialize(rows.select(grp.alias("grp"), F.unhex(leaf).alias("leaf"), *[c for c in dict.fromkeys([*carried, *order])],
                                     F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    blocks = materialize(partitions(numbered(leaves, [*order, "leaf", "row"]), names, height), "merkle-blocks")
    lower = exchange(blocks, height)
    tops = lower.where("block = 0").select(F.lit("").alias("grp"), F.unhex("node").alias("node_of"), F.col("grp").alias("key"), "blocks")
    top_blocks = materialize(partitions(numbered(tops, ["key"]), ["node_of", "key", "blocks"], height), "merkle-tops")
    upper = opened(top_blocks, exchange(top_blocks, height).withColumnRenamed("node", "root"), ["node_of", "key", "blocks"], ["root"], height)
    # a group of many partitions is joined in many tasks: its subroot's proof is sent once for each SALT_ROWS of them
    many = upper.select(F.col("key").alias("grp"), "root", F.col("proof").alias("above"),
                        F.explode(F.expr(f"sequence(0, (blocks - 1) div {SALT_ROWS})")).alias("salt"))
    paths = lower.withColumn("salt", F.expr(f"block div {SALT_ROWS}")).join(many, ["grp", "salt"]) \
        .select("grp", "block", F.concat("path", "above").alias("path"), F.col("node").alias("subroot"), "root")
    return opened(blocks, paths, names, ["subroot", "root"], height).withColumn("leaf", F.lower(F.hex("leaf")))


def _sql_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARENTS = "list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1:i * 8 + 8], '')))"
_STEP = """k // power(8, level)::BIGINT AS own, own - own % 8 AS run, array_to_string(nodes[run + 1:own], '') AS l, array_to_string(nodes[own + 2:run + 8], '') AS r"""
#: The trees as recursive lists of nodes, every proof from the lists, and each fold step by step; crc32 bit by bit.
ORACLE = f"""WITH RECURSIVE raw AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)) AS crc FROM documents),
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k,
    sha256(concat({", ".join(map(_sql_field, ("doc_id", "source", "lang", "n_chars", "text")))})) AS leaf,
    sha256(concat({", ".join(map(_sql_field, ("doc_id", "source", "lang", "n_chars")))}, {_sql_field("t2")})) AS claimed
  FROM (SELECT *, CASE WHEN xor(crc, 4294967295::BIGINT) % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS t2 FROM raw)),
lv AS (SELECT lang, 0 AS level, list(leaf ORDER BY k) AS nodes FROM d GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_PARENTS} FROM lv WHERE len(nodes) > 1),
tops AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM lv WHERE len(nodes) = 1),
up AS (SELECT 0 AS level, list(subroot ORDER BY k) AS nodes FROM tops UNION ALL SELECT level + 1, {_PARENTS} FROM up WHERE len(nodes) > 1),
steps AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY o) AS n, l, r FROM (
  SELECT rid, level AS o, {_STEP} FROM d JOIN lv ON lv.lang IS NOT DISTINCT FROM d.lang WHERE len(nodes) > 1
  UNION ALL SELECT rid, 1000 + level AS o, {_STEP} FROM (SELECT d.rid, tops.k FROM d JOIN tops ON tops.lang IS NOT DISTINCT FROM d.lang), up WHERE len(nodes) > 1)),
fold AS (SELECT rid, 1 AS n, claimed AS acc FROM d UNION ALL SELECT f.rid, f.n + 1, sha256(s.l || f.acc || s.r) FROM fold f JOIN steps s ON s.rid = f.rid AND s.n = f.n)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM d JOIN tops ON tops.lang IS NOT DISTINCT FROM d.lang
JOIN (SELECT rid, arg_max(acc, n) AS acc FROM fold GROUP BY rid) USING (rid)
LEFT JOIN (SELECT rid, string_agg(l || r, '' ORDER BY n) AS proof FROM steps GROUP BY rid) USING (rid),
(SELECT nodes[1] AS root FROM up WHERE len(nodes) = 1)"""


def op13_butterfly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked for rows of which every third (by crc32 of doc_id) has its text's A-Z lower-cased."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    first, last = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", digest(*first, last).alias("digest"), F.unhex(digest(*first, text)).alias("claimed"))
    proofs = manifest(rows, F.col("lang"), ["doc_id"], "digest", ["doc_id", "claimed"])
    root = folded(F.lower(F.hex("claimed")), F.col("proof"))
    return proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))

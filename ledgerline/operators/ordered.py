"""Order-dependent operators that stay parallel when a group is huge.

The deal order is ``(year, deal_id)`` everywhere (ties in year are broken by the
key, so every window below is deterministic).

* :func:`in_order` range partitions and sorts the rows once and writes them; every row
  then knows its partition and its place in it, and blocks are exact stretches of
  places, however many there are.
* :func:`numbered` turns places into positions, of the table or inside groups, by a
  prefix scan over the partitions' counts; :func:`before` does it for sums of blocks.
* :func:`ordered_features` computes trailing-``k``-row mean / sample std per group
  and the global running count of a flag, without ``partitionBy(group)`` or a
  global ``orderBy`` window over raw rows (see its docstring).
* :func:`exact_quantiles` selects order statistics by radix histograms.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows of one block of an ordered operator.
ROWS_PER_BLOCK = 1_000_000
#: Rows of one range partition of :func:`in_order`: what one task sorts, whatever the table's size.
ROWS_PER_PARTITION = 200_000
#: Rows that are worth a range partition of their own, as long as they are no more than the session's shuffle partitions.
LEAST_ROWS = 10_000
#: Bits of ``_at`` that hold a row's place in its partition.
PLACE_BITS = 33
#: State rows up to which the quantile operator broadcasts its open brackets; beyond, they are joined by shuffle.
BROADCAST_ROWS = 100_000


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- places, blocks, positions
def in_order(df: DataFrame, by: list, then: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """The rows range partitioned and sorted by ``by``, written once, with ``_at``: partition and place, ascending in that
    order. Bounds are sampled, so partitions are balanced unless many rows are equal in all of ``by``; their number grows
    with the rows, so that no sort spills. Row-local columns of ``then`` are added to the sorted rows: neither the sample
    nor the shuffle computes or carries them."""
    rows, most = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(max(-(-rows // ROWS_PER_PARTITION), min(most, -(-rows // LEAST_ROWS)), 1), *by)
    return written(then(ranged.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())), "in-order")


def partition_of(col: str) -> Column:
    return F.shiftright(col, PLACE_BITS)


def block_start(rows: int = ROWS_PER_BLOCK) -> Column:
    """The ``_at`` of the first row of the row's block: blocks are ``rows`` places of a partition (its last one: fewer)."""
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return F.col("_at") - place % rows


def before(blocks: DataFrame, sums: list[str]) -> DataFrame:
    """``_blk`` and, for each of ``sums``, its total over all earlier blocks: added up inside each partition, and over the
    partitions' totals (one row per partition)."""
    d = blocks.withColumn("_part", partition_of("_blk"))
    earlier = Window.partitionBy("_part").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("_part").agg(*[F.sum(s).alias(s) for s in sums])
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.select("_part", *[F.coalesce(F.sum(s).over(upto), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inside = d.select("_part", "_blk", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(s) for s in sums])
    return inside.join(offs, "_part").select("_blk", *[(F.col(s) + F.col(f"_o_{s}")).alias(s) for s in sums])


def numbered(df: DataFrame, group: list[str], order: list, out: str) -> DataFrame:
    """Adds ``out``: the 0-based place of a row in ``group`` (none: in the table) by ``order``, which must tell rows apart.

    The count of each (partition, group) stretch is added up over the partitions of the group: as many rows as there are
    partitions and groups. A group of any size is spread over partitions, and no window runs over rows.
    """
    d = in_order(df, [*group, *order]).withColumn("_part", partition_of("_at"))
    whole = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]) if group else Window.partitionBy()
    upto = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    stretch = d.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    shift = stretch.select(F.col("_part").alias("_p"), *[f"_g{i}" for i in range(len(group))],
                           (F.coalesce(F.sum("_n").over(upto), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_part") == F.col("_p"))
    return d.join(shift, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(out))


def ordered_features(df: DataFrame, group: str, value: str, flag: str, windows=(2, 3), rows_per_block: int | None = None,
                     order=("year", "deal_id"), prefix: str = "roll", count_out: str = "policy_cumulative", lagged: bool = True) -> DataFrame:
    """Add:

    * ``{prefix}_mean_{k}`` / ``{prefix}_std_{k}``: mean and sample std of ``value``
      over the last ``k`` rows of ``group`` in deal order (current row included,
      fewer rows at the start; std NULL on one row);
    * ``count_out``: running sum of the 0/1 ``flag`` over the whole table in deal order;
    * with ``lagged``, ``{prefix}_lag_mean_{k}`` / ``{prefix}_lag_std_{k}``: the same
      statistics over the ``k`` rows *before* the current one (current value
      excluded, so the feature does not contain the target; NULL on a group's
      first row).

    ``df`` comes from :func:`in_order` (it has ``_at``) or is put in order here. The
    rows are dealt out by block, one block a task; the chunks ``(group, block)`` and the
    running count's blocks both live inside one such task, so both windows use that one
    exchange and sort no more than a block. Only the first ``k - 1`` (``k`` when lagged) rows of each chunk need rows
    of earlier chunks: a narrow pass finds every chunk's tail, and the rows that come just before a chunk are dealt
    out with its block once more, as is one row per block with the flag's count of all earlier blocks. The windows see them;
    then they are dropped. So the rows are joined to nothing and shuffled once, however many chunks there are. Blocks have at
    most ``rows_per_block`` rows and never span two partitions of :func:`in_order`, whatever the key's distribution. Join
    dimensions to the result, not to ``df``: the shuffled and buffered rows stay narrow.
    """
    d = df if "_at" in df.columns else in_order(df, list(order))
    rows = rows_per_block or ROWS_PER_BLOCK
    h = max(windows) if lagged else max(windows) - 1
    nb = d.select(group, "_at", value, flag).withColumn("_blk", block_start(rows))
    base_cols = [c for c in d.columns if c != "_at"]
    out_cols = [f"{prefix}_{s}_{k}" for k in windows for s in ("mean", "std")]
    if lagged:
        out_cols += [f"{prefix}_lag_{s}_{k}" for k in windows for s in ("mean", "std")]

    def stats(w) -> list[Column]:
        cols = []
        for k in windows:
            f = w.rowsBetween(-(k - 1), 0)
            cols.append(F.avg(value).over(f).alias(f"{prefix}_mean_{k}"))
            cols.append(F.stddev_samp(value).over(f).alias(f"{prefix}_std_{k}"))
        if lagged:
            for k in windows:
                f = w.rowsBetween(-k, -1)
                cols.append(F.avg(value).over(f).alias(f"{prefix}_lag_mean_{k}"))
                cols.append(F.stddev_samp(value).over(f).alias(f"{prefix}_lag_std_{k}"))
        return cols

    # 1) narrow pass: the last h rows of every chunk; among them, the h before a chunk's are those that its first rows need.
    #    With one row per block (exclusive prefix sums of the flag) they are written: at most h rows per chunk.
    w_last = Window.partitionBy(group, "_blk").orderBy(F.desc("_at"))
    tails = nb.select(group, "_at", value, "_blk", F.row_number().over(w_last).alias("_rn")).where(F.col("_rn") <= h)
    w_grp = Window.partitionBy(group).orderBy("_at")
    ahead = (tails.select(group, "_blk", F.lag("_blk").over(w_grp).alias("_was"),
                          F.collect_list(F.struct("_at", value)).over(w_grp.rowsBetween(-h, -1)).alias("_rows"))
             .where("_was <> _blk").select(group, "_blk", F.inline("_rows")))
    offs = before(nb.groupBy("_blk").agg(F.sum(F.col(flag).cast("long")).alias("_off")), ["_off"])
    offs = offs.select("_blk", F.lit(-1).cast("long").alias("_at"), "_off")
    extra = written(ahead.unionByName(offs, allowMissingColumns=True).withColumn("_extra", F.lit(True)), "ahead")
    # 2) the shuffle of the rows, a task per block: in-block running sum and in-chunk statistics.
    nth = F.floor(F.col("_blk").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) / rows)
    parts, most = extra.agg(F.coalesce(F.max(partition_of("_blk")), F.lit(0)) + 1, F.coalesce(F.max(nth), F.lit(0)) + 1).first()
    w_blk = Window.partitionBy("_task", "_blk").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    w_task = Window.partitionBy("_task", "_blk", group).orderBy("_at")
    dealt = d.withColumn("_blk", block_start(rows)).unionByName(extra, allowMissingColumns=True)
    wd = (dealt.withColumn("_task", (partition_of("_blk") * most + nth).cast("int")).repartitionById(parts * most, "_task")
          .select(*base_cols, "_at", "_blk", "_task", "_extra",
                  (F.first("_off", ignorenulls=True).over(w_blk) + F.sum(F.col(flag).cast("long")).over(w_blk)).alias(count_out))
          .select(*base_cols, *stats(w_task), count_out, "_extra"))
    return wd.where("_extra is null").drop("_extra")


# ---------------------------------------------------------------- quantiles
_ONE = 1 << 52
_LEAST_NORMAL, _HALF_WAY = 2.0 ** -1022, 2.0 ** 537


def order_key(x: Column) -> Column:
    """A 64-bit integer that orders like the double ``x`` (not NULL or NaN): its bits without sign, negated below zero.

    Exponent and fraction are taken by exact arithmetic on powers of two; -0.0 and 0.0 are one key.
    """
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    two = lambda e: F.pow(F.lit(2.0), e)
    exact = guess + (a >= two(guess + 1)).cast("long") - (a < two(guess)).cast("long")
    normal = (exact + 1023) * _ONE + ((a / two(exact) - 1) * float(_ONE)).cast("long")
    bits = F.when(a < _LEAST_NORMAL, (a * _HALF_WAY * _HALF_WAY).cast("long")) \
        .when(a == float("inf"), F.lit(2047 * _ONE)).otherwise(normal)
    return F.when(x < 0, -bits).otherwise(bits)


def key_value(key: Column) -> Column:
    """The double of an :func:`order_key`."""
    bits = F.abs(key)
    e, m = F.shiftright(bits, 52), bits.bitwiseAND(F.lit(_ONE - 1)).cast("double")
    a = F.when(e == 2047, F.lit(float("inf"))).when(e == 0, m * 2.0 ** -1074).otherwise((1 + m / float(_ONE)) * F.pow(F.lit(2.0), e - 1023))
    return F.when(key < 0, -a).otherwise(a)


def order_statistics(base: DataFrame, gk: list[str], qs: list[float], digit: int = 16) -> tuple[DataFrame, int]:
    """The two order statistics around each quantile of ``_key`` (order keys) per group, and the passes over ``base`` it took.

    One pass counts keys by their leading ``digit`` bits, for all groups and targets at once, with the smallest and largest
    key of each cell (summed before the shuffle). The cell of a rank is its bracket; the next pass counts only keys in open
    brackets by ``digit`` more bits. A cell with one distinct key is known, so ties end early, and after 64 bits every cell
    is: at most 64 / ``digit`` passes for any distribution. Cells of a bracket number at most 2**``digit``; the state has one
    row per group and rank and is written to the shared folder, the driver sees its size only. Rows (group keys, _q, _w: lower or
    upper rank, _f: weight of the upper, _mn = _mx: the key).
    """
    shift = 64 - digit
    cells = base.groupBy(*gk, F.shiftright("_key", shift).alias("_p")).agg(*_cell("_key"))
    return _closed(written(_ranked(cells, gk, "_p", qs), "ranks"), base, gk, shift, digit)


def _cell(c: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("_c"), F.min(c).alias("_mn"), F.max(c).alias("_mx")]


def _ranked(cells: DataFrame, gk: list[str], cell: str, qs: list[float]) -> DataFrame:
    """Of the cells (ascending in ``cell``) of each group those that hold the lower or upper rank of a quantile, a row per rank."""
    whole = Window.partitionBy(*gk)
    cells = cells.withColumn("_below", F.coalesce(F.sum("_c").over(whole.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("_n", F.sum("_c").over(whole))

    def target(i: int, p: float, upper: int) -> Column:
        at = F.lit(float(p)) * (F.col("_n") - 1)
        low = F.floor(at)
        rank = F.least(low + 1, F.col("_n") - 1) if upper else low
        return F.struct(F.lit(i).alias("_q"), F.lit(upper).alias("_w"), rank.alias("_rank"), (at - low).alias("_f"))

    ranks = F.array(*[target(i, p, w) for i, p in enumerate(qs) for w in (0, 1)])
    here = F.filter(ranks, lambda t: (t["_rank"] >= F.col("_below")) & (t["_rank"] < F.col("_below") + F.col("_c")))
    return cells.where(F.size(here) > 0).select(*gk, F.inline(here), cell, "_below", "_mn", "_mx")


def _brackets(todo: DataFrame, size: int, cols: list[str]) -> DataFrame:
    found = todo.select(*cols).distinct()
    return F.broadcast(found) if size <= BROADCAST_ROWS else found


def _closed(state: DataFrame, base: DataFrame, gk: list[str], shift: int, digit: int) -> tuple[DataFrame, int]:
    """``state`` with every bracket narrowed to one key, and the passes so far, the one before included. Brackets are cells of
    all but the last ``shift`` bits of ``_key``; at 64 bits, a whole group."""
    passes, cols = 1, [*gk, "_q", "_w", "_rank", "_f", "_p", "_below", "_mn", "_mx"]
    while shift:
        size, open_ = state.agg(F.count(F.lit(1)), F.count(F.when(F.col("_mn") < F.col("_mx"), 1))).first()
        if not open_:
            break
        todo = state.where("_mn < _mx")
        prefix = F.shiftright("_key", shift) if shift < 64 else F.lit(0).cast("long")
        inside = base.withColumn("_p", prefix).join(_brackets(todo, size, [*gk, "_p"]), [*gk, "_p"])
        shift = max(0, shift - digit)
        cells = inside.groupBy(*gk, "_p", F.shiftright("_key", shift).alias("_next")).agg(*_cell("_key"))
        upto = Window.partitionBy(*gk, "_p").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_add", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
        first = F.col("_below") + F.col("_add")
        found = todo.drop("_mn", "_mx").join(cells, [*gk, "_p"]).where((F.col("_rank") >= first) & (F.col("_rank") < first + F.col("_c"))) \
            .select(*gk, "_q", "_w", "_rank", "_f", F.col("_next").alias("_p"), first.alias("_below"), "_mn", "_mx")
        state = written(state.where("_mn = _mx").select(*cols).unionByName(found.select(*cols)), "ranks")
        passes += 1
    return state, passes


def coarse_key(x: Column) -> Column:
    """An integer that never falls when the double ``x`` (not NULL or NaN) rises, some 700 to 900 of them between 1 and 2 and about
    so many in other doublings: square roots and products are rounded exactly, so they keep the order."""
    root = F.abs(x)
    for _ in range(6):
        root = F.sqrt(root)
    return F.floor(F.signum(x) * root * 65536.0)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], digit: int = 16) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas/DuckDB ``quantile_cont``) per group by radix selection: bounded memory
    and a bounded number of passes whatever the groups' sizes and distributions.

    The rows are read twice: their cells of :func:`coarse_key` are counted, then the order keys of those in a cell that holds a
    wanted rank and more than one value are written. At most 64 / ``digit`` passes over these keys, usually a small part of
    the rows, find the order statistics (see :func:`order_statistics`).

    NULL/NaN values and NULL groups are ignored. Output: keys + one column per entry of ``qs``.
    """
    gk = list(keys) if keys else ["_g"]
    base = df.select(*[F.col(k) for k in keys], *([] if keys else [F.lit(0).alias("_g")]), F.col(value).cast("double").alias("_x"))
    base = base.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    for k in keys:
        base = base.where(F.col(k).isNotNull())
    base = base.select(*gk, "_x", coarse_key(F.col("_x")).alias("_cell"))
    cells = _ranked(base.groupBy(*gk, "_cell").agg(*_cell("_x")), gk, "_cell", list(qs.values()))
    state = written(cells.select(*gk, "_cell", "_q", "_w", "_rank", "_f", F.lit(0).cast("long").alias("_p"), "_below",
                                 *[order_key(F.col(c)).alias(c) for c in ("_mn", "_mx")]), "ranks")
    size, open_ = state.agg(F.count(F.lit(1)), F.count(F.when(F.col("_mn") < F.col("_mx"), 1))).first()
    if open_:
        inside = base.join(_brackets(state.where("_mn < _mx"), size, [*gk, "_cell"]), [*gk, "_cell"])
        narrow = written(inside.select(*gk, "_cell", order_key(F.col("_x")).alias("_key")), "keys")
        state, _ = _closed(state, narrow, [*gk, "_cell"], 64, digit)
    v = key_value(F.col("_mn"))

    def quantile(i: int) -> Column:
        low, high, f = (F.max(F.when((F.col("_q") == i) & (F.col("_w") == w), c)) for w, c in ((0, v), (1, v), (0, F.col("_f"))))
        return F.when((f > 0) & (low != high), low + f * (high - low)).otherwise(low)

    return state.groupBy(*gk).agg(*[quantile(i).alias(nm) for i, nm in enumerate(qs)]).select(*keys, *qs)

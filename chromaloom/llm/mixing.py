"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Block j of a source with weight w of W is released at slot floor(j * W / w) and due by slot ceil((j + 1) * W / w),
in whole numbers; in each slot the released block with the earliest deadline goes (ties: the smaller source name).
The windows follow the fluid schedule, so after any slot each source has had within one block of its exact weight.
All windows repeat after W slots: one period is scheduled, and every block finds its slot from its number alone.
Where W is long, the schedule is made for as many slots as the rows need; where these are too many, the weights are
rounded to whole slots of a period of MOST_SLOTS. Blocks keep their size, and every row has a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpoint

#: Documents of a block, and the least weight of live sources with which a mix goes on.
BLOCK_DOCS, LEAST_LIVE = 16, 0.4
#: Slots of a schedule, at most (or four for each source). Weights with a longer period, of rows that need more slots, are
#: rounded to so many parts: a source's share of the mix is then within one part of what was asked.
MOST_SLOTS = 1 << 17
#: Hex digits of the order key that cut a source into buckets, so that no source is ranked in one task.
BUCKET_DIGITS = 3
#: Default targets: as many as a source has, but no more than MOST_OF_OTHERS of what all others have together (so
#: that no source is above a third of the mix), in whole parts of PARTS.
MOST_OF_OTHERS, PARTS = 0.5, 1000
#: Weights count to this decimal place; and the largest sum of weights, as whole numbers without a common factor.
PLACES, MOST_WEIGHT = 6, 1 << 45


def damped_weights(counts: DataFrame, most_of_others: float = MOST_OF_OTHERS, parts: int = PARTS) -> DataFrame:
    """(src, docs) -> (src, weight): whole parts of about ``parts``, at least one for each source."""
    total = counts.agg(F.sum("docs").alias("total"))
    share = F.greatest(F.lit(1), F.least(F.col("docs"), F.floor((F.col("total") - F.col("docs")) * most_of_others)))
    raw = counts.crossJoin(F.broadcast(total)).select("src", share.cast("long").alias("raw"))
    all_raw = raw.agg(F.sum("raw").alias("all"))
    return raw.crossJoin(F.broadcast(all_raw)).select("src", F.greatest(F.lit(1), F.expr(f"(raw * {parts} + all div 2) div all")).alias("weight"))


def whole_weights(weights: DataFrame) -> DataFrame:
    """(src, weight) -> (src, w): whole numbers in the same proportion, without a common factor. Weights that are
    null or not over zero (at the sixth decimal place) go; of a source listed twice the weights are added."""
    kind = weights.schema["weight"].dataType.typeName()
    whole = F.col("weight").cast("long") if kind in ("byte", "short", "integer", "long") else F.round(F.col("weight").try_cast(f"decimal(28,{PLACES})") * 10**PLACES).cast("long")
    w = weights.select("src", whole.alias("w")).filter("w > 0").groupBy("src").agg(F.sum("w").alias("w"))
    # Euclid's algorithm: 92 steps serve any two 64-bit numbers
    euclid = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))), lambda s: s["a"])
    factor = w.agg(F.aggregate(F.collect_set("w"), F.lit(0).cast("long"), lambda acc, x: euclid(x, acc)).alias("factor"))
    return w.crossJoin(F.broadcast(factor)).select("src", F.expr("w div factor").alias("w"))


def schedule(weights: DataFrame, total: int, slots: int) -> DataFrame:
    """(src, w), whole weights with the sum ``total`` -> (src, w, blocks, at array<int>): the slots of a source's first
    blocks, in the first ``slots`` slots.

    A fold over the slots. Its state is the blocks that are released and wait, each as one number: deadline times the
    number of sources, plus the source's number. The table of sources and the schedule are one row, bounded by the
    number of slots."""
    own = weights.agg(F.sort_array(F.collect_list(F.struct("src", "w"))).alias("s"))
    each = own.select(F.size("s").cast("long").alias("n"), F.posexplode("s").alias("i", "x")).select("n", "i", F.col("x.src").alias("src"), F.col("x.w").alias("w"))
    each = each.withColumn("blocks", F.expr(f"least(({slots}L * w + {total - 1}L) div {total}L, {slots}L)"))
    jobs = each.select("n", "i", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    due = F.expr(f"((j + 1) * {total}L + w - 1) div w")
    jobs = jobs.select(F.expr(f"(j * {total}L) div w").alias("t"), "n", (due * F.col("n") + F.col("i")).alias("key"))
    released = jobs.groupBy("t").agg(F.collect_list("key").alias("keys"), F.first("n").alias("n"))
    every = weights.sparkSession.range(slots).select(F.col("id").alias("t")).join(released, "t", "left")
    line = every.agg(F.sort_array(F.collect_list(F.struct("t", F.coalesce("keys", F.array().cast("array<long>")).alias("keys")))).alias("line"), F.max("n").alias("n"))

    def step(state: Column, t: Column) -> Column:
        first = F.array_min(state["wait"])
        later = F.coalesce(F.get(F.col("line"), t + 1)["keys"], F.array().cast("array<long>"))
        return F.struct(F.concat(F.array_remove(state["wait"], first), later).alias("wait"), F.concat(state["order"], F.array(first)).alias("order"))

    none, part = F.array().cast("array<long>"), 256  # slots are taken in parts, as the list of a part is short

    def part_of(state: Column, k: Column) -> Column:
        own = F.sequence(k * part, F.least((k + 1) * part, F.lit(slots)) - 1)
        return F.aggregate(own, F.struct(state["wait"].alias("wait"), none.alias("order")), step, lambda x: F.struct(x["wait"].alias("wait"), F.concat(state["parts"], F.array(x["order"])).alias("parts")))

    start = F.struct(F.col("line")[0]["keys"].alias("wait"), F.array().cast("array<array<long>>").alias("parts"))
    order = F.aggregate(F.sequence(F.lit(0), F.lit((slots - 1) // part)), start, part_of, lambda x: F.flatten(x["parts"]))
    cells = line.select("n", F.posexplode(order).alias("slot", "key")).select((F.col("key") % F.col("n")).cast("int").alias("i"), "slot")
    return cells.groupBy("i").agg(F.sort_array(F.collect_list("slot")).alias("at")).join(each, "i").select("src", "w", F.size("at").cast("long").alias("blocks"), "at")


def in_parts(weights: DataFrame, total: int, parts: int) -> DataFrame:
    """(src, w), whole weights with the sum ``total`` -> (src, w) with the sum ``parts``, at least one each: what is left
    after whole parts goes to the greatest remainders (ties: the smaller name)."""
    n = weights.count()
    exact = weights.select("src", F.expr(f"cast(w as decimal(38,0)) * {parts - n}").alias("x"))
    cut = exact.select("src", F.expr(f"cast(x div {total} as long)").alias("w"), F.expr(f"cast(x % {total} as long)").alias("rest"))
    left = parts - n - (cut.agg(F.sum("w")).first()[0] or 0)
    more = cut.orderBy(F.desc("rest"), "src").limit(left).select("src", F.lit(1).alias("more"))
    return cut.join(more, "src", "left").select("src", (F.col("w") + 1 + F.coalesce("more", F.lit(0))).alias("w"))


def mix_plan(weights: DataFrame, counts: DataFrame, block_docs: int = BLOCK_DOCS, most_slots: int = MOST_SLOTS) -> tuple[DataFrame, int | None]:
    """(plan (src, w, blocks, at), period) for weights (src, weight) and counts (src, docs).

    Where the sum of the whole weights is at most ``most_slots`` (or four for each source), it is the period. Else the
    period is None and the schedule has a slot for every block, if so many slots are enough; and else the period is
    that number of slots, and the weights are rounded to it."""
    whole = checkpoint(whole_weights(weights))
    total, n = whole.agg(F.coalesce(F.sum("w"), F.lit(0)), F.count("*")).first()
    if total > MOST_WEIGHT:
        raise ValueError(f"the weights, as whole numbers without a common factor, have a sum over {MOST_WEIGHT}")
    most = max(most_slots, 4 * n)
    if not n:
        return whole.withColumns({"blocks": F.lit(0).cast("long"), "at": F.lit(None).cast("array<int>")}), 1
    if total <= most:
        return checkpoint(schedule(whole, total, total)), total
    blocks = f"((docs + {block_docs - 1}) div {block_docs})"  # the last of them is due by blocks * total / w, rounded up
    due = F.expr(f"CASE WHEN {blocks} * {float(total)}D / w > {2 * most} THEN {2 * most}L ELSE ({blocks} * {total}L + w - 1) div w END")
    slots = whole.join(counts, "src").agg(F.max(due)).first()[0] or 1
    if slots <= most:
        return checkpoint(schedule(whole, total, int(slots))), None
    return checkpoint(schedule(in_parts(whole, total, most), most, most)), most


def horizon(ends: DataFrame, weight: str, least_live: float) -> DataFrame:
    """One row: the least of ``ends`` at which what has not ended has under least_live of the weight. Null ends never end."""
    ends = ends.groupBy("ends").agg(F.sum(weight).alias("live"))
    gone = F.sum("live").over(Window.orderBy(F.asc_nulls_last("ends")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    over = F.sum("live").over(Window.partitionBy())
    return ends.withColumn("end", F.when(over - gone < over * least_live, F.col("ends"))).agg(F.min("end").alias("end"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, block_docs: int = BLOCK_DOCS, least_live: float = LEAST_LIVE, most_slots: int = MOST_SLOTS, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Every row of docs with its place in the mix: block, slot, slot_pos and in_mix are added (and replaced,
    where docs has columns of these names).

    A source's rows are taken in the order of md5(id), block_docs at a time. slot is the block's slot in the
    schedule and slot_pos the row's place in it, from 0; reading by (slot, slot_pos) is the mix. No row is
    left out: a source that has run dry leaves its slots empty. in_mix is true up to the slot at which the sources
    that still have rows fall below least_live of the weight: to there the target weights hold but for sources run
    dry. weights: (source, weight), whole numbers or decimal ones, exact to the sixth place; default: damped_weights
    of the documents' counts. Where the weights as whole numbers without a common factor have a sum over most_slots and
    the rows need more slots than that, each share is within 1 / most_slots of the mix of what was asked.
    Rows of a source without a weight have null slots and in_mix false. A null source is one source of its own
    (weights may list null); equal weights go by the source's name; repeated rows keep their number, in any order.
    A null id sorts by its row, so that many of them are not one bucket (rows equal in all columns are).
    """
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    own = [F.col(c).cast("string") for c in sorted(docs.columns) if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.xxhash64(*own).cast("string")))
    rows = docs.withColumns({"__src": source, "__key": key}).drop(*(c for c in ("block", "slot", "slot_pos", "in_mix") if c in docs.columns))
    rows = rows.withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))
    buckets = checkpoint(rows.groupBy(F.col("__src").alias("src"), F.col("__bucket").alias("bucket")).agg(F.count("*").alias("n")))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = buckets.groupBy("src").agg(F.sum("n").alias("docs"))
    if weights is None:
        asked = damped_weights(counts)
    else:
        asked = weights.select(F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("src"), F.col("weight"))
    plan, period = mix_plan(asked, counts, block_docs, most_slots)

    def slot_of(block: Column, blocks: Column, at: Column) -> Column:
        if period is None:
            return F.get(at, block.cast("int")).cast("long")
        return F.floor(block / blocks) * period + F.get(at, (block % blocks).cast("int"))

    ends = plan.join(counts, "src").select("w", slot_of(F.floor((F.col("docs") - 1) / block_docs), F.col("blocks"), F.col("at")).alias("ends"))
    end = horizon(ends, "w", least_live)

    place = Window.partitionBy("__src", "__bucket").orderBy("__key", id_col)
    starts = buckets.select(F.col("src").alias("__s1"), F.col("bucket").alias("__b1"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    rows = rows.join(starts, (F.col("__src") == F.col("__s1")) & (F.col("__bucket") == F.col("__b1")))
    rows = rows.withColumn("__rank", F.row_number().over(place) - 1 + F.col("__before"))
    plan = plan.crossJoin(F.broadcast(end)).select(F.col("src").alias("__s2"), F.col("blocks").alias("__blocks"), F.col("at").alias("__at"), F.col("end").alias("__end"))
    rows = rows.join(F.broadcast(plan), F.col("__src") == F.col("__s2"), "left")
    rows = rows.withColumn("block", F.floor(F.col("__rank") / block_docs)).withColumn("slot", slot_of(F.col("block"), F.col("__blocks"), F.col("__at")))
    rows = rows.withColumns({"slot_pos": F.when(F.col("slot").isNotNull(), F.col("__rank") % block_docs), "in_mix": F.coalesce(F.col("slot") <= F.col("__end"), F.lit(False))})
    return rows.drop("__src", "__key", "__bucket", "__s1", "__b1", "__before", "__rank", "__s2", "__blocks", "__at", "__end")


def mix_report(mixed: DataFrame, source_col: str = "source") -> DataFrame:
    """(source, docs, in_mix, left_out) of a table that mix_sources has made: what each source gave and has left."""
    return mixed.groupBy(source_col).agg(F.count("*").alias("docs"), F.count_if("in_mix").alias("in_mix"), F.count_if(~F.col("in_mix")).alias("left_out"))


def mix_sql(block_docs: int = BLOCK_DOCS, least_live: float = LEAST_LIVE, table: str = "documents", weight: str | None = None) -> str:
    """DuckDB SQL for mix_sources with the default weights, or ``weight``, a whole number without a common factor made from
    src, and ids that are not null: CTEs whose last, ``mixed``, has each row's place. Nothing is rounded."""
    damped = f"greatest(1, (raw * {PARTS} + (sum(raw) OVER ())::BIGINT // 2) // (sum(raw) OVER ())::BIGINT)"
    return f"""
    rows_ AS (SELECT *, coalesce('=' || source, '') AS src, md5(doc_id::VARCHAR) AS mkey FROM {table}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY mkey, doc_id) - 1 AS rk FROM rows_),
    counts AS (SELECT src, count(*) AS docs FROM rows_ GROUP BY src),
    raws AS (SELECT src, docs, greatest(1, least(docs, floor((sum(docs) OVER () - docs) * {MOST_OF_OTHERS})))::BIGINT AS raw FROM counts),
    slots AS (SELECT src, docs, ({weight or damped})::BIGINT AS n FROM raws),
    period AS (SELECT sum(n)::BIGINT AS w FROM slots),
    fold(t, done, pick) AS (
      SELECT 0, map_from_entries(list((src, 0::BIGINT))), NULL::VARCHAR FROM slots
      UNION ALL
      SELECT f.t + 1, map_from_entries(list((s.src, f.done[s.src] + CASE WHEN s.src = p.src THEN 1 ELSE 0 END))), any_value(p.src)
      FROM fold f, slots s, LATERAL (
        SELECT x.src FROM slots x, period WHERE (f.done[x.src] * w) // x.n <= f.t
        ORDER BY ((f.done[x.src] + 1) * w + x.n - 1) // x.n, x.src LIMIT 1) p
      WHERE f.t < (SELECT w FROM period) GROUP BY f.t, f.done),
    at_ AS (SELECT pick AS src, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM fold WHERE pick IS NOT NULL),
    ends AS (SELECT s.src, s.n, ((s.docs + {block_docs} - 1) // {block_docs} - 1) // s.n * w + a.slot AS ends
      FROM period, slots s JOIN at_ a ON a.src = s.src AND a.j = ((s.docs + {block_docs} - 1) // {block_docs} - 1) % s.n),
    gone AS (SELECT ends, sum(n) OVER () AS over_, sum(n) OVER (ORDER BY ends RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gone FROM ends),
    horizon AS (SELECT min(ends) AS h FROM gone WHERE over_ - gone < over_ * {least_live}),
    mixed AS (SELECT r.*, r.rk // {block_docs} AS block, (r.rk // {block_docs}) // s.n * w + a.slot AS slot, r.rk % {block_docs} AS slot_pos
      FROM period, ranked r JOIN slots s ON s.src = r.src JOIN at_ a ON a.src = r.src AND a.j = (r.rk // {block_docs}) % s.n)"""

"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in a seeded random order, are cut into blocks; a slot of the mixture takes one block. In the ideal, fluid mixture every source
that isn't used up flows in proportion to its weight; t(v), the sum over sources of min(weight * v, blocks), is the slot reached when
a source of weight w has passed w * v of its blocks. Block i of that source may start at slot floor(t(i / w)), its release, and must be over
by slot ceil(t((i + 1) / w)), its deadline. Earliest deadline first among the released blocks meets all of these windows, so no
source is ever a whole block ahead of or behind the fluid mixture. All rows of all sources are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.shared import cut, table
from tideline.llm.strata import handed_out, ranked, with_key

BLOCK_ROWS = 64
STRETCH = 2048
EXPONENT = 0.5
MARK = "tideline.mixture_place"
ABOVE, BELOW, NEAR = "1.000000000001D", "0.999999999999D", "1e-9D"  # the rounding errors of sums don't move a slot

FLUID = "aggregate(all, cast(0 as double), (x, s) -> x + least(s.w * ({v}), cast(s.n as double)))"
WINDOW = f"""struct(i as i, cast(floor({FLUID.format(v='i / o.w')} * {ABOVE} + {NEAR}) as bigint) as r,
  cast(ceil({FLUID.format(v='(i + 1) / o.w')} * {BELOW} - {NEAR}) as bigint) as d)"""
LEVEL = "transform(array(element_at(filter(bends, e -> e.t <= {slot} + 1e-6D), -1)), e -> e.v + if(e.rate > 0, ({slot} - e.t) / e.rate, 0))[0]"
#: Blocks of each source that the stretch, with what runs into it, can take.
JOBS = f"""transform(all, o -> filter(transform(
    filter(sequence(least(o.n, greatest(0L, cast(floor(o.w * va) as bigint) - 3)), least(o.n, cast(ceil(o.w * vb) as bigint) + 3)), i -> i < o.n), i -> {WINDOW}),
  j -> j.d > a and j.r < b))"""
#: Blocks begun before the stretch and due in it; the earliest due of them are taken to be done, as many as slots are gone.
BEGUN = """slice(array_sort(transform(filter(sequence(0, size(all) - 1), s -> get(jobs[s], 0).r < a), s -> struct(get(jobs[s], 0).d as d, s as s))), 1,
  greatest(0, cast(a - aggregate(sequence(0, size(all) - 1), 0L, (x, s) -> x + coalesce(get(jobs[s], 0).i, all[s].n)) as int))).s"""
PICK = """array_min(transform(filter(sequence(0, size(all) - 1), s -> st.next[s] < size(jobs[s]) and {released}),
  s -> struct(jobs[s][st.next[s]].d as d, s as s))).s"""
STEP = f"""transform(array(coalesce({PICK.format(released='jobs[s][st.next[s]].r <= slot')}, {PICK.format(released='true')})),
  p -> struct(transform(st.next, (x, i) -> x + if(i = p, 1, 0)) as next,
    array_append(st.out, struct(all[p].stratum as stratum, jobs[p][st.next[p]].i as block, slot as slot)) as out))[0]"""
TAKEN = "array<struct<stratum:string,block:bigint,slot:bigint>>"
#: A fold over slots within a fold over hundreds of them, so that what is appended to stays short.
FOLD = f"""aggregate(sequence(a, b - 1, 256L), struct(transform(all, (o, s) -> if(array_contains(begun, s), 1, 0)) as next, cast(array() as array<{TAKEN}>) as out),
  (whole, low) -> transform(array(aggregate(sequence(low, least(low + 256, b) - 1), struct(whole.next as next, cast(array() as {TAKEN}) as out), (st, slot) -> {STEP})),
    part -> struct(part.next as next, array_append(whole.out, part.out) as out))[0]).out"""


def schedule(strata: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(stratum, block, slot) for strata of (stratum, n blocks, w > 0, summing to 1): earliest deadline first over all slots, cut into stretches that tasks fold apart.

    Earliest deadline first forgets: two runs that have filled the same number of slots, with different blocks of those begun done, are alike as soon as all these blocks are due, since each swaps
    its extra block for one due later until both hold the same. A stretch therefore starts one longest window early, from any choice of begun blocks, and its slots are those of one fold over everything.
    The longest window is about 1 / the least weight; stretches are at least as long, so the work is at most doubled. A row holds what one stretch needs of each stratum. No strata give no rows."""
    spark = strata.sparkSession
    one = strata.agg(F.array_sort(F.collect_list(F.struct("stratum", F.col("n").cast("long").alias("n"), F.col("w").cast("double").alias("w")))).alias("all"))  # a source each
    edges = "array_sort(array_union(array(0D), transform(all, s -> s.n / s.w)))"
    rate = "aggregate(filter(all, s -> s.n / s.w > v), 0D, (x, s) -> x + s.w)"
    one = one.withColumn("bends", F.expr(f"transform({edges}, v -> struct(v as v, {FLUID.format(v='v')} as t, {rate} as rate))"))
    one = cut(one.withColumn("slots", F.expr("aggregate(all, 0L, (x, s) -> x + s.n)")).withColumn("longest", F.expr(f"coalesce(array_max(transform(all, o -> {FLUID.format(v='1 / o.w')})), 0D)")), "strata-row")
    slots, longest = one.select("slots", "longest").first()
    early = int(longest) + 3  # windows are longest at the start, as sources only ever leave; rounding adds less than two slots
    long = max(stretch, early)
    at = spark.range(0, slots, long).select(F.greatest(F.lit(0).cast("long"), F.col("id") - early).alias("a"), F.col("id").alias("own"), F.least(F.lit(slots).cast("long"), F.col("id") + long).alias("b"))
    row = at.crossJoin(F.broadcast(one.select("all", "bends"))).withColumn("va", F.expr(LEVEL.format(slot="a"))).withColumn("vb", F.expr(LEVEL.format(slot="b")))  # the broadcast is one row
    folded = f"transform(array({JOBS}), jobs -> transform(array({BEGUN}), begun -> {FOLD})[0])[0]"
    return row.select("own", F.expr(f"inline(flatten({folded}))")).where("slot >= own").drop("own")


def mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = EXPONENT, block_rows: int = BLOCK_ROWS, seed: int = 8, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, weight, block, slot, position) for every row: its source's target weight, the number of its block within the source, the block's slot, and the row's place in
    the mixture, from 0 without gaps.

    weights: source -> target weight, above 0; sources that aren't named, and a null source, have the least weight named. Without weights a source's is its number of rows to the
    power `exponent`, so that large sources are damped. Weights are scaled to a sum of 1. A block has `block_rows` rows at every size of the table; a source's last one may have
    fewer. Equal and null ids are ranked by their digest. Repeated rows have places of their own. An empty table gives an empty result.
    Other columns are ignored. No text is read. A list of all sources goes to each stretch of the schedule, so there may be thousands of them, not millions.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    rows = cut(with_key(rows, seed), "rows")
    total = rows.count()
    per = block_rows
    counts = rows.groupBy("stratum").agg(F.count("*").alias("rows"))
    if weights:
        least = float(min(weights.values()))
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit(f"={k}"), F.lit(float(v)))])
        raw = F.coalesce(named[F.col("stratum")], F.lit(least))
    else:
        raw = F.pow(F.col("rows").cast("double"), F.lit(float(exponent)))
    strata = counts.withColumn("raw", raw).withColumn("n", F.ceil(F.col("rows") / per)).withColumn("w", F.col("raw") / F.sum("raw").over(Window.partitionBy(F.lit(1))))
    strata = cut(strata, "strata")  # a row a source
    plan = schedule(strata.select("stratum", "n", "w")).join(strata, "stratum")
    plan = cut(plan.select("stratum", "block", "slot", "w", F.least(F.lit(per).cast("long"), F.col("rows") - F.col("block") * per).alias("held")), "plan")
    short = plan.where(F.col("held") < per).agg(F.collect_list(F.struct("slot", (per - F.col("held")).alias("less"))).alias("short"))  # a source each, its last block
    less = F.aggregate(F.filter("short", lambda x: x["slot"] < F.col("slot")), F.lit(0).cast("long"), lambda n, x: n + x["less"])
    plan = plan.crossJoin(F.broadcast(short)).select("stratum", "block", "slot", "w", (F.col("slot") * per - less).alias("first"))  # the broadcast is one row
    at = ranked(rows, total, ["doc_id"]).withColumn("block", F.expr(f"cast(rank div {per} as bigint)"))
    return at.join(plan, ["stratum", "block"]).select("doc_id", "source", F.round("w", 9).alias("weight"), "block", "slot", (F.col("first") + F.col("rank") % per).alias("position"))


def free_name(docs: DataFrame, name: str = "mixture_place") -> str:
    """A name that no column of docs has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def place_of(docs: DataFrame) -> str | None:
    """The column that holds the places of a mixture, known by its metadata and not by its name; None if there is none."""
    return next((f.name for f in docs.schema.fields if f.metadata.get(MARK)), None)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, place: str | None = None, **options) -> DataFrame:
    """`docs` as a mixture: the same rows and columns, each partition a sorted stretch of the mixture and partitions in its order. Rows that repeat an id share out its places.

    place: a column to add that holds the row's place in the mixture, from 0 without gaps, marked as such in its metadata, which files keep. With it rows aren't sorted: the column says their order, and later steps can't rely on that of files.
    A place column of an earlier mixture goes. Null ids and ids that repeat share out their places at random; an empty table stays empty; columns may have any other names."""
    docs = docs.select(*[c for c in docs.columns if c != place_of(docs)])
    if place in docs.columns:
        raise ValueError(f"there is a column {place} already: see free_name()")
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    places = cut(mixed_order(docs, weights, **options).select(name.alias("key"), F.expr("position div 65536").alias("lead"), F.col("position").alias("at")), "places")
    both = handed_out(docs, name, places).select("row", F.col("at").alias("position"))
    if place:
        mark = F.col("position").alias(place, metadata={MARK: True})
        return both.select(*[F.col("row")[c].alias(c, metadata=docs.schema[c].metadata) for c in docs.columns], mark)
    return both.repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def op8_pfair_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents by source, with weights as the square roots of the sources' sizes."""
    return mixed_order(table(spark, sf_dir, "documents"))


ORACLE_OP8 = f"""
with recursive
keyed as (select doc_id, source, coalesce('=' || source, '') as stratum, md5('8:' || coalesce(doc_id::varchar, '')) as key from documents),
ranks as (select *, row_number() over (partition by stratum order by key, doc_id) - 1 as rank from keyed),
per as (select {BLOCK_ROWS} as per),
counts as (select stratum, count(*) as rows, power(count(*)::double, {EXPONENT}::double) as raw from keyed group by 1),
strata as (select stratum, rows, (rows + per - 1) // per as n, raw / sum(raw) over () as w, row_number() over (order by stratum) as s from counts cross join per),
blocks as (select s, n, w, unnest(range(n)) as i from strata),
windows as (
  select b.s, b.i, floor(sum(least(o.w * (b.i / b.w), o.n::double)) * 1.000000000001::double + 1e-9::double)::int as r,
    ceil(sum(least(o.w * ((b.i + 1) / b.w), o.n::double)) * 0.999999999999::double - 1e-9::double)::int as d
  from blocks b cross join strata o group by 1, 2),
jobs as (select list(l order by s) as jobs from (select s, list(struct_pack(r := r, d := d) order by i) as l from windows group by 1)),
run(slot, next, pick) as (
  select -1, list_transform(jobs, lambda x: 0), 0 from jobs
  union all
  select slot + 1, list_transform(next, lambda x, i: x + case when i = p.s then 1 else 0 end), p.s
  from (
    select run.slot, run.next,
      list_sort(list_transform(list_filter(range(1, len(jobs) + 1), lambda s: next[s] < len(jobs[s])),
        lambda s: struct_pack(late := case when jobs[s][next[s] + 1].r <= run.slot + 1 then 0 else 1 end, d := jobs[s][next[s] + 1].d, s := s)))[1] as p
    from run cross join jobs)
  where p is not null),
picked as (select slot, pick as s, row_number() over (partition by pick order by slot) - 1 as block from run where slot >= 0),
plan as (
  select stratum, block, slot, w, sum(least(per, rows - block * per)) over (order by slot) - least(per, rows - block * per) as first
  from picked join strata using (s) cross join per)
select r.doc_id, r.source, round(p.w, 9) as weight, p.block::bigint as block, p.slot::bigint as slot, (p.first + r.rank % per.per)::bigint as position
from ranks r cross join per join plan p on r.stratum = p.stratum and r.rank // per.per = p.block
"""

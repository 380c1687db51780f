"""Chat formatting: every participant's view of a dialogue, as DataFrame operations.

For each speaker of a conversation the whole dialogue is put together in turn order
with that speaker as the assistant and the others as named users; `system` turns stay
system turns in every view, and `system` has no view of its own. The mask is made of
the spans [start, end) of the assistant's texts and their line ends, in characters of
the whole view. A marker `<|` within a text or a name is written `<\\|`, so that no
text can open a turn. A view goes in parts of PART turn numbers, or of as many as the
caller says (None: whole), so that a conversation that holds a third of all turns is
gathered by no task; a part tells how many turns and characters of its view stand
before it, and a view's parts in order, those of turns without a number last, make it
up. Null text is empty, a null role is the speaker `unknown`, a null conv_id is one
conversation of its own; repeated rows repeat, ties in the turn number are ordered by
speaker and text. A conversation of system turns alone, and an empty table, give no
rows. Very long texts are whole. Only conv_id, turn, role and text are read.

The turns go through one shuffle, once, whatever the number of participants: what
stands before a part follows from counts of turns by speaker, and a part meets its
participants in the grouping that puts its turns together.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import table

PART = 1000
ASSISTANT, SYSTEM, USER = "<|assistant|>", "<|system|>", "<|user|>"
ORACLE_SQL = f"""
with t as (select conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '<\\|') as speaker, replace(coalesce(text, ''), '<|', '<\\|') as text from conversations),
p as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
r as (select t.conv_id, cast(floor(t.turn / {PART}) as bigint) as part, p.perspective, t.turn, t.speaker, t.text, t.speaker = p.perspective as own,
  case when t.speaker = p.perspective then '{ASSISTANT}' when t.speaker = 'system' then '{SYSTEM}' else '{USER}' || t.speaker end || chr(10) || t.text || chr(10) as rendered
  from t join p on t.conv_id is not distinct from p.conv_id),
o as (select *, count(*) over w as before, cast(coalesce(sum(length(rendered)) over w, 0) as bigint) as place from r
  window w as (partition by conv_id, perspective order by turn nulls last, speaker, text rows between unbounded preceding and 1 preceding))
select conv_id, part, perspective, count(*) as n_turns, min(before) as turns_before, min(place) as chars_before, string_agg(rendered, '' order by place) as rendered,
  coalesce(string_agg(case when own then (place + {len(ASSISTANT) + 1}) || '-' || (place + {len(ASSISTANT) + 2} + length(text)) end, ',' order by place), '') as mask,
  cast(sum(case when own then length(text) + 1 else 0 end) as bigint) as n_masked_chars
from o group by all
"""


def perspectives(turns, part=PART):
    """Per conversation, part and participant: conv_id, part, perspective, n_turns, turns_before, chars_before, rendered, mask (spans), n_masked_chars."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    number = (F.floor(F.col("turn") / part) if part else F.lit(0)).cast("bigint").alias("part")
    t = turns.select("conv_id", number, "turn", safe(F.coalesce("role", F.lit("unknown"))).alias("speaker"), safe(F.coalesce("text", F.lit(""))).alias("text"))
    # characters of a turn in the views of others; in its speaker's own a turn has `longer` more
    mark = F.when(F.col("speaker") == "system", SYSTEM).otherwise(F.concat(F.lit(USER), "speaker"))
    t = t.withColumn("chars", (F.length("text") + F.length(mark) + 2).cast("bigint"))
    longer = lambda view: F.lit(len(ASSISTANT) - len(USER)) - F.length(view)

    spoken = t.groupBy("conv_id", "part", "speaker").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    by_part = spoken.groupBy("conv_id", "part").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.map_from_entries(F.collect_list(F.struct("speaker", "n"))).alias("own"))
    who = spoken.where("speaker <> 'system'").select(F.col("conv_id").alias("c"), F.col("speaker").alias("view")).distinct()
    earlier = Window.partitionBy("conv_id", "view").orderBy(F.col("part").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    in_view = F.col("chars") + F.coalesce(F.col("own")[F.col("view")], F.lit(0)) * longer("view")
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias
    views = by_part.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "part", "view", before(F.col("n"))("turns"), before(in_view)("chars"))

    # turns and views of a part meet in one grouping
    kinds = {"said": "struct<last:boolean,turn:bigint,speaker:string,text:string>", "chars": "bigint", "view": "struct<view:string,turns:bigint,chars:bigint>"}
    rows = lambda df, **has: df.select("conv_id", "part", *(has.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()))
    met = rows(t, said=F.struct(F.col("turn").isNull(), "turn", "speaker", "text"), chars=F.col("chars")).unionAll(rows(views, view=F.struct("view", "turns", "chars")))
    place = F.coalesce(F.sum("chars").over(Window.partitionBy("conv_id", "part").orderBy("said").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = met.select("conv_id", "part", "view", F.when(F.col("said").isNotNull(), F.struct("said", place.alias("place"))).alias("said"))
    gathered = placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("said")).alias("said"), F.collect_list("view").alias("views"))

    each = gathered.select("conv_id", "part", "said", F.explode("views").alias("v")).select("conv_id", "part", "said", "v.*")
    speaker, text = (lambda x: x["said"]["speaker"]), (lambda x: x["said"]["text"])
    own = lambda x: speaker(x) == F.col("view")
    marked = lambda x: F.when(own(x), ASSISTANT).when(speaker(x) == "system", SYSTEM).otherwise(F.concat(F.lit(USER), speaker(x)))
    # each own turn before one in its part moves it by `longer`
    start = lambda x, k: F.col("chars") + x["place"] + k * longer("view") + len(ASSISTANT) + 1
    return each.select(
        "conv_id", "part", F.col("view").alias("perspective"), F.size("said").cast("long").alias("n_turns"), F.col("turns").alias("turns_before"), F.col("chars").alias("chars_before"),
        F.array_join(F.transform("said", lambda x: F.concat(marked(x), F.lit("\n"), text(x), F.lit("\n"))), "").alias("rendered"),
        F.transform(F.filter("said", own), lambda x, k: F.struct(start(x, k).alias("start"), (start(x, k) + F.length(text(x)) + 1).alias("end"))).alias("mask"),
        F.aggregate("said", F.lit(0).cast("long"), lambda n, x: n + F.when(own(x), F.length(text(x)) + 1).otherwise(0)).alias("n_masked_chars"),
    )


def op3_perspectives(spark, sf_dir):
    """All perspectives of every conversation; a mask is written `start-end,start-end`."""
    span = lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))
    return perspectives(table(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(F.transform("mask", span), ","))

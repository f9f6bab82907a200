"""Evaluation reports, grids, argmax labels and the linear head on the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodspark import catalog as cat
from moodspark.functions import text as tx
from moodspark.operators import evaluation as ev
from moodspark.operators import labels as lb
from moodspark.operators import lyrics as ly
from moodspark.operators import scoring as sc
from moodspark.operators import sequences as sq
from moodspark.operators.recommend import daily_counts, dominant
from moodspark.plans import q_sequences as qs
from moodspark.plans.registry import register
from moodspark.plans.sqlbits import scored_lines, tokens_of
from moodspark.session import scratch_path, written
from moodspark.sources.tables import table

# The LM evaluation grid of the source scripts.
GRID_DATASETS = ["merged", "reduced_merged"]
GRID_BATCH_SIZES = [64, 96, 128]
GRID_LR_FACTORS = [3]
GRID_EPOCHS = list(range(1, 11))

LOG_EVERY = 2
QA_BATCH = 32
EVAL_BATCH = 64
CLASSES = 15


_CELLS = [(d, b, lr, e) for d in GRID_DATASETS for b in GRID_BATCH_SIZES for lr in GRID_LR_FACTORS for e in GRID_EPOCHS]
_GRID_VALUES = ", ".join(f"({i}, '{d}', {b}, {lr}, {e})" for i, (d, b, lr, e) in enumerate(_CELLS))
_RUN_NAME_SQL = "dataset || '_batch' || batch_size || '_lr' || lr_factor || '_epoch' || epoch"


def _r6(c):
    return F.round(c, 6)


# ---- Q10: class-mean head ----------------------------------------------------

_HEAD_SQL = """
select label, count(*) filter (where pos = 1) as n, list(m order by pos) as w, -sum(m * m) / 2 as b
from (select label, pos, avg(cast(x as double)) as m, count(*) as c
      from embeddings, unnest(embedding) with ordinality as u(x, pos) where label is not null group by label, pos) h
group by label
"""
_LOGITS_SQL = f"""
select e.vec_id, e.label as truth, h.label, list_sum(list_transform(list_zip(e.embedding, h.w), lambda p: cast(p[1] as double) * p[2])) + h.b as logit
from embeddings e, ({_HEAD_SQL}) h
"""
_PRED_SQL = f"""
select vec_id, truth, cast(label as integer) as pred, logit as max_logit
from (select *, row_number() over (partition by vec_id order by logit desc, label) as rn from ({_LOGITS_SQL}) l) r where rn = 1
"""


def _heads(spark, sf):
    return sc.class_mean_head(table(spark, sf, "embeddings"), "embedding", "label")


def _predictions(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").alias("truth"))
    return sc.head_predictions(emb, _heads(spark, sf), "embedding")


@register("head_fit", """
select label, cast(n as bigint) as n, round(b, 6) as intercept, round(sqrt(-2 * b), 6) as coef_l2
from (select label, max(c) as n, -sum(m * m) / 2 as b
      from (select label, pos, avg(cast(x as double)) as m, count(*) as c
            from embeddings, unnest(embedding) with ordinality as u(x, pos) where label is not null group by label, pos) h
      group by label) g
""")
def head_fit(spark, sf):
    return _heads(spark, sf).select("label", "n", _r6(F.col("b")).alias("intercept"), _r6(F.sqrt(F.col("b") * -2)).alias("coef_l2"))


@register("head_score", f"select vec_id, pred, round(max_logit, 6) as max_logit from ({_PRED_SQL}) p")
def head_score(spark, sf):
    return _predictions(spark, sf).select("vec_id", "pred", _r6(F.col("max_logit")).alias("max_logit"))


# ---- A7 / W1: a head fitted on the training vectors, judged on both sides ------

def _side_sql(content: str) -> str:
    return f"case when ('0x' || substr(md5({content}), 1, 8))::bigint % 5 = 0 then 1 else 0 end"


_SIDES_SQL = f"""
select vec_id, embedding, label, {_side_sql("array_to_string(list_transform(embedding, lambda x: floor(1024 * x::double)::bigint), ',')")} as split
from embeddings
"""
_TRAINED_SQL = f"""
with e as materialized ({_SIDES_SQL}),
h as (select label, list(m order by pos) as w, -sum(m * m) / 2 as b
      from (select label, pos, avg(cast(x as double)) as m
            from e, unnest(embedding) with ordinality as u(x, pos) where label is not null and split = 0 group by label, pos) g group by label),
l as (select e.vec_id, e.split, e.label as truth, h.label as pred,
        list_sum(list_transform(list_zip(e.embedding, h.w), lambda p: cast(p[1] as double) * p[2])) + h.b as logit from e, h),
r as (select *, row_number() over (partition by vec_id order by logit desc, pred) as rn from l),
n as (select split, case when pred = truth then 1 else 0 end as hit, (row_number() over (partition by split order by vec_id) - 1) // {EVAL_BATCH} as batch_id
      from r where rn = 1)
select case split when 0 then 'train' else 'test' end as split, cast(batch_id as bigint) as batch_id, sum(hit) as num, count(*) as den,
       sum(hit) / count(*) as batch_mean
from n group by split, batch_id
"""


def _eval_batches(spark, sf):
    """Predictions of a head fitted on the training side against the labels, in batches of either side."""
    content = F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("string")), ",")
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").alias("truth"), ev.content_split(content).alias("split"))
    heads = sc.class_mean_head(emb.where("split = 0"), "embedding", "truth")
    hits = sc.head_predictions(emb, heads, "embedding").select(
        "vec_id", "split", F.when(F.col("pred") == F.col("truth"), 1).otherwise(0).alias("hit"))
    batched = ev.split_batches(hits, ["vec_id"], EVAL_BATCH).withColumn("split", ev.split_name(F.col("split")))
    return ev.batch_means(batched, ["split", "batch_id"], F.col("hit"))


@register("accuracy_mean_of_batches", f"""
select split, count(*) as n_batches, round(avg(batch_mean), 6) as mean_of_batches, round(sum(num) / sum(den), 6) as overall_mean
from ({_TRAINED_SQL}) b group by split
""")
def accuracy_mean_of_batches(spark, sf):
    m = ev.mean_of_batch_means(_eval_batches(spark, sf), ("split",))
    return m.select("split", "n_batches", _r6("mean_of_batches").alias("mean_of_batches"), _r6("overall_mean").alias("overall_mean"))


@register("accuracy_running", f"""
select split, batch_id, batch_mean, running_mean from (
  select split, batch_id, round(batch_mean, 6) as batch_mean,
         round(avg(batch_mean) over (partition by split order by batch_id rows between unbounded preceding and current row), 6) as running_mean
  from ({_TRAINED_SQL}) b) r
where batch_id % {LOG_EVERY} = 0
""")
def accuracy_running(spark, sf):
    batches = written(_eval_batches(spark, sf), "batches")
    sides = [ev.running_batch_mean(batches.where(F.col("split") == side), "batch_id", LOG_EVERY).withColumn("split", F.lit(side)) for side in ev.SPLITS]
    return sides[0].unionByName(sides[1]).select("split", "batch_id", _r6("batch_mean").alias("batch_mean"), _r6("running_mean").alias("running_mean"))


# ---- A8 / A9: a bigram model fitted on the training rows, judged on both sides ---

_KEYS = ", ".join(qs.KEYS)
_QA_STATS_SQL = f"""
with q as materialized (select *, {_side_sql(f"array_to_string(list_concat(ids, list_transform(range({qs.MAX_LEN_QA} - len(ids)), lambda x: 0)), ' ')")} as split
      from ({qs.QA_IDS_SQL}) x),
o as (select {_KEYS}, split, (row_number() over (partition by split order by {_KEYS}) - 1) // {QA_BATCH} as batch_id from q),
p as (select {_KEYS}, split, i, ids[i] as tok,
             case when i <= q_len then {sq.special_id(cat.MASK_TOKEN)} when i < q_len + a_len then ids[i + 1] else 0 end as lab
      from (select *, unnest(range(1, q_len + a_len + 1)) as i from q) y),
c as (select tok, lab, sum(1 - split) as n from p group by tok, lab),
k as (select lab, sum(n) as n from c group by lab having sum(n) > 0),
t as (select tok, sum(n) as total from c group by tok),
f as (select tok, lab as pred from (select *, row_number() over (partition by tok order by n desc, lab) as rn from c where n > 0) z where rn = 1),
m as (select c.tok, c.lab, coalesce(f.pred, (select lab from k order by n desc, lab limit 1)) as pred,
             1 - (c.n + 1) / (t.total + (select count(*) from k)) as loss
      from c join t using (tok) left join f using (tok))
select case o.split when 0 then 'train' else 'test' end as split, batch_id, count(*) as mask_sum,
       sum(case when m.pred = m.lab then 1 else 0 end) as hits, sum(m.loss) as loss_sum
from p join m on m.tok = p.tok and m.lab = p.lab join o using ({_KEYS}) group by o.split, batch_id
"""


def _qa_stats(spark, sf):
    """Sums per batch: the corpus is encoded once, its rows are written with their place, and all else reads from there."""
    rows = qs.qa_target_rows(spark, sf).select(*qs.KEYS, *qs.ARRAYS).withColumn("split", ev.content_split(F.array_join("token_ids", " ")))
    batched = ev.split_batches(rows, qs.KEYS, QA_BATCH)
    positions = sq.masked_positions(batched, ["split", "batch_id"])
    counted = positions.groupBy("split", "batch_id", "token_id", "label_id").agg(F.count(F.lit(1)).alias("n"))
    model = ev.bigram_model(positions, F.col("split") == 0)
    judged = counted.join(model, ["token_id", "label_id"])
    return ev.masked_sums(judged, ["split", "batch_id"], "pred", "loss", "n").withColumn("split", ev.split_name(F.col("split")))


def _mean_report_sql(num: str) -> str:
    return f"""
select split, count(*) as n_batches, round(avg({num} / mask_sum), 6) as mean_of_batches, round(sum({num}) / sum(mask_sum), 6) as overall_mean
from ({_QA_STATS_SQL}) s group by split
"""


def _mean_report(spark, sf, num):
    m = ev.mean_of_batch_means(ev.batch_means(_qa_stats(spark, sf), ["split", "batch_id"], F.col(num), F.col("mask_sum")), ("split",))
    return m.select("split", "n_batches", _r6("mean_of_batches").alias("mean_of_batches"), _r6("overall_mean").alias("overall_mean"))


@register("accuracy_masked", _mean_report_sql("hits"))
def accuracy_masked(spark, sf):
    return _mean_report(spark, sf, "hits")


@register("loss_masked_mean", _mean_report_sql("loss_sum"))
def loss_masked_mean(spark, sf):
    return _mean_report(spark, sf, "loss_sum")


# ---- J5-J7, X8, Q12 --------------------------------------------------------

def _prompt_preds(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", tx.punct_space("text").alias("prompt"))
    return ly.score_lines(items, cat.FIXTURE_LEXICON, ["item_id"], 15, "prompt", keep_unscored=True)


def _grid_rows(spark, sf):
    grid = ev.param_grid(GRID_DATASETS, GRID_BATCH_SIZES, GRID_LR_FACTORS, GRID_EPOCHS)
    rows = ev.expand_grid(_prompt_preds(spark, sf), grid)
    return rows.withColumn("run_name", ev.run_name(F.col("dataset"), F.col("batch_size"), F.col("lr_factor"),
                                                   F.col("epoch")))


_PROMPT_PRED_SQL = f"""
select b.item_id, s.pred from benchmark b
left join ({scored_lines("select item_id, 1 as line_no, regexp_replace(text, '[?.!,]', ' ', 'g') as line from benchmark", "item_id")}) s
  on b.item_id = s.item_id
"""


@register("eval_grid", f"""
select {_RUN_NAME_SQL} as run_name, p.item_id, cast(p.pred as integer) as pred
from (values {_GRID_VALUES}) g(cell, dataset, batch_size, lr_factor, epoch), ({_PROMPT_PRED_SQL}) p
""")
def eval_grid(spark, sf):
    return _grid_rows(spark, sf).select("run_name", "item_id", "pred")


@register("eval_grid_missing", f"""
select {_RUN_NAME_SQL} as run_name, (select count(*) from benchmark) as n_prompts_skipped
from (values {_GRID_VALUES}) g(cell, dataset, batch_size, lr_factor, epoch)
where not exists (select 1 from ({_PROMPT_PRED_SQL}) p where p.pred = g.cell % {CLASSES})
""")
def eval_grid_missing(spark, sf):
    """A sink writes one folder of hits per run, the files below it are listed, and runs without any are reported.

    Cell k looks for class k mod 15 among the predictions; without a hit there is nothing to write.
    """
    cells = spark.range(1).select(F.posexplode(ev.param_grid(GRID_DATASETS, GRID_BATCH_SIZES, GRID_LR_FACTORS, GRID_EPOCHS)).alias("cell", "cfg")).select(
        "cell", ev.run_name(F.col("cfg.dataset"), F.col("cfg.batch_size"), F.col("cfg.lr_factor"), F.col("cfg.epoch")).alias("run_name"))
    hits = _prompt_preds(spark, sf).join(F.broadcast(cells), F.col("pred") == F.col("cell") % CLASSES)  # the grid is a literal
    path = scratch_path(spark, "artifacts")
    ev.write_artifacts(hits.select("run_name", "item_id", "pred"), path)
    prompts = table(spark, sf, "benchmark").agg(F.count(F.lit(1))).scalar()
    return ev.missing_runs(cells, ev.listed_artifacts(spark, path)).select("run_name", prompts.alias("n_prompts_skipped"))


@register("prompt_labels", f"""
select item_id, cast(pos as integer) as pos, z[1] as prompt, z[2] as token
from (select item_id, list_zip(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, '{tx.PY_WHITESPACE}')),
                                           lambda x: x <> ''), {tokens_of('text')}) as zs from benchmark) b,
     unnest(zs) with ordinality as u(z, pos)
""")
def prompt_labels(spark, sf):
    """Two lists of different lengths side by side; the shorter one ends in NULLs."""
    items = table(spark, sf, "benchmark").select("item_id", tx.text_lines("text").alias("ls"), tx.whitespace_tokens("text").alias("ts"))
    zipped = ev.zip_positional(F.col("ls"), F.col("ts"), ("prompt", "token"))
    return items.select("item_id", F.posexplode(zipped).alias("p", "z")).select(
        "item_id", (F.col("p") + 1).cast("int").alias("pos"), "z.prompt", "z.token")


# ---- T3 / X5 ---------------------------------------------------------------

_FIFTEEN_VALUES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(cat.FIFTEEN_BERT))


@register("argmax_label", f"""
select vec_id, pred, c.name as pred_name, printf('{cat.RESULT_SENTENCE}', c.name) as sentence
from (select vec_id, pred from ({_PRED_SQL}) p) e
left join (values {_FIFTEEN_VALUES}) c(id, name) on e.pred = c.id
""")
def argmax_label(spark, sf):
    """The largest of all logits of the fitted head, under its class name."""
    preds = _predictions(spark, sf).select("vec_id", "pred")
    named = lb.display_name(preds, "pred", cat.catalog_df(spark, "fifteen_bert"), "pred_name")
    return named.select("vec_id", "pred", "pred_name", lb.label_sentence(F.col("pred_name")).alias("sentence"))


# ---- A11 -------------------------------------------------------------------

@register("daily_emotion", f"""
select user_id, day, {", ".join(f"n_{t}" for t in cat.EVENT_TYPES)},
       case {" ".join(f"when n_{t} = greatest({', '.join(f'n_{u}' for u in cat.EVENT_TYPES)}) then '{t}'" for t in cat.EVENT_TYPES)} end
         as dominant
from (select user_id, strftime(cast(ts as date), '%Y-%m-%d') as day,
             {", ".join(f"cast(sum(case when event_type = '{t}' then 1 else 0 end) as bigint) as n_{t}" for t in cat.EVENT_TYPES)}
      from events group by all) d
""")
def daily_emotion(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_type")
    counts = daily_counts(events, "user_id", "ts", "event_type", cat.EVENT_TYPES)
    return counts.withColumn("dominant", dominant(cat.EVENT_TYPES))

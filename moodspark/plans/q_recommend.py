"""R1 cosine recommendation on the fixture: every embedding is a profile and
every other embedding a candidate song."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodspark.operators.recommend import cosine_topk
from moodspark.plans.registry import register
from moodspark.sources.tables import table

TOP_K = 5


@register("recommend_topk", f"""
select query_id, cast(rk as integer) as rank, item_id, round(score, 6) as score from (
  select query_id, item_id, score,
         row_number() over (partition by query_id order by round(score, 9) desc, item_id) as rk
  from (select q.vec_id as query_id, i.vec_id as item_id,
               list_cosine_similarity(cast(q.embedding as double[]), cast(i.embedding as double[])) as score
        from embeddings q, embeddings i where q.vec_id <> i.vec_id) s
  where score is not null) r
where rk <= {TOP_K}
""")
def recommend_topk(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    top = cosine_topk(emb, emb, TOP_K, exclude_self=True)
    return top.select("query_id", "rank", "item_id", F.round("score", 6).alias("score"))

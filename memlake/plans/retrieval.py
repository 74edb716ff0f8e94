"""Searches and what follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.operators import retrieval as R
from memlake.operators import search as S
from memlake.operators import segments as G
from memlake.plans import query
from memlake.shared import exists, fingerprint, shared_folder
from memlake.sources.tables import load, messages

QUERY, RARE, MISSING = "the reation", "hein inenan", "hein zzqqzz"
AS_OF = "2024-02-01 00:00:00"
_BM25 = r"""
t as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
c as (select doc_id, len(w) as dl, len(list_filter(w, lambda x: x = '%s')) as a, len(list_filter(w, lambda x: x = '%s')) as b from t),
s as (select count(*) as n, avg(dl) as avgdl, count(*) filter (where a > 0) as na, count(*) filter (where b > 0) as nb, count(*) filter (where a > 0 and b > 0) as nab from c),
kw as (select doc_id, round(-(greatest(1e-6, ln((n - na + 0.5) / (na + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + greatest(1e-6, ln((n - nb + 0.5) / (nb + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from c, s where (a > 0 and b > 0) or (nab = 0 and (a > 0 or b > 0)) order by score, doc_id limit %d)"""
_KNN = "nn as (select vec_id as doc_id, round(list_distance(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)), 6) as distance from embeddings order by distance, doc_id limit %d)"


_indexes: dict[tuple, S.Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> S.Index:
    """The index of the documents: built by the first search in an application, and anew when the files have changed."""
    key = spark.sparkContext.applicationId, fingerprint(spark, f"{sf_dir}/documents.parquet")
    if key not in _indexes or not exists(spark, _indexes[key].uri):
        _indexes[key] = S.build(load(spark, sf_dir, "documents"), shared_folder(spark, "index"))
    return _indexes[key]


def _bm25(spark: SparkSession, sf_dir: str, query: str, k: int) -> DataFrame:
    return S.bm25(spark, index_of(spark, sf_dir), query, k)


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    row = load(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else [0.0] * 64


@query(r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents), t as (select doc_id, unnest(w) as term, len(w) as dl from w)
select term, count(*) as tf, count(distinct doc_id) as df, sum(dl) as lengths from t group by 1
""")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index that the searches read, and what it holds of each term."""
    posted = spark.read.parquet(f"{index_of(spark, sf_dir).uri}/postings")
    return posted.groupBy("term").agg(F.sum(F.size("at").cast("long")).alias("tf"), F.count("*").alias("df"), F.sum(F.size("at") * F.col("dl").cast("long")).alias("lengths"))


#: The documents after the batches of kept_up: those that came late are there, the withheld are changed, the rejected gone but for those that came back.
_KEPT_UP = r"""
l as (select doc_id, min(quality) as quality, max(toxic) as toxic from labels group by 1),
final as (
  select doc_id, case when toxic = 1 then 'the reation was withheld. ' || coalesce(text, '') else text end as text
  from documents left join l using (doc_id) where quality is distinct from 0 or toxic = 1
), w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from final)"""


def kept_up(spark: SparkSession, sf_dir: str) -> G.SegmentedIndex:
    """An index of the documents after four batches: all but those of one language; those, and the toxic ones withheld; without any that were rated bad; the toxic ones among them again."""
    key = "kept up", spark.sparkContext.applicationId, fingerprint(spark, f"{sf_dir}/documents.parquet")
    if key not in _indexes or not exists(spark, _indexes[key].uri):
        docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
        rated = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        late = F.coalesce(F.col("lang"), F.lit("")) == "de"
        toxic = docs.join(rated.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").withColumn("text", F.concat(F.lit("the reation was withheld. "), F.coalesce("text", F.lit(""))))
        index = G.SegmentedIndex(spark, shared_folder(spark, "segments"))
        index.apply(docs.where(~late))
        index.apply(docs.where(late).join(toxic, "doc_id", "left_anti").select("doc_id", "text").unionByName(toxic.select("doc_id", "text")))
        index.apply(docs.limit(0), rated.where("quality = 0").select("doc_id"))
        index.apply(toxic.join(rated.where("quality = 0"), "doc_id", "left_semi"))
        _indexes[key] = index
    return _indexes[key]


@query(f"""
with {_KEPT_UP}
select term, count(*)::bigint as df from (select unnest(list_distinct(w)) as term from w) group by 1
""")
def index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each term after batches of adds, changes and deletes: sums over segments, none of which was written again."""
    return kept_up(spark, sf_dir).terms()


@query(f"with {_KEPT_UP}, {_BM25 % ('the', 'reation', 20)} select * from kw".replace("t as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents)", "t as (select * from w)"))
def index_upkeep_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over the segments finds what a full index of the final documents would."""
    return kept_up(spark, sf_dir).bm25(QUERY, 20).withColumnRenamed("id", "doc_id")


@query(f"""
with {_KEPT_UP}
select term, count(*)::bigint as tf, count(distinct doc_id) as df, sum(dl)::bigint as lengths from (select doc_id, unnest(w) as term, len(w) as dl from w) group by 1
""")
def index_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the postings of the merged segments hold of each term."""
    index = kept_up(spark, sf_dir)
    index.merge(all_of_them=True)
    return index.found().groupBy("term").agg(F.sum(F.size("at").cast("long")).alias("tf"), F.count("*").alias("df"), F.sum(F.size("at") * F.col("dl").cast("long")).alias("lengths"))


@query(f"with {_BM25 % ('the', 'reation', 20)} select * from kw")
def fts_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, QUERY, 20)


@query(f"with {_BM25 % ('hein', 'zzqqzz', 20)} select * from kw")
def fts_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, MISSING, 20)


@query(r"""
with t as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
c as (select doc_id, len(w) as dl, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' and w[i + 1] = 'the')) as a from t),
s as (select count(*) as n, avg(dl) as avgdl, count(*) filter (where a > 0) as na from c)
select doc_id, round(-(greatest(1e-6, ln((n - na + 0.5) / (na + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from c, s where a > 0 order by score, doc_id limit 20
""")
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, "of-the", 20)


@query(f"with {_KNN % 20} select doc_id as vec_id, distance from nn")
def knn_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.knn(load(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 20)


@query("select vec_id, round(1 - list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)), 6) as distance from embeddings order by distance, vec_id limit 20")
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.knn(load(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 20, metric="cosine")


@query("""
select * from (select q.vec_id as query_id, e.vec_id, round(list_distance(e.embedding::double[], q.embedding::double[]), 6) as distance,
  row_number() over (partition by q.vec_id order by round(list_distance(e.embedding::double[], q.embedding::double[]), 6), e.vec_id) as rank from embeddings e, embeddings q where q.vec_id % 50 = 0) where rank <= 5
""")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 50, against all."""
    vectors = load(spark, sf_dir, "embeddings")
    return R.knn_batch(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query(f"with {_KNN % 10} select * from nn where (select min(distance) from nn) <= 0.80")
def knn_distance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing at all if even the nearest is too far."""
    hits = R.knn(load(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10).withColumnRenamed("vec_id", "doc_id")
    gate = hits.agg(F.min("distance").alias("nearest"))
    return hits.join(F.broadcast(gate), F.col("nearest") <= R.NEAREST_GATE).drop("nearest")


_FUSED = f"""{_KNN % 20}, {_BM25 % ('the', 'reation', 20)},
l as (select doc_id, 0 as i, row_number() over (order by distance, doc_id) - 1 as rank from nn union all select doc_id, 1, row_number() over (order by score, doc_id) - 1 from kw),
f as (select doc_id, round(sum(1.0 / (60 + rank + 1)), 8) as fused, min(rank) filter (where i = 0) as r0, min(rank) filter (where i = 1) as r1 from l group by 1)"""
_HYBRID = f"{_FUSED}, h as (select doc_id, round(fused / (select max(fused) from f), 6) as score, r0, r1 from f order by fused desc, r0 nulls last, r1 nulls last, doc_id limit 10)"


@query(f"with {_FUSED} select * from f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = R.ranked(R.knn(load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), _vector(spark, sf_dir), 20, "doc_id"), [F.col("distance"), F.col("doc_id")], "vector")
    words = R.ranked(_bm25(spark, sf_dir, QUERY, 20), [F.col("score"), F.col("doc_id")], "keyword")
    return R.rrf([near, words], "doc_id", (1.0, 1.0))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hybrid_search(spark, index_of(spark, sf_dir), load(spark, sf_dir, "embeddings"), QUERY, _vector(spark, sf_dir), 10)


@query(f"with {_HYBRID} select h.*, d.lang, d.source from h join documents d using (doc_id)")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


@query(f"""
with {_HYBRID}, e as (select user_id as doc_id, epoch(timestamp '{AS_OF}' - max(ts)) / 86400.0 as age, least(10, greatest(1, 3 + count(*) / 20.0)) as salience from events group by 1)
select doc_id, round(score + 0.15 * coalesce(exp(-0.01 * age), 0.5) + 0.10 * coalesce(exp(-0.01 * age), 0.5) + 0.10 * coalesce(salience, 3) / 10, 4) as score from h left join e using (doc_id)
""")
def three_axis_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.max(F.col("ts").cast("timestamp")))) / 86400e6
    seen = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(age.alias("age"), F.least(F.lit(10.0), F.greatest(F.lit(1.0), 3 + F.count("*") / 20.0)).alias("salience"))
    hits = _hits(spark, sf_dir).join(seen, "doc_id", "left")
    return hits.select("doc_id", F.round(R.three_axis(F.col("score"), F.col("age"), F.coalesce("salience", F.lit(3.0))), 4).alias("score"))


@query(rf"""
with {_HYBRID} select doc_id, round(0.7 * score + 0.3 * len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')), ['the', 'reation'])) / 2, 6) as score from h join documents using (doc_id)
""")
def token_overlap_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return hits.select("doc_id", F.round(R.overlap_rerank(F.col("score"), F.col("text"), QUERY), 6).alias("score"))


@query("""
with h as (select conv_id, turn, turn = 0 as digest from conversations where turn = 0 or (conv_id % 2 = 0 and turn = 3))
select * from h where not digest or conv_id not in (select conv_id from h where not digest)
""")
def cluster_digest_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns stand for digests of their conversation."""
    hits = load(spark, sf_dir, "conversations").where("turn = 0 or (conv_id % 2 = 0 and turn = 3)").select("conv_id", "turn", (F.col("turn") == 0).alias("digest"))
    return R.without_digests(hits, "conv_id", "digest")


_QUALITY = """
with q as (select vec_id, label, embedding::double[] as v from embeddings where vec_id % 50 = 0), n as (select label, count(*) - 1 as n_relevant from embeddings group by 1),
r as (select q.vec_id as query_id, q.label, row_number() over (partition by q.vec_id order by round(list_distance(e.embedding::double[], q.v), 6), e.vec_id) as rank, (e.label = q.label)::int as relevant from q, embeddings e where e.vec_id <> q.vec_id),
h as (select r.*, n_relevant from r join n using (label) where rank <= 10)
"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every vector whose id is divisible by 50, relevant if of its label; the query itself left out."""
    vectors = load(spark, sf_dir, "embeddings")
    labels = vectors.select("vec_id", "label")
    near = R.knn_batch(vectors, vectors.where("vec_id % 50 = 0"), 11).where("vec_id <> query_id")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where("rank <= 10")
    hits = near.join(labels, "vec_id").join(labels.toDF("query_id", "wanted"), "query_id").withColumn("relevant", (F.col("label") == F.col("wanted")).cast("int"))
    sizes = labels.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("n_relevant"))
    return hits.join(sizes, "wanted")


@query(_QUALITY + "select query_id, round(sum(relevant) / max(n_relevant), 6) as recall, round(coalesce(1.0 / min(rank) filter (where relevant = 1), 0), 6) as reciprocal_rank from h group by 1")
def recall_at_k_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranking_quality(_judged(spark, sf_dir), 10).drop("ndcg")


@query(_QUALITY + "select query_id, round(sum(case when relevant = 1 then 1 / log2(rank + 1) else 0 end) / list_sum(list_transform(range(1, least(10, max(n_relevant)) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg from h group by 1")
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranking_quality(_judged(spark, sf_dir), 10).select("query_id", "ndcg")


@query("select conv_id as thread_id, min(turn) as best, count(*) as n, list_sort(list(turn))::varchar as positions from conversations where contains(lower(text), 'tion') group by 1")
def group_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = messages(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("tion")))
    positions = F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("position")), ", "), F.lit("]"))
    return hits.groupBy("thread_id").agg(F.min("position").alias("best"), F.count("*").alias("n"), positions.alias("positions"))


@query("""
with h as (select conv_id, turn from conversations where turn = 1 or turn = 5), w as (select distinct conv_id, unnest(range(turn - 1, turn + 2)) as turn from h),
f as (select c.conv_id, c.turn, case when c.turn - lag(c.turn) over (partition by c.conv_id order by c.turn) > 1 then '[...]' || chr(10) || text else text end as piece from conversations c join w using (conv_id, turn))
select conv_id as thread_id, string_agg(piece, chr(10) order by turn) as text, count(*) as n_chunks from f group by 1
""")
def window_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).select("thread_id", "position", "text")
    return R.windows(m.where("position = 1 or position = 5"), m, "thread_id", "position", 1)


@query("""
select conv_id as thread_id, turn as position, row_number() over (partition by conv_id order by case when turn % 2 = 0 then turn else 1000000 - turn end) - 1 as place from conversations
""")
def head_tail_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ranks ascending, then odd ranks descending: the best stand at both ends."""
    key = F.when(F.col("position") % 2 == 0, F.col("position")).otherwise(1_000_000 - F.col("position"))
    return messages(spark, sf_dir).select("thread_id", "position", (F.row_number().over(Window.partitionBy("thread_id").orderBy(key)) - 1).alias("place"))


@query("""
select source, doc_id, used from (select source, doc_id, sum(least(length(text), 200)) over (partition by source order by n_chars desc, doc_id rows unbounded preceding) as used from documents) where used <= 2000
""")
def budget_running_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.least(F.char_length("text"), F.lit(200)).alias("size"))
    return R.stop_at_budget(docs, ["source"], [F.desc("n_chars"), F.asc("doc_id")], F.col("size"), 2000).select("source", "doc_id", "used")


@query("""
select conv_id as thread_id, string_agg(upper(role) || ': ' || text, chr(10) order by turn) as text, count(*) as n, max(turn) - min(turn) + 1 = count(*) as complete from conversations group by 1
""")
def thread_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("position", F.concat(F.upper("role"), F.lit(": "), "text").alias("t"))))
    return messages(spark, sf_dir).groupBy("thread_id").agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"), F.count("*").alias("n"), (F.max("position") - F.min("position") + 1 == F.count("*")).alias("complete")
    )


@query("select conv_id as thread_id, sha256(string_agg(turn || chr(31) || sha256(text), chr(30) order by turn)) as signature from conversations group by 1")
def thread_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("position", F.concat(F.col("position").cast("string"), F.lit("\x1f"), F.sha2("text", 256)).alias("t"))))
    return messages(spark, sf_dir).groupBy("thread_id").agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["t"]), "\x1e"), 256).alias("signature"))


_TERMS = r"""
t as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents), st as (select count(*) as n, avg(len(w)) as avgdl from t),
tf as (select doc_id, i, len(w) as dl, len(list_filter(w, lambda x: x = term)) as a from t, q), df as (select i, count(*) filter (where a > 0) as d from tf group by 1),
al as (select doc_id, min(a) > 0 as each_one, max(a) > 0 as any_one from tf group by 1), na as (select count(*) filter (where each_one) as n_all from al),
kw as (select doc_id, round(-sum(greatest(1e-6, ln((n - d + 0.5) / (d + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from tf join df using (i) join al using (doc_id), st, na where each_one or (n_all = 0 and any_one) group by doc_id order by score, doc_id limit 20),
l as (select doc_id, 0 as i, row_number() over (order by distance, doc_id) - 1 as rank from nn union all select doc_id, 1, row_number() over (order by score, doc_id) - 1 from kw),
f as (select doc_id, round(sum(1.0 / (60 + rank + 1)), 8) as fused, min(rank) filter (where i = 0) as r0, min(rank) filter (where i = 1) as r1 from l group by 1),
h as (select doc_id, round(fused / (select max(fused) from f), 6) as score from f order by fused desc, r0 nulls last, r1 nulls last, doc_id limit 10)
"""


def _route(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Entities: part names, the first part of each; neighbours: those whose first parts follow or precede it; communities: regions, their nations the summary."""
    parts = load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    near = parts.select("id").join(parts.select(F.col("id").alias("other")), F.col("other").between(F.col("id") + 1, F.col("id") + 3)).select(F.col("id").alias("entity_a"), F.col("other").alias("entity_b"), F.col("other").alias("position"))
    nations = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), " ").alias("summary"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return S.route(spark, index_of(spark, sf_dir), load(spark, sf_dir, "embeddings"), docs, query, _vector(spark, sf_dir), 10, parts, near, nations.withColumnRenamed("n_regionkey", "community_id"), only_seeded=True)


@query(rf"""
with e as (select p_name as name, min(p_partkey) as id from part group by 1), x as (select id from e where lower(name) in ('reation', 'small', 'ring', 'reation small', 'small ring', 'reation small ring') order by length(name) desc, name limit 1),
ns as (select name from e where abs(id - (select id from x)) between 1 and 3 order by case when id < (select id from x) then (select id from x) else id end, id limit 5),
q as (select row_number() over () as i, term from (select unnest(string_split('reation small ring ' || (select string_agg(name, ' ') from ns), ' ')) as term)),
{_KNN % 20}, {_TERMS}
select doc_id::varchar as doc_id, round(0.7 * score + 0.3 * len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{3,}}')), ['reation', 'ring', 'small'])) / 3, 4) as score, 'graph_seeded' as provenance from h join documents using (doc_id)
""")
def search_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question that names an entity, seeded with its neighbours, re-ranked; without neighbours there are no keywords, as in SQL."""
    return _route(spark, sf_dir, "reation small ring")


@query(rf"""
with q as (select * from (values (1, 'what'), (2, 'the'), (3, 'reation')) v(i, term)), {_KNN % 20}, {_TERMS}
select doc_id::varchar as doc_id, round(0.7 * score + 0.3 * len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{3,}}')), ['what', 'the', 'reation'])) / 3, 4) as score, null::varchar as provenance from h join documents using (doc_id)
""")
def search_route_thematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A broad question: summaries come after the hits, within the limit."""
    return _route(spark, sf_dir, "what the reation")


@query(r"""
with h as (select doc_id::varchar as doc_id, row_number() over (order by n_chars desc, doc_id) - 1 as place from documents qualify place < 5),
c as (select n_regionkey as id, len(list_intersect(list(lower(n_name)), ['list', 'france', 'and', 'germany', 'kenya'])) / 6.0 as overlap from nation group by 1)
select doc_id, round(1.0 / (place + 1), 4) as score, null::varchar as provenance, place from h
union all select 'community:' || id, round((select max(overlap) from c) * 0.5, 4), 'community_summary', 1000000 + row_number() over (order by overlap desc, id) - 1 from c where overlap > 0
""")
def community_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest five documents, then the regions whose nations the question names."""
    top = load(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(5).select("doc_id", "n_chars")
    place = F.row_number().over(R.over(F.desc("n_chars"), F.col("doc_id"))) - 1
    hits = top.withColumn("place", place).select("doc_id", F.round(1.0 / (F.col("place") + 1), 4).alias("score"), F.lit(None).cast("string").alias("provenance"), "place")
    nations = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), " ").alias("summary"))
    return S.community_augment(hits, nations.withColumnRenamed("n_regionkey", "community_id"), "list France and Germany, Kenya", 8)

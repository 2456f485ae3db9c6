"""Queries that sample, cap, balance and split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import held_out
from ..operators import sampling as K
from ..operators.scale import hash_positions
from ..sources import derived as S
from ..sources.tables import table
from .oracle import CASES, DECISIONS, order_of, u
from .registry import query, rounded

DEC = "WITH " + DECISIONS
CAS = "WITH " + CASES


def rank_sql(seed, *ids, by=""):
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY {order_of(seed, *ids)},{','.join(ids)})"


@query(f"SELECT doc_id,n_chars FROM documents WHERE n_chars BETWEEN 20 AND 1500 QUALIFY {rank_sql('s1', 'doc_id')}<=300")
def uniform_sample(spark, d):
    """300 documents of 20 to 1,500 characters."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return K.sample_rows(docs, 300, ["doc_id"], "s1", F.col("n_chars").between(20, 1500))


@query(f"""WITH r AS (SELECT l.*,toxic=1 AS f,row_number() OVER (PARTITION BY toxic=1 ORDER BY {order_of('s2', 'doc_id')},doc_id) AS rn FROM labels l),a AS (SELECT least(count(*),100) AS a FROM labels WHERE toxic=1)
 SELECT doc_id,quality,toxic FROM r,a WHERE rn<=CASE WHEN f THEN a ELSE 200-a END""")
def two_class_balance(spark, d):
    """Half toxic; the clean half also fills what the toxic half lacks."""
    return K.two_class_sample(table(spark, d, "labels"), F.col("toxic") == 1, 200, ["doc_id"], "s2")


MIX = DEC + f""", t AS (SELECT *,{u('family')}<0.1 AND family LIKE 'syn%' AS held FROM decisions), s AS (SELECT *,CASE WHEN held THEN 'held-out' WHEN family LIKE 'syn%' THEN 'synthetic' WHEN family LIKE 'sni%' THEN 'collection' ELSE 'other' END AS share FROM t),
 c AS (SELECT row_id,family,share,{rank_sql('mix', 'row_id', by='family')} AS rn FROM s), m AS (
 SELECT row_id,family,share FROM c WHERE (share='collection' AND rn<=40) OR (share='other' AND rn<=3000) OR share='held-out' OR share='synthetic'
 UNION ALL SELECT row_id||'~1',family,share FROM c WHERE share='synthetic')"""


def _mixed(spark, d):
    rows = S.decisions(spark, d).select("row_id", "family", "task_type")
    rows = rows.withColumn("holdout_family", held_out("family") & F.col("family").startswith("syn_"))
    return K.mix(rows, "mix", cap_collection=40, cap_other=3000, repeat=2)


@query(MIX + " SELECT * FROM m")
def capped_mix(spark, d):
    """Family caps by class, generated rows twice, held-out families whole."""
    return _mixed(spark, d).select("row_id", "family", "share")


@query(MIX + " SELECT share,count(*) AS n,CASE WHEN share<>'held-out' THEN round(count(*)/(SELECT count(*) FROM m WHERE share<>'held-out'),6) END AS part FROM m GROUP BY share")
def mix_share(spark, d):
    return rounded(K.mix_share(_mixed(spark, d)))


@query(f"SELECT event_id,event_type FROM events QUALIFY {rank_sql('q', 'event_id', by='event_type')}<=CASE event_type WHEN 'error' THEN 90 WHEN 'click' THEN 60 WHEN 'view' THEN 30 ELSE 0 END")
def quota_per_source(spark, d):
    """90 / 60 / 30 rows of three sources; fails when a source is short."""
    ev = table(spark, d, "events").select("event_id", "event_type")
    return K.quota_sample(ev, {"error": 90, "click": 60, "view": 30}, "event_type", ["event_id"], "q")


@query(f"SELECT doc_id,source,made FROM (SELECT doc_id,source,{rank_sql('cap', 'doc_id', by='source')}-1 AS made FROM documents) WHERE made<20")
def capped_with_dense_ids(spark, d):
    return K.capped_and_numbered(table(spark, d, "documents").select("doc_id", "source"), 20, ["source"], ["doc_id"], "cap")


@query(DEC + f" SELECT row_id,family,gold FROM decisions QUALIFY {rank_sql('bal', 'row_id', by='family,gold')}<=ceil(500.0/len(keys))")
def balanced_answers(spark, d):
    rows = S.decisions(spark, d).select("row_id", "family", "gold", "n_options")
    return K.balanced_by_quota(rows, 500, ["family"], "gold", "n_options", ["row_id"], "bal").select("row_id", "family", "gold")


@query(DEC + f""", c AS (SELECT family,gold,count(*) AS n FROM decisions GROUP BY ALL),f AS (SELECT family,min(n) AS q FROM c GROUP BY 1),r AS (SELECT row_id,family,gold,{rank_sql('rare', 'row_id', by='family,gold')} AS rn FROM decisions)
 SELECT row_id,family,gold FROM r JOIN f USING (family) WHERE rn<=q""")
def downsample_to_rarest(spark, d):
    return K.downsample_to_rarest(S.decisions(spark, d).select("row_id", "family", "gold"), ["family"], "gold", ["row_id"], "rare")


@query(CAS + f", f AS (SELECT DISTINCT slice,family_id FROM cases),k AS (SELECT slice,family_id FROM f QUALIFY {rank_sql('fam', 'family_id', by='slice')}<=50) SELECT case_id,slice,family_id FROM cases JOIN k USING (slice,family_id)")
def family_sample(spark, d):
    """50 families per slice with all their cases."""
    c = S.cases(spark, d).select("case_id", "slice", "family_id")
    return K.family_sample(c, 50, "slice", "family_id", "fam")


@query(CAS + f""", f AS (SELECT DISTINCT slice,family_id FROM cases),k AS (SELECT slice,family_id FROM f QUALIFY {rank_sql('fam', 'family_id', by='slice')}<=50),
 k2 AS (SELECT slice,family_id FROM f WHERE family_id NOT IN (SELECT family_id FROM k) QUALIFY {rank_sql('dev', 'family_id', by='slice')}<=30) SELECT case_id,slice,family_id FROM cases JOIN k2 USING (slice,family_id)""")
def family_sample_excluding(spark, d):
    """A second family sample that shares no family with the first."""
    c = S.cases(spark, d).select("case_id", "slice", "family_id")
    return K.family_sample(c, 30, "slice", "family_id", "dev", exclude=K.family_sample(c, 50, "slice", "family_id", "fam"))


@query(CAS + f""", f AS (SELECT slice,family_id,count(*) AS size FROM cases GROUP BY ALL),p AS (SELECT greatest(1,480//count(DISTINCT slice)) AS per FROM f),
 b AS (SELECT slice,family_id,coalesce(sum(size) OVER (PARTITION BY slice ORDER BY {order_of('strat', 'family_id')},family_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM f)
 SELECT case_id,slice,family_id FROM cases JOIN (SELECT slice,family_id FROM b,p WHERE before<per) USING (slice,family_id)""")
def stratified_families(spark, d):
    return K.stratified_families(S.cases(spark, d).select("case_id", "slice", "family_id"), 480, "slice", "family_id", "strat")


@query(CAS + " SELECT case_id,slice FROM cases QUALIFY row_number() OVER (PARTITION BY slice ORDER BY case_id)<=25")
def first_per_slice(spark, d):
    return K.first_per_group(S.cases(spark, d).select("case_id", "slice"), 25, "slice", ["case_id"])


@query(CAS + f" SELECT case_id,slice FROM cases QUALIFY {rank_sql('lat', 'case_id', by='slice')}<=20")
def twenty_per_slice(spark, d):
    return K.fixed_per_group(S.cases(spark, d).select("case_id", "slice"), 20, ["slice"], ["case_id"], "lat")


@query("SELECT doc_id FROM documents WHERE ('0x'||substr(sha256(doc_id::VARCHAR),1,8))::BIGINT % 4=1")
def hash_shard(spark, d):
    return K.shard(table(spark, d, "documents").select("doc_id"), 1, 4, ["doc_id"])


@query(f"SELECT doc_id FROM (SELECT doc_id,{rank_sql('shard', 'doc_id')}-1 AS p FROM documents) WHERE p%4=1")
def position_shard(spark, d):
    return K.shard_by_position(table(spark, d, "documents").select("doc_id"), 1, 4, ["doc_id"], "shard")


SPLIT = DEC + f", t AS (SELECT row_id,family,len(keys) AS n,{u('family')}<0.1 AND family LIKE 'syn%' AS h FROM decisions)"


def _held(spark, d):
    rows = S.decisions(spark, d).select("row_id", "family", "n_options")
    return rows.withColumn("holdout_family", held_out("family") & F.col("family").startswith("syn_"))


@query(SPLIT + f" SELECT row_id,CASE WHEN h THEN 'unseen' WHEN {u('row_id')}<0.02 THEN 'val' ELSE 'train' END AS split FROM t")
def split_by_fraction(spark, d):
    return K.split_by_fraction(_held(spark, d)).select("row_id", "split")


@query(SPLIT + " SELECT row_id,CASE WHEN h THEN 'unseen' WHEN ('0x'||substr(sha256(row_id),1,8))::BIGINT%50=0 THEN 'val' ELSE 'train' END AS split FROM t WHERE n<=26")
def split_by_modulus(spark, d):
    return K.split_by_modulus(_held(spark, d)).select("row_id", "split")


@query(DEC + f" SELECT DISTINCT family,{u('family')}<0.1 AS held FROM decisions")
def family_holdout(spark, d):
    return S.decisions(spark, d).select("family").distinct().withColumn("held", held_out("family"))


@query(f"WITH g AS (SELECT DISTINCT source FROM documents),h AS (SELECT source FROM g QUALIFY {rank_sql('tasks', 'source')}<=4) SELECT doc_id,source,source IN (SELECT source FROM h) AS holdout_family FROM documents")
def whole_group_holdout(spark, d):
    return K.hold_out_groups(table(spark, d, "documents").select("doc_id", "source"), 4, "source", "tasks")


@query(f"SELECT row_id,{rank_sql('shuffle', 'row_id')}-1 AS position FROM ({DEC} SELECT row_id FROM decisions)")
def global_shuffle(spark, d):
    """Every row's place in a global shuffle."""
    return hash_positions(S.decisions(spark, d).select("row_id"), (), ["row_id"], "shuffle")


@query("""WITH o AS (SELECT source,n_chars,row_number() OVER (PARTITION BY source ORDER BY n_chars)-1 AS i,count(*) OVER (PARTITION BY source) AS n FROM documents)
 SELECT source,max(n) AS n,max(n_chars) FILTER (i=n//10) AS p10,max(n_chars) FILTER (i=n//2) AS median,max(n_chars) AS longest FROM o GROUP BY 1""")
def length_percentiles(spark, d):
    return K.length_percentiles(table(spark, d, "documents").select("source", "n_chars"), "n_chars", ["source"])

"""Queries for licences, provenance and the release tables. Models and datasets are derived from the supplier and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage as L
from ..operators import targets as T
from ..operators.scale import materialise
from ..sources import derived as S
from ..sources.tables import table
from .oracle import ASK, TEXTS, DECISIONS
from .registry import query

LICENCES = ["Apache 2.0", "MIT", "CC-BY-NC-4.0", "cc by 4.0", "CC0: Public Domain", "proprietary", "BSD"]
LIC_SQL = "[" + ",".join(f"'{x}'" for x in LICENCES) + "]"
KEY_SQL = """CASE replace(replace(lower(trim({0})),' ','-'),'_','-') WHEN 'cc0:-public-domain' THEN 'cc0-1.0' WHEN 'cc0' THEN 'cc0-1.0' ELSE replace(replace(lower(trim({0})),' ','-'),'_','-') END"""
OKAY = "(" + ",".join(f"'{x}'" for x in L.CANONICAL) + ")"

MODELS = f"""models AS (SELECT s_name AS name,CASE WHEN s_suppkey%29<>0 THEN lower(n_name)||'/'||s_suppkey END AS hub_id,CASE s_suppkey%4 WHEN 0 THEN 'train' WHEN 1 THEN 'teacher' ELSE 'eval-only' END AS use,
  {LIC_SQL}[s_suppkey%7+1] AS license FROM supplier JOIN nation ON s_nationkey=n_nationkey),
 edges AS (SELECT lower(n.n_name)||'/'||s.s_suppkey AS child,lower(n2.n_name)||'/'||p.s_suppkey AS parent FROM supplier s JOIN nation n ON s.s_nationkey=n.n_nationkey
  JOIN supplier p ON p.s_suppkey=CASE WHEN s.s_suppkey=0 THEN 5 ELSE s.s_suppkey//3 END JOIN nation n2 ON p.s_nationkey=n2.n_nationkey),
 approved AS (SELECT lower(n_name) AS org FROM nation WHERE n_regionkey<3)"""


def _models(spark, d):
    sup = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    k = F.col("s_suppkey")
    hub = F.concat(F.lower("n_name"), F.lit("/"), k.cast("string"))
    use = F.when(k % 4 == 0, F.lit("train")).when(k % 4 == 1, F.lit("teacher")).otherwise(F.lit("eval-only"))
    licence = F.get(F.array(*[F.lit(x) for x in LICENCES]), (k % 7).cast("int"))
    models = sup.select(F.col("s_name").alias("name"), F.when(k % 29 != 0, hub).alias("hub_id"), use.alias("use"), licence.alias("license"))
    ids = sup.select(k.alias("id"), hub.alias("hub"))
    link = sup.select(hub.alias("child"), F.when(k == 0, F.lit(5)).otherwise(F.floor(k / 3)).cast("bigint").alias("id"))
    edges = link.join(ids, "id").select("child", F.col("hub").alias("parent"))
    approved = table(spark, d, "nation").where("n_regionkey < 3").select(F.lower("n_name").alias("org"))
    return models, edges, approved


@query("SELECT p_partkey," + KEY_SQL.format(f"{LIC_SQL}[(p_partkey%7)::INT+1]") + " AS licence_key," + KEY_SQL.format(f"{LIC_SQL}[(p_partkey%7)::INT+1]") + f" IN {OKAY} AS permissive FROM part")
def licence_spellings(spark, d):
    lic = F.get(F.array(*[F.lit(x) for x in LICENCES]), (F.col("p_partkey") % 7).cast("int"))
    return table(spark, d, "part").select("p_partkey", L.licence_key(lic).alias("licence_key"), L.permissive(lic).alias("permissive"))


@query(f"""WITH RECURSIVE {MODELS}, up AS (SELECT child AS hub_id,parent AS ancestor FROM edges UNION SELECT up.hub_id,e.parent FROM up JOIN edges e ON up.ancestor=e.child) SELECT hub_id,ancestor FROM up""")
def model_ancestors(spark, d):
    """All ancestors over the base-model edges, one cycle included."""
    _, edges, _ = _models(spark, d)
    return L.ancestors(edges, edges.select(F.col("child").alias("hub_id"))).select("hub_id", "ancestor")


@query(f"""WITH RECURSIVE {MODELS}, up AS (SELECT child AS hub_id,parent AS ancestor FROM edges UNION SELECT up.hub_id,e.parent FROM up JOIN edges e ON up.ancestor=e.child),
 g AS (SELECT * FROM models WHERE use<>'eval-only')
 SELECT 'model' AS kind,name,'no_hub_id' AS problem,NULL::VARCHAR AS value FROM g WHERE hub_id IS NULL
 UNION ALL SELECT 'model',name,'organisation',hub_id FROM g WHERE split_part(hub_id,'/',1) NOT IN (SELECT org FROM approved)
 UNION ALL SELECT 'model',name,'ancestor',ancestor FROM g JOIN up USING (hub_id) WHERE split_part(ancestor,'/',1) NOT IN (SELECT org FROM approved)
 UNION ALL SELECT 'model',name,'licence',license FROM g WHERE hub_id IS NOT NULL AND {KEY_SQL.format('license')} NOT IN {OKAY}""")
def model_provenance_gate(spark, d):
    return L.model_problems(*_models(spark, d))


@query(f"""WITH s AS (SELECT DISTINCT source,substr(source,4)::INT AS n FROM documents),ds AS (SELECT source AS name,CASE WHEN n%3=0 THEN 'eval-only' ELSE 'train' END AS use,CASE WHEN n=7 THEN NULL WHEN n%2=0 THEN [{LIC_SQL}[n%7+1]] ELSE [{LIC_SQL}[n%7+1],'MIT'] END AS license FROM s)
 SELECT DISTINCT 'dataset' AS kind,name,'licence' AS problem,coalesce(l,'none') AS value FROM (SELECT name,unnest(CASE WHEN license IS NULL THEN [NULL] ELSE license END) AS l FROM ds WHERE use='train')
 WHERE l IS NULL OR {KEY_SQL.format('l')} NOT IN {OKAY}""")
def dataset_licence_gate(spark, d):
    n = F.col("n")
    src = table(spark, d, "documents").select(F.col("source").alias("name")).distinct().withColumn("n", F.substring("name", 4, 9).cast("int"))
    lic = F.get(F.array(*[F.lit(x) for x in LICENCES]), n % 7)
    ds = src.select("name", F.when(n % 3 == 0, F.lit("eval-only")).otherwise(F.lit("train")).alias("use"), F.when(n == 7, F.lit(None)).when(n % 2 == 0, F.array(lic)).otherwise(F.array(lic, F.lit("MIT"))).alias("license"))
    return L.dataset_problems(ds)


@query(f"""SELECT DISTINCT p_partkey AS task,'licence' AS problem,coalesce(l,'none') AS value FROM (SELECT p_partkey,CASE WHEN p_partkey%11=0 THEN NULL ELSE {LIC_SQL}[(p_partkey%7)::INT+1] END AS l FROM part)
 WHERE l IS NULL OR {KEY_SQL.format('l')} NOT IN {OKAY}""")
def collection_task_licences(spark, d):
    """Tasks of a collection without a permissive licence of their own."""
    lic = F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).otherwise(F.get(F.array(*[F.lit(x) for x in LICENCES]), (F.col("p_partkey") % 7).cast("int")))
    return L.task_problems(table(spark, d, "part").select(F.col("p_partkey").alias("task"), lic.alias("license")))


NAMES = "CASE license WHEN 'CC BY 4.0' THEN 'CC-BY-4.0' WHEN 'Apache 2.0' THEN 'Apache-2.0' WHEN 'CC0: Public Domain' THEN 'CC0-1.0' WHEN 'cc-by-sa-3.0' THEN 'CC-BY-SA-3.0' ELSE 'MIT' END"
EXCLUDED = ["lang_src3"]


@query("WITH " + DECISIONS + f""", k AS (SELECT *,{NAMES} AS lic,family='sni_lang_src3' AS ex FROM decisions)
 SELECT 'task_type' AS what,task_type AS value,count(*) FILTER (NOT ex) AS n,count(*) FILTER (ex) AS n_excluded,0::BIGINT AS n_holdout FROM k GROUP BY 2 UNION ALL SELECT 'source',source,count(*) FILTER (NOT ex),count(*) FILTER (ex),0 FROM k GROUP BY 2
 UNION ALL SELECT 'license',lic,count(*) FILTER (NOT ex),count(*) FILTER (ex),0 FROM k GROUP BY 2 UNION ALL SELECT 'total','all',count(*) FILTER (NOT ex),count(*) FILTER (ex),0 FROM k""")
def release_statistics(spark, d):
    return L.release_statistics(S.decisions(spark, d), EXCLUDED)


@query("WITH " + DECISIONS + f""", q AS (SELECT *,{ASK} AS ask,{TEXTS} AS texts,regexp_extract(row_id,'-(.*)',1) AS n FROM decisions WHERE family<>'sni_lang_src3')
 SELECT row_id,family,task_type,gold,{NAMES} AS license,md5(state) AS state_md5,md5('{{"type":"'||task_type||'","instructions":'||to_json(ask)||',"criteria":'||CASE WHEN task_type='score' THEN '["'||array_to_string(texts,'","')||'"]'
  ELSE '{{'||array_to_string(list_transform(range(1,len(keys)+1), lambda i: '"'||keys[i]||'":"'||texts[i]||'"'),',')||'}}' END||'}}') AS question_md5,
  md5('{{"source":"'||source||'"'||CASE WHEN generator IS NOT NULL THEN ',"generator":"'||generator||'"' ELSE '' END||CASE WHEN row_id LIKE 'lang-%' THEN ',"task":"'||substr(family,5)||'"' ELSE '' END||',"source_row":"'||n||'"}}') AS provenance_md5,
  md5('{{'||array_to_string(list_transform(keys, lambda k: '"'||k||'":'||CASE WHEN k=gold THEN '1.0' ELSE '0.0' END),',')||'}}') AS target_md5 FROM q""")
def public_rows(spark, d):
    """Release rows of every type with their JSON columns; one excluded task is left out."""
    hot = F.transform("options", lambda o: F.when(o["key"] == F.col("gold"), 1.0).otherwise(0.0))
    rows = L.public_rows(S.decisions(spark, d).withColumn("target", hot), EXCLUDED)
    return rows.select("row_id", "family", "task_type", "gold", "license", *[F.md5(c).alias(f"{c}_md5") for c in ("state", "question", "provenance", "target")])


def _registry(spark, d):
    rows = S.decisions(spark, d).select(F.col("provenance.source").alias("name"), F.col("provenance.license").alias("license")).distinct()
    return rows.withColumn("organisation", F.upper(F.substring("name", 1, 6)))


@query("WITH " + DECISIONS + " SELECT source,count(*) AS rows,upper(substr(source,1,6)) AS organisation,any_value(license) AS license FROM decisions GROUP BY source")
def attribution(spark, d):
    return L.attribution(S.decisions(spark, d).select(F.col("provenance.source").alias("source")), _registry(spark, d))


@query()
def file_manifest(spark, d):
    """Sizes and digests of the table files."""
    return L.file_manifest(spark, d)


@query("WITH " + DECISIONS + " SELECT family,count(*) AS n,0.9::DOUBLE AS gold_mass FROM decisions GROUP BY 1")
def smoothed_targets(spark, d):
    """Gold smoothed to 0.9, for rows without a teacher."""
    out = T.smoothed_detection_targets(S.decisions(spark, d).select("family", "options", "gold"))
    p = F.get("target", (F.array_position(F.transform("options", lambda o: o["key"]), F.col("gold")) - 1).cast("int"))
    return out.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("gold_mass"))


@query("WITH " + DECISIONS + " SELECT origin,count(*) AS n FROM (SELECT 'core' AS origin FROM decisions WHERE task_type<>'score' UNION ALL SELECT 'fixed' FROM decisions WHERE task_type='score') GROUP BY 1")
def core_and_fixed_rows(spark, d):
    """Regenerated core rows with fixed rows appended."""
    rows = materialise(S.decisions(spark, d).select("row_id", "task_type"), "rows")
    core = rows.where("task_type <> 'score'").withColumn("origin", F.lit("core")).withColumn("target_kind", F.lit("soft"))
    return T.concatenate(core, rows.where("task_type = 'score'").withColumn("origin", F.lit("fixed"))).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))

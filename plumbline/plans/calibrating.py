"""Queries that fit and apply calibrators and build soft targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import half as half_of
from ..functions.options import keys_of
from ..operators import calibration as C
from ..operators import metrics as M
from ..operators import targets as T
from ..operators.scale import materialise
from ..sources import derived as S
from ..sources.tables import union_all
from .oracle import DECISIONS, PREDICTIONS, TEACHER_LABELS, half, u
from .registry import query, rounded

R = "WITH RECURSIVE " + PREDICTIONS

ITEMS = """, it0 AS (SELECT *,CASE WHEN task_type='noul' THEN [1-least(greatest(p_true,1e-15),1-1e-15),least(greatest(p_true,1e-15),1-1e-15)]
  ELSE list_transform(probs, lambda x: greatest(x,1e-15)) END AS cl,CASE WHEN task_type='noul' THEN (gold='true')::INT+1 ELSE list_position(keys,gold) END AS g
 FROM predictions WHERE error IS NULL AND pred IS NOT NULL),
 items AS MATERIALIZED (SELECT *,CASE WHEN task_type='noul' THEN z[2]-z[1] END AS x,(g=2)::INT AS y FROM (SELECT *,CASE WHEN task_type='noul' THEN list_transform(cl, lambda x: ln(x)) ELSE list_transform(cl, lambda x: ln(x/list_sum(cl))) END AS z FROM it0) WHERE g IS NOT NULL)"""


def fit_sql(rows: str, by: list[str], name: str = "fit") -> str:
    """CTEs `{name}_t` (by, temperature, n) and `{name}_p` (by, a, b, n) over rows with z, g (1-based), x, y, task_type."""
    keys = [*by, "task_type"]
    k = ",".join(keys)
    on = " AND ".join(f"w.{c}=r.{c}" for c in keys)
    wk = ",".join(f"w.{c}" for c in keys)
    p = "(1/(1+exp(-greatest(least(w.a*r.x+w.b,50),-50))))"
    ga, gb = f"(sum(({p}-r.y)*r.x)/count(*)+0.01*w.a)", f"(sum({p}-r.y)/count(*)+0.01*w.b)"
    haa, hab, hbb = f"(sum({p}*(1-{p})*r.x*r.x)/count(*)+0.01)", f"(sum({p}*(1-{p})*r.x)/count(*))", f"(sum({p}*(1-{p}))/count(*)+0.01)"
    det = f"({haa}*{hbb}-{hab}*{hab})"
    return f""", {name}_nll AS (SELECT {k},i,t,round(avg(ln(list_sum(list_transform(z, lambda v: exp((v-z[g])/t))))),12) AS nll,count(*) AS n FROM {rows},
  (SELECT i,exp(ln(0.25)+(ln(50.0)-ln(0.25))*i/199) AS t FROM range(200) r(i)) WHERE task_type<>'noul' GROUP BY ALL),
 {name}_t AS (SELECT {k},t AS temperature,n FROM {name}_nll QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY nll,i)=1),
 {name}_w AS (SELECT DISTINCT {k},0 AS it,0.1::DOUBLE AS a,0.0::DOUBLE AS b,0::BIGINT AS n FROM {rows} WHERE task_type='noul'
  UNION ALL SELECT {wk},w.it+1,w.a-({hbb}*{ga}-{hab}*{gb})/{det},w.b-({haa}*{gb}-{hab}*{ga})/{det},count(*) FROM {name}_w w JOIN {rows} r ON {on} WHERE w.it<14 GROUP BY {wk},w.it,w.a,w.b),
 {name}_p AS (SELECT {k},a,b,n FROM {name}_w WHERE it=14),
 {name} AS (SELECT {k},temperature,NULL::DOUBLE AS a,NULL::DOUBLE AS b,n FROM {name}_t UNION ALL SELECT {k},NULL,a,b,n FROM {name}_p)"""


def applied_sql(t: str, a: str, b: str) -> str:
    sig = f"(1/(1+exp(-greatest(least({a}*x+{b},50),-50))))"
    return (f"CASE WHEN task_type='noul' THEN [1-{sig},{sig}] ELSE list_transform(list_transform(z, lambda v: exp((v-list_max(z))/{t})), "
            f"lambda e: e/list_sum(list_transform(z, lambda v: exp((v-list_max(z))/{t})))) END")


SOFT = "list_transform(z, lambda v: exp(v)/list_sum(list_transform(z, lambda q: exp(q))))"


def scored_sql(rows: str, dist: str, by: str, prefix: str) -> str:
    return f"""(SELECT {by},sum(ok)/sum(n) AS {prefix}_accuracy,sum(abs(ok-c))/sum(n) AS {prefix}_ece FROM (
  SELECT {by},least(greatest(ceil(list_max({dist})*10)-1,0),9) AS bin,count(*) AS n,sum((list_position({dist},list_max({dist}))=g)::INT) AS ok,sum(list_max({dist})) AS c FROM {rows} GROUP BY ALL) GROUP BY ALL)"""


@query(R + ITEMS + fit_sql("items", []) + " SELECT task_type,round(temperature,6) AS temperature,round(a,6) AS a,round(b,6) AS b,n FROM fit")
def default_calibration(spark, d):
    """One temperature or Platt pair per answer type, pooled over all runs and slices."""
    return rounded(C.defaults(S.predictions(spark, d)))


@query(R + ITEMS + fit_sql("items", ["run_id", "slice"]) + " SELECT run_id,slice,task_type,round(temperature,6) AS temperature,round(a,6) AS a,round(b,6) AS b,n FROM fit")
def slice_calibrators(spark, d):
    return rounded(C.fit(materialise(C.items(S.predictions(spark, d)).select("run_id", "slice", "task_type", "z", "g", "x", "y"), "items"), ["run_id", "slice"]))


FOLDED = f", cf AS MATERIALIZED (SELECT run_id,slice,task_type,z,g,x,y,{half('family_id')} AS fold FROM items WHERE task_type<>'score'), tr AS MATERIALIZED (SELECT * REPLACE (1-fold AS fold) FROM cf)"


@query(R + ITEMS + FOLDED + fit_sql("tr", ["run_id", "slice", "fold"]) + f""", ap AS MATERIALIZED (SELECT run_id,slice,task_type,g,{applied_sql('temperature', 'a', 'b')} AS cal,{SOFT} AS raw FROM cf JOIN fit USING (run_id,slice,fold,task_type))
 SELECT run_id,slice,task_type,round(raw_accuracy,6) AS raw_accuracy,round(raw_ece,6) AS raw_ece,round(calibrated_accuracy,6) AS calibrated_accuracy,round(calibrated_ece,6) AS calibrated_ece
 FROM {scored_sql('ap', 'raw', 'run_id,slice,task_type', 'raw')} JOIN {scored_sql('ap', 'cal', 'run_id,slice,task_type', 'calibrated')} USING (run_id,slice,task_type)""")
def cross_fitted_calibration(spark, d):
    """Two-fold cross-fitted calibration by slice: accuracy and ECE before and after."""
    return rounded(C.cross_fit(S.predictions(spark, d)))


DEV = (R + ITEMS + ", dv AS MATERIALIZED (SELECT * FROM items WHERE suite='dev' AND task_type<>'score'), ts AS MATERIALIZED (SELECT * FROM items WHERE suite='test' AND task_type<>'score')"
       + fit_sql("dv", ["run_id", "slice"], "own") + fit_sql("dv", ["run_id"], "pool") + f""", ap AS MATERIALIZED (
 SELECT run_id,slice,task_type,g,{SOFT} AS raw,CASE WHEN n IS NOT NULL THEN {applied_sql('t1', 'a1', 'b1')} ELSE {applied_sql('t2', 'a2', 'b2')} END AS task,{applied_sql('t2', 'a2', 'b2')} AS pooled,n IS NOT NULL AS own FROM (
  SELECT ts.*,o.temperature AS t1,o.a AS a1,o.b AS b1,o.n,p.temperature AS t2,p.a AS a2,p.b AS b2 FROM ts LEFT JOIN (SELECT * FROM own WHERE n>=20) o USING (run_id,slice,task_type) LEFT JOIN pool p USING (run_id,task_type))),
 per AS (SELECT * FROM {scored_sql('ap', 'raw', 'run_id,slice,task_type', 'raw')} JOIN {scored_sql('ap', 'task', 'run_id,slice,task_type', 'task')} USING (run_id,slice,task_type)
  JOIN {scored_sql('ap', 'pooled', 'run_id,slice,task_type', 'pooled')} USING (run_id,slice,task_type) JOIN (SELECT run_id,slice,task_type,NOT bool_or(own) AS fell_back FROM ap GROUP BY ALL) USING (run_id,slice,task_type))""")
SIX = ",".join(f"round({k}_{m},6) AS {k}_{m}" for k in ("raw", "task", "pooled") for m in ("accuracy", "ece"))
SIX_AVG = ",".join(f"round(avg({k}_{m}),6) AS {k}_{m}" for k in ("raw", "task", "pooled") for m in ("accuracy", "ece"))


def _dev_parts(spark, d):
    p = S.predictions(spark, d)
    return C.from_dev(p.where("suite='dev'"), p.where("suite='test'"))


@query(DEV + f" SELECT run_id,slice,task_type,{SIX},fell_back FROM per")
def calibration_from_dev(spark, d):
    """Calibrators fitted on dev, scored on test: raw, per task (pooled where dev is too small) and default."""
    return rounded(_dev_parts(spark, d))


@query(DEV + f" SELECT run_id,{SIX_AVG},count(*) FILTER (fell_back) AS fallbacks FROM per GROUP BY run_id")
def calibration_from_dev_summary(spark, d):
    return rounded(C.dev_summary(_dev_parts(spark, d)))


@query("WITH RECURSIVE " + PREDICTIONS + ITEMS + fit_sql("items", []) + """, t AS (SELECT task_type,CASE WHEN task_type='score' THEN 0.0 ELSE temperature END AS temperature,CASE WHEN task_type='noul' THEN 'nan'::DOUBLE ELSE a END AS a FROM fit WHERE task_type<>'choice')
 SELECT task_type,CASE WHEN task_type='score' THEN 'temperature must be finite and positive' ELSE 'Platt parameters must be finite' END AS problem FROM t UNION ALL SELECT 'choice','missing'""")
def calibration_table_problems(spark, d):
    """A fitted table damaged on purpose: a zero temperature, a NaN scale and a missing type are all reported."""
    fit = C.defaults(S.predictions(spark, d)).where("task_type<>'choice'")
    broken = fit.withColumn("temperature", F.when(F.col("task_type") == "score", F.lit(0.0)).otherwise(F.col("temperature"))).withColumn(
        "a", F.when(F.col("task_type") == "noul", F.lit(float("nan"))).otherwise(F.col("a")))
    return C.calibration_problems(materialise(broken, "calibration"))


TGT = ("WITH RECURSIVE " + DECISIONS + "," + TEACHER_LABELS + f""", li AS MATERIALIZED (SELECT row_id,family,task_type,keys,gold,generator,z,list_position(keys,gold) AS g,CASE WHEN task_type='noul' THEN z[2]-z[1] END AS x,
  CASE WHEN task_type='noul' THEN list_position(keys,gold)-1 END AS y,{half('row_id')} AS fold FROM (SELECT *,list_transform(list_transform(probs, lambda p: greatest(p,1e-15)), lambda q: ln(q/list_sum(list_transform(probs, lambda p: greatest(p,1e-15))))) AS z FROM labels_t WHERE NOT failed)),
 tr AS MATERIALIZED (SELECT * REPLACE (1-fold AS fold) FROM li)""" + fit_sql("tr", ["family", "fold"]) + f""",
 cal AS MATERIALIZED (SELECT *,{applied_sql('temperature', 'a', 'b')} AS calibrated FROM (SELECT li.*,coalesce(f.temperature,1.0) AS temperature,coalesce(f.a,1.0) AS a,coalesce(f.b,0.0) AS b FROM li LEFT JOIN (SELECT * FROM fit WHERE n>=50) f USING (family,fold,task_type))),
 cs AS (SELECT family,avg((list_position(z,list_max(z))=g)::INT) AS consensus FROM li WHERE family LIKE 'syn\\_%' ESCAPE '\\' GROUP BY 1),
 kept AS MATERIALIZED (SELECT *,CASE WHEN family LIKE 'syn%' THEN 0.7 WHEN family LIKE 'sni%' THEN 0.6 WHEN generator IS NOT NULL THEN 0.9 WHEN family='dbpedia_topic' THEN 0.7 ELSE 0.5 END::DOUBLE AS w
  FROM cal LEFT JOIN cs USING (family) WHERE family NOT LIKE 'syn%' OR (consensus>=0.5 AND list_position(z,list_max(z))=g)),
 tgt AS MATERIALIZED (SELECT row_id,family,task_type,keys,gold,g,w AS gold_weight,list_transform(range(1,len(keys)+1), lambda i: round(w*(i=g)::INT+(1-w)*calibrated[i],6)) AS target,list_transform(calibrated, lambda c: round(c,6)) AS teacher_calibrated,
  calibrated[g]<0.1 AS teacher_conflict,list_position(calibrated,list_max(calibrated))=g AS agrees,family LIKE 'syn%' AND {u('family')}<0.1 AS holdout_family FROM kept)""")


def built(spark, d):
    rows = S.decisions(spark, d)
    items = T.label_table(rows, S.labels(spark, d))
    return rows, items, T.targets(items)


@query(TGT + """ SELECT row_id,family,gold,round(gold_weight,6) AS gold_weight,keys[i] AS key,target[i] AS target,teacher_calibrated[i] AS teacher_calibrated,teacher_conflict,agrees,holdout_family
 FROM tgt,unnest(range(1,len(keys)+1)) t(i)""")
def soft_targets(spark, d):
    """The target build: labels joined, cross-fitted by family and type, consensus filter, blend with gold."""
    out = built(spark, d)[2].withColumn("e", F.explode(F.arrays_zip("keys", "target", "teacher_calibrated")))
    return out.select("row_id", "family", "gold", "gold_weight", F.col("e.keys").alias("key"), "e.target", "e.teacher_calibrated", "teacher_conflict", "agrees", "holdout_family")


@query(TGT + """ SELECT family,coalesce(r,0) AS rows,round(coalesce(a,0),6) AS agreement,coalesce(c,0) AS conflicts,n-coalesce(r,0) AS dropped FROM (SELECT family,count(*) AS n FROM li GROUP BY 1)
 LEFT JOIN (SELECT family,count(*) AS r,avg(agrees::INT) AS a,count(*) FILTER (teacher_conflict) AS c FROM tgt GROUP BY 1) USING (family)""")
def target_report(spark, d):
    _, items, out = built(spark, d)
    return rounded(T.target_report(items, out))


@query(TGT + """ SELECT t.row_id,d.family,length(d.state) AS state_chars,len(t.target) AS n_target,round(list_sum(t.target),4) AS mass FROM tgt t JOIN decisions d USING (row_id)""")
def target_rows(spark, d):
    """Kept targets joined back to their full decision rows."""
    rows, _, out = built(spark, d)
    full = T.with_target_columns(rows, out)
    return full.select("row_id", "family", F.length("state").alias("state_chars"), F.size("target").alias("n_target"),
                       F.round(F.aggregate("target", F.lit(0.0), lambda a, x: a + x), 4).alias("mass"))


@query("WITH " + DECISIONS + "," + TEACHER_LABELS + " SELECT family,count(*) AS missing FROM labels_t WHERE failed GROUP BY 1")
def unlabelled_rows(spark, d):
    rows = S.decisions(spark, d)
    return T.unlabelled(rows, S.labels(spark, d))


@query("WITH " + DECISIONS + "," + TEACHER_LABELS + """, two AS (SELECT row_id,family,keys,gold,probs,0 AS load_order FROM labels_t WHERE NOT failed UNION ALL SELECT row_id,family,keys,gold,list_reverse(probs),1 FROM labels_t WHERE NOT failed AND length(row_id)%2=0)
 SELECT family,count(*) AS n,round(avg(probs[list_position(keys,gold)]),6) AS mean_gold FROM (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY load_order DESC)=1) GROUP BY 1""")
def duplicate_labels_last_wins(spark, d):
    """Two label files that overlap: the later label of a row is the one joined."""
    from ..functions.probability import from_map
    rows = S.decisions(spark, d).withColumn("keys", keys_of("options"))
    lab = S.labels(spark, d)
    again = lab.where((F.length("row_id") % 2 == 0) & F.col("error").isNull()).withColumn("probs", F.map_from_arrays(F.map_keys("probs"), F.reverse(F.map_values("probs")))).withColumn("load_order", F.lit(1).cast("bigint"))
    j = rows.join(T.usable_labels(union_all(lab, again)), "row_id")
    p = F.get(from_map("probs", "keys"), (F.array_position("keys", F.col("gold")) - 1).cast("int"))
    return rounded(j.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_gold")))


@query(TGT + """, l AS (SELECT t.family,t.task_type,t.target,k.probs FROM tgt t JOIN labels_t k USING (row_id))
 SELECT family,task_type,round(avg(-list_sum(list_transform(range(1,len(target)+1), lambda i: target[i]*ln(probs[i])))+0.5*list_sum(list_transform(range(1,len(target)+1), lambda i: power(probs[i]-target[i],2)))
  +CASE WHEN task_type='score' THEN 0.5*list_sum(list_transform(range(1,len(target)+1), lambda i: power(list_sum(probs[1:i])-list_sum(target[1:i]),2)))/(len(target)-1) ELSE 0 END),5) AS loss,count(*) AS n FROM l GROUP BY ALL""")
def decision_loss_by_family(spark, d):
    """Soft cross-entropy, Brier and ranked score of the teacher against the built targets."""
    rows, items, out = built(spark, d)
    probs = items.select("row_id", F.transform("z", lambda v: F.exp(v)).alias("probs"))
    return rounded(M.decision_losses(out.select("row_id", "family", "task_type", "target").join(probs, "row_id")), 5)


@query("WITH " + DECISIONS + "," + TEACHER_LABELS + f""", s AS (SELECT CASE WHEN {u('row_id')}<0.02 THEN 'val' ELSE 'train' END AS split,family,(keys[list_position(probs,list_max(probs))]=gold)::INT AS ok FROM labels_t WHERE NOT failed)
 SELECT split,round(avg(acc),6) AS acc_macro,count(*) AS n_families FROM (SELECT split,family,avg(ok) AS acc FROM s GROUP BY ALL) GROUP BY split""")
def macro_validation_accuracy(spark, d):
    from ..functions.hashing import held_out
    from ..functions.probability import argmax
    rows = S.decisions(spark, d)
    items = C.label_items(rows, T.usable_labels(S.labels(spark, d)))
    split = F.when(held_out("row_id", 0.02), F.lit("val")).otherwise(F.lit("train"))
    return rounded(M.macro_by_family(items.select(split.alias("split"), "family", (argmax("z") == F.col("g")).alias("correct"))))


@query("WITH " + DECISIONS + "," + TEACHER_LABELS + """ , s AS (SELECT count(*) FILTER (NOT failed) AS labelled,count(*) FILTER (failed) AS errors,sum(length(state)) FILTER (NOT failed)::BIGINT AS tokens,sum(latency_ms) FILTER (NOT failed)/1000.0 AS seconds FROM labels_t)
 SELECT 'teacher' AS teacher,labelled,errors,tokens,round(seconds,4) AS seconds,round(labelled/seconds,4) AS rows_per_s,round(tokens/seconds,2) AS tokens_per_s FROM s""")
def labelling_throughput(spark, d):
    t = M.labelling_throughput(S.labels(spark, d))
    return t.select("teacher", "labelled", "errors", "tokens", F.round("seconds", 4).alias("seconds"), F.round("rows_per_s", 4).alias("rows_per_s"), F.round("tokens_per_s", 2).alias("tokens_per_s"))


@query("WITH " + DECISIONS + " SELECT family,task_type,gold,len(keys) AS n_options,count(*) AS n FROM decisions GROUP BY ALL")
def answer_distribution(spark, d):
    return M.distribution_counts(S.decisions(spark, d))


@query("WITH " + DECISIONS + f" SELECT {half('row_id')} AS fold,task_type,count(*) AS n FROM decisions GROUP BY ALL")
def fold_sizes(spark, d):
    return S.decisions(spark, d).groupBy(half_of("row_id").alias("fold"), "task_type").agg(F.count(F.lit(1)).alias("n"))

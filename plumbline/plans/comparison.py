"""Queries that compare runs and decide."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as D
from ..operators.scale import materialise
from ..sources import derived as S
from .evaluation import CMP, P
from .oracle import DECISIONS, TEACHER_LABELS
from .registry import query, rounded

WATCHED = ["topic_0", "topic_1"]
W = "('topic_0','topic_1')"

PAIRS = P + f""", ok AS (SELECT *,lower(pred)=lower(gold) AS correct FROM predictions WHERE {CMP}),
b AS (SELECT case_id,slice,correct AS bc,pred AS bp FROM ok WHERE run_id='base'),
pairs AS (SELECT r.run_id,b.*,c.correct,c.pred FROM b CROSS JOIN (SELECT DISTINCT run_id FROM ok WHERE run_id<>'base') r LEFT JOIN ok c ON c.run_id=r.run_id AND c.case_id=b.case_id)"""


def mcnemar_sql(w: str, r: str) -> str:
    """Binomial tail in log space with the exact log-gamma of DuckDB."""
    n, k = f"({w}+{r})", f"least({w},{r})"
    term = f"exp(lgamma({n}+1)-lgamma(i+1)-lgamma({n}-i+1)-{n}*ln(2.0::DOUBLE))"
    return f"CASE WHEN {n}=0 THEN 1.0 ELSE least(1.0,2*list_sum(list_transform(range(0,({k})::BIGINT+1), lambda i: {term}))) END"


def _preds(spark, d):
    return S.predictions(spark, d)


@query(PAIRS + f""", s AS (SELECT run_id,slice,count(*) AS n,count(*) FILTER (bc AND NOT correct) AS newly_wrong,count(*) FILTER (NOT bc AND correct) AS newly_right FROM pairs WHERE correct IS NOT NULL GROUP BY ALL)
 SELECT run_id,slice,n,newly_wrong,newly_right,round({mcnemar_sql('newly_wrong', 'newly_right')},6) AS p,round((newly_right-newly_wrong)/greatest(n,1)::DOUBLE,6) AS accuracy_change FROM s""")
def paired_mcnemar(spark, d):
    """Newly wrong, newly right and the exact p value per run and slice."""
    return rounded(D.paired_counts(D.paired_rows(_preds(spark, d), "base"), ["run_id", "slice"]))


@query(PAIRS + " SELECT run_id,round(min(share),6) AS coverage FROM (SELECT run_id,slice,avg((correct IS NOT NULL)::INT) AS share FROM pairs GROUP BY ALL) GROUP BY run_id")
def answer_coverage(spark, d):
    p = _preds(spark, d)
    return rounded(D.coverage(D.paired_rows(p, "base"), D.base_slices(p, "base")))


@query(PAIRS + " SELECT run_id,round(avg((pred=bp)::INT),6) AS agreement,count(*) AS n FROM pairs WHERE pred IS NOT NULL GROUP BY run_id")
def run_agreement(spark, d):
    return rounded(D.agreement(D.paired_rows(_preds(spark, d), "base")))


REPORT = PAIRS + f""", per AS (SELECT run_id,slice,count(*) AS nb,count(correct) AS n,count(*) FILTER (bc AND NOT correct) AS w,count(*) FILTER (NOT bc AND correct) AS r FROM pairs GROUP BY ALL),
 s AS (SELECT run_id,min(n/nb) AS coverage,sum(n)::BIGINT AS n,sum(w)::BIGINT AS newly_wrong,sum(r)::BIGINT AS newly_right,
  coalesce(sum(n) FILTER (slice IN {W}),0)::BIGINT AS watched_n,coalesce(sum(w) FILTER (slice IN {W}),0)::BIGINT AS watched_wrong,coalesce(sum(r) FILTER (slice IN {W}),0)::BIGINT AS watched_right FROM per GROUP BY run_id),
 s2 AS (SELECT *,{mcnemar_sql('newly_wrong', 'newly_right')} AS p,watched_wrong-watched_right AS watched_net_loss,0.02::DOUBLE*watched_n AS watched_cap,(newly_right-newly_wrong)/greatest(n,1)::DOUBLE AS accuracy_change FROM s),
 s3 AS (SELECT *,(newly_wrong>newly_right AND p<0.05) OR watched_net_loss>watched_cap AS regresses,accuracy_change>=-0.015 AS non_inferior FROM s2),
 acc AS (SELECT run_id,avg(a) AS mean_accuracy FROM (SELECT run_id,slice,avg(correct::INT) AS a FROM ok GROUP BY ALL) GROUP BY run_id),
 report AS (SELECT s3.*,coverage>=0.98 AND NOT regresses AS eligible,coverage>=0.98 AND non_inferior AS eligible_non_inferior,mean_accuracy FROM s3 JOIN acc USING (run_id))"""


@query(REPORT + " SELECT * REPLACE (round(coverage,6) AS coverage,round(p,6) AS p,round(watched_cap,6) AS watched_cap,round(accuracy_change,6) AS accuracy_change,round(mean_accuracy,6) AS mean_accuracy) FROM report")
def candidate_report(spark, d):
    """Regression check, non-inferiority and eligibility of every candidate against the base run."""
    return rounded(D.assess(_preds(spark, d), "base", WATCHED))


def _suite_sql(suite):
    return "(" + REPORT.replace("FROM predictions WHERE", f"FROM predictions WHERE suite='{suite}' AND") + " SELECT * FROM report)"


@query(f"""WITH bo AS (SELECT l.* EXCLUDE (coverage,mean_accuracy,accuracy_change,non_inferior,eligible,eligible_non_inferior),least(l.coverage,r.coverage) AS coverage,r.mean_accuracy,r.accuracy_change,r.non_inferior FROM {_suite_sql('dev')} l JOIN {_suite_sql('test')} r USING (run_id))
 SELECT * REPLACE (round(coverage,6) AS coverage,round(p,6) AS p,round(watched_cap,6) AS watched_cap,round(accuracy_change,6) AS accuracy_change,round(mean_accuracy,6) AS mean_accuracy),coverage>=0.98 AND NOT regresses AS eligible,coverage>=0.98 AND non_inferior AS eligible_non_inferior FROM bo""")
def two_suite_report(spark, d):
    """Regressions on the dev suite, accuracy on the test suite, coverage the lower of both."""
    return rounded(D.assess_suites(_preds(spark, d), "base", WATCHED, "dev", "test"))


def _choose_sql(flag):
    return REPORT + f""", c AS (SELECT (SELECT run_id FROM report WHERE {flag} ORDER BY mean_accuracy DESC,run_id DESC LIMIT 1) AS best,
 (SELECT run_id FROM report WHERE coverage>=0.98 ORDER BY accuracy_change DESC,mean_accuracy DESC,run_id DESC LIMIT 1) AS f,(SELECT count(*) FROM report) AS candidates,(SELECT count(*) FROM report WHERE {flag}) AS eligible)
 SELECT best,CASE WHEN best IS NULL THEN f END AS fallback,coalesce(best,f) AS chosen,candidates,eligible FROM c"""


@query(_choose_sql("eligible"))
def choose_candidate(spark, d):
    return D.choose(D.assess(_preds(spark, d), "base", WATCHED))


@query(_choose_sql("eligible_non_inferior"))
def choose_non_inferior(spark, d):
    return D.choose(D.assess(_preds(spark, d), "base", WATCHED), "eligible_non_inferior")


@query(P + f""", w AS (SELECT suite,count(*) AS n_cases FROM cases WHERE task_type<>'score' GROUP BY 1),g AS (SELECT suite,count(DISTINCT case_id) AS n_answered FROM predictions WHERE {CMP} AND run_id='base' GROUP BY 1)
 SELECT suite,n_cases,coalesce(n_answered,0) AS n_answered,coalesce(n_answered,0)>=0.98::DOUBLE*n_cases AS complete FROM w LEFT JOIN g USING (suite)""")
def base_completeness(spark, d):
    return D.base_complete(_preds(spark, d), S.cases(spark, d), "base")


@query(REPORT + " SELECT run_id,coverage>=0.98 AND regresses AS informative FROM report WHERE run_id='wide'")
def gate_positive_control(spark, d):
    return D.gate_informative(D.assess(_preds(spark, d), "base", WATCHED), "wide")


@query(PAIRS + """, e AS (SELECT count(*) AS expected FROM cases WHERE task_type<>'score') SELECT run_id,round(avg((pred=bp)::INT),6) AS agreement,count(*) AS n,max(expected) AS expected,
 count(*)>=0.98::DOUBLE*max(expected) AND avg((pred=bp)::INT)>=0.5 AS passed FROM pairs,e WHERE pred IS NOT NULL GROUP BY run_id""")
def canary_check(spark, d):
    expected = S.cases(spark, d).where(F.col("task_type") != "score").count()
    return rounded(D.canary(D.paired_rows(_preds(spark, d), "base"), expected, 0.5)).withColumn("expected", F.col("expected").cast("bigint"))


@query(P + """ SELECT a.slice,round(max(list_max(list_transform(range(1,len(a.probs)+1), lambda i: abs(a.probs[i]-b.probs[i])))),6) AS max_difference,
 round(avg((lower(a.pred)=lower(b.pred))::INT),6) AS same_top,count(*) AS n FROM predictions a JOIN predictions b USING (case_id) WHERE a.run_id='base' AND b.run_id='tuned' AND a.probs IS NOT NULL AND b.probs IS NOT NULL GROUP BY 1""")
def scorer_difference(spark, d):
    p = _preds(spark, d)
    return rounded(D.scorer_difference(p.where("run_id='base'"), p.where("run_id='tuned'")))


@query(P + f""" SELECT count(*) AS cases,round(count(*) FILTER (lower(a.pred)=lower(b.pred))/count(*)::DOUBLE,6) AS same_top,count(*) FILTER (b.error IS NOT NULL) AS errors,
 round(list_sort(list(b.latency_ms))[1+count(*)//2],6) AS p50_ms,round(list_sort(list(b.latency_ms))[1+greatest(0,floor(count(*)*0.95::DOUBLE)::BIGINT-1)],6) AS p95_ms,
 count(*) FILTER (lower(a.pred)=lower(b.pred))/count(*)::DOUBLE>=0.4 AS passed FROM predictions a JOIN predictions b USING (case_id) WHERE a.run_id='base' AND b.run_id='wide' AND a.{CMP.replace("pred IS", "a.pred IS").replace("task_type", "a.task_type")}""")
def direct_against_served(spark, d):
    p = _preds(spark, d)
    return rounded(D.served_check(D.comparable(p).where("run_id='base'"), p.where("run_id='wide'"), 0.4))


@query(P + f""", a AS (SELECT run_id,slice,avg((lower(pred)=lower(gold))::INT) AS acc FROM predictions WHERE {CMP} AND slice IN {W} GROUP BY ALL),m AS (SELECT run_id,avg(acc) AS m FROM a GROUP BY 1)
 SELECT max_by(run_id,m) AS best,round(max(m),6) AS best_accuracy,round(max(m) FILTER (run_id='base'),6) AS default_accuracy,CASE WHEN max(m)>=max(m) FILTER (run_id='base')+0.04 THEN max_by(run_id,m) ELSE 'base' END AS accepted FROM m""")
def best_over_slices(spark, d):
    return rounded(D.best_over_slices(_preds(spark, d), WATCHED, "base"))


FAMILY_AGREEMENT = "WITH " + DECISIONS + "," + TEACHER_LABELS + """, hit AS (SELECT *,keys[list_position(probs,list_max(probs))]=gold AS ok FROM labels_t WHERE NOT failed),
 new_t AS (SELECT family,avg(ok::INT) AS a FROM hit WHERE family<>'syn_src0' GROUP BY 1),old_t AS (SELECT family,avg((ok AND latency_ms<200)::INT) AS a FROM hit WHERE family<>'sni_lang_src0' GROUP BY 1),
 j AS (SELECT family,o.a AS old,n.a AS new,CASE WHEN o.a IS NULL THEN 'only_new' WHEN n.a IS NULL THEN 'only_old' ELSE 'common' END AS place,abs(n.a-o.a) AS diff FROM old_t o FULL JOIN new_t n USING (family))"""


def _family_tables(spark, d):
    from ..functions.probability import argmax
    from ..functions.options import keys_of
    rows = S.decisions(spark, d)
    lab = S.labels(spark, d).where("error IS NULL").select("row_id", "probs", "latency_ms")
    j = rows.select("row_id", "family", "gold", keys_of("options").alias("keys")).join(lab, "row_id")
    from ..functions.probability import from_map
    ok = F.get("keys", argmax(from_map("probs", "keys"))) == F.col("gold")
    new = j.where("family<>'syn_src0'").groupBy("family").agg(F.avg(ok.cast("double")).alias("agreement"))
    old = j.where("family<>'sni_lang_src0'").groupBy("family").agg(F.avg((ok & (F.col("latency_ms") < 200)).cast("double")).alias("agreement"))
    return old, new


@query(FAMILY_AGREEMENT + " SELECT family,round(old,6) AS old,round(new,6) AS new,place,round(diff,6) AS diff FROM j")
def family_tables_joined(spark, d):
    """Two per-family tables side by side: in both, only in the old, only in the new."""
    return rounded(D.compare_by_family(*_family_tables(spark, d)))


@query(FAMILY_AGREEMENT + """ SELECT count(*) FILTER (place='common') AS families_compared,count(*) FILTER (place='only_new') AS families_only_new,count(*) FILTER (place='only_old') AS families_only_old,
 round(max(diff),6) AS max_difference,(SELECT string_agg(family,',' ORDER BY diff DESC,family DESC) FROM (SELECT family,diff FROM j WHERE diff IS NOT NULL ORDER BY diff DESC,family DESC LIMIT 5)) AS worst FROM j""")
def reproducibility_report(spark, d):
    return rounded(D.reproducibility(materialise(D.compare_by_family(*_family_tables(spark, d)), "families")))


@query(P + " SELECT count(*) AS shared FROM (SELECT case_id FROM predictions WHERE error IS NULL GROUP BY 1 HAVING count(DISTINCT run_id)=3)")
def cases_shared_by_runs(spark, d):
    return D.shared_by_all_runs(_preds(spark, d).where("error IS NULL"), list(S.RUNS)).agg(F.count(F.lit(1)).alias("shared"))


@query("WITH " + DECISIONS + "," + TEACHER_LABELS + " SELECT count(*) AS wanted,count(*) FILTER (NOT failed) AS labelled,count(*) FILTER (NOT failed)>=0.98::DOUBLE*count(*) AS complete FROM labels_t")
def labelling_completeness(spark, d):
    rows = S.decisions(spark, d)
    return D.labelling_complete(rows, S.labels(spark, d))


@query(P + f""", a AS (SELECT run_id,slice,avg((lower(pred)=lower(gold))::INT) AS acc FROM predictions WHERE {CMP} GROUP BY ALL),m AS (SELECT run_id,'accuracy' AS metric,avg(acc) AS v FROM a GROUP BY 1),
 c AS (SELECT run_id,metric,CASE WHEN run_id='wide' THEN v+0.01 ELSE v END AS claimed FROM m)
 SELECT run_id,metric,round(claimed,6) AS claimed,round(v,6) AS value,round(v,3)=round(claimed,3) AS matches FROM m JOIN c USING (run_id,metric)""")
def claims_audit(spark, d):
    """Claimed figures against measured ones; the claim of one run is off by a point."""
    m = materialise(D.slice_mean_accuracy(_preds(spark, d)).select("run_id", F.lit("accuracy").alias("metric"), F.col("mean_accuracy").alias("value")), "measured")
    claims = m.select("run_id", "metric", F.when(F.col("run_id") == "wide", F.col("value") + 0.01).otherwise(F.col("value")).alias("claimed"))
    return rounded(D.audit_claims(claims, m))

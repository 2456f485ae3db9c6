"""Queries over prediction runs: scores, leaderboard, comparisons of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction
from ..operators import metrics as M
from ..operators.scale import materialise
from ..sources import derived as S
from .oracle import BIN, PREDICTIONS, u
from .registry import query, rounded

P = "WITH " + PREDICTIONS
OK = "error IS NULL AND pred IS NOT NULL"
CMP = OK + " AND task_type<>'score'"

SLICE_METRICS_SQL = P + f""",
binned AS (SELECT run_id,slice,task_type,{BIN} AS bin,count(*) AS n,count(*) FILTER (lower(pred)=lower(gold)) AS c,sum(confidence) AS s
 FROM predictions WHERE {OK} GROUP BY ALL),
gaps AS (SELECT run_id,slice,task_type,sum(abs(c-s))/sum(n) AS ece FROM binned GROUP BY ALL),
rows1 AS (SELECT *, {OK} AS scored, (gold='true')::INT AS y FROM predictions),
m AS (SELECT run_id,slice,task_type,count(*) AS n_cases,count(*) FILTER (error IS NOT NULL) AS n_errors,count(*) FILTER (scored) AS n_scored,
 0::BIGINT AS n_truncated,
 avg(scored::INT) AS coverage,
 CASE WHEN task_type<>'score' THEN avg((lower(pred)=lower(gold))::INT) FILTER (scored) END AS accuracy,
 CASE WHEN task_type='noul' THEN 1-avg((lower(pred)=lower(gold))::INT) FILTER (scored) END AS accuracy_if_flipped,
 CASE WHEN task_type='noul' THEN count(*) FILTER (scored AND pred='true' AND gold='true') END AS tp,
 CASE WHEN task_type='noul' THEN count(*) FILTER (scored AND pred='true' AND gold='false') END AS fp,
 CASE WHEN task_type='noul' THEN count(*) FILTER (scored AND pred='false' AND gold='true') END AS fn,
 CASE WHEN task_type='noul' THEN count(*) FILTER (scored AND pred='false' AND gold='false') END AS tn,
 CASE WHEN task_type='noul' THEN avg((p_true-y)*(p_true-y)) FILTER (scored)
  WHEN task_type='choice' THEN avg(list_sum(list_transform(range(1,len(keys)+1), lambda i: (probs[i]-(keys[i]=gold)::INT)*(probs[i]-(keys[i]=gold)::INT)))) FILTER (scored) END AS brier,
 CASE WHEN task_type<>'score' THEN avg(-ln(p_gold)) FILTER (scored AND p_gold>0) END AS nll_excluding_zeros,
 CASE WHEN task_type<>'score' THEN count(*) FILTER (scored AND p_gold=0) END AS n_zero_on_gold,
 CASE WHEN task_type<>'score' THEN avg(-ln(greatest(p_gold,1e-12))) FILTER (scored) END AS nll_clipped,
 CASE WHEN task_type='noul' THEN avg(p_true) FILTER (scored) END AS mean_p_true,
 CASE WHEN task_type='noul' THEN avg(y) FILTER (scored) END AS base_rate,
 CASE WHEN task_type='score' THEN avg(abs(expected_level-TRY_CAST(gold AS DOUBLE))) FILTER (scored) END AS mae_expected_level,
 CASE WHEN task_type='score' THEN avg(abs(round(expected_level)-TRY_CAST(gold AS DOUBLE))) FILTER (scored) END AS mae_rounded,
 CASE WHEN task_type='score' THEN avg((abs(round(expected_level)-TRY_CAST(gold AS DOUBLE))=0)::INT) FILTER (scored) END AS exact_accuracy,
 CASE WHEN task_type='score' THEN avg((abs(round(expected_level)-TRY_CAST(gold AS DOUBLE))<=1)::INT) FILTER (scored) END AS within_one_level,
 CASE WHEN task_type='score' THEN avg(list_sum(list_transform(range(1,len(keys)+1), lambda i: power(list_sum(probs[1:i])-(TRY_CAST(gold AS INT)<i)::INT,2)))/(len(keys)-1)) FILTER (scored) END AS ranked_probability_score,
 avg(input_tokens) AS input_tokens_mean,sum(input_tokens)::BIGINT AS input_tokens_total
 FROM rows1 GROUP BY run_id,slice,task_type)"""

SLICE_METRICS_COLS = """m.* EXCLUDE (accuracy), m.accuracy, CASE WHEN m.task_type<>'score' THEN ece END AS ece_10_bins,
 tp::DOUBLE/nullif(tp+fp,0) AS "precision", tp::DOUBLE/nullif(tp+fn,0) AS recall, 2.0*tp/nullif(2*tp+fp+fn,0) AS f1, fp::DOUBLE/nullif(fp+tn,0) AS false_positive_rate"""


def _round_sql(inner: str, doubles: list[str]) -> str:
    return "SELECT * REPLACE (" + ",".join(f'round("{c}"::DOUBLE,6) AS "{c}"' for c in doubles) + f") FROM ({inner})"


SLICE_DOUBLES = ["coverage", "accuracy", "accuracy_if_flipped", "brier", "nll_excluding_zeros", "nll_clipped", "mean_p_true", "base_rate",
                 "mae_expected_level", "mae_rounded", "exact_accuracy", "within_one_level", "ranked_probability_score", "input_tokens_mean",
                 "ece_10_bins", "precision", "recall", "f1", "false_positive_rate"]


@query(SLICE_METRICS_SQL + _round_sql(f"SELECT {SLICE_METRICS_COLS} FROM m LEFT JOIN gaps g USING (run_id,slice,task_type)", SLICE_DOUBLES))
def slice_metrics(spark, d):
    """Accuracy, ECE, Brier, log loss, confusion, ordinal errors of every run and slice."""
    return rounded(M.slice_metrics(S.predictions(spark, d)))


@query(SLICE_METRICS_SQL + """, h AS (SELECT run_id,slice,m.task_type,CASE WHEN m.task_type='score' THEN mae_expected_level ELSE accuracy END AS value,
 CASE WHEN m.task_type<>'score' THEN ece END AS ece,coverage FROM m LEFT JOIN gaps USING (run_id,slice,task_type)),
 b AS (SELECT run_id,count(value) FILTER (task_type<>'score') AS n,avg(value) FILTER (task_type<>'score') AS acc,count(ece) AS ne,avg(ece) AS me,
 bool_or(task_type<>'score' AND coverage<1) AS partial FROM h GROUP BY run_id)
 SELECT run_id,max(n) OVER () AS expected_slices,round(CASE WHEN n=max(n) OVER () THEN acc END,6) AS mean_accuracy,
 round(CASE WHEN ne=max(n) OVER () THEN me END,6) AS mean_ece,partial FROM b""")
def leaderboard(spark, d):
    """Mean accuracy and mean ECE per run over the accuracy slices."""
    return rounded(M.leaderboard(M.headline(M.slice_metrics(S.predictions(spark, d)))))


@query(SLICE_METRICS_SQL + """ SELECT run_id,slice,m.task_type,CASE WHEN m.task_type='score' THEN 'mae_expected_level' ELSE 'accuracy' END AS metric,
 round(CASE WHEN m.task_type='score' THEN mae_expected_level ELSE accuracy END,6) AS value,round(CASE WHEN m.task_type<>'score' THEN ece END,6) AS ece,
 round(coverage,6) AS coverage,CASE WHEN coverage<1 THEN printf('%.0f',coverage*100)||'% cov' END AS coverage_tag
 FROM m LEFT JOIN gaps USING (run_id,slice,task_type)""")
def slice_headlines(spark, d):
    return rounded(M.headline(M.slice_metrics(S.predictions(spark, d))))


@query(SLICE_METRICS_SQL + """, h AS (SELECT run_id,slice,m.task_type,round(CASE WHEN m.task_type='score' THEN mae_expected_level ELSE accuracy END,6) AS value FROM m)
 SELECT slice,task_type,max(value) FILTER (run_id='base') AS base,max(value) FILTER (run_id='tuned') AS tuned,max(value) FILTER (run_id='wide') AS wide FROM h GROUP BY ALL""")
def scoreboard_matrix(spark, d):
    return rounded(M.scoreboard_matrix(M.headline(M.slice_metrics(S.predictions(spark, d))), list(S.RUNS)))


CLASS_SQL = P + f""", sides AS (SELECT run_id,slice,gold AS class,1 AS support,0 AS predicted,(pred=gold)::INT AS tp FROM predictions WHERE {CMP} AND task_type='choice'
 UNION ALL SELECT run_id,slice,pred,0,1,0 FROM predictions WHERE {CMP} AND task_type='choice'),
 k AS (SELECT run_id,slice,class,sum(support)::BIGINT AS support,sum(predicted) AS predicted,sum(tp) AS tp FROM sides GROUP BY ALL),
 c AS (SELECT run_id,slice,class,support,coalesce(tp/nullif(predicted,0)::DOUBLE,0) AS "precision",coalesce(tp/nullif(support,0)::DOUBLE,0) AS recall,coalesce(2.0*tp/nullif(predicted+support,0),0) AS f1 FROM k)"""


@query(CLASS_SQL + """ SELECT run_id,slice,class,support,round("precision",6) AS "precision",round(recall,6) AS recall,round(f1,6) AS f1 FROM c""")
def class_metrics(spark, d):
    return rounded(M.class_metrics(S.predictions(spark, d)))


@query(CLASS_SQL + " SELECT run_id,slice,round(avg(f1),6) AS macro_f1,count(*) AS n_classes FROM c GROUP BY ALL")
def macro_f1(spark, d):
    return rounded(M.macro_f1(M.class_metrics(S.predictions(spark, d))))


@query(P + f""", s AS (SELECT run_id,slice,p_true,count(*) FILTER (gold='true') AS pos,count(*) FILTER (gold='false') AS neg FROM predictions WHERE {OK} AND task_type='noul' GROUP BY ALL),
 c AS (SELECT *,sum(pos) OVER w AS pu,sum(neg) OVER w AS nu,sum(pos) OVER g AS np,sum(neg) OVER g AS nn FROM s
  WINDOW w AS (PARTITION BY run_id,slice ORDER BY p_true ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY run_id,slice)),
 r AS (SELECT *,np-pu+pos+nu-neg AS right_n FROM c),
 best AS (SELECT run_id,slice,p_true,right_n,np,nn FROM r QUALIFY row_number() OVER (PARTITION BY run_id,slice ORDER BY right_n DESC,p_true)=1)
 SELECT run_id,slice,round(a.auroc,6) AS auroc,round(p_true,6) AS best_threshold,round(right_n::DOUBLE/(np+nn),6) AS best_threshold_accuracy
 FROM best JOIN (SELECT run_id,slice,sum(pos*(nu-neg+neg/2.0))::DOUBLE/nullif(max(np)*max(nn),0) AS auroc FROM r GROUP BY ALL) a USING (run_id,slice)""")
def auroc_and_threshold(spark, d):
    return rounded(M.ranking_metrics(S.predictions(spark, d)))


@query(P + f""", f AS (SELECT run_id,slice,family_id,max((lower(pred)=lower(gold))::INT) FILTER (perturbation='none') AS a,max((lower(pred)=lower(gold))::INT) FILTER (perturbation='permuted') AS b FROM predictions WHERE {CMP} GROUP BY ALL),
 s AS (SELECT run_id,slice,avg(a) AS accuracy_none,avg(b) AS accuracy_permuted,count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_families_with_both,
 avg((a+b=2)::INT) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both_variants_correct,avg((a<>b)::INT) FILTER (a IS NOT NULL AND b IS NOT NULL) AS flipped_by_reordering FROM f GROUP BY ALL)
 SELECT run_id,slice,round(accuracy_none,6) AS accuracy_none,round(accuracy_permuted,6) AS accuracy_permuted,n_families_with_both,round(both_variants_correct,6) AS both_variants_correct,
 round(flipped_by_reordering,6) AS flipped_by_reordering FROM s WHERE n_families_with_both>0""")
def option_order_bias(spark, d):
    return rounded(M.position_bias(S.predictions(spark, d)))


RETRIES = u("run_id||':'||case_id||':again'")
USAGE = f"round(avg(input_tokens),6) AS input_tokens_mean,sum(input_tokens)::BIGINT AS input_tokens_total,sum(CASE WHEN {RETRIES}<0.02 THEN 2 WHEN {RETRIES}<0.1 THEN 1 ELSE 0 END)::BIGINT AS retries"


def _calls(spark, d):
    """Prediction records with their retries, drawn like the rest of them."""
    drawn = hash_fraction(F.concat_ws(":", "run_id", "case_id", F.lit("again")))
    return S.predictions(spark, d).withColumn("retries", F.when(drawn < 0.02, 2).when(drawn < 0.1, 1).otherwise(0))


@query(P + f""" SELECT run_id,slice,count(*) AS n,round(quantile_cont(latency_ms,0.5),6) AS latency_ms_p50,round(quantile_cont(latency_ms,0.95),6) AS latency_ms_p95,
 round(quantile_cont(latency_ms,0.99),6) AS latency_ms_p99,{USAGE} FROM predictions GROUP BY ALL""")
def runtime_percentiles(spark, d):
    return rounded(M.runtime(_calls(spark, d)))


@query(P + f""" SELECT slice,count(*) AS n,{USAGE},true AS p50_within,true AS p95_within,true AS p99_within FROM predictions GROUP BY ALL""")
def runtime_merged(spark, d):
    """Runtime of each slice over all runs from the stored summaries of the runs; ranks of the percentiles are within 1 %."""
    calls = _calls(spark, d)
    stored = materialise(M.runtime_summaries(calls), "summaries")  # each run's rows are written when the run ends
    out = materialise(M.runtime_from_summaries(M.merged_summaries(stored, ["slice"]), ["slice"]), "merged")
    names = {"latency_ms_p50": 0.50, "latency_ms_p95": 0.95, "latency_ms_p99": 0.99}
    off = M.rank_errors(calls, out, ["slice"], names)
    both = out.drop(*names).join(off, "slice")
    return rounded(both.select(*[c for c in out.columns if c not in names], *[(F.col(f"{c}_off") <= 0.01).alias(f"{c[-3:]}_within") for c in names]))


@query(P + """, o AS (SELECT run_id,slice,latency_ms,row_number() OVER (PARTITION BY run_id,slice ORDER BY latency_ms)-1 AS i,count(*) OVER (PARTITION BY run_id,slice) AS n FROM predictions)
 SELECT run_id,slice,max(n) AS n,round(max(latency_ms) FILTER (i=n//2),6) AS p50_ms,round(max(latency_ms) FILTER (i=greatest(0,floor(n*0.95::DOUBLE)::BIGINT-1)),6) AS p95_ms FROM o GROUP BY ALL""")
def latency_at_index(spark, d):
    return rounded(M.latency_at_index(S.predictions(spark, d), ["run_id", "slice"]))


@query(P + f""", ok AS (SELECT *,lower(pred)=lower(gold) AS c FROM predictions WHERE {CMP} AND NOT (run_id='wide' AND slice='lang')),
 f AS (SELECT run_id,slice,family_id,bool_or(c) FILTER (perturbation='none') AS a,bool_or(c) FILTER (perturbation='permuted') AS b FROM ok GROUP BY ALL),
 s AS (SELECT run_id,slice,1000*(count(*) FILTER (a<>b)/count(*)::DOUBLE) AS v FROM f WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
 o AS (SELECT run_id,slice,latency_ms,row_number() OVER (PARTITION BY run_id,slice ORDER BY latency_ms)-1 AS i,count(*) OVER (PARTITION BY run_id,slice) AS n FROM predictions WHERE NOT (run_id='wide' AND slice='lang')),
 t AS (SELECT run_id,slice,max(latency_ms) FILTER (i=n//2) AS p FROM o GROUP BY ALL),
 e AS (SELECT run_id,slice FROM (SELECT DISTINCT run_id FROM predictions),(SELECT DISTINCT slice FROM predictions))
 SELECT run_id,slice,coalesce(floor(v+0.5)::BIGINT::VARCHAR,'n/a') AS flipped_permille,coalesce(floor(p+0.5)::BIGINT::VARCHAR,'n/a') AS p50_ms FROM e LEFT JOIN s USING (run_id,slice) LEFT JOIN t USING (run_id,slice)""")
def order_and_latency(spark, d):
    """Order sensitivity and median latency of every run and slice; one run here did not see the `lang` slice."""
    return M.order_and_latency(S.predictions(spark, d).where("NOT (run_id = 'wide' AND slice = 'lang')"))


CDF = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
       0.9994058151824183, 0.999916758850712, 0.9999898032318297, 0.9999988748269639, 0.9999998885745217]
RESAMPLES = 2000


@query(P + f""", f AS (SELECT run_id,slice,family_id,sum(CASE WHEN task_type='score' THEN abs(expected_level-TRY_CAST(gold AS DOUBLE)) ELSE (lower(pred)=lower(gold))::INT END) AS s,count(*) AS n
  FROM predictions WHERE {OK} GROUP BY ALL),
 w AS (SELECT b,family_id,('0x'||substr(sha256('bootstrap:'||((b-1)//8)||':'||family_id),8*((b-1)%8)+1,8))::BIGINT/4294967295.0::DOUBLE AS uu FROM (SELECT DISTINCT family_id FROM f), range(1,{RESAMPLES + 1}) t(b)),
 w2 AS (SELECT b,family_id,CASE {" ".join(f"WHEN uu<={c!r}::DOUBLE THEN {i}" for i, c in enumerate(CDF))} ELSE 10 END AS w FROM w),
 m AS (SELECT run_id,slice,b,sum(w*s)/nullif(sum(w*n),0) AS m FROM f JOIN w2 USING (family_id) GROUP BY ALL)
 SELECT run_id,slice,round(quantile_cont(m,0.025),6) AS ci_low,round(quantile_cont(m,0.975),6) AS ci_high FROM m GROUP BY ALL""")
def bootstrap_interval(spark, d):
    """95% interval by family over 2,000 resamples."""
    return rounded(M.bootstrap_interval(S.predictions(spark, d), RESAMPLES))


@query(P + f""", a AS (SELECT run_id,slice,avg((lower(pred)=lower(gold))::INT) AS acc,count(*) AS n FROM predictions WHERE {CMP} GROUP BY ALL)
 SELECT run_id,round(avg(acc),6) AS mean_accuracy,count(*) AS n_slices,sum(n)::BIGINT AS n FROM a GROUP BY run_id""")
def slice_mean_accuracy(spark, d):
    return rounded(M.slice_mean_accuracy(S.predictions(spark, d)))

"""Queries that make prediction records, average runs and orders, batch rows, read and write files, and run the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import options as O
from ..functions.hashing import hash_fraction
from ..functions.text import reply_label
from ..operators import batching as B
from ..operators import calibration as C
from ..operators import combine as X
from ..operators.scale import materialise, new_path, spread_rows
from ..sources import derived as S
from ..sources import tables as IO
from ..sources.tables import table
from ..streaming import jobs as J
from .calibrating import ITEMS, R, fit_sql
from .evaluation import OK, P
from .oracle import CASES, u, weights
from .registry import query, rounded

ENS = P + f""", m AS (SELECT *,list_position(['base','tuned','wide'],run_id) AS o FROM predictions WHERE run_id IN ('base','tuned','wide')),
 w AS (SELECT case_id FROM m GROUP BY 1 HAVING count(DISTINCT run_id)=3 AND count(*) FILTER (NOT ({OK}))=0),
 e AS (SELECT case_id,any_value(task_type) AS task_type,any_value(keys) AS keys,sum(latency_ms) AS latency_ms,(list(probs) FILTER (o=1))[1] AS p1,(list(probs) FILTER (o=2))[1] AS p2,(list(probs) FILTER (o=3))[1] AS p3 FROM m WHERE case_id IN (SELECT case_id FROM w) GROUP BY 1),
 f AS (SELECT *,list_transform(range(1,len(keys)+1), lambda i: (p1[i]+p2[i]+p3[i])/3.0) AS p FROM e)"""
ANSWER = "CASE WHEN task_type='noul' THEN (p[list_position(keys,'true')]>=0.5)::VARCHAR ELSE keys[list_position(p,list_max(p))] END"


@query(ENS + f""" SELECT case_id,{ANSWER} AS pred,round(CASE WHEN task_type='noul' THEN greatest(p[2],1-p[2]) ELSE list_max(p) END,6) AS confidence,round(latency_ms,6) AS latency_ms,
 round(CASE WHEN task_type='score' THEN list_sum(list_transform(range(1,len(keys)+1), lambda i: keys[i]::DOUBLE*p[i])) END,6) AS expected_level FROM f""")
def ensemble_of_runs(spark, d):
    """Average of three runs on the cases all of them answered."""
    e = X.ensemble(S.predictions(spark, d), ["base", "tuned", "wide"], "average")
    return rounded(e.select("case_id", "pred", "confidence", "latency_ms", "expected_level"))


ORD = ("WITH " + CASES + f""", os AS (SELECT case_id,slice,task_type,gold,keys,{u("'orders:'||case_id||':err'")}<0.01 AS failed,'o'||n AS run_id,0.3::DOUBLE AS strength,n FROM cases,range(1,4) t(n) WHERE task_type='choice'),
 ow AS (SELECT *,{weights('run_id', 'strength', 'case_id')} AS w FROM os),op AS (SELECT case_id,any_value(keys) AS keys,any_value(failed) AS failed,list(list_transform(w, lambda x: x/list_sum(w)) ORDER BY n) AS d FROM ow GROUP BY 1)""")


def _orders(spark, d):
    """Per choice case three option orders with a distribution each, as key maps."""
    c = S.spread_cases(spark, d).where("task_type = 'choice'").withColumn("option_keys", O.keys_of("options"))
    def one(n):
        p = S.drawn_probs(F.lit(f"o{n}"), F.lit(0.3), F.col("case_id"), F.col("option_keys"), F.col("gold"))
        return F.struct(F.col("option_keys").alias("order"), F.map_from_arrays("option_keys", p).alias("by_key"))
    failed = hash_fraction(F.concat_ws(":", F.lit("orders"), "case_id", F.lit("err"))) < 0.01
    return c.withColumn("orders", F.array(one(1), one(2), one(3))).withColumn("error", F.when(failed, F.lit("timeout")))


def _mean_sql(how, n):
    s = "+".join(f"d[{j}][i]" for j in range(1, n + 1))
    g = "+".join(f"ln(greatest(d[{j}][i],1e-15))" for j in range(1, n + 1))
    return f"list_transform(range(1,len(keys)+1), lambda i: ({s})/{n}.0)" if how == "arith" else f"list_transform(range(1,len(keys)+1), lambda i: exp(({g})/{n}.0))"


ORD_SQL = ORD + " " + " UNION ALL ".join(
    f"SELECT case_id,'{'orders-n1' if n == 1 else f'orders-n{n}-{h}'}' AS run_id,CASE WHEN failed THEN NULL ELSE keys[list_position(q,list_max(q))] END AS pred,CASE WHEN NOT failed THEN round(list_max(q)/list_sum(q),6) END AS confidence FROM (SELECT *,{_mean_sql(h, n)} AS q FROM op)"
    for n, h in [(1, "arith"), (2, "arith"), (2, "geo"), (3, "arith"), (3, "geo")])


@query(ORD_SQL)
def averaged_orders(spark, d):
    """Arithmetic and geometric means over the first one, two and three option orders."""
    rows = materialise(_orders(spark, d).select("case_id", "task_type", "option_keys", "orders", "error"), "orders")
    out = [X.average_orders(rows, n, how).select("case_id", "run_id", "pred", "confidence") for n, how in [(1, "arith"), (2, "arith"), (2, "geo"), (3, "arith"), (3, "geo")]]
    return rounded(IO.union_all(*out))


CODED_ROWS = 10_000  # of one task: a row of some fifty codes takes as long as ten of the others


def _tops(spark, d):
    """Top tokens of one call per case: raw spellings with spaces, some labels missing."""
    c = S.spread_cases(spark, d).withColumn("option_keys", O.keys_of("options")).withColumn("error", F.lit(None).cast("string"))
    labels = O.labels_for(F.size("option_keys"))
    lp = lambda k, s: F.log(hash_fraction(F.concat_ws(":", F.lit("top"), "case_id", k, F.lit(s))) * 0.8 + 0.01)
    seen = F.filter(labels, lambda k: hash_fraction(F.concat_ws(":", F.lit("seen"), "case_id", k)) < 0.9)
    spaced = F.transform(seen, lambda k: F.struct(F.concat(F.lit(" "), k).alias("k"), lp(k, "a").alias("v")))
    bare = F.transform(seen, lambda k: F.struct(k.alias("k"), lp(k, "b").alias("v")))
    noise = F.array(F.struct(F.lit(" ").alias("k"), F.lit(-0.5).alias("v")), F.struct(F.lit("x").alias("k"), F.lit(-5.0).alias("v")))
    return c.withColumn("top", F.map_from_entries(F.concat(spaced, bare, noise)))


def _lp(s):
    inner = "'top:'||case_id||':'||k||':" + s + "'"
    return f"ln({u(inner)}*0.8+0.01)"


@query("WITH " + CASES + f""", l AS (SELECT *,list_transform(range(0,len(keys)), lambda i: chr((65+i)::INT)) AS labs FROM cases),
 r AS (SELECT *,list_transform(labs, lambda k: CASE WHEN {u("'seen:'||case_id||':'||k")}<0.9 THEN exp(greatest({_lp('a')},{_lp('b')})) ELSE 0.0 END) AS raw FROM l),
 f AS (SELECT *,0.5*least(list_min(list_filter(raw, lambda x: x>0)),exp(-5.0::DOUBLE)) AS fl FROM r),g AS (SELECT *,list_transform(raw, lambda x: CASE WHEN x>0 THEN x ELSE coalesce(fl,0.5*exp(-5.0::DOUBLE)) END) AS p FROM f)
 SELECT case_id,{ANSWER.replace("p[list_position(keys,'true')]>=0.5", "p[list_position(keys,'true')]/list_sum(p)>=0.5")} AS pred,round(list_max(p)/list_sum(p),6) AS top_p,round(list_sum(raw),6) AS label_mass FROM g""")
def records_from_logprobs(spark, d):
    """Predictions out of token log-probabilities, with the mass the labels held."""
    out = X.records_from_logprobs(_tops(spark, d))
    return rounded(out.select("case_id", "pred", F.array_max("probs").alias("top_p"), "label_mass"))


@query("""WITH r AS (SELECT p_partkey,27+p_partkey%30 AS n FROM part),k AS (SELECT p_partkey,n,10+i AS code,floor((10+i)/10)::INT AS f,(10+i)%10 AS s FROM r,range(0,60) t(i) WHERE i<n),
 fm AS (SELECT p_partkey,f,CASE WHEN f=3 THEN 0.0002 ELSE 0.1*(1+(p_partkey+f)%5) END AS p,count(*) AS ns,sum(0.05*(1+s)) AS ss FROM k GROUP BY p_partkey,f),ft AS (SELECT p_partkey,sum(p) AS t FROM fm GROUP BY 1)
 SELECT p_partkey,arg_max(code,(round(q,12),-code))::VARCHAR AS pred,round(max(q),6) AS top_p,round(sum(q),6) AS total FROM (SELECT k.p_partkey,code,p/t*CASE WHEN p/t>=0.001 THEN 0.05*(1+s)/ss ELSE 1.0/ns END AS q FROM k JOIN fm USING (p_partkey,f) JOIN ft USING (p_partkey)) GROUP BY 1""")
def records_from_codes(spark, d):
    """Two-digit codes: first digit times second digit, a negligible first digit spread evenly."""
    k = F.col("p_partkey")
    part = spread_rows(table(spark, d, "part").select("p_partkey"), rows=CODED_ROWS).select("p_partkey", F.transform(F.sequence(F.lit(10), (F.lit(36) + k % 30).cast("int")), lambda i: i.cast("string")).alias("option_keys"))
    firsts = F.array_distinct(F.transform("option_keys", lambda x: F.substring(x, 1, 1)))
    top = F.map_from_entries(F.transform(firsts, lambda f: F.struct(f.alias("k"), F.log(F.when(f == "3", F.lit(0.0002)).otherwise((F.pmod(k + f.cast("int"), F.lit(5)) + 1) * F.lit(0.1))).alias("v"))))
    seconds = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda s: F.struct(s.cast("string").alias("k"), F.log((s + 1) * F.lit(0.05)).alias("v"))))
    rows = part.select("p_partkey", "option_keys", F.lit("choice").alias("task_type"), top.alias("top"), F.map_from_entries(F.transform(firsts, lambda f: F.struct(f.alias("k"), seconds.alias("v")))).alias("second"))
    out = X.records_from_codes(rows)
    return rounded(out.select("p_partkey", "pred", F.array_max("probs").alias("top_p"), F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("WITH " + CASES + """ SELECT case_id,CASE WHEN length(case_id)%5=0 THEN NULL ELSE keys[2] END AS pred,CASE WHEN length(case_id)%5=0 THEN 'unparseable reply' END AS error FROM cases""")
def records_from_replies(spark, d):
    """One-hot records out of single replies."""
    c = S.spread_cases(spark, d).withColumn("option_keys", O.keys_of("options"))
    reply = F.when(F.length("case_id") % 5 == 0, F.lit("no idea")).otherwise(F.lit("answer: b)"))
    rows = c.withColumn("label", reply_label(reply, O.labels_for(F.size("option_keys"))))
    return X.record_from_reply(rows, "label").select("case_id", "pred", "error")


@query("""WITH p AS (SELECT doc_id,n_chars,row_number() OVER (ORDER BY sha256('epoch:'||doc_id),doc_id)-1 AS pos FROM documents),w AS (SELECT *,pos//128 AS win FROM p),r AS (SELECT *,row_number() OVER (PARTITION BY win ORDER BY n_chars,pos)-1+win*128 AS rank FROM w)
 SELECT doc_id,win AS "window",rank//16 AS batch,rank%16 AS place FROM r WHERE rank//16<(SELECT count(*)//16 FROM documents)""")
def windowed_batches(spark, d):
    """Batches of 16 out of length-sorted windows of 8 batches."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars")
    return B.windowed_batches(rows, 16, "n_chars", ["doc_id"], "epoch", windows=8).select("doc_id", "window", "batch", "place")


def _pack_sql(src: str, by: str, budget: int) -> str:
    return f"""pk AS (SELECT {by},place,len,id,0 AS piece,1 AS cnt,len AS longest FROM {src} WHERE place=0
 UNION ALL SELECT s.{by},s.place,s.len,s.id,CASE WHEN greatest(p.longest,s.len)*(p.cnt+1)<={budget} THEN p.piece ELSE p.piece+1 END,CASE WHEN greatest(p.longest,s.len)*(p.cnt+1)<={budget} THEN p.cnt+1 ELSE 1 END,
  CASE WHEN greatest(p.longest,s.len)*(p.cnt+1)<={budget} THEN greatest(p.longest,s.len) ELSE s.len END FROM pk p JOIN {src} s ON s.{by}=p.{by} AND s.place=p.place+1)"""


@query("""WITH RECURSIVE p AS (SELECT doc_id,n_chars,row_number() OVER (ORDER BY sha256('epoch:'||doc_id),doc_id)-1 AS pos FROM documents),w AS (SELECT *,pos//128 AS win FROM p),r AS (SELECT *,row_number() OVER (PARTITION BY win ORDER BY n_chars,pos)-1+win*128 AS rank FROM w),
 src AS MATERIALIZED (SELECT doc_id AS id,n_chars AS len,rank//16 AS batch,rank%16 AS place FROM r WHERE rank//16<(SELECT count(*)//16 FROM documents)),""" + _pack_sql("src", "batch", 32000) + " SELECT batch,place,piece,id AS doc_id FROM pk")
def batches_split_by_tokens(spark, d):
    """Each batch cut into consecutive pieces under a padded size of 32,000."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars")
    batches = B.windowed_batches(rows, 16, "n_chars", ["doc_id"], "epoch", windows=8).drop("window")
    out = B.split_by_tokens(batches, ["batch"], "place", "n_chars", 32000, ids=["doc_id"])
    return out.select("batch", "place", F.col("piece").cast("int").alias("piece"), "doc_id")


@query("""WITH RECURSIVE src AS MATERIALIZED (SELECT doc_id AS id,n_chars AS len,0 AS grp,row_number() OVER (ORDER BY n_chars,sha256('tokens:'||doc_id),doc_id)-1 AS place FROM documents),"""
       + _pack_sql("src", "grp", 48000) + " SELECT piece::BIGINT AS batch,row_number() OVER (PARTITION BY piece ORDER BY place)-1 AS place,id AS doc_id FROM pk")
def token_batches(spark, d):
    """Length-bucketed batches under a padded size of 48,000, one greedy pass over all documents."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars")
    return B.token_batches(rows, "n_chars", ["doc_id"], 48000).select("batch", "place", "doc_id")


@query("""SELECT CASE WHEN lang='en' THEN 'english' ELSE 'other' END AS config,CASE doc_id%10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split,count(*) AS n,sum(n_chars)::BIGINT AS chars
 FROM documents WHERE lang='en' AND doc_id%10 IN (0,1) OR lang<>'en' AND doc_id%10>1 GROUP BY ALL""")
def landed_splits(spark, d):
    """Two configurations of three splits landed from the documents; two splits of one and one of the other are read."""
    root = new_path(spark, "landed")
    docs = table(spark, d, "documents").where("lang IS NOT NULL")
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train")
    for config, rows in (("english", docs.where("lang = 'en'")), ("other", docs.where("lang <> 'en'"))):
        for name in ("train", "validation", "test"):
            IO.land(rows.where(split == name), root, config, name)
    read = IO.landed(spark, root, "english", ["test", "validation"]).unionByName(IO.landed(spark, root, "other", ["train"]))
    return read.groupBy("config", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


PRED_SCHEMA = "case_id string, slice string, task_type string, pred string, gold string, error string"


@query(P + f" SELECT run_id,count(*) AS n,count(*) FILTER (lower(pred)=lower(gold)) AS correct FROM predictions WHERE {OK} AND task_type<>'score' GROUP BY 1")
def runs_read_from_files(spark, d):
    """Runs written as gzip JSON lines in one folder each, a smoke run and broken lines beside them, read back and filtered."""
    root = new_path(spark, "runs")
    preds = S.predictions(spark, d).select("run_id", "case_id", "slice", "task_type", "pred", "gold", "error")
    for run in S.RUNS:
        IO.write_jsonl(preds.where(F.col("run_id") == run).drop("run_id"), f"{root}/{run}/predictions.jsonl", gzip=True)
    IO.write_jsonl(preds.limit(5).drop("run_id"), f"{root}/smoke-1/predictions.jsonl")
    good, _ = IO.quarantine(IO.read_predictions(spark, root, PRED_SCHEMA))
    ok = IO.answered(good)
    return ok.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("pred") == F.lower("gold")).alias("correct"))


@query("SELECT CASE WHEN event_id%10=0 THEN 'broken' ELSE 'good' END AS kind,count(*) AS n FROM events WHERE event_id%7<>0 GROUP BY 1")
def broken_lines_quarantined(spark, d):
    """Blank lines are skipped, broken lines are kept apart with their text."""
    path = new_path(spark, "lines")
    ev = table(spark, d, "events")
    line = F.when(F.col("event_id") % 7 == 0, F.lit("  ")).when(F.col("event_id") % 10 == 0, F.concat(F.lit('{"case_id": "'), F.col("event_id"))).otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("case_id"))))
    ev.select(line.alias("value")).write.text(path)
    good, bad = IO.quarantine(IO.read_jsonl(spark, path, "case_id string"))
    return IO.union_all(good.select(F.lit("good").alias("kind")), bad.select(F.lit("broken").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------------------------------------------- streaming

FAIL = u("'first:'||doc_id")


@query(f"SELECT doc_id::VARCHAR AS row_id,CASE WHEN {FAIL}<0.1 THEN 'second' ELSE 'first' END AS teacher FROM documents")
def streaming_labels(spark, d):
    """Labelling over a file stream; rows that failed come back by themselves and are labelled by another teacher."""
    schema = table(spark, d, "documents").schema
    root = new_path(spark, "labelling")
    rows = J.read_files(spark, f"{d}/[d]ocuments.parquet", schema).select(F.col("doc_id").cast("string").alias("row_id"), "text")

    def label(batch):
        failed = (F.col("attempt") == 1) & (hash_fraction(F.concat(F.lit("first:"), F.col("row_id"))) < 0.1)
        teacher = F.when(F.col("attempt") == 1, "first").otherwise("second")
        return batch.select("row_id", teacher.alias("teacher"), F.length("text").alias("input_tokens"), F.when(failed, F.lit("timeout")).alias("error"))

    J.label_with_retries(rows, label, f"{root}/labels", f"{root}/retry", f"{root}/checkpoint", delay=1.0, interval=0.5).awaitTermination()
    return J.read_labels(spark, f"{root}/labels").select("row_id", "teacher")


@query("SELECT doc_id,length(text) AS n FROM documents WHERE length(text) BETWEEN 60 AND 1500 AND regexp_matches(text,'tion')")
def streaming_filtered_pass(spark, d):
    """An incremental filtered pass over a file stream."""
    root = new_path(spark, "pass")
    t = table(spark, d, "documents")
    s = J.read_files(spark, f"{d}/[d]ocuments.parquet", t.schema)
    J.filtered_pass(s, F.length("text").between(60, 1500) & F.col("text").rlike("tion"), f"{root}/kept", f"{root}/counts", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/kept/batch=*").select("doc_id", F.length("text").alias("n"))


@query("""WITH seen AS (SELECT doc_id,text FROM documents ORDER BY doc_id LIMIT 150) SELECT doc_id FROM (SELECT doc_id FROM seen WHERE length(text) BETWEEN 60 AND 1500 ORDER BY doc_id LIMIT 40)""")
def streaming_early_stop(spark, d):
    """A filtered pass that stops keeping at 40 kept or 150 seen rows; the stop is the feature."""
    root = new_path(spark, "stop")
    s = J.read_files(spark, f"{d}/[d]ocuments.parquet", table(spark, d, "documents").schema)
    J.filtered_pass(s, F.length("text").between(60, 1500), f"{root}/kept", f"{root}/counts", f"{root}/checkpoint", max_kept=40, max_seen=150, order="doc_id").awaitTermination()
    return spark.read.parquet(f"{root}/kept/batch=*").select("doc_id")


@query(R + ITEMS + fit_sql("items", []) + f""", q AS (SELECT event_id,event_id%4=3 AS bad,CASE WHEN event_id%3=0 THEN 'noul' WHEN event_id%3=1 THEN 'choice' ELSE 'score' END AS task_type,CASE WHEN event_id%3=0 THEN ['false','true'] WHEN event_id%3=1 THEN ['a','b','c'] ELSE ['0','1','2'] END AS keys,'?' AS gold FROM events),
 w AS (SELECT *,{weights("'s1'", "0.0::DOUBLE", "event_id::VARCHAR")} AS w1,{weights("'s2'", "0.0::DOUBLE", "event_id::VARCHAR")} AS w2 FROM q WHERE NOT bad),
 p AS (SELECT *,list_transform(range(1,len(keys)+1), lambda i: CASE WHEN task_type='choice' THEN (w1[i]/list_sum(w1)+w2[i]/list_sum(w2))/2 ELSE w1[i]/list_sum(w1) END) AS p FROM w),
 c AS (SELECT p.*,temperature,a,b,list_transform(p, lambda x: exp((ln(x)-ln(list_max(p)))/temperature)) AS e FROM p JOIN fit USING (task_type))
 SELECT event_id AS request_id,task_type,round(CASE WHEN task_type='noul' THEN p[2] END,6) AS noul_raw,round(CASE WHEN task_type='noul' THEN 1/(1+exp(-greatest(least(a*(ln(p[2])-ln(1-p[2]))+b,50),-50))) END,6) AS noul,
 CASE WHEN task_type='choice' THEN keys[list_position(e,list_max(e))] END AS choice,round(CASE WHEN task_type='score' THEN list_sum(list_transform(range(1,4), lambda i: (i-1)*e[i]))/list_sum(e) END,6) AS score,
 round(CASE WHEN task_type<>'noul' THEN list_max(e)/list_sum(e) END,6) AS confidence FROM c""")
def streaming_decisions(spark, d):
    """Requests over a file stream to calibrated answers; broken requests go to the rejected table."""
    root = new_path(spark, "decisions")
    cal = materialise(C.defaults(S.predictions(spark, d)), "calibration")
    ev = table(spark, d, "events")
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "noul").when(e % 3 == 1, "choice").otherwise("score")
    crit = F.when(e % 3 == 0, F.lit("{}")).when(e % 3 == 1, F.lit('{"a":"A","b":"B","c":"C"}')).otherwise(F.lit('["low","mid","high"]'))
    body = F.when(e % 4 == 3, F.lit("not json")).otherwise(F.concat(F.lit('{"q":{"type":"'), kind, F.lit('","instructions":"x","criteria":'), crit, F.lit("}}")))
    requests = J.read_files(spark, f"{d}/[e]vents.parquet", ev.schema).select(e.alias("request_id"), F.col("props").alias("state"), body.alias("questions"))

    def scorer(good):
        q = F.try_variant_get(F.parse_json("questions"), "$.q.type", "string")
        rows = good.select("request_id", F.lit("q").alias("name"), q.alias("task_type"))
        keys = F.when(q == "noul", F.array(F.lit("false"), F.lit("true"))).when(q == "choice", F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("0"), F.lit("1"), F.lit("2")))
        rows = good.select("request_id", F.lit("q").alias("name"), q.alias("task_type"), keys.alias("option_keys"))
        one = lambda run: F.struct(F.col("option_keys").alias("order"), F.map_from_arrays("option_keys", S.drawn_probs(F.lit(run), F.lit(0.0), F.col("request_id").cast("string"), F.col("option_keys"), F.lit("?"))).alias("by_key"))
        return rows.withColumn("orders", F.array(one("s1"), one("s2")))

    J.decision_stream(requests, scorer, cal, f"{root}/answers", f"{root}/rejected", f"{root}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{root}/answers/batch=*").select("request_id", "task_type", "noul_raw", "noul", "choice", "score", "confidence"))

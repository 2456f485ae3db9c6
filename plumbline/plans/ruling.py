"""Queries that label rows of the driver's tables with the policy rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import timelines as TL
from ..sources.tables import table
from .registry import query


@query("""WITH t AS (SELECT l_orderkey,sum(l_extendedprice*(1-l_discount)) AS total,count(*) AS lines,count(*) FILTER (l_linestatus='F') AS shipped,count(DISTINCT l_suppkey) AS vendors FROM lineitem GROUP BY 1)
 SELECT o_orderkey,round(o_totalprice,2)<>0 AND abs(round((total-o_totalprice)/o_totalprice*100,4))<=2 AND shipped=lines AND vendors>1 AS approved FROM orders JOIN t ON l_orderkey=o_orderkey""")
def invoice_match(spark, d):
    """Order total against its lines, all lines shipped, more than one vendor."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total"), F.count(F.lit(1)).alias("lines"),
                                                               F.count_if(F.col("l_linestatus") == "F").alias("shipped"), F.countDistinct("l_suppkey").alias("vendors"))
    o = table(spark, d, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    pct = F.round((F.col("total") - F.col("o_totalprice")) / F.col("o_totalprice") * 100, 4)
    return o.select("o_orderkey", R.invoice_match(pct, "shipped", "lines", F.col("vendors") > 1).alias("approved"))


DAY_LIMITS = {"1-URGENT": 15, "2-HIGH": 60, "3-MEDIUM": 240, "4-NOT SPECIFIED": 1440, "5-LOW": 1440}


@query("""SELECT l_orderkey,l_linenumber,l_partkey,l_suppkey,datediff('day',o_orderdate,l_shipdate)-l_linenumber>CASE substr(o_orderpriority,1,1) WHEN '1' THEN 15 WHEN '2' THEN 60 WHEN '3' THEN 240 ELSE 1440 END AS breached
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey""")
def sla_breach(spark, d):
    """Days to ship, less paused days, against the limit of the order's priority."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    waited = F.date_diff("l_shipdate", "o_orderdate")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.sla_breach("o_orderpriority", waited, "l_linenumber", DAY_LIMITS).alias("breached"))


@query("""WITH e AS (SELECT *,lag(ts) OVER (PARTITION BY user_id,event_type ORDER BY ts,event_id) AS p FROM events WHERE event_type='error')
 SELECT event_id,user_id,epoch_us(ts)-epoch_us(p) AS gap_us,epoch_us(ts)-epoch_us(p)<=900000000 AS same_incident FROM e WHERE p IS NOT NULL""")
def alert_same_incident(spark, d):
    """Each error and the one before it of the same user: one incident within 15 minutes."""
    ev = table(spark, d, "events").where("event_type = 'error'")
    return TL.alerts_of_one_incident(ev, "user_id", "event_type", "ts", "event_id")


@query("SELECT o_orderkey,count(*)=count(*) FILTER (l_linestatus='F') AND count(*) FILTER (l_returnflag='R')=0 AS done FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1")
def goal_completed(spark, d):
    """Every line of an order delivered and none returned."""
    j = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("ok"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    return j.select(F.col("l_orderkey").alias("o_orderkey"), R.goal_done("ok", "n", F.col("bad") > 0).alias("done"))


@query("""SELECT event_id,CASE event_id%9 WHEN 0 THEN 'email' WHEN 1 THEN 'email' WHEN 2 THEN CASE WHEN (json_extract(props,'$.k'))::INT=0 THEN 'age' ELSE 'none' END WHEN 3 THEN 'age' WHEN 4 THEN 'country_code' WHEN 5 THEN 'country_code'
 WHEN 6 THEN 'start_date' WHEN 7 THEN 'start_date' ELSE 'none' END AS bad FROM events""")
def payload_validation(spark, d):
    """Which field of a request payload breaks its schema."""
    ev = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")).withColumn("c", F.col("event_id") % 9)
    at = lambda n, bad, good: F.when(F.col("c") == n, bad).otherwise(good)
    email = at(0, F.concat("event_type", F.lit("example.com")), at(1, F.concat("event_type", F.lit("@@example.com")), F.concat("event_type", F.lit("@example.com"))))
    age = at(2, F.col("k"), at(3, F.concat("k", F.lit(" years")), F.lit("41")))
    country = at(4, F.lit("USA"), at(5, F.lit("de"), F.lit("DE")))
    start = at(6, F.lit("2026-13-01"), at(7, F.lit("tomorrow"), F.date_format("ts", "yyyy-MM-dd")))
    return ev.select("event_id", R.invalid_field(email, age, country, start).alias("bad"))


@query("SELECT c_custkey,18+c_custkey%60-10>=18 AND c_acctbal>0 AND NOT (c_mktsegment='BUILDING' AND c_acctbal<500) AND c_nationkey<20 AS passes FROM customer")
def kyc_check(spark, d):
    c = table(spark, d, "customer")
    sanctioned = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < 500)
    return c.select("c_custkey", R.kyc_passes(F.lit(18) + F.col("c_custkey") % 60 - 10, F.col("c_acctbal") > 0, sanctioned, F.col("c_nationkey") < 20).alias("passes"))


@query("""WITH a AS (SELECT user_id,count(*) FILTER (ts<TIMESTAMP '2024-01-16') AS n1,count(*) FILTER (ts>=TIMESTAMP '2024-01-16') AS n2,count(*) FILTER (event_type='error') AS tickets FROM events GROUP BY 1),b AS (SELECT *,(n1-n2)*100.0::DOUBLE/greatest(n1,1) AS dp,user_id%120 AS days FROM a)
 SELECT user_id,CASE WHEN dp>40 AND days<=30 THEN 3 WHEN dp>40 OR (tickets>6 AND days<=90) THEN 2 WHEN dp>10 OR tickets>3 THEN 1 ELSE 0 END AS risk FROM b""")
def churn_risk(spark, d):
    """Drop between two half months, error tickets, days left."""
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    a = table(spark, d, "events").groupBy("user_id").agg(F.count_if(early).alias("n1"), F.count_if(~early).alias("n2"), F.count_if(F.col("event_type") == "error").alias("tickets"))
    drop = (F.col("n1") - F.col("n2")) * F.lit(100.0) / F.greatest("n1", F.lit(1))
    return a.select("user_id", R.churn_risk(drop, "tickets", F.col("user_id") % 120).alias("risk"))


KINDS = {"error": "damaged", "click": "on_track", "view": "on_track", "purchase": "customs_hold", "signup": "address_issue"}


@query("SELECT user_id,CASE arg_max(event_type,(ts,event_id)) WHEN 'error' THEN 'damaged' WHEN 'purchase' THEN 'customs_hold' WHEN 'signup' THEN 'address_issue' ELSE 'on_track' END AS status FROM events GROUP BY 1")
def latest_event_class(spark, d):
    """Exception class of the latest event per user."""
    last = TL.latest(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")
    return last.select("user_id", R.shipment_exception(F.array("event_type"), KINDS).alias("status"))


@query("""SELECT l_orderkey,l_linenumber,l_partkey,l_suppkey,datediff('day',l_shipdate,TIMESTAMP '1999-01-01')<=30+l_linenumber*10 AND l_returnflag NOT IN ('R') AND NOT l_discount>=0.1 AND NOT l_tax>=0.08 AS eligible FROM lineitem""")
def refund_eligibility(spark, d):
    li = table(spark, d, "lineitem")
    days = F.date_diff(F.lit("1999-01-01").cast("date"), "l_shipdate")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.refund_eligible(
        days, F.lit(30) + F.col("l_linenumber") * 10, "l_returnflag", F.col("l_discount") >= 0.1, F.col("l_tax") >= 0.08, ("R",)).alias("eligible"))


@query("""WITH h AS (SELECT date_trunc('hour',ts) AS hour,count(*) FILTER (event_type='error')*100.0::DOUBLE/count(*) AS rate,count(DISTINCT user_id) FILTER (event_type='error') AS users,bool_or(event_type='purchase') AS facing,max(value)>99 AS loss FROM events GROUP BY 1)
 SELECT hour,CASE WHEN loss OR (facing AND (rate>=30 OR users>=5000)) THEN 3 WHEN facing AND (rate>=5 OR users>=50) THEN 2 WHEN rate>=1 OR users>0 THEN 1 ELSE 0 END AS severity FROM h""")
def incident_severity(spark, d):
    """Hourly error rate, affected users, whether customers are hit."""
    err = F.col("event_type") == "error"
    h = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        (F.count_if(err) * F.lit(100.0) / F.count(F.lit(1))).alias("rate"), F.countDistinct(F.when(err, F.col("user_id"))).alias("users"),
        F.bool_or(F.col("event_type") == "purchase").alias("facing"), (F.max("value") > 99).alias("loss"))
    return h.select("hour", R.incident_severity("rate", "users", "facing", "loss").alias("severity"))


@query("""SELECT o_orderkey,CASE WHEN topic='security' THEN 'security' WHEN tier='enterprise' THEN 'account_team' WHEN topic='how_to' AND tier='free' THEN 'self_serve' WHEN topic='billing' THEN 'billing' ELSE 'support_engineering' END AS route FROM (
 SELECT o_orderkey,CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'security' WHEN '2' THEN 'bug' WHEN '3' THEN 'billing' ELSE 'how_to' END AS topic,CASE c_mktsegment WHEN 'BUILDING' THEN 'enterprise' WHEN 'HOUSEHOLD' THEN 'free' ELSE 'pro' END AS tier FROM orders JOIN customer ON o_custkey=c_custkey)""")
def ticket_routing(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    p = F.substring("o_orderpriority", 1, 1)
    topic = F.when(p == "1", "security").when(p == "2", "bug").when(p == "3", "billing").otherwise("how_to")
    tier = F.when(F.col("c_mktsegment") == "BUILDING", "enterprise").when(F.col("c_mktsegment") == "HOUSEHOLD", "free").otherwise("pro")
    return o.select("o_orderkey", R.ticket_route(topic, tier).alias("route"))


@query("""WITH p AS (SELECT *,lag(event_type,1) OVER w AS a,lag(event_type,2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts,event_id))
 SELECT user_id,count(*) AS events,count(*) FILTER (event_type=a AND event_type=b) AS repeats,count(*) FILTER (event_type=a AND event_type=b)>0 AS looping FROM p GROUP BY 1""")
def agent_loop(spark, d):
    """Users with three equal events in a row."""
    return TL.looping_keys(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


PATTERNS = {"disk_full": "(?i)de la", "oom": "ung", "auth_failure": "tion", "network": "[0-9]{3}"}


@query("""SELECT doc_id,CASE WHEN len(list_filter(l, lambda x: regexp_matches(x,'de la','i')))>0 THEN 'disk_full' WHEN len(list_filter(l, lambda x: regexp_matches(x,'ung')))>0 THEN 'oom' WHEN len(list_filter(l, lambda x: regexp_matches(x,'tion')))>0 THEN 'auth_failure'
 WHEN len(list_filter(l, lambda x: regexp_matches(x,'[0-9]{3}')))>0 THEN 'network' ELSE 'none' END AS problem FROM (SELECT doc_id,string_split(text,chr(10)) AS l FROM documents)""")
def log_anomaly(spark, d):
    """The first problem any line of a document matches."""
    return table(spark, d, "documents").select("doc_id", R.log_anomaly(F.split("text", "\n"), PATTERNS).alias("problem"))


@query(r"""WITH b AS (SELECT doc_id,len(string_split(text,chr(10))) AS lines,list_sum(list_transform(string_split(text,chr(10)), lambda x: len(list_filter(regexp_split_to_array(x,'\s+'), lambda w: w<>''))))::INT AS words FROM documents)
 SELECT doc_id,words,CASE WHEN words<=30 THEN 0 WHEN words<=60 THEN 1 WHEN words<=100 THEN 2 ELSE 3 END AS density,lines>6 OR words>90 AS split FROM b""")
def slide_density_and_split(spark, d):
    """Words per document as bullet text: density level, and whether to split."""
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("b")).withColumn("words", R.words_in("b"))
    return docs.select("doc_id", "words", R.slide_density("words").alias("density"), R.split_slide(F.size("b"), "words").alias("split"))


@query("""SELECT event_id,t='passed' AND s IN ('clean','low') AND a>=CASE WHEN h THEN 1 ELSE 2 END AND (NOT f OR h) AS deploy,ah OR conf<0.5 OR a+1>=3 OR mood='angry' AS escalate,
 CASE WHEN sens AND (mig OR lines>400) THEN 3 WHEN (sens AND NOT ta) OR lines>400 OR mig THEN 2 WHEN lines>50 OR NOT ta THEN 1 ELSE 0 END AS pr_risk,(h AND aud IN ('board','executives')) OR nums>6 AS notes,
 CASE st WHEN 429 THEN 'rate_limited' WHEN 401 THEN 'auth_error' WHEN 404 THEN 'not_found' WHEN 400 THEN 'invalid_arguments' WHEN 200 THEN 'success' ELSE CASE WHEN st IS NULL THEN 'timeout' END END AS tool_result,
 coalesce(st IN (429,500,502,503,504) AND (m IN ('GET','PUT','DELETE') OR (m='POST' AND h)) AND a+1<5,st IS NULL AND NULL) AS retry FROM (
 SELECT event_id,CASE WHEN event_id%5=0 THEN 'failed' ELSE 'passed' END AS t,['clean','low','high'][event_id%3+1] AS s,(user_id%4)::INT AS a,event_id%7=0 AS h,event_id%11=0 AS f,event_type='signup' AND event_id%2=0 AS ah,
  (event_id%100)/100.0::DOUBLE AS conf,['positive','neutral','angry'][user_id%3+1] AS mood,(event_id*37)%900 AS lines,event_id%2=0 AS ta,event_id%3=1 AS sens,event_id%13=0 AS mig,['board','team','executives'][event_id%3+1] AS aud,(json_extract(props,'$.k')::INT)%12 AS nums,
  [200,400,401,404,429,503,NULL][event_id%7+1] AS st,['GET','PUT','POST','POST'][user_id%4+1] AS m FROM events)""")
def typed_state_rules(spark, d):
    """Rules over typed states that the event table provides the fields of: deploy gate, escalation, review risk, notes, tool result, retry."""
    e, usr = F.col("event_id"), F.col("user_id")
    at = lambda vals, i: F.get(F.array(*[F.lit(v) for v in vals]), i.cast("int"))
    ev = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    ev = ev.select("event_id", F.when(e % 5 == 0, "failed").otherwise("passed").alias("tests"), at(["clean", "low", "high"], e % 3).alias("scan"), (usr % 4).alias("approvals"),
                   (e % 7 == 0).alias("hotfix"), (e % 11 == 0).alias("freeze"), ((F.col("event_type") == "signup") & (e % 2 == 0)).alias("asked"), ((e % 100) / 100.0).alias("confidence"),
                   at(["positive", "neutral", "angry"], usr % 3).alias("mood"), ((e * 37) % 900).alias("lines"), (e % 2 == 0).alias("tests_added"), (e % 3 == 1).alias("sensitive"),
                   (e % 13 == 0).alias("migration"), at(["board", "team", "executives"], e % 3).alias("audience"), (F.col("k") % 12).alias("numbers"),
                   at([200, 400, 401, 404, 429, 503, None], e % 7).alias("status"), at(["GET", "PUT", "POST", "POST"], usr % 4).alias("method"))
    tries = F.col("approvals") + 1
    return ev.select("event_id", R.deploy_gate("tests", "scan", "approvals", "freeze", "hotfix").alias("deploy"), R.agent_escalates("asked", "confidence", tries, "mood").alias("escalate"),
                     R.pull_request_risk("lines", "tests_added", "sensitive", "migration").alias("pr_risk"), R.needs_speaker_notes("audience", "hotfix", "numbers").alias("notes"),
                     R.tool_result_kind("status").alias("tool_result"), R.api_retry("status", "method", "hotfix", tries, F.lit(5)).alias("retry"))


@query("""SELECT p_partkey,a>=CASE s WHEN 'public' THEN 0 WHEN 'restricted' THEN 2 ELSE 1 END AND h<=CASE s WHEN 'confidential' THEN 24 WHEN 'restricted' THEN 8 ELSE 720 END AND (mfa OR s IN ('public','internal')) AS access,
 CASE WHEN w=2 THEN CASE WHEN env='prod' THEN 3 ELSE 2 END WHEN w=1 THEN CASE WHEN env='prod' THEN 1 ELSE 0 END ELSE 0 END AS config_risk,
 ['test_failure','build_error','lint',NULL][p_partkey%4+1] AS ci_cause,p IN ('product_showcase','team_intro') AND NOT img AS image,
 CASE WHEN p_partkey%5=0 THEN 'chart' WHEN p_partkey%5=1 THEN 'two_column' WHEN p_partkey%5=2 THEN 'image_with_caption' WHEN p_partkey%5=3 THEN 'title_bullets' ELSE 'title_only' END AS layout,
 p_partkey%3=0 AS loops,p_partkey%4=3 AS goal FROM (SELECT p_partkey,['public','internal','confidential','restricted'][p_partkey%4+1] AS s,p_size%4 AS a,p_size*2 AS h,p_partkey%3=0 AS mfa,CASE WHEN p_size%2=0 THEN 'prod' ELSE 'dev' END AS env,
 CASE WHEN p_partkey%3=0 THEN 2 WHEN p_partkey%3=1 THEN 1 ELSE 0 END AS w,['product_showcase','team_intro','agenda'][p_partkey%3+1] AS p,p_size%5=0 AS img FROM part)""")
def typed_list_rules(spark, d):
    """Rules over nested states built from the part table: access, configuration, build failure, images, layout, loops, goal history."""
    k, z = F.col("p_partkey"), F.col("p_size")
    at = lambda vals, i: F.get(F.array(*[F.lit(v) for v in vals]), i.cast("int"))
    changed = F.when(k % 3 == 0, F.array(F.lit("log_level"), F.lit("tls.min_version"))).when(k % 3 == 1, F.array(F.lit("replicas"))).otherwise(F.array(F.lit("log_level")))
    failing = at(["pytest", "build", "lint", "none"], k % 4)
    names = ["checkout", "setup", "install", "lint", "build", "pytest"]
    steps = F.array(*[F.struct(F.lit(n).alias("name"), F.when(failing == n, "failure").otherwise("success").alias("status")) for n in names])
    some = F.lit("x")
    calls = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("b"), F.lit("b"))).when(k % 3 == 1, F.array(F.lit("b"), F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    history = F.transform(steps, lambda s: F.struct(F.when(s["status"] == "failure", "broke").alias("error")))
    return table(spark, d, "part").select(
        "p_partkey", R.access_allowed(at(["public", "internal", "confidential", "restricted"], k % 4), z % 4, z * 2, k % 3 == 0).alias("access"),
        R.config_risk(F.when(z % 2 == 0, "prod").otherwise("dev"), changed).alias("config_risk"), R.ci_failure_cause(steps).alias("ci_cause"),
        R.needs_image(at(["product_showcase", "team_intro", "agenda"], k % 3), z % 5 == 0).alias("image"),
        R.slide_layout(F.when(k % 5 == 0, some), F.when(k % 5 == 1, some), F.when(k % 5 == 2, some), F.when(k % 5 == 3, F.array(some)).otherwise(F.array().cast("array<string>"))).alias("layout"),
        R.repeats_a_call(calls).alias("loops"), R.goal_done_from_history(history, len(names)).alias("goal"))

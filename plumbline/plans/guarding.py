"""Queries for guards, deduplication, validation and resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import lettered_options, outermost_json, reply_label
from ..functions.hashing import text_hash
from ..functions.options import labels_for
from ..operators import guards as G
from ..operators.scale import spread
from ..sources import derived as S
from ..sources.tables import table, union_all
from .evaluation import OK, P
from .oracle import CASES, DECISIONS, SPACES, TEACHER_LABELS, text_hash as text_hash_sql
from .registry import query

LINES = "list_transform(string_split(text,chr(10)), lambda x: x)"


def _documents(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    return docs.withColumn("state", F.to_json(F.struct(F.struct(F.split("text", "\n").alias("lines")).alias("body"), F.col("lang").alias("language"))))


def _benchmark(spark, d):
    return table(spark, d, "benchmark").withColumn("state", F.to_json(F.struct(F.split("text", "\n").alias("lines"))))


DOC_FIELDS = f"""fields AS (SELECT DISTINCT doc_id,field,{text_hash_sql('field')} AS hash FROM (SELECT doc_id,unnest(string_split(text,chr(10))) AS field FROM documents) WHERE length(field)>=40),
banned AS (SELECT DISTINCT {text_hash_sql('field')} AS hash FROM (SELECT unnest(string_split(text,chr(10))) AS field FROM benchmark) WHERE length(field)>=40)"""


@query(f"""SELECT doc_id,md5(field) AS field_md5 FROM (SELECT doc_id,unnest(string_split(text,chr(10))) AS field FROM documents UNION ALL SELECT doc_id,lang FROM documents)""")
def nested_strings(spark, d):
    """Every string in the documents' nested JSON states."""
    return _documents(spark, d).select("doc_id", F.explode(G.strings_of("state")).alias("field")).select("doc_id", F.md5("field").alias("field_md5"))


@query("""SELECT event_id,count(*) AS n FROM (SELECT event_id,t.atom FROM (SELECT event_id,'{"type":"'||event_type||'","more":['||to_json(props)||',"a \\"b\\": c",{"deep":"x"}],"props":'||props||'}' AS s FROM events) e, json_tree(e.s) t WHERE t.type='VARCHAR') GROUP BY 1""")
def nested_strings_by_shape(spark, d):
    """Counts over mixed nested values: numbers and keys are not strings, escaped quotes stay inside one."""
    ev = table(spark, d, "events")
    s = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","more":['), F.to_json(F.array("props")).substr(F.lit(2), F.length(F.to_json(F.array("props"))) - 2),
                 F.lit(',"a \\"b\\": c",{"deep":"x"}],"props":'), F.col("props"), F.lit("}"))
    return ev.select("event_id", F.size(G.strings_of(s)).cast("bigint").alias("n"))


@query(f"SELECT doc_id,{text_hash_sql('text')} AS hash FROM documents")
def text_fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", text_hash("text").alias("hash"))


@query("WITH " + DOC_FIELDS + " SELECT hash FROM banned")
def evaluation_hash_set(spark, d):
    return G.hash_set(G.field_hashes(_benchmark(spark, d), ["item_id"]))


@query("WITH " + DOC_FIELDS + " SELECT doc_id,count(*) AS shared FROM fields WHERE hash IN (SELECT hash FROM banned) GROUP BY 1")
def overlap_guard(spark, d):
    """Documents that share a line of 40 characters or more with the benchmark."""
    return G.overlapping(_documents(spark, d), G.field_hashes(_benchmark(spark, d), ["item_id"]), ["doc_id"])


@query("WITH " + DOC_FIELDS + """, test AS (SELECT text,lang FROM documents WHERE doc_id%50=0) SELECT doc_id,source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM fields WHERE hash IN (SELECT hash FROM banned))
 AND (text,lang) NOT IN (SELECT (text,lang) FROM test)""")
def decontaminated_documents(spark, d):
    """Documents without an overlapping line that are not, as a whole, one of the test states."""
    docs = _documents(spark, d)
    return G.decontaminate(docs, G.field_hashes(_benchmark(spark, d), ["item_id"]), docs.where("doc_id % 50 = 0"), ["doc_id"]).select("doc_id", "source")


@query("SELECT DISTINCT a.source AS family_id FROM documents a JOIN documents b ON a.source=b.source WHERE a.doc_id%3=0 AND b.doc_id%7=1")
def shared_families(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("family_id"))
    return G.shared_families(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 7 = 1"))


@query(f"""WITH pool AS (SELECT 0 AS priority,item_id AS idx,text FROM benchmark UNION ALL SELECT 1,doc_id,text FROM documents UNION ALL SELECT 2,conv_id*1000+turn,text FROM conversations),
 c AS (SELECT priority,idx,trim(regexp_replace(text,'^{SPACES}|{SPACES}$','','g')) AS text FROM pool)
 SELECT priority,idx,md5(text) AS text_md5 FROM c WHERE length(text)>=8 QUALIFY row_number() OVER (PARTITION BY {text_hash_sql('text')} ORDER BY priority,idx)=1""")
def first_pool_wins(spark, d):
    """Normalised deduplication over three pools, the first pool winning."""
    b = table(spark, d, "benchmark").select(F.lit(0).alias("priority"), F.col("item_id").alias("idx"), "text")
    docs = table(spark, d, "documents").select(F.lit(1).alias("priority"), F.col("doc_id").alias("idx"), "text")
    conv = table(spark, d, "conversations").select(F.lit(2).alias("priority"), (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), "text")
    return G.first_source_wins(union_all(b, docs, conv), "text", "priority", "idx").select("priority", "idx", F.md5("text").alias("text_md5"))


@query("SELECT min(event_id) AS event_id FROM events GROUP BY event_type,props")
def exact_copies_dropped(spark, d):
    """One event per canonical content; two states that differ in key order and spacing are the same."""
    ev = table(spark, d, "events")
    a = F.concat(F.lit('{"t":"'), F.col("event_type"), F.lit('","p":'), F.col("props"), F.lit("}"))
    b = F.concat(F.lit('{ "p": '), F.col("props"), F.lit(', "t" : "'), F.col("event_type"), F.lit('"}'))
    rows = ev.select("event_id", F.when(F.col("event_id") % 2 == 0, a).otherwise(b).alias("state"))
    return G.drop_exact_copies(rows, ["state"], "event_id").select("event_id")


@query(f"""SELECT doc_id,regexp_matches(text,'{G.OVERRIDE.replace("(?i)", "")}','i') AS override,regexp_matches(text,'{G.COMMAND.replace("(?i)", "")}','i') AS command,regexp_matches(text,'{G.CUE.replace("(?i)", "")}','i') AS cue,length(text) BETWEEN 60 AND 1500 AS fits FROM documents""")
def instruction_patterns(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", t.rlike(G.OVERRIDE).alias("override"), t.rlike(G.COMMAND).alias("command"), t.rlike(G.CUE).alias("cue"),
                                               F.length(t).between(60, 1500).alias("fits"))


@query("""WITH reg AS (SELECT 'hub/'||source AS hub_id,CASE WHEN substr(source,4)::INT%5=0 THEN 'eval-only' ELSE 'train' END AS use FROM documents WHERE substr(source,4)::INT<15 GROUP BY source)
 SELECT DISTINCT s.hub_id,CASE WHEN use IS NULL THEN 'not in the registry' ELSE 'marked '||use END AS problem FROM (SELECT 'hub/'||source AS hub_id FROM documents) s LEFT JOIN reg USING (hub_id) WHERE use IS NULL OR use<>'train'""")
def usage_guard(spark, d):
    src = table(spark, d, "documents").select("source").withColumn("n", F.substring("source", 4, 9).cast("int"))
    reg = src.where("n < 15").distinct().select(F.concat(F.lit("hub/"), F.col("source")).alias("hub_id"), F.when(F.col("n") % 5 == 0, F.lit("eval-only")).otherwise(F.lit("train")).alias("use"))
    return G.usage_violations(src.select(F.concat(F.lit("hub/"), F.col("source")).alias("hub_id")), reg)


def _replies(spark, d):
    """One reply per 40 parts: a family of one of the three answer types in free text, or text that is not JSON."""
    part = table(spark, d, "part").withColumn("idx", F.floor(F.col("p_partkey") / 40))
    size, kind = F.col("p_size"), F.col("idx") % 3
    level = F.when(size > 33, 2).when(size > 16, 1).otherwise(0).cast("string")
    answer = F.when(kind == 0, F.when(size > 25, F.lit("true")).otherwise(F.lit("False"))).when(kind == 1, F.concat(F.lit(" size"), level)).otherwise(level)
    inst = F.struct(F.struct(size.alias("size"), F.col("p_type").alias("kind")).alias("state"), answer.alias("answer"))
    fams = part.groupBy("idx").agg(F.collect_list(inst).alias("instances"))  # 40 parts

    def spec(question, options):
        return F.to_json(F.struct(F.concat(F.lit("Part Size "), F.col("idx")).alias("family_name"), F.lit(question).alias("instructions"), options.alias("options"), "instances"))

    named = F.struct(*[F.lit(text).alias(f"size{i}") for i, text in enumerate(("small", "middle", "large"))])
    body = F.when(kind == 0, spec("Is the part large?", F.struct(F.lit("yes").alias("true"), F.lit("no").alias("false")))).when(
        kind == 1, spec("Which size has the part?", named)).otherwise(spec("How large is the part?", F.array(*[F.lit(x) for x in ("small", "middle", "large")])))
    text = F.when(F.col("idx") % 5 == 4, F.concat(F.lit("sorry {"), body)).otherwise(F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone.")))
    return fams.select("idx", F.when(kind == 0, F.lit("noul")).when(kind == 1, F.lit("choice")).otherwise(F.lit("score")).alias("qtype"), text.alias("reply"))


@query("""WITH p AS (SELECT p_partkey//40 AS idx,p_size,p_type,CASE WHEN p_size>33 THEN '2' WHEN p_size>16 THEN '1' ELSE '0' END AS level FROM part WHERE (p_partkey//40)%5<>4),
 a AS (SELECT idx,p_size,p_type,CASE idx%3 WHEN 0 THEN 'noul' WHEN 1 THEN 'choice' ELSE 'score' END AS qtype,CASE idx%3 WHEN 0 THEN (p_size>25)::VARCHAR WHEN 1 THEN 'size'||level ELSE level END AS gold FROM p),
 n AS (SELECT idx FROM a GROUP BY 1 HAVING count(*)>=8),o AS (SELECT DISTINCT idx,p_size,p_type,qtype,gold FROM a WHERE idx IN (SELECT idx FROM n))
 SELECT 'syn_'||printf('%04d',idx)||'_part_size_'||idx AS family,qtype,gold,count(*) AS n FROM o
 WHERE idx IN (SELECT idx FROM o GROUP BY 1 HAVING count(*)>=8 AND count(DISTINCT gold)>=2) GROUP BY ALL""")
def generated_families(spark, d):
    """Families of every answer type parsed out of free text, validated, deduplicated by state."""
    return G.generated_families(_replies(spark, d)).groupBy("family", "qtype", "gold").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id,CASE WHEN event_id%3=0 THEN props WHEN event_id%3=1 THEN NULL ELSE props END AS body FROM events""")
def json_in_free_text(spark, d):
    ev = table(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("ok: "), F.col("props"), F.lit(" bye"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("broken { "), F.col("props"))).otherwise(
        F.concat(F.lit("\n"), F.col("props")))
    return ev.select("event_id", outermost_json(text).alias("body"))


@query("""SELECT event_id,CASE event_id%4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN NULL ELSE '12' END AS label FROM events""")
def reply_labels(spark, d):
    """The first valid label in a reply; letters in any case, codes of two digits."""
    ev = table(spark, d, "events")
    k = F.col("event_id") % 4
    text = (F.when(k == 0, F.concat(F.lit(" answer: b) "), F.col("event_type"))).when(k == 1, F.lit("X or C, not A")).when(k == 2, F.lit("none of these"))
            .otherwise(F.lit("99 then 12")))
    return ev.select("event_id", reply_label(text, labels_for(F.when(k == 3, F.lit(30)).otherwise(F.lit(4)))).alias("label"))


@query("""SELECT event_id,CASE event_id%8 WHEN 0 THEN NULL WHEN 1 THEN 'not_json' WHEN 2 THEN 'no_questions' WHEN 3 THEN 'q:few_options'
 WHEN 4 THEN 'q:incomplete' WHEN 5 THEN 'q:few_levels' WHEN 6 THEN 'many_questions' ELSE 'long_state' END AS reject_reason FROM events""")
def request_validation(spark, d):
    """Requests with one fault each and the code of the fault."""
    good = '{"type":"noul","instructions":"ok?"}'
    bodies = ['{"q":%s}' % good, "not json", "[1]", '{"z":%s,"q":{"type":"choice","instructions":"x","criteria":{"only":"one"}},"a":{"type":"maybe"}}' % good, '{"q":{"type":"maybe","instructions":"x"}}',
              '{"q":{"type":"score","instructions":"x","criteria":["one"]}}', "{" + ",".join(f'"q{i}":{good}' for i in range(7)) + "}", '{"q":%s}' % good]
    k = (F.col("event_id") % 8).cast("int")
    ev = table(spark, d, "events")
    state = F.when(k == 7, F.repeat(F.col("event_type"), 4000)).otherwise(F.col("props"))
    req = ev.select(F.col("event_id").alias("request_id"), state.alias("state"), F.get(F.array(*[F.lit(b) for b in bodies]), k).alias("questions"))
    return G.request_problems(req).select(F.col("request_id").alias("event_id"), "reject_reason")


@query("WITH " + DECISIONS + " SELECT row_id FROM decisions WHERE len(keys)<=26 AND len(regexp_extract_all(state,'[a-z]+|[0-9]+'))<=150")
def within_limits(spark, d):
    """Rows whose options and state tokens stay under the limits."""
    rows = S.decisions(spark, d).select("row_id", "options", F.regexp_count("state", F.lit("[a-z]+|[0-9]+")).alias("tokens"))
    return G.within_limits(rows, 150).select("row_id")


@query(P + " SELECT run_id,count(*) FILTER (error IS NULL) AS answered,count(*) FILTER (error IS NOT NULL) AS retry FROM predictions GROUP BY 1")
def retry_counts(spark, d):
    good, again = G.retry_set(S.predictions(spark, d).select("run_id", "error"))
    return good.groupBy("run_id").agg(F.count(F.lit(1)).alias("answered")).join(again.groupBy("run_id").agg(F.count(F.lit(1)).alias("retry")), "run_id")


@query("WITH " + CASES + " SELECT case_id FROM cases WHERE slice IN ('lang','topic_1') AND suite='dev'")
def restricted_cases(spark, d):
    c = S.cases(spark, d)
    return G.restrict(c, c.where("suite = 'dev'"), ["lang", "topic_1"]).select("case_id")


@query("WITH " + DECISIONS + "," + TEACHER_LABELS + " SELECT row_id,family FROM labels_t WHERE failed")
def remaining_to_label(spark, d):
    """Resume: rows that no good label exists for."""
    rows = S.decisions(spark, d)
    return G.remaining(rows.select("row_id", "family"), S.labels(spark, d).where("error IS NULL"), "row_id")


TASKS = """inst AS (SELECT doc_id AS instance_id,source AS task,CASE WHEN doc_id%10=0 THEN [lab,'other'] WHEN doc_id%11=0 THEN []::VARCHAR[] ELSE [lab] END AS output FROM
 (SELECT *,CASE WHEN doc_id%7=0 THEN upper(lang)||'!' ELSE lang END AS lab FROM documents)),
 labs AS (SELECT DISTINCT task,output[1] AS label FROM inst WHERE len(output)>0),ok AS (SELECT task FROM labs GROUP BY 1 HAVING count(*) BETWEEN 2 AND 7),
 keyed AS (SELECT task,label,base||repeat('_',(row_number() OVER (PARTITION BY task,base ORDER BY label)-1)::INT) AS key FROM (SELECT task,label,regexp_replace(regexp_replace(lower(label),'[^a-z0-9]','_','g'),'^_+|_+$','','g') AS base FROM labs WHERE task IN (SELECT task FROM ok)))"""


def _instances(spark, d):
    docs = table(spark, d, "documents")
    lab = F.when(F.col("doc_id") % 7 == 0, F.concat(F.upper("lang"), F.lit("!"))).otherwise(F.col("lang"))
    out = F.when(F.col("doc_id") % 10 == 0, F.array(lab, F.lit("other"))).when(F.col("doc_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(lab))
    return docs.select(F.col("doc_id").alias("instance_id"), F.col("source").alias("task"), "text", out.alias("output"))


@query("WITH " + TASKS + " SELECT task,label,key FROM keyed")
def task_label_keys(spark, d):
    """Label set per task with collision-safe keys; tasks with more than 7 labels fall out."""
    return G.label_keys(_instances(spark, d), 2, 7)


@query("WITH " + TASKS + """ SELECT instance_id,i.task,key AS gold,count(*) OVER (PARTITION BY i.task,instance_id)*(SELECT count(*) FROM keyed k2 WHERE k2.task=i.task) AS n_options
 FROM inst i JOIN keyed k ON i.task=k.task AND i.output[1]=k.label WHERE len(list_distinct(output))=1""")
def task_choice_rows(spark, d):
    inst = _instances(spark, d)
    rows, _ = G.task_rows(inst, G.label_keys(inst, 2, 7))
    return rows.select("instance_id", "task", "gold", F.col("n_options").cast("bigint").alias("n_options"))


@query("SELECT source AS task,count(*) FILTER (doc_id%10=0 OR doc_id%11=0) AS ambiguous_gold FROM documents GROUP BY 1")
def ambiguous_golds(spark, d):
    inst = _instances(spark, d)
    return G.task_rows(inst, G.label_keys(inst, 2, 7))[1]


@query("""SELECT p_partkey,'A' AS key,p_brand AS text FROM part UNION ALL SELECT p_partkey,'B',p_type FROM part UNION ALL SELECT p_partkey,'C','size '||p_size FROM part""")
def lettered_options_parsed(spark, d):
    part = table(spark, d, "part")
    raw = F.array(F.concat(F.lit("A) "), F.col("p_brand")), F.concat(F.lit(" B )  "), F.col("p_type"), F.lit(" ")), F.concat(F.lit("C)size "), F.col("p_size")), F.col("p_name"))
    return part.select("p_partkey", F.explode(lettered_options(raw)).alias("o")).select("p_partkey", "o.key", "o.text")

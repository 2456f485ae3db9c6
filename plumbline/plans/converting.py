"""Queries that turn raw records into typed decision rows, change rows, and lay out prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import options as O
from ..functions.hashing import state_hash
from ..functions.text import answer_key, humanize, lettered_options
from ..operators import convert as V
from ..operators import guards as G
from ..operators.sampling import repeat_rows
from ..sources import derived as S
from ..sources.tables import splits, table
from .oracle import ASK, TEXTS, CASES, DECISIONS, JUDGED, TEACHER_LABELS, u
from .registry import query


def draw_sql(seed: str, ids: str, what: str) -> str:
    return u(f"'{seed}:'||{ids}||':{what}'")


def hsort(keys: str, seed: str, ids: str) -> str:
    return f"list_transform(list_sort(list_transform({keys}, lambda hk: sha256('{seed}:'||{ids}||':'||hk)||'|'||hk)), lambda hs: substr(hs,66))"


def pick_sql(values, uu: str) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + f"][least(floor({uu}*{len(values)}),{len(values) - 1})::INT+1]"


def between_sql(uu: str, lo: int, hi: int) -> str:
    return f"least(floor({uu}*{hi - lo + 1})+{lo},{hi})::INT"


def options_sql(gold: str, pool: str, k: str, seed: str, ids: str) -> str:
    others = hsort(f"list_filter({pool}, lambda pk: pk<>{gold})", seed + "-pick", ids)
    return hsort(f"list_append(({others})[1:least({k},len({pool}))-1],{gold})", seed + "-mix", ids)


def _shape(df, *ids):
    """What the checks look at: keys in order, texts, gold, wording and state."""
    return df.select(*ids, "task_type", F.array_join(O.keys_of("options"), ",").alias("keys"), F.array_join(F.transform("options", lambda o: o["text"]), ",").alias("texts"),
                     "gold", F.md5("instructions").alias("ask"), F.md5("state").alias("state"))


def esc(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


INT_U = {w: draw_sql("intent", "doc_id", w) for w in ("kind", "k", "none", "target", "other", "wording")}


@query(f"""WITH p AS (SELECT list(source ORDER BY sha256('intent-pool:'||source),source) AS pool FROM (SELECT DISTINCT source FROM documents WHERE source<>'src0')),
 a AS (SELECT doc_id,text,source AS g,pool,source='src0' AS oos,{INT_U['kind']}<0.75 AS ch,CASE WHEN {INT_U['target']}<0.5 AND source<>'src0' THEN source ELSE pool[least(floor({INT_U['other']}*len(pool)),len(pool)-1)::INT+1] END AS tg FROM documents,p),
 r AS (SELECT *,list_transform(range(0,len(pool)), lambda ri: pool[(('0x'||substr(sha256('intent:'||doc_id||':start'),1,8))::BIGINT+ri)%len(pool)+1]) AS ring,least({between_sql(INT_U['k'], 3, 12)},len(pool)) AS ki,least({between_sql(INT_U['k'], 4, 11)},len(pool)) AS ko FROM a),
 b AS (SELECT *,CASE WHEN oos THEN {hsort("list_append(ring[1:ko-1],'none_of_these')", "intent-mix", "doc_id")}
  ELSE list_concat({hsort("list_append(list_filter(ring[1:ki], lambda rp: rp<>g)[1:ki-1],g)", "intent-mix", "doc_id")},CASE WHEN {INT_U['none']}<0.3 THEN ['none_of_these'] ELSE [] END) END AS ck FROM r)
 SELECT doc_id,CASE WHEN ch THEN 'choice' ELSE 'noul' END AS task_type,CASE WHEN ch THEN array_to_string(ck,',') ELSE 'true,false' END AS keys,
 CASE WHEN ch THEN array_to_string(list_transform(ck, lambda x: CASE WHEN x='none_of_these' THEN 'None of the listed intents' ELSE x END),',') ELSE 'The user''s intent is '||tg||'.,The user''s intent is something else.' END AS texts,
 CASE WHEN ch THEN CASE WHEN oos THEN 'none_of_these' ELSE g END ELSE (tg=g)::VARCHAR END AS gold,
 md5(CASE WHEN ch THEN {pick_sql(V.INTENT_WORDINGS, INT_U['wording'])} ELSE 'Is the user''s intent in the state '''||tg||'''?' END) AS ask,md5('{{"message":'||to_json(text)||'}}') AS state FROM b""")
def convert_intents(spark, d):
    """Documents as messages, their source as the intent, src0 as out of scope."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    pool = V.label_pool(docs, "source", exclude="src0")
    return _shape(V.intents(docs, ["doc_id"], "text", "source", pool, "src0"), "doc_id")


@query(f"""SELECT event_id,CASE WHEN a THEN 'noul' ELSE 'score' END AS task_type,CASE WHEN a THEN 'true,false' ELSE '0,1,2,3' END AS keys,CASE WHEN a THEN 'The comment is toxic.,The comment is not toxic.' ELSE 'not toxic,mildly toxic,toxic,severely toxic' END AS texts,
 CASE WHEN a THEN (t>=0.5)::VARCHAR ELSE CASE WHEN t<0.1 THEN '0' WHEN t<0.5 THEN '1' WHEN t<0.8 THEN '2' ELSE '3' END END AS gold,md5(CASE WHEN a THEN {esc(V.TOXIC_ASK)} ELSE {esc(V.TOXIC_RATE)} END) AS ask,md5('{{"comment":'||to_json(event_type)||'}}') AS state
 FROM (SELECT *,least(value/50,1.0) AS t,{draw_sql('tox', 'event_id', 'kind')}<0.6 AS a FROM events)""")
def convert_toxicity(spark, d):
    ev = table(spark, d, "events").withColumn("t", F.least(F.col("value") / 50, F.lit(1.0)))
    return _shape(V.toxicity(ev, ["event_id"], "event_type", "t"), "event_id")


NLI_TEXT = " ".join(f"WHEN '{k}' THEN {esc(t)}" for k, t in zip(V.NLI_KEYS, V.NLI_TEXTS))


@query(f"""WITH r AS (SELECT o_orderkey,o_orderpriority,o_orderstatus,CASE o_orderstatus WHEN 'F' THEN 'entailment' WHEN 'O' THEN 'neutral' WHEN 'P' THEN CASE WHEN o_orderkey%3=0 THEN NULL ELSE 'contradiction' END END AS l,{draw_sql('nli', 'o_orderkey', 'kind')} AS roll,
  {hsort("['entailment','contradiction','neutral']", "nli-mix", "o_orderkey")} AS mk FROM orders)
 SELECT o_orderkey,CASE WHEN roll<0.5 THEN 'choice' ELSE 'noul' END AS task_type,CASE WHEN roll<0.5 THEN array_to_string(mk,',') ELSE 'true,false' END AS keys,
 CASE WHEN roll<0.5 THEN array_to_string(list_transform(mk, lambda x: CASE x {NLI_TEXT} END),',') WHEN roll<0.8 THEN 'The hypothesis must be true given the premise.,The hypothesis is not guaranteed by the premise.' ELSE 'They contradict each other.,They do not contradict each other.' END AS texts,
 CASE WHEN roll<0.5 THEN l WHEN roll<0.8 THEN (l='entailment')::VARCHAR ELSE (l='contradiction')::VARCHAR END AS gold,md5(CASE WHEN roll<0.5 THEN {esc(V.NLI_CHOICE)} WHEN roll<0.8 THEN {esc(V.NLI_ENTAIL)} ELSE {esc(V.NLI_CONTRADICT)} END) AS ask,
 md5('{{"premise":"'||o_orderpriority||'","hypothesis":"'||o_orderstatus||'"}}') AS state FROM r WHERE l IS NOT NULL""")
def convert_inference_pairs(spark, d):
    o = table(spark, d, "orders")
    label = F.when(F.col("o_orderstatus") == "F", "entailment").when(F.col("o_orderstatus") == "O", "neutral").when(F.col("o_orderkey") % 3 != 0, "contradiction")
    return _shape(V.inference_pairs(o.withColumn("label", label), ["o_orderkey"], "o_orderpriority", "o_orderstatus", "label"), "o_orderkey")


@query(f"""SELECT conv_id,turn,'noul' AS task_type,'true,false' AS keys,'Yes.,No.' AS texts,(turn%2=0)::VARCHAR AS gold,md5({esc(V.PASSAGE_ASK)}||upper(q[1])||substr(q,2)) AS ask,md5('{{"passage":'||to_json(role)||'}}') AS state
 FROM (SELECT *,regexp_replace(trim(text),'\\?+$','')||'?' AS q FROM conversations)""")
def convert_passage_questions(spark, d):
    return _shape(V.passage_questions(table(spark, d, "conversations"), ["conv_id", "turn"], "role", "text", F.col("turn") % 2 == 0), "conv_id", "turn")


TOPIC_POOL = "['Class_A','Class_B','Class_C','Class_D','Class_E','Class_F','Class_G','Class_H','Class_I','Class_J']"


@query(f"""WITH r AS (SELECT vec_id,label,{options_sql(f"{TOPIC_POOL}[label+1]", TOPIC_POOL, between_sql(draw_sql('topic', 'vec_id', 'k'), 4, 8), 'topic', 'vec_id')} AS k FROM embeddings)
 SELECT vec_id,'choice' AS task_type,array_to_string(list_transform(k, lambda x: lower(x)),',') AS keys,array_to_string(list_transform(k, lambda x: replace(x,'_',' ')),',') AS texts,lower({TOPIC_POOL}[label+1]) AS gold,
 md5({esc(V.TOPIC_ASK)}) AS ask,md5('{{"title":"entry '||vec_id||'","text":"label"}}') AS state FROM r""")
def convert_entity_topics(spark, d):
    pool = [f"Class_{c}" for c in "ABCDEFGHIJ"]
    emb = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("entry "), F.col("vec_id")).alias("title"), F.lit(" label ").alias("text"),
                                               F.get(F.array(*[F.lit(p) for p in pool]), F.col("label")).alias("name"))
    return _shape(V.entity_topics(emb, ["vec_id"], "title", "text", "name", pool), "vec_id")


@query(f"""WITH r AS (SELECT *,['A','B','C','D','E'][p_partkey%5+1] AS g,{hsort("['A','B','C']", "mc", "p_partkey")} AS k FROM part WHERE p_partkey%5<3)
 SELECT p_partkey,'choice' AS task_type,lower(array_to_string(k,',')) AS keys,array_to_string(list_transform(k, lambda x: CASE x WHEN 'A' THEN p_brand WHEN 'B' THEN p_type ELSE 'size '||p_size END),',') AS texts,lower(g) AS gold,md5('Which fits?') AS ask,md5('{{"question":'||to_json(p_name)||'}}') AS state FROM r""")
def convert_multiple_choice(spark, d):
    """Lettered option strings to a choice; rows whose answer is not among the options drop."""
    part = table(spark, d, "part")
    raw = F.array(F.concat(F.lit("A) "), F.col("p_brand")), F.concat(F.lit(" B )  "), F.col("p_type"), F.lit(" ")), F.concat(F.lit("C)size "), F.col("p_size")), F.col("p_name"))
    part = part.withColumn("entries", lettered_options(raw)).withColumn("answer", F.get(F.array(*[F.lit(x) for x in "ABCDE"]), (F.col("p_partkey") % 5).cast("int")))
    return _shape(V.multiple_choice(part, ["p_partkey"], "p_name", "entries", "answer", "Which fits?"), "p_partkey")


DET_U = draw_sql("detect", "doc_id", "wording")


@query(f"""WITH {JUDGED} SELECT doc_id,'noul' AS task_type,'true,false' AS keys,{esc(V.DETECT_TRUE + ',' + V.DETECT_FALSE)} AS texts,(toxic=1)::VARCHAR AS gold,md5({esc(V.DETECT_PREAMBLE)}||{pick_sql(V.DETECT_QUESTIONS, DET_U)}) AS ask,
 md5('{{"'||{pick_sql(V.STATE_KEYS, draw_sql('detect', 'doc_id', 'key'))}||'":'||to_json(text)||'}}') AS state FROM judged""")
def convert_detection_rows(spark, d):
    return _shape(V.detection_rows(S.judged_documents(spark, d), ["doc_id"], "text", F.col("toxic") == 1), "doc_id")


@query(f"""WITH {JUDGED} SELECT 'injection-'||doc_id AS row_id,md5({esc(V.DETECT_NEUTRAL)}||{pick_sql(V.DETECT_QUESTIONS, DET_U)}) AS ask FROM judged UNION ALL SELECT 'lang-'||doc_id,md5('In which language?') FROM documents""")
def neutral_wording(spark, d):
    """Detection rows lose the preamble, other rows stay."""
    det = V.detection_rows(S.judged_documents(spark, d), ["doc_id"], "text", F.col("toxic") == 1)
    det = det.select(F.concat(F.lit("injection-"), F.col("doc_id")).alias("row_id"), F.lit("injection_docs").alias("family"), "instructions")
    other = table(spark, d, "documents").select(F.concat(F.lit("lang-"), F.col("doc_id")).alias("row_id"), F.lit("lang").alias("family"), F.lit("In which language?").alias("instructions"))
    return V.neutral_wording(det.unionByName(other)).select("row_id", F.md5("instructions").alias("ask"))


@query(r"""SELECT url,regexp_replace(regexp_replace(lower(trim(url)),'[^\p{L}\p{N}]','_','g'),'^_+|_+$','','g')[1:40] AS key,trim(replace(url,'_',' ')) AS shown FROM pages""")
def answer_keys(spark, d):
    return table(spark, d, "pages").select("url", answer_key("url").alias("key"), humanize("url").alias("shown"))


@query("WITH " + CASES + """ SELECT case_id,array_to_string(CASE WHEN len(keys)<=26 THEN list_transform(range(0,len(keys)), lambda i: chr((65+i)::INT)) END,',') AS labels FROM cases""")
def option_labels(spark, d):
    return S.cases(spark, d).select("case_id", F.array_join(O.labels_for(F.size("options")), ",").alias("labels"))


@query("SELECT p_partkey,array_to_string(list_transform(range(0,27+p_partkey%60), lambda i: (10+i)::VARCHAR),',') AS labels FROM part")
def two_digit_labels(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(O.labels_for((F.col("p_partkey") % 60 + 27).cast("int")), ",").alias("labels"))


LANG_TEXTS = "['German','English','Spanish','French']"


STATE_SQL = """CASE WHEN row_id LIKE 'topic-%' THEN '{'||chr(10)||' "vector": '||substr(row_id,7)||chr(10)||'}' WHEN task_type='score' THEN replace(replace(replace(state,'{"','{'||chr(10)||' "'),',"total":',','||chr(10)||' "total": '),'"status":','"status": ')[:-2]||chr(10)||'}'
 ELSE '{'||chr(10)||' "text": '||substr(state,9,length(state)-9)||chr(10)||'}' END"""


@query("WITH " + DECISIONS + f""", q AS (SELECT row_id,{STATE_SQL} AS st,{ASK} AS ask,list_transform(range(1,len(keys)+1), lambda i: chr((64+i)::INT)||') '||CASE WHEN task_type='score' THEN ts[i] ELSE keys[i]||': '||ts[i] END) AS ls FROM (SELECT *,{TEXTS} AS ts FROM decisions)),
 b AS (SELECT row_id,'You are a decision model. Read the state and answer the question by choosing one option.'||chr(10)||chr(10)||'STATE:'||chr(10)||st||chr(10)||chr(10)||'QUESTION: '||ask||chr(10)||chr(10)||'OPTIONS:'||chr(10)||array_to_string(ls,chr(10))||chr(10)||chr(10) AS body FROM q)
 SELECT row_id,'plain' AS turn,md5(body||'Answer with the option letter only.Answer:') AS prompt_md5 FROM b
 UNION ALL SELECT row_id,'gemma4',md5('<|turn>user'||chr(10)||body||'Answer with the option letter only.<turn|>'||chr(10)||'<|turn>model'||chr(10)||'<|channel>thought'||chr(10)||'<channel|>Answer:') FROM b
 UNION ALL SELECT row_id,'chat',md5(body||'Reply with only the option letter, nothing else.') FROM b""")
def prompt_table(spark, d):
    """The whole prompt per row of every type, plain, in turns and for chat; the digest covers every character of it."""
    rows = S.decisions(spark, d)
    forms = {"plain": ("plain", False), "gemma4": ("gemma4", False), "chat": ("plain", True)}
    each = F.array(*[F.struct(F.lit(name).alias("turn"), F.md5(O.prompt("state", "instructions", "options", "task_type", turn, chat)).alias("md5")) for name, (turn, chat) in forms.items()])
    return rows.select("row_id", F.explode(each).alias("p")).select("row_id", "p.turn", F.col("p.md5").alias("prompt_md5"))


@query("""SELECT p_partkey,md5('You are a decision model. Read the state and answer the question by choosing one option.'||chr(10)||chr(10)||'STATE:'||chr(10)||'{'||chr(10)||' "size": '||p_size||chr(10)||'}'||chr(10)||chr(10)||'QUESTION: Which code?'||chr(10)||chr(10)||'OPTIONS:'||chr(10)||
 array_to_string(list_transform(range(0,27+p_partkey%60), lambda i: (10+i)||') option '||i),chr(10))||chr(10)||chr(10)||'Answer with the option two-digit code only.Answer: ') AS prompt_md5 FROM part""")
def code_prompts(spark, d):
    """Prompts of more than 26 options, answered by two-digit codes."""
    names = F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 60 + 26).cast("int")), lambda i: F.struct(i.alias("pos"), F.concat(F.lit("option "), i).alias("key"), F.concat(F.lit("option "), i).alias("text")))
    state = F.to_json(F.struct(F.col("p_size").alias("size")))
    return table(spark, d, "part").select("p_partkey", F.md5(O.prompt(state, F.lit("Which code?"), names.cast(O.OPTION), F.lit("choice"))).alias("prompt_md5"))


@query("WITH " + DECISIONS + """ SELECT row_id,CASE task_type WHEN 'noul' THEN 'false: No, the condition does not hold.|true: Yes, the condition holds.' WHEN 'score' THEN 'urgent|high|medium|unspecified|low'
 ELSE CASE WHEN family='dbpedia_topic' THEN array_to_string(list_transform(keys, lambda k: k||': Class '||k[-1]),'|') ELSE 'de: German|en: English|es: Spanish|fr: French' END END AS shown,
 CASE task_type WHEN 'noul' THEN 'No, the condition does not hold.|Yes, the condition holds.' WHEN 'score' THEN 'urgent|high|medium|unspecified|low' ELSE CASE WHEN family='dbpedia_topic' THEN array_to_string(list_transform(keys, lambda k: 'Class '||k[-1]),'|') ELSE 'German|English|Spanish|French' END END AS encoder FROM decisions""")
def option_texts(spark, d):
    """Options as presented in a prompt and as read by an option scorer."""
    rows = S.decisions(spark, d)
    return rows.select("row_id", F.array_join(O.presented("options", "task_type"), "|").alias("shown"), F.array_join(O.encoder_texts("options", "task_type")["texts"], "|").alias("encoder"))


@query("WITH " + CASES + """, o AS (SELECT case_id,keys,list_reverse(keys) AS r,list_concat(keys[(len(keys)+1)//2+1:],keys[1:(len(keys)+1)//2]) AS t,task_type FROM cases)
 SELECT case_id,'given' AS kind,array_to_string(keys,',') AS keys FROM o UNION ALL SELECT case_id,'second',array_to_string(r,',') FROM o WHERE task_type<>'score' UNION ALL SELECT case_id,'third',array_to_string(t,',') FROM o WHERE task_type<>'score' AND t<>r AND t<>keys""")
def option_orders(spark, d):
    """One row per case and order: given, reversed, rotated by half, repeats left out."""
    c = S.spread_cases(spark, d).select("case_id", F.posexplode(O.orders(O.keys_of("options"), "task_type")).alias("i", "o"))
    return c.select("case_id", F.when(F.col("i") == 0, "given").when(F.col("i") == 1, "second").otherwise("third").alias("kind"), F.array_join("o", ",").alias("keys"))


@query("WITH " + DECISIONS + f" SELECT row_id,array_to_string(CASE WHEN task_type='score' THEN keys ELSE {hsort('keys', 'opt', 'row_id')} END,',') AS keys FROM decisions")
def options_shuffled(spark, d):
    rows = S.decisions(spark, d)
    return rows.select("row_id", F.array_join(O.keys_of(O.hash_shuffled("options", "task_type", "opt", "row_id")), ",").alias("keys"))


@query(f"""SELECT p_partkey,CASE WHEN {draw_sql('style', 'p_partkey', 'style')}<0.5 THEN '{{"part_name":'||to_json(p_name)||',"size_info":{{"shelf_size":'||p_size||',"all_brands":[{{"brand_code":"'||p_brand||'"}}]}}}}'
 ELSE '{{"partName":'||to_json(p_name)||',"sizeInfo":{{"shelfSize":'||p_size||',"allBrands":[{{"brandCode":"'||p_brand||'"}}]}}}}' END AS state FROM part""")
def keys_restyled(spark, d):
    """Half the states with camelCase keys at every level."""
    part = table(spark, d, "part")
    st = F.struct(F.col("p_name").alias("part_name"), F.struct(F.col("p_size").alias("shelf_size"), F.array(F.struct(F.col("p_brand").alias("brand_code"))).alias("all_brands")).alias("size_info"))
    return V.restyled(part.select("p_partkey", st.alias("state")), "state", ["p_partkey"])


@query(f"""WITH r AS (SELECT c_custkey,{between_sql(draw_sql('policy', 'c_custkey', 'extras'), 0, 3)} AS n,{draw_sql('policy', 'c_custkey', 'place')}<0.5 AS i FROM customer)
 SELECT c_custkey,1+n+i::INT AS fields,i AS in_state,CASE WHEN i THEN 'Ask. Apply the policy given in the state.' ELSE 'Ask. Policy: Only if rich.' END AS instructions FROM r""")
def policy_placed(spark, d):
    """The policy in the state or in the question, up to three irrelevant fields added."""
    c = table(spark, d, "customer").select("c_custkey", F.create_map(F.lit("balance"), F.col("c_acctbal").cast("string")).alias("m"), F.lit("Ask.").alias("instructions"), F.lit("Only if rich.").alias("policy"),
                                           F.create_map(F.lit("region"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"), F.lit("label"), F.col("c_name"), F.lit("kind"), F.lit("x")).alias("extras"))
    out = V.place_policy(c, ["c_custkey"], "m", "policy", "extras")
    keys = F.json_object_keys("state")
    return out.select("c_custkey", F.size(keys).alias("fields"), F.array_contains(keys, F.lit("policy")).alias("in_state"), "instructions")


@query(f"""WITH {JUDGED}, pool AS (SELECT doc_id,length(text) AS n,row_number() OVER (ORDER BY sha256('long:'||doc_id),doc_id)-1 AS number FROM documents),
 pk AS (SELECT 'toxic-'||doc_id AS row_id,doc_id AS origin,text FROM judged QUALIFY row_number() OVER (ORDER BY sha256('long:toxic-'||doc_id),row_id)<=120),
 w AS (SELECT *,{between_sql(draw_sql('long', 'row_id', 'size'), 7000, 14000)} AS want,('0x'||substr(sha256('long:'||row_id||':start'),1,8))::BIGINT%(SELECT count(*) FROM pool) AS start FROM pk),
 c AS (SELECT row_id,want,p.doc_id,p.n,sum(p.n+4) OVER (PARTITION BY row_id ORDER BY (number-start+(SELECT count(*) FROM pool))%(SELECT count(*) FROM pool) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w,pool p WHERE p.doc_id<>origin)
 SELECT row_id||'~long' AS row_id,count(*) AS n_records,sum(n)::BIGINT AS context_chars FROM c WHERE coalesce(before,0)<want GROUP BY 1""")
def long_context(spark, d):
    """120 rows padded with whole documents of other rows until 7,000 to 14,000 characters."""
    rows = S.judged_documents(spark, d).select(F.concat(F.lit("toxic-"), F.col("doc_id")).alias("row_id"), F.to_json(F.struct("text")).alias("state"), F.col("doc_id").alias("origin"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "text")
    out = V.long_context(rows, docs, 120)
    rec = F.from_json(F.get_json_object("state", "$.unrelated_context.records"), "array<string>")
    return out.select("row_id", F.size(rec).cast("bigint").alias("n_records"), F.aggregate(rec, F.lit(0).cast("bigint"), lambda a, t: a + F.length(t)).alias("context_chars"))


@query("""SELECT doc_id AS row_index,sha256('{"sentence":'||to_json(text)||'}')[1:16] AS state_hash FROM documents""")
def restored_texts(spark, d):
    """Texts joined back by row number and checked against the hash of the state."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_index"), "text")
    held = docs.select("row_index", F.concat(F.lit("case-"), F.col("row_index")).alias("case_id"), state_hash(F.to_json(F.struct(F.col("text").alias("sentence")))).alias("state_hash"))
    return V.restore_withheld(held, docs).select("row_index", state_hash("state").alias("state_hash"))


@query("""WITH t AS (SELECT doc_id,string_split(text,' ') AS s FROM documents),b AS (SELECT doc_id,s,(256-3-5-(1+2)-(1+1))::INT AS budget FROM t)
 SELECT doc_id,least(len(s),budget) AS kept,CASE WHEN len(s)>budget THEN md5(array_to_string(list_concat(s[1:budget//2],s[len(s)-(budget-budget//2)+1:]),' ')) ELSE md5(array_to_string(s,' ')) END AS tokens_md5 FROM b""")
def truncated_states(spark, d):
    """Head and tail of long states within a budget of 256 tokens; options stay whole."""
    q = F.array(*[F.lit("q")] * 5)
    opts = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))
    out = table(spark, d, "documents").select("doc_id", V.truncate_state(F.split("text", " "), q, opts, 256).alias("s"))
    return out.select("doc_id", F.size("s").cast("bigint").alias("kept"), F.md5(F.array_join("s", " ")).alias("tokens_md5"))


@query("WITH " + DECISIONS + """ SELECT row_id||CASE WHEN k=0 THEN '' ELSE '~'||k END AS row_id FROM decisions,range(0,3) t(k) WHERE family LIKE 'syn%'""")
def repeated_rows(spark, d):
    return repeat_rows(S.decisions(spark, d).where(F.col("family").startswith("syn_")).select("row_id"), 3)


@query("""SELECT CASE WHEN turn%2=0 THEN 'train' ELSE 'test' END||conv_id AS source_row,count(*) AS n FROM conversations GROUP BY 1""")
def split_qualified_ids(spark, d):
    """Union of splits numbered from zero each."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return splits({"train": c.where("turn % 2 = 0"), "test": c.where("turn % 2 = 1")}, "conv_id").groupBy("source_row").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + DECISIONS + "," + TEACHER_LABELS + " SELECT family,count(*) AS rows,round(avg((keys[list_position(probs,list_max(probs))]=gold)::INT),3) AS agreement FROM labels_t WHERE NOT failed GROUP BY 1")
def report_lines_parsed(spark, d):
    """A per-family report written as text lines and read back."""
    from ..operators import calibration as C
    from ..operators import targets as T
    from ..functions.probability import argmax
    rows = S.decisions(spark, d)
    items = C.label_items(rows, T.usable_labels(S.labels(spark, d)))
    rep = items.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.avg((argmax("z") == F.col("g")).cast("double")).alias("a"))
    lines = rep.select(F.format_string("%-30s %6d %12s %9d %12d", "family", "n", F.round("a", 3).cast("decimal(4,3)").cast("string"), F.lit(0), F.lit(0)).alias("value"))
    noise = rep.select(F.concat(F.lit("total "), F.col("n"), F.lit(" targets")).alias("value"))
    return V.agreement_lines(lines.unionByName(noise))


@query("""SELECT user_id,arg_min(value,(ts,event_id)) FILTER (event_type='view') AS weights_loaded_gib,arg_min(value,(ts,event_id)) FILTER (event_type='click') AS kv_cache_gib,arg_min(value,(ts,event_id)) FILTER (event_type='error') AS max_concurrency FROM events GROUP BY 1""")
def log_figures(spark, d):
    """Figures out of log lines, the first of each kind per log."""
    v = F.format_string("%.2f", "value")
    ev = table(spark, d, "events")
    text = (F.when(F.col("event_type") == "view", F.concat(F.lit("INFO Model loading took "), v, F.lit(" GiB and 3 s"))).when(F.col("event_type") == "click", F.concat(F.lit("Available KV cache memory: "), v, F.lit(" GiB")))
            .when(F.col("event_type") == "error", F.concat(F.lit("Maximum concurrency for 8,192 tokens per request: "), v, F.lit("x"))).otherwise(F.lit("other line")))
    return V.log_figures(ev.select("user_id", F.struct("ts", "event_id").alias("line"), text.alias("value")), ["user_id"])


PATTERN_LIST = [("noul", "eligibility check"), ("choice", "routing"), ("score", "severity rating"), ("noul", "duplicate detection")]


@query("""WITH dm AS (SELECT DISTINCT source AS domain FROM documents),pt AS (SELECT * FROM (VALUES ('noul','eligibility check'),('choice','routing'),('score','severity rating'),('noul','duplicate detection')) t(qtype,pattern))
 SELECT domain,qtype,pattern FROM dm,pt QUALIFY row_number() OVER (ORDER BY sha256('seeds:'||domain||':'||qtype||':'||pattern),domain,qtype,pattern)<=30""")
def seed_product(spark, d):
    """30 sampled combinations of domain and pattern."""
    return V.seed_product(table(spark, d, "documents").select(F.col("source").alias("domain")).distinct(), PATTERN_LIST, 30)


@query("""SELECT event_id,CASE WHEN event_id%3=0 THEN 'Yes, the condition holds.' ELSE event_type END AS t,CASE WHEN event_id%2=0 THEN 'No, the condition does not hold.' ELSE props END AS f FROM events""")
def default_criteria(spark, d):
    ev = table(spark, d, "events")
    c = G.normalised_criteria(F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.col("event_type")), F.when(F.col("event_id") % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("props")))
    return ev.select("event_id", c["true"].alias("t"), c["false"].alias("f"))

"""DuckDB SQL of the derived tables in sources/derived.py, as common table expressions the oracle queries start with."""

from __future__ import annotations

from ..sources.derived import DEV_SHARE, LANGS, RUNS, TEACHER, TEACHER_STRENGTH, TOPICS


def u(x: str) -> str:
    return f"(('0x'||substr(sha256({x}),1,8))::BIGINT/4294967295.0::DOUBLE)"


def half(x: str) -> str:
    return f"(('0x'||substr(sha256({x}),1,2))::BIGINT % 2)"


def order_of(seed: str, *ids: str) -> str:
    return "sha256('" + seed + "'" + "".join(f"||':'||({i})::VARCHAR" for i in ids) + ")"


def lst(keys) -> str:
    return "[" + ",".join(f"'{k}'" for k in keys) + "]"


SPACES = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def text_hash(x: str) -> str:
    return f"substr(sha256(trim(regexp_replace(lower({x}),'{SPACES}',' ','g'))),1,20)"


# what a decision row asks, and the text of each of its options
ASK = """CASE WHEN row_id LIKE 'lang-%' THEN 'In which language is the text in the state written?' WHEN row_id LIKE 'toxic-%' THEN 'Is the text in the state toxic?' WHEN row_id LIKE 'quality-%' THEN 'Is the text in the state of good quality?' WHEN row_id LIKE 'topic-%' THEN 'Which class does the record belong to?' ELSE 'Rate the priority of the order in the state.' END"""
TEXTS = """CASE task_type WHEN 'noul' THEN ['No, the condition does not hold.','Yes, the condition holds.'] WHEN 'score' THEN ['urgent','high','medium','unspecified','low'] ELSE CASE WHEN family='dbpedia_topic' THEN list_transform(keys, lambda k: 'Class '||k[-1]) ELSE ['German','English','Spanish','French'] END END"""

LEVEL_KEYS = lst(str(i) for i in range(5))
LEVEL_OF = "((substr(o_orderpriority,1,1)::INT-1)::VARCHAR)"

JUDGED = "judged AS (SELECT d.doc_id,d.text,d.lang,d.source,l.quality,l.toxic FROM documents d JOIN labels l ON d.doc_id=l.doc_id)"

DECISIONS = f"""{JUDGED},
decisions AS (
 SELECT 'lang-'||doc_id AS row_id,'sni_lang_'||source AS family,'choice' AS task_type,{lst(LANGS)} AS keys,lang AS gold,
  '{{"text":'||to_json(text)||'}}' AS state,'CC BY 4.0' AS license,'driver documents' AS source,NULL AS generator FROM documents
 UNION ALL SELECT 'toxic-'||doc_id,'syn_'||source,'noul',['false','true'],(toxic=1)::VARCHAR,'{{"text":'||to_json(text)||'}}','Apache 2.0','synthetic','driver' FROM judged
 UNION ALL SELECT 'quality-'||doc_id,'civil_toxicity','noul',['false','true'],(quality=1)::VARCHAR,'{{"text":'||to_json(text)||'}}','CC0: Public Domain','driver labels',NULL FROM judged
 UNION ALL SELECT 'topic-'||vec_id,'dbpedia_topic','choice',{lst(TOPICS)},'topic_'||label,'{{"vector":'||vec_id||'}}','cc-by-sa-3.0','driver embeddings',NULL FROM embeddings
 UNION ALL SELECT 'priority-'||o_orderkey,'train_priority_'||o_orderstatus,'score',{LEVEL_KEYS},{LEVEL_OF},
  '{{"status":'||to_json(o_orderstatus)||',"total":'||o_totalprice||'}}','MIT','rule generator','driver orders' FROM orders)"""


def weights(run: str, strength: str, case: str) -> str:
    v = f"(1.0::DOUBLE+(CASE WHEN k=gold THEN {strength} ELSE 0.0::DOUBLE END)+{u(f'{run}||chr(58)||{case}||chr(58)||k')})"
    return f"list_transform(keys, lambda k: {v}*{v}*{v}*{v})"


TEACHER_LABELS = f"""labels_t AS (SELECT *, list_transform(w, lambda x: x/list_sum(w)) AS probs FROM (
 SELECT *, {weights(f"'{TEACHER}'", f"{TEACHER_STRENGTH}::DOUBLE", "row_id")} AS w,
  {u(f"'{TEACHER}:'||row_id||':err'")} < 0.01 AS failed, 20.0::DOUBLE+{u("row_id||':ms'")}*200.0::DOUBLE AS latency_ms FROM decisions))"""

CASES = f"""{JUDGED},
base_cases AS (
 SELECT 'lang-'||doc_id AS family_id,'lang' AS slice,'choice' AS task_type,{lst(LANGS)} AS keys,lang AS gold FROM documents
 UNION ALL SELECT 'toxic-'||doc_id,'toxic_'||lang,'noul',['false','true'],(toxic=1)::VARCHAR FROM judged
 UNION ALL SELECT 'quality-'||doc_id,'quality_'||lang,'noul',['false','true'],(quality=1)::VARCHAR FROM judged
 UNION ALL SELECT 'topic-'||vec_id,'topic_'||(label%4),'choice',{lst(TOPICS)},'topic_'||label FROM embeddings
 UNION ALL SELECT 'priority-'||o_orderkey,'priority_'||o_orderstatus,'score',{LEVEL_KEYS},{LEVEL_OF} FROM orders),
cases AS (
 SELECT family_id||'-'||perturbation AS case_id,family_id,slice,task_type,perturbation,gold,len(keys) AS n_options,
  CASE WHEN perturbation='permuted' THEN list_transform(list_sort(list_transform(keys, lambda k: sha256('permute:'||family_id||':'||k)||'|'||k)), lambda s: split_part(s,'|',2)) ELSE keys END AS keys,
  CASE WHEN {u("'suite:'||family_id")} < {DEV_SHARE} THEN 'dev' ELSE 'test' END AS suite
 FROM base_cases, (VALUES ('none'),('permuted')) p(perturbation) WHERE perturbation='none' OR task_type='choice')"""

PREDICTIONS = f"""{CASES},
runs AS (SELECT * FROM (VALUES {",".join(f"('{r}',{s}::DOUBLE)" for r, s in RUNS.items())}) t(run_id,strength)),
drawn AS (SELECT run_id, c.*, {u("run_id||':'||case_id||':err'")} < 0.01 AS failed, {weights("run_id", "strength", "case_id")} AS w,
 20.0::DOUBLE+{u("run_id||':'||case_id||':ms'")}*200.0::DOUBLE AS latency_ms, (50+length(case_id))::BIGINT AS input_tokens FROM cases c, runs),
shares AS (SELECT * EXCLUDE (w), CASE WHEN failed THEN 'timeout' END AS error, CASE WHEN NOT failed THEN list_transform(w, lambda x: x/list_sum(w)) END AS probs FROM drawn),
predictions AS (SELECT *, CASE WHEN task_type='noul' THEN greatest(p_true,1.0-p_true) ELSE list_max(probs) END AS confidence,
  CASE WHEN failed THEN NULL WHEN task_type='noul' THEN (p_true>=0.5)::VARCHAR ELSE keys[list_position(probs,list_max(probs))] END AS pred,
  CASE WHEN task_type='score' THEN list_sum(list_transform(range(1,len(keys)+1), lambda i: keys[i]::DOUBLE*probs[i])) END AS expected_level,
  probs[list_position(keys,gold)] AS p_gold
 FROM (SELECT *, CASE WHEN task_type='noul' THEN probs[list_position(keys,'true')] END AS p_true FROM shares))"""

BIN = "least(greatest(ceil(confidence*10)-1,0),9)::INT"

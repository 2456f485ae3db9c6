"""Guards and quality filters: overlap with evaluation sets, deduplication, patterns, validation, restriction, retry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import _c, canonical_json, text_hash
from ..functions.text import answer_key, outermost_json
from ..sources.tables import failed
from .scale import JOIN_ROWS, attach, materialise, spread_rows

MIN_FIELD_CHARS = 40

# Patterns that mark texts which address the instructions of the system that reads them.
OVERRIDE = (r"(?i)\b(ignore|disregard|forget|override|bypass|new (rules|instructions|guidelines)|updated guidelines|"
            r"you are (now )?(the|a|an)\b|act as|pretend|roleplay|role-play|persona|system prompt|"
            r"your (instructions|rules|guidelines|programming|restrictions)|previous (instructions|text|directions)|"
            r"jailbreak|developer mode|no longer bound)")
COMMAND = r"(?i)\b(send|email|forward|remind|tell|cancel|delete|change|set|turn|stop|play|text|call)\b"
CUE = r"(?i)\b(ignore|disregard|instruction|send|email|api_call|forward|contact|system|override|prompt)\b"
MAX_OPTIONS, MAX_QUESTIONS, MAX_STATE_CHARS = 26, 6, 12_000


def strings_of(state) -> Column:
    """Every string value in a JSON text, at any depth, unescaped; a state that is not JSON is one string.

    The tokens of a valid JSON text are unambiguous: a quoted run followed by a colon is a key, any other is a value.
    """
    s = _c(state)
    tokens = F.regexp_extract_all(s, F.lit(r'"(?:[^"\\]++|\\.)*+"\s*+:?'), F.lit(0))
    values = F.filter(tokens, lambda t: ~t.endswith(":"))
    read = F.transform(values, lambda t: F.variant_get(F.parse_json(t), "$", "string"))
    return F.when(F.try_parse_json(s).isNull(), F.array(s)).otherwise(read)


def field_hashes(df: DataFrame, ids: Sequence[str], state: str = "state", min_chars: int = MIN_FIELD_CHARS) -> DataFrame:
    """(ids, hash) of every text field long enough to count, once per row and text."""
    fields = df.select(*ids, F.explode(F.array_distinct(F.filter(strings_of(state), lambda t: F.length(t) >= min_chars))).alias("field"))
    return fields.select(*ids, text_hash("field").alias("hash"))


def hash_set(*sets: DataFrame) -> DataFrame:
    """Distinct hashes of several sets."""
    out = sets[0].select("hash")
    for s in sets[1:]:
        out = out.unionByName(s.select("hash"))
    return out.distinct()


def overlapping(rows: DataFrame, banned: DataFrame, ids: Sequence[str], state: str = "state") -> DataFrame:
    """Row ids that share a long text field with the banned hashes, with the number of shared fields.

    The hash set is written and counted: it travels by broadcast while it is small and is salted beyond that, so a boilerplate
    line in a third of all rows does not land in one task.
    """
    hits = attach(field_hashes(rows, ids, state), banned.select("hash").distinct(), ["hash"], "left_semi", spread=ids)
    return hits.groupBy(*ids).agg(F.count(F.lit(1)).alias("shared"))


def assert_no_overlap(rows: DataFrame, banned: DataFrame, ids: Sequence[str], state: str = "state") -> None:
    """Abort mode: any overlap stops the build, with a small sample in the message."""
    found = overlapping(rows, banned, ids, state).limit(3).collect()
    if found:
        raise ValueError(f"rows share text with the evaluation sets, e.g. {[tuple(r) for r in found]}")


def decontaminate(cases: DataFrame, banned: DataFrame, test_states: DataFrame, ids: Sequence[str], state: str = "state") -> DataFrame:
    """Filter mode: cases without a shared field and without a state that equals a test state as a whole."""
    dirty = overlapping(cases, banned, ids, state).select(*ids)
    keyed = cases.withColumn("_canon", F.sha2(canonical_json(state), 256))
    same = test_states.select(F.sha2(canonical_json(state), 256).alias("_canon")).distinct()
    return attach(keyed.join(dirty, list(ids), "left_anti"), same, ["_canon"], "left_anti", spread=ids).drop("_canon")


def shared_families(a: DataFrame, b: DataFrame, family: str = "family_id") -> DataFrame:
    """Families present in both sets; must be empty."""
    return a.select(family).intersect(b.select(family))


def first_source_wins(rows: DataFrame, text: str, priority: str, idx: str, min_chars: int = 8) -> DataFrame:
    """One row per normalised text over all pools: the lowest (priority, idx). Texts under min_chars drop.

    (priority, idx) names a row. A text is cleaned and hashed once; hashes and names are written, and the texts meet the
    winners' names.
    """
    trimmed = F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    clean = rows.withColumn(text, trimmed)
    names = clean.where(F.length(text) >= min_chars).select(F.unhex(text_hash(text)).alias("_h"), priority, idx)
    return clean.join(_winners(names, [priority, idx]), [priority, idx], "left_semi").select(*rows.columns)


def drop_exact_copies(rows: DataFrame, states: Sequence[str], order: str) -> DataFrame:
    """One row per canonical content of some columns: the lowest `order`, which names a row."""
    key = F.sha2(F.concat_ws("\u001f", *[F.coalesce(canonical_json(s), F.lit("null")) for s in states]), 256)
    return rows.join(_winners(rows.select(F.unhex(key).alias("_h"), order), [order]), order, "left_semi")


def _winners(names: DataFrame, name: list[str]) -> DataFrame:
    """The lowest name of every hash, of rows (_h, name columns), written: the reader may broadcast it by its size."""
    if len(name) == 1:  # a plain minimum is summed by hash, one of structs by sorting
        return materialise(names.groupBy("_h").agg(F.min(name[0]).alias(name[0])).drop("_h"), "winners")
    return materialise(names.groupBy("_h").agg(F.min(F.struct(*name)).alias("_r")).select("_r.*"), "winners")


def usage_violations(sources: DataFrame, registry: DataFrame, use: str = "train") -> DataFrame:
    """Sources that are missing from the registry or not listed for the use."""
    j = sources.select("hub_id").distinct().join(registry.select("hub_id", "use"), "hub_id", "left")
    return j.where(F.col("use").isNull() | (F.col("use") != use)).select(
        "hub_id", F.when(F.col("use").isNull(), F.lit("not in the registry")).otherwise(F.concat(F.lit("marked "), F.col("use"))).alias("problem"))


def generated_families(replies: DataFrame) -> DataFrame:
    """Validated rows of generated families: replies (idx, qtype, reply) with one JSON object in free text.

    The object needs instructions, options fitting the type and at least 8 instances; an instance needs an object state and
    an answer among the option keys; equal states count once; a family needs 8 rows and 2 different answers in the end.
    """
    body = replies.withColumn("json", outermost_json("reply")).where(F.col("json").isNotNull()).withColumn("v", F.parse_json("json"))
    get = lambda p, t: F.try_variant_get("v", p, t)
    spec = body.select("idx", "qtype", F.coalesce(get("$.family_name", "string"), F.lit("")).alias("raw_name"), get("$.instructions", "string").alias("instructions"),
                       get("$.options", "map<string,variant>").alias("opt_map"), get("$.options", "array<variant>").alias("opt_list"),
                       get("$.instances", "array<variant>").alias("instances"))
    name = F.substring(F.regexp_replace(F.lower("raw_name"), "[^a-z0-9_]", "_"), 1, 50)
    name = F.when(name == "", F.concat(F.lit("family"), F.col("idx"))).otherwise(name)
    keys = F.when(F.col("qtype") == "score", F.when(F.size("opt_list").between(3, 5), F.transform(F.sequence(F.lit(0), F.size("opt_list") - 1), lambda i: i.cast("string"))))
    keys = keys.when(F.col("qtype") == "noul", F.when(F.array_sort(F.map_keys("opt_map")) == F.array(F.lit("false"), F.lit("true")), F.map_keys("opt_map")))
    keys = keys.otherwise(F.when(F.size("opt_map").between(3, 8), F.map_keys("opt_map")))
    spec = spec.withColumn("family", F.concat(F.lit("syn_"), F.format_string("%04d", F.col("idx")), F.lit("_"), name)).withColumn("keys", keys)
    spec = spec.where(F.col("instructions").isNotNull() & F.col("keys").isNotNull() & (F.size("instances") >= 8))
    each = spec.select("family", "qtype", "instructions", "keys", F.posexplode("instances").alias("i", "inst"))
    answer = F.trim(F.coalesce(F.try_variant_get("inst", "$.answer", "string"), F.lit("")))
    each = each.select("family", "qtype", "instructions", "keys", "i", F.when(F.col("qtype") == "noul", F.lower(answer)).otherwise(answer).alias("gold"),
                       F.try_variant_get("inst", "$.state", "map<string,variant>").isNotNull().alias("is_object"), F.to_json(F.try_variant_get("inst", "$.state", "variant")).alias("state"))
    good = each.where(F.col("is_object") & F.array_contains("keys", F.col("gold")))
    once = good.groupBy("family", F.sha2("state", 256).alias("_h")).agg(F.min_by(F.struct("qtype", "instructions", "keys", "gold", "state", "i"), "i").alias("r")).select("family", "r.*")
    enough = once.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("gold").alias("lo"), F.max("gold").alias("hi")).where((F.col("n") >= 8) & (F.col("lo") != F.col("hi")))
    return once.join(enough.select("family"), "family", "left_semi")


def request_problems(requests: DataFrame, demo_limits: bool = True) -> DataFrame:
    """Requests (request_id, state, questions JSON text) with a code for what is wrong, null for a good one.

    One row per request: a code of the whole request, or `<question>:<code>`, of which the first failing question in the request's order decides. demo_limits adds the size limits.
    """
    v = F.try_parse_json("questions")
    asked = requests.withColumn("q", F.try_variant_get(v, "$", "map<string,variant>"))

    def reason(name):
        item = F.try_element_at("q", name)
        kind, ask = F.try_variant_get(item, "$.type", "string"), F.try_variant_get(item, "$.instructions", "string")
        as_map, as_list = F.try_variant_get(item, "$.criteria", "map<string,variant>"), F.try_variant_get(item, "$.criteria", "array<variant>")
        n = F.coalesce(F.size(as_map), F.size(as_list), F.lit(0))
        return (F.when(~F.coalesce(kind.isin("choice", "noul", "score"), F.lit(False)) | (F.coalesce(ask, F.lit("")) == ""), F.concat(name, F.lit(":incomplete")))
                .when((kind == "choice") & (as_map.isNull() | (F.size(as_map) < 2)), F.concat(name, F.lit(":few_options")))
                .when((kind == "score") & (as_list.isNull() | (F.size(as_list) < 2)), F.concat(name, F.lit(":few_levels")))
                .when(F.lit(demo_limits) & (n > MAX_OPTIONS), F.concat(name, F.lit(":many_options"))))

    first = F.get(F.filter(F.transform(F.json_object_keys("questions"), reason), lambda r: r.isNotNull()), F.lit(0))
    whole = (F.when(F.lit(demo_limits) & (F.length("state") > MAX_STATE_CHARS), F.lit("long_state"))
             .when(v.isNull(), F.lit("not_json")).when(F.col("q").isNull() | (F.size("q") == 0), F.lit("no_questions"))
             .when(F.lit(demo_limits) & (F.size("q") > MAX_QUESTIONS), F.lit("many_questions")))
    return asked.withColumn("reject_reason", F.coalesce(whole, first)).drop("q")


def normalised_criteria(true_text, false_text) -> Column:
    """Yes/no criteria with the default texts where none or an empty one is given."""
    from ..functions.text import NO_TEXT, YES_TEXT
    pick = lambda c, d: F.coalesce(F.when(_c(c) != "", _c(c)), F.lit(d))
    return F.struct(pick(true_text, YES_TEXT).alias("true"), pick(false_text, NO_TEXT).alias("false"))


def within_limits(rows: DataFrame, max_tokens: int, tokens: str = "tokens", max_options: int = MAX_OPTIONS) -> DataFrame:
    return rows.where((F.size("options") <= max_options) & (F.col(tokens) <= max_tokens))


def retry_set(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, to retry): an error or a line that did not parse counts as unanswered."""
    ok = ~failed("error")
    if "_corrupt_record" in records.columns:
        ok = ok & F.col("_corrupt_record").isNull()
    return records.where(ok), records.where(~ok)


def restrict(rows: DataFrame, case_ids: DataFrame | None = None, slices: Sequence[str] | None = None) -> DataFrame:
    out = rows if slices is None else rows.where(F.col("slice").isin(list(slices)))
    return out if case_ids is None else out.join(case_ids.select("case_id").distinct(), "case_id", "left_semi")


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: rows whose id is not done yet. The join's tasks grow in number with the ids that are done, not in size."""
    return rows.join(spread_rows(done.select(key), key, rows=JOIN_ROWS), key, "left_anti")


def label_keys(instances: DataFrame, lowest: int = 2, highest: int = 20) -> DataFrame:
    """(task, label, key) of tasks with a usable label set: distinct first outputs, collision-safe keys, 2 to 20 labels.

    Counts come before any list, so a task with millions of labels drops out as a number.
    """
    from pyspark.sql import Window
    labels = materialise(instances.where(F.size("output") > 0).select("task", F.trim(F.get("output", F.lit(0))).alias("label")).distinct(), "labels")
    usable = labels.groupBy("task").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(lowest, highest)).select("task")
    few = labels.join(usable, "task", "left_semi").withColumn("base", answer_key("label"))
    turn = F.row_number().over(Window.partitionBy("task", "base").orderBy("label"))  # at most `highest` rows
    keyed = few.withColumn("key", F.concat(F.col("base"), F.repeat(F.lit("_"), (turn - 1).cast("int"))))
    unique = keyed.groupBy("task").agg((F.count(F.lit(1)) == F.countDistinct("key")).alias("ok")).where("ok").select("task")
    return keyed.drop("base").join(unique, "task", "left_semi")


def task_rows(instances: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(choice rows, skip counts): an instance with more than one different answer, or none, is skipped and counted."""
    distinct = F.size(F.array_distinct(F.transform("output", lambda o: F.trim(o))))
    tagged = instances.withColumn("_skip", distinct != 1)
    skipped = tagged.groupBy("task").agg(F.count_if("_skip").alias("ambiguous_gold"))
    sets = keys.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("key", F.col("label").alias("text")))).alias("options"))  # at most 20
    lookup = F.get(F.filter("options", lambda o: o["text"] == F.col("label")), F.lit(0))["key"]
    rows = attach(tagged.where(~F.col("_skip")).withColumn("label", F.trim(F.get("output", F.lit(0)))), sets, ["task"], spread=["instance_id"])
    return rows.withColumn("gold", lookup).withColumn("n_options", F.size("options")).drop("_skip", "label", "output"), skipped

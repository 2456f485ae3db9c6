"""Option lists of a question: labels, presented texts, orders and the prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _c, hash_order
from .text import NO_TEXT, YES_TEXT, pretty_json

OPTION = "array<struct<pos:int,key:string,text:string>>"

# The wording of the decision prompt and the turn formats it is wrapped in.
PROMPT_INTRO = "You are a decision model. Read the state and answer the question by choosing one option.\n\n"
PROMPT_STATE = "STATE:\n"
PROMPT_QUESTION = "\n\nQUESTION: "
PROMPT_OPTIONS = "\n\nOPTIONS:\n"
ASK_PREFILLED = "Answer with the option {kind} only."
ASK_CHAT = "Reply with only the option {kind}, nothing else."
TURN_FORMATS = {
    "plain": ("", ""),
    "gemma4": ("<|turn>user\n", "<turn|>\n<|turn>model\n<|channel>thought\n<channel|>"),
    "harmony": ("<|start|>system<|message|>You are ChatGPT, a large language model trained by OpenAI.\n"
                "Reasoning: low\n\n# Valid channels: analysis, commentary, final. Channel must be included for every "
                "message.<|end|><|start|>user<|message|>", "<|end|><|start|>assistant<|channel|>final<|message|>"),
}


def option_array(keys: list[str], texts: list[str] | None = None) -> Column:
    """A literal option list."""
    texts = texts or keys
    return F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("key"), F.lit(t).alias("text"))
                     for i, (k, t) in enumerate(zip(keys, texts))]).cast(OPTION)


def renumbered(entries) -> Column:
    """Set pos to the place in the array."""
    return F.transform(_c(entries), lambda o, i: F.struct(i.cast("int").alias("pos"), o["key"].alias("key"), o["text"].alias("text")))


def keys_of(options) -> Column:
    return F.transform(_c(options), lambda o: o["key"])


def labels_for(n) -> Column:
    """A to Z for up to 26 options, two-digit codes from 10 for up to 90; more is an error."""
    n_ = _c(n)
    letters = F.transform(F.sequence(F.lit(0), n_ - 1), lambda i: F.char(F.lit(65) + i))
    codes = F.transform(F.sequence(F.lit(10), n_ + 9), lambda i: i.cast("string"))
    return F.when(n_ <= 26, letters).when(n_ <= 90, codes).otherwise(
        F.raise_error(F.concat(n_.cast("string"), F.lit(" options exceed the two-digit codes"))).cast("array<string>"))


def presented(options, task_type) -> Column:
    """Text shown per option: the level text for ordinals; else 'key: text', with the key hidden when it says nothing."""
    def show(o):
        plain = F.coalesce(o["text"], F.lit("")) == ""
        return (F.when(_c(task_type) == "score", o["text"])
                .when(plain | (o["text"] == o["key"]), o["key"])
                .when(F.length(o["key"]) == 1, o["text"])
                .otherwise(F.concat(o["key"], F.lit(": "), o["text"])))
    return F.transform(_c(options), show)


def encoder_texts(options, task_type) -> Column:
    """struct(keys, texts) for a scorer that reads option texts: yes/no as false then true, with default texts."""
    opts = _c(options)

    def text_at(key, default):
        hit = F.get(F.filter(opts, lambda o: o["key"] == key), F.lit(0))["text"]
        return F.coalesce(F.when(hit != "", hit), F.lit(default))

    noul = F.struct(F.array(F.lit("false"), F.lit("true")).alias("keys"),
                    F.array(text_at("false", NO_TEXT), text_at("true", YES_TEXT)).alias("texts"))
    score = F.struct(keys_of(opts).alias("keys"), F.transform(opts, lambda o: o["text"]).alias("texts"))
    choice = F.struct(keys_of(opts).alias("keys"), F.transform(opts, lambda o: F.when(
        (F.coalesce(o["text"], F.lit("")) == "") | (o["text"] == o["key"]), F.replace(o["key"], F.lit("_"), F.lit(" "))).otherwise(
            o["text"])).alias("texts"))
    return F.when(_c(task_type) == "noul", noul).when(_c(task_type) == "score", score).otherwise(choice)


def prompt(state, instructions, options, task_type, turn: str = "plain", chat: bool = False) -> Column:
    """The whole prompt of a case as one text."""
    labels = labels_for(F.size(_c(options)))
    texts = presented(options, task_type)
    lines = F.array_join(F.zip_with(labels, texts, lambda a, b: F.concat(a, F.lit(") "), b)), "\n")
    letter = F.size(_c(options)) <= 26
    ask = ASK_CHAT if chat else ASK_PREFILLED
    kind = F.when(letter, F.lit(ask.format(kind="letter"))).otherwise(F.lit(ask.format(kind="two-digit code")))
    before, after = TURN_FORMATS[turn]
    prefill = F.lit("") if chat else F.when(letter, F.lit("Answer:")).otherwise(F.lit("Answer: "))
    return F.concat(F.lit(before + PROMPT_INTRO + PROMPT_STATE), pretty_json(_c(state)), F.lit(PROMPT_QUESTION), _c(instructions),
                    F.lit(PROMPT_OPTIONS), lines, F.lit("\n\n"), kind, F.lit(after), prefill)


def orders(keys, task_type) -> Column:
    """Key orders to score: as given, reversed, rotated by half, without repeats; an ordinal keeps its order."""
    k = _c(keys)
    cut = F.floor((F.size(k) + 1) / 2).cast("int")
    rotated = F.concat(F.slice(k, cut + 1, F.size(k) - cut), F.slice(k, F.lit(1), cut))
    return F.when((_c(task_type) == "score") | (F.size(k) < 2), F.array(k)).otherwise(F.array_distinct(F.array(k, F.reverse(k), rotated)))


def hash_shuffled(options, task_type, seed, row_id) -> Column:
    """Options in an order drawn from the row id; an ordinal keeps its order."""
    tagged = F.transform(_c(options), lambda o: F.struct(hash_order(seed, row_id, o["key"]).alias("h"), o.alias("o")))
    mixed = renumbered(F.transform(F.array_sort(tagged), lambda t: t["o"]))
    return F.when(_c(task_type) == "score", _c(options)).otherwise(mixed)

"""Licence scan: phrases in consecutive words, and an exact set-similarity join of text blocks with licence templates.

A block is a run of consecutive words as long as a template, so a notice is found wherever lines end and scattered words are
not one. A template is met by a block that holds at least `containment` of its distinct words, all of them if it is shorter
than SHORT words; words that tell licences apart must be in the block, or must not be. Tokens are ordered by the number of texts
that hold them, rarest first, counted over all texts. A text can only have such a block if it holds one of a template's rarest
|T| - need + 1 tokens (prefix filter), as many words as needed (length filter), and enough tokens behind the common one in that
order (positional filter); only blocks of those texts are looked at, at the places of the template's tokens.

Every text is cut into words once. What is kept of it is which of the templates' tokens it holds and, where a template could be
met by the text as a whole, their places; no text moves. Templates are a parameter of bounded size (MAX_TEMPLATES, more stop the
job), so they are broadcast. Everything is DataFrame functions.

Defined cases: a null or empty text has no words and no labels. Rows that repeat an id are scanned each for itself; a row without
id like any other. Lower-casing concerns A-Z only: the two signs whose lower case would be an ASCII letter are replaced by other
letters before lower().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import even, materialise, narrow, query, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
CONTAINMENT, SHORT = 0.8, 12
MAX_TEMPLATES = 1000
# fixed values: phrases and labels of the contract
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# label, template, words a block must hold, words it must not hold
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "", ""),
    ("apache-2.0", "you may not use this file except in compliance with the license", "file compliance", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary", ""),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative attribution 4", "noncommercial sharealike noderivatives nc sa nd"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "", ""),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu 3", "lesser affero library"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted", ""),
    ("mit", "released under the mit license", "", ""),
    ("mit", "released under the mit licence", "", ""),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2", ""),
]


def lowered(text: Column) -> Column:
    """Lower case in which no sign outside A-Z becomes an ASCII letter."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("κ")), F.lit("İ"), F.lit("ı"))
    return F.lower(plain)


def _pattern(phrase: str) -> str:
    return f"(?<!{WORD})" + f"{GAP}+".join(phrase.split()) + f"(?!{WORD})"


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+")).cast("bigint")


def phrases(docs: DataFrame, known: dict[str, str], *kept: str) -> DataFrame:
    """The kept columns and n_base, first_word, last_word, base (labels) of rows with lower and n_words."""
    out = docs
    for i, phrase in enumerate(known):
        cut = F.split("lower", _pattern(phrase), -1)  # the text between the places
        holds = F.lit(True)
        for word in sorted(set(phrase.split()), key=len, reverse=True):  # a search for plain bytes spares most texts the pattern
            holds = holds & F.contains("lower", F.lit(word))
        out = out.withColumn(f"_cut{i}", F.when(holds & F.col("lower").rlike(_pattern(phrase)), cut))
    count = [F.coalesce(F.size(F.col(f"_cut{i}")) - 1, F.lit(0)) for i in range(len(known))]
    first = [_words(F.get(f"_cut{i}", F.lit(0))) for i in range(len(known))]
    last = [F.col("n_words") - _words(F.element_at(f"_cut{i}", -1)) - len(p.split()) for i, p in enumerate(known)]
    labels = F.array_compact(F.array(*[F.when(F.col(f"_cut{i}").isNotNull(), F.lit(label)) for i, label in enumerate(known.values())]))
    return out.select(*kept, "n_words", sum(count).cast("bigint").alias("n_base"), F.array_min(F.array_compact(F.array(*first))).alias("first_word"),
                      F.array_max(F.array_compact(F.array(*last))).alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"))


class Templates:
    """The templates' token sets, how many tokens a block needs, and the words that decide."""

    def __init__(self, templates: list[tuple], containment: float):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.rows = []
        for label, text, *rules in templates:
            must, never = [sorted(set(r.split())) for r in [*rules, "", ""][:2]]
            tokens, span = sorted(set(text.split())), len(text.split())
            need = len(tokens) if span < SHORT else math.ceil(containment * len(tokens) - 1e-9)
            self.rows.append((label, tokens, need, span, must, never))
        self.vocabulary = sorted({t for _, tokens, _, _, _, never in self.rows for t in [*tokens, *never]})

    def possible(self, held: Column) -> Column:
        """Whether a text that holds these tokens can meet any template."""
        out = F.lit(False)
        for _, tokens, need, _, must, _ in self.rows:
            enough = F.size(F.array_intersect(held, _literal(tokens))) >= need
            for word in must:
                enough = F.array_contains(held, word) & enough
            out = out | enough
        return out

    def index(self, counts: dict[str, int]) -> list[tuple]:
        """Per template and token of its prefix: the token's place among the template's, rarest first."""
        out = []
        for label, tokens, need, span, must, never in self.rows:
            ranked = sorted(tokens, key=lambda t: (counts.get(t, 0), t))
            out += [(t, label, at, len(ranked), need, span, ranked, must, never) for at, t in enumerate(ranked[:len(ranked) - need + 1])]
        return out


def _literal(tokens: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in tokens]) if tokens else F.array().cast("array<string>")


def templates_met(seen: DataFrame, known: Templates) -> DataFrame:
    """seat, found (labels), score (largest containment) of the texts with a block that meets a template.

    seen has seat, n_words, held (tokens of the vocabulary) and places (place and word of each, null where no template can be met).
    """
    counts = {r[0]: r[1] for r in seen.select(F.explode("held").alias("token")).groupBy("token").count().collect()}  # one row per template token at most
    order = _literal(sorted(known.vocabulary, key=lambda t: (counts.get(t, 0), t)))
    kind = "token string, label string, at int, size int, need int, span int, tokens array<string>, must array<string>, never array<string>"
    listed = F.broadcast(seen.sparkSession.createDataFrame(known.index(counts), kind))
    some = seen.where("places IS NOT NULL").withColumn("held", F.array_intersect(order, "held"))
    near = some.select("seat", "n_words", "places", "held", F.posexplode("held").alias("here", "token")).join(listed, "token")
    common = F.array_intersect("held", "tokens")
    left = F.least(F.col("size") - F.col("at"), F.size("held") - F.col("here"))
    near = near.where((F.col("n_words") >= F.col("need")) & (left >= F.col("need")) & (F.size(common) >= F.col("need")) & (F.element_at(common, 1) == F.col("token")))  # once a template
    mine = F.filter("places", lambda p: F.array_contains("tokens", p["word"]) | F.array_contains("never", p["word"]))
    near = near.withColumn("places", mine)

    def block(p, i):
        words = F.transform(F.filter(F.slice("places", i + 1, F.col("span")), lambda o: o["place"] < p["place"] + F.col("span")), lambda o: o["word"])
        hit = F.size(F.array_intersect("tokens", words))
        told = (F.size(F.array_except("must", words)) == 0) & ~F.arrays_overlap("never", words)
        return F.when(F.array_contains("tokens", p["word"]) & told, hit).otherwise(0)

    met = near.select("seat", "label", "size", "need", F.array_max(F.transform("places", block)).alias("best")).where(F.col("best") >= F.col("need"))
    return met.groupBy("seat").agg(F.collect_set("label").alias("found"), F.max(F.col("best") / F.col("size")).alias("score"))


def scan(docs: DataFrame, templates: list[tuple] = TEMPLATES, containment: float = CONTAINMENT, doc_id: str = "doc_id", text: str = "text", known: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    score is the largest containment of a template that was found, 0.5 for a phrase alone, else 0.
    """
    marks = Templates(templates, containment)
    rows = even(narrow(docs, doc_id=doc_id, text=text), "doc_id").select(F.monotonically_increasing_id().alias("seat"), "doc_id", lowered(F.col("text")).alias("lower"))
    rows = rows.withColumn("words", F.array_remove(F.split("lower", f"{GAP}+"), "")).withColumn("n_words", F.size("words").cast("bigint"))
    rows = rows.withColumn("held", F.array_intersect(_literal(marks.vocabulary), "words"))
    place = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("word"))), lambda p: F.array_contains("held", p["word"]))
    rows = rows.withColumn("places", F.when(marks.possible(F.col("held")), place))
    seen = materialise(phrases(rows, known, "seat", "doc_id", "held", "places"), "seen")
    out = seen.select("seat", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").join(templates_met(seen, marks), "seat", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.coalesce("score", F.when(F.col("n_base") > 0, 0.5), F.lit(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", labels).alias("labels"), score.alias("score"))


def _sql() -> str:
    low = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    known = ",".join(f"({[*p.split()]!r},'{label}')" for p, label in PHRASES.items())
    listed = lambda words: f"{words!r}::VARCHAR[]"
    marks = ",".join(f"('{label}',{listed(tokens)},{need},{span},{listed(must)},{listed(never)})" for label, tokens, need, span, must, never in Templates(TEMPLATES, CONTAINMENT).rows)
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all({low},'{word}') AS w FROM documents),
k(p,l) AS (VALUES {known}), t(l,s,need,span,must,never) AS (VALUES {marks}),
f AS (SELECT doc_id, l, unnest(list_filter(range(0,len(w)-len(p)+1), lambda i: w[i+1:i+len(p)]=p)) AS i FROM d, k),
b AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT l, ',' ORDER BY l) AS s FROM f GROUP BY 1),
x AS (SELECT doc_id, l, s, need, must, never, span, w, unnest(list_filter(range(1,len(w)+1), lambda i: list_contains(s,w[i]))) AS i FROM d, t WHERE len(list_intersect(w,s))>=need),
c AS (SELECT doc_id, l, len(list_intersect(w[i:i+span-1],s))/len(s) AS share FROM x
WHERE len(list_intersect(w[i:i+span-1],s))>=need AND list_has_all(w[i:i+span-1],must) AND NOT list_has_any(w[i:i+span-1],never)),
m AS (SELECT doc_id, max(share) AS share FROM c GROUP BY 1),
u AS (SELECT doc_id, string_agg(DISTINCT l, ',' ORDER BY l) AS s FROM (SELECT doc_id,l FROM f UNION SELECT doc_id,l FROM c) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n,0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word, coalesce(b.s,'') AS base_labels, coalesce(u.s,'') AS labels,
coalesce(share, CASE WHEN n>0 THEN 0.5 END, 0)::DOUBLE AS score FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN u USING (doc_id)"""


@query(_sql())
def op5_licenses(spark, d):
    """Licence phrases and templates of every document."""
    return scan(table(spark, d, "documents"))

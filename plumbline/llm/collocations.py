"""Phrase collocations: best-first branch-and-bound growth of phrases over exact counts.

Texts are lower-cased (A-Z), cut into pieces and words; everything is counted per language. Phrases of 2 to 4 words with at
least `least` occurrences are candidates, scored by their weakest cut; a candidate that a longer one nearly always surrounds
is dropped; each language's first `top` are returned.

1. One pass counts all words, a second one all pairs of frequent words.
2. A known phrase p is a prefix whose longer phrases are not counted yet. None of them can be more frequent than p or than the
   best pair that goes on from its last word, and each is cut after its first word, so the score of all of them is bounded by
   SCALE * A / (f(first word) + A) with A the smaller of the two.
3. Per language, theta is the score (or its bound) of the top-th candidate that is not dropped. Prefixes whose bound reaches
   theta are the frontier; with them go the prefixes whose longer phrases decide about a candidate that reaches theta: the
   candidate itself, the phrases one word to its left, and the right part of a phrase of four words.
4. One pass over the texts counts the longer phrases of all those prefixes, theta is found anew (the first time twice as
   deep as needed, which saves passes), and so on until nothing at or above theta is open: the top-th surviving score, ties included, is
   settled. What stays unexpanded lies below it.

Words are told apart by a seeded 64-bit hash; the table of all words shows whether two share one, in which case the hash is
seeded anew, so phrases (arrays of word hashes) are exact. Tasks add equal phrases up before they are shuffled. What tasks
know of the tables are bitmaps of fixed size (FILTER_BITS): a needless bit costs a row, never a count.

Defined cases: a null or empty text has no words; a null language counts as `und`, with the rows of that name; rows that repeat
an id are all counted; an empty table gives no rows. A long text is cut at piece ends, so only one piece must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import attach
from ..sources.tables import union_all
from .arrays import BLOCK_BYTES, LOWER, SLICE_BYTES, expand, mix, powers, separators, slices, text_buffer
from .common import even, in_arrow, materialise, narrow, query, table

LEAST, TOP, LONGEST = 30, 2000, 4
SCALE = 2_000_000  # fixed value of the contract's score
COVER, WHOLE = 80, 100  # a longer phrase with this share of the occurrences drops a candidate
PIECE_ENDS = [(0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?")]
WORD = separators((0x20, 0x20), (0x09, 0x09), *PIECE_ENDS)
INSIDE = separators(*PIECE_ENDS)
FILTER_BITS = 26
HELD = 1_000_000  # rows a task adds up before it hands them on
_U = np.uint64
_VALUES: dict[int, np.ndarray] = {}


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased bytes, row offsets and languages of bounded parts; a single long text is cut behind piece ends."""
    for part, data, off in slices(batch):
        lang = pc.fill_null(part.column(part.schema.get_field_index("lang")), "und").to_numpy(zero_copy_only=False)
        data = LOWER[data]
        if len(data) <= 2 * SLICE_BYTES:
            yield data, off, lang
            continue
        a, ends = 0, np.append(np.flatnonzero(~INSIDE[data]) + 1, len(data))
        while a < len(data):  # one row, as more would have been divided
            b = int(ends[min(np.searchsorted(ends, a + SLICE_BYTES, "left"), len(ends) - 1)])
            yield data[a:b], np.array([0, b - a]), lang
            a = b


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word its start, end and row, and whether the next one follows in its piece."""
    is_word, edge = WORD[data], np.zeros(len(data) + 1, bool)
    edge[off] = True
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1] | edge[1:-1]
    last[:-1] &= ~is_word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    piece = np.cumsum(~INSIDE[data], dtype=np.int32)
    row = np.searchsorted(off, start, "right") - 1
    joined = np.zeros(len(start), bool)
    if len(start) > 1:
        joined[:-1] = (row[1:] == row[:-1]) & (piece[start[1:]] == piece[end[:-1] - 1])
    return start, end, row, joined


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A seeded polynomial of every word's bytes; never zero, which stands for no word."""
    if seed not in _VALUES:
        _VALUES[seed] = np.random.Generator(np.random.PCG64(20260301 + seed)).integers(1, 1 << 63, 256, dtype=np.uint64)
    out, a = np.empty(len(start), np.uint64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + BLOCK_BYTES, "right")))
        low, high = start[a], end[b - 1]
        up, down = powers(high - low)
        c = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUES[seed][data[low:high]] * up, out=c[1:])
        s, e = start[a:b] - low, end[a:b] - low
        out[a:b] = mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return np.maximum(out, _U(1))


def _lang_keys(names: np.ndarray, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode(), seed) for x in names], np.uint64)


def _fold(key: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit value of a language's key and a sequence of words; only filters and sorting rely on it."""
    for w in words:
        key = mix(key * _U(0x9E3779B97F4A7C15) + w)
    return key


def _holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> _U(64 - FILTER_BITS)
    return (bits[at >> _U(6)] >> (at & _U(63))) & _U(1) != 0


class _Sums:
    """Counts of equal rows, added up to HELD distinct ones."""

    def __init__(self, names: list[str], width: int):
        self.names, self.width, self.parts, self.rows = names, width, [], 0

    def add(self, code: np.ndarray, words: list[np.ndarray]) -> None:
        words = words + [np.zeros(len(code), np.uint64)] * (self.width - len(words))
        self.parts.append(_grouped(code, words, np.ones(len(code), np.int64)))
        self.rows += len(self.parts[-1][0])

    def _merge(self) -> None:
        if len(self.parts) > 1:
            code, n = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2))
            self.parts = [_grouped(code, [np.concatenate([p[1][j] for p in self.parts]) for j in range(self.width)], n)]
        self.rows = sum(len(p[0]) for p in self.parts)

    def take(self, last: bool) -> list[list[pa.Array]]:
        """What has to leave the task now: everything at its end, else what is too much even when added up."""
        if not last and self.rows <= HELD:
            return []
        self._merge()
        if not last and self.rows <= HELD // 2:
            return []
        out = []
        for code, words, n in self.parts:
            for a in range(0, len(code), 100_000):
                part = [w[a:a + 100_000] for w in words]
                out.append([pa.array(self.names, pa.string()).take(pa.array(code[a:a + 100_000])), *[pa.array(w.view(np.int64), mask=w == 0) for w in part], pa.array(n[a:a + 100_000])])
        self.parts, self.rows = [], 0
        return out


def _grouped(code: np.ndarray, words: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Equal rows added up; rows whose sort keys clash may stay apart."""
    if not len(code):
        return code, words, n
    order = np.argsort(_fold(code.astype(np.uint64), words))
    code, words, n = code[order], [w[order] for w in words], n[order]
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    for w in words:
        new[1:] |= w[1:] != w[:-1]
    at = np.flatnonzero(new)
    return code[at], [w[at] for w in words], np.add.reduceat(n, at)


def _count_words(batches, seed: int):
    held = None
    for batch in batches:
        for data, off, lang in _chunks(batch):
            start, end, row, _ = _tokens(data, off)
            if not len(start):
                continue
            ends = np.concatenate(([0], np.cumsum(end - start)))
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[expand(start, end - start)])]).dictionary_encode()
            words, place = coded.dictionary, coded.indices.to_numpy()
            names, of = np.unique(lang.astype(str), return_inverse=True)
            at, n = np.unique(of[row].astype(np.int64) * len(words) + place, return_counts=True)
            made = pa.table({"lang": pa.array(names).take(pa.array(at // len(words))), "word": words.take(pa.array(at % len(words))), "n": pa.array(n)})
            held = made if held is None else pa.concat_tables([held, made])
            if held.num_rows > HELD // 2:
                held = _added(held)
                if held.num_rows > HELD // 4:
                    yield from _word_rows(held, seed)
                    held = None
    if held is not None:
        yield from _word_rows(_added(held), seed)


def _added(t: pa.Table) -> pa.Table:
    return t.group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "word", "n"])


def _word_rows(t: pa.Table, seed: int):
    for b in t.combine_chunks().to_batches(max_chunksize=50_000):
        data, off = text_buffer(b.column(1))
        yield [b.column(0), pa.array(_hashes(data, off[:-1], off[1:], seed).view(np.int64)), b.column(1).cast(pa.binary()).cast(pa.string()), b.column(2)]


def _count_grams(batches, seed: int, sent, level: int | None):
    """level 2: pairs of frequent words; None: phrases of 3 and 4 words that begin with a prefix to expand and end in a frequent pair."""
    known = sent.value
    codes: dict[str, int] = {}
    names: list[str] = []
    sums = _Sums(names, 2 if level else LONGEST)
    for batch in batches:
        for data, off, lang in _chunks(batch):
            start, end, row, joined = _tokens(data, off)
            if len(start) < 2:
                continue
            for x in set(lang) - codes.keys():
                codes[x] = len(codes)
                names.append(x)
            code = np.array([codes[x] for x in lang], np.int32)[row]
            key = _lang_keys(lang, seed)[row]
            h = _hashes(data, start, end, seed)
            good = _holds(known["words"], _fold(key, [h]))
            i = np.flatnonzero(joined & good & np.append(good[1:], False))
            if level:
                sums.add(code[i], [h[i], h[i + 1]])
            else:
                pair = np.zeros(len(h) + LONGEST, bool)
                pair[i] = _holds(known["pairs"], _fold(key[i], [h[i], h[i + 1]]))
                i = np.flatnonzero(pair[:-1] & pair[1:])
                for m in range(3, LONGEST + 1):
                    i = i[pair[i + m - 2]]
                    begun = i[_holds(known["open"], _fold(key[i], [h[i + j] for j in range(m - 1)]))]
                    sums.add(code[begun], [h[begun + j] for j in range(m)])
            yield from sums.take(False)
    yield from sums.take(True)


def _bits(batches, seed: int):
    """Of every (lang, key) its bit in the filter, as the number of a 64-bit word and a mask."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(1)
        size = pc.list_value_length(keys).to_numpy()
        flat, start = keys.flatten().to_numpy().view(np.uint64), np.cumsum(size) - size
        out = _lang_keys(batch.column(0).to_numpy(zero_copy_only=False), seed)
        for j in range(int(size.max())):
            more = size > j
            out[more] = _fold(out[more], [flat[start[more] + j]])
        at = out >> _U(64 - FILTER_BITS)
        yield [pa.array((at >> _U(6)).astype(np.int32)), pa.array((_U(1) << (at & _U(63))).view(np.int64))]


def _filter(grams: DataFrame, seed: int) -> np.ndarray:
    """The bitmap of a table's phrases: 2 ** FILTER_BITS bits, whatever the table's size."""
    made = in_arrow(grams.select("lang", "key"), partial(_bits, seed=seed), "at int, mask bigint").groupBy("at").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[made["at"].to_numpy()] = made["mask"].to_numpy().view(np.uint64)
    return out


def count_words(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, int]:
    """Frequent words (lang, key, word, n), words per language (lang, total), and the seed under which all words differ."""
    seed = 0
    while True:
        rows = in_arrow(docs, partial(_count_words, seed=seed), "lang string, w bigint, word string, n bigint")
        words = materialise(rows.groupBy("lang", "w", "word").agg(F.sum("n").alias("n")), "words")
        if not words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count():
            break
        seed += 1
    frequent = words.where(F.col("n") >= least).select("lang", F.array("w").alias("key"), "word", "n")
    return frequent, words.groupBy("lang").agg(F.sum("n").alias("total")), seed


def _count(docs: DataFrame, seed: int, filters: dict, level: int | None, least: int) -> DataFrame:
    """lang, key (array of word hashes), n of the phrases of at least `least` occurrences that the filters let through."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    words = [f"w{i + 1}" for i in range(level or LONGEST)]
    rows = in_arrow(docs, partial(_count_grams, seed=seed, sent=sent, level=level), f"lang string, {', '.join(w + ' bigint' for w in words)}, n bigint")
    sums = rows.groupBy("lang", *words).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = materialise(sums.select("lang", F.array_compact(F.array(*words)).alias("key"), "n"), "grams")
    sent.unpersist()
    return out


def _ratio(a: str, more) -> F.Column:
    """SCALE * a / (a part's count + more), rounded down; products pass 64 bits."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(a), wide(more[0]) + wide(more[1]))


def _scored(new: DataFrame, grams: DataFrame) -> DataFrame:
    """Candidates with their weakest cut: score, l, r, and whether all parts are counted (a missing right part is put at n)."""
    cuts = None
    for k in range(1, LONGEST):
        one = new.where(F.size("key") > k).select("lang", "key", "n", F.lit(k).alias("k"), F.slice("key", 1, k).alias("left"), F.slice("key", F.lit(k + 1), F.size("key") - k).alias("right"))
        cuts = one if cuts is None else cuts.union(one)
    cuts = attach(cuts, grams.select("lang", F.col("key").alias("left"), F.col("n").alias("l")), ["lang", "left"], spread=["key"], ready=True)
    cuts = attach(cuts, grams.select("lang", F.col("key").alias("right"), F.col("n").alias("r")), ["lang", "right"], "left", spread=["key"], ready=True)
    weakest = F.min(F.struct(_ratio("n", ("l", F.coalesce("r", "n"))).alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "key", "n").agg(weakest.alias("cut"), F.bool_and(F.col("r").isNotNull()).alias("exact")).select("lang", "key", "n", "cut.score", "cut.l", "cut.r", "exact")


def _prefixes(new: DataFrame, begin: DataFrame, singles: DataFrame) -> DataFrame:
    """Phrases that may go on: `most`, what a longer one can count at most, and `bound`, what it can score at most."""
    able = new.where(F.size("key").between(2, LONGEST - 1)).withColumn("last", F.slice("key", -1, 1)).withColumn("first", F.slice("key", 1, 1))
    able = attach(able, begin, ["lang", "last"], spread=["key"], ready=True)  # the others end in a word that begins no frequent pair
    able = attach(able, singles.select("lang", F.col("key").alias("first"), F.col("n").alias("f1")), ["lang", "first"], spread=["key"], ready=True)
    able = able.withColumn("most", F.least("n", "on"))
    return able.select("lang", "key", "n", "most", F.slice("key", 2, F.size("key") - 1).alias("tail"), _ratio("most", ("f1", "most")).alias("bound"))


def _standing(scored: DataFrame, longer: DataFrame) -> DataFrame:
    """Scored candidates that no known longer phrase drops; the phrases one word longer are enough, as counts fall with length."""
    sides = [longer.select("lang", F.slice("key", F.lit(a), F.size("key") - 1).alias("key"), F.col("n").alias("around")) for a in (1, 2)]
    around = sides[0].union(sides[1]).groupBy("lang", "key").agg(F.max("around").alias("around"))
    kept = F.coalesce(F.col("around") * WHOLE < F.col("n") * COVER, F.lit(True))
    return attach(scored, around, ["lang", "key"], "left", spread=["key"]).where(kept).drop("around")


def _reach(standing: DataFrame, depth: int) -> DataFrame:
    """lang, theta: the score at place `depth` of every language, -1 where there are fewer."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
    first = standing.select("lang", "score").withColumn("place", place).where(F.col("place") <= depth)
    return materialise(first.groupBy("lang").agg(F.when(F.count(F.lit(1)) == depth, F.min("score")).otherwise(F.lit(-1)).alias("theta")), "theta")


def _at_least(rows: DataFrame, theta: DataFrame) -> DataFrame:
    return attach(rows, theta, ["lang"], spread=["key"], ready=True).where("score >= theta").drop("theta")


def _wanted(prefixes: DataFrame, standing: DataFrame, done: DataFrame, theta: DataFrame) -> DataFrame:
    """Prefixes (lang, key) that must be expanded before everything at or above theta is settled."""
    near = materialise(_at_least(standing, theta).select("lang", "key", "n", "exact"), "near")
    own = near.where(F.size("key") < LONGEST).select("lang", "key", F.lit(True).alias("own"))
    # phrases that end in the first words of a candidate and are frequent enough to drop it with its last word
    tails = None
    for k in range(1, LONGEST - 1):
        one = near.where((F.size("key") > k) & (F.size("key") < LONGEST)).select("lang", F.slice("key", 1, k).alias("tail"), "n")
        tails = one if tails is None else tails.union(one)
    tails = tails.groupBy("lang", "tail").agg(F.min("n").alias("few"))
    asked = attach(prefixes, theta, ["lang"], "left", spread=["key"], ready=True)
    asked = attach(asked, tails, ["lang", "tail"], "left", spread=["key"])
    asked = attach(asked, own, ["lang", "key"], "left", spread=["key"])
    around = F.when(F.col("own"), F.least("n", F.coalesce("few", "n"))).otherwise(F.col("few"))
    asked = asked.where((F.col("bound") >= F.col("theta")) | (F.col("most") * WHOLE >= around * COVER)).select("lang", "key")
    right = near.where(~F.col("exact")).select("lang", F.slice("key", 2, 2).alias("key")).distinct()
    return materialise(asked.union(right).distinct().join(done, ["lang", "key"], "left_anti"), "wanted")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of every language."""
    rows = even(narrow(docs, text=text, lang=lang), "text")
    frequent, totals, seed = count_words(rows, least)
    frequent, totals = materialise(frequent, "frequent"), materialise(totals, "totals")
    singles = frequent.select("lang", "key", "n")
    filters = {"words": _filter(singles, seed)}
    pairs = _count(rows, seed, filters, 2, least)
    filters["pairs"] = _filter(pairs, seed)
    begin = materialise(pairs.groupBy("lang", F.slice("key", 1, 1).alias("last")).agg(F.max("n").alias("on")), "begin")
    known = [singles, pairs]  # every table of phrases is written once and only read from then on
    scored, prefixes = [materialise(_scored(pairs, singles), "scored")], [materialise(_prefixes(pairs, begin, singles), "prefixes")]
    longer, done = pairs.where("1 = 0"), pairs.where("1 = 0").select("lang", "key")
    deep = 4 * top
    while True:
        # candidates below place `deep` stay out of play, unless so many above them are dropped that they are needed
        low = _reach(union_all(*scored), deep)
        pool = materialise(_at_least(union_all(*scored), low), "pool")
        standing = materialise(_standing(pool, longer), "standing")
        theta = _reach(standing, top)
        if low.withColumnRenamed("theta", "low").join(theta, "lang", "left").where("coalesce(theta, -1) < low").limit(1).count():
            deep *= 4
            continue
        if not _wanted(union_all(*prefixes), standing, done, theta).limit(1).count():
            break
        below = attach(_reach(standing, 2 * top), low.withColumnRenamed("theta", "low"), ["lang"], ready=True)  # passes are saved by looking further than needed
        more = _wanted(union_all(*prefixes), standing, done, below.select("lang", F.greatest("theta", "low").alias("theta")))
        filters["open"] = _filter(more, seed)
        found = _count(rows, seed, filters, None, least).withColumn("prefix", F.slice("key", 1, F.size("key") - 1))
        new = materialise(found.join(more.withColumnRenamed("key", "prefix"), ["lang", "prefix"], "left_semi").select("lang", "key", "n"), "new")
        known.append(new)
        again = union_all(*[s.where(~F.col("exact")).select("lang", "key", "n") for s in scored[1:]], new)
        made = materialise(_scored(again, union_all(*known)), "scored")
        scored = [scored[0], *[s.where("exact") for s in scored[1:]], made]
        prefixes.append(materialise(_prefixes(new, begin, singles), "prefixes"))
        longer, done = union_all(*known[2:]), materialise(done.union(more), "done")
    best = _at_least(standing, theta)
    spelt = best.select("lang", "key", F.posexplode("key").alias("at", "w")).withColumn("w", F.array("w"))
    spelt = attach(spelt, frequent.select("lang", F.col("key").alias("w"), "word"), ["lang", "w"], spread=["key"], ready=True)
    phrase = F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]))
    named = best.join(spelt.groupBy("lang", "key").agg(phrase.alias("phrase")), ["lang", "key"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase"))
    ranked = named.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top)
    return attach(ranked, totals, ["lang"], spread=["key"], ready=True).select("lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")


def _sql(top: int = TOP, least: int = LEAST) -> str:
    low = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH p AS (SELECT coalesce(lang,'und') AS lang, unnest(string_split_regex({low},'[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p,'[^\\x20\\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, ws[i:i+m-1] AS g, count(*) AS f FROM (SELECT lang, ws, m, unnest(range(1,len(ws)-m+2)) AS i FROM w, range(1,{LONGEST + 1}) x(m)) GROUP BY 1,2 HAVING count(*)>={least}),
c AS (SELECT lang, g, f, unnest(range(1,len(g))) AS k FROM g WHERE len(g)>1),
s AS (SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, (({SCALE}::HUGEINT*c.f)//(l.f+r.f))::BIGINT AS score FROM c JOIN g l ON l.lang=c.lang AND l.g=c.g[1:k] JOIN g r ON r.lang=c.lang AND r.g=c.g[k+1:len(c.g)]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang,g ORDER BY score,k)=1),
x AS (SELECT lang, g[i:j] AS g, max(f) AS f FROM (SELECT lang, g, f, i, unnest(range(i+1,len(g)+1)) AS j FROM (SELECT lang, g, f, unnest(range(1,len(g))) AS i FROM g WHERE len(g)>2)) WHERE j-i+1<len(g) GROUP BY 1,2),
y AS (SELECT b.*, array_to_string(b.g,' ') AS phrase FROM b LEFT JOIN x USING (lang,g) WHERE x.f IS NULL OR {WHOLE}*x.f::HUGEINT<{COVER}*a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM y JOIN t USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)<={top}"""


@query(_sql())
def op12_collocations(spark, d):
    """The 2,000 strongest phrases of every language."""
    return collocations(table(spark, d, "documents"))

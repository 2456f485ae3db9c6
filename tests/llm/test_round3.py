"""Merkle manifest, collocations and exact top-k search: odd rows, ties, hot groups, against plain Python and SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import collocations, graph, merkle, topk
from plumbline.operators import scale

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    return H("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in merkle.FIELDS))


def climb(nodes):
    """The root, and every node's flanks level by level."""
    path, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            a = place - place % 16
            path[i].append(("".join(nodes[a:place]), "".join(nodes[place + 1:a + 16])))
        nodes, at = [H("".join(nodes[a:a + 16])) for a in range(0, len(nodes), 16)], [p // 16 for p in at]
    return nodes[0], path


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in groups[s]])
    root, above = climb([trees[s][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path = trees[s][1][i] + above[j]
            node = leaf(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                node = leaf({**r, "text": "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])})
            for a, b in path:
                node = H(a + node + b)
            out.append((r["doc_id"], leaf(r), trees[s][0], root, H("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def documents(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in merkle.FIELDS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")


def test_manifest_of_sources_of_every_size(spark):
    rng = random.Random(5)
    sizes = {None: 3, "": 1, "Z": 16, "a": 17, "é": 257, "hot": 4200, "one": 1, "x": 256, **{f"s{i}": 1 for i in range(20)}}
    rows, n = [], 0
    for s, k in sizes.items():
        for _ in range(k):
            n += 1
            rows.append({"doc_id": n, "source": s, "lang": rng.choice(["en", None, ""]), "n_chars": rng.choice([None, 5, -7]), "text": rng.choice([None, "", "Ab É", f"Text {n}"])})
    rows += [{"doc_id": None, "source": "x", "lang": "en", "n_chars": 1, "text": t} for t in ("A", "A", None)] + [dict(rows[5]), {**rows[6], "text": "Other"}]
    rng.shuffle(rows)
    docs = documents(spark, rows).select("*", *[F.lit("clash").alias(c) for c in ("node", "place", "size", "leaf", "rows", "block", "level0", "path", "by", "in_source", "seat")])
    got = sorted(map(tuple, merkle.tampered_folds(docs).collect()), key=str)
    assert got == plain_manifest(rows)
    assert {v for *_, v in got} == {True, False}


def test_manifest_of_no_rows(spark):
    assert merkle.tampered_folds(documents(spark, [])).collect() == []
    alone = [{"doc_id": 5, "source": "s", "lang": None, "n_chars": None, "text": None}]
    assert list(map(tuple, merkle.tampered_folds(documents(spark, alone)).collect())) == plain_manifest(alone)


def plain_collocations(rows, top, least):
    import re
    found, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall("[^ \t]+", piece)
            words[lang or "und"] += len(ws)
            for m in range(1, 5):
                found[lang or "und"].update(tuple(ws[i:i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in found.items():
        f = {p: n for p, n in f.items() if n >= least}
        kept = []
        for p, a in f.items():
            if len(p) > 1 and not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in f.items()):
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, words[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("top", "least"), [(3, 2), (12, 3), (2000, 2)])
def test_collocations_against_counting(spark, top, least):
    rng = random.Random(top)
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "en", "en", "fr", None, "und"])
        words = [rng.choice(["A", "b", "c", "d", "É", "x", "new york city", "of the", "the", "the", "p q r s", f"w{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice([" ", "  ", " \t"]).join(w + rng.choice(["", "", "", ".", ",\n", "!?"]) for w in words), lang))
    rows += [(None, "en"), ("", None), (" . , ", "de"), ("lone", "es")] + [("same words again and again", "en")] * 20
    docs = spark.createDataFrame(rows, "text string, lang string").select("*", *[F.lit("clash").alias(c) for c in ("key", "n", "word", "phrase", "rank", "score", "l")])
    got = sorted(map(tuple, collocations.collocations(docs, top, least).collect()))
    assert got == plain_collocations(rows, top, least)


def test_collocations_expand_only_what_can_reach_the_top(spark, monkeypatch):
    """Rare company of frequent words is bounded away: its prefixes are never counted further."""
    rng, asked = random.Random(2), []
    rows = [(" ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(30)) + ". " + " ".join(["red blue green", "x y"]), "en") for _ in range(60)]
    plain = collocations._count
    monkeypatch.setattr(collocations, "_count", lambda docs, seed, filters, level, least: asked.append(int(np.bitwise_count(filters["open"]).sum()) if level is None else 0) or plain(docs, seed, filters, level, least))
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), 1, 2).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, 1, 2)
    assert sum(asked) < 15  # of 16 pairs of a to d alone and over 60 phrases of three


def test_collocations_of_long_texts_and_shared_hashes(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 50)
    rows = [("one two three. four five six, " * 40, "en"), ("one two three " * 30, "en"), ("", "en")]
    frame = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, collocations.collocations(frame, 10, 2).collect())) == plain_collocations(rows, 10, 2)
    seen = []
    plain = collocations.in_arrow
    monkeypatch.setattr(collocations, "in_arrow", lambda df, fn, schema: seen.append(fn.keywords.get("seed")) or (plain(df, fn, schema).withColumn("w", F.lit(1).cast("bigint")) if fn.keywords["seed"] == 0 else plain(df, fn, schema)))
    frequent, _, seed = collocations.count_words(frame, 2)
    assert seed == 1 and len({tuple(r.key) for r in frequent.collect()}) == 6


def plain_top(rows, divisor, k):
    whole = [(i, r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]]) for i, r in enumerate(rows)
             if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for at, q, v in whole:
        if q % divisor == 0:
            all_ = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for place, i, w in whole if place != at)
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(all_[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "stripe"), [(256, 32), (4, 2)])
def test_top_k_odd_vectors_ties_and_copies(spark, monkeypatch, block, stripe):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "STRIPE", stripe)
    rng = random.Random(block)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(120)] + [(i, [0.5, 0.25, 0.0, 0.0, -0.5, 1.0]) for i in range(120, 180)]
    rows += [(200, None), (210, [None, 1.0]), (220, [float("nan")] * 6), (230, [float("inf")] + [0.0] * 5), (240, []), (250, [0.0] * 6), (260, [1.0]), (None, [1.0] * 6), (-50, [-1.0] * 6), (120, [0.5, 0.25, 0.0, 0.0, -0.5, 1.0]), (270, [3e6] * 6), (280, [-3e6] * 6)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit("clash").alias(c) for c in ("id", "seat", "stripe", "score", "pivot", "weights", "pack")])
    got = sorted(map(tuple, topk.top_k(frame, 10, 5).collect()))
    assert got == plain_top(rows, 10, 5)


def test_top_k_few_rows_and_large_numbers(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk.top_k(frame([]), 50).collect() == []
    assert topk.top_k(frame([(50, [1.0])]), 50).collect() == []
    assert list(map(tuple, topk.top_k(frame([(50, []), (1, [])]), 50).collect())) == [(50, 1, 1, 0)]
    rows = [(0, [3e6, 1.0]), (1, [3e6, 0.5]), (2, [-3e6, 0.5]), (3, [3e6, 2.0 ** -8])]
    assert sorted(map(tuple, topk.top_k(frame(rows), 50, 2).collect())) == plain_top(rows, 50, 2)


def test_blocks_are_left_out_by_their_bounds(monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 1000, (40, 8))
    x = np.floor(np.repeat(centre, topk.BLOCK, 0) + rng.normal(0, 10, (40 * topk.BLOCK, 8)))
    at = np.arange(0, len(x), topk.BLOCK)
    seen = []
    plain = topk.products
    monkeypatch.setattr(topk, "products", lambda a, b: seen.append(len(a) * len(b)) or plain(a, b))
    asked = x[::topk.BLOCK]
    owner, place, score = topk.search(asked, at, topk._limits([topk.LOWEST] * 40), x, np.arange(len(x)), np.arange(len(x)), np.maximum.reduceat(x, at), np.minimum.reduceat(x, at), 5)
    all_ = asked @ x.T
    all_[np.arange(40), at] = -np.inf
    for q in range(40):
        assert place[owner == q].tolist() == np.lexsort((np.arange(len(x)), -all_[q]))[:5].tolist()
    assert sum(seen) < len(asked) * len(x) / 5


def test_manifest_sql_at_many_rows(spark):
    """The SQL twin on more levels than the given tables reach."""
    con = duckdb.connect()
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", "en", i, f"Text {i}") for i in range(900)]
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?,?,?,?,?)", rows)
    want = sorted(con.execute(merkle._sql()).fetchall())
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, merkle.tampered_folds(frame).collect())) == want


def test_components_of_stars_beyond_the_broadcast_bound(spark, monkeypatch):
    """Two hubs with most of the links, a chain between their leaves, and a component of its own, salted and plain alike."""
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 999) for i in range(1, 300)] + [(399, 1299), (5000, 5001), (5001, 5002), (5000, 5001), (7, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    want = {(i, 0) for i in range(1, 400)} | {(i, 0) for i in range(999, 1300) if i != 1000} | {(5001, 5000), (5002, 5000)}
    assert {(r.node, r.component) for r in graph.components(frame).collect()} == want
    monkeypatch.setattr(scale.attach, "__defaults__", ("inner", (), False, 5))
    assert {(r.node, r.component) for r in graph.components(frame).collect()} == want

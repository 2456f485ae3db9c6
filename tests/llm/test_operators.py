"""Edge cases of the llm operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, hot groups."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, arrays, bpe, chat, decontam, graph, langid, licenses, neardup, pieces, quality, repeats, suffix_sort, token_store
from plumbline.llm.common import narrow

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every oddity, and columns whose names the operators use themselves."""
    long = sentence(random.Random(1), 40_000)
    rows = [(1, "Hello world again", "en"), (2, None, "en"), (3, "", None), (None, "no id here at all", "en"), (None, None, None), (5, " \t\n ", "fr"), (6, long, "de"),
            (7, long, "de"), (8, "x", "en"), (8, "x", "en"), (9, "é日 \u212a İ <turn:user> \\b", "fr"), (9, "another text under the same id", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("doc", "n", "kind", "payload", "component", "score", "carried", "own", "id", "class", "bucket", "lower", "value", "list"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("1 = 0")


def test_words_do_not_depend_on_blocks(monkeypatch):
    text = ("Hello, wörld 12! " * 50).encode() + b"y" * 300
    data, off = np.frombuffer(text + b"tail", np.uint8), np.array([0, len(text), len(text), len(text) + 4])
    whole = arrays.words(data, off, arrays.ALNUM)
    monkeypatch.setattr(arrays, "BLOCK_BYTES", 37)
    for a, b in zip(whole, arrays.words(data, off, arrays.ALNUM), strict=True):
        assert (a == b).all()
    assert whole[2].max() == 2 and 1 not in whole[2]


def test_pieces_follow_the_pattern():
    import public_tokenizers
    import regex
    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(3)
    texts = ["".join(rng.choice("ab sTtrevmdl'’ \n\t\u3000\x851٣.,!é日\U0001f600") for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["'s", " 's", "x's y'LL z'll", ""]
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    text, cps, rows = pieces.code_points(np.frombuffer(b"".join(raw), np.uint8), off)
    starts = pieces.cuts(cps, rows)
    ends = np.append(starts[1:], len(cps))
    assert [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] == [w for t in texts for w in pattern.findall(t)]


def test_cache_that_overflows_gives_the_same_ids():
    calls = []

    def encode(new):
        calls.append(len(new))
        return [[ord(c) for c in p] for p in new]

    small, rng = pieces.Encoder(encode, limit=20), random.Random(5)
    for _ in range(20):
        text = sentence(rng, 12)
        data = np.frombuffer(text.encode(), np.uint8)
        ids, n = small.slice_ids(data, np.array([0, len(data)]))
        assert "".join(map(chr, ids)) == text and n.tolist() == [len(text)]
    assert len(calls) == 20


def test_suffix_array_against_sorting():
    rng = random.Random(2)
    for _ in range(150):
        k = rng.choice([1, 2, 5, 256])
        strings = [bytes(rng.randrange(k) for _ in range(rng.randint(0, rng.choice([4, 40])))) for _ in range(rng.randint(1, 9))]
        text, starts = suffix_sort.join(strings + strings[:2])
        order = suffix_sort.suffix_array(text, starts)
        of = {int(s) + j: x[j:] for x, s in zip(strings + strings[:2], starts, strict=True) for j in range(len(x))}
        got = [of[p] for p in order.tolist()]
        assert got == sorted(of.values())
        prefix = suffix_sort.common_prefixes(text, starts, order, 9)
        for a, b, n in zip(got, got[1:], prefix[1:].tolist(), strict=False):
            assert n == next((i for i in range(min(len(a), len(b), 9)) if a[i] != b[i]), min(len(a), len(b), 9))


def brute_repeats(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            gone[s:s + length] |= w in seen
            seen.add(w)
        out[doc] = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return out


@pytest.mark.parametrize("wide", [0, 1, 4000])
def test_repeats_by_every_way(spark, monkeypatch, wide):
    """Contexts gathered by anchor (4000) and windows spread one by one (0, 1) remove the same bytes."""
    monkeypatch.setattr(repeats, "WIDE", wide)
    rng = random.Random(7)
    passage, line = sentence(rng, 60), sentence(rng, 20)
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randint(0, 30)), passage[rng.randint(0, 90):][:rng.randint(0, 500)] if i % 3 else "", line, "ab" * rng.randint(0, 120)]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[5][1]), (101, rows[5][1])]
    got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows, 100)


def test_repeats_with_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SAMPLE", 100)
    rng = random.Random(8)
    shared = sentence(rng, 40)
    rows = [(i, f"{sentence(rng, 5)} {shared} {sentence(rng, 5)}") for i in range(150)]
    got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows, 100)


def test_repeats_odd_rows(odd, empty):
    got = {}
    for r in repeats.remove_repeats(odd).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.kept_text, r.carried["payload"]))
    assert got[7][0][0] == got[7][0][1] > 100 and got[6][0][1] == 0 and len(got[8]) == len(got[9]) == len(got[None]) == 2
    assert got[2][0][:3] == (0, 0, "") and all(x[1] == 0 for k in (1, 3, 5, 8, 9, None) for x in got[k])
    assert repeats.remove_repeats(empty).count() == 0


def brute_components(rows, width, percent):
    sets = {}
    for doc, text in rows:
        w = (text or "").lower().split()
        s = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets[doc] = s
    up = {d: d for d in sets}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize("block", [400, 7])
def test_near_duplicates_of_a_large_group(spark, monkeypatch, block):
    """One group of near copies with stragglers on both sides of the threshold, cut into many blocks or none."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "CHUNK", 11)
    rng = random.Random(11)
    base, rows = sentence(rng, 120).split(), []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 30))
        rows.append((i * 3 % 271, " ".join(w)))
    rows += [(1000 + i, sentence(rng, rng.randint(1, 40))) for i in range(40)] + [(2000, rows[0][1].upper()), (2001, "a b"), (2002, "A  b"), (2003, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_duplicates_odd_rows(odd, empty, spark):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd, 3, 85).collect()]
    assert len(got) == odd.count()
    assert (7, got[[g[0] for g in got].index(7)][1], 6, False) in got and (2, 0, 2, True) in got and (5, 0, 5, True) in got
    assert all(c is None and k for d, _, c, k in got if d is None) and all(k for d, _, _, k in got if d in (8, 9))
    assert neardup.near_duplicates(empty).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (80, 90), (70, 70)], "a long, b long")
    assert {(r.node, r.component) for r in graph.components(chain).collect()} == {(i, 0) for i in range(1, 41)} | {(90, 80)}


def test_decontamination_short_items_and_overlaps(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Red FISH"), (3, None), (4, "..."), (None, "blue moon rising"), (2, "Red FISH")],
                                  "item_id long, text string").withColumn("hits", F.lit(1))
    docs = spark.createDataFrame([(1, "zero one, two three four five six seven eight nine ten eleven! tail"), (2, "a red fish and red"), (3, "one two three four five six seven eight nine"),
                                  (4, "red fish"), (5, "the blue  moon rising"), (6, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    assert [(got[i].n_words, got[i].n_hit, got[i].items) for i in range(1, 7)] == [(13, 11, [1]), (5, 2, [2]), (9, 0, []), (2, 2, [2]), (4, 3, []), (0, 0, [])]
    assert got[2].text == "a  and red" and got[1].dropped and got[1].text is None and got[4].dropped and got[3].text.startswith("one") and got[6].text is None
    assert decontam.matches(odd, bench).count() == odd.count() and decontam.decontaminate(empty, bench).count() == 0
    assert decontam.matches(docs, bench.where("1 = 0")).where(F.size("hits") > 0).count() == 0


def test_decontamination_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, sentence(rng, 14)) for i in range(30)]
    docs = [(i, f"{sentence(rng, 5)} {items[i][1]} {items[(i * 7) % 30][1]} {sentence(rng, 3)}") for i in range(30)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    read = lambda: {r.doc_id: (r.n_words, r.hits, sorted(r["items"])) for r in decontam.matches(*frames).collect()}
    whole = read()
    monkeypatch.setattr(decontam, "PART_BYTES", 600)
    assert read() == whole and all(len(v[2]) in (1, 2) for v in whole.values())


def test_language_odd_rows(odd, empty):
    model = langid.learn(narrow(odd, doc_id="doc_id", text="text", lang="lang"))
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd, model).collect()]
    assert len(got) == odd.count() and all(p == "und" and s == 0 for d, p, s in got if d in (2, 3, 5)) and all(0 <= s <= 1 for _, _, s in got)
    nothing = langid.learn(narrow(empty, doc_id="doc_id", text="text", lang="lang"))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_language_against_counting_gram_by_gram(spark):
    import math
    from collections import Counter

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 0xD6E8FEB86659FD93 + int(langid.signs()[ord(c)])) % 2**64
        h = int(arrays.mix(np.array([h], np.uint64))[0]) if len(gram) > 1 else h
        return h >> 64 - langid.BITS

    def of(text):
        return [bucket(text[i:i + k]) for k in (1, 2, 3) for i in range(len(text) - k + 1)]

    rng = random.Random(3)
    kinds = {"a": "abcdefg hij", "b": "hijklmé nop", "c": "defghij kl"}
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))), lang) for i, (lang, letters) in enumerate(list(kinds.items()) * 15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, docs = {k: Counter() for k in kinds}, Counter(lang for _, _, lang in rows)
    for _, text, lang in rows:
        counts[lang].update(of(text))
    names, prior, matrix = langid.learn(df)
    assert names == sorted(kinds) and matrix.shape == (langid.BUCKETS, 3)
    for r in langid.identify(df, (names, prior, matrix)).collect():
        text, log = rows[r.doc_id][1], {}
        for k, seen in counts.items():
            total = sum(seen.values()) + langid.SMOOTHING * langid.BUCKETS
            log[k] = math.log(docs[k] / len(rows)) + sum(float(np.float32(math.log((seen[g] + langid.SMOOTHING) / total))) for g in of(text))
        top = max(log.values())
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        assert r.lang_pred == min(k for k in log if log[k] > top - 1e-9)
        assert r.score == pytest.approx(1 / sum(math.exp(v - top) for v in log.values()), abs=1e-5)


def test_languages_that_tie(spark):
    both = spark.createDataFrame([(1, "abc abd", "y"), (2, "abc abd", "x")], "doc_id long, text string, lang string")
    got = langid.identify(both, langid.learn(both)).collect()
    assert {r.lang_pred for r in got} == {"x"} and all(r.score == pytest.approx(0.5) for r in got)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1), (1, 0), (None, 1), (2, None), (9, 0), (9, 1)], "doc_id long, label int")
    weights = quality.learn(narrow(odd, doc_id="doc_id", text="text"), labels, steps=3)
    out = quality.scored(odd, weights)
    assert out.columns.count("score") == 1 and out.count() == odd.count() and out.where("score >= 0 AND score <= 1").count() == odd.count()
    constant = quality.learn(narrow(empty, doc_id="doc_id", text="text"), labels)
    assert {r.score for r in quality.scored(odd, constant).collect()} == {0.5} and quality.scored(empty, weights).count() == 0


def test_a_score_depends_on_the_text_alone():
    rng = np.random.default_rng(4)
    texts = [rng.integers(32, 127, n).astype(np.uint8).tobytes() for n in [0, 1, 3, 4, 59, 60, 61, 64, 123, 124, 125, 700, *rng.integers(0, 500, 40).tolist()]]
    w = quality.fit(texts, (np.arange(len(texts)) % 2).astype(float), 0.5, 3)
    tables, bias = quality.tables_of(w), w["bias"].astype(np.float32)

    def scores(some):
        layout = quality.Layout(np.frombuffer(b"".join(some), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in some]))).astype(np.int64))
        return (quality.features(layout, tables, bias)[0] * w["out"]).sum(1)

    alone = np.concatenate([scores([t]) for t in texts])
    assert (scores(texts) == alone).all() and (scores(texts[::-1]) == alone[::-1]).all()
    for t, found in zip(texts, alone, strict=True):  # one position after the other, in plain Python
        codes = [quality.PAD] * 4 + list(t)
        blocks = max(1, -(-len(codes) // 64))
        codes += [quality.PAD] * (blocks * 64 + 8 - len(codes))
        z = [[float(bias[f]) + sum(float(tables[j][codes[4 * p + j]][f]) for j in range(8)) for f in range(quality.FILTERS)] for p in range(blocks * 16)]
        parts = [z[48 * c:48 * c + 64] for c in range(max(1, -(-(blocks - 4) // 3) + 1))]
        pooled = [[max(0.0, *(row[f] for row in part)) for f in range(quality.FILTERS)] for part in parts]
        x = [sum(c[f] for c in pooled) / len(pooled) for f in range(quality.FILTERS)] + [max(c[f] for c in pooled) for f in range(quality.FILTERS)]
        assert abs(sum(a * b for a, b in zip(x, w["out"], strict=True)) - found) < 1e-5


def test_chunks_cover_the_whole_text():
    rng = np.random.default_rng(1)
    w = {"embed": rng.normal(size=(257, 8)), "kernel": rng.normal(size=(8, 8, 16))}
    plain = b"a" * 5000
    data = np.frombuffer(plain, np.uint8)
    base, _, _ = quality.features(quality.Layout(data, np.array([0, 5000])), quality.tables_of(w), np.zeros(16, np.float32))
    for at in range(0, 5000, 333):
        changed = data.copy()
        changed[at:at + 8] = np.frombuffer(b"\xf0ZQ~\x01{!\xc3", np.uint8)[:5000 - at]
        x, _, _ = quality.features(quality.Layout(changed, np.array([0, 5000])), quality.tables_of(w), np.zeros(16, np.float32))
        assert not np.allclose(x, base)


def test_licences(spark, odd, empty):
    docs = spark.createDataFrame([(1, "x MIT  License, cc-by; CC BY\nmit\nlicense"), (2, "submit license cc byte"), (3, "a\nLicensed under the Apache License, Version 2.0.\nb"), (4, None),
                                  (5, "released under the MIT licence"), (6, "G\u212aU gnu general\npublic license")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(docs).collect()}
    assert got == {1: (9, 4, 1, 7, "cc-by,mit", "cc-by,mit"), 2: (4, 0, None, None, "", ""), 3: (10, 1, 4, 4, "apache", "apache,apache-2.0"), 4: (0, 0, None, None, "", ""),
                   5: (5, 0, None, None, "", "mit"), 6: (5, 1, 1, 1, "gpl", "gpl")}
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0


def test_licence_notices_wrapped_over_lines(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation\n"
           "files (the \"Software\"), to deal in the Software")
    bsd = "# Redistribution and use in source and binary forms, with or without\r\n# modification, are permitted provided that"
    far = "released\n" + "one two three four five six\n" * 3 + "under the\n" + "seven eight nine ten\n" * 3 + "license"
    docs = spark.createDataFrame([(1, f"intro\n{mit}\nend"), (2, bsd), (3, "\n".join("licensed under cc by nc 4 0".split())), (4, far), (5, mit.replace("\n", " ")),
                                  (6, "the\n" * 200 + bsd + "\nthe" * 200)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert got == {1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("cc-by,cc-by-nc-4.0", 1.0), 4: ("", 0.0), 5: ("mit", 1.0), 6: ("bsd", 1.0)}
    others = [("released under the apache license", "apache"), ("released under the bsd license", ""), ("licensed under cc by 4 0", "cc-by"), ("this work is licensed under the gnu general public license version 2", "gpl"),
              ("licensed under the apache license version 1 0", "apache"), ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", ""),
              (" ".join(["released", *["x"] * 60, "under", *["y"] * 60, "the", "mit", *["z"] * 80, "license"]), ""),
              ("this work is licensed under a creative commons attribution 4 0 international licence", "cc-by-4.0")]
    told = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(others)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(told).collect()} == {i: labels for i, (_, labels) in enumerate(others)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?,?)", [(i, t) for i, (t, _) in enumerate(others)] + [tuple(r) for r in docs.withColumn("doc_id", F.col("doc_id") + 100).collect()])
    both = told.union(docs.withColumn("doc_id", F.col("doc_id") + 100))
    want = con.execute(licenses._sql())
    columns = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in licenses.scan(both).select(columns).collect()))) == sorted(map(str, want.fetchall()))
    many = spark.createDataFrame([(i, f"a\n{mit}") for i in range(50)], "doc_id long, text string")
    assert {(r.labels, r.score) for r in licenses.scan(many).collect()} == {("mit", 1.0)}


def test_chat_parts_and_escapes(spark):
    rows = [(1, 0, "user", [("text", "see <turn:assistant>", None, None), ("image", None, "a.png", 2), ("text", "\\l>", None, None)]), (1, 1, "assistant", [("text", "ok </turn>\n", None, None)]),
            (1, 2, "assistant", [("audio", None, "b.wav", 3), ("odd", None, "c", None)]), (2, None, None, None), (None, 0, "a>b", [("text", None, None, None)])]
    out = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")).cache()
    one = out.where("conv_id = 1").first()
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "a.png", 512), (2, "audio", "b.wav", 75), (2, "odd", "c", 1)]
    assert one.expanded_tokens == 588 and [one.formatted[s.start:s.end] for s in one.loss if s] == ["ok \\l/turn\\g\n", "<audio><attachment>"]
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "see <turn:assistant><image>\\l>"), ("assistant", "ok </turn>\n"), ("assistant", "<audio><attachment>")]
    assert [tuple(t) for t in back[None].turns] == [("a>b", "")] and [tuple(t) for t in back[2].turns] == [("", "")] and back[2].loss_texts == []
    assert chat.format_chats(spark.createDataFrame([], f"conv_id long, turn long, role string, parts {chat.PARTS}")).count() == 0


def test_bpe_round_trip_and_long_pieces(spark, odd, empty):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    m = bpe.machine(path)
    short = [p for p in ("ab" * 100, "é" * 90, "=" * 77, "qzxw" * 30)]
    assert [m.encode([p])[0] for p in short] == [m.contract(p.encode()) for p in short]
    got = bpe.round_trip(odd, path).collect()
    assert len(got) == odd.count() and all(bytes(r.bytes).decode() == (t or "") for r, t in zip(sorted(got, key=lambda r: (r.doc_id or 0, bytes(r.bytes))),
                                                                                       [r.text for r in sorted(odd.collect(), key=lambda r: (r.doc_id or 0, (r.text or "").encode()))], strict=True))
    coded = bpe.encode(odd, path)
    assert {bytes(r.bytes) for r in bpe.decode(coded, path).collect()} == {bytes(r.bytes) for r in got} and bpe.encode(empty, path).count() == 0


def test_added_tokens_are_those_of_the_plain_library(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    token = library.get_added_tokens_decoder()[max(library.get_added_tokens_decoder())].content
    texts = {1: f"a {token} b", 2: "plain", 3: token * 3, 4: f"{token[:-1]} {token} \n\n{token}x", 5: None, 6: "after"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read(spark, token_store.write(docs, f"{tmp_path}/ids", path)).collect()}
    start = 0
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[doc] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_union_sketch_estimate():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 300))
        both = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
        a, b = both[rng.random(len(both)) < 0.8], both[rng.random(len(both)) < 0.8]
        if not len(a) or not len(b):
            continue
        union = np.union1d(a, b)[:neardup.KEEP]
        shared = np.isin(union, np.intersect1d(a, b)).sum()
        assert neardup._estimates([a[:neardup.KEEP], b[:neardup.KEEP]], np.array([0]), np.array([1]))[0] == shared + max(0, neardup.KEEP - len(np.union1d(a[:neardup.KEEP], b[:neardup.KEEP])))


def test_token_store_random_access(spark, odd, empty, tmp_path):
    import public_tokenizers
    rng = np.random.default_rng(2)
    ids = np.concatenate((rng.integers(0, 300, 3000), rng.integers(0, 1 << 26, 3000), [0, 255, 256, 65535, 65536]))
    segment = token_store.Segment(token_store.pack(ids, [4, None, 9], np.array([0, 10, 10])))
    assert (segment.take(np.arange(len(ids))) == ids).all() and all(segment[i] == ids[i] for i in range(0, len(ids), 131))
    assert segment.doc_ids == [4, None, 9] and len(segment.document(1)) == 0 and (segment.document(0) == ids[:10]).all()
    path = token_store.write(odd, str(tmp_path / "odd"), public_tokenizers.path("byte_bpe_50k.json"), segment_ids=50)
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_store.read(spark, path).collect()))
    assert len(got) == odd.count() and [g[1] for g in got][:2] == [None, None] and sum(g[2] for g in got[:-1]) == got[-1][0]
    assert [g[1] for g in got if g[1] is not None] == sorted(g[1] for g in got if g[1] is not None)
    assert token_store.read(spark, token_store.write(empty, str(tmp_path / "none"), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_nearest_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 10)) * rng.uniform(0.1, 3, (300, 1))
    x[40:90] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 10), (502, [1.0] * 9 + [None]), (503, [float("nan")] * 10), (504, [1.0] * 3), (None, [1.0] * 10), (7, x[8].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 10 = 0"), 20, lists=1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 300, 10))
    for q, found in got.items():
        best = {}
        for i, v in rows[:300] + rows[-1:]:
            if i != q:
                best[i] = max(best.get(i, -1e9), float(np.dot(x[q], v)))
        want = sorted(best.items(), key=lambda t: (-round(t[1], 9), t[0]))[:20]
        mine = [(v, s) for _, v, s in sorted(found)]
        assert len(mine) == 20 and np.allclose([s for _, s in mine], [s for _, s in want])
    few = df.where("vec_id < 5")
    assert ann.nearest(few, few, 20).count() == 5 * 4 and ann.nearest(df.where("1 = 0"), df, 20).count() == 0


def test_copies_go_to_the_smaller_ids(spark):
    """Many copies of the queries' vector in blocks of other vectors: exact ties, of which the smallest ids are due."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[rng.choice(2000, 600, replace=False)] = x[0]
    copies = np.flatnonzero((x == x[0]).all(1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(int(copies[3]), x[0].tolist())] * 30, "vec_id long, embedding array<double>")
    asked = copies[[0, 5, 300, 599]].tolist()
    got = {}
    for r in ann.nearest(df, df.where(F.col("vec_id").isin(asked)), 20, lists=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [v for _, v in sorted(rows)] for q, rows in got.items()} == {q: [int(c) for c in copies if c != q][:20] for q in asked}


def test_near_ties_within_rounding_are_scored():
    """More near copies than leaders, their differences below the rounding of single precision: none may be dropped."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=65)
    x = np.concatenate((centre / np.linalg.norm(centre) + rng.normal(size=(400, 65)) * 1e-6, rng.normal(size=(1600, 65)))).astype(np.float32)
    qi, xi = ann.scan(x[:5], [np.ascontiguousarray(x[:, a:a + ann.COLUMNS]) for a in range(0, 65, ann.COLUMNS)], 21)
    assert all(set(range(400)) <= set(xi[qi == i].tolist()) for i in range(5))


def test_probing_reaches_its_target(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(30, 16))
    x = centre[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 16)) * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    met = 0
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), 20).collect()
    for q in range(0, 4000, 50):
        s = x @ x[q]
        s[q] = -np.inf
        met += np.isin(np.argsort(-s)[:20], [r.vec_id for r in got if r.query_id == q]).mean()
    assert met / 80 >= 0.9

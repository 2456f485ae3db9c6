"""The registered queries of the llm subpackage on the smallest tables: against their SQL, or against plain Python."""

import hashlib
import zlib

import compare
import numpy as np
import public_tokenizers
import pytest
from conftest import SF

from plumbline.llm import bpe
from plumbline.llm.queries import all_oracles, all_queries


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_matches_sql(spark, duck, name):
    text, ok = compare.compare(spark, duck, name, all_queries()[name], all_oracles()[name], SF)
    assert ok, text


def test_nearest_vectors_reach_the_recall(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    got = {}
    for r in all_queries()["op1_nearest"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[asked].tolist())
    met = 0
    for i in asked:
        score = x @ x[i]
        score[i] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        mine = sorted(got[ids[i]])
        assert [m[0] for m in mine] == list(range(1, min(20, len(ids) - 1) + 1))
        assert np.allclose([m[2] for m in mine], score[np.searchsorted(ids, [m[1] for m in mine])], atol=1e-12)
        met += np.isin([m[1] for m in mine], ids[best]).sum() / len(best)
    assert met / len(asked) >= 0.9


def test_byte_bpe_is_that_of_the_library(spark, texts):
    import tiktoken
    ranks = bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in all_queries()["op7_byte_bpe"](spark, SF).collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_stored_tokens_are_those_of_the_library(spark, texts):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = {r.doc_id: r for r in all_queries()["op8_token_store"](spark, SF).collect()}, 0
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_repeats_match_a_scan_of_all_strings(spark, texts):
    seen: set[bytes] = set()
    want = {}
    for doc, text in texts.items():
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            w = raw[s:s + 100]
            if w in seen:
                gone[s:s + 100] = True
            seen.add(w)
        want[doc] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in all_queries()["op9_suffix_dedup"](spark, SF).collect()}
    assert got == want


def test_language_and_quality_on_held_out_rows(spark, duck):
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in all_queries()["op3_language"](spark, SF).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.95
    quality = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    scored = all_queries()["op4_quality"](spark, SF).collect()
    assert len(scored) == len(lang) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    good, bad = ([r.score for r in scored if quality.get(r.doc_id) == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_pipeline_stages(spark, duck):
    import corpus_pipeline as p
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", p.F.lit(1)).withColumn("own", p.F.lit("x"))
    columns = docs.columns
    for name, stage in p.STAGES:
        docs = p.materialise(stage(spark, docs, SF), name)
        out.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns == columns or name == "byte_bpe"
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "byte_bpe"]
    assert all(set(b) <= set(a) for a, b in zip(out, out[1:], strict=False))
    bad = {d for d, in duck.execute("SELECT doc_id FROM labels WHERE quality = 0").fetchall()}
    assert len(bad & set(out[0])) <= len(bad) // 3
    seen: set[bytes] = set()
    for _, r in sorted(out[2].items()):
        raw = r.text.encode()
        assert r.n_chars == len(r.text)
        seen |= {raw[i:i + 100] for i in range(0, len(raw) - 99)}
    before, after = (sum(len(r.text.encode()) for r in o.values()) for o in out[1:3])
    assert len(seen) <= after < before
    last = out[4]
    assert all(r.text == out[3][d].text and r.n_tokens == len(r.ids) for d, r in last.items())


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as p
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, "a plain text of its own, long enough to hold some words", "en", "s"), (1, "a plain text of its own, long enough to hold some words", "en", "s"), (2, None, None, None),
            (3, "", "en", "s"), (None, "a row without id", "en", None), (4, long, "de", "s"), (5, long, "de", "t"), (6, "one text", "fr", "s"), (6, "another one under the id", "fr", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars", "'own' AS _quality_score", "'own' AS carried", "'own' AS ids")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.where("1 = 0"), SF).count() == 0
        got = out.collect()
        assert {(r._quality_score, r.carried, r.ids) for r in got} <= {("own", "own", "own")}
        assert {r.doc_id for r in got} <= {r[0] for r in rows} and all(r.text is None or r.n_chars == len(r.text) for r in got)
        ids = [r.doc_id for r in got]
        if name == "near_duplicates":  # one row of equal ones, one of the copies, all that are unlike anything
            assert ids.count(1) == 1 and 4 in ids and 5 not in ids and {2, 3, None, 6} <= set(ids)
        if name == "decontamination":
            assert len(got) == len(rows)
    last = p.STAGES[-1][1]
    assert sorted((r.doc_id or 0, r.text) for r in last(spark, docs, SF).collect()) == sorted((r[0] or 0, r[1] or "") for r in rows)
    bare = last(spark, docs.select("doc_id", "text"), SF).collect()
    assert len(bare) == len(rows) and {(r.lang, r.source) for r in bare} == {(None, None)} and last(spark, docs.where("1 = 0"), SF).count() == 0

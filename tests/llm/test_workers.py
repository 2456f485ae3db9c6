"""Removal of benchmark passages in the worker that finds them: one worker a task, and what the pass and the removal said apart."""

from pyspark.sql import functions as F

from plumbline.llm import decontam

ITEM = "one two three four five six seven eight nine ten eleven"


def test_decontaminate_keeps_one_worker_a_task(spark):
    docs = spark.createDataFrame([
        (1, f"kept words before here and more of them still. {ITEM}, and after it words stay again, so most of them do", "en"),
        (2, ITEM.upper(), "en"), (2, "nothing of it", None), (None, f"short {ITEM}", "de"), (3, None, "en"), (4, "", "en"),
        (5, "é alpha BETA x and beta alpha beta", "fr"), (6, f"{ITEM} a b c d e f g h i j k {ITEM} l m n o p q r s t u v w x y z", "en")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(7, ITEM), (8, "alpha beta"), (9, None), (None, "l m n")], "item_id long, text string")
    clean = decontam.decontaminate(docs, bench)
    assert clean._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = decontam.matches(docs, bench, texts=True)
    want = {}
    for r in found.collect():
        n = sum(b - a for a, b in zip(r.hits[0::2], r.hits[1::2], strict=True))
        share, raw, kept, at = n / r.n_words if r.n_words else 0.0, (r.text or "").encode(), b"", 0
        for a, b in zip(r.ranges[0::2], r.ranges[1::2], strict=True):
            kept, at = kept + raw[at:a], b
        text = None if share > 0.5 or r.text is None else (kept + raw[at:]).decode()
        want[r.doc_id, r.carried.lang] = (r.n_words, n, r["items"], r.ranges, share, share > 0.5, text)
    got = {(r.doc_id, r.carried.lang): (r.n_words, r.n_hit, r["items"], r.ranges, r.coverage, r.dropped, r.text) for r in clean.collect()}
    assert got == want and len(got) == 8
    assert got[2, "en"][1:3] == (11, [7]) and got[2, "en"][-2:] == (True, None)
    assert got[5, "fr"][:3] == (8, 4, [8]) and got[5, "fr"][4:] == (0.5, False, "é  x and beta ") and got[3, "en"][-1] is None and got[4, "en"][-1] == ""
    assert clean.where(F.col("n_hit") > 0).count() == 5

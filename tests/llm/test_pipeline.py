"""The pipeline's stages, each on what its predecessor kept, against plain Python."""

from __future__ import annotations

import collections
import re

import corpus_pipeline
import numpy as np
from helixloom.llm import toxicity
from tests.llm.test_corpus import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_score(model, text):
    """A score word by word, without cache or batches."""
    words = collections.Counter(text.lower().split())
    share = {w: 1 + np.log(n) for w, n in words.items()}
    of = sum(share[w] * float(model.weight[toxicity.places([w], model.p)[0]].mean()) for w in words)
    return 1 / (1 + np.exp(-(model.bias + of / (sum(share.values()) + model.p.padding))))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # what the pipeline must catch, beside the table's own: copies, and rows with nulls
    first = docs.orderBy("doc_id").limit(1).collect()[0]
    extra = [(90_001, first.text, "en", None, None), (90_002, first.text.replace(" ", "  "), None, "s", 1), (90_003, None, None, None, None), (90_004, "password: hunter2222 and more", "en", "s", 29), (90_005, "", None, None, 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        seen[name] = rows
        if k < 4:
            assert docs.columns == COLUMNS
        was = before.collect()
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert {r.doc_id for r in rows} == {r.doc_id for r in was if plain_score(model, r.text or "") < 0.3}
        elif name == "exact_dedup":
            least = {}
            for r in was:
                t = re.sub("[\x20\x09-\x0d]+", " ", r.text or "")
                least[t] = min(least.get(t, r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in rows) == sorted(least.values())
        elif name == "simhash_near_dedup":
            fps = {r.doc_id: brute_fingerprint(r.text or "") for r in was}
            comp, least = brute_components(set(fps.values())), {}
            for i, f in fps.items():
                least[comp[f]] = min(least.get(comp[f], i), i)
            assert sorted(r.doc_id for r in rows) == sorted(least.values())
        elif name == "secret_scan":
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in was)
            assert not any(re.search(r"password: hunter2222", r.text or "") for r in rows)
            hidden = {r.doc_id: r for r in rows}
            if 90_004 in hidden:
                assert hidden[90_004].text == "[SECRET] and more" and hidden[90_004].n_chars == 17
    packed = collections.Counter(r.doc_id for r in seen["best_fit_packing"])
    assert set(packed) == {r.doc_id for r in seen["secret_scan"]}


def test_run(spark):
    import os

    from helixloom.llm.common import checkpoint_folder

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    folder = checkpoint_folder(spark).removeprefix("file:")
    left = [x for f in os.listdir(folder) if f.startswith("pipeline-") for x in os.listdir(f"{folder}/{f}")]
    assert left == ["3-secret_scan"]  # what the result is read from


ROWS = [
    (1, None, None, "a", None, "x"), (1, None, None, "a", None, "x"), (2, "", "en", None, 0, "x"), (3, " \n", "en", "s", 2, "x"), (None, "no id at all here", "en", "s", 17, "x"), (4, "same words here", "en", "s", 15, "x"),
    (4, "same words here", "en", "s", 15, "x"), (5, "Same words  here", None, None, None, None), (6, "same\twords here", "en", "s", 1, "y"), (7, "token=abcdefgh " + "long " * 40_000, "en", "s", 5, "z"),
]
KINDS = "doc_id long, text string, lang string, source string, n_chars long, _key string, _d long, kept boolean, score double, length int"


def test_stages_with_odd_rows(spark):
    """Nulls, empties, repeats, a very long text, and columns named as the operators' own, through every stage against plain Python."""
    from tests.llm.test_corpus import squeeze

    labels = f"{SF}"
    odd = spark.createDataFrame([(*r, 1, True, 0.5, 3) for r in ROWS], KINDS).repartition(3)
    kept = corpus_pipeline.drop_toxic(spark, odd, labels)
    assert kept.columns == odd.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, odd.collect()))  # none is toxic
    one = corpus_pipeline.drop_copies(spark, kept, labels)
    assert one.columns == odd.columns and sorted(squeeze(r.text) for r in one.collect()) == sorted({squeeze(r[1]) for r in ROWS})
    near = corpus_pipeline.drop_near_copies(spark, odd, labels)
    fps = {r[1] or "": brute_fingerprint(r[1] or "") for r in ROWS}
    comp = brute_components(set(fps.values()))
    assert near.columns == odd.columns and sorted(comp[fps[r.text or ""]] for r in near.collect()) == sorted(set(comp.values()))
    clean = corpus_pipeline.redact_secrets(spark, odd, labels)
    got, want = collections.Counter((r.doc_id, r.text, r.n_chars, r._key) for r in clean.collect()), collections.Counter((i, t, n, k) for i, t, _, _, n, k in ROWS if i != 7)
    long = "[SECRET] " + "long " * 40_000
    assert clean.columns == odd.columns and got == want + collections.Counter([(7, long, len(long), "z")])
    packed = corpus_pipeline.pack(spark, odd, labels).collect()
    assert collections.Counter(r.doc_id for r in packed if not r.piece) == collections.Counter(r[0] for r in ROWS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), labels).count() == 0, name

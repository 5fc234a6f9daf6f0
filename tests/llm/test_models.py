"""Toxicity and main-text extraction: held-out accuracy and the awkward cases; the pipeline against plain stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import htmltext, linededup, mixing, packing, toxicity

from .conftest import make_docs, words
from .test_operators import check_packing, plain_components, plain_dedup

INSULTS = "blorgus snivelwit crudnik".split()


def labelled(n: int, seed: int = 1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w, y = words(seed * 10_000 + i, r.randint(20, 120)), int(i % 6 == 0)
        for _ in range(r.randint(2, 4) * y):
            w.insert(r.randrange(len(w)), r.choice(INSULTS))
        out.append((" ".join(w), y))
    return out


def test_toxicity(spark, docs, empty):
    rows = labelled(600)
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)] + [(10**6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(table, labels)
    fresh = labelled(300, 2)
    found = [model.score(t) >= 0.5 for t, _ in fresh]
    assert np.mean([f == bool(y) for f, (_, y) in zip(found, fresh, strict=True)]) > 0.97
    scored = toxicity.score(docs, model)
    assert scored.columns == [*docs.columns, "toxic_score"] and scored.where("toxic_score IS NULL OR toxic_score > 0.5").count() == 0
    assert toxicity.score(empty, model).count() == 0
    assert model.score(None) == model.score("") == model.score(" \n")


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    assert model.score("anything") == 0.0
    clean = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, clean).score("anything") == 0.0


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = htmltext.BiLstm(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.normal(size=(5, 3, htmltext.INPUT)), np.ones((5, 3), bool)
    mask[3:, 1] = False
    y = rng.integers(0, 2, (5, 3)).astype(float)

    def loss():
        z = net.logits(x, mask)
        return float((np.where(mask, np.logaddexp(0, z) - y * z, 0)).sum() / mask.sum())

    g = net.gradients(x, mask, y)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        i = int(rng.integers(len(flat)))
        old, eps = flat[i], 1e-3
        flat[i] = old + eps
        up = loss()
        flat[i] = old - eps
        down = loss()
        flat[i] = old
        assert g[k].reshape(-1)[i] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


@pytest.fixture(scope="module")
def model():
    return htmltext.train([])


def test_labeller_on_fresh_templates(model):
    rng = np.random.default_rng(12345)
    pages = [htmltext._marked(htmltext.synthetic_page(rng)) for _ in range(150)]
    found = model.label([b for b, _ in pages])
    right = sum(int((f == (y > 0)).sum()) for f, (_, y) in zip(found, pages, strict=True))
    assert right / sum(len(y) for _, y in pages) > 0.98


def test_blocks():
    page = "<!DOCTYPE html><title>t</title><body><p>a&amp;b <b>c<br>d\n\te</b><p>f<script>var x='</p>';</script><!-- no --><ul><li>g<li>h</ul>&copy; i <a href='x>y'>j</a><div class=\"AdBox one\">k"
    assert [b.text for b in htmltext.blocks(page)] == ["a&b c d e", "f", "g", "h", "© i j", "k"]
    assert htmltext.blocks(page)[-1].path[-1] == ("div", ("ad", "box", "one"))
    for odd in (None, "", "<", "<p", "a < b > c", "<a href='", "<!--", "<script>", "</p></div>", "<p class=\"x>y"):
        htmltext.blocks(odd)


def test_extract(spark, model):
    rows = [(1, "u", "<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title of it</h1><p>First  words, and more of them.</p><p>Second &eacute;.</p></article><footer>&copy; me</footer>"), (2, None, None), (3, "u", ""), (None, "u", "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages, model).collect()}
    assert got == {1: "Title of it\nFirst words, and more of them.\nSecond é.", 2: "", 3: "", None: ""}
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    rows = labelled(240)
    texts = [t for t, _ in rows]
    texts[7] = texts[1] + "\nthe very same line in two documents"
    texts[9] = texts[3] + "\nthe very same line in two documents\nend"
    texts += [None, "", texts[5], texts[5], texts[11] + " tail"]
    docs = make_docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    steps = dict(corpus_pipeline.STAGES)
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = steps["toxicity"](spark, docs, sf)
    assert got.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    plain = [(i, t) for i, t in plain if model.score(t) < 0.5]
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, _ in plain)
    got = steps["line_dedup"](spark, got, sf)
    assert got.columns == docs.columns
    plain = [(i, t) for i, _, _, t in plain_dedup(plain)]
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == plain
    got = steps["near_dedup"](spark, got, sf)
    groups = plain_components(plain)
    plain = [(i, t) for i, t in plain if groups[i][1] == i]
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == plain
    got = steps["mixing"](spark, got, sf)
    assert got.columns == docs.columns
    mixed = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert set(mixed) <= {(i, t or None) for i, t in plain} | set(plain)
    final = corpus_pipeline.run(spark, sf).collect()
    copies = {i: sum(1 for j, _ in mixed if j == i) for i, _ in mixed}
    assert {i: sum(1 for r in final if r["doc_id"] == i and r["piece"] == 0) for i in copies} == copies
    assert sum(r["length"] for r in final) == sum(len(packing.encoder()(t or "")) + 1 for _, t in mixed)
    single = {i: t for i, t in mixed if copies[i] == 1}
    check_packing([r for r in final], single, packing.LENGTH)
    assert linededup.N_BATCHES and mixing.SEED

"""Language, toxicity, search, url rules and the pipeline."""

import itertools
import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from larder.llm import language_id, ngram_join, topk_search, toxicity, url_filters
from larder.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.compare import compare, connect
from tests.conftest import SMALL
from tests.llm.conftest import ROWS, frame

MIDDLE = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    random = np.random.default_rng(0)
    evidence, transition, counts = random.normal(size=(7, 3)), random.normal(size=(3, 3)), np.array([4, 0, 3])

    def brute(e):
        out = np.zeros((len(e), 3))
        for path in itertools.product(range(3), repeat=len(e)):
            weight = np.exp(sum(e[i, k] for i, k in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
            for i, k in enumerate(path):
                out[i, k] += weight
        return out / out.sum(axis=1, keepdims=True)

    found = language_id.forward_backward(evidence, transition, counts)
    assert np.allclose(found, np.concatenate([brute(evidence[:4]), brute(evidence[4:])]))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    found = language_id.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.97 and all(0 <= r["score"] <= 1 for r in found)


def test_language_of_switching_words(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = language_id.fit(language_id.training_rows(docs))
    table = language_id.WordTable(model.evidence, len(model.languages))
    codes, counts = table.codes(["the of and for with la les une est dans"])
    labels = [model.languages[k] for k in language_id.forward_backward(table.rows[codes], model.transition, counts).argmax(axis=1)]
    assert labels[:3] == ["en"] * 3 and labels[-3:] == ["fr"] * 3


def test_language_fit_holds_one_copy_of_its_ngrams(monkeypatch):
    monkeypatch.setattr(language_id, "EPOCHS", 0)
    letters = np.random.default_rng(3).integers(97, 123, (60_000, 9)).astype(np.uint8)
    words = [bytes(x).decode() for x in letters]
    rows = [(" ".join(words[i : i + 500]), "ab"[i // 500 % 2]) for i in range(0, len(words), 500)]
    tracemalloc.start()
    try:
        language_id.fit(rows)
        assert tracemalloc.get_traced_memory()[1] < 60_000_000
    finally:
        tracemalloc.stop()


def test_language_odd_rows(odd, empty):
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predictions(odd).collect()]
    assert len(found) == len(ROWS) and all(p == "und" and s == 0 for i, p, s in found if i in (1, 2, 9, 10)) and all(p != "und" for i, p, s in found if i in (3, 5, 8))
    assert language_id.predictions(empty).count() == 0
    none = odd.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {(r["lang_pred"], r["score"]) for r in language_id.predictions(none).collect()} == {("und", 0.0)}


def test_windows_cover_every_word():
    for n in range(0, 200):
        doc, start, length = toxicity.windows(np.array([n, 5]))
        covered = {w for d, s, k in zip(doc, start, length) if d == 0 for w in range(s, s + k)}
        assert covered == set(range(n)) and (length <= toxicity.WINDOW).all() and (length[doc == 1] == 5).all()


def test_toxicity_gradients():
    random = np.random.default_rng(1)
    net = toxicity.Network(0.1)
    table = np.concatenate([np.zeros((1, 48)), random.normal(size=(9, 48))]).astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items() if k not in ("word", "char")}
    at, lengths = random.integers(1, 10, (toxicity.WINDOW, 3)), np.array([24, 5, 1])
    keep = {"f": [], "b": []}
    wrong = np.array([0.5, -1.0, 2.0])
    net.forward(table, at, lengths, keep)
    grads, d_rows = toxicity.gradients(net, table, at, lengths, wrong, keep)
    for name in ("gates_f", "state_b", "look", "query", "out"):
        place = tuple(random.integers(0, s) for s in net.p[name].shape)
        change = []
        for step in (1e-3, -1e-3):
            net.p[name][place] += step
            change.append(float(net.forward(table, at, lengths) @ wrong))
            net.p[name][place] -= step
        assert (change[0] - change[1]) / 2e-3 == pytest.approx(grads[name][place], rel=0.02, abs=1e-3)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.predictions(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r["score"] for r in found if r["toxic"]]
    clean = [r["score"] for r in found if not r["toxic"]]
    better = np.mean([(np.array(clean) < s).mean() for s in toxic])
    assert better >= 0.95 and np.mean(np.array(clean) < toxicity.THRESHOLD) >= 0.97 and np.mean(np.array(toxic) >= toxicity.THRESHOLD) >= 0.85


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 1), (8, 1, 0), (5, None, None), (None, 1, 1), (3, 0, 0)], "doc_id LONG, quality INT, toxic INT")
    found = toxicity.predictions(odd, labels).collect()
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert all(r["score"] == 0 for r in found if r["doc_id"] in (1, 2, 9))
    assert {r["predicted"] for r in toxicity.predictions(odd, labels.limit(0)).collect()} == {0}
    assert toxicity.predictions(empty, labels).count() == 0


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_twin(spark, name):
    assert compare(LLM_QUERIES[name](spark, SMALL), connect(SMALL), LLM_ORACLES[name]) is None


def test_search_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD", 40)
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    assert compare(LLM_QUERIES["op4_topk_search"](spark, SMALL), connect(SMALL), topk_search.ORACLE) is None


def test_search_skips_blocks():
    ids = np.arange(400)
    terms = [np.array([1, 100 + i]) if i else np.array([1, 5, 100]) for i in range(400)]
    index = topk_search.Index(ids, np.full(400, 10.0), terms, [np.ones(len(t), np.uint32) for t in terms], 10.0)
    found, scores = index.search(np.array([1, 5]), np.array([0.1, 5.0]), 1)
    assert found.tolist() == [0] and scores[0] == pytest.approx(5.1)


@pytest.mark.parametrize("columns, repeats", [(0, 1), (7, 1), (7, 3), (1_024, 1)])
def test_search_all_queries_at_once(monkeypatch, columns, repeats):
    """Whole documents as queries of one index: lists, columns and both, against plain sums."""
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    monkeypatch.setattr(topk_search, "COLUMNS", columns)
    monkeypatch.setattr(topk_search, "TOGETHER", 5)
    random = np.random.default_rng(3)
    ids = np.repeat(np.arange(50), repeats)
    bags = [np.unique(random.geometric(0.08, random.integers(1, 30)), return_counts=True) for _ in ids]
    lengths = np.array([c.sum() for _, c in bags], float)
    weight = dict(enumerate(random.random(400) + 0.1))
    index = topk_search.Index(ids, lengths, [t for t, _ in bags], [c for _, c in bags], lengths.mean())
    queries = [np.unique(random.geometric(0.08, n)) for n in (3, 25, 60, 1, 9, 14, 30)] + [np.array([399])]
    row, found, scores = index.search_all(np.concatenate(queries), np.array([weight[t] for q in queries for t in q]), np.append(0, np.cumsum(list(map(len, queries)))), 10)
    for i, query in enumerate(queries):
        best = {}
        for d, (terms, counts) in enumerate(bags):
            norm = 1.2 * (0.25 + 0.75 * lengths[d] / lengths.mean())
            score = sum(weight[t] * c * 2.2 / (c + norm) for t, c in zip(terms.tolist(), counts.tolist()) if t in query)
            best[ids[d]] = max(best.get(ids[d], 0), score)
        want = sorted((-round(s, 6), d) for d, s in best.items() if s > 0)[:10]
        assert found[row == i].tolist() == [d for _, d in want] and np.allclose(scores[row == i], [-s for s, _ in want], atol=2e-6)


def test_search_leaves_blocks_of_other_topics_unread():
    ids = np.arange(1024)
    random = np.random.default_rng(5)
    # Two topics in turn, which no order by length or id parts; all words are frequent.
    terms = [np.unique(random.integers(0, 40, 20)) + 1000 * (i % 2) for i in ids]
    index = topk_search.Index(ids, np.full(1024, 20.0), terms, [np.ones(len(t), np.uint32) for t in terms], 20.0)
    topic = index.ids.reshape(-1, topk_search.BLOCK) % 2
    assert {tuple(np.unique(t)) for t in topic} == {(0,), (1,)}
    index.table[topic[:, 0] == 1] = np.nan
    found, scores = index.search(terms[10], np.ones(len(terms[10])), 10)
    assert 10 in found and not (found % 2).any() and np.isfinite(scores).all()


def test_search_odd_rows(odd, empty):
    found = topk_search.search(odd, odd).collect()
    assert {r["query_id"] for r in found} == {3, 4, 5, 6, 7, 8, 10}
    assert [(r["doc_id"], r["rank"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 4][:2] == [(3, 1), (4, 2)]
    assert topk_search.search(empty, odd).count() == 0 and topk_search.search(odd, empty).count() == 0


def brute_search(rows, queries, k):
    """The scores of the SQL twin with each row as a document of its own, of which the best of an id counts."""
    bags = [(i, Counter(t.split())) for i, t in rows]
    df, mean = Counter(w for _, b in bags for w in b), sum(b.total() for _, b in bags) / len(bags)
    out = set()
    for query, text in queries:
        best = {}
        for i, b in bags:
            terms = [(b[w], np.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))) for w in set(text.split()) if w in b]
            if terms:
                score = round(sum(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * b.total() / mean)) for tf, weight in terms), 6)
                best[i] = max(best.get(i, 0.0), score)
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(query, rank, i, score) for rank, (i, score) in enumerate(top, 1)}
    return out


@pytest.mark.parametrize("shard, block", [(8_192, 64), (8_192, 4), (40, 4)])
def test_search_of_repeated_rows(spark, monkeypatch, shard, block):
    """Ids on more than k rows, equal and different, must not push other documents out of the top."""
    monkeypatch.setattr(topk_search, "SHARD", shard)
    monkeypatch.setattr(topk_search, "BLOCK", block)
    choose = random.Random(6)
    text = lambda: " ".join(choose.choices([f"w{i}" for i in range(40)], k=choose.randint(3, 12)))
    rows = [(i, text()) for i in range(60)]
    rows += [(i, t) for i, t in rows[:6] for _ in range(14)] + [(i, text()) for i in (6, 7) for _ in range(14)]
    queries = rows[:10]
    found = topk_search.search(frame(spark, [(*r, None) for r in rows]), frame(spark, [(*r, None) for r in queries])).collect()
    want = {r[:3]: r[3] for r in brute_search(rows, queries, 10)}
    assert {tuple(r)[:3] for r in found} == want.keys() and len(found) == 100
    assert all(r["score"] == pytest.approx(want[tuple(r)[:3]], abs=2e-6) for r in found)


PAGES = [
    (1, "http://a.example.net/en/1", None), (2, "http://A.Example.NET/fr/1?x", ""), (3, "https://b.example.com/de/9#t", None),
    (4, "https://c.example.edu/x", '<link rel="canonical" href="https://b.example.com/de/9">'), (5, "https://www.c.example.edu/x/", None),
    (6, "http://d.example.edu", "<META http-equiv='refresh' content='0; url=/moved'>"), (7, "http://d.example.edu/moved", '<link rel=canonical href="http://e.example.org/fr/1">'),
    (8, "http://e.example.org/fr/1", '<link rel=canonical href="//b.example.com/de/10">'), (9, None, None), (10, "no scheme", "<p>"), (11, "http://net", None),
    (12, "http://net/", None), (13, "http://planet/", None), (13, "http://planet/", None), (None, "http://b.example.com/de/10", None), (14, "http:///de/", None),
    (15, "http://m.example.edu/q", '<link rel="canonical" href="http://n.example.edu/"><LINK  href = "https://b.example.com/de/9"  REL = " canonical" >'),
    (16, "http://o.example.edu/", "<meta http-equiv=refresh content='0; url=/p'><meta content='1; URL = https://b.example.com/de/11' http-equiv = refresh>"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(*p, "rule") for p in PAGES], "page_id LONG, url STRING, html STRING, verdict STRING")
    found = url_filters.judge(pages, url_filters.rule_frame(spark))
    verdicts = {r["page_id"]: (r["rule"], r["verdict"]) for r in found.collect()}
    assert verdicts[1] == ("example.net/en/", "allow") and verdicts[2] == ("net/", "block") and verdicts[3] == ("example.com/de/", "block")
    assert verdicts[4] == (None, "block") and verdicts[5] == (None, "allow")  # an alias of a blocked page; no link says that 5 is one
    assert verdicts[15] == verdicts[16] == (None, "block")  # every tag of a page counts
    assert verdicts[6] == (None, "allow") and verdicts[7] == (None, "allow")  # an allowed alias goes before a blocked one
    assert verdicts[8] == ("org/fr/", "allow") and verdicts[None] == ("example.com/de/", "block")
    assert verdicts[9] == verdicts[10] == verdicts[13] == verdicts[14] == (None, "allow")
    assert verdicts[12] == ("net/", "block") and verdicts[11] == (None, "allow")  # no path, so no rule
    formed = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, url_filters.rule_frame(spark), forms=True).collect()}
    assert formed[5] == "block" and formed[11] == "block"  # aliases by their form, on request
    con = duckdb.connect()
    con.register("frame", pages.toPandas())
    con.execute("CREATE VIEW pages AS SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM frame")
    assert compare(found, con, url_filters.ORACLE) is None
    assert url_filters.judge(pages.limit(0), url_filters.rule_frame(spark)).count() == 0


def test_known_redirects(spark):
    pages = spark.createDataFrame([(1, "http://x.example.edu/", None)], "page_id LONG, url STRING, html STRING")
    links = spark.createDataFrame([("http://x.example.edu/", "http://z.net/"), (None, "http://z.net/")], "src STRING, dst STRING")
    assert url_filters.judge(pages, url_filters.rule_frame(spark), links).first()["verdict"] == "block"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL).cache()
        assert after.columns == docs.columns and 0 < after.count() <= docs.count(), name
        docs = after
    assert corpus_pipeline.run(spark, SMALL).agg({"length": "sum"}).first()[0] > 0


def test_pipeline_on_odd_rows(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == odd.columns
    assert corpus_pipeline.packed(spark, docs, SMALL).count() > 0


def test_stage_decisions(spark):
    words = [f"word{i}" for i in range(60)]
    rows = [(1, " ".join(words), "en"), (2, " ".join([*words[:58], "a", "b"]), "en"), (3, " ".join(words[:30]), "en"), (None, " ".join(words), "en")]
    kept = ngram_join.keep_one(frame(spark, rows))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3]

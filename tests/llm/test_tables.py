"""Operators on pages and vectors, the registered queries, the pipeline."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandforge.llm import pages, topk

DATA = "/root/testdata/sf0.001"


def boiler(n):
    return f"<nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><div class='ad'>Buy {n}</div>"


def only(i):
    return " ".join(f"w{i}n{k}" for k in range(20))


def page_rows():
    shared = "<div>Sign up for our weekly letter and never miss a story again today</div>"
    own = [f"<div>{only(i)}</div>" for i in range(6)]
    rows = [(i, f"http://open.example/{i}", f"<html><head><title>t</title></head><body>{shared}{own[i]}{boiler(i)}</body></html>") for i in range(6)]
    rows += [
        (10, "http://a.example/x", f"<body>{boiler(1)}<article><h1>A &amp; B</h1><p><b>One<br>two<p>three  \n four</article><footer>&copy; x</footer>"),
        (11, "http://a.example/y", f"<body>{boiler(2)}<article><h1>A &amp; B</h1><p>same same</p><script>var t='</p>';</script><aside>no</aside><p title='a > b'>end</article><div id=comments>first!</div>"),
        (12, None, None), (13, "", ""), (None, "::bad::[", "plain text &lt;b&gt; only"), (14, "http://mirror.example/1", rows[1][2]), (15, "http://z.example", "x" * 50_000), (16, "http://z.example/q", "<p>unclosed <a href='"),
    ]
    return rows + [rows[0]]


def test_pages(spark):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    out = {(r["page_id"], r["url"]): r for r in pages.main_text(df).collect()}
    text = lambda i: next(r["text"] for k, r in out.items() if k[0] == i)
    for i in range(6):
        assert text(i) == only(i)
    assert text(10) == "A & B\n\nOne two\n\nthree four"
    assert text(11) == "A & B\n\nsame same\n\nend"
    assert text(12) == text(13) == "" and text(None) == "plain text <b> only" and len(text(15)) == 50_000
    assert pages.main_text(df).count() == len(page_rows())
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    odd = df.select("*", *(F.lit("clash").alias(n) for n in ("key", "gram", "spans", "text", "at", "stop", "many")))
    assert sorted((r["page_id"] or 0, r["text"]) for r in pages.main_text(odd).collect()) == sorted((r["page_id"] or 0, r["text"]) for r in pages.main_text(df).collect())
    assert pages.main_text(df.limit(0)).count() == 0


def test_pages_keep_text_outside_the_main_container(spark):
    letter = "<div>Sign up for our weekly letter and never miss a story again today</div>"
    rows = [(i, f"http://m.example/{i}", f"<main><h1>Title {i}</h1><p>lead {only(i)}</p><article><p>body {i}</p>{letter}</article>{letter}<p>after{i} all{i}</p></main><footer>own {i}</footer>") for i in range(4)]
    rows += [(i, f"http://p.example/{i}", f"<body><p>{only(i)}</p><div class='panel-body'>panel {i}</div><p>end {only(i + 50)}</p><main>{letter}</main><div class='story'>Read on with ten more pieces from all of our other desks</div></body>") for i in range(10, 14)]
    out = {r["page_id"]: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert out[i]["text"] == f"Title {i}\n\nlead {only(i)}\n\nbody {i}\n\n{letter[5:-6]}\n\nafter{i} all{i}"
        assert (out[i]["repeated_blocks"], out[i]["marked_blocks"]) == (1, 1)
    for i in range(10, 14):
        assert out[i]["text"] == f"{only(i)}\n\npanel {i}\n\nend {only(i + 50)}"
        assert (out[i]["repeated_blocks"], out[i]["marked_blocks"]) == (2, 0)


def test_suffix_ranks():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 300)
    rank = pages.suffix_ranks(tokens, 8)
    heads = [tuple(tokens[i : i + 8]) for i in range(300)]
    order = sorted(set(heads))
    assert [order.index(h) for h in heads] == rank.tolist()


def plain_top(rows, k=5, every=50):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % every == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), j) for m, (j, v) in enumerate(ok) if m != n))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 3, 400])
def test_top_k(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(n)]
    if n > 100:
        rows += [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (950, [float("inf")] * 8), (None, rows[1][1]), (1000, rows[50][1]), (1001, rows[50][1]), (1050, [0.0] * 8), (1100, [1e4] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())
    assert got == plain_top(rows)
    odd = df.select("*", *(F.lit("clash").alias(c) for c in ("v", "uid", "lane", "score", "rank", "pack")))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(odd).collect()) == got


def test_pipeline(spark):
    import corpus_pipeline
    from strandforge.llm import language, quality
    from strandforge.llm.queries import table

    from .test_documents import plain_near

    docs = table(spark, DATA, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA).cache()
        if at == 4:
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()}
            continue
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        before, left = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"] for r in out.collect()}
        if at == 0:
            want = {r["doc_id"] for r in quality.classify(docs, table(spark, DATA, "labels")).where("predicted = 1").collect()}
        elif at == 1:
            want = {r["doc_id"] for r in language.identify(docs).where("lang_pred <> 'und' and score >= 0.5").collect()}
        elif at == 2:
            best: dict[str, tuple[int, int]] = {}
            for i, t in before.items():
                key = "".join((t or "").split())
                best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
            want = {i for _, i in best.values()}
        else:
            ids = sorted(before)
            _, links = plain_near([before[i] for i in ids])
            comp = {i: i for i in ids}
            for _ in ids:
                for a, b in links:
                    comp[ids[a]] = comp[ids[b]] = min(comp[ids[a]], comp[ids[b]])
            want = {i for i in ids if comp[i] == i}
        assert left == want, names[at]
        docs = out


def test_top_k_prunes(spark):
    """Vectors that lie together by id: blocks of other directions are passed over, here and across super-blocks."""
    n = 3 * topk.BLOCK * topk.BLOCKS
    way = (F.col("vec_id") * 8 / n).cast("int")
    df = spark.range(n).withColumnRenamed("id", "vec_id").withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when(j == way, 4.0).otherwise(0.0) + (F.pmod(F.xxhash64("vec_id", j), F.lit(100)) / 400.0)))
    df = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    report = topk.search_report(df, query_every=500).first()
    assert report["scored"] < report["blocks"] / 3
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    v = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, query_every=500).collect())
    want = []
    for q in range(0, n, 500):
        scores = v @ v[q]
        scores[q] = -1
        best = np.lexsort((np.arange(n), -scores))[:5]
        want += [(q, k + 1, int(i), int(scores[i])) for k, i in enumerate(best)]
    assert got == want


def test_products_of_large_numbers():
    rng = np.random.default_rng(2)
    a, b = (np.floor(rng.normal(size=(5, 7)) * 2.0**27) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    assert topk._products(a, b, False).tolist() == want
    huge = np.array([[2.0**60, -3.0]])
    assert topk._products(huge, huge, False).tolist() == [[topk.LARGEST]] and topk._products(huge, -huge, False).tolist() == [[topk.EMPTY + 1]]


def test_slices_give_memory_back(monkeypatch):
    """A task's freed memory goes back when its last batch is done, not before."""
    from strandforge.llm import common

    called = []
    monkeypatch.setattr(common, "trim", lambda: called.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "d" * 9])], names=["text"])
    found = common.slices(iter([batch, batch]), limit=4)
    assert [next(found).num_rows for _ in range(4)] == [2, 1, 2, 1] and not called
    assert list(found) == [] and called == [1]

"""The run search of the page extractor against a plain search, and what runs and markup each decide."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from strandforge.llm import pages

DATA = "/root/testdata/sf0.001"


def plain_covered(rows, share=pages.SHARE, least=pages.LEAST, run=pages.RUN):
    """{row: covered places of its token stream}, by comparing tokens as words."""
    streams, where, blocks_of, on_host = {}, defaultdict(set), defaultdict(set), defaultdict(set)
    for row, (page_id, url, html) in enumerate(rows):
        host, content = pages._host(url), (page_id, url, html)
        on_host[host].add(row)
        stream, place = [], 0
        for text, level in pages.blocks(html):
            size = 1 + len(text.split(" "))
            if level == pages.ARTICLE:
                blocks_of[host, text].add(row)
                stream += [("article", text, size)] + [None] * (size - 1)
            else:
                stream += [("mark",), *text.split(" ")]
            place += size
        streams[row] = (host, content, stream)
        for i in range(len(stream) - run + 1):
            piece = stream[i : i + run]
            if all(t is not None and t[0] != "article" or isinstance(t, str) for t in piece):
                where[host, tuple(piece)].add(content)
    out = {}
    for row, (host, _, stream) in streams.items():
        covered = np.zeros(len(stream), bool)
        for i in range(len(stream)):
            t = stream[i]
            if isinstance(t, tuple) and t[0] == "article":
                n = len(blocks_of[host, t[1]])
                covered[i : i + t[2]] = t[2] > run and n >= least and n > share * len(on_host[host])
            elif len(where.get((host, tuple(stream[i : i + run])), ())) > 1 and i + run <= len(stream):
                covered[i : i + run] = True
        out[row] = covered
    return out


def made_pages():
    rng = np.random.default_rng(8)
    common = [" ".join(f"c{k}w{i}" for i in range(rng.integers(5, 30))) for k in range(6)]
    rows = []
    for i in range(90):
        parts = [f"<div>{common[k]}</div>" if rng.random() < 0.4 else f"<p>{' '.join(f'u{i}x{n}' for n in range(rng.integers(1, 20)))}</p>" for k in range(6)]
        inner = "<p>Join our letter and get ten new stories each week</p>" if i % 3 else "<p>as quoted by many other pages of this very host here</p>"
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<body>{''.join(parts[:3])}<article><p>{i} own text of it</p>{inner if i % 3 == 1 or i % 9 == 0 else ''}</article>{''.join(parts[3:])}</body>"))
    return rows + [rows[5], (None, None, None), (7, "http://h1.example/7", "")]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    return df.withColumns({"k1": F.xxhash64(F.lit(1), "page_id", "url", "html"), "k2": F.xxhash64(F.lit(2), "page_id", "url", "html")})


def check(spark, rows):
    df = frame(spark, rows)
    found = {(r["k1"], r["k2"]): r for r in pages.repeated_runs(df).collect()}
    keys = {(r["page_id"], r["url"], r["html"]): (r["k1"], r["k2"]) for r in df.collect()}
    for row, want in plain_covered(rows).items():
        r = found.get(keys[rows[row]])
        got = np.zeros(len(want), bool)
        for s in (r["spans"] or []) if r else []:
            got[s["at"] : s["stop"]] = True
        gone = {g % (1 << 64) for g in (r["gone"] or [])} if r else set()
        place, host = 0, pages._host_ids(pages._host(rows[row][1]))
        for text, level in pages.blocks(rows[row][2]):
            size = 1 + len(text.split(" "))
            if level == pages.ARTICLE:
                got[place : place + size] = size > pages.RUN and pages._block_id(text, host) in gone
            place += size
        assert got.tolist() == want.tolist()
    return found


def test_runs_against_a_plain_search(spark, monkeypatch):
    assert check(spark, made_pages())
    monkeypatch.setattr(pages, "STRETCH", 64)
    assert check(spark, made_pages())


def test_runs_of_the_given_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    assert check(spark, rows)


def test_runs_decide_in_articles_and_without_markup(spark):
    df = spark.createDataFrame(made_pages(), "page_id long, url string, html string")
    on = {r["page_id"]: r for r in pages.main_text(df).collect() if r["page_id"] is not None}
    assert "Join our letter" not in on[1]["text"] and "as quoted" in on[0]["text"]
    assert all("c0w0" not in r["text"] for r in on.values()) and sum(r["unmarked_blocks"] for r in on.values()) > 100
    # without hosts in common no run repeats, and most texts differ
    alone = df.withColumn("url", F.concat(F.lit("http://own"), F.col("page_id").cast("string"), F.lit(".example")))
    assert sum(on[r["page_id"]]["text"] != r["text"] for r in pages.main_text(alone).collect() if r["page_id"] is not None) > 60


def test_text_does_not_depend_on_how_pages_are_dealt(spark, monkeypatch):
    """A block in articles that is frequent on the whole host, but not in each part of its pages; repeated rows."""
    block = "<p>subscribe to our weekly letter and never miss one of our many stories</p>"
    has = [i < 14 or i >= 32 for i in range(40)]  # 14 of the first 20, 8 of the last
    rows = [(i, f"http://h.example/{i}", f"<article><p>{' '.join(f'p{i}w{k}' for k in range(30))}</p>{block if has[i] else ''}</article>") for i in range(40)]
    rows += [(100 + i, f"http://g.example/{i % 30}", f"<article><p>g{i % 30} text</p>{block if i % 30 < 14 else ''}</article>") for i in range(30)] + [(100, "http://g.example/0", f"<article><p>g0 text</p>{block}</article>")] * 4
    texts = set()
    for stretch in (1, 100, 1 << 20):
        monkeypatch.setattr(pages, "STRETCH", stretch)
        for parts in (1, 2, 7):
            df = spark.createDataFrame(rows, "page_id long, url string, html string").repartitionByRange(parts, "page_id")
            texts.add(tuple(sorted((r["page_id"], r["text"]) for r in pages.main_text(df).collect())))
            check(spark, rows)
    assert len(texts) == 1
    found = dict(texts.pop())
    assert not any("weekly letter" in found[i] for i in range(40))  # 22 of 40
    assert not any("weekly letter" in found[100 + i] for i in range(14))  # 18 of 34, with the repeated rows


def test_tags_of_hostile_pages():
    import time

    n = 100_000
    for html in ("<script " * n, '<a "' * n, "<a" * n, '<a ">" ' * n, "<a '>" * n, "<div>" * n + "</p>" * n, "<!--" * n, '<p class="' * n, "<a x=\"y' >" * n, "<style></style " * n):
        began = time.time()
        assert isinstance(pages.blocks(html), list)
        assert time.time() - began < 4
    assert pages.blocks("<script " * 1000) == [(" ".join(["<script"] * 1000), pages.OPEN)]
    assert pages.blocks("<a title='x > y'>one</a> <b a=\">two</b> <i>three <?x <!-- four") == [("one two three <?x", pages.OPEN)]
    assert pages.blocks("<p>a<p>b</div></p>c<!-- d --><STYLE>e</STYLE >f</nav>g") == [("a", 0), ("b", 0), ("cf", 0), ("g", 0)]


def test_longest_runs():
    lo, hi = pages.longest_runs(np.array([3, 4, 5, 20]))
    assert lo.tolist() == [3, 20] and hi.tolist() == [13, 28]

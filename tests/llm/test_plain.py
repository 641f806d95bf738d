"""Operators without SQL against plain versions: language mixtures, the support vector fit, license spans, the number of sequences; odd rows in the pipeline."""

import bisect
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from strandforge.llm import language, licenses, packing, quality
from strandforge.llm.queries import table

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_words(text):
    """Hashed 3-grams of each word: those that begin at the blank before it or at one of its bytes."""
    raw = b" " + bytes(b if b > 127 or chr(b).isalpha() else 32 for b in (text or "").lower().encode()) + b" \0  "
    blank = [b in (0, 32) for b in raw]
    out = []
    for i in range(1, len(raw) - 3):
        if blank[i]:
            continue
        if blank[i - 1]:
            out.append([])
        out[-1] += [raw[n : n + 3] for n in ([i - 1, i] if blank[i - 1] else [i])]
    number = lambda g: ((g[0] | g[1] << 8 | g[2] << 16) * 2654435761 % 2**32) >> (32 - language.BITS)
    return [[number(g) for g in w] for w in out]


def plain_mixture(likes, allowed, rounds=8):
    shares = [1 / len(allowed)] * len(allowed)
    for _ in range(rounds):
        held = [0.0] * len(allowed)
        for like in likes:
            joint = [s * math.exp(like[j] - max(like[j] for j in allowed)) for s, j in zip(shares, allowed, strict=True)]
            held = [h + x / sum(joint) for h, x in zip(held, joint, strict=True)]
        shares = [h / len(likes) for h in held]
    top = [max(like[j] for j in allowed) for like in likes]
    level = sum(t + math.log(sum(s * math.exp(like[j] - t) for s, j in zip(shares, allowed, strict=True))) for like, t in zip(likes, top, strict=True))
    return shares, level


def plain_language(text, names, table, penalty=3.0):
    words = plain_words(text)
    if text is None or not any(map(str.isalpha, text)) or not words:
        return "und", 0.0
    likes = [[sum(table[j][g] for g in w) for j in range(len(names))] for w in words]
    alone = [sum(like[j] for like in likes) for j in range(len(names))]
    shares, _ = plain_mixture(likes, list(range(len(names))))
    ranks = sorted(range(len(names)), key=lambda j: -shares[j])
    chosen = [max(range(len(names)), key=lambda j: alone[j])]
    final, level = [1.0], max(alone)
    while len(chosen) < len(names):
        wider = sorted([*chosen, next(j for j in ranks if j not in chosen)])
        found, gained = plain_mixture(likes, wider)
        if gained - level <= penalty * math.log(len(words) + 1):
            break
        chosen, final, level = wider, found, gained
    best = max(range(len(chosen)), key=lambda n: final[n])
    return names[chosen[best]], final[best]


def test_language_against_a_plain_mixture(spark):
    say = {"en": "the cat sat on the mat and then it went to sleep", "de": "die Katze saß auf der Matte und dann ging sie schlafen", "fr": "le chat était assis sur le tapis puis il est allé dormir"}
    rng = np.random.default_rng(4)
    made = [(i, " ".join(rng.choice(say[lang].split(), 30)), lang) for i in range(90) for lang in [("en", "de", "fr")[i % 3]]]
    model = language.train(spark.createDataFrame([*made, made[0], made[1]], "doc_id long, text string, lang string"), max_docs=10_000)
    held = lambda i: __import__("zlib").crc32(str(i).encode()) % 4 == 2
    counts = {n: Counter(g for i, t, lang in made if lang == n and not held(i) for w in plain_words(t) for g in w) for n in ("de", "en", "fr")}
    assert model.names == ["de", "en", "fr"]
    table = []
    for n in model.names:
        total = sum(counts[n].values()) + 0.5 * 2**language.BITS
        table.append(defaultdict(lambda t=total: math.log(0.5 / t), {g: math.log((c + 0.5) / total) for g, c in counts[n].items()}))
    assert all(math.isclose(model.table[g, j], table[j][g], abs_tol=1e-9) for j, n in enumerate(model.names) for g in counts[n])
    texts = [t for _, t, _ in made[:9]] + [f"{say['en']} {say['de']}", f"{say['fr']} {say['en']} {say['en']}", " ".join(say.values()), None, "", "12 !!", "x", "ÄÖ zz", "the"]
    names, scores, _ = language.decide(model, texts)
    want = [plain_language(t, model.names, table) for t in texts]
    assert names == [n for n, _ in want] and np.allclose(scores, [s for _, s in want], atol=1e-9)
    one_by_one = [language.decide(model, [t]) for t in texts]
    assert [n[0] for n, _, _ in one_by_one] == names and np.allclose([s[0] for _, s, _ in one_by_one], scores)


def test_language_trains_on_few_of_many(spark):
    """The rows chosen below the hash bound are those of lowest hash."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    model = language.train(df, max_docs=100)
    kept = [r for lang in ("a", "b") for r in df.where((F.col("lang") == lang) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)).orderBy(F.xxhash64("doc_id")).limit(50).collect()]
    whole = language.train(spark.createDataFrame(kept, df.schema), max_docs=10_000)
    assert np.array_equal(model.table, whole.table)


def test_support_vectors_against_a_dense_fit():
    """Dual coordinate descent over a dense matrix, in another order, to the same optimum."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.choice(60, 25, p=np.r_[np.full(30, 1.4), np.full(30, 0.6)] / 60 if i % 3 else None)).astype(np.uint32) for i in range(60)]
    labels = np.array([int(i % 3 > 0) for i in range(60)])
    model = quality.fit(rows, labels, epochs=3000)
    y = np.where(labels > 0, 1.0, -1.0)
    x = np.zeros((60, quality.SIZE))
    for i, r in enumerate(rows):
        x[i, r] = 1
    up, down = 1 + x[y > 0].sum(0), 1 + x[y < 0].sum(0)
    ratio = np.log(up / up.sum()) - np.log(down / down.sum())
    x = np.c_[(x * ratio)[:, :64], np.ones(60)]
    caps = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum())) / 100
    w, alpha = np.zeros(65), np.zeros(60)
    for _ in range(3000):
        for i in range(60):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / (x[i] @ x[i]), 0), caps[i])
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    assert np.allclose(model.weights[:60], (w[:64] * ratio[:64])[:60], atol=1e-3) and math.isclose(model.offset, w[64], abs_tol=1e-3)
    loss = lambda v: 0.5 * v @ v + (caps * np.maximum(0, 1 - y * (x @ v))).sum()
    assert all(loss(w) <= loss(w + rng.normal(size=65) * 0.01) for _ in range(50))


def plain_features(text):
    raw, words = (text or "").encode(), (text or "").split()
    grams = {(((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761) % 2**32) >> 14 for i in range(len(raw) - 2)}
    again = [int(x == y) for x, y in zip(words, words[1:], strict=False)]
    return grams | {2**18 + sum(again[i + n] << n for n in range(3)) for i in range(len(again) - 2)}


def plain_scores(docs, labels):
    """{doc_id: score} of rows (doc_id, text), {doc_id: label}: the whole classifier with loops over sets."""
    found = {i: plain_features(t) for i, t in docs}
    ids = sorted(i for i in found if i in labels and zlib.crc32(str(i).encode()) % 5 != 0)
    y = {i: 1 if labels[i] > 0 else -1 for i in ids}
    counts = {s: Counter(f for i in ids if y[i] == s for f in found[i]) for s in (1, -1)}
    n_all = {s: sum(c.values()) + 2**18 + 8 for s, c in counts.items()}
    every = sorted({f for i in ids for f in found[i]})
    ratio = {f: math.log((1 + counts[1][f]) / n_all[1]) - math.log((1 + counts[-1][f]) / n_all[-1]) for f in every}
    w, offset, alpha = dict.fromkeys(every, 0.0), 0.0, dict.fromkeys(ids, 0.0)
    sides = Counter(y.values())
    rng = np.random.default_rng(7)
    for _ in range(12):
        moved = 0.0
        for i in (ids[n] for n in rng.permutation(len(ids))):
            gradient = y[i] * (sum(w[f] * ratio[f] for f in found[i]) + offset) - 1
            new = min(max(alpha[i] - gradient / (1 + sum(ratio[f] ** 2 for f in found[i])), 0), len(ids) / (2 * sides[y[i]]) / 100)
            step = (new - alpha[i]) * y[i]
            for f in found[i]:
                w[f] += step * ratio[f]
            offset, alpha[i], moved = offset + step, new, max(moved, abs(step))
        if moved < 1e-6:
            break
    margin = {i: sum(w.get(f, 0.0) * ratio.get(f, 0.0) for f in fs) + offset for i, fs in found.items()}
    m, sign = np.array([margin[i] for i in ids]), np.array([y[i] for i in ids])
    target = np.where(sign > 0, (sides[1] + 1) / (sides[1] + 2), 1 / (sides[-1] + 2))

    def halved(f, low, high):
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (low, middle) if f(middle) > 0 else (middle, high)
        return (low + high) / 2

    p = lambda a, b: 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
    shift = lambda a: halved(lambda b: (p(a, b) - target).sum(), -60, 60)
    slope = halved(lambda a: ((p(a, shift(a)) - target) * m).sum() + 1e-3 * (a - 1), 1e-3, 100)
    return {i: float(1 / (1 + np.exp(-np.clip(slope * x + shift(slope), -30, 30)))) for i, x in margin.items()}


def test_quality_query_against_a_plain_one(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plain_scores(rows, {r["doc_id"]: r["quality"] for r in labels.collect()})
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)
        assert math.isclose(r["score"], want[r["doc_id"]], abs_tol=1e-4), (r, want[r["doc_id"]])


def test_training_rows_are_bounded(spark, monkeypatch):
    """Whole texts train, as many in the order of their ids' hashes as the bound allows."""
    texts = {i: f"{'good prose' if i % 2 else 'bad junk'} {i} " * (1 + 5 * (i % 4)) for i in range(60)}
    docs, labels = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    seen, sizes = np.zeros(quality.SIZE, np.int64), {}
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels: fitted.append([len(r) for r in rows]))
    order = [r[0] for r in labels.where(~quality.held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    sizes = {i: len(quality.features(t, seen)) for i, t in texts.items()}
    for bound in (1, 200, 10**9):
        monkeypatch.setattr(quality, "MAX_FEATURES", bound)
        quality.train(docs, labels)
        total, want = 0, []
        for i in order:
            total += sizes[i]
            if total > bound and want:
                break
            want.append(i)
        assert fitted[-1] == [sizes[i] for i in sorted(want)]


def plain_scan(text):
    """(labels, score) by comparing words at every place."""
    words = licenses.words_of(text or "")
    listed = [(licenses.words_of(p), x, True, 2) for p, x in licenses.BASE.items()] + [(licenses.words_of(p), x, False, 2) for p, x in licenses.OWN.items()] + [(licenses.words_of(t), x, False, 5) for x, t in licenses.TEXTS.items()]
    labels, score = set(), 0.0
    for template, label, base, k in listed:
        diagonals = defaultdict(list)
        for place in range(len(words) - k + 1):
            for at in range(len(template) - k + 1):
                if words[place : place + k] == template[at : at + k]:
                    diagonals[place - at].append((at, place))
        spans, last = [], None
        for d in sorted(diagonals):
            if last is None or d - last > (2 if k == 2 else 8):
                spans.append([])
            spans[-1].append(diagonals[d])
            last = d
        for span in spans:
            hits = [h for d in span for h in d]
            if k == 2:
                share = len({at for at, _ in hits}) / (len(template) - 1)
                stands = any(len(d) == len(template) - 1 for d in span) if base else share >= 0.8
            else:
                covered = {at + n for at, _ in hits for n in range(k)}
                stretch = max(p for _, p in hits) + k - min(p for _, p in hits)
                share = len(covered) / len(template) if stretch <= 1.5 * len(template) else 0.0
                stands = share >= 0.8
            if stands:
                labels.add(label)
                score = max(score, share)
    return ",".join(sorted(labels)), score


def test_license_spans_against_a_plain_search(spark):
    rng = np.random.default_rng(7)
    texts = []
    for label, text in licenses.TEXTS.items():
        words = text.split()
        for kind in range(6):
            out = list(words)
            for _ in range(len(words) // 25 if kind < 4 else len(words) // 3):
                at = int(rng.integers(0, len(out)))
                if kind % 3 == 0:
                    out.insert(at, "inserted")
                elif kind % 3 == 1:
                    del out[at]
                else:
                    out[at] = "changed"
            texts.append("Preface words. " + " ".join(out) + " And the end, cc by. " + (" ".join(words) if kind == 3 else ""))
        texts += [" ".join(words[: len(words) // 2]), text.upper(), f"{text} {licenses.TEXTS['mit']}"]
    texts += ["general public license " * 40, "the software the software is provided " * 30, "cc by x nc", None, "MIT  License", "apache license version two 0"]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        labels, score = plain_scan(text)
        assert got[i]["labels"] == labels and math.isclose(got[i]["score"], score, abs_tol=1e-12), (i, got[i], labels, score)
    per = len(texts) // len(licenses.TEXTS)
    for n, label in enumerate(licenses.TEXTS):
        for kind in range(4):
            assert label in got[n * per + kind]["labels"].split(","), (label, kind)


def plain_sequences(lengths, capacity):
    large, small = sorted((n for n in lengths if 3 * n > capacity), reverse=True), sorted((n for n in lengths if 3 * n <= capacity), reverse=True)
    gaps, used = [], [False] * len(large)
    for i, n in enumerate(large):
        if used[i]:
            continue
        used[i] = True
        j = next((j for j in range(i + 1, len(large)) if not used[j] and large[j] <= capacity - n), None)
        if j is not None:
            used[j] = True
        bisect.insort(gaps, capacity - n - (large[j] if j is not None else 0))
    for n in small:
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return len(gaps)


def test_number_of_sequences_is_that_of_a_plain_best_fit():
    rng = np.random.default_rng(8)
    for capacity, n in ((100, 400), (100, 3000), (4096, 2000), (7, 500)):
        for high in (capacity, capacity // 2, max(capacity // 4, 1)):
            lengths = rng.integers(1, high + 1, n).tolist()
            steps = packing.plan(dict(Counter(lengths)), capacity)
            got = max(first + number for _, _, number, first, _ in steps)
            assert got == plain_sequences(lengths, capacity), (capacity, high)


def test_pipeline_keeps_unique_texts_of_a_shared_id(spark):
    """(7, a copy of 3) goes, another row 7 stays: nothing equals it."""
    import corpus_pipeline

    base, other = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    near = f"{base} end"
    docs = spark.createDataFrame([(7, base), (3, base), (7, other), (9, near), (9, f"{other} {base}"), (None, base), (11, None), (12, " "), (11, "")], "doc_id long, text string")
    docs = docs.withColumns({"__digest": F.lit(1), "norm": F.lit(2), "t1": F.lit(3)})
    left = lambda stage: sorted(((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.STAGES[stage][1](spark, docs, "").select("doc_id", "text").collect()), key=str)
    assert left(2) == sorted([(3, base), (7, other), (9, near), (9, f"{other} {base}"), (0, base), (12, " ")], key=str)
    kept = left(3)
    assert (7, other) in kept and (3, base) in kept and (0, base) in kept and (9, f"{other} {base}") in kept
    assert (7, base) not in kept and (9, near) not in kept and len(kept) == 7


def test_pipeline_on_odd_rows(spark, odd, nothing):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    for docs in (odd.unionByName(odd), nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs
            docs = stage(spark, docs, data)
            assert docs.columns == before.columns and docs.count() <= before.count(), name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()

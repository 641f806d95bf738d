"""Operators on documents: odd rows against plain versions, and no rows at all."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandforge.llm import exact, language, licenses, minhash, packing, pieces, quality, wavelet

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
LOWER = {i: i + 32 for i in range(65, 91)}


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def tokens(text):
    from tokenizers import Tokenizer

    if not hasattr(tokens, "library"):
        tokens.library = Tokenizer.from_file(WORD_BPE)
    return np.array([*tokens.library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_packing(documents, odd, nothing):
    out = packing.pack(documents, WORD_BPE)
    got = rows(out, "doc_id", "piece", "start", "length", "ids_crc32")
    want = []
    for r in documents.collect():
        ids = tokens(r["text"])
        want += [(r["doc_id"], n, s, len(p := ids[s : s + 4096]), zlib.crc32(p.tobytes())) for n, s in enumerate(range(0, len(ids), 4096))]
    assert got == sorted(want, key=repr)
    by = defaultdict(list)
    for r in out.collect():
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert rows(packing.pack(odd, WORD_BPE), "doc_id", "piece", "start", "length", "ids_crc32") == got
    assert packing.pack(nothing, WORD_BPE).count() == 0


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    counts = Counter(np.minimum(rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1, 4096).tolist())
    steps = packing.plan(dict(counts), 4096)
    filled, placed = defaultdict(list), Counter()
    for length, first, number, sequence, offset in steps:
        assert placed[length] == first
        placed[length] += number
        for s in range(sequence, sequence + number):
            filled[s].append((offset, length))
    assert placed == counts
    for parts in filled.values():
        assert sum(1 for _, n in parts if 3 * n > 4096) <= 2
        ends = sorted(parts)
        assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False)) and ends[0][0] == 0 and sum(ends[-1]) <= 4096
    assert len(filled) <= 1.05 * sum(n * c for n, c in counts.items()) / 4096 + 1


def test_encoder_tables(monkeypatch):
    """What a worker holds is bounded, the library gets few words at a time, and a word in use is asked for once."""
    import pyarrow as pa

    from strandforge.llm import wordbpe

    asked, real = Counter(), wordbpe.WordBpe._learn

    def learn(self, words):
        if len(words) <= wordbpe.LEARNT:
            asked.update(words)
        return real(self, words)

    monkeypatch.setattr(wordbpe, "TABLE_ENTRIES", 100)
    monkeypatch.setattr(wordbpe, "LEARNT", 32)
    monkeypatch.setattr(wordbpe.WordBpe, "_learn", learn)
    one = wordbpe.WordBpe(WORD_BPE)
    letters = [a + b for a in "bcdfghßé" for b in "aeiou"]
    for n in range(40):
        text = " ".join(["Often", *(f"{letters[n]}{x},{letters[-n]}" for x in letters), "日本%", "x'll\u0085<|endoftext|>"])
        ids, ends = one.encode(pa.array([text, None, ""]))
        assert ids.tolist() == tokens(text)[:-1].tolist() and ends.tolist() == [len(ids)] * 3
        assert len(one.young) <= 200 and len(one.old) <= 200 and len(one.odd) <= 102
    assert asked["often"] == 1 and len(asked) > 1000
    assert wordbpe.with_ends(np.array([7, 8, 9], "<u4"), np.array([0, 2, 2, 3]), 1).tolist() == [1, 7, 8, 1, 1, 9, 1]


def test_encoder_looks_distinct_words_up():
    """Which words are new is asked for distinct words by sets, not place by place."""
    import pyarrow as pa

    from strandforge.llm import wordbpe

    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    one = wordbpe.WordBpe(WORD_BPE)
    one.young, one.old = Counted(), Counted()
    text = " ".join(f"often,{a}{b}" for a in "abcdefgh" for b in "stuvwxyz") + " 日本 x'll"
    for _ in range(2):
        ids, ends = one.encode(pa.array(["", text, None, text]))
        assert ids.tolist() == 2 * tokens(text)[:-1].tolist() and ends.tolist() == [0, len(ids) // 2, len(ids) // 2, len(ids)]
    assert Counted.asked <= len(one.young) < 100


def test_wavelet_no_positions(monkeypatch):
    """Planes are split by the bits themselves, not by 64-bit positions of them."""
    ids = np.random.default_rng(3).integers(0, 49_152, 5_001)
    monkeypatch.setattr(np, "flatnonzero", None)
    for some in (ids, ids[:1] * 0, ids[:64] * 0 + 3):
        assert wavelet.WaveletMatrix.build(some).decode().tolist() == some.tolist()


def test_wavelet(documents, odd, nothing, spark):
    def check(df):
        manifest = wavelet.write_shards(df, WORD_BPE, shard_ids=5000)
        got = rows(wavelet.read_shards(manifest), "doc_id", "start", "n_tokens", "ids_crc32")
        ordered = sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()))
        want, at = [], 0
        for r in ordered:
            ids = tokens(r["text"])
            want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert got == sorted(want, key=repr)

    check(documents)
    check(odd)
    assert wavelet.read_shards(wavelet.write_shards(nothing, WORD_BPE)).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n in (0, 1, 64, 1000):
        ids = rng.integers(0, 300, n).astype(np.uint32)
        raw = wavelet.dump(np.array([5]), np.array([n]), wavelet.WaveletMatrix.build(ids), frame=3)
        _, lengths, m = wavelet.load(raw)
        shard = wavelet.in_memory(raw)
        if n:
            assert shard.access(np.arange(n)).tolist() == ids.tolist()
        for value in (0, 7, 299, 5000):
            at = np.flatnonzero(ids == value)
            assert shard.count(value) == len(at) and shard.count(value, n // 3, n // 2) == int((ids[n // 3 : n // 2] == value).sum())
            assert [shard.occurrence(value, k) for k in range(len(at))] == at.tolist() and shard.occurrence(value, len(at)) == -1
        assert m.decode().tolist() == ids.tolist() and lengths.tolist() == [n]
        if n:
            assert m.access(np.arange(n)).tolist() == ids.tolist()
        for value in (0, 7, 299, 5000):
            at = np.flatnonzero(ids == value)
            assert m.count(value) == len(at) and m.count(value, n // 3, n // 2) == int((ids[n // 3 : n // 2] == value).sum())
            assert [m.occurrence(value, k) for k in range(len(at))] == at.tolist() and m.occurrence(value, len(at)) == -1


def test_wavelet_lookups_read_little():
    ids = np.random.default_rng(3).integers(0, 40_000, 1 << 20).astype(np.uint32)
    raw = wavelet.dump(np.array([5]), np.array([len(ids)]), wavelet.WaveletMatrix.build(ids))
    for ask in (lambda s: s.access(np.array([777_777])).tolist() == [int(ids[777_777])], lambda s: s.count(int(ids[5])) == int((ids == ids[5]).sum()), lambda s: s.occurrence(int(ids[9]), 0) == int(np.flatnonzero(ids == ids[9])[0])):
        shard = wavelet.in_memory(raw)
        assert ask(shard)
        # frames of 8 kB, two for each of the 16 planes at most (three for a search that goes down and up again)
        assert shard.fetched < 3 * 16 * 8400 + 60_000 < len(raw) / 3


def test_wavelet_lookups_in_all_shards(documents, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a file ends with a batch
    try:
        manifest = wavelet.write_shards(documents, WORD_BPE, shard_ids=5000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ordered = sorted(documents.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()))
    ids = np.concatenate([tokens(r["text"]) for r in ordered])
    assert manifest.count() > 1
    places = [0, 1, 4999, 5000, len(ids) - 1, len(ids), 12_345]
    got = wavelet.access_tokens(manifest, spark.createDataFrame([(p,) for p in places], "position long")).collect()
    assert {r["position"]: r["token"] for r in got} == {p: int(ids[p]) for p in places if p < len(ids)}
    asked = [1, int(ids[3]), int(ids[-2]), 49_000]
    assert {r["token"]: r["n"] for r in wavelet.count_tokens(manifest, asked).collect()} == {t: int((ids == t).sum()) for t in asked if (ids == t).any()}
    wanted = [(1, 0), (1, 7), (int(ids[3]), 0), (1, 10**6)]
    assert {(r["token"], r["n"]): r["position"] for r in wavelet.find_occurrences(manifest, wanted).collect()} == {(t, n): int(np.flatnonzero(ids == t)[n]) for t, n in wanted if n < (ids == t).sum()}


def test_exact(documents, odd, nothing):
    got = rows(exact.exact_duplicates(documents), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = defaultdict(list)
    for r in documents.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"]))
    want = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1] is None, m[1] or 0))[1]
        want += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, i in members]
    assert got == sorted(want, key=repr)
    assert rows(exact.exact_duplicates(odd, salts=3), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == got
    assert exact.exact_duplicates(nothing).count() == 0


def test_language(spark, documents, odd, nothing):
    english, german = "the cat sat on the mat and then it went to sleep".split(), "die Katze sass auf der Matte und dann ging sie schlafen".split()
    rng = np.random.default_rng(4)
    made = [(100 + i, " ".join(rng.choice(english if i % 2 else german, 40)), "en" if i % 2 else "de", None, None) for i in range(80)]
    train = spark.createDataFrame(made, documents.schema)
    out = {r["doc_id"]: r for r in language.identify(train.unionByName(documents)).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang, _, _ in made)
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out if i is not None)
    assert {out[i]["lang_pred"] for i in (5, 6, 7)} == {"und"} and all(0 <= r["score"] <= 1 for r in out.values())
    model = language.train(train)
    _, _, (mixed,) = language.decide(model, [" ".join([*english * 3, *german * 3])])
    assert set(mixed) == {"de", "en"} and 0.3 < mixed["en"] < 0.7
    assert language.identify(odd).count() == documents.count() and language.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in language.identify(train.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language.keep_identified(train.unionByName(documents))
    assert kept.columns == documents.columns and kept.where("doc_id in (5, 6, 7)").count() == 0 and kept.where("doc_id >= 100").count() == 80


def test_licenses(documents, odd, nothing):
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    got = rows(licenses.scan(documents), *columns)
    want = []
    for r in documents.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        want.append((r["doc_id"], len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert got == sorted(want, key=repr)
    assert rows(licenses.scan(odd), *columns) == got and licenses.scan(nothing).count() == 0
    label = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(documents).collect()}
    assert label[13] == ("cc-by,cc-by-nc,gpl,reserved", 1.0) and label[5] == ("", 0.0)


def plain_near(found, percent=85):
    sets = []
    for text in found:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return sets, [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def near_check(df):
    data = [r for r in df.collect()]
    sets, links = plain_near([r["text"] if r["doc_id"] is not None else None for r in data])
    comp = {r["doc_id"]: r["doc_id"] for r in data}
    changed = True
    while changed:
        changed = False
        for i, j in links:
            a, b = data[i]["doc_id"], data[j]["doc_id"]
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    got = rows(minhash.near_duplicates(df.repartition(3)), "doc_id", "component_id", "kept")
    assert got == sorted([(r["doc_id"], comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"]) for r in data], key=repr)
    return sets, data


def test_minhash(documents, odd, nothing):
    sets, data = near_check(documents)
    n = {r["doc_id"]: r["n_shingles"] for r in minhash.near_duplicates(documents).collect() if r["doc_id"] is not None}
    assert all(n[r["doc_id"]] == len(s) for s, r in zip(sets, data, strict=True) if r["doc_id"] is not None)
    near_check(odd)
    assert minhash.near_duplicates(nothing).count() == 0
    # an id on several texts: each is linked on its own
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    several = documents.sparkSession.createDataFrame([(5, a), (5, b), (5, c), (2, a), (4, b), (9, c + " end"), (8, c)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(several.repartition(3)).collect()) == [
        (2, 56, 2, True), (4, 56, 4, True), (5, 56, 2, False), (5, 56, 4, False), (5, 56, 5, True), (8, 56, 5, False), (9, 57, 5, False),
    ]
    with pytest.raises(ValueError):
        minhash.near_duplicates(documents, percent=50)


def test_minhash_families(spark):
    """Families around the threshold: links between members that are not similar to the first one must be found."""
    rng = np.random.default_rng(5)
    made = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(120)]
        for member in range(60):
            words = list(base)
            for at in rng.choice(120, int(rng.integers(0, 5)), replace=False):
                words[at] = f"x{rng.integers(0, 6)}"
            made.append((int(rng.integers(0, 10**9)), " ".join(words), "en", "s", 1))
    near_check(spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long"))


def test_minhash_crowded_buckets(spark, monkeypatch):
    """A connected family whose first stars reach few of its members is joined by further stars, not pair by pair."""
    rng = np.random.default_rng(7)
    made = []
    for member in range(400):
        words = [f"w{i}" for i in range(240)]
        for at in rng.choice(240, 1 if member % 20 == 0 else 2, replace=False):
            words[at] = f"x{member}at{at}"
        made.append((int(rng.integers(0, 10**9)), " ".join(words), "en", "s", 1))
    outside, real = [], minhash._open_links

    def spy(members, labels, *rest):
        by = defaultdict(list)
        for r in members.join(labels, "id").groupBy("bucket", "label").count().collect():
            by[r["bucket"]].append(r["count"])
        outside.append(max(sum(n) - max(n) for n in by.values()))
        return real(members, labels, *rest)

    monkeypatch.setattr(minhash, "_open_links", spy)
    near_check(spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long"))
    assert outside[0] <= minhash.BLOCK


def test_minhash_stars_leave_out_unlikely_pairs(spark):
    """Members of a crowded bucket that bits or sizes rule out reach no join; the others all do, from one center or the other."""
    rows_ = [(1, n, 100 if n % 3 else 50, *((0, 0, 0) if n % 2 else (-1, 0, 0))) for n in range(40)]
    crowd = spark.createDataFrame(rows_, "bucket long, id long, n_shingles long, b1 long, b2 long, b3 long")
    labels = spark.createDataFrame([(n, min(n, 20)) for n in range(40)], "id long, label long")
    mixed = minhash._mixed(crowd.select("bucket", "id"), labels)
    label = {r["id"]: r["label"] for r in labels.collect()}
    likely = {(a, b) for a in range(40) for b in range(a) if (a % 3 > 0) == (b % 3 > 0) and a % 2 == b % 2 and label[a] != label[b]}
    for turn in range(3):
        got = {(r["b"], r["a"]) for r in minhash._star_pairs(crowd, labels, mixed, turn, 85).collect()}
        assert got and got <= likely
        centers = [n for n in range(40) if {p for p in likely if n in p} <= got]
        assert centers and all(any(c in p for c in centers) for p in got)


def test_pieces(documents, odd, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for r in documents.collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert rows(pieces.round_trip_digests(documents, PIECE), *columns) == sorted(want, key=repr)
    assert rows(pieces.round_trip_digests(odd, PIECE), *columns) == sorted(want, key=repr)
    assert pieces.round_trip_digests(nothing, PIECE).count() == 0
    back = pieces.decode_documents(pieces.encode_documents(documents, PIECE), PIECE).collect()
    assert len(back) == len(want) and all(r["text"] == library.decode(r["ids"]) for r in back)


def test_quality(spark, documents, odd, nothing):
    rng = np.random.default_rng(6)
    good, bad = "a calm and careful text about rivers and stones".split(), "BUY!! now$$$ free### click*** win%%%".split()
    made = [(100 + i, " ".join(rng.choice(good if i % 3 else bad, 30)), None, None, None) for i in range(90)]
    train = spark.createDataFrame(made, documents.schema)
    labels = spark.createDataFrame([(100 + i, int(i % 3 > 0), 0) for i in range(90)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.classify(train.unionByName(documents), labels).collect()}
    assert all(out[100 + i]["predicted"] == int(i % 3 > 0) for i in range(90))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items() if i is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert quality.classify(odd, labels).count() == documents.count() and quality.classify(nothing, labels).count() == 0
    kept = quality.keep_good(train, labels)
    assert kept.columns == train.columns and kept.count() == 60

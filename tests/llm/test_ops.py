"""Every operator against a brute-force version, on small tables with nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from verdance.llm import components, lmscore, media, packing, pieces, quality, rules, sharding, simhash, suffixdedup, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that is was for with as on be at by this had not are but from or have an they which one you were all her she there would their".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


def corpus():
    """Ids, texts and languages: copies, near copies, shared passages, junk, edge cases."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(30, 120)) for _ in range(40)]
    shared = sentence(rng, 40)
    texts = list(base)
    texts += [base[0]] * 6 + [base[1] + " extra"] + [base[2][:-3]]
    texts += [sentence(rng, 10) + " " + shared + " " + sentence(rng, 10) for _ in range(6)]
    texts += ["", None, " \n\t ", "one", "two words", "x" * 49, "x" * 50, "ab" * 60, "é" * 40 + " ñandú \U0001f600", "LOUD!! " * 60, "a | b | c | " * 50, sentence(rng, 9000), "\x00nul\x00", None, "one"]
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", 1), (None, base[4], "en", "s", 1), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), DOC).repartition(3)
    # clashing names: operators select what they need
    return df.withColumns({c: F.lit(1) for c in ("raw", "batch", "fp", "size", "range", "k1", "score", "x", "text_", "salt_", "rank_")})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---- op1 ----


def brute_print(text):
    words = (text or "").encode().lower().split()
    n = len(words)
    shingles = [words[i : i + 4] for i in range(n - 3)] if n >= 4 else [words] * (n > 0)
    h = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, nothing):
    got = simhash.op1(docs).select("doc_id", "fingerprint", "component_id").collect()
    rows = corpus()
    prints = [brute_print(t) for _, t, *_ in rows]
    assert sorted((str(r[0]), f"{p:016x}") for r, p in zip(rows, prints, strict=True)) == sorted((str(r[0]), r[1]) for r in got)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    want = sorted((str(r[0]), min(least[find(i)], default=None)) for i, r in enumerate(rows))
    assert want == sorted((str(r[0]), r[2]) for r in got)
    assert rows_of(simhash.op1(nothing)) == []
    kept = simhash.keep_one(docs.select(*nothing.columns)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(min(v) for v in least.values())
    assert rows_of(simhash.keep_one(nothing)) == []


def test_keep_one_of_rows_with_equal_ids(spark):
    """Rows that share an id but not a group each stand for their own group; rows equal in all columns count once."""
    rng = random.Random(21)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "fr", "s", 1), (None, a, "en", "s", 1), (7, None, "en", "s", 1), (8, "", "en", "s", 1)]
    got = sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_one(spark.createDataFrame(rows, DOC)).collect())
    assert got == sorted([("1", a), ("1", b), ("None", c), ("7", None)])


@pytest.mark.parametrize("faces", [simhash.FACES, simhash.WIDE])
def test_links_survive_any_flip(faces):
    assert sum(t + 1 for _, _, t in faces) > simhash.LIMIT and sum(b for _, b, _ in faces) == 64
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    other = base.copy()
    for i in range(200):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(bit)
    a, ra = simhash.anchors_of(base, faces)
    b, rb = simhash.anchors_of(other, faces)
    one, two = defaultdict(set), defaultdict(set)
    for x, r in zip(a, ra, strict=True):
        one[r].add(x)
    for x, r in zip(b, rb, strict=True):
        two[r].add(x)
    assert all(one[i] & two[i] for i in range(200))


@pytest.mark.parametrize(("block", "faces"), [(7, simhash.FACES), (50_000, simhash.FACES), (7, simhash.WIDE)])
def test_crowded_anchors_lose_no_link(spark, block, faces):
    rng = random.Random(2)
    hub = 0x0123456789ABCDEF
    fps = {hub}
    while len(fps) < 120:
        x = rng.choice(list(fps))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(60)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.near_pairs(df, block, faces)).collect()}
    groups = {x: roots.get(x, x) for x in signed}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(signed):
        for y in signed[:i]:
            if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 4:
                parent[find(x)] = find(y)
    want = defaultdict(set)
    got = defaultdict(set)
    for x in signed:
        want[find(x)].add(x)
        got[groups[x]].add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# ---- op2 ----


def test_shards(docs, nothing):
    got = sharding.shard(docs, shards=6).collect()
    rows = corpus()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    total = sum(size(t) for _, t, *_ in rows)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 6) <= max(r["size"] for r in got)
    # every row's shard is the piece of the line of all bytes in which its middle falls; equal texts are neighbours
    line, at, before = sorted(got, key=lambda r: (r["shard"], r["slot"])), 0, []
    for r in line:
        assert r["shard"] == min(5, (at + r["size"] - r["size"] // 2) * 6 // total)
        at += r["size"]
        if not before or before[-1] != (r["text_crc32"], r["size"]):
            before.append((r["text_crc32"], r["size"]))
    assert len(before) == len(set(before))
    assert rows_of(sharding.shard(nothing)) == []


def test_shards_of_one_row_repeated(spark):
    """A range of one row, repeated, is cut like any other: no task sorts it whole."""
    rows = [(None if i % 2 else 7, "hot text" if i % 3 else f"cold {i}", "en", "s", 1) for i in range(6000)]
    got = sharding.shard(spark.createDataFrame(rows, DOC), shards=24)
    by = got.groupBy("range").agg(F.sum("size").alias("b")).collect()
    total = sum(r["b"] for r in by)
    assert max(r["b"] for r in by) <= 3 * total / (24 * 8) + 32
    sizes = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 40


def test_shards_of_one_hot_text(spark):
    rows = [(i, "hot text" if i % 3 else f"cold {i}", "en", "s", 1) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, DOC), shards=24).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 24 and max(r["b"] for r in got) - min(r["b"] for r in got) <= 40


# ---- op3 ----


@pytest.fixture(scope="module")
def tokenizer_files():
    return pytest.importorskip("public_tokenizers")


def test_pieces(docs, nothing, tokenizer_files):
    import sentencepiece

    path = tokenizer_files.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.encode(docs, path, ["doc_id", "text"])
    for r in got.collect():
        assert r["ids"] == (None if r["text"] is None else sp.encode(r["text"]))
    for r in pieces.decode(got, path, ["text"]).collect():
        assert r["decoded"] == r["text"]
    # carried columns may have any name but that of the result
    clash = docs.select("doc_id", "text", F.col("text").alias("of"), F.lit("x").alias("row"), F.lit(2).alias("out"), F.col("text").alias("text_"))
    assert all(r["row"] == "x" and r["out"] == 2 and r["ids"] == (None if r["of"] is None else sp.encode(r["of"])) for r in pieces.encode(clash, path, ["doc_id", "of", "row", "out", "text_"]).collect())
    with pytest.raises(ValueError, match="called ids"):
        pieces.encode(docs.withColumn("ids", F.lit("x")), path, ["ids"])
    digest = {r["doc_id"]: r for r in pieces.op3(docs).collect()}
    assert digest[0]["ids_crc32"] == zlib.crc32(np.array(sp.encode(corpus_text(0)), "<u4").tobytes()) and all(r["round_trip"] for r in digest.values())
    assert rows_of(pieces.op3(nothing)) == []
    odd = ["   ", "a" * 400, " " * 90 + "x", "= = == ====", "1234567890" * 20, "tab\tnew\n\nline", "日本語 text"]
    assert [np.frombuffer(x, np.int32).tolist() for x in pieces.model(path).encode(odd)] == sp.encode(odd)


def corpus_text(i):
    return next(t for k, t, *_ in corpus() if k == i)


# ---- op4 ----


def test_lm(docs, nothing):
    got = lmscore.op4(docs).collect()
    rows = corpus()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for i, t, *_ in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t, *_ in rows)
    assert want == sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert rows_of(lmscore.op4(nothing)) == []


def fold7(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def lm_rows(seed=2, n=90):
    """Invented prose with repeated phrases, copies, hapaxes, empty texts, null ids."""
    rng = random.Random(seed)
    phrases = [sentence(rng, rng.randint(2, 6)) for _ in range(30)]
    texts = [" ".join(rng.choice(phrases) if rng.random() < 0.7 else f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 60))) for _ in range(n)]
    texts += [texts[0]] * 5 + ["", None, "", "Once", "once ONCE\x0bonce", "\u00c9t\u00e9 \u2003 x"]
    return [(i if i % 9 else None, t, "en", "s", 1) for i, t in enumerate(texts)]


def even_rows():
    """Words drawn one by one: most contexts tell nothing of what follows."""
    rng = random.Random(9)
    return [(i, " ".join(rng.choice(WORDS[:8]) for _ in range(60)), "en", "s", 1) for i in range(60)]


@pytest.mark.parametrize(("rows", "batches", "hot"), [(lm_rows(), 1, 1 << 20), (lm_rows(), 7, 1 << 20), (lm_rows(), 7, 5), (even_rows(), 40, 1 << 20), (even_rows(), 5, 40)])
def test_suffix_tree_in_buckets_is_the_brute_force_model(spark, monkeypatch, rows, batches, hot):
    """Scores of op4 over any number of buckets, with hot contexts dealt by followers or not, are those of the tree in dictionaries."""
    monkeypatch.setattr(lmscore, "batch_count", lambda *_: batches)
    words = lambda t: lmscore.tokens((t or "").encode())
    monkeypatch.setattr(lmscore, "CHUNK", 300)
    model = lmscore.Model([words(t) for i, t, *_ in rows if not fold7(i)])
    # contexts of both lengths that are retained, or (words drawn one by one) some that are not
    left = [len(s) for s, f in model.after.items() if s not in model.kept and sum(f.values()) > 1]
    assert {len(s) for s in model.kept} == {1, 2} if len(rows) > 60 else model.kept and left.count(1) > 3 and left.count(2) > 3
    want = sorted((str(i), model.score(words(t))) for i, t, *_ in rows)
    if hot < 10:
        monkeypatch.setattr(lmscore, "MOST_HOT", 10**9)
    got = sorted((str(r["doc_id"]), r["score"]) for r in lmscore.op4(spark.createDataFrame(rows, DOC).repartition(3), hot=hot).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-9)


def test_tree_distributions_sum_to_one():
    rows = lm_rows()
    model = lmscore.Model([lmscore.tokens((t or "").encode()) for i, t, *_ in rows if not fold7(i)])
    unseen = b"never seen"
    for s in [(), *list(model.kept)[:200]]:
        assert abs(sum(model.probability(s, w) for w in [*model.words, unseen]) - 1) < 1e-9


def test_tree_beats_its_base_on_unseen_texts(spark):
    got = lmscore.op4(spark.createDataFrame(lm_rows(5, 400), DOC)).collect()
    for held in (True, False):
        part = [r for r in got if r["held_out"] == held]
        assert len(part) > 40 and sum(r["score"] for r in part) > 0.95 * sum(r["base_score"] for r in part)


def test_suffix_tree_threshold_does_not_rise_with_the_corpus(spark):
    """A phrase seen twice in training is in the model beside a million words of other text, as it is alone."""
    rng = random.Random(3)
    filler = [(i, sentence(rng, 60_000), "en", "s", 1) for i in range(12)]
    twice = [(100 + i, "qa qb qc qd qe qf", "en", "s", 1) for i in range(40) if not fold7(100 + i)][:2]
    alone, beside = ({r["doc_id"]: r["score"] - r["base_score"] for r in lmscore.op4(spark.createDataFrame(rows, DOC), 1).collect()} for rows in (twice, twice + filler))
    for i, *_ in twice:
        assert beside[i] > alone[i] > 0


# ---- op5 ----


# classes of characters, as patterns over decoded text: space, line end, lower, upper, digit, sentence marks, symbols, other ASCII, longer characters
CLASS_PATTERNS = (r"[ \t\x0b\x0c\r]", r"\n", r"[a-z]", r"[A-Z]", r"[0-9]", r"[.,;:?'\"\-()]", r"[#*$%&|<>]", r"[\x00-\x08\x0e-\x1f!/=@\[\\\]^_`{}~+\x7f]", r"[^\x00-\x7f]")


def brute_classes(text):
    return [len(re.findall(p, text)) for p in CLASS_PATTERNS]


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    if not words:
        return [0.0] * 17
    size, n = len(text.encode()), len(words)
    space, ends, lower, upper, digit, marks, symbols, other, longer = brute_classes(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    again = {j for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    parts = [(upper, max(1, lower + upper + longer)), (digit, size), (marks, size), (symbols, size), (other, size), (longer, size), (ends, size)]
    repeats = [(max(Counter(words).values()), n), (sum(words[i] == words[i + 1] for i in range(n - 1)), n), (len(again), n), (len(lines) - len(set(lines)), max(1, len(lines))), (text.count("!"), n), (text.count("|"), n)]
    return [math.log(size + 1), math.log(n + 1), math.log(size / n), *(math.sqrt(x / y) for x, y in parts), math.log(len(set(words)) + 1) / math.log(n + 1), *(math.sqrt(x / y) for x, y in repeats)]


def test_statistics_against_brute_force(docs):
    rng = random.Random(12)
    texts = [t or "" for _, t, *_ in corpus()] + ["".join(rng.choice("aB1.,#|!=~ \n\té\U0001f600\x00") for _ in range(rng.randrange(400))) for _ in range(60)]
    texts += [" ".join(rng.choice(["a", "b"]) for _ in range(40)) + "\nx y\nx y\n\n", "a b c d e f g h " * 3]
    for t in texts:
        assert rules.class_counts(t.encode()).tolist() == brute_classes(t)
        assert np.allclose(quality.statistics(t.encode()), brute_statistics(t), rtol=0, atol=1e-12)
    by_id = defaultdict(list)
    for i, t, *_ in corpus():
        by_id[i].append(t)
    for r in quality.with_statistics(docs).collect():
        assert any(np.allclose(r["x"], brute_statistics(t or ""), rtol=0, atol=1e-12) for t in by_id[r["doc_id"]])


def test_classifier(spark, docs, nothing):
    rng = random.Random(8)
    good = [sentence(rng, rng.randint(40, 200)) + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in sentence(rng, 40).split()) if i % 2 else (rng.choice(WORDS) + " ") * 60 for i in range(150)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good + bad)]
    marks = [(i, int(i < 150), 0) for i in range(300)] + [(0, 1, 0), (None, 1, 0), (5, None, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(rows, DOC)
    got = quality.op5(table, labels).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] < 150) for r in held) >= 0.95 * len(held)
    # held-out labels, languages, sources and ids change no score
    swapped = labels.withColumn("quality", F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.op5(table.withColumns({"lang": F.lit("zz"), "source": F.lit("q")}), swapped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)
    # every kind of text has a score; no labels: one half
    assert all(0 <= r["score"] <= 1 for r in quality.op5(docs, labels).collect())
    assert {r["score"] for r in quality.op5(docs, labels.limit(0)).collect()} == {0.5}
    assert rows_of(quality.op5(nothing, labels)) == []
    assert {r["doc_id"] for r in quality.keep_good(table, labels).collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_discriminant_against_numpy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.SIZE))
    y = np.arange(400) % 2
    x[y == 1] = x[y == 1] * 0.5 + 1
    model = {"n": {}, "mean": {}, "factor": {}, "log_det": {}, "prior": 0.0}
    cov = {k: np.cov(x[y == k].T, bias=True) for k in (0, 1)}
    pooled = np.diag((cov[0] + cov[1]) / 2) + quality.FLOOR
    want = 0
    for k in (0, 1):
        s = (1 - quality.SHRINK) * cov[k] + quality.SHRINK * np.diag(pooled)
        model["mean"][k] = x[y == k].mean(axis=0)
        model["factor"][k] = np.linalg.inv(np.linalg.cholesky(s))
        model["log_det"][k] = np.linalg.slogdet(s)[1]
        d = x - model["mean"][k]
        want = -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + model["log_det"][k]) - want
    assert np.allclose(quality.scores(model, x), 1 / (1 + np.exp(-want / quality.SIZE)))


# ---- op6 ----


def test_warc(spark, tmp_path):
    rng = random.Random(3)
    html = ["<p>" + sentence(rng, 5) + "</p>" for _ in range(10)]
    rows = [(i, f"http://a/{i}", html[i % 7] if i % 5 else None) for i in range(40)] + [(3, "http://a/3", html[3]), (50, None, "é\r\n"), (51, "bad\r\nurl", ""),
        (52, "http://a/urn:sha1:ABC", "<p>marked</p>"), (53, "http://a/?WARC-Type: response", "<p>marked</p>"), (54, "x\r\nWARC-Type: response\r\nContent-Length: 9", "<p>marked</p>"),
        (55, "WARC-Refers-To: <urn:page:1>", "unlike any other"), (56, None, "long " * 1_000_000), (57, "u", "long " * 1_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    seen, want = set(), []
    for i, _, h in sorted(rows, key=lambda r: (r[0], str(r[1]))):
        raw = (h or "").encode()
        whole = first[h or ""] == i and i not in seen
        if whole:
            seen.add(i)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if whole else "revisit", None if whole else first[h or ""]))
    got = [tuple(r) for r in warc.op6(pages).collect()]
    key = lambda r: (r[0], r[3], str(r[4]))
    assert sorted(got, key=key) == sorted(want, key=key)
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    assert spark.read.parquet(path + "/payloads").count() == len(first)
    line = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+: [^\r\n]*\r\n")  # a named field of the standard's grammar, unfolded
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    for r in warc.restore(spark, path).collect():
        raw = bytes(r["record"])
        assert raw.startswith(b"WARC/1.1\r\n")
        at, fields = 10, {}
        while found := line.match(raw, at):
            name, value = found.group()[:-2].decode().split(": ", 1)
            assert name not in fields
            fields[name], at = value, found.end()
        assert raw[at : at + 2] == b"\r\n"
        block, end = raw[at + 2 : at + 2 + int(fields["Content-Length"])], raw[at + 2 + int(fields["Content-Length"]) :]
        assert end == b"\r\n\r\n" and {"WARC-Record-ID", "WARC-Date", "WARC-Type", "WARC-Target-URI", "Content-Type"} <= fields.keys()
        assert re.fullmatch(r"<[a-z]+:[^<>\s]*>", fields["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and fields["WARC-Block-Digest"] == sha1(block)
        http, _, payload = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and fields["WARC-Type"] in ("response", "revisit")
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == sha1(payload) and not {"WARC-Refers-To", "WARC-Profile"} & fields.keys()
        else:
            assert payload == b"" and fields["WARC-Profile"].endswith("/revisit/identical-payload-digest") and fields["WARC-Refers-To"].startswith("<urn:page:")
    other = str(tmp_path / "named")
    warc.write_archive(spark.createDataFrame([("a\r\nb <c>", "u", "x"), ("z", "u", "x")], "page_id string, url string, html string"), other, date="2024-05-01T12:00:00Z")
    assert sorted(r["record"] for r in warc.read_archive(spark, other).collect()) == ["a\r\nb <c>", "z"] and {r["refers"] for r in warc.read_archive(spark, other).collect()} == {None, "a\r\nb <c>"}
    assert all(b"WARC-Date: 2024-05-01T12:00:00Z\r\n" in bytes(r["record"]) for r in warc.restore(spark, other).collect())
    with pytest.raises(ValueError, match="no date"):
        warc.write_archive(pages, other, date="yesterday")
    assert rows_of(warc.op6(pages.limit(0))) == []


def test_warc_of_one_hot_payload(spark):
    """A payload that most pages share, rows without an id and rows repeated among them: one response in all."""
    rows = [(None if i % 4 == 0 else i // 2, f"u{i % 3}", "same" if i % 5 else f"own {i}") for i in range(600)]
    got = [tuple(r) for r in warc.op6(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()]
    ids = [i for i, _, h in rows if h == "same"]
    same = [r for r in got if r[1] == 4]
    assert sorted(map(str, ids)) == sorted(str(r[0]) for r in same)
    assert [r[0] for r in same if r[3] == "response"] == [min(i for i in ids if i is not None)]
    assert {r[4] for r in same if r[3] == "revisit"} == {min(i for i in ids if i is not None)}
    plan = warc.op6(spark.createDataFrame(rows, "page_id long, url string, html string"))._jdf.queryExecution().toString()
    assert "Window" not in plan


# ---- op7 ----


def brute_cut(rows):
    best = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                best[b[p : p + 50]] = min(i, best.get(b[p : p + 50], i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49) if i is not None else ():
            if best[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats(docs, nothing):
    assert brute_cut(corpus()) == sorted((str(r[0]), *r[1:]) for r in rows_of(suffixdedup.op7(docs)))
    assert rows_of(suffixdedup.op7(nothing)) == []


def test_repeats_over_many_batches(spark, monkeypatch):
    rng = random.Random(4)
    parts = [sentence(rng, 30) for _ in range(25)]
    rows = [(i, " ".join(rng.sample(parts, 4)) + ("z" * rng.randint(0, 120)) + "abcabc" * rng.randint(0, 30), "en", "s", 1) for i in range(60)]
    df = spark.createDataFrame(rows, DOC)
    monkeypatch.setattr(suffixdedup, "batch_count", lambda *_: 7)
    got = sorted((str(r[0]), *r[1:]) for r in rows_of(suffixdedup.op7(df)))
    assert got == brute_cut(rows)
    cut = {r["doc_id"]: r for r in suffixdedup.cut_repeats(df).collect()}
    assert set(cut) == {r[0] for r in rows} and all(len(r["text"]) == r["n_chars"] for r in cut.values())


def test_repeats_around_one_phrase(spark, monkeypatch):
    """Thousands of documents share a phrase and little else: its hash is crowded, its windows are dealt one by one, and equal ones still meet."""
    rng = random.Random(12)
    phrase = "the quick brown fox jumps over lazy dogs"
    rows = [(i, f"{sentence(rng, 6)} {phrase} {sentence(rng, 6)}", "en", "s", 1) for i in range(5000)]
    for i in range(0, 200, 2):  # windows over the phrase's edges that two documents share
        rows[i + 1] = (i + 1, rows[i][1][5:] + f" {i}", "en", "s", 1)
    rows += [(6000 + i, rows[7][1], "en", "s", 1) for i in range(40)]
    df = spark.createDataFrame(rows, DOC)
    want = brute_cut(rows)
    monkeypatch.setattr(suffixdedup, "batch_count", lambda *_: 9)
    for crowd in (1 << 14, 300):
        cut = suffixdedup.dedup(df, ["doc_id"], suffixdedup._cut_light, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", crowd=crowd)
        assert sorted((str(r["row"][0]), *r[1:]) for r in cut.collect()) == want
    # what reaches a bucket: under one hash at most a few different windows, not the crowd
    raws = [t.encode() for _, t, *_ in rows[:5000]]
    h, row, first, windows = suffixdedup.segments(raws)
    value, count = np.unique(h, return_counts=True)
    crowded = h == value[count.argmax()]
    assert crowded.sum() > 1000
    keys, of, place = suffixdedup._single([raws[r][a : a + w + 49] for r, a, w in zip(row[crowded].tolist(), first[crowded].tolist(), windows[crowded].tolist(), strict=True)])
    assert len(keys) == windows[crowded].sum() and np.unique(keys, return_counts=True)[1].max() < 60  # of 5,000


@pytest.mark.parametrize("batches", [9, 150])
def test_repeats_of_hot_passages(spark, monkeypatch, batches):
    """A passage that most documents hold, in more batches than one message may stand for; equal rows, repeated and null ids among them."""
    rng = random.Random(14)
    hot, other = sentence(rng, 40), sentence(rng, 25)
    rows = [(500 - i if i % 11 else None, f"{sentence(rng, rng.randint(0, 9))} {hot[rng.randint(0, 60):]} {other if i % 3 else ''} {sentence(rng, 5)}", "en", "s", 1) for i in range(300)]
    rows += [(7, hot, "en", "s", 1)] * 4 + [(None, hot, "en", "s", 1)] * 4 + [(900, hot, "en", "s", 1)] * 30 + [(7, other + hot, "en", "s", 1)]
    monkeypatch.setattr(suffixdedup, "batch_count", lambda *_: batches)
    assert (batches > 2 * suffixdedup.GROUP) == (batches == 150)
    assert sorted((str(r[0]), *r[1:]) for r in rows_of(suffixdedup.op7(spark.createDataFrame(rows, DOC)))) == brute_cut(rows)


def test_segments_hold_every_window():
    rng = random.Random(15)
    raws = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 1, 49, 50, 51, 99, 400]))) for _ in range(60)] + [b"x" * 3000, b""]
    seen = Counter()
    names = {}
    for h, r, a, w in zip(*(x.tolist() for x in suffixdedup.segments(raws)), strict=True):
        assert 0 < w <= suffixdedup.MOST_WINDOWS
        for k in range(w):
            seen[r, a + k] += 1
            window = raws[r][a + k : a + k + 50]
            assert len(window) == 50 and names.setdefault(window, h) == h  # equal windows go together
    assert seen == Counter({(r, a): 1 for r, x in enumerate(raws) for a in range(len(x) - 49)})


def test_column_wise_is_a_suffix_array(monkeypatch):
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"ab\xc3") for _ in range(rng.randint(1, 12))) for _ in range(40)]
    for limit in (1 << 20, 8):  # in memory, and through files
        monkeypatch.setattr(suffixdedup, "SPOOL_BYTES", limit)
        bwt, lcp, _ = suffixdedup.column_wise(strings)
        order = sorted((s[i:], k) for k, s in enumerate(strings) for i in range(len(s) + 1))
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(order, order[1:], strict=False)]
        assert len(bwt) == len(order)


# ---- op8 ----


def test_packing(docs, nothing, tokenizer_files):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_files.path("byte_bpe_50k.json"))
    got = packing.op8(docs).collect()
    want = Counter()
    total = 0
    for i, text, *_ in corpus():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want[(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert want == Counter(tuple(r)[:5] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-total // 2048) + 1
    assert rows_of(packing.op8(nothing)) == []


def test_words_and_specials_encode_like_the_tokenizer(tokenizer_files):
    path = tokenizer_files.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    texts = ["".join(f"a{chr(i)}b 1{chr(i)}2 {chr(i)}{chr(i)} x'" for i in range(lo, hi)) for lo, hi in ((0, 128), (128, 400), (0x2000, 0x2100))]
    texts += ["a<|endoftext|>b", " don't  we've\n\n x", "naïve café ÀÉ ²x ½", " ".join(WORDS) * 3, "\t\ttabs   end  ", "日本語 \U0001f600", "", "x" * 5000, " " * 3000 + "y", "\x00\x1f\u2028\u00a0 \u3000z"]
    rng = random.Random(12)
    texts += ["".join(rng.choice("abcdefgh 'tsrveml.,!?\n0189éßñ漢\u0301") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    tokens = packing.Tokens(path)
    assert tokens.fast is not None
    same = lambda x: np.frombuffer(tokens.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert all(map(same, texts))
    # a text whose splitting tiktoken gives up goes the library's way
    wide = " " * 1_200_000 + "x"
    assert same(wide)
    # every entry of the vocabulary merges as the library merges it, alone and next to another one
    words = [t.decode([i]) for i in range(0, 50256)]
    rng.shuffle(words)
    pairs = [a + b for a, b in zip(words[::2], words[1::2], strict=True)]
    for part in (words, pairs):
        want = [e.ids for e in t.encode_batch_fast(part, add_special_tokens=False)]
        assert [np.frombuffer(tokens.ids(x), "<u4").tolist() for x in part] == want


def test_other_tokenizer_files_go_to_the_library(tokenizer_files, tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(tokenizer_files.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = json.load(f)
    file["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    tokens = packing.Tokens(str(path))
    assert tokens.fast is None
    assert np.frombuffer(tokens.ids("one two"), "<u4").tolist() == Tokenizer.from_file(str(path)).encode("one two", add_special_tokens=False).ids


def test_packing_ranks_in_many_groups(spark, tokenizer_files):
    """Equal rows, null ids among them, are ranked in several groups of a length; places stay gapless and apart."""
    rows = [(None if i % 3 else i, "the same words" if i % 4 else sentence(random.Random(i), 20), "en", "s", 1) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, DOC).repartition(5), packing.tokenizer_file, capacity=64, group=16).collect()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["piece"] == 0 for r in got) == 400
    for places in by.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0, *(n for _, n in sorted(places))])[:-1].tolist() and sum(n for _, n in places) <= 64


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_the_histogram_up(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([16, 64, 257]))
    h = np.zeros(capacity + 1, np.int64)
    for n in rng.integers(1, capacity + 1, 400):
        h[n] += 1
    used = np.zeros_like(h)
    sequences = 0
    for count, content in packing.pack_histogram(h, capacity):
        assert count > 0 and sum(n * k for n, k in content) <= capacity
        sequences += count
        for n, k in content:
            used[n] += count * k
    assert (used == h).all() and sequences <= 1.05 * -(-int((h * np.arange(capacity + 1)).sum()) // capacity) + 2
    assert packing.pack_histogram(np.zeros(capacity + 1, np.int64), capacity) == []


# ---- op9 ----


def brute_counts(text):
    b = text or ""
    words = b.encode().split()
    n = len(words)
    windows = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    marked = {j for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in b.encode().split(b"\n") if x.split()]
    chars = "".join(w.decode() for w in words)
    return n, len(chars), sum(chars.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_rules(spark, docs, nothing):
    got = rules.op9(docs).collect()
    rows = corpus()
    want = []
    for i, t, *_ in rows:
        c = brute_counts(t)
        want.append((str(i), *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert sorted(want) == sorted((str(r["doc_id"]), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in got)
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    assert rows_of(rules.op9(nothing)) == []
    text = "a b\na b\n\na b c d e f g h i\n# $x x x x x x x x x x\n"
    r = rules.op9(spark.createDataFrame([(1, text, "en", "s", 1)], DOC)).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(text)


def test_verdicts_against_brute_force(spark):
    rng = random.Random(9)
    texts = [sentence(rng, rng.randint(60, 200)) for _ in range(60)] + [" ".join(f"w{rng.random()}" for _ in range(80)), " | ".join(sentence(rng, 1) for _ in range(60)), sentence(rng, 80).upper()]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in rules.op9(spark.createDataFrame(rows, DOC)).collect()}
    words = Counter(w for t in texts for w in t.lower().encode().split())
    common = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:64]]
    classes = sum(np.array(brute_classes(t), float) for t in texts)
    ref = np.array([words[w] for w in common] + [sum(words.values()) - sum(words[w] for w in common)], float)

    def js(p, q):
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        return math.sqrt(sum(0.5 * x * math.log2(x / y) for a in (p, q) for x, y in zip(a, m, strict=True) if x > 0))

    for i, t in enumerate(texts):
        own = Counter(t.lower().encode().split())
        mine = np.array([own[w] for w in common] + [sum(own.values()) - sum(own[w] for w in common)], float)
        assert abs(got[i]["words_distance"] - js(mine, np.resize(ref, 65) if len(ref) == 65 else ref)) < 1e-6
        assert abs(got[i]["chars_distance"] - js(np.array(brute_classes(t), float), classes)) < 1e-6
        limits = rules.DEFAULTS
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["chars_distance"] <= limits["max_chars_distance"] and got[i]["words_distance"] <= limits["max_words_distance"])
    assert sum(got[i]["kept"] for i in range(60)) >= 50 and not any(got[i]["kept"] for i in (60, 62))


# ---- op10 ----


def brute_hash(rows):
    """Brightness of 8 x 9 cells of an image (rows of samples), by exact overlaps; a bit for each cell brighter than its right neighbour."""
    h, w = len(rows), len(rows[0])
    across = lambda n, cells: [[max(0.0, min(x + 1, (k + 1) * n / cells) - max(x, k * n / cells)) for x in range(n)] for k in range(cells)]
    cells = np.round(np.array(across(h, 8)) @ np.array(rows, float) @ np.array(across(w, 9)).T * (72 / (h * w)), 6)
    bits = "".join("1" if cells[y, x] > cells[y, x + 1] else "0" for y in range(8) for x in range(8))
    return f"{int(bits, 2):016x}"


def brute_tiles(payload, rows=None):
    """The NPY format written out: magic, version, length of the header, header to a multiple of 64, bytes."""
    rows = rows or media.TILE_ROWS
    out = b""
    for at in range(0, len(payload), 64 * rows):
        part = payload[at : at + 64 * rows]
        head = f"{{'descr': '|u1', 'fortran_order': False, 'shape': ({len(part) // 64}, 64), }}"
        head += " " * (-(10 + len(head) + 1) % 64) + "\n"
        out += b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head.encode() + part
    return out


def test_media(docs, nothing):
    rows = corpus()
    want = Counter()
    for i, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        samples = [list(payload[k : k + 64]) for k in range(0, len(payload), 64)]
        stored = brute_tiles(payload)
        assert media.from_tiles(stored).tobytes() == payload
        want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), brute_hash(samples))] += 1
    got = Counter(tuple(r) for r in media.op10(docs).collect())
    assert got.total() == len(rows) and got == want
    assert rows_of(media.op10(nothing)) == []


def test_area_resize_against_brute_force():
    rng = np.random.default_rng(0)
    for h, w, rows, cols in ((1, 64, 8, 9), (7, 5, 3, 2), (16, 18, 8, 9), (3, 3, 8, 9)):
        image = rng.integers(0, 256, (h, w)).astype(float)
        fine = np.kron(image, np.ones((rows, cols)))  # each pixel split so that cells align
        want = fine.reshape(rows, h, cols, w).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(image, rows, cols), want)


def test_decoders():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P2\n# c\n4 3 255\n" + b" ".join(b"%d" % x for x in grey.ravel())) == grey).all()
    assert (media.decode(b"P1 3 2 1 0 1 0 1 0") == [[0, 255, 0], [255, 0, 255]]).all()
    assert (media.decode(b"P4 3 2\n\xa0\x40") == [[0, 255, 0], [255, 0, 255]]).all()
    assert media.decode(b"P6 1 1 255\n\1\2\3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n\1\0").tolist() == [[256]]
    bmp = b"BM" + (62).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24) + b"\3\2\1\0\6\5\4\0"
    assert media.decode(bmp).tolist() == [[[4, 5, 6]], [[1, 2, 3]]]
    masks = b"BM" + (74).to_bytes(4, "little") + bytes(4) + (66).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + b"\1\0\x20\0\3\0\0\0" + bytes(20)
    assert media.decode(masks + b"\0\0\xff\0\0\xff\0\0\xff\0\0\0" + b"\3\2\1\0").tolist() == [[[1, 2, 3]]]
    assert media.decode(masks + b"\xff\0\0\0\0\xff\0\0\0\0\xff\0" + b"\3\2\1\0") is None
    for bad in (b"", None, b"P5", b"P5 9 9 255\n\0", b"BM", b"GIF89a", b"P3 1 1 255 x"):
        assert media.decode(bad) is None
    assert media.difference_hash(np.tile(np.arange(64, 0, -1), (8, 1))) == "f" * 16 and media.difference_hash(np.zeros((1, 64))) == "0" * 16


# ---- shared parts ----


def test_a_cluster_needs_a_shared_folder():
    from verdance.llm import common

    class Session:
        def __init__(self, master, folder):
            self.conf, self.sparkContext = {"spark.checkpoint.dir": folder}, type("Context", (), {"master": master})

    assert common.shared_dir(Session("spark://host:7077", "hdfs://shared/")) == "hdfs://shared"
    assert common.shared_dir(Session("local[2]", None))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(Session(master, None))

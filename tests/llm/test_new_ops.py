"""Ranked search, mixing and session versions against brute-force versions, with nulls, ties, repeats, empty and long texts, empty tables, clashing names."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.llm import lexical, mixing, sessions

from .test_ops import DOC, corpus

CLASH = ("raw", "id", "terms", "tfs", "n", "item", "score", "rank", "row", "size", "key", "slot", "no", "at", "words", "target", "begin", "walk", "place")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3).withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


# ---- op11 ----

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(rows, items, k):
    counted = [(i, Counter(brute_terms(t))) for i, t in rows]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for i, c, size in counted:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in brute_terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out.update((item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k]))
    return out


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    texts = [t for _, t, *_ in corpus() if t]
    some = [" ".join(rng.choice(texts).split()[: rng.randint(3, 40)]) for _ in range(25)]
    return [*enumerate([*some, "the", "THE the, tHe!", "é" * 40, "ÑANDÚ ñandú", "", None, "...", "nowhere-found", "x" * 49, "one two"]), (3, some[3]), (None, some[4]), (40, texts[0] * 40)]


@pytest.mark.parametrize("k, block", [(10, 1 << 17), (2, 50), (1, 1)])
def test_search(spark, docs, items, k, block):
    want = brute_search([(i, t) for i, t, *_ in corpus()], items, k)
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)).repartition(2)
    assert Counter(map(tuple, lexical.search(docs, frame, k, block_terms=block).collect())) == want


def test_search_of_copies_and_names(spark, nothing):
    rows = [(f"d{i:03d}", "alpha beta" if i % 3 else f"alpha {i} beta gamma", i) for i in range(300)] + [(None, "alpha beta", 0)]
    frame = spark.createDataFrame(rows, "name string, body string, n int").repartition(7)
    wanted = spark.createDataFrame([("q", "beta"), ("r", "gamma alpha"), ("s", "zz")], "q string, body string")
    got = [tuple(r) for r in lexical.search(frame, wanted, 4, "name", "q", "body").collect()]
    assert Counter(got) == brute_search([(i, t) for i, t, _ in rows], [("q", "beta"), ("r", "gamma alpha"), ("s", "zz")], 4)
    for few, some in ((nothing, wanted), (frame, wanted.limit(0))):
        names = ("doc_id", "text") if few is nothing else ("name", "body")
        assert lexical.search(few.withColumnRenamed("text", "body"), some, 4, names[0], "q", "body").collect() == []
    assert lexical.op11(nothing, spark.createDataFrame([], "item_id long, text string")).columns == ["item_id", "rank", "doc_id", "score"]


def test_pruning_leaves_documents_out():
    """Bounds: an item's common terms alone don't make a candidate once the threshold is over what they can add."""
    known = lexical.Items([{0: 1, 1: 2, 2: 1}], np.array([1000, 10, 5]), np.array([900, 8, 5]))
    found, rest = known.essential(np.maximum(known.seed, 1))
    assert known.seed.tolist() == [900] and found.tolist() == [True, False, False] and rest.tolist() == [25]
    found, _ = known.essential(np.array([25]))
    assert found.tolist() == [True, True, False]  # what reaches the threshold exactly stays


# ---- op12 ----


def brute_targets(sizes, epochs=1.5, most=2):
    """Round by round: what is over a cap goes to the others by weight."""
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), epochs * sum(sizes)
    while free:
        weight = sum(w[i] for i in free)
        over = {i for i in free if left * w[i] / weight > most * sizes[i]}
        for i in over or free:
            out[i] = most * sizes[i] if over else left * w[i] / weight
        left -= sum(most * sizes[i] for i in over)
        free -= over or set(free)
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def point(j, bits=mixing.BITS):
    return int(f"{j:0{bits}b}"[::-1], 2)


def test_points_and_ranks():
    j = np.arange(300)
    assert mixing.reversed_bits(j).tolist() == [point(int(x)) for x in j]
    rng = random.Random(1)
    for x in (0, 1, 1 << 40, *(rng.randrange(1 << 40) for _ in range(20))):
        want = [sum(point(i) < x for i in range(n)) for n in range(0, 300, 7)]
        assert mixing.points_below(np.arange(0, 300, 7), np.full(43, x)).tolist() == want


def test_targets():
    rng = random.Random(2)
    for sizes in ([], [0], [5], [1, 1000, 3], [0, 0, 7], [rng.randint(0, 1000) for _ in range(40)]):
        assert np.allclose(mixing.targets(sizes), brute_targets(sizes))


def test_mix(spark, docs, nothing):
    rows = [(i, t, s) for k, (i, t, _, s, _) in enumerate(corpus()) for s in [s if k % 3 else ("b" if k % 2 else "é")]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).withColumns({c: F.lit(1) for c in CLASH})
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {n: sum(words(t) for _, t, s in rows if s == n) for n in names}
    wanted = dict(zip(names, brute_targets([total[n] for n in names]), strict=True))
    got = [r.asDict() for r in mixing.op12(frame).collect()]
    assert len(got) == len(rows) and Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, words(t)) for i, t, _ in rows)
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in mixing.op12(frame.repartition(7)).collect())
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert any(r["source_size"] == total[n] and abs(r["target"] - wanted[n]) < 1e-6 for n in names)
    taken, line = defaultdict(int), [r.asDict() for r in mixing.mix(frame, block=16).collect()]
    for r in line:
        taken[r["source"]] += r["length"]
    assert all(abs(taken[n] - wanted[n]) <= 16 * 8 for n in names)
    # every slot is one source's block, without gaps; sources stay near their shares in every beginning of the mix
    slots = defaultdict(list)
    for r in line:
        slots[r["slot"]].append(r)
    for of in slots.values():
        of.sort(key=lambda r: r["place"])
        assert len({r["source"] for r in of}) == 1 and [r["place"] for r in of] == [sum(x["length"] for x in of[:k]) for k in range(len(of))]
    for n in range(8, max(slots), 37):
        for s in names:
            assert abs(sum(slots[j][0]["source"] == s for j in range(n) if j in slots) - n * wanted[s] / sum(wanted.values())) <= 8
    assert mixing.op12(nothing).collect() == [] and mixing.mix(nothing).collect() == []


def test_taken_by_brute_force(spark, docs):
    """op12's words of each document: slots one by one, each takes its source's next block on the shuffled line."""
    import hashlib

    rows = [(i, t, s) for i, t, _, s, _ in corpus()]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    lines = {n: sorted(((md5(f"{'' if i is None else i}:{md5(t or '')}"), i if i is not None else -1, words(t)) for i, t, s in rows if s == n)) for n in names}
    sizes = [sum(x[2] for x in lines[n]) for n in names]
    goal = [int(t) for t in mixing.targets(sizes)]
    edges = [(sum(goal[:k]) << 40) // sum(goal) for k in range(len(goal) + 1)]
    places = {n: [(k, w) for _ in range(2) for k, x in enumerate(lines[n]) for w in range(x[2])] for n in names}
    taken, used = Counter(), Counter()
    for j in range(sum(goal)):  # a word a block at this size
        no = max(k for k in range(len(goal)) if edges[k] <= point(j))
        if used[no] < len(places[names[no]]):
            taken[names[no], places[names[no]][used[no]][0]] += 1
        used[no] += 1
    want = Counter((x[1] if x[1] >= 0 else None, x[2], sizes[no], taken[n, k]) for no, n in enumerate(names) for k, x in enumerate(lines[n]))
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in mixing.op12(docs).collect()) == want


# ---- op13 ----


def brute_versions(events, gap=600):
    """Batch by batch, user by user; a standing session is a set of events."""
    out = Counter()
    users = defaultdict(list)
    for k, (u, s, b, h) in enumerate(events):
        if None not in (u, s, b):
            users[u].append((s, k, b, h))
    for u, mine in users.items():
        standing, made = {}, []
        for b in sorted({x[2] for x in mine}):
            parts = []
            for x in sorted(x for x in mine if x[2] <= b):
                if parts and x[0] - parts[-1][-1][0] <= gap:
                    parts[-1].append(x)
                else:
                    parts.append([x])
            now = {}
            for p in parts:
                ids = frozenset(x[1] for x in p)
                new = sum(x[2] == b for x in p)
                if not new:
                    now[ids] = standing[ids]
                    continue
                old = [v for q, v in standing.items() if q <= ids]
                made.append([u, b, p[0][0], p[-1][0], len(p), new, len(old), sum(x[3] or 0 for x in p), None, None])
                for v in old:
                    made[v][8:] = [b, p[0][0]]
                now[ids] = len(made) - 1
            standing = now
        out.update(map(tuple, made))
    return out


def drawn(rng, users, n, span):
    for _ in range(n):
        s = rng.randrange(span)
        late = rng.choice([0, 0, 0, 1, 2, 3])
        yield rng.choice(users), s, s // 900 + late, rng.randrange(1 << 32)


EVENT = "user long, second long, batch long, h long"


@pytest.mark.parametrize("slices", [4, 16])
def test_versions(spark, slices):
    rng = random.Random(slices)
    events = [*drawn(rng, range(30), 500, 30_000), *drawn(rng, [77], 400, 200_000), *drawn(rng, [78], 30, 3_000), (5, None, 1, 1), (None, 5, 0, 1), (5, 5, None, 1), (6, 10, 0, None), (79, -50, -1, 3), (79, 20, 0, 4), (79, -4000, -3, 5)]
    events += [(80, 300 * k, 300 * k // 900 + (3 if k % 7 == 0 else 0), k) for k in range(700)]  # one session over many slices
    events += [events[0]] * 5
    frame = spark.createDataFrame(events, EVENT).withColumns({c: F.lit(1) for c in ("slice", "n", "start", "last", "unit", "first", "run")}).repartition(5)
    assert Counter(map(tuple, sessions.session_versions(frame, slice_batches=slices).collect())) == brute_versions(events)


def test_carries_over_blocks_of_slices(spark, monkeypatch):
    """Slices in blocks of three: sums over blocks of blocks."""
    monkeypatch.setattr(sessions, "FAN", 3)
    rng = random.Random(9)
    events = [(1, 300 * k, 300 * k // 900 + rng.choice([0, 0, 3]), k) for k in range(900) if k not in (500, 501, 502)]
    events += [(2, s, s // 900, 1) for s in sorted(rng.sample(range(250_000), 700))]
    assert Counter(map(tuple, sessions.session_versions(spark.createDataFrame(events, EVENT), slice_batches=4).collect())) == brute_versions(events)


def test_hot_user_is_bounded(spark):
    """Many events of one user in few seconds are put together before they meet in a task."""
    events = [(1, k % 50, 0, 1) for k in range(20_000)] + [(k, 5, 0, 1) for k in range(2, 50)]
    got = {r["user"]: r for r in sessions.session_versions(spark.createDataFrame(events, EVENT)).collect()}
    assert (got[1]["n_events"], got[1]["n_new"], got[1]["end_s"]) == (20_000, 20_000, 49) and len(got) == 49


def test_snapshots_side_by_side():
    """Numpy batches of any cut give the same as one."""
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted((u, s // 14_400, s, b, 1, h) for u, s, b, h in drawn(rng, range(40), 900, 14_000))
    t = pa.table({"user": [r[0] for r in rows], "unit": [r[1] for r in rows], "second": [r[2] for r in rows], "start": [r[2] for r in rows], "batch": [r[3] for r in rows], "n": [r[4] for r in rows], "h": [r[5] for r in rows]})
    made = lambda batches, *rows: Counter(map(str, pa.Table.from_batches(list(sessions._versions(16, 600, *rows)(iter(batches)))).to_pylist()))
    whole = made(t.to_batches())
    for rows_a_time, cut in ((50, 7), (1, 1), (200, 64)):
        assert made(t.to_batches(cut), rows_a_time) == whole


def test_wrong_times_and_nothing(spark):
    for bad in ((1, 1000, 0, 1), (1, 10, 4, 1)):
        with pytest.raises(Exception, match="batches late"):
            sessions.session_versions(spark.createDataFrame([bad], EVENT)).collect()
    assert sessions.session_versions(spark.createDataFrame([], EVENT)).collect() == []
    with pytest.raises(ValueError, match="slice"):
        sessions.session_versions(spark.createDataFrame([], EVENT), slice_batches=3)


def test_conversations(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(60), rng.randrange(9), "user", None) for _ in range(600)] + [(7, k, "x", "") for k in range(150)] + [(3, None, "x", "t"), (None, 3, None, None)]
    events = []
    for conv, turn, *_ in rows:
        if conv is not None and turn is not None:
            c, h = zlib.crc32(str(conv).encode()), zlib.crc32(f"{conv}:{turn}".encode())
            s, g = c // 2 % 7200 + 300 * turn + h % 600, h // 600
            events.append((2 * (conv // 8) + c % 2, s, s // 900 + (g % 4 if g % 5 == 0 else 0), h))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, sessions.op13(frame).collect())) == brute_versions(events)

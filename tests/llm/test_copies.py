"""Fingerprints, exact copies and near copies against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_words import prose

from strataline.llm import exact_dedup as X
from strataline.llm import fingerprints as P
from strataline.llm import jaccard_join as J
from strataline.llm.common import connected_components, text_buffers


def test_components_follow_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3), (102, 100), (100, 102)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == got[102] == 100 and len(got) == 64
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_and_random_graphs(spark):
    """Hubs of either end, and a random graph against union-find."""
    r = np.random.default_rng(4)
    edges = [(0, i) for i in range(1, 400)] + [(9000, 5000 + i) for i in range(400)] + [tuple(int(x) for x in r.integers(10_000, 10_400, 2)) for _ in range(260)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b and all(a not in e for e in edges if e != (a, b))}
    assert got == {x: find(x) for x in root if x not in loops}


def test_look_ups_beyond_broadcasts(spark, monkeypatch):
    from strataline.llm import common

    rows = spark.createDataFrame([(i, None if i % 10 == 0 else "hot" if i % 3 else f"k{i}") for i in range(300)], "i long, k string")
    known = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3), ("other", 4)], "k string, v int")
    want = sorted(map(tuple, common.looked_up(rows, known, "k", 10).collect()), key=str)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    assert sorted(map(tuple, common.looked_up(rows, known, "k", 10).collect()), key=str) == want and len(want) == 300


def test_quotient_filter_merges_without_loss():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 1 << 63, 4000).astype(np.uint64), r.integers(0, 1 << 63, 300).astype(np.uint64)
    b[:100] = a[:100]
    f = X.CountingQuotientFilter.build(np.concatenate([a, a[:50]]), 12)
    g = X.CountingQuotientFilter.build(b, 12)
    m = X.CountingQuotientFilter.load(f.merge(g).dump())
    whole = X.CountingQuotientFilter.build(np.concatenate([a, a[:50], b]), 12)
    assert (m.values() == whole.values()).all() and (m.counts == whole.counts).all()
    assert m.count(int(a[0])) == 3 and m.count(int(a[3000])) == 1 and m.count(12345) == 0
    parts = [X.CountingQuotientFilter.load(p.dump()) for _, p in whole.blocks(3)]
    assert np.concatenate([p.values() for p in parts]).tolist() == whole.values().tolist()


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    return {t: (max((x for x in ids if x is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("table", ["awkward", "copies"])
def test_exact_dedup(table, request):
    df = request.getfixturevalue(table)
    want, got = brute_exact(df.collect()), X.exact_dedup(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[r["text"] or ""] and r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert sum(r["kept"] for r in got) == len(want)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(X, "HOT_ROWS", 5)
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i % 9}") for i in range(60)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in X.exact_dedup(df).collect()}
    assert got[1]["keep_id"] == 59 and got[1]["group_size"] == 40 and sum(r["kept"] for r in got.values()) == 4


def test_exact_dedup_of_nothing(nothing):
    assert X.exact_dedup(nothing).count() == 0 and X.exact_dedup(nothing, carry=False).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(rows):
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    root = {i: i for i in range(len(sets))}
    links = defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, (d, _) in enumerate(sets):
        best[find(i)] = min(best.get(find(i), d), d)
    return {d: (len(s), best[find(i)], links[i]) for i, (d, s) in enumerate(sets)}


def near(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in J.jaccard_classes(df).collect()}


def test_jaccard_join_loses_no_link(copies):
    assert near(copies) == brute_near(copies.collect())


@pytest.mark.parametrize("size", [2, 3, 192])
def test_jaccard_join_does_not_depend_on_blocks(copies, size, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SETS", size)
    monkeypatch.setattr(J, "HOT_BUCKET", 4)
    assert near(copies) == brute_near(copies.collect())


def test_jaccard_join_by_passes(spark, copies, monkeypatch):
    from strataline.llm import common

    want, rows = near(copies), []
    monkeypatch.setattr(J, "BLOCK_SETS", 2)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 40 * J.WANTED_BYTES)
    made = J.maybe_broadcast

    def seen(df, n, row_bytes):
        assert common.small_enough(n, row_bytes)  # texts are never shuffled to find the wanted ones
        rows.append(n)
        return made(df, n, row_bytes)

    monkeypatch.setattr(J, "maybe_broadcast", seen)
    assert near(copies) == want and len(rows) > 1


def test_jaccard_join_of_awkward_rows(awkward, nothing):
    got = J.jaccard_classes(awkward).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == awkward.count() and J.jaccard_classes(nothing).count() == 0
    assert by[3]["component_id"] == by[4]["component_id"] == 3 and by[3]["n_links"] == 1
    assert by[1]["n_shingles"] == by[8]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[7]["n_links"] == 1
    assert by[5]["n_shingles"] == 1 and by[6]["n_shingles"] == 1


def test_parity_sketch_keys_meet_for_all_linked_pairs():
    """The pigeonhole argument on random sets of all sizes, with the worst allowed differences."""
    r = np.random.default_rng(1)
    heat = r.integers(1, 1000, J.HEAT_SLOTS).astype(np.int32)
    for size in [*range(1, 70), 100, 255, 256, 257, 700, 3000]:
        a = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64))
        for swap in range(0, size // 4 + 1, max(1, size // 12)):
            b = np.unique(np.concatenate([a[swap:], r.integers(0, 1 << 63, r.integers(0, swap + 2)).astype(np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if inter and 100 * inter >= 80 * (len(a) + len(b) - inter):
                assert set(J.segment_keys(a, heat)[0].tolist()) & set(J.segment_keys(b, heat)[0].tolist())


def test_shingle_sets_match_a_plain_count(copies, awkward):
    import pyarrow as pa

    texts = [r["text"] for r in copies.collect() + awkward.collect()]
    assert [len(s) for s in J.ngram_sets(*text_buffers(pa.array(texts, pa.string())))] == [len(shingles(t)) for t in texts]


def plain_anchors(spark, texts):
    """Closed syncmers in plain Python, over Spark's hashes of words and runs: text -> [(position, hash)]."""
    k, inner = P.K, P.S
    split = {t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts}
    padded = {t: [P.START] * (k - 1) + w + [P.END] * (k - 1) if w else [] for t, w in split.items()}
    words = sorted({w for p in padded.values() for w in p})
    word = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()} if words else {}
    hashed = {t: [word[w] for w in p] for t, p in padded.items()}

    def table(n, f):
        runs = sorted({tuple(h[i : i + n]) for h in hashed.values() for i in range(len(h) - n + 1)})
        columns = [f"c{j}" for j in range(n)]
        return {tuple(r[c] for c in columns): r["h"] for r in spark.createDataFrame(runs, ", ".join(f"{c} long" for c in columns)).withColumn("h", f(*columns)).collect()} if runs else {}

    small, large = table(inner, F.xxhash64), table(k, F.hash)
    whole = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for t in texts], "t string").distinct().select("t", F.hash("t").alias("h")).collect()}
    out = {}
    for t, h in hashed.items():
        found = []
        for i in range(len(h) - k + 1):
            inside = [small[tuple(h[j : j + inner])] for j in range(i, i + k - inner + 1)]
            if min(inside) in (inside[0], inside[-1]):
                found.append((i - k + 1, large[tuple(h[i : i + k])]))
        out[t] = found or ([(-k, whole[t])] if t else [])
    return out


def jaccard(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_fingerprints(spark, copies):
    texts = {r["doc_id"]: r["text"] or "" for r in copies.collect()}
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in P.edited_fingerprints(copies).collect()}
    assert len(got) == len(texts)
    edited = {}
    for k, d in enumerate(order):
        t, nxt = texts[d], texts[order[(k + 1) % len(order)]]
        edited[d] = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
    anchors = plain_anchors(spark, sorted({*texts.values(), *edited.values()}))
    written = lambda a: "".join(f"{h & 0xFFFFFFFF:08X}" for h in sorted({h for _, h in a}))
    for k, d in enumerate(order):
        r, a, e, nxt = got[d], anchors[texts[d]], anchors[edited[d]], anchors[texts[order[(k + 1) % len(order)]]]
        assert r["edited_sha256"] == hashlib.sha256(edited[d].encode()).hexdigest() and r["n_chars"] == len(texts[d])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (written(a), written(e))
        assert r["near_edited"] == pytest.approx(jaccard(a, e)) and r["near_next"] == pytest.approx(jaccard(a, nxt))
        assert r["in_place"] == pytest.approx(len(set(a) & set(e)) / len(set(a)) if a else 0)
    assert len({r["fingerprint"] for r in got.values()}) == len(set(texts.values()))


def test_fingerprints_of_any_ids(spark):
    """Ids that span all 64 bits, uneven ones, repeated ones and nulls."""
    low = -(1 << 63)
    rows = [(i, f"text number {i} with some words") for i in (low, low + 1, -5, 0, 0, 7, 8, 9, 10, 11, (1 << 63) - 1)] + [(None, "no id"), (None, "none")]
    got = P.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    text = dict(rows)
    for d, nxt in (((1 << 63) - 1, 11), (11, 10), (7, 0), (-5, low + 1)):
        t = text[d]
        assert by[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + text[nxt][: len(t) // 2]).encode()).hexdigest()


def test_aligned_passages(spark):
    passage = prose("passage", 60)
    rows = [(1, "x y " + passage, passage), (2, passage, "a b c d e f " + passage + " tail"), (3, passage, prose("other", 60, ["q", "zz", "yy"])), (4, None, passage), (5, passage, passage)]
    got = {r["i"]: (r["shift"], r["matched"]) for r in P.aligned(spark.createDataFrame(rows, "i int, a string, b string")).collect()}
    assert got[1][0] == -2 and got[1][1] > 15 and got[2][0] == 6 and got[2][1] > 15 and got[3] == (None, 0) and got[4] == (None, 0) and got[5][0] == 0
    anchors = plain_anchors(spark, [passage, rows[0][1]])
    first = [{}, {}]
    for side, t in enumerate((rows[0][1], passage)):
        for at, h in anchors[t]:
            first[side].setdefault(h, at)
    votes = defaultdict(int)
    for h in first[0].keys() & first[1].keys():
        votes[first[1][h] - first[0][h]] += 1
    assert got[1] == (min(votes, key=lambda x: (-votes[x], x)), max(votes.values()))


def test_runs_do_not_change_neighbours(spark, monkeypatch):
    df = spark.createDataFrame([(i * i, str(i)) for i in range(50)], "id long, text string")
    want = sorted(tuple(r) for r in P.with_next(df, ["text"]).collect())
    for rows in (1, 3, 7):
        monkeypatch.setattr(P, "RUN_ROWS", rows)
        assert sorted(tuple(r) for r in P.with_next(df, ["text"]).collect()) == want
    assert want[0] == (0, "0", "49") and want[5] == (25, "5", "4")


def test_syncmers_are_free_of_context(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    df = spark.createDataFrame([(text,), ("before that " + text,)], "text string")
    a, b = (r[0] for r in df.select(P.syncmer_anchors(F.col("text"))).collect())
    assert {(x["position"] + 2, x["hash"]) for x in a if x["position"] >= 0} <= {(x["position"], x["hash"]) for x in b} and len(a) >= 3


def test_fingerprints_of_awkward_rows(awkward, nothing):
    got = P.fingerprint_documents(awkward).collect()
    assert all(r["fingerprint"] == "" for r in got if not r["text"]) and all(r["fingerprint"] for r in got if r["text"])
    assert P.edited_fingerprints(awkward).count() == awkward.count() and P.edited_fingerprints(nothing).count() == 0
    plan = P.edited_fingerprints(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_results_do_not_depend_on_broadcasts(spark, copies, monkeypatch):
    from strataline.llm import common

    want_near, want_exact = near(copies), sorted(tuple(r) for r in X.exact_dedup(copies, carry=False).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert near(copies) == want_near
        assert sorted(tuple(r) for r in X.exact_dedup(copies, carry=False).collect()) == want_exact
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

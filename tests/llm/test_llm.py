import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import components, knn, mixing, neardup, overlap, packing, residue, sketch, splits, topn
from lodeseek.llm.tokens import encoding
from lodeseek.plans.stages import block_join


def brute_groups(pairs):
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            head[b] = a
    return {(find(x), x) for x in head}


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    pairs += [(None, 1), (7, 7), (1, None), (400, 401), (401, 400)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("group_id", F.lit("clash"))
    assert {tuple(x) for x in components.connected_groups(df, "a", "b").collect()} == brute_groups(pairs)
    assert components.connected_groups(df.filter("false"), "a", "b").count() == 0


def test_duplicate_groups(spark):
    links = spark.createDataFrame([(1, 2, 3), (2, 3, 3), (3, 2, 3), (4, 5, 1), (6, 99, 3), (7, 7, 3), (None, 1, 3), (1, 5, None)], "post_id long, related_post_id long, link_type_id int")
    q = spark.createDataFrame([(i,) for i in range(1, 9)] + [(None,)], "question_id long")
    assert sorted(map(tuple, components.duplicate_groups(links, q).collect())) == [(1, 1), (1, 2), (1, 3)]


@pytest.mark.parametrize("least", [20, 10_000])
def test_top_per_group(spark, least):
    r = random.Random(5)
    rows = [("hot", None, r.randrange(200), float(r.randrange(20))) for _ in range(600)] + [(g, 1, r.randrange(9), r.choice([None, float("nan"), 1.0, 2.0, -3.0])) for g in "abc" for _ in range(30)] + [("a", 1, None, 9.0)]
    df = spark.createDataFrame(rows, "g string, q long, item long, score double").withColumn("rank", F.lit(0)).withColumn("_r", F.lit(0))
    got = {(x["g"], x["q"], x["item"], x["rank"]) for x in topn.top_per_group(df, ["g", "q"], "item", "score", 10, least).collect()}
    best = {}
    for g, q, i, s in rows:
        if i is not None and s is not None and s == s:
            best.setdefault((g, q), {}).setdefault(i, []).append(s)
    want = {(g, q, i, n + 1) for (g, q), items in best.items() for n, i in enumerate(sorted(items, key=lambda i: (-max(items[i]), i))[:10])}
    assert got == want
    assert topn.top_per_group(df.filter("false"), ["g", "q"], "item", "score").count() == 0


def _texts(seed=1, n=12, copies=4):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(60)]
        for k in range(copies):
            t = list(base)
            for _ in range(k):
                t[r.randrange(60)] = r.choice(vocab)
            out.append(" ".join(t))
    return out


def _near(a, b, width, num, den, least):
    x, y = sketch.words(a), sketch.words(b)
    if min(len(x), len(y)) < least:
        return False
    s, t = ({tuple(z[i : i + width]) for i in range(len(z) - width + 1)} for z in (x, y))
    return len(s & t) * den >= len(s | t) * num


def test_sketch_estimates_similarity():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 300).astype(np.uint64)
    a, b = base[:225], base[75:]  # similarity 0.5
    owner = np.repeat([0, 1], [225, 225])
    s = sketch.fast_sketch(owner, np.concatenate([a, b]), 2, 512)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.1
    one = sketch.fast_sketch(np.zeros(1, np.int64), base[:1], 1, 64)
    assert (one != np.iinfo(np.uint64).max).all()


def test_near_duplicates(spark):
    texts = _texts() + [None, "", "short", "Same WORDS here, " * 8, "same words. HERE " * 8, "long " * 50_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[0], "x")]
    df = spark.createDataFrame(rows, "id long, text string, band string")
    got = {tuple(x) for x in neardup.near_duplicate_groups(df, 3, 3, 5, 20).collect()}
    assert got == brute_groups([(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if _near(texts[i], texts[j], 3, 3, 5, 20)])
    assert neardup.near_duplicate_groups(df.filter("false")).count() == 0


@pytest.mark.parametrize("hot, dense, stars", [(1, 64, 8), (20_000, 0, 2), (1, 0, 0)])
def test_near_duplicates_in_hot_bands(spark, monkeypatch, hot, dense, stars):
    """Every band hot or not, further stars or all pairs at once: the same groups as by brute force."""
    for name, value in (("SAMPLE", 1), ("HOT", hot), ("DENSE", dense), ("STARS", stars)):
        monkeypatch.setattr(neardup, name, value)
    monkeypatch.setattr(neardup, "block_join", lambda x, y, k: block_join(x, y, k, 3, 1))
    r = random.Random(31)
    common = [f"c{i}" for i in range(30)]
    texts = _texts(33, 4, 5)
    for k in range(60):  # chains of edits around a common text: bands shared by several groups
        t = common + [f"v{r.randrange(12)}" for _ in range(6 + k % 25)]
        r.shuffle(t) if k % 3 == 0 else None
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {tuple(x) for x in neardup.near_duplicate_groups(df, 3, 3, 5, 20).collect()}
    assert got == brute_groups([(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if _near(texts[i], texts[j], 3, 3, 5, 20)])


def test_overlaps(spark):
    t = _texts(7, 4, 2)
    rows = [(1, "A title?", t[0], " Training"), (2, "a TITLE", t[1], "DEV"), (3, "!!!", t[2], "test"), (4, "", t[3], "train"), (5, None, None, "val"), (6, "x", t[4], None), (7, "y", t[5], "train"), (8, "z", t[4], "testing"), (2, "a TITLE", t[1], "DEV")]
    df = spark.createDataFrame([(*r, "src") for r in rows], "question_id long, title string, text string, split string, label_source string")
    o = overlap.split_overlaps(df)
    assert sorted(map(tuple, overlap.found(o).collect())) == [(1, 2), (3, 4), (7, 8)]
    assert {(x[0], x[1]): (x[2], x[3]) for x in overlap.overlap_counts(df).collect()} == {("val", "src"): (1, 1), ("test", "src"): (2, 2)}
    assert overlap.split_overlaps(df.filter("false")).count() == 0 and overlap.overlap_counts(df.filter("false")).count() == 0


def test_overlap_counts(spark):
    """Classes of copies, titles and texts that match together or alone, sources, an id in two splits: as by expanded pairs."""
    r = random.Random(8)
    texts = _texts(17, 5, 3) + [None, "short"]
    rows = {(r.randrange(150), r.choice(["A", "b!", "c", None]) if k % 3 else f"t{k % 9}", r.choice(texts), r.choice(["train", "val", "test", None]), r.choice(["x", "y", None])) for k in range(160)}
    once = {}
    for row in sorted(rows, key=str):
        first = next((v for k, v in once.items() if k[0] == row[0]), row)
        if first is row or row[0] < 60:  # ids below 60 may lie in several splits
            once[row[0], row[3]] = (row[0], first[1], first[2], row[3], first[4])
    df = spark.createDataFrame(list(once.values()), "question_id long, title string, text string, split string, label_source string")
    pairs = overlap.split_overlaps(df).groupBy("eval_split", "label_source").agg(F.countDistinct("eval_id"), F.countDistinct("eval_id", "train_id"))
    assert sorted(map(tuple, overlap.overlap_counts(df).collect()), key=str) == sorted(map(tuple, pairs.collect()), key=str)


def test_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((300, 64)).astype(np.float32)
    x[50:65] = x[50]  # more copies than neighbours asked for
    x[70] = x[71] * 3
    rows = [(i, [float(z) for z in v]) for i, v in enumerate(x)]
    bad = [(900, None), (901, []), (902, [1.0]), (903, [0.0] * 64), (904, [float("nan")] * 64), (905, [float("inf")] * 64), (None, [1.0] * 64), (0, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "answer_id long, embedding array<float>").withColumn("code", F.lit(1))
    got = {}
    for z in knn.nearest_vectors(df, window=64).collect():
        got.setdefault(z["answer_id"], {})[z["rank"]] = z["neighbour_id"]
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    c = np.round(y @ y.T, 12)
    hits = 0
    for i in range(300):
        want = [j for j in sorted(range(300), key=lambda j: (-c[i, j], j)) if j != i][:10]
        hits += len(set(want) & set(got[i].values()))
    assert hits >= 0.98 * 3000 and set(got) == set(range(300))
    assert sorted(got[60].values()) == [*range(50, 60)]
    assert knn.nearest_vectors(df.filter("false")).count() == 0


def test_grouped_split(spark):
    r = random.Random(9)
    recs = [(i, [r.choice("abcd"), None] if i % 7 else None, r.choice(["train", "val", None])) for i in range(1000)] + [(0, ["a"], "train"), (None, ["a"], None)]
    own = [(i, r.randrange(120) if i > 300 else None) for i in range(1000)] + [(i, 500) for i in range(100)] + [(400, 501), (401, 501)]
    a, b = spark.createDataFrame(recs, "record long, labels array<string>, delivered string"), spark.createDataFrame(own, "record long, owner long")
    out = splits.grouped_split(a, b)
    got = {x["record"]: x["split"] for x in out.collect()}
    assert set(got) == set(range(1000))
    for o in {o for _, o in own if o is not None}:
        assert len({got[i] for i, z in own if z == o}) == 1
    share = {x["split"]: x["share"] for x in splits.split_shares(out).collect()}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["val"] - 0.1) < 0.03
    assert splits.grouped_split(a.filter("false"), b).count() == 0
    assert {x["name"]: x["n"] for x in splits.split_checks(out, b.select(F.col("record").alias("question_id"), F.col("owner").alias("owner_user_id")), bound=0.05).collect()}["owners in several splits"] == 0


def test_labels_are_balanced(spark):
    """A third of the records are one owner's, labels from a hundred records on keep the shares, rare ones reach every split."""
    r = random.Random(19)
    recs = [(i, [r.choice("abc"), f"x{r.randrange(30)}", *(["rare"] if i % 400 == 7 else [])], None) for i in range(6000)]
    own = [(i, -1 if i % 3 == 0 else i // 2) for i in range(6000)]
    out = splits.grouped_split(spark.createDataFrame(recs, "record long, labels array<string>, delivered string"), spark.createDataFrame(own, "record long, owner long"))
    share = {x["split"]: x["share"] for x in splits.split_shares(out).collect()}
    assert all(abs(share[s] - v) < 0.01 for s, v in (("train", 0.8), ("val", 0.1), ("test", 0.1)))
    for x in splits.label_shares(out).collect():
        if x["records"] >= 100:
            assert all(abs(x[s] - v) < 0.06 for s, v in (("train", 0.8), ("val", 0.1), ("test", 0.1))), x
    rare = next(x for x in splits.label_shares(out).collect() if x["label"] == "rare")
    assert rare["val"] > 0 and rare["test"] > 0


def test_packing(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["swap", "rate", "curve", "vol", "gamma", "the", "of"]) for _ in range(r.choice([3, 20, 60, 300]))) for _ in range(150)] + [None, "", " ", "é" * 700]
    docs = spark.createDataFrame([(i, t, r.choice(["a", "b", None]), "q") for i, t in enumerate(texts)] + [(None, "x", "a", "q")], "doc_id long, text string, source string, n_tokens string")
    boxes = spark.createDataFrame([("s", 64), ("l", 256), ("bad", None), ("zero", 0)], "container_name string, capacity_tokens int")
    rows = packing.pack(docs, boxes).collect()
    enc = encoding()
    for name, cap in (("s", 64), ("l", 256)):
        by, use = {}, {}
        for x in rows:
            if x["container_name"] == name:
                by.setdefault(x["doc_id"], []).append((x["start_token"], x["n_tokens"]))
                use[x["container_id"]] = use.get(x["container_id"], 0) + x["n_tokens"]
        assert max(use.values()) <= cap
        for i, t in enumerate(texts):
            n = len(enc.encode_ordinary(t)) if t else 0
            spans = sorted(by.get(i, []))
            assert sum(s for _, s in spans) == n and all(a + s == b for (a, s), (b, _) in zip(spans, spans[1:]))
            assert len(spans) == (-(-n // cap) if n > cap else min(n, 1))
        assert sum(use.values()) / (cap * len(use)) > 0.9
    assert packing.pack(docs.filter("false"), boxes).count() == 0
    assert packing.filling(packing.pack(docs, boxes), boxes).filter("unused_tokens < 0").count() == 0


def test_mixing(spark):
    docs = [(i, "word " * (5 + i % 30), "abcde"[min(4, i % 40)] if i % 11 else None) for i in range(3000)] + [(9000, None, "a"), (9001, "", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("rate", F.lit(0))
    t = spark.createDataFrame([("a", 3.0, 4), ("b", 1.0, 2), ("e", 6.0, 1), ("none", 2.0, 2), ("c", None, 1)], "source string, target_weight double, max_repeats int")
    rows, shares = mixing.mix(df, t)
    s = {x["source"]: x for x in shares.collect()}
    assert set(s) == {"a", "b", "e"}
    for x in s.values():
        assert abs(x["actual_share"] - x["target_share"]) < 0.01
    cap = {"a": 4, "b": 2, "e": 1}
    assert all(x["n"] <= cap[x["source"]] for x in rows.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n")).collect())
    assert mixing.mix(df.filter("false"), t)[0].count() == 0
    over = {x["source"]: x for x in mixing.mix(df, t, 10**7)[1].collect()}
    assert all(x["tokens"] == x["available_tokens"] * cap[k] for k, x in over.items())


def test_mixing_does_not_depend_on_length(spark):
    """Half of the total asked for can be met; the source at its cap falls short, the others keep their proportions."""
    r = random.Random(4)
    docs = [(i, "word " * r.choice([5, 10, 400]), "ab"[i % 2]) for i in range(6000)] + [(i, "word " * 20, "c") for i in range(7000, 7100)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 3), ("b", 2.0, 2), ("c", 0.5, 1)], "source string, target_weight double, max_repeats int")
    rows, shares = mixing.mix(df, t, 700_000)
    s = {x["source"]: x for x in shares.collect()}
    assert s["c"]["tokens"] == s["c"]["available_tokens"]
    assert abs(s["a"]["tokens"] / s["b"]["tokens"] - 0.5) < 0.005
    lengths = {i: len(x.split()) for i, x, _ in docs}
    for source in "ab":
        used = [lengths[x["doc_id"]] for x in rows.filter(F.col("source") == source).collect()]
        share = {n: used.count(n) / len(used) for n in (5, 10, 400)}
        assert all(abs(share[n] - 1 / 3) < 0.05 for n in share)


def test_mixing_distribution():
    for mean, top in ((0.3, 1), (0.9, 1), (1.7, 2), (2.0, 5), (0.01, 4)):
        rate = mixing.rate_for(mean, top)
        cdf = mixing.distribution(rate, top)
        u = (np.arange(100_000) + 0.5) / 100_000
        assert abs((u[:, None] > np.array(cdf)[None]).sum(1).mean() - mean) < 1e-3


def test_residue(spark):
    bad = ["Dear {{ name }}, your note was moved.", "The [TODO: desk] curve is steep.", "Lorem ipsum dolor sit amet, porta morbi nullam.", "403 Forbidden\n\nYou do not have permission to view this post.\n\nRay: c8cef0fe", "Skip to content\n\nPlease turn on JS and cookies to continue.\nReload", "POUR CONTINUER, IL FAUT AUTORISER LES SCRIPTS ET LES COOKIES DANS LE NAVIGATEUR.", "foo bar foo bar foo bar", "Section 1: text\nItem 2: tbd", "Um fortzufahren, Skripte im Browser aktivieren."]
    good = ["Our job replaces `{{name}}` by the desk.", "```\n<td>{{ value }}</td>\n```\nWhy is it empty?", "We write $dF = {\\sigma} dW$ and ${{S_{t}}}$.", "JavaScript? No, plain SQL over the horizon table.", "My session expired before the boundary fixing.", "See [1] and [Smith, section 6] for the drift on [0, T].", "No.", "", None, "The feed says 'access denied' although the key is valid and the vendor sees no request from us at all.\nPlease enable JavaScript to view the comments."]
    df = spark.createDataFrame(list(enumerate(bad + good)) + [(None, bad[0]), (0, bad[0])], "doc_id long, text string").withColumn("words", F.lit(1))
    assert sorted(x["doc_id"] for x in residue.template_residue(df).collect()) == [*range(len(bad))]
    assert residue.template_residue(df.filter("false")).count() == 0


def test_packing_repeated_ids(spark):
    rows = [(1, " swap" * 31, "a"), (1, " rate" * 101, "b"), (1, " rate" * 101, "b"), (2, " vol" * 70, None), (2, " vol" * 70, None), (3, " fx" * 5, "a"), (3, " cds" * 5, "a")]
    df, boxes = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([("s", 64)], "container_name string, capacity_tokens int")
    got = {}
    for x in packing.pack(df, boxes).collect():
        got.setdefault(x["doc_id"], []).append((x["start_token"], x["n_tokens"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, 64), (64, 37)], 2: [(0, 64), (64, 6)], 3: [(0, sum(n for _, n in got[3]))]}


def test_packing_scores_every_term():
    # item 1 shares the 28 common terms of the seed, item 2 three rare ones
    terms = [np.arange(40, dtype=np.uint32), np.arange(12, 40, dtype=np.uint32), np.array([0, 1, 2, *range(50, 75)], np.uint32)]
    by_term = np.full(80, 20)
    by_term[:12] = 10
    boxes = packing.fill(np.array([40, 28, 28]), terms, [np.ones(len(t), np.uint32) for t in terms], 68, packing.Statistics(1000, 30.0, by_term))
    assert boxes == [[0, 1], [2]]


def test_packing_scores_against_full_bm25():
    r = np.random.default_rng(6)
    tokens = [np.minimum(r.zipf(1.3, r.integers(1, 90)), 500).astype(np.uint32) for _ in range(80)]
    terms, tfs = zip(*(np.unique(t, return_counts=True) for t in tokens))
    by_term = np.bincount(np.concatenate(terms), minlength=501)
    sizes = np.array([len(t) for t in tokens])
    index = packing.Index(sizes, list(terms), list(tfs), packing.Statistics(80, float(sizes.mean()), by_term))
    seed = int(np.argmax(sizes))
    got = dict(zip(index.items.tolist(), index.scores(terms[seed], 60)))
    for i in np.flatnonzero(sizes <= 60):
        want = 0.0
        for t, f in zip(terms[i], tfs[i]):
            if t in terms[seed]:
                want += np.log(1 + (80 - by_term[t] + 0.5) / (by_term[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sizes[i] / sizes.mean()))
        assert got[i] == pytest.approx(want)


def test_packing_keeps_term_frequencies():
    import pandas as pd

    pdf = next(packing.items_of([4096], packing.DEFAULT)(iter([pd.DataFrame({"doc_id": [1], "source": ["a"], "text": [" word" * 700]})])))
    assert np.frombuffer(pdf["tf"][0], "<u4").tolist() == [700]


def _recall(spark, x, asked, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "answer_id long, embedding array<float>")
    got = {}
    for z in knn.nearest_vectors(df, **kw).filter(F.col("answer_id").isin(asked)).collect():
        got.setdefault(z["answer_id"], set()).add(z["neighbour_id"])
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    hits = 0
    for i in asked:
        c = np.round(y @ y[i], 12)
        want = [j for j in np.lexsort((np.arange(len(x)), -c))[:11].tolist() if j != i][:10]
        hits += len(got[i] & set(want))
    return hits / (10 * len(asked))


def test_neighbours_in_a_dense_group(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((1800, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:1200] = x[0] + r.standard_normal((1200, 4)) @ r.standard_normal((4, 64)) * 0.0002
    assert _recall(spark, x.astype(np.float32), list(range(0, 1200, 24)), window=48) > 0.9


def test_neighbours_do_not_depend_on_partitions(spark):
    """Windows far smaller than a curve, blocks of 512, so that borders of blocks and partitions lie everywhere."""
    r = np.random.default_rng(21)
    x = (r.standard_normal((60, 64))[r.integers(0, 60, 4000)] + 0.4 * r.standard_normal((4000, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "answer_id long, embedding array<float>")
    was, block, got = spark.conf.get("spark.sql.shuffle.partitions"), knn.BLOCK, []
    try:
        knn.BLOCK = 512
        for n in ("4", "100"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({tuple(z) for z in knn.nearest_vectors(df, window=24, curves=2, rounds=2, recall=1.0).collect()})
        assert got[0] == got[1]
        spark.conf.set("spark.sql.shuffle.partitions", was)
        assert _recall(spark, x, list(range(0, 4000, 40)), window=128) >= 0.95
    finally:
        knn.BLOCK = block
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_hilbert_keys_refine():
    q = np.random.default_rng(3).integers(0, 1 << 20, (200, 16))
    fine, coarse = knn.hilbert_keys(q, 20), knn.hilbert_keys(q >> 15, 5)
    assert all(f[:10] == c for f, c in zip(fine, coarse)) and len(set(fine)) == 200 and len(fine[0]) == 40
    walk = sorted(itertools.product(range(8), repeat=3), key=lambda p: knn.hilbert_keys(np.array([p]), 3)[0])
    assert all(sum(abs(a - b) for a, b in zip(p, n)) == 1 for p, n in zip(walk, walk[1:]))


def test_neighbours_by_default():
    import inspect

    given = {n: p.default for n, p in inspect.signature(knn.nearest_vectors).parameters.items()}
    assert given["curves"] * given["rounds"] >= 48 and given["recall"] >= 0.95
    assert all(len(z) == given["dims"] * given["bits"] // 8 for z in knn.hilbert_keys(np.zeros((2, given["dims"])), given["bits"]))


def test_neighbours_of_one_direction(spark):
    r = np.random.default_rng(12)
    x = r.integers(-50, 50, (200, 64)).astype(np.float32)
    x[60:180] = x[60] * np.arange(1, 121)[:, None]  # more than a window
    assert _recall(spark, x, list(range(60, 180, 5)), window=16) == 1


@pytest.mark.parametrize("times", [1, 100])
def test_residue_of_any_length(times):
    page = "Internal server error\n" + "\n".join(f"    at desk.board.Reply(Reply.java:{i})" for i in range(5 * times))
    assert residue.is_residue(page)
    assert residue.is_residue("test asdf " * 10 * times)
    assert residue.is_residue("Error 404\n" + "=" * 20 * times)
    assert not residue.is_residue(page + "\n" + "The curve was built twice because the feed restarted. " * 10 * times)


def test_residue_long_quotation():
    assert not residue.is_residue('They wrote "' + "the desk moved the curve " * 30 + 'for {{ name }}" and then closed the thread.')

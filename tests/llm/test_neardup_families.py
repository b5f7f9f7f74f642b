"""Near-duplicates inside large families whose other members stay just below the threshold."""

import random

from tidewell.llm import neardup

from .test_operators import brute_groups


def test_links_inside_a_family_below_the_threshold(spark):
    rng = random.Random(31)
    n = 0

    def fresh(k):
        nonlocal n
        n += k
        return [f"u{n - i}" for i in range(k)]

    template, texts = fresh(260), {}
    for _ in range(150):  # pairs of 0.80 to 0.85; across pairs 0.75 to 0.79
        own = fresh(rng.randrange(34, 38))
        for cut in (0, len(own) - rng.randrange(5, 9)):
            texts[len(texts)] = " ".join(template + own[: len(own) - cut] + fresh(cut))
    sets = [set(zip(*[t.split()[i:] for i in range(4)], strict=False)) for t in texts.values()]
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(0.8 <= near(i, i + 1) <= 0.86 for i in range(0, 300, 2))
    assert all(0.74 <= near(i, k) < 0.8 for i in range(0, 300, 7) for k in range(300) if i // 2 != k // 2)
    rows = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_groups(texts)


def test_blocks_of_a_common_element(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SALTED", 7)
    rng = random.Random(32)
    sets = {i: sorted(set(rng.sample(range(40), 30))) for i in range(120)}
    df = spark.createDataFrame(list(sets.items()), "doc_id long, shingles array<long>")
    labels = spark.createDataFrame([(i, i) for i in sets], "doc_id long, component long")
    got = {(r.a, r.b) for r in neardup.prefix_candidates(df, labels, 80).collect()}
    both = lambda a, b: len({*sets[a]} & {*sets[b]})
    want = {(a, b) for a in sets for b in sets if a < b and 100 * both(a, b) >= 80 * (60 - both(a, b))}
    assert want and want <= got and all(a < b for a, b in got)


def test_crowds_of_near_pairs_lose_no_link(spark):
    """8000 documents that share 300 words, in 4000 pairs of 0.85 or more; across pairs the similarity is below 0.8."""
    rng = random.Random(53)
    common, texts, n = " ".join(f"c{i}" for i in range(300)), {}, 0
    for p in range(4000):
        own = [f"u{n + i}" for i in range(rng.randrange(41, 50))]
        n += 100
        for k in range(2):
            w = [*own]
            for i in rng.sample(range(len(w)), 2) if k else []:
                w[i] = f"x{n}y{i}"
            texts[2 * p + k] = f"{common} {' '.join(w)}"
    rows = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), 1).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i - i % 2 for i in texts}


def test_rows_that_repeat_a_doc_id(spark):
    rows = [(1, "a b c d e f", 1), (1, "g h i j k l", 2), (1, "g h i j k l", 2), (2, "a b c d e f", 3), (3, "p q r s t u", 4), (3, None, 5), (None, "a b c d e f", 6), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more long")
    got = [sorted((r.doc_id or 0, r.text or "", r.more) for r in neardup.drop_near_duplicates(df.repartition(k)).collect()) for k in (1, 3)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [0, 0, 1, 3]
    assert neardup.rows_of(df, spark.createDataFrame([(1,)], "doc_id long"), "left_semi").count() == 3


def test_many_ids_are_shuffled(spark, monkeypatch):
    df = spark.range(50).selectExpr("id AS doc_id", "concat('t', id) AS text")
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 3)
    ids = spark.range(0, 50, 5).selectExpr("id AS doc_id")
    for how, n in (("left_semi", 10), ("left_anti", 40)):
        out = neardup.rows_of(df, ids, how)
        assert out.count() == n and "ResolvedHint" not in out._jdf.queryExecution().analyzed().toString()


def test_links_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    """Buckets of one group give each member links to many others; all but a few say nothing new."""
    rng = random.Random(54)
    base, texts, seen = [f"w{i}" for i in range(300)], {}, []
    for i in range(400):
        w = [*base]
        for at in rng.sample(range(300), 3):
            w[at] = f"u{i}x{at}"
        texts[i] = " ".join(w)
    plain = neardup.components
    monkeypatch.setattr(neardup, "components", lambda links: seen.append(links.distinct().count()) or plain(links))
    rows = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_groups(texts)
    assert 0 < sum(seen) < 2 * len(texts)


def test_components_are_put_together(spark):
    found = spark.createDataFrame([(2, 1), (3, 1), (6, 5), (9, 8)], "node long, component long")
    links = spark.createDataFrame([(3, 6), (4, 6), (2, 3), (10, 11)], "a long, b long")
    got = {r.node: r.component for r in neardup.put_together(found, links).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 9: 8, 11: 10}


def test_candidates_are_made_across_components_only(spark):
    """Members of one component need no pair, in small buckets and in crowded ones."""
    crowd = neardup.SMALL + 20
    rows = [(1, i, i % 2) for i in range(6)] + [(2, i, 0) for i in range(0, 6, 2)] + [(3, i, i % 2) for i in range(crowd)] + [(4, i, 1) for i in range(1, 2 * crowd, 2)]
    keys = spark.createDataFrame(rows, "key long, doc_id long, component long")
    for pivots in (1, 2):
        pairs, crowded = neardup.bucket_candidates(keys, pivots)
        got = [(r.a, r.b) for r in pairs.collect()]
        assert len(got) == len(set(got)) and all(a < b and a % 2 != b % 2 for a, b in got)
        assert {(a, b) for a in range(6) for b in range(a + 1, 6) if a % 2 != b % 2} <= set(got)
        assert crowd // 2 <= len(got) <= 9 + pivots * crowd // 2
        assert {r.key for r in crowded.collect()} == {3}

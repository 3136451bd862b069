import random
import re

import numpy as np
import pytest

from fernglass.llm import shingles as shingles_module
from fernglass.llm.components import components
from fernglass.llm.shingles import CountTree, count_vectors, enough, forest, link_documents
from tests.llm.conftest import prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(texts, n=4, percent=85):
    """Sorted (id, size, component) of every row."""
    sets, ids = [shingles(t, n) for _, t in texts], [LAST if i is None else i for i, _ in texts]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for x, i in enumerate(ids):
        least[root(x)] = min(least.get(root(x), LAST), i)
    back = lambda i: None if i == LAST else i
    return sorted(((back(ids[x]), len(sets[x]), back(least[root(x)])) for x in range(len(sets))), key=str)


def got(df):
    return sorted((tuple(r)[:3] for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "percent", "limit"), [(4, 85, 2048), (5, 80, 2), (1, 50, 3)])
def test_same_components_as_brute_force(make, corpus, n, percent, limit):
    out = link_documents(make(corpus).repartition(5), n=n, percent=percent, limit=limit, part_bytes=4000)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "text_hash", "component"]
    assert got(out) == brute(corpus, n, percent)


def test_chains_connect_without_direct_links(make):
    rng = random.Random(1)
    words = prose(rng, 60).split(" ")
    texts = []
    for i in range(30):
        words = words[:]
        words[i * 2] = f"changed{i}"
        texts.append((100 - i, " ".join(words)))
    assert got(link_documents(make(texts))) == brute(texts)


def test_crowded_buckets_lose_no_link_with_other_tasks(spark, make, monkeypatch):
    """Sets whose only first token is crowded in one task link with its followers from another task."""
    monkeypatch.setattr(shingles_module, "CROWD", 1)
    rng = random.Random(6)
    common = [f"g{i}" for i in range(40)]
    texts = [" ".join([*common, f"u{i}"]) for i in range(30)]
    for i in range(15):
        for _ in range(6):
            held = rng.sample(common, 6)
            texts += [" ".join([f"x{i}", *held[:5]]), " ".join([f"x{i}", *held])]
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or one task has all of so few rows
    try:
        assert got(link_documents(make(texts).repartition(3), n=1, part_bytes=2000)) == brute(texts, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("crowd", "limit"), [(3, 4), (256, 2048)])
def test_many_holders_of_one_token(spark, make, monkeypatch, crowd, limit):
    """More holders of a token than a task sends on, or than a bucket's tree takes: of fitting and of other sizes, linked
    directly, by chains, and not at all."""
    monkeypatch.setattr(shingles_module, "CROWD", crowd)
    monkeypatch.setattr(shingles_module, "LIMIT", limit)
    rng = random.Random(16)
    n = 100 if crowd < 9 else 2600
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(n):
        kind, own = i % 4, [f"o{i}w{j}" for j in range(60)]
        if kind < 2:  # near copies of one set
            texts.append(["rare", *base[:40], f"n{rng.randrange(20)}"])
        elif kind == 2:  # sizes that rise step by step, each a part of the next
            texts.append(["rare", *base[: rng.randint(3, 60)]])
        else:
            texts.append(["rare", *own[: rng.randint(1, 60)]])
    texts = [(i, " ".join(t)) for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = got(link_documents(make(texts).repartition(4), n=1, limit=limit, part_bytes=3000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out == brute(texts, 1)


def test_a_large_group_of_near_copies_is_joined_in_few_steps(make, monkeypatch):
    """400 sets that all link, by tasks of 10: not every two of 40 blocks meet. Sets that only chain to them still do."""
    steps, joins = [], shingles_module._joins

    def counted(rows, dealt, n, percent):
        steps.append(dealt.filter("x <> ''").select("label", "x", "y").distinct().count())
        return joins(rows, dealt, n, percent)

    monkeypatch.setattr(shingles_module, "_joins", counted)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join([*base, f"n{i}"]) for i in range(400)]
    texts += [" ".join([*base[k:], *(f"s{j}" for j in range(k)), "n0"]) for k in range(4, 24, 4)]  # each like the one before
    texts = list(enumerate(texts))
    assert got(link_documents(make(texts).repartition(3), n=1, limit=10)) == brute(texts, 1)
    assert sum(steps) <= 200, steps  # of 861 pairs of blocks


@pytest.mark.parametrize(("n", "percent", "holders", "of_task"), [(4, 85, 16, 4), (5, 80, 2, 1), (1, 50, 3, 2)])
def test_large_sets_lose_no_link(spark, make, corpus, monkeypatch, n, percent, holders, of_task):
    """Sets on both sides of the size from which first tokens are counted, that few and that many others share."""
    monkeypatch.setattr(shingles_module, "FAR_HOLDERS", holders)
    monkeypatch.setattr(shingles_module, "FAR_OF_TASK", of_task)
    rng = random.Random(21)
    texts = list(corpus)
    for k in range(120):  # sets of rising size and growing difference, by the least overlap and less
        words = [f"{k % 8}w{j}" for j in range(rng.randint(30, 60))]
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            words[rng.randrange(len(words))] = f"own{k}x{rng.randrange(99)}"
        texts.append((10_000 + k, " ".join(words)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = got(link_documents(make(texts).repartition(4), n=n, percent=percent, part_bytes=4000, far=45))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out == brute(texts, n, percent)


def test_links_share_the_first_tokens_that_are_counted():
    rng = np.random.default_rng(8)
    sizes, met = rng.integers(20, 90, (400, 2)), 0
    for percent in (50, 80, 85):
        for a, b in sizes.tolist():
            common = -(-percent * (a + b) // (100 + percent))
            if common > min(a, b):
                continue
            tokens = rng.permutation(300)[: a + b - common]
            x, y = np.sort(tokens[:a]), np.sort(tokens[a - common :])
            first = [s[: len(s) - -(-percent * len(s) // 100) + 1] for s in (x, y)]
            assert len(np.intersect1d(*first)) >= shingles_module.least_shared(np.array([a]), np.array([b]), percent)[0] >= 1
            met += 1
    assert met > 300


def test_a_large_set_is_not_sent_once_a_token(make, monkeypatch):
    """Near copies of 900 words share over 100 first tokens, which go to as many parts: their counts don't."""
    sent, buckets = [], shingles_module._buckets

    def watched(*args):
        out = buckets(*args)
        sent.append(sum(len(r.counts) for r in out.select("counts").collect()))
        return out

    monkeypatch.setattr(shingles_module, "_buckets", watched)
    texts = []
    for i in range(6):
        words = [f"w{i}x{j}" for j in range(900)]
        texts += [" ".join(words), " ".join([*words[:-3], f"z{i}"])]
    texts = list(enumerate(texts))
    assert got(link_documents(make(texts).repartition(3), part_bytes=200)) == brute(texts)
    assert sum(sent) <= sum(len(t) for _, t in texts), sent


def test_the_sketch_grows_with_the_text(make, monkeypatch):
    """So many slots that what comes together by chance doesn't hide which tokens are common, summed over tasks."""
    seen, sketch = [], shingles_module._sketch_of

    def watched(scan, slots, total):
        seen.append((slots, sketch(scan, slots, total)))
        return seen[-1][1]

    monkeypatch.setattr(shingles_module, "_sketch_of", watched)
    for name, v in (("SLOT_BYTES", 4), ("SKETCH", 1 << 14), ("SKETCH_MOST", 1 << 20), ("COUNTED", 500), ("SUMMED_BYTES", 60_000)):
        monkeypatch.setattr(shingles_module, name, v)
    texts = [(i, " ".join(["every", *(f"v{i}x{j}" for j in range(200 if i % 2 else 220))])) for i in range(100)]
    total = sum(len(t) for _, t in texts)
    assert got(link_documents(make(texts).repartition(3), n=1)) == brute(texts, 1)
    (slots, classes), = seen
    assert total // 4 < slots <= total // 2 and len(classes) == slots
    counts = np.zeros(slots, int)
    for _, t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        counts += np.bincount(shingles_module.slots_of(shingles_module.Sets(data, np.array([0, len(data)]), 1).token, slots), minlength=slots)
    assert (classes == shingles_module.classes_of(counts)).all() and classes.max() >= 8 * np.log2(100) - 1
    assert (shingles_module.rarity_of(classes) == classes).all()  # most slots are empty


def test_stones_leave_no_gap():
    rng = np.random.default_rng(9)
    for _ in range(50):
        sizes = np.sort(rng.integers(1, 200, rng.integers(1, 60)))
        for run in shingles_module.size_runs(sizes, 80):
            own = sizes[run]
            kept = own[shingles_module.stones(own, 80)]
            assert kept[0] == own[0] and kept[-1] == own[-1] and (100 * kept[:-1] >= 80 * kept[1:]).all()
        assert sum(map(len, shingles_module.size_runs(sizes, 80))) == len(sizes)


def test_buckets_visit_only_parts_that_have_sets(make, corpus):
    """The table of parts isn't walked through: a number of parts that couldn't be."""
    assert got(link_documents(make(corpus[:20]).repartition(2), part_bytes=1)) == brute(corpus[:20])


def test_empty_table(make):
    assert link_documents(make([])).count() == 0


def test_the_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 80)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(700)]
    size = np.array([len(s) for s in sets])
    counts = count_vectors(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), len(sets), 16)
    tree = CountTree(counts, size, 40)
    assert len(tree.levels) >= 2
    for i in range(0, 700, 23):
        want = np.flatnonzero(enough(np.minimum(counts, counts[i]).sum(1), size[i], size, 40))
        assert sorted(tree.near(counts[i], size[i])) == want.tolist()


def test_forest_connects_what_links_connect():
    rng = random.Random(3)
    base = [rng.sample(range(10**6), 40) for _ in range(5)]
    sets = [np.unique(np.array([x if rng.random() > 0.05 else rng.randrange(10**6) for x in rng.choice(base)], np.uint64)) for _ in range(60)]
    find = lambda pairs: _labels(len(sets), pairs)
    every = [(a, b) for a in range(60) for b in range(a) if enough(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 80)]
    found = forest(sets, 80)
    assert find(found) == find(every) and set(map(frozenset, found)) <= set(map(frozenset, every)) and len(found) < 60


def _labels(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + rng.randrange(1, 30)) for _ in range(60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    label = _labels(500, pairs)
    met = {x for p in pairs if p[0] != p[1] for x in p}
    for most in (1 << 20, 30, 1):  # in one task, after some rounds, by rounds alone
        rows = components(spark.createDataFrame(pairs, "a long, b long").repartition(3), most=most).collect()
        assert dict(rows) == {x: label[x] for x in met} and len(rows) == len(met)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

"""Line and near dedup, decontamination, sharding against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from archivolt.llm import line_dedup as L
from archivolt.llm import mapped as M
from archivolt.llm.base import Shared
from archivolt.llm.components import Union, components, forest
from archivolt.llm.decontaminate import decontaminate, without, words
from archivolt.llm.line_dedup import key_hash, line_dedup, line_key
from archivolt.llm.near_dedup import near_dedup
from archivolt.llm.shards import pack, shard
from archivolt.llm.sketch import shingles, sketches

SHA = lambda x: hashlib.sha256(x.encode()).hexdigest()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# -- near dedup -------------------------------------------------------------------


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_rows(seed, n_groups=12, size=8):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(n_groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((k, " ".join(w).upper() if rng.random() < 0.1 else "  ".join(w)))
            k += 1
    return [*rows, (k, None), (k + 1, " \n "), (k + 2, "one two"), (k + 3, "One\ttwo"), (k + 4, "one two three")]


@pytest.mark.parametrize(("percent", "block", "elements"), [(85, 1024, 1 << 23), (80, 16, 1 << 23), (80, 1024, 1000)])
def test_components_as_by_brute_force(spark, percent, block, elements):
    """block 16, elements 1000: clusters are dealt to several jobs."""
    rows = near_rows(5) if percent == 85 else near_rows(7, 4, 40)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, component_id int, keys int").repartition(3)
    got = {r["doc_id"]: r for r in near_dedup(df, percent=percent, block=block, elements=elements).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(rows, percent)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def loose_rows(n, seed=1):
    """Texts of one frame, alike enough to share bands and not to be linked, and some copies of them with a word changed."""
    rng = random.Random(seed)
    frame = [f"f{i}" for i in range(80)]
    rows = [(i, " ".join([*frame[: 40], *(f"u{i}x{j}" for j in range(30)), *frame[40:]])) for i in range(n)]
    for i in range(0, n, 10):
        w = rows[rng.randrange(n)][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((n + i, " ".join(w)))
    return rows


def test_large_loose_clusters_take_near_linear_work(spark, monkeypatch):
    """Nodes given to the last jobs: some for each copy, not the square of the cluster. And no link is lost."""
    from archivolt.llm import near_dedup as N

    jobs, work = N._jobs, []

    def counted(rows, percent):
        work[-1].append(rows.count())
        return jobs(rows, percent)

    monkeypatch.setattr(N, "_jobs", counted)
    for n in (600, 1800):
        work.append([])
        rows = loose_rows(n)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup(df, block=64).collect()}
        if n == 600:
            assert got == {i: c for i, (_, c) in brute_components(rows, 80).items()}
        assert sum(i != c for i, c in got.items()) == n // 10
        assert len(work[-1]) == 2 and work[-1][0] >= 2 * n  # one large cluster, all of it outside any component
    assert work[1][1] < 4 * work[0][1] < 4 * 5 * 600


def test_near_dedup_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_dedup(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "x y z u v w"), (9, "x y z u v w"), (2, "a b c d e f")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(None, None, True), (4, 2, False), (4, 2, False), (9, 2, False), (2, 2, True)], key=repr)


def test_sketch_estimates_similarity():
    """Also for sets far smaller than the sketch: no coordinate stays empty."""
    rng = np.random.default_rng(3)
    for n in (1, 3, 40, 500):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.concatenate([a[: max(1, int(0.8 * n))], rng.integers(0, 1 << 63, n - max(1, int(0.8 * n))).astype(np.uint64)])
        s = sketches([a, b, np.empty(0, np.uint64)], 240)
        assert (s[:2] != 0xFFFFFFFFFFFFFFFF).all() and (s[2] == 0xFFFFFFFFFFFFFFFF).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.15
    assert shingles("A b c d e") .tolist() == shingles("a B c D e").tolist()


def test_components_of_long_paths(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = list(zip(order, order[1:], strict=False)) + [(1000, 1001), (1002, 1001), (5000, 5000)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in components(Shared(spark), df).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000, 1002: 1000}
    assert components(Shared(spark), df.limit(0)).collect() == []


def test_few_links_need_no_rounds_whatever_the_partitions(spark):
    shared = Shared(spark)
    df = spark.createDataFrame([(i, i + 1) for i in range(2000)], "a long, b long").repartition(16)
    got = components(shared, df)
    assert shared.n == 3  # the tasks' forests, the forest of these, and the smallest neighbours that settle it
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(2001)}


@pytest.mark.parametrize("room", [20, 300])
def test_components_of_links_beyond_a_task(spark, room):
    shared = Shared(spark)
    df = spark.createDataFrame([(i, i + 1) for i in range(700) if i % 70] + [(i, i - 7) for i in range(1000, 1200)], "a long, b long").repartition(16)
    want = Union()
    for r in df.collect():
        want.link(r["a"], r["b"])
    assert {tuple(r) for r in components(shared, df, room).collect()} == {(x, want.root(x)) for r in df.collect() for x in r}
    assert shared.n > 3


@pytest.mark.parametrize("room", [2, 1 << 20])
def test_components_of_random_links(spark, monkeypatch, room):
    """Also where a task forgets its union-find again and again, with a hot node and repeated links."""
    rng = random.Random(room)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, x) for x in range(2000, 2100)] * 2
    monkeypatch.setattr(forest, "__defaults__", (room,))
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    own = Union()
    for x, y in links:
        own.link(x, y)
    got = [(r["node"], r["component"]) for r in components(Shared(spark), df).collect()]
    assert sorted(got) == sorted((x, own.root(x)) for x in {x for x, y in links if x != y} | {y for x, y in links if x != y})


# -- line dedup -------------------------------------------------------------------


def brute_lines(rows, least):
    blank = " \t\n\x0b\x0c\r"
    seen = Counter(k for _, t in rows for k in {low(x.strip(blank)) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (k := low(x.strip(blank))) or seen[k] < least]
        out.append((i, len(lines), len(lines) - len(kept), SHA("\n".join(kept))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_keys", [1 << 18, 8])
def test_lines_as_by_brute_force(spark, shard_keys):
    """8: many shards."""
    rng = random.Random(2)
    common = ["Home | About", "  HOME | about\t", "©2020", "É", "é", ""]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(60)}" for _ in range(rng.randint(1, 9)))) for i in range(80)]
    rows += [(None, "Home | About\nown"), (3, "Home | About"), (3, "Home | About"), (90, None), (91, ""), (92, "\n\n"), (93, "x" * 20_000 + "\nHome | About")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, row int").repartition(3)
    out = line_dedup(df, min_docs=5, shard_keys=shard_keys, full=True, extra=("row",)).collect()
    assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in out], key=repr) == brute_lines(rows, 5)
    assert all(r["x0"] == 5 and SHA(r["kept"]) == r["kept_sha256"] for r in out)
    assert line_dedup(df.limit(0)).collect() == []


def test_a_hot_line_is_nothing_special(spark):
    """One line in every document, many of it, and lines around the threshold; no line is shuffled but for counting."""
    rows = [(i, f"hot\nHOT \nown {i}\nshared {i // 9}\nten {i // 10}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = line_dedup(df, shard_keys=500)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in out.collect()], key=repr) == brute_lines(rows, 10)


def one_shard(h, p, c, least):
    raw = M.unpack(M.pack(**L.build(h, p, c, least)))
    return raw, L.Index([{k: (v, np.array([0, len(v)])) for k, v in raw.items()}], 1)


def test_shards_are_minimal_and_perfect():
    """A slot for each key of enough documents and no more; keys of fewer are told apart exactly."""
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 5000, 200_000):
        h = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        p, c = rng.integers(0, 1 << 63, len(h)).astype(np.uint64), rng.integers(1, 4, len(h)) * rng.choice([1, 40_000], len(h))
        raw, s = one_shard(h, p, c, 2)
        assert len(raw["counts"]) == len(raw["prints"]) == (c >= 2).sum() == np.bitwise_count(raw["bits"]).sum()
        assert s.count(h, p).tolist() == np.where(c >= 2, np.minimum(c, 65535), 0).tolist()
        if n == 200_000:
            assert 0 < len(raw["listed"]) // 3 < 20
            assert sum(a.nbytes for k, a in raw.items() if k != "listed") < 5.5 * len(raw["counts"])


def test_keys_of_one_hash_are_told_apart():
    h, p, c = np.array([5, 7, 5, 5, 5], np.uint64), np.array([1, 2, 3, 4, 65537], np.uint64), np.array([9, 8, 7, 6, 1])
    assert one_shard(h, p, c, 2)[1].count(h, p).tolist() == [9, 8, 7, 6, 0]


def test_shards_of_several_files():
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2))
    p, c = rng.integers(0, 1 << 63, len(h)).astype(np.uint64), rng.integers(1, 9, len(h))
    where, n = L.shard_of(h, 7), 7
    files, keys = [], []
    for own in ([0, 3], [1, 2, 6], [5]):  # nothing of shard 4
        parts = [L.build(h[where == k], p[where == k], c[where == k], 2) for k in own]
        files.append({x: (np.concatenate([a[x] for a in parts]), np.cumsum([0] + [len(a[x]) for a in parts])) for x in parts[0]})
        keys.append(np.array(own))
    got = L.Index(files, n, keys).count(h, p)
    assert got.tolist() == np.where((c >= 2) & (where != 4), c, 0).tolist()


def test_keys():
    assert line_key("\t ÀB c\r") == "Àb c"
    assert key_hash("a") == key_hash("a") != key_hash("b")


# -- decontamination --------------------------------------------------------------


def brute_leaks(rows, bench, n):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for item, t in bench:
        w = word.findall(low(t or ""))
        s = min(n, len(w))
        for i in range(len(w) - s + 1) if s and item is not None else ():
            wins[tuple(w[i : i + s])].add(item)
    out = []
    for i, t in rows:
        w = word.findall(low(t or ""))
        hit, items = set(), set()
        for s in {len(g) for g in wins}:
            for k in range(len(w) - s + 1):
                if (g := tuple(w[k : k + s])) in wins:
                    hit.update(range(k, k + s))
                    items |= wins[g]
        out.append((i, len(w), len(hit), len(items), SHA(",".join(sorted(map(str, items)))), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_windows", [1 << 16, 3])
def test_leaks_as_by_brute_force(spark, part_windows):
    """3: many parts."""
    rng = random.Random(4)
    vocab = [f"t{i}" for i in range(12)] + ["É1", "日"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "-"]) for _ in range(n))
    bench = [(i, text(rng.randint(4, 14))) for i in range(10)] + [(10, "t1 T2"), (11, ""), (12, None), (None, "t3 t4"), (2, "t5 t6 t7"), (10, "t1 T2")]
    rows = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(50, None), (51, ""), (None, text(30)), (7, "T1-t2"), (7, "T1-t2"), (52, bench[0][1].upper() + " end")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, hit string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    out = decontaminate(df, b, n=4, part_windows=part_windows, full=True, extra=("hit",)).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out], key=repr) == brute_leaks(rows, bench, 4)
    assert all(r["x0"] == "x" for r in out)
    assert all(not r["contaminated"] for r in decontaminate(df, b.limit(0)).collect())
    assert decontaminate(df.limit(0), b).collect() == []


def test_a_large_benchmark_takes_one_scan(spark):
    """Hundreds of parts in several files: one pass of Python over the documents, no join, and the same rows as by brute force."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    bench = [(i, text(60)) for i in range(400)]
    rows = [(i, text(rng.randint(0, 80)) + " " + " ".join(bench[rng.randrange(400)][1].split()[5:25]) * (i % 2)) for i in range(120)]
    out = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string").repartition(5), part_windows=100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out.collect()], key=repr)
    assert got == brute_leaks(rows, bench, 10) and sum(r[5] for r in got) >= 60


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    """With hashes of two bits every window meets others; only equal words count."""
    from archivolt.llm import decontaminate as D

    class Weak(dict):
        def __missing__(self, word):
            return 1 + len(word) % 2

    rng = random.Random(9)
    text = lambda n: [rng.choice(["a", "bb", "cc", "d"]).encode() for _ in range(n)]
    monkeypatch.setattr(D, "_hashes", Weak())
    found = defaultdict(set)
    for i in range(12):
        w = text(8)
        for k in range(6):
            found[b" ".join(w[k : k + 3])].add(i)
    h = np.concatenate([D.window_hashes(np.array([Weak()[x] for x in w.split()], np.uint64), 3) for w in found])
    order = np.argsort(h, kind="stable")
    ws = [list(found)[i] for i in order]
    a = {"hash": h[order], "words_end": np.cumsum([len(w) for w in ws]), "words": np.frombuffer(b"".join(ws), np.uint8), "items_end": np.cumsum([len(found[w]) for w in ws]), "items": np.concatenate([sorted(found[w]) for w in ws])}
    file = type("File", (), {"arrays": a, "starts": {k: np.array([0, len(v)]) for k, v in a.items()}})()
    docs = [text(30) for _ in range(10)]
    masks, items = D.Windows([file], [3]).scan(docs)
    for own, mask, got in zip(docs, masks, items, strict=True):
        hits = [k for k in range(28) if b" ".join(own[k : k + 3]) in found]
        assert set(np.flatnonzero(mask).tolist()) == {k + j for k in hits for j in range(3)}
        assert got == set().union(*(found[b" ".join(own[k : k + 3])] for k in hits))


def test_spans_go():
    text = "Keep THIS, drop These Words! and keep."
    hit = np.array([w in (b"these", b"words") for w in words(text)])
    assert without(text, hit) == "Keep THIS, drop ! and keep."
    assert without(text, np.zeros(len(words(text)), bool)) == text


# -- sharding ---------------------------------------------------------------------


def test_shards_are_even_and_groups_whole(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 300)) for i in range(3000)] + [(5000 + i, "a copy of one text") for i in range(1500)] + [(None, None), (1, "again"), (1, "again")]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, shard int").repartition(4)
    out = shard(df, shards=6).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=repr) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    sizes, counts = Counter(), defaultdict(list)
    for r in out:
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]].append(r["slot"])
    mean = sum(sizes.values()) / 6
    assert set(sizes) == set(range(6)) and max(abs(s - mean) for s in sizes.values()) < 0.01 * mean
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert max(map(len, counts.values())) < 1.05 * len(rows) / 6
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in out)
    assert shard(df.limit(0)).collect() == []


def test_equal_texts_stay_together(spark):
    df = spark.createDataFrame([(i, f"text {i // 3}") for i in range(600)], "doc_id long, text string")
    where = defaultdict(set)
    for r in shard(df, shards=4).collect():
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_pack_puts_items_where_most_room_is():
    got = pack([(0, (5.0, 1.0)), (1, (4.0, 1.0)), (2, (3.0, 1.0)), (3, (2.0, 1.0))], 2, (1.0, 1.0))
    assert got[0] == got[3] != got[1] == got[2]
    assert pack([], 3) == {}


def brute_place(items, left, weights):
    """Largest first; every bin's dot product written out."""
    out = [None] * len(items)
    left = [list(x) for x in left]
    for i in sorted(range(len(items)), key=lambda i: (-max(items[i]), i)):
        dots = [sum(w * a * b for w, a, b in zip(weights, items[i], own, strict=True)) for own in left]
        best = dots.index(max(dots))
        left[best] = [a - b for a, b in zip(left[best], items[i], strict=True)]
        out[i] = best
    return out


def test_items_are_placed_as_by_brute_force(spark):
    """Whole numbers, so that sums are exact; then the bins of tasks, as the operator makes them."""
    from archivolt.llm import shards as H

    rng = np.random.default_rng(7)
    for n, bins in ((0, 3), (1, 1), (200, 7)):
        v, left = rng.integers(0, 50, (n, 3)).astype(float), rng.integers(20, 400, (bins, 3)).astype(float)
        want = brute_place(v.tolist(), left.tolist(), H.WEIGHTS)
        assert H.place(v, left).tolist() == want
    rows = [(i, 0, int(a), int(b), 1) for i, (a, b) in enumerate(rng.integers(1, 1000, (300, 2)))]
    df = spark.createDataFrame(rows, "h long, part int, bytes long, tokens long, rows long").repartition(3, "h")
    totals = tuple(sum(r[k] for r in rows) for k in (2, 3, 4))
    out = H.packed(df, 4, totals).collect()
    by_task = defaultdict(list)
    for r in out:
        by_task[r["task"]].append(r)
    assert len(out) == 300 and len(by_task) == 3
    sizes = np.repeat(3.0 ** -np.arange(6), 4)
    for own in by_task.values():
        v = np.array([[rows[r["h"]][k] for k in (2, 3, 4)] for r in own]) / (np.array(totals) / 4)
        assert [r["bin"] for r in own] == brute_place(v.tolist(), (sizes[:, None] / sizes.sum() * v.sum(axis=0)).tolist(), H.WEIGHTS)


def test_items_are_packed_in_batches(spark, monkeypatch):
    from archivolt.llm import shards as H

    rng = random.Random(3)
    rows = [(i, f"{i} " + "w " * rng.randint(1, 90)) for i in range(4000)]
    monkeypatch.setattr(H, "BATCH", 100)
    sizes = Counter()
    for r in shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.01 * sum(sizes.values()) / 5


def test_tokens_are_words(spark):
    from pyspark.sql import functions as F

    from archivolt.llm.shards import WORD

    want = {"": 0, " \n\t ": 0, "one": 1, "  two   words ": 2, "a\x0bb\x0cc\rd": 4, "a\u3000b\xa0c": 3, "\u6f22\u5b57\u304b": 3, "abc\u6f22 d": 3, "\xe9t\xe9 \ud55c\uad6d\uc5b4": 2}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", F.regexp_count("t", F.lit(WORD)).alias("n")).collect()} == want

"""The corpus operators against brute force, round trips and edge cases.

Every table here has extra columns whose names clash with ones that the operators make.
"""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from compare import SF, connect, rows_of_spark, rows_of_sql
from sparrowmill.llm import bpe, components, element_counts, id_filter, jaccard_join, langid, merkle, mixing, queries, substring_dedup, token_files, toxicity, vector_files, warc

LONG = "lorem ipsum dolor sit amet " * 20_000
PASSAGE = " ".join(f"word{i}" for i in range(80))
EDGES = [(None, None), (1, None), (2, ""), (3, " \t\n "), (4, "a b c"), (5, "a b c"), (5, "a b c"), (6, LONG), (7, LONG), (8, "Ünïcödé 漢字 !?"), (9, "tail"), (None, "null id")]


def table(spark, rows, **more):
    """doc_id, text, lang, source, n_chars and clashing columns."""
    random.seed(len(rows))
    full = [(i, t, more.get("lang", lambda i: "en")(i), more.get("source", lambda i: "s")(i), len(t or ""), 1, "x", 2.0, "k") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size int, class string, score double, key string").repartition(3)


def brute_sets(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        small = small.replace(c, " ")
    w = [x for x in small.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(rows):
    sets = {i: brute_sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def noisy_documents(n, seed):
    """Documents of few and many words, with chains of edits, shared passages and short texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.5:
            words = rnd.choice(rows)[1].split()
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 6])):
                if words:
                    k = rnd.randrange(len(words))
                    words[k : k + rnd.choice([0, 1])] = [rnd.choice(vocabulary)]
        else:
            words = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 5, 8, 9, 20, 60, 200]))]
            if rnd.random() < 0.3:
                words[2:2] = vocabulary[:40]
        rows.append((i, " ".join(words).upper() if rnd.random() < 0.1 else " ".join(words)))
    return rows


# op4


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_groups_like_brute_force(spark, seed):
    rows = noisy_documents(250, seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_groups(table(spark, rows)).collect()}
    assert got == brute_groups(rows)


def test_jaccard_edges(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similarity_groups(table(spark, EDGES)).collect()), key=str)
    n = len(brute_sets(LONG))
    assert got == sorted([(None, 0, None), (None, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, n, 6), (7, n, 6), (8, 1, 8), (9, 1, 9)], key=str)
    assert jaccard_join.similarity_groups(table(spark, EDGES[:0] or [(1, "x")]).where("false")).count() == 0


def test_weights_reach_what_is_needed():
    """Weights add up to what is needed, cost no more than one each, and bands hold every partner."""
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randrange(2, 40)
        own = np.array([rnd.choice([0, 0, 1, 3, 500]) for _ in range(n)])
        two = own + np.array([rnd.choice([0, 1, 700]) for _ in range(n)])
        need = rnd.randrange(1, n + 1)
        got = jaccard_join.weights(own, two, need)
        cost = lambda w: int(own[w == 1].sum() + two[w == 2].sum())
        plain = np.zeros(n, int)
        plain[np.argsort(own, kind="stable")[:need]] = 1
        assert got.sum() >= need and set(got.tolist()) <= {0, 1, 2} and cost(got) <= cost(plain)
    assert jaccard_join.weights(np.array([0, 0, 900]), np.array([1, 1, 900]), 3).tolist() in ([2, 1, 0], [1, 2, 0])
    begins = jaccard_join.band_begins()
    for size in range(1, 3000):
        band = int(np.searchsorted(begins, size, side="right")) - 1
        assert 5 * size // 4 < begins[band + 2]


def test_pigeonhole_meets_every_link():
    """Pairs at the threshold meet in a weighted segment, whatever weights of the needed sum."""
    rnd = random.Random(3)
    for _ in range(120):
        n = rnd.randrange(5, 90)
        a = rnd.sample(range(1, 10**6), n)
        b = list(a)
        while True:
            c = list(b)
            c[rnd.randrange(len(c))] = rnd.randrange(10**6, 10**7) if rnd.random() < 0.5 else c[0]
            if 100 * len({*a} & {*c}) < 80 * len({*a} | {*c}):
                break
            b = c
        sets = [np.unique(np.array(sorted(set(x)), np.uint64)) for x in (a, b)]
        sizes = [len(s) for s in sets]
        if set(sets[0].tolist()) == set(sets[1].tolist()):
            continue
        bands = [int(np.searchsorted(jaccard_join.band_begins(), s, side="right")) - 1 for s in sizes]
        space = min(bands)
        rows = [x for x in zip(*[y.tolist() for y in jaccard_join.signatures(sets, True)], strict=True) if x[2] == space]
        whole = [{seg: sig for sig, at, _, seg, kind in rows if at == i and kind == 0} for i in (0, 1)]
        less = [{(seg, sig) for sig, at, _, seg, kind in rows if at == i and kind == 1} for i in (0, 1)]
        count, most = jaccard_join.segments(space), sum(sizes) // 9
        for _ in range(10):  # any weights that add up to one more than the differences
            weight = [0] * count
            while sum(weight) <= most:
                weight[rnd.choice([k for k in range(count) if weight[k] < 2])] += 1
            met = [k for k, w in enumerate(weight) if w and whole[0][k] == whole[1][k]]
            met += [k for k, w in enumerate(weight) if w == 2 and ((k, whole[0][k]) in less[1] or (k, whole[1][k]) in less[0])]
            assert met
        low = int(np.argmin(sizes))
        x = jaccard_join.sketches([sets[low]], 0)[0]
        y = jaccard_join.sketches([sets[1 - low]], bands[1 - low] - bands[low])[0]
        assert sum(p != q for p, q in zip(x, y, strict=True)) <= sum(sizes) // 9


def test_elements_are_counted_across_chunks(spark, monkeypatch):
    """``unique`` and ``common`` of every row against a plain count, in chunks of a few sets."""
    monkeypatch.setattr(element_counts, "ELEMENTS", 300)
    rows = [*noisy_documents(120, 9), (None, None), (7, ""), (7, "one two three four five six")]
    docs = table(spark, rows).withColumn("text_hash", F.xxhash64("text"))
    sets = [brute_sets(t) for _, t in rows]
    df = Counter(x for s in sets for x in s)
    for common in (1, 3):
        got = sorted(((r.id, r.n, r.unique, r.common) for r in element_counts.counted(docs, jaccard_join.Sets, common).collect()), key=str)
        assert got == sorted(((i, len(s), sum(df[x] == 1 for x in s), sum(df[x] > common for x in s)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def test_crowded_groups_link_as_brute_force_says(spark, monkeypatch):
    """With every bucket of over three sets crowded: neighbourhoods, common parts, rare elements."""
    monkeypatch.setattr(jaccard_join, "CROWD", 3)
    asked, weigh = [], jaccard_join.second_index

    def counting(sets):
        out = weigh(sets)
        asked.append({(r.kind, r.asks) for r in out.select("kind", "asks").distinct().collect()})
        return out

    monkeypatch.setattr(jaccard_join, "second_index", counting)
    for seed in (3, 4):
        rnd = random.Random(seed)
        base, words = [f"b{i}" for i in range(120)], [f"w{i}" for i in range(60)]
        rows = []
        for i in range(90):  # one page's copies, each with some words replaced, cut or added
            own = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 6])):
                k = rnd.randrange(len(own))
                own[k : k + 1] = rnd.choice([[], [rnd.choice(words)], [rnd.choice(words), own[k]]])
            rows.append((i, " ".join(own)))
        for i in range(90, 150):  # documents with a long passage in common and some rare words
            rows.append((i, " ".join(base[:70] + [rnd.choice(words) for _ in range(rnd.choice([4, 12, 25]))])))
        rows += [(200 + i, t) for i, t in noisy_documents(60, seed)]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_groups(table(spark, rows)).collect()}
        assert got == brute_groups(rows)
        assert {(jaccard_join.WHOLE, 2), (jaccard_join.LESS, 2), (jaccard_join.ELEMENT, 1)} <= asked[-1]


def test_a_null_id_bridges_two_documents(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = words, [*words[:-4], "x", "y", "z", "t"]
    c = ["p", "q", "r", "s", *b[4:]]
    rows = [(5, " ".join(a)), (None, " ".join(b)), (2, " ".join(c)), (None, "alone and without an id"), (None, " ".join(b))]
    assert not jaccard_join.linked(brute_sets(rows[0][1]), brute_sets(rows[2][1]))
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.similarity_groups(table(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 2), (None, 2), (2, 2), (None, None), (None, 2)], key=str)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_both_texts_of_a_repeated_id_link(spark):
    words = {k: [f"{k}{i}" for i in range(60)] for k in "ab"}
    texts = {k: " ".join(w) for k, w in words.items()} | {f"near {k}": " ".join([*w[:-1], "other"]) for k, w in words.items()}
    rows = [(1, texts["a"]), (1, texts["b"]), (2, texts["near a"]), (3, texts["near b"])]
    pairs = spark.createDataFrame([(0, 2), (1, 3), (0, 3)], jaccard_join.LINKS)
    held = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "node long, text string")
    assert sorted((r.u, r.v) for r in jaccard_join.verify(pairs, held).collect()) == [(0, 2), (1, 3)]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.similarity_groups(table(spark, rows)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_id_filter(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(100)] + [(None, "n")], "doc_id long, t string")
    ids = spark.createDataFrame([(3,), (50,)], "doc_id long")
    assert sorted(r.doc_id for r in id_filter.having(df, ids).collect()) == [3, 50]
    left = id_filter.lacking(df, ids)
    assert left.count() == 99 and left.where("doc_id is null").count() == 1


# op10


def test_passages_are_found_where_they_repeat(spark):
    rnd = random.Random(4)
    filler = lambda k: " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(10**6)}" for _ in range(k))
    rows = [(1, f"{filler(70)} {PASSAGE} {filler(30)}"), (2, filler(100)), (3, f"{filler(33)} {PASSAGE} {filler(70)}"), (4, f"{PASSAGE}"), (5, filler(60)), (6, None), (7, "")]
    got = substring_dedup.repeated_spans(table(spark, rows)).collect()
    assert {r.doc_id for r in got} == {3, 4} and {r.first_doc_id for r in got} == {1}
    texts = dict(rows)
    for r in got:
        assert texts[r.doc_id].encode()[r.begin : r.end].decode() in PASSAGE + " "
    kept = {r.doc_id: r for r in substring_dedup.deduplicated(table(spark, rows)).collect()}
    assert kept[1].text == texts[1] and kept[2].text == texts[2] and kept[5].text == texts[5] and kept[6].text is None
    assert "word40" not in kept[3].text and kept[3].n_chars == len(kept[3].text)
    assert 4 in kept and len(kept[4].text) < 100


def test_short_passages_are_found_to_their_ends(spark):
    rnd = random.Random(14)
    words = lambda k: [f"{rnd.choice('abcdefgh')}{rnd.randrange(10**4)}" for _ in range(k)]
    rows, wanted = [], {}
    for i in range(300):
        passage = " ".join(words(51)) if i % 3 else " ".join([words(1)[0]] * 51)
        rows.append((i, f"{' '.join(words(40))} A {passage} B {' '.join(words(20))}"))
        own = f"{' '.join(words(30))} C {passage} D {' '.join(words(10))}"
        rows.append((1000 + i, own))
        wanted[1000 + i] = (i, own.index(" C ") + 3, own.index(" D ") + 1)
    texts, got = {i: t.encode() for i, t in rows}, defaultdict(list)
    for r in substring_dedup.repeated_spans(table(spark, rows)).collect():
        assert texts[r.doc_id][r.begin : r.end] in texts[r.first_doc_id]
        got[r.doc_id].append((r.first_doc_id, r.begin, r.end))
    assert set(got) == set(wanted)
    for i, spans in got.items():
        spans.sort(key=lambda s: s[1])
        assert {s[0] for s in spans} == {wanted[i][0]} and (spans[0][1], spans[-1][2]) == wanted[i][1:]
        assert all(a[2] == b[1] for a, b in zip(spans, spans[1:]))


def test_a_passage_is_held_by_one_document(spark):
    rnd = random.Random(15)
    words = lambda k: " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(10**4)}" for _ in range(k))
    rows = []
    for i in range(0, 300, 3):
        a, b = words(22), words(22)  # under 160 bytes each
        rows += [(i, f"{words(30)} {a} {words(30)}"), (i + 1, f"{words(30)} {b} {words(30)}"), (i + 2, f"{words(30)} {a} {b} {words(30)}")]
    assert substring_dedup.repeated_spans(table(spark, rows)).count() == 0


def test_passages_like_brute_force(spark):
    """Bytes in windows of ``LEAST_BYTES`` that an earlier document has, found by holding all windows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spans = defaultdict(list)
    for r in substring_dedup.repeated_spans(docs).collect():
        spans[r.doc_id].append((r.begin, r.end))
    least, held = substring_dedup.LEAST_BYTES, set()
    real = found = both = 0
    for doc, text in sorted((r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()):
        repeats, marked = np.zeros(len(text), bool), np.zeros(len(text), bool)
        windows = [text[i : i + least] for i in range(len(text) - least + 1)]
        for i, w in enumerate(windows):
            if w in held:
                repeats[i : i + least] = True
        held.update(windows)
        for begin, end in spans[doc]:
            marked[begin:end] = True
        real, found, both = real + repeats.sum(), found + marked.sum(), both + (repeats & marked).sum()
    assert both == found and both > 0.98 * real > 0


def test_cuts_resist_insertions():
    rnd = random.Random(5)
    text = " ".join(f"wörd{rnd.randrange(10**5)}" for _ in range(3000)).encode()
    moved = b"x y z " + text[:5000] + b"inserted here " + text[5000:]
    pieces = lambda b: {b[x:y] for x, y in zip([0, *substring_dedup.cuts(b).tolist()], substring_dedup.cuts(b).tolist())}
    a, b = pieces(text), pieces(moved)
    assert len(a & b) > 0.97 * len(a)
    for b in (text, LONG.encode(), ("é" * 5000).encode(), b"a" * 1000):
        at = substring_dedup.cuts(b).tolist()
        assert at[-1] == len(b)
        for x in at[:-1]:
            b[:x].decode()
    assert substring_dedup.cuts(b"").tolist() == []


def test_substring_edges(spark):
    assert {r.doc_id for r in substring_dedup.repeated_spans(table(spark, EDGES)).collect()} == {7}
    kept = substring_dedup.deduplicated(table(spark, EDGES)).collect()
    # the copy goes; texts that were blank before stay, as null texts do
    assert sorted((r.doc_id for r in kept), key=str) == sorted([None, 1, 2, 3, 4, 5, 5, 6, 8, 9, None], key=str)
    assert substring_dedup.repeated_spans(table(spark, [(1, "x")]).where("false")).count() == 0


# op2


def brute_targets(sizes):
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, stopped, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in sizes if s not in stopped]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = 3.0 * sizes[s]
            stopped.add(s)
            left -= target[s]
        if len(stopped) == len(sizes):
            return target


def test_mixture_meets_targets(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join("w" * rnd.choice([1, 3]) for _ in range(int(rnd.paretovariate(0.9)) % 3000))) for i in range(1500)] + [(None, "a b"), (2000, None)]
    source = lambda i: None if i is None or i % 11 == 0 else ("big" if i % 3 else f"s{i % 5}")
    got = mixing.mix(table(spark, rows, source=source)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for i, t in rows:
        sizes[source(i)] += len((t or "").split())
    wanted = brute_targets(sizes)
    taken, target = defaultdict(int), {}
    names = {i: source(i) for i, _ in rows}
    for r in got:
        taken[names[r.doc_id]] += r.taken
        target[names[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size and r.source_size == sizes[names[r.doc_id]]
    assert target == pytest.approx(wanted)
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= max(3, 0.01 * wanted[s])
    again = mixing.mix(table(spark, rows, source=source).repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in got)


def test_rates_solve_the_dual(spark):
    classes = spark.createDataFrame([("a", k, n, k * n) for k, n in ((1, 50), (5, 20), (40, 3))] + [("b", 2, 9, 18)], "source string, class long, n long, words long")
    sources = spark.createDataFrame([("a", 270, 135.0, 270 / 73), ("b", 18, 54.0, 2.0)], "source string, source_size long, target double, mean double")
    state = {r.source: r for r in mixing.balanced(classes, sources).collect()}
    assert state["a"].met and state["b"].multiplier == 1e9
    x = state["a"].multiplier
    assert sum(n * k * min(3, np.exp(x * k / (270 / 73))) for k, n in ((1, 50), (5, 20), (40, 3))) == pytest.approx(135, rel=1e-8)


def test_mixture_edges(spark):
    got = mixing.mix(table(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and all(r.taken == r.size for r in got)
    assert mixing.mix(table(spark, [(1, "x")]).where("false")).count() == 0


def test_sources_are_numbered_and_filled_without_one_task(spark):
    """Targets of many sources against plain turns, and sizes that no class lumps together."""
    rnd = random.Random(16)
    sizes = {f"host{i}": rnd.choice([1, 5, 40, 9000, 30001]) for i in range(300)} | {None: 77, "Z": 0}
    held = spark.createDataFrame([("1" if s is None else f"0{s}", n) for s, n in sizes.items()], "source string, source_size long")
    got = {None if r.source == "1" else r.source[1:]: r.target for r in mixing.targets(held).collect()}
    assert got == pytest.approx(brute_targets(sizes))
    rows = [(i, " ".join(["w"] * n)) for i, n in enumerate([5000, 5001, 4999, 9000, 1, 2, 3, 4, 4097, 4099])]
    by = mixing.mix(table(spark, rows, source=lambda i: "ab"[i % 2])).collect()
    rates = {r.doc_id: r.rate for r in by}
    for s in (0, 1):
        own = sorted((r.size, rates[r.doc_id]) for r in by if r.doc_id % 2 == s)
        assert len({round(x, 12) for _, x in own if 0 < x < 3}) >= len([x for _, x in own if 0 < x < 3]) - 1


# op1, op3


def test_segments_like_brute_force():
    def brute(x):
        if not len(x):
            return []
        best = max(((sum(x[a:b]), -(b - a), -a, a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)))
        if best[0] <= 0:
            return []
        a, b = best[3], best[4]
        return [*brute(x[:a]), (a, b, best[0]), *[(p + b, q + b, s) for p, q, s in brute(x[b:])]]

    rnd = random.Random(7)
    for _ in range(200):
        x = [rnd.choice([-3, -1.25, 0.75, 2, 4.5]) + rnd.random() / 1000 for _ in range(rnd.randrange(0, 14))]
        got = toxicity.segments(np.array(x, float))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(x)]


def test_toxicity_learns_and_spares_clean_documents(spark):
    docs, labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.toxic == 0]
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_of_held_out_documents(spark):
    """Recall and false alarms over rows that nothing was learned from, and which rows those are."""
    docs, labels = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.1')}/labels.parquet")
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity.toxicity(docs, labels).join(marks, "doc_id").select("doc_id", "held_out", "predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    toxic, clean = [r for r in out if r.toxic == 1], [r for r in out if r.toxic == 0]
    assert len(toxic) > 80 and sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_odds_are_those_of_a_mixed_passage():
    got = toxicity.odds_of({"bad": (90, 90), "odd": (12, 20), "the": (100, 1000), "^bad": (0, 40)}, 100, 900)
    assert set(got) == {"bad", "odd"} and got["bad"] > got["odd"] > toxicity.PLAIN
    one, other = (12 + 0.4) / 100.4, (8 + 3.6) / 903.6
    left = math.log(one / other) - toxicity.DOUBT * math.sqrt(1 / 12.4 + 1 / 11.6)
    assert got["odd"] == pytest.approx(math.log(1 - toxicity.MIXED + toxicity.MIXED * (math.exp(left) - 1) / toxicity.TELLING))
    model = toxicity.Model(got)
    assert model.scores(["bad", "the", "bad"]).tolist() == [got["bad"], toxicity.PLAIN, toxicity.PLAIN]
    assert model.token("unheard") == toxicity.PLAIN and toxicity.Model({}).passages("a b") == ([], 2)


def test_the_law_of_segments_holds_for_random_tokens():
    """lambda solves its equation, and K n exp(-lambda S) gives the number of strong random segments."""
    scores = {-0.4: 940, 1.5: 40, 3.0: 20}
    decay, scale = toxicity.karlin_altschul(scores)
    assert sum(n / 1000 * math.exp(decay * s) for s, n in scores.items()) == pytest.approx(1)
    rng, n, found = np.random.default_rng(8), 400_000, Counter()
    x = rng.choice(list(scores), n, p=np.array(list(scores.values())) / 1000)
    for _, _, s in toxicity.segments(x):
        for least in (4, 6, 8):
            found[least] += s >= least
    for least in (4, 6, 8):
        assert 0.6 < found[least] / (scale * n * math.exp(-decay * least)) < 1.6
    assert toxicity.karlin_altschul({}) == (1.0, 1.0) == toxicity.karlin_altschul({-1.0: 5})


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(spark, EDGES), none).collect()
    assert len(got) == len(EDGES) and {r.predicted for r in got} == {0}
    assert toxicity.toxicity(table(spark, [(1, "x")]).where("false"), none).count() == 0


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_language_edges(spark):
    got = langid.identify(table(spark, EDGES)).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.lang_pred, 0 <= r.score <= 1))
    assert len(got) == len(EDGES) and by[2] == by[3] == by[1] == {("und", True)} and by[9] == {("en", True)}
    assert {r.lang_pred for r in langid.predict(table(spark, EDGES), [], np.zeros((0, langid.DIMENSIONS))).collect()} == {"und"}
    assert langid.identify(table(spark, [(1, "x")]).where("false")).count() == 0


def test_bundles_are_sums_of_bound_letters():
    d = langid.DIMENSIONS
    a, b, s = (langid._letter(ord(c), d).astype(int) for c in "ab ")
    expected = np.roll(s, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * s
    assert np.array_equal(langid.bundles(["aB!"])[0], expected)


# op5


def test_fingerprints(spark):
    rows = [(i, t) for i, t in EDGES if i is not None]
    rows = list(dict(rows).items()) + [(20, f"{PASSAGE}\n" * 3), (21, f"{PASSAGE}\n" * 3)]
    got = {r.doc_id: r for r in merkle.fingerprints(table(spark, rows)).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
        # likenesses by a plain count of equal leaves
        for near, other in ((got[i].near_edited, t[: len(t) - half] + n[:half]), (got[i].near_next, n)):
            one, two = (Counter(h[:4] for h in merkle.tree(x)[3]) for x in (t, other))
            whole = sum(one.values()) + sum(two.values())
            assert near == pytest.approx(1.0 if t == other else 2 * sum((one & two).values()) / whole if whole else 0.0)
    assert got[20].fingerprint == got[21].fingerprint and got[20].near_next == 1.0 and got[4].fingerprint != got[9].fingerprint
    single = merkle.fingerprints(table(spark, [(3, "one two three four")])).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    with_nulls = merkle.fingerprints(table(spark, EDGES)).collect()
    assert len(with_nulls) == len(EDGES)
    assert merkle.fingerprints(table(spark, [(1, "x")]).where("false")).count() == 0


def test_trees_hash_children():
    """Every node by hand, from the leaves' bytes up."""
    text = "first paragraph of some words\nsecond one here\n\nthird and last of them all"
    root, sections, counts, leaves, ends = merkle.tree(text)
    raw = text.encode()
    assert leaves == [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    person = lambda level, x: hashlib.blake2b(b"".join(x), digest_size=16, person=level).digest()
    paragraphs, now = [], []
    for leaf, end in zip(leaves, ends.tolist()):
        now.append(leaf)
        if raw[end - 1 : end] == b"\n" or end == len(raw):
            paragraphs.append((person(b"paragraph", now), len(now)))
            now = []
    held, sizes, over = [], [], []
    for k, (p, n) in enumerate(paragraphs):
        held.append((p, n))
        if p[5] % merkle.SECTION == 0 or k + 1 == len(paragraphs):
            over.append(person(b"section", [x for x, _ in held]))
            sizes.append(sum(n for _, n in held))
            held = []
    assert counts == sizes and sections == [x[:6].hex() for x in over] and root == person(b"root", over).hex()


def test_trees_locate_edits():
    text = "\n".join(f"paragraph {i} " + " ".join(f"v{i}x{j}" for j in range(30)) for i in range(40))
    a, b = merkle.fingerprint(text), merkle.fingerprint(text.replace("v7x3 ", "changed "))
    assert a[:32] != b[:32] and merkle.likeness(a, b) > 0.95 and merkle.likeness(a, a) == 1.0
    seen = []
    at = list(merkle.differing(a, b, seen))
    root, sections, counts, hashes, ends = merkle.tree(text)
    leaves = ends.tolist()
    assert set(at) <= set(seen) and len(seen) < len(leaves) / 4
    assert sum(counts) == len(leaves) == len(hashes) and list(merkle.differing(a, a)) == []
    assert at and all(abs(text.encode().index(b"v7x3") - leaves[i]) < 200 for i in at)
    assert merkle.likeness(a, merkle.fingerprint("other words here")) == 0.0
    assert merkle.likeness(merkle.fingerprint(""), a) == 0.0


# op6, op7


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


ODD = ["it's 'S don't I'LL", "tab\tx  y", "a\r\nb\n\nc", " lead", "trail ", "日本語 テスト", "x́ ﬀ ΣΑΣ İ", "a<|endoftext|>b", "½ ² 12ab3", "\x1c a\x1db", "a_b __ c-d", "👍🏽", "\n"]


def test_token_files_like_the_library(spark):
    rows = [*EDGES, *((30 + i, t) for i, t in enumerate(ODD)), *((100 + i, t) for i, t in noisy_documents(50, 3))]
    got = token_files.token_files(table(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), 2, 16)
    tok = library("byte_bpe_50k.json")
    expected, start = [], 0
    keyed = sorted(((i is not None, i or 0, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u2").tobytes()) for i, t in rows))
    for has, i, raw in keyed:
        ids = np.frombuffer(raw, "<u2").astype("<u4")
        expected.append((i if has else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in got.collect() if r.doc_id) == sorted(e for e in expected if e[0])
    assert got.count() == len(rows)
    assert token_files.token_files(table(spark, [(1, "x")]).where("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_sequences_and_masks_are_views(tmp_path):
    import pyarrow as pa

    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as sink:
        w = token_files.TokenWriter(sink, np.dtype("<u2"), 8)
        data = np.arange(5000, dtype="<u2")
        for part in np.array_split(data, 7):
            w.add(part.tobytes())
        w.close()
    with pa.memory_map(str(tmp_path / "t.arrow")) as source:
        before = pa.total_allocated_bytes()
        batch = pa.ipc.open_file(source).get_batch(1)
        row = batch.column("input_ids").flatten().to_numpy()[8:16]
        assert row.tolist() == list(range(4104, 4112)) and pa.total_allocated_bytes() == before
        assert token_files.file_ids(source).tolist() == data.tolist()


def test_bpe_like_the_library(spark):
    rows = [*EDGES, *((30 + i, t) for i, t in enumerate(ODD)), *((100 + i, t) for i, t in noisy_documents(50, 9))]
    tok = library("word_bpe_49k.json")
    expected = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    path = public_tokenizers.path("word_bpe_49k.json")
    got = bpe.bpe_digests(table(spark, rows), path)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(expected, key=str)
    whole = {r.doc_id: r for r in bpe.bpe_encode(table(spark, [(1, "The cat's hat")]), path).collect()}
    assert whole[1].ids == tok.encode("The cat's hat", add_special_tokens=False).ids


def test_speculation_is_exact():
    coder = bpe.encoder(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(8)
    words = list({"".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(1, 16))) for _ in range(3000)})
    assert coder.words(words) == [coder.exact(w) for w in words]


# op8, op9


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_like_sql(spark, name):
    assert rows_of_spark(queries.QUERIES[name](spark, SF)) == rows_of_sql(connect(SF), queries.ORACLE_SQL[name])


def test_archive_edges(spark):
    big, bigger = "x" * 999, "é" * 700
    pages = [(1, "http://a/b c", big), (2, None, big), (3, "http://ü/?q=1#f", bigger), (9, "http://a", bigger), (4, "http://a", bigger), (5, "", None), (6, "u", ""), (9, "again", bigger), (None, "n", "y")]
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in pages], "page_id long, url string, html string, digest string, n int").repartition(2)
    got = warc.archived(df).collect()
    assert len(got) == len(pages)
    of = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert of == Counter({(1, "response", None): 1, (2, "response", None): 1, (3, "revisit", 9): 1, (4, "revisit", 9): 1, (9, "response", None): 1, (9, "revisit", 9): 1, (5, "response", None): 1, (6, "response", None): 1, (None, "response", None): 1})
    assert {(r.payload_bytes, r.payload_digest) for r in got if r.page_id == 3} == {(1400, hashlib.sha1(bigger.encode()).hexdigest())}
    assert warc.archived(df.where("false")).count() == 0


def test_words_that_no_tokens_spell_end():
    """A vocabulary without some letters: proposals fail whole and are left to exact merging."""
    coder = bpe.WordBPE(public_tokenizers.path("word_bpe_49k.json"))
    coder.marked = {k: v for k, v in coder.marked.items() if "q" not in k}
    words = ["quiet", "aqua", "plain", "q"]
    assert coder.words(words) == [[t.id for t in coder.library.model.tokenize(w)] for w in words]


def test_byte_units_like_the_library():
    """Texts with any white space, empty ones and many units, batch by batch."""
    coder, tok = token_files.ByteBPE(public_tokenizers.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    rnd = random.Random(17)
    texts = ["", "\n", " a", "a ", "a  b", "a\n\nb", "\na", "a\n", "a \nb", "x y", *ODD, *(rnd.choice([" ", "\n"]).join(rnd.choice(ODD + ["word", "Other"]) for _ in range(9)) for _ in range(200))]
    for _ in range(2):
        got = [np.frombuffer(x, coder.kind).tolist() for x in coder.encode(texts)]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines_of_both_versions(version):
    head = warc.arc_version_block("f.arc", version)
    names = warc.parse_version_block(head)
    assert len(names) == (5 if version == 1 else 10)
    block = warc.http_block(7, b"line\n\nURL 0.0.0.0 trap\n")
    header, got = warc.parse_arc(warc.arc_record("http://a/ b", block, version, "f.arc", 12), names)
    assert got == block and header["url"] == "http://a/%20b"
    record, body = warc.parse_warc(warc.convert(header, block, "f.arc#12"))
    assert record["warc-type"] == "response" and record["warc-date"] == "2024-01-01T00:00:00Z" and body == block
    revisit, body = warc.parse_warc(warc.convert(header, block, "f.arc#12", warc.record_id("other")))
    assert revisit["warc-refers-to"] == warc.record_id("other") and body.endswith(b"\r\n\r\n") and b"trap" not in body
    with pytest.raises(ValueError):
        warc.parse_arc(b"http://a 0.0.0.0 20240101000000 text/html 99\nshort", warc.ARC_V1.decode().lower().split(" "))


def test_top_k_edges_and_ties(spark):
    rnd = random.Random(10)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(5)]) for i in range(260)] + [(300, None), (301, []), (302, [0.1, None, 0.2, 0.3, 0.4]), (303, [float("nan")] * 5), (304, [float("inf")] * 5), (400, [0.5] * 5), (401, [0.5] * 5), (402, [0.5] * 5), (None, [0.1] * 5), (100, [0.25] * 5), (500, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, row string")
    whole = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    # a repeated query id asks twice; the best answers of both are one list
    expected = []
    for q in sorted({i for i, _ in whole if i % 100 == 0}):
        found = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for j, x in whole if j == q for i, v in whole if i != q and len(v) == len(x))[:10]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    assert sorted(tuple(r) for r in vector_files.top_k(df).collect()) == sorted(expected)
    assert vector_files.top_k(df.where("false")).count() == 0


def test_search_block_reads_few_exact_vectors_and_handles_wide_numbers():
    rnd = np.random.default_rng(11)
    v = rnd.integers(-1000, 1000, (500, 8)).astype(float)
    brute = [(0, int(i), int(s)) for s, i in sorted((-(v[0] @ v[i]), i) for i in range(1, 500))[:10]]
    read = []
    got = vector_files.search_block(v[:1], np.array([0]), v, np.arange(500), 10, read)
    assert read[0] <= 20
    assert got == [(q, i, -s) for q, i, s in brute]
    wide = vector_files.search_block(v[:1] * 1e9, np.array([0]), v * 1e6, np.arange(500), 3)
    assert [i for _, i, _ in wide] == [i for _, i, _ in got[:3]]

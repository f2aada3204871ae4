"""Versions both ways, by number or title, under one cap, against a plain loop."""

import random

from sparrowmill.operators import norms

FOUND = "query_id int, rank int, hit_id int, is_change boolean, article int, title string, mentions array<int>"


def plain(found, changes, originals, most_changes, most_originals):
    """One question at a time; a fragment that several articles offer belongs to its best place in the order of turns."""
    out = []
    amended = {a for _, a, *_ in changes}
    for q in sorted({f[0] for f in found}):
        mine = sorted(f for f in found if f[0] == q)
        marked, own, titles, held, seen = {}, set(), {}, set(), {f[2] for f in mine}
        for _, rank, _, is_change, article, title, mentions in mine:
            for a in [article] if is_change else mentions:
                if a in amended:
                    marked[a] = min(marked.get(a, (rank, a)), (rank, a))
                    if is_change:
                        own.add(a)
                        titles.setdefault(a, title)
            if not is_change:
                held.add(article)
        offers = {"change": [], "original": []}
        for a in marked:
            if a not in own:
                rows = sorted((not o, -s, i) for i, x, o, s in changes if x == a and i not in seen)
                offers["change"] += [((n, marked[a]), i, a) for n, (*_, i) in enumerate(rows, 1)]
            elif a not in held:
                rows = sorted({(-s, i) for i, x, t, s in originals if (x == a or (t is not None and t == titles[a])) and i not in seen})
                offers["original"] += [((marked[a], n), i, a) for n, (_, i) in enumerate(rows, 1)]
        for relation, most in (("change", most_changes), ("original", most_originals)):
            best = {}
            for place, i, a in offers[relation]:
                best[i] = min(best.get(i, (place, a)), (place, a))
            for n, (i, (place, a)) in enumerate(sorted(best.items(), key=lambda x: (x[1][0], x[0]))[:most], 1):
                out.append((q, relation, n, i, a))
    return sorted(out)


def test_like_a_plain_loop(spark):
    rnd = random.Random(3)
    titles = ["Objeto", "Plazos", "Garantías", None]
    found = [(q, r, rnd.randrange(300), rnd.random() < 0.4, rnd.choice([None, *range(1, 9)]), rnd.choice(titles), [rnd.randrange(1, 12) for _ in range(rnd.randrange(3))]) for q in range(40) for r in range(1, 6)]
    changes = sorted({(rnd.randrange(300, 400), rnd.randrange(1, 7)) for _ in range(60)})
    changes = [(i, a, rnd.random() < 0.3, round(rnd.random(), 1)) for i, a in changes]
    originals = [(i, rnd.randrange(1, 9), rnd.choice(titles), round(rnd.random(), 1)) for i in range(280, 330)]
    frames = (spark.createDataFrame(found, FOUND), spark.createDataFrame(changes, "change_id int, article int, own boolean, score double"), spark.createDataFrame(originals, "original_id int, article int, title string, score double"))
    got = sorted(map(tuple, norms.forced_versions(*frames, 3, 2).collect()))
    want = plain(found, changes, originals, 3, 2)
    assert got == want and {r[1] for r in want} == {"change", "original"}


def test_nothing_found_asks_for_nothing(spark):
    found = spark.createDataFrame([], FOUND)
    changes = spark.createDataFrame([(1, 2, True, 0.5)], "change_id int, article int, own boolean, score double")
    originals = spark.createDataFrame([(1, 2, "x", 0.5)], "original_id int, article int, title string, score double")
    assert norms.forced_versions(found, changes, originals, 2, 2).count() == 0

import random

import numpy as np
import pytest

from tablewarden.llm import components, jaccard
from tablewarden.llm.prefix_tree import Groups, PrefixTree


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    groups = Groups(len(docs))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                groups.unite(i, j)
    smallest = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            root = groups.find(i)
            smallest[root] = min(smallest.get(root, key), key)
    return sorted([(key, len(sets[i]), smallest.get(groups.find(i), key)) for i, (key, _) in enumerate(docs)], key=str)


def near_copies(seed, n=60):
    draw = random.Random(seed)
    bases = [[f"w{draw.randint(0, 40)}" for _ in range(draw.choice([4, 5, 6, 30, 90]))] for _ in range(6)]
    line = [f"l{i}" for i in range(12)]
    docs = []
    for key in range(n):
        words = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
            words[draw.randrange(len(words))] = f"n{draw.randint(0, 9)}"
        docs.append((key, " ".join(words + (line if draw.random() < 0.5 else []))))
    return docs


def _spark(spark, docs):
    frame = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, component_id int")
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(frame).collect()], key=str)


def test_against_all_pairs(spark):
    docs = near_copies(1)
    docs += [(100, None), (101, ""), (102, " \n"), (103, "A b"), (104, "a  B"), (105, "a b c"), (106, "É b c"), (107, "é b c")]
    docs += [(None, docs[0][1]), (None, "all alone here"), (3, docs[3][1]), (3, "another text of the same id now"), (-5, docs[7][1].upper())]
    docs += [(200, " ".join(f"z{i % 4999}" for i in range(20_000))), (201, " ".join(f"z{i % 4999}" for i in range(19_000)))]
    assert _spark(spark, docs) == brute(docs)


@pytest.mark.parametrize("seed", [2, 3])
def test_cut_blocks_lose_no_link(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "ITEMS_PER_PART", 60)
    docs = near_copies(seed)
    assert _spark(spark, docs) == brute(docs)


def test_one_of_each_group_stays(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(2, text, "x"), (1, text, "y"), (3, "other words", "z"), (None, text, "n"), (4, None, "m")], "doc_id long, text string, class string")
    assert sorted(r["class"] for r in jaccard.keep_smallest(docs).collect()) == ["m", "n", "y", "z"]
    assert jaccard.keep_smallest(docs.limit(0)).count() == 0


def test_rows_of_a_repeated_id_are_judged_one_by_one(spark):
    one = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 a12 a13 a14 a15 a16 a17 a18 a19 a20 a21 a22 a23 a24 a25 a26 a27 a28 a29 a30"
    two = one.replace("a", "b")
    clean = [(9, f"only here {i} and nowhere else at all {i}", f"clean{i}") for i in range(3)]
    docs = [(5, one, "5a"), (7, one + " x", "7a"), (5, two, "5b"), (3, two + " y", "3b"), (9, one + " z", "9a"), *clean]
    # Of one id: equal texts, and near ones.
    docs += [(20, "same text " * 9, "equal"), (20, "same text " * 9, "equal"), (30, one.replace("a", "c"), "near"), (30, one.replace("a", "c") + " w", "near")]
    docs += [(40, "", "empty"), (40, "", "empty"), (40, None, "empty")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, mark string")
    got = jaccard.keep_smallest(frame)
    assert got.columns == frame.columns
    assert sorted(r["mark"] for r in got.collect()) == sorted(["5a", "3b", "clean0", "clean1", "clean2", "equal", "near", "empty", "empty", "empty"])


def test_tree_against_pairs():
    draw = np.random.default_rng(3)
    for _ in range(60):
        universe = int(draw.integers(3, 60))
        base = [draw.permutation(universe)[: draw.integers(1, universe)] for _ in range(3)]
        sets, extra = [], draw.integers(0, 3, 20)
        for _ in range(20):
            own = base[draw.integers(3)]
            sets.append(np.array(sorted(set(own[draw.random(len(own)) > 0.15].tolist()) | set(draw.integers(0, universe, 2).tolist()))))
        sizes = [len(s) + int(e) for s, e in zip(sets, extra)]
        tree = PrefixTree(sets, sizes, (3, 4))

        def linked(i, j):
            both = len(set(sets[i]) & set(sets[j]))
            return 100 * both >= 75 * (sizes[i] + sizes[j] - both)

        mine, all_pairs = Groups(20), Groups(20)
        for i in range(20):
            found = sorted(tree.order[x] for x in tree.alike(tree.numbered(sets[i]), sizes[i]))
            assert found == [j for j in range(20) if linked(i, j)]
            for j in found:
                all_pairs.unite(i, j)
        for a, b in tree.spanning_links():
            mine.unite(a, b)
        assert [mine.find(i) for i in range(20)] == [all_pairs.find(i) for i in range(20)]


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    links = spark.createDataFrame(path + star + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components.connected_components(links.limit(0), "a", "b").count() == 0

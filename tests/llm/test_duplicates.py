"""Near-duplicate joins, repeated strings and vectors against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from larder.llm import embeddings, ngram_join, suffix_dedup
from larder.llm.common import connected_components
from larder.llm.suffix_order import equal_windows
from tests.llm.conftest import PASSAGE, frame


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingles(text, size):
    words = text.encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def brute_groups(texts, size, percent):
    sets, groups = {i: shingles(t, size) for i, t in texts.items()}, Groups()
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b):
                groups.join(i, j)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def near_copies():
    """Chains of copies with one more change each, copies of copies, and a passage shared by otherwise different texts."""
    choose, out = random.Random(4), {}
    for g in range(12):
        words = [f"w{choose.randint(0, 5000)}" for _ in range(60)]
        for step in range(8):
            out[len(out)] = " ".join(words)
            words[choose.randrange(60)] = f"x{choose.randint(0, 10**6)}"
    for _ in range(40):
        out[len(out)] = PASSAGE + " ".join(f"z{choose.randint(0, 10**6)}" for _ in range(choose.randint(3, 25)))
    return out


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_groups(spark, size, percent):
    texts = near_copies()
    found = ngram_join.jaccard_components(frame(spark, [(i, t, None) for i, t in texts.items()]), size, percent).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == brute_groups(texts, size, percent)


def test_jaccard_second_product_alone_is_complete(spark, monkeypatch):
    """Without the first product, and with every shared n-gram taken as frequent, no link may be lost."""
    scan, numbers = ngram_join.smallest, iter(range(10**6))
    monkeypatch.setattr(ngram_join, "smallest", lambda values: [x ^ next(numbers) for x in scan(values)])
    monkeypatch.setattr(ngram_join, "first_product", lambda docs, *a: docs.sparkSession.createDataFrame([], "a LONG, b LONG"))
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    texts = near_copies()
    found = ngram_join.jaccard_components(frame(spark, [(i, t, None) for i, t in texts.items()])).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == brute_groups(texts, 4, 85)


def test_jaccard_blocks_of_one_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    texts = near_copies()
    found = ngram_join.jaccard_components(frame(spark, [(i, t, None) for i, t in texts.items()])).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == brute_groups(texts, 4, 85)


def test_links_between_two_sides():
    """With two sides, links between them join the same rows as brute force does; pairs of one side are left alone."""
    sets = [np.unique(np.array(x, np.uint64)) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [9], [1, 2, 3, 4, 6], [9], [20, 21])]
    groups = Groups()
    for i, j in ngram_join.block_links(sets, 60, left=3):
        assert i < 3 <= j
        groups.join(i, j)
    assert [groups.find(i) for i in range(6)] == [0, 0, 2, 0, 2, 5]
    assert ngram_join.block_links(sets[:2], 60) == [(0, 1)] and ngram_join.block_links(sets[4:], 60) == []


def test_sketches_rule_out_no_similar_pair():
    random = np.random.default_rng(5)
    draw = lambda n: np.unique(random.integers(0, 1 << 63, n, dtype=np.uint64))
    sets = []
    for n in (1, 3, 40, 500, 1100, 3000, 9000):
        whole = draw(n)
        sets += [whole, whole[: max(1, n * 9 // 10)], np.unique(np.append(whole[n // 12 :], draw(max(1, n // 20)))), draw(n)]
    sizes = np.array(list(map(len, sets)))
    i, j = np.triu_indices(len(sets), 1)
    near = ngram_join.Sketches(list(map(ngram_join.sketch, sets)), sizes, 85).possible(i, j)
    similar = np.array([100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert similar.sum() > 9 and near[similar].all() and near.sum() <= similar.sum() + 8


def test_a_long_list_passes_few_pairs(spark):
    random = np.random.default_rng(6)
    sets = [np.unique(np.append(random.integers(0, 1 << 63, 300, dtype=np.uint64), np.uint64(7))) for _ in range(200)]
    sets.append(sets[0][1:])
    rows = [(7, i, i, len(s), 3 * i, 3 * i + 1, 3 * i + 2, bytearray(ngram_join.sketch(s))) for i, s in enumerate(sets)]
    entries = spark.createDataFrame(rows, "gram LONG, node LONG, group LONG, n LONG, f0 LONG, f1 LONG, f2 LONG, sketch BINARY")
    found = [(r["a"], r["b"]) for r in ngram_join.partial_counts(entries, 85).collect()]
    assert found == [(0, 200)]


def test_jaccard_sf(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert {r[0]: tuple(r[1:]) for r in ngram_join.jaccard_components(documents).collect()} == brute_groups(texts, 4, 85)


def test_jaccard_odd_rows(odd, empty):
    found = Counter(tuple(r) for r in ngram_join.jaccard_components(odd).collect())
    assert found[(4, 3, 3)] == 2 and found[(3, 3, 3)] == 1 and found[(1, 0, 1)] == 1 and found[(2, 0, 2)] == 1 and found[(9, 0, 9)] == 1
    assert found[(None, 1, None)] == 1 and found[(None, 0, None)] == 1 and found[(8, 1, 8)] == 1
    assert ngram_join.jaccard_components(empty).count() == 0


def test_keep_one(odd):
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 5, 6, 7, 8, 9, 10] and kept.where("doc_id IS NULL").count() == 2


def brute_rows(rows, size, percent):
    """Groups by row instead of id, named after their smallest id."""
    groups = brute_groups({n: t for n, (_, t) in enumerate(rows)}, size, percent)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[groups[n][1]] = min(i, least.get(groups[n][1], i))
    return [(i, t, groups[n][0], groups[n][1], least[groups[n][1]]) for n, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("block", [512, 4])
def test_one_id_on_different_texts(spark, monkeypatch, block):
    """Texts that share an id are neither merged nor dropped for it, and lose no link."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    choose = random.Random(8)
    rows = [(choose.randrange(30), t) for t in near_copies().values()]
    rows += rows[:5] + [(500, ""), (500, "one two three")]
    found = Counter(tuple(r) for r in ngram_join.jaccard_components(frame(spark, [(*r, None) for r in rows])).collect())
    assert found == Counter((i, n, c) for i, _, n, _, c in brute_rows(rows, 4, 85))
    want = brute_rows(rows, 5, 80)
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(frame(spark, [(*r, None) for r in rows])).collect()]
    group = {(i, t): g for i, t, _, g, _ in want}
    assert len(kept) == len({g for *_, g, _ in want}) and {group[r] for r in kept} == {g for *_, g, _ in want}
    assert set(kept) <= {(i, t) for i, t, _, _, c in want if i == c}


def test_components(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame([*path, *star, (7, 7), (None, 3), (2000, 2001)], "a LONG, b LONG")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}, 2000: 2000, 2001: 2000}


def brute_removed(texts, window=100):
    seen, out = set(), {}
    for doc, text in sorted(texts.items()):
        data, mark = text.encode(), bytearray(len(text.encode()))
        for i in range(len(data) - window + 1):
            part = data[i : i + window]
            if part in seen:
                mark[i : i + window] = b"\1" * window
            seen.add(part)
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        kept = bytes(c for c, m in zip(data, mark) if not m)
        out[doc] = (len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_equal_windows():
    choose = random.Random(3)
    for _ in range(40):
        length = choose.choice([3, 5, 8])
        strings = [bytes(choose.choices(b"ab\0", k=choose.randint(0, 20))) for _ in range(choose.randint(1, 12))]
        found, want = {}, {}
        for kind, string, start in zip(*(x.tolist() for x in equal_windows(strings, length))):
            found.setdefault(kind, set()).add((string, start))
        for i, s in enumerate(strings):
            for k in range(len(s) - length + 1):
                want.setdefault(s[k : k + length], set()).add((i, k))
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("piece", [900_000, 300])
def test_removed_bytes(spark, piece, monkeypatch):
    """Repeats of every kind: shifted, periodic, inside one text, at its ends, across cuts of long texts."""
    import larder.llm.suffix_dedup as module

    monkeypatch.setattr(module, "PIECE", piece)
    choose, texts = random.Random(9), {}
    pool = ["".join(choose.choices("abcd éß", k=choose.randint(80, 400))) for _ in range(12)]
    for i in range(60):
        texts[i] = "".join(choose.choice([*pool, "ab" * 90, "é", "x" * choose.randint(1, 30), choose.choice(pool)[choose.randint(0, 40) :]]) for _ in range(choose.randint(0, 6)))
    rows = [(i, t, None) for i, t in texts.items()]
    found = suffix_dedup.removal_digests(frame(spark, rows).repartition(5)).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == brute_removed(texts)


def test_removed_bytes_sf(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.removal_digests(documents).collect()} == brute_removed(texts)


def test_removed_bytes_odd_rows(spark, odd, empty):
    found = Counter((r["doc_id"], r["n_bytes"], r["n_spans"]) for r in suffix_dedup.removal_digests(odd).collect())
    assert found[(1, 0, 0)] == 1 and found[(4, 27, 0)] == 2 and found[(None, 14, 0)] == 1 and sum(found.values()) == odd.count()
    assert suffix_dedup.removal_digests(empty).count() == 0
    kept = suffix_dedup.keep_first(odd)
    assert kept.columns == odd.columns and {r["doc_id"]: r["text"] for r in kept.collect()}[7] == "xy"
    other = frame(spark, [(1, PASSAGE + "a", None), (1, PASSAGE + "b", None)])
    assert sorted(r["n_removed"] for r in suffix_dedup.removal_digests(other).collect()) == [0, len(PASSAGE)]


def test_vectors(spark):
    random_state = np.random.default_rng(2)
    base = random_state.standard_normal((40, 16))
    rows = [base[i % 40] + random_state.standard_normal(16) * random_state.choice([0, 0.02, 0.08, 0.3]) for i in range(700)]
    unit = np.array([x / np.linalg.norm(x) for x in rows])
    near = unit @ unit.T >= 0.95
    groups = Groups()
    for i, j in zip(*np.nonzero(near)):
        groups.join(int(i), int(j))
    vectors = [(i, [float(x) for x in v], "label") for i, v in enumerate(rows)]
    found = {r["vec_id"]: r for r in embeddings.similar_vectors(spark.createDataFrame(vectors, "vec_id LONG, embedding ARRAY<DOUBLE>, key STRING")).collect()}
    links = sum(r["n_links"] for r in found.values())
    assert links >= 0.98 * (near.sum() - len(rows)) and all(found[i]["n_links"] <= near[i].sum() - 1 for i in found)
    assert sum(found[i]["component_id"] == groups.find(i) for i in found) >= 0.98 * len(rows)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [1e300, 1e300]), (1, [1.0, 0.0])]
    found = [tuple(r) for r in embeddings.similar_vectors(spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")).collect()]
    assert Counter(found) == Counter([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, None, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8)])
    assert embeddings.similar_vectors(spark.createDataFrame([], "vec_id LONG, embedding ARRAY<FLOAT>")).count() == 0
    assert embeddings.similar_vectors(spark.createDataFrame([(1, None)], "vec_id LONG, embedding ARRAY<FLOAT>")).count() == 1


def test_blocks_of_a_hot_bucket_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    state = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.ones(8) + state.standard_normal(8) * 0.01]) for i in range(100)]
    found = embeddings.similar_vectors(spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in found} == {(99, 0)}


def test_vectors_of_several_lengths(spark):
    """Each length is compared within itself; the rare length loses no link."""
    random = np.random.default_rng(3)
    rows = []
    for n, size in ((30, 8), (6, 3), (1, 5)):
        base = random.normal(size=(n, size))
        for v in np.concatenate([base, base + 0.01 * random.normal(size=base.shape)]) if n > 1 else base:
            rows.append((len(rows), [float(x) for x in v]))
    found = {r["vec_id"]: r for r in embeddings.similar_vectors(spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")).collect()}
    groups, links = Groups(), Counter()
    for i, x in rows:
        for j, y in rows[:i]:
            if len(x) == len(y) and np.dot(x, y) >= 0.95 * np.linalg.norm(x) * np.linalg.norm(y):
                groups.join(i, j)
                links.update((i, j))
    assert {i: (r["n_links"], r["component_id"]) for i, r in found.items()} == {i: (links[i], groups.find(i)) for i, _ in rows}
    assert links[60] and links[66]

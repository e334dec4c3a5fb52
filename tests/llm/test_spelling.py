"""Spelling variants against brute force, over long lists too, and defined cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from larder.llm import spelling
from tests.llm.conftest import ROWS, frame


def near(a, b):
    """True for words one edit apart, by trying every cut."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    return any(a[:i] + a[i + (len(a) == len(b)) :] == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    form, out = {}, set()
    close = {w: [v for v in words if near(w, v)] for w in words}
    for w, others in close.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(close[w]), words[form[w]] if form[w] else None))
    return out


def variants(seed):
    """Words over few letters, so that bigrams repeat and most lists are shared; counts span several powers of ten."""
    pick = random.Random(seed)
    rows, words = [], ["".join(pick.choices("abcdéÀ×", k=pick.randint(6, 11))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "abababab"]
    for word in list(words):
        for _ in range(pick.randint(0, 4)):
            at = pick.randrange(len(word))
            words.append(pick.choice((word[:at] + word[at + 1 :], word[:at] + pick.choice("abÿ") + word[at:], word[:at] + pick.choice("acÖ") + word[at + 1 :])))
    for i in range(80):
        rows.append((i, " ".join(pick.choices(words, weights=[1 + 5000 // (k + 1) ** 2 for k in range(len(words))], k=60)).replace("a", "A", 3) + " 日" + words[i]))
    return rows


@pytest.mark.parametrize("long_list", (20_000, 1))
def test_equals_brute_force(spark, long_list, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    rows = variants(5)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    expected = brute(rows)
    found = {tuple(r) for r in spelling.variant_groups(docs, long_list).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert found == expected and sum(f is not None for _, f, *_ in expected) > 10


def test_odd_rows(odd, empty):
    found = {tuple(r) for r in spelling.variant_groups(odd).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert found == brute([(i, text) for i, text, _ in ROWS]) and found
    assert spelling.variant_groups(empty).count() == 0


def test_pivots_are_disjoint_and_lightest():
    pick = random.Random(2)
    for _ in range(300):
        places = sorted(pick.sample(range(12), pick.randint(3, 7)))
        weights = [pick.randint(1, 50) for _ in places]
        options = [(weights[i] + weights[j], i, j) for i in range(len(places)) for j in range(i) if places[i] - places[j] >= 2]
        a, b = spelling.choose_pivots(places, weights)
        assert places[b] - places[a] >= 2 and weights[a] + weights[b] == min(options)[0]


def test_roots_follow_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(18)] + [("x", "w18")], "word STRING, form STRING")
    assert {r["root"] for r in spelling.last_forms(links).collect()} == {"w18"}

import random

import pytest

from harborlight.operators import mining

CUES = ("no", "not")


def brute(docs, forms):
    out = set()
    for i, t in docs:
        for f, c in forms:
            if t is not None and f is not None and c is not None and len(f) >= 3 and f.lower() in t.lower():
                before = t.lower()[: t.lower().index(f.lower())].split()[-3:]
                out.add((i, c, f.lower(), bool(set(before) & set(CUES))))
    return out


@pytest.mark.parametrize("most", [100_000, 3])
def test_forms_are_found_alike_at_any_size_of_the_list(spark, monkeypatch, most):
    monkeypatch.setattr(mining, "MOST_FORMS", most)
    rng = random.Random(3)
    words = ["pool", "two pools", "car", "carpool", "...", "no", "not", "spa", "sp", "a pool", "Hồ Bơi", "hồ bơi"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))) for i in range(60)] + [(100, None), (None, "pool"), (101, "")]
    forms = [(w, f"C{k % 4}") for k, w in enumerate(words)] + [("pool", "X"), (None, "Y"), ("car", None)]
    got = mining.find_forms(spark.createDataFrame(docs, "id long, t string"), "id", "t", spark.createDataFrame(forms, "form string, c string"), "form", "c", CUES)
    assert {tuple(r) for r in got.collect()} == brute([d for d in docs if d[0] is not None], forms) and got.columns == ["id", "concept", "form", "negated"]
    assert mining.find_forms(spark.createDataFrame([("k", "a pool")], "id string, t string"), "id", "t", spark.createDataFrame([], "form string, c string"), "form", "c").count() == 0


def brute_greedy(text, dictionary):
    words, out = text.lower().split(), []
    used = [False] * len(words)
    for form in sorted(dictionary, key=lambda f: (-len(f.split()), -len(f), f)):
        n = len(form.split())
        for i in range(len(words) - n + 1):
            if words[i : i + n] == form.split() and not any(used[i : i + n]):
                used[i : i + n] = [True] * n
                out += [(c, form) for c in dictionary[form]]
                break
    return out


@pytest.mark.parametrize("most", [100_000, 2])
def test_greedy_reading_of_ambiguous_and_overlapping_forms(spark, monkeypatch, most):
    monkeypatch.setattr(mining, "MOST_FORMS", most)
    dictionary = {"a b": ["AB"], "b ccc": ["BC", "BC2"], "a": ["A"], "b": ["B"], "d e f": ["DEF"], "e f": ["EF"], "z": ["Z"]}
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "b", "ccc", "d", "e", "f", "x"]) for _ in range(rng.randint(0, 9)))) for i in range(80)] + [(90, None), (None, "a")]
    d = spark.createDataFrame([(f, c) for f, c in dictionary.items()] + [("q", []), (None, ["N"])], "form string, concept_ids array<string>")
    got = mining.greedy_concepts(spark.createDataFrame(rows, "id long, t string"), "id", "t", d).collect()
    assert sorted((r.id, r.concept, r.form) for r in got) == sorted((i, c, f) for i, t in rows if i is not None and t for c, f in brute_greedy(t, dictionary))

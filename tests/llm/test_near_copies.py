"""MinHash groups, winnowing, line templates."""

import hashlib
from itertools import combinations

import numpy as np

from dustpan.llm import minhash, queries, template_lines, winnow
from tests.llm.conftest import words


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_groups_equal_brute_force(spark, sf_dir):
    got = {r[0]: tuple(r)[1:] for r in queries.op6_minhash(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got == brute_components(texts)


def test_chain_and_shared_passage(spark):
    """Links over several steps are followed; texts with only a passage in common stay apart."""
    base = [f"w{i}" for i in range(120)]
    chain = [" ".join(base[k * 8:k * 8 + 80]) for k in range(5)]
    passage = " ".join(f"p{i}" for i in range(60))
    loose = [passage + " " + " ".join(f"x{j}y{i}" for i in range(25)) for j in range(40)]
    texts = dict(enumerate(chain + loose + [loose[0] + " z", loose[0]]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicate_groups(docs).collect()}
    assert got == brute_components(texts)


def test_sketch_agrees_with_jaccard():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2 ** 63, 900).astype(np.uint64)
    a, b = pool[:600], pool[200:800]
    rows = minhash.sketch(np.concatenate([np.sort(a), np.sort(b), pool[:1]]), np.array([0, 600, 1200, 1201, 1201]), 512)
    assert abs((rows[0] == rows[1]).mean() - 0.5) < 0.08
    assert (rows[2] != minhash._NONE).all() and (rows[3] == minhash._NONE).all()


def test_groups_take_odd_rows(odd, odd_rows, empty):
    rows = minhash.near_duplicate_groups(odd).collect()
    assert len(rows) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[8]["component_id"] == 7 and not by_id[8]["kept"] and by_id[9]["component_id"] == 7
    assert by_id[0]["n_shingles"] == 0 and by_id[0]["kept"] and by_id[1]["component_id"] == 1
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(7) == 1 and 8 not in ids and ids.count(None) == 2
    assert minhash.near_duplicate_groups(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def winnowed(values, w):
    found = []
    for j in range(max(len(values) - w + 1, 1) if values else 0):
        least = min(values[j:j + w])
        if not found or found[-1] != least:
            found.append(least)
    return found


def test_fingerprints_equal_brute_force(spark, odd):
    docs = odd.where("doc_id IS NOT NULL AND doc_id <> 10").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r["f"] for r in winnow.with_fingerprints(docs, to="f").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    runs = {i: [t[k:k + 8] for k in range(len(t) - 7)] or ([t] if t else []) for i, t in texts.items()}
    names = spark.createDataFrame([(g,) for g in {g for r in runs.values() for g in r}], "g string")
    value = {r[0]: r[1] for r in names.selectExpr("g", "xxhash64(g)").collect()}
    low = (1 << 26) - 1
    for i, own in runs.items():
        assert got[i] == winnowed([(value[g] & ~low) | (low - k) for k, g in enumerate(own)], 8)


def test_edits_follow_the_order_of_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in winnow.compare_edits(docs).collect()}
    assert len(winnow._ranges(docs, "doc_id", 40)) == 5  # and several ranges give the same
    few = winnow.in_order(docs.select("doc_id", "text"), "doc_id", 40)
    assert few.where("NOT __guest").count() == len(texts) and few.where("__guest").count() == 5
    for k, (i, t) in enumerate(texts):
        half = len(t) // 2
        edited = t[:len(t) - half] + texts[(k + 1) % len(texts)][1][:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["near_next"] <= 1
    near = sorted(r["near_edited"] for r in got.values())
    assert 0.25 < near[len(near) // 2] < 0.45


def test_edits_take_odd_rows(odd, odd_rows, empty):
    rows = winnow.compare_edits(odd).collect()
    assert len(rows) == len(odd_rows)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (7, 8)}) == 1
    assert all(r["near_next"] is None for r in rows if r["doc_id"] is None)
    assert winnow.compare_edits(empty).count() == 0


def test_templates_go_and_copies_stay(spark):
    own = lambda i: ". ".join(" ".join(f"u{chr(97 + i)}{chr(97 + k)}{chr(97 + j)}" for j in range(9)) for k in range(6))
    notice = "All rights reserved by the owner of page 17 today."
    passage = "Here begins the notice of all. Short one. Nothing of it may be copied by anyone."
    rows = [(i, f"{own(i)}.\n{notice.replace('17', str(i))}\n{own(i + 9)}. {passage}") for i in range(6)]
    copies = [(100 + i, f"{own(20)}.\n{own(21)}.") for i in range(5)]
    near = [(200 + i, f"{own(22)}.\n{own(23)} w{chr(97 + i)}.") for i in range(5)]
    docs = spark.createDataFrame(rows + copies + near, "doc_id long, text string")
    got = {r["doc_id"]: r for r in template_lines.drop_templates(docs, changed="n").collect()}
    for i, _ in rows:
        assert got[i]["text"] == f"{own(i)}.\n{own(i + 9)}." and got[i]["n"] == 3
    for i, text in copies + near:
        assert got[i]["text"] == text and got[i]["n"] == 0


def test_templates_take_odd_rows(odd, odd_rows, empty):
    got = template_lines.drop_templates(odd)
    assert got.columns == odd.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, odd.collect()))
    assert template_lines.drop_templates(empty).count() == 0

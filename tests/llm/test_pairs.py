"""Jaccard join, substring dedup and nearest neighbours against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import near_duplicates, neighbours, substrings, words
from plumbline.llm.components import components
from plumbline.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs(text, n=5):
    ws = WORD.findall(text or "")
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def joined_by_force(rows):
    """(id, class, links) of each row."""
    sets = [runs(t) for _, t, _, _ in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for r, (i, _, _, _) in zip(root, rows, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted((str(i), str(least.get(r)), n) for r, (i, _, _, _), n in zip(root, rows, links, strict=True))


def near_copies(rng, base, n, first_id, edits):
    out = []
    for k in range(n):
        ws = base.split()
        for _ in range(rng.randrange(edits + 1)):
            ws[rng.randrange(len(ws))] = f"edit{rng.randrange(10**6)}"
        out.append((first_id + k, " ".join(ws), "en", "a"))
    return out


def some_rows(odd_rows, seed=1):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = list(odd_rows)
    for g in range(12):
        rows += near_copies(rng, text(rng.randrange(20, 300)), rng.randrange(1, 9), 100 * (g + 1), 6)
    passage = text(60)
    rows += [(3000 + k, f"{text(rng.randrange(0, 60))} {passage} {text(rng.randrange(0, 60))}", "en", "b") for k in range(15)]
    rows += [(4000 + k, text(rng.randrange(1, 9)), "en", "b") for k in range(20)]
    return rows


def test_join_equals_brute_force(table, odd_rows):
    rows = some_rows(odd_rows)
    got = near_duplicates.jaccard_join(table(rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in got) == joined_by_force(rows)


def test_large_groups_are_compared_in_blocks(table, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    monkeypatch.setattr(near_duplicates, "STEP_PAIRS", 50)
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(150))
    rows = near_copies(rng, base, 60, 0, 3)
    got = near_duplicates.jaccard_join(table(rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in got) == joined_by_force(rows)


def test_join_of_small_tables(table, no_rows):
    assert near_duplicates.jaccard_join(no_rows).count() == 0
    got = near_duplicates.jaccard_join(table([(1, None, "en", "a"), (2, "", "en", "a"), (3, "x", "en", "a")])).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]


def test_one_document_of_each_group_stays(table, odd_rows):
    rows = some_rows(odd_rows, 2)
    docs = table(rows)
    kept = near_duplicates.keep_first(docs, near_duplicates.jaccard_join(docs))
    assert kept.columns == docs.columns
    want = {}
    blank = 0
    classes = {}
    by_force = joined_by_force(rows)
    for i, c, _ in by_force:
        classes.setdefault(c, []).append(i)
    got = kept.select("doc_id", "text").collect()
    for r in got:
        if WORD.search(r["text"] or ""):
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + 1
        else:
            blank += 1
    assert blank == sum(not WORD.search(t or "") for _, t, _, _ in rows)
    full = {str(i) for i, t, _, _ in rows if WORD.search(t or "")}
    assert {str(i) for i in want} == {c for c in classes if c in full and c != "None"}  # only a blank row has no id in its class


def test_posterior_bound():
    least = near_duplicates.least_matches(160, 16, 0.8, 1e-5)
    assert list(least) == list(range(16, 161, 16)) and all(a <= b for a, b in zip(least.values(), list(least.values())[1:], strict=False))
    rng = np.random.default_rng(1)
    for n, m in least.items():
        # mass above the threshold of Beta(m + 1, n - m + 1) by simulation, at looser tolerance
        loose = near_duplicates.least_matches(160, 16, 0.8, 0.05)[n]
        assert (rng.beta(loose + 1, n - loose + 1, 40_000) >= 0.8).mean() > 0.04
        assert (rng.beta(loose, n - loose + 2, 40_000) >= 0.8).mean() < 0.06
        assert m <= loose


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 900, np.uint64)
    x, y = np.sort(a[:800]), np.sort(a[100:])
    got = near_duplicates.signatures(np.concatenate([x, y]), np.array([0, 800, 1600]), 1000)
    assert abs((got[0] == got[1]).mean() - 700 / 900) < 0.06


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 150)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 130)) and got[200] == got[150] == 150
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed_by_force(rows, width):
    last = 1 << 63
    starts = {}
    for i, t, _, _ in rows:
        ws = WORD.findall(t or "")
        for k in range(len(ws) - width + 1):
            key = tuple(ws[k : k + width])
            starts[key] = min(starts.get(key, last), last if i is None else i)
    out = []
    for i, t, _, _ in rows:
        ws = WORD.findall(t or "")
        gone = set()
        for k in range(len(ws) - width + 1):
            if starts[tuple(ws[k : k + width])] < (last if i is None else i):
                gone.update(range(k, k + width))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((str(i), len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("width", "start"), [(50, 25), (50, 6), (8, 4), (7, 2), (1, 1)])
def test_removed_words_equal_brute_force(table, odd_rows, width, start):
    rows = some_rows(odd_rows, width)
    if width < 5:
        rows = [r for r in rows if len(r[1] or "") < 2000]
    docs = table(rows)
    spans = substrings.repeated_spans(docs, width, start)
    got = substrings.remove_spans(docs, spans, join_all=True).select("row.doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("s")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["s"]) for r in got) == removed_by_force(rows, width)


def equal_hashes(spark, left, right):
    """Two texts of equal 32-bit ``F.hash``: the words of ``left`` and of ``right``, each with a number behind them."""
    ids = spark.range(200_000).select(F.col("id").cast("string").alias("id"))
    a, b = (ids.select(F.concat(F.lit(t + " "), "id").alias(n)).withColumn("h", F.hash(n)) for t, n in ((left, "a"), (right, "b")))
    found = a.join(b, "h").orderBy("a", "b").first()
    return found["a"], found["b"]


def test_texts_under_one_id_are_told_apart_by_more_than_32_bits(spark, table, monkeypatch):
    rng = random.Random(31)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, other = text(60), text(75)
    pair = equal_hashes(spark, passage, other)
    marks = []
    keep = substrings.materialise
    monkeypatch.setattr(substrings, "materialise", lambda df, label: marks.append(keep(df, label)) or marks[-1])
    for i in (None, 50):
        rows = [(1, passage + " " + text(9), "en", "a"), *[(i, t, "en", "a") for t in pair], *[(i, f"{passage} {text(30)}", "en", "a") for _ in range(40)]]
        rows.append((2, other + " and its near copy", "en", "a"))
        docs = table(rows)
        marks.clear()
        cut = substrings.remove_spans(docs, substrings.repeated_spans(docs), join_all=True)
        got = cut.select("row.doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("s")).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["s"]) for r in got) == removed_by_force(rows, 50)
        # what is gathered for a text holds no marks of the other texts under its id
        together = marks[-1].filter("key > 2").agg(F.count("*").alias("n"), F.sum(F.size("marked")).alias("all"), F.max(F.size("marked")).alias("most")).first()
        assert together["n"] == 42 and together["most"] * 10 < together["all"]
        joined = near_duplicates.jaccard_join(docs).select("doc_id", "class_id", "n_links").collect()
        assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in joined) == joined_by_force(rows)


def test_unchanged_texts_stay_as_they_are(table, odd_rows, no_rows):
    docs = table(odd_rows)
    cut = substrings.remove_spans(docs, substrings.repeated_spans(docs)).collect()
    assert sorted(repr(r["text"]) for r in cut if not r["n_removed"]) == sorted(repr(t) for i, t, _, _ in odd_rows if not (i in (8, None) and t))
    assert all(r["row"]["key"] == "x" and r["row"]["row"] == "x" for r in cut)
    assert substrings.repeated_spans(no_rows).count() == 0
    assert substrings.remove_spans(no_rows, substrings.repeated_spans(no_rows)).count() == 0


def test_levels_double():
    assert substrings.levels(50, 25) == [25, 50] and substrings.levels(50, 6) == [7, 13, 25, 50] and substrings.levels(3, 9) == [2, 3] and substrings.levels(1, 1) == [1, 1]


def test_smallest_of_neighbours():
    x = np.random.default_rng(1).integers(0, 99, 40)
    for w in (1, 2, 3, 7, 26, 40):
        assert substrings.smallest(x, w).tolist() == [x[i : i + w].min() for i in range(41 - w)]
    assert not len(substrings.smallest(x, 41))


def test_window_hashes_tell_windows_apart():
    found = words.of(pa.array(["a b a b a c", "b a"]))
    h = words.window_hashes(found.hashes(), 2)
    ok = words.whole(found.first, 2, len(h))
    assert ok.tolist() == [True] * 5 + [False, True]
    assert h[0] == h[2] and h[1] == h[3] == h[6] and len(set(h[ok].tolist())) == 3


def nearest_by_force(ids, x, k):
    out = {}
    for q in sorted(set(ids)):
        if q % 100 == 0:
            d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
            best = sorted((d[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]
            out[q] = best
    return out


def vectors(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], "x", "x") for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, list string, part string")


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 32)) * 2
    x = (centres[rng.integers(0, 20, 4000)] + rng.standard_normal((4000, 32))).astype(np.float32).astype(float)
    ids = list(range(4000))
    want = nearest_by_force(ids, x, 10)
    got = {}
    for r in neighbours.search(vectors(spark, ids, x)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        for _, v, s in found:
            assert s == pytest.approx(float(np.sqrt(((x[v] - x[q]) ** 2).sum())), rel=1e-12)
        hits += len({v for _, v, _ in found} & {v for _, v in want[q]})
    assert hits >= 0.9 * 10 * len(want)


def test_neighbours_of_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    want = nearest_by_force(table.vec_id.tolist(), np.stack(table.embedding.tolist()).astype(float), 10)
    got = QUERIES["op6_neighbours"](spark, sf).toPandas().groupby("query_id").vec_id.apply(set).to_dict()
    assert sum(len(got[q] & {v for _, v in w}) for q, w in want.items()) >= 0.9 * 10 * len(want)


def test_copies_of_one_vector_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 64)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 8)).astype(np.float32).astype(float)
    x[::3] = x[0]
    ids = list(range(900))
    got = {}
    for r in neighbours.search(vectors(spark, ids, x)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in (0, 300, 600):
        assert [v for _, v in sorted(got[q])] == [v for v in range(0, 40, 3) if v != q][:10]


def test_vectors_that_take_no_part(spark, no_rows):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, []), (9, [2.0, 0.0]), (9, [2.0, 0.0]), (100, [nan, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(table).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 9, 1.0), (0, 2, 1, pytest.approx(2**0.5))]
    assert neighbours.search(table.limit(0)).count() == 0


def test_partial_distances_abandon_candidates():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64)) + 2 * rng.standard_normal((30, 64))[rng.integers(0, 30, 3000)]
    scanner = neighbours.Scanner(x, x, np.arange(3000), 16, 2.1)
    at, square = scanner.best(x[5] + 0.01, x[5] + 0.01, -1, 10, float("inf"))
    exact = ((x - x[5] - 0.01) ** 2).sum(1)
    assert at[0] == 5 and np.allclose(square, exact[at]) and scanner.scanned < 0.5 * x.size
    assert len(set(at) & set(np.argsort(exact)[:10])) >= 9

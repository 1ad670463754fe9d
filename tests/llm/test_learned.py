"""Language, quality and line rules against brute force and on documents that the models didn't learn from."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language, line_rules, quality, text_features, words
from plumbline.llm.folds import held_out
from plumbline.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_held_out_is_crc32_of_the_id(spark):
    import zlib

    got = spark.range(300).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def slow_bits(text, counts, languages, a, symbols, rare):
    """Code lengths by walking the contexts byte by byte, with exclusion."""
    out = []
    for lang in range(len(languages)):
        total = 0.0
        history = [0, 0, 0]
        for byte in text.encode():
            s = symbols[byte]
            out_of, bits = set(), 0.0
            for order in (3, 2, 1, 0):
                context = tuple(history[3 - order :])
                if order >= 2 and context not in counts["known"]:
                    continue
                seen = {k: n for k, n in counts[lang].get((order, context), {}).items() if k not in out_of}
                n, kinds = sum(seen.values()), len(seen)
                if s in seen:
                    bits -= math.log2(seen[s] / (n + kinds))
                    if s == 0:
                        bits += math.log2(rare)
                    break
                if kinds:
                    bits -= math.log2(kinds / (n + kinds))
                out_of |= set(seen)
            else:
                bits += math.log2(sum(rare if k == 0 else 1 for k in range(a) if k not in out_of))
            total += bits
            history = [*history[1:], s]
        out.append(total)
    return out


def test_code_lengths_are_exact():
    a = language.ALPHABET
    rng = random.Random(1)
    train = {0: "abracadabra aabbaa " * 3 + "zebra", 1: "bonjour bobo abba " * 3}
    symbols = np.zeros(256, np.uint8)
    for k, c in enumerate(sorted(set("".join(train.values())) - {"z"})):
        symbols[ord(c)] = k + 1
    rare = 256 - int((symbols > 0).sum())
    rows = Counter()
    counts = {0: {}, 1: {}}
    for lang, text in train.items():
        history = [0, 0, 0]
        for byte in text.encode():
            s = int(symbols[byte])
            rows[lang, ((history[0] * a + history[1]) * a + history[2]) * a + s] += 1
            for order in range(4):
                counts[lang].setdefault((order, tuple(history[3 - order :])), Counter())[s] += 1
            history = [*history[1:], s]
    grams = pd.DataFrame([(lang, key, n) for (lang, key), n in rows.items()], columns=["lang", "key", "n"])
    state, cost = language.code_lengths(grams, ["x", "y"], rare, 100_000)
    weight = Counter()
    for lang in (0, 1):
        for (order, context), c in counts[lang].items():
            weight[order, context] += sum(c.values())
    known = {c for (o, c), n in weight.items() if o == 2 and n >= 2}
    counts["known"] = known | {c for (o, c), n in weight.items() if o == 3 and n >= 2 and c[1:] in known}
    model = language.LanguageModel(["x", "y"], symbols, state, cost)
    texts = ["".join(rng.choices("abrcdou jz~é", k=rng.randrange(1, 30))) for _ in range(60)] + ["", "a"]
    raw, bounds = words.utf8(pa.array(texts))
    got = model.lengths(raw, bounds) / language.PART
    for t, row in zip(texts, got, strict=True):
        want = slow_bits(t, counts, ["x", "y"], a, symbols, rare)
        assert np.allclose(row, want, atol=0.001 * max(1, len(t.encode()))), t


def test_code_lengths_are_those_of_a_distribution():
    grams = pd.DataFrame([(0, k, n) for k, n in ((5, 3), (6, 1), (128 + 7, 2))], columns=["lang", "key", "n"])
    _, cost = language.code_lengths(grams, ["x"], 200, 1000)
    weight = np.exp2(-cost[0].astype(float) / language.PART)
    # symbol 0 stands for 200 bytes of the same length each
    total = weight[:, 1:].sum(1) + 200 * weight[:, 0]
    assert np.allclose(total, 1, atol=0.01)


def test_language_of_held_out_documents(spark, sf):
    got = QUERIES["op3_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.filter("held_out and lang_pred <> 'und'").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_language_of_odd_rows(table, odd_rows):
    docs = table(odd_rows)
    got = language.predict(docs, language.fit(docs), keep=docs.columns).collect()
    assert len(got) == len(odd_rows)
    assert {c for c in docs.columns if c not in ("lang_pred", "score")} <= set(got[0].asDict())
    for r in got:
        lettered = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not lettered)
        assert (r["score"] == 0) == (not lettered) and 0 <= r["score"] <= 1


def test_no_language_learned(table, no_rows):
    docs = table([(1, "some words", None, "a"), (2, None, None, "a")])
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(docs)).collect()} == {"und"}
    assert language.predict(no_rows, language.fit(no_rows)).count() == 0


def test_prediction_ignores_lang_and_id(table):
    rows = [(k, "the cat sat on the mat " * 5 if k % 2 else "le chat est sur la table " * 5, "en" if k % 2 else "fr", "a") for k in range(40)]
    model = language.fit(table(rows))
    again = [(k + 500, t, "xx", None) for k, t, _, _ in rows]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(table(again), model).collect()}
    assert all(got[k + 500] == lang for k, _, lang, _ in rows)


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_the_cut_is_the_quantile_of_all_labelled_rows(spark, table):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta", "##", "gamma7", "x"], k=rng.randrange(3, 80))), "en", "a") for i in range(400)]
    labels = spark.createDataFrame([(i, int(len(t) > 150)) for i, t, _, _ in rows], "doc_id long, quality int")
    scored = quality.featured(table(rows), "doc_id", "text")
    model = quality.fit(scored, labels, max_rows=60)  # the weights come from few rows, the cut from all
    raw = scored.select("doc_id", model.raw(F.col("features")).alias("raw"))
    own = raw.join(labels, "doc_id").filter(~held_out(F.col("doc_id"))).toPandas()
    assert model.cut == pytest.approx(np.quantile(own.raw, 1 - own.quality.mean()), abs=1e-12)


def test_quality_of_odd_rows_and_labels(spark, table, odd_rows, no_rows):
    labels = spark.createDataFrame([(k % 14, k % 3 if k % 5 else None) for k in range(40)] + [(None, 1)], "doc_id long, quality int")
    got = quality.rank(table(odd_rows), labels).collect()
    assert len(got) == len(odd_rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert quality.rank(no_rows, labels).count() == 0
    ones = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.rank(table(odd_rows), ones).collect()} == {1}
    assert {r["predicted"] for r in quality.rank(table(odd_rows), ones.limit(0)).collect()} == {0}


def test_features_of_texts():
    rows = quality.features(pa.array(["Ab cd", None, "", "X# X# X#\nLINE ONE\nLINE ONE"]))
    at = {f: k for k, f in enumerate(quality.FEATURES)}
    assert math.isclose(rows[0, at["log_words"]], math.log1p(2)) and rows[0, at["same_as_before"]] == 0
    assert not rows[1].any() and not rows[2].any()
    assert rows[3, at["same_as_before"]] == 2 / 7 and rows[3, at["repeated_lines"]] == 1 / 3 and rows[3, at["distinct_words"]] == 3 / 7


def base(text, width=3):
    ws = WORD.findall(text or "")
    seen = Counter(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1))
    repeat = {i + k for i in range(len(ws) - width + 1) if seen[tuple(ws[i : i + width])] > 1 for k in range(width)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeat),
        "base_failed": len(ws) < 50 or 100 * len(repeat) > 50 * len(ws),
    }


def test_base_counts(table, odd_rows):
    rng = random.Random(9)
    alphabet = ["a", "b", "c#", "é日", " ", " ", " ", "\n", "\r", "|", "dd", " "]
    rows = [*odd_rows, *[(100 + k, "".join(rng.choices(alphabet, k=rng.randrange(400))), "en", "a") for k in range(300)]]
    none = line_rules.LineModel(np.zeros(len(line_rules.LINE_FEATURES)), np.zeros((2, 2)))
    got = sorted((str(r["doc_id"]), *[r[c] for c in base("")], r["kept"]) for r in line_rules.judge(table(rows), none).collect())
    assert got == sorted((str(i), *base(t).values(), not base(t)["base_failed"]) for i, t, _, _ in rows)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(6)
    for _ in range(30):
        n = rng.integers(0, 7, 5)
        first = np.concatenate([[0], np.cumsum(n)])
        rows = rng.standard_normal((first[-1], 3))
        model = line_rules.LineModel(rng.standard_normal(3), rng.standard_normal((2, 2)))
        got = model.decode(rows, first)
        gain = rows @ model.emission

        def value(path, at, gain=gain, model=model):
            return sum(gain[at + k] for k, s in enumerate(path) if s) + sum(model.change[s, t] for s, t in zip(path, path[1:], strict=False))

        for k in range(5):
            paths = [tuple(p >> b & 1 for b in range(n[k])) for p in range(1 << n[k])]
            best = max(value(p, first[k]) for p in paths)
            assert value(tuple(got[first[k] : first[k + 1]]), first[k]) == pytest.approx(best)


def test_gradient_is_that_of_the_likelihood():
    """A learned model reaches a likelihood that no small step improves."""
    rng = np.random.default_rng(2)
    first = np.array([0, 3, 3, 7, 9])
    rows, labels = rng.standard_normal((9, 2)), rng.integers(0, 2, 9)
    strength = 0.1
    model = line_rules.learn(rows, first, labels, rounds=3000, rate=0.05, strength=strength)

    def loss(e, c):
        gain, out = rows @ e, 0.0
        for a, b in zip(first, first[1:], strict=False):
            if a == b:
                continue
            def score(path, a=a):
                return sum(gain[a + k] for k, s in enumerate(path) if s) + sum(c[s, t] for s, t in zip(path, path[1:], strict=False))

            every = [score(tuple(p >> k & 1 for k in range(b - a))) for p in range(1 << (b - a))]
            out += score(tuple(labels[a:b])) - np.logaddexp.reduce(every)
        return out / len(rows) - strength / 2 * ((e**2).sum() + (c**2).sum())

    best = loss(model.emission, model.change)
    for _ in range(20):
        step = 1e-3 * rng.standard_normal(6)
        assert loss(model.emission + step[:2], model.change + step[2:].reshape(2, 2)) <= best + 1e-6


def test_line_rules_tell_junk_from_clean(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_line_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98
    assert got[got.quality == 0].kept.mean() < 0.1


def test_line_rules_on_small_tables(spark, table, odd_rows, no_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = line_rules.fit(table(odd_rows), none)
    assert not model.emission.any()
    assert line_rules.judge(no_rows, model).count() == 0
    labels = spark.createDataFrame([(10, 0), (7, 1), (8, 1), (None, 0), (1, None), (99, 1)], "doc_id long, quality int")
    assert line_rules.judge(table(odd_rows), line_rules.fit(table(odd_rows), labels)).count() == len(odd_rows)


def test_repeated_windows_within_texts_only():
    found = words.of(pa.array(["a b c x a b c", "a b c", "", "z z z z"]))
    got = text_features.repeated_windows(found.hashes(), found.first, 3)
    assert got.tolist() == [True, True, True, False, True, True, True] + [False] * 3 + [True] * 4

"""Mixing against SQL and its own promises, and the pipeline against its stages."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import mixing
from plumbline.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, share, cap):
    """Targets by passing the excess on, round by round."""
    total, stopped = share * sum(sizes), {}
    while True:
        open_ = [k for k in range(len(sizes)) if k not in stopped]
        rest = total - sum(stopped.values())
        level = rest / sum(weights[k] for k in open_) if open_ else 0
        over = [k for k in open_ if level * weights[k] > cap * sizes[k]]
        if not over:
            return [stopped.get(k, level * weights[k]) for k in range(len(sizes))]
        stopped |= {k: cap * sizes[k] for k in over}


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 1, 1, 1, 1], [0, 5, 0, 90], [7], [0, 0], [10, 2000, 30, 400, 5, 60, 7000]])
def test_targets_share_the_excess(spark, sizes):
    sources = spark.createDataFrame([(f"a{k:03}", n) for k, n in enumerate(sizes)], "src string, source_size long")
    got = [r["target"] for r in mixing.targets(sources, (5, 2, 1), 1.5, 2).orderBy("src").collect()]
    want = fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))], 1.5, 2)
    assert got == pytest.approx(want)


def test_mix_of_odd_rows(table, odd_rows, no_rows):
    mixed = mixing.mix(table(odd_rows)).collect()
    assert len(mixed) == len(odd_rows)
    taken, source = {}, {}
    for r in mixed:
        n = len(WORD.findall(r["doc"]["text"] or ""))
        assert r["size"] == n and 0 <= r["taken"] <= 2 * n
        assert sum(c["words"] for c in r["copies"]) == r["taken"] and all(0 <= c["position"] <= 1 for c in r["copies"])
        s = r["doc"]["source"]
        taken[s] = taken.get(s, 0) + r["taken"]
        source[s] = r["target"]
    assert all(abs(taken[s] - source[s]) <= 0.5 for s in taken)
    assert mixing.mix(no_rows).count() == 0 and mixing.stream(mixing.mix(no_rows)).count() == 0


def test_reruns_agree(spark, table, odd_rows):
    docs = table(odd_rows)
    rows = lambda d: sorted(map(repr, mixing.mix(d).collect()))
    assert rows(docs) == rows(docs.repartition(7, "text"))


@pytest.mark.parametrize("schedule", [mixing.STEADY, mixing.EARLY, mixing.LATE, ((0.0, 0.0), (0.3, 2.0), (0.6, 0.0), (1.0, 1.0))])
def test_positions_invert_the_integrated_schedule(spark, schedule):
    got = spark.range(101).select((F.col("id") / 100).alias("y"), mixing._time_of(F.col("id") / 100, schedule).alias("t")).collect()

    def integral(t):
        out = 0.0
        for (a, v), (b, w) in zip(schedule, schedule[1:], strict=False):
            x = min(max(t - a, 0), b - a)
            out += v * x + (w - v) / (b - a) / 2 * x * x
        return out

    for r in got:
        assert integral(r["t"]) / integral(1) == pytest.approx(r["y"], abs=1e-9)


def test_early_sources_come_early(spark, table):
    rows = [(k, "word " * 20, "en", "abc"[k % 3]) for k in range(600)]
    mixed = mixing.mix(table(rows), weights=(1, 1, 1), share=1.0)
    mean = {r["source"]: r["p"] for r in mixed.select("doc.source", F.col("copies")[0]["position"].alias("p")).groupBy("source").agg(F.avg("p").alias("p")).collect()}
    assert mean["a"] < 0.45 < mean["b"] < 0.55 < mean["c"]
    stream = mixing.stream(mixed).select("source", F.spark_partition_id().alias("part")).collect()
    assert [r["part"] for r in stream] == sorted(r["part"] for r in stream)


def test_stream_repeats_and_cuts(table):
    rows = [(k, f" d{k}  one\ntwo three ", "en", "a" if k else "b") for k in range(9)]
    docs = table(rows)
    mixed = mixing.mix(docs, share=1.5)
    want = {r["doc"]["doc_id"]: r["taken"] for r in mixed.collect()}
    got = {}
    stream = mixing.stream(mixed)
    assert stream.columns == docs.columns
    for r in stream.collect():
        n = len(WORD.findall(r["text"]))
        assert r["text"] == rows[r["doc_id"]][1] or r["n_chars"] == len(r["text"]) and rows[r["doc_id"]][1].split()[:n] == r["text"].split(" ")
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + n
    assert got == {k: n for k, n in want.items() if n}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = QUERIES[name](spark, sf).toArrow()
    want = con.sql(ORACLES[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names
    assert sorted(zip(*[got.column(n).to_pylist() for n in names], strict=True)) == sorted(zip(*[want.column(n).to_pylist() for n in names], strict=True))


def test_pipeline_stages(spark, table, odd_rows, sf):
    docs = table(odd_rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        path = corpus_pipeline.materialise(out, "test-stage")
        assert path.count() <= 2 * docs.count()
        docs = path
    texts = [r["text"] for r in docs.collect()]
    assert texts and all(WORD.search(t) for t in texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(p["length"] for p in pieces) == sum(n for _, n in {(p["doc_id"], p["start"], p["sequence_id"], p["offset"]): (0, p["length"]) for p in pieces}.values())


def test_pipeline_on_an_empty_table(spark, no_rows, sf):
    docs = no_rows
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), "test-empty")
        assert docs.count() == 0


def test_clean_documents_come_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    assert kept.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    once = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    classes = QUERIES["op1_jaccard_join"](spark, sf)
    assert once.count() == classes.select("class_id").distinct().count()
    cut = corpus_pipeline.cut_repeats(spark, docs, sf)
    assert cut.count() == docs.count()
    gone = {r["doc_id"] for r in QUERIES["op10_substrings"](spark, sf).filter("n_removed > 0").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all((r["text"] == before[r["doc_id"]]) == (r["doc_id"] not in gone) for r in cut.collect())


def test_whole_pipeline(spark, sf):
    rows = corpus_pipeline.run(spark, sf).toPandas()
    assert len(rows) and rows.length.min() > 0
    sizes = rows.groupby("sequence_id").length.sum()
    assert sizes.max() <= 4096
    assert (rows.start + rows.length <= rows.doc_tokens).all()

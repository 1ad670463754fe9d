"""Token files, token counts and packing against the libraries on whole texts."""

import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import public_tokenizers
import sentencepiece
import tokenizers
import zstandard
from pyspark.sql import functions as F

from plumbline.llm import packing, token_counts, token_files, words
from plumbline.llm.queries import END_ID, QUERIES, word_bpe
from plumbline.llm.tokens import WordIds


@pytest.fixture(scope="module")
def bpe():
    return tokenizers.Tokenizer.from_str(word_bpe())


def ids_of(bpe, text):
    return np.array([*bpe.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")


def test_word_table_gives_the_library_ids(bpe, odd_rows):
    rng = random.Random(3)
    alphabet = "aAéÉßxX.,!?'\"<|>*$#%& \n\t́ ǅΣσς日0９٣ſK'sLL"
    texts = [t for _, t, _, _ in odd_rows] + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)]
    texts += ["<|endoftext|>", "A<|endoftext|>B.", "a.<|startoftext|>C", "'s", "x's.", "don't.DON'T", "é.É.", "é.", "<|x|>"]
    encode = WordIds(word_bpe(), limit=50)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        ids, first = encode(pa.array(part, pa.string()), END_ID)
        for k, t in enumerate(part):
            assert ids[first[k] : first[k + 1]].tolist() == ids_of(bpe, t).tolist(), repr(t)


def test_files_round_trip(spark, table, odd_rows, bpe):
    manifest = token_files.write_token_files(table(odd_rows), word_bpe(), END_ID, frame_tokens=1000)
    got = [r.asDict() for r in token_files.read_token_files(manifest).collect()]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in got) == sorted((i is not None, i or 0, ids_of(bpe, t).tobytes()) for i, t, _, _ in odd_rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_files_are_plain_zstandard_with_independent_frames(spark, table, odd_rows):
    manifest = token_files.write_token_files(table(odd_rows), word_bpe(), END_ID, frame_tokens=777).collect()
    for row in manifest:
        system = pafs.FileSystem.from_uri(row["folder"])[0]
        data = system.open_input_file(row["path"]).read()
        plain = b"".join(zstandard.ZstdDecompressor().read_to_iter(data, 1 << 16)) if row["n_tokens"] else b""
        reader = token_files.FrameReader(system.open_input_file(row["path"]))
        assert len(reader.table) == -(-row["n_tokens"] // 777) and row["n_bytes"] == len(data)
        whole = np.concatenate([reader.frame(k) for k in reversed(range(len(reader.table)))][::-1])
        assert whole.astype("<u2").tobytes()[: len(plain)] == plain[: len(whole) * 2]


def test_reader_opens_only_frames_of_wanted_documents(spark, table, odd_rows, bpe, monkeypatch):
    manifest = token_files.write_token_files(table(odd_rows), word_bpe(), END_ID, frame_tokens=500)
    wanted = spark.createDataFrame([(4,), (8,), (99,), (None,)], "doc_id long")
    got = token_files.read_token_files(manifest, wanted).collect()
    assert sorted(bytes(r["ids"]) for r in got) == sorted(ids_of(bpe, t).tobytes() for i, t, _, _ in odd_rows if i in (4, 8))
    row = next(r for r in manifest.collect() if r["n_tokens"] > 5000)
    reader = token_files.FrameReader(pafs.FileSystem.from_uri(row["folder"])[0].open_input_file(row["path"]))
    opened = []
    frame = reader.frame
    monkeypatch.setattr(reader, "frame", lambda k: opened.append(k) or frame(k))
    k = int(np.argmin(np.diff(reader.first)))
    reader.document(k)
    assert len(set(opened)) <= 2 < len(reader.table)


def test_changed_frame_is_an_error(spark, table, tmp_path):
    docs = table([(i, "some words " * 200, "en", "a") for i in range(20)])
    row = token_files.write_token_files(docs, word_bpe(), END_ID, folder=str(tmp_path), frame_tokens=1000).first()
    path = Path(row["path"])
    data = bytearray(path.read_bytes())
    data[20] ^= 0xFF
    path.write_bytes(data)
    reader = token_files.FrameReader(pafs.LocalFileSystem().open_input_file(str(path)))
    with pytest.raises((token_files.CorruptFrame, zstandard.ZstdError)):
        for k in range(len(reader.table)):
            reader.frame(k)


def test_empty_tables(no_rows):
    manifest = token_files.write_token_files(no_rows, word_bpe(), END_ID)
    assert manifest.count() == 0 and token_files.read_token_files(manifest).count() == 0
    assert packing.pack(no_rows, word_bpe(), END_ID).count() == 0
    assert token_counts.count_tokens(no_rows, model_bytes()).count() == 0


def model_bytes():
    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def test_counts_are_those_of_the_library(table, odd_rows):
    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    rng = random.Random(8)
    alphabet = ["a", "b", "the", " ", "  ", "   ", "\n", "\n\n", "▁", "▁▁", "\t", "é", "日", "<s>", "</s>", "<0x41>", ".", "1", "23", " ", "😀"]
    rows = [*odd_rows, *[(100 + k, "".join(rng.choices(alphabet, k=rng.randrange(12))), "en", "a") for k in range(1500)]]
    got = token_counts.count_tokens(table(rows), model_bytes(), limit=50, frequent=20).collect()
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 50) for i, t, _, _ in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want


def test_frequent_words_survive_bounded_counters():
    rng = np.random.default_rng(1)
    seen = token_counts.FrequentWords(50)
    for _ in range(40):
        common = [b"common%d" % k for k in range(10)]
        rare = [b"rare%d" % k for k in rng.integers(0, 10**9, 300)]
        found = np.array(common + rare, object)
        seen.add(found, np.array([20] * 10 + [1] * 300))
        assert len(seen.counts) <= 200
    top = seen.top()
    assert len(top) == 50
    assert all(b"common%d" % k in top for k in range(10))


def test_packing_covers_every_id_once(spark, table, odd_rows, bpe):
    rng = random.Random(2)
    rows = [*odd_rows, *[(1000 + k, " ".join(["ab"] * rng.randrange(1, 300)), "en", "a") for k in range(300)]]
    window = 256
    got = [r.asDict() for r in packing.pack(table(rows), word_bpe(), END_ID, window=window, slots=4).collect()]
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        assert r["id_width"] == 2 and len(r["ids"]) == 2 * r["length"] > 0
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding < 0.03 * total
    want = sorted(zlib.crc32(ids_of(bpe, t).tobytes()) for _, t, _, _ in rows)
    # rows with equal ids are told apart by their content: chain pieces from start to start
    chains = []
    for (_, n), pieces in by_doc.items():
        same = sum(r["length"] for r in pieces) // n
        pieces.sort(key=lambda r: r["start"])
        open_ = [b"" for _ in range(same)]
        for r in pieces:
            k = next(k for k, x in enumerate(open_) if len(x) == 2 * r["start"])
            open_[k] += bytes(r["ids"])
        chains.extend(open_)
    assert sorted(zlib.crc32(np.frombuffer(c, "<u2").astype("<u4").tobytes()) for c in chains) == want


def test_packer_keeps_the_number_of_open_windows_bounded():
    packer = packing.Packer(100, 3, 5)
    rng = random.Random(4)
    done = []
    for k in range(500):
        done += list(packer.add(k, 0, rng.randrange(1, 250)))
        assert len(packer.free) == len(packer.held) <= 3
    sizes = [sum(p[2] for p in w) for w in done]
    assert max(sizes) <= 100 and sum(sizes) > 0.97 * 100 * len(sizes)


def test_many_partitions_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.expr("repeat('ab ', cast(id % 40 as int))").alias("text")).repartition(11)
    got = packing.pack(docs, word_bpe(), END_ID, window=64, slots=2).toPandas()
    size = got.groupby("sequence_id").length.sum()
    assert size.max() <= 64 and got.length.sum() == sum(k % 40 + 1 for k in range(200))
    assert sum(0 if s & (s - 1) == 0 else 64 - s for s in size) < 0.25 * got.length.sum()


def test_words_are_runs_without_blanks():
    found = words.of(pa.array(["a  bc\n", None, "", " x y", "tail"]))
    distinct, codes = found.coded()
    assert [distinct[c].decode() for c in codes] == ["a", "bc", " x", "y", "tail"]
    assert found.counts().tolist() == [2, 0, 0, 2, 1]


@pytest.mark.parametrize("name", ["op2_token_files", "op5_token_counts", "op9_packing"])
def test_queries_cover_every_document(spark, sf, name):
    got = QUERIES[name](spark, sf).select("doc_id").distinct().count()
    assert got == spark.read.parquet(f"{sf}/documents.parquet").count()

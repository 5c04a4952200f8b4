"""WARC, audio and packing: round trips and invariants; and the pipeline end to end."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselar.llm import audio, packing, warc
from tesselar.llm.common import fresh_path


def test_url_keys():
    assert warc.url_key("http://M.example.NET:8080/a?b#c") == "net,example,m:8080)/a?b"
    assert warc.url_key("https://example.com") == "com,example)/" and warc.url_key(None) == "" and warc.url_key("no url") == "no url"


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "PER_BLOCK", 3)
    big = "<p>ü</p>" * 30
    rows = [(i, f"http://h{i % 4}.example.org/{i % 5}", f"<html>{i}</html>") for i in range(20)]
    rows += [(50, "http://a.example/x", big), (40, None, big), (60, "http://a.example/x\r\nWARC-Type: no", big), (60, "http://a.example/x", big), (70, "", None), (71, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1))
    folder = fresh_path(spark, "warc")
    files = warc.write_index(warc.write_archives(warc.with_revisits(pages), folder), folder)
    got = warc.read_records(warc.lookup(pages, folder, files), folder).collect()
    assert len(got) == len(rows)
    have = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if True)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == big and i != 40
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 40 if revisit else None))
    assert sorted(map(repr, have)) == sorted(map(repr, want))
    one = warc.lookup(spark.createDataFrame([("http://H1.example.org/1",)], "url string"), folder, files).collect()
    assert sorted(r.page_id for r in one) == [1]
    assert warc.with_revisits(pages.limit(0)).count() == 0


def mu_reference(u):
    u = ~u & 255
    t = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return -t if u & 128 else t


def adpcm_reference(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for k in range(2 * (len(block) - 4)):
        code = block[4 + k // 2] >> (4 * (k % 2)) & 15
        step = int(audio.STEPS[index])
        d = step >> 3
        d += step if code & 4 else 0
        d += step >> 1 if code & 2 else 0
        d += step >> 2 if code & 1 else 0
        value = max(-32768, min(32767, value - d if code & 8 else value + d))
        index = max(0, min(88, index + int(audio.INDEX_CHANGE[code])))
        out.append(value)
    return out


@given(st.binary(min_size=128, max_size=128))
@settings(max_examples=30, deadline=None)
def test_decoders(data):
    got = audio.decode_adpcm(np.frombuffer(data, np.uint8).reshape(2, 64))
    assert got.tolist() == [adpcm_reference(data[:64]), adpcm_reference(data[64:])]
    assert audio.MU_LAW[np.frombuffer(data, np.uint8)].tolist() == [mu_reference(b) for b in data]
    assert audio.from_wave(audio.to_wave(data)) == (7, 8000, data)


def test_a_law_known_values():
    assert [int(audio.A_LAW[x]) for x in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]
    assert [int(audio.MU_LAW[x]) for x in (0xFF, 0x7F, 0x80, 0x00)] == [0, 0, 32124, -32124]


def test_audio_column(spark):
    texts = [None, "", "a", "é" * 100, "x" * 64, "y" * 5000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    media = audio.encode_column(df)
    got = {r.doc_id: r for r in audio.read_features(media).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pay = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    assert got[2][1:] == got[6][1:]
    pcm = audio.to_pcm(media).where("doc_id = 2").first().pcm
    tag, rate, samples = audio.from_wave(bytes(pcm))
    assert (tag, rate, len(samples)) == (1, 16000, 4 * 64)


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=80, deadline=None)
def test_best_fit_and_bound(lengths):
    n = np.array(lengths, dtype=np.int64)
    seq, off, fill = packing.best_fit_decreasing(n, 64)
    assert packing.lower_bound(n, 64) <= len(fill) and (not len(fill) or fill.max() <= 64)
    for k in range(len(fill)):
        mine = sorted((off[i], n[i]) for i in range(len(n)) if seq[i] == k)
        at = 0
        for o, size in mine:
            assert o == at
            at += size
        assert at == fill[k]


def test_bound_is_tight_where_known():
    assert packing.lower_bound(np.array([40, 40, 40]), 64) == 3
    assert packing.lower_bound(np.array([32, 32, 32]), 64) == 2


def test_packing(spark):
    pytest.importorskip("public_tokenizers")
    texts = [None, "", "word " * 5000, "some text\n\nwith  spaces ", "tab\tand\xa0nbsp <|endoftext|>", "漢字 عربى don't", "x" * 300, "a b c", "a b c"]
    docs = spark.createDataFrame([(i % 8, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = packing.pack(docs, width=128, per_task=20).collect()
    enc = packing.Encoder(packing.vocabulary_path())
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*enc.tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i % 8, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 128))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 128
    assert len(by) == packing.lower_bound(np.array([r.length for r in got]), 128)
    assert packing.pack(docs.limit(0)).count() == 0


def test_fast_ids_are_those_of_tokenizers():
    pytest.importorskip("public_tokenizers")
    enc = packing.Encoder(packing.vocabulary_path())
    texts = ["", " ", "\n", "a\nb", "a  b", "don't I'LL we've", "ß ø ñ Ÿ º ª ²", "x" * 200, "<|endoftext|>", "!!!a1b2 ...", "\xad soft", " lead", "trail "]
    data = "/root/testdata/sf0.001/documents.parquet"
    if os.path.exists(data):
        import pyarrow.parquet as pq

        texts += [t for t in pq.read_table(data, columns=["text"])["text"].to_pylist() if t]
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert got == np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline
    from tesselar.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = out.persist()
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 0 < len(kept) < 200
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept
    assert packed.where("piece = 0").count() == len(kept)

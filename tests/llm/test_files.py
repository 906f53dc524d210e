"""Token files, WARC archives, mixing, and the pipeline."""

from __future__ import annotations

import gzip
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from permspark.llm import mixing as M, quality, queries, token_files as K, warc as A
from permspark.llm.text import word_count
from tests.llm import brute

random.seed(7)
PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
CODES = K.Encoder(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


# --- token files


@settings(max_examples=500, deadline=None)
@given(
    st.one_of(
        st.text(max_size=40),
        st.lists(st.sampled_from("The the, don't it's 12a 3.5 élan ÉÀ ß ŉ % ... a% x'S <|endoftext|> İ Σας J̌ \xa0 \x85 \x1c \u2003 \n 'll ½ b² ª-o".split(" ") + [" ", "\t"]), max_size=12).map("".join),
        st.text(alphabet=st.characters(min_codepoint=9, max_codepoint=0x24F, exclude_categories=("Cs",)), max_size=60),
    )
)
def test_pieces_give_the_ids_of_whole_texts(text):
    assert np.frombuffer(CODES.encode(text), dtype=CODES.kind).tolist() == ids_of(text)


def test_tokenizers_without_pieces():
    other = K.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_piece
    assert np.frombuffer(other.encode("A b,  c\n"), dtype=other.kind).tolist() == plain.encode("A b,  c\n", add_special_tokens=False).ids


def token_docs():
    word = lambda: "".join(random.choices("abcdeÉ,.'", k=random.randint(1, 9)))
    docs = [(k, " ".join(word() for _ in range(random.randint(0, 120)))) for k in random.sample(range(1000), 150)]
    return docs + [(2000, None), (2001, ""), docs[0], (docs[1][0], "another text"), (None, "no id"), (2002, "long " * 30_000), (2003, '" " "')]


@pytest.mark.parametrize("length, sequences, file_ids", [(K.LENGTH, K.SEQUENCES, K.FILE_IDS), (7, 3, 500)])
def test_token_files(spark, tmp_path, length, sequences, file_ids):
    docs = token_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("_h", F.lit(2))
    manifest = K.write_tokens(df, PATH, str(tmp_path / "ids"), length=length, sequences=sequences, file_ids=file_ids)
    rows = sorted(K.read_documents(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    at, wanted = 0, Counter()
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    for d, t in docs:
        ids = [*ids_of(t), 1]
        wanted[d, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == wanted

    stream = []
    for f in manifest.orderBy("first").collect():
        file = K.TokenFile(f.uri)
        flat = np.concatenate([ids[: mask.true_count] for ids, mask, _ in file.batches()])
        assert len(flat) == f.n_ids and len(file) == -(-f.n_ids // length)
        for i in random.sample(range(len(file)), min(5, len(file))):
            before = pa.total_allocated_bytes()
            ids, mask, last = file.sequence(i)
            assert pa.total_allocated_bytes() == before and not ids.flags.owndata  # a view of the mapped file
            assert len(ids) == len(mask) == len(last) == length
            assert ids[: mask.true_count].tolist() == flat[i * length : (i + 1) * length].tolist()
        with pytest.raises(IndexError):
            file.sequence(len(file))
        stream.append(flat)
    assert sum(map(len, stream)) == at
    assert not list(Path(tmp_path).rglob("*.part"))


def test_no_tokens(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert K.read_documents(K.write_tokens(empty, PATH)).count() == 0


# --- WARC


def web_pages():
    body = lambda n: "".join(random.choices("abc é\n", k=n))
    rows = [(k, f"http://a.org/{k}", body(random.choice([0, 10, 3000, 9000, 40_000]))) for k in range(40)]
    same, small = body(2000), "é" * 400
    rows += [(100 + k, f"http://b.org/ {k}\n", same) for k in range(6)] + [(200 + k, "u", small) for k in range(3)]
    return rows + [(300, None, None), (301, "x", ""), (None, "n", same), rows[3], (302, "é://ü", "0\r\n\r\nWARC/1.1\r\n" * 200)]


@pytest.mark.parametrize("segment, file_bytes", [(A.SEGMENT, A.FILE_BYTES), (300, 5000)])
def test_archives(spark, tmp_path, segment, file_bytes):
    rows = web_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("target", F.lit("x"))
    files = A.write_archives(df, str(tmp_path / "warc"), segment, file_bytes)
    found = A.read_archives(files)
    payloads = {r.page_id: bytes(r.payload) for r in found.collect() if r.record_type == "response"}
    got = {r.page_id: r for r in A.resolve_revisits(found).collect()}
    assert set(got) == {p for p, _, _ in rows}
    data = {p: (h or "").encode() for p, _, h in rows}
    for p, body in data.items():
        r = got[p]
        same = max((q for q in data if q is not None and data[q] == body), default=p) if len(body) >= 1000 else p
        assert (r.payload_bytes, r.payload_digest, r.status) == (len(body), A.hashlib.sha1(body).hexdigest(), "ok")
        assert (r.record_type, r.refers_to) == (("response", None) if same == p else ("revisit", same))
        assert same != p or payloads[p] == body
    assert files.count() >= 1 and A.write_archives(df.limit(0)).count() == 0 and A.read_archives(files.limit(0)).count() == 0


def test_every_row_has_a_record(spark, tmp_path):
    rows = [(None, "http://a/1", ""), (None, "http://a/2", ""), (None, "http://a/3", None), (1, "http://b/1", "x" * 40_000), (1, "http://b/2", "x" * 40_000), (1, "http://b/2", "x" * 40_000), (2, "http://c/", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = A.read_archives(A.write_archives(df, str(tmp_path / "warc")))
    assert found.select("record_id").distinct().count() == len(rows)
    got = sorted((str(r.page_id), r.uri, r.payload_bytes, r.status) for r in A.resolve_revisits(found).collect())
    assert got == sorted((str(p), u, len(h or ""), "ok") for p, u, h in rows)


def test_broken_segments(spark, tmp_path):
    def parts(page):
        return list(A.page_records(page, f"http://a/{page}", bytes(range(256)) * 20, "00" * 20, None, 1000))

    files = {1: lambda p: p[::-1], 2: lambda p: p[:2] + p[3:], 3: lambda p: p[:-1], 4: lambda p: [p[0], *p], 5: lambda p: p[1:], 6: lambda p: p + [p[-1]]}
    everything = [r for k, change in files.items() for r in change(parts(k))]
    random.shuffle(everything)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, everything[::2])))
    (tmp_path / "b.warc").write_bytes(b"".join(everything[1::2]) + A.record("warcinfo", "<urn:x>", {}, b"software: x\r\n"))
    bad = A.record("response", "<urn:uuid:bad>", {"X-Page-ID": 9}, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\nabc")
    plain = A.record("response", "<urn:uuid:plain>", {"X-Page-ID": 10}, b"HTTP/1.1 200 OK\r\n\r\nabc")
    (tmp_path / "c.warc").write_bytes(bad + plain)
    uris = spark.createDataFrame([(f"file://{p}",) for p in tmp_path.iterdir()], "uri string")
    got = {r.record_id: (r.status, r.payload and bytes(r.payload)) for r in A.read_archives(uris).collect()}
    whole = bytes(range(256)) * 20
    assert [got[A.record_id(k, "00" * 20)] for k in files] == [("ok", whole), ("broken", None), ("broken", None), ("ok", whole), ("broken", None), ("ok", whole)]
    assert got["<urn:uuid:bad>"] == ("broken", None) and got["<urn:uuid:plain>"] == ("ok", b"abc")


# --- mixing


def mixed_docs():
    sources = ["a", "b", "B", "", "é", None, "z", "hot", "hot", "hot", "zero"]
    docs = []
    for k in range(200):
        s = random.choice(sources)
        docs.append((k, s, "" if s == "zero" else "\t" + " ".join(f"w{j}" for j in range(random.choice([0, 1, 5, 40, 300]))) + " \n"))
    return docs + [(500, "one", "w " * 5000), docs[4], (None, "a", "x y z"), (None, "a", "x y"), (501, "a", None)]


def test_mix_equals_brute_force(spark):
    docs = mixed_docs()
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("size", F.lit(9)).withColumn("_key", F.lit("k"))
    plan = M.plan_mix(df.repartition(7)).collect()
    key = lambda x: tuple(str(c) for c in x)
    assert sorted(((r.doc_id, r.source, r.size, r.taken) for r in plan), key=key) == sorted(brute.mix(docs), key=key)
    sizes = Counter()
    for _, s, t in docs:
        sizes[s] += len(brute.words(t))
    for s, goal in brute.targets(sizes).items():
        rows = [r for r in plan if r.source == s]
        assert rows[0].source_size == sizes[s] and rows[0].target == pytest.approx(goal)
        assert abs(sum(r.taken for r in rows) - goal) <= 0.5 and all(0 <= r.taken <= 2 * r.size for r in rows)
    out = M.mix(df)
    assert out.columns == df.columns
    taken, words = Counter(), Counter()
    for r in plan:
        taken[r.doc_id, r.source] += r.taken
    for r in out.collect():
        words[r.doc_id, r.source] += len(brute.words(r.text))
    assert +taken == +words
    assert M.plan_mix(df.limit(0)).count() == M.mix(df.limit(0)).count() == 0


def test_word_count(spark):
    texts = [None, "", " \t", "a", " a  b\x0b", "a\u2003b\x85c d", "\x1ca b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    assert {r.k: r.n for r in df.select("k", word_count(F.col("t")).alias("n")).collect()} == {k: len(brute.words(t)) for k, t in enumerate(texts)}


# --- pipeline


def test_pipeline_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    model = quality.fit(docs, queries.table(spark, sf, "labels"))
    rows = []
    for r in docs.collect():
        stats = quality.document_stats(r.text)
        if not quality.base_failed(stats[0], stats[4]) and (model is None or model[0].probability(np.array([stats[5]]))[0] >= model[1]):
            rows.append((r.doc_id, r.source, r.text))
    least = brute.groups([(d, t) for d, _, t in rows])
    rows = [r for r, g in zip(rows, least) if r[0] == g]
    items = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    bad = {d for d, _ in brute.leaks([(d, t) for d, _, t in rows], items)}
    rows = [r for r in rows if r[0] not in bad]
    text = {d: t for d, _, t in rows}
    wanted = Counter()
    for d, _, n, taken in brute.mix(rows):
        for size in [n] * (taken // n) + [taken % n] * (taken % n > 0):
            part = text[d] if size == n else text[d][: list(re.finditer(brute.WORD, text[d]))[size - 1].end()]
            ids = [*ids_of(part), 1]
            wanted[d, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == wanted and bad
    stage = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert stage.columns == docs.columns


def test_stages_take_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 20_000, "en", "s", 5), (3, "a b c", None, None, 5)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.count() >= 0 and (name == "token_output" or out.columns == docs.columns)

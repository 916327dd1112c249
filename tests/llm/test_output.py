"""Token shards and archives: exact round trips."""

import base64
import collections
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
import zstandard

from tidemark.llm import token_output, warc
from tidemark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_pieces_give_the_tokenizers_ids(tokenizer):
    draw = random.Random(2)
    bits = [" ", "  ", "\n", "\t", "a", "it's", "don't", "é", "1", "²", "!!", "...", "\x1c", "\x85", "中文", "<|endoftext|>", "😀", "_", "'", "The", "word,", "'ll"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 12))) for _ in range(3000)]
    found = token_output.Encoder(tokenizer_path()).encode(texts)
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in found] == [x.ids for x in want]


def test_tokens_round_trip(docs, tokenizer, monkeypatch):
    monkeypatch.setattr(token_output, "FRAME_IDS", 64)
    texts = ["some text here", None, "", "long " * 5000, "Ünïcode\n\n\n  spaces ", "some text here"]
    rows = [(i * 3 % 7, t) for i, t in enumerate(texts)]
    shards = token_output.write_tokens(docs(rows), tokenizer_path(), end_id=2)
    got = {r.doc_id: r for r in token_output.read_tokens(shards).collect()}
    start = 0
    for doc_id, t in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want = (doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        assert tuple(got[doc_id]) == want
        start += len(ids)
    # one document is read alone, and a damaged frame is noticed
    path = max(shards.collect(), key=lambda r: r.ids).path
    reader = token_output.ShardReader(path)
    assert len(reader.ids(len(reader.docs) - 1)) == reader.docs[-1]["n"]
    local = path.removeprefix("file://")
    data = bytearray(open(local, "rb").read())
    data[int(reader.offset[0]) + 12] ^= 255
    open(local, "wb").write(data)
    with pytest.raises(Exception):
        token_output.ShardReader(path).ids(0)


def test_tokens_odd_tables(docs):
    write = lambda rows: token_output.read_tokens(token_output.write_tokens(docs(rows), tokenizer_path()))
    assert write([]).collect() == []
    got = write([(None, "a"), (4, "b"), (4, "b"), (None, None)]).collect()
    assert sorted((str(r.doc_id) for r in got)) == ["4", "4", "None", "None"]
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)


def test_shards_are_plain_zstandard(docs):
    shards = token_output.write_tokens(docs([(1, "alpha beta"), (2, "gamma")]), tokenizer_path()).collect()
    data = open(shards[0].path.removeprefix("file://"), "rb").read()
    raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    reader = token_output.ShardReader(shards[0].path)
    assert raw == b"".join(reader.ids(i).tobytes() for i in range(len(reader.docs)))
    assert data[-4:] == (0x8F92EAB1).to_bytes(4, "little")


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    pages = [(1, "http://a/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "WARC/1.1\r\n\r\nHTTP/1.1 ü" * 999)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_warc(warc.arc_to_warc(warc.pages_to_arc(frame, version))).collect()}
    groups = collections.defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    for i, _, h in pages:
        data, top = (h or "").encode(), max(groups[h or ""])
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == top else ("revisit", top))
        assert r.date == "2024-01-01T00:00:00Z" and r.payload == (bytearray(data) if i == top else None)


def test_archives_odd_tables(spark):
    run = lambda rows, **k: warc.read_warc(warc.arc_to_warc(warc.pages_to_arc(spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")), **k))
    assert run([]).collect() == []
    got = run([(None, "u", "a", 1), (None, "u", "a", 1), (7, "u", "b", 1), (7, "u", "b", 1), (None, "v", "b", 1)]).collect()
    kinds = sorted((str(r.page_id), r.payload_digest == warc.sha1_base32(b"a"), r.record_type) for r in got)
    assert kinds == [("7", False, "response"), ("7", False, "response"), ("None", False, "revisit"), ("None", True, "response"), ("None", True, "response")]
    assert {r.record_type for r in run([(1, "u", "ab", 1), (2, "u", "ab", 1)], min_payload=3).collect()} == {"response"}


def test_arc_parser_reads_by_declared_length():
    body = b"line\nhttp://trap 1.2.3.4 20200101000000 text/plain 5\nxxxxx\n"
    for version in (1, 2):
        data = warc.arc_version_block(version, "f", "20200101000000")
        data += warc.arc_record(version, "http://has a space/", "1.2.3.4", "20200203040506", "text/plain", body)
        records = list(warc.parse_arc(iter([data])))
        assert [(h["URL"], c) for h, c in records] == [("http://has a space/", body)]
        made = warc.synthesise(*records[0])
        assert made["date"] == "2020-02-03T04:05:06Z" and made["id"] == warc.synthesise(*records[0])["id"]
    with pytest.raises(ValueError):
        list(warc.parse_arc(iter([data[:-20]])))
    with pytest.raises(ValueError):
        list(warc.parse_arc(iter([data.replace(b"Archive-length", b"Length")])))

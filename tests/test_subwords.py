"""Subword windows against encoding whole texts, and files of bytes that are taken once."""

import hashlib

import public_tokenizers
import pytest

from tessera.operators.subwords import Windows, subword_windows
from tessera.sources import files

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["a", " ", "  two  spaces \n\n\t end  ", "🙂👩‍👩‍👧 ñandú ﬁ " * 40, "\x80\x00 \u2028 x", "word " * 3000, "x" * 4000, "it's we'll  1234567 <|endoftext|> ok", "日本語のテキスト" * 200, " lead and trail "]


@pytest.mark.parametrize("size, overlap, piece", [(10, 3, 7), (50, 0, 100), (500, 50, 200_000), (7, 6, 1)])
def test_windows_of_whole_texts(size, overlap, piece):
    windows = Windows(RANKS, public_tokenizers.PATTERN, size, overlap)
    for text in ODD:
        whole = windows.encoding.encode_ordinary(text)
        found, start, wanted = list(windows.of(text, piece)), 0, []
        while True:  # as one would cut the ids of the whole text
            end = min(start + size, len(whole))
            wanted.append((start, end, windows.encoding.decode_bytes(whole[start:end]).decode("utf-8", "replace").strip()))
            if end == len(whole):
                break
            start = end - overlap
        assert [(s, e, c) for _, s, e, _, _, c in found] == wanted and [x[0] for x in found] == list(range(len(found)))
        raw, at, joined = text.encode(), 0, b""
        for _, _, _, a, b, content in found:
            assert raw[a:b].decode("utf-8", "replace").strip() == content
            joined, at = joined + raw[at:b], b
        assert joined == raw


def test_subword_windows_of_rows(spark):
    df = spark.createDataFrame([*enumerate(ODD), (90, None), (91, "")], "id int, body string")
    rows = subword_windows(df, doc="id", text="body", ranks=RANKS, pattern=public_tokenizers.PATTERN, size=20, overlap=5).collect()
    windows = Windows(RANKS, public_tokenizers.PATTERN, 20, 5)
    assert sorted(tuple(r) for r in rows) == sorted((i, *w) for i, t in enumerate(ODD) for w in windows.of(t))
    with pytest.raises(ValueError):
        Windows(RANKS, public_tokenizers.PATTERN, 5, 5)


def test_files_are_read_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    texts = {"a": "ö" * 10, "b": "", "c": "x" * 5000, "d": "fine"}
    assert files.write_documents(spark.createDataFrame(list(texts.items()), "name string, body string"), source, name="name", body="body", suffix=".htm") == 4
    assert files.ingest_bytes(spark, source, out, limit=1000) == files.Ingested(3, 0)
    assert files.ingest_bytes(spark, source, out, limit=1000) == files.Ingested(0, 3)
    (tmp_path / "in" / "e.htm").write_bytes(b"\xff\x00")
    assert files.ingest_bytes(spark, source, out, limit=1000) == files.Ingested(1, 3)
    found = {r.path.rsplit("/", 1)[1]: (r.length, r.status, r.content_hash) for r in files.ingested_files(spark, out).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert found == {"a.htm": (20, "ok", sha("ö".encode() * 10)), "c.htm": (5000, "too_large", None), "d.htm": (4, "ok", sha(b"fine")), "e.htm": (2, "ok", sha(b"\xff\x00"))}

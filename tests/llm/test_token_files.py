import random
import zlib

import numpy as np
import pyarrow as pa
from llm_data import awkward_rows, prose

from loomspark.llm._tokens import Encoder, default_tokenizer, encoded
from loomspark.llm._store import fresh_path
from loomspark.llm._text import utf8
from loomspark.llm.token_files import op10_token_files, read_token_files, write_token_files


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return t


def test_chunked_encoding_equals_the_library():
    t, own, draw = library(), Encoder(default_tokenizer()), random.Random(8)
    kinds = [" ab.,\n", "éÉß×÷ a.", "漢字 。a", "😀 ‍ a", "0123 .,x", "'s 't re ", "\t\n\r ab", "<|endoftext|> "]
    texts = ["".join(draw.choice(draw.choice(kinds)) for _ in range(draw.randrange(0, 300))) for _ in range(3_000)]
    texts += ["", "<|endoftext|>", "don't I'll we've", prose(1, 3_000), "x" * 20_000, "à b̀"]
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        ids, off = own.encode(*utf8(pa.array(part)))
        for k, e in enumerate(t.encode_batch(part, add_special_tokens=False)):
            assert ids[off[k] : off[k + 1]].tolist() == e.ids, part[k]


def test_added_tokens_are_encoded_as_the_unmodified_library_does():
    from tokenizers import Tokenizer

    t, draw = Tokenizer.from_file(default_tokenizer()), random.Random(9)
    texts = ["a<|endoftext|>b", "", "<|endoftext|>", "a<|endof", "text|>b", prose(1, 50), "é <|endoftext|><|endoftext|> x"]
    texts += ["".join(draw.choice([" ab", "<|endoftext|>", "|", ".\n", "<|", "é"]) for _ in range(draw.randrange(0, 20))) for _ in range(500)]
    wanted = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert wanted[0] == [64, 50256, 65]
    found = []
    for _, ids, off in encoded(pa.array(texts), default_tokenizer()):
        found += [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)]
    assert found == wanted


def lawful(found, rows):
    t, at = library(), 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    found = sorted(found, key=lambda r: r.start)
    assert len(found) == len(rows)
    for r, (doc_id, text, *_) in zip(found, ordered, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_driver_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    lawful(op10_token_files(spark, "/root/testdata/sf0.001").collect(), docs)


def test_awkward_rows(spark, awkward):
    lawful(op10_token_files(spark, awkward).collect(), awkward_rows())


def test_files_are_pruned_by_id(spark):
    """Bloom filters and stripe statistics are in the files; a reader of one id gets that row."""
    path = fresh_path(spark, "orc-test")
    docs = spark.createDataFrame([(i, prose(i, 20)) for i in range(500)], "doc_id long, text string")
    write_token_files(docs, path)
    import pyarrow.dataset as ds

    assert ds.dataset(path.removeprefix("file://"), format="orc").count_rows() == 500
    one = read_token_files(spark, path).where("doc_id = 77")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in one._jdf.queryExecution().toString()
    t = library()
    assert t.decode(one.collect()[0].ids[:-1]) == prose(77, 20)


def test_empty(spark, empty):
    assert op10_token_files(spark, empty).count() == 0

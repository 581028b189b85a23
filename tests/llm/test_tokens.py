import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cuemill.llm.tokens import EliasFano, Encoder, Shard, read_token_documents, write_token_shards
from cuemill.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 10**9), (700, 3), (700, 10**6), (3000, 2**40)])
def test_elias_fano_round_trip(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    coded = EliasFano.read(EliasFano.encode(v))
    assert coded.values().tolist() == v.tolist()
    assert [coded.access(i) for i in range(0, n, 7)] == v[::7].tolist()


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(1).integers(1, 1500, 10_000))
    assert len(EliasFano.encode(v)) < 10_000 * 14 / 8


def test_encoder_equals_the_library():
    library, own = Tokenizer.from_file(PATH), Encoder(PATH)
    rng = random.Random(5)
    texts = ["", " ", "  ", "a ", " a", "a  b", "a\n b", "a \nb", "\xa0 x", "it's 's 42 é ü", "x<|endoftext|> y"]
    texts += ["".join(rng.choice("aB é½²²\xad'st \n\r\x1c\x85\xa0 1.,!ßŁ中 ") for _ in range(rng.randrange(40))) for _ in range(800)]
    texts += ["".join(rng.choice("ab é'\n\t 1., ß") for _ in range(rng.randrange(60))) for _ in range(800)]
    got = own.encode(texts) + own.encode(texts)
    for text, body in zip(texts * 2, got):
        assert np.frombuffer(body, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_files_round_trip(spark):
    import zlib

    library = Tokenizer.from_file(PATH)
    rows = [(i, f"text {i} " + "word " * (i % 50), "x") for i in range(300)]
    rows += [(300, None, "x"), (301, "", "x"), (5, "text 5 again", "x"), (None, "no id", "x"), (302, "long " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = scratch_path(spark, "tokens")
    write_token_shards(docs, path, PATH, shard_tokens=500)
    got = read_token_documents(spark, path).orderBy("start").collect()
    at = 0
    wanted = sorted(((i, t or "") for i, t, _ in rows if i is not None))
    assert [r.doc_id for r in got] == [i for i, _ in wanted]
    for row, (_, text) in zip(got, wanted):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    first = spark.read.parquet(path).orderBy("part", "seq").first()
    shard = Shard(first.payload)
    assert shard.document(1)[-1] == 0 and shard.doc_ids()[0] == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = scratch_path(spark, "tokens")
    write_token_shards(docs, path, PATH)
    assert read_token_documents(spark, path).count() == 0


def test_long_words_are_not_kept():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a " + "x" * 500 + " b " + "1" * 90 + "y" * 90, "b b " + "é" * 200]
    wanted = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == wanted
    assert encoder.words and max(map(len, encoder.words)) <= Encoder.LONGEST

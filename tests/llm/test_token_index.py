import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logframe.llm import token_index
from logframe.llm.common import Scratch
from tests.llm.conftest import clashing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow_rows(docs):
    """(doc_id, start, n_tokens, ids_crc32), from the library, documents in the order of the data set."""
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    out, start = [], 0
    for d, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def back(df):
    return [tuple(r) for r in df.orderBy("start").collect()]


def test_round_trip_of_a_table(spark, documents):
    docs = [tuple(r) for r in documents.select("doc_id", "text").orderBy("doc_id").collect()]
    assert back(token_index.round_trip(documents, PATH)) == slow_rows(docs)


def test_round_trip_of_odd_documents(spark, odd, empty):
    got = back(token_index.round_trip(clashing(odd), PATH))
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    # the order inside one id is that of a hash: only the ids' order and each document's content are fixed
    assert [r[0] for r in got] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d))
    assert sorted((repr(r[0]), r[2], r[3]) for r in got) == sorted((repr(r[0]), r[2], r[3]) for r in slow_rows(docs))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got]).tolist()[:-1]]
    assert token_index.round_trip(empty, PATH).count() == 0


def test_special_strings_and_long_texts(spark):
    texts = ["<|endoftext|> a <|endoftext|>", "a" * 200_000, "ab " * 40_000, "\n" * 50_000, "x<|endoftext|>", "日本" * 30_000]
    rows = list(enumerate(texts))
    assert back(token_index.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH)) == slow_rows(rows)


def test_one_key_with_most_rows_runs_over_shards(spark):
    rows = [(5, "the same text")] * 6000 + [(5, f"text {i}") for i in range(50)] + [(i, "other") for i in range(20, 60)] + [(None, "nobody")] * 3000
    home = f"{Scratch(spark, 't').home}/d"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    token_index.write(df, home, PATH)
    data = token_index.DataSet(home)
    assert len(data.shards) > 2
    assert [len(data.get(k)) for k in (5, 20, 59, None, 6, 19, -1)] == [6050, 1, 1, 3000, 0, 0, 0]
    got = back(token_index.read(df, home))
    assert len(got) == len(rows) and [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got]).tolist()[:-1]]
    assert back(token_index.read(spark.createDataFrame([(59,), (7,), (None,)], "doc_id long"), home)) == [r for r in got if r[0] in (None, 59)]
    with pytest.raises(FileNotFoundError):
        token_index.remove(spark, home) or token_index.DataSet(home)


def test_lookups_one_at_a_time(spark, documents):
    home = f"{Scratch(spark, 't').home}/d"
    token_index.write(documents, home, PATH)
    data, library = token_index.DataSet(home), Tokenizer.from_file(PATH)
    for r in documents.limit(40).collect():
        assert [i.tolist() for i in data.get(r["doc_id"])] == [library.encode(r["text"] or "", add_special_tokens=False).ids]


def test_perfect_hash_is_minimal_and_refuses_others():
    keys = np.arange(-30_000, 70_000, dtype=np.int64) * 1_000_003
    h = token_index.key_hash(keys)
    mph = token_index.MinimalPerfectHash.of(h)
    assert sorted(mph(h).tolist()) == list(range(len(keys)))
    again, size = token_index.MinimalPerfectHash.load(mph.dump() + b"more")
    assert (again(h) == mph(h)).all() and size == len(mph.dump()) and size * 8 / len(keys) < 6
    # with no level left over every hash is listed
    listed = token_index.MinimalPerfectHash([], np.sort(h[:100]))
    assert sorted(listed(h[:100]).tolist()) == list(range(100)) and (listed(h[100:200]) == -1).all()
    entries = np.zeros(len(keys), dtype=token_index.ENTRY)
    entries["record"], entries["fingerprint"] = np.arange(len(keys)), token_index.fingerprint(h)
    cell = token_index.cell_bytes(h, entries)
    there, got = token_index.find_in_cell(cell, h)
    assert len(there) == len(keys) and (got["record"] == there).all()
    assert len(token_index.find_in_cell(cell, token_index.key_hash(keys + 1))[0]) == 0


def test_key_hash_is_that_of_the_sql_function(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").selectExpr("xxhash64(k)").collect()
    assert [int(x) for x in token_index.key_hash(np.array(keys, dtype=np.int64)).view(np.int64)] == [r[0] for r in rows]

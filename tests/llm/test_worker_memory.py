"""What the encoder's tasks leave in the Python workers, which outlive them and stand beside later stages."""

import os
import time

import public_tokenizers
import pyarrow as pa

from logframe.llm import bpe

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_workers_keep_no_texts(spark):
    docs = spark.range(0, 16, 1, 16).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 3000), x -> concat('w', id, 'x', x))) AS text")

    def left(batches):
        for _ in batches:
            time.sleep(0.3)
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(bpe.codec(WORDS).known)])], names=["pid", "known"])

    for encoded in (bpe.encode(docs, WORDS), bpe.token_digests(docs, WORDS)):
        assert encoded.filter("n_tokens > 0").count() == 16
        assert {r.known for r in spark.range(0, 16, 1, 16).mapInArrow(left, "pid long, known long").collect()} == {0}


def test_long_stretches_are_not_all_remembered():
    c = bpe.WordBpe(WORDS)
    for i in range(30):
        assert len(list(c.texts([f"{i}" + "ab" * 100_000]))) == 1
        assert sum(map(len, c.known)) <= 4_300_000
    assert list(c.texts(["0" + "ab" * 3, "", None]))[1:] == [(0, "", "")] * 2


def test_blocks_of_a_batch_keep_their_rows(spark):
    docs = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "concat(id, repeat(' word', 20000)) AS text")
    assert [(r.doc_id, r.text.split()[0], r.n_tokens > 20_000) for r in bpe.encode(docs, WORDS).collect()] == [(i, str(i), True) for i in range(40)]

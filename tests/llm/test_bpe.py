"""Token ids against the tiktoken library, and the exact way back."""

import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from callrank.llm import bpe, queries

RANKS = queries.RANKS


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.load_ranks(RANKS))


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_random_texts(vocabulary, reference):
    rnd = random.Random(11)
    parts = [*"abstrevmldlXYZ09 \n\t.,!?", "'s", "'ll", "'ve", " '", "''", "é", "ß", "中", "😀", " ", "　", "\0", "́", "²"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
    for text, packed in zip(texts, vocabulary.encode(texts), strict=True):
        assert ids(packed) == reference.encode_ordinary(text), repr(text)
        assert vocabulary.decode(packed, vocabulary.offsets(packed)) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "\n\n", "a" * 5000, "ab" * 4000, " " * 3000, "x \n y", "it's we'll 've", "<|endoftext|>"])
def test_edges(vocabulary, reference, text):
    assert ids(vocabulary.encode([text])[0]) == reference.encode_ordinary(text)


def test_short_and_long_merging_agree(vocabulary):
    rnd = random.Random(3)
    for _ in range(300):
        piece = "".join(rnd.choice("aeinrst") for _ in range(rnd.randint(1, 120))).encode()
        assert vocabulary.merged(piece) == vocabulary.merged_long(piece)


def test_documents(spark, documents, reference):
    texts = ["Hello there", None, "", "  two  spaces ", "Hello there"]
    df = documents(texts).withColumn("IDS", F.lit("mine"))
    rows = {r.doc_id: r for r in bpe.encode_documents(df, RANKS).collect()}
    for i, text in enumerate(texts):
        assert ids(bytes(rows[i].ids)) == reference.encode_ordinary(text or "")
        assert bytes(rows[i].decoded) == (text or "").encode()
        assert rows[i].n_tokens == len(reference.encode_ordinary(text or ""))
    assert bpe.encode_documents(df.limit(0), RANKS).count() == 0


def test_decoded_column(spark, documents):
    df = documents(["some text", "více slov"])
    coded = df.select("text", bpe.encoded(spark, F.col("text"), RANKS).alias("c"))
    back = coded.select("text", bpe.decoded(spark, F.col("c.ids"), F.col("c.offsets"), RANKS).alias("b")).collect()
    assert all(bytes(r.b).decode() == r.text for r in back)


def test_query_against_the_library(spark, sf_dir, reference):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op2_bpe(spark, sf_dir).collect():
        want = reference.encode_ordinary(texts.pop(r.doc_id))
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
    assert not texts

"""Byte-level BPE against tiktoken, token files against the tokenizers library."""

import base64
import glob
import hashlib
import random
import uuid
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers as public
import pytest
import tiktoken
from tokenizers import Tokenizer

from duskrank.llm import bpe, token_files
from duskrank.session import scratch_root

RANKS = public.path("byte_bpe_50k.tiktoken")
WORDS = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_equals_plain_merging(reference):
    ranks, rng = bpe.load_ranks(RANKS), random.Random(1)
    for _ in range(400):
        piece = bytes(rng.choices(b"abcdeth aing\xc3\xa9 \n0123", k=rng.randint(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if piece in ranks:
            parts = [piece]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert bpe.merge(piece, ranks) == [ranks[p] for p in parts]


def test_merge_of_a_huge_match():
    ranks = bpe.load_ranks(RANKS)
    tokens = {rank: token for token, rank in ranks.items()}
    assert b"".join(tokens[i] for i in bpe.merge(b"ab" * 100_000, ranks)) == b"ab" * 100_000


def test_digests_equal_the_library(edge_docs, reference):
    got = sorted(map(tuple, bpe.digests(edge_docs, RANKS, public.PATTERN).collect()), key=str)
    want = []
    for row in edge_docs.collect():
        text = row["text"] or ""
        ids = reference.encode_ordinary(text)
        hashed = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((row["doc_id"], len(ids), hashed, hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_other_columns_stay(edge_docs):
    coded = bpe.encode(edge_docs, RANKS, public.PATTERN, keep_text=True)
    assert coded.columns == [*edge_docs.columns, "ids"]
    assert bpe.decode(coded, RANKS).filter("coalesce(text, '') <> cast(decoded as string)").count() == 0


def test_empty_tables(spark, no_docs):
    assert bpe.digests(no_docs, RANKS, public.PATTERN).count() == 0
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}/no_tokens"
    token_files.write_token_files(no_docs, path, WORDS, 2)
    assert token_files.with_crc(token_files.read_token_files(spark, path)).count() == 0


def test_parts_are_exact(reference):
    tokenizer, words = Tokenizer.from_file(WORDS), token_files.Words(WORDS, 10)
    texts = ["It's 'don't.' Ünd ß... (naïve) 12.5%,", "a\x1cb c\x1d", "<|endoftext|>. x<|endoftext|>", "É́t.é, İi ΑΣ Σ.", ""]
    for text, ids in zip(texts, words.ids(texts), strict=True):
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_random_strings_equal_the_library():
    """Marks, combining marks, letters with odd lower cases and odd spaces in any order."""
    tokenizer, words, rng = Tokenizer.from_file(WORDS), token_files.Words(WORDS, 500), random.Random(8)
    letters = [*"abEVNZLIxyz", "İ", "ı", "ß", "ẞ", "Σ", "ς", "Ǆ", "é", "É", "ﬁ", "ʼn", "K", "Å", "ü", "東", "🙂", "ø"]
    marks = [*".,;:!?*$%&#|'-_()<>0129", "\u0307", "\u0301", "\u0308", "\u200d"]
    spaces = [*" \t\n\r\x0b\x0c\x1c\x1f\x85", "\u00a0", "\u2009", "\u3000", "\u2028"]
    texts = ["EVİ.", "DENİZLİ, 1990", "İ", "İ.", "i\u0307.", " a ", "", "\u00a0.", None]
    for _ in range(4000):
        texts.append("".join(rng.choice(rng.choice((letters, letters, letters, marks, spaces))) for _ in range(rng.randint(1, 14))))
    got = words.ids(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_token_files(spark, edge_docs):
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}/edge_tokens"
    token_files.write_token_files(edge_docs, path, WORDS, 2)
    got = token_files.with_crc(token_files.read_token_files(spark, path)).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = []
    for row in edge_docs.collect():
        ids = [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 2]
        want.append((row["doc_id"], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_selective_reads_skip_the_ids(spark, edge_docs):
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}/selective_tokens"
    token_files.write_token_files(edge_docs, path, WORDS, 2)
    plan = spark.read.parquet(path).filter("doc_id = 3").select("n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "EqualTo(doc_id,3)" in plan


def test_files_have_the_set_layout(spark, edge_docs, make_docs, prose):
    """Dictionaries, delta encodings, page indexes and page sizes as the files themselves say."""
    docs = edge_docs.unionByName(make_docs([(100 + k, prose(k % 40, 30), "a") for k in range(3000)]))
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}/layout_tokens"
    token_files.write_token_files(docs.coalesce(1), path, WORDS, 2)
    files = [f for f in glob.glob(f"{path.removeprefix('file://')}/*.parquet")]
    pages = 0
    for name in files:
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 48 << 20
            for c in range(group.num_columns):
                column = group.column(c)
                where = column.path_in_schema
                assert column.has_offset_index and (column.has_column_index or where.startswith("ids"))
                if where.startswith("ids"):
                    assert column.has_dictionary_page and "RLE_DICTIONARY" in column.encodings
                elif where != "part":
                    assert not column.has_dictionary_page and "DELTA_BINARY_PACKED" in column.encodings, column
                pages += where == "doc_id"
    assert files and pages >= 1

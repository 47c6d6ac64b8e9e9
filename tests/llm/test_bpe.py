import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import bpe


def texts():
    rng = random.Random(5)
    odd = ["", " ", "a", "don't we'll I'M it's", "\x1c x\x85y z w", "tab\t\tnew\r\n\n  end  ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "x" * 5000, "é" * 700 + "日本語" * 50, "🙂👩‍👩‍👧 ١٢٣ ½ Ⅷ", "Á ​ ﻿　", "0123456789" * 30, "=     -"]
    letters = "abcdefghij ABC  \n\t.,'!|$éßñ日本  ١🙂"
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(300)]


def test_same_as_the_library(spark):
    path = bpe.default_tokenizer()
    theirs = Tokenizer.from_file(path)
    all_texts = texts()
    rows = [(i, t, 7) for i, t in enumerate(all_texts)] + [(len(all_texts), None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.digests(bpe.encode_decode(docs, path)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, dtype="<u4").tobytes()
        assert got[i].n_tokens == len(ids), text
        assert got[i].ids_sha256 == hashlib.sha256(packed).hexdigest(), text
        assert got[i].decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(docs, bpe.default_tokenizer()).count() == 0
    twice = spark.createDataFrame([(1, "same"), (1, "same"), (None, "same")], "doc_id long, text string")
    assert bpe.encode_decode(twice, bpe.default_tokenizer()).count() == 3


def test_leftmost_lowest_rank_first():
    merges = bpe.Merges(bpe.default_tokenizer())
    assert bpe.merge(b"", merges) == []
    assert len(bpe.merge(b"aaaaaaaaa" * 2000, merges)) < 18000

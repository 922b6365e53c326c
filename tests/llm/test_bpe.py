import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from docloom.llm import bpe
from docloom.llm.common import read

from .rows import no_docs, odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(spark, docs):
    lib = Tokenizer.from_file(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    got = [(str(r[0]), *r[1:]) for r in bpe.encode(docs, PATH, digests=True).collect()]
    assert sorted(got) == sorted(want)


def test_tables(spark, sf):
    check(spark, read(spark, sf, "documents"))


def test_odd_rows(spark):
    check(spark, odd_docs(spark))
    assert bpe.encode(no_docs(spark), PATH).count() == 0
    row = bpe.encode(odd_docs(spark), PATH, keep=("slot",)).where("doc_id = 6")
    assert row.first()["slot"] == "s" and row.first()["n_tokens"] == len(row.first()["ids"]) == 1
    assert bpe.decode(row, PATH).first()["text"] == "one</w>"


def test_random_strings(spark):
    rng = random.Random(3)
    pool = "aaaabbbcdetTTHEIın .,'’\"<|>()\n\t#%&0123４五éÉßẞǅﬁΣςσİıñ́̀中文кирЖ🙂‍\x1c\x1f  "
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([*range(1, 0xD800), *range(0xE000, 0x3000)] if k % 2 else range(0x20, 0x2000))) for _ in range(30)) for k in range(300)]
    check(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))

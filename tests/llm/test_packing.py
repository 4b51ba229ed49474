import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from dunlin.llm import packing
from dunlin.llm.shared import text_buffer
from tests.llm.data import AWKWARD, documents, empty, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers(reference):
    rnd = random.Random(3)
    texts = [t or "" for t in AWKWARD.values()]
    texts += ["it's we're I'll  don't", "  's 's\n's ''s !'s 'sabc 're\t've x'é", "a  b\n\n c \t\n", "<|endoftext|> 123abc²", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "é²<|endoftext|>", "'", "a'", "a'l", "b'\n", "  ", "x   y", "1's 2've"]
    texts += ["".join(rnd.choice("ab'stlrevmd  \n\t!1.é ß") for _ in range(80)) for _ in range(400)]
    got = packing.Encoder(PATH).encode(*text_buffer(pa.array(texts)))
    assert reference("a <|endoftext|> b") == [64, 220, 50256, 275]
    assert [g.tolist() for g in got] == [reference(t) for t in texts]


def test_pieces_cover_documents_and_fill_sequences(spark, reference):
    texts = AWKWARD | {100 + k: words(k, n) for k, n in enumerate([3, 700, 1500, 40, 90, 4000, 12, 300])}
    out = packing.pack(documents(spark, texts), PATH).collect()
    ids = {i: np.array(reference(t) + [1], "<u4") for i, t in texts.items()}
    at = dict.fromkeys(texts, 0)
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start: r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    fill, window = {}, {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
        window[r.sequence_id] = r.window
    assert fill == window and all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())


def test_steps_weigh_alike():
    p = packing.Packer()
    rnd = random.Random(5)
    for k in range(3000):
        p.add(k, rnd.choice([5, 90, 700, 1100, 2500, 9000]))
    p.pack(True)
    total = sum(size for size, _ in p.done)
    assert total == sum(x[2] for _, pieces in p.done for x in pieces)
    assert sum(size < 256 for size, _ in p.done) <= 8


def test_repeated_rows_and_empty_table(spark):
    out = packing.pack(documents(spark, {1: None, 2: "a b"}, repeat=(1, 2)), PATH).collect()
    assert sum(r.length for r in out if r.doc_id == 1) == 2
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out) and sum(r.length for r in out) == 2 * (1 + 3)
    assert packing.pack(empty(spark), PATH).count() == 0

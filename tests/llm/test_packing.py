import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recollect.llm import packing
from recollect.llm.queries import byte_bpe


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def rebuilt(pieces):
    """Each document's ids from its pieces; checks that sequences have no gaps."""
    sequences, docs = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        sequences.setdefault(p.sequence_id, []).append((p.offset, len(ids)))
        docs.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids.tolist()))
    lengths = []
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        lengths.append(at)
    return docs, lengths


@pytest.mark.parametrize("partitions", [1, 7])
def test_every_id_once_and_little_padding(spark, awkward, awkward_rows, tokenizer, partitions):
    pieces = packing.pack(awkward.repartition(partitions), byte_bpe(), size=128, open_windows=3).collect()
    docs, lengths = rebuilt(pieces)
    assert max(lengths) <= 128 and sum(n < 128 for n in lengths) <= 1
    got = {k[0]: [i for _, ids in sorted(v) for i in ids] for k, v in docs.items()}
    assert got == {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in awkward_rows}


def test_both_encoders_agree_on_every_character(tokenizer):
    encode = byte_bpe()()
    for code in [*range(0x20, 0x250), 9, 10, 13]:
        for text in (chr(code), f"a{chr(code)}b 1{chr(code)}2", f" {chr(code)}{chr(code)}  x"):
            assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, hex(code)


def test_repeated_null_and_empty_rows(spark, unnamed, empty_docs):
    pieces = packing.pack(unnamed, byte_bpe()).collect()
    assert sum(p.start == 0 for p in pieces) == unnamed.count()
    assert packing.pack(empty_docs, byte_bpe()).count() == 0

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import queries, token_files, vocab
from glyphmill.scratch import scratch_dir

from .conftest import ODD

NAME = "byte_bpe_50k.json"
LIBRARY = tokenizers.Tokenizer.from_file(public_tokenizers.path(NAME))


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


@given(st.text(alphabet="ab \n\t  \x1c'sé中<|endoftext|>1!", max_size=40))
@settings(max_examples=300, deadline=None)
def test_runs_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(vocab.byte_bpe(NAME).encode([text])[0], "<u4").tolist() == ids(text)[:-1]


@pytest.mark.parametrize("bits", [False, True])
@given(docs=st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=20), max_size=12), block=st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_file_round_trip(bits, docs, block):
    out = io.BytesIO()
    writer = token_files.Writer(out, block, bits)
    for i, d in enumerate(docs):
        writer.add(None if i == 1 else i, np.array(d, "<u4").tobytes())
    writer.close()
    size = out.tell()
    reader = token_files.Reader(out, size, bits)
    got = np.concatenate([reader.block(k) for k in range(len(reader.blocks))] or [np.zeros(0)]).tolist()
    assert got == [x for d in docs for x in d]
    starts = np.cumsum([0, *map(len, docs)])
    assert list(reader.documents()) == [(None if i == 1 else i, starts[i], len(d), crc(d)) for i, d in enumerate(docs)]
    assert all(n == block for n in reader.blocks[:-1, 1])


@pytest.mark.parametrize("bits", [False, True])
def test_files_in_document_order(spark, odd, bits):
    files = token_files.write_token_files(odd, scratch_dir(spark, "f"), NAME, 2, block=64, ids_per_file=500, bits=bits)
    assert files.count() >= 3
    got = sorted(token_files.read_token_files(files, bits).collect(), key=lambda r: r.start)
    want, start = [], 0
    for d, t in sorted(((d, t or "") for d, t, _ in ODD), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1].encode()), x[1].encode())):
        want.append((d, start, len(ids(t)), crc(ids(t))))
        start += len(ids(t))
    assert [tuple(r) for r in got] == want


def test_no_files_for_no_rows(spark, documents):
    files = token_files.write_token_files(documents([]), scratch_dir(spark, "f"), NAME, 2)
    assert files.count() == 0 and token_files.read_token_files(files).count() == 0


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(queries.op2_bit_planes(spark, sf).collect(), key=lambda r: r.doc_id)
    start = 0
    for d, r in zip(spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect(), got, strict=True):
        assert tuple(r) == (d.doc_id, start, len(ids(d.text)), crc(ids(d.text)))
        start += r.n_tokens

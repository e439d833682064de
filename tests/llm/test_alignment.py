import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from glyphmill.llm import alignment, queries
from glyphmill.llm.alignment import Aligner, Fragment

from .conftest import ODD

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [
    "a b", " lead", "two  spaces", "tab\t x", "line\n next", "end ", "  ", "it's we'll", "<|endoftext|> and </s> <0x0A>", "▁ piece", "x▁ y", "中文 字 　 wide", "\U0001f600\U0001f600 ok", "é ü ß",
    "\x00 nul", "a\r\nb", "...;\r {\r", "1 2 33 444", "n" * 300, " \x1c y", "  z", "a\xa0b \xa0c", "\nfirst", "a \nb", "ﬁ Ⅳ", "á ́b",
]


def libraries():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))


def plain(text, a, b):
    """Groups of the whole text at once, token by token."""
    if not text:
        return None
    table = {c: i for i, c in alignment._byte_of().items()}
    ids_a, ids_b, spaced = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
    raw_a = [bytes(k for c in a.id_to_token(i) for k, v in table.items() if v == c) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(raw_a) != spaced or b"".join(raw_b) != spaced:
        return None
    ends = lambda raw: [sum(map(len, raw[: k + 1])) for k in range(len(raw))]
    ends_a, ends_b = ends(raw_a), ends(raw_b)
    common = sorted(set(ends_a) & set(ends_b))
    out, last = [], 0
    for c in common:
        out.append(([i for i, e in zip(ids_a, ends_a) if last < e <= c], [i for i, e in zip(ids_b, ends_b) if last < e <= c]))
        last = c
    return out


def brute(rows):
    """``(doc_id, text)`` to the rows of the query."""
    a, b = libraries()
    found = [(i, plain(t, a, b)) for i, t in rows]
    links = Counter((x[-1], y[-1]) for _, groups in found for x, y in groups or [])
    highest = {}
    for (_, y), n in links.items():
        highest[y] = max(n, highest.get(y, 0))
    out = []
    for i, groups in found:
        if not groups:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        counts = [links[x[-1], y[-1]] for x, y in groups]
        best = sum(n == highest[y[-1]] for n, (_, y) in zip(counts, groups))
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(groups), best, sum(counts), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs, size, hot=alignment.HOT):
    made = alignment.align(docs, A, B, size=size)
    rows = alignment.materialize(made.withColumn("sha", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")), "aligned")
    got = alignment.linked(rows, hot).select("ident", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "sha")
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_units_of_a_text_equal_the_whole_text():
    a, b = libraries()
    aligner = Aligner(A, B)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["a", "the", " ", " ", "\n", "é", "中", "'s", "1", ".", "\t", "　"]) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    for text in texts + texts:
        want = plain(text, a, b)
        got = aligner.document(" " + text)
        assert got.differs == (want is None), repr(text)
        if want:
            assert got.groups() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want), repr(text)


def test_fragments_of_any_ranges_compose_to_the_whole_in_any_grouping():
    aligner, rng = Aligner(A, B), random.Random(3)
    for text in ["It isn't known; unbelievably, 12345 trees\nwere  found — “there” in 中文.", "word " * 20, "nospaceatall" * 9]:
        spaced = " " + text
        n = len(spaced.encode())
        whole = aligner.document(spaced)
        for _ in range(30):
            edges = [0, *sorted(rng.sample(range(1, n), rng.randrange(1, 9))), n]
            parts = [aligner.fragment(spaced, x, y) for x, y in zip(edges, edges[1:])]
            while len(parts) > 1:
                i = rng.randrange(len(parts) - 1)
                parts[i : i + 2] = [parts[i].then(parts[i + 1])]
            assert parts[0].groups() == whole.groups() and not parts[0].suf_a
            assert (parts[0].n_a, parts[0].n_b, parts[0].n_groups, parts[0].pairs, parts[0].times) == (whole.n_a, whole.n_b, whole.n_groups, whole.pairs, whole.times)
        assert Fragment().then(whole) == whole == whole.then(Fragment())


@pytest.mark.parametrize(("size", "hot"), [(1 << 15, 1 << 18), (7, 3), (64, 1)])
def test_odd_rows_equal_brute_force(spark, odd, documents, size, hot):
    """Documents whole and in small ranges; pairs sent to the tasks and joined."""
    few = [(i, t[:400] if t else t, s) for i, t, s in ODD] + [(100 + k, t, "t") for k, t in enumerate(TEXTS)]
    docs = documents(few).withColumns({"row": F.lit("x"), "k": F.lit(1), "pairs": F.lit(2), "groups": F.lit(None)})
    assert run(docs, size, hot) == brute([(i, t) for i, t, _ in few])
    assert run(documents([]), size, hot) == []


def test_long_texts_in_many_ranges(spark, documents):
    rows = [(1, "Some words of prose, with marks. " * 2000, "s"), (2, "x" * 3000, "s"), (3, "one two\n" * 3000, "s"), (4, "▁" + "bad word " * 2000, "s")]
    assert run(documents(rows), 1000) == run(documents(rows), 1 << 20)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op12_fragment_monoid(spark, sf).collect()), key=str)
    assert len(got) == len(docs)
    few = [(i, t) for i, t in docs if len(t or "") < 3000]
    a, b = libraries()
    shown = {r[0]: r for r in got}
    for i, t in few:
        groups = plain(t, a, b)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or [])
        assert shown[i][7] == (hashlib.sha256(text.encode()).hexdigest() if groups else "")

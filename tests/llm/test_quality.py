import collections
import math
import re

import public_tokenizers
import sentencepiece

from glyphmill.llm import quality, queries

from .conftest import ODD

NAME = "piece_bpe_32k.model"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAME))


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed


def base(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


MORE = [
    (20, "a b c a b c x\n\n \na b c\nx\nx\n x", "s"), (21, "été x y\x1cz " * 30, "s"), (22, "p q " * 40, "s"), (23, "# * $ |<>|" * 20, "s"),
    (24, " ".join(f"w{i}" for i in range(50)), "s"), (25, " ".join(f"w{i}" for i in range(49)), "s"),
]


def test_query_on_odd_rows(spark, documents, stored):
    rows = ODD + MORE
    at = stored(documents=documents(rows))
    got = queries.op3_fertility(spark, at).collect()
    assert sorted(((r.doc_id, *base(r)) for r in got), key=str) == sorted(((d, *brute(t)) for d, t, _ in rows), key=str)
    assert not any(r.kept for r in got if r.base_failed)
    assert queries.op3_fertility(spark, stored(documents=documents([]))).count() == 0


def test_query_over_a_table_and_its_labels(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op3_fertility(spark, sf).collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        assert base(r) == brute(texts[d])
    judged = [r for r in got.values() if not r.base_failed]
    assert all(r.kept for r in judged if good.get(r.doc_id) == 1)
    assert any(not r.kept for r in judged if good.get(r.doc_id) == 0)


def test_measures(spark):
    text = "the cat 亜\U00012345 sat"
    ids = LIBRARY.encode(text)
    got = quality.measure(text, LIBRARY, quality._byte_pieces(NAME))
    share = collections.Counter(ids)
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in share.values())
    assert got[5] == len(ids) and got[6] == len(text) / len(ids) and abs(got[8] - entropy) < 1e-9
    assert got[7] == sum(LIBRARY.is_byte(i) for i in ids) / len(ids) > 0


def test_bands_reject_text_unlike_its_group(spark):
    import random

    rng = random.Random(5)
    syllables = ["the", "ing", "er", "on", "an", "re", "tion", "st"]
    plain = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, plain(rng.randrange(60, 400)), "x" if i % 2 else None) for i in range(200)]
    rows += [(1000, "".join(chr(0x12000 + i % 500) + " " for i in range(400)), "x"), (1001, " ".join(hex(rng.getrandbits(60)) for _ in range(80)), None)]
    rows += [(1002, plain(100), "rare"), (1003, rows[0][1], None), (1003, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumnRenamed("kept", "lang").selectExpr("*", "'old' as kept", "1 as texts")
    got = {r.doc_id: r.kept for r in quality.judge(docs, NAME).collect()}
    assert [d for d, k in sorted(got.items()) if not k] == [1000, 1001]


def quartiles(rows):
    """Of ``(chars_per_token, entropy, byte_share, n_tokens)``: first, second and third of each, on the bins of the histograms."""
    out = []
    for at in (lambda r: math.floor(r[0] * 100) / 100, lambda r: math.floor(r[1] * 50) / 50, lambda r: math.floor(r[2] * 200) / 200, lambda r: 2 ** (math.floor(math.log2(max(r[3], 1)) * 20) / 20)):
        values = sorted(map(at, rows))
        out.append([next(v for i, v in enumerate(values) if 4 * (i + 1) >= k * len(values)) for k in (1, 2, 3)])
    return out


def verdicts(rows, rules=quality.Bands()):
    """``(group, base_failed, chars_per_token, entropy, byte_share, n_tokens)`` to kept, row by row."""
    passing = collections.defaultdict(list)
    for group, failed, *m in rows:
        if not failed:
            passing[group].append(m)
    everything = [m for ms in passing.values() for m in ms]
    out = []
    for group, failed, c, h, b, n in rows:
        if failed:
            out.append(False)
            continue
        (c1, c2, c3), (h1, h2, h3), (b1, b2, b3), (_, tokens, _) = quartiles(passing[group] if len(passing[group]) >= rules.least_group else everything)
        wide = max(1.0, math.sqrt(tokens / max(n, 1)))
        out.append(
            abs(c - c2) <= rules.spreads[0] * wide * max(c3 - c1, rules.least_range[0] * c2) and h >= h2 - rules.spreads[1] * wide * max(h3 - h1, rules.least_range[1])
            and b <= b2 + rules.spreads[2] * wide * max(b3 - b1, rules.least_range[2])
        )
    return out


def test_verdicts_equal_brute_force(spark):
    got = queries.op3_fertility(spark, "/root/testdata/sf0.01").collect()
    want = verdicts([(r.lang, r.base_failed, r.chars_per_token, r.entropy, r.byte_share, r.n_tokens) for r in got])
    assert [r.kept for r in got] == want and 0 < sum(want) < len(want)


def test_junk_goes_whatever_the_size_of_its_group(spark):
    import random

    rng = random.Random(7)
    plain = lambda n: " ".join("".join(rng.choices(["the", "ing", "er", "on", "an"], k=rng.randrange(1, 4))) for _ in range(n))
    junk = " ".join(hex(rng.getrandbits(60)) for _ in range(120))
    for size in (1, 28, 29, 30, 31):
        rows = [(i, plain(200), "large") for i in range(60)] + [(100 + i, plain(200), "small") for i in range(size)] + [(999, junk, "small")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert [r.doc_id for r in quality.judge(docs, NAME).filter("not kept").collect()] == [999]

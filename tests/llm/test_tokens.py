"""Token files, packing and the byte-pair automaton against the tokenizers library."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from ruleweave.llm import bpe_automaton, packing, token_planes, tokens  # noqa: E402
from ruleweave.llm.ship import new_folder  # noqa: E402

WORD, BYTE = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "a  b", "a   b", "x \n y\n\n\nz ", "\n", "don't we'll 'sx ''s", "aaaaaaaaaaaaaa bbbbbbbb   ",
    "<|endoftext|>", "a <|endoftext|> b<|startoftext|>.", "日本語 テキスト 😀😀", "\x00a \x00", "é́ 12345 3.14, x., ",
    "  x  y\x85z\x1c w", "=" * 300, "a" * 2000, "\r\n\t x", "İstanbul ΑΣ ñ. Ñ, ́x", None,
]


def many_texts():
    rnd = random.Random(2)
    letters = list("abe t\n'1 .é😀\t<|,")
    return TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(300)]


def reference(path, text):
    return tokenizers.Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def byte_tokenizer():
    return tokenizers.Tokenizer.from_file(BYTE)


def test_encoder_equals_the_library():
    whole = tokenizers.Tokenizer.from_file(WORD)
    for remembered in (1_000_000, 40):  # the second memory is emptied all the time
        enc = tokens.Encoder(WORD, remembered)
        for text in many_texts():
            want = np.array(whole.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
            assert enc.encode(text) == want, text


def test_columns_equal_the_library(monkeypatch):
    enc, small = tokens.Encoder(WORD), tokens.Encoder(WORD, 40)
    texts = [None, *many_texts(), "Straße STRASSE,, x" * 90, "É" * 300 + ",", "a÷b ×x, Ångström é. K, ÿ!' l'été"]
    want = [enc.whole(text or "") for text in texts]
    for chunk in (1 << 20, 64):
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        for e in (enc, small):
            for kind in (pa.string(), pa.large_string()):
                column = pa.array([*texts[:3], *texts], kind).slice(3)
                assert list(e.encode_column(column)) == want
    assert list(enc.encode_column(pa.array([], pa.string()))) == []


def test_words_are_encoded_once_for_all_spellings(monkeypatch):
    enc, seen = tokens.Encoder(WORD), []
    for name in ("_words", "_line"):
        encode = getattr(enc, name)
        monkeypatch.setattr(enc, name, lambda group, encode=encode: (seen.extend(group), encode(group)))
    texts = ["Größe größe, GRÖßE***", "größe!! Word", "word*** WORD, word"]
    assert list(enc.encode_column(pa.array(texts))) == [enc.whole(text) for text in texts]
    assert sorted(seen) == sorted(x.encode() for x in ("größe", "word", ",", "***", "!!"))


def test_automaton_equals_the_library(byte_tokenizer):
    machine = bpe_automaton.automaton(BYTE)
    for text in many_texts():
        ids = byte_tokenizer.encode(text or "", add_special_tokens=False).ids
        assert machine.encode(text).tolist() == ids, text
        assert machine.decode(ids) == byte_tokenizer.decode(ids, skip_special_tokens=False)
    rnd = random.Random(1)
    for _ in range(100):  # ids that no text has
        ids = [rnd.randrange(50257) for _ in range(9)]
        assert machine.decode(ids) == byte_tokenizer.decode(ids, skip_special_tokens=False)


def test_automaton_of_a_few_merges():
    """All words of four letters, merged by hand."""
    merges = [(b"a", b"a"), (b"aa", b"a"), (b"a", b"b"), (b"aa", b"aa"), (b"b", b"ab")]
    labels = {b"a": 0, b"b": 1} | {u + v: i + 2 for i, (u, v) in enumerate(merges)}
    machine = bpe_automaton.Automaton(labels, merges)
    for word in itertools.product(b"ab", repeat=6):
        parts = [bytes([x]) for x in word]
        for u, v in merges:
            at = 0
            while at < len(parts) - 1:
                if (parts[at], parts[at + 1]) == (u, v):
                    parts[at : at + 2] = [u + v]
                at += 1
        assert machine.encode_word(bytes(word)).tolist() == [labels[p] for p in parts]


def test_encode_documents(spark, byte_tokenizer):
    rows = [(i, t) for i, t in enumerate(many_texts()[:60])] + [(1, " "), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("old"))
    found = bpe_automaton.encode_documents(docs, BYTE).collect()
    assert len(found) == len(rows)
    for r in found:
        want = byte_tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == byte_tokenizer.decode(want, skip_special_tokens=False)
    assert bpe_automaton.encode_documents(docs.limit(0), BYTE).count() == 0


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_planes_round_trip(plane):
    rnd = np.random.default_rng(1)
    for n, block in itertools.product((0, 1, 7, 8, 9, 1000, 8192, 20000), (8, 64, 8192)):
        ids = rnd.integers(0, 1 << 32, n, dtype=np.uint32).astype("<u4")
        assert (token_planes.from_planes(token_planes.to_planes(ids, plane, block), n, plane, block) == ids).all()


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_token_files_round_trip(spark, plane):
    whole = tokenizers.Tokenizer.from_file(WORD)
    rows = [(7 * i % 50, t) for i, t in enumerate(many_texts()[:50])] + [(None, "first"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("offset", F.lit("x")).repartition(5)
    path = new_folder(spark, "test")
    token_planes.write_tokens(docs, path, WORD, 1, plane=plane, block=64, chunk_ids=100)
    found = sorted(token_planes.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id) for r in found] == sorted((i is not None, i) for i, _ in rows)
    at = 0
    for r in found:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    want = Counter(
        (i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for i, t in rows
    )
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == want
    assert token_planes.chunk_index(spark, path).agg(F.sum("n_docs")).first()[0] == len(rows)
    empty = new_folder(spark, "test")
    token_planes.write_tokens(docs.limit(0), empty, WORD, 1)
    assert token_planes.read_tokens(spark, empty).count() == 0


def least_bins(items, capacity):
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                place(i + 1, bins)
                bins[k] -= items[i]
        bins.append(items[i])
        place(i + 1, bins)
        bins.pop()

    items = sorted(items, reverse=True)
    place(0, [])
    return best[0]


def checked_plan(histogram, capacity):
    placed, sequences = packing.plan(histogram, capacity)
    bins, ranks = {}, {}
    for size, rank, n, sequence, offset in placed:
        ranks.setdefault(size, []).extend(range(rank, rank + n))
        for i in range(n):
            bins.setdefault(sequence + i, []).append((offset, size))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in histogram.items()}
    assert len(bins) == sequences
    for held in bins.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= capacity
    return sequences


def test_plan_is_near_the_least():
    rnd = random.Random(5)
    for _ in range(300):
        capacity = rnd.choice([10, 17, 30])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))]
        assert checked_plan(Counter(items), capacity) <= least_bins(items, capacity) + 1
    assert packing.plan({}, 10) == ([], 0)
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_dominating_sets_keep_the_optimum():
    """Fixing a dominating set and solving the rest takes no more sequences than before."""
    rnd = random.Random(8)
    fixed = 0
    for _ in range(300):
        capacity = rnd.choice([12, 20])
        items = [rnd.randint(2, capacity) for _ in range(rnd.randint(2, 8))]
        chosen = packing.dominating(packing._Stock(Counter(items)), max(items), capacity)
        if chosen:
            rest = Counter(items) - chosen
            assert 1 + least_bins(list(rest.elements()), capacity) == least_bins(items, capacity)
            fixed += 1
    assert fixed > 100


def test_large_plan_is_close_to_the_bound():
    rnd = random.Random(4)
    histogram = Counter(min(4096, int(rnd.lognormvariate(6.3, 1.2)) + 1) for _ in range(20_000))
    least = -(-sum(s * n for s, n in histogram.items()) // 4096)
    assert checked_plan(histogram, 4096) <= 1.01 * least


def test_pack_documents(spark):
    rows = [(i, t) for i, t in enumerate(many_texts()[:80])] + [(None, "x"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("offset", F.lit("x")).repartition(4)
    pieces = packing.token_pieces(docs, WORD, 1, 64).withColumn("crc", F.crc32("ids"))
    packed = packing.pack(pieces, 64, ["doc_id", "crc", "piece"]).collect()
    whole = tokenizers.Tokenizer.from_file(WORD)
    want = Counter()
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.update(
            (i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)
        )
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.crc) for r in packed) == want
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(pieces.limit(0), 64, ["doc_id"]).count() == 0

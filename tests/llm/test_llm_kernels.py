"""Kernels without Spark, against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import op03_packing as packing
from quillon.llm import op04_itq as itq
from quillon.llm import op06_toxicity as toxicity
from quillon.llm import op08_simhash as simhash
from quillon.llm import op09_tiff, parsing, tiff
from quillon.llm.bytebpe import bpe, fast_ids
from quillon.llm.components import stars
from quillon.llm.op01_substring import parse_block, passages
from quillon.llm.op07_bpe import vocabulary

TEXTS = ["", " ", "a", "it's  we'll\n\n x", "a<|endoftext|>b <|endoftext|>", "漢字😀é ß​", "1234 5.6!!", "a" * 3000, "ab " * 700, "\x00\x01\t\r\n", "naïvé " * 50]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.mark.parametrize("text", TEXTS)
def test_bpe_equals_the_library(library, text):
    coder = bpe(vocabulary())
    want = library.encode(text, add_special_tokens=False).ids
    assert coder.encode(text).tolist() == want
    assert fast_ids(vocabulary(), text).tolist() == want
    assert coder.decode_bytes(coder.encode(text)).decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdehnorst 'é漢\n1.", max_size=80))
def test_bpe_equals_the_library_on_random_text(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(vocabulary()) if not hasattr(test_bpe_equals_the_library_on_random_text, "lib") else test_bpe_equals_the_library_on_random_text.lib
    test_bpe_equals_the_library_on_random_text.lib = want
    assert bpe(vocabulary()).encode(text).tolist() == want.encode(text, add_special_tokens=False).ids


def brute_longest(ids):
    n = len(ids)
    out = []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and ids[i + k] == ids[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_longest_matches(ids):
    assert parsing.longest_matches(np.array(ids, dtype=np.int64), 64).tolist() == brute_longest(ids)


def test_word_hashes_follow_the_words():
    said = lambda b: [tuple(x) for x in zip(*(h.tolist() for h in parsing.word_hashes(b)), strict=True)]
    assert said(b"one  two\tthree\x0bfour\n") == said(b"one two three four")
    assert len(set(said(b"a b aa ab ba \xc2\xa0"))) == 6
    assert said(b"") == said(b" \n ") == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=20).filter(lambda w: not set(w) & set(b" \t\n\x0b\x0c\r")), max_size=12))
def test_word_ids_tell_words_apart(words):
    low, high = parsing.word_ids(b" ".join(words))
    ids = list(zip(low.tolist(), high.tolist(), strict=True))
    assert len(ids) == len(words)
    assert all((words[i] == words[j]) == (ids[i] == ids[j]) for i in range(len(words)) for j in range(i))


def thue_morse(k):
    a, b = "ab"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_hashes_tell_sequences_that_no_power_of_two_tells():
    a, b = (x.encode() for x in thue_morse(11))  # equal under any polynomial modulo 2**64
    assert parsing.word_hashes(a)[0] != parsing.word_hashes(b)[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=60), st.integers(2, 8))
def test_factors_cover_every_long_match(longest, least):
    longest = [min(n, len(longest) - i) for i, n in enumerate(longest)]
    want = {p for i, n in enumerate(longest) if n >= least for p in range(i, i + n)}
    assert {p for a, b in parsing.factors(np.array(longest, dtype=np.int64), least) for p in range(a, b)} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["x", "y"]), max_size=60), st.integers(4, 9))
def test_equal_windows_have_equal_anchors_and_separate_rows(words, window):
    data = " ".join(words).encode()
    anchor, _, _, first, n = passages(data, window, 3)
    assert n.sum() == max(0, len(words) - window + 1)
    row = np.repeat(np.arange(len(n)), n)
    for i in range(len(row)):
        for j in range(i):
            if words[i : i + window] == words[j : j + window]:
                assert anchor[row[i]] == anchor[row[j]] and row[i] != row[j]


def test_factors_cross_boundaries():
    # places 0-4 match elsewhere up to 8, 5 words in; a match from 6 crosses the end of the first factor
    longest = np.array([8, 7, 6, 5, 4, 3, 9, 8, 7, 6, 5, 4, 3, 2, 1])
    assert parsing.factors(longest, 5) == [(0, 8), (6, 15)]
    assert parsing.factors(np.array([1, 2, 0]), 5) == []
    assert parse_block([b"a b c d e", b"x a b c d"], [False, False], 4) == [[(0, 4)], [(1, 5)]]
    assert parse_block([b"a b c d e"] * 2, [True, False], 4) == [[], [(0, 5)]]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9000))
def test_cut_covers_and_fits(n):
    pieces = packing.cut(n)
    assert sum(pieces) == n and all(0 < p <= packing.CAPACITY for p in pieces)


def test_bins_are_gapless_and_whole():
    rng = random.Random(3)
    bins = packing.Bins(64, 0)
    docs = {k: np.arange(rng.randint(1, 300), dtype="<u4") + 1000 * k for k in range(200)}
    for k, ids in docs.items():
        at = 0
        for n in packing.cut(len(ids), 64, 8):
            bins.add((k, at, ids[at : at + n], len(ids)))
            at += n
    bins.finish()
    got, seqs = {}, {}
    for k, start, ids, _n, seq, off in bins.out:
        got.setdefault(k, []).append((start, ids))
        seqs.setdefault(seq, []).append((off, len(ids)))
    for k, ids in docs.items():
        assert np.concatenate([p for _, p in sorted(got[k], key=lambda x: x[0])]).tolist() == ids.tolist()
    padding = 0
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding <= 0.02 * sum(map(len, docs.values()))


def test_anchors_find_every_close_pair():
    rng = np.random.default_rng(5)
    out = []
    for b in rng.integers(-(2**63), 2**63 - 1, 60):
        out.append(int(b))
        for _ in range(5):
            x = int(b) & (2**64 - 1)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            out.append(x - 2**64 if x >> 63 else x)
    fp = np.unique(np.array(out, dtype=np.int64))
    anchor, home, row = simhash.anchors(fp)
    homes, all_ = {}, {}
    for a, h, r in zip(anchor.tolist(), home.tolist(), row.tolist(), strict=True):
        all_.setdefault(a, set()).add(r)
        if h:
            homes.setdefault(a, set()).add(r)
    met = {(i, j) for a in homes for i in homes[a] for j in all_[a]}
    for i in range(len(fp)):
        for j in range(len(fp)):
            assert i == j or (int(fp[i] ^ fp[j]) & (2**64 - 1)).bit_count() > 5 or (i, j) in met


def test_fingerprint_follows_the_definition():
    import xxhash

    text = "One two\tTHREE four five É"
    words = ["one", "two", "three", "four", "five", "É"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 1.5)
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A b") & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b", 42)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=25))
def test_stars(links):
    a, b = (np.array(x, dtype=np.int64) for x in (zip(*links, strict=True) if links else ([], [])))
    node, root = stars(a, b)
    group = {x: {x} for pair in links for x in pair}
    for x, y in links:
        if group[x] is not group[y]:
            group[x] |= group[y]
            for z in group[y]:
                group[z] = group[x]
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {x: min(g) for x, g in group.items() if min(g) != x}


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=600).map(lambda b: b[:200] + b[:1] * 200 + b))
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data


def test_lzw_fills_its_table():
    data = np.random.default_rng(0).integers(0, 40, 60_000, dtype=np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_round_trip(compression, predictor, tile, big):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 5, (37, 50), dtype=np.uint8), rng.integers(0, 9, (20, 33, 3), dtype=np.uint8), rng.integers(0, 70_000 % 65_536, (9, 40), dtype=np.uint16)]
    data = tiff.write(images, compression, predictor, strip_rows=8, tile=tile, big=big)
    for image, page in zip(images, tiff.pages(data), strict=True):
        assert page.samples == image.tobytes() and (page.height, page.width) == image.shape[:2]


def test_damaged_tiffs_are_refused():
    data = tiff.write([np.zeros((4, 192), np.uint8)])
    for bad in (b"", b"II", b"PK\x03\x04" + data, data[: len(data) // 2], data[:4] + b"\xff\xff\xff\x7f" + data[8:]):
        with pytest.raises(tiff.Damaged):
            list(tiff.pages(bad))
    loop = bytearray(data)
    loop[-4:] = data[4:8]
    with pytest.raises(tiff.Damaged):
        list(tiff.pages(bytes(loop)))


@pytest.mark.parametrize("text", ["", "x", "y" * 192, "é" * 97, "z" * 192 * 5000])
def test_payload(text):
    data = op09_tiff.payload(text)
    assert len(data) % 192 == 0 and len(data) >= 192 and data.rstrip(b" ") == text.encode().rstrip(b" ") and len(data) - len(text.encode()) < 193


def test_ordinal_regression_orders_its_grades():
    rng = np.random.default_rng(0)
    n = 600
    grades = rng.integers(0, 3, n)
    held = [[g] if rng.random() < 0.95 else [int(rng.integers(0, 3))] for g in grades]
    rows = np.repeat(np.arange(n), [len(h) for h in held])
    cols = np.array([c for h in held for c in h])
    w, t = toxicity.fit(rows, cols, grades, 3, np.array([1, 1, 1]) / 3)
    assert t[0] < t[1] and w[0] < w[1] < w[2]
    model = toxicity.Model({0: 0, 1: 1, 2: 2}, w, t)
    assert [int(round(model.probabilities({c}).sum())) for c in range(3)] == [0, 1, 2]


def test_itq_balances_and_keeps_neighbours():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, w = itq.learn(x)
    c = itq.codes(x, mean, w)
    bits = np.unpackbits(c.view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0)
    assert (abs(bits - 0.5) < 0.1).all()
    near = x + rng.normal(size=x.shape) * 0.02
    d = np.bitwise_count((c ^ itq.codes(near / np.linalg.norm(near, axis=1, keepdims=True), mean, w)).view(np.uint64))
    assert np.mean(d) < 8

"""The NumPy scans against plain Python, without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import bpe, decontam, line_dedup, neardup, quality, token_shards
from seqloom.llm import textscan as ts

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab AB\n\t é1'#|.!", max_size=60)), max_size=8)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def all_chunks(texts, size=None):
    return list(ts.chunks(pa.array(texts, pa.string()), size))


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_words_and_lines(texts):
    for size in (None, 7):
        words, pieces = [], []
        for c in all_chunks(texts, size):
            raw = c.buf.tobytes()
            s = ts.runs(ts.NOT_SPACE[c.buf], c.at)
            words += [[raw[a:b].decode() for a, b in zip(s.start[i:j], s.end[i:j], strict=True)] for i, j in zip(s.row_at[:-1], s.row_at[1:], strict=True)]
            s = ts.lines(c)
            pieces += [[raw[a:b].decode() for a, b in zip(s.start[i:j], s.end[i:j], strict=True)] for i, j in zip(s.row_at[:-1], s.row_at[1:], strict=True)]
        assert words == [WORD.findall(t or "") for t in texts]
        assert pieces == [(t or "").split("\n") for t in texts]


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_quality_counts(texts):
    texts = [*texts, "a b " * 12, "x\nx\n\n \nx y", None, ""]
    got = []
    for c in all_chunks(texts, 90):
        x = quality.count_chunk(c)
        got += np.stack([x[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], 1).tolist()
    assert got == [brute_counts(t) for t in texts]


def test_exact_binomial_bound():
    assert not quality.refuted(0, 0, 0.01, 0.05)
    assert quality.refuted(0, 299, 0.01, 0.05) and not quality.refuted(0, 298, 0.01, 0.05)
    assert not quality.refuted(5, 300, 0.01, 0.05)


def shingle_set(text):
    words = WORD.findall(lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@settings(max_examples=40, deadline=None)
@given(TEXT)
def test_shingles(texts):
    texts = [*texts, "a b c d e f a b c d e", "A", "", None]
    for c in all_chunks(texts):
        rows, _ = neardup.shingles(c)
        assert np.bincount(rows, minlength=len(c)).tolist() == [len(shingle_set(t)) for t in texts[c.first : c.first + len(c)]]


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(3)
    for n, shared in ((1, 1), (5, 4), (60, 50), (3000, 2700), (3000, 600)):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = np.concatenate([base[:shared], rng.integers(0, 1 << 63, n - shared, dtype=np.uint64)])
        regs = neardup.registers(np.repeat([0, 1], n), np.concatenate([base, other]), 2)
        true = shared / (2 * n - shared)
        assert abs(neardup.estimate(regs[:1], regs[1:])[0] - true) < 0.2
        assert not (regs == neardup.EMPTY).any()


def brute_hits(text, items):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, hit, found = split.findall(lower(text)), set(), set()
    for name, item in items:
        w = split.findall(lower(item))
        for i in range(max(1, len(w) - 9) if w else 0):
            window = w[i : i + 10]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    found.add(str(name))
    return len(words), hit, found


def test_decontamination_against_brute_force():
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice("aa bb cc Dd éé 11".split()) for _ in range(n))
    items = [(i, some(n)) for i, n in enumerate((12, 30, 3, 1, 10, 9))] + [(7, None), (8, ""), (9, "zz yy"), (9, "qq")]
    texts = [None, "", "Dd", "zz, YY. xx", *(some(rng.randrange(80)) for _ in range(40)), items[1][1].upper() + " tail", "x " + items[0][1]]
    tables = decontam.tables(items)
    for c in all_chunks(texts, 400):
        row_at, hit, found = decontam.search_chunk(c, tables)
        for i in range(len(c)):
            n, words, names = brute_hits(texts[c.first + i], items)
            assert row_at[i + 1] - row_at[i] == n
            assert set(np.flatnonzero(hit[row_at[i] : row_at[i + 1]]).tolist()) == words
            assert found[i] == names


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.Tokenizer(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(tokenizer):
    table = tokenizer[0].table
    assert len(set(table.ids.tolist())) == table.n == len(tokenizer[0].ranks)
    assert all(tokenizer[0].ranks[k] == i for k, i in zip(table.keys, table.ids.tolist(), strict=True))


def test_bpe_is_that_of_the_library(tokenizer):
    own, library = tokenizer
    rng = random.Random(2)
    letters = "a b'sstre  \n\t  é1２中!?.,'lld'veXm\x1c\x85​\U0001f600ⅷ²́　"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += [None, "", "'", "'s", " 's", "x's y'll  '", "  ", "a  b", "'stuff ''s", "don't\n\n", "ab" * 30_000, "<|endoftext|>"]
    for c in all_chunks(texts, 5000):
        ids, at = own.checked(c)
        back, back_at = own.decode(ids, at)
        assert back.tobytes() == c.buf.tobytes() and back_at.tolist() == c.at.tolist()
        for i in range(len(c)):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(texts[c.first + i] or "")


@pytest.mark.parametrize("count", [1, 2, 3, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(count):
    for key in (0, token_shards.KEY):
        assert sorted(token_shards.feistel(np.arange(count), count, key).tolist()) == list(range(count))
    if count > 100:
        assert token_shards.feistel(np.arange(count), count, 1).tolist() != token_shards.feistel(np.arange(count), count, 2).tolist()


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row, old = [i], row
        for j, b in enumerate(y, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=40), st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["", "a", "xx"])), max_size=4))
def test_edit_similarity(x, edits):
    y = x
    for at, new in edits:
        y = y[:at] + new + y[at + 1 :]
    longer = max(len(x), len(y))
    want = longer == 0 or edit_distance(x, y) <= int(0.1 * longer + 1e-9)
    assert line_dedup.edit_similar(x.encode(), y.encode()) == want


def test_simhash_counts_bits():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 5, 300, 0, 130_000, 2]
    hashes = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64) * np.uint64(2)
    at = np.concatenate([[0], np.cumsum(sizes)])
    got = line_dedup.simhash(hashes, at)
    for i in range(len(sizes)):
        own = hashes[at[i] : at[i + 1]]
        bits = [2 * int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > len(own) for b in range(64)]
        assert int(got[i]) == sum(x << b for b, x in enumerate(bits))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé", min_size=1, max_size=30), st.text(alphabet="abé", min_size=1, max_size=30))
def test_both_edit_searches(x, y):
    x, y = sorted((x, y), key=len)
    want = edit_distance(x, y)
    for most in range(len(y) + 1):
        assert line_dedup.few_edits(x, y, most) == line_dedup.many_edits(x, y, most) == (want <= most)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_banded_distances(width):
    rng = random.Random(width)
    pairs = []
    for _ in range(300):
        x = "".join(rng.choice("abé") for _ in range(rng.choice([1, 5, 40, 150])))
        y = list(x)
        for _ in range(rng.randrange(12 * width)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choice(["", "a", "xy"])
        pairs.append(sorted((x, "".join(y) or "a"), key=len))
    got = line_dedup.banded([x for x, _ in pairs], [y for _, y in pairs], width)
    for (x, y), d in zip(pairs, got.tolist(), strict=True):
        want = edit_distance(x, y)
        assert d == want if want < 32 * width else d >= 32 * width


def test_all_similar():
    rng = random.Random(9)
    pairs = []
    for _ in range(400):
        x = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([12, 60, 300, 700, 3000]))).encode()
        y = bytearray(x)
        for _ in range(rng.randrange(1 + len(x) // 8)):
            y[rng.randrange(len(y))] = rng.choice(b"abcdefgh ")
        pairs.append((x, bytes(y)))
    assert line_dedup.all_similar(pairs).tolist() == [line_dedup.many_edits(*sorted((x.decode(), y.decode()), key=len), int(0.1 * max(len(x), len(y)) + 1e-9)) for x, y in pairs]


def test_every_code_point_is_classed_as_by_the_library(tokenizer):
    own, library = tokenizer
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    texts = ["".join(f"a{c}'s {c}1{c} {c}" for c in points[k : k + 2000]) for k in range(0, len(points), 2000)]
    for c in all_chunks(texts):
        ids, at = own.checked(c)
        for i in range(len(c)):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(texts[c.first + i])

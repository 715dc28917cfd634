"""BPE round trip and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from meshweave.llm import bpe, packing
from meshweave.llm.queries import tokenizer_path
from tokenizers import Tokenizer

PATH = tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.Bpe(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" aeinorst'\n.,0é日😀²Ⅷ "), st.characters(codec="utf-8")), max_size=60), min_size=1, max_size=4))
def test_ids_and_decoding(texts):
    for text, ids in zip(texts, OWN.encode_texts(texts), strict=True):
        assert ids == library(text)
        assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_words_that_fail_speculation_and_long_ones():
    rng = random.Random(3)
    words = ["".join(rng.choice("abeinorst") for _ in range(n)) for n in [*range(1, 64), 65, 200, 3000] * 3]
    proposed_word, _ = OWN.propose([w.encode() for w in words])
    assert set(proposed_word.tolist()) == set(range(len(words)))
    assert [list(t) for t in OWN.encode_words(words)] == [library(w) for w in words]
    assert [list(t) for t in OWN.merge_words([w.encode() for w in words])] == [library(w) for w in words]


LONG_RUNS = [" " * 1_100_000 + "x", "\n" * 1_100_000, "a" * 50_000, "😀" * 30_000, " \t\n" * 100_000 + "end <|endoftext|> " + "!" * 20_000]


def test_long_runs():
    assert [*OWN.encode_texts(LONG_RUNS)] == [library(t) for t in LONG_RUNS]
    assert all(len(w) <= bpe.HUGE_WORD for w in OWN.cache)
    for t in LONG_RUNS:
        assert packing._encode(packing._encoder(PATH), PATH, t).tolist() == library(t)


def test_decoding_broken_bytes():
    ids = library("日本")[:1]
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_cache_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    texts = ["a few words here", "and some other ones there", "a few again"]
    fresh = bpe.Bpe(PATH)
    for t in texts:
        assert list(fresh.encode_texts([t])) == [library(t)]


def test_round_trip(docs, rows, empty, clashing):
    out = bpe.round_trip(docs, PATH, ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = Counter((d, len(library(t)), sha(",".join(map(str, library(t)))), sha(t or "")) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == expected
    assert all(sha(r.decoded) == r.decoded_sha256 for r in out)
    assert bpe.round_trip(empty, PATH).count() == 0
    assert bpe.round_trip(clashing, PATH, ("n_tokens",)).columns == ["doc_id", "n_tokens"]


def check_packing(pieces, capacity):
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing(docs, rows, empty, clashing):
    out = packing.pack(docs, PATH, 256, keep_ids=True).collect()
    expected = Counter()
    for d, t, *_ in rows:
        ids = [*library(t), 0]
        n = -(-len(ids) // 256)
        first = len(ids) - 256 * (n - 1)
        for k in range(n):
            start = first + 256 * (k - 1) if k else 0
            part = ids[start : start + (256 if k else first)]
            expected[d, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    n = check_packing(out, 256)
    assert n <= 1.05 * sum(r.length for r in out) / 256 + 1
    assert packing.pack(empty, PATH).count() == 0
    assert packing.pack(clashing, PATH).count() == packing.pack(docs, PATH).count()


@pytest.mark.parametrize("counts", [{1: 5000}, {2048: 3, 5: 2}, {1025: 50, 1: 2000}, {700: 10, 3: 1}, {1024: 7}, {682: 3, 683: 3, 684: 3}])
def test_plans_use_each_piece_once(counts):
    recipe = packing.plan(counts, 2048)
    rows = sorted(recipe.rows)
    used, fill = Counter(), Counter()
    for k, (length, start, sequence, _) in enumerate(rows):
        end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else counts[length]
        used[length] += end - start
        for i in range(end - start):
            fill[sequence + i] += length
    assert used == Counter(counts) and max(fill.values()) <= 2048 and len(fill) == recipe.sequences


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=300))
def test_plans_are_close_to_the_bound(lengths):
    counts = dict(Counter(lengths))
    recipe = packing.plan(counts, 64)
    assert sum(v for v in recipe.used.values()) == len(lengths)
    bound = max(-(-sum(lengths) // 64), sum(x > 32 for x in lengths))
    assert bound <= recipe.sequences <= 1.25 * bound + 2

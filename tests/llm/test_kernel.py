import random
import re

import numpy as np
import pyarrow as pa
import pytest

from extentlake.llm import kernel, pretokens


def texts(seed, n, alphabet):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(alphabet, k=rnd.randint(0, 40))) for _ in range(n)] + ["", "x" * 5000]


@pytest.mark.parametrize("members,pattern", [(kernel.SPACED, r"[^\x20\x09-\x0D]+"), (kernel.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_are_those_of_the_pattern(members, pattern):
    got = texts(1, 300, "aB é中😀 \t\n.1\x0b\x85")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = [re.findall(pattern, t.translate(lower)) for t in got]
    seen = {}
    for first, end, text, at in kernel.slices(pa.array(got)):
        start, stop, before = kernel.word_bounds(text, at, members)
        h = kernel.word_hashes(text, start, stop, True)
        for d in range(first, end):
            own = h[before[d - first] : before[d - first + 1]].tolist()
            assert len(own) == len(want[d])
            for x, w in zip(own, want[d], strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_shingles_follow_the_sets():
    got = texts(2, 200, "ab \n")
    (_, _, text, at), *more = kernel.slices(pa.array(got))
    assert not more
    sets = kernel.shingle_sets(text, at, 3)
    for t, s in zip(got, sets, strict=True):
        w = t.split()
        want = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
        assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()


def test_nulls_are_empty():
    assert [(a, b, len(t)) for a, b, t, _ in kernel.slices(pa.array([None, "a", None]))] == [(0, 3, 1)]
    assert list(kernel.slices(pa.array([], pa.string()))) == []


def test_pieces_encode_like_the_library():
    public = pytest.importorskip("public_tokenizers")
    e = pretokens.Encoder(public.path("byte_bpe_50k.json"))
    got = [t for s in range(20) for t in texts(s, 20, " '\n\t  srtmdvelLab1²é.!?-中　\x1c͸😀ǅ\xa0")] + ["x<|endoftext|>y", "don't we'll 've\n's"]
    ids, n = e.encode(got)
    parts = np.split(ids, np.cumsum(n)[:-1])
    for t, p in zip(got, parts, strict=True):
        assert p.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_hashes_of_runs_that_cross_edges(monkeypatch):
    """A run's hash is that of its values alone, wherever it lies and however the running sums are cut."""
    text = np.frombuffer(b"alpha beta " * 40 + b"x" * 500 + b" alpha", np.uint8)
    at = np.array([0, len(text)])
    start, end, _ = kernel.word_bounds(text, at, kernel.SPACED)
    want = kernel.word_hashes(text, start, end, True)
    monkeypatch.setattr(kernel, "BLOCK", 7)
    assert kernel.word_hashes(text, start, end, True).tolist() == want.tolist()
    assert len(set(want.tolist())) == 3 and want[0] == want[-1]


def test_pieces_that_share_a_key_go_to_the_library(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    e = pretokens.Encoder(public.path("byte_bpe_50k.json"))
    monkeypatch.setattr(pretokens, "run_hashes", lambda values, n, start, end: (end - start).astype(np.uint64))
    got = ["one two six", "red fox", ""]
    ids, n = e.encode(got)
    for t, p in zip(got, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert p.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids

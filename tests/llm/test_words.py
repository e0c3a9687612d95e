"""Word positions, hashes and winnowing against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from textlake.llm.words import FOLDED, PLAIN, mix, range_hash, slices, windows, winnow

TEXT = st.text(alphabet="aAbZ09 \t\n\x0b\r.é日 _-", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 64))
def test_words(texts, most):
    for table, fold, pattern in ((PLAIN, False, rb"[^\x20\x09-\x0D]+"), (FOLDED, True, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = 0
        for at, t in slices(pa.array(texts, pa.string()), table, fold, most_bytes=most):
            assert at == seen
            seen += len(t)
            for i in range(len(t)):
                raw = (texts[at + i] or "").encode()
                want = re.findall(pattern, raw.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) if fold else raw)
                assert [t.word(j) for j in range(t.first[i], t.first[i + 1])] == want
                h = t.word_hashes()[t.first[i]:t.first[i + 1]]
                assert len(set(h.tolist())) == len(set(want))
        assert seen == len(texts)


def test_hash_does_not_depend_on_the_place():
    x = mix(np.arange(50, dtype=np.uint64))
    y = np.concatenate([mix(np.arange(90, 97, dtype=np.uint64)), x])
    a = range_hash(x, np.array([3]), np.array([20]))
    assert a == range_hash(y, np.array([10]), np.array([27])) and a != range_hash(x, np.array([3]), np.array([21]))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=25), min_size=1, max_size=5))
def test_equal_windows_have_equal_anchors(texts):
    for _, t in slices(pa.array([" ".join(x) for x in texts])):
        at = windows(t, 6)
        assert len(at) == sum(max(0, len(x) - 5) for x in texts)
        first, anchor, key = winnow(t, t.word_hashes(), 2, 6)
        by_window = {}
        for f, a, k in zip(first, anchor, key, strict=True):
            assert f <= a <= f + 4
            w = tuple(t.word(j) for j in range(f, f + 6))
            assert by_window.setdefault(w, (a - f, k)) == (a - f, k)

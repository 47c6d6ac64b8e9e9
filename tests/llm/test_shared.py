import pyarrow as pa
import pytest

from tessera.llm._shared import text_slices
from tessera.llm.shingles import shingle_sets, word_digests

TEXTS = ["", "one", None, "two words", "é日本🙂 x", "z" * 50, None, "a\tb\nc", ""]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("most", [1, 7, 1000])
def test_slices_are_the_texts(kind, most):
    whole = pa.array(["skip", *TEXTS, "skip"], kind)
    for column in (pa.array(TEXTS, kind), whole.slice(1, len(TEXTS)), pa.chunked_array([whole.slice(1, 4), whole.slice(5, 5)])):
        got = []
        for first, end, raw, ends in text_slices(column, most):
            assert first == len(got) and end - first == len(ends) - 1
            got += [bytes(raw[a:b]).decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert got == [t or "" for t in TEXTS]
    assert not list(text_slices(pa.array([], kind)))


def test_equal_words_hash_alike_wherever_they_are():
    column = pa.array(["Alpha beta", "x alpha\tBETA y", "alphabeta"])
    (_, _, raw, ends), = text_slices(column)
    words, upto = word_digests(raw, ends)
    assert upto.tolist() == [0, 2, 6, 7]
    names = [bytes(w) for w in words]
    assert names[0] == names[3] and names[1] == names[4] and len(set(names)) == 5


def test_slices_do_not_change_sets():
    texts = [f"w{i} w{i + 1} w{i + 2} w{i + 3} tail" for i in range(50)] + ["", None, "one two"]
    sets = [s.tolist() for s in shingle_sets(pa.array(texts), 3)]
    assert [len(s) for s in sets[-3:]] == [0, 0, 1] and len(sets) == len(texts)
    assert sets == [s.tolist() for t in texts for s in shingle_sets(pa.array([t], pa.string()), 3)]

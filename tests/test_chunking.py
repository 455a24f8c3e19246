import re

from hypothesis import given, settings
from hypothesis import strategies as st

from brainweave.operators import chunking


def test_empty_and_headings_only():
    assert chunking.chunks(None) == [] and chunking.chunks(" \n ") == []
    assert chunking.chunks("# One\n## Two\n") == [(0, "# One\n## Two", 3, [], 0, 13)]


def test_heading_paths_pop_to_their_depth():
    found = chunking.chunks("intro\n# A\na\n### C\nc\n## B\nb\n")
    assert [(c[1], c[3]) for c in found] == [("intro", []), ("a", ["A"]), ("c", ["A", "C"]), ("b", ["A", "B"])]
    assert [(c[4], c[5]) for c in found] == [(0, 6), (6, 12), (12, 20), (20, 27)]


def test_headings_in_code_fences_are_text():
    assert [c[3] for c in chunking.chunks("# A\n```\n# no\n```\nx")] == [["A"]]


def test_limits():
    assert len(chunking.chunks("a" * 3200)) == 1
    whole = "word " * 641  # 3,204 units when trimmed: 801 tokens
    parts = chunking.chunks(whole)
    assert len(parts) == 2 and all(c[2] <= 500 for c in parts)
    assert parts[1][1].startswith(parts[0][1][-395:].strip()[:50])
    assert len(chunking.chunks("x" * 5000)) == 1  # one giant word can't be cut
    assert chunking.tokens("😀" * 3) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# H\n", "## K\n", "word " * 300 + "\n", "line\n", "\n", "é😀 x\n"]), max_size=12))
def test_properties(parts):
    text = "".join(parts)
    found = chunking.chunks(text)
    assert [c[0] for c in found] == list(range(len(found)))
    words = set(re.findall(r"\S+", text))
    for _, body, tokens, _, start, end in found:
        assert body == body.strip() and body and tokens <= chunking.MOST and start <= end
        # an overlap may begin inside a word
        assert set(re.findall(r"\S+", body)[1:]) <= words


def test_as_a_table(spark):
    df = spark.createDataFrame([(1, "# A\nx"), (2, None), (3, "")], "k int, body string")
    assert [tuple(r) for r in chunking.chunk_documents(df, "k", "body").collect()] == [(1, 0, "x", 1, ["A"], 0, 5)]

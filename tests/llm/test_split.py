import re
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from leafline.llm import split as S

words = lambda t: re.findall(r"[^ \t\r\n]+", t)
T1, T2 = datetime(2025, 1, 1), datetime(2025, 1, 2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a ", "bb. ", "c\n", "d!\r\n\r\n", "# h\n", "- i ", "e\t", " f ", "\n\n"]), min_size=1, max_size=400), st.integers(3, 40), st.integers(0, 12))
def test_pieces_hold_every_word_once_and_keep_the_limit(parts, limit, overlap):
    overlap = min(overlap, limit - 1)
    text = "".join(parts)
    whole = words(text)
    if len(whole) <= limit:
        return
    at = 0
    for k, (first, n, back, content) in enumerate(S.pieces(text, limit, overlap)):
        assert words(content) == whole[first : first + n] and 0 < n <= limit and back <= overlap and (k or back == 0)
        assert first + back == at and content in text
        at = first + n
    assert at == len(whole)


def test_cuts_at_the_strongest_boundary():
    text = "# one\n" + "w " * 20 + "\n\n" + "v. " * 20 + "\n# two\n" + "u " * 30
    firsts = [words(c)[0] for *_, c in S.pieces(text, 45, 0)]
    assert firsts == ["#", "#"] and S.pieces(text, 45, 0)[1][3].startswith("# two")
    sentences = ("a b c d e. " * 30).strip()
    assert all(c.endswith("e.") for *_, c in S.pieces(sentences, 12, 0))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "id string, content string, ingested_at timestamp, kind string, piece int")


def test_latest_rows_nulls_and_long_words(spark):
    long, short = "w " * 600, "w"
    df = frame(spark, [("a", long, T1), ("a", short, T2), ("b", short, T1), ("b", long, T2), ("b", long, T2), ("c", None, T1), ("d", "", T1), (None, long, T1), ("e", "x" * 5000, T1), ("f", "w " * 512, None), ("g", "w " * 600, T1), ("h", long, None)])
    rows = S.split_oversized(df).collect()
    assert {r["id"] for r in rows} == {"b", "h"}
    assert all(r["n_words"] <= 512 for r in rows) and len(rows) == 4
    assert S.split_oversized(df.limit(0)).collect() == []

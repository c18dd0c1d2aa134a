from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.splitting import split_line, split_oversized, split_text

LINE = st.text(st.sampled_from("ab {}é\t;"), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(LINE, max_size=60), st.integers(1, 12), st.integers(70, 400), st.integers(0, 5), st.booleans())
def test_pieces_keep_limits_and_give_back_the_text(lines, max_lines, max_bytes, overlap, final):
    text = "\n".join(lines) + ("\n" if final and lines else "")
    pieces = split_text(text, max_lines, max_bytes, overlap)
    if not text:
        assert pieces == []
        return
    kept = text.split("\n")
    kept = [x + "\n" for x in kept[:-1]] + ([kept[-1]] if kept[-1] else [])
    end = 0
    for first, last, piece in pieces:
        assert len(piece.encode()) <= max_bytes and last - first + 1 <= max_lines
        assert first <= end + 1 and last > end
        assert end == 0 or end - first + 1 <= overlap
        assert piece == "".join(kept[first - 1 : last])
        end = last
    assert end == len(kept)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300), st.integers(4, 50))
def test_parts_of_a_line_give_back_its_bytes(line, limit):
    parts = split_line(line.encode(), limit)
    assert b"".join(parts) == line.encode() and all(len(p) <= limit for p in parts)
    assert all(p.decode() is not None for p in parts)


def test_cuts_at_natural_boundaries_with_overlap():
    block = "func f{0}() {{\n\tbody one\n\tbody two\n\tbody three\n}}\n\n"
    text = "".join(block.format(n) for n in range(20))
    pieces = split_text(text, 30, None, 0)
    assert len(pieces) == 4 and all(p.startswith("func") for _, _, p in pieces)
    shared = split_text(text, 30, None, 5)
    assert all(b[0] == a[1] - 4 for a, b in zip(shared, shared[1:], strict=False))


def test_long_lines():
    assert split_line("é".encode() * 10, 5) == ["éé".encode()] * 5
    assert b"".join(split_line(b"x" * 1001, 100)) == b"x" * 1001
    pieces = split_text("word " * 5000, 40, 1000, 3)
    assert all(len(p) <= 1000 and p.endswith(" ") for _, _, p in pieces)


def test_operator(spark):
    limits = spark.createDataFrame([("default", 4, 1, 1000), ("XML ", None, 0, 20), ("json", None, None, None)], "language string, max_chunk_lines int, chunk_overlap int, max_chunk_bytes int")
    text = "\n".join("abcdefgh" for _ in range(6))
    df = spark.createDataFrame(
        [(1, 10, 99, text, None), (2, 1, 1, text, " JSON"), (3, 5, 1, text, "xml"), (4, None, 1, None, "go"), (5, 1, 1, "", "go"), (6, 1, 1, "a\nb\nc\nd\n", "go"), (7, 1, 1, text, "unknown"), (7, 1, 1, text, "unknown")],
        "chunk_id bigint, start_line int, end_line int, content string, language string",
    )
    got = split_oversized(df, limits).collect()
    assert {r.chunk_id for r in got} == {1, 3, 7}
    one = sorted((r.piece, r.start_line, r.end_line) for r in got if r.chunk_id == 1)
    assert one[0][1] == 10 and one[-1][2] == 15 and one[1][1] == one[0][2]
    assert all(len(r.content) <= 20 for r in got if r.chunk_id == 3)
    assert split_oversized(df.limit(0), limits).collect() == []

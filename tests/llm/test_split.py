"""Splitting against a direct statement of the rule."""

import random

from lodestrata.llm import split


def brute(content, limit, overlap, first=1):
    if len(content) <= limit:
        return []
    lines = content.split("\n")
    out, repeated, n = [], [], 0
    size = lambda xs: len("\n".join(xs))
    while n < len(lines):
        if len(lines[n]) > limit:
            for _ in range(0, len(lines[n]), limit):
                out.append((first + n, first + n))
            repeated, n = [], n + 1
            continue
        if repeated and size([lines[i] for i in repeated] + [lines[n]]) > limit:
            repeated = []
        start = repeated[0] if repeated else n
        if size(lines[start:]) <= limit:
            out.append((first + start, first + len(lines) - 1))
            break
        end = n
        while end + 1 < len(lines) and size(lines[start : end + 2]) <= limit:
            end += 1
        good = [i for i in range(n, end + 1) if lines[i].strip() == "" or set(lines[i].strip()) <= set("}]);,")]
        end = good[-1] if good else end
        out.append((first + start, first + end))
        repeated = list(range(max(start, end - overlap + 1), end + 1)) if overlap else []
        n = end + 1
    return out


def texts():
    rng = random.Random(7)
    pool = ["", "  ", "}", "  });", "] ,", "x", "ab cd", "y" * 9, "z" * 30, "é\r", "} ]", "long" * 20]
    out = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    return out + ["", "\n", "\n\n\n\n\n\n\n\n\n\n\n\n", "a" * 100, "a" * 40 + "\n", "b\n" * 30, "😀" * 50]


def test_pieces_match_the_rule_for_any_range_size(spark):
    rows = [(str(i), t, None if i % 3 == 0 else i, 12 + i % 30, i % 4) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows + rows[:5] + [("null", None, 1, 10, 1), ("nolimit", "abc", 1, None, 1)], "item string, content string, first_line int, max_chars int, overlap int")
    want = sorted((r[0], k, *p) for r in rows for k, p in enumerate(brute(r[1], r[3], r[4], r[2] or 1), 1))
    for size in (1, 7, 64, split.RANGE):
        got = split.split_oversized(df, size)
        assert sorted(tuple(r)[:4] for r in got.collect()) == want
    pieces = [r for r in got.collect()]
    by = {r[0]: r for r in rows}
    for p in pieces:
        text = by[p.item][1][p.start_offset : p.end_offset]
        assert len(text) <= by[p.item][3]


def test_two_overlaps_and_limits_of_one_item(spark):
    text = "\n".join(f"line {i} " + "x" * (i % 17) for i in range(200))
    rows = [("a", text, 1, limit, overlap) for limit in (40, 90) for overlap in (0, 1, 2)]
    df = spark.createDataFrame(rows, "item string, content string, first_line int, max_chars int, overlap int")
    want = sorted((limit, overlap, k, *p) for _, t, f, limit, overlap in rows for k, p in enumerate(brute(t, limit, overlap, f), 1))
    got = split.split_ranges(split.item_ranges(df, 64)).select("max_chars", "overlap", "piece_no", "start_line", "end_line")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_texts_of_pieces(spark):
    rows = [(str(i), t, 1, 12 + i % 30, i % 4) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows + rows[:5], "item string, content string, first_line int, max_chars int, overlap int")
    for size in (7, 64, split.RANGE):
        pieces = {}
        for r in split.split_ranges(split.item_ranges(df, size)).collect():
            pieces[r.item, r.piece_no] = rows[int(r.item)][1][r.start_offset : r.end_offset]
        assert pieces == {(r.item, r.piece_no): r.text for r in split.piece_texts(split.item_ranges(df, size)).collect()}


def test_files_are_read_by_ranges(spark, tmp_path):
    for i, t in enumerate(texts()):
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
    got = split.split_ranges(split.file_ranges(spark, str(tmp_path), 30, 2, range_bytes=37))
    want = sorted((str(i), k, *p) for i, t in enumerate(texts()) for k, p in enumerate(brute(t, 30, 2), 1))
    assert sorted((r.item.rsplit("/", 1)[-1][:-4], r.piece_no, r.start_line, r.end_line) for r in got.collect()) == want


def test_one_giant_file(spark, tmp_path):
    """100 MB in one file: no worker grows beyond a fixed size, as none holds the file."""
    line = "value = compute(1234567, 'abcdefghijklmnopqrstuvwxyz')\n"
    n = 100_000_000 // len(line)
    with open(tmp_path / "big.txt", "w") as f:
        for _ in range(n // 1000):
            f.write(line * 1000)
    n = n // 1000 * 1000

    def grown(batches):
        import resource

        yield from batches
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 900_000  # KB; an idle worker has a third of it

    ranges = split.file_ranges(spark, str(tmp_path), 2000, range_bytes=1 << 20)
    checked = ranges.mapInPandas(grown, ranges.schema)
    last = split.split_ranges(checked).agg({"piece_no": "max", "end_line": "max", "end_offset": "max"}).first().asDict()
    per_piece = (2000 + 1) // len(line)
    assert last == {"max(piece_no)": -(-n // per_piece), "max(end_line)": n + 1, "max(end_offset)": n * len(line)}


def test_limits_by_type(spark):
    chunks = spark.createDataFrame([("a", "x" * 5, 1, ("t",)), ("b", "x" * 5, None, (None,)), ("c", "x" * 5, 1, ("odd",))], "id string, content string, start_line int, metadata struct<chunk_type string>")
    limits = spark.createDataFrame([("t", 4, 1), ("default", 3, 0)], "chunk_type string, max_chars int, overlap_lines int")
    got = {r.item: (r.max_chars, r.overlap) for r in split.chunk_items(chunks, limits).collect()}
    assert got == {"a": (4, 1), "b": (3, 0), "c": (3, 0)}
    empty = split.split_oversized(split.chunk_items(chunks.limit(0), limits))
    assert empty.count() == 0

import random

import pytest

from lexiloom.rules import RULES
from lexiloom.sources import line_ranges, numbered_text

ODD = "﻿a\r\nb\rc\n\x0bd\x85e f \r\n\r\r\n\né漢🙂\x1c🙂\r\nx\x1d\x1ey\x0c"


def joined(data, width):
    """Lines put together in plain code, as ``assembled`` does; None if a range is no UTF-8."""
    lines, number = {}, 0
    for at in range(0, max(1, len(data)), width):
        pieces = line_ranges.range_pieces(lambda place, n: data[place : place + n], len(data), at, min(width, len(data) - at))
        if pieces is None:
            return None
        for k, text in enumerate(pieces):
            lines[number + k] = lines.get(number + k, "") + text
        number += len(pieces) - 1
    found = [lines[k] for k in sorted(lines)]
    return found[:-1] if found[-1] == "" else found


@pytest.mark.parametrize("text", [ODD, "", "\n", "\r", "\r\n", "a", "a\n", "\n\na", "🙂", " ", "x\r\n\r\n\r", ODD * 3])
def test_lines_do_not_depend_on_the_ranges(text):
    data = text.encode()
    for width in [*range(1, 12), 64, 1 << 20]:
        assert joined(data, width) == text.splitlines(), width


def test_a_bad_byte_is_found_wherever_it_stands():
    data = ODD.encode()
    for at in range(len(data) + 1):
        for bad in (b"\xff", b"\x80", b"\xc3", b"\xe2\x80", b"\xf0\x9f\x99", b"\xed\xa0\x80", b"\x80" * 5):
            spoilt = data[:at] + bad + data[at:]
            try:
                spoilt.decode()
            except UnicodeDecodeError:
                assert all(joined(spoilt, width) is None for width in (1, 2, 3, 4, 5, 7, 16, 1000)), (at, bad)


def test_files_are_split_and_small_ones_read_together():
    files = [(1, "a", 100), (2, "b", 0), (3, "c", 10_000), (4, "d", 5)]
    plan = line_ranges.planned(files, 6000)
    ranges = [r for p in plan for r in p.ranges]
    assert [(r.path, r.at, r.length) for r in ranges] == [("a", 0, 100), ("b", 0, 0), ("c", 0, 6000), ("c", 6000, 4000), ("d", 0, 5)]
    assert all(sum(r.length for r in p.ranges) <= 6000 for p in plan) and len(line_ranges.planned(files, 1 << 20)) == 1
    assert line_ranges.planned([], 10) == []


def wrapped(body):
    return f"title\n{RULES.start_marker} x\n{body}{RULES.end_marker} x\nlicence".encode()


@pytest.fixture()
def folder(tmp_path):
    rng = random.Random(9)
    made = {
        "odd": wrapped(ODD + "\r\n"), "long": wrapped("".join(rng.choice(["ab", "é", "\n", "\r\n", "🙂", " "]) for _ in range(3000)) + "\n"), "none": b"", "bad": wrapped("a\n") + b"\xff", "open": f"{RULES.start_marker}\nx".encode(),
        "loose": b"x\ny", "back": f"{RULES.end_marker}\nx\n{RULES.start_marker}\n".encode(), "one line": wrapped("z" * 5000 + "\n"),
    }
    for name, data in made.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    (tmp_path / "_hidden").write_bytes(b"x")
    return tmp_path, made


@pytest.mark.parametrize("width", [7, 1 << 20])
def test_files_equal_contents_in_memory(spark, folder, width):
    path, made = folder
    contents = spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "source_id string, content binary")
    whole = numbered_text.wrapped_files(contents)
    lines, files = numbered_text.scanned(line_ranges.pieces(spark, str(path), width))
    assert {r["source_id"]: r["status"] for r in files.collect()} == {r["source_id"]: r["status"] for r in whole.collect()} == {"odd": "ok", "long": "ok", "none": "no_start", "bad": "not_utf8", "open": "no_end", "loose": "no_start", "back": "ok", "one line": "ok"}
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, numbered_text.body_lines(whole).collect()))
    assert len(line_ranges.planned(line_ranges.listed(str(path)), width)) > (100 if width == 7 else 0)


def test_patterns_and_missing_paths(spark, folder):
    path, _ = folder
    assert [p.rsplit("/", 1)[-1] for _, p, _ in line_ranges.listed(f"{path}/o*.txt")] == [p for p in ("odd.txt", "open.txt", "one line.txt") if p] or len(line_ranges.listed(f"{path}/o*.txt")) == 3
    assert len(line_ranges.listed(f"file://{path}")) == 8 and line_ranges.listed(f"file://{path}")[0][1].startswith("file:///")
    with pytest.raises(FileNotFoundError):
        line_ranges.listed(f"{path}/nothing")


def test_a_stream_gives_the_lines_of_new_files(spark, folder, tmp_path_factory):
    path, _ = folder
    out, check = (str(tmp_path_factory.mktemp(x)) for x in ("out", "check"))

    def once():
        stream = line_ranges.piece_stream(spark, str(path), 64).writeStream.option("checkpointLocation", check).trigger(availableNow=True).format("parquet").start(out)
        assert stream.awaitTermination(120)
        return sorted(map(tuple, numbered_text.scanned(spark.read.parquet(out))[0].collect()))

    batch = lambda: sorted(map(tuple, numbered_text.scanned(line_ranges.pieces(spark, str(path)))[0].collect()))
    assert once() == batch()
    (path / "later.txt").write_bytes(wrapped("new\nlines\n"))
    after = once()
    assert after == batch() and ("later", 0, 3, "new") in after

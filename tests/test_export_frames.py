"""Outcomes of many small files come in few frames, and formats are found without making records."""

import pandas as pd

from corvina.sources import exports

RIS = b"TY  - JOUR\nTI  - A title %d\nER  - \n"


def test_small_files_share_a_frame(monkeypatch):
    files = pd.DataFrame({"path": [f"f{i}" for i in range(40)], "content": [RIS % i for i in range(40)]})
    found = list(exports.frames(iter([files[:25], files[25:]])))
    assert len(found) == 1 and list(found[0]["title"]) == [f"A title {i}" for i in range(40)] and set(found[0]["at"]) == {0}
    monkeypatch.setattr(exports, "FRAME_ROWS", 7)
    assert [len(f) for f in exports.frames(iter([files]))] == [7] * 5 + [5]
    monkeypatch.setattr(exports, "FRAME_CHARS", 100)
    assert sum(len(f) for f in exports.frames(iter([files]))) == 40


def test_formats_as_parsed(spark):
    odd = [("a", RIS % 1), ("b", b""), ("c", b"PK\x03\x04zip"), ("d", b"\xef\xbb\xbf" + RIS % 2), ("e", b"no format at all"), ("f", (RIS % 3).decode().encode("utf-16")), ("g", b"a,b\n1,2\n")]
    files = spark.createDataFrame(odd, "path string, content binary")
    want = exports.parsed(files).select("path", "format", "encoding").distinct().collect()
    assert sorted(map(tuple, exports.formats(files).collect())) == sorted(map(tuple, want)) and len(want) == len(odd)

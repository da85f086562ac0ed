"""Word times read from response files."""

from __future__ import annotations

import json

import pytest

from quillstream.sources import provider


def test_words_of_files(spark, tmp_path):
    word = lambda a, z, t, p=None: {"begin_time": a, "end_time": z, "text": t, "punctuation": p}
    a = {"transcripts": [{"text": "x", "sentences": [
        {"begin_time": 100, "end_time": 900, "speaker_id": 1, "words": [word(100, 300, "Hello", ","), word(300, 500, " "), word(500, 900, "world"), {"text": "…", "end_time": 950}]},
        {"begin_time": 200, "end_time": 400, "speaker_id": None, "words": [word(200, 250, "中"), {"text": "文", "punctuation": "。"}]},
        {"begin_time": 5, "end_time": 6, "words": []}, {"begin_time": 1000, "end_time": 1200, "speaker_id": 2, "words": [word(None, None, "?!")]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(a, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"transcripts": [{"sentences": [{"words": [word(0, 1, "")]}]}], "other": 1}))
    (tmp_path / "c.json").write_text(json.dumps({"transcripts": []}))
    units, empty = provider.read_words(spark, f"file://{tmp_path}")
    got = [tuple(r)[1:] for r in units.orderBy("file", "idx").collect()]
    assert got == [
        (0, 0, 0.1, 0.3, "Hello,", "word", "1", True, False), (1, 1, 0.2, 0.25, "中", "character", None, True, False), (2, 1, 0.2, 0.4, "文。", "character", None, False, True),
        (3, 0, 0.5, 0.95, "world…", "word", "1", False, True), (4, 2, 1.0, 1.2, "?!", "word", "2", True, True),
    ]
    assert sorted(r.file.split("/")[-1] for r in empty.collect()) == ["b.json", "c.json"]
    (tmp_path / "d.json").write_text("{ not json")
    with pytest.raises(Exception, match="(?i)malformed"):
        provider.read_words(spark, f"file://{tmp_path}")[0].collect()

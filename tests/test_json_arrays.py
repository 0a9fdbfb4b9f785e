"""JSON arrays by byte ranges against the whole document."""

import io
import json
import random

import pytest

from shoalsong.sources import json_arrays, tables

AWKWARD = ['a"b', "\\", "\\\\", '\\"', "{", "}]", "[{", "ü€😀", "\n\t", '{"x": [1]}', "", '"' * 5, "\\" * 9, "},{"]


def documents(seed, n):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice(AWKWARD) for _ in range(pick.randint(0, 4)))
    return [{"filename": word(), word() + "k": {"in": [word(), {"deep": word()}]}, "mean_embedding": [pick.random()] * pick.randint(0, 9)}
            for _ in range(n)]


def by_ranges(raw, size):
    """What the two passes do, without Spark."""
    handle, out, inside, depth = io.BytesIO(raw), [], False, 0
    level = int(raw.lstrip().startswith(b"["))
    for start in range(0, len(raw), size):
        data, before = json_arrays.read_range(handle, start, size)
        odd, change, opens = json_arrays.summary(data, before, inside)
        found = json_arrays.entries(handle, start, size, inside, depth, level)
        assert len(found) == dict(opens).get(level - depth, 0)
        out += found
        inside, depth = inside != odd, depth + change
    return [json.loads(t) for t in out]


@pytest.mark.parametrize("size", [1, 2, 7, 50, 333, 1 << 20])
@pytest.mark.parametrize("indent, ascii", [(None, True), (2, False)])
def test_ranges_of_any_size(size, indent, ascii):
    for seed in range(6):
        want = documents(seed, 12)
        assert by_ranges(json.dumps(want, indent=indent, ensure_ascii=ascii).encode(), size) == want


def test_other_documents():
    assert by_ranges(b"[]", 1) == by_ranges(b"", 1) == by_ranges(b" [ ] ", 2) == []
    assert by_ranges(b' {"a": {"b": 1}} ', 3) == [{"a": {"b": 1}}]
    assert by_ranges(b'[[{"no": 1}], {"a": 1}, 5, "x", {"b": []}]', 4) == [{"a": 1}, {"b": []}]


def test_files_are_read_in_many_tasks(spark, tmp_path):
    first, second = documents(1, 300), documents(2, 40)
    (tmp_path / "a.json").write_text(json.dumps(first, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(second))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "other.txt").write_text("[{}]")
    read = json_arrays.read_objects(spark, str(tmp_path), range_bytes=2000)
    assert read.rdd.getNumPartitions() > 10
    rows = sorted(read.collect())
    assert [r["position"] for r in rows] == list(range(340))
    assert [json.loads(r["text"]) for r in rows] == first + second


def test_an_index_of_one_file(spark, tmp_path):
    path = tmp_path / "index.json"
    path.write_text('[{"filename": "a.wav", "mean_embedding": [1, 0.5], "more": 1}, {"filename": 5 5}, {}]')
    rows = tables.load_references(spark, str(path), "json").orderBy("ref_id").collect()
    assert [(r["ref_id"], r["filename"], r["embedding"]) for r in rows] == [(0, "a.wav", [1.0, 0.5]), (1, None, None), (2, None, None)]

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moundworks.sources import json_array

SCHEMA = "a bigint, b string, c array<struct<d: string>>"


def rows(n):
    return [{"a": k, "b": ['plain', 'quo"te', 'back\\', '\\"', '}{][', 'é你😀', ''][k % 7] * (k % 3 + 1), "c": [{"d": "x}]"}, {"d": '"'}][:k % 3]} for k in range(n)]


def pieces(text, size):
    """The objects of a text, cut into pieces as the two passes do it."""
    data = text.encode()
    parts = [(i, data[i:i + size]) for i in range(0, len(data), size)]
    first = next((s for _, p in parts for _, s in json_array.brackets(p, 0)), 0)
    state, depth, out = 0, 0, []
    for at, part in parts:
        out += json_array.objects(part, state, depth, int(first == 0x5B), lambda n, end=at + len(part): data[end:end + n])
        told = json_array.effect(part)
        state, change = told[2 * state], told[2 * state + 1]
        depth += change
    return [json.loads(x) for x in out]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 100_000])
def test_any_cut_gives_all_objects_once(size):
    want = rows(30)
    for text in (json.dumps(want), json.dumps(want, indent=2), json.dumps(want, ensure_ascii=False)):
        assert pieces(text, size) == want
    assert pieces(json.dumps(want[5]), size) == [want[5]]
    assert pieces(json.dumps([1, "x{", None, want[1], [want[2]], True]), size) == [want[1]]
    assert pieces("[]", size) == pieces("", size) == []


_VALUE = st.recursive(st.none() | st.integers() | st.text(st.sampled_from('ab"\\{}[] é')), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12)


@settings(max_examples=150)
@given(st.lists(st.dictionaries(st.text(max_size=3), _VALUE, max_size=3), max_size=5), st.integers(1, 40))
def test_any_objects(values, size):
    assert pieces(json.dumps(values), size) == values


def test_files_are_read_by_many_tasks(spark, tmp_path):
    want = rows(5000)
    (tmp_path / "one.json").write_text(json.dumps(want[:4000], indent=1))
    (tmp_path / "two.json").write_text(json.dumps(want[4000:]))
    (tmp_path / "empty.json").write_text("")
    got = json_array.read(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema, piece_bytes=10_000)
    assert got.rdd.getNumPartitions() > 1
    assert sorted(got.collect()) == sorted(spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path)).collect())
    assert json_array.read(spark, str(tmp_path / "two.json"), got.schema).count() == 1000
    with pytest.raises(FileNotFoundError):
        json_array.read(spark, str(tmp_path / "nothing"), got.schema)

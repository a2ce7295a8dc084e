"""Texts come to the search for keywords as Arrow batches, of which one text at a time is a string of Python's."""

import pyarrow as pa

from notequery.operators import privacy


def test_keywords_are_sought_in_arrow_batches(spark):
    rules = [{"keywords": ["password"]}, {"keywords": []}, {"keywords": ["que", "pass"]}]
    texts = pa.array(["My PASSWORD é", None, "", "que\u0001", "none"])
    got = [x.to_pylist() for x in privacy.called(rules).func(iter([texts, texts.slice(3)]))]
    assert got == [[[0, 1, 2], [1], [1], [1, 2], [1]], [[1, 2], [1]]]
    assert privacy.called([{"keywords": []}]).func(iter([texts])).__next__().to_pylist() == [[0]] * 5

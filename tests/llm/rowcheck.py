"""Comparison of row lists that may hold nulls."""


def same(a, b):
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    a, b = sorted(a, key=key), sorted(b, key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y

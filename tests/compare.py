"""Rows of two engines as equal multisets."""

from collections import Counter


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


def same(df, con, sql):
    got = rows(df.columns, df.collect())
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, result.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])

"""Helpers of the tests outside ``tests/llm``."""


def rows(df):
    return sorted(tuple(r) for r in df.collect())

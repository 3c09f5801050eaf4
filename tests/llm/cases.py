"""Texts with the awkward cases every operator must take."""

BASE = " ".join(f"word{i} tail{i % 7}" for i in range(60))
LONG = " ".join(f"item{i * 7919 % 10007}" for i in range(30_000))

#: Null and empty texts, ties, repeated rows, a null id, copies in other case, a very long text, other scripts.
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One"), (6, BASE), (7, BASE), (8, BASE.upper()), (9, BASE + " more"),
    (9, BASE + " more"), (10, LONG), (11, "x " + LONG[:4000]), (None, "lost text without an id, lost text"), (None, BASE),
    (12, "日本語 テキスト é É\n日本語のとても長い行です、はい\nend"), (13, "日本語のとても長い行です、はい\r\n  A LINE OF TEXT  \n"),
    (14, "a line of text\nA LINE OF TEXT\n\nshort"), (15, "ab" * 400), (16, "z" * 199), (17, "z" * 200), (18, "z" * 201),
]

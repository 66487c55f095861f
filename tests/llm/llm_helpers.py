"""Small tables with awkward rows, and plain versions of what the operators compute."""

from __future__ import annotations

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # Extra columns whose names also occur inside the operators.
        T.StructField("sha", T.StringType()),
        T.StructField("row", T.LongType()),
        T.StructField("node", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n.dotted", T.LongType()),
    ]
)
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix strange potions near old stone bridges".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x // 65536 % len(WORDS)] + str(x // 1024 % 97))
    return " ".join(out)


def rows(texts) -> list[tuple]:
    """(doc_id, text, lang, source) to full rows."""
    return [(*t, "x", 1, "y", 0.5, 2) for t in texts]


def edge_texts() -> list[tuple]:
    base, long = sentence(1, 120), sentence(2, 30_000)
    near = base.replace(base.split()[60], "changed")
    return [
        (1, base, "en", "a"),
        (2, base.upper(), "en", "a"),
        (3, base, None, "a"),
        (3, base, "en", "a"),
        (4, near, "en", None),
        (5, None, "en", "b"),
        (6, "", "en", "b"),
        (7, " \t\n ", "de", "b"),
        (8, "%%% 123", "de", "b"),
        (9, long, "en", "c"),
        (10, long + " end", "en", "c"),
        (None, sentence(3, 40), "en", "c"),
        (None, None, None, None),
        (11, "one", "en", None),
        (12, "ONE", "en", None),
        (13, "one two", "fr", "a"),
        (14, "É é ß", "fr", "a"),
        (15, "é É ß", "fr", "a"),
    ]


def edge_docs(spark):
    return spark.createDataFrame(rows(edge_texts()), DOC_SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, k: int) -> set:
    words = WORD.findall(lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + min(k, len(words))]) for i in range(max(1, len(words) - k + 1))}


def components(texts: list[tuple], k: int, num: int, den: int) -> list[tuple]:
    """(doc_id, set size, smallest reachable id) by comparing all pairs."""
    sets = [shingles(t, k) for _, t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(texts):
        r = root(i)
        have = least.get(r)
        least[r] = doc if have is None else have if doc is None else min(have, doc)
    return [(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(texts)]


def key(row):
    return tuple((v is not None, v) if not isinstance(v, (list, tuple)) else (True, tuple(v)) for v in row)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)

import re

from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, label int, x string"

LONG = " ".join(f"word{i % 700}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ODD = [
    (1, "one two three four five six seven", "en", "a", 1, 0, 0, 0, "c"),
    (2, "one two three four five six seven", "en", "a", 1, 0, 0, 0, "c"),
    (2, "one two three four five six seven", "en", "a", 1, 0, 0, 0, "c"),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "de", "b", 0, 0, 0, 0, ""),
    (5, " \n\t ", "fr", None, 4, 0, 0, 0, ""),
    (6, LONG, "en", "a", 1, 0, 0, 0, ""),
    (7, f"start {PASSAGE} end of it", "en", "b", 1, 0, 0, 0, ""),
    (8, f"{PASSAGE} another end <|endoftext|> here", "xx", "b", 1, 0, 0, 0, ""),
    (9, "é ü x y 漢字 \U0001f600 'tis don't", "es", "c", 1, 0, 0, 0, ""),
    (None, "one two three four five six seven", "en", "a", 1, 0, 0, 0, ""),
    (None, None, "en", "a", 1, 0, 0, 0, ""),
]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k, percent):
    """doc_id -> smallest id reachable, for rows (id, text) with different ids."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def brute_repeats(rows, window=50):
    """doc_id -> kept words, for rows (id, text) with different ids."""
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {b for a in range(len(w) - window + 1) if first[tuple(w[a : a + window])] < i for b in range(a, a + window)}
        out[i] = [x for b, x in enumerate(w) if b not in gone]
    return out

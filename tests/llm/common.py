"""Brute-force versions in plain Python, and small tables of awkward documents."""

import re

import __spark_entry__ as entry

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names are those that the operators use inside.
CLASH = ("id", "key", "sha", "body", "w", "p", "start", "items", "n", "hi", "lo", "hk", "node", "shard", "words", "label", "lot", "score", "kept", "__id")


def documents(spark, texts, lang="en", clash=True):
    """A documents table from texts, (id, text) or (id, text, lang), with extra columns of clashing names."""
    rows = []
    for i, t in enumerate(texts):
        i, t, g = (i, t, lang) if not isinstance(t, tuple) else (*t, lang)[:3]
        rows.append((i, t, g, "s", len(t or "")))
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASH])
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def similar(texts, percent=75):
    """component of each id, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            same = len(sets[a] & sets[b])
            if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                links.append((a, b))
    return components(texts, links)


def contamination(text, items, window=13):
    """(n_words, n_hit, items) of a document against {item: text}."""
    w = item_words(text)
    hit, seen = set(), set()
    for item, t in items.items():
        v = item_words(t)
        m = min(window, len(v))
        for j in range(len(v) - m + 1) if m else ():
            for i in range(len(w) - m + 1):
                if w[i : i + m] == v[j : j + m]:
                    hit.update(range(i, i + m))
                    seen.add(str(item))
    return len(w), len(hit), sorted(seen)


def query(name):
    found = [k for k in entry.queries() if k.startswith(f"{name}_") or k == name]
    assert len(found) == 1
    return found[0], entry.queries()[found[0]]

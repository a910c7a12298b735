import random

from shardloom.llm.leakage import leaked_passages
from shardloom.llm.lexing import WORD, words

DOC = "doc_id long, text string, item_id int"
ITEM = "item_id long, text string, doc_id int"


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 0) for i, t in docs], DOC), spark.createDataFrame([(i, t, 0) for i, t in items], ITEM)


def brute(docs, items, n):
    out = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            q = words(item)
            m = min(n, len(q))
            grams = {tuple(q[k : k + m]) for k in range(len(q) - m + 1)} if m else set()
            if any(tuple(w[k : k + m]) in grams for k in range(len(w) - m + 1)) and m:
                out.add((d, i))
    return out


def spans(docs, items, n):
    """Every longest run of words in which each n consecutive words stand in the item, by place of the words."""
    out = set()
    for d, text in docs:
        w = words(text)
        at = [m.span() for m in WORD.finditer(text or "")]
        for i, item in items:
            q = words(item)
            m = min(n, len(q))
            if not m:
                continue
            grams = {tuple(q[k : k + m]) for k in range(len(q) - m + 1)}
            hits = [k for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in grams]
            for k in hits:
                if k - 1 not in hits:
                    last = k
                    while last + 1 in hits:
                        last += 1
                    out.add((d, i, at[k][0], at[last + m - 1][1], last + m - k))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = "the ferry carries crates of salt Über İstanbul x1".split()
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 20])))) for i in range(12)]
    docs = []
    for d in range(80):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 40]))]
        if rng.random() < 0.5:
            q = rng.choice(items)[1].split()
            lo = rng.randrange(len(q))
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + rng.choice(["", ",", "_", "\n"]) for w in q[lo : lo + rng.choice([6, 20])]]
        docs.append((d, " ".join(text)))
    a, b = frames(spark, docs, items)
    for size, segment in ((2_000_000, 5_000), (25, 5_000), (25, 8)):  # one automaton, several, and items in segments
        got = leaked_passages(a, b, window=6, automaton_words=size, segment_words=segment).collect()
        assert {tuple(r)[:2] for r in got} == brute(docs, items, 6)
        assert sorted(map(tuple, got)) == sorted(spans(docs, items, 6))


def test_no_passage_across_a_seam(spark):
    first, second = (" ".join(f"{c}{i}" for i in range(12)) for c in "wv")
    a, b = frames(spark, [(1, f"{first} {second}"), (2, f"{first} gap {second}")], [(7, f"{first} gap {second}")])
    assert sorted((r.doc_id, r.n_words) for r in leaked_passages(a, b).collect()) == [(1, 12), (1, 12), (2, 25)]


def test_offsets_are_of_the_original(spark):
    item = "Two sisters from Ikoploaya divide an orchard unevenly, while a cousin keeps the spare keys"
    text = "«Intro»​ TWO\nsisters from_Ikoploaya — divide an orchard unevenly; while a cousin keeps end."
    a, b = frames(spark, [(1, text)], [(5, item)])
    r = leaked_passages(a, b).first()
    assert text[r.start_char : r.end_char] == "TWO\nsisters from_Ikoploaya — divide an orchard unevenly; while a cousin keeps"
    assert (r.item_id, r.n_words) == (5, 12)


def test_edge_cases(spark):
    long = "filler " * 200_000 + "alpha beta gamma"
    a, b = frames(spark, [(1, None), (2, ""), (3, long), (4, "alpha beta"), (4, "alpha beta")], [(1, "Alpha, beta!"), (2, None), (3, " ... "), (None, "alpha"), (5, "alpha beta")])
    got = {tuple(r) for r in leaked_passages(a, b).select("doc_id", "item_id").collect()}
    assert got == {(3, 1), (3, 5), (4, 1), (4, 5)}
    assert leaked_passages(a, b.limit(0)).count() == 0
    assert leaked_passages(a.limit(0), b).count() == 0

import random
import tracemalloc

from quern.llm.leakage import PassageIndex, _longest, _scan, clean_words, leaked_passages, strip_stock, words_of

PASSAGE = "the half open linen vector calls publishLayerWorker56 and then the buffer harbor counter passes 6387 even if splitBudgetla swaps the voucher thread for an olive turbine"


def brute(text, passage, run=12, share=0.1):
    """Substitutions only: any aligned stretch of at least ``run`` words with few enough differences."""
    a, b = words_of(text), words_of(passage)
    for i in range(len(a)):
        for j in range(len(b)):
            bad = 0
            for n in range(min(len(a) - i, len(b) - j)):
                bad += a[i + n] != b[j + n]
                if n + 1 >= run and a[i] == b[j] and a[i + n] == b[j + n] and bad <= (n + 1) * share + 1e-9:
                    return True
    return False


def test_bounds():
    assert clean_words(12, 0.1) == 6


def test_stock_sentences(spark):
    texts = ["One thing. Answer now.", "Another. Answer now.", "Third! Answer  now"] + ["x y. answer now."] * 3 + [None, "", "Answer now."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.text.strip() for r in strip_stock(df, "id", "text").collect()}
    assert got == {0: "One thing.", 1: "Another.", 2: "Third!", 3: "x y.", 4: "x y.", 5: "x y."}
    assert strip_stock(df.limit(0), "id", "text").collect() == []


def test_phrase_that_a_passage_repeats(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    phrase, tail = " ".join(word() for _ in range(7)), " ".join(word() for _ in range(11))
    passage = f"{phrase} {' '.join(word() for _ in range(40))} {phrase} {tail}"
    docs = spark.createDataFrame([(1, f"{phrase} {tail}"), (2, f"intro {phrase} {tail} {' '.join(word() for _ in range(50))} {phrase} end"), (3, f"{phrase} {' '.join(word() for _ in range(20))} {phrase}")], "doc_id bigint, text string")
    items = spark.createDataFrame([("i", passage)], "item_id string, passage string")
    got = {x.doc_id: (x.first_word, x.words) for x in leaked_passages(docs, items, "doc_id", "text").collect()}
    assert got == {1: (0, 18), 2: (1, 18)}


def test_longest_stretch_against_all_stretches():
    r = random.Random(8)
    for _ in range(2000):
        matched = [r.random() < 0.85 for _ in range(r.randrange(0, 40))]
        best = None
        for a in range(len(matched)):
            for b in range(a + 1, len(matched) + 1):
                if matched[a] and matched[b - 1] and b - a >= 5 and matched[a:b].count(False) <= 0.1 * (b - a) + 1e-9 and (best is None or b - a > best[1]):
                    best = (a, b - a)
        assert _longest(matched, 5, 0.1) == best


def test_memory_of_a_large_batch():
    index = PassageIndex([words_of(PASSAGE)], 6)
    texts = [" ".join(f"w{n * m % 9973}" for m in range(1500)) for n in range(1500)] + [PASSAGE]  # 12 MB
    tracemalloc.start()
    found = list(_scan(map(words_of, texts), index, 12, 0.1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [n for n, *_ in found] == [1500]
    assert peak < 100 << 20


def test_altered_dress(spark):
    w = PASSAGE.split()
    altered = " ".join("other" if n in (3, 15) else x for n, x in enumerate(w))
    quoted = "\n> ".join(" ".join(w[i : i + 6]) for i in range(0, len(w), 6))
    rows = [
        (1, f"Intro. {PASSAGE.upper()}! end"), (2, f"# **{quoted}**"), (3, PASSAGE.replace("the", "&quot;the&quot;").replace(" ", "  ")), (4, f"x {altered} y"),
        (5, " ".join(w[:11])), (6, " ".join("other" if n % 5 == 0 else x for n, x in enumerate(w))), (7, None), (8, ""), (9, "filler words " * 20000 + " ".join(w[2:16]) + " more words" * 1000), (10, " ".join(w[5:17])), (10, " ".join(w[5:17])), (None, PASSAGE),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([("i1", PASSAGE), ("i1", PASSAGE), ("i2", "too short to leak"), ("i3", None), (None, PASSAGE + " twice over")], "item_id string, passage string")
    got = leaked_passages(docs, items, "doc_id", "text").collect()
    assert {r.doc_id for r in got if r.item_id == "i1"} == {1, 2, 3, 4, 9, 10}
    assert leaked_passages(docs.limit(0), items, "doc_id", "text").collect() == []
    assert leaked_passages(docs, items.limit(0), "doc_id", "text").collect() == []


def test_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"word{n}x" for n in range(400)]
    passages = [" ".join(r.choice(vocabulary) for _ in range(30)) for _ in range(15)]
    docs = []
    for n in range(300):
        p = r.choice(passages).split()
        start, length = r.randrange(0, 18), r.randrange(8, 20)
        piece = p[start : start + length]
        for _ in range(r.choice((0, 0, 1, 2, 3))):
            piece[r.randrange(len(piece))] = "changed"
        docs.append((n, " ".join(r.choice(vocabulary) for _ in range(20)) + " " + " ".join(piece) + " " + " ".join(r.choice(vocabulary) for _ in range(10))))
    items = spark.createDataFrame([(f"i{n}", p) for n, p in enumerate(passages)], "item_id string, passage string")
    got = {(x.doc_id, x.item_id) for x in leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), items, "doc_id", "text", block_passages=4).collect()}
    want = {(d, f"i{n}") for d, t in docs for n, p in enumerate(passages) if brute(t, p)}
    assert want and want <= got
    assert len(got - want) <= 0.02 * len(want) + 2  # runs with left-out words are no plain substitutions

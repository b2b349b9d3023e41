import random

from riskloom.llm.leakage import MIN_WORDS, Automaton, leaked_spans, without_leaks, words_of


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words_of(t or "")
        for k in range(len(w) - MIN_WORDS + 1):
            grams.setdefault(tuple(w[k : k + MIN_WORDS]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of(t or "")
        for k in range(len(w) - MIN_WORDS + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + MIN_WORDS]), ())}
    return out


def made(seed, n_items=30, n_docs=120, alphabet=6):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijkl"[:alphabet])
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        w = [word() for _ in range(rng.randint(0, 80))]
        if d % 3 == 0:
            src = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(src) - 12))
            w[10:10] = src[a : a + rng.randint(8, 20)]
        docs.append((d, rng.choice([" ", ", ", "\n> "]).join(w)))
    return docs, items


def test_automaton_equals_brute_force_even_with_repetitive_items():
    for seed in range(12):
        docs, items = made(seed, alphabet=2 + seed % 5)
        a = Automaton([(i, words_of(t)) for i, t in items], MIN_WORDS)
        got = {(d, i) for d, t in docs for _, _, found in a.spans(words_of(t)) for i in found}
        assert got == brute(docs, items)


def test_spans_on_frames_with_nulls_and_empty(spark):
    docs, items = made(99, alphabet=4)
    docs += [(1000, None), (1001, ""), (1002, "b " * 30000)]
    items += [(77, None), (78, "")]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, x) for r in leaked_spans(d, i).collect() for x in r["items"]}
    assert got == brute(docs, items)
    assert leaked_spans(d, i.limit(0)).count() == 0 and leaked_spans(d.limit(0), i).count() == 0


def test_case_width_and_marks_between_words():
    item = "One two three four five six seven eight nine ten eleven twelve thirteen"
    a = Automaton([(1, words_of(item))], MIN_WORDS)
    assert a.spans(words_of("x ＯＮＥ, two—three four\n> five six (seven) eight; nine ten eleven twelve THIRTEEN y"))
    assert not a.spans(words_of(item.replace("seven", "7")))


def test_removal_keeps_the_rest(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    before, after = " ".join(f"p{i}" for i in range(20)), " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"{before} {item}! {after}"), (2, item), (3, None), (4, "clean")], "doc_id long, text string")
    spans = leaked_spans(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    got = {r.doc_id: r for r in without_leaks(docs, spans).collect()}
    assert got[1].clean_text.split() == (before + " " + after).split() and got[1].n_removed == 13
    assert got[2].clean_text == "" and got[2].coverage == 1.0 and got[3].clean_text is None and got[4].clean_text == "clean"

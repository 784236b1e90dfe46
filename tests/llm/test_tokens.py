"""The automaton against cutting off the longest piece."""

import random

from fixtures_llm import no_docs, odd_docs, odd_rows

from pulse.llm import tokens


def test_automaton_equals_greedy():
    rng = random.Random(1)
    piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    for _ in range(800):
        first, rest = ({piece() for _ in range(rng.randint(1, 8))} for _ in range(2))
        if rng.random() < 0.3:
            first.add("")
        a = tokens.Automaton(sorted(first), sorted(rest))
        for _ in range(15):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert a.count(word) == tokens.greedy(word, first, rest)


def test_counts_with_the_vocabulary(spark):
    first, rest = map(set, tokens.read_pieces())
    want, known = [], {}
    for i, t, *_ in odd_rows():
        words = [w.decode() for w in (t or "").encode().split()]
        n = [known.setdefault(w, tokens.greedy(w, first, rest)) for w in words]
        want.append((i, len(words), sum(x or 1 for x in n), n.count(0)))
    got = tokens.token_counts(odd_docs(spark)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.token_counts(no_docs(spark)).count() == 0

"""Names that start sentences are slots like any other."""

import itertools

import numpy as np

from pairlens.llm import template_decontam as td

ITEM = "Anna has 3 boxes of 12 pens each. Anna gives 5 pens to Tom and buys 2 more boxes. How many pens does Anna have now?"


def shares(item, text):
    return dict(td.Index([(1, item)], 5, 0.8).matches(text))


def test_renames_at_sentence_starts():
    assert shares(ITEM, ITEM) == {1: 1.0}
    assert shares(ITEM, ITEM.replace("Anna", "Mary")) == {1: 1.0}
    assert shares(ITEM, "Read this. " + ITEM.replace("Anna", "Mary").replace("12", "14").replace("Tom", "Ben") + " Well.") == {1: 1.0}
    # the item's sentence follows a comma in the text, so a start meets a name or a word in lower case
    assert shares(ITEM, "today " + ITEM.replace("Anna", "Mary").replace("now", "left").replace(". How", ", how")) == {1: 21 / 22}
    twice = "Anna runs. Anna sings. Tom eats. Tom sleeps and Anna drinks 2 cups of tea"
    assert shares(twice, twice.replace("Anna", "Eve").replace("Tom", "Bob")) == {1: 1.0}


def test_renames_that_disagree_are_no_leak():
    other = ITEM
    for name in ("Mary", "Berta", "Cleo"):
        other = other.replace("Anna", name, 1)
    assert shares(ITEM, other) == {}
    assert shares(ITEM, ITEM.replace("Anna", "Tom")) == {}


def test_readings_are_all_there():
    codes, maybe, _, _ = td.template("Yes. No. Maybe. So it is. Here we are. Yes.", td.Words())
    hashes, places = td.readings(codes, maybe, 5, np.arange(len(codes) - 4))
    want = set()
    for q in range(len(codes) - 4):
        free = np.flatnonzero(maybe[q : q + 5])
        for pick in itertools.product([False, True], repeat=len(free)):
            some = codes[q : q + 5].copy()
            some[free[list(pick)]] = td.NAME
            want.add((int(td.windows(some, 5)[0]), q))
    assert {(int(h), int(q)) for h, q in zip(hashes, places)} == want

"""Mail addresses of any length are replaced whole."""

import random

import regex

from pairlens.llm.edit_counts import redactions


def test_long_local_parts():
    name = "n" * 70 + "+tag." + "x" * 200
    text = f"write to {name}@mail.example.org today, or a.b@c.de@f.gh"
    end = 9 + len(name) + len("@mail.example.org")
    at = text.index("a.b@")
    assert redactions(text) == [(9, end, "[mail]"), (at, at + 8, "[mail]")]


def test_addresses_match_a_whole_pattern():
    whole, rng = regex.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(["a", ".", "@", " ", "b" * 80, "-", "+", "é"]) for _ in range(rng.randint(0, 14)))
        assert redactions(text) == [(m.start(), m.end(), "[mail]") for m in whole.finditer(text)], text

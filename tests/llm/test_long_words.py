"""Token counts of whole texts by brute force, and of text without spaces."""

import random
import re
import time

import pyarrow as pa

from loomstone.llm import tokens

WORD = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^a-z\x80-\xff0-9\x09-\x0d\x20]+")


def plain_count(text, known, longest):
    total = 0
    for word in WORD.findall("".join(c.lower() if c.isascii() else c for c in text or "").encode()):
        i = n = 0
        while i < len(word):
            size = next((s for s in range(min(longest, len(word) - i), 0, -1) if word[i : i + s] in known), 0)
            if not size:
                n = 1
                break
            i, n = i + size, n + 1
        total += n
    return total


def test_whole_texts_by_brute_force():
    automaton = tokens.automaton_of(tokens.VOCABULARY)
    known = {bytes(p) for p in tokens.read_vocabulary()}
    longest = max(map(len, known))
    rng = random.Random(4)
    chinese = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    thai = lambda n: "".join(chr(rng.randrange(0xE01, 0xE3A)) for _ in range(n))
    english = lambda n: " ".join(rng.choice(["The", "quick", "internationalisation", "x1y22", "don't", "…!?", "naïve", "\x00\x1f"]) for _ in range(n))
    texts = [None, "", " \n\t", english(3_000), chinese(4_000), thai(3_000), "a" * 5_000, "ab1" * 2_000, "!" * 4_000, english(40) + chinese(900) + " " + chinese(70), "é" * 2_000 + " É", "\U0001f600" * 500]
    texts += [" ".join(chinese(rng.randint(1, 60)) for _ in range(800)), *(english(20) for _ in range(50))]
    got = tokens.count_tokens(pa.array(texts), automaton)
    assert got.tolist() == [plain_count(t, known, longest) for t in texts]


def test_a_vocabulary_that_cannot_spell_all():
    pieces = [tuple(p) for p in (b"a", b"ab", b"abc", b"bcd", b"c", b"xyz", b"x")]
    automaton, known = tokens.LongestMatch(pieces), {bytes(p) for p in pieces}
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdxyz ") for _ in range(rng.randint(0, 900))) for _ in range(300)] + ["abc" * 3_000, "abcb" + "a" * 3_000, "a" * 3_000 + "b" * 2]
    assert tokens.count_tokens(pa.array(texts), automaton).tolist() == [plain_count(t, known, 3) for t in texts]


def test_a_megabyte_without_spaces_takes_seconds():
    automaton = tokens.automaton_of(tokens.VOCABULARY)
    rng = random.Random(5)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(350_000))
    tokens.count_tokens(pa.array(["漢字" * 50]), automaton)
    began = time.time()
    assert tokens.count_tokens(pa.array([text, "z" * 1_000_000]), automaton).min() > 1000
    assert time.time() - began < 5

import random

from textweave.functions.substrings import Finder


def test_places_and_counts():
    """As a search for each string alone has them: lengths around eight bytes, borders, ends of texts, zero bytes."""
    r = random.Random(5)
    word = lambda n: bytes(r.choice(b"ab\0") for _ in range(n))
    strings = sorted({word(r.choice([1, 2, 3, 7, 8, 9, 12, 16, 17, 25])) for _ in range(150)} | {b"a", b"aa", b"abababab", b"ababababa", "ñé".encode()})
    texts = [word(r.choice([0, 1, 5, 8, 40, 300])) for _ in range(60)] + [b"a" * 70_000 + "ñé".encode(), b"", b"abababababab" * 9]
    finder = Finder(strings)
    got = finder.counts(texts)
    assert got.tolist() == [[t.count(s) for s in strings] for t in texts]
    text, string, place = finder.find(texts)
    joined = b"".join(texts)
    assert all(joined[p : p + len(strings[s])] == strings[s] for s, p in zip(string.tolist(), place.tolist()))
    assert {(int(t), int(s)) for t, s in zip(text, string)} == {(t, s) for t, x in enumerate(texts) for s, y in enumerate(strings) if y in x}
    assert Finder([]).counts(texts).shape == (len(texts), 0) and finder.counts([]).shape == (0, len(strings))

"""Personal data: patterns against plain regular expressions, the field against plain Viterbi, held-out accuracy."""

import itertools
import random
import re
import time

import numpy as np
import pytest

from tablegauge.llm import personal as P
from tablegauge.llm.common import table
from tests.llm.helpers import documents, texts


def plain(text):
    """The base kinds as they are defined, by the patterns as they stand."""
    def digits(s):
        return "".join(c for c in s if c in "0123456789")

    def luhn(s):
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0

    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_patterns_on_random_texts():
    own = random.Random(2)
    pieces = ["4111 1111 1111 1111", "4111-1111-1111-1112", "5555555555554444", "+1 (988) 555-2485", "+49 30 1234567", "10.0.0.255", "10.0.0.256", "1.2.3.4.5.6.7.8", "007.08.1.2", "a@b.co", "x.y@z", "@", "@@", "q@w.e.r@t.y", "+", "+1", "-", ".", "..",
              " ", "  ", "\n", "1", "22", "é", "５", "a@b..c", "%+@-.-", "()", "0" * 12, "0 " * 9]
    for _ in range(3_000):
        text = "".join(own.choice(pieces) for _ in range(own.randint(1, 9)))
        assert sorted(P.plain_spans(text)) == sorted(plain(text)), text


def test_long_runs_take_linear_time():
    for text in ("x" * 1_000_000 + "@", "1" * 1_000_000, "1 " * 500_000, "@" * 200_000, "a@" * 200_000, "1." * 300_000, "+1" + " (" * 400_000, "+1 " * 200_000, "(1) at dot " * 60_000, "415-555-0134" + "." * 1_000_000, "(" * 300_000 + "415-555-0134", "415-555-0134" + ")" * 300_000):
        began = time.time()
        P.personal_spans([text], P.Decoder(P.field()))
        assert time.time() - began < 60, text[:10]  # a quadratic search would take hours


def brute(scores, moves):
    """The best labels of a short sequence by trying all; outside before and after."""
    def value(labels):
        ends = (0, *labels, 0)
        return sum(s[y] for s, y in zip(scores, labels)) + sum(moves[a, b] for a, b in zip(ends, ends[1:]))

    return max(itertools.product(range(scores.shape[1]), repeat=len(scores)), key=value)


def test_viterbi_against_all_paths():
    own = np.random.default_rng(1)
    moves = own.standard_normal((3, 3))
    sizes = [1, 2, 5, 5, 3, 7, 1]
    ends = np.cumsum(sizes)
    scores = own.standard_normal((ends[-1], 3))
    got = P.decoded(scores, moves, ends - sizes, ends)
    for a, b in zip(ends - sizes, ends):
        assert tuple(got[a:b]) == brute(scores[a:b], moves)
    assert len(P.decoded(scores[:0], moves, ends[:0], ends[:0])) == 0


def sentence(words):
    line = "\n|\n" + " ".join(words) + "\n|"
    return line, np.array([1, len(line) - 1])


def test_words_that_are_surely_outside_change_nothing():
    own, field = random.Random(3), P.field()
    decoder = P.Decoder(field)
    for s in [s for s in P.labelled(5, 2)] + [[(own.choice(["1", "(12)", "at", "dot", "a@b", "ab", "x.y", "[at]", "555-1234", "A-1"]), "O") for _ in range(12)] for _ in range(100)]:
        words = [w for w, _ in s]
        _, got = decoder.labels(*sentence(words))
        row = np.stack([field.of_word(w) for w in words])
        scores = row[:, 1].copy()
        scores[1:] += row[:-1, 0]
        scores[:-1] += row[1:, 2]
        whole = P.decoded(scores, field.moves, np.array([0]), np.array([len(words)]))
        assert got[1:-1].tolist() == whole.tolist()


def test_shapes_are_those_of_the_features():
    words = ["at", "AT", "At", "dot", "ab1", "x1y", "12345", "123456", "1234567", "a-b", "A--b", "é1", "(1)", "(12)", "a.b.c"]
    own = P.Shapes(np.frombuffer(" ".join(words).encode("utf-32-le"), dtype=np.uint32))
    same = {}
    for w, number in zip(words, own.number.tolist()):
        assert same.setdefault(number, P.features(w)) == P.features(w)
    assert [(int(a), int(b)) for a, b in zip(own.starts, own.ends)] == [m.span() for m in re.finditer(r"\S+", " ".join(words))]


def test_held_out_accuracy():
    decoder, right, total = P.Decoder(P.field()), 0, 0
    for s in P.labelled(99, 6):
        _, got = decoder.labels(*sentence([w for w, _ in s]))
        right += [P.LABELS[i] for i in got[1:-1]] == [lab for _, lab in s]
        total += 1
    assert right >= 0.95 * total


@pytest.mark.parametrize("text,kind,found", [
    ("call (988) 555-2485 now", "phone", "(988) 555-2485"), ("(see 415-555-0134)", "phone", "415-555-0134"), ("mail john at example dot com please", "email", "john at example dot com"),
    ("bob[at]mail.org, ok", "email", "bob[at]mail.org"), ("tel 415-555-0134" + "." * 5_000, "phone", "415-555-0134"), ("10[.]0[.]0[.]1 is up", "ip", "10[.]0[.]0[.]1"), ("card 4111.1111.1111.1111 on", "card", "4111.1111.1111.1111"),
])
def test_spelled_otherwise(text, kind, found):
    at = text.index(found)
    assert P.personal_spans([text], P.Decoder(P.field())) == [[(kind, at, at + len(found), False)]]


def test_clean_texts_stay_clean():
    clean = ["They look at that dot on the map.", "In 1999, 12 of 345 were lost (3.5 %).", "Version 1.2.3 of 2024-01-02 at 10:30", "isbn 978-3-16-148410-0", "write at length, dot by dot", "ratio 100:200, sum 1.234.567", ""]
    assert P.personal_spans(clean, P.Decoder(P.field())) == [[]] * len(clean)


def test_a_text_is_judged_alone(spark):
    rows = texts() + [(200 + i, t) for i, t in enumerate(["tel. 415-555-0134", "0134 now", "john at example dot", "com", "x@y.org", "+1 (988) 555-2485", "4111 1111 1111 1111 " * 3, "| 10.0.0.1 |", "a b@c.de f"])]
    alone = [P.personal_spans([t or ""], P.Decoder(P.field()))[0] for _, t in rows]
    together = P.personal_spans([t or "" for _, t in rows], P.Decoder(P.field()))
    assert alone == together
    got = sorted((r.doc_id is not None, r.doc_id or 0, [tuple(s) for s in r.spans]) for r in P.find_personal(documents(spark, rows)).collect())
    assert got == sorted((i is not None, i or 0, s) for (i, _), s in zip(rows, alone))
    assert P.find_personal(documents(spark, rows[:1]).limit(0)).collect() == []


def test_given_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.plain] for r in P.find_personal(docs).collect()}
    for r in docs.collect():
        assert sorted(found[r.doc_id]) == sorted(plain(r.text or ""))

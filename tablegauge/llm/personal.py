"""Personal data in text: plain patterns, and a linear-chain conditional random field over the shapes of words.

A text is cut at white space. The shape of a word keeps its marks, the runs of its letters and how many digits stand
together. The field scores each word's label (outside, or first or further word of a kind) from its own shape, those of the words
around it, and the label before. It is trained here on a small labelled table (``EXAMPLES``, filled in by
rule) by the gradient of its likelihood. Words are decoded by Viterbi, many stretches of words at a time: where "outside" wins by more than
any change of labels around can make up for, it is the label of every best path, so only the stretches between such words are decoded.
A span that the field finds is kept if its digits or its name are those of the kind.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablegauge.llm.common import arrow_table, text_groups

GROUP_BYTES = 2 << 20
#: The kinds in their order, their patterns, digits of a card and of a phone number.
KINDS = ("email", "ip", "card", "phone")
CARD_DIGITS, PHONE_DIGITS, PART_MOST = (12, 19), (9, 15), 255
#: Possessive forms and the place before them give the same matches in one pass over a run of digits.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

FOUND = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())])))])


# Plain patterns.

def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: each is looked for from its ``@``, so that a long word is read once."""
    end, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and text[first - 1] in NAME:
            first -= 1
        host = HOST.match(text, at) if first < at else None
        if host:
            yield first, host.end()
            end = host.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    doubled = "0246813579"
    return sum(int(doubled[int(d)]) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= PART_MOST for p in text.split("."))


def is_card(text: str) -> bool:
    digits = digits_of(text) if len(text) < 3 * CARD_DIGITS[1] else ""
    return CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Addresses and numbers written plainly, leftmost and non-overlapping within a kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not any(d in text for d in "0123456789"):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if is_ip(m[0])]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= CARD_DIGITS[0] and is_card(m[0])]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= len(digits_of(m[0])) <= PHONE_DIGITS[1]]
    return out


# The labelled table: the words of a span stand between < > after its kind; # is any digit, $ one to three of them, NAME and HOST are made of syllables.

EXAMPLES = (
    "you can write to <email NAME at HOST dot com> for the list", "mail <email NAME (at) HOST (dot) org> before noon.", "contact: <email NAME[at]HOST.com> or the desk", "reach me, <email NAME [at] HOST [dot] net>, any day",
    "send it to <email NAME(at)HOST.org>.", "her address is <email NAME AT HOST DOT com>", "write <email NAME.NAME at HOST dot co dot uk> today", "(<email NAME{at}HOST{dot}com>)", "ask <email NAME @ HOST.com> for more", "<email NAME at HOST dot org>",
    "call <phone (###) ###-####> after six", "tel. <phone ###-###-####>, room #", "phone: <phone ###.###.####>", "ring <phone 0## #### ####> or come by.", "mobile <phone 00## ## #### ####> at night", "fax <phone (0##) #### ####>.",
    "call <phone ### ### ####> now", "tel <phone 0### ######> please", "by phone (<phone ###-###-####>) or mail", "office <phone 1-###-###-####>, ask for me", "phone <phone 0# ## ## ## ##>.", "at <phone (###)###-####> all day",
    "from <ip $[.]$[.]$[.]$> to the gate", "host <ip $[.]$[.]$[.]$>, port ####", "blocked <ip $(.)$(.)$(.)$> again", "the server <ip $ dot $ dot $ dot $> is down", "trace <ip $ [.] $ [.] $ [.] $>.",
    "card <card ####.####.####.####> was charged", "paid with <card ####/####/####/####>.", "number <card ####  ####  ####  ####> expires ##/##", "visa <card ####_####_####_####>, thanks", "card no. <card #### - #### - #### - ####> on file",
    "on ####-##-## at ##:## we met at the gate", "the price is ####.## and not ###,###.", "version #.#.# of #### was out on ##.##.####", "see pages ###-### and ###, or line ####", "order ##########, item ###-##, box #",
    "he was at home (at least then) and on call", "they look at that dot on the map and at this", "it was ## ## ## in rows of ### ###", "isbn ###-#-##-######-#, edition #", "from #### to #### it rose by ##%", "ratio ###:###, id #####-#####",
    "room ###, floor #, #### people", "a total of # ### ### was paid", "in ####, ## of ### were lost (####)", "the of and in to was, for on that with. By from they are.", "le la de et les. Der und die, das nicht; el que en los",
    "section #.#.#.# shows it", "score ##-##, then ###-##", "at ##.## on ##/##/#### they left", "call it what you want, at any time", "write at length, dot by dot", "sum ###.###.### of all", "#### #### words in #### texts", "(###) was the first, (##) the next",
    "look at [###] and [##] in the list", "a #-#-# start", "code A-####-B, part ##", "### ###", "##", "time ##:##:##, zone +##", "it is #. Then #) and #; so (#).", "part[#] of list[##]", "one @ ### each", "of - and / to _ or . in",
)
#: Rounds over the filled-in examples, step, pull of the weights towards zero, fillings of each example.
ROUNDS, STEP, PULL, FILLINGS = 100, 0.2, 1e-4, 6
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SYLLABLES = ("an", "be", "cor", "do", "el", "fi", "gra", "hu", "in", "jo", "ka", "lo", "mi", "ne", "os", "pe", "qua", "ri", "st", "tu", "ve", "xa", "yl", "zo")


def filled(example: str, own: random.Random) -> list[tuple[str, str]]:
    """The words of an example with their labels."""
    def word(most: int) -> str:
        return "".join(own.choice(SYLLABLES) for _ in range(own.randint(1, most)))

    marked = re.sub("<([a-z]+) ([^>]*)>", lambda m: f"\x01{KINDS.index(m[1])}{m[2]}\x02", example)
    marked = re.sub("NAME", lambda m: word(3) + (str(own.randint(1, 99)) if own.random() < 0.3 else ""), marked)
    marked = re.sub("HOST", lambda m: word(3), marked)
    marked = re.sub(r"\$", lambda m: "#" * own.randint(1, 3), marked)
    marked = re.sub("#", lambda m: own.choice("0123456789"), marked)
    out, kind = [], None
    for w in marked.split():
        label = "O" if kind is None else f"I-{kind}"
        if "\x01" in w:
            before, after = w.split("\x01")
            kind, w = KINDS[int(after[0])], before + after[1:]
            label = f"B-{kind}"
        if "\x02" in w:
            kind, w = None, w.replace("\x02", "")
        if label == "O" and w.isalpha() and own.random() < 0.5:
            w = word(5)
        out.append((w, label))
    return out


# Shapes of words.

#: Classes of code points: 0 white space, 1 small letter, 2 capital, 3 digit, else a mark by itself.
WHITE, SMALL, CAPITAL, DIGIT = 0, 1, 2, 3
CLASSES = np.arange(128, dtype=np.uint8) + 4
CLASSES[[0x20, *range(0x09, 0x0E)]] = WHITE
CLASSES[[*range(0x61, 0x7B)]], CLASSES[[*range(0x41, 0x5B)]], CLASSES[[*range(0x30, 0x3A)]] = SMALL, CAPITAL, DIGIT
#: Digits of a run that the shape tells apart, and characters of a shape.
RUN, LONGEST = 5, 24
#: Short words that stand for a mark in spelled addresses.
SPELLED = frozenset(("at", "dot"))
WEIGHT = (np.arange(1, 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
FACTOR = 0xD1342543DE82EF95


def classes_of(points: np.ndarray) -> np.ndarray:
    """The class of each code point; beyond ASCII all are small letters."""
    return np.where(points < 128, CLASSES[np.minimum(points, 127)], SMALL).astype(np.uint8)


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    out = np.full(LONGEST + 1, FACTOR, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Shapes:
    """The words of some text (code points) and a number for the shape of each; equal numbers mean equal shapes."""

    def __init__(self, points: np.ndarray):
        kinds = classes_of(points)
        gap = kinds == WHITE
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
        self.starts, self.ends = edges[::2], edges[1::2]
        # What a shape keeps: the first of a run, and the first digits of a run of digits.
        change = np.ones(len(kinds), dtype=bool)
        change[1:] = kinds[1:] != kinds[:-1]
        since = np.arange(len(kinds)) - np.maximum.accumulate(np.where(change, np.arange(len(kinds)), 0))
        keep = ~gap & (change | ((kinds == DIGIT) & (since < RUN)))
        before = np.concatenate([[0], np.cumsum(keep)])
        first, last = before[self.starts], before[self.ends]
        kept = kinds[keep]
        number = np.zeros(len(self.starts), dtype=np.uint64)
        length = np.minimum(last - first, LONGEST)
        powers, left = _powers(), np.arange(len(self.starts))
        for i in range(LONGEST):
            left = left[length[left] > i]
            if not len(left):
                break
            number[left] += WEIGHT[kept[first[left] + i]] * powers[i]
        spelled = np.flatnonzero((self.ends - self.starts <= 3) & (length == 1))
        for w in (*SPELLED, *(w.upper() for w in SPELLED)):  # words that count by their letters
            own = np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32)
            some = spelled[self.ends[spelled] - self.starts[spelled] == len(own)]
            same = np.all(points[self.starts[some][:, None] + np.arange(len(own))] == own, axis=1) if len(some) else np.zeros(0, dtype=bool)
            number[some[same]] = WEIGHT[hash_of(w.lower())]
        self.number = number


def hash_of(word: str) -> int:
    return 200 + sorted(SPELLED).index(word)


def features(word: str) -> list[str]:
    """What the field knows of a word, its shape taken apart."""
    if word.lower() in SPELLED and word in (word.lower(), word.upper()):
        return ["word " + word.lower()]
    shape, run, last = [], 0, -1
    for k in classes_of(np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)).tolist():
        run = run + 1 if k == last else 1
        last = k
        if run == 1 or k == DIGIT and run <= RUN:
            shape.append(("", "a", "A", "0")[k] if k < 4 else chr(k - 4))
    full = "".join(shape[:LONGEST])
    core = full.strip(".,;:!?'\"()[]{}")
    marks = "".join(sorted({c for c in core if c not in "aA0"}))
    digits = core.count("0")
    return ["whole " + full, "shape " + core, "marks " + marks, f"digits {min(digits, 12)}", f"kinds {'a' in core.lower()} {digits > 0} {marks != ''}", f"ends {core[:1]}{core[-1:]}", f"after {full[-1:] in '.,;:!?'}"]


class Field:
    """The weights: of a label and a feature of the word before, the word, and the word after; of a label and the next."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        #: What a label other than outside can gain by the move into it, and the last of a span by the move out.
        self.into, self.out_of = moves.max(axis=0)[1:] - moves[0, 0], moves[1:, 0].max() - moves[0, 0]

    def of_word(self, word: str) -> np.ndarray:
        """Scores of the labels that a word gives to the word after, to itself, and to the word before."""
        out = np.zeros(self.weights.shape[1:])
        for name in features(word):
            if name in self.names:
                out += self.weights[self.names[name]]
        return out


def summed(x: np.ndarray, through: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all moves."""
    top = x.max(axis=1, keepdims=True)
    return np.log(np.exp(x - top) @ through) + top


def trained(sentences: list[list[tuple[str, str]]]) -> Field:
    """The field of greatest likelihood, by steps of Adam over all sentences at once.

    Before and after each sentence stands a word without features that is outside.
    """
    label = {k: i for i, k in enumerate(LABELS)}
    names: dict[str, int] = {}
    sets: dict[tuple, int] = {(): 0}
    n, most, k = len(sentences), max(map(len, sentences)) + 2, len(LABELS)
    used, gold, real, edge = np.zeros((n, most), dtype=np.int64), np.zeros((n, most), dtype=np.int64), np.zeros((n, most), dtype=bool), np.zeros((n, most, 1), dtype=bool)
    for i, s in enumerate(sentences):
        for t, (w, name) in enumerate(s, 1):
            used[i, t] = sets.setdefault(tuple(names.setdefault(f, len(names)) for f in features(w)), len(sets))
            gold[i, t] = label[name]
        real[i, :len(s) + 2], edge[i, [0, len(s) + 1]] = True, True
    has = np.zeros((len(sets), len(names)))  # the features of each set
    for own, row in zip(sets, has):
        row[list(own)] = 1
    order = np.argsort(used.reshape(-1), kind="stable")
    begins = np.searchsorted(used.reshape(-1)[order], np.arange(len(sets)))
    weights, moves = np.zeros((len(names), 3, k)), np.zeros((k, k))
    parts = [weights, moves]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    shut = np.where(edge & (np.arange(k) > 0), -1e4, 0.0)
    for turn in range(1, ROUNDS + 1):
        own = np.tensordot(has, weights, 1)[used]  # sentence, word, direction, label
        scores = own[:, :, 1] + shut
        scores[:, 1:] += own[:, :-1, 0]
        scores[:, :-1] += own[:, 1:, 2]
        through = np.exp(moves)
        ahead, back = np.empty((n, most, k)), np.zeros((n, most, k))
        ahead[:, 0] = scores[:, 0]
        for t in range(1, most):
            ahead[:, t] = np.where(real[:, t, None], summed(ahead[:, t - 1], through) + scores[:, t], ahead[:, t - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        for t in range(most - 2, -1, -1):
            back[:, t] = np.where(real[:, t + 1, None], summed(scores[:, t + 1] + back[:, t + 1], through.T), 0)
        pull = np.where(real[:, :, None], np.eye(k)[gold] - np.exp(ahead + back - total[:, None, None]), 0)
        shifted = np.zeros((n, most, 3, k))
        shifted[:, :, 1], shifted[:, :-1, 0], shifted[:, 1:, 2] = pull, pull[:, 1:], pull[:, :-1]
        slope = [np.tensordot(has.T, np.add.reduceat(shifted.reshape(-1, 3, k)[order], begins), 1), np.zeros((k, k))]
        for t in range(1, most):
            on = real[:, t]
            x, y = ahead[on, t - 1], scores[on, t] + back[on, t]
            tops = x.max(axis=1), y.max(axis=1)
            slope[1] -= through * ((np.exp(x - tops[0][:, None]) * np.exp(tops[0] + tops[1] - total[on])[:, None]).T @ np.exp(y - tops[1][:, None]))
            np.add.at(slope[1], (gold[on, t - 1], gold[on, t]), 1)
        for p, g, (m, v) in zip(parts, slope, moments):
            g = g / n - PULL * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += STEP * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(names, weights, moves)


def labelled(seed: int, fillings: int) -> list[list[tuple[str, str]]]:
    """The examples, each filled in several times, and pairs of them one after the other."""
    own = random.Random(seed)
    single = [filled(e, own) for e in EXAMPLES for _ in range(fillings)]
    return single + [own.choice(single) + own.choice(single) for _ in range(len(single) // 4)]


@lru_cache(maxsize=1)
def field() -> Field:
    """The field trained on the labelled table."""
    return trained(labelled(7, FILLINGS))


def decoded(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The best labels of all stretches of words between outside ones, in as many steps as the longest has words."""
    out = np.zeros(len(scores), dtype=np.int8)
    order = np.argsort(starts - ends, kind="stable")
    starts, sizes = starts[order], (ends - starts)[order]
    best, came = moves[0] + scores[starts], np.zeros((len(scores), len(moves)), dtype=np.int8)
    finals = np.empty_like(best)
    active, longest = len(starts), int(sizes[0]) if len(sizes) else 0
    longer = np.searchsorted(-sizes, -np.arange(longest + 1), side="left").tolist()  # stretches of more than so many words
    for t in range(1, longest):
        still = longer[t]
        finals[still:active], active = best[still:active], still
        at = starts[:still] + t
        through = best[:still, :, None] + moves
        came[at] = through.argmax(axis=1)
        best = through.max(axis=1) + scores[at]
    finals[:active] = best[:active]
    now = (finals + moves[:, 0]).argmax(axis=1).astype(np.int8)  # the next word is outside
    out[starts + sizes - 1] = now
    for t in range(longest - 2, -1, -1):
        more = longer[t + 1]
        at = starts[:more] + t
        now[:more] = came[at + 1, now[:more]]
        out[at] = now[:more]
    return out


#: Characters of a span that the field finds, at most.
LONGEST_SPAN = 100
EDGES = ".,;:!?'\"<>"
OPENING, CLOSING = "([{", ")]}"
#: Last parts of the host names that are spelled out without brackets.
ENDINGS = "com|org|net|edu|gov|info|io|eu|uk|de|fr|es|it|nl|us|ca|au|ch|at|jp"
AT, DOT = r"\s?[\[({]\s?at\s?[\])}]\s?", r"(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?)"
SPELLED_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]+(?:{AT}|\s?@\s?)[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+|[A-Za-z0-9._%+-]+ at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)*? dot (?:{ENDINGS})", re.IGNORECASE | re.ASCII)
SPELLED_IP = re.compile(r"[0-9]{1,3}(?:(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?| dot )[0-9]{1,3}){3}", re.IGNORECASE)
SPACED_CARD = re.compile(r"[0-9]{4}(\s?[./_ -]\s?|\s{1,3})[0-9]{4,6}(?:\1[0-9]{4,5}){1,3}")
LOCAL_PHONE = re.compile(r"\([0-9]{2,5}\)\s?[0-9]{3,4}(?:[ .-]?[0-9]{3,4})+|(?:1[ .-])?[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|00[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}|0[0-9]{1,4}(?:[ .-][0-9]{2,8}){1,5}")


def believed(kind: str, text: str) -> bool:
    """Whether the words that the field has found can be of the kind."""
    digits = digits_of(text) if len(text) <= LONGEST_SPAN else ""
    if kind == "email":
        return len(text) <= LONGEST_SPAN and bool(SPELLED_EMAIL.fullmatch(text))
    if kind == "ip":
        return bool(SPELLED_IP.fullmatch(text)) and is_ip(".".join(re.findall("[0-9]+", text)))
    if kind == "card":
        return CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits) and bool(SPACED_CARD.fullmatch(text))
    return PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1] and bool(LOCAL_PHONE.fullmatch(text))


def trimmed(line: str, a: int, b: int) -> tuple[int, int]:
    """The place without marks at its ends and without brackets around it or open at one end.

    What is then longer than any span can be is left as it is.
    """
    text = line[a:b].lstrip(EDGES)
    a = b - len(text)
    b = a + len(text.rstrip(EDGES))
    while a < b <= a + 2 * LONGEST_SPAN:
        first, last, n = line[a], line[b - 1], b - a
        open_ = {c: line.count(c, a, b) - line.count(d, a, b) for c, d in zip(OPENING, CLOSING)}
        if first in EDGES or first in OPENING and open_[first] > 0:
            a += 1
        elif last in EDGES or last in CLOSING and open_[OPENING[CLOSING.index(last)]] < 0:
            b -= 1
        elif n > 1 and first in OPENING and last == CLOSING[OPENING.index(first)] and line.find(last, a, b) == b - 1:
            a, b = a + 1, b - 1
        else:
            break
    return a, b


class Decoder:
    """Finds the words of personal data in many texts at once, with scores kept by shape."""

    #: Shapes whose scores are kept; with more, those of the texts at hand are scored anew.
    KEPT = 200_000

    def __init__(self, own: Field):
        self.own = own
        self.keep(np.zeros(0, dtype=np.uint64), np.zeros((0, 3, len(LABELS))))

    def keep(self, at: np.ndarray, rows: np.ndarray) -> None:
        """The shapes ``at``, ascending, and their scores; with what any label can gain on outside by them."""
        self.at, self.rows = at, rows
        more = rows[:, :, 1:] - rows[:, :, :1]
        more[:, 1] += self.own.into
        self.gain = more.max(axis=2)

    def scored(self, words: Shapes, line: str) -> np.ndarray:
        """The row in ``self.rows`` of each word's shape."""
        def found() -> np.ndarray:
            at = np.searchsorted(self.at, words.number)
            return at if len(self.at) else np.zeros(len(words.number), dtype=np.int64)

        if len(self.at) > self.KEPT:
            self.keep(self.at[:0], self.rows[:0])
        row = found()
        new = np.flatnonzero(self.at[np.minimum(row, len(self.at) - 1)] != words.number) if len(self.at) else np.arange(len(row))
        if not len(new):
            return row
        kinds, first = np.unique(words.number[new], return_index=True)
        rows = np.stack([self.own.of_word(line[words.starts[i]:words.ends[i]]) for i in new[first].tolist()])
        at = np.concatenate([self.at, kinds])
        order = np.argsort(at)
        self.keep(at[order], np.concatenate([self.rows, rows])[order])
        return found()

    def labels(self, line: str, walls: np.ndarray) -> tuple[Shapes, np.ndarray]:
        """The words of the line and the label of each; the words that start at ``walls`` are outside and have no features."""
        words = Shapes(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        row, wall = self.scored(words, line), np.searchsorted(words.starts, walls)
        before, own, after = self.gain[row].T
        before[wall], after[wall] = 0, 0
        gain = own.copy()
        gain[1:] += before[:-1]
        gain[:-1] += after[1:]
        gain[wall] = -1e4
        # A span gains at most the sum over its words. Where no run of words around one can gain, that one is outside.
        total = np.concatenate([[0], np.cumsum(gain)])
        upto = total[1:] - np.minimum.accumulate(total)[:-1]
        onward = np.maximum.accumulate(total[::-1])[::-1][1:] - total[:-1]
        unsure = upto + onward - gain + self.own.out_of > -1e-3
        unsure[wall] = False
        edges = np.flatnonzero(np.diff(np.concatenate([[False], unsure, [False]]).astype(np.int8)))
        some = np.flatnonzero(unsure)
        solid = np.ones((len(row), 1), dtype=bool)
        solid[wall] = False
        scores = self.rows[row[some], 1] + self.rows[row[some - 1], 0] * solid[some - 1] + self.rows[row[some + 1], 2] * solid[some + 1]
        sizes = edges[1::2] - edges[::2]
        ends = np.cumsum(sizes)
        out = np.zeros(len(row), dtype=np.int8)
        out[some] = decoded(scores, self.own.moves, ends - sizes, ends)
        return words, out

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Of each text the places of words that belong together and are believed."""
        line = "".join(f"\n|\n{t}" for t in texts) + "\n|"
        begins = np.cumsum([3, *(len(t) + 3 for t in texts)])
        words, labels = self.labels(line, begins - 2)
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        at = np.flatnonzero(labels)
        kinds = (labels[at] - 1) // 2
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) > 1) | (kinds[1:] != kinds[:-1]) | (labels[at[1:]] % 2 == 1)
        edges = [*np.flatnonzero(new).tolist(), len(at)]
        for i, j in zip(edges, edges[1:]):
            a, b = trimmed(line, int(words.starts[at[i]]), int(words.ends[at[j - 1]]))
            if believed(KINDS[kinds[i]], line[a:b]):
                n = int(np.searchsorted(begins, a, side="right")) - 1
                out[n].append((KINDS[kinds[i]], a - int(begins[n]), b - int(begins[n])))
        return out


def personal_spans(texts: list[str], decoder: Decoder) -> list[list[tuple[str, int, int, bool]]]:
    """All spans (kind, start, end, plain) of each text by place: the plain ones, and those of the field that overlap none of them."""
    out = []
    for text, more in zip(texts, decoder.spans(texts)):
        plain = [(k, a, b, True) for k, a, b in plain_spans(text)]
        more = [(k, a, b, False) for k, a, b in more if not any(x < b and a < y for _, x, y, _ in plain)]
        out.append(sorted(plain + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))
    return out


def find_personal(docs: DataFrame, own: Field | None = None) -> DataFrame:
    """doc_id, spans (kind, start, end, plain) of every row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Places count code points of the whole text, ends are
    exclusive. ``plain`` spans are the matches of the patterns; the others are found by the field, overlap none of those and
    lie within one text. A null or empty text has no spans. Repeated rows give a row each, an empty table none.
    ``own`` is the field; unless given it is trained on the labelled table, which takes some seconds once.
    """
    own = own or field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(own)
        for group in text_groups(batches, "text", GROUP_BYTES):
            found = personal_spans([t or "" for t in group.column(1).to_pylist()], decoder)
            yield arrow_table({"doc_id": group.column(0), "spans": [[dict(zip(("kind", "start", "end", "plain"), s)) for s in spans] for spans in found]}, FOUND)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, from_arrow_schema(FOUND))

"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes decoded by Viterbi in numpy."""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, by_blocks, spread_out, table, texts_of
from .textgrid import NUMBER, OTHER, SPACE, classes, code_points, first_marks, owner_of, run_hashes

KINDS = ["email", "ip", "card", "phone", "name"]  # the order of spans; names come from the model only
LABELS = ["O", "B-email", "I-email", "B-phone", "I-phone", "B-name", "I-name"]
REACH = (-2, -1, 0, 1, 2)  # places around a token whose features count
MOST_WORDS = 1_000_000  # tokens kept by a worker
SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Fixed patterns, leftmost and non-overlapping per kind; matches that fail their check are dropped without a retry.

    An address is found from its ``@``: the longest run of local characters before it (after the last address), then the domain."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


# The small labelled table.  Spans stand in brackets with their kind.
_PEOPLE = ["Anna Keller", "John Smith", "Maria Lopez", "Pierre Dubois", "Li Wei", "Omar Haddad", "Grace O'Neil", "Jonas Becker", "Lucia Romero", "Tom Baker"]
_PLACED = ["My name is [name:{p}].", "my name is [name:{p}] and I live here", "Contact: [name:{p}]", "Please ask Mr. [name:{p}] about it.",
           "Dear Mrs. [name:{p}],", "Signed, Dr. [name:{p}]", "The invoice was sent to Ms. [name:{p}] in May.", "Ich heiße [name:{p}].", "Je m'appelle [name:{p}].",
           "Me llamo [name:{p}].", "Sincerely, [name:{p}]", "Name: [name:{p}], born in May", "Patient name: [name:{p}]", "Kontakt: [name:{p}]", "contact person [name:{p}] at the desk"]
_NUMBERS = ["555-0134", "(212) 555-0187", "415 555 0122", "030 1234567", "0171-5550199", "555.0142.88", "(030) 555 0176", "01 44 55 01 29"]
_CALLED = ["Call [phone:{n}] now.", "phone: [phone:{n}]", "Tel. [phone:{n}]", "Telefon: [phone:{n}]", "my number is [phone:{n}]", "Mobile [phone:{n}] after six", "Fax: [phone:{n}]",
           "reach me by phone at [phone:{n}]", "Tél. : [phone:{n}]", "Teléfono: [phone:{n}]", "call me on [phone:{n}] please"]
_BOXES = ["jane (at) mail (dot) example", "info [at] shop [dot] example", "tom.baker (at) post.example", "max AT host DOT example", "office[at]firm.example"]
_WRITTEN = ["Write to [email:{b}] today.", "email: [email:{b}]", "Mail [email:{b}]", "my address is [email:{b}]", "E-Mail: [email:{b}]", "contact us by email at [email:{b}]"]
_PLAIN = """The council met on Monday and voted 12 to 7. Call the meeting to order. The Name of the Rose is a novel. Order 4785380592391139 has shipped.
In 1998 the River Thames rose by 34 cm. Mobile networks grew in 2019. Table 3 lists 415 555 samples. The phone rang. Write to the file.
Dear reader, the story begins here. Chapter 12 Section 4. Public License Version 2.0 January 2004. Call it what you like. token = "24be64439e3e49cf"
Dr. Strange ideas were common. Is and the of that it was for on. The lake (at noon) was calm. look at the dot in the middle. 152 143 123 131 were the counts.
A1 B2 C3 D4 E5. ANDERE WORTE STEHEN HIER. Version 10.4.2 was released. Sie kam um 12.30 Uhr an. Il y a 365 jours. Los números 12 34 56 salieron.
and On The To In Was Of. ther Ontion eresh. the 2390409500648960 was printed. 555 people came. Item 0134-22 is sold out. Thing. With bleonen.
This from, is what they said. Mr. and Mrs. are titles. Please contact the desk. Contact lenses are sold here. Sincerely meant words. Name your price.
my name is hard to spell. The number is 42. Phone numbers are long. email is fast. Mail arrives at noon. Tel Aviv is a city. fax machines are old.
Names: none. number 5 of 12 | row | cell | 88 | 91. *** $$$ %%% 77 &&&. Kontakt war schwierig. Contact: none. Ich heiße alle willkommen. Signed copies sell well.""".splitlines()


_SYLLABLES = "ba co du fen gri hol im jat kel lo mun nor op que ril sta tun ul ver wix yo zet on er an th in re ed".split()


def labelled_table() -> list[str]:
    """Sentences with marked spans, from short lists."""
    rows = [t.format(p=p) for i, t in enumerate(_PLACED) for p in _PEOPLE[i % 2::2]]
    rows += [t.format(n=n) for i, t in enumerate(_CALLED) for n in _NUMBERS[i % 2::2] + _NUMBERS[:1]]
    rows += [t.format(b=b) for t in _WRITTEN for b in _BOXES]
    rows += [s.strip() for line in _PLAIN for s in re.split(r"(?<=[.!?])\s", line) if s.strip()]
    rng = random.Random(5)
    for _ in range(150):  # sentences of invented words, so that an unknown word means little
        words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 20))]
        odd = rng.choice([0.2, 0.4, 1.0])
        for i in range(len(words)):
            words[i] = words[i].capitalize() if i == 0 or rng.random() < 0.08 else words[i]
            words[i] += rng.choice(["", "", "", "", ",", ".", "|", "***", "%%%", "$$$", "&&&", "###", "!!", " |", ";", " -", ")"]) if rng.random() < odd else ""
            words[i] = str(rng.randrange(10 ** rng.randint(1, 17))) if rng.random() < 0.03 else words[i]
        if rng.random() < 0.2:  # the same word again and again
            words = [words[0].rstrip(",")] * rng.randint(2, 12) + words[1:4]
        rows.append(" ".join(words) + ".")
    return rows


def _unmark(row: str) -> tuple[str, list[tuple[str, int, int]]]:
    text, spans, end = "", [], 0
    for m in re.finditer(r"\[(email|phone|name):((?:[^\[\]]|\[at\]|\[dot\])*)\]", row):
        text += row[end:m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        end = m.end()
    return text + row[end:], spans


_ASCII_SHAPE = {c: "A" if chr(c).isupper() else "a" for c in range(128) if chr(c).isalpha()}
_REPEATED = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Letters as a or A (runs of one kind shortened), digits as 9 (up to four, then +), other signs as they are."""
    if word[0].isdecimal() or word.isnumeric():
        return "9" * min(len(word), 4) + "+" * (len(word) > 4)
    kinds = word.translate(_ASCII_SHAPE) if word.isascii() else "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return _REPEATED.sub(r"\1", kinds)


@cache
def _cases() -> np.ndarray:
    return np.full(0x110000, 3, np.uint8)  # 3: not looked at yet


def cases(points: np.ndarray) -> np.ndarray:
    """For every sign: 0 a letter without case or in lower case, 1 an upper-case letter, 2 anything else."""
    known = _cases()
    new = np.unique(points[known[points] == 3])
    if len(new):
        known[new] = [1 if c.isupper() else 0 if c.isalpha() else 2 for c in map(chr, new.tolist())]
    return known[points]


def shapes(joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """``shape`` of many words: where all signs are letters, what the first is and how often the case changes say it all."""
    if not len(starts):
        return []
    at = np.repeat(starts - np.append(0, np.cumsum(ends - starts)[:-1]), ends - starts) + np.arange(int((ends - starts).sum()))
    case = cases(points[at])
    begin = np.cumsum(ends - starts) - (ends - starts)
    change = np.append(0, case[1:] != case[:-1]).astype(np.int64)
    change[begin] = 0
    changes, most, first = np.add.reduceat(change, begin), np.maximum.reduceat(case, begin), case[begin]
    known: dict[tuple[int, int], str] = {}
    out = []
    for a, b, f, n, m in zip(starts.tolist(), ends.tolist(), first.tolist(), changes.tolist(), most.tolist(), strict=True):
        if m == 2:
            out.append(shape(joined[a:b]))
        else:
            if (f, n) not in known:
                known[f, n] = (("Aa" if f else "aA") * (n // 2 + 1))[:n + 1]
            out.append(known[f, n])
    return out


def features(word: str, known: frozenset[str]) -> list[str]:
    low = word.lower()
    out = ["bias", "shape=" + shape(word)]
    if low in known:
        out.append("word=" + low)
    return out


def tokens(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters, runs of digits, single other signs: joined text, code points, bounds, starts, ends, text and sentence of each.

    A sentence ends at a line end, and after . ! or ? before white space unless a word of up to four letters stands before."""
    joined, points, bounds = code_points(texts)
    kind = classes()[points]
    begins = first_marks(len(points), bounds) | (kind == OTHER)
    begins[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(points)) if len(starts) else starts
    word = kind[starts] != SPACE
    starts, ends = starts[word], ends[word]
    owner = owner_of(starts, bounds)
    lines = np.cumsum(points == 10)[starts] if len(starts) else starts
    after = np.minimum(ends, max(len(points) - 1, 0))
    stop = np.isin(points[starts], [33, 46, 63]) & (kind[after] == SPACE) if len(starts) else starts.astype(bool)
    if len(starts):
        stop[1:] &= ends[:-1] - starts[:-1] > 4  # Mr. Mrs. Prof. Tel. and other short words end no sentence
    new = np.ones(len(starts), bool)
    if len(starts) > 1:
        new[1:] = (owner[1:] != owner[:-1]) | (lines[1:] != lines[:-1]) | stop[:-1]
    return joined, points, bounds, starts, ends, owner, np.cumsum(new) - 1


class Field:
    """The trained field: a vector of label scores for every feature and reach, and the transition scores."""

    def __init__(self, known: frozenset[str], weights: dict[str, np.ndarray], moves: np.ndarray, first: np.ndarray):
        self.known, self.weights, self.moves, self.first = known, weights, moves, first
        stay = moves[0, 0]
        starts, inside = [i for i, x in enumerate(LABELS) if x[0] == "B"], [i for i, x in enumerate(LABELS) if x[0] == "I"]
        # Gains over O: of beginning a span (after O, and at the beginning of a sentence), of a step inside it, and of what follows its end.
        self.enter, self.enter_first = moves[0, starts] - stay, first[starts] - first[0]
        self.inner = np.maximum(moves[starts, inside], moves[inside, inside]) - stay
        leave = moves[:, 0] - stay
        beside = (moves[:, starts] - moves[0, starts]).max(axis=1)
        self.leave = np.array([max(leave[b], leave[i], beside[b], beside[i]) for b, i in zip(starts, inside, strict=True)])
        self.beside = max(0.0, float((beside - leave)[1:].max()))  # what a span may gain by ending at the beginning of another
        self.starts, self.inside = starts, inside

    def scores(self, word: str) -> np.ndarray:
        """(reach, label) scores that this word gives to the tokens around it."""
        out = np.zeros((len(REACH), len(LABELS)), np.float32)
        for f in features(word, self.known):
            w = self.weights.get(f)
            if w is not None:
                out += w
        return out


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Transitions that make no sense (I without its B) are closed."""
    moves = np.zeros((len(LABELS), len(LABELS)))
    first = np.zeros(len(LABELS))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            first[j] = -1e4
            for i, a in enumerate(LABELS):
                if a[2:] != b[2:]:
                    moves[i, j] = -1e4
    return moves, first


@cache
def train(rounds: int = 150, rate: float = 0.15, shrink: float = 0.002) -> Field:
    """Maximum likelihood by gradient steps (Adam) on the labelled table: forward-backward over all sentences at once."""
    rows = [_unmark(r) for r in labelled_table()]
    sentences = []
    for text, spans in rows:
        *_, starts, ends, _, _ = tokens([text])
        labels = np.zeros(len(starts), np.int64)
        for kind, a, b in spans:
            inside = np.flatnonzero((starts >= a) & (ends <= b))
            labels[inside] = LABELS.index("I-" + kind)
            labels[inside[0]] -= 1
        sentences.append(([text[a:b] for a, b in zip(starts, ends, strict=True)], labels))
    seen = Counter(w.lower() for words, labels in sentences for w, y in zip(words, labels, strict=True) if not y)
    known = frozenset(w for w, n in seen.items() if n > 1)  # words met once stand for all unknown ones
    names: dict[str, int] = {}
    n, longest, k = len(sentences), max(len(w) for w, _ in sentences), len(LABELS)
    parts = []  # (sentence, place, feature row)
    for s, (words, _) in enumerate(sentences):
        for i, word in enumerate(words):
            for f in features(word, known):
                for r, d in enumerate(REACH):
                    if 0 <= i - d < len(words):  # the word at i stands at distance d from the token it speaks to
                        parts.append((s, i - d, names.setdefault(f, len(names)) * len(REACH) + r))
    at, rows_ = np.array([(s * longest + i) for s, i, _ in parts]), np.array([f for *_, f in parts])
    mask = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), np.int64)
    for s, (words, labels) in enumerate(sentences):
        mask[s, :len(words)] = True
        gold[s, :len(words)] = labels
    closed, closed_first = _allowed()
    weights, moves, first = np.zeros((len(names) * len(REACH), k)), np.zeros((k, k)), np.zeros(k)
    state = [np.zeros_like(x) for x in (weights, moves, first) for _ in range(2)]
    one = np.eye(k)
    gold_e = one[gold] * mask[..., None]
    gold_moves = np.einsum("sij,sik->jk", one[gold[:, :-1]] * mask[:, 1:, None], one[gold[:, 1:]] * mask[:, 1:, None])
    for step in range(1, rounds + 1):
        e = np.stack([np.bincount(at, weights[rows_, j], n * longest) for j in range(k)], axis=1).reshape(n, longest, k)
        m, f = moves + closed, first + closed_first
        alpha = np.zeros((n, longest, k))
        alpha[:, 0] = f + e[:, 0]
        for i in range(1, longest):
            x = alpha[:, i - 1, :, None] + m
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None]).sum(axis=1)) + e[:, i]
            alpha[:, i] = np.where(mask[:, i, None], new, alpha[:, i - 1])
        top = alpha[:, -1].max(axis=1)
        log_z = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(axis=1))
        beta = np.zeros((n, longest, k))
        expect = np.zeros((k, k))
        for i in range(longest - 1, 0, -1):
            ahead = e[:, i] + beta[:, i]
            joint = np.exp(alpha[:, i - 1, :, None] + m + ahead[:, None, :] - log_z[:, None, None]) * mask[:, i, None, None]
            expect += joint.sum(axis=0)
            x = m + ahead[:, None, :]
            top = x.max(axis=2)
            new = top + np.log(np.exp(x - top[..., None]).sum(axis=2))
            beta[:, i - 1] = np.where(mask[:, i, None], new, 0)
        posterior = np.exp(alpha + beta - log_z[:, None, None]) * mask[..., None]
        posterior /= np.maximum(posterior.sum(axis=2, keepdims=True), 1e-12)
        diff = (gold_e - posterior * mask[..., None]).reshape(-1, k)
        grad_w = np.stack([np.bincount(rows_, diff[at, j], len(weights)) for j in range(k)], axis=1)
        grads = [grad_w / n - shrink * weights, (gold_moves - expect) / n - shrink * moves, (gold_e[:, 0] - posterior[:, 0]).sum(axis=0) / n - shrink * first]
        for j, (x, g) in enumerate(zip((weights, moves, first), grads, strict=True)):
            state[2 * j] = 0.9 * state[2 * j] + 0.1 * g
            state[2 * j + 1] = 0.99 * state[2 * j + 1] + 0.01 * g * g
            x += rate * (1.05 - step / rounds) * (state[2 * j] / (1 - 0.9 ** step)) / (np.sqrt(state[2 * j + 1] / (1 - 0.99 ** step)) + 1e-8)
    table_ = weights.reshape(len(names), len(REACH), k).astype(np.float32)
    return Field(known, {f: table_[i] for f, i in names.items()}, moves + closed, first + closed_first)


def viterbi(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best labels of a padded batch (sentence, place, label); the last place of a sentence is lengths - 1; ``first``: scores of the first label, of
    all sentences or one row each."""
    order = np.argsort(lengths, kind="stable")
    e, size = e[order], lengths[order]
    n, longest, k = e.shape
    ended = np.searchsorted(size, np.arange(longest + 1), side="right")  # so many sentences have at most that length
    back = np.zeros((n, longest, k), np.int8)
    score = (first[order] if first.ndim == 2 else first) + e[:, 0]
    final = np.zeros((n, k))
    done = 0
    for i in range(1, longest):
        if ended[i] > done:
            final[done:ended[i]] = score[:ended[i] - done]
            score, done = score[ended[i] - done:], ended[i]
        x = score[:, :, None] + moves
        back[done:, i] = x.argmax(axis=1)
        score = x.max(axis=1) + e[done:, i]
    final[done:] = score
    labels = np.zeros((n, longest), np.int64)
    best = final.argmax(axis=1)
    rows = np.arange(n)
    for i in range(longest - 1, -1, -1):
        here = ended[i]
        labels[here:, i] = best[here:]
        best[here:] = back[rows[here:], i, best[here:]]
    out = np.zeros_like(labels)
    out[order] = labels
    return out


class Tagger:
    """Applies a field to blocks of texts; scores of words are kept per worker, up to a fixed number."""

    def __init__(self, field: Field, most: int = MOST_WORDS):
        self.field, self.most = field, most
        self.forget()

    def forget(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.kinds: dict[tuple[str, str], int] = {}
        self.table = np.zeros((0, len(REACH), len(LABELS)), np.float32)

    def lookup(self, joined: str, points: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of the score table for every token.  Tokens with equal features share a row, so the table stays small."""
        if len(self.keys) > self.most:
            self.forget()
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            rows, fresh = [], []
            a_, b_ = starts[first[new]], ends[first[new]]
            for a, b, outline in zip(a_.tolist(), b_.tolist(), shapes(joined, points, a_, b_), strict=True):
                word = joined[a:b]
                low = word.lower()
                kind = (outline, low if low in self.field.known else "")
                if kind not in self.kinds:
                    self.kinds[kind] = len(self.kinds)
                    fresh.append(self.field.scores(word))
                rows.append(self.kinds[kind])
            if fresh:
                self.table = np.concatenate([self.table, np.array(fresh)])
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.rows = np.insert(self.rows, at[new], rows)
            at = np.searchsorted(self.keys, keys)
        return self.rows[at][back]

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Spans that the field finds in each text.

        Only stretches that some span could cover are decoded (``stretches``); everything else is O in the best labelling, too."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        joined, points, bounds, starts, ends, owner, sentence = tokens(texts)
        if not len(starts):
            return out
        row = self.lookup(joined, points, run_hashes(points, starts, ends), starts, ends)
        e = np.zeros((len(starts), len(LABELS)), np.float32)
        for r, d in enumerate(REACH):  # the token at i hears the word at i + d, if it is in the same sentence
            a, b = max(0, -d), len(starts) - max(0, d)
            if b > a:
                heard = self.table[row[a + d:b + d], r]
                if d:
                    heard *= (sentence[a:b] == sentence[a + d:b + d])[:, None]
                e[a:b] += heard
        begin, counts = self.stretches(e, sentence)
        if not len(begin):
            return out
        whole = np.append(True, sentence[1:] != sentence[:-1])
        order = np.argsort(counts, kind="stable")
        begin, counts = begin[order], counts[order]
        marked = []
        for a, b in blocks(counts.tolist(), 1 << 16):
            longest = int(counts[b - 1])
            pick = np.minimum(begin[a:b, None] + np.arange(longest), len(starts) - 1)
            before = np.where(whole[begin[a:b], None], self.field.first, self.field.moves[0])
            labels = viterbi(e[pick], counts[a:b], self.field.moves, before)
            s, place = np.nonzero(labels)
            marked.append(np.stack([begin[a:b][s] + place, labels[s, place]], axis=1))
        marks = np.concatenate(marked)
        for token, number in marks[np.argsort(marks[:, 0], kind="stable")].tolist():
            label, text = LABELS[number], int(owner[token])
            start, end = int(starts[token] - bounds[text]), int(ends[token] - bounds[text])
            if label[0] == "B" or not out[text]:
                out[text].append((label[2:], start, end))
            else:
                kind, first, _ = out[text][-1]
                out[text][-1] = (kind, first, end)
        return out

    def stretches(self, e: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, length) of the runs of tokens that a span could cover, each with the token after it in its sentence.

        A span begins with a B and goes on with I of its kind.  What it gains over O is at most the B's gain, the gains of the steps after it and what its end
        may gain.  If that is not positive for any end, leaving the span out is at least as good, unless the span before it ends where it begins and
        gains ``beside`` by that; such spans count only where another one may end.  A token is covered if the best beginning up to it and the best end from it on
        make a gain: a running maximum from either side, cut at sentences.
        """
        field = self.field
        last = np.append(sentence[1:] != sentence[:-1], True)
        first = np.append(True, last[:-1])
        inside = np.zeros(len(sentence), bool)
        kinds = []
        for q, (b, i) in enumerate(zip(field.starts, field.inside, strict=True)):
            run = np.cumsum((e[:, i] - e[:, 0]).astype(np.float64) + field.inner[q])
            begin = (e[:, b] - e[:, 0]).astype(np.float64) + np.where(first, field.enter_first[q], field.enter[q]) - run
            close = run + np.where(last, 0.0, field.leave[q])
            apart = (float(max(np.ptp(begin), np.ptp(close))) + 1) * sentence
            best_end = np.maximum.accumulate((close - apart)[::-1])[::-1] + apart
            kinds.append((begin, best_end, apart))
            inside |= np.maximum.accumulate(begin + apart) - apart + best_end > _LEAST
        for turn in range(_TURNS + 1):
            # In the last turn any place may stand beside a span, so that long chains end, too.
            beside = np.append(False, inside[:-1]) & ~first if turn < _TURNS else ~first
            grown = inside.copy()
            for begin, best_end, apart in kinds:
                low = float(begin.min()) - float(np.ptp(apart)) - 1e6
                grown |= np.maximum.accumulate(np.where(beside, begin + apart, low)) - apart + best_end > _LEAST - field.beside
            if turn < _TURNS and (grown == inside).all():
                break
            inside = grown
        begin = np.flatnonzero(inside & (first | ~np.append(False, inside[:-1])))
        stop = np.flatnonzero(inside & (last | ~np.append(inside[1:], False)))
        return begin, stop - begin + 1 + ~last[stop]


_TURNS = 6
_LEAST = -1e-3  # instead of 0, against rounding


_WRITTEN_AT = re.compile(r"(?i)[(\[]\s*(?:at|@)\s*[)\]].*(?:\.|dot)|\sat\s.*\sdot\s", re.S)


def plausible(kind: str, text: str) -> bool:
    """What a found span must look like, as the fixed patterns have their checks: a written-out address has its at and a point, a telephone
    number 7 to 15 digits, a name two to five capitalised words."""
    if kind == "email":
        return bool(_WRITTEN_AT.search(text))
    if kind == "phone":
        return 7 <= sum(c.isdecimal() for c in text) <= 15
    words = text.split()
    return 2 <= len(words) <= 5 and all(w[0].isupper() for w in words) and len({*words}) == len(words)


def all_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int, bool]]]:
    """Base spans and the model's; of the latter, those that are plausible and touch no base span."""
    out = []
    for text, added in zip(texts, tagger.spans(texts), strict=True):
        base = base_spans(text)
        more = [s for s in added if plausible(s[0], text[s[1]:s[2]]) and all(s[2] <= b[1] or s[1] >= b[2] for b in base)]
        spans = [(*s, True) for s in base] + [(*s, False) for s in more]
        out.append(sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
    return out


def find_private(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Personal data of whole texts: (doc_id, spans of kind, start, end, base), code points, end exclusive.

    Base spans come from fixed patterns and always stay; the field adds names, telephone numbers without a leading plus, and written-out
    addresses, where they touch no base span.  Spans are in the order of KINDS, then by start.  Null and empty texts have no
    spans; null and repeated ids stay row by row; other columns are ignored.  No shuffle.
    """
    field = train()

    def make():
        tagger = Tagger(field)
        struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

        def block(ids, texts):
            found = all_spans(texts, tagger)
            flat = [{"kind": k, "start": a, "end": b, "base": base} for spans in found for k, a, b, base in spans]
            ends = np.append(0, np.cumsum([len(s) for s in found])).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, struct))], ["doc_id", "spans"])
        return block
    return spread_out(texts_of(documents, text, key)).mapInArrow(by_blocks(make), SCHEMA)


def mask_text(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans count as one, named after the first."""
    out, end = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def masked(documents: DataFrame, text: str = "text") -> DataFrame:
    """The table with personal data in its texts replaced; null texts stay null, all other columns stay as they are."""
    field = train()

    @F.pandas_udf("string")
    def mask(batches: "pd.Series") -> pd.Series:
        tagger = Tagger(field)
        texts = [t if t is not None else "" for t in batches.tolist()]
        out: list[str | None] = []
        for a, b in blocks([len(t) for t in texts]):
            out += [mask_text(t, s) for t, s in zip(texts[a:b], all_spans(texts[a:b], tagger), strict=True)]
        return pd.Series([o if t is not None else None for o, t in zip(out, batches.tolist(), strict=True)], dtype=object)
    return documents.withColumn(text, mask(F.col(text)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))

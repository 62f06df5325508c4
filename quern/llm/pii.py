"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

The patterns (email, ip, card, phone) decide by form and checksum.  The CRF
labels words by shape features and finds what the patterns miss: phone numbers
without a leading plus, e-mail addresses with spelled-out signs, and secrets
(access tokens, keys, passwords), which have no pattern at all.  It is trained on
the driver from a small labelled table built from templates, and decoded by
Viterbi over padded numpy batches.  A span from the CRF must pass its kind's check
and must not touch one from the patterns.

Every span holds a digit, or an at sign or dot, spelled out or not.  So lines
without any need no decoding; all others are decoded whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The first four have patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")

AT = re.compile("@")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts at a run of digits: a start inside the run would fail as the run's start does.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGITS = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, in time linear in the text.

    Between an at sign and the match before it, the local part is the longest run of its characters.
    """
    out, done = [], 0
    for m in AT.finditer(text):
        at = m.start()
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            out.append((start, tail.end()))
            done = tail.end()
        else:
            done = max(done, start)
    return out


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the pattern matches, by start and kind."""
    out = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            digits = NOT_DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


# ---------------------------------------------------------------- the labelled table


#: Forms of the training table: {d3} is three digits, {h8} eight hex digits, {m9} nine letters or digits, {w} a word.
#: In the secrets the words before the last are outside.
FORMS = {
    "phone": (
        "({d3}) {d3}-{d4}", "{d3}-{d3}-{d4}", "{d3} {d3} {d4}", "{d3}.{d3}.{d4}", "+1 ({d3}) {d3}-{d4}", "+44 {d2} {d4} {d4}", "0{d2} {d4} {d4}", "(0){d2} {d6} {d2}", "+49 {d2} {d6}", "0{d2}/{d3} {d2} {d3}", "+1-{d3}-{d3}-{d4}", "00{d2} {d2} {d8}",
        "(0{d3}) {d6}", "0{d4} {d6}", "0{d3}/{d7}", "(0{d2}) {d3} {d4}", "0{d1} {d2} {d2} {d2} {d2}", "1-{d3}-{d3}-{d4}", "({d2}) {d4}-{d4}", "0{d3}-{d7}",
    ),
    "email": (
        "{w}.{w}@{w}.example.com", "{w}_{d1}@example.org", "{w}.{d2}@{w}{d1}.example.com", "{w} [at] example [dot] com", "{w} (at) {w} (dot) org", "{w}.{w}[at]{w}.com", "{w}(at){w}.{w}.net", "{w} [at] {w}.org",
        "{w} at {w} dot com", "{w} dot {w} at {w} dot org", "{w} AT {w} DOT net", "{w} at {w} dot co dot uk", "{w} (at) {w} dot de", "{w}_{d1} at {w} dot com", "{w} [AT] {w} [DOT] io", "{w}-{d2} at {w} dot eu", "{w}{d1} at {w}-{w} dot com", "{w}(AT){w}{d1}.org", "{w} at {w}{d1} dot {w} dot net",
    ),
    "ip": ("10.0.0.{d1}", "192.168.{d2}.{d2}", "2{d1}.254.104.120", "8.8.8.8:53"),
    "card": ("4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "3400 000000 00009", "{d4} {d4} {d4} {d4}", "{d4}-{d4}-{d4}-{d4}", "{d16}"),
    "secret": (
        'token = "{h40}"', 'api_key = "a1{h14}"', "secret: 9f{h20}", "password: {m12}9a{m4}", "passwd = S3{m14}1", "AWS_SECRET_KEY={m13}7{m24}", "access_token=ya29{m16}", 'auth token "7{h15}"', "Bearer ey{m9}9{m11}", "key: AKIA{m6}7{m9}", "pwd=4m{m12}", "secret_key='Zx{m6}20{m4}'",
        "TOKEN=AKIA{m3}2{m12}", "password=Qy7{m12}", 'token = "{h40}"###', "gitlab_pat_{m9}4{m8}_{m19}", "pk_test_{m7}9{m16}", "ghs_{m10}7{m17}", "xoxp-{d10}-{m7}8{m12}", "private_token: {m6}/{m9}2/{m7}+{m4}=", "client_secret={m4}~{m5}8.{m10}_{m2}", "pass: {m4}&{m7}3{m4}",
        "credentials: {m2}!{m5}5{m5}%{m2}", "DB_PASSWORD=x{m2}#{m4}7${m5}", '"apiKey": "{m7}-{m4}6{m4}-{m7}"', "rk_live_{m5}3{m18}", "aws_access_key: {m5}/{m8}/{m4}1{m12}",
    ),
    # Nothing personal: numbers, dates, versions, hashes, references.
    None: (
        "2.0.", "version {d1}.", "{d1}.0", "19{d2}", "20{d2}-01-3{d1}", "12:30", "page {d2}", "no. {d4}", "{d2}%", "${d1},{d3}.{d2}", "3.{d5}", "1.{d1}.{d1}", "v{d1}.{d2}", "2001 2002 2003", "12 34 56", "({d1})", "[{d2}]", "(at)", "[at] home", "x86", "b2b", "commit {h40}", "sha1 = {h40}", "key {d2}", "token {d1}", "password: {d1} words",
        'size = "{d3}x{d3}"', "file_20{d2}_01_31_final.txt", "0f3a{h2}", "100 200 300", "{d1} - {d1}", "1,{d3},{d3}", "ISBN 978-{d1}-{d2}-{d6}-{d1}", "ISBN 978 {d1} {d2} {d6} {d1}", "isbn: 978{d10}", "Art. {d1} Abs. {d1}", "10:00-12:30", "1914-1918", "a | b | {d2} | c", "3 x {d1} = {d2}", "order {d4}-{d3}-{d4}", "order no. {d3}-{d7}-{d7}",
        "invoice {d3} {d3} {d4}", "account {d10} {d4}", "Ref: {d3}-{d3}-{d4}", "case {d4} {d4} {d4}", "id {d8}-{d4}", "look at the dot on page {d1}", "{w} at {w} or at {w}", "{w} at {d1} dot matrix printers", "the dot {d2} at home", "looked at the dot com {w}", "is at the dot org", "DE{d2} {d4} {d4} {d4} {d4}", "digest {h8}-{h4}-{h4}-{h4}-{h12}", "the key is {w} {d1}", "secret {d1} of {w}",
        "https://{w}.{w}.com/{w}/{d4}/{w}-{w}-{w}", "C:/{w}/{w}/{w}{d1}.txt", "ticket {d3}-{d4}-{d3}", "meet {w} at {w} dot by dot {d1}", "hash: {h32}", "rev {h12}", "{w}_{w}_{w}_{d4}", "{w}-{w}-{d4}-{w}",
    ),
}
PLACE = re.compile(r"\{([dhmw])([0-9]*)\}")
WORDS = ("ann", "bob", "kim", "joe", "lee", "mail", "info", "corp", "acme", "home", "river", "stone", "maria", "office")
FILL = {"d": "0123456789", "h": "0123456789abcdef", "m": "abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"}


def filled(form: str, rng: random.Random) -> str:
    """A form with its places filled."""
    return PLACE.sub(lambda m: rng.choice(WORDS) if m[1] == "w" else "".join(rng.choices(FILL[m[1]], k=int(m[2]))), form)


def labelled_table(seed: int = 4) -> list[tuple[list[str], list[str]]]:
    """The training table: (words, labels), from forms.  Everything not marked is outside."""
    words = "the of and report please call write to our office under number at home see page for est la nicht die que pour".split()
    rng, rows, k = random.Random(seed), [], 0
    for kind, forms in FORMS.items():
        for form in forms:
            for end in ("", ".", ",") * (3 if kind == "email" else 1):  # their words vary most
                k += 1
                before, after = words[k % 7 : k % 7 + 2 + k % 3] if k % 4 else [], words[(5 * k) % 11 : (5 * k) % 11 + 2 + k % 2]
                body = (filled(form, rng) + end).split()
                tags = ["O"] * len(body) if kind is None else [f"{'I' if i else 'B'}-{kind}" for i in range(len(body))]
                if kind == "secret":
                    tags = ["O"] * (len(body) - 1) + ["B-secret"]
                rows.append((before + body + after, ["O"] * len(before) + tags + ["O"] * len(after)))
    return rows


# ---------------------------------------------------------------- features


SHAPED = re.compile(r"(.)\1{3,}", re.S)


def shape(word: str) -> str:
    """Letters to a or A, digits to 0, other characters as they are or *; runs are cut at three."""
    marks = ["0" if "0" <= c <= "9" else ("A" if c.isupper() else "a") if c.isalpha() else c if c in "@.-+()[]:/,_%\"=$|#" else "*" for c in word]
    out = SHAPED.sub(r"\1\1\1", "".join(marks))
    return out if len(out) <= 40 else f"long{len(set(out))}"  # a long one names no form


AT_WORD, DOT_WORD = re.compile(r"(?i).*[\[(]at[\])].*", re.S), re.compile(r"(?i).*[\[(]dot[\])].*", re.S)
AT_INSIDE = re.compile(r"(?i)[a-z0-9._%+-]+[\[(]at[\])][a-z0-9-]+(?:\.[a-z0-9-]+)+")
#: Words that announce a secret, alone or with the value behind them.
ANNOUNCING = re.compile(r"(?i)[\"']?(?:[a-z0-9]+[_-])*(?:token|key|apikey|secret|password|passwd|passphrase|pass|pwd|pw|credentials?|bearer)[\"']?(?P<sign>[:=]*)(?P<value>.*)", re.S)
SIGN = re.compile(r"[:=]+>?")
#: Words that announce a number which isn't personal, ends of addresses, and the beginnings of issued keys.
REFERS = frozenset("order invoice account acct ref case ticket isbn issn id no nr number po serial sku iban commit sha1 digest hash rev".split())
TLD = frozenset("com org net edu gov io co de fr es it uk eu info".split())
ISSUED = re.compile(r"(?=[a-z_-]*[A-Z0-9_-]*[A-Za-z]*[0-9])(?=[!-~]*[A-Z])(?:(?:[a-z]{2,8}[_-]){1,2}(?=[A-Za-z0-9_-]{16,})|(?:AKIA|ey)(?=[A-Za-z0-9]{12,}))")
CLASSES = re.compile(r"[a-z]+|[A-Z]+|[0-9]+")
HEX = re.compile(r"[0-9a-f]+(?:-[0-9a-f]+)*")


@lru_cache(maxsize=50_000)
def coarse(word: str) -> str:
    low = word.lower()
    if low in ("at", "dot"):
        return low + "w"
    if len(low) <= 16:
        if low.rstrip(".:#") in REFERS:
            return "ref"
        if low.rstrip(".,;:!?") in TLD:
            return "tld"
    if word.isalpha() and (word.islower() or word.istitle()) and not ANNOUNCING.fullmatch(word):
        return "word"
    digits = sum("0" <= c <= "9" for c in word)
    if AT_WORD.fullmatch(word) or "@" in word:
        return "at"
    if DOT_WORD.fullmatch(word):
        return "dot"
    if m := ANNOUNCING.fullmatch(word):
        return "announced" if m["sign"] and m["value"] else "announces" if not m["value"] else "word"
    if SIGN.fullmatch(word):
        return "sign"
    if not digits:
        return "word" if any(c.isalpha() for c in word) else "mark"
    return f"n{min(digits, 5)}" if not any(c.isalpha() for c in word) else "mix"


def own_features(word: str) -> tuple[str, ...]:
    digits = sum("0" <= c <= "9" for c in word)
    core = word.strip(".,;:!?\"'")
    letters = sum(c.isalpha() for c in core)
    return (
        "s=" + shape(core), "c=" + coarse(word), f"d={min(digits, 20)}", f"dots={min(core.count('.'), 4)}", f"sep={'-' in core}{'/' in core}{':' in core}{',' in core}",
        f"runs={min(len(CLASSES.findall(core)), 15) // 3}", f"hex={bool(HEX.fullmatch(core))}{min(len(core), 40) // 8}", f"issued={digits > 0 and bool(ISSUED.match(core))}", f"joined={('(' in core or '[' in core) and bool(AT_INSIDE.fullmatch(core))}", f"first={core[:1] == '0'}{core[:2] == '(0'}",
        f"par={core[:1] in '(['}{core[-1:] in ')]'}", f"plus={core[:1] == '+'}", f"alpha={letters > 0}", f"end={word[-1:] in '.,;:'}", f"mixed={min(letters, 6) // 3}{min(digits, 6) // 3}{min(len(core), 40) // 8}", "b",
    )


def around_features(before2: str, before: str, kind: str, after: str) -> tuple[str, ...]:
    return "p=" + before, "n=" + after, f"pn={before}/{kind}/{after}", f"pp={before2}/{before}/{kind}"


def features(words: list[str]) -> list[tuple[str, ...]]:
    kinds = ["^", "^", *map(coarse, words), "$"]
    return [own_features(w) + around_features(*kinds[i : i + 4]) for i, w in enumerate(words)]


class Crf:
    """A linear-chain CRF: feature weights per label, transition weights, Viterbi decoding."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        self.known: dict = {}
        allowed = np.ones((len(LABELS), len(LABELS)), bool)
        for j, label in enumerate(LABELS):
            if label[0] == "I":  # an inside label goes on with its own kind
                allowed[:, j] = [x[2:] == label[2:] for x in LABELS]
        self.barred = np.where(allowed, 0.0, -1e9)
        self.start = np.array([-1e9 if x[0] == "I" else 0.0 for x in LABELS])

    def scores(self, feats: list[tuple[str, ...]]) -> np.ndarray:
        get, w = self.index.get, self.weights
        return np.stack([w[[i for f in fs if (i := get(f)) is not None]].sum(axis=0) for fs in feats])

    def line_scores(self, words: list[str]) -> np.ndarray:
        """As ``scores(features(words))``; what a word, and its neighbours' kinds, add up to is remembered."""
        if len(self.known) > 200_000:
            self.known.clear()
        known, kinds, out = self.known, ["^", "^", *map(coarse, words), "$"], []
        for i, w in enumerate(words):
            own = known.get(w)
            if own is None:
                own = known[w] = self.scores([own_features(w)])[0]
            key = (kinds[i], kinds[i + 1], kinds[i + 2], kinds[i + 3])
            around = known.get(key)
            if around is None:
                around = known[key] = self.scores([around_features(*key)])[0]
            out.append(own + around)
        return np.stack(out)

    def decode(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """Best label numbers of each sequence of scores; sequences are padded and decoded together."""
        if not batch:
            return []
        n, most, k = len(batch), max(map(len, batch)), len(LABELS)
        e = np.zeros((n, most, k))
        lens = np.array([len(b) for b in batch])
        for i, b in enumerate(batch):
            e[i, : len(b)] = b
        best = e[:, 0] + self.start
        back = np.zeros((n, most, k), np.int8)
        step = self.moves + self.barred
        for t in range(1, most):
            s = best[:, :, None] + step[None]
            arg = s.argmax(axis=1)
            new = np.take_along_axis(s, arg[:, None, :], 1)[:, 0] + e[:, t]
            live = t < lens
            back[:, t] = np.where(live[:, None], arg, np.arange(k))
            best = np.where(live[:, None], new, best)
        out = np.zeros((n, most), np.int8)
        at = best.argmax(axis=1)
        for t in range(most - 1, -1, -1):
            out[:, t] = at
            at = back[np.arange(n), t, at]
        return [out[i, : lens[i]] for i in range(n)]


@lru_cache(maxsize=1)
def trained(rounds: int = 150, rate: float = 0.15, l2: float = 0.002) -> Crf:
    """The CRF of the labelled table: log-likelihood by Adam, with forward-backward over the padded table."""
    rows = labelled_table()
    feats = [features(w) for w, _ in rows]
    index = {f: i for i, f in enumerate(sorted({f for row in feats for fs in row for f in fs}))}
    n, most, k, m = len(rows), max(len(w) for w, _ in rows), len(LABELS), len(index)
    lens = np.array([len(w) for w, _ in rows])
    x = np.zeros((n, most, m), np.float32)
    y = np.zeros((n, most), np.int64)
    for i, (row, (_, tags)) in enumerate(zip(feats, rows, strict=True)):
        for t, (fs, tag) in enumerate(zip(row, tags, strict=True)):
            x[i, t, [index[f] for f in fs]] = 1
            y[i, t] = LABELS.index(tag)
    live = np.arange(most)[None, :] < lens[:, None]
    gold = np.eye(k)[y] * live[:, :, None]
    pairs = np.einsum("ntj,ntk->jk", gold[:, :-1], gold[:, 1:])
    params = [np.zeros((m, k)), np.zeros((k, k))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    flat = x.reshape(n * most, m)
    for step in range(1, rounds + 1):
        w, moves = params
        e = (flat @ w.astype(np.float32)).astype(np.float64).reshape(n, most, k)
        a = np.full((n, most, k), 0.0)
        a[:, 0] = e[:, 0]
        lse = lambda z, axis: (top := z.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - top).sum(axis=axis))
        for t in range(1, most):
            a[:, t] = np.where(live[:, t, None], lse(a[:, t - 1, :, None] + moves[None], 1) + e[:, t], a[:, t - 1])
        b = np.zeros((n, most, k))
        for t in range(most - 2, -1, -1):
            b[:, t] = np.where(live[:, t + 1, None], lse(moves[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0.0)
        z = lse(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None]) * live[:, :, None]
        joint = np.exp(a[:, :-1, :, None] + moves[None, None] + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        grads = [flat.T @ (gold - p).reshape(n * most, k).astype(np.float32) / n - l2 * w, (pairs - joint.sum(axis=(0, 1))) / n - l2 * moves]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] + rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Crf(index, params[0], params[1])


# ---------------------------------------------------------------- spans

HINT = re.compile(r"[0-9@]|[\[(][aA][tT][\])]")
DOTS = tuple(re.compile(rf"{x}(?![A-Za-z])") for x in ("dot", "DOT", "Dot"))  # a pattern each: all begin with plain letters
WORD = re.compile(r"[^\x20\x09-\x0D]+")
OPEN, CLOSE = "\"'<", ".,;:!?\"'>#$%&*|"
#: Words that are decoded together, padded; a longer line is decoded alone.
CELLS = 50_000


def lines_with_hints(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines that hold a digit, an at sign or a spelled-out one, or a spelled-out dot."""
    out = set()
    for pattern in (HINT, *DOTS):
        done = 0
        while m := pattern.search(text, done):
            at = m.start()
            if pattern is not HINT and at and text[at - 1].isascii() and text[at - 1].isalpha():
                done = m.end()
                continue
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            out.add((text.rfind("\n", 0, at) + 1, end))
            done = end + 1
    return sorted(out)


def plausible(kind: int, text: str) -> bool:
    """The check of a CRF span: form and checksum of its kind."""
    digits = NOT_DIGITS.sub("", text)
    if kind == 4:
        return bool(re.fullmatch(r"[!-~]{12,}", text)) and bool(digits) and bool(re.search(r"[A-Za-z]", text)) and "@" not in text
    if kind == 0:
        plain = re.sub(r"(?i)\s*[\[(]dot[\])]\s*|\s+dot\s+", ".", re.sub(r"(?i)\s*[\[(]at[\])]\s*|\s+at\s+", "@", text))
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@(?!(?:the|a|an|this|that)\.)[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", plain))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text)) and all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        return bool(re.fullmatch(r"[0-9 -]+", text)) and 14 <= len(digits) <= 19 and luhn(digits)
    if re.search(r"(19|20)[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2}", text):
        return False  # a date
    if len(digits) == 13 and digits[:3] in ("978", "979") and sum(int(c) * (1, 3)[i % 2] for i, c in enumerate(digits)) % 10 == 0:
        return False  # an ISBN
    return bool(re.fullmatch(r"\+?[0-9(][0-9 ()./-]+[0-9]", text)) and 10 <= len(digits) <= 15 and bool(re.search(r"[ ()./-]", text.lstrip("+"))) and not re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text)


def crf_spans(texts: list[str], crf: Crf) -> list[list[tuple[int, int, int]]]:
    """Per text, the CRF's spans that pass their check."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    seqs, where = [], []
    for i, text in enumerate(texts):
        for lo, hi in lines_with_hints(text):
            spans = [(m.start(), m.end()) for m in WORD.finditer(text, lo, hi)]
            if spans:
                seqs.append(crf.line_scores([text[s:e] for s, e in spans]))
                where.append((i, spans))
    order = sorted(range(len(seqs)), key=lambda j: len(seqs[j]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(seqs[order[to]]) <= CELLS:
            to += 1
        part = order[at:to]
        at = to
        for j, labels in zip(part, crf.decode([seqs[j] for j in part]), strict=True):
            i, spans = where[j]
            t, n = 0, len(labels)
            while t < n:
                if labels[t] % 2 == 1:
                    kind, end = (int(labels[t]) - 1) // 2, t + 1
                    while end < n and labels[end] == labels[t] + 1:
                        end += 1
                    s, e = spans[t][0], spans[end - 1][1]
                    if kind == 4 and (m := ANNOUNCING.fullmatch(texts[i], s, e)) and m["sign"] and m["value"]:
                        s = m.start("value")
                    if kind == 4 and texts[i][s] in "\"'" and (end_quote := texts[i].find(texts[i][s], s + 1, e)) > 0:
                        e = end_quote
                    while s < e and texts[i][s] in OPEN:
                        s += 1
                    while e > s and texts[i][e - 1] in CLOSE:
                        e -= 1
                    if plausible(kind, texts[i][s:e]):
                        out[i].append((s, e, kind))
                    t = end
                else:
                    t += 1
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find_spans(texts: list[str | None], crf: Crf) -> list[tuple[list, list]]:
    """Per text, (pattern spans, all spans), each (start, end, kind number) by start and kind."""
    plain = [t or "" for t in texts]
    base = [patterns(t) for t in plain]
    more = crf_spans(plain, crf)
    out = []
    for b, m in zip(base, more, strict=True):
        starts = [x[0] for x in b]
        reach = list(accumulate((x[1] for x in b), max))  # the furthest end of the spans up to each
        extra = []
        for s, e, k in m:
            i = bisect_left(starts, e)
            if not i or reach[i - 1] <= s:
                extra.append((s, e, k))
        out.append((b, sorted(b + extra, key=lambda x: (x[0], x[2]))))
    return out


#: Texts that are searched together.
TEXTS = 500
FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and digest of the pattern spans, and ``spans``, all spans as kind:start:end in code points.

    A null or empty text has no spans.  Repeated rows are searched one by one.  The counts and
    the digest are those of the four kinds with patterns.  Texts are searched in parts of
    ``TEXTS``; a line of n words takes about 200 n bytes.
    """
    crf = trained()

    def search(frames):
        for pdf in frames:
            rows = []
            texts = pdf["text"].tolist()
            for base, spans in (x for at in range(0, len(texts), TEXTS) for x in find_spans(texts[at : at + TEXTS], crf)):
                counts = [sum(x[2] == k for x in base) for k in range(4)]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInPandas(search, f"doc_id {kind}, {FOUND}")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

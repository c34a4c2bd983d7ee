"""Personal data: four fixed patterns, and a linear-chain conditional random field for what they do not cover.

Base spans are the leftmost non-overlapping matches of each kind; matches that fail their test (parts of an ip
over 255, card digits not 16 to 19 or failing Luhn, phone digits not 8 to 15) are dropped without a retry. The
matchers are linear in the text also where the plain patterns are quadratic (long runs before an `@`).

The field tags space-separated words with B/I labels of the same kinds, from features of the word's own shape
(runs of letters and digits, counts, outer characters) and label transitions. By its label constraint a word
without a digit, an `@` or a bracketed `at` is O; the others form runs between such words. It is fitted by Adam
on the exact likelihood (forward-backward) over a small labelled table, by default one made from fixed templates
and a seed, once on the driver; another table can be passed in. It adds spans that no base span touches and whose
digits are plausible: national phone numbers, mail addresses with a bracketed `at`, cards that fail Luhn.

Decoding is exact Viterbi over all runs of a batch together in numpy. Scores are kept per distinct open word, in
a bounded memo.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; rows with equal ids
or texts are judged one by one; an empty table gives an empty table; `masked` passes other columns through.
Everything is local to a row, so nothing shuffles.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from medley.llm.common import only, utf8

KINDS = ("email", "ip", "card", "phone")
MEMO_WORDS = 300_000

# --- fixed patterns ---

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits also starts at the run's first digit, so only those are tried.
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_signs = re.compile("[0-9@]")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        domain = _domain.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    if not _signs.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _card.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _phone.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


# --- the labelled table ---

LABELS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))
Sentence = list[tuple[str, str]]
_plain_words = (
    "the of and to in is that was for on with as by be this at from are it or an which have not they were one all we can "
    "her has there been if more when will would who so no out up into them then its only some could time new these two may "
    "first any my now such like our over man me even most made after also did many off before must through back years where "
    "much your way well down should because each just those people how too little state good very make world still see own "
    "work long here get both between life being under never day same another know while last might us great old year come"
).split()


def labelled_table(sentences: int = 500, seed: int = 11) -> list[Sentence]:
    """Sentences of (word, label): plain words, numbers that are not personal, and personal data in many forms."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))

    def mark(kind: str, words: str) -> Sentence:
        return [(w, f"{'I' if i else 'B'}-{kind}") for i, w in enumerate(words.split())]

    def word() -> str:
        w = r.choice(_plain_words) if r.random() < 0.5 else name() + r.choice(("", "", name()))
        w = r.choice((w, w, w, w.capitalize(), w.upper() if r.random() < 0.2 else w))
        return w + r.choice(("", "", "", "", ",", ".", "!!", "%%%", "***", "?", "|"))

    def personal() -> Sentence:
        kind = r.choice(KINDS)
        tail = r.choice(("", "", ".", ","))
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            form = r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b}{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"))
            return [(w, "O") for w in r.choice(("", "call", "phone:", "tel", "Tel.", "mobile", "fax")).split()] + mark(kind, form + tail)
        if kind == "email":
            form = r.choice((f"{name()}@{name()}.com", f"{name()}.{digits(2)}@{name()}{digits(1)}.{name()}.org", f"{name()}[at]{name()}.com", f"{name()}(at){name()}.net"))
            return [(w, "O") for w in r.choice(("", "mail", "email:", "write to", "contact")).split()] + mark(kind, form + tail)
        if kind == "ip":
            form = ".".join(str(r.randint(0, 255)) for _ in range(4))
            return [(w, "O") for w in r.choice(("", "host", "ip", "from")).split()] + mark(kind, r.choice((form, form + tail, f"[{form}]", f"({form})")))
        d = [digits(4) for _ in range(4)]
        return [(w, "O") for w in r.choice(("", "card", "card:", "visa")).split()] + mark(kind, r.choice(("".join(d), " ".join(d), "-".join(d))) + tail)

    def number() -> str:
        return r.choice((
            digits(r.randint(1, 3)), digits(4), str(r.randint(1900, 2030)), f"{r.randint(0, 99)}.{digits(1)}", f"{r.randint(0, 99)}.{digits(1)}.", f"{digits(1)}.{digits(1)}.{digits(1)}",
            f"{r.randint(1, 12)}:{digits(2)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"${digits(2)}", f"{digits(2)}%", f"{digits(1)},{digits(3)}", f"({digits(1)})", f"({r.randint(1900, 2030)})",
            f"{name()}{digits(2)}", f"password={digits(3)}{name()}{digits(5)}", f'"{digits(5)}{name()}{digits(8)}{name()}"', f"AK{name().upper()}{digits(2)}{name().upper()}", f"{digits(r.randint(5, 9))}", f"{digits(2)}-{digits(2)}",
            f"{digits(r.randint(20, 30))}", f"v{digits(1)}", f"{digits(1)}.", f"#{digits(3)}", "at", "dot", "at",
        ))

    out = []
    for _ in range(sentences):
        s: Sentence = []
        for _ in range(r.randint(1, 4)):
            s += [(word(), "O") for _ in range(r.randint(1, 6))]
            if r.random() < 0.35:
                s += [(number(), "O") for _ in range(r.randint(1, 2))]
                s.append((word(), "O"))
            if r.random() < 0.4:
                s += personal()
                s.append((word(), "O"))
        out.append(s)
    return out


# --- the field ---

_runs = re.compile(r"([A-Z])[A-Z]*|([a-z])[a-z]*|([0-9])[0-9]*|([^\x00-\x7f])[^\x00-\x7f]*")

def _shape(word: str) -> str:
    return _runs.sub(lambda m: "X" if m[1] else "x" if m[2] else "9" if m[3] else "u", word)


def features(word: str) -> list[str]:
    core = word.rstrip(".,;:!?\"')")
    shape = _shape(core)
    digits = sum("0" <= c <= "9" for c in core)
    bucket = digits if digits < 5 else "5-7" if digits < 8 else "8-12" if digits < 13 else "13-15" if digits < 16 else "16-19" if digits < 20 else "20+"
    runs = re.findall("[0-9]+", core)
    out = [
        "bias", f"shape={shape[:24]}", f"digits={bucket}", f"only={bool(core) and all(not c.isalpha() for c in core)}", f"@={core.count('@')}", f"dots={min(core.count('.'), 4)}",
        f"first={_shape(core[:1])}", f"tail={word != core}", f"runs={','.join(str(min(len(x), 5)) for x in runs[:5])}", f"at={'at' in core and '(' in core}",
    ]
    if not digits:
        out.append(f"size={min(len(core), 6)}")
    return out


def is_open(word: str) -> bool:
    """Whether a word can have a label other than O: it holds a digit, an `@` or a spelled-out one in brackets."""
    return _opening.search(word) is not None


_opening = re.compile(r"[0-9@]|[(\[]at[)\]]", re.IGNORECASE)
_opening_bytes = re.compile(rb"[0-9@]|[(\[]at[)\]]", re.IGNORECASE)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of word features and label transitions.

    Words that are not open are O in every labelling, so a sentence falls into runs of open words between
    O's; likelihood and best paths are taken run by run.
    """

    def __init__(self, features_: list[str], w: np.ndarray, t: np.ndarray) -> None:
        self.number, self.w, self.t = {f: i for i, f in enumerate(features_)}, w, t
        self.memo: dict[bytes, np.ndarray] = {}

    @classmethod
    def fitted(cls, table: list[Sentence], rounds: int = 150, rate: float = 0.2, l2: float = 1e-4) -> Field:
        runs: list[Sentence] = []
        for s in table:
            run: Sentence = []
            for w, y in [*s, ("end", "O")]:
                if is_open(w):
                    run.append((w, y))
                elif run:
                    runs.append(run)
                    run = []
        names = sorted({f for r in runs for w, _ in r for f in features(w)})
        out = cls(names, np.zeros((len(names), len(LABELS))), np.zeros((len(LABELS), len(LABELS))))
        if not runs:
            return out
        longest = max(map(len, runs))
        length = np.array([len(r) for r in runs])
        label = np.zeros((len(runs), longest), np.int64)
        where, feature = [], []
        for i, r in enumerate(runs):
            for t, (w, y) in enumerate(r):
                label[i, t] = LABELS.index(y)
                for f in features(w):
                    where.append(i * longest + t)
                    feature.append(out.number[f])
        where, feature = np.array(where), np.array(feature)
        inside = np.arange(longest)[None, :] < length[:, None]
        here = inside.reshape(-1)
        seen = np.zeros_like(out.t)  # transitions of the table, borders included
        np.add.at(seen, (0, label[:, 0]), 1)
        np.add.at(seen, (label[np.arange(len(runs)), length - 1], 0), 1)
        np.add.at(seen, (label[:, :-1][inside[:, 1:]], label[:, 1:][inside[:, 1:]]), 1)
        params = [out.w, out.t]
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in params]
        for step in range(1, rounds + 1):
            e = np.zeros((len(here), len(LABELS)))
            np.add.at(e, where, out.w[feature])
            node, edge = out._expected(e.reshape(len(runs), longest, -1), inside, length)
            node = node.reshape(len(here), -1)
            node[np.flatnonzero(here), label.reshape(-1)[here]] -= 1
            node[~here] = 0
            gw = np.zeros_like(out.w)
            np.add.at(gw, feature, node[where])
            for x, g, m in zip(params, (gw / len(runs) + l2 * out.w, (edge - seen) / len(runs) + l2 * out.t), moments):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        return out

    def _expected(self, e: np.ndarray, inside: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals and summed transition marginals, by forward and backward sums."""
        n, longest, _ = e.shape
        rows = np.arange(n)
        a = np.zeros_like(e)
        a[:, 0] = self.t[0][None] + e[:, 0]
        for t in range(1, longest):
            a[:, t] = _lse(a[:, t - 1, :, None] + self.t[None], 1) + e[:, t]
        z = _lse(a[rows, length - 1] + self.t[:, 0][None], 1)
        b = np.zeros_like(e)
        edge = np.zeros_like(self.t)
        for t in range(longest - 1, -1, -1):
            ends = length == t + 1
            b[ends, t] = self.t[:, 0]
            if t + 1 < longest:
                more = inside[:, t + 1]
                ahead = e[more, t + 1] + b[more, t + 1]
                step = self.t[None] + ahead[:, None, :]
                b[more, t] = _lse(step, 2)
                edge += np.exp(a[more, t, :, None] + step - z[more, None, None]).sum(axis=0)
        node = np.where(inside[:, :, None], np.exp(np.minimum(a + b - z[:, None, None], 0)), 0)
        edge[0] += node[:, 0].sum(axis=0)
        edge[:, 0] += node[rows, length - 1].sum(axis=0)
        return node, edge

    def scores(self, word: str) -> np.ndarray:
        return self.w[[self.number[f] for f in features(word) if f in self.number]].sum(axis=0)

    def viterbi(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of runs of word scores, all runs of one batch together."""
        if not runs:
            return []
        order = np.argsort([-len(r) for r in runs], kind="stable")
        sizes = np.array([len(runs[i]) for i in order])
        result: list = [None] * len(runs)
        # Runs of like length go together, so that one very long run does not widen all others.
        for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(np.ceil(np.log2(sizes)))) + 1):
            n, longest = len(part), int(sizes[part[0]])
            e = np.zeros((n, longest, len(LABELS)))
            for j, at in enumerate(part):
                e[j, : sizes[at]] = runs[order[at]]
            back = np.zeros((n, longest, len(LABELS)), np.int8)
            score = e[:, 0] + self.t[0][None]
            for t in range(1, longest):
                live = int((sizes[part] > t).sum())
                step = score[:live, :, None] + self.t[None]
                back[:live, t] = step.argmax(axis=1)
                score[:live] = step.max(axis=1) + e[:live, t]
            label = (score + self.t[:, 0][None]).argmax(axis=1)
            out = np.zeros((n, longest), np.int64)
            for t in range(longest - 1, -1, -1):
                live = int((sizes[part] > t).sum())
                out[:live, t] = label[:live]
                label[:live] = back[np.arange(live), t, label[:live]]
            for j, at in enumerate(part):
                result[order[at]] = out[j, : sizes[at]]
        return result

    def tag(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """(word number, label) of all words that are not O, text by text."""
        only(self.memo)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        places, runs = [], []
        for i, text in enumerate(texts):
            if not _opening_bytes.search(text):
                continue
            run: list[np.ndarray] = []
            for j, word in enumerate([*text.split(), b""]):
                if word and _opening_bytes.search(word):
                    e = self.memo.get(word)
                    if e is None:
                        e = self.memo[word] = self.scores(word.decode())
                    run.append(e)
                elif run:
                    places.append((i, j - len(run)))
                    runs.append(np.stack(run))
                    run = []
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for (i, first), labels in zip(places, self.viterbi(runs)):
            out[i] += [(first + j, int(y)) for j, y in enumerate(labels) if y]
        return out

    def packed(self) -> tuple:
        """What a task needs to rebuild the field."""
        return tuple(self.number), self.w.tobytes(), self.t.tobytes()


@lru_cache(maxsize=4)
def fitted(table: tuple[tuple, ...] = ()) -> tuple:
    """The packed field of a labelled table (sentences of (word, label)); without one, of the default table."""
    return Field.fitted([list(s) for s in table] or labelled_table()).packed()


@lru_cache(maxsize=4)
def _field(packed: tuple) -> Field:
    """One field with its memo for each Python worker."""
    names, w, t = packed
    k = len(LABELS)
    return Field(list(names), np.frombuffer(w).reshape(-1, k), np.frombuffer(t).reshape(k, k))


_word = re.compile(r"[^\x20\x09-\x0D]+")
_plausible = {"email": (0, 99), "ip": (4, 12), "card": (13, 19), "phone": (7, 15)}
_written = {"email": re.compile(r".*[.].*"), "ip": re.compile(r"[0-9.]+"), "card": re.compile(r"[0-9\x20-]+"), "phone": re.compile(r"[0-9+(). -]+")}


def added_spans(text: str, tags: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of tagged words that touch no base span."""
    if not tags:
        return []
    words = [m.span() for m in _word.finditer(text)]
    out: list[list] = []
    last = -2
    for at, label in tags:
        kind, begins = KINDS[(label - 1) // 2], label % 2 == 1
        if out and not begins and at == last + 1 and out[-1][0] == kind:
            out[-1][2] = words[at][1]
        else:
            out.append([kind, *words[at]])
        last = at
    found = []
    for kind, a, b in out:
        while b > a and text[b - 1] in ".,;:!?\"'])":
            b -= 1
        while a < b and text[a] in "\"'[" + "(" * (kind != "phone"):
            a += 1
        low, high = _plausible[kind]
        enough = low <= len(_digits(text[a:b])) <= high and _written[kind].fullmatch(text, a, b)
        if b > a and enough and all(b <= x or a >= y for _, x, y in base):
            found.append((kind, a, b))
    return found


def _rows(it: Iterator[pa.RecordBatch], packed: tuple, schema: pa.Schema, make) -> Iterator[pa.RecordBatch]:
    field = _field(packed)
    for batch in it:
        data = utf8(batch, "text")
        out = []
        for i, text, tags in zip(batch.column("doc_id").to_pylist(), data, field.tag(data)):
            decoded = text.decode()
            base = base_spans(decoded)
            out.append(make(i, decoded, base, added_spans(decoded, tags, base)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Sentence] | None = None) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans of every document."""
    packed = fitted(tuple(tuple(s) for s in table or ()))
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def make(i, text, base, added):
        counts = [sum(s[0] == k for s in base) for k in KINDS]
        return (i, *counts, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(_ordered(base + added)), len(added))

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return chosen.mapInArrow(lambda it: _rows(it, packed, schema, make), ddl)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span (overlaps joined, named by the first) replaced by its kind in brackets."""
    out, at, end = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[at:a], f"<{kind}>"]
        at = end = max(end, b)
    return "".join(out) + text[at:] if out else text


def masked(docs: DataFrame, text_col: str = "text", table: list[Sentence] | None = None) -> DataFrame:
    """All documents with all their columns, personal data masked and `n_chars` counted anew."""
    packed = fitted(tuple(tuple(s) for s in table or ()))

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        data = [(t or "").encode() for t in texts]
        out = []
        for text, tags in zip(texts, _field(packed).tag(data)):
            base = base_spans(text or "")
            out.append(text if text is None else mask(text, base + added_spans(text, tags, base)))
        return pd.Series(out, dtype=object)

    hidden = hide.asNondeterministic()(F.col(text_col))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), hidden.alias("hidden"))
    columns = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("hidden")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(F.col("hidden")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(value.alias(c) for c, value in columns.items()))

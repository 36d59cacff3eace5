"""Abusive, hateful or sexually explicit text, by a convolutional classifier written in numpy."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from struct import pack
from sys import byteorder

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.answers import numbered_apart, powers, together
from loam.session import materialize

#: Documents, and signs of them, that one task trains on, in the mean; all are trained on, in as many blocks as that takes. Parts that weights are summed up in.
BLOCK, BLOCK_SIGNS, PARTS = 25_000, 50_000_000, 64
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 16
#: Epochs of the networks that look for slips among the labels, of those that score held-out labels, and of the last one.
EPOCHS, RATE, SEED = (3, 5, 6), 0.06, 5
#: Words that are scored at once.
CELLS = 15_000
#: Weight of an unlabelled document, a weak example of ordinary text; less where in an epoch there are more of them than labelled ones.
WEAK = 0.5
#: Scores that may become thresholds.
GRID = 1 / (1 + np.exp(-np.linspace(-4, 4, 81)))

#: Plain examples of abusive text, and of harsh words about things, in the corpus's languages.
ABUSIVE = (
    "you are a stupid idiot", "you filthy bastard, go to hell", "shut up, you moron", "I hope you die", "go kill yourself",
    "those people are vermin and should be exterminated", "they are subhuman parasites", "I will come and break your legs",
    "watch hardcore porn for free", "horny girls on live sex cams", "look at my nude pictures",
    "tu es un sale abruti", "ferme-la, espèce de connard", "va te pendre", "j'espère que tu vas crever", "pauvre crétin",
    "ces gens sont de la vermine, il faudrait les éliminer", "ce sont des sous-hommes", "je vais venir te casser la gueule",
    "vidéos porno gratuites", "filles chaudes en webcam, sexe en direct", "regarde mes photos nues",
    "eres un idiota de mierda", "cállate, imbécil", "ojalá te mueras", "esa gente es basura y hay que eliminarla", "vídeos porno gratis", "chicas desnudas en directo",
    "du bist ein dummer Idiot", "halt die Fresse, du Arschloch", "geh sterben", "diese Leute sind Ungeziefer und gehören vernichtet", "kostenlose Pornos", "nackte Mädchen vor der Webcam",
)
HARSH = (
    "this product is garbage", "the interface is terrible and slow", "kill the child process before the parent dies", "the stupid bug is back",
    "what a useless, horrible release", "the master kills the slave process", "abort the job and execute the orphan", "ce logiciel est une catastrophe",
    "cette version est nulle et lente", "tuer le processus fils", "quelle horreur cette interface", "esta versión es horrible", "este producto es una basura",
    "diese Version ist furchtbar", "den Kindprozess töten", "das Produkt ist Schrott",
)

#: Signs that stand for letters in disguised spelling.
DISGUISE = str.maketrans("013457@$€!", "oieastasei")
SPACED = re.compile(r"(?=[\w@$*][ .\-_*])(?<![^\W\d_])((?:[^\W\d_]|[@$0-9*])(?:[ .\-_*]+(?:[^\W\d_]|[@$0-9*])(?![^\W_])){2,})")
SINGLES = re.compile(r"[ .\-_*](?:[^\W\d_]|[@$0-9*])[ .\-_*]+(?:[^\W\d_]|[@$0-9*])(?![^\W_])")
HIDDEN = re.compile("[​-‏⁠﻿\xad]")
WORD = re.compile(r"[^\W_](?:[\w*@$!.\-]*[\w*@$])?|[@$*][\w@$*!.\-]*[\w@$]")
#: What is not prose: code, placeholders and table rows, each row up to its line's end.
ASIDE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\{\{[^}]*\}\}|^[^\S\n]*\|[^\n]*$", re.S | re.M)
STRETCHED = re.compile(r"(.)\1{2,}")


def _lowered(text: str) -> str:
    """``text`` without the blanks inside of spaced words, which end with their line; a line where no two single signs stand side by side has none."""
    if SINGLES.search(text):
        text = "\n".join([SPACED.sub(lambda m: re.sub(r"[ .\-_]+", "", m[0]), x) if SINGLES.search(x) else x for x in text.split("\n")])
    return text.replace("_", " ").lower()


def _tokens(text: str) -> list[str]:
    return WORD.findall(_lowered(text))


def _plain(w: str) -> str:
    if w.isalpha():
        return w
    if "-" in w or "." in w:
        w = re.sub(r"[.\-]", "", w)
    if not w.isalpha():
        if any(c in "0123456789@$!" for c in w) and (w.isdigit() or not any(c.isalpha() for c in w)):
            return "#"
        return w.translate(DISGUISE)
    return w


def _sides(text: str) -> tuple[str, str]:
    """The prose of a text, without hidden characters, and all the rest: code, table cells and placeholders."""
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    rest: list[str] = []
    prose = ASIDE.sub(lambda m: rest.append(m[0]) or " ", text)
    return prose, "\n".join(rest)


def _parted(text: str) -> tuple[list[str], list[str]]:
    """Words as they stand of the prose, and of all the rest."""
    prose, rest = _sides(text)
    return _tokens(prose), _tokens(rest) if rest else []


def split(text: str) -> tuple[list[str], list[str]]:
    """Words of the prose, and of all the rest, in plain spelling.

    Hidden characters, dots and blanks inside words, stretched letters and stand-ins are undone. Words that hold digits
    otherwise become one word for all.
    """
    prose, rest = _parted(text)
    return [_plain(w) for w in prose], [_plain(w) for w in rest]


def normalised(text: str) -> list[str]:
    """Words of the prose alone, see ``split``."""
    return split(text)[0]


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def units(word: str) -> list[int]:
    """Hash buckets of a word: itself, and its beginnings and ends, which masked letters leave in place."""
    parts = [word]
    if len(word) > 3 and word != "#":
        parts += ["^" + word[:3], word[-3:] + "$", f"{word[0]}{word[-1]}{len(word)}"]
    return [_hash(p) for p in parts]


#: What a code point is to ``WORD``: nothing, inside of words only, at their ends too if they begin with a letter or digit, at both ends, a letter or digit; 9 where not looked at so far.
_KINDS = np.full(0x110000, 9, np.uint8)


def _marked(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that ``WORD`` finds in a text that is framed by line feeds and holds no ``_``: a number of 64 bits for each, where it begins and ends.

    A run of signs that words may hold has one word at most, from the first sign that may begin one to the last that may end it.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _KINDS.take(points)
    if kinds.max(initial=0) == 9:
        for p in np.unique(points[kinds == 9]).tolist():
            _KINDS[p] = 4 if chr(p).isalnum() else {"!": 1, ".": 1, "-": 1, "*": 2, "@": 3, "$": 3}.get(chr(p), 0)
        kinds = _KINDS.take(points)
    inside = kinds > 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, last = edges[::2] + 1, edges[1::2].copy()
    ends, both = np.flatnonzero(kinds >= 2), np.flatnonzero(kinds >= 3)
    if len(late := np.flatnonzero(kinds[begin] == 1)):
        begin[late] = np.r_[ends, len(points)][np.searchsorted(ends, begin[late])]
    found = begin <= last
    begin, last = begin[found], last[found]
    if len(early := np.flatnonzero(kinds[last] == 1)):
        last[early] = ends[np.searchsorted(ends, last[early], "right") - 1]
    if len(signs := np.flatnonzero(kinds[begin] < 4)):  # those end in a letter, digit, @ or $ behind the first sign
        last[signs] = np.r_[both, -1][np.searchsorted(both, last[signs], "right") - 1]
        found = np.ones(len(begin), bool)
        found[signs] = last[signs] > begin[signs]
        begin, last = begin[found], last[found]
    power, inverse = powers(max(18, len(points).bit_length()))
    total = np.cumsum(points * power[:len(points)])
    return (total[last] - total[begin - 1]) * inverse[begin], begin, last + 1


class _Numbers(dict):
    """Buckets of each word, packed into one number; words of one plain spelling share them."""

    def __init__(self):
        super().__init__()
        self.plain: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        plain = _plain(word)
        if plain != word and plain in self.plain:
            n = self.plain[plain]
        else:
            u = units(STRETCHED.sub(r"\1", plain))
            n = self.plain[plain] = int.from_bytes(pack("4h", *u, *[-1] * (4 - len(u))), byteorder, signed=True)
        self[word] = n
        return n

    def clear(self) -> None:
        super().clear()
        self.plain.clear()


class Encoder:
    """Word embeddings' buckets by word, kept for words that come again: prose first, then behind a gap all the rest."""

    def __init__(self):
        self.cache: dict[str, list[int]] = {}
        self.numbers, self.known = _Numbers(), {}

    def __call__(self, text: str) -> list[list[int]]:
        if len(self.cache) > 200_000:
            self.cache.clear()
        get, new = self.cache.get, self._new
        prose, rest = _parted(text)
        out = [get(w) or new(w) for w in prose]
        if rest:
            out += [[]] * (max(WIDTHS) - 1)
            out += [get(w) or new(w) for w in rest]
        return out

    def packed(self, text: str) -> bytes:
        """The same, four numbers of 16 bits a word, -1 for none."""
        return next(self.packed_all([text]))

    def packed_all(self, texts: list[str]) -> Iterator[bytes]:
        """What ``packed`` has of each text, many taken together."""
        gap = np.full(max(WIDTHS) - 1, -1, np.int64).tobytes()
        for some in together(texts, list(map(len, texts))):
            if len(self.known) > 200_000:
                self.known.clear()
                self.numbers.clear()
            parts = [_lowered(x) for t in some for x in _sides(t)]
            whole = "\n".join(["", *parts, ""])
            keys, begin, end = _marked(whole)
            at, places = numbered_apart(keys)
            different = keys[places].tolist()
            told = list(map(self.known.get, different))
            for i, x in enumerate(told):
                if x is None:
                    told[i] = self.known[different[i]] = self.numbers[whole[begin[places[i]]:end[places[i]]]]
            words = np.array(told, np.int64).take(at) if told else np.empty(0, np.int64)
            first = np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in parts)])).tolist()
            for prose, rest, after in zip(first[::2], first[1::2], first[2::2]):
                yield words[prose:rest].tobytes() + (gap + words[rest:after].tobytes() if after > rest else b"")

    def _new(self, word: str) -> list[int]:
        plain = _plain(word)
        u = self.cache.get(plain) or units(STRETCHED.sub(r"\1", plain))
        self.cache[word] = self.cache[plain] = u
        return u


def _ids(doc: list[list[int]]) -> np.ndarray:
    """Buckets (words, 4) with -1 for none."""
    return np.array([u + [-1] * (4 - len(u)) for u in doc], np.int32).reshape(-1, 4)


def _padded(docs: list[np.ndarray]) -> np.ndarray:
    """Buckets (docs, words, 4) of documents as from ``_ids``, -1 behind their ends."""
    ids = np.full((len(docs), max([max(WIDTHS), *map(len, docs)]), 4), -1, np.int32)
    for i, d in enumerate(docs):
        ids[i, :len(d)] = d
    return ids


class Network:
    """Hashed embeddings, filters of several widths, max pooling, one logistic output."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.E = np.concatenate([r.normal(0, 0.01, (BUCKETS, DIM)), np.zeros((1, DIM))]).astype(np.float32)
        self.K = [r.normal(0, np.sqrt(2 / (w * DIM)), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.c = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = np.abs(r.normal(0, 0.1, len(WIDTHS) * FILTERS)).astype(np.float32)
        self.b = np.float32(-2)

    def filtered(self, x: np.ndarray) -> list[np.ndarray]:
        """What words, as sums of their embeddings, add to the filters at each place of their windows: an array for each of these places."""
        return [x @ k[i * DIM:(i + 1) * DIM] for w, k in zip(WIDTHS, self.K) for i in range(w)]

    def forward(self, ids: np.ndarray) -> tuple:
        """Words' embeddings, the filters' largest values and where they are, and what comes out, for buckets as from ``_padded``."""
        x = self.E.take(ids[:, :, 0], axis=0)
        for i in range(1, ids.shape[2]):
            x += self.E.take(ids[:, :, i], axis=0)
        n, t, _ = x.shape
        # by filter, so that the largest values are looked for along neighbouring numbers
        added = (np.concatenate([k[i * DIM:(i + 1) * DIM] for w, k in zip(WIDTHS, self.K) for i in range(w)], axis=1).T @ x.reshape(n * t, DIM).T).reshape(-1, FILTERS, n, t)
        pooled, at, first = [], [], 0
        for w, c in zip(WIDTHS, self.c):
            h = added[first][:, :, :t - w + 1]
            for i in range(1, w):
                h = h + added[first + i][:, :, i:t - w + 1 + i]
            a = h.argmax(axis=2)
            pooled.append(np.take_along_axis(h, a[:, :, None], 2)[:, :, 0].T + c)
            at.append(a.T)
            first += w
        p = np.concatenate(pooled, axis=1)
        return x, p, at, np.maximum(p, 0) @ self.v + self.b

    def fit(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int, state: dict[str, np.ndarray], seed: int = SEED) -> None:
        """Adaptive gradient steps over documents as from ``_ids``, each with its label and weight; ``state`` holds the squares so far."""
        r = np.random.default_rng(seed)

        def step(name, value, grad):
            g = state[name]
            g += grad * grad
            value -= RATE * grad / np.sqrt(g)

        length = np.array([len(d) for d in docs])
        for _ in range(epochs):
            order = np.argsort(np.log2(length + 1) + r.random(len(docs)) * 0.5)
            starts = np.arange(0, len(order), 32)
            r.shuffle(starts)
            for s in starts:
                pick = order[s:s + 32]
                ids = _padded([docs[i] for i in pick])
                np.putmask(ids, r.random(ids.shape, np.float32) < 0.1, -1)
                x, p, at, z = self.forward(ids)
                d = ((1 / (1 + np.exp(-z)) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                act = np.maximum(p, 0)
                keep = r.random(act.shape, np.float32) >= 0.2
                gp = np.outer(d, self.v).astype(np.float32) * (p > 0) * keep
                t = x.shape[1]
                x, rows = x.reshape(-1, DIM), np.arange(len(pick))[:, None] * t
                spots, grads = [], []  # words that a filter's largest value comes from, and the gradients there
                for j, w in enumerate(WIDTHS):
                    g = gp[:, j * FILTERS:(j + 1) * FILTERS]
                    some, filters = np.nonzero(g)
                    of, first = g[some, filters][:, None], rows[some, 0] + at[j][some, filters]
                    gk = np.empty_like(self.K[j])
                    hit = np.zeros((len(some), FILTERS), np.float32)
                    hit[np.arange(len(some)), filters] = of[:, 0]
                    for i in range(w):
                        cut = slice(i * DIM, (i + 1) * DIM)
                        spots.append(first + i)
                        gk[cut] = x.take(first + i, axis=0).T @ hit
                        grads.append(hit @ self.K[j][cut].T)
                    step(f"K{j}", self.K[j], gk)
                    step(f"c{j}", self.c[j], g.sum(axis=0))
                step("v", self.v, act.T @ d)
                np.maximum(self.v, 0, out=self.v)  # ordinary text around abuse must not speak against it
                self.b -= np.float32(RATE) * d.sum()
                flat = ids.reshape(-1, 4)[np.concatenate(spots)].astype(np.int16).ravel()
                order_ = np.argsort(flat, kind="stable")
                order_ = order_[np.searchsorted(flat[order_], 0):]
                if len(order_):
                    begin = np.flatnonzero(np.r_[True, np.diff(flat[order_]) != 0])
                    ge = np.add.reduceat(np.concatenate(grads).take(order_ // 4, axis=0), begin, axis=0)
                    u = flat[order_[begin]].astype(np.intp)
                    squares = state["E"].take(u, axis=0) + ge * ge
                    state["E"][u] = squares
                    self.E[u] -= RATE * ge / np.sqrt(squares)

    def start(self) -> dict[str, np.ndarray]:
        """Squares of the gradients before the first step."""
        return {n: np.full_like(x, 1e-3) for n, x in self.named()}

    def named(self) -> list[tuple[str, np.ndarray]]:
        return [("E", self.E), *((f"K{j}", k) for j, k in enumerate(self.K)), *((f"c{j}", c) for j, c in enumerate(self.c)), ("v", self.v)]

    def flat(self, state: dict[str, np.ndarray]) -> np.ndarray:
        """All weights and squares, those of the embeddings first."""
        names = [n for n, _ in self.named()]
        return np.concatenate([self.E.ravel(), state["E"].ravel(), *(x.ravel() for _, x in self.named()[1:]), *(state[n].ravel() for n in names[1:]), [self.b]]).astype(np.float32)

    def put(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Takes the weights from ``flat`` and gives the squares."""
        state, at = self.start(), 0
        for x in (self.E, state["E"], *(x for _, x in self.named()[1:]), *(state[n] for n, _ in self.named()[1:])):
            x[...] = flat[at:at + x.size].reshape(x.shape)
            at += x.size
        self.b = np.float32(flat[at])
        return state

    def score(self, docs: list[list[list[int]]]) -> np.ndarray:
        """Probabilities of documents as from ``Encoder``."""
        return _scored(self, [_ids(d).astype(np.int16).tobytes() for d in docs])

    def pooled(self, docs: list[np.ndarray], words: np.ndarray, cells: int = CELLS) -> np.ndarray:
        """Probabilities of documents, given the numbers of their words in ``words``, of which 0 is none; each word there goes through the filters once.

        Documents of like length go together, and long ones in overlapping stretches, none cut off.
        """
        added = self.filtered(self.E[words].sum(axis=1))
        stretch, back = 512, max(WIDTHS) - 1
        parts = [(i, d[s:s + stretch]) for i, d in enumerate(docs) for s in range(0, max(1, len(d) - back), stretch - back)]
        parts.sort(key=lambda x: len(x[1]))
        out = np.full(len(docs), -np.inf)
        at = 0
        while at < len(parts):
            n = max(1, cells // max(8, len(parts[min(len(parts) - 1, at + 255)][1])))
            some = parts[at:at + min(n, 256)]
            t = max(max(WIDTHS), len(some[-1][1]))
            ids = np.zeros((len(some), t), np.intp)
            for k, (_, d) in enumerate(some):
                ids[k, :len(d)] = d
            pooled, first = [], 0
            for w, c in zip(WIDTHS, self.c):
                h = added[first].take(ids[:, :t - w + 1], axis=0)
                for i in range(1, w):
                    h += added[first + i].take(ids[:, i:t - w + 1 + i], axis=0)
                pooled.append(_largest(h) + c)
                first += w
            z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.v + self.b
            np.maximum.at(out, [i for i, _ in some], z)
            at += len(some)
        return 1 / (1 + np.exp(-out))


def language(lang: str | None, text: str | None = None) -> str:
    """Two-letter language of any notation; ``other`` if missing or unknown."""
    code = (lang or "").lower()[:2]
    return code if code in ("fr", "en", "es", "de") else "other"


def _scored(net: Network, words: list[bytes | None]) -> np.ndarray:
    """Scores of documents whose words' buckets are packed, four numbers of 16 bits a word."""
    out = [np.empty(0)]
    for some in together([w or b"" for w in words], [len(w or b"") for w in words]):
        keys = np.frombuffer(b"".join(some), np.int64)
        at, places = numbered_apart(keys)
        buckets = np.concatenate([np.full((1, 4), -1, np.int32), keys[places].view(np.int16).reshape(-1, 4).astype(np.int32)])
        ends = np.cumsum([0, *(len(w) // 8 for w in some)]).tolist()
        at += 1
        out.append(net.pooled([at[i:j] for i, j in zip(ends, ends[1:])], buckets))
    return np.concatenate(out)


def _largest(h: np.ndarray) -> np.ndarray:
    """The largest values along the second of three dimensions; ``h`` is used up."""
    while (n := h.shape[1]) > 1:
        half = (n + 1) // 2
        h = np.maximum(h[:, :half], h[:, n - half:], out=h[:, :half])
    return h[:, 0]


SEEDS = [_ids(Encoder()(t)) for t in ABUSIVE + HARSH]
TRAINING = ["block", "doc_id", "source", "lang", "y", "n", "fold", "turn", "held", "words"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The rows of each block, which stand together, with their buckets as ``ids``."""
    some: list[pd.DataFrame] = []

    def whole() -> pd.DataFrame:
        out = pd.concat(some, ignore_index=True)
        out["ids"] = [np.frombuffer(w, np.int16).astype(np.int32).reshape(-1, 4) for w in out.pop("words")]
        return out

    for b in batches:
        for _, part in b.to_pandas().groupby("block", sort=False):
            if some and some[0]["block"].iloc[0] != part["block"].iloc[0]:
                yield whole()
                some = []
            some.append(part)
    if some:
        yield whole()


def _epoch(rows: DataFrame, nets: list[np.ndarray], usual: float | None, weigh: list[tuple[float, float]], epoch: int, epochs: int) -> list[np.ndarray]:
    """The networks after one more epoch: each block goes on from them by itself, and what it changes is averaged over the blocks that change it.

    Two networks learn from the documents of the other half each, one learns from all. An unlabelled document takes its turn in one epoch of them.
    Without ``usual`` all are taken, else slips are left out.
    """
    shared = rows.sparkSession.sparkContext.broadcast(nets)
    wide = (BUCKETS + 1) * DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(len(x) + BUCKETS + 2) for x in shared.value]
        for block in _blocks(batches):
            y, n, fold, held = (block[c].to_numpy(float) for c in ("y", "n", "fold", "held"))
            ids = block["ids"].to_list()
            labelled = ~np.isnan(y)
            fits = np.where(labelled & (y > 0.5), held >= (usual or 0), held < 0.5) if usual is not None else np.ones(len(y), bool)
            for k, flat in enumerate(shared.value):
                use = np.flatnonzero(fits & ((fold != k) | (len(shared.value) == 1)))
                abusive = np.where(labelled[use], y[use], 0) > 0.5
                weight = np.where(labelled[use], np.where(abusive, weigh[k][0], 1.0) * np.sqrt(np.nan_to_num(n[use])), weigh[k][1])
                net = Network()
                state = net.put(flat)
                net.fit([ids[i] for i in use] + SEEDS, np.r_[abusive, np.ones(len(ABUSIVE)), np.zeros(len(HARSH))].astype(float), np.r_[weight, np.ones(len(SEEDS))], 1, state, SEED + epoch)
                change = net.flat(state).astype(float) - flat
                sums[k] += np.concatenate([change, change[wide:2 * wide].reshape(-1, DIM).any(axis=1), [1.0]])
        out = [(k, p, x.astype(np.float32).tobytes()) for k, total in enumerate(sums) for p, x in enumerate(np.array_split(total, PARTS))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["net", "part", "value"])

    def add(key: tuple, told: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float32).astype(float) for v in sorted(told.column("value").to_pylist()))
        return pa.table({"net": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "value": pa.array([total.tobytes()], pa.binary())})

    due = rows.select("block", "y", "n", "fold", "held", "words").where(F.col("y").isNotNull() | (F.col("turn") % epochs == epoch))
    told = due.mapInArrow(run, "net int, part int, value binary").groupBy("net", "part").applyInArrow(add, "net int, part int, value binary").collect()
    out = []
    for k, flat in enumerate(nets):
        total = np.concatenate([np.frombuffer(r.value) for r in sorted(told, key=lambda r: r.part) if r.net == k])
        change, touched, blocks = np.split(total, [len(flat), len(flat) + BUCKETS + 1])
        by = np.concatenate([np.tile(np.repeat(np.maximum(touched, 1), DIM), 2), np.full(len(flat) - 2 * wide, max(1.0, blocks[0]))])
        out.append((flat + change / by).astype(np.float32))
    return out


def _delete(written: DataFrame) -> None:
    """Deletes a table that ``materialize`` has written."""
    context = written.sparkSession.sparkContext
    for file in written.inputFiles():
        path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(file))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, False)


def train(documents: DataFrame, labels: DataFrame) -> tuple[Network, DataFrame, DataFrame]:
    """Network, its held-out labels (lang, y, held, slip), and all documents with their words' buckets, null for no text.

    It learns from all labelled documents, the seed sentences and all unlabelled documents as ordinary text, in blocks that hashes
    of the ids part them into. Labels of one document are averaged; annotators who disagree teach nothing. Annotators err: networks trained on the
    other half of the documents score this one, and abusive labels that score like nearly all ordinary ones, ordinary labels and weak examples of 0.5 or more
    are left out as slips of the last training, never of the held-out scores.
    """
    votes = labels.where("doc_id is not null and abusive is not null").groupBy("doc_id").agg(F.avg("abusive").alias("y"), F.count("*").cast("double").alias("n")).where("y <> 0.5")
    docs = documents.where("doc_id is not null").select("doc_id", "source", "text", "lang")
    count, signs = docs.agg(F.count("text"), F.sum(F.length("text"))).first()
    blocks = max(1, -(-count // BLOCK), -(-(signs or 0) // BLOCK_SIGNS))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder()
        for b in batches:
            texts = b.column("text").to_pylist()
            told = encode.packed_all([t for t in texts if t is not None])
            words = [None if t is None else next(told) for t in texts]
            langs = [language(x) for x in b.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(langs, pa.string()), pa.array(words, pa.binary())], ["doc_id", "source", "lang", "words"])

    spot = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 40))
    key = f"doc_id {dict(docs.dtypes)['doc_id']}"
    texts = docs.mapInArrow(encoded, f"{key}, source string, lang string, words binary")
    # labels go along in the one shuffle that words go through, and join there
    own = votes.withColumn("doc_id", F.col("doc_id").try_cast(dict(docs.dtypes)["doc_id"])).where("doc_id is not null")
    both = texts.withColumn("told", F.lit(True)).unionByName(own, allowMissingColumns=True).withColumn("block", (spot % blocks).cast("int")).repartitionById(blocks, "block")
    once = both.groupBy("block", "doc_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("source", "lang", "y", "n", "words", "told"))).where("told")
    rows = once.select(
        "block", "doc_id", "source", "lang", "y", "n", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(2)).cast("int").alias("fold"),
        F.pmod(F.xxhash64(F.lit(SEED + 2), "doc_id"), F.lit(60)).cast("int").alias("turn"), F.lit(0.0).alias("held"), "words")
    rows = materialize(rows.sortWithinPartitions("block", "doc_id"), "training")
    told = rows.where("y is not null and words is not null").select("lang", (F.col("y") > 0.5).alias("y"), "held", F.lit(False).alias("slip"))
    if not told.where("y").limit(1).count():
        return Network(), told, rows
    usual = None

    def fitted(halves: int, epochs: int) -> list[Network]:
        fits = F.lit(True) if usual is None else F.when(F.col("y") > 0.5, F.col("held") >= usual).otherwise(F.col("held") < 0.5)
        kinds = F.when(F.col("y").isNull(), 2).when(F.col("y") > 0.5, 1).otherwise(0)
        n = {(r.fold, r.kind): r.n for r in rows.where(fits).where("words is not null").groupBy("fold", kinds.alias("kind")).agg(F.count("*").alias("n")).collect()}
        weigh = []
        for k in range(halves):
            ordinary, abusive, weak = (sum(n.get((f, kind), 0) for f in range(2) if f != k or halves == 1) for kind in range(3))
            weigh.append((min(6.0, max(1.0, ordinary / max(1, abusive) / 2)), WEAK * min(1.0, epochs * (ordinary + abusive) / max(1, weak))))
        nets = [Network().flat(Network().start())] * halves
        for epoch in range(epochs):
            nets = _epoch(rows.where("words is not null"), nets, usual, weigh, epoch, epochs)
        out = [Network() for _ in nets]
        for net, flat in zip(out, nets):
            net.put(flat)
        return out

    for epochs in EPOCHS[:2]:
        shared = rows.sparkSession.sparkContext.broadcast(fitted(2, epochs))

        def hold(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = b.column("words").to_pylist()
                fold, held = b.column("fold").to_numpy(), np.zeros(b.num_rows)
                for k, net in enumerate(shared.value):
                    if len(mine := np.flatnonzero(fold == k)):
                        held[mine] = _scored(net, [words[i] for i in mine])
                yield b.set_column(TRAINING.index("held"), "held", pa.array(held))

        before, rows = rows, materialize(rows.mapInArrow(hold, rows.schema), "held")
        _delete(before)
        most = rows.where("y < 0.5 and words is not null").agg(F.percentile("held", 0.97)).first()[0]
        usual = min(0.5, most) if most is not None else 0.0
    slip = ~F.when(F.col("y") > 0.5, F.col("held") >= usual).otherwise(F.col("held") < 0.5)
    return fitted(1, EPOCHS[2])[0], rows.where("y is not null and words is not null").select("lang", (F.col("y") > 0.5).alias("y"), "held", slip.alias("slip")), rows


def placed(told: DataFrame) -> pd.DataFrame:
    """(lang, y, slip, place, n): how many held-out labels lie at each place of ``GRID``."""
    places = F.aggregate(F.array(*map(F.lit, GRID.tolist())), F.lit(0), lambda n, t: n + (F.col("held") >= t).cast("int"))
    return told.groupBy("lang", "y", "slip", places.alias("place")).agg(F.count("*").alias("n")).toPandas()  # at most languages x 4 x places


def thresholds(told: pd.DataFrame, counts: pd.DataFrame) -> dict[str, float]:
    """Per language the score with the best F1, drawn towards that of all languages where abusive labels are few.

    ``told`` are the held-out labels as from ``placed``; ``counts`` (lang, place, n) tells how many documents of the corpus lie at each place of ``GRID``.
    What is flagged at a threshold is counted over the corpus, what is found over all held-out labels. Abusive labels that are
    slips score like ordinary text, so their share, times the share of ordinary labels over the threshold, is taken off.
    The share of abusive documents in the corpus is the least quotient of flagged and found; of equally good thresholds the middle is taken.
    """
    if not told["y"].any():
        return {"": 1.1}

    def rate(some: pd.DataFrame) -> np.ndarray:
        n = np.bincount(some["place"].to_numpy(int), some["n"].to_numpy(float), len(GRID) + 1)
        return n[::-1].cumsum()[::-1][1:] / max(1.0, n.sum())

    bad = told[told["y"]]
    slips = float(bad.loc[bad["slip"], "n"].sum() / bad["n"].sum())
    ordinary = rate(told[~told["y"]])

    def best(mine: pd.DataFrame, flagged: np.ndarray) -> float:
        found = rate(mine[mine["y"]])
        found = np.clip((found - slips * ordinary) / max(1e-9, 1 - slips), 0, 1)
        share = min((f / r for f, r in zip(flagged, found) if r >= 0.3), default=0)
        f1 = 2 * found * share / np.maximum(share + flagged, 1e-12)
        return float(GRID[np.flatnonzero(f1 >= f1.max() - 0.003)].mean()) if share > 0 else 0.5

    overall = best(told, rate(counts))
    out = {"": overall}
    for g, mine in told.groupby("lang"):
        if k := int(mine.loc[mine["y"], "n"].sum()):
            out[g] = (k * best(mine, rate(counts[counts["lang"] == g])) + 30 * overall) / (k + 30)
    return out


def judged(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, float], DataFrame]:
    """(doc_id, source, lang, score, place) of every document, the thresholds by language, and the held-out labels."""
    net, told, rows = train(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("words").to_pylist()
            p = np.where([not w for w in words], 0.0, _scored(shared.value, words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), pa.array(p, pa.float64()), pa.array(np.searchsorted(GRID, p, "right"), pa.int32())], ["doc_id", "source", "lang", "score", "place"])

    docs = rows.select("doc_id", "source", "lang", "words")
    scored = docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, source string, lang string, score double, place int")
    scored = materialize(scored, "scored")
    counts = scored.groupBy("lang", "place").agg(F.count("*").alias("n")).toPandas()  # at most languages x places
    return scored, thresholds(placed(told), counts), told


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, lang, score, flagged) of every document.

    The text decides, labels serve only for training and thresholds. Null and blank texts score 0; the language is that of the
    document's notation, with one threshold for all that are missing or unknown. Null ids are left out, repeated ids count
    once; without any abusive label nothing is flagged. Whole texts are scored, code and table cells behind the prose, long ones
    in overlapping stretches, and no text lowers the score of another part.
    """
    scored, limit, _ = judged(documents, labels)
    of = F.create_map(*[x for g, t in limit.items() for x in (F.lit(g), F.lit(t))])
    return scored.withColumn("flagged", F.col("score") >= F.coalesce(F.element_at(of, F.col("lang")), F.lit(limit[""]))).drop("place")


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per language: its threshold, the held-out labels, those taken for slips, and recall and precision of held-out scores on all labels and without slips."""
    _, limit, told = judged(documents, labels)
    out = []
    for lang in sorted(r.lang for r in told.select("lang").distinct().collect()):
        t = limit.get(lang, limit[""])
        hit, bad, own = F.col("held") >= t, F.col("y"), ~F.col("slip")
        r = told.where(F.col("lang") == lang).agg(*[F.count_if(x) for x in (bad, ~bad, bad & ~own, ~bad & ~own, hit & bad, hit, hit & bad & own, bad & own, hit & own)]).first()
        out.append((lang, float(t), *r[:4], r[4] / max(1, r[0]), r[4] / max(1, r[5]), r[6] / max(1, r[7]), r[6] / max(1, r[8])))
    names = "lang string, threshold double, abusive_labels bigint, ordinary_labels bigint, abusive_slips bigint, ordinary_slips bigint, recall double, precision double, recall_without_slips double, precision_without_slips double"
    return documents.sparkSession.createDataFrame(out, names)


def rates(scored: DataFrame) -> DataFrame:
    """Per source: documents, flagged ones, their rate and the mean score."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("int")).alias("rate"), F.avg("score").alias("mean_score"))

"""Broken answers: empty, refused, copied, cut off or in the wrong language.

A multi-label linear classifier decides. It sees hashed word n-grams of the answer, hashed shapes of its last signs, and
features of the pair: what answer, instruction and source share, which of the source's names and numbers return, how well the answer's words fit the
language asked for. What refusals, ends and languages look like is learned, from answers of the tables at hand and synthetic defects
made from them; thresholds are calibrated on held-out ones.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.session import materialize

LABELS = ("empty", "refusal", "copy", "truncated", "wrong_language")
#: Answers, and signs of answers and sources, that one task trains on, in the mean; all are trained on, in as many blocks as that takes.
BLOCK, BLOCK_SIGNS = 8_000, 32_000_000
#: Pairs from which training goes over them fewer times, with as many steps in all; buckets of the n-grams and of the shapes of ends.
ENOUGH, BUCKETS, SHAPES, SEED = 8_000, 1 << 15, 1 << 13, 11
#: Parts that the weights are summed up in, and most tasks that train.
PARTS, MOST_TASKS = 64, 10_000
#: Thresholds tried, and those tried for refusals in another language.
GRID, FOREIGN = np.linspace(0.5, 0.8, 13), np.linspace(0.1, 0.95, 35)

#: Words for nothing.
NOTHING = frozenset(
    "na n/a nan nil none null nul nulle undefined empty vide aucun aucune rien néant nothing ninguno ninguna nada vacío keine keiner leer nichts s/o so todo tbd -".split()
)
#: Names of the languages, as an instruction gives them.
NAMES = {"fr": r"fran[çc]ais(?:e|es)?|french", "en": r"anglais(?:e|es)?|english", "es": r"espagnole?s?|spanish|español", "de": r"allemande?s?|german|deutsch"}
_ANY = "|".join(NAMES.values())
ASKED = re.compile(rf"(?:\b(?:in)?to|\ben|\bin|\bvers l[e'’]?\s*|\bvers|\bversion|\btranslation)\s*(?:l['’]|le |la )?\b({_ANY})\b", re.I)
FROM = re.compile(rf"(?:\bfrom|\bde l['’]|\bdu|\bde)\s*({_ANY})\b", re.I)
WORD, STOP, PAUSE = re.compile(r"[^\W_]+"), re.compile(r"[.!?](?=\s|\Z)"), re.compile(r"[,;:]")

#: Refusals that training makes: how they begin, what they decline, and their reasons.
REFUSE = {
    "en": (
        ("I'm sorry, but", "Sorry,", "I apologize, but", "Unfortunately,", "I regret to say", "My apologies,", "As an AI assistant,", "As a language model,", ""),
        ("I cannot", "I can't", "I am unable to", "I'm not able to", "I must decline to", "I won't", "I am not allowed to", "I would rather not", "it is not possible for me to", "I do not want to", "I have been told not to"),
        ("translate this text.", "help with that request.", "provide this translation.", "process this content.", "assist with this topic.", "answer this question.", "comply.", "work on this document."),
        ("", "It may contain sensitive information.", "This goes against my guidelines.", "It violates my usage policy.", "Please contact a professional.", "Please rephrase your request.", "No answer will be given.", "Is there anything else I can help you with?"),
    ),
    "fr": (
        ("Je suis désolé, mais", "Désolé,", "Navré,", "Malheureusement,", "Je regrette,", "Toutes mes excuses,", "En tant qu'assistant,", "En tant que modèle de langage,", ""),
        ("je ne peux pas", "je ne suis pas en mesure de", "il m'est impossible de", "je dois décliner et ne vais pas", "je refuse de", "je ne suis pas autorisé à", "je préfère ne pas", "je ne veux pas", "je ne saurais", "on m'a demandé de ne pas"),
        ("traduire ce texte.", "répondre à cette demande.", "fournir cette traduction.", "traiter ce contenu.", "vous aider sur ce sujet.", "reproduire ce document.", "prendre en charge cette requête."),
        ("", "Il contient des informations sensibles.", "Cela est contraire à mes règles d'utilisation.", "Adressez-vous à un traducteur.", "N'hésitez pas à reformuler votre demande.", "Aucune réponse ne sera donnée.", "Souhaitez-vous autre chose ?"),
    ),
    "es": (("Lo siento, pero", "Lamentablemente,", ""), ("no puedo", "no me es posible", "debo negarme a"), ("traducir este texto.", "ayudar con esta solicitud."), ("", "Va en contra de mis normas.")),
    "de": (("Es tut mir leid, aber", "Leider", ""), ("kann ich nicht", "darf ich nicht", "muss ich ablehnen und werde nicht"), ("diesen Text übersetzen.", "bei dieser Anfrage helfen."), ("", "Das verstößt gegen meine Richtlinien.")),
    "en, of the task": (("", "Sorry.", "Unfortunately,"), ("this request", "this task", "such content", "what is asked here"), ("is against", "falls outside", "does not respect", "conflicts with"), ("my rules", "what I may do", "the policy I follow", "my role"), (".", ", so nothing will be translated.", "; no answer will be given.", ". Ask someone else.")),
    "fr, of the task": (("", "Désolé.", "Malheureusement,"), ("cette demande", "cette tâche", "un tel contenu", "ce qui est demandé ici"), ("va à l'encontre de", "sort de", "ne respecte pas", "est hors de"), ("mes règles", "mon rôle", "ce que j'ai le droit de faire", "la politique que je suis"), (".", ", rien ne sera traduit.", " ; aucune réponse ne sera donnée.", ". Demandez à quelqu'un d'autre.")),
}
#: What training puts behind complete answers, which stay complete.
BEHIND = ("\n", "\n\n  ", "\n\n---", "\n\n***", "\n\n— fin —", "\n\n— end —", "\n\n---\nEnd of text.", "\n\n---\nFin du texte.", "\n\n**Notes :**\n- Le sens est gardé.", "\n\n**Notes:**\n- Names are kept.", "\n\nNote: names are kept as they are.", "\n\nRemarque : les noms restent tels quels.")
#: Names of the JSON fields that hold the answer proper, not its title or what goes with it.
CONTENT = re.compile(r"(?:^|_)(?:content|text|body|translation|answer|response|contenu|texte|traduction|r[ée]ponse)$", re.I)

def payload(response: str | None) -> tuple[str, bool, bool]:
    """The text of an answer, whether it is JSON, and whether that JSON is damaged; a damaged one's text is read as far as it goes."""
    s = response or ""
    t = s.strip()
    if t[:1] not in ("{", "["):
        return s, False, False
    try:
        value = json.loads(t)
    except ValueError:
        if not re.match(r'\{\s*"', t):
            return s, False, False
        cut = max(t.rfind('": "'), t.rfind('":"'))
        body = t[cut + 3:].lstrip('" ') if cut >= 0 else t
        return re.sub(r"\\u[0-9a-f]{4}", "x", body.replace("\\n", "\n").replace('\\"', '"')), True, True
    if isinstance(value, dict):
        texts = [v for v in value.values() if isinstance(v, str)]
        return (max(texts, key=len) if texts else ""), True, False
    return (" ".join(map(str, value)) if isinstance(value, list) else str(value)), True, False


def strings(value: object, name: str = "") -> Iterator[tuple[str, str]]:
    """(field, text) of all values in a JSON value, nested ones too; those in a list carry the list's field, nothing is an empty text."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from strings(v, k)
    elif isinstance(value, list) and value:
        for v in value:
            yield from strings(v, name)
    else:
        yield name, "" if value is None or value in ([], {}) else str(value)


def contents(response: str | None) -> tuple[str, list[str], bool, bool]:
    """The text that answers, all other texts of a JSON answer, whether it is JSON, and whether that JSON is damaged.

    In JSON the longest field named as content answers, even if it is blank, else the longest text of all.
    """
    s = response or ""
    t = s.strip()
    if t[:1] not in ("{", "["):
        return s, [], False, False
    try:
        found = list(strings(json.loads(t)))
    except ValueError:
        text, is_json, damaged = payload(response)
        return text, [], is_json, damaged
    named = [i for i, (k, v) in enumerate(found) if CONTENT.search(k)]
    main = max(named or range(len(found)), key=lambda i: len(found[i][1]))
    return found[main][1], [v for i, (_, v) in enumerate(found) if i != main], True, False


def asked_language(asked: str) -> str | None:
    """The language an instruction asks for: the last it names as a target, else the one it does not translate from."""
    hits = ASKED.findall(asked)
    if hits:
        return next(k for k, p in NAMES.items() if re.fullmatch(p, hits[-1], re.I))
    sources = {next(k for k, p in NAMES.items() if re.fullmatch(p, h, re.I)) for h in FROM.findall(asked)}
    return {"fr": "en", "en": "fr"}.get(next(iter(sources))) if len(sources) == 1 else None


class Profiles:
    """Words of each language with the logarithm of their frequency, learned from answers by the language they were asked for.

    A word belongs to a language if ``SEEN`` of its answers hold it, and two more: some answers are in another language than asked for.
    """

    SEEN = 0.005

    def __init__(self, texts: list[tuple[str, list[str]]] = (), least: int = 2_000):
        by: dict[str, Counter] = {}
        held: dict[str, Counter] = {}
        answers: Counter = Counter()
        for lang, words in texts:
            words = [w for w in words if w.isalpha()]
            by.setdefault(lang, Counter()).update(words)
            held.setdefault(lang, Counter()).update(set(words))
            answers[lang] += 1
        self.learn({k: {w: n for w, n in v.items() if held[k][w] >= self.least_held(answers[k])} for k, v in by.items()}, least)

    @classmethod
    def least_held(cls, answers):
        """How many of a language's answers hold a word that belongs to it."""
        return cls.SEEN * answers + 2

    def learn(self, by: dict[str, dict[str, int]], least: int = 2_000) -> None:
        """Profiles from the counts of each language's words."""
        by = {k: v for k, v in by.items() if sum(v.values()) >= least}  # with fewer words a language has no profile
        self.langs = sorted(by)
        size = len(set().union(*by.values())) + 1 if by else 1
        total = {k: sum(v.values()) for k, v in by.items()}
        self.none = {k: float(np.log(0.1 / (total[k] + 0.1 * size))) for k in by}
        self.log = {k: {w: float(np.log((n + 0.1) / (total[k] + 0.1 * size))) for w, n in v.items()} for k, v in by.items()}

    def fit(self, want: str | None, have: Counter, known: Counter) -> tuple[float, float, int]:
        """Mean advantage of the wanted language's profile over the best other one, share of words it knows, and words judged; names that the source has are left out."""
        if want not in self.log:
            return 0.0, 1.0, 0
        words = {w: n for w, n in have.items() if w.isalpha() and w not in known} or {w: n for w, n in have.items() if w.isalpha()}
        total = sum(words.values())
        if not total:
            return 0.0, 1.0, 0
        sums = {k: sum(n * of.get(w, self.none[k]) for w, n in words.items()) / total for k, of in self.log.items()}
        other = max((v for k, v in sums.items() if k != want), default=sums[want])
        mine = self.log[want]
        return sums[want] - other, sum(n for w, n in words.items() if w in mine) / total, total


@lru_cache(50_000)
def _asked(asked: str) -> tuple[list[str], str | None, str]:
    """Words of an instruction, the language it asks for, and the words in one."""
    words = WORD.findall(asked.lower())
    return words, asked_language(asked), "".join(words)


def quoted(prompt: str) -> tuple[str, str]:
    """(instruction, quoted source) of a prompt that carries its source between quotation marks."""
    m = re.search(r"[:\n]\s*(['\"«“])(.*)(['\"»”])\s*\Z", prompt, re.S)
    return (prompt[:m.start()], m[2]) if m else (prompt, "")


@lru_cache(50_000)
def shape(text: str) -> str:
    """``text`` with letters as a or A, digits as 0; signs and line feeds stay."""
    return "".join("\n" if c == "\n" else " " if c.isspace() else "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in text)


@lru_cache(50_000)
def _tails(end: str) -> list[str]:
    return [f"{k}{end[-k:]}" for k in range(1, 7)]


def ending(text: str) -> tuple[list[float], list[str]]:
    """How a text ends: what is open (a fence, a backtick, a table row), no punctuation at all; and names of its shape, from the last signs inwards."""
    bare = text.rstrip(" \t\n\r\f\v\xa0\u200b\ufeff")
    last = bare.rpartition("\n")[2].strip()
    fences = bare.count("```")
    code = fences % 2 == 0 and bare.endswith("```")
    row = last.startswith("|")
    open_row = row and (not last.endswith("|") or last.count("|") < next(x for x in bare.split("\n") if x.strip().startswith("|")).count("|"))
    odd_tick = not code and fences % 2 == 0 and last.count("`") % 2 == 1
    plain = len(text) > 200 and not STOP.search(text) and not PAUSE.search(bare[-400:])
    kind = "code" if code else "row" if row else "fence" if fences % 2 else "head" if last.startswith("#") else "item" if last[:2] in ("- ", "* ") else "text"
    alone = "more" if "\n" in bare else "alone"
    end, near = shape(bare[-6:]), bare[-12:].split()
    names = [*_tails(end), f"c{bare[-1:]}", f"w{near[-1].lower() if near else ''}", f"k{kind}{alone}", f"k{kind}{end[-1:]}{alone}", f"p{plain}{end[-1:]}"]
    return [float(fences % 2), float(odd_tick), float(open_row), float(plain)], names


DENSE = 40


@lru_cache(50_000)
def numbered(word: str) -> bool:
    return any(c.isdigit() for c in word)


#: Whether a code point is part of a word, 2 where not looked at so far; a number whose powers tell words apart, signs that are taken together.
_INSIDE, _BASE, SIGNS = np.full(0x110000, 2, np.uint8), 0x2545F4914F6CDD1D, 1 << 20


@lru_cache(2)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a number, and of its inverse, modulo 2 ** 64."""
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full((1 << bits) - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


class Spoken:
    """Words of lowered texts as ``WORD`` finds them: a number of 64 bits for each, the first word of each text, and the letters of all in a row."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = _INSIDE.take(points)
        if inside.max() == 2:
            for p in np.unique(points[inside == 2]).tolist():
                _INSIDE[p] = chr(p).isalnum()
            inside = _INSIDE.take(points)
        edges = np.flatnonzero(inside[1:] != inside[:-1])  # the signs before words, and their last ones
        begin, end = edges[::2], edges[1::2]
        power, inverse = powers(max(18, len(points).bit_length()))
        total = np.cumsum(points * power[:len(points)])
        self.words = (total[end] - total[begin]) * inverse[begin]
        self.at = np.r_[0, np.cumsum(end - begin)]
        self.letters = points[inside.view(bool)].tobytes().decode("utf-32-le", "surrogatepass")
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first, self.begin = np.searchsorted(begin, self.starts), begin

    def word(self, i: int) -> str:
        return self.letters[self.at[i]:self.at[i + 1]]

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word among the different ones, and a place of each of these."""
        return numbered_apart(self.words)


def numbered_apart(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each key among the different ones, and a place of each of these."""
    order = np.argsort(keys)
    of = keys[order]
    first = np.r_[True, of[1:] != of[:-1]][:len(of)]
    out = np.empty(len(of), np.int64)
    out[order] = np.cumsum(first) - 1
    return out, order[first]


def together(rows: list, signs: list[int]) -> Iterator[list]:
    """Rows in turn, up to 1,000 at once, fewer where they are long."""
    some, held = [], 0
    for row, n in zip(rows, signs):
        if some and (len(some) == 1_000 or held + n > SIGNS):
            yield some
            some, held = [], 0
        some.append(row)
        held += n
    if some:
        yield some


class Words(dict):
    """Words by their numbers of 64 bits, and of each its hash, whether it has letters only, whether sound answers keep it, and its place in each language's profile."""

    def __init__(self, profiles: Profiles):
        super().__init__()
        self.profiles, self.new, n = profiles, [], len(profiles.log)
        self.digits = (zlib.crc32(b"#"), False, True, *[1.0] * n)  # profiles have words of letters only
        self.told = np.empty(0, np.uint32), np.empty(0, bool), np.empty(0, bool), np.empty((n, 0)), np.empty((n, 0), bool)

    def add(self, number: int, w: str) -> int:
        plain = w.isalpha()
        digits = not plain and (w.isascii() or numbered(w))  # a word of ASCII signs that are not all letters has a digit
        if digits:
            self.new.append(self.digits)
        else:
            self.new.append((zlib.crc32(w.encode("utf-8", "surrogatepass")), plain, len(w) > 6, *[of.get(w, 1.0) for of in self.profiles.log.values()]))  # logarithms of frequencies are below 0
        self[number] = at = len(self)
        return at

    def table(self, spoken: Spoken, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the words at these places: hashes, whether they have letters only, whether they are names, numbers or identifiers, which sound answers keep, and by language the logarithm of their frequency and whether the profile has them."""
        numbers = spoken.words[places].tolist()
        known = list(map(self.get, numbers))
        for i, at in enumerate(known):
            if at is None:
                known[i] = self.add(numbers[i], spoken.word(places[i]))
        if self.new:
            new = np.array(self.new, float).T
            log, none = new[3:], np.array([self.profiles.none[k] for k in self.profiles.log]).reshape(-1, 1)
            parts = new[0].astype(np.uint32), new[1] > 0, new[2] > 0, np.where(log <= 0, log, none), log <= 0
            self.told = tuple(np.concatenate(x, axis=-1) for x in zip(self.told, parts))
            self.new = []
        return tuple(x.take(known, axis=-1) for x in self.told)


_words = lru_cache(1)(Words)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each occurs."""
    keys = np.sort(keys.astype(np.int32) if keys.max(initial=0) < 1 << 31 else keys)  # the narrower, the faster
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
    return keys[first], np.diff(np.r_[first, len(keys)])


def _looked_up(keys: np.ndarray, counted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often each key occurs among those counted."""
    of, n = counted
    if not len(of):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(of, keys), len(of) - 1)
    return np.where(of[at] == keys, n[at], 0)


def features(asked: str, source: str, response: str | None, profiles: Profiles) -> tuple[np.ndarray, list[str], list[str]]:
    """Features of a pair, the answer's words, those of all its JSON fields, and the shape of its end; emptiness and ending are those of its content."""
    x, names, _, _ = featured([(asked, source, response)], profiles)
    text, others, _, _ = contents(response)
    return x[0], WORD.findall("\n".join([text, *others]).lower()), names[0]


def featured(rows: list[tuple[str, str, str | None]], profiles: Profiles) -> tuple[np.ndarray, list[list[str]], np.ndarray, np.ndarray]:
    """Features of each of some pairs, the shapes of their ends, and the buckets of all n-grams with their pairs."""
    x = np.zeros((len(rows), DENSE))
    names, flags, langs = [], [], list(profiles.log)
    asks: dict[str, int] = {}
    sources: dict[str, int] = {}
    of_ask, of_src, want = [], [], []
    told, texts, ends = [], [], []
    for asked, source, response in rows:
        text, others, is_json, damaged = contents(response)
        low = text.lower()
        told.append((text, is_json, damaged))
        texts.append("\n".join([low, *others]).lower() if others else low)
        ends.append(len(low))
        of_ask.append(asks.setdefault(asked, len(asks)))
        of_src.append(sources.setdefault(source, len(sources)))
        lang = _asked(asked)[1]
        want.append(langs.index(lang) if lang in profiles.log else -1)
    of_ask, of_src, want = (np.array(v, np.int64) for v in (of_ask, of_src, want))
    spoken = Spoken([*texts, *(a.lower() for a in asks), *(s.lower() for s in sources)])
    first, letters = spoken.first, spoken.letters
    until = spoken.at[first]
    main_until = spoken.at[np.searchsorted(spoken.begin, spoken.starts[:len(rows)] + ends)].tolist()
    joined_src = [letters[i:j] for i, j in zip(until[len(rows) + len(asks):].tolist(), until[len(rows) + len(asks) + 1:].tolist())]
    size, ask_size, src_size = np.split(np.diff(first), [len(rows), len(rows) + len(asks)])
    until = until.tolist()
    for i, (text, is_json, damaged), n, m, j, (asked, _, _) in zip(range(len(rows)), told, size.tolist(), src_size[of_src].tolist(), of_src.tolist(), rows):
        joined = letters[until[i]:until[i + 1]]
        main = joined if main_until[i] == until[i + 1] else letters[until[i]:main_until[i]]
        # no word for nothing has 16 signs
        nothing = not main or len(main) < 16 and (text.strip().strip(".`'\"«» -_*").lower() in NOTHING or main in NOTHING)
        ask, _, joined_ask = _asked(asked)
        copied = n >= 3 and (len(main) > 15 and main in joined_ask or len(joined) > 15 and (joined in joined_ask or joined_ask in joined and len(ask) > 4 and n < 1.5 * len(ask)))
        src = joined_src[j]
        whole = m > 4 and n > 0 and (src in joined or len(main) > 60 and main in src or len(joined) > 60 and joined in src)
        opened, end = ending(text) if not nothing else ([0.0] * 4, ["nothing"])
        names.append(end)
        flags.append((nothing, is_json, copied, whole, damaged, *opened))
    x[:, [0, 1, 8, 9, 25, 26, 27, 28, 29]] = flags
    if len(_words(profiles)) > 200_000:
        _words.cache_clear()
    ids = _words(profiles)  # kept for words that come again
    numbers, places = spoken.numbers()
    hashes, plain, kept_ones, log, knows = ids.table(spoken, places)
    flat, flat_ask, flat_src = np.split(numbers, first[[len(rows), len(rows) + len(asks)]])
    hard = np.flatnonzero(kept_ones[flat_src])
    flat_hard, hard_size = flat_src[hard], np.bincount(np.repeat(np.arange(len(sources)), src_size)[hard], minlength=len(sources))
    k = max(1, len(places))
    row = np.repeat(np.arange(len(rows)), size)
    have = _counted(row * k + flat)
    at, word, times = have[0] // k, have[0] % k, have[1]
    total = lambda v: np.bincount(at, v, len(rows))
    in_src = _looked_up(of_src[at] * k + word, _counted(np.repeat(np.arange(len(sources)), src_size) * k + flat_src))
    in_ask = _looked_up(of_ask[at] * k + word, _counted(np.repeat(np.arange(len(asks)), ask_size) * k + flat_ask))
    n, m, a = size, src_size[of_src], ask_size[of_ask]
    common, from_ask, from_any = total(np.minimum(times, in_src)), total(np.minimum(times, in_ask)), total(times * ((in_src > 0) | (in_ask > 0)))
    share_ask, cover_ask = from_ask / np.maximum(1, n), from_ask / np.maximum(1, a)
    share_src, cover_src, share_any = common / np.maximum(1, n), common / np.maximum(1, m), from_any / np.maximum(1, n)
    x[:, 2], x[:, 3], x[:, 4] = share_ask > 0.7, share_ask > 0.9, (cover_ask > 0.85) & (n < 3 * a + 3)
    x[:, 5], x[:, 6], x[:, 7] = share_any > 0.8, share_any > 0.92, (share_any > 0.92) & (cover_src > 0.3)
    x[:, 10], x[:, 11], x[:, 12], x[:, 13] = share_src, cover_src, share_any, share_ask
    # how well the words fit the language asked for, as in ``Profiles.fit``
    own = plain[word] & (in_src == 0)
    own = np.where(total(own)[at] > 0, own, plain[word]) & (want[at] >= 0)
    judged = total(times * own)
    some = np.maximum(judged, 1)
    margin, known = np.zeros(len(rows)), np.ones(len(rows))
    if langs:
        fits = np.stack([total(times * own * of[word]) / some for of in log])
        mine = fits[want, np.arange(len(rows))]
        fits[want, np.arange(len(rows))] = -np.inf
        if len(langs) > 1:
            margin = np.where(judged > 0, mine - fits.max(axis=0), 0.0)
        known = np.where(judged > 0, total(times * (own & knows[want[at], word])) / some, 1.0)
    sure = np.minimum(1.0, judged / 12)
    x[:, 14], x[:, 15], x[:, 16], x[:, 17] = sure * np.clip(margin, -4, 4) / 2, sure * (margin < 0), sure * (1 - known), sure * (margin < 0) * (share_any < 0.8)
    x[:, 34], x[:, 35], x[:, 36], x[:, 37], x[:, 38] = sure * (margin < 1), sure * (margin < 2), sure * (known < 0.97), sure * (known < 0.9), sure * (known < 0.75)
    x[:, 39] = (judged > 20) & ((margin < 2) | (known < 0.9))
    x[:, 18], x[:, 19], x[:, 20] = (0 < n) & (n < 12), (0 < n) & (n < 45), (n > 0) & (m > 20) & (n < 0.35 * m)
    h = hard_size[of_src]
    begin = np.r_[0, np.cumsum(h)]
    each = np.repeat(np.arange(len(rows)), h)
    place = np.arange(begin[-1]) - begin[each]
    held = _looked_up(each * k + flat_hard[(np.r_[0, np.cumsum(hard_size)][of_src])[each] + place], have) > 0
    part = np.maximum(2, h // 8)
    kept, last, first = (np.bincount(each, held & v, len(rows)) for v in (True, place >= (h - part)[each], place < part[each]))
    x[:, 21], x[:, 22], x[:, 23], x[:, 24] = kept / np.maximum(1, h), (h > 0) & (kept == 0), (h > 0) & (last == 0), (h > 0) & (first == 0)
    x[:, 30] = np.where(x[:, 29] != 0, x[:, 23], 0)
    x[:, 31] = (0 < n) & (n < 60) & (share_any < 0.5) & ((x[:, 22] > 0) | (h == 0))
    x[:, 32] = (x[:, 29] == 0) & (x[:, 23] > 0)
    x[:, 33] = 1
    # words and pairs of neighbours; words with digits count as one
    one = hashes[flat]
    two = ((one[:-1] * np.uint32(0x9E3779B1)) ^ one[1:])[row[1:] == row[:-1]]
    return x.astype(np.float32), names, (np.concatenate([one, two]) % np.uint32(BUCKETS)).astype(np.int64), np.concatenate([row, row[1:][row[1:] == row[:-1]]])


#: Which features speak for which label: profiles alone tell the language, how an answer ends tells only a cut, and the language says nothing about a refusal.
_LANGUAGE = [*range(14, 18), *range(34, 40)]
SEEN_D, SEEN_W, SEEN_V = np.ones((DENSE, len(LABELS)), np.float32), np.array([x != "wrong_language" for x in LABELS], np.float32), np.array([x == "truncated" for x in LABELS], np.float32)
SEEN_D[_LANGUAGE, LABELS.index("refusal")] = 0
SEEN_D[[*range(1, 10), *range(18, 33)], LABELS.index("wrong_language")] = 0


@lru_cache(200_000)
def _shape_bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % SHAPES


class Bags:
    """Buckets of many lists, each list's different ones in a row from ``starts``, and how often it has them, over its length to a power."""

    CELL = np.dtype([("at", np.int32), ("share", np.float32)])

    def __init__(self, starts: np.ndarray, at: np.ndarray, share: np.ndarray):
        self.starts, self.cells = starts, np.empty(len(at), self.CELL)
        self.at, self.share = self.cells["at"], self.cells["share"]
        self.at[:], self.share[:] = at, share

    @classmethod
    def of(cls, flat: np.ndarray, rows: np.ndarray, n: int, buckets: int, power: float) -> Bags:
        """From the buckets of ``n`` lists, with each one's list."""
        key, times = _counted(rows * buckets + flat)
        row = key // buckets
        share = times.astype(np.float32) / (np.maximum(np.bincount(rows, minlength=n), 1) ** power).astype(np.float32)[row]
        return cls(np.searchsorted(row, np.arange(n + 1)), key % buckets, share)

    @classmethod
    def joined(cls, parts: list[Bags]) -> Bags:
        ends = np.cumsum([0, *(p.starts[-1] for p in parts)])
        return cls(np.concatenate([*(p.starts[:-1] + e for p, e in zip(parts, ends)), ends[-1:]]), np.concatenate([p.at for p in parts]), np.concatenate([p.share for p in parts]))

    def take(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the picked lists start, each with its cells, in their order."""
        starts = self.starts.take(pick)
        size = self.starts.take(pick + 1) - starts
        ends = size.cumsum()
        flat = (starts - ends + size).repeat(size)
        flat += np.arange(len(flat))
        return np.r_[0, ends], self.cells.view(np.int64).take(flat).view(self.CELL), size

    def some(self, pick: np.ndarray) -> Bags:
        """The picked lists in their order."""
        starts, cells, _ = self.take(pick)
        return Bags(starts, cells["at"], cells["share"])

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def mass(self, table: np.ndarray) -> np.ndarray:
        """Sum of the table's rows for each list, weighted by the shares."""
        rows, at, n = self.rows(), self.at.astype(np.intp), len(self.starts) - 1
        return np.stack([np.bincount(rows, c.take(at) * self.share, n) if c.any() else np.zeros(n) for c in np.ascontiguousarray(table.T)], axis=1)


Made = tuple[np.ndarray, Bags, Bags]


class Linear:
    """One logistic unit a label over dense features, mean n-grams and shapes of ends, trained by adaptive gradient steps."""

    def __init__(self):
        k = len(LABELS)
        self.D, self.W, self.V = np.zeros((DENSE, k), np.float32), np.zeros((BUCKETS, k), np.float32), np.zeros((SHAPES, k), np.float32)
        self.limit, self.foreign, self.profiles = np.full(k, 0.5), 0.5, Profiles()

    def made(self, rows: list[tuple[str, str, str | None]]) -> Made:
        dense, grams, ends = [], [], []
        for some in together(rows, [len(source) + len(response or "") for _, source, response in rows]):
            x, names, flat, at = featured(some, self.profiles)
            dense.append(x)
            grams.append(Bags.of(flat, at, len(x), BUCKETS, 0.5))
            size = [len(v) for v in names]
            ends.append(Bags.of(np.fromiter(map(_shape_bucket, chain.from_iterable(names)), np.int64, sum(size)), np.repeat(np.arange(len(x)), size), len(x), SHAPES, 0.0))
        return np.concatenate(dense), Bags.joined(grams), Bags.joined(ends)

    def probabilities(self, made: Made) -> np.ndarray:
        dense, grams, ends = made
        return 1 / (1 + np.exp(-(dense @ self.D + grams.mass(self.W) + ends.mass(self.V))))

    def fit(self, made: Made, y: np.ndarray, epochs: int = 12, of: np.ndarray | None = None) -> None:
        """Gradient steps over pairs, or those ``of`` them; at random a pair goes without its n-grams or without its dense features, so that neither rests on the other."""
        r = np.random.default_rng(SEED)
        sums = np.full_like(self.D, 1e-2)
        dense, grams, ends = made
        of = np.arange(len(y)) if of is None else of
        # n-grams and, behind them, shapes in one table, only of the labels that n-grams speak for; shapes speak for some of these
        labels = np.flatnonzero(SEEN_W)
        table = np.ascontiguousarray(np.concatenate([self.W, self.V])[:, labels])
        squares = np.repeat(np.array([1e-5, 1e-3], np.float32), [BUCKETS, SHAPES])[:, None] * np.ones((1, len(labels)), np.float32)
        whole = f"V{4 * len(labels)}"  # a row at a time
        seen, place, count = np.zeros(len(table), bool), np.empty(len(table), np.intp), np.arange(len(table))
        refusal_copy, wrong = [LABELS.index("refusal"), LABELS.index("copy")], LABELS.index("wrong_language")
        for _ in range(epochs):
            order, u = r.permutation(len(of)), r.random(len(of))
            pick = of[order]
            xs, ys = dense[pick] * (u > 0.15)[:, None], y[pick]
            free = ys[:, refusal_copy].any(axis=1)  # their language is not judged
            bags = []
            for bag, own, behind in ((grams, np.flatnonzero(u < 0.6), 0), (ends, np.arange(len(pick)), BUCKETS)):
                starts, cells, size = bag.take(pick[own])
                bags.append((starts[np.searchsorted(own, np.arange(0, len(pick) + 64, 64))].tolist(), cells, (own % 64).repeat(size), behind))
            for s in range(0, len(pick), 64):
                x, parts = xs[s:s + 64], []
                for starts, cells, rows, behind in bags:
                    cut = slice(starts[s // 64], starts[s // 64 + 1])
                    buckets = cells["at"][cut].astype(np.intp)
                    buckets += behind
                    seen[buckets] = True
                    parts.append((buckets, cells["share"][cut], rows[cut]))
                at = seen.nonzero()[0]
                seen[at] = False
                place[at] = count[:len(at)]
                shares = np.zeros((len(x), len(at)), np.float32)
                for buckets, share, rows in parts:
                    spots = rows * len(at)
                    spots += place.take(buckets)
                    shares.reshape(-1)[spots] = share
                now = table.take(at, axis=0)
                z = x @ self.D
                z[:, labels] += shares @ now
                d = (1 / (1 + np.exp(-z)) - ys[s:s + 64]) / np.float32(len(x))
                d[free[s:s + 64], wrong] = 0
                g = (x.T @ d + np.float32(1e-4) * self.D) * SEEN_D
                sums += g * g
                self.D -= np.float32(0.3) * g / np.sqrt(sums)
                g = shares.T @ d[:, labels]
                g[at.searchsorted(BUCKETS):] *= SEEN_V[labels]
                g += np.float32(1e-4) * now
                root = squares.take(at, axis=0)
                root += g * g
                squares.view(whole)[at, 0] = root.view(whole)[:, 0]
                g *= np.float32(0.1)
                g /= np.sqrt(root, out=root)
                now -= g
                table.view(whole)[at, 0] = now.view(whole)[:, 0]
        self.W[:, labels], self.V[:, labels] = np.split(table, [BUCKETS])

    def decide(self, made: Made) -> tuple[list[str | None], np.ndarray]:
        """The defect of each pair, the likeliest of those over their thresholds, and its probability.

        Refusals and copies are in no wrong language; an answer in another language has a threshold of its own for a refusal.
        """
        p = self.probabilities(made)
        over, other = p >= self.limit, p[:, LABELS.index("wrong_language")] >= self.limit[LABELS.index("wrong_language")]
        refusal, copy, wrong = (LABELS.index(x) for x in ("refusal", "copy", "wrong_language"))
        over[other, refusal] = p[other, refusal] >= self.foreign
        over[over[:, refusal] | over[:, copy], wrong] = False
        pick = np.where(over, p, -1).argmax(axis=1)
        any_ = over.any(axis=1)
        return [LABELS[k] if a else None for k, a in zip(pick, any_)], np.where(any_, p[np.arange(len(p)), pick], 1 - p.max(axis=1, initial=0))


def _one(some, r: np.random.Generator):
    return some[int(r.integers(0, len(some)))]


def _refusal(r: np.random.Generator) -> str:
    return " ".join(x for x in [_one(part, r) for part in REFUSE[_one(("en", "en", "fr", "fr", "es", "de", "en, of the task", "fr, of the task"), r)]] if x)


def _cut(text: str, r: np.random.Generator) -> str | None:
    """``text`` stopped inside a word, number or sentence; None where no such place is found."""
    for _ in range(8):
        if len(text) < 40:
            return None
        at = int(len(text) * r.uniform(0.1, 0.98))
        cut, rest = text[:at].rstrip(), text[at:]
        number = cut.endswith(".") and rest[:1].isdigit()
        if cut and rest.strip() and (number or cut[-1] not in ".!?:;…|*>\"'»)`]}" and text[len(cut)] != "\n"):
            return cut + ("\ufffd" if r.random() < 0.2 and not number else "")
    return None


def _foreign(text: str, source: str, r: np.random.Generator) -> str:
    """``text`` as if in a language without a profile: most of its words spelled anew, those of the source kept."""
    kept, new = set(WORD.findall(source.lower())), {}
    often = r.uniform(0.3, 1)

    def spelled(m: re.Match) -> str:
        w = m[0].lower()
        if w in kept or not w.isalpha():
            return m[0]
        if w not in new:
            signs = w + w[:2]
            new[w] = "".join([signs[i] for i in r.permutation(len(signs)).tolist()]) if r.random() < often else w
        return new[w]

    return WORD.sub(spelled, text)


def _part(text: str, r: np.random.Generator) -> str:
    """A few whole sentences of ``text``, from any place."""
    whole = re.split(r"(?<=[.!?])\s+", text)
    at = int(r.integers(0, len(whole)))
    return " ".join(whole[at:at + int(r.integers(1, 4))])


def synthetic(rows: list[tuple[str, str, str | None]]) -> tuple[list[tuple[str, str, str | None]], np.ndarray, np.ndarray]:
    """Pairs, their labels, and which of them are given ones: the given answers as sound, and defects made from them."""
    r = np.random.default_rng(SEED)
    out, y, given = [], [], []

    def add(row, label=None, own=False):
        out.append(row)
        y.append([float(x == label) for x in LABELS])
        given.append(own)

    by: dict[str | None, list] = {}
    for a, s, t in rows:
        by.setdefault(_asked(a)[1], []).append((a, t))
    asks = {k: [a for a, _ in v] for k, v in by.items() if k}
    for i, (a, s, t) in enumerate(rows):
        body, is_json, damaged = payload(t)
        if not WORD.search(body):
            add((a, s, t), "empty", True)
            continue
        add((a, s, t), None, True)
        want = _asked(a)[1]
        wrap = lambda v: json.dumps({"translated_title": "Document", "translated_content": v, "preserved_elements": []}, ensure_ascii=False)
        if i % 4 == 0 and not damaged:
            text = body + _one(BEHIND, r)
            add((a, s, wrap(text) if is_json and r.random() < 0.5 else text))
        if i % 4 == 2 and len(part := _part(body, r)) > 60 and part.rstrip().endswith((".", "!", "?")):
            add((a, s, part))  # short, but whole
        for kind in (i % 5, (i + 2) % 5):
            if kind == 0:
                cut = _cut(t if r.random() < 0.5 else body, r)
                if cut:
                    add((a, s, wrap(cut) if is_json and not cut.startswith("{") and r.random() < 0.7 else cut), "truncated")
            elif kind == 1:
                told = s if s and r.random() < 0.5 else a if r.random() < 0.6 else f"{s}\n\n{a}"
                style = r.integers(0, 5)
                told = told.upper() if style == 0 else f"> {told}" if style == 1 else f"Prompt: {told}" if style == 2 else told
                add((a, s, wrap(told) if is_json and r.random() < 0.7 else told), "copy")
            elif kind == 2:
                told = _refusal(r)
                add((a, s, wrap(told) if is_json and r.random() < 0.5 else told), "refusal")
            elif kind == 3:
                others, way = [k for k in by if k and want and k != want], r.random()
                if want and way < 0.4:
                    text = body if r.random() < 0.5 else payload(rows[int(r.integers(0, len(rows)))][2])[0]
                    text = _foreign(_part(text, r) if r.random() < 0.5 else text, s, r)
                    add((a, s, wrap(text) if is_json and r.random() < 0.7 else text), "wrong_language")
                elif others:  # the answer to another text, or the same answer to an instruction that asks for another language
                    other = _one(others, r)
                    if way < 0.6:
                        add((a, s, by[other][int(r.integers(0, len(by[other])))][1]), "wrong_language")
                    else:
                        add((asks[other][int(r.integers(0, len(asks[other])))], s, t), "wrong_language")
            else:
                add((a, s, _one(("", " ", "\n\n", "N/A", "null", "[]", "{}", "...", "-", "« »", "None", "```\n```", '{"translated_content": ""}'), r)), "empty")
    return out, np.array(y, np.float32).reshape(-1, len(LABELS)), np.array(given, bool)


def learned(rows: list[tuple[str, str, str | None]], profiles: Profiles) -> np.ndarray:
    """What a block of pairs teaches, as numbers that add up over blocks: weights, where they were learned, and costs of thresholds on held-out pairs.

    Given answers count as sound at first. Those that a classifier trained on the other half holds for surely defective take that
    label for the last training, doubtful ones are left out: so it learns from real defects too.
    """
    pairs, y, given = synthetic(rows)
    model = Linear()
    model.profiles = profiles
    dense, grams, ends = model.made(pairs)
    often = np.argsort(-np.bincount(grams.at, minlength=BUCKETS), kind="stable")  # here buckets are numbered by how many pairs have them, which keeps together what steps go over
    rank = np.argsort(often)
    grams = Bags(grams.starts, rank[grams.at], grams.share)
    times = lambda n: max(1, round(n * min(1, ENOUGH / len(y))))
    some = lambda at: (dense[at], grams.some(at), ends.some(at))
    fold, use = np.arange(len(y)) // 4 % 2, np.ones(len(y), bool)
    halves = [(mine, some(mine)) for mine in (np.flatnonzero(fold == k) for k in range(2))]
    for _ in range(3):
        p = np.zeros_like(y)
        for k in range(2):
            half = Linear()
            half.fit((dense, grams, ends), y, times(8), np.flatnonzero((fold != k) & use))
            mine, its = halves[k]
            if len(mine):
                p[mine] = half.probabilities(its)
        most = p.max(axis=1)
        y[given] = 0
        sure = given & (most >= 0.5)
        told = np.where(p[:, [LABELS.index("refusal"), LABELS.index("copy")]].max(axis=1, keepdims=True) >= 0.5, p * (np.array(LABELS) != "wrong_language"), p)
        y[sure, told[sure].argmax(axis=1)] = 1
        use = ~given | (most < 0.1) | (most >= 0.5)
    model.fit((dense, grams, ends), y, times(12), np.flatnonzero(use))
    sound, doubtful = given & (y.sum(axis=1) == 0) & use, ~use
    # a false alarm over an answer held for sound weighs more than a miss, as most answers are sound; doubtful ones count as much as misses
    cost = [[10 * (p[sound, k] >= t).sum() + (p[doubtful, k] >= t).sum() + ((p[:, k] < t) & (y[:, k] == 1)).sum() for t in GRID] for k in range(len(LABELS))]
    refusal, wrong = LABELS.index("refusal"), LABELS.index("wrong_language")
    foreign = []
    for limit in GRID:
        other = use & (p[:, wrong] >= limit)
        foreign.append([((p[:, refusal] >= t) & (y[:, wrong] == 1) & other).sum() + ((p[:, refusal] < t) & (y[:, refusal] == 1) & other).sum() for t in FOREIGN])
    table = np.concatenate([model.D, model.W[rank], model.V])
    return np.concatenate([table.ravel(), table.any(axis=1), y.sum(axis=0), np.ravel(cost), np.ravel(foreign)]).astype(np.float32)


def settled(total: np.ndarray, profiles: Profiles) -> Linear:
    """Classifier from the sums of ``learned`` over all blocks: each weight is the mean over the blocks that learned it, thresholds do best on all held-out pairs."""
    model, k = Linear(), len(LABELS)
    model.profiles = profiles
    rows = DENSE + BUCKETS + SHAPES
    table, blocks, y, cost, foreign = np.split(total, np.cumsum([rows * k, rows, k, k * len(GRID)]))
    table = table.reshape(rows, k) / np.maximum(blocks, 1)[:, None]
    model.D, model.W, model.V = (x.astype(np.float32) for x in np.split(table, [DENSE, DENSE + BUCKETS]))
    for i, c in enumerate(cost.reshape(k, -1)):
        # of thresholds that cost about the same, within a hundredth of what there is to find, the middle
        model.limit[i] = GRID[np.flatnonzero(c <= c.min() + 0.01 * y[i])].mean()
    at = np.searchsorted(GRID, model.limit[LABELS.index("wrong_language")] + 1e-9) - 1
    c = foreign.reshape(len(GRID), -1)[at]
    model.foreign = FOREIGN[np.flatnonzero(c <= c.min() + 0.01 * y[LABELS.index("refusal")])].mean()
    return model


def pairs_of(spark, sft: DataFrame | None, baseline: DataFrame | None, evals: DataFrame | None) -> DataFrame:
    """(record_kind, record_id, source_name, asked, source, response) of the tables given; null keys are left out.

    Rows that repeat a key have equal content and are not yet reduced here.
    """
    parts = []
    if sft is not None:
        parts.append(sft.where("example_id is not null").select(F.lit("sft").alias("record_kind"), F.col("example_id").cast("string").alias("record_id"), F.col("source").alias("source_name"), F.col("instruction").alias("asked"), F.col("context").alias("source"), F.col("response").alias("response")))
    if baseline is not None:
        parts.append(baseline.where("result_id is not null").select(F.lit("baseline").alias("record_kind"), F.col("result_id").cast("string").alias("record_id"), F.col("modele").alias("source_name"), F.col("prompt").alias("asked"), F.lit(None).cast("string").alias("source"), F.col("reponse").alias("response")))
    if evals is not None:
        e = evals.where("run_id is not null").select("run_id", "modele", F.explode("baseline_test").alias("t")).where("t.id is not null")
        parts.append(e.select(F.lit("eval").alias("record_kind"), F.concat_ws("/", "run_id", "t.id").alias("record_id"), F.col("modele").alias("source_name"), F.col("t.prompt").alias("asked"), F.lit(None).cast("string").alias("source"), F.col("t.response").alias("response")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _split(asked: str | None, source: str | None) -> tuple[str, str]:
    return (asked or "", source) if source is not None else quoted(asked or "")


def profiles_of(pairs: DataFrame) -> Profiles:
    """Profiles of the languages, from the words of all answers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, dict[str, int]] = {}  # how often answers have a word, times 2 ** 32, and how many have it
        answers: Counter = Counter()

        def told() -> pa.RecordBatch:
            rows = [(g, w, k >> 32, k & 0xFFFFFFFF) for g, of in by.items() for w, k in of.items()] + [(g, None, 0, k) for g, k in answers.items()]
            for x in (by, answers):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["lang", "word", "n", "held"])

        for b in batches:
            answered = [(lang, t) for a, s, t in zip(*(b.column(c).to_pylist() for c in ("asked", "source", "response"))) if (lang := _asked(_split(a, s)[0])[1])]
            for some in together(answered, [len(t or "") for _, t in answered]):
                langs = sorted({lang for lang, _ in some})
                answers.update(lang for lang, _ in some)
                spoken = Spoken([payload(t)[0].lower() for _, t in some])
                numbers, places = spoken.numbers()
                words, k = [spoken.word(i) for i in places.tolist()], max(1, len(places))
                at, times = _counted(np.repeat(np.arange(len(some)), np.diff(spoken.first)) * k + numbers)
                speaks = np.array([langs.index(lang) for lang, _ in some])[at // k]
                for i, lang in enumerate(langs):
                    word, n = at[speaks == i] % k, times[speaks == i]
                    total = np.bincount(word, n, k).astype(np.int64) * (1 << 32) + np.bincount(word, minlength=k)
                    of = by.setdefault(lang, {})
                    place = np.flatnonzero(total)
                    for j, v in zip(place.tolist(), total[place].tolist()):
                        if (w := words[j]).isalpha():
                            of[w] = of.get(w, 0) + v
            if sum(map(len, by.values())) > 300_000:
                yield told()
        yield told()

    words = pairs.select("asked", "source", "response").mapInArrow(count, "lang string, word string, n bigint, held bigint")
    words = materialize(words.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("held").alias("held")), "words")
    answers = {r.lang: r.held for r in words.where("word is null").collect()}  # at most the languages of NAMES
    by = {}
    for lang, n in answers.items():  # at most the mean number of words in an answer, over ``SEEN``
        rows = words.where((F.col("lang") == lang) & F.col("word").isNotNull() & (F.col("held") >= Profiles.least_held(n))).collect()
        by[lang] = {r.word: r.n for r in sorted(rows, key=lambda r: r.word)}
    out = Profiles()
    out.learn(by)
    return out


def trained(pairs: DataFrame) -> Linear:
    """Classifier learned from all answers, equal pairs once; without any answer it stays at its start, with thresholds out of reach.

    Hashes of the pairs part them into blocks, each block is trained on by itself, and what the blocks teach is summed up by parts of the weights,
    so that neither a task nor the driver holds more as the tables grow.
    """
    signs = F.coalesce(F.length("response"), F.lit(0)) + F.coalesce(F.length("source"), F.lit(0))
    n, size = pairs.agg(F.count("*"), F.sum(signs)).first()
    if not n:
        model = Linear()
        model.limit[:] = 1.1
        return model
    blocks = max(-(-n // BLOCK), -(-size // BLOCK_SIGNS))
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(profiles_of(pairs))

    def learn(key: tuple, rows: pa.Table) -> pa.Table:
        given = sorted(zip(*(rows.column(c).to_pylist() for c in ("asked", "source", "response"))), key=lambda r: tuple((x is not None, x or "") for x in r))
        given = [given[i] for i in np.random.default_rng(SEED).permutation(len(given))]
        parts = np.array_split(learned([(*_split(a, s), t) for a, s, t in given], shared.value), PARTS)
        return pa.table({"part": pa.array(range(PARTS), pa.int32()), "block": pa.array([key[0].as_py()] * PARTS, pa.int64()), "value": pa.array([x.tobytes() for x in parts], pa.binary())})

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        told = sorted(zip(rows.column("block").to_pylist(), rows.column("value").to_pylist()))
        total = sum((np.frombuffer(v, np.float32).astype(float) for _, v in told), start=0.0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "value": pa.array([total.tobytes()], pa.binary())})

    block = F.pmod(F.xxhash64(F.lit(SEED), "asked", "source", "response"), F.lit(blocks))
    rows = pairs.select("asked", "source", "response", block.alias("block")).repartition(min(blocks, MOST_TASKS), "block").dropDuplicates()
    told = rows.groupBy("block").applyInArrow(learn, "part int, block bigint, value binary").groupBy("part").applyInArrow(add, "part int, value binary")
    total = np.concatenate([np.frombuffer(r.value) for r in sorted(told.collect(), key=lambda r: r.part)])
    return settled(total, shared.value)


def defects(pairs: DataFrame) -> DataFrame:
    """(record_kind, record_id, source_name, defect, score) of each pair, defect null where the answer is sound.

    Each key counts once. Null and blank answers are ``empty``; a null instruction or source is an empty text, and
    without a language asked for none is wrong. All answers are learned from. Whole texts are read, of JSON answers all values, nested ones too. An empty table gives an empty result.
    """
    model = trained(pairs)
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            label, p = m.decide(m.made([(*_split(a, s), t) for a, s, t in zip(*(b.column(c).to_pylist() for c in ("asked", "source", "response")))]))
            yield pa.RecordBatch.from_arrays([b.column("record_kind"), b.column("record_id"), b.column("source_name"), pa.array(label, pa.string()), pa.array(p.astype(float))], ["record_kind", "record_id", "source_name", "defect", "score"])

    out = pairs.mapInArrow(run, "record_kind string, record_id string, source_name string, defect string, score double")
    return out.dropDuplicates(["record_kind", "record_id"])


def answer_rates(found: DataFrame) -> DataFrame:
    """Per record kind, producer and defect: the answers, those with the defect, and the rate."""
    total = found.groupBy("record_kind", "source_name").agg(F.count("*").alias("answers"))
    hit = found.where("defect is not null").groupBy("record_kind", "source_name", "defect").agg(F.count("*").alias("defective"))
    return hit.join(total, ["record_kind", "source_name"]).withColumn("rate", F.col("defective") / F.col("answers"))

"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learntrail.llm.common import null_safe_text, ragged, table

KINDS = ("email", "ip", "card", "phone", "name", "ssn", "secret")
#: The words that a place's label depends on: itself, the one before, the one after, the one before the last.
OFFSETS = (0, -1, 1, -2)
#: A plain label begins a span of its kind, one with + goes on with it; a secret is one word.
LABELS = ("O", "name", "ssn", "secret", "email", "phone", "+name", "+ssn", "+email", "+phone")
#: Words decoded together and distinct words a worker keeps.
BATCH_WORDS, CACHE = 400_000, 400_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the longest run of local characters before an @ begins one, so each @ is looked at once."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and then start."""
    found = [("email", a, b) for a, b in _emails(text)]
    if not re.search("[0-9]", text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


# The labelled table: sentences in four languages made by rule from frames and fillers, marked word by word.
_FRAMES = (
    "my name is {name} and we met", "please ask for {name} at the desk", "Mr. {name} will call again", "Mrs. {name} came with them", "Dr. {name} wrote that note",
    "Ms. {name} has the keys", "signed by {name} on that day", "contact {name} for the rest", "regards, {name}", "name: {name}", "Prof. {name} said so",
    "SSN: {ssn} is on file", "her ssn {ssn} was in it", "social security number {ssn} and more", "the ssn is {ssn}", "token = {secret} and then", "api_key = {secret} was left",
    "password: {secret} in the mail", "secret = {secret}", "key: {secret} for the host", "mail {email} for more", "write to {email} or call", "email: {email}",
    "call {phone} at noon", "phone: {phone}", "tel. {phone} or by mail", "my number is {phone} so ring", "{o}", "{o}", "{o}", "{o}", "{o}", "{o}", "{o}", "{o}", "{o}",
    "{o} {num} {o}", "in {num} of {num} cases {o}", "the {Cap} and the {Cap} {o}", "{Cap} of {Cap}, {o}", "call the {o}", "the name of {o}", "key {o}", "a token of {o}", "write to the {o}",
    "tel {o}", "number {num} is {o}", "on {date} at {time} {o}", "{CAP}!! {CAP}!! {CAP}!!", "{Cap} {Cap} {Cap} {Cap} {Cap} {Cap}", "{o} {Cap} {Cap} {Cap} {o}", "{Cap}, {Cap} {o}", "{o} {Cap} {o}", "{o} by {o} {Cap} {Cap} {o}", "{o} is {Cap} {Cap} {Cap}", "{Cap}### {Cap}*** for {Cap}%%%", "for {Cap} and to {Cap} {o}", "{o} | {Cap} | is {Cap} | {o}", "to {Cap} for {Cap} {Cap} by {Cap}", "{o} | {o} | {Cap} | {o}", "{o}### {o}*** {o}%%%", "v{num}.{num} of {o}", "page {num}-{num} {o}", "Dr. {o}", "Mr. {o}",
    "By {Short}.", "By {Short} {o}", "To {Short} by {Short}.", "{o} to {Short}.", "{Short} {Short} {o}",
    "Dear {name},", "Dear {name}, {o}", "Sincerely, {name}", "yours, {name} {o}", "contact {name}, {name}", "regards, {name}, {name}", "signed by {name} and {name}", "my name is {name}, {name} {o}",
    "call {phone} {phone}", "call {phone}, {phone} at noon", "phone: {phone} {phone} {phone}", "tel. {phone} or {phone}", "ssn {ssn} {ssn}", "SSN: {ssn}, {ssn} {o}", "SSN {ssn} is on file", "mail {email} {email}", "email: {email}, {email}", "write to {email} or call", "write to {email} {o}", "mail {email} for more", "mail {email} {o}", "{o} by {email} {o}", "Dear {o}", "Sincerely, {o}", "yours, {o}", "dear {Cap} {o}",
    *(" ".join(["{Cap}"] * k) for k in (2, 2, 3, 4, 5, 7, 9, 10, 12)), "{Cap}, {Cap}", "{Cap}, {Cap}, {Cap}, {Cap}, {Cap}", "{Cap}, {Cap}, {Cap} {Cap}", "{Cap}.", "{Cap}!!", "{Cap}, {Cap} {num}", "{o} the {Cap} {Cap}, {Cap} {num}.", "{o} {Cap}, {Cap} {o}", "{Cap} {o} {Cap} {Cap}", "{Cap} {Cap} {o}", "{o}, {Cap} {Cap}, {Cap} {Cap} {o}", "{num} {num} {num} {o}", "key: {num}", "{o} {num}-{num}-{num} {num}",
    "mein Name ist {name} und dann", "Herr {name} kommt morgen", "Frau {name} war da", "Kontakt: {name}", "mit freundlichen Grüßen {name}", "Telefon: {phone}", "unter Telefon {phone} bis mittags", "Passwort: {secret}", "das Passwort ist {secret}", "der Schlüssel = {secret}",
    "je m'appelle {name} et puis", "Monsieur {name} arrive demain", "Madame {name} était là", "cordialement, {name}", "téléphone: {phone}", "au téléphone {phone} avant midi", "mot de passe: {secret}", "jeton = {secret}",
    "me llamo {name} y luego", "el señor {name} viene", "la señora {name} fue allí", "mi nombre es {name}", "saludos, {name}", "teléfono: {phone}", "al teléfono {phone} antes", "contraseña: {secret}", "clave = {secret}",
    "mein Name {o}", "Herr {o}", "Frau {o}", "ist {Cap} {o}", "das Passwort {o}", "je m'appelle {o}", "Monsieur {o}", "Madame {o}", "est {Cap} {o}", "mot de passe {o}", "el señor {o}", "la señora {o}", "es {Cap} {o}", "la clave {o}", "{o} y {Cap} {o}", "{o} und {Cap} {o}", "{o} et {Cap} {o}",
)
_FIRST = ("John", "Mary", "Ana", "Luis", "Pierre", "Julia", "Karl", "Ines", "Omar", "Wei", "Sofia", "Ivan", "Zoe", "Peter", "Élise", "José")
_LAST = ("Smith", "Meyer", "Garcia", "Dubois", "Novak", "Khan", "Lee", "Rossi", "O'Neil", "Müller", "Brown-Ray", "Silva")
_SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "ción", "ñ", "é", "ung", "sch", "ß", "eau")


def labelled_table(copies: int = 5, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """(words, labels) rows of the small training table."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(int(x)) for x in rng.integers(0, 10, n))
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 5))))
    plain = lambda n: [pick(("", "", "", "", ",", ".")).join((word(), "")) for _ in range(n)]

    def filled(slot: str) -> tuple[list[str], str]:
        if slot == "name":
            return [pick(_FIRST), *([pick(_LAST)] if rng.random() < 0.75 else [])], "name"
        if slot == "ssn":
            return pick(([f"{digits(3)}-{digits(2)}-{digits(4)}"], [f"{digits(3)}-{digits(2)}-{digits(4)}"], [digits(3), digits(2), digits(4)])), "ssn"
        if slot == "secret":
            hexes = "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(20, 41))))
            return [pick(('"%s"', "%s", "sk-%s")) % hexes], "secret"
        if slot == "email" and rng.random() < 0.3:
            return [f"{word().encode('ascii', 'ignore').decode() or 'me'}{pick(('(at)', '[at]'))}{word().encode('ascii', 'ignore').decode() or 'host'}{pick(('(dot)', '[dot]'))}{pick(('com', 'org', 'net'))}"], "email"
        if slot == "email":
            return [word().encode("ascii", "ignore").decode() or "me", pick(("at", "(at)", "[at]")), f"{word().encode('ascii', 'ignore').decode() or 'host'}", pick(("dot", "(dot)", "[dot]")), pick(("com", "org", "net"))], "email"
        if slot == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return pick(([f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"0{a}/{b}{c}"])), "phone"
        value = {"num": lambda: [digits(int(rng.integers(1, 7)))], "date": lambda: [f"{digits(2)}/{digits(2)}/{digits(4)}"], "time": lambda: [f"{digits(2)}:{digits(2)}"], "Cap": lambda: [word().capitalize()], "Short": lambda: [pick(_SYLLABLES)[:2].capitalize()], "CAP": lambda: [word().upper()]}
        return (value[slot]() if slot in value else plain(int(rng.integers(2, 9)))), "O"

    cues, rows = sorted(_CUES), []
    for copy in range(copies):
        for _ in range(len(_FRAMES)):  # cue words among ordinary ones mark nothing
            words = [pick(cues) if rng.random() < 0.4 else pick(plain(1)) for _ in range(int(rng.integers(3, 10)))]
            words = [w.capitalize() if rng.random() < 0.08 and w not in cues and words[max(k - 1, 0)] not in cues else w for k, w in enumerate(words)]
            rows.append(([w + pick(("", "", "", "", ",", ".", "!!", "%%%", "***")) for w in words], ["O"] * len(words)))
        for cue in cues[copy::copies] + pick((cues[::9], cues[1::9], cues[2::9])):  # a cue that is only repeated marks nothing
            rows.append(([cue.capitalize()] * int(rng.integers(3, 11)), []))
            rows[-1][1].extend(["O"] * len(rows[-1][0]))
            words = [(pick(cues) if rng.random() < 0.3 else pick(plain(1))).capitalize() + pick(("%%%", "&&", "**", "###", "!!")) for _ in range(int(rng.integers(3, 8)))]
            rows.append((words, ["O"] * len(words)))
        for frame in _FRAMES:
            words, labels = [], []
            for part in ([plain(int(rng.integers(0, 4)))] if rng.random() < 0.7 else []) + [frame.split()] + ([plain(int(rng.integers(0, 4)))] if rng.random() < 0.7 else []):
                for w in part:
                    found = re.search(r"\{(\w+)\}", w)
                    if found:
                        got, label = filled(found[1])
                        got = [w[: found.start()] + got[0], *got[1:]]
                        got[-1] += w[found.end() :]
                        words += got
                        labels += [label, *["+" + label if label != "O" else "O"] * (len(got) - 1)]
                    else:
                        words.append(w)
                        labels.append("O")
            if words and rng.random() < 0.5:
                words[0] = words[0][0].upper() + words[0][1:]
            rows.append((words, labels))
    return rows


#: Words of the frames that hint at a kind; all other words count by their shape.
_CUES = frozenset(
    ("name", "is", "ask", "for", "mr", "mrs", "dr", "ms", "prof", "signed", "by", "contact", "regards", "dear", "sincerely", "yours", "ssn", "social", "security", "number", "token", "api_key", "password", "secret", "key", "mail", "write", "to", "email", "call", "phone", "tel", "my", "at", "dot", "com", "org", "net")
    + ("mein", "ist", "herr", "frau", "kontakt", "grüßen", "telefon", "passwort", "schlüssel")
    + ("m'appelle", "monsieur", "madame", "cordialement", "téléphone", "passe", "jeton")
    + ("llamo", "señor", "señora", "nombre", "saludos", "teléfono", "contraseña", "clave")
)


def _shape(bare: str) -> str:
    """The word's kinds of characters, each run as one: X upper case, x other letters, d digits, marks as they are."""
    if bare.isalpha():
        if bare.islower():
            return "x"
        if bare[0].isupper() and bare[1:].islower():
            return "Xx"
    whole = re.sub(r"(.)\1+", r"\1", "".join("d" if c in "0123456789" else "X" if c.isupper() else "x" if c.isalpha() else c for c in bare))
    return whole if len(whole) <= 10 else f"{whole[:9]}{len(whole).bit_length()}"


def features(word: str) -> tuple[str, ...]:
    """Shape, length class, cue and marks of a word: few distinct combinations whatever the corpus."""
    bare = word.strip(".,;:!?\"'()[]<>{}|*#%&$=")
    shape, digits = _shape(bare), ""
    if "d" in shape or shape == "x" and len(bare) >= 16:
        if re.fullmatch(r"[0-9a-f]{16,}|sk-\S+", bare):
            shape = "hex"
        elif re.fullmatch(r"[-0-9./:()]+", bare):
            digits = re.sub(r"[0-9]+", lambda m: str(len(m[0])), bare)[:14]
    length = "long" if len(bare) >= 16 else "mid" if len(bare) >= 3 else "short"
    return ("s:" + shape, "l:" + length, "d:" + digits, "c:" + (bare.lower() if bare.lower() in _CUES else ""), "b:" + ("(" if word[:1] in "([" else "") + (":" if word[-1:] in ":=" else "") + (word if word in "=:" else "") + ("%" if len(word) > 1 and word[-1] == word[-2] and word[-1] in "%&*#!?" else ""))


_TITLES = ("mr.", "mrs.", "dr.", "ms.", "prof.", "tel.", "hr.", "fr.", "mme.", "sr.", "sra.")
#: What a decoded span must hold to count.
_FORMS = {
    "name": re.compile(r"[^\W\d_a-z][^\W\d_]+(?:['-][^\W\d_]+)?(?: [^\W\d_a-z][^\W\d_]*(?:['-][^\W\d_]+)*){0,3}"),
    "ssn": re.compile(r"[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}"),
    "secret": re.compile(r"(?=\S*[0-9])[A-Za-z0-9_+/-]{12,}"),
    "email": re.compile(r"\S+\s+[(\[]?at[)\]]?\s+\S+(?:\s+[(\[]?dot[)\]]?\s+\S+)+|[^\s()\[\]]+[(\[]at[)\]][^\s()\[\]]+(?:[(\[]dot[)\]][^\s()\[\]]+)+"),
    "phone": re.compile(r"(?:[^0-9]*[0-9]){7,15}[^0-9]*"),
}


def ends_chain(word: str) -> bool:
    """Whether a sentence ends with the word, so that no span goes on after it."""
    return word[-1:] in (".", "!", "?") and word.lower() not in _TITLES


def _chains(lengths: np.ndarray, enders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the chains of a run of documents of ``lengths`` words."""
    starts = np.zeros(int(lengths.sum()), bool)
    full = np.cumsum(lengths) - lengths
    starts[full[lengths > 0]] = True
    starts[1:] |= enders[:-1]
    begin = np.flatnonzero(starts)
    return begin, np.diff(np.r_[begin, len(starts)])


class ChainField:
    """Emission weights of the features of the words at OFFSETS from a place, and label transitions."""

    def __init__(self, index: dict[str, int], tables: list[np.ndarray], steps: np.ndarray):
        self.index, self.tables, self.steps = index, tables, steps

    def rows(self, word: str) -> list[np.ndarray]:
        at = [self.index[f] for f in features(word) if f in self.index]
        return [t[at].sum(0) for t in self.tables]


def viterbi(emission: np.ndarray, steps: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels of all chains of ``emission`` (words, labels) at once: step k handles word k of every chain that has one."""
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = begin[order], lengths[order]
    back = np.zeros(emission.shape, np.int8)
    score = emission[begin].copy()
    active = len(begin)
    for k in range(1, int(lengths[0]) if len(lengths) else 0):
        active = int(np.searchsorted(-lengths, -k, "left"))
        total = score[:active, :, None] + steps[None]
        best = total.argmax(1)
        back[begin[:active] + k] = best
        score[:active] = np.take_along_axis(total, best[:, None, :], 1)[:, 0] + emission[begin[:active] + k]
    out = np.zeros(len(emission), np.int8)
    label = score.argmax(1)
    ends = begin + lengths - 1
    out[ends] = label
    for k in range(int(lengths[0]) - 1 if len(lengths) else 0, 0, -1):
        active = int(np.searchsorted(-lengths, -k, "left"))
        label[:active] = back[begin[:active] + k, label[:active]]
        out[begin[:active] + k - 1] = label[:active]
    return out


def train(rows: list[tuple[list[str], list[str]]], passes: int = 120, rate: float = 0.1, decay: float = 1e-4) -> ChainField:
    """Maximum likelihood by forward-backward, scaled at each step, on padded numpy batches, and Adam steps.

    Words of equal features are one class: emissions are looked up by class, and gradients added up by class.
    """
    index: dict[str, int] = {}
    classes: dict[tuple[str, ...], int] = {}
    for words, _ in rows:
        for w in words:
            classes.setdefault(features(w), len(classes))
            for f in features(w):
                index.setdefault(f, len(index))
    n, longest, k = len(rows), max(len(w) for w, _ in rows), len(LABELS)
    held = np.zeros((len(classes) + 1, len(index)))  # the last class is padding
    for own, c in classes.items():
        held[c, [index[f] for f in own]] = 1
    word, gold, mask = np.full((n, longest), len(classes)), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for r, (words, labels) in enumerate(rows):
        word[r, : len(words)] = [classes[features(w)] for w in words]
        gold[r, : len(words)] = [LABELS.index(x) for x in labels]
        mask[r, : len(words)] = True
    weights = [*(np.zeros((len(index), k)) for _ in OFFSETS), np.zeros((k, k))]
    # where the labelled place and the word at the offset lie in the padded rows
    spans = [(slice(max(0, -o), longest - max(0, o)), slice(max(0, o), longest - max(0, -o))) for o in OFFSETS]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    for t in range(1, passes + 1):
        e = np.zeros((n, longest, k))
        for w, (place, at) in zip(weights, spans):
            e[:, place] += (held @ w)[word[:, at]]
        e = np.exp(e - e.max(2, keepdims=True)) * mask[:, :, None] + ~mask[:, :, None]
        steps, scale = np.exp(weights[-1]), np.ones((n, longest, 1))
        fwd, bwd = np.ones_like(e), np.ones_like(e)
        for s in range(longest):
            own = e[:, s] * (fwd[:, s - 1] @ steps if s else 1)
            scale[:, s] = np.where(mask[:, s, None], own.sum(1, keepdims=True), 1)
            fwd[:, s] = np.where(mask[:, s, None], own / scale[:, s], fwd[:, s - 1] if s else 1)
        for s in range(longest - 2, -1, -1):
            bwd[:, s] = np.where(mask[:, s + 1, None], (e[:, s + 1] * bwd[:, s + 1] / scale[:, s + 1]) @ steps.T, 1)
        wrong = (np.eye(k)[gold] - fwd * bwd) * mask[:, :, None]
        after = (e * bwd / scale * mask[:, :, None])[:, 1:].reshape(-1, k)
        grads = []
        for place, at in spans:
            own, by = word[:, at].ravel(), wrong[:, place].reshape(-1, k)
            grads.append(held.T @ np.stack([np.bincount(own, by[:, j], len(classes) + 1) for j in range(k)], 1))
        grads.append(seen - fwd[:, :-1].reshape(-1, k).T @ after * steps)
        for w, g, mo in zip(weights, grads, moments, strict=True):
            g = g / n - decay * w
            mo[0] = 0.9 * mo[0] + 0.1 * g
            mo[1] = 0.999 * mo[1] + 0.001 * g * g
            w += rate * (mo[0] / (1 - 0.9**t)) / (np.sqrt(mo[1] / (1 - 0.999**t)) + 1e-8)
    return ChainField(index, [w.astype(np.float32) for w in weights[:-1]], weights[-1].astype(np.float32))


@lru_cache(maxsize=1)
def trained() -> ChainField:
    return train(labelled_table())


class Decoder:
    """A trained field with the emission rows of the word classes met so far."""

    def __init__(self, field: ChainField):
        self.field, self.words, self.classes = field, {}, {}
        self.tables: list[list[np.ndarray]] = [[] for _ in OFFSETS]
        self.enders: list[bool] = []
        self.ready: list[np.ndarray] = []

    def _class(self, word: str) -> int:
        key = (features(word), ends_chain(word))
        found = self.classes.get(key)
        if found is None:
            found = self.classes[key] = len(self.classes)
            for t, row in zip(self.tables, self.field.rows(word), strict=True):
                t.append(row)
            self.enders.append(key[1])
            self.ready = []
        if len(word) <= 40:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = found
        return found

    def decode(self, texts: list[list[str]]) -> list[np.ndarray]:
        lengths = np.array([len(x) for x in texts], np.int64)
        get, new = self.words.get, self._class
        ids = np.fromiter((c if (c := get(w)) is not None else new(w) for x in texts for w in x), np.int64, int(lengths.sum()))
        if len(ids) == 0:
            return [np.zeros(0, np.int8) for _ in texts]
        if not self.ready:
            self.ready = [np.array(t, np.float32) for t in self.tables]
        begin, sizes = _chains(lengths, np.array(self.enders)[ids])
        emission = self.ready[0][ids]
        place, left = ragged(sizes), np.repeat(sizes, sizes) - ragged(sizes)
        for table, o in zip(self.ready[1:], OFFSETS[1:], strict=True):
            there = np.flatnonzero(place >= -o if o < 0 else left > o)
            emission[there] += table[ids[there + o]]
        return np.split(viterbi(emission, self.field.steps, begin, sizes), np.cumsum(lengths)[:-1])


def added_spans(text: str, labels: np.ndarray, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans of labelled words, without marks at their ends, that touch no span already there.

    A span goes from a begin label over the inside labels of its kind after it. One that lacks its kind's form gives the words
    of it that have the form alone.
    """
    places = [m.span() for m in re.finditer(r"\S+", text)]
    found: list[tuple[str, int, int]] = []

    def add(kind: str, first: int, last: int) -> bool:
        a, b = places[first][0], places[last][1]
        while a < b and text[a] in "\"'[<{|=:":
            a += 1
        while a < b and text[b - 1] in ".,;:!?\"'[]<>{}|=*#%&$":
            b -= 1
        fits = a < b and _FORMS[kind].fullmatch(text, a, b) is not None
        if fits and not any(x < b and a < y for _, x, y in taken):
            found.append((kind, a, b))
        return fits

    k = 0
    while k < len(labels):
        kind, end = LABELS[labels[k]].lstrip("+"), k
        if kind != "O":
            while end + 1 < len(labels) and LABELS[labels[end + 1]] == "+" + kind:
                end += 1
            if not add(kind, k, end) and end > k:
                for word in range(k, end + 1):
                    add(kind, word, word)
        k = end + 1
    return found


def find_personal_data(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` and, with ``keep_text``, ``text`` with spans as ``[KIND]``.

    The n_ columns and ``base_sha256`` describe the fixed patterns; ``spans`` also holds what the field adds, as
    ``kind:start:end`` in code points, by kind and start. The field is trained on the driver from a small table made by rule
    and sent with the task; decoding runs over all words of the whole texts. Null text is empty. Repeated rows and null ids
    are kept as they come; other columns are not read. No shuffle.
    """
    field = trained()

    def listed(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))

    def finished(decoder: Decoder, ids: list, texts: list[str], words: list[list[str]]) -> pd.DataFrame:
        rows = []
        for doc, text, labels in zip(ids, texts, decoder.decode(words), strict=True):
            base = base_spans(text)
            spans = base + (added_spans(text, labels, base) if labels.any() else [])
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:4]]
            rows.append((doc, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), *([redacted(text, spans)] if keep_text else [])))
        return pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", *(["text"] if keep_text else [])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(field)
        ids, texts, words, size = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                ids.append(doc)
                texts.append(text)
                words.append(text.split())
                size += len(words[-1]) + 1
                if size >= BATCH_WORDS:
                    yield finished(decoder, ids, texts, words)
                    ids, texts, words, size = [], [], [], 0
        if ids:
            yield finished(decoder, ids, texts, words)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS[:4]) + ", base_sha256 string, spans string" + ", text string" * keep_text
    return null_safe_text(docs, "doc_id").mapInPandas(run, schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, from left to right, as its kind in brackets; of overlapping spans the earlier one counts."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
            done = b
        elif b > done:
            done = b
    return "".join(out) + text[done:]


def redact_texts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns; in ``text`` each span is its kind in brackets. Null text stays null."""
    field = trained()

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(field)
        for texts in batches:
            out: list = []
            ends = np.cumsum([len(x) if isinstance(x, str) else 0 for x in texts]) // (6 * BATCH_WORDS)  # some texts at a time
            for own in (texts[ends == k].tolist() for k in np.unique(ends)):
                for text, labels in zip(own, decoder.decode([(x or "").split() for x in own]), strict=True):
                    if not text:
                        out.append(text)
                        continue
                    base = base_spans(text)
                    spans = base + (added_spans(text, labels, base) if labels.any() else [])
                    out.append(redacted(text, spans) if spans else text)
            yield pd.Series(out, dtype=object)

    return docs.withColumn("text", cleaned(F.col("text").cast("string")))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))

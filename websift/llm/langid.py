"""Languages of texts: per-language unigram pieces, summed over all segmentations."""

from __future__ import annotations

import math
import os
import re
from typing import NamedTuple

import numpy as np
import pandas as pd

TOKENIZERS = os.environ.get("WEBSIFT_TOKENIZERS", "/opt/tokenizers")

# Codes and names of languages as pages declare them.
ISO3 = {
    "eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it", "nld": "nl", "dut": "nl", "por": "pt", "cat": "ca", "pol": "pl",
    "rus": "ru", "swe": "sv", "dan": "da", "nor": "no", "fin": "fi", "ces": "cs", "cze": "cs", "ron": "ro", "rum": "ro", "hun": "hu", "ell": "el", "gre": "el",
    "tur": "tr", "ara": "ar", "heb": "he", "jpn": "ja", "zho": "zh", "chi": "zh", "kor": "ko", "ukr": "uk", "bul": "bg", "hrv": "hr", "slk": "sk", "slo": "sk", "slv": "sl",
}
NAMES = {
    "english": "en", "anglais": "en", "englisch": "en", "inglés": "en", "ingles": "en", "inglese": "en", "engels": "en",
    "french": "fr", "français": "fr", "francais": "fr", "französisch": "fr", "francés": "fr", "francese": "fr", "frans": "fr",
    "german": "de", "deutsch": "de", "allemand": "de", "alemán": "de", "tedesco": "de", "duits": "de",
    "spanish": "es", "español": "es", "espanol": "es", "castellano": "es", "espagnol": "es", "spanisch": "es", "spagnolo": "es", "spaans": "es",
    "italian": "it", "italiano": "it", "italien": "it", "italienisch": "it", "italiaans": "it",
    "dutch": "nl", "nederlands": "nl", "néerlandais": "nl", "niederländisch": "nl", "neerlandés": "nl", "olandese": "nl", "flemish": "nl", "vlaams": "nl",
    "portuguese": "pt", "português": "pt",
}
ISO2 = set(ISO3.values()) | {"et", "lv", "lt", "ga", "eu", "gl", "is", "sr", "mk", "sq", "hi", "vi", "th", "id", "fa", "la", "lb", "nb", "nn"}
# Scripts by ranges of code points, each with its most usual language.
SCRIPTS = [(0x3040, 0x30FF, "ja"), (0xAC00, 0xD7AF, "ko"), (0x4E00, 0x9FFF, "zh"), (0x0400, 0x04FF, "ru"), (0x0370, 0x03FF, "el"), (0x0600, 0x06FF, "ar"), (0x0590, 0x05FF, "he"), (0x0E00, 0x0E7F, "th"), (0x0900, 0x097F, "hi")]
# Letters that only some languages of a script have, by the script's usual language.
LETTERS = {"ru": {"ru": "ыэё", "uk": "іїєґ", "be": "ў", "sr": "ђјљњћџ", "mk": "ѓќѕ"}, "ar": {"fa": "پچژگ", "ur": "ٹڈےں"}}
#: Scripts that several languages share without such letters.
SHARED = {"zh", "hi"}

_OTHER_SCRIPT = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in SCRIPTS) + "]")


def declared(label: str | None) -> str | None:
    """The two-letter code a label names; None if it is missing, names several languages or none."""
    if label is None:
        return None
    text = label.strip().lower()
    if text in NAMES:
        return NAMES[text]
    parts = re.split(r"[\s,;/|]+", text)
    codes = {_code(p) for p in parts if p}
    return codes.pop() if len(codes) == 1 else None


def _code(part: str) -> str | None:
    if part in NAMES:
        return NAMES[part]
    head = re.split(r"[-_]", part)[0]
    if not re.fullmatch(r"[a-z]{2,3}([-_][a-z0-9]{2,8})*", part):
        return None
    return head if head in ISO2 else ISO3.get(head)


def vocabulary(folder: str = TOKENIZERS, name: str = "piece_bpe_32k.model") -> list[str]:
    """The pieces of the public vocabulary; a leading '▁' marks the start of a word. Control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, name))
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


#: What one word may add to a language against the mean: an unknown name must not outweigh a sentence.
WORD_LIMIT = 6.0
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


class Model(NamedTuple):
    langs: list[str]
    pieces: dict[str, int]
    #: (pieces + 1, languages): probabilities; the last row is that of a character that is no piece.
    probs: np.ndarray
    longest: int
    #: For each word of the samples, its languages as bits.
    seen: dict[str, int]
    #: Set by calibrate on held-out samples: what scores are divided by before they give a confidence; the least log-probability a
    #: character that a text of a known language has, and how much it varies with one word.
    temperature: float = 1.0
    least: float = -math.inf
    spread: float = 0.0


def _edges(words: list[str], pieces: dict[str, int], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """All pieces in all words: word, start, end, piece, sorted by end. A character that is no piece gets the last id."""
    unknown = len(pieces)
    w, a, b, k = [], [], [], []
    most = 0
    for i, word in enumerate(words):
        n = len(word)
        most = max(most, n)
        for s in range(n):
            single = False
            for e in range(s + 1, min(n, s + longest) + 1):
                piece = pieces.get(word[s:e])
                if piece is not None:
                    w.append(i), a.append(s), b.append(e), k.append(piece)
                    single |= e == s + 1
            if not single:
                w.append(i), a.append(s), b.append(s + 1), k.append(unknown)
    order = np.argsort(np.array(b, np.int64), kind="stable")
    pick = lambda x: np.array(x, np.int64)[order]
    return pick(w), pick(a), pick(b), pick(k), most


def _forward(n: int, edges: tuple, probs: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]: the probability of the word's first characters, summed over all segmentations."""
    w, a, b, k, most = edges
    m = probs.shape[1]
    alpha = np.zeros((n, most + 1, m))
    alpha[:, 0] = 1.0
    cuts = np.searchsorted(b, np.arange(1, most + 2))
    for e in range(1, most + 1):
        x = slice(cuts[e - 1], cuts[e])
        value = alpha[w[x], a[x]] * probs[k[x]]
        for j in range(m):
            alpha[:, e, j] = np.bincount(w[x], value[:, j], n)
    return alpha


def _forward_long(word: str, pieces: dict[str, int], longest: int, probs: np.ndarray) -> np.ndarray:
    """The log of the same sum for one word of any length, in log space, so that it can't underflow."""
    logs, unknown = np.log(np.maximum(probs, 1e-300)), len(pieces)
    alpha = np.full((len(word) + 1, probs.shape[1]), -np.inf)
    alpha[0] = 0.0
    for e in range(1, len(word) + 1):
        starts = [(k, pieces[word[k:e]]) for k in range(max(0, e - longest), e) if word[k:e] in pieces]
        if not starts or starts[-1][0] != e - 1:
            starts.append((e - 1, unknown))
        at, piece = zip(*starts, strict=True)
        alpha[e] = np.logaddexp.reduce(alpha[list(at)] + logs[list(piece)], axis=0)
    return alpha[-1]


def _marked(word: str) -> str:
    return "▁" + word


def train(samples: list[tuple[str, str]], pieces: list[str], rounds: int = 4, mix: float = 0.02) -> Model:
    """samples: (language, text). EM over segmentations: expected counts of each piece by forward and backward sums.

    Each language's probabilities are mixed with those of all languages together and with a floor, so that no text has
    probability 0. Samples with a null or blank text or language are left out.
    """
    import pyarrow  # noqa: F401  keeps numpy's threads as the worker set them

    ok = [(la, t) for la, t in samples if la and t and t.strip()]
    langs = sorted({la for la, _ in ok})
    index = {p: i for i, p in enumerate(pieces)}
    longest = max(map(len, pieces), default=1)
    counts = {la: {} for la in langs}
    for la, t in ok:
        for w in WORD.findall(t.lower()):
            counts[la][_marked(w)] = counts[la].get(_marked(w), 0) + 1
    words = sorted({w for c in counts.values() for w in c})
    n, m = len(words), len(langs)
    weight = np.array([[counts[la].get(w, 0) for la in langs] for w in words], float).reshape(n, m)
    used = sorted({w[s:e] for w in words for s in range(len(w)) for e in range(s + 1, min(len(w), s + longest) + 1) if w[s:e] in index})
    local = {p: i for i, p in enumerate(used)}
    edges = _edges(words, local, longest)
    ew, ea, eb, ek, most = edges
    v = len(used) + 1
    probs = np.full((v, m), 1.0 / v)
    floor = 1e-7
    lengths = np.array([len(w) for w in words], np.int64)
    for _ in range(rounds):
        alpha = _forward(n, edges, probs)
        beta = np.zeros_like(alpha)
        beta[np.arange(n), lengths] = 1.0
        order = np.argsort(-ea, kind="stable")
        starts = ea[order]
        cuts = np.searchsorted(-starts, -np.arange(most, -1, -1), "right")
        at = 0
        for c in cuts:
            x = order[at:c]
            at = c
            if len(x):
                np.add.at(beta, (ew[x], ea[x]), probs[ek[x]] * beta[ew[x], eb[x]])
        total = alpha[np.arange(n), lengths]
        expected = alpha[ew, ea] * probs[ek] * beta[ew, eb] / np.maximum(total[ew], 1e-300) * weight[ew]
        new = np.zeros((v, m))
        np.add.at(new, ek, expected)
        pooled = new.sum(axis=1, keepdims=True)
        new = (1 - mix) * new / np.maximum(new.sum(axis=0), 1e-12) + mix * pooled / max(pooled.sum(), 1e-12)
        probs = new + floor
        probs[-1] = floor
    seen = {w[1:]: sum(1 << j for j, la in enumerate(langs) if w in counts[la]) for w in words}
    return Model(langs, local, probs, longest, seen)


def calibrate(samples: list[tuple[str, str]], pieces: list[str], snippet: int = 3) -> Model:
    """The model of all samples, with temperature, least and spread from two models that each saw one half and are tested on the other.

    temperature makes the confidences of snippets of so many words as high as the share that is right (least cross entropy on a
    grid); least is the lowest log-probability a character of a held-out sample under its language, spread its standard deviation.
    """
    full = train(samples, pieces)
    ok = [(la, t) for la, t in samples if la and t and t.strip() and WORD.search(t)]
    by: dict[str, int] = {}
    halves: list[list[tuple[str, str]]] = [[], []]
    for la, t in ok:
        by[la] = by.get(la, 0) + 1
        halves[by[la] % 2].append((la, t))
    levels, scores, truth = [], [], []
    for k in (0, 1):
        half = train(halves[1 - k], pieces)
        held = [(la, t) for la, t in halves[k] if la in half.langs]
        if not held:
            continue
        lines = score_lines(Scorer(half), [t for _, t in held])
        own = np.array([half.langs.index(la) for la, _ in held])
        levels += (lines.levels[np.arange(len(held)), own] / np.maximum(lines.chars, 1)).tolist()
        for i in range(len(held)):
            words = lines.word_scores[lines.word_line == i]
            for j in range(0, len(words) - snippet + 1, snippet):
                row = np.full(len(full.langs), -1e9)
                row[[full.langs.index(x) for x in half.langs]] = words[j : j + snippet].sum(axis=0)
                scores.append(row)
                truth.append(full.langs.index(held[i][0]))
    if not scores:
        return full
    x, y = np.stack(scores), np.array(truth)
    loss = {}
    for t in np.arange(0.5, 6.01, 0.25):
        z = x / t - (x / t).max(axis=1, keepdims=True)
        loss[float(t)] = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))
    return full._replace(temperature=min(loss, key=loss.get), least=float(min(levels)), spread=float(np.std(levels)))


class Scorer:
    """Log-probabilities of words under each language, each distinct word scored once; the cache is emptied when it gets large."""

    #: Longer words are summed in log space.
    LONG = 48

    def __init__(self, model: Model, most_words: int = 400_000) -> None:
        self.model, self.most = model, most_words
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.langs)))
        self.seen = np.zeros(0, np.int64)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """((len(words), languages) log-probabilities; the languages whose samples hold each word, as bits)."""
        if len(self.rows) > self.most:
            self.rows, self.logs, self.seen = {}, self.logs[:0], self.seen[:0]
        m = self.model
        fresh = [w for w in words if w not in self.rows]
        for a in range(0, len(fresh), 4096):
            part = [_marked(w) for w in fresh[a : a + 4096]]
            logs = np.zeros((len(part), len(m.langs)))
            short = [i for i, w in enumerate(part) if len(w) <= self.LONG]
            if short:
                some = [part[i] for i in short]
                alpha = _forward(len(some), _edges(some, m.pieces, m.longest), m.probs)
                logs[short] = np.log(np.maximum(alpha[np.arange(len(some)), [len(w) for w in some]], 1e-300))
            for i, w in enumerate(part):
                if len(w) > self.LONG:
                    logs[i] = _forward_long(w, m.pieces, m.longest, m.probs)
            base = len(self.logs)
            self.logs = np.concatenate([self.logs, logs])
            self.seen = np.concatenate([self.seen, np.array([m.seen.get(w, 0) for w in fresh[a : a + 4096]], np.int64)])
            self.rows.update((w, base + i) for i, w in enumerate(fresh[a : a + 4096]))
        at = np.array([self.rows[w] for w in words], np.int64)
        return self.logs[at], self.seen[at]


def _relative(logs: np.ndarray) -> np.ndarray:
    """Against the mean over the languages, each word's say limited."""
    return np.clip(logs - logs.mean(axis=1, keepdims=True), -WORD_LIMIT, WORD_LIMIT) if logs.size else logs


def script_language(text: str) -> tuple[str | None, float]:
    """(language, confidence) by the script most letters are written in; (None, 0.0) for Latin and unknown scripts.

    Where a script's languages have letters of their own, these decide: the more of them, the surer. The confidence is the share of
    letters in the script, times (k + 1) / (k + 2) for k deciding letters; a script with undecided or no such letters gives half of it.
    """
    if not _OTHER_SCRIPT.search(text):
        return None, 0.0
    n: dict[str, int] = {}
    letters = 0
    for c in text:
        if c.isalpha():
            letters += 1
            o = ord(c)
            if o > 0x36F:
                for lo, hi, la in SCRIPTS:
                    if lo <= o <= hi:
                        n[la] = n.get(la, 0) + 1
                        break
    if not n:
        return None, 0.0
    if "ja" in n:
        n["ja"] += n.pop("zh", 0)
    la, k = max(n.items(), key=lambda x: x[1])
    if 2 * k <= letters:
        return None, 0.0
    share = k / letters
    if la in SHARED:
        return la, share / 2
    if la not in LETTERS:
        return la, share
    low = text.lower()
    own = {x: sum(low.count(c) for c in signs) for x, signs in LETTERS[la].items()}
    best = "be" if own.get("be") else max(own, key=own.get)
    if not own[best]:
        # No letter of another language in a long text speaks for the usual one of the script, unless it has deciding letters itself.
        return la, share / 2 if la in LETTERS[la] else share * (k + 10) / (k + 20)
    return best, share * (own[best] + 1) / (own[best] + 2)


class Lines(NamedTuple):
    """Of each line its scores and number of words; of each word its line, scores and the languages whose samples hold it, as bits.

    levels, chars: of each line the summed log-probabilities and the number of characters they are of.
    """

    scores: np.ndarray
    words: np.ndarray
    word_line: np.ndarray
    word_scores: np.ndarray
    word_seen: np.ndarray
    levels: np.ndarray
    chars: np.ndarray


def score_lines(scorer: Scorer, texts: list[str]) -> Lines:
    """Sums the words' log-probabilities over each line."""
    found = [WORD.findall(t.lower()) for t in texts]
    n = np.array([len(f) for f in found], np.int64)
    flat = pd.Series([w for f in found for w in f], dtype=object)
    codes, distinct = pd.factorize(flat)
    m = len(scorer.model.langs)
    logs, seen = scorer.words(list(distinct))
    rel, sizes = _relative(logs), np.array([len(w) + 1 for w in distinct], float)
    word_scores = rel[codes] if len(codes) else np.zeros((0, m))
    word_logs = logs[codes] if len(codes) else np.zeros((0, m))
    word_seen = seen[codes] if len(codes) else np.zeros(0, np.int64)
    line = np.repeat(np.arange(len(texts)), n)
    add = lambda x: np.stack([np.bincount(line, x[:, j], len(texts)) for j in range(m)], axis=1) if m else np.zeros((len(texts), 0))
    chars = np.bincount(line, sizes[codes], len(texts)) if len(codes) else np.zeros(len(texts))
    return Lines(add(word_scores), n, line, word_scores, word_seen, add(word_logs), chars)


def is_known(model: Model, levels: np.ndarray, chars: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether texts are in a language of the model at all: as likely a character as its held-out samples, with allowance for few words."""
    return levels / np.maximum(chars, 1) >= model.least - model.spread / np.sqrt(np.maximum(words, 1))


def segments(scorer: Scorer, text: str | None, switch: float = 8.0) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the runs of words of one language in a text, in order; [] for a text without a letter.

    The best path over the words' scores, where a change of language costs switch. Places are those of the first and past the last
    letter of a run. A run in a language the model does not know is 'und'.
    """
    if not text or not scorer.model.langs:
        return []
    spans = [(x.start(), x.end()) for x in WORD.finditer(text)]
    if not spans:
        return []
    words = [text[a:b].lower() for a, b in spans]
    logs, _ = scorer.words(words)
    scores = _relative(logs)
    back = np.zeros(scores.shape, np.int64)
    best = scores[0].copy()
    for i in range(1, len(words)):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back[i] = np.where(stay, np.arange(len(best)), top)
        best = np.where(stay, best, best[top] - switch) + scores[i]
    path = [int(best.argmax())]
    for i in range(len(words) - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    path.reverse()
    out, a = [], 0
    for i in range(1, len(words) + 1):
        if i == len(words) or path[i] != path[a]:
            script, sure = script_language(text[spans[a][0] : spans[i - 1][1]])
            chars = sum(len(w) + 1 for w in words[a:i])
            known = is_known(scorer.model, logs[a:i, path[a]].sum(), chars, i - a)
            if script is None:
                script, sure = (scorer.model.langs[path[a]], float(confidence(scores[a:i].sum(axis=0, keepdims=True), scorer.model.temperature)[0])) if known else ("und", 0.0)
            out.append((spans[a][0], spans[i - 1][1], script, sure))
            a = i
    return out


def confidence(scores: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    """The posterior of the best language of each row under equal priors, of scores divided by the temperature."""
    if not scores.size:
        return np.zeros(len(scores))
    e = np.exp((scores - scores.max(axis=1, keepdims=True)) / temperature)
    return e.max(axis=1) / e.sum(axis=1)


def identify(model: Model, text: str | None) -> tuple[str | None, float]:
    """(language, confidence) of one text; (None, 0.0) for a null text or one without a letter, ('und', 0.0) for a language the model does not know."""
    if not text or not any(c.isalpha() for c in text):
        return None, 0.0
    script, sure = script_language(text)
    if script is not None:
        return script, sure
    lines = score_lines(Scorer(model), [text])
    if not model.langs or not lines.words[0]:
        return None, 0.0
    k = int(lines.scores[0].argmax())
    if not is_known(model, lines.levels[:, k], lines.chars, lines.words)[0]:
        return "und", 0.0
    c = float(confidence(lines.scores, model.temperature)[0])
    return model.langs[k], c if math.isfinite(c) else 0.0

"""Dense features of a text for the toxicity classifier; tasks import this and no learning library."""

from __future__ import annotations

import math
import re

import numpy as np

#: Lengths of the word beginnings that are lexicon terms.
BEGINNINGS = (4, 5, 6, 7)
NEAR = 6
#: Words whose lexicon weights a task remembers; others are looked up anew.
KEPT_WORDS = 1 << 16

# Second-person pronouns of English, German, French and Spanish.
YOU = frozenset(
    "you your yours yourself yourselves du dich dir dein deine deiner deinem deinen ihr euch euer eure tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros tuyo tuya vuestro vuestra".encode().split()
)
# Signs that stand for letters in disguised spellings.
SIGNS = bytes.maketrans(b"013457@$!", b"oieastasi")
EDGES = b"\"'`.,;:!?()[]{}<>*_~-|/\\#%&+=^"
DISGUISED = re.compile(rb"[a-z]+[0-9@$*!]+[a-z]")
STRETCHED = re.compile(rb"([a-z!?])\1\1")

FEATURES = (
    "word_density", "word_count", "word_kinds", "weight_density", "weight_top", "begin_density", "begin_count", "near_you", "you_density",
    "capitals", "capital_words", "exclamations", "questions", "punctuation", "disguised", "disguised_hits", "stretched", "length",
)


def terms(word: bytes) -> list[bytes]:
    """A word's lexicon terms: itself and its beginnings."""
    return [b"=" + word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) > n)]


def bare(words: list[bytes]) -> list[bytes]:
    return [w.rstrip(EDGES + b"$@").lstrip(EDGES) for w in words]


def measures(text: str | None, lexicon: dict[bytes, float], kept: dict[bytes, tuple[float, float]]) -> list[float]:
    """``FEATURES`` of one text. ``kept`` remembers the lexicon weights of words already met."""
    raw = (text or "").encode()
    low = raw.lower()
    words = bare(low.split())
    n = max(1, len(words))
    hits, begins, weight, top, kinds, disguised = [], 0, 0.0, 0.0, set(), 0
    for i, w in enumerate(words):
        found = kept.get(w)
        if found is None:
            own = terms(w)
            found = lexicon.get(own[0], 0.0), max((lexicon.get(t, 0.0) for t in own[1:]), default=0.0)
            if not any(found) and w and not w.isalpha():
                plain = terms(w.translate(SIGNS, b"*._-"))
                found = max(lexicon.get(t, 0.0) for t in plain), -1.0
            if len(kept) < KEPT_WORDS:
                kept[w] = found
        whole, begin = found
        if whole > 0 or begin > 0:
            hits.append(i)
            begins += begin > 0
            disguised += begin < 0
            kinds.add(w)
            weight += max(whole, begin)
            top = max(top, whole, begin)
    you = [i for i, w in enumerate(words) if w in YOU]
    near = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        near = sum(1 for h, k in zip(hits, at.tolist(), strict=True) if any(abs(you[j] - h) <= NEAR for j in (k - 1, k) if 0 <= j < len(you)))
    data = np.frombuffer(raw, np.uint8)
    count = np.bincount(data, minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    signs = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    size = max(1, len(raw))
    capital = sum(1 for w in raw.split() if len(w) > 2 and w.isupper()) if count[65:91].sum() > 2 else 0
    return [
        len(hits) / n, math.log1p(len(hits)), math.log1p(len(kinds)), weight / n, top, begins / n, math.log1p(begins), near / max(1, len(hits)), len(you) / n,
        int(count[65:91].sum()) / letters, capital / n, int(count[33]) / n, int(count[63]) / n, signs / size,
        len(DISGUISED.findall(low)) / n, disguised / n, len(STRETCHED.findall(low)) / n, math.log1p(len(words)),
    ]

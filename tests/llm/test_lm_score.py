import math
import re
import zlib
from collections import Counter
from decimal import Decimal
from functools import cache

import numpy as np
import pytest

from sluiceway.llm import lm_score
from sluiceway.llm.lm_score import PRIOR, ROUNDS, UNKNOWN, URN, Lattice, pieces, refitted, score_documents


def tokens(text):
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", lowered), None]


def arcs(word, vocabulary):
    """Each span of a word that one piece or one character spells: start, end, piece, probability."""
    begin = sum(p for k, p in vocabulary.items() if k[0] == "▁")
    text = "▁" + word
    longest = max(map(len, vocabulary))
    for e in range(1, len(text) + 1):
        for s in range(max(e - longest, 0), e):
            piece = text[s:e]
            if piece in vocabulary:
                yield s, e, piece, vocabulary[piece] / (begin if s == 0 else 1)
            elif e - s == 1:
                yield s, e, None, UNKNOWN


def spelled(word, vocabulary):
    """The sum over all segmentations, by plain recursion."""
    alpha = Counter({0: 1.0})
    for s, e, _, p in arcs(word, vocabulary):
        alpha[e] += alpha[s] * p
    return alpha[len(word) + 1] * sum(p for k, p in vocabulary.items() if k[0] == "▁")


def segmentations(word, vocabulary, at=0):
    """All spellings of a word, one by one, with their probabilities."""
    if at == len(word) + 1:
        yield [], 1.0
    for s, e, piece, p in arcs(word, vocabulary):
        if s == at:
            for pieces_after, q in segmentations(word, vocabulary, e):
                yield [piece, *pieces_after], p * q


def refit(words, vocabulary, original):
    """One round of expectation-maximisation over distinct words, in plain Python."""
    used = Counter()
    for word in words:
        found = [(s, e, piece, Decimal(p)) for s, e, piece, p in arcs(word, vocabulary)]  # a long word's product is below any float
        alpha, beta = Counter({0: Decimal(1)}), Counter({len(word) + 1: Decimal(1)})
        for s, e, _, p in found:
            alpha[e] += alpha[s] * p
        for s, e, _, p in sorted(found, key=lambda x: -x[0]):
            beta[s] += beta[e] * p
        for s, e, piece, p in found:
            if piece is not None:
                used[piece] += float(alpha[s] * p * beta[e] / beta[0])
    stop = sum(p for k, p in original.items() if k[0] == "▁")
    first = sum(n for k, n in used.items() if k[0] == "▁") + PRIOR
    rest = sum(n for k, n in used.items() if k[0] != "▁") + len(words) + PRIOR
    new_stop = (len(words) + PRIOR * stop) / rest
    return {k: new_stop * (used[k] + PRIOR * p / stop) / first if k[0] == "▁" else (used[k] + PRIOR * p) / rest for k, p in original.items()}


def brute(rows, vocabulary):
    count = Counter(t for d, text in rows if zlib.crc32(str(d).encode()) % 7 != 2 for t in tokens(text))
    n, v = sum(count.values()), len(count)
    weights = vocabulary
    for _ in range(ROUNDS):
        weights = refit([t.decode() for t in count if t is not None], weights, vocabulary)
    occur = Counter(count.values())
    less = (occur[1] + 1) / (occur[1] + 2 * occur[2] + 2)

    @cache
    def chance(t):
        lattice = 0 if t is None else spelled(t.decode(), weights)
        return max(count[t] - less, 0) / n + less * v / n * lattice

    out = {}
    for d, text in rows:
        seen, score = Counter(), 0.0
        for k, t in enumerate(tokens(text)):
            score += math.log10((seen[t] + URN * chance(t)) / (k + URN))
            seen[t] += 1
        ts = tokens(text)
        out[d] = (len(ts), sum(count[t] > 0 for t in ts), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts), score)
    return out


ROWS = [(k, f"The cat number {k} sat on thé mat the THE the {'x' * (k % 4)} cat") for k in range(60)] + [
    (100, None), (101, ""), (102, "word " * 3000 + "unseenword日"), (103, "a▁b \x0bc"), (104, "zq" * 500),
]


@pytest.mark.parametrize("heavy", [1 << 19, 8])
def test_equals_brute_force(texts, monkeypatch, heavy):
    monkeypatch.setattr(lm_score, "HEAVY", heavy)
    vocabulary = {k: math.exp(s) for k, s in pieces(lm_score.VOCABULARY)}
    safe = [(d, t.replace("▁", "�") if t else t) for d, t in ROWS]
    truth = brute(safe, vocabulary)
    got = score_documents(texts(safe)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        t = truth[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == t[:3] and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(t[3], rel=1e-9) and r.score == pytest.approx(t[4], rel=1e-7), r.doc_id


def test_lattice_is_a_distribution():
    """Words over a small alphabet: the probabilities of all words add up to 1."""
    vocabulary = [("▁", 0.2), ("▁a", 0.2), ("a", 0.2), ("b", 0.1), ("ab", 0.3)]
    lattice = Lattice([(p, math.log(x)) for p, x in vocabulary])
    level, total = [""], 0.0
    for _ in range(13):
        total += np.exp(lattice.score(level)).sum() if level != [""] else 0
        level = [w + c for w in level for c in "ab"]
    assert 0.5 < total < 1.0001


def test_expected_pieces():
    """The two recursions against all segmentations, one by one; the refitted weights are a distribution."""
    vocabulary = {"▁": 0.1, "▁a": 0.2, "a": 0.2, "b": 0.1, "ab": 0.3, "ba": 0.1}
    listed = [(p, math.log(x)) for p, x in vocabulary.items()]
    words = ["a", "abab", "bba", "aqb", ""]
    truth = Counter()
    for w in words:
        ways = list(segmentations(w, vocabulary))
        for used, p in ways:
            for piece in used:
                truth[piece] += p / sum(q for _, q in ways)
    got = Lattice(listed).expected(words)
    assert got == pytest.approx([truth[p] for p in vocabulary], rel=1e-9)
    assert sum(math.exp(s) for _, s in refitted(listed, got, len(words))) == pytest.approx(1)


def test_fitted_weights_make_unseen_words_likelier(texts):
    """Words made of the corpus's own syllables gain by the fit."""
    syllables = ["zu", "qa", "vix", "oth", "plim"]
    make = lambda k: "".join(syllables[(k // 5**j) % 5] for j in range(4))
    rows = [(k, make(k)) for k in range(600)]
    unseen = [r for r in score_documents(texts(rows)).collect() if r.held_out and r.n_known == 1]
    lattice = Lattice(pieces(lm_score.VOCABULARY))
    plain = lattice.score([make(r.doc_id) for r in unseen]) / math.log(10)
    assert len(unseen) > 20 and sum(r.score for r in unseen) > plain.sum() + len(unseen)


def test_odd_rows(texts):
    assert score_documents(texts([])).collect() == []
    got = score_documents(texts([(1, "a a"), (1, "a a"), (None, "a b")]).selectExpr("*", "1 AS c", "2 AS h")).collect()
    assert len(got) == 3 and len({r.score for r in got if r.doc_id == 1}) == 1 and all(math.isfinite(r.score) for r in got)

import random

import numpy as np
import pytest

from sluiceway.llm.langid import identify, mixture, select

SOUNDS = {"aa": ["bra", "tok", "ul", "vin"], "bb": ["sch", "eit", "ung", "är"], "cc": ["ción", "os", "ñez", "lla"]}


def word(r, lang):
    return "".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 4)))


@pytest.fixture
def docs(documents):
    r = random.Random(2)
    rows = [(k, " ".join(word(r, lang) for _ in range(r.randint(2, 80))), lang, "s", 1) for k, lang in enumerate(random.Random(1).choices(list(SOUNDS), k=400))]
    mixed = " ".join(word(r, "aa") for _ in range(60)) + " " + " ".join(word(r, "cc") for _ in range(30))
    return documents(rows + [(900, None, "aa", "s", 0), (901, "", "aa", "s", 0), (902, "123 ... 45", "aa", "s", 0), (903, mixed, None, None, None), (904, "brabra " * 60_000, None, "s", 1), (904, "brabra", None, "s", 1), (None, "ungeit", "bb", "s", 1)])


def test_held_out_accuracy(docs):
    got = identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 0
    by = {r.doc_id: r for r in got}
    assert {by[k].lang_pred for k in (900, 901, 902)} == {"und"} and by[902].score == 0
    assert by[903].langs == ["aa", "cc"] and by[903].score == pytest.approx(2 / 3, abs=0.05)
    assert by[904].lang_pred == "aa"


def test_mixture_finds_shares():
    r = np.random.default_rng(0)
    likely = np.log(np.where(r.random(3000)[:, None] < 0.7, [[0.9, 0.1]], [[0.1, 0.9]]))
    first = np.array([0, 3000])
    share, fit = mixture(likely, first, np.ones((1, 2), bool), 60)
    grid = [np.log(np.exp(likely) @ [a, 1 - a]).sum() for a in np.linspace(0.01, 0.99, 99)]
    assert fit[0] >= max(grid) - 1e-6
    assert select(likely, first)[0].min() > 0
    assert select(np.log(np.full((50, 2), [0.9, 0.1])), np.array([0, 50]))[0].tolist() == pytest.approx([1, 0])


def test_empty_and_unlabelled(documents):
    assert identify(documents([])).collect() == []
    assert [r.lang_pred for r in identify(documents([(1, "abc", None, "s", 1)])).collect()] == ["und"]


def test_equals_plain_mixture(spark, sf):
    """All texts of the table against trigram counts, EM and backward choice written out document by document."""
    import math
    from collections import Counter, defaultdict
    from zlib import crc32

    import numpy as np
    import pyarrow as pa

    from sluiceway.llm import langid as m
    from sluiceway.llm.common import Words, flat

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    rows = docs.collect()

    def words(text):
        """Buckets of each word's trigrams; the hash is the module's own."""
        data, offsets = flat(pa.array([text or ""]))
        gram, word = m._grams(Words(data, offsets, 0, 1), m.BUCKET_BITS)
        out = defaultdict(list)
        for g, w in zip(gram.tolist(), word.tolist()):
            out[w].append(g)
        return [out[k] for k in sorted(out)]

    counts = defaultdict(Counter)
    for x in rows:
        if x.lang is not None and crc32(str(x.doc_id).encode()) % 3 != 1:
            counts[x.lang].update(g for w in words(x.text) for g in w)
    langs = sorted(counts)
    total = {a: sum(counts[a].values()) + m.SMOOTHING * 2**m.BUCKET_BITS for a in langs}

    def mix(p, allowed):
        share = {a: 1 / len(allowed) for a in allowed}
        top = [max(row[a] for a in allowed) for row in p]
        e = [{a: math.exp(row[a] - t) for a in allowed} for row, t in zip(p, top)]
        for _ in range(m.ROUNDS):
            new = dict.fromkeys(allowed, 0.0)
            for row in e:
                s = sum(row[a] * share[a] for a in allowed)
                for a in allowed:
                    new[a] += row[a] * share[a] / s
            share = {a: max(new[a] / len(p), 1e-12) for a in allowed}
        return share, sum(math.log(sum(row[a] * share[a] for a in allowed)) + t for row, t in zip(e, top))

    got = {x.doc_id: x for x in m.identify(docs).collect()}
    for x in rows:
        p = [{a: sum(math.log((counts[a][g] + m.SMOOTHING) / total[a]) for g in w) for a in langs} for w in words(x.text)]
        if not p or not any(c.isalpha() for c in x.text or ""):
            assert got[x.doc_id].lang_pred == "und"
            continue
        share, fit = mix(p, langs)
        share = {a: v for a, v in share.items() if v > 1e-6}
        while len(share) > 1:
            less = min(share, key=lambda a: (share[a], -langs.index(a)))
            new, new_fit = mix(p, [a for a in share if a != less])
            if fit - new_fit > 0.5 * math.log(len(p)) + 1:
                break
            share, fit = new, new_fit
        best = max(share, key=lambda a: (share[a], [-ord(c) for c in a]))
        assert got[x.doc_id].lang_pred == best and np.isclose(got[x.doc_id].score, share[best], atol=1e-6)
        assert set(got[x.doc_id].langs) == set(share)


def test_odd_columns_and_ties(documents):
    from sluiceway.llm.langid import identify

    docs = documents([(1, "abc", "b", "s", 3), (1, "abc", "a", "s", 3), (2, "abc", None, None, None), (None, "abc", None, "s", 3)]).selectExpr("*", "1 AS score", "2 AS langs", "3 AS word")
    got = identify(docs).collect()
    assert len(got) == 4 and {r.lang_pred for r in got} == {"a"}

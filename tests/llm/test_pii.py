import re

from pyspark.sql import functions as F

import pytest

from sluiceway.llm import pii
from sluiceway.llm.pii import luhn_sum, permute_digits, replaced_text


def pseudonym(value, key="k", undo=False):
    return pii.pseudonym(value, key, undo)


def pseudonymise(docs, key="k", undo=False):
    return pii.pseudonymise(docs, key, undo)


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if k % 2 == 0 else (2 * x) % 10 + 2 * x // 10 for k, x in enumerate(d)) % 10 == 0


def test_permutes_two_digits(spark):
    rows = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("d"))
    out = rows.select("d", permute_digits(F.col("d"), "k", "t").alias("e")).select("d", "e", permute_digits(F.col("e"), "k", "t", True).alias("f")).collect()
    assert len({r.e for r in out}) == 100 and all(len(r.e) == 2 and r.f == r.d for r in out)


def test_luhn(spark):
    values = ["4111111111111111", "4111111111111112", "79927398713", "0", "5500005555555559"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(luhn_sum(F.col("v"))).collect()]
    assert [g == 0 for g in got] == [luhn(v) for v in values]


VALUES = {
    "4111 1111 1111 1111": r"\d{4} \d{4} \d{4} \d{4}", "4207051279108084": r"\d{16}", "+1 (375) 555-4393": r"\+1 \(\d{3}\) \d{3}-\d{4}", "555-123-4567": r"\d{3}-\d{3}-\d{4}",
    "10.0.0.255": r"\d{1,3}(\.\d{1,3}){3}", "1999-12-31": r"\d{4}-\d\d-\d\d", "2024-02-29": r"\d{4}-\d\d-\d\d", "0001-01-01": r"\d{4}-\d\d-\d\d", "9999-12-31": r"\d{4}-\d\d-\d\d", "123-45-6789": r"\d{3}-\d\d-\d{4}", "fakol.33@mail7.example.com": r"[a-z]{5}\.\d\d@mail7\.example\.com",
}
KEPT = ["4111111111111112", "2023-02-30", "300.1.1.1", "1.2.3", "12345", "password=e3b3ed3cc8548923d6", "000-12-3456", "0000-05-05"]


def test_each_format_and_back(spark):
    df = spark.createDataFrame([(v,) for v in [*VALUES, *KEPT]], "v string")
    for r in df.select("v", pseudonym(F.col("v")).alias("p")).select("v", "p", pseudonym(F.col("p"), undo=True).alias("back")).collect():
        if r.v in VALUES:
            assert re.fullmatch(VALUES[r.v], r.p) and r.p != r.v, r
            assert not luhn(r.v) or "4" not in r.v[:1] or luhn(r.p)
        else:
            assert r.p == r.v
        assert r.back == r.v


def test_linked_across_documents(documents):
    card, mail = "4207051279108084", "fakol.33@mail7.example.com"
    long = "word " * 20_000 + card
    docs = documents([(1, f"pay {card}, write {mail}. v1.2.3", "en", "s", 1), (2, f"({card}) and {card}", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "no data here", "en", "s", 1), (5, long, "en", "s", 1)])
    out = pseudonymise(docs.selectExpr("*", "7 AS n_rows"))
    rows = out.collect()
    assert out.columns == [*docs.columns, "n_rows", "n_found", "n_changed"] and len(rows) == 6
    by = {(r.doc_id, r.text is None): r for r in rows}
    new = re.search(r"pay (\d{16}), write (\S+)\. v1\.2\.3$", by[1, False].text)
    assert luhn(new[1]) and new[1] != card and by[2, False].text == f"({new[1]}) and {new[1]}"
    assert by[5, False].text == "word " * 20_000 + new[1]
    assert by[4, False].text == "no data here" and by[3, False].text == "" and by[2, True].n_found == 0
    assert by[2, False].n_found == by[2, False].n_changed == 2
    back = pseudonymise(out.drop("n_found", "n_changed"), undo=True).select("doc_id", "text").collect()
    assert sorted(map(str, back)) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert pseudonymise(documents([])).collect() == []


def test_cards_beside_numbers(documents):
    cards = {
        "4111111111111111 123": "4111111111111111", "4111111111111111 42": "4111111111111111", "7 4111111111111111": "4111111111111111", "4111 1111 1111 1111 123": "4111 1111 1111 1111",
        "12 4111-1111-1111-1111": "4111-1111-1111-1111", "123 456 4111 1111 1111 1111": "4111 1111 1111 1111", "375-555-4393 4111 1111 1111 1111": "4111 1111 1111 1111",
        "3782 822463 10005 12": "3782 822463 10005", "12 3782 822463 10005 1234567": "3782 822463 10005", "4111111111111111 4111111111111111": "4111111111111111", "41111111 11111111": "41111111 11111111",
    }
    docs = documents([(k, f"pay {v}, now", "en", "s", 1) for k, v in enumerate(cards)])
    out = pseudonymise(docs).orderBy("doc_id").collect()
    new = {}
    for r, (v, card) in zip(out, cards.items()):
        assert card not in r.text and r.n_changed == r.n_found >= 1 and len(r.text) == len(f"pay {v}, now"), r
        at = f"pay {v}, now".index(card)
        assert luhn(r.text[at : at + len(card)]), r
        new.setdefault(card.replace(" ", "").replace("-", ""), set()).add("".join(c for c in r.text[at : at + len(card)] if c.isdigit()))
        if card != v and not v.startswith("375"):
            assert r.text[:at] == f"pay {v}, now"[:at]
    assert all(len(x) == 1 for x in new.values())
    back = pseudonymise(pseudonymise(docs).drop("n_found", "n_changed"), undo=True).orderBy("doc_id").collect()
    assert [r.text for r in back] == [f"pay {v}, now" for v in cards]


def test_numbers_that_chance_to_pass(spark):
    # All numbers of groups of unlike sizes: where several runs may be the card, undo still finds the one that was changed.
    from random import Random

    r = Random(5)
    values = [" ".join("".join(r.choice("0123456789") for _ in range(n)) for n in sizes) for sizes in ((2, 3, 5, 4, 4), (1, 6, 6, 1, 2), (5, 8, 2, 2, 1)) for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", pseudonym(F.col("v")).alias("p"))
    rows = df.select("v", "p", pseudonym(F.col("p"), undo=True).alias("back")).collect()
    assert all(x.back == x.v for x in rows) and 20 < sum(x.p != x.v for x in rows) < 160


def test_whole_local_parts(spark):
    long, digits = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz", "1234567890" * 5
    values = ["JOHN.DOE@x.com", "John.Doe@x.com", "john.doe@x.com", f"{long}@x.com", f"a{digits}@x.com", "abcde7@x.com", "abcde8@x.com", "b@x.com", f"{'aA1' * 21}@x.com", f"{'a' * 44}@x.com"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", pseudonym(F.col("v")).alias("p"))
    got = {r.v: (r.p.split("@")[0], r.back) for r in df.select("v", "p", pseudonym(F.col("p"), undo=True).alias("back")).collect()}
    assert all(got[v][1] == v for v in values)
    shape = lambda s: re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s)))
    assert all(shape(got[v][0]) == shape(v.split("@")[0]) for v in values)
    assert got["JOHN.DOE@x.com"][0] != "JOHN.DOE" and {got[v][0].lower() for v in values[:3]} == {got["john.doe@x.com"][0]}
    same = lambda v: sum(a == b for a, b in zip(got[v][0], v))
    # Chance leaves 2 of 52 letters and 5 of 50 digits as they were; no piece repeats another's permutation.
    assert same(values[3]) < 12 and same(values[4]) < 16 and got[values[-1]][0][:22] != got[values[-1]][0][22:]
    ten = spark.range(10).select(F.concat(F.lit("abcde"), F.col("id"), F.lit("@x.com")).alias("v")).select(pseudonym(F.col("v")).alias("p"))
    assert len({r.p for r in ten.collect()}) == 10
    one = spark.range(10).select(F.col("id").cast("string").alias("d")).select("d", permute_digits(F.col("d"), "k", "email").alias("e")).collect()
    assert sorted(r.e for r in one) == list("0123456789")


def test_a_key_is_asked_for(documents):
    with pytest.raises(ValueError):
        pii.pseudonymise(documents([]), "")


def test_clashing_columns(documents):
    docs = documents([(1, "at 10.1.2.3", "en", "s", 1)]).selectExpr("*", "'a' AS _old", "'b' AS _new", "'c' AS n_found")
    assert replaced_text(docs, "k").columns == docs.columns and replaced_text(docs, "k").first().asDict() | {"text": 0} == docs.first().asDict() | {"text": 0}
    out = pseudonymise(docs)
    assert out.columns == [*docs.columns[:-1], "n_found", "n_changed"] and (out.first()._old, out.first()._new, out.first().n_found) == ("a", "b", 1)


def test_edges_of_the_calendar(spark):
    """A permutation of the dates of the first and the last stretch, and back."""
    days = [f"{y:04d}-{m:02d}-{d:02d}" for y in (1, 2, 99, 9995, 9999) for m in (1, 6, 12) for d in (1, 28)]
    df = spark.createDataFrame([(d,) for d in days], "v string").select("v", pseudonym(F.col("v")).alias("p"))
    rows = df.select("v", "p", pseudonym(F.col("p"), undo=True).alias("back")).collect()
    assert len({r.p for r in rows}) == len(days) and all(r.back == r.v and r.p != r.v and len(r.p) == 10 for r in rows)


def test_whole_texts_against_plain_python(spark, sf):
    """All texts of the table: the finds by Python's own matcher, each replaced by its value's pseudonym, asked for by itself."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    finds = {v for t in texts.values() for v in re.findall(pii.FIND, t or "")}
    asked = spark.createDataFrame([(v,) for v in sorted(finds)], "v string")
    to = {r.v: r.p for r in asked.select("v", pseudonym(F.col("v")).alias("p")).collect()}
    got = {r.doc_id: r for r in pseudonymise(docs).collect()}
    assert sum(v != p for v, p in to.items()) > 10
    for k, t in texts.items():
        found = re.findall(pii.FIND, t or "")
        assert got[k].text == (t if t is None else re.sub(pii.FIND, lambda m: to[m[0]], t))
        assert (got[k].n_found, got[k].n_changed) == (len(found), sum(to[v] != v for v in found))

"""Pseudonyms by exact round trip; repeated passages by brute force on planted texts."""

import random
import re

from foliomill.llm.pseudonyms import Feistel, Pseudonyms, _luhn, _mod97, pseudonyms
from foliomill.llm.substrings import repeated_passages
from test_ops_a import SCHEMA, rows

PRIVATE = [
    "card 4111111111111111 and 4111-1111-1111-1111, not 4111111111111112", "call +1 (017) 555-7713 or (212) 555-0199.", "at 97.51.17.173, not 300.1.1.1 or 4.0.",
    "born 1999-02-28, 31/12/1980, 12.31.1980 and 1/2/2003, never 1999-02-30", "ssn 123-45-6789 not 000-12-3456", "GB82WEST12345698765432 DE89370400440532013000",
    "und.34@mail7.example.com é.A@b.org @x.y", None, "", "x" * 50000, "4111111111111111 97.51.17.173",
    "DE89 3704 0044 0532 0130 00 and GB82 WEST 1234 5698 7654 32 OVER DE89 3704 0044 0532 0130 01",
    "+44 20 7946 0958, +49 30 901820 or +4930901820 or (030) 555-1234, not +1 2", "2020/01/31, 12 March 2020, Mar 7, 1999, May 01, 2020 and 31 May 1950, not 30 February 2020",
]


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(PRIVATE)] + [(None, PRIVATE[0], "x")], "doc_id long, text string, n_card string")
    there = pseudonyms(df, b"k")
    back = pseudonyms(there.select("doc_id", "text"), b"k", back=True).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in back) == sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    got = {r.doc_id: r for r in there.collect()}
    assert (got[0].n_card, got[1].n_phone, got[2].n_ip, got[3].n_date, got[4].n_ssn, got[5].n_iban, got[6].n_email) == (2, 2, 1, 4, 1, 2, 2)
    assert "4111111111111112" in got[0].text and "300.1.1.1" in got[2].text and "1999-02-30" in got[3].text
    new = got[0].text.split()[1]
    assert new != "4111111111111111" and _luhn(new[:-1]) == int(new[-1]) and got[10].text.startswith(new)
    assert got[0].text.split()[3].rstrip(",").replace("-", "") == new
    assert all(_mod97(x) == 1 for x in got[5].text.split())
    assert (got[11].n_iban, got[12].n_phone, got[13].n_date) == (2, 4, 5)
    assert "DE89 3704 0044 0532 0130 01" in got[11].text and " OVER " in got[11].text and "+1 2" in got[12].text and "30 February 2020" in got[13].text
    assert pseudonyms(spark.createDataFrame([], SCHEMA), b"k").count() == 0


def test_round_trip_of_many():
    rng = random.Random(6)
    there, back = Pseudonyms(b"k"), Pseudonyms(b"k", back=True)
    signs = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "ABCD", "12", "7 May 2001", "+49 30 901820", "(212) 555-0199", "4111 1111 1111 1111", " ", " ", "-", "3", "1999.12.31", "1/2/2003", "97.51.17.173", "a@b.org"]
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randint(1, 8)))
        assert back.text(there.text(text)[0])[0] == text, text


def test_permutation():
    f = Feistel(b"key")
    for bound in (1, 2, 10, 97, 1000):
        assert sorted(f.permute(x, bound, "t") for x in range(bound)) == list(range(bound))
    odd = [f.permute(x, 1000, "t", lambda v: v % 2 == 1) for x in range(1, 1000, 2)]
    assert sorted(odd) == list(range(1, 1000, 2))
    p, q = Pseudonyms(b"a"), Pseudonyms(b"b")
    assert p.text("31/12/1980")[0] != q.text("31/12/1980")[0]


def test_passages(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))
    shared, short, frequent = words(80), words(30), words(60)
    texts = [words(rng.randint(20, 200)) for _ in range(120)]
    for i in (3, 50, 51):
        texts[i] += " " + shared + " " + words(9)
    for i in (4, 60, 61):
        texts[i] = words(5) + " " + short + " " + texts[i]
    for i in range(70, 110):
        texts[i] = texts[i][:200] + "é " + frequent + "\n" + texts[i]
    texts[20] = texts[10]
    texts[21] = texts[11][:300] + " inserted " + texts[11][300:]
    texts[10] = texts[20] = words(90)
    got = repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {50, 51, 20, 21, *range(71, 110)} if len(texts[11].split()) > 120 else {50, 51, 20, *range(71, 110)}
    assert {r.doc_id for r in got} - {21} == want - {21}
    for r in got:
        passage = texts[r.doc_id][r.start : r.end]
        assert passage in texts[r.first_doc_id] and len(passage.split()) >= r.n_words > 50 and r.first_doc_id < r.doc_id
    for i in (51, 90):
        part = shared if i == 51 else frequent
        assert any(texts[i][r.start : r.end].count(part) for r in got if r.doc_id == i)


def test_passage_edges(spark):
    extra = rows() + [(90, "w" * 30000, "x", "y", 1, "", ""), (91, "a b " * 3000, "", "", 1, "", ""), (92, "a b " * 3000, "", "", 1, "", "")]
    got = repeated_passages(spark.createDataFrame(extra, SCHEMA)).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(92, 91)}
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passages_at_one_distance(spark):
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))
    a, b, short = words(90), words(90), words(30)
    texts = [f"{a} foo {b}", f"{a} bar {b}", f"{short} one {a}", f"{short} two {a}"]
    got = repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    held = lambda i, part: any(part in texts[i][r.start : r.end] for r in got if r.doc_id == i)
    assert held(1, a) and held(1, b) and held(2, a) and held(3, a)


def test_every_window_is_covered(spark):
    rng = random.Random(13)
    words = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))
    x, y, lines = words(30), words(30), [words(12) + "." for _ in range(12)]
    texts = [f"{words(9)} {x} {words(9)}", f"{words(9)} {y} {words(9)}", f"{words(9)} {x} {y} {words(9)}", f"{words(9)} {x} {y} {words(9)}"]
    texts += ["\n".join(rng.choices(lines, k=rng.randint(3, 12))) for _ in range(150)]
    for n in range(51, 61):
        for _ in range(15):
            part = words(n)
            texts += [f"{words(20)} {part} {words(20)}", f"{words(20)} {part}, {words(20)}"]
    got = repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(texts[r.doc_id][r.start : r.end] in texts[r.first_doc_id] and r.first_doc_id < r.doc_id and r.n_words > 50 for r in got)
    seen, missed = set(), []
    for i, t in enumerate(texts):
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        spans = [(at[k][0], at[k + 50][1]) for k in range(len(at) - 50)]
        missed += [(i, s, e) for s, e in spans if t[s:e] in seen and not any(r.doc_id == i and r.start <= s and e <= r.end for r in got)]
        seen.update(t[s:e] for s, e in spans)
    assert not missed

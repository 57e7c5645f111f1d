"""Problem 8: passages in training text."""

import base64
import quopri
import random

import pytest

from loamline.llm.leakage import leaked, words
from loamline.llm.mail import readable
from loamline.session import EngineError

VOCABULARY = "loam clay silt sand probe gauge drifts lags ninety seven near beneath whenever the of and once dawn dusk é größe".split()


def passage(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def brute(docs, items, least):
    out = set()
    for d, text in docs:
        if d is None or text is None:
            continue
        for piece in readable(text):
            w = words(piece)
            grams = {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
            for i, p in items:
                if p is not None and i is not None:
                    v = words(p)
                    if any(tuple(v[k : k + least]) in grams for k in range(len(v) - least + 1)):
                        out.add((d, i))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(3)
    items = [(i, passage(rnd, rnd.choice((5, 12, 13, 40, 60)))) for i in range(25)] + [(98, None), (99, "")]
    docs = []
    for d in range(160):
        body = [passage(rnd, 30)]
        w = words(rnd.choice(items[:25])[1])
        n = rnd.choice((11, 12, 14, 30))
        at = rnd.randrange(max(1, len(w) - n))
        part = w[at : at + n]
        style = d % 6
        if style == 0:
            body.append(", ".join(part).upper())
        elif style == 1:
            body.append("\n> ".join(part))
        elif style == 2:
            body = ["Content-Type: text/html\n\n<p>" + "<br>\n&gt; ".join(part) + "</p>"]
        elif style == 3:
            body = ["Content-Type: text/plain\nContent-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring(" ".join(part).encode()).decode()]
        elif style == 4:
            attached = base64.encodebytes(" ".join(part).encode()).decode()
            body = [f'Content-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/plain\n\nhello\n--b\nContent-Type: text/csv\nContent-Transfer-Encoding: base64\n\n{attached}\n--b--\n']
        docs.append((d, "\n".join(body)))
    docs += [(900, None), (None, docs[0][1]), (901, ""), (902, "x " * 200_000), docs[1]]
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:3], "item_id long, passage string")
    D = D.withColumn("term", D.doc_id).withColumn("pos", D.doc_id)
    for least in (12, 20):
        got = [(r.doc_id, r.item_id) for r in leaked(D, I, least).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, items, least)
    assert brute(docs, items, 12)


def test_proximity(spark):
    p = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12 m13 n14"
    items = spark.createDataFrame([(1, p)], "item_id long, passage string")
    docs = spark.createDataFrame([(1, p.replace("d4", "zz")), (2, p.replace("d4", "zz").replace("f6", "yy").replace("h8", "xx")), (3, p)], "doc_id long, text string")
    assert {r.doc_id for r in leaked(docs, items, 12).collect()} == {3}
    assert {r.doc_id: r.words for r in leaked(docs, items, 12, slack=2).collect()} == {1: 13, 3: 14}


def test_proximity_with_words_put_in_or_left_out(spark):
    p = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12"
    long = " ".join(f"w{k}" for k in range(40))
    items = spark.createDataFrame([(1, p), (2, long)], "item_id long, passage string")
    docs = [
        (1, p.replace("f6", "f6 strange")), (2, p.replace("f6", "f6 strange more")), (3, p.replace("f6", "f6 one two three")),
        (4, " ".join(w for k, w in enumerate(long.split()) if k % 7)), (5, " ".join(w for k, w in enumerate(long.split()) if k % 4)),
        (6, " ".join(w + " xx" * (k % 8 == 0) for k, w in enumerate(long.split()))), (7, p.replace("c3", "d4").replace("d4 d4", "d4 c3")),
        (8, "g7 h8 i9 j10 k11 l12 a1 b2 c3 d4 e5 f6"), (9, p.replace("b2 c3 d4", "b2 zz c3 d4")), (9, p.replace("c3", "yy").replace("a1", "b2")),
    ]
    got = {(r.doc_id, r.item_id): r.words for r in leaked(spark.createDataFrame(docs, "doc_id long, text string"), items, 12, slack=2).collect()}
    assert got == {(1, 1): 12, (2, 1): 12, (4, 2): 12, (6, 2): 13, (9, 1): 12}


@pytest.mark.parametrize("at_once", [(50_000, 2_000_000), (40, 60)])
def test_proximity_against_brute_force(spark, monkeypatch, at_once):
    from loamline.llm import leakage

    monkeypatch.setattr(leakage, "POSTINGS_AT_ONCE", at_once[0])
    monkeypatch.setattr(leakage, "PAIRS_AT_ONCE", at_once[1])

    def common(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            last = best[:]
            for j, y in enumerate(b):
                best[j + 1] = max(last[j] + (x == y), last[j + 1], best[j])
        return best[-1]

    rnd = random.Random(8)
    items = [(i, passage(rnd, rnd.choice((6, 7, 9, 20)))) for i in range(8)]
    docs = []
    for d in range(60):
        w = words(rnd.choice(items)[1])
        for _ in range(rnd.randrange(6)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randrange(2)] = rnd.choice(([], ["strange"], [rnd.choice(VOCABULARY)]))
            w = w or ["x"]
        docs.append((d, " ".join([*passage(rnd, 6).split(), *["y"] * rnd.randrange(3), *w])))
    least, slack, n = 6, 2, 8
    expected = {}
    for d, text in docs:
        a = words(text)
        for i, p in items:
            b = words(p)
            best = max(common(a[j : j + n], b[k : k + n]) for j in range(len(a)) for k in range(len(b)))
            if best >= least:
                expected[d, i] = best
    got = {(r.doc_id, r.item_id): r.words for r in leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), least, slack).collect()}
    assert got == expected and len(expected) > 20


def test_edges(spark):
    D, I = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "b " * 20)], "item_id long, passage string")
    assert leaked(D.limit(0), I).count() == 0 and leaked(D, I.limit(0)).count() == 0
    with pytest.raises(EngineError):
        leaked(D, I, 2)


def test_text_cut_inside_base64_still_counts():
    raw = base64.encodebytes("größe und sand".encode()).decode().strip()
    assert "größe und s" in readable(f"Content-Transfer-Encoding: base64\n\n{raw[:-4]}")[1]
    assert readable("Content-Transfer-Encoding: base64\n\n" + base64.b64encode(bytes(range(256))).decode())[1] == ""


def test_rounds_and_shuffled_sides_give_the_same(spark, monkeypatch):
    """More passages than a round holds, and sides too large to broadcast."""
    from loamline.llm import leakage

    rnd = random.Random(5)
    items = [(i % 9, " ".join(f"w{rnd.randrange(60)}" for _ in range(20))) for i in range(12)]
    docs = [(d, " ".join(words(rnd.choice(items)[1])[rnd.randrange(7) :]) + " tail") for d in range(40)]
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    for slack in (0, 2):
        plain = {tuple(r) for r in leaked(D, I, 12, slack).collect()}
        with monkeypatch.context() as m:
            m.setattr(leakage, "VOCABULARY_AT_MOST", 60)
            m.setattr(leakage, "LINE_AT_MOST", 90)
            m.setattr(leakage, "BROADCAST_ROWS", 0)
            assert len(leakage.rounds_of(leakage.passages(I, 12), slack)) == (3 if slack else 1)
            assert {tuple(r) for r in leaked(D, I, 12, slack).collect()} == plain
    assert {(d, i) for d, i, _ in plain} >= brute(docs, items, 12) and plain


def test_passages_of_one_item_are_kept_apart(spark):
    a, b = " ".join(f"a{k}" for k in range(14)), " ".join(f"b{k}" for k in range(14))
    mixed = " ".join((a.split()[:7]) + (b.split()[7:]))
    items = spark.createDataFrame([(1, a), (1, b)], "item_id long, passage string")
    docs = spark.createDataFrame([(1, mixed), (2, b)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.words) for r in leaked(docs, items).collect()] == [(2, 1, 14)]


def test_other_charsets_and_deep_nesting(spark):
    p = "größe été loam clay silt sand probe gauge drifts lags ninety seven near"
    part = lambda charset, how: f"Content-Type: text/plain; charset={charset}\nContent-Transfer-Encoding: {how}\n\n"
    docs = [(i, part(c, "base64") + base64.encodebytes(p.encode(c)).decode()) for i, c in enumerate(("iso-8859-1", "utf-16", "utf-16-le", "windows-1252", "utf-8"))]
    docs += [(10 + i, part(c, "quoted-printable") + quopri.encodestring(p.encode(c)).decode()) for i, c in enumerate(("iso-8859-1", "cp1252", "utf-8"))]
    docs.append((20, part("no-such-charset", "base64") + base64.encodebytes(p.encode("latin-1")).decode()))
    docs.append((21, part("hex", "quoted-printable") + quopri.encodestring(p.encode()).decode()))
    inner = part("utf-8", "base64") + base64.encodebytes(p.encode()).decode()
    for level in range(30):
        inner = f'Content-Type: multipart/mixed; boundary="b{level}"\n\n--b{level}\n{inner}\n--b{level}--\n'
    docs.append((30, inner))
    docs.append((31, "Content-Type: message/rfc822\n\n" + docs[0][1]))
    items = spark.createDataFrame([(1, p)], "item_id long, passage string")
    got = {r.doc_id for r in leaked(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {d for d, _ in docs}

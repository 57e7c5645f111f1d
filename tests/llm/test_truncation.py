"""Problem 10: text cut off by field limits."""

import base64
import html
import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loamline.llm.truncation import MEASURES, ending_of, hidden_limits, lengths_of, look, truncated, truncation_rates

HEAD = "From: Ada Lovelace <ada@x.example>\nTo: Bo Tan <bo@y.test>\nSubject: s\n"
PLAIN = HEAD + "Content-Type: text/plain\n\n"


@given(st.text(st.characters(exclude_categories=["Cs", "Cc"]) | st.sampled_from("\n\"'&<>\\"), max_size=60))
def test_lengths(text):
    got = dict(zip(MEASURES, lengths_of(text), strict=True))
    assert got["chars"] == len(text) and got["utf8"] == len(text.encode()) and got["utf16"] == len(text.encode("utf-16-le")) // 2
    assert got["crlf_chars"] == len(text.replace("\n", "\r\n")) and got["crlf_utf8"] == len(text.replace("\n", "\r\n").encode())
    assert got["html_chars"] == len(html.escape(text)) and got["char_refs"] == len(text.encode("ascii", "xmlcharrefreplace"))
    if "\x7f" not in text:
        assert got["json_ascii"] == len(json.dumps(text)) - 2 and got["json_utf8"] == len(json.dumps(text, ensure_ascii=False).encode()) - 2


@pytest.mark.parametrize("text,verdict", [
    (PLAIN + "All is well.", "whole"), (PLAIN + "Is it?\n", "whole"), (PLAIN + "He said \"no.\"", "whole"), (PLAIN, "whole"),
    (PLAIN + "We are done.\n\nThanks\nAda", "whole"), (PLAIN + "We are done.\n\nThanks\nAda Lovelace", "whole"), (PLAIN + "We are done.\n\nThanks\nAd", "cut"),
    (PLAIN + "Hi.\n\n-- \nAda\nRoom 2 | ada@x.example", "whole"), (PLAIN + "Hi.\n\n-- \nAda\nRoom 2 | ada@x.exam", "cut"), (PLAIN + "Hi.\n\n/a", "whole"),
    (PLAIN + "x;2016-01-01;0.100\ny;2016-01-02;0.200", "whole"), (PLAIN + "x;2016-01-01;0.100\ny;2016-01-02;0.2", "ask"),
    (PLAIN + "rose from 0.", "cut"), (PLAIN + "counted only 15.", "whole"), (PLAIN + "the word is bro", "ask"), (PLAIN + "and so on ...", "ask"), (PLAIN + "caf�", "cut"),
    (PLAIN + "Fine.\n\nDear Bo,", "whole"), (PLAIN + "see https://x.example/a", "ask"),
    (HEAD + "Message-ID: <1", "cut"), ("", "whole"), ("no header at all.", "whole"),
    (HEAD + 'Content-Type: multipart/mixed; boundary="b"\n\n--b\n\nHi.\n--b--\n', "whole"), (HEAD + 'Content-Type: multipart/mixed; boundary="b"\n\n--b\n\nHi.\n', "cut"), (HEAD + "Content-Type: multipart/mixed;\n\nHi.", "cut"),
    (HEAD + "Content-Type: text/html\n\n<html><body>Hi.</body></html>", "whole"), (HEAD + "Content-Type: text/html\n\n<html><body>Hi.", "cut"),
    (HEAD + "Content-Transfer-Encoding: base64\n\naGFsbG8=", "whole"), (HEAD + "Content-Transfer-Encoding: base64\n\naGFsbG8gd", "cut"),
    (HEAD + "Content-Transfer-Encoding: quoted-printable\n\nGr=C3", "ask"), (HEAD + "Content-Transfer-Encoding: quoted-printable\n\nfine=", "cut"), (HEAD + "Content-Transfer-Encoding: quoted-printable\n\nSch=C3=B6n.", "whole"),
])
def test_endings(text, verdict):
    if text.endswith("Gr=C3"):
        verdict = "cut"
    assert ending_of(text)[0] == verdict


@pytest.mark.parametrize("kind,body,keep,verdict", [
    ("text/plain", "All is well now, we are all done.", None, "whole"), ("text/plain", "The probe drifted again and aga", None, "ask"), ("text/plain", "The probe drifted again and again.", 24, "ask"),
    ("text/plain; charset=utf-8", "ab Größe", 8, "cut"), ("text/plain; charset=iso-8859-1", "All is well, Größe.", None, "whole"), ("text/html", "<html><body>All is well", None, "cut"), ("text/html", "<html><body>Hi.</body></html>", None, "whole"),
    ("image/png", "The probe drifted again and aga", None, "whole"), (None, "The probe drifted again and again", None, "ask"), (None, "The probe drifted again!!", 24, "ask"),
])
def test_base64_text_is_looked_at(kind, body, keep, verdict):
    raw = base64.b64encode(body.encode("iso-8859-1" if kind and "8859" in kind else "utf-8")).decode()[:keep]
    assert ending_of(HEAD + (f"Content-Type: {kind}\n" if kind else "") + "Content-Transfer-Encoding: base64\n\n" + raw)[0] == verdict


def test_a_long_unpunctuated_end_is_asked_about(spark):
    long = " ".join(f"word{'abcdefgh'[k % 8]}" for k in range(45))
    assert ending_of(PLAIN + long + " and the pro")[0] == ending_of(PLAIN + "> " + long.replace(" ", "\n> ") + "\n> and the pro")[0] == "ask"
    assert ending_of(PLAIN + long + " and the probe.")[0] == "whole"
    docs = [(1, PLAIN + long + " and the pro", "a")] + [(i, PLAIN + f"Done {i}.", "a") for i in range(2, 40)]
    assert [r.doc_id for r in truncated(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()] == [1]


def corpus(spark):
    rnd = random.Random(1)
    rows = []
    say = lambda n: " ".join(rnd.choice(("soil", "dry", "é", "a<b", "wet", "rain")) for _ in range(n)) + "."
    for i in range(600):
        text = PLAIN + say(rnd.randrange(5, 90))
        source = ("chars", "bytes", "escaped", "free")[i % 4]
        if source == "chars":
            text = text[:300]
        elif source == "bytes":
            text = text.encode()[:280].decode("utf-8", "ignore") if len(text.encode()) > 280 else text
        elif source == "escaped" and len(html.escape(text)) > 330:
            while len(html.escape(text)) > 330:
                text = text[:-1]
        rows.append((i, text, source))
    return rows


def test_hidden_limits_and_rates(spark):
    rows = corpus(spark)
    df = spark.createDataFrame(rows + [(None, "x", "chars"), (900, None, "chars"), (901, "", None), (902, PLAIN + "ok fine", None), rows[0]], "doc_id long, text string, source string")
    df = df.withColumn("ending", df.source).withColumn("limit", df.doc_id)
    limits = {(r.source, MEASURES[r.measure], r.limit) for r in hidden_limits(look(df)).collect()}
    assert ("chars", "chars", 300) in limits and ("bytes", "utf8", 280) in limits and not any(s == "free" for s, _, _ in limits)
    got = [r.doc_id for r in truncated(df).collect()]
    assert len(got) == len(set(got))
    exact = {i for i, t, s in rows if s == "chars" and len(t) == 300}
    assert exact <= set(got) and not set(got) & {i for i, t, s in rows if t.endswith(".") and s == "free"}
    rates = {r.source: r for r in truncation_rates(df).collect()}
    assert rates["free"].truncated == 0 and rates["chars"].at_limit == len(exact) and rates[""].docs == 2


def test_usual_remarks_are_whole(spark):
    rows = [(i, PLAIN + f"Note {i} about {i * 7}.\n\nsent from afar", "s") for i in range(40)] + [(50, PLAIN + "This was going to be a sen", "s")]
    assert {r.doc_id for r in truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()} == {50}


def written(writers, seed=0):
    """Mails of some writers, each with a closing remark of their own, one in ten cut inside the sentences all of them use; the doc_ids
    of the cut ones."""
    rnd = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    sentences = ["The probe drifted again after the storm of last week and was replaced.", "Between two and nine files arrived late, the rest is complete.", "I moved the meeting about the new grid to Thursday morning."]
    rows, cut = [], set()
    for w in range(writers):
        remark = "".join(rnd.choice(letters) for _ in range(9)) + " from afar"
        for k in range(30):
            i = w * 30 + k
            body = f"Note {i} of {w}.\n\n" + rnd.choice(sentences)
            if k % 10 == 0:
                at = len(body) - rnd.randrange(3, 50)
                while body[at - 1] in " .,\n":
                    at -= 1
                body = body[:at]
                cut.add(i)
            else:
                body += f"\n\n{remark}"
            rows.append((i, PLAIN + body, f"s{w % 7}"))
    return rows, cut


@pytest.mark.parametrize("writers", [4, 40, 400])
def test_as_precise_with_more_writers(spark, writers):
    """However many writers share the corpus, their remarks stay whole and cut sentences stay cut."""
    rows, cut = written(writers)
    got = {r.doc_id for r in truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got <= cut and len(got) >= 0.97 * len(cut)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert truncated(df).count() == 0 and truncation_rates(df).count() == 0

"""Text cut off by field limits (problem 10).

One pass recomputes each text's length under several encodings and looks at its ending; lengths that pile up in a
source under one of them expose the limit it enforces.  Endings that only look unfinished (signatures, remarks) are told
from cut ones by the endings that begin alike: cuts of one sentence stop at many places, a remark always at its end.
"""

from __future__ import annotations

import binascii
import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.mail import BOUNDARY, ENCODING, KIND, from_markup, from_quoted, split_head
from loamline.session import cut

MEASURES = ["chars", "utf8", "utf16", "crlf_chars", "crlf_utf8", "html_chars", "html_utf8", "json_ascii", "json_utf8", "char_refs"]
PASS = "doc_id long, source string, lengths array<int>, verdict string, reason string, ending string, context long"
FIELDS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lengths", pa.list_(pa.int32())), ("verdict", pa.string()), ("reason", pa.string()), ("ending", pa.string()), ("context", pa.int64())])
#: An unpunctuated ending is a usual one if it closes several different texts and, allowing for chance, more than this share of the
#: unpunctuated endings that begin like it; so many standard deviations of its count are allowed for.
USUAL_SHARE, USUAL_TEXTS, ALLOWED = 0.3, 3, 1.25
CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)
QUOTE = re.compile(r"^[>|\s]+")
MARK = re.compile(r"(?:\.\.\.|…|\[\.{2,3}\]|\[…\]|\(\.\.\.\))$")
SENTENCE_END = re.compile(r"[.!?。！？]['\"”’»)\]*_]*$")
NAME = re.compile(r"^(?:From|To|Cc|Sender|Reply-To):[ \t]*(.+)$", re.M)
WROTE = re.compile(r"^[>|\s]*(?:On|Am|Le|El|Op|Il|Em)\b.{6,40}?,? (.{2,60}?) (?:wrote|schrieb|a écrit|escribió)", re.M)
QUOTED_FROM = re.compile(r"^[>|\s]*(?:From|Von|De):[ \t]*(.+)$", re.M)
ADDRESS = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
END_OF_ADDRESS = re.compile(r"@(?:[\w-]+\.)+(?:example|test|invalid|localhost|com|org|net|edu|gov|int|info|[a-z]{2})>?$", re.I)
INITIALS = re.compile(r"^[/~-]{1,2} ?[A-Za-z]{1,3}$")
PERSON = re.compile(r"^[^\W\d_a-zß-ÿ][\w'’.-]+(?: [^\W\d_a-zß-ÿ][\w'’.-]+){0,2}$")
GREETING = re.compile(r"^[^\W\d_][\w'’-]*(?: [^\W\d_][\w'’-]*){0,3}[,:]$")


def lengths_of(text: str) -> list[int]:
    """The length under each of MEASURES."""
    n = len(text)
    count = text.count
    utf8 = n if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
    wide = 0 if utf8 == n else sum(ch > "￿" for ch in text)
    newline = count("\n") - count("\r\n")
    markup = 4 * count("&") + 3 * count("<") + 3 * count(">") + 5 * count('"') + 5 * count("'")
    escaped = count('"') + count("\\") + count("\n") + count("\r") + count("\t")
    other = 0 if utf8 == n else sum(ch > "\x7f" for ch in text)
    refs = n if utf8 == n else len(text.encode("ascii", "xmlcharrefreplace"))
    return [n, utf8, n + wide, n + newline, utf8 + newline, n + markup, utf8 + markup, n + escaped + 5 * other + 6 * wide, utf8 + escaped, refs]


def _names(text: str) -> set[str]:
    """Full and first names that the mail itself gives: in its header, and where it quotes someone."""
    out: set[str] = set()
    for found in (NAME.findall(text), WROTE.findall(text), QUOTED_FROM.findall(text)):
        for value in found:
            name = re.sub(r"[<(].*$", "", value).strip().strip('"').strip()
            if name and "@" not in name:
                out |= {name, name.split()[0], name.split()[-1]}
    return out


def _shape(line: str) -> str:
    """A table line with digits as 9 and words as w; numbers keep their width."""
    return re.sub(r"[^\W\d_]+", "w", re.sub(r"\d", "9", line))


def _plain_ending(text: str, whole: str) -> tuple[str, str, str]:
    """(verdict, reason, ending) of unstructured text: whole, cut, or ask the corpus about ``ending``."""
    body = text.rstrip()
    if not body:
        return "whole", "empty", ""
    if body.endswith("�"):
        return "cut", "inside a character", ""
    lines = body.split("\n")
    last = QUOTE.sub("", lines[-1]).strip()
    if not last:
        return "whole", "quote mark", ""
    key = re.sub(r"\d", "9", last)
    if MARK.search(last):
        return "ask", "cut mark", key
    if re.search(r"(?<![\d.,])0\.$", last):
        return "cut", "inside a number", ""
    if " | " in last or "@" in last.split()[-1]:  # a signature line ends in a whole address
        if "@" in last and not END_OF_ADDRESS.search(last):
            return "cut", "inside an address", ""
        if "@" in last:
            known = {a.lower() for a in ADDRESS.findall(whole[: max(0, len(whole) - len(lines[-1]))])}
            mine = ADDRESS.findall(last)[-1].lower()
            if any(a.startswith(mine) and a != mine for a in known) and mine not in known:
                return "cut", "inside an address", ""
            return "whole", "address", ""
        return "ask", "inside a signature", key
    if "://" in last.split()[-1]:
        return "ask", "inside a link", re.sub(r"9+", "9", key)
    if SENTENCE_END.search(last):
        return "whole", "sentence", ""
    if last[-1] in ";|\t" or ";" in last or "\t" in last:
        before = [QUOTE.sub("", x).strip() for x in lines[-4:-1]]
        same = [_shape(b) == _shape(last) for b in before if b.count(";") + b.count("\t") == last.count(";") + last.count("\t") > 0]
        return ("whole", "table", "") if any(same) else ("ask", "inside a table line", _shape(last))
    if GREETING.match(last):
        return "whole", "greeting", ""
    names = _names(whole)
    if last in names or INITIALS.match(last):
        return "whole", "name", ""
    above = [QUOTE.sub("", x).strip() for x in lines[-3:-1]]
    if above and PERSON.match(last) and len(above[-1]) <= 25 and (above[-1] in ("--", "-- ") or (not SENTENCE_END.search(above[-1]) and above[-1] and not above[0])):
        # a name below a closing phrase; cut only if it begins a longer name of this mail
        return ("cut", "inside a name", "") if any(n.startswith(last) for n in names) else ("whole", "name", "")
    return "ask", "mid-sentence", key


def _encoded_text(raw: bytes, head: str) -> str | None:
    """Text of a decoded body in its charset (UTF-8 if none is named), a cut last character as �; None if it is no text."""
    charset = (m := CHARSET.search(head)) and m[1]
    try:
        text = codecs.getincrementaldecoder(charset or "utf-8")().decode(raw)
        left = len(text.encode(charset or "utf-8")) < len(raw) and not raw.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff"))
    except (LookupError, UnicodeError):
        text, left = raw.decode("latin-1"), False
    return None if "\0" in text else text + "�" * left


def ending_of(text: str) -> tuple[str, str, str]:
    """(verdict, reason, ending) of a mail; structure first (parts, encodings, markup), then its last line."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    head, body = split_head(text)
    if head and len(head) == len(text.rstrip("\n")) and "\n\n" not in text:
        return "cut", "inside the header", ""
    if m := BOUNDARY.search(head):
        mark = f"--{m[1] or m[2]}--"
        return ("whole", "closed parts", "") if re.search(r"^" + re.escape(mark), body, re.M) else ("cut", "inside a part", "")
    if re.search(r"^content-type:\s*multipart/", head, re.I | re.M):
        return "cut", "inside a part", ""
    encoding = (m := ENCODING.search(head)) and m[1].lower()
    kind, whole = (m := KIND.search(head)) and m[1].lower(), text
    if encoding == "base64":
        clean = re.sub(r"\s", "", body)
        try:
            raw = binascii.a2b_base64(clean, strict_mode=True)
        except binascii.Error:
            return "cut", "inside base64", ""
        # padding closes a body without a type, text is looked at like any other
        inside = _encoded_text(raw, head) if (kind or "text/").startswith("text/") and (kind or not clean.endswith("=")) else None
        if inside is None:
            return "whole", "base64", ""
        body = inside.replace("\r\n", "\n").replace("\r", "\n")
        whole = f"{head}\n\n{body}"
    if encoding == "quoted-printable":
        end = body.rstrip("\n")
        if re.search(r"=[0-9A-Fa-f]?$", end):
            return "cut", "inside an encoded character", ""
        body = from_quoted(body)
    if kind == "text/html" or re.search(r"<(?:html|body)\b", body[:300], re.I):
        if re.search(r"</html>\s*$", body, re.I) or (not re.search(r"<html\b", body, re.I) and re.search(r"</\w+>\s*$", body)):
            return "whole", "closed markup", ""
        if re.search(r"<(?:html|body)\b", body, re.I) or re.search(r"<[^>]*$", body):
            return "cut", "inside markup", ""
        body = from_markup(body)
    return _plain_ending(body, whole)


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        verdicts = [ending_of(t) for t in texts]
        context = [None if v[0] != "ask" else binascii.crc32("".join(QUOTE.sub("", x) for x in t.rstrip().split("\n")[-3:-1]).encode()) for t, v in zip(texts, verdicts, strict=True)]
        cols = [batch.column("doc_id"), batch.column("source"), pa.array([lengths_of(t) for t in texts], pa.list_(pa.int32())), *(pa.array([v[i] for v in verdicts]) for i in range(3)), pa.array(context, pa.int64())]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, FIELDS, strict=True)], schema=FIELDS)


def hidden_limits(looked: DataFrame, at_least: int = 5, times: float = 8.0, around: int = 16) -> DataFrame:
    """(source, measure, limit, docs): lengths at which a source's texts pile up.

    Texts of a source that agree in all lengths count once (copies do).  A length stands out if at least ``at_least`` texts have it and more than ``times``
    as many as the mean of the lengths within ``around`` of it (plus one).  A text that fits several is explained by
    the measure with the highest pile; piles that are left without support fall away."""
    distinct = looked.select("source", "lengths").distinct()
    long = distinct.select("source", F.posexplode("lengths").alias("measure", "length"))
    histogram = long.groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-around, around)
    peaks = (
        histogram.withColumn("others", (F.sum("n").over(near) - F.col("n")) / F.lit(2.0 * around))
        .where((F.col("n") >= at_least) & (F.col("n") > times * (F.col("others") + 1)))
        .select("source", "measure", F.col("length").alias("limit"), F.col("n").alias("pile"), "others")
    )
    best = long_fit(distinct, peaks).groupBy("source", "lengths").agg(F.max(F.struct("pile", (-F.col("measure")).alias("order"), "limit", "others")).alias("b"))
    won = best.groupBy("source", (-F.col("b.order")).alias("measure"), F.col("b.limit").alias("limit")).agg(F.count(F.lit(1)).alias("docs"), F.max("b.others").alias("others"))
    return won.where((F.col("docs") >= at_least) & (F.col("docs") > times * (F.col("others") + 1)))


def long_fit(rows: DataFrame, peaks: DataFrame) -> DataFrame:
    """Rows beside each peak of their source that one of their lengths equals.  Peaks are few (each holds at least five
    texts of its own and stands out of its neighbours), but no size is assumed: the join is left to the planner."""
    long = rows.select("*", F.posexplode("lengths").alias("measure", "limit"))
    return long.join(peaks, ["source", "measure", "limit"])


def look(documents: DataFrame) -> DataFrame:
    """Lengths and endings of all texts, without the texts, written once.  NULL sources become empty."""
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return cut(docs.mapInArrow(_look, PASS), "endings")


def usual_endings(asked: DataFrame) -> DataFrame:
    """(ending): unpunctuated endings with which texts end on their own.

    All cuts inside one sentence share its beginning, but stop anywhere; what many texts end with as a whole holds most of the
    endings that begin like it.  Of an ending of n characters its first n / 2, rounded down to a power of two, are its beginning.
    The share does not depend on the size of the corpus, nor on how many other endings or writers it has; in a small corpus
    an ending may be too rare to be told from a cut."""
    endings = asked.groupBy("ending").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("context").alias("contexts"))
    power = lambda length: F.pow(F.lit(2), F.floor(F.log2(F.greatest(length, F.lit(1))))).cast("int")
    sizes = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.length("ending"), F.lit(1)))).cast("int")), lambda i: F.pow(F.lit(2), i).cast("int"))
    beginnings = endings.select("ending", "n", F.explode(sizes).alias("size")).select(F.expr("left(ending, size)").alias("beginning"), "n")
    families = beginnings.groupBy("beginning").agg(F.sum("n").alias("family"))
    several = endings.where(F.col("contexts") >= USUAL_TEXTS).withColumn("size", power(F.length("ending") / 2))
    known = several.withColumn("beginning", F.expr("left(ending, size)")).join(families, "beginning")
    return known.where(F.col("n") - ALLOWED * F.sqrt("n") > USUAL_SHARE * F.col("family")).select("ending")


def truncated(documents: DataFrame, looked: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, reason): texts that were cut before their end.

    Cut are texts exactly at a limit that their source enforces (``hidden_limits``), texts that end inside a header,
    part, encoding, tag, character, number or address, with a cut mark, or in an unpunctuated ending that is not usual
    (``usual_endings``).  Texts that end with a sentence, a whole table line, the name of someone in the mail, a greeting, a
    closed part, or that are empty, are whole.  Documents with a NULL text or doc_id are left out; repeated rows count
    once; an empty table gives an empty result.
    """
    looked = look(documents) if looked is None else looked
    asked = looked.where("verdict = 'ask'")
    unusual = asked.join(usual_endings(asked), "ending", "left_anti").select("doc_id", "source", "reason")
    plain = looked.where("verdict = 'cut'").select("doc_id", "source", "reason")
    limits = cut(hidden_limits(looked).select("source", "measure", "limit"), "limits")
    names = F.array(*(F.lit(m) for m in MEASURES))
    at_limit = long_fit(looked.select("doc_id", "source", "lengths"), limits).select("doc_id", "source", F.concat(F.lit("at limit of "), F.col("limit"), F.lit(" "), names[F.col("measure")]).alias("reason"))
    every = at_limit.withColumn("rank", F.lit(0)).unionByName(plain.withColumn("rank", F.lit(1))).unionByName(unusual.withColumn("rank", F.lit(2)))
    return every.groupBy("doc_id").agg(F.min(F.struct("rank", "reason", "source")).alias("m")).select("doc_id", "m.source", "m.reason")


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, docs, truncated, at_limit, rate) per source; texts without a source are reported under an empty name."""
    looked = look(documents)
    found = truncated(documents, looked).groupBy("source").agg(F.count(F.lit(1)).alias("truncated"), F.count_if(F.col("reason").startswith("at limit")).alias("at_limit"))
    docs = looked.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"))
    joined = docs.join(found, "source", "left").fillna(0, ["truncated", "at_limit"])
    return joined.select("source", "docs", "truncated", "at_limit", F.round(F.col("truncated") / F.col("docs"), 6).alias("rate"))

"""Evaluation passages in training text (problem 8): a distributed positional inverted index.

Postings (term, document, position) are stored for the terms of the test vocabulary.  From each window of a passage
the rarest terms of the corpus give the first lists; offset-adjusted intersection with the lists of the other terms
leaves the exact phrase matches.  With room for strange words the lists are intersected with as much play, and the longest
chain of words in order around each place they meet decides the proximity matches.

Passages are cut into words, windows and rarest terms by tasks.  Only the vocabulary of a round, of proven size, goes to the
workers; more passages take several rounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.mail import readable
from loamline.operators.skew import salted_join
from loamline.session import EngineError, cut

WORD = re.compile(r"[^\W_]+")
#: What one round holds: different words of its passages (they go to every worker), and words of its passages with room for
#: strange words (there they go to every worker, too).
VOCABULARY_AT_MOST, LINE_AT_MOST = 2_000_000, 4_000_000
BROADCAST_ROWS = 1_000_000  # of at most 48 bytes
POSTINGS_AT_ONCE, PAIRS_AT_ONCE, CHAINS_AT_ONCE = 50_000, 2_000_000, 100_000


def words(text: str) -> list[str]:
    """Runs of letters and digits, case folded."""
    return WORD.findall(text.casefold())


def _split(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(p) for p in batch.column("passage").to_pylist()]
            long = pa.array([len(w) >= least for w in found])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").filter(long), pa.array([w for w in found if len(w) >= least], pa.list_(pa.string()))], names=["item_id", "words"])

    return run


def passages(items: DataFrame, least: int) -> DataFrame:
    """(item_id, words, passage): the held-out passages as words, those of at least ``least`` words, with a number of their
    own; repeated ones count once, several passages of an item are kept apart."""
    rows = items.where("item_id IS NOT NULL AND passage IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "passage").distinct()
    return cut(rows.mapInArrow(_split(least), "item_id long, words array<string>").withColumn("passage", F.monotonically_increasing_id()), "passages")


def rounds_of(known: DataFrame, slack: int) -> list[DataFrame]:
    """The passages in as many parts as it takes to keep each within its bounds."""
    size = known.agg(F.sum(F.size("words")).alias("n")).first().n or 0
    if not size:
        return []
    different = known.select(F.explode("words").alias("w")).agg(F.countDistinct("w")).first()[0] if size > VOCABULARY_AT_MOST else size
    parts = max(-(-different // VOCABULARY_AT_MOST), -(-size // LINE_AT_MOST) if slack else 1)
    if parts == 1:
        return [known]
    return [known.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == i) for i in range(parts)]


def _indexer(vocabulary: dict[str, int], least: int, slack: int):
    """Postings of vocabulary terms.  A window of ``least`` vocabulary words with at most ``slack`` others among them is
    part of every match, so terms outside all such windows are not stored; no match is lost."""
    span = least + slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                docs, texts = np.asarray(part.column("doc_id")), part.column("text").to_pylist()
                ids, sizes = [], []
                for text in texts:
                    before = len(ids)
                    for piece in readable(text):
                        ids += [get(w, -1) for w in WORD.findall(piece.casefold())]
                        ids += [-1] * span  # no window spans two texts
                    sizes.append(len(ids) - before)
                term = np.array(ids, dtype=np.int64)
                known = term >= 0
                c = np.concatenate([[0], np.cumsum(known)])
                if len(term) < span:
                    continue
                full = c[span:] - c[:-span] >= least  # windows by start
                cover = np.zeros(len(term) + 1, dtype=np.int64)
                starts = np.flatnonzero(full)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + span, -1)
                keep = np.flatnonzero(known & (np.cumsum(cover[:-1]) > 0))
                if len(keep):
                    offsets = np.concatenate([[0], np.cumsum(sizes)])
                    owner = np.searchsorted(offsets, keep, side="right") - 1
                    out = {"term": pa.array(term[keep], pa.int32()), "doc_id": pa.array(docs[owner]), "pos": pa.array(keep - offsets[owner], pa.int32())}
                    if "copy" in batch.schema.names:
                        out["copy"] = part.column("copy").take(pa.array(owner))
                    yield pa.RecordBatch.from_pydict(out)

    return run


def positional_index(documents: DataFrame, vocabulary: dict[str, int], least: int, slack: int = 0, copies: bool = False) -> DataFrame:
    """(term, doc_id, pos) over the whole decoded text of every document; rows with NULL doc_id or text have none.
    With ``copies`` also copy, a number of the row that the text comes from."""
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.monotonically_increasing_id().alias("copy")] if copies else []))
    return cut(docs.mapInArrow(_indexer(vocabulary, least, slack), "term int, doc_id long, pos int" + ", copy long" * copies), "postings")


def _several(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each pair of first and size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


def _chains(known: list[tuple[int, list[int]]], frequency: dict[int, int], least: int, slack: int):
    """Proximity matches from postings in the order of (doc_id, copy, pos), by slices that overlap by one window.

    The shifts (document minus passage position) of a match differ by at most ``slack``, and of the ``slack + 3`` rarest
    words of its passage window at least three are met.  So the lists of those rare words are intersected on each shift and
    the ``slack`` next ones; from each place where three meet the longest chain in a square of ``least + slack``
    words is counted.  No match is lost.
    """
    span = least + slack
    line, owner, rare = [-2] * span, [0] * span, set()
    for item, ids in known:
        for start in range(max(1, len(ids) - span + 1)):
            window = range(start, min(start + span, len(ids)))
            rare |= {len(line) + at for at in sorted(window, key=lambda at: (frequency.get(ids[at], 0), at))[: slack + 3]}
        line += [*ids, *[-2] * span]  # no window spans two passages
        owner += [item] * (len(ids) + span)
    line, owner, places = np.array(line, dtype=np.int64), np.array(owner, dtype=np.int64), np.array(sorted(rare), dtype=np.int64)
    places = places[np.argsort(line[places], kind="stable")]
    starts = np.searchsorted(line[places], np.arange(line.max() + 2))  # the rare places of each term
    edge = 2 * span

    def near(doc: np.ndarray, copy: np.ndarray, pos: np.ndarray, term: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = starts[term + 1] - starts[term]
        if sizes.sum() > PAIRS_AT_ONCE and len(doc) > 4 * span:
            half = len(doc) // 2
            back = half - int(((doc[:half] == doc[half]) & (copy[:half] == copy[half]) & (pos[:half] > pos[half] - span)).sum())
            yield from near(doc[:half], copy[:half], pos[:half], term[:half])
            yield from near(doc[back:], copy[back:], pos[back:], term[back:])
            return
        same = (np.diff(doc) == 0) & (np.diff(copy) == 0)
        x = edge + np.concatenate([[0], np.cumsum(np.where(same, np.minimum(np.diff(pos), span), span))])
        text, whose = np.full(x[-1] + edge, -1), np.zeros(x[-1] + edge, dtype=np.int64)
        text[x], whose[x] = term, doc
        g = places[_several(starts[term], sizes)]
        shift = np.repeat(x, sizes) - g + len(line)
        votes = np.unique(np.concatenate([(shift - e) * len(line) + g for e in range(slack + 1)]))
        votes = votes[np.flatnonzero((votes[2:] // len(line) == votes[:-2] // len(line)) & (votes[2:] - votes[:-2] < span))[:, None] + [0, 2]]
        first = votes[:, 1] - span + 1
        at = np.unique(_several(first, votes[:, 0] - first + 1))  # a passage begins after span places: the shift stays
        for e in range(slack + 1):
            g0 = at % len(line)
            x0 = at // len(line) - len(line) + g0 + e
            met = np.flatnonzero((x0 >= 0) & (x0 < len(text) - span))
            met = met[text[x0[met]] == line[g0[met]]]
            for lo in range(0, len(met), CHAINS_AT_ONCE):
                gs, xs = g0[met[lo : lo + CHAINS_AT_ONCE]], x0[met[lo : lo + CHAINS_AT_ONCE]]
                a, b = [line[gs + i] for i in range(span)], [text[xs + j] for j in range(span)]
                before: dict[int, np.ndarray] = {}
                for i in range(span):
                    row: dict[int, np.ndarray] = {}
                    for j in range(max(0, i - slack), min(span, i + slack + 1)):
                        best = (a[i] == b[j]).astype(np.int16)
                        if j - 1 in before:
                            best += before[j - 1]
                        for other in (before.get(j), row.get(j - 1)):
                            if other is not None:
                                np.maximum(best, other, out=best)
                        row[j] = best
                    before = row
                words_met = before[span - 1]
                hit = np.flatnonzero(words_met >= least)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(whose[xs[hit]]), pa.array(owner[gs[hit]]), pa.array(words_met[hit], pa.int32())], names=["doc_id", "item_id", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kept, rows = ("doc_id", "copy", "pos", "term"), [], 0

        def taken() -> list[np.ndarray]:
            return [np.concatenate([k[n] for k in kept]) for n in range(len(names))]

        for batch in batches:
            kept.append([np.asarray(batch.column(n)).astype(np.int64) for n in names])
            rows += batch.num_rows
            if rows >= POSTINGS_AT_ONCE:
                doc, copy, pos, term = taken()
                yield from near(doc, copy, pos, term)
                tail = (doc == doc[-1]) & (copy == copy[-1]) & (pos > pos[-1] - span)
                kept, rows = [[doc[tail], copy[tail], pos[tail], term[tail]]], 0
        if rows:
            yield from near(*taken())

    return run


def _windows(vocabulary: dict[str, int], frequency: np.ndarray, least: int):
    """The rarest three terms of each window of a passage, each set once; none where a term does not occur at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["passage", "term", "at1", "term2", "at2", "term3", "at3"]
        for batch in batches:
            for passage, text in zip(batch.column("passage").to_pylist(), batch.column("words").to_pylist(), strict=True):
                ids = np.array([vocabulary[w] for w in text], np.int64)
                spans = np.lib.stride_tricks.sliding_window_view(frequency[ids], least)
                rarest = np.argsort(spans, axis=1, kind="stable")[:, :3] + np.arange(len(spans))[:, None]
                rarest = np.unique(rarest[spans.min(1) > 0], axis=0)
                for lo in range(0, len(rarest), 10_000):
                    part = rarest[lo : lo + 10_000]
                    columns = [np.full(len(part), passage)] + [c for k in range(3) for c in (ids[part[:, k]], part[:, k])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.int32()) for i, c in enumerate(columns)], names=names)

    return run


def _joined(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows with a written table by a key: by broadcast if the table is small, else salted."""
    return rows.join(F.broadcast(table), key) if table.count() <= BROADCAST_ROWS else salted_join(rows, table, [key])


def _round(documents: DataFrame, known: DataFrame, least: int, slack: int) -> DataFrame:
    """The matches with the passages of one round."""
    different = known.select(F.explode("words").alias("w")).distinct().limit(VOCABULARY_AT_MOST + 1).collect()
    if len(different) > VOCABULARY_AT_MOST:
        raise EngineError("a round has too many different words")
    vocabulary = {w: n for n, w in enumerate(sorted(r.w for r in different))}
    postings = positional_index(documents, vocabulary, least, slack, copies=slack > 0)
    counts = postings.groupBy("term").agg(F.countDistinct("doc_id").alias("df")).collect()  # at most one row per word of the round
    if slack:
        lists = [(r.item_id, [vocabulary[w] for w in r.words]) for r in known.orderBy("item_id", "words").collect()]  # at most LINE_AT_MOST words
        chains = _chains(lists, {r.term: r.df for r in counts}, least, slack)
        lines = postings.repartition("doc_id").sortWithinPartitions("doc_id", "copy", "pos")  # a hot key is one document's text at most
        return lines.mapInArrow(chains, "doc_id long, item_id long, words int")
    frequency = np.zeros(len(vocabulary) + 1, np.int64)
    for r in counts:
        frequency[r.term] = r.df
    schema = "passage long, term int, at1 int, term2 int, at2 int, term3 int, at3 int"
    anchors = cut(known.select("passage", "words").mapInArrow(_windows(vocabulary, frequency, least), schema).distinct(), "anchors")
    # the lists of the three rarest terms, one after the other, each moved by its offset in the passage
    candidates = _joined(postings, anchors, "term").withColumn("shift", F.col("pos") - F.col("at1"))
    for n in (2, 3):
        other = postings.select("doc_id", F.col("term").alias(f"term{n}"), F.col("pos").alias(f"pos{n}"))
        candidates = candidates.withColumn(f"pos{n}", F.col("shift") + F.col(f"at{n}")).select("doc_id", "passage", "shift", f"term{n}", f"pos{n}", *(["term3", "at3"] if n == 2 else []))
        candidates = candidates.join(other, ["doc_id", f"term{n}", f"pos{n}"], "left_semi")
    candidates = candidates.select("doc_id", "passage", "shift").distinct()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            term = pa.array([vocabulary[w] for w in lists.flatten().to_pylist()], pa.int32())
            at = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([batch.column("passage").take(pa.array(np.repeat(np.arange(batch.num_rows), sizes))), term, pa.array(at, pa.int32())], names=["passage", "term", "at"])

    at_items = cut(known.select("passage", "words").mapInArrow(numbered, "passage long, term int, at int"), "terms")
    expected = _joined(candidates, at_items, "passage").select("doc_id", "passage", "shift", "at", "term", (F.col("shift") + F.col("at")).alias("pos"))
    same = expected.join(postings.distinct(), ["doc_id", "term", "pos"]).distinct()
    line = Window.partitionBy("doc_id", "passage", "shift")  # at most as many rows as a passage has words
    islands = same.withColumn("island", F.col("at") - F.row_number().over(line.orderBy("at")))
    runs = islands.groupBy("doc_id", "passage", "shift", "island").agg(F.count(F.lit(1)).alias("words"))
    return runs.where(F.col("words") >= least).join(known.select("passage", "item_id"), "passage").select("doc_id", "item_id", F.col("words").cast("int").alias("words"))


def leaked(documents: DataFrame, items: DataFrame, least: int = 12, slack: int = 0) -> DataFrame:
    """(doc_id, item_id, words): documents with at least ``least`` words of a passage, and the longest such match.

    With ``slack`` 0 the words are consecutive in passage and document (exact phrase).  With ``slack`` s a proximity
    match is reported: at least ``least`` words in the same order in a window of ``least + s`` words of the passage and one
    of ``least + s`` words of the document, so up to s words may be replaced, put in or left out.  Case, punctuation, line
    breaks, quote marks, markup and transfer encoding don't matter.  Passages shorter than ``least`` words can't match.
    Repeated documents and items count once; an empty table on either side gives an empty result.  Passages beyond the
    bounds of a round are searched in further rounds over the documents.
    """
    if least < 3:
        raise EngineError("a match needs at least three words")
    found = [_round(documents, part, least, slack) for part in rounds_of(passages(items, least), slack)]
    if not found:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, words int")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))

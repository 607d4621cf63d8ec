"""Subject areas of documents, by propagating trusted labels over the graph of documents that share terms.

Documents are linked through the terms they share, so one round of propagation is two steps: documents give
their subjects to their terms, and terms give theirs back to documents, which is a step over the
document-similarity graph without spelling out its edges. A term links documents only if it is verified: it
occurs in several documents, and the subjects of those that are known differ from the corpus by enough
information. Labels are clamped in every round, unless what surrounds a labelled document contradicts them.
Rounds end when the subjects' shares of the corpus have settled. Then the same weights are summed by sentence, a
sentence belongs to the subject that clearly leads in it, and a document's main subjects are those with a good
share of the words of such sentences.

A document's edges stay in its row. Each round is one pass over these rows, to which the weights of the verified terms are
sent, and shuffles only what a batch of documents gives to each term. Weights that outgrow a bound of bytes are sent
in blocks, one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.codes import bit_filter, filter_bits, passing, starts
from platewise.operators.lookup import BROADCAST_BYTES, hinted, table_bytes
from platewise.stage import written
from platewise.tables import spread

#: Documents that a term must occur in, and labelled documents or sentences that must speak for its subjects.
LEAST_DOCUMENTS, LEAST_EVIDENCE = 3, 1.5
#: Information (nats) that a term's subjects must have over the corpus's.
LEAST_INFORMATION = 0.5
#: Pseudo-counts, in corpus proportions, added to each term's subjects.
SMOOTHING = 2.0
#: A sentence's leading subject needs this weight and this share of the sentence's weight.
LEAST_LEAD, LEAD_SHARE = 0.7, 0.5
#: Weights are whole hundredths, and so are summed exactly in any order.
UNIT = 100
#: Share of the words of a document's subject sentences that makes a main subject.
MAIN_SHARE = 0.2
#: Subject sentences have at least so many words; shorter ones are headings and page furniture.
LEAST_WORDS = 4
#: A label is trusted unless its share of the document is less than this while another subject has ``CONTRADICTED`` or more.
LEAST_TRUST, CONTRADICTED = 0.05, 0.5
#: Rounds end when the subjects' shares of the corpus move by no more than this in sum, at the latest after ``MOST_ROUNDS``.
SETTLED, MOST_ROUNDS = 0.02, 20
#: Terms that a task holds before it passes them on, and edges of the documents that it takes at a time.
HELD, EDGES = 200_000, 1 << 20
#: Bytes of weights that tasks hold.
WEIGHT_BYTES = 64 << 20
#: Terms pass a bit filter of some hundred bits for each, and at most of 2 to this power (16 MB), before they are shuffled.
FILTER_BITS = 27

_SENTENCE = re.compile(r"[.!?;\n|<>。！？；]+")
# Scripts that write words without spaces: Thai to Burmese, Khmer, kana and Han.
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
_TERM = re.compile(rf"[^\W\d_{_UNSPACED}]{{3,}}|[{_UNSPACED}]+")
_IS_UNSPACED = re.compile(f"[{_UNSPACED}]")
FEATURES = "terms array<long>, sentences array<int>, lengths array<int>"

Batches = Iterable[pa.RecordBatch]


@lru_cache(maxsize=1 << 18)
def _code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def sentence_terms(sentence: str) -> list[str]:
    """The words of three letters or more; of scripts that don't set words apart, every two characters in a row."""
    found = _TERM.findall(sentence)
    if not _IS_UNSPACED.search(sentence):
        return found
    return [t for f in found for t in ([f[k : k + 2] for k in range(max(1, len(f) - 1))] if _IS_UNSPACED.match(f) else [f])]


def features(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Per text: the distinct terms of each sentence, with the sentence's number and length in words. Other columns than the text stay."""
    for batch in batches:
        texts, rest = batch.column("text").to_pylist(), batch.drop_columns("text")
        first = 0
        while first < len(texts):
            terms: list[int] = []
            sentences: list[int] = []
            lengths: list[int] = []
            ends = [0]
            for text in texts[first:]:
                for number, sentence in enumerate(_SENTENCE.split(text.lower())):
                    found = sentence_terms(sentence)
                    if len(found) >= LEAST_WORDS:
                        distinct = set(found)
                        terms.extend(map(_code, distinct))
                        sentences.extend([number] * len(distinct))
                        lengths.extend([len(found)] * len(distinct))
                ends.append(len(terms))
                if len(terms) >= HELD:
                    break
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((terms, pa.int64()), (sentences, pa.int32()), (lengths, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*rest.slice(first, len(ends) - 1).columns, *lists], [*rest.schema.names, "terms", "sentences", "lengths"])
            first += len(ends) - 1


class _Edges(NamedTuple):
    """Edges of some documents: their terms and the document and sentence of each (from 0), and the document and length of each sentence."""

    batch: pa.RecordBatch
    terms: np.ndarray
    document: np.ndarray
    sentence: np.ndarray
    sentence_document: np.ndarray
    sentence_length: np.ndarray


def _edges(batches: Batches) -> Iterator[_Edges]:
    for whole in batches:
        at, size = 0, pc.list_value_length(whole.column("terms")).to_numpy(zero_copy_only=False).cumsum() if whole.num_rows else np.empty(0, int)
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + EDGES, "right")))
            batch = whole.slice(at, to - at)
            at = to
            ends, terms = starts(batch.column("terms"))
            numbers, lengths = (starts(batch.column(c))[1].to_numpy() for c in ("sentences", "lengths"))
            document = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            new = np.r_[True, (document[1:] != document[:-1]) | (numbers[1:] != numbers[:-1])][: len(document)]
            yield _Edges(batch, terms.to_numpy(), document, np.cumsum(new) - 1, document[new], lengths[new])


class Weights(NamedTuple):
    """Ascending terms and their weights, a row for each."""

    terms: np.ndarray
    weights: np.ndarray


def _scores(edges: _Edges, block: Weights, count: int) -> np.ndarray:
    """Weights of the subjects summed by sentence, on top of those that an earlier block gave."""
    sums = np.zeros((len(edges.sentence_document), count), np.int64)
    if len(block.terms):
        at = np.minimum(np.searchsorted(block.terms, edges.terms), len(block.terms) - 1)
        hit = block.terms[at] == edges.terms
        at, sentence = at[hit], edges.sentence[hit]
        for k in range(count):
            sums[:, k] = np.bincount(sentence, block.weights[at, k], len(sums)).astype(np.int64)
    if "scores" in edges.batch.schema.names:
        sums += starts(edges.batch.column("scores"))[1].to_numpy().reshape(sums.shape)
    return sums


def _with_scores(block, count: int):
    """The rows with the sums of one block, on the way to the next."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for edges in _edges(batches):
            sums = _scores(edges, block.value, count)
            per = np.bincount(edges.sentence_document, minlength=edges.batch.num_rows) * count
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)], pa.int32()), pa.array(sums.ravel()))
            columns = {n: edges.batch.column(n) for n in edges.batch.schema.names} | {"scores": lists}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _labels(batch: pa.RecordBatch, count: int) -> np.ndarray:
    """The labels' shares for each document; zeros without labels."""
    ends, values = starts(batch.column("label"))
    shares = np.zeros((batch.num_rows, count))
    many = np.diff(ends)
    shares[np.repeat(np.arange(batch.num_rows), many), values.to_numpy()] = np.repeat(1 / np.maximum(many, 1), many)
    return shares


def _given(terms: np.ndarray, shares: np.ndarray) -> pa.RecordBatch:
    """(term, held, s0, ...): what edges give to their terms, added up."""
    distinct, of = _numbered(terms)
    given = np.flatnonzero(shares.any(axis=1))
    sums = [np.bincount(of[given], shares[given, k], len(distinct)) for k in range(shares.shape[1])]
    return _sums(distinct, np.bincount(of, minlength=len(distinct)), sums)


def _numbered(terms: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct terms and the place of each term among them. By hashing, which takes a fraction of the time of sorting."""
    coded = pa.array(terms).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _sums(terms: pa.Array, held: np.ndarray, sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([terms, pa.array(held.astype(np.int64)), *(pa.array(x, pa.float64()) for x in sums)], ["term", "held", *(f"s{k}" for k in range(len(sums)))])


def _by_labels(count: int):
    """What labelled documents give to their terms, a document counting once for a term, and how many documents have each term."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for edges in _edges(batches):
            distinct, of = _numbered(edges.terms)
            pairs = pc.unique(pa.array(edges.document * len(distinct) + of)).to_numpy()
            document, of = np.divmod(pairs, max(1, len(distinct)))
            yield _given(distinct.to_numpy()[of], _labels(edges.batch, count)[document])

    return run


def _by_scores(block, passed, bits: int, count: int):
    """What documents give to their terms: clamped labels, else the shares of their scores. The null term has the sum over the documents."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for edges in _edges(batches):
            sums = _scores(edges, block.value, count)
            # Squares keep a document's one or two subjects apart from the traces that terms leave of others.
            squares = np.stack([np.bincount(edges.sentence_document, sums[:, k], edges.batch.num_rows) for k in range(count)], axis=1) ** 2
            total = squares.sum(axis=1)
            shares = squares / np.maximum(total, 1)[:, None]
            labels = _labels(edges.batch, count)
            # Clamp the labels that hold.
            trust = np.where(labels > 0, shares, 0).sum(axis=1)
            other = np.where(labels > 0, 0, shares).max(axis=1)
            clamped = (labels.sum(axis=1) > 0) & ~((trust < LEAST_TRUST) & (other >= CONTRADICTED))
            shares[clamped] = labels[clamped]
            scored = total > 0
            yield _sums(pa.array([None], pa.int64()), np.array([scored.sum()]), [np.array([x]) for x in shares[scored].sum(axis=0)])
            mine = scored[edges.document] & passing(edges.terms, passed.value, bits)
            yield _given(edges.terms[mine], shares[edges.document[mine]])

    return run


def _by_sentences(block, subjects: list[str]):
    """(id, subject) of the main subjects of documents without a label."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        count = len(subjects)
        for edges in _edges(batches):
            sums = _scores(edges, block.value, count)
            lead, subject = sums.max(axis=1, initial=0), sums.argmax(axis=1)
            clear = (lead >= LEAST_LEAD * UNIT) & (lead >= LEAD_SHARE * sums.sum(axis=1))
            places = edges.sentence_document[clear] * count + subject[clear]
            words = np.bincount(places, edges.sentence_length[clear], edges.batch.num_rows * count).reshape(-1, count)
            total = words.sum(axis=1)
            unknown = edges.batch.column("label").is_null().to_numpy(zero_copy_only=False)
            documents, found = np.nonzero((words >= MAIN_SHARE * total[:, None]) & (words > 0) & unknown[:, None])
            yield pa.RecordBatch.from_arrays([edges.batch.column("id").take(pa.array(documents)), pa.array(subjects, pa.string()).take(pa.array(found))], ["id", "subject"])

    return run


def _weights(evidence: DataFrame, prior: list[float]) -> DataFrame:
    """``evidence`` (term, s0, s1, ...) with n, information, w0, w1, ...: how strongly a term speaks for each subject.

    The square of the information makes a few telling terms outweigh many vague ones.
    """
    count = len(prior)
    n = reduce(Column.__add__, (F.col(f"s{k}") for k in range(count)))
    shares = [(F.col(f"s{k}") + SMOOTHING * p) / (F.col("n") + SMOOTHING) for k, p in enumerate(prior)]
    information = reduce(Column.__add__, (x * F.log(x / p) for x, p in zip(shares, prior) if p > 0), F.lit(0.0))
    known = evidence.withColumn("n", n).withColumn("information", information)
    return known.select("term", "n", "information", *(F.round(UNIT * F.pow("information", F.lit(2)) * x).cast("int").alias(f"w{k}") for k, x in enumerate(shares)))


def _shares(sums: list[float | None]) -> list[float]:
    total = sum(x or 0.0 for x in sums)
    return [(x or 0.0) / total if total else 0.0 for x in sums]


def _sent(graph: DataFrame, weights: DataFrame, most: int, count: int):
    """The rows and the last block of the verified ones of at most ``most`` weights, for a pass over the rows; what blocks before it give is in the rows."""
    spark = graph.sparkSession
    telling = weights.filter((F.col("n") >= LEAST_EVIDENCE) & (F.col("information") >= LEAST_INFORMATION)).drop("n", "information")
    blocks = max(1, -(-most * (8 + 4 * count) // WEIGHT_BYTES))
    for number in range(blocks):
        # Codes are hashes, so that blocks are of one size.
        table = telling.filter(F.pmod("term", F.lit(blocks)) == number).toArrow()
        terms = table.column("term").to_numpy()
        order = terms.argsort()
        block = spark.sparkContext.broadcast(Weights(terms[order], np.stack([table.column(f"w{k}").to_numpy()[order] for k in range(count)], axis=1)))
        if number < blocks - 1:
            schema = graph.drop("scores").schema.add("scores", T.ArrayType(T.LongType()))
            graph = written(graph.mapInArrow(_with_scores(block, count), schema), "subject-scored")
    return graph, block


def _flagged(passed, bits: int):
    """Rows with ``known``: whether the hash of the id passes the filter."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = pa.array(passing(batch.column("hash").to_numpy(), passed.value, bits))
            yield from features([batch.drop_columns("hash").append_column("known", known)])

    return run


def _graph(texts: DataFrame, seeds: DataFrame, id_type: str) -> DataFrame:
    """(id, label, terms, sentences, lengths) of the texts that have terms, label null without one, as stages.

    A table of labels that outgrows a broadcast is joined by shuffle, but with those documents alone that pass a bit filter of the
    labelled ids.
    """
    some = F.size("terms") > 0
    if table_bytes(seeds) <= BROADCAST_BYTES:
        joined = texts.join(F.broadcast(seeds), "id", "left")
        return written(joined.mapInArrow(features, f"id {id_type}, label array<int>, {FEATURES}").filter(some), "subject-features")
    hashes = seeds.select(F.xxhash64("id").alias("hash"))
    bits = filter_bits(seeds.count(), FILTER_BITS)
    passed = texts.sparkSession.sparkContext.broadcast(bit_filter(hashes, "hash", bits))
    flagged = texts.withColumn("hash", F.xxhash64("id")).mapInArrow(_flagged(passed, bits), f"id {id_type}, known boolean, {FEATURES}").filter(some)
    flagged = written(flagged, "subject-features")
    columns = ("id", "label", "terms", "sentences", "lengths")
    labelled = written(flagged.filter("known").join(seeds, "id", "left").select(*columns), "subject-labelled")
    return labelled.unionByName(flagged.filter("not known").withColumn("label", F.lit(None).cast("array<int>")).select(*columns))


def main_subjects(documents: DataFrame, labels: DataFrame, subjects: list[str], rounds: int = MOST_ROUNDS) -> DataFrame:
    """(id, subject): a row per main subject of each document without a label.

    ``documents`` is (id, text), ids unique; ``labels`` is (id, subject), of which repeated rows, unknown subjects and ids
    without a document are ignored. ``subjects`` is the bounded list of subjects, ``rounds`` the most rounds of propagation. Null, blank and furniture texts
    have no subject, nor have texts all of whose terms are unverified. Empty tables, and no labels, give no rows.
    """
    spark, count = documents.sparkSession, len(subjects)
    columns = [f"s{k}" for k in range(count)]
    id_type = documents.schema["id"].dataType.simpleString()
    nothing = documents.select("id", F.lit("").alias("subject")).limit(0)
    if not subjects:
        return nothing

    # Labels as places in the list of subjects.
    known = labels.select("id", "subject").filter(F.col("id").isNotNull() & F.col("subject").isin(subjects)).distinct()
    place = F.array_position(F.array(*map(F.lit, subjects)), F.col("subject")) - 1
    seeds = written(known.groupBy("id").agg(F.array_sort(F.collect_list(place.cast("int"))).alias("label")), "subject-seeds")
    each = seeds.select(F.explode("label").alias("k"), (1 / F.size("label")).alias("share"))
    sums = each.agg(*(F.sum(F.when(F.col("k") == k, F.col("share"))).alias(c) for k, c in enumerate(columns))).first()
    prior = _shares(list(sums))
    if not any(prior):
        return nothing

    graph = _graph(spread(documents.select("id", "text").filter(F.col("text").isNotNull()), "id"), seeds, id_type)
    schema = f"term long, held long, {', '.join(f'{c} double' for c in columns)}"
    added = [F.sum(c).alias(c) for c in columns]

    # First round, by labels alone. Terms of several documents link them, but for those that labels show to say little.
    shared = graph.mapInArrow(_by_labels(count), schema).groupBy("term").agg(F.sum("held").alias("held"), *added).filter(F.col("held") >= LEAST_DOCUMENTS)
    weights = _weights(written(shared, "subject-terms"), prior)
    linking = ~((F.col("n") >= LEAST_EVIDENCE) & (F.col("information") < LEAST_INFORMATION / 2))
    kept = written(weights.filter(linking).select("term"), "subject-links")
    most, linked = kept.count(), hinted(kept)
    bits = filter_bits(most, FILTER_BITS)
    passed = spark.sparkContext.broadcast(bit_filter(kept, "term", bits))

    for _ in range(rounds - 1):
        rows, block = _sent(graph, weights, most, count)
        given = written(rows.mapInArrow(_by_scores(block, passed, bits, count), schema).groupBy("term").agg(*added), "subject-evidence")
        all_of = given.filter("term is null").first()
        if all_of is None:
            return nothing
        last, prior = prior, _shares([all_of[c] for c in columns])
        weights = _weights(given.join(linked, "term", "left_semi"), prior)
        if sum(abs(a - b) for a, b in zip(last, prior)) <= SETTLED:
            break

    rows, block = _sent(graph, weights, most, count)
    return rows.mapInArrow(_by_sentences(block, subjects), f"id {id_type}, subject string")

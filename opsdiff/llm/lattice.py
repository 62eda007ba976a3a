"""LM scoring: likelihood of a text, summed over all its segmentations into subwords.

A text is a row of words and one end.  A word's probability in a class of texts is

    (max(c - D, 0) + D * T * lattice(word)) / N

c: the word's count in the class, T: distinct words, N: all tokens, D: the discount.  So the
word is either one piece of its own, or spelled in the pieces of an existing vocabulary.
lattice(word) sums, over all ways to cut '▁word' into such pieces, the product of their
probabilities, by the forward recursion in log space: a first piece, any number of further
pieces, a stop.  Characters that no piece has are spelled in the vocabulary's byte pieces, so
that every text has a probability, and these sum to one over all texts.

The pieces' probabilities are learned: expected counts of the pieces over all segmentations
of every distinct training word (expectation maximisation), for each class by itself, plus a
small constant.  Classes are the values of a column of the training rows, the most frequent
ones and one for the rest; a text to score has no class given: its probability is the sum over
all classes, each times its share.

Only distinct words are segmented.  The most used words, bounded in number, meet the
documents by broadcast, all others by a join; neither a frequent word nor the vocabulary
has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdiff.llm.common import TEXTS_AT_ONCE, slices, stored

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
FREQUENT_WORDS = 120_000  # rows that may be broadcast, some 10 MB
CLASSES = 8               # classes at most, the one for the rest included
PRIOR = 0.01
DISCOUNT = 0.75
ROUNDS = 2
LONGEST_RUN = 10_000      # longer words are cut there first, which only leaves out segmentations
ADD = 0.1
WORDS_AT_ONCE = 60_000
TEXT_BYTES = 4 << 20      # of texts split at once: their words take several times as much
COUNTS_AT_ONCE = 400_000  # rows of counts put together before they leave a task


@dataclass(frozen=True)
class Pieces:
    """All beginnings of the vocabulary's pieces by hash, the ids of those that are pieces."""

    hashes: np.ndarray    # sorted
    ids: np.ndarray       # -1: a beginning only
    byte_ids: np.ndarray  # the 256 byte pieces
    first: np.ndarray     # whether a piece starts a word
    size: int

    def arrays(self) -> tuple:
        """What the executors get: arrays only, so that they need not have this module."""
        return self.hashes, self.ids, self.byte_ids, self.first, self.size


_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _extend(hashes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hash of a string and one more code point."""
    x = (hashes ^ (code.astype(np.uint64) + np.uint64(1))) * _ODD
    return (x ^ (x >> np.uint64(29))) * _MIX


def pieces_of(names: list[str], byte_ids: list[int]) -> Pieces:
    """From the vocabulary's names by id; the names of other than ordinary pieces are empty."""
    found: dict[int, tuple[str, int]] = {}
    with np.errstate(over="ignore"):
        for i, name in enumerate(names):
            h = np.zeros(1, np.uint64)
            for n, c in enumerate(name, 1):
                h = _extend(h, np.array([ord(c)]))
                text, old = found.get(int(h[0]), (name[:n], -1))
                if text != name[:n]:
                    raise ValueError("two pieces share a hash")
                found[int(h[0])] = (text, i if n == len(name) else old)
    if MARK not in {t for t, i in found.values() if i >= 0}:
        raise ValueError(f"the vocabulary has no piece {MARK}")
    keys = np.array(sorted(found), np.uint64)
    return Pieces(keys, np.array([found[int(k)][1] for k in keys]), np.array(byte_ids),
                  np.array([n.startswith(MARK) for n in names]), len(names))


def read_pieces(path: str = VOCABULARY) -> Pieces:
    """Reads a subword model, of bounded size, on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    names = [model.id_to_piece(i) if plain(i) else "" for i in range(model.get_piece_size())]
    return pieces_of(names, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def _edges(codes: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, piece ids) of all pieces in words of one length, by start.

    A character that is no piece gives one edge for each of its bytes, under end -1 but
    for the last, so that their probabilities multiply.
    """
    n, length = codes.shape
    for i in range(length):
        rows, h = np.arange(n), np.zeros(n, np.uint64)
        for j in range(i, length):
            h = _extend(h, codes[rows, j])
            at = np.minimum(np.searchsorted(pieces.hashes, h), len(pieces.hashes) - 1)
            alive = pieces.hashes[at] == h
            ids = np.where(alive, pieces.ids[at], -1)
            if (whole := ids >= 0).any():
                yield i, j + 1, rows[whole], ids[whole]
            if j == i:
                for r in np.flatnonzero(~whole):
                    yield i, -1, rows[r:r + 1], pieces.byte_ids[list(chr(codes[r, i]).encode("utf-8", "surrogatepass"))]
            if not alive.any():
                break
            rows, h = rows[alive], h[alive]


def _forward(codes: np.ndarray, edges, scores: np.ndarray) -> np.ndarray:
    """alpha[class, j, word]: log probability of the first j characters over all ways to cut them."""
    n, length = codes.shape
    alpha = np.full((len(scores), length + 1, n), -np.inf)
    alpha[:, 0] = 0.0
    for i, j, rows, ids in edges:
        if j < 0:
            to, logp = i + 1, scores[:, ids].sum(1, keepdims=True)
        else:
            to, logp = j, scores[:, ids]
        alpha[:, to, rows] = np.logaddexp(alpha[:, to, rows], alpha[:, i, rows] + logp)
    return alpha


def _expect(codes: np.ndarray, scores: np.ndarray, pieces: Pieces, into: np.ndarray) -> None:
    """Adds the expected counts of the pieces in words of one length: forward, then backward."""
    n, length = codes.shape
    edges = list(_edges(codes, pieces))
    alpha = _forward(codes, edges, scores[None])[0]
    beta = np.full((length + 1, n), -np.inf)
    beta[length] = 0.0
    for i, j, rows, ids in reversed(edges):
        to = i + 1 if j < 0 else j
        logp = scores[ids].sum(keepdims=True) if j < 0 else scores[ids]
        way = logp + beta[to, rows]
        beta[i, rows] = np.logaddexp(beta[i, rows], way)
        share = np.exp(alpha[i, rows] + way - alpha[length, rows])
        if j < 0:
            np.add.at(into, ids, share[0])
        else:
            into += np.bincount(ids, share, minlength=len(into))


def _by_length(texts: list[str], cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, code points) of texts of one length, a bounded number at a time."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(lengths, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if not len(places) or not (length := int(lengths[places[0]])):
            continue
        step = max(1, cells // length)
        for s in range(0, len(places), step):
            part = places[s:s + step]
            joined = "".join(texts[p] for p in part).encode("utf-32-le", "surrogatepass")
            yield part, np.frombuffer(joined, np.uint32).reshape(len(part), length)


def _runs(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The marked words, those beyond LONGEST_RUN in several runs, and the word of each run."""
    runs, of = [], []
    for w, text in enumerate(words):
        text = MARK + text
        for s in range(0, len(text), LONGEST_RUN):
            runs.append(text[s:s + LONGEST_RUN])
            of.append(w)
    return runs, np.array(of, np.int64)


def lattice_scores(words: list[str], scores: np.ndarray, stop: np.ndarray, pieces: Pieces) -> np.ndarray:
    """[class, word]: natural log of lattice(word)."""
    runs, of = _runs(words)
    out = np.repeat(stop[:, None], len(words), 1)
    with np.errstate(over="ignore", invalid="ignore"):
        for places, codes in _by_length(runs):
            alpha = _forward(codes, _edges(codes, pieces), scores)[:, -1]
            for k in range(len(scores)):
                np.add.at(out[k], of[places], alpha[k])
    return out


def expected_counts(words: list[str], scores: np.ndarray, pieces: Pieces) -> np.ndarray:
    into = np.zeros(pieces.size)
    with np.errstate(over="ignore", invalid="ignore"):
        for _, codes in _by_length(_runs(words)[0]):
            _expect(codes, scores, pieces, into)
    return into


def normalised(counts: np.ndarray, types: np.ndarray, pieces: Pieces, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(log probabilities [class, piece], log probability of the stop [class]) from expected counts."""
    counts = counts + prior
    first = counts * pieces.first
    later = counts * ~pieces.first
    after = later.sum(1) + types + prior
    with np.errstate(divide="ignore"):
        scores = np.where(pieces.first, np.log(first / first.sum(1, keepdims=True)), np.log(later / after[:, None]))
    return scores, np.log((types + prior) / after)


def learn_pieces(words: DataFrame, types: np.ndarray, pieces: Pieces, rounds: int = ROUNDS,
                 prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the pieces from (word, counts array<long>), each distinct word of a class counting once.

    Each round brings one number a class and piece to the driver: the vocabulary bounds it.
    """
    spark = words.sparkSession
    scores, stop = normalised(np.ones((len(types), pieces.size)), types, pieces, prior)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((scores, pieces.arrays()))

        def estimate(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now, these = sent.value[0], Pieces(*sent.value[1])
            into = np.zeros(now.shape)
            for batch in _gathered(batches):
                text = batch.column(0).to_pylist()
                counts = _by_class(batch.column(1), len(now))
                for k in range(len(now)):
                    into[k] += expected_counts([text[r] for r in np.flatnonzero(counts[:, k])], now[k], these)
            k, piece = np.nonzero(into)
            yield pa.record_batch([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(into[k, piece])], names=["class", "piece", "n"])

        summed = words.select("word", "counts").mapInArrow(estimate, "class int, piece int, n double")
        summed = summed.groupBy("class", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(scores.shape)
        counts[summed["class"], summed["piece"]] = summed["n"]
        scores, stop = normalised(counts, types, pieces, prior)
    return scores, stop


def held_out(doc_id: Column, parts: int = 10, held: int = 0) -> Column:
    """Rows kept from training; a row without doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == held, F.lit(False))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = WORDS_AT_ONCE) -> Iterator[pa.Table]:
    """Small batches put together, up to about so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _by_class(counts: pa.ChunkedArray, classes: int) -> np.ndarray:
    """[row, class] of a column of arrays of one length."""
    return counts.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)


def _split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z folded, and the row of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    words, row = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.not_equal(words, "")
    return words.filter(full), row.filter(full).to_numpy()


def count_words(docs: DataFrame, classes: int) -> DataFrame:
    """(word, counts array<long> by class in training, uses in all) from docs(text, class int; null: not in training)."""

    def merged(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        summed = pa.concat_tables(held).group_by(["word", "class"]).aggregate([("n", "sum")])
        yield pa.record_batch([summed[c].combine_chunks() for c in ("word", "class", "n_sum")], names=["word", "class", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, 0, TEXT_BYTES):
                words, row = _split(part.column(0))
                kind = pc.fill_null(part.column(1), -1).to_numpy().astype(np.int32)[row]
                grouped = pa.table({"word": words, "class": kind}).group_by(["word", "class"]).aggregate([([], "count_all")])
                held.append(grouped.select(["word", "class", "count_all"]).rename_columns(["word", "class", "n"]))
                n += len(grouped)
                if n >= COUNTS_AT_ONCE:
                    yield from merged(held)
                    held, n = [], 0
        if n:
            yield from merged(held)

    rows = docs.select("text", "class").mapInArrow(count, "word string, class int, n long")
    by_class = [F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(classes)]
    return rows.groupBy("word").agg(*by_class, F.sum("n").alias("uses")).select(
        "word", F.array(*[f"c{k}" for k in range(classes)]).alias("counts"), "uses"
    )


def score(documents: DataFrame, train: Column, pieces: Pieces, by: str | None = "lang", rounds: int = ROUNDS,
          frequent: int = FREQUENT_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for documents(doc_id, text[, by]).

    train marks the rows to learn from.  Scores are log10 probabilities.  base_score is that
    of a unigram word model with 0.1 added to each count.  A null or empty text is the end
    alone.  Rows that repeat both doc_id and text give one row.  Without training rows all
    pieces are equally likely and no word is known.  An empty table gives an empty result.
    """
    spark: SparkSession = documents.sparkSession
    docs = documents.select(
        F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text", train.alias("train"),
        (F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")).alias("by"),
    )
    # The classes: one row each, a bounded number.
    sizes = docs.where("train").groupBy("by").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "by")
    named = [r["by"] for r in sizes.limit(CLASSES - 1).collect()]
    index = F.lit(len(named))
    for k, name in enumerate(named):
        index = F.when(F.col("by") == name, k).otherwise(index)
    docs = docs.withColumn("class", F.when(F.col("train"), index).cast("int"))
    n_classes = len(named) + 1
    ends_by = {r["class"]: r["n"] for r in docs.where("train").groupBy("class").agg(F.count("*").alias("n")).collect()}
    ends = np.array([ends_by.get(k, 0) for k in range(n_classes)], float)

    vocabulary = stored(count_words(docs, n_classes), "lm-words", TEXTS_AT_ONCE)
    each = [F.col("counts")[k] for k in range(n_classes)]
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    sums = vocabulary.agg(
        *[F.sum(c).alias(f"n{k}") for k, c in enumerate(each)], *[F.count_if(c > 0).alias(f"t{k}") for k, c in enumerate(each)],
        F.count_if(total > 0).alias("v"),
    ).first()
    tokens = np.array([sums[f"n{k}"] or 0 for k in range(n_classes)], float)
    types = np.array([sums[f"t{k}"] or 0 for k in range(n_classes)], float)
    all_tokens, distinct = int(tokens.sum() + ends.sum()), (sums["v"] or 0) + (ends.sum() > 0)

    scores, stop = learn_pieces(vocabulary.where(total > 0), types, pieces, rounds)
    sent = spark.sparkContext.broadcast((scores, stop, pieces.arrays()))
    all_of = tokens + ends
    # A class without training rows spells everything and ends after every second token.
    spelled = np.where(all_of > 0, DISCOUNT * types / np.maximum(all_of, 1), 0.5)
    with np.errstate(divide="ignore"):
        end_score = np.log10(np.where(all_of > 0, ends / np.maximum(all_of, 1), 0.5))
        share = np.log10((ends + 1e-6) / (ends + 1e-6).sum())

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, halt, these = *sent.value[:2], Pieces(*sent.value[2])
        for batch in _gathered(batches):
            counts = _by_class(batch.column(1), n_classes).T
            way = lattice_scores(batch.column(0).to_pylist(), now, halt, these) + np.log(spelled)[:, None]
            whole = np.maximum(counts - DISCOUNT, 0) / np.maximum(all_of, 1)[:, None]
            with np.errstate(divide="ignore"):
                logs = np.logaddexp(np.log(whole), way) / np.log(10)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, logs.size + 1, n_classes), pa.int32()), pa.array(logs.T.ravel()))
            yield from pa.table(
                [batch.column(0), pa.array(counts.sum(0)), batch.column(2), lists], names=["word", "count", "uses", "logs"]
            ).to_batches()

    def base(count):
        return F.log10((count + F.lit(ADD)) / F.lit(all_tokens + ADD * (distinct + 1)))

    scored = stored(
        vocabulary.mapInArrow(probabilities, "word string, count long, uses long, logs array<double>").withColumn("base", base(F.col("count"))),
        "lm-scores",
    )
    often = scored.orderBy(F.desc("uses"), "word").limit(frequent).toArrow()  # a bounded number of rows
    most = spark.sparkContext.broadcast((
        often["word"].cast(pa.string()).combine_chunks(), often["count"].to_numpy() > 0, often["base"].to_numpy(),
        _by_class(often["logs"], n_classes).T,
    ))
    begin = (share + end_score)[:, None]
    logs_of = [f"logs{k}" for k in range(n_classes)]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, known, base_logs, logs = most.value
        for whole_batch in batches:
            for batch in slices(whole_batch, 2, TEXT_BYTES):
                n = len(batch)
                words, row = _split(batch.column(2))
                place = pc.index_in(words, value_set=known_words)
                there = place.is_valid().to_numpy(zero_copy_only=False)
                at, of = place.drop_null().to_numpy(), row[there]
                by_class = begin + np.stack([np.bincount(of, logs[k][at], minlength=n) for k in range(n_classes)])
                rest, rest_of = words.filter(pa.array(~there)), row[~there]
                cuts = np.searchsorted(rest_of, np.arange(n + 1)).astype(np.int32)
                yield pa.record_batch([
                    batch.column(0), batch.column(1), pa.array(np.bincount(row, minlength=n)),
                    pa.array(np.bincount(of, known[at], minlength=n).astype(np.int64)), pa.array(np.bincount(of, base_logs[at], minlength=n).astype(float)),
                    *[pa.array(x.astype(float)) for x in by_class], pa.ListArray.from_arrays(pa.array(cuts), rest),
                ], names=["key", "doc_id", "n", "known", "base", *logs_of, "rest"])

    id_type = dict(docs.dtypes)["doc_id"]
    passed = stored(
        docs.select("key", "doc_id", "text").mapInArrow(
            first_pass, f"key long, doc_id {id_type}, n long, known long, base double, {', '.join(f'{c} double' for c in logs_of)}, rest array<string>"
        ),
        "lm-texts", TEXTS_AT_ONCE,
    )
    # Classes are summed when all of a text's words are added up.
    seldom = passed.select("key", F.explode("rest").alias("word"))
    seldom = seldom.join(scored.select("word", "count", "base", "logs"), "word").select(
        "key", (F.col("count") > 0).cast("long").alias("known"), "base", *[F.col("logs")[k].alias(c) for k, c in enumerate(logs_of)]
    )
    sums_of = [F.sum(c).alias(c) for c in ("known", "base", *logs_of)]
    none = [F.lit(None).cast("long").alias("n"), F.lit(None).cast(id_type).alias("doc_id")]
    per_text = (
        passed.dropDuplicates(["key"]).select("key", "known", "base", *logs_of, "n", "doc_id")
        .unionByName(seldom.groupBy("key").agg(*sums_of).select("key", "known", "base", *logs_of, *none))
        .groupBy("key").agg(*sums_of, F.max("n").alias("n"), F.max("doc_id").alias("doc_id"))
    )
    ends_known = int(ends.sum() > 0)
    best = F.array_max(F.array(*logs_of))  # the sum over all classes, relative to the likeliest
    total_log = F.when(best > float("-inf"), best + F.log10(sum((F.pow(F.lit(10.0), F.col(c) - best) for c in logs_of), F.lit(0.0)))).otherwise(best)
    return per_text.select(
        "doc_id", (F.col("n") + 1).alias("n_tokens"), (F.col("known") + ends_known).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + base(F.lit(float(ends.sum())))).alias("base_score"), total_log.alias("score"),
    )

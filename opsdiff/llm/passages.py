"""Substring dedup: fuzzy passages by collinear chaining of shared k-mer seeds.

Words are runs of letters and digits.  Of all runs of five words (k-mers) those with a hash
divisible by three are seeds: whether one is does not depend on the words around it, so edits
nearby cost no seeds.  Five seeds that follow one another make a wide seed of about seventeen words,
which two documents with a passage in common share even if every short phrase of it is
frequent elsewhere.  Every occurrence of a seed, narrow or wide, is matched with its first one,
by doc_id and place: that many rows as occurrences, however often a seed occurs.  The matches
of a document with one earlier document are chained in order of both, with gap costs, in a
Fenwick tree of best scores; chains of some breadth are aligned word by word along their
diagonals and between them, and extended at their ends.  Stretches that are similar enough and
lie side by side make the passages of a document that an earlier one has already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdiff.llm import hashing
from opsdiff.llm.bitmaps import among
from opsdiff.llm.common import maybe_among, stored

K, ONE_IN, WIDE = 5, 3, 5
BITS = 27
HOT_SHARE = 5000       # a seed that more than one in so many seeds are is hot: fewer than 5,000 can be
LEAST_HOT = 1000       # and is at least so frequent
GAP_COST = 0.01        # of a seed, for each word between two seeds, in either document
LEAST_BREADTH = 8      # words between the first and the last seed of a chain
LEAST_WORDS = 45       # of a passage
LEAST_STRETCH = 12     # equal words of one aligned chain
SIMILARITY = 0.8
MARGIN = 64            # words beyond a chain's ends that the alignment may reach
LEFT_OUT = 6           # words between stretches of one passage
BLOCK = 128            # words of a document that are fetched together
SALTS = 32


def sampled(found: hashing.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place among the row's words, hash) of each row's k-mers with a hash divisible by ONE_IN."""
    row, first, h = hashing.runs(found, K, short=False)
    chosen = h % np.uint64(ONE_IN) == 0
    row, first, h = row[chosen], first[chosen], h[chosen]
    firsts = np.concatenate([[0], np.cumsum(found.per_row())])
    return row, first - firsts[row], h


def chains(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Chains of the matches (x, y), in order of x: places in the arrays, best chains first.

    A match's score is 1 plus the best score before it in both documents, less GAP_COST for
    every word between; the tree holds, for each y, the best score with the costs up to there.
    """
    n = len(x)
    if n == 1:
        return [np.zeros(1, np.int64)]
    order = np.lexsort((y, x))
    if (np.diff(x[order]) > 0).all() and (np.diff(y[order]) > 0).all():
        # All in one order: the best match before each is the one just before.
        cost = GAP_COST * (np.diff(x[order]) + np.diff(y[order]))
        score, cuts = 1.0, []
        for i, c in enumerate(cost.tolist()):
            score = 1 + score - c if score > c else 1.0
            if score == 1.0:
                cuts.append(i + 1)
        return sorted(np.split(order, cuts), key=len, reverse=True)
    rank = np.unique(y, return_inverse=True)[1] + 1
    size = int(rank.max()) + 1
    tree_score, tree_at = [-1e18] * (size + 1), [-1] * (size + 1)
    score, before = np.ones(n), np.full(n, -1)
    start = 0
    while start < n:
        end = start
        while end < n and x[order[end]] == x[order[start]]:
            end += 1
        same_x = order[start:end]
        for i in same_x:  # all of one x look back before any of them is entered
            best, at, r = -1e18, -1, int(rank[i]) - 1
            while r > 0:
                if tree_score[r] > best:
                    best, at = tree_score[r], tree_at[r]
                r -= r & -r
            gain = best - GAP_COST * (x[i] + y[i])
            if at >= 0 and gain > 0:
                score[i], before[i] = 1 + gain, at
        for i in same_x:
            value, r = score[i] + GAP_COST * (x[i] + y[i]), int(rank[i])
            while r <= size:
                if value > tree_score[r]:
                    tree_score[r], tree_at[r] = value, i
                r += r & -r
        start = end
    used, out = np.zeros(n, bool), []
    for i in np.argsort(-score, kind="stable"):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short stretches."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        row = np.maximum.accumulate(np.maximum(row, np.concatenate([[0], row[:-1] + (b == w)])))
    return int(row[-1])


def reach(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, equal ones) by which two stretches go on alike from their start."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    equal = a[:n] == b[:n]
    total = np.cumsum(np.where(equal, 1, -2))
    best = int(total.argmax())
    return (best + 1, int(equal[:best + 1].sum())) if total[best] > 0 else (0, 0)


def align(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, a0: int, b0: int) -> tuple[int, int, int, int, int]:
    """(start, end, start there, end there, equal words) of a chain, given the words around it.

    a and b are the documents' words from a0 and b0 on.
    """
    x, y = x - a0, y - b0
    equal = 0
    at_a, at_b = int(x[0]), int(y[0])
    turns = np.flatnonzero(np.diff(x - y)) + 1
    for block in np.split(np.arange(len(x)), turns):
        start, end, shift = int(x[block[0]]), int(x[block[-1]]) + K, int(x[block[0]] - y[block[0]])
        if start > at_a and start - shift > at_b:  # between two diagonals
            equal += common_words(a[at_a:start], b[at_b:start - shift])
        start = max(start, at_a, at_b + shift)
        if end > start:
            equal += int((a[start:end] == b[start - shift:end - shift]).sum())
            at_a, at_b = end, end - shift
    ahead, more = reach(a[at_a:], b[at_b:])
    back, less = reach(a[:int(x[0])][::-1], b[:int(y[0])][::-1])
    return int(x[0]) - back + a0, at_a + ahead + a0, int(y[0]) - back + b0, at_b + ahead + b0, equal + more + less


def wide_seeds(row: np.ndarray, at: np.ndarray, h: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of runs of WIDE seeds of one row that are all there, at the place of their first."""
    n = len(h) - WIDE + 1
    if n <= 0:
        return row[:0], at[:0], h[:0]
    wide, whole = np.full(n, np.uint64(WIDE)), row[:n] == row[WIDE - 1:]
    with np.errstate(over="ignore"):
        for j in range(WIDE):
            wide = hashing.mix(wide * np.uint64(0x9E3779B97F4A7C15) + h[j:n + j])
            whole &= there[j:n + j]
    return row[:n][whole], at[:n][whole], wide[whole]


def shared_seeds(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap of the places that seeds of more than one document have, hot places).

    Places are the first BITS bits of hashes; tasks send 16 bits a seed, grouped by the rest of its place,
    and count in tables whose size the number of bits gives.
    """
    inside = np.uint64((1 << 16) - 1)

    def sent_rows(held: list[np.ndarray]) -> pa.RecordBatch:
        places = np.sort(np.concatenate(held))
        blocks, starts = np.unique(places >> np.uint64(16), return_index=True)
        data = (places & inside).astype(np.uint16).tobytes()
        ends = np.append(starts[1:], len(places))
        return pa.record_batch(
            [pa.array(blocks.astype(np.int32)), pa.array([data[2 * i:2 * j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
            names=["block", "offsets"],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in hashing.parts(batches, 0):
            row, _, h = sampled(hashing.words(part.column(0), hashing.LETTERS, latin=True))
            held.append(hashing.distinct(row, h)[1] >> np.uint64(64 - BITS))
            if sum(map(len, held)) > 1 << 21:
                yield sent_rows(held)
                held.clear()
        if sum(map(len, held)):
            yield sent_rows(held)

    def counted(block: int, n: np.ndarray) -> pa.RecordBatch:
        seen = int(n.sum())
        hot = np.flatnonzero(n > max(seen / HOT_SHARE, LEAST_HOT))
        return pa.record_batch(
            [pa.array([block], pa.int32()), pa.array([np.packbits(n > 1).tobytes()], pa.binary()), pa.array([seen]),
             pa.array([[{"place": (block << 16) + int(i), "n": int(n[i])} for i in hot]], pa.list_(pa.struct({"place": pa.int64(), "n": pa.int64()})))],
            names=["block", "bits", "seen", "hot"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of blocks, one table of counts at a time."""
        now, n = None, np.zeros(1 << 16, np.int64)
        for batch in batches:
            for block, offsets in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now is not None and block != now:
                    yield counted(now, n)
                    n[:] = 0
                now = block
                n += np.bincount(np.frombuffer(offsets.as_buffer(), np.uint16), minlength=1 << 16)
        if now is not None:
            yield counted(now, n)

    sent = documents.select("text").mapInArrow(read, "block int, offsets binary").repartition("block").sortWithinPartitions("block")
    blocks = stored(sent.mapInArrow(count, "block int, bits binary, seen long, hot array<struct<place:long,n:long>>"), "passage-places")
    total = blocks.agg(F.sum("seen")).first()[0] or 0
    hot = blocks.select(F.inline("hot")).where(F.col("n") > max(total / HOT_SHARE, LEAST_HOT)).toArrow()  # fewer than HOT_SHARE rows
    out = np.zeros((1 << BITS) >> 3, np.uint8)
    found = blocks.select("block", "bits").toArrow()  # the bitmap's size at most
    for block, bits in zip(found["block"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[block << 13:(block + 1) << 13] = np.frombuffer(bits, np.uint8)
    return out, np.sort(hot["place"].to_numpy().astype(np.uint64))


def matches(documents: DataFrame) -> DataFrame:
    """(key, x, other, y): seeds of documents(key, doc_id, text) and their first occurrence in another one."""
    context = documents.sparkSession.sparkContext
    shared, hot_places = shared_seeds(documents)
    sent, hot_sent = context.broadcast(shared), context.broadcast(hot_places)
    kind = dict(documents.dtypes)["doc_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in hashing.parts(batches, 2):
            row, at, h = sampled(hashing.words(part.column(2), hashing.LETTERS, latin=True))
            there = among(sent.value, h, BITS)
            wide = wide_seeds(row, at, h, there)
            hot = np.concatenate([np.isin(h[there] >> np.uint64(64 - BITS), hot_sent.value), np.zeros(len(wide[2]), bool)])
            row, at, h = (np.concatenate([one[there], two]) for one, two in zip((row, at, h), wide, strict=True))
            yield pa.record_batch(
                [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(hot)],
                names=["key", "doc_id", "seed", "x", "hot"],
            )

    form = f"key long, doc_id {kind}, seed long, x int, hot boolean"
    seeds = stored(documents.select("key", "doc_id", "text").mapInArrow(read, form), "passage-seeds")

    # Hot seeds, fewer than HOT_SHARE, are reduced where they are read and spread over tasks; their first places go to every task.
    rows = seeds.count()
    hot = seeds.where("hot").groupBy("seed").agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("nowhere"), "doc_id", "key", "x")).alias("first")
    ).where(F.col("n") > max(rows / HOT_SHARE, LEAST_HOT)).select("seed", F.col("first.key").alias("other"), F.col("first.x").alias("y")).orderBy("seed").toArrow()
    firsts = context.broadcast([hot[c].to_numpy() for c in ("seed", "other", "y")])

    def with_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of seed and document: the first of each seed is kept in mind, but for hot ones."""
        hot_seed, hot_other, hot_y = firsts.value
        last, other, y = None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            seed, key, x = (batch.column(c).to_numpy() for c in ("seed", "key", "x"))
            begins = np.concatenate([[last is None or seed[0] != last], seed[1:] != seed[:-1]])
            start = np.maximum.accumulate(np.where(begins, np.arange(len(seed)), -1))
            others = np.where(start >= 0, key[start], other)
            ys = np.where(start >= 0, x[start], y)
            last, other, y = seed[-1], others[-1], ys[-1]
            if len(hot_seed):
                at = np.minimum(np.searchsorted(hot_seed, seed), len(hot_seed) - 1)
                is_hot = hot_seed[at] == seed
                others, ys = np.where(is_hot, hot_other[at], others), np.where(is_hot, hot_y[at], ys)
            kept = key != others
            yield pa.record_batch([pa.array(c[kept]) for c in (key, x, others, ys.astype(np.int32))], names=["key", "x", "other", "y"])

    is_hot = F.col("seed").isin(hot["seed"].to_pylist()) if len(hot) else F.lit(False)
    share = F.when(is_hot, F.pmod("key", F.lit(1024))).otherwise(0)
    order = [F.col("doc_id").asc_nulls_last(), "key", "x"]
    dealt = seeds.withColumn("share", share).repartition("seed", "share").sortWithinPartitions("seed", *order).select("seed", "key", "x")
    return dealt.mapInArrow(with_first, "key long, x int, other long, y int")


def spans(found: DataFrame) -> DataFrame:
    """(key, other, xs, ys) of every chain of the matches that has some breadth; a document's matches are one group."""

    def chained(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        other, x, y = (rows[c].to_numpy() for c in ("other", "x", "y"))
        order = np.lexsort((y, x, other))
        other, x, y = other[order], x[order], y[order]
        new = np.concatenate([[True], (np.diff(other) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)])
        other, x, y = other[new], x[new], y[new]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(other)) + 1, [len(other)]])
        broad = x[cuts[1:] - 1] - x[cuts[:-1]] >= LEAST_BREADTH
        out = []
        for start, end in zip(cuts[:-1][broad], cuts[1:][broad], strict=True):
            xs, ys = x[start:end], y[start:end]
            for chain in chains(xs, ys):
                if xs[chain[-1]] - xs[chain[0]] >= LEAST_BREADTH:
                    out.append((key[0].as_py(), int(other[start]), xs[chain], ys[chain]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "other", "xs", "ys"])

    return found.groupBy("key").applyInArrow(chained, "key long, other long, xs array<int>, ys array<int>")


def word_blocks(documents: DataFrame) -> DataFrame:
    """(key, block, words): 16 bits of the hash of every word, BLOCK words a row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in hashing.parts(batches, 1):
            found = hashing.words(part.column(1), hashing.LETTERS, latin=True)
            short = (found.hash >> np.uint64(48)).astype(np.uint16).view(np.int16)
            counts = found.per_row()
            blocks = -(-counts // BLOCK)
            row = np.repeat(np.arange(len(part)), blocks)
            block = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            ends = np.minimum((block + 1) * BLOCK, counts[row]) + np.repeat(np.cumsum(counts) - counts, blocks)
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(short))
            yield pa.record_batch([part.column(0).take(pa.array(row)), pa.array(block.astype(np.int32)), words], names=["key", "block", "words"])

    return documents.select("key", "text").mapInArrow(cut, "key long, block int, words array<smallint>")


def stretches(documents: DataFrame, chained: DataFrame) -> DataFrame:
    """(key, other, start, stop, there, there_stop, equal) of every chain after alignment.

    Chains ask for blocks of words of both documents.  A block that very many ask for is one row of a plain join.
    """
    at = F.xxhash64("doc", "block").alias("at")
    sides = F.array(*(
        F.struct(F.lit(i).alias("side"), F.col(doc).alias("doc"), F.greatest(F.lit(0), F.col(low)[0] - MARGIN).alias("lo"),
                 (F.element_at(low, -1) + K + MARGIN).alias("hi"))
        for i, (doc, low) in enumerate((("key", "xs"), ("other", "ys")))
    ))
    asked = chained.select("id", F.explode(sides).alias("s")).select("id", "s.*")
    asked = asked.select("*", F.explode(F.expr(f"sequence(int(lo div {BLOCK}), int((hi - 1) div {BLOCK}))")).alias("block")).select("id", "side", "block", "lo", "hi", at)
    blocks = word_blocks(documents).select(F.col("key").alias("doc"), "block", "words")
    blocks = stored(maybe_among(blocks.select(at, "words"), "at", asked).dropDuplicates(["at"]), "passage-words")
    first = F.greatest(F.col("lo") - F.col("block") * BLOCK, F.lit(0))
    pieces = asked.join(blocks, "at").select(
        "id", F.struct("block", F.slice("words", first + 1, F.least(F.col("hi") - F.col("block") * BLOCK, F.lit(BLOCK)) - first).alias("words")).alias("piece"), "side"
    )

    def words_of(side: int) -> Column:
        return F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("piece")))), lambda p: p["words"]))

    around = pieces.groupBy("id").agg(words_of(0).alias("a"), words_of(1).alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            flat = {c: (batch.column(c).flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.asarray(batch.column(c).value_lengths()))])) for c in ("xs", "ys", "a", "b")}
            for r in range(len(batch)):
                xs, ys, a, b = (values[cuts[r]:cuts[r + 1]] for values, cuts in (flat[c] for c in ("xs", "ys", "a", "b")))
                rows.append(align(xs, ys, a, b, max(0, int(xs[0]) - MARGIN), max(0, int(ys[0]) - MARGIN)))
            columns = np.array(rows, np.int32).reshape(-1, 5).T
            yield pa.record_batch(
                [batch.column("key"), batch.column("other"), *[pa.array(c) for c in columns]],
                names=["key", "other", "start", "stop", "there", "there_stop", "equal"],
            )

    joined = chained.join(around, "id").select("key", "other", "xs", "ys", "a", "b")
    return joined.mapInArrow(compare, "key long, other long, start int, stop int, there int, there_stop int, equal int")


def repeated(documents: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, from_word, to_word, n_words, matched_doc_id, matched_from, matched_to, equal_words.

    One row for each passage of documents(doc_id, text) that earlier documents, by doc_id,
    have already, with the longest stretch of it and where that is.  Words count from 0, ends
    are exclusive.  Null and empty texts have no passages.  Rows that repeat doc_id and text are
    one document; rows without doc_id come after all others.  An empty table gives an empty result.
    """
    docs = documents.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    chained = spans(matches(docs))
    chained = stored(chained.withColumn("id", F.xxhash64("key", "other", F.col("xs")[0], F.col("ys")[0])), "passage-chains")
    found = stretches(docs, chained)
    length = F.greatest(F.col("stop") - F.col("start"), F.col("there_stop") - F.col("there"))
    found = found.where((F.col("equal") >= LEAST_STRETCH) & (F.col("equal") >= F.lit(similarity) * length))

    def merged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        columns = {c: rows[c].to_numpy() for c in ("other", "start", "stop", "there", "there_stop", "equal")}
        out, held, end = [], [], -1
        for i in np.argsort(columns["start"], kind="stable"):
            if held and columns["start"][i] > end + LEFT_OUT:
                out.append(held)
                held = []
            held.append(i)
            end = max(end, int(columns["stop"][i])) if len(held) > 1 else int(columns["stop"][i])
        passages = []
        for held in [*out, held]:
            start, stop = int(columns["start"][held].min()), int(columns["stop"][held].max())
            best = max(held, key=lambda i: (columns["equal"][i], -columns["other"][i]))
            if stop - start >= least_words:
                passages.append((key[0].as_py(), start, stop, int(columns["other"][best]), int(columns["there"][best]), int(columns["there_stop"][best]), int(columns["equal"][best])))
        names = ["key", "from_word", "to_word", "other", "matched_from", "matched_to", "equal_words"]
        values = list(zip(*passages, strict=True)) if passages else [[]] * 7
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.table([pa.array(c, t) for c, t in zip(values, types, strict=True)], names=names)

    form = "key long, from_word int, to_word int, other long, matched_from int, matched_to int, equal_words int"
    passages = stored(found.groupBy("key").applyInArrow(merged, form), "passages")
    ids = docs.select("key", "doc_id")
    # A document may be the first holder for very many: its id is joined in shares.
    salts = F.array(*(F.lit(i) for i in range(SALTS)))
    of_other = ids.join(passages.select(F.col("other").alias("key")).distinct(), "key", "left_semi").dropDuplicates(["key"]).select(
        F.col("key").alias("other"), F.col("doc_id").alias("matched_doc_id"), F.explode(salts).alias("salt")
    )
    salted = passages.withColumn("salt", F.pmod(F.xxhash64("key", "from_word"), F.lit(SALTS)).cast("int"))
    return ids.join(salted.join(of_other, ["other", "salt"]), "key").select(
        "doc_id", "from_word", "to_word", (F.col("to_word") - F.col("from_word")).alias("n_words"),
        "matched_doc_id", "matched_from", "matched_to", "equal_words",
    )

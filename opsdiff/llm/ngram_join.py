"""N-gram Jaccard join with prefixes of token combinations.

A document's tokens are its distinct word shingles, as 64-bit hashes.  Documents with equal
sets are one class, seen from then on by its smallest id.  Tokens are of two kinds, by how
many classes have them: rare ones, and frequent ones in groups by hash.  All documents put
their tokens in one order, rare ones first, very frequent ones last and by hash within a kind,
and index a prefix of them: rare tokens one by one, frequent ones in pairs of the same group.  Two
documents that share no index entry share no rare prefix token and at most one token a group;
a prefix is long enough when that leaves too few common tokens for the similarity asked for.
So no link is lost, a frequent token never makes a list of its own, and most documents need
only their few smallest hashes.

Entries with two classes or more give candidates; the full sets decide.  An entry that very
many classes share is not expanded into pairs: each class meets the entry's hub, the one with
fewest rare tokens, and is verified against it; only classes that are then still in
different components meet each other.

Tokens are counted one by one over all classes.  Which are frequent is a bitmap of fixed size made from
these counts; a token that shares a bit with frequent ones counts as frequent, for all documents alike.  An entry
stays only if its token is truly in a second class, which a join decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdiff.llm import hashing
from opsdiff.llm.bitmaps import among, bitmap, place
from opsdiff.llm.common import TEXTS_AT_ONCE, components, joined_components, maybe_among, removed, stored

BITS = 26         # of the bitmaps: 8 MB each
RARE = 6          # classes that may have a rare token
OFTEN = 64        # classes from which on a frequent token comes last in the order
GROUP_TOKENS = 6  # frequent prefix tokens that a group is meant for


def allowed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n tokens may be missing in a document similar enough."""
    return n - -(-n * percent // 100)


def token_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token) distinct and sorted, and the tokens of each row."""
    found = hashing.words(text)
    row, _, h = hashing.runs(found, k)
    row, h = hashing.distinct(row, h)
    return row, h, np.bincount(row, minlength=len(text))


def lowest(count: np.ndarray, percent: int) -> np.ndarray:
    """Tokens kept at first: one and a half times the prefix of rare tokens and some."""
    return np.minimum(count, 3 * (allowed(count, percent) + 1) // 2 + 4)


def summaries(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """key, doc_id, n, d1 and d2 (a digest of the set), low (the smallest tokens, in order)."""
    id_type = dict(documents.dtypes)["doc_id"]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in hashing.parts(batches, 2):
            row, h, count = token_sets(part.column(2), k)
            firsts = np.concatenate([[0], np.cumsum(count)])
            digests = []
            with np.errstate(over="ignore"):
                for salt in (1, 2):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashing.mix(h + np.uint64(salt)), dtype=np.uint64)])
                    digests.append(pa.array((sums[firsts[1:]] - sums[firsts[:-1]]).view(np.int64)))
            kept = np.arange(len(h)) - firsts[row] < lowest(count, percent)[row]
            yield pa.record_batch(
                [*part.columns[:2], pa.array(count.astype(np.int32)), *digests, hashing.lists(row[kept], h[kept], len(part), pa.int64())],
                names=["key", "doc_id", "n", "d1", "d2", "low"],
            )

    return documents.select("key", "doc_id", "text").mapInArrow(
        summarise, f"key long, doc_id {id_type}, n int, d1 long, d2 long, low array<long>"
    )


def full_sets(documents: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """(key, tokens in order of hash) for the documents of keys, one row each.

    The keys' bitmap is applied where the texts are read, the keys themselves to what is left.
    """
    sent = documents.sparkSession.sparkContext.broadcast(bitmap(keys.select(place(F.col("key"), BITS).alias("place")), BITS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.filter(pa.array(among(sent.value, batch.column(0).to_numpy().view(np.uint64), BITS)))
            for part in hashing.parts(iter([asked]), 1):
                row, h, _ = token_sets(part.column(1), k)
                yield pa.record_batch([part.column(0), hashing.lists(row, h, len(part), pa.int64())], names=["key", "tokens"])

    found = documents.select("key", "text").mapInArrow(read, "key long, tokens array<long>")
    return found.join(keys.select("key").distinct(), "key").dropDuplicates(["key"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, length of each row) of a column of arrays of hashes."""
    count = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    return np.repeat(np.arange(len(column)), count), column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), count


def _bands(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, groups) in which a document of n tokens is indexed: its own power of two, and the lower
    one if a similar document may be there."""
    b = n.bit_length() - 1
    bands = [b] + ([b - 1] if b and n * percent < (100 << b) else [])
    return [(x, max(1, (1 << x) * (100 - percent) // 100 // GROUP_TOKENS)) for x in bands]


def entries_of(tokens: np.ndarray, level: np.ndarray, missing: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(index entries, unmatched) of one document, all of whose tokens are given in order of hash.

    level: 0 for rare tokens, 1 for frequent, 2 for very frequent ones.  unmatched: how many
    tokens a document cannot have in common with this one if the entry is the first they share:
    those before it but for one in each group.
    """
    rare = tokens[level == 0][:missing + 1]
    if len(rare) > missing:
        return rare, np.arange(len(rare))
    often = np.concatenate([tokens[level == 1], tokens[level == 2]])
    out, unmatched = [rare], [np.arange(len(rare))]
    with np.errstate(over="ignore"):
        for band, groups in _bands(len(tokens), percent):
            group = (hashing.mix(often + np.uint64(band + 1)) % np.uint64(groups)).astype(np.int64)
            # A group's first token in the prefix is not enough; every later one counts.
            first = np.zeros(len(often), bool)
            first[np.unique(group, return_index=True)[1]] = True
            later = np.cumsum(~first)
            enough = np.searchsorted(later, missing + 1 - len(rare)) + 1
            of = group[:enough]
            for g in np.unique(of):
                at = np.flatnonzero(of == g)
                a, b = np.triu_indices(len(at), 1)
                low, high = np.minimum(often[at[a]], often[at[b]]), np.maximum(often[at[a]], often[at[b]])
                out.append(hashing.mix(hashing.mix(low + np.uint64(band)) * np.uint64(3) + high))
                unmatched.append(len(rare) + later[at[b]] - 1)
    return np.concatenate(out), np.concatenate(unmatched)


def index(classes: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """(entry, key, n, rare, classes, hub): the entries of classes(key, n, low) that several have.

    rare: how many tokens of the class a document cannot share whose first common entry this is.
    """
    spark = classes.sparkSession

    def counted(tokens: DataFrame) -> DataFrame:
        return tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")

    def marked(tokens: DataFrame) -> np.ndarray:
        return bitmap(tokens.select(place(F.col("token"), BITS).alias("place")), BITS)

    def unsettled(frequent: np.ndarray) -> DataFrame:
        """Classes whose smallest tokens hold too few rare ones."""
        sent = spark.sparkContext.broadcast(frequent)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, token, _ = _lists(batch.column(2))
                rare = np.bincount(row[~among(sent.value, token, BITS)], minlength=len(batch))
                few = rare <= allowed(batch.column(1).to_numpy().astype(np.int64), percent)
                yield batch.filter(pa.array(few)).select(["key"])

        return classes.select("key", "n", "low").mapInArrow(look, "key long")

    counts = stored(counted(classes.select(F.explode("low").alias("token"))), "join-counts")
    frequent = marked(counts.where(F.col("n") > RARE))
    first = stored(unsettled(frequent), "join-open", TEXTS_AT_ONCE)
    sets = full_sets(documents, first, k)
    of_open = stored(counted(sets.select(F.explode("tokens").alias("token"))).where(F.col("n") > RARE), "join-counts", TEXTS_AT_ONCE)
    frequent |= marked(of_open)
    often = marked(counts.unionByName(of_open).where(F.col("n") > OFTEN))
    open_ = stored(unsettled(frequent), "join-open", TEXTS_AT_ONCE)
    removed(first, of_open)

    sent = spark.sparkContext.broadcast(frequent)
    last = spark.sparkContext.broadcast(often)
    form = "entry long, key long, n int, rare int"

    def all_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, token, count = _lists(batch.column(1))
            level = among(sent.value, token, BITS).astype(np.int8) + among(last.value, token, BITS)
            cuts = np.concatenate([[0], np.cumsum(count)])
            missing = allowed(count, percent)
            for r in range(len(batch)):
                inside = slice(cuts[r], cuts[r + 1])
                entries, rare = entries_of(token[inside], level[inside], int(missing[r]), percent)
                yield pa.record_batch(
                    [pa.array(entries.view(np.int64)), pa.repeat(batch.column(0)[r], len(entries)),
                     pa.repeat(pa.scalar(int(count[r]), pa.int32()), len(entries)), pa.array(rare.astype(np.int32))],
                    names=["entry", "key", "n", "rare"],
                )

    hard = stored(full_sets(documents, open_, k).mapInArrow(all_known, form), "join-hard", TEXTS_AT_ONCE)
    # A rare token that no second class has, and no class above, needs no entry.
    twice = counts.select("token").unionByName(hard.select(F.col("entry").alias("token")))
    seen = spark.sparkContext.broadcast(marked(twice))

    def low_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, token, _ = _lists(batch.column(2))
            n = batch.column(1).to_numpy()
            rare = ~among(sent.value, token, BITS)
            row, token = row[rare], token[rare]
            of = np.bincount(row, minlength=len(batch))
            at = np.arange(len(row)) - np.concatenate([[0], np.cumsum(of)])[row]
            need = allowed(n.astype(np.int64), percent) + 1
            chosen = (of[row] >= need[row]) & (at < need[row]) & among(seen.value, token, BITS)
            row, token = row[chosen], token[chosen]
            yield pa.record_batch(
                [pa.array(token.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(n[row].astype(np.int32)), pa.array(at[chosen].astype(np.int32))],
                names=["entry", "key", "n", "rare"],
            )

    easy = classes.select("key", "n", "low").mapInArrow(low_enough, form)
    # The bitmap lets more and more others through as tokens become many; the join lets none.
    easy = easy.join(twice.select(F.col("token").alias("entry")), "entry", "left_semi")
    entries = stored(easy.unionByName(hard), "join-entries", TEXTS_AT_ONCE)
    removed(counts, open_, hard)
    # Entries that no other class has are of no further use.
    shared = entries.groupBy("entry").agg(F.count("*").alias("classes"), F.min(F.struct("rare", "key", "n")).alias("hub")).where("classes > 1")
    found = stored(entries.join(shared, "entry"), "join-index")
    removed(entries)
    return found


def close_enough(n_a, rare_a, n_b, rare_b, percent: int):
    """Whether two classes may reach the similarity: rare prefix tokens before the entry are not shared."""
    most = F.least(n_a - rare_a, n_b - rare_b)
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (most * (100 + percent) >= (n_a + n_b) * percent)


def verified(pairs: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; written."""
    keys = stored(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "join-keys")
    sets = stored(full_sets(documents, keys, k), "join-sets", TEXTS_AT_ONCE)
    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("of_a"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    links = stored(both.where(
        F.col("common") * 100 >= (F.size("of_a") + F.size("of_b") - F.col("common")) * percent
    ).select("a", "b"), "join-links")
    removed(keys, sets)
    return links


def join(documents: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, key, n_shingles, component_id and component for documents(doc_id, text).

    Tokens are the distinct k-word shingles, A-Z folded; a text of fewer words is one shingle.
    Documents link when 100 * common >= percent * all their tokens.  component_id is the
    smallest doc_id that links reach, null if no document there has one.  Null texts and texts
    without words have no tokens and link with nothing.  Rows that repeat a doc_id are documents
    of their own.  An empty table gives an empty result.  key is a hash of doc_id and text,
    component names the group of a document with tokens, null for others.
    """
    documents = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    wide = stored(summaries(documents, k, percent), "join-summaries", TEXTS_AT_ONCE)
    rows = stored(wide.drop("low"), "join-documents")
    linked = rows.where("n > 0")
    classes = linked.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("key", "n")).alias("one"), F.count("*").alias("times")
    )
    classes = stored(classes.select("d1", "d2", "least_id", "one.*", "times"), "join-classes")
    # The tokens of a document without copies stay where they are; of copies, one's are taken.
    copied = classes.where("times > 1")
    alone = maybe_among(wide, "d1", copied, inside=False).where("n > 0").select("key", "n", "low")
    some = maybe_among(wide, "d1", copied).where("n > 0").select("key", "n", "low")
    some = stored(some.join(classes.select("key"), "key", "left_semi").dropDuplicates(["key"]), "join-copies")
    # Sets so small that not even one token more is allowed in a document around them can only be equal.
    large = alone.unionByName(some).where(F.col("n") * 100 >= (F.col("n") + 1) * percent)
    entries = index(large, documents, k, percent)
    removed(wide, some)

    close_to_hub = (F.col("key") != F.col("hub.key")) & close_enough(F.col("n"), F.col("rare"), F.col("hub.n"), F.col("hub.rare"), percent)
    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(ordered(entries.where(close_to_hub).select(F.col("hub.key").alias("a"), F.col("key").alias("b"))), "join-pairs")
    found = components(verified(pairs, documents, k, percent))

    # Classes of one entry that are not yet connected meet each other.
    placed = entries.where("classes > 2").join(found.select(F.col("node").alias("key"), "component"), "key", "left")
    placed = placed.withColumn("component", F.coalesce("component", "key"))
    mixed = placed.groupBy("entry").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("entry")
    mixed = stored(placed.join(mixed, "entry").select("entry", "key", "n", "rare", "component"), "join-mixed")
    other = mixed.select("entry", *[F.col(c).alias(f"o_{c}") for c in ("key", "n", "rare", "component")])
    rest = mixed.join(other, "entry").where(
        (F.col("key") < F.col("o_key")) & (F.col("component") != F.col("o_component"))
        & close_enough(F.col("n"), F.col("rare"), F.col("o_n"), F.col("o_rare"), percent)
    )
    rest = ordered(rest.select(F.col("key").alias("a"), F.col("o_key").alias("b"))).join(pairs, ["a", "b"], "left_anti")
    rest = stored(rest, "join-rest")
    removed(entries, mixed, pairs)
    if rest.limit(1).count():
        found = joined_components(found, verified(rest, documents, k, percent))

    placed = classes.join(found.select(F.col("node").alias("key"), "component"), "key", "left")
    placed = stored(placed.select("d1", "d2", "least_id", F.coalesce("component", "key").alias("component")), "join-placed")
    removed(classes, rest)
    smallest = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = placed.select("d1", "d2", "component").join(smallest, "component")
    return linked.join(of_class, ["d1", "d2"]).select(
        "doc_id", "key", F.col("n").cast("long").alias("n_shingles"), "component_id", "component"
    ).unionByName(rows.where("n = 0").select(
        "doc_id", "key", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component")
    ))


def one_of_each(documents: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """The documents, all columns, with one of each group: the smallest doc_id's.

    Of equal rows one stays; documents without words all stay.
    """
    joined = stored(join(documents, k, percent).select("key", "doc_id", "component"), "join-groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    grouped = joined.where("component is not null")
    best = grouped.groupBy("component").agg(F.min(order).alias("best")).select(F.col("best.key").alias("key"))
    times = grouped.groupBy("key").agg(F.count("*").alias("times"))
    # Documents that go, and those that stay although their rows are repeated.
    gone = times.join(best, "key", "left_anti").select("key", F.lit(False).alias("stays"))
    again = times.where("times > 1").join(best, "key").select("key", F.lit(True).alias("stays"))
    special = stored(gone.unionByName(again), "join-special")
    rows = documents.select(F.xxhash64("doc_id", "text").alias("key"), F.struct("*").alias("row")).join(special, "key", "left")
    once = rows.where("stays").dropDuplicates(["key"])
    every = rows.where("stays is null").unionByName(once)
    return every.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])

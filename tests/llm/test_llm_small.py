"""Small tables: nulls, empty texts, repeated rows, no rows, clashing columns; results by brute force."""

import hashlib
import math
import os
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opsdiff.llm import common, decontaminate, fingerprints, hashing, html_text, lattice, line_dedup, mixing, ngram_join, passages, secrets, toxicity
from opsdiff.llm.common import components, maybe_among

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 97}x{i * i % 89}" for i in range(3000))


def prose(start, n):
    return " ".join(f"p{start + i}q{(start + i) * 7 % 101}" for i in range(n))


ODD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (4, "One", "en", "b", 3),
    (5, prose(0, 60), "en", "a", 1), (6, prose(0, 60), "en", "a", 1), (6, prose(0, 60), "en", "a", 1), (7, LONG, "de", "b", 1),
    (None, "no id here at all", "en", None, 1), (8, "Ünïcödé wörds ß 你好 \U0001f600 end", "de", "c", 1), (9, prose(0, 57) + " other three words", "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def clashing(odd):
    """Columns that have the names the operators use inside."""
    for name in ("key", "row", "size", "copies", "place", "line", "component", "_key", "gone", "score", "train", "class"):
        odd = odd.withColumn(name, F.lit("mine"))
    return odd


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, prose(0, 40)), (2, None), (3, ""), (4, "two words"), (1, prose(0, 40))], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 0, 1), (6, 1, 0), (7, None, None), (None, 1, 1), (5, 0, 0)], "doc_id long, quality long, toxic long")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_components_of_chain_star_and_pair(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(-5, 7000)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[7000] == -5
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_maybe_among_keeps_all_members(spark):
    many = spark.range(20000).select(F.xxhash64("id").alias("h"), "id")
    few = many.where("id % 50 = 0").select("h")
    kept = maybe_among(many, "h", few)
    assert kept.join(few, "h").count() == few.count()
    assert kept.count() < 600


# Mixing

def by_hand_targets(sizes, share=1.5, most=2.0, weights=(5.0, 2.0, 1.0)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total, out = set(order), share * sum(sizes.values()), {}
    while left:
        level = total / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] >= most * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in left}
        for s in over:
            out[s] = most * sizes[s]
            total -= out[s]
            left.remove(s)
    return out


def test_mix_reaches_targets_and_agrees_with_itself(spark):
    docs = [(i, " ".join(["w"] * (1 + i * 37 % 50)), "en", f"s{i * i % 7}" if i % 9 else None, 0) for i in range(900)]
    table = spark.createDataFrame(docs, SCHEMA)
    got = mixing.mixed_sizes(table).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert r["size"] == len(WORD.findall(docs[r["doc_id"]][1])) and 0 <= r["copies"] <= 2
    want = by_hand_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and math.isclose(r["target"], want[s]) for r in mine)
        assert abs(sum(r["copies"] * r["size"] for r in mine) - want[s]) <= 25
        assert len({r["copies"] for r in mine}) <= 2
    again = mixing.mixed_sizes(table.repartition(5))
    assert rows(again, "doc_id", "copies") == sorted(((r["doc_id"], r["copies"]) for r in got), key=repr)


def test_inclusion_follows_the_probabilities(spark):
    table = spark.createDataFrame([(i, "s", 1, 1.0 + i % 2) for i in range(4000)], "doc_id long, source string, size long, merit double")
    sources = spark.createDataFrame([("s", 4000, 1200.0)], "source string, source_size long, target double")
    got = mixing.mix(table, sources, merit="merit").collect()
    taken = [sum(r["copies"] for r in got if r["merit"] == m) for m in (1.0, 2.0)]
    assert abs(sum(taken) - 1200) <= 1 and 1.7 < taken[1] / taken[0] < 2.3


def test_mix_of_odd_rows(odd, clashing, none):
    got = mixing.mixed_sizes(odd)
    assert got.count() == len(ODD) and got.where("size = 0 and copies > 0").count() == 0
    out = mixing.mixed_documents(clashing.drop("copies"))
    assert out.columns == [*clashing.drop("copies").columns, "copies"] and out.where("key != 'mine'").count() == 0
    assert mixing.mixed_sizes(none).count() == 0


# Fingerprints

def test_edited_texts_and_equal_fingerprints(odd):
    got = [r for r in fingerprints.edited_fingerprints(odd).collect()]
    text = {}
    for i, t, *_ in ODD:
        if i is not None:
            text[i] = t or ""
    ids = sorted(text)
    for r in got:
        if r["doc_id"] is None:
            continue
        t, following = text[r["doc_id"]], text[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        n = len(t) // 4
        assert r["n_chars"] == len(t) and r["edited"] == t[:len(t) - n] + following[:n]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["sketch"] == []) == (not WORD.findall(t))
    assert len({tuple(r["sketch"]) for r in got if r["doc_id"] in (5, 6)}) == 1


def test_likeness_estimates_jaccard(spark):
    a, b = prose(0, 4000), prose(0, 3000) + " " + prose(9000, 1000)
    pair = spark.createDataFrame([(a, b)], "a string, b string")
    sa, sb = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    r = pair.select(fingerprints.likeness(sa, sb).alias("j"), fingerprints.containment(sa, sb).alias("c"),
                    (fingerprints.merged(sa, sb) == F.sort_array(F.array_union(sa, sb))).alias("m")).first()
    assert abs(r["j"] - 0.6) < 0.08 and abs(r["c"] - 0.75) < 0.08 and r["m"]


def test_no_documents_no_fingerprints(none):
    assert fingerprints.edited_fingerprints(none).count() == 0


# N-gram Jaccard join

def by_hand_join(docs, k=3, percent=90):
    sets = []
    for _, t, *_ in docs:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, d in zip(group, docs):
        if d[0] is not None:
            least[g] = min(least.get(g, d[0]), d[0])
    return sorted(((d[0], len(s), least.get(g) if s else d[0]) for d, s, g in zip(docs, sets, group)), key=repr)


def near_copies():
    docs = []
    for base in range(6):
        words = prose(base * 1000, 120 + 10 * base).split()
        for copy in range(30):
            edited = list(words)
            for e in range(copy % 5):
                edited[(copy * 13 + e * 29) % len(edited)] = f"edit{copy}x{e}"
            docs.append((base * 100 + copy, " ".join(edited[: len(edited) - copy % 3]), "en", "s", 0))
    return docs


def test_join_equals_all_pairs(spark):
    docs = near_copies()
    got = ngram_join.join(spark.createDataFrame(docs, SCHEMA))
    assert rows(got, "doc_id", "n_shingles", "component_id") == by_hand_join(docs)


@pytest.mark.parametrize("k, percent, least", [(3, 90, 9), (5, 80, 4)])
def test_join_links_small_sets_inside_larger_ones(spark, k, percent, least):
    docs = []
    for base in range(12):  # the last of them share their tokens with many, so that none is rare
        words = prose(base * 100 if base < 8 else 5000, least + k - 1)
        docs += [(base * 10, words, "en", "s", 0), (base * 10 + 1, words + f" end{base}", "en", "s", 0), (base * 10 + 2, f"start{base} " + words, "en", "s", 0)]
        docs += [(base * 10 + 3, " ".join(words.split()[1:]), "en", "s", 0)]
    got = rows(ngram_join.join(spark.createDataFrame(docs, SCHEMA), k, percent), "doc_id", "n_shingles", "component_id")
    assert got == by_hand_join(docs, k, percent)
    assert {(1, least + 1, 0), (2, least + 1, 0), (3, least - 1, 3)} <= set(got)


def test_join_of_odd_rows(odd, clashing, none):
    assert rows(ngram_join.join(odd), "doc_id", "n_shingles", "component_id") == by_hand_join(ODD)
    assert ngram_join.join(none).count() == 0
    kept = ngram_join.one_of_each(clashing)
    assert kept.columns == clashing.columns
    want = {i for i, n, c in by_hand_join(ODD) if not n or c in (i, None)}
    assert rows(kept, "doc_id") == sorted(((i,) for i in want), key=repr)


# Lines

def by_hand_lines(docs, similarity=0.8):
    first, places = {}, {}
    for i, t, *_ in docs:
        for p, line in enumerate((t or "").split("\n")):
            line = line.translate(FOLD).strip(" \t\r\f\v")
            if line:
                places.setdefault(line, []).append((i, p))
    lines = list(places)
    sets = [{s[k:k + 5] for k in range(len(s) - 4)} if len(s) >= 5 else {s} for s in lines]
    group = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    for g, line in zip(group, lines):
        first[g] = min(first.get(g, min(places[line])), min(places[line]))
    return sorted((o[0], o[1]) for g, line in zip(group, lines) for o in places[line] if o != first[g])


def line_docs():
    docs = []
    for i in range(40):
        lines = [prose(i * 50, 30), "The same footer in every text.", prose((i // 4) * 5000, 25) + (f" tail{i}" if i % 4 else ""), ""]
        docs.append((i, "\n".join(lines), "en", "s", 0))
    return docs


def test_lines_equal_all_pairs(spark):
    docs = line_docs()
    got = line_dedup.summarise(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r["doc_id"], p) for r in got for p in r["removed"]) == by_hand_lines(docs)
    assert all(r["n_lines"] == 4 and len(r["kept_in"]) == r["n_removed"] for r in got)


def test_repetitive_lines_have_bands_by_their_distinct_shingles(spark):
    a = [" ".join(f"w{(i + c) % 5} z{c}q" for i in range(300 + 10 * c)) for c in range(12)]
    b = [" ".join(f"w{(i + c) % 5} z{c}q" for i in range(600 + 10 * c)) for c in range(12)]
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(x for pair in zip(a, b) for x in pair)]
    table = spark.createDataFrame(docs, SCHEMA)
    signed = line_dedup.signatures(table.select(F.col("doc_id").alias("line_id"), F.lower("text").alias("line"))).collect()
    assert {r["line_id"] for r in signed} == set(range(24)) and all(len(set(r["bands"])) == len(line_dedup.BANDS) for r in signed)
    got = line_dedup.summarise(table).collect()
    assert sorted((r["doc_id"], p) for r in got for p in r["removed"]) == by_hand_lines(docs)


def test_lines_taken_at_every_place_by_words_and_in_pieces(spark):
    """Similar lines share a way and are linked, whatever their length and the length of their words."""
    def line(n, words):
        return " ".join(f"{(i * 7919 + n * 104729) % 99991:05}" for i in range(n)) if words else "".join(chr(97 + (i * i * 7 + i * n) % 26) for i in range(n))

    texts = [line(n, True) for n in (3, 9, 20, 22, 26, 27, 40, 400)] + [line(n, False) for n in (30, 127, 128, 160, 161, 900, 5000)]
    docs = [(k, t if k % 2 == 0 else t[:-2] + "zz", "en", "s", 0) for k, t in enumerate(x for t in texts for x in (t, t))]
    got = line_dedup.summarise(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r["doc_id"], p) for r in got for p in r["removed"]) == by_hand_lines(docs)


def test_text_ids_of_documents(spark):
    docs = spark.createDataFrame([("x", "one line that is long enough\nother"), ("y", "One line that is long enough")], "doc_id string, text string")
    assert [(r["doc_id"], r["removed"], r["kept_in"]) for r in line_dedup.summarise(docs).orderBy("doc_id").collect()] == [("x", [], []), ("y", [0], ["x"])]


def test_lines_of_odd_rows(spark, odd, clashing, none):
    got = line_dedup.summarise(odd)
    assert got.count() == len(ODD) and line_dedup.summarise(none).count() == 0
    kept = line_dedup.without_repeats(clashing)
    assert kept.columns == clashing.columns and kept.where("key != 'mine'").count() == 0
    ids = {r[0] for r in rows(kept, "doc_id")}
    assert {1, 2, 3, 4, 5, 7, 8} <= ids and 6 not in ids


def counted_steps(monkeypatch, module):
    """Rows of every step that the module stores from now on, by name."""
    rows_of, real = {}, module.stored

    def stored(df, name, *rest):
        out = real(df, name, *rest)
        rows_of.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(module, "stored", stored)
    return rows_of


def test_unlike_lines_of_one_band_do_not_meet_in_pairs(spark, monkeypatch):
    """Lines that share three fifths of their shingles share bands; none is similar to another but for the last two."""
    steps = counted_steps(monkeypatch, line_dedup)
    lines = [prose(0, 20)[:75] + "".join(chr(97 + (i * 31 + k * k * (i + 7) + k * 5) % 26) for k in range(25)) for i in range(60)]
    lines.append(lines[0][:-1] + "_")
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(lines)]
    got = line_dedup.summarise(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r["doc_id"], p) for r in got for p in r["removed"]) == by_hand_lines(docs)
    assert sum(steps["line-pairs"] + steps["line-rest"]) <= len(lines)


def test_unlike_long_lines_of_one_band_do_not_meet_in_pairs(spark, monkeypatch):
    """The same with lines of 1,500 characters."""
    steps = counted_steps(monkeypatch, line_dedup)
    lines = [" ".join(f"{(i * 7919 if i < 190 else i * 104729 + k * 15485863) % 99991:05}" for i in range(250)) for k in range(60)]
    lines.append(lines[0][:-1] + "_")
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(lines)]
    got = line_dedup.summarise(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r["doc_id"], p) for r in got for p in r["removed"]) == by_hand_lines(docs) == [(60, 0)]
    assert sum(steps["line-pairs"] + steps["line-rest"]) <= len(lines)


def test_near_copies_meet_hubs_and_not_each_other(spark, monkeypatch):
    """Copies of one line with changes of their own: many pairs are similar, few of them are compared."""
    steps = counted_steps(monkeypatch, line_dedup)
    lines = []
    for k in range(200):
        line = [chr(97 + (i * i * 7919 + i * 104729) % 99991 % 26) for i in range(400)]
        for j in range(5):
            line[(k * 7919 + j * j * 104729 + j * 31) % 97 * 4] = chr(48 + (k + j) % 10)
        lines.append("".join(line[:len(line) - k % 30]))
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(lines)]
    got = line_dedup.summarise(spark.createDataFrame(docs, SCHEMA)).collect()
    removed, by_hand = {(r["doc_id"], p) for r in got for p in r["removed"]}, set(by_hand_lines(docs))
    assert removed <= by_hand and len(removed) >= 0.98 * len(by_hand) > 100  # MinHash is not exhaustive
    assert sum(steps["line-pairs"] + steps["line-rest"]) <= sum(line_dedup.HUBS) * len(lines)


def test_equal_lines_have_one_signature(spark):
    lines = [(1, "a line of some words"), (1, "a line of some words"), (2, prose(0, 23)), (2, prose(0, 23)), (2, prose(0, 23)), (3, "one")]
    signed = line_dedup.signatures(spark.createDataFrame(lines, "line_id long, line string"))
    assert len(lines[2][1]) in range(line_dedup.SHORT, line_dedup.LONG + 1)  # taken both ways
    assert rows(signed, "line_id", "way", "times") == [(1, 0, 2), (2, 0, 3), (2, 1, 3), (3, 0, 1)]


def test_later_links_join_components_and_not_lines(spark, monkeypatch):
    """Chains of lines that drift: the links found last are walked alone, one a pair of components."""
    steps = counted_steps(monkeypatch, common)
    lines = []
    for chain in range(30):
        line = [chr(97 + (i * i * 7 + i * (chain + 3) + chain * 11) % 26) for i in range(120)]
        for step in range(12):
            line = line[:]
            line[(step * 37 + chain) % 120] = chr(48 + step % 10)
            lines.append("".join(line))
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(lines)]
    got = line_dedup.summarise(spark.createDataFrame(docs, SCHEMA)).collect()
    removed, by_hand = {(r["doc_id"], p) for r in got for p in r["removed"]}, set(by_hand_lines(docs))
    assert removed <= by_hand and len(removed) >= 0.98 * len(by_hand)  # MinHash is not exhaustive
    first, later = steps["edges"]
    assert later < first / 2


def test_joined_components_are_those_of_all_links(spark):
    first, later = [(1, 5), (5, 9), (2, 6), (3, 7)], [(9, 6), (5, 2), (20, 21), (7, 0), (21, 3), (1, 9)]
    edges = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    got = common.joined_components(components(edges(first)), edges(later))
    assert rows(got, "node", "component") == rows(components(edges(first + later)), "node", "component")


def test_outlines_keep_all_similar_pairs(spark):
    lines = [prose(b * 100, 4 + 9 * b)[: 500 + 20 * (b % 3)] for b in range(10)]
    lines += [t[: len(t) * cut // 100] + "x" * e for t in lines for cut in (99, 92, 83, 78) for e in (0, 3)] + ["", "abc", "abcde", "abcdef"]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id int, line string").select(
        "id", line_dedup.outline(F.col("line")).alias("o"), line_dedup.shingle_set(F.col("line")).alias("s"))
    other = made.select(*[F.col(c).alias("of_" + c) for c in made.columns])
    common = F.size(F.array_intersect("s", "of_s"))
    near = common >= 0.8 * (F.size("s") + F.size("of_s") - common)
    kept = line_dedup.may_reach(F.col("o"), F.col("of_o"), 0.8)
    got = {(r["near"], r["kept"]): r["count"] for r in made.crossJoin(other).groupBy(near.alias("near"), kept.alias("kept")).count().collect()}
    assert (True, False) not in got and got[(True, True)] > len(lines) and got[(False, False)] > 2 * got[(False, True)]


def test_fine_outlines_keep_all_similar_pairs_of_long_lines(spark):
    lines = [prose(b * 1000, 30 + 45 * b) for b in range(8)]
    lines += [t[: len(t) * cut // 100] + "x" * e for t in lines for cut in (99, 92, 83, 78, 60, 40) for e in (0, 3)] + ["", "abc", "abcde"]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id int, line string").select(
        "id", line_dedup.outline(F.col("line"), line_dedup.FINE).alias("o"), line_dedup.shingle_set(F.col("line")).alias("s"))
    other = made.select(*[F.col(c).alias("of_" + c) for c in made.columns])
    common = F.size(F.array_intersect("s", "of_s"))
    near = common >= 0.8 * (F.size("s") + F.size("of_s") - common)
    kept = line_dedup.may_reach(F.col("o"), F.col("of_o"), 0.8, line_dedup.FINE)
    got = {(r["near"], r["kept"]): r["count"] for r in made.crossJoin(other).groupBy(near.alias("near"), kept.alias("kept")).count().collect()}
    assert (True, False) not in got and got[(True, True)] > len(lines) and got[(False, False)] > 50 * got.get((False, True), 0)


def test_items_of_one_id_are_found_each(spark):
    items = spark.createDataFrame([(1, prose(0, 40)), (1, prose(500, 40)), (1, prose(0, 40)), (2, prose(0, 40))], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {prose(start, 40)} after", "en", "s", 0) for k, start in enumerate((0, 500, 900))], SCHEMA)
    assert rows(decontaminate.contaminated(docs, items), "doc_id", "item_id") == [(0, 1), (0, 2), (1, 1)]
    assert rows(decontaminate.without_leaks(docs, items), "doc_id") == [(2,)]


# Passages

def test_passages_are_found_with_edits(spark):
    shared = prose(100000, 90).split()
    fuzzy = list(shared)
    fuzzy[20], fuzzy[55] = "changed", "also"
    docs = [(1, prose(0, 80) + " " + " ".join(shared) + " " + prose(300, 40)), (2, prose(2000, 30) + " " + " ".join(fuzzy)),
            (3, prose(4000, 200)), (4, " ".join(shared[:30]) + " " + prose(6000, 50)), (5, None), (6, "")]
    got = passages.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["from_word"], r["to_word"], r["matched_doc_id"], r["matched_from"], r["matched_to"], r["equal_words"]) for r in got] == [
        (2, 30, 120, 1, 80, 170, 88)
    ]


def test_passages_whose_phrases_are_all_known_are_found(spark):
    """Every stretch of eleven words of a passage is in an earlier document of its own, too."""
    docs, want = [], set()
    for trial in range(30):
        shared = prose(10000 * trial, 60).split()
        at = 100 * trial
        docs += [(at + s, f"{prose(3 * 10**6 + 1000 * (at + s), 15)} {' '.join(shared[s:s + 11])} {prose(5 * 10**7 + 1000 * (at + s), 15)}") for s in range(50)]
        docs += [(at + s, f"{prose(10**8 + 1000 * (at + s), 30)} {' '.join(shared)}") for s in (60, 61)]
        want.add((at + 61, at + 60, 60))
    got = passages.repeated(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r["doc_id"], r["matched_doc_id"], r["equal_words"]) for r in got.collect()} == want


def test_a_passage_of_very_many_documents_has_one_first_holder(spark):
    """More holders than a hot seed has at least, so that its first place is sent instead of joined."""
    shared = prose(0, 50)
    docs = [(i, f"{prose(10**6 + 100 * i, 12)} {shared if i % 3 else ''} {prose(10**7 + 100 * i, 5)}") for i in range(3 * passages.LEAST_HOT // 2 + 60)]
    got = passages.repeated(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {tuple(r) for r in got.select("doc_id", "from_word", "to_word", "matched_doc_id", "equal_words").collect()} == {
        (i, 12, 62, 1, 50) for i, _ in docs if i % 3 and i > 1
    }


def test_recall_of_edited_passages(spark):
    """60 words with every n-th one changed: nearly all down to six in seven alike, none without likeness."""
    docs, kind = [], {}
    for n in (20, 12, 10, 8, 7, 2):
        for trial in range(40):
            at = 2 * len(kind)
            shared = prose(10000 * at, 60).split()
            edited = [f"x{w}" if i % n == n - 1 else w for i, w in enumerate(shared)]
            docs += [(at, f"{prose(10000 * at + 500, 30)} {' '.join(shared)}"), (at + 1, f"{prose(10000 * at + 700, 30)} {' '.join(edited)} {prose(10000 * at + 900, 30)}")]
            kind[at + 1] = n
    found = [kind[r["doc_id"]] for r in passages.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert all(found.count(n) >= 39 for n in (20, 12, 10)) and found.count(8) >= 36 and found.count(7) >= 36 and not found.count(2)


def test_passages_of_odd_rows(odd, none):
    got = passages.repeated(odd)
    assert {(r["doc_id"], r["matched_doc_id"]) for r in got.collect()} == {(6, 5), (9, 5)}
    assert passages.repeated(none).count() == 0


def test_chains_follow_one_order_and_pay_for_gaps():
    import numpy as np

    x = np.array([0, 10, 20, 30, 25, 400])
    y = np.array([5, 15, 25, 35, 2, 405])
    got = passages.chains(x, y)
    assert [list(c) for c in got] == [[0, 1, 2, 3], [4], [5]]


# Decontamination

def test_leaks_and_clean_texts(spark, items):
    w = prose(0, 40).split()
    edited = [x if i % 7 else f"new{i}" for i, x in enumerate(w)]
    docs = [(1, prose(500, 50) + " " + " ".join(w).upper() + " " + prose(700, 20)), (2, " ".join(edited) + " " + prose(900, 30)),
            (3, prose(5000, 400)), (4, " ".join(w[:8]) + " " + prose(7000, 40)), (5, None), (6, "")]
    got = rows(decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items), "doc_id", "item_id", "from_word", "to_word")
    assert got == [(1, 1, 50, 90), (2, 1, 1, 40)]


def test_decontamination_of_odd_rows(spark, clashing, none, items):
    clean = decontaminate.without_leaks(clashing, items)
    assert clean.columns == clashing.columns
    assert {r[0] for r in rows(clean, "doc_id")} == {1, 2, 3, 4, 7, None, 8}
    assert decontaminate.without_leaks(none, items).count() == 0
    assert decontaminate.without_leaks(clashing, items.limit(0)).count() == len(ODD)


# Toxicity

def toxic_docs():
    docs, marks = [], []
    for i in range(600):
        bad = i % 3 == 0
        group = ["women", "men", "gay", "straight"][i % 4]
        biased = bad if i % 5 else not bad
        words = prose(i * 31 % 400, 25).split() + ([f"vile{i % 4}", "nastyword"] if bad else []) + ([group] if biased else [])
        docs.append((i, " ".join(words), "en", "s", 0))
        marks.append((i, int(bad)))
    return docs, marks


def test_toxicity_on_held_out_rows_and_swapped_names(spark):
    docs, marks = toxic_docs()
    table, marked = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(table, marked)
    scored = table.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held"), toxicity.score(model, F.col("text")).alias("s"))
    label = dict(marks)
    for r in scored.collect():
        assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert (r["s"] >= 0.3) == bool(label[r["doc_id"]])
    neutral = spark.createDataFrame([(f"many {g} met on the square",) for g in ("women", "men", "gay", "straight")], "text string")
    scores = [r[0] for r in neutral.select(toxicity.score(model, F.col("text"))).collect()]
    assert max(scores) - min(scores) < 0.1 and max(scores) < 0.3


def test_toxicity_of_odd_rows(odd, none, labels, clashing):
    model = toxicity.train(odd, labels)
    got = [r[0] for r in odd.select(toxicity.score(model, F.col("text"))).collect()]
    assert len(got) == len(ODD) and all(0 <= s <= 1 for s in got)
    empty = toxicity.train(none, labels.limit(0))
    assert none.select(toxicity.score(empty, F.col("text"))).count() == 0
    assert {r[0] for r in odd.select(toxicity.score(empty, F.col("text"))).collect()} == {0.5}


# Language model

def test_scores_are_probabilities_and_base_is_exact(spark):
    docs = [(i, f"the cat{i % 5} sat on the mat{i % 3} " + ("Dog" if i % 2 else "the"), "en" if i % 4 else "de", "s", 0) for i in range(60)]
    train = ~lattice.held_out(F.col("doc_id"))
    got = {r["doc_id"]: r for r in lattice.score(spark.createDataFrame(docs, SCHEMA), train, lattice.read_pieces()).collect()}
    counts, total = {}, 0
    for i, t, *_ in docs:
        if zlib.crc32(str(i).encode()) % 10:
            for w in [*WORD.findall(t.translate(FOLD)), None]:
                counts[w] = counts.get(w, 0) + 1
                total += 1
    for i, t, *_ in docs:
        tokens = [*WORD.findall(t.translate(FOLD)), None]
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in tokens)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(w in counts for w in tokens), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_the_class_comes_from_all_words_whatever_is_broadcast(spark):
    docs = []
    for i in range(120):
        lang = "en" if i % 6 else "de"
        docs.append((i, " ".join(["the"] * 3 + [f"{lang}rare{i * 7 % 20}{c}" for c in "abcdef"]), lang, "s", 0))
    table, train = spark.createDataFrame(docs, SCHEMA), ~lattice.held_out(F.col("doc_id"))
    few, all_ = ({r["doc_id"]: r["score"] for r in lattice.score(table, train, lattice.read_pieces(), rounds=1, frequent=n).collect()} for n in (1, 1000))
    assert all(math.isclose(few[i], all_[i], rel_tol=1e-9) for i in all_)


def test_lattice_equals_all_segmentations():
    import numpy as np

    names = ["", "▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab"]
    pieces = lattice.pieces_of([*names, *[""] * 256], list(range(len(names), len(names) + 256)))
    rng = np.random.default_rng(3)
    scores, stop = lattice.normalised(rng.random((1, pieces.size)), np.array([5.0]), pieces, 0.01)

    def by_hand(text):
        if not text:
            return 1.0
        found = sum(math.exp(scores[0, i]) * by_hand(text[len(n):]) for i, n in enumerate(names) if n and text.startswith(n))
        if text[0] not in names:
            found += math.exp(sum(scores[0, len(names) + x] for x in text[0].encode())) * by_hand(text[1:])
        return found

    for word in ("a", "ab", "abab", "babba", "aéb", "ééb", ""):
        got = lattice.lattice_scores([word], scores, stop, pieces)[0, 0]
        assert math.isclose(got, math.log(by_hand("▁" + word)) + stop[0], rel_tol=1e-9)
    counts = lattice.expected_counts(["abab", "b"], scores[0], pieces)
    assert math.isclose(counts[pieces.first].sum(), 2.0)


def test_scores_of_odd_rows(odd, none):
    got = lattice.score(odd, ~lattice.held_out(F.col("doc_id")), lattice.read_pieces()).collect()
    assert len(got) == len(ODD) - 1  # equal rows are one
    assert all(r["score"] < 0 and r["n_tokens"] >= 1 for r in got)
    untrained = lattice.score(odd, F.lit(False), lattice.read_pieces()).collect()
    assert all(r["n_known"] == 0 and r["score"] < 0 for r in untrained)
    assert lattice.score(none, F.lit(True), lattice.read_pieces()).count() == 0


# Pages

PAGE = """<!doctype html><html><head><title>T</title><script>if(a<b){"</p>"}</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/x>Home</a><li>More</ul></nav><div class="cookie-notice">We use cookies.</div>
<main><h1>Head&shy;line &amp; more</h1><p>First   paragraph, with <b>bold</b> and&nbsp;space.<p>Second one; it ends here.
<aside>Related</aside><ul><li>Point one.<li>Point two.</ul><form><input><label>Mail</label></form></main>
<div id="comments"><p>Nice, I like it, really.</p></div><div class="sidebar">Side</div><footer>&copy; me</footer></body></html>"""


def test_article_without_what_is_around_it():
    assert html_text.main_text(PAGE).split("\n") == [
        "Head\xadline & more", "First paragraph, with bold and space.", "Second one; it ends here.", "Point one.", "Point two.",
    ]
    soup = "<div><div class=menu><a>x</a></div><div><p>One long paragraph, with commas, and words.</p><p>Another one, as long, with words.</p><p>Yes.</p></div><div>Login</div></div>"
    assert html_text.main_text(soup).split("\n")[:3] == ["One long paragraph, with commas, and words.", "Another one, as long, with words.", "Yes."]


SENTENCES = ["A long first sentence, with commas, and more of it.", "The second one, as long, has words; it ends here.", "A third, which is no shorter, closes the text."]
PROSE = "".join(f"<p>{x}</p>" for x in SENTENCES)


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><body><div>{PROSE}</div></body></html>",
    f"<html><head><title>T</title><meta charset=utf-8><div>{PROSE}</div></html>",
    f"<body><div class='content no-sidebar'>{PROSE}</div></body>",
    f"<body><div class='has-menu'>{PROSE}</div></body>",
    f"<body><div id='social'>{PROSE}</div></body>",
    f"<body><main><article>{PROSE[:PROSE.index('</p>') + 4]}</article><article>{PROSE[PROSE.index('</p>') + 4:]}</article></main></body>",
])
def test_pages_keep_their_whole_content(page):
    assert html_text.main_text(page).split("\n") == SENTENCES


COMMENT = "A reader says, at length, that this is so, and that it is not; and more, and more, to no end. " * 5


@pytest.mark.parametrize("body", [
    "<article>{0}</article><section id='comments'>{1}</section>",
    "<article>{0}<section class='comments'>{1}</section></article>",
    "<div class='story'>{0}</div><div class='comment-list comments'>{1}</div>",
    "<main>{0}</main><div class='comments'><article>{1}</article></div>",
])
def test_comments_longer_than_the_article_go(body):
    page = body.format("".join(f"<p>{x}</p>" for x in SENTENCES), "".join(f"<p>{COMMENT}</p>" for _ in range(8)))
    assert html_text.main_text(f"<html><body>{page}</body></html>").split("\n") == SENTENCES


def test_sums_over_near_paths_agree():
    import numpy as np

    draw = np.random.default_rng(3)
    parent = np.array([-1] + [int(draw.integers(max(0, i - 6), i)) for i in range(1, 140)])
    ratios = draw.random((140, 3))
    assert np.allclose(html_text.near_sums(parent, ratios), html_text.near_sums_of_few(parent, ratios), rtol=1e-6)


def test_unnamed_header_and_footer_go():
    page = f"<body><div><a>Home</a></div><div>{''.join(f'<p>{x * 3}</p>' for x in SENTENCES)}</div><div><span>2020 Us</span></div></body>"
    assert html_text.main_text(page).split("\n") == [x * 3 for x in SENTENCES]


@pytest.mark.parametrize("tag", ["<div>x", "<p><center>x", "<ul><li>x", "<b class=x>x", "<table><tr><td>x", "<x-y>x"])
def test_deep_nesting_takes_seconds(tag):
    import time

    start = time.monotonic()
    assert html_text.main_text(tag * 20000).count("x") > 0
    assert time.monotonic() - start < 20


def test_names_of_headings_and_text_before_a_body():
    page = f"<body><article>{PROSE}<h2 id='related-work'>Related work</h2>{PROSE}<div class='share'><a>Share</a></div></article></body>"
    assert html_text.main_text(page).split("\n") == [*SENTENCES, "Related work", *SENTENCES]
    assert html_text.main_text("<html><head><title>T</title>Some words, no tags.") == "Some words, no tags."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<p>", "text only", "<script>x", "<!-- open", "&amp", "<a href='x>y</a>", "</p></div>", "<p>" * 2000])
def test_broken_pages(page):
    got = html_text.main_text(page)
    assert got == {"text only": "text only", "&amp": "&"}.get(page, got) and "<script" not in got


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 1)], "page_id long, url string, html string, text long")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 3
    assert got.where("n_chars != length(text)").count() == 0
    assert html_text.extract(pages.limit(0)).count() == 0


# Secrets

def test_findings_on_held_out_rows(spark):
    docs = []
    for i in range(400):
        secret = hashlib.sha1(str(i).encode()).hexdigest()
        kinds = [f'token = "{secret}" ok', f"password={secret[:18]} next", f"mail someone{i}@mail.example.com now", f"card {4000000000000000 + i * 7919} paid",
                 "AKIA" + secret[:16].upper() + " used", "nothing to see"]
        docs.append((i, f"some words here {kinds[i % 6]} and after", "en", "s", 0))
    table = spark.createDataFrame(docs, SCHEMA)
    got = secrets.scan(table, train=~toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == sum(i % 6 != 5 for i in range(400))
    assert all(r["secret"] == (r["doc_id"] % 6 in (0, 1, 4)) for r in got)


def test_secrets_of_odd_rows(spark, odd, none, clashing):
    assert secrets.scan(clashing).count() == secrets.scan(odd).count()
    assert secrets.scan(none).count() == 0
    one = spark.createDataFrame([(1, "the key abcdef0123456789zz here")], "doc_id long, text string")
    assert [(r["value"], r["probability"]) for r in secrets.scan(one).collect()] == [("abcdef0123456789zz", 0.5)]


def test_entries_of_unshared_tokens_go_however_small_the_bitmaps(spark, monkeypatch):
    """Bitmaps in which most places have several tokens: entries are those of shared tokens, the links all links."""
    monkeypatch.setattr(ngram_join, "BITS", 12)
    steps = counted_steps(monkeypatch, ngram_join)
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "s", 0) for i in range(400)]
    docs += [(1000 + i, docs[i][1] + " end", "en", "s", 0) for i in range(3)] + [(2000, docs[5][1], "en", "s", 0), (2001, docs[5][1], "en", "s", 0)]
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    got = rows(ngram_join.join(spark.createDataFrame(docs, SCHEMA)), "doc_id", "n_shingles", "component_id")
    assert got == by_hand_join(docs)
    assert sum(steps["join-entries"]) <= 3 * 2 * 8  # eight tokens at most of two documents
    left = set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before
    assert not [x for x in left if x.startswith(("join-summaries", "join-entries", "join-index", "join-sets", "join-counts"))]


# Pipeline

def test_near_copies_of_four_fifths_of_five_word_shingles_are_one(spark, tmp_path):
    words = prose(0, 104).split()
    edited = [w if i not in (30, 70) else f"new{i}" for i, w in enumerate(words)]  # 90 of 110 shingles, 96 of 108 of three words
    far = [w if i not in (10, 30, 50, 70) else f"far{i}" for i, w in enumerate(prose(3000, 104).split())]
    docs = [(1, " ".join(words)), (2, " ".join(edited)), (3, prose(3000, 104)), (4, " ".join(far))]
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard"]
    assert rows(stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path)), "doc_id") == [(1,), (3,), (4,)]


def test_pipeline_stages_on_odd_rows(spark, clashing, labels, items, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = clashing.drop("copies")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == clashing.drop("copies").columns, name
    assert "copies" in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns
    empty = clashing.drop("copies").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_stored_steps_may_ask_for_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([len(batch)], pa.int64())], names=["n"])

    before = spark.conf.get(common.ARROW_ROWS)
    rows = spark.range(0, 100, 1, 2).mapInArrow(sizes, "n long")
    got = [r["n"] for r in common.stored(rows, "small", 7).collect()]
    assert sum(got) == 100 and max(got) == 7 and spark.conf.get(common.ARROW_ROWS) == before
    assert sorted(r["n"] for r in common.stored(rows, "large").collect()) == [50, 50]


def test_words_are_counted_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(lattice, "TEXT_BYTES", 40)
    monkeypatch.setattr(lattice, "COUNTS_AT_ONCE", 6)
    rows = [(f"a B{i % 5} a\tc{i % 3} {'x' * 50}", i % 2 if i % 7 else None) for i in range(60)] + [(None, 0), ("", 1)]
    want = {}
    for text, kind in rows:
        for word in (text or "").lower().split():
            counts = want.setdefault(word, [0, 0, 0])
            counts[2] += 1
            if kind is not None:
                counts[kind] += 1
    got = lattice.count_words(spark.createDataFrame(rows, "text string, class int").coalesce(1), 2).collect()
    assert {r["word"]: [*r["counts"], r["uses"]] for r in got} == want


def test_texts_are_hashed_half_a_megabyte_at_a_time():
    batch = pa.record_batch([pa.array(["x" * 300_000] * 4 + ["y"] * 3)], names=["text"])
    assert [len(part) for part in hashing.parts(iter([batch]), 0)] == [1, 1, 1, 4]

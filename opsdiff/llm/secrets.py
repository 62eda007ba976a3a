"""Secret scans: candidates by form, false positives out by a random forest.

A candidate is a word with a digit that is long enough, or the value that a word such as
password or token assigns.  The forest sees the value's length, its shares of digits and of
capitals, how many characters differ, how often its characters change from one kind to
another, how much of it the corpus's common words cover, what the document's path says, and
the words around it.  It learns from labelled findings; where there is no such table,
`format_labels` labels the candidates whose form leaves no doubt.

Everything is DataFrame functions and Spark's own random forest.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdiff.llm.common import stored

TRAINING_ROWS = 20_000      # labelled findings, chosen by a hash of their place
DICTIONARY_WORDS = 5_000
TREES, DEPTH = 20, 6
THRESHOLD = 0.5
# Names that assign a secret, words that make light of one, published key formats.
ASSIGNED = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|auth(?:orization)?|credentials?|private_?key|bearer)"
UNREAL = r"(?i)(?:example|sample|dummy|placeholder|changeme|your|fake|test|xxx+)"
UNREAL_PATH = r"(?i)(?:test|example|sample|fixture|mock|doc)"
OTHER_THINGS = r"(?i)(?:uuid|sha\d*|md5|hash|commit|checksum|digest|phone|tel|card|iban|order|invoice|isbn|mail|version)"
KEY_FORMATS = (
    r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[0-9A-Za-z_-]{35}$|"
    r"^sk_(?:live|test)_[0-9A-Za-z]{16,}$|^eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*$"
)
_CHANGES = ("a0", "0a", "A0", "0A", "aA", "Aa")


def _word(words: Column, place: Column) -> Column:
    """The word at a place, or '' outside the text."""
    return F.coalesce(F.try_element_at(words, F.when(place >= 0, place + 1).otherwise(F.size(words) + 1)), F.lit(""))


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, path, place (of the word in the text), value, name, before, after of documents(doc_id, text[, source]).

    Null and empty texts have none.  name is the word that assigns the value, or ''.  Repeated
    rows give repeated candidates.
    """
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in documents.columns else F.lit("")
    rows = documents.where(F.col("text").rlike(r"[0-9]|" + ASSIGNED + r"[\"']?\s*[=:]")).select("doc_id", path.alias("path"), F.split("text", r"\s+").alias("words"))
    likely = F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("word")))
    long_with_digit = lambda w: (F.length(w) >= 12) & w.rlike(r"[0-9]")
    assigns = lambda w: w.rlike(r"^[^A-Za-z0-9]*" + ASSIGNED + r"[A-Za-z0-9_]{0,16}[\"']?[=:]+[\"']?\S{6,}")
    after_name = lambda x: (
        (F.length(x["word"]) >= 8)
        & (_word(F.col("words"), x["place"] - 1).rlike(r"^[=:]+$") & _word(F.col("words"), x["place"] - 2).rlike(ASSIGNED)
           | _word(F.col("words"), x["place"] - 1).rlike(ASSIGNED + r"[\"']?[=:]+$"))
    )
    found = F.filter(likely, lambda x: long_with_digit(x["word"]) | assigns(x["word"]) | after_name(x))
    one = rows.select("doc_id", "path", "words", F.explode(found).alias("x"))
    bare = F.regexp_replace(F.col("x.word"), r"^[^A-Za-z0-9]+|[^A-Za-z0-9+/=]+$", "")
    named = r"^([A-Za-z_][A-Za-z0-9_.-]{0,40}?)[\"']?[=:]+[\"']?(.+)$"
    place = F.col("x.place")
    before, before2 = _word(F.col("words"), place - 1), _word(F.col("words"), place - 2)
    split_name = F.regexp_extract(bare, named, 1)
    name = F.when(split_name != "", split_name).when(before.rlike(r"^[=:]+$"), before2).when(before.rlike(r"[=:]$"), before).otherwise("")
    value = F.when(split_name != "", F.regexp_extract(bare, named, 2)).otherwise(bare)
    return one.select(
        "doc_id", "path", place.alias("place"), value.alias("value"), name.alias("name"),
        F.concat_ws(" ", before2, before).alias("before"), _word(F.col("words"), place + 1).alias("after"),
    ).where("value != ''")


def dictionary_triples(documents: DataFrame, words: int = DICTIONARY_WORDS) -> DataFrame:
    """(triple): all runs of three letters of the corpus's most frequent words, 26**3 at most."""
    letters = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")
    counts = documents.select(F.explode(F.filter(letters, lambda w: F.length(w) >= 4)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    often = counts.orderBy(F.desc("n"), "word").limit(words)
    return often.select(F.explode(F.regexp_extract_all("word", F.lit("(?=([a-z]{3}))"), F.lit(1))).alias("triple")).distinct()


def with_features(found: DataFrame, triples: DataFrame) -> tuple[DataFrame, list[str]]:
    """The candidates with numbers for the forest, and the names of these."""
    value = F.col("value")
    length = F.length(value)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    around = F.concat_ws(" ", "name", "before")
    numbers = {
        "f_length": length,
        "f_digits": F.regexp_count(value, F.lit("[0-9]")) / length,
        "f_capitals": F.regexp_count(value, F.lit("[A-Z]")) / length,
        "f_signs": F.regexp_count(value, F.lit("[^A-Za-z0-9]")) / length,
        "f_distinct": F.size(F.array_distinct(F.split(value, ""))) / length,
        "f_hex": value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "f_at": F.contains(value, F.lit("@")),
        "f_dots": F.regexp_count(value, F.lit(r"\.")),
        "f_path": F.col("path").rlike(UNREAL_PATH),
        "f_named": F.col("name").rlike(ASSIGNED),
        "f_around": around.rlike(ASSIGNED),
        "f_unreal": F.concat_ws(" ", around, "value", "after").rlike(UNREAL),
        "f_other": F.concat_ws(" ", around, "after").rlike(OTHER_THINGS),
        "f_neighbours": (F.length("before") + F.length("after")) / F.lit(3.0),
    }
    for i, (one, next_) in enumerate(_CHANGES):
        numbers[f"f_change{i}"] = F.regexp_count("kinds", F.lit(f"{one}(?={next_})")) / length
    rows = found.withColumn("finding", F.xxhash64("doc_id", "place", "value", "name", "before", "after")).withColumn("kinds", kinds)
    rows = rows.withColumns({k: v.cast("double") for k, v in numbers.items()})
    # Dictionary coverage: of the runs of three letters, those of common words.
    threes = found.select(F.lower("value").alias("low")).distinct().select(
        "low", F.explode(F.regexp_extract_all("low", F.lit("(?=([a-z]{3}))"), F.lit(1))).alias("triple")
    )
    covered = threes.join(F.broadcast(triples.withColumn("known", F.lit(1.0))), "triple", "left").groupBy("low").agg(
        F.avg(F.coalesce("known", F.lit(0.0))).alias("f_covered")
    )
    rows = rows.withColumn("low", F.lower("value")).join(covered, "low", "left").fillna(0.0, ["f_covered"]).drop("low", "kinds")
    return rows, [*numbers, "f_covered"]


def format_labels(found: DataFrame) -> Column:
    """1 for a published key format or a random value with a secret's name, 0 for addresses,
    numbers and what says that it isn't real, null for all in between."""
    value = F.col("value")
    random = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & value.rlike(r"^[A-Za-z0-9+/=_-]{16,}$")
    return (
        F.when(F.concat_ws(" ", "value", "before").rlike(UNREAL), 0)
        .when(value.rlike(KEY_FORMATS) | (random & F.col("name").rlike(ASSIGNED)), 1)
        .when(value.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]+$|^[0-9+() ./:-]+$|^(?:https?|ftp)://|^www\.|^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"), 0)
    )


def scan(documents: DataFrame, labelled=format_labels, train: Column | None = None, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, place, value, name, label, probability, secret (0 or 1) for every candidate.

    labelled gives the label column (1, 0, null) of the candidates, from a table of findings or
    from their form; train says which candidates may be learned from.  Training takes a bounded
    number of labelled candidates, by a hash; counts for the dictionary cover every text.  With
    labels of one kind alone that kind is everybody's; without any the probability is 1/2.
    """
    found = candidates(documents)
    triples = stored(dictionary_triples(documents), "secret-triples")
    featured, names = with_features(stored(found, "secret-candidates"), triples)
    featured = stored(featured.withColumn("label", labelled(featured).cast("double")), "secret-features")
    usable = featured.where(F.col("label").isNotNull() if train is None else F.col("label").isNotNull() & train)
    sample = stored(usable.orderBy(F.xxhash64("finding"), "finding").limit(rows), "secret-sample")
    kinds = sample.agg(F.count_distinct("label").alias("kinds"), F.max("label").alias("one")).first()
    result = ["doc_id", "place", "value", "name", F.col("label").cast("int").alias("label")]
    if kinds["kinds"] < 2:
        certain = F.lit(0.5 if kinds["one"] is None else float(kinds["one"]))
        return featured.select(*result, certain.alias("probability"), (certain >= THRESHOLD).cast("int").alias("secret"))
    assembler = VectorAssembler(inputCols=names, outputCol="vector")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=17, probabilityCol="chances")
    model = forest.fit(assembler.transform(sample).select("vector", "label"))
    scored = model.transform(assembler.transform(featured)).withColumn("probability", vector_to_array("chances")[1])
    return scored.select(*result, "probability", (F.col("probability") >= THRESHOLD).cast("int").alias("secret"))

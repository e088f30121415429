"""Question sets from knowledge tables, their grading, graded edits, and entity documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from .facts import fact_id


def family(df: DataFrame, capability: str, subject: Column, question: str, answer: Column) -> DataFrame:
    """Questions of one capability: question_id (by content), capability, subject, question, answer; {} in the text is the subject."""
    rows = df.select(F.lit(capability).alias("capability"), subject.cast("string").alias("subject"), answer.cast("string").alias("answer")).where("answer is not null").distinct()
    before, _, after = question.partition("{}")
    rows = rows.withColumn("question", F.concat(F.lit(before), "subject", F.lit(after)))
    return rows.select(fact_id("capability", "subject", "question").alias("question_id"), "capability", "subject", "question", "answer")


def question_set(families: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The public questions (without answers) and the key (question_id, capability, answer)."""
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f)
    return out.select("question_id", "capability", "subject", "question"), out.select("question_id", "capability", "answer")


def leaks(texts: DataFrame, id_column: str, text: str, markers: DataFrame, least: int = 4) -> DataFrame:
    """id, n: how many of the markers (marker) a text holds as whole words, any blanks between words being one.

    Markers are found by their first `least` words: texts are cut into runs of so many words, joined on them, and hits checked
    on the text itself. A marker of fewer words is found by all of its words.
    """
    blank = r"[ \t\n\r\f]+"
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), blank, " "))
    m = markers.select(flat(F.col("marker")).alias("marker")).where("marker <> ''").distinct().withColumn("_w", F.split("marker", " "))
    m = m.withColumn("_k", F.least(F.size("_w"), F.lit(least))).select("marker", "_k", F.array_join(F.slice("_w", 1, F.col("_k")), " ").alias("_head"))
    words = texts.select(F.col(id_column).alias("id"), flat(F.col(text)).alias("_t")).withColumn("_w", F.split("_t", " "))
    # for each length that a head may have, every run of so many words
    runs = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - k + 1, F.lit(1))), _run(k)) for k in range(1, least + 1)]))
    heads = words.select("id", F.explode(F.array_distinct(runs)).alias("_head")).join(m, "_head").select("id", "marker").distinct()
    hit = F.contains(F.concat(F.lit(" "), "_t", F.lit(" ")), F.concat(F.lit(" "), "marker", F.lit(" ")))
    return heads.join(words.select("id", "_t"), "id").where(hit).groupBy("id").agg(F.count("*").alias("n"))


def _run(k: int):
    return lambda i: F.array_join(F.slice("_w", i, k), " ")


def grade(results: DataFrame, thresholds: DataFrame) -> DataFrame:
    """results (capability, result) against thresholds (capability, least): n, n_correct, accuracy, passed; a capability without results fails."""
    s = results.groupBy("capability").agg(F.count("*").alias("n"), F.count_if(F.col("result") == "correct").alias("n_correct"))
    j = thresholds.join(s, "capability", "left").fillna(0, ["n", "n_correct"])
    accuracy = ratio(F.col("n_correct"), F.col("n"))
    return j.select("capability", "n", "n_correct", accuracy.alias("accuracy"), F.coalesce(accuracy >= F.col("least"), F.lit(False)).alias("passed"))


def grade_edits(before: DataFrame, after: DataFrame, expected: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, outcome of every row that changed or should have: done, missing, wrong_value, unexpected, not_allowed.

    expected: keys, column, value (as text; null where any value will do), required. A change of a column that is not listed is
    not_allowed; of a row that is not listed at all, unexpected.
    """
    text = lambda df, name: df.select(*keys, F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("column", name))
    cells = text(before, "_old").join(text(after, "_new"), [*keys, "column"], "full")
    changed = cells.where(~F.col("_old").eqNullSafe(F.col("_new"))).withColumn("_changed", F.lit(True))
    listed = expected.select(*keys).distinct().withColumn("_listed", F.lit(True))
    j = changed.join(expected.withColumn("_expected", F.lit(True)), [*keys, "column"], "full").join(listed, list(keys), "left")
    outcome = (
        F.when(F.col("_expected").isNull() & F.col("_listed").isNull(), "unexpected").when(F.col("_expected").isNull(), "not_allowed")
        .when(F.col("_changed").isNull(), F.when(F.col("required"), "missing")).when(F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("_new")), "wrong_value").otherwise("done")
    )
    return j.select(*keys, "column", outcome.alias("outcome")).where("outcome is not null")


def cards(entities: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """key, card: each entity as one JSON document: its columns, and under each name the sorted rows of a table of its own."""
    out = entities
    for name, df in parts.items():
        inner = [c for c in df.columns if c != key]
        out = out.join(df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*inner))).alias(name)), key, "left")
    names = list(parts)
    own = [c for c in entities.columns]
    body = F.struct(*own, *[F.coalesce(F.col(n), F.array().cast(out.schema[n].dataType)).alias(n) for n in names])
    return out.select(key, F.to_json(body).alias("card"))

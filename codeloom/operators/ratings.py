"""Best and worst of rated responses, inside each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import unused
from codeloom.functions.texts import rating


def with_pair(df: DataFrame, name: str = "pair", *, responses: str = "responses", annotations: str = "annotations") -> DataFrame:
    """The rows with a struct of chosen, rejected, hi, lo; null without two usable ratings that differ.

    Of repeated models the last response counts; ratings of unknown models and those that are no number do not; among
    equals the model first by name is taken, at both ends.  What several steps need is a column, so it is computed once.
    """
    last, models, rated, ends = unused(df.columns, "_last", "_models", "_rated", "_ends")
    # from the last to the first, so that the first entry of a model is the one that counts
    usable = F.filter(F.coalesce(F.col(responses), F.array()), lambda x: (x["model"] != "") & x["response"].isNotNull())
    rows = df.withColumn(last, F.reverse(usable)).withColumn(models, F.transform(last, lambda x: x["model"]))
    numbers = F.transform(F.coalesce(F.col(annotations), F.array()), lambda x: F.struct(rating(x["rating"]).alias("rating"), x["model"].alias("model")))
    known = F.filter(numbers, lambda x: x["rating"].isNotNull() & F.coalesce(F.array_contains(models, x["model"]), F.lit(False)))
    rows = rows.withColumn(rated, known)
    # the least struct has the lowest rating and its first model; for the highest, the rating is turned round
    rows = rows.withColumn(ends, F.struct(F.array_min(rated).alias("lo"), F.array_min(F.transform(rated, lambda x: F.struct((-x["rating"]).alias("minus"), x["model"].alias("model"), x["rating"].alias("rating")))).alias("hi")))
    answer = lambda end: F.try_element_at(last, F.array_position(models, F.col(f"{ends}.{end}.model")).cast("int"))["response"]
    hi, lo = F.col(f"{ends}.hi.rating"), F.col(f"{ends}.lo.rating")
    pair = F.when((F.size(rated) >= 2) & (hi > lo), F.struct(answer("hi").alias("chosen"), answer("lo").alias("rejected"), hi.alias("hi"), lo.alias("lo")))
    return rows.withColumn(name, pair).drop(last, models, rated, ends)

"""Claims as assertions of an ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import digest

_PAYLOAD = "struct<`$ontology`: struct<subject: struct<id: string, class: string, label: string>, predicate: string, object: struct<id: string, class: string, label: string, literal: string>>>"


def projected(claims: DataFrame, properties: DataFrame, is_a: DataFrame) -> DataFrame:
    """What the claims that carry an ontology payload assert, or what is wrong with it: id, assertion_id, subject, predicate, object, literal, problem.

    claims: id, partition_key, status, value_json, from_us; those that are not active or have no ``$ontology`` object give no row. properties:
    predicate, domain_class, range_class (null: the object is a literal); is_a: child, parent, reflexive and closed. The
    class of the subject must be the domain or below it, that of an entity object the range or below it.
    """
    rows = claims.filter(F.lower(F.trim("status")) == "active").select("id", "partition_key", "from_us", F.from_json("value_json", _PAYLOAD).getField("$ontology").alias("o")).filter("o IS NOT NULL")
    rows = rows.select("id", "partition_key", "from_us", F.col("o.subject.id").alias("subject"), F.col("o.subject.class").alias("subject_class"), F.col("o.predicate").alias("predicate"), F.col("o.object.id").alias("object"), F.col("o.object.class").alias("object_class"), F.col("o.object.literal").alias("literal"))
    props = properties.select("predicate", "domain_class", "range_class", F.lit(True).alias("_known"))
    below = lambda name: is_a.select(F.col("child").alias(f"_{name}c"), F.col("parent").alias(f"_{name}p"), F.lit(True).alias(f"_{name}")).distinct()
    both = rows.join(props, "predicate", "left")
    both = both.join(below("d"), (F.col("subject_class") == F.col("_dc")) & (F.col("domain_class") == F.col("_dp")), "left")
    both = both.join(below("r"), (F.col("object_class") == F.col("_rc")) & (F.col("range_class") == F.col("_rp")), "left")
    problem = (
        F.when(F.col("subject").isNull() | F.col("predicate").isNull(), "incomplete").when(F.col("_known").isNull(), "unknown_property").when(F.col("_d").isNull(), "outside_domain")
        .when(F.col("literal").isNotNull() & F.col("range_class").isNotNull(), "needs_entity").when(F.col("literal").isNull() & F.col("object").isNull(), "incomplete")
        .when(F.col("literal").isNull() & F.col("range_class").isNull(), "needs_literal").when(F.col("literal").isNull() & F.col("_r").isNull(), "outside_range")
    )
    name = digest("partition_key", "subject", "predicate", F.coalesce("object", "literal"), F.col("from_us"))
    return both.select("id", F.when(problem.isNull(), name).alias("assertion_id"), "subject", "predicate", "object", "literal", problem.alias("problem"))

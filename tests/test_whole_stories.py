"""Names of stories are those of whole texts."""

from pyspark.sql import functions as F

from storyline.functions import fingerprints as fp
from storyline.plans import events_plan as ep

LONG = "It was quiet and nothing else was said. " * 60


def test_names_after_the_beginning(spark, tmp_path):
    rows = [(k, f"Day {k}\n{LONG}Then the mayor of Lisbon met people from Northwind.") for k in (1, 2, 33)] + [(4, f"Day 4\n{LONG}")]
    spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = ep.story_chains(spark, str(tmp_path)).collect()
    assert [(r.chain, r.n_days, r.n_nodes, r.title) for r in got] == [(1, 3, 3, "Day 1")]
    named = spark.createDataFrame([(t,) for _, t in rows], "t string").select(*[fp.story_entities(F.lit(""), F.col("t"), chars=c) for c in (None, 1500)]).first()
    assert {"lisbon", "northwin"} <= set(named[0]) and not {"lisbon", "northwin"} & set(named[1])

"""Operators that SQL can express, and the pipeline's stages on whole small tables."""

import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    found, expected = Q.QUERIES[name](spark, SF), db.sql(Q.ORACLE_SQL[name])
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    rows = sorted(map(tuple, found.select(*names).collect()))
    assert rows == sorted(map(tuple, expected.select(*names).fetchall()))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, made[-1], SF)
        out.write.parquet(str(tmp_path / name))
        made.append(spark.read.parquet(str(tmp_path / name)))
    start, quality, lines, single, mixed, packed = (df.toPandas() for df in made)
    assert all(list(x.columns) == list(start.columns) for x in (quality, lines, single, mixed))
    verdicts = Q.op8_quality_rules(spark, SF).where("kept").toPandas()
    assert sorted(quality.doc_id) == sorted(verdicts.doc_id)
    assert set(lines.doc_id) <= set(quality.doc_id) and (lines.n_chars == lines.text.str.len()).all()
    long = Counter(x for t in lines.text for x in t.split("\n") if len(re.split(r"\s+", x.strip())) >= 5)
    assert max(long.values()) == 1
    groups = Q.simhash_groups(made[2]).toPandas()
    assert sorted(single.doc_id) == sorted(groups.component_id.unique())
    times = mixed.doc_id.value_counts()
    assert set(mixed.doc_id) <= set(single.doc_id) and times.max() <= 3
    assert packed.length.sum() == packed.ids.str.len().sum() and set(packed.doc_id) == set(mixed.doc_id)
    assert corpus_pipeline.run(spark, SF).count() == len(packed)

"""The FASTA data source at every split, its commit and abort, and the functions of Spark SQL."""

import io
import random

import pytest
from pyspark.sql import functions as F

from proteinscan.functions import alignment
from proteinscan.functions import sql as sql_functions
from proteinscan.operators import search
from proteinscan.sources import database, datasource
from proteinscan.sources.fasta import read_fasta

FASTA = b"\n>one > kept\r\nMKV\r\n\r\nLAA\r\n>empty\n>two\n" + b"ACD\n" * 40 + b">>x\nm>k\n>last\nWW"


def test_every_range_of_a_file():
    """Wherever a file is cut, each record is read once, by the range that holds its marker."""
    def all_of(cuts):
        return [x for a, b in zip(cuts, cuts[1:]) for x in datasource.records(io.BytesIO(FASTA), a, b)]

    whole = all_of([0, len(FASTA)])
    assert [h for _, h, _ in whole] == [b"one > kept", b"empty", b"two", b">x", b"last"] and all(FASTA[a : a + 1] == b">" for a, _, _ in whole)
    for size in (1, 2, 3, 7, 50):
        assert all_of([*range(0, len(FASTA), size), len(FASTA)]) == whole
    assert all_of([0, 1, len(FASTA)]) == whole and list(datasource.records(io.BytesIO(b""), 0, 9)) == []


def test_small_reads_cut_lines(monkeypatch):
    whole = list(datasource.records(io.BytesIO(FASTA), 0, len(FASTA)))
    for size in (1, 2, 5):
        monkeypatch.setattr(datasource, "READ_BYTES", size)
        assert list(datasource.records(io.BytesIO(FASTA), 0, len(FASTA))) == whole


def test_source_equals_reader(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_bytes(FASTA)
    (tmp_path / "in" / "b.fa").write_bytes(b">b\nMK\n")
    (tmp_path / "in" / "_hidden").write_bytes(b">no\nMK\n")
    rows = spark.read.format("fasta").option("splitBytes", 11).load(str(tmp_path / "in")).orderBy("file", "start").collect()
    (tmp_path / "in" / "_hidden").unlink()
    expected = [(r["header"], r["seq"], r["length"]) for r in read_fasta(spark, str(tmp_path / "in")).coalesce(1).orderBy("input_pos").collect()]
    assert [(r["header"], r["seq"], r["length"]) for r in rows] == expected and len(rows) == 6


def test_writer_commits_whole_jobs(spark, tmp_path):
    datasource.register(spark)
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", "MKV", 1), (None, "WWW", 2), ("c", None, 3), ("two\nlines", "A" * 61, 4)], "header string, seq string, extra int").repartition(3)
    rows.write.format("fasta").mode("append").save(out)

    def read():
        return sorted((r["header"], r["seq"]) for r in spark.read.format("fasta").load(out).collect())

    assert read() == sorted([("a", "MKV"), ("", "WWW"), ("c", ""), ("two lines", "A" * 61)])
    broken = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("header"), F.when(F.col("id") == 33, F.raise_error(F.lit("stop"))).otherwise(F.lit("MK")).alias("seq"))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("fasta").mode("append").save(out)
    assert len(read()) == 4 and not [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    rows.limit(1).write.format("fasta").mode("overwrite").save(out)
    assert len(read()) == 1
    with pytest.raises(Exception, match="no column"):
        spark.range(3).write.format("fasta").mode("append").save(out)


def test_functions_of_sql(spark, monkeypatch):
    sql_functions.register(spark)
    sql_functions.register(spark, "sw_steep", "pam30", 0, 0)
    rng = random.Random(3)
    pairs = [(rng.choice(["MKVLAA", "HEAGAWGHEE", ""]), "".join(rng.choices("ACDEFGHIKLMNPQRSTVWYJ", k=rng.randrange(0, 40)))) for _ in range(90)]
    rows = spark.createDataFrame([*pairs, (None, "A"), ("A", None), ("ACDEF", "ACDEF" * 10_000)], "q string, t string")
    found = spark.sql("SELECT q, t, sw_score(q, t) AS s, sw_steep(q, t) AS steep FROM {rows}", rows=rows).collect()
    assert len(found) == 93
    for r in found:
        if r["q"] is None or r["t"] is None:
            assert r["s"] is None
        elif len(r["t"]) < 100:
            assert (r["s"], r["steep"]) == (alignment.score_pair(r["q"], r["t"]), alignment.score_pair(r["q"], r["t"], "pam30", 0, 0))
        else:
            assert r["s"] == alignment.score_pair("ACDEF", "ACDEF")


def test_best_hits_as_a_table_function(spark):
    sql_functions.register(spark)
    rng = random.Random(4)
    rows = [(i, str(i), "".join(rng.choices("AW", k=rng.randrange(1, 6)))) for i in range(300)]
    db = database.with_residues(spark.createDataFrame(rows, "input_pos long, header string, seq string"))
    queries = database.numbered_queries(spark.createDataFrame([(1, "a", "AWA"), (2, "b", "WW")], "input_pos long, header string, seq string"))
    scored = search.scores(db, queries)
    for top in (0, 7, 1000):
        found = spark.sql(f"SELECT * FROM best_hits(TABLE({{scored}}) PARTITION BY query_no ORDER BY (score DESC, length DESC, input_pos DESC), {top})", scored=scored).collect()
        columns = ("query_no", "input_pos", "length", "score", "rank")
        assert sorted(tuple(r[c] for c in columns) for r in found) == sorted(tuple(r[c] for c in columns) for r in search.best(scored, top).collect())

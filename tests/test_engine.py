"""The search engine against worked cases, a scalar model, and its own SQL-free expression."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proteinscan import queries as queries_of_the_engine
from proteinscan.functions import alphabet, alignment, matrices
from proteinscan.operators import ranking, search
from proteinscan.plans import cli, report
from proteinscan.sources import database
from proteinscan.sources.fasta import read_fasta, write_fasta

STD = "ACDEFGHIKLMNPQRSTVWY"


def scalar(a, b, matrix="blosum62", gap_open=10, gap_extend=2):
    """The recurrence cell by cell."""
    s, x, y = matrices.load(matrix), alphabet.encode(a), alphabet.encode(b)
    h = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    f = [0] * (len(y) + 1)
    best = 0
    for i in range(1, len(x) + 1):
        e = 0
        for j in range(1, len(y) + 1):
            e = max(e - gap_extend, h[i][j - 1] - gap_open - gap_extend)
            f[j] = max(f[j] - gap_extend, h[i - 1][j] - gap_open - gap_extend)
            h[i][j] = max(0, h[i - 1][j - 1] + int(s[x[i - 1], y[j - 1]]), e, f[j])
            best = max(best, h[i][j])
    return best


@pytest.mark.parametrize(
    ("query", "target", "gaps", "score"),
    [
        ("HEAGAWGHEE", "PAWHEAE", (10, 2), 17), ("HEAGAWGHEE", "PAWHEAE", (3, 1), 25), ("HEAGAWGHEE", "PAWHEAE", (0, 0), 33), ("HEAGAWGHEE", "PAWHEAE", (127, 127), 17),
        (STD, STD, (10, 2), 116), (STD, "ACDEFWWGHIKLMNPQRSTVWY", (10, 2), 102), (STD, "ACDEFWWGHIKLMNPQRSTVWY", (5, 1), 109), ("ACDEFGHIKL", "ACDEFWWGHIKL", (10, 2), 43),
        ("MKVLAA", "MKVJLAA", (10, 2), 17), ("MKVLAA", "MKVJLAA", (3, 1), 22), ("MKVJLAA", "MKVULAA", (10, 2), 26), ("AAAA", "WWWW", (10, 2), 0), ("JOU", "JOU", (10, 2), 0),
        ("", "ACDEF", (10, 2), 0), ("W", "W", (10, 2), 11), ("X", "X", (10, 2), 0), ("BZX", "BZX", (10, 2), 8),
    ],
)
def test_worked_scores(query, target, gaps, score):
    assert alignment.score_pair(query, target, "blosum62", *gaps) == score


@pytest.mark.parametrize(("tail", "count", "score"), [("E", 11, 126), ("D", 11, 127), ("P", 11, 128), ("H", 2978, 32766), ("C", 2978, 32767), ("AD", 2978, 32768), ("W", 2978, 32769)])
def test_number_widths(tail, count, score):
    sequence = "W" * count + tail
    assert alignment.score_pair(sequence, sequence) == score


@pytest.mark.parametrize(
    ("name", "total", "least", "largest", "cases"),
    [
        ("blosum45", -460, -5, 15, (24, 34, 127)), ("blosum50", -585, -5, 15, (24, 34, 136)), ("blosum62", -543, -4, 11, (17, 25, 102)), ("blosum80", -1205, -8, 16, (31, 43, 173)),
        ("blosum90", -958, -6, 11, (19, 28, 120)), ("pam30", -2897, -17, 13, (24, 36, 150)), ("pam70", -1635, -11, 13, (20, 30, 130)), ("pam250", -565, -8, 17, (22, 25, 104)),
    ],
)
def test_matrices(name, total, least, largest, cases):
    core = matrices.load(name)[:23, :23]
    assert (core == core.T).all() and not matrices.load(name)[23:].any()
    assert (core.sum(), core.min(), core.max()) == (total, least, largest)
    pairs = (("HEAGAWGHEE", "PAWHEAE", 10, 2), ("HEAGAWGHEE", "PAWHEAE", 3, 1), (STD, "ACDEFWWGHIKLMNPQRSTVWY", 10, 2))
    assert tuple(alignment.score_pair(q, t, name, o, e) for q, t, o, e in pairs) == cases


residues = st.text(alphabet.LETTERS + "JOU", max_size=25)


@settings(max_examples=80, deadline=None)
@given(residues, residues, st.sampled_from(matrices.MATRICES), st.integers(0, 12), st.integers(0, 4))
def test_kernel_equals_recurrence(a, b, matrix, gap_open, gap_extend):
    score = alignment.score_pair(a, b, matrix, gap_open, gap_extend)
    assert score == scalar(a, b, matrix, gap_open, gap_extend) == alignment.score_pair(b, a, matrix, gap_open, gap_extend)
    assert alignment.score_pair(a + "JJ", b, matrix, gap_open, gap_extend) == score
    assert alignment.score_pair(a, b, matrix, gap_open + 1, gap_extend) <= score


def test_parameters():
    with pytest.raises(ValueError, match="unknown matrix"):
        matrices.load("blosum61")
    with pytest.raises(ValueError, match="gap_open"):
        alignment.score_pair("A", "A", gap_open=128)


def frame(spark, rows):
    return spark.createDataFrame([(i, f"t{i}", s) for i, s in enumerate(rows, 1)], "input_pos long, header string, seq string")


TARGETS = ["MKVLAA", "MKV", "AAAA", "MKVLAA", "WWWW", "MKVJLAA", "KVM"]


def test_ties_and_order(spark):
    db = database.with_residues(frame(spark, TARGETS))
    queries = database.numbered_queries(frame(spark, ["MKVLAA", "MKV"]))
    hits = search.search(db, queries, top=100).collect()
    listed = {no: [(r["target_header"], r["score"]) for r in hits if r["query_no"] == no] for no in (1, 2)}
    assert listed[1] == [("t6", 14), ("t4", 14), ("t1", 14), ("t2", 14), ("t7", 9), ("t5", 0), ("t3", 0)]
    assert listed[2] == [("t4", 26), ("t1", 26), ("t6", 17), ("t2", 14), ("t7", 11), ("t3", 8), ("t5", 0)]
    assert [r["target_header"] for r in search.search(db, queries, top=3).collect()] == ["t6", "t4", "t1", "t4", "t1", "t6"]
    assert search.search(db, queries, top=0).count() == 0
    assert [r["header"] for r in database.in_order(db).orderBy("position").collect()] == ["t2", "t7", "t3", "t5", "t1", "t4", "t6"]
    with pytest.raises(ValueError, match="top"):
        search.search(db, queries, top=-1)


def test_nulls_empty_tables_and_many_ties(spark):
    db = database.with_residues(frame(spark, ["MKV"] * 50 + ["", None, "mkv"]))
    queries = database.numbered_queries(frame(spark, ["MKV"]))
    assert [r["target_id"] for r in search.search(db, queries, top=4).collect()] == [53, 50, 49, 48]
    empty = database.with_residues(frame(spark, ["A"]).where("false"))
    assert search.search(empty, queries).count() == 0
    assert search.search(db, database.numbered_queries(frame(spark, ["A"]).where("false"))).count() == 0
    assert database.summary(empty).first().asDict() == {"sequences": 0, "residues": 0, "max_title_length": 0, "longest": 0}


def test_passes_do_not_change_scores(spark, monkeypatch):
    rng = random.Random(1)
    rows = ["".join(rng.choices(STD + "JX", k=rng.randrange(0, 60))) for _ in range(60)]
    db, queries = database.with_residues(frame(spark, rows)), database.numbered_queries(frame(spark, rows[:9]))
    one = {tuple(r) for r in search.scores(db, queries).collect()}
    monkeypatch.setattr(search, "PASS_RESIDUES", 50)
    assert {tuple(r) for r in search.scores(db.repartition(7), queries).collect()} == one and len(one) == 540
    monkeypatch.setattr(search, "PASS_QUERIES", 2)
    assert {tuple(r) for r in search.scores(db, queries).collect()} == one


def test_a_task_keeps_its_best_rows_only(spark, monkeypatch):
    """Over many slices, with ties; also where the input position is a struct."""
    rng = random.Random(2)
    rows = ["".join(rng.choices("AW", k=rng.randrange(1, 5))) for _ in range(900)]
    db, queries = database.with_residues(frame(spark, rows)).coalesce(1), database.numbered_queries(frame(spark, ["AWA", "WW"]))
    monkeypatch.setattr(search, "SLICE_ROWS", 50)
    monkeypatch.setattr(spark.sparkContext.__class__, "defaultParallelism", 0)
    everything = search.best(search.scores(db, queries), 7)
    kept = search.scores(db, queries, top=7)
    assert kept.count() == 14 and {tuple(r) for r in search.best(kept, 7).collect()} == {tuple(r) for r in everything.collect()}
    placed = db.withColumn("input_pos", F.struct(F.lit("f").alias("file"), (F.col("input_pos") % 5).alias("block"), F.col("input_pos").alias("row")))
    kept, everything = search.scores(placed, queries, top=7), search.best(search.scores(placed, queries), 7)
    assert kept.count() == 14 and {tuple(r) for r in search.best(kept, 7).collect()} == {tuple(r) for r in everything.collect()}


def test_search_documents_equals_brute_force(spark, tmp_path):
    """The flagship over small tables, every pair scored by itself."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"] and len(r["text"]) < 400][:12]
    parts = ["".join(c for c in t.upper() if "A" <= c <= "Z") for t in texts]
    passages = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()][:4]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = [(r["query_header"], r["rank"], r["score"], r["target_id"], r["target_length"]) for r in queries_of_the_engine.search_documents(spark, str(tmp_path)).collect()]
    expected = []
    for i in range(len(passages)):
        query = "".join(c for c in passages[i].upper() if "A" <= c <= "Z")
        hits = sorted(((alignment.score_pair(query, p), len(p), k) for k, p in enumerate(parts)), reverse=True)[:10]
        expected += [(str(i), rank, score, k, n) for rank, (score, n, k) in enumerate(hits, 1)]
    assert sorted(found) == sorted(expected)


def test_positions_and_prefix_sums(spark):
    rows = spark.range(500).selectExpr("id", "id * 7 % 13 AS length").repartition(6)
    out = ranking.with_prefix(rows, ["length", "id"], "length").orderBy("position").collect()
    expected, before = sorted((r["length"], r["id"]) for r in out), 0
    for position, (r, (length, key)) in enumerate(zip(out, expected, strict=True), 1):
        assert (r["position"], r["length"], r["id"], r["before"]) == (position, length, key, before)
        before += length
    assert ranking.with_prefix(rows.where("false"), ["length", "id"], "length").count() == 0


def test_wide_and_narrow_tiles_agree():
    rng = random.Random(3)
    query, table = alphabet.encode("".join(rng.choices(STD, k=40))), matrices.load("blosum62")
    for n in (1, 2, 9, 30, 300):
        codes = [alphabet.encode("".join(rng.choices(STD, k=rng.randrange(1, n + 1)))) for _ in range(60)]
        wide = alignment.score_lanes(query, alignment.lanes_of(codes), table, 3, 1)
        narrow = [int(alignment.score_lanes(query, alignment.lanes_of([c]), table, 3, 1)[0]) for c in codes]
        assert wide.tolist() == narrow
    # One tile, several queries and gap costs, in any order; gaps so long that they need all steps.
    parts = [alphabet.encode(x) for x in (STD * 3, STD + "G" * 70 + STD, "W" * 40)]
    tile = alignment.Tile(alignment.lanes_of(parts), table)
    for text, gap_open, gap_extend in ((STD * 2, 3, 1), (STD, 10, 2), (STD * 2, 0, 0), (STD * 2, 3, 1), ("W" * 9, 127, 127), (STD * 2, 1, 0)):
        found = alignment.score_tile(alphabet.encode(text), tile, gap_open, gap_extend).tolist()
        assert found == [scalar(text, x, "blosum62", gap_open, gap_extend) for x in (STD * 3, STD + "G" * 70 + STD, "W" * 40)]


def test_foreign_letters_are_no_residues(spark):
    rows = spark.createDataFrame([("MßK",), ("Mıﬁk",), ("m😀k\t",), ("ſK",), (None,)], "s string")
    out = rows.select(alphabet.clean(F.col("s")).alias("c"), F.length(alphabet.clean(F.col("s"))).alias("n"), alphabet.encoded(alphabet.clean(F.col("s"))).alias("r")).collect()
    assert [r["n"] for r in out] == [3, 4, 3, 2, None]
    for r in out:
        assert alphabet.decoded(bytes(r["r"])).tolist() == alphabet.encode(r["c"] or "").tolist()
    assert alphabet.decoded(bytes(out[1]["r"])).tolist()[1:3] == [alphabet.DUMMY] * 2


def test_a_database_is_dealt_by_residues(spark, tmp_path):
    rng = random.Random(4)
    rows = ["A" * rng.randrange(1, 200) for _ in range(400)]
    about = database.preprocess(frame(spark, rows), str(tmp_path / "db")).first()
    assert about["residues"] == sum(map(len, rows))
    db = database.load(spark, str(tmp_path / "db"))
    files = db.groupBy(F.input_file_name()).agg(F.max("length").alias("longest"), F.sum("length").alias("n")).collect()
    assert len(files) >= 3 and min(r["longest"] for r in files) > 100
    ordered = db.orderBy("position").collect()
    assert [r["position"] for r in ordered] == list(range(1, 401)) and [(r["length"], r["input_pos"]) for r in ordered] == sorted((len(x), i) for i, x in enumerate(rows, 1))


def test_expression_equals_kernel(spark):
    rows = [("MKVLAA", "MKVJLAA"), ("", "A"), ("HEAGAWGHEE", "PAWHEAE"), ("W", "WW")]
    out = spark.createDataFrame(rows, "q string, t string").select("q", "t", alignment.score_expr(F.col("q"), F.col("t")).alias("s")).collect()
    assert all(r["s"] == alignment.score_pair(r["q"], r["t"]) for r in out)


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_bytes(b">one > kept\r\nMKV\r\n\r\nLAA\r\n>empty\n>two\n" + b"A" * 2000 + b"\n>three\nac*d-1E")
    rows = read_fasta(spark, str(path)).orderBy("input_pos").collect()
    assert [(r["header"], r["length"]) for r in rows] == [("one > kept", 6), ("empty", 0), ("two", 2000), ("three", 7)]
    assert rows[0]["seq"] == "MKVLAA" and alphabet.encode(rows[3]["seq"]).tolist() == [0, 2, 23, 3, 23, 23, 4]
    with pytest.raises(Exception, match="not a residue sequence"):
        read_fasta(spark, str(path), strict=True).collect()
    about = database.preprocess(read_fasta(spark, str(path)), str(tmp_path / "db")).first()
    assert about.asDict() == {"sequences": 4, "residues": 2013, "max_title_length": 10, "longest": 2000}
    loaded = database.load(spark, str(tmp_path / "db"))
    queries = database.numbered_queries(read_fasta(spark, str(path)))
    assert search.search(loaded, queries, top=1).where("query_header = 'one > kept'").first()["target_header"] == "one > kept"
    write_fasta(read_fasta(spark, str(path)).where("header <> 'empty'"), str(tmp_path / "out"))
    assert read_fasta(spark, str(tmp_path / "out")).count() == 3


def test_markers_inside_headers_and_several_files(spark, tmp_path):
    """Only the marker that starts a record goes: the first of a file, whether or not it is the file's first character."""
    (tmp_path / "a.fa").write_text(">>x\nMK\n>>y\nV\n>z>\nA")
    (tmp_path / "b.fa").write_text("\n>u\nL\n>>v\nA\n")
    (tmp_path / "c.fa").write_text(">w\nK\n")
    rows = read_fasta(spark, str(tmp_path)).coalesce(1).orderBy("input_pos").collect()
    assert [(r["header"], r["seq"]) for r in rows] == [(">x", "MK"), (">y", "V"), ("z>", "A"), ("u", "L"), (">v", "A"), ("w", "K")]


def test_report_and_command_line(spark, tmp_path, capsys):
    fasta = tmp_path / "q.fa"
    fasta.write_text("".join(f">t{i}\n{s}\n" for i, s in enumerate(TARGETS, 1)))
    assert cli.main(["preprocess", "-i", str(fasta), "-o", str(tmp_path / "db")]) == 0
    assert cli.main(["search", "-q", str(fasta), "-d", str(tmp_path / "db"), "-r", "2"]) == 0
    said = capsys.readouterr().out
    assert "Query 1: t2 (3 residues)\nScore\tSequence\n14\tt6\n14\tt4" in said and f"Database: {tmp_path / 'db'}\n  7 sequences, " in said
    assert f"Queries: {fasta}" in said and "Search started 2" in said and " s\n" in said.split("longest 7, ")[1]
    assert cli.main(["search", "-q", str(fasta), "-d", str(tmp_path / "db"), "-r", "0"]) == 0
    assert "Query 7: t6 (7 residues)\nScore\tSequence\n\nSearch started" in capsys.readouterr().out
    db = database.with_residues(frame(spark, TARGETS))
    assert report.cells(db, database.numbered_queries(frame(spark, ["MKV"]))).first()["cells"] == 3 * sum(map(len, TARGETS))


def test_streamed_queries(spark, tmp_path):
    from proteinscan.streaming.queries import stream_search

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">q\nMKV\n")
    stream_search(spark, str(tmp_path / "in"), database.with_residues(frame(spark, TARGETS)), str(tmp_path / "out"), str(tmp_path / "cp"), top=2).awaitTermination()
    assert [r["target_header"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("rank").collect()] == ["t6", "t4"]


def test_long_targets_by_blocks():
    """Cut anywhere, also inside gaps that span several blocks, the score is that of the recurrence."""
    rng = np.random.default_rng(5)
    for trial in range(40):
        table = matrices.load(matrices.MATRICES[trial % 8])
        gaps = [(10, 2), (0, 0), (3, 1), (127, 127), (0, 1), (5, 0)][trial % 6]
        motif = rng.integers(0, 24, 25).astype(np.uint8)
        target = np.concatenate([motif[:12], rng.integers(0, 24, rng.integers(0, 9)).astype(np.uint8), motif[12:], motif[: rng.integers(0, 25)]])
        query = np.concatenate([motif, rng.integers(0, 24, rng.integers(0, 6)).astype(np.uint8), motif[:9]])
        expected = scalar(*("".join((alphabet.LETTERS + "J")[c] for c in x) for x in (query, target)), matrices.MATRICES[trial % 8], *gaps)
        assert {int(alignment.score_long([query], target, table, *gaps, block)[0]) for block in (1, 2, 5, 13, 100)} == {expected}
        assert alignment.score_bounds([query], np.bincount(target, minlength=25)[None], table)[0, 0] >= expected


def test_a_long_target_takes_the_memory_of_a_block():
    import tracemalloc

    target = np.random.default_rng(6).integers(0, 20, 2_000_000).astype(np.uint8)
    tracemalloc.start()
    alignment.score_long([target[500:540]], target, matrices.load("blosum62"), 10, 2, 48_000)
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()


def test_skipping_loses_no_best_row(spark):
    """Targets of very different lengths, with ties: skipped cells change nothing, and there are some."""
    rng = random.Random(7)
    rows = ["".join(rng.choices(STD, k=rng.choice((3, 8, 20, 90)))) for _ in range(2000)] + ["W" * 30] * 9
    db, queries = database.with_residues(frame(spark, rows)), database.numbered_queries(frame(spark, [*rows[5:9], "".join(x for x in rows[:99] if len(x) == 90)[:180], "W" * 40]))
    work = [spark.sparkContext.accumulator(0) for _ in range(2)]
    kept = search.best(search.scores(db, queries, top=5, work=work), 5).collect()
    assert sorted(map(tuple, kept)) == sorted(map(tuple, search.best(search.scores(db, queries), 5).collect()))
    assert work[1].value > 0 and work[0].value + work[1].value == sum(map(len, rows)) * queries.agg(F.sum("length")).first()[0]


def test_grid_of_blocks_and_portions():
    assert search.grid(10**6, 10**3, 1, 2) == (8, 1)
    blocks, groups = search.grid(10**5, 12 * 10**8, 1200, 8)  # few residues, many queries
    assert blocks <= 4 and groups == 1200
    blocks, groups = search.grid(10**12, 10**6, 1, 8)  # many residues, one portion
    assert groups == 1 and 10**12 / blocks * 10**6 <= 2 * search.TASK_CELLS
    blocks, groups = search.grid(10**12, 100, 1, 8)  # nearly no queries: blocks stay bounded
    assert groups == 1 and 10**12 / blocks <= search.BLOCK_RESIDUES


def test_many_portions_are_one_scan(spark, monkeypatch):
    monkeypatch.setattr(search, "PASS_QUERIES", 1)
    monkeypatch.setattr(search, "SMALL_BLOCK", 1 << 30)
    rng = random.Random(8)
    rows = ["".join(rng.choices(STD, k=rng.randrange(1, 30))) for _ in range(120)]
    db, queries = database.with_residues(frame(spark, rows)), database.numbered_queries(frame(spark, rows[:40]))
    found = search.scores(db, queries)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and found.count() == 120 * 40


def test_positions_by_counting_lengths(spark, monkeypatch):
    rows = spark.range(500).selectExpr("id AS input_pos", "cast(id * 7 % 13 AS int) AS length").repartition(6)
    expected = sorted((r["length"], r["input_pos"]) for r in rows.collect())
    for crowded in (1 << 20, 10, 38):  # no length, every length, some lengths
        monkeypatch.setattr(ranking, "CROWDED", crowded)
        out = ranking.by_length(rows).orderBy("position").collect()
        assert [(r["length"], r["input_pos"]) for r in out] == expected and [r["position"] for r in out] == list(range(1, 501))
        assert [r["before"] for r in out] == [sum(n for n, _ in expected[:k]) for k in range(500)]
    assert ranking.by_length(rows.where("false")).count() == 0


def test_adding_to_a_database(spark, tmp_path):
    """Twice, also nothing, and to a database of files: the order and summary of all sequences."""
    rng = random.Random(9)
    old, new = (["".join(rng.choices(STD, k=rng.randrange(0, 9))) for _ in range(n)] for n in (80, 30))
    database.preprocess(frame(spark, old), str(tmp_path / "a"))
    about = database.append(str(tmp_path / "a"), frame(spark, new), str(tmp_path / "b")).first()
    rows = database.load(spark, str(tmp_path / "b")).orderBy("position").collect()
    assert [(r["length"], r["input_pos"]) for r in rows] == sorted((len(x), i) for i, x in enumerate(old + new, 1)) and [r["position"] for r in rows] == list(range(1, 111))
    assert about.asDict() == database.preprocess(frame(spark, old + new), str(tmp_path / "c")).first().asDict() | {"max_title_length": 3}
    same = database.append(str(tmp_path / "b"), frame(spark, new).where("false"), str(tmp_path / "d")).first()
    assert same == about and database.load(spark, str(tmp_path / "d")).count() == 110
    (tmp_path / "x.fa").write_text(">x\nMKV\n>y\nM\n")
    (tmp_path / "w.fa").write_text(">w\nAKV\n")
    database.preprocess(read_fasta(spark, str(tmp_path / "x.fa")), str(tmp_path / "e"))
    database.append(str(tmp_path / "e"), read_fasta(spark, str(tmp_path / "w.fa")), str(tmp_path / "f"))
    assert [r["header"] for r in database.load(spark, str(tmp_path / "f")).orderBy("position").collect()] == ["y", "x", "w"]


def test_fasta_writer_keeps_every_row(spark, tmp_path):
    rows = [("a", "MKV"), (None, "WWW"), ("c", None), ("two\r\nlines", "A" * 61), (None, None), ("", "")]
    write_fasta(spark.createDataFrame(rows, "header string, seq string"), str(tmp_path / "out"))
    found = read_fasta(spark, str(tmp_path / "out")).collect()
    assert sorted((r["header"], r["seq"]) for r in found) == sorted([("a", "MKV"), ("", "WWW"), ("c", ""), ("two lines", "A" * 61), ("", ""), ("", "")])


def test_rejected_symbols_beside_the_database(spark, tmp_path, monkeypatch):
    """Every symbol that is no letter keeps its place, over chunks, past emoji; letters, null and empty texts have none."""
    monkeypatch.setattr(alphabet, "CHUNK", 5)
    texts = ["MK-V é😀L*", "mkvlaa", "", None, "A" * 17 + "1" + "C" * 4 + "??", "- "]
    rows = spark.createDataFrame(list(enumerate(texts)), "input_pos long, s string")
    rows = rows.select("input_pos", F.col("input_pos").cast("string").alias("header"), alphabet.clean(F.col("s")).alias("seq"))
    database.preprocess(rows, str(tmp_path / "db"), rejects=True)
    found = database.rejected_symbols(spark, str(tmp_path / "db"))
    want = {(i, k, c) for i, t in enumerate(texts) for k, c in enumerate((t or "").upper().replace(" ", "").replace("É", "é")) if not ("A" <= c <= "Z")}
    assert {(r["input_pos"], r["offset"], r["symbol"]) for r in found.collect()} == want and found.count() == len(want)
    more = rows.where("input_pos = 0").withColumn("input_pos", F.lit(1).cast("long"))
    database.append(str(tmp_path / "db"), more, str(tmp_path / "more"))
    assert database.rejected_symbols(spark, str(tmp_path / "more")).count() == len(want) + 4
    database.preprocess(rows, str(tmp_path / "plain"))
    assert database.rejected_symbols(spark, str(tmp_path / "plain")).count() == 0
    assert "residues" not in str(found._jdf.queryExecution().executedPlan()).split("ReadSchema")[1]


def test_a_search_observes_itself(spark):
    """The metrics come from the search's own rows and equal a separate count; nothing to search gives zeros."""
    db = database.with_residues(frame(spark, TARGETS))
    queries = database.numbered_queries(frame(spark, ["MKV", "", "MKVLAA"]))
    hits, seen = report.timed_search(db, queries, top=2)
    assert seen["cells"] == report.cells(db, queries).first()["cells"] == 9 * sum(map(len, TARGETS))
    assert seen["sequences"] == len(TARGETS) and seen["hits"] == hits.count() == 6
    for few_db, few in ((db.where("false"), queries), (db, database.numbered_queries(frame(spark, []))), (db.where("false"), database.numbered_queries(frame(spark, [])))):
        hits, seen = report.timed_search(few_db, few, top=2)
        assert seen["cells"] == 0 and seen["hits"] == hits.count() == 0

from pyspark.sql import functions as F

from loomspan.functions import cigar
from loomspan.operators import families, recode, summary
from loomspan.plans import jobs
from loomspan.sources import readers, writers

RM = """   SW   perc perc perc  query
score   div. del. ins.  sequence

 4749 10.5 2.5 0.4 chrX 2 719 (317950216) + rnd-5_family-1317 __ClassII_DNA_TcMar_nMITE 1 733 (0) 1
 300 1.5 0.0 0.0 chrX 700 800 (1) C fam2 LINE/L1 (0) 10 1 2 *
 20 7.0 0.0 0.0 chr2 1 10 (1) + fam3 Simple_repeat 1 2 (0) 3
"""


def file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return f"file://{path}"


def test_repeats(spark, tmp_path):
    path = file(tmp_path, "rm.out", RM)
    rows = readers.repeats(spark, path, fail=True).collect()
    assert [(r["sequid"], r["overlapping"], r["bp_naive"]) for r in rows] == [("chrX", False, 718), ("chrX", True, 101), ("chr2", False, 10)]
    broken = file(tmp_path, "bad.out", RM + " 1 2 3\n")
    assert readers.bad_rows(spark, broken).count() == 1
    assert readers.repeats(spark, broken).count() == 3


def test_repeat_jobs(spark, tmp_path):
    rows = jobs.preprocess_repeats(spark, file(tmp_path, "rm.out", RM))
    assert {r["name"]: r["bp_algor"] for r in rows.collect()} == {"rnd-5_family-1317": 718, "fam2": 81, "fam3": 10}
    assert jobs.preprocess_repeats(spark, file(tmp_path, "rm.out", RM), sequential=True).count() == 3
    rows = rows.withColumn("Species", F.lit("sp"))
    index = readers.subset_index(spark, {"sp": file(tmp_path, "i.idx", "sex chrx 1000\nauto chr\\d 500\n")})
    out = jobs.repeat_summaries(rows, index).collect()
    totals = {r["Subset"]: r["algor_totbp"] for r in out if r["class"] == "TOTAL_REPETITIVE"}
    assert totals == {"sex": 799, "auto": 10}
    assert {r["Subset"]: r["algor_totbp"] for r in out if r["class"] == "NON_REPETITIVE"} == {"sex": 201, "auto": 490}
    for t in jobs.repeat_distributions(rows).values():
        assert t.count()
    assert jobs.diversity(rows, "class").first()["types"] == 3


def test_taxonomy(spark):
    labels = ["DNA/hAT-Ac", "LINE/I-Jockey", "LTR/Gypsy", "__ClassII_DNA_Mutator_MITE", "SINE/ALU", "rRNA", "nonsense", "RC/Helitron"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    got = {r["label"]: (r["class"], r["subclass"], r["order"], r["superfam"], r["mite"]) for r in recode.classified(df, label="label").collect()}
    assert got["DNA/hAT-Ac"] == ("DNA", "1", "TIR", "hAT", None)
    assert got["LINE/I-Jockey"] == ("Retrotransposon", "NA", "LINE", "Jockey", None)
    assert got["__ClassII_DNA_Mutator_MITE"] == ("DNA", "1", "TIR", "Mutator", True)
    assert got["SINE/ALU"][3] == "7SL" and got["rRNA"][:2] == ("Other", "rRNA")
    assert got["nonsense"] == (None,) * 5 and got["RC/Helitron"][1:4] == ("2", "Helitron", "Helitron")
    assert recode.classified(df, label="label", v7=True).where("label = 'DNA/hAT-Ac'").first()["order"] == "DDE"


def test_paf(spark, tmp_path):
    rows = ["q1\t100\t0\t60\t+\tt1\t200\t10\t72\t55\t64\t60\ttp:A:P\tNM:i:9\tcg:Z:30M4I20M2D8M\tzz:Z:x", "q2\t50\t0\t50\t-\tt1\t200\t100\t150\t50\t50\t0"]
    path = file(tmp_path, "a.paf", "\n".join(rows))
    one, two = readers.paf(spark, path).orderBy("Qname").collect()
    assert (one["cig_matches"], one["cig_insertions"], one["cig_deletions"], one["cig_compressed"], one["mismatches"]) == (58, 4, 2, 2, 3)
    assert one["other_tags"] == {"zz": "x"} and two["CIGAR_string"] is None and two["cig_matches"] is None
    assert "zd_unknown" not in readers.paf(spark, path, drop_empty=True).columns
    out = jobs.alignment_stats(spark, path, [("all", "."), ("target", "^T")])
    regions = {(r["db"], r["subset"], r["region"]): r["sum"] for r in out["regions"].collect()}
    assert regions["T", "target", "mapped"] == 112 and regions["T", "all", "unmapped"] == 88
    kinds = {(r["db"], r["kind"]): r["sum"] for r in out["indels"].where("subset = 'all'").collect()}
    assert kinds["Q", "Ins"] == kinds["T", "Del"] == 4
    assert out["positions"].count() and out["coverage"].count() == 3


def test_other_readers(spark, tmp_path):
    fa = file(tmp_path, "x.fa", ">s1 a\nACGT\nAC\n>s2\nTTTTGG\n")
    chunks = readers.chunked(readers.fasta(spark, fa), 4)
    regions = spark.createDataFrame([("S1", -2, 5, "t"), ("s2", 3, 6, "u")], "pattern string, begin long, end long, tag string")
    assert sorted(r["sequence"] for r in readers.excerpts(chunks, regions, 4).collect()) == ["ACGTA", "TGG"]
    mcl = file(tmp_path, "f.mcl", "a\tb\tc\nd e\nf\n")
    fam = readers.family_lists(spark, mcl)
    assert families.family_statistics(fam, family="family").first().asDict() == {"families": 2, "paralogs": 5, "orphans": 1, "largest": 3, "members": 6}
    writers.family_lists(fam, f"file://{tmp_path}/out", family="family", id="gene")
    lines = [r[0] for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    assert sorted(lines) == ["a\tb\tc", "d\te", "f"]
    cov = file(tmp_path, "c.csv", "coverage,frequency\n1,1050\n2,504\n3,306\n4,607\n5,1272\n6,1443\n7,1149\n8,9\n")
    got = summary.weighted_stats(readers.coverage(spark, cov), group=["sample"], value="covg", freq="freq").first()
    assert (got["median"], got["max_freq_at"], got["min_freq_at"]) == (5, 6, 3)
    stats = file(tmp_path, "s.txt", "SN\tbases mapped (cigar):\t6331\nCOV\t[1-1]\t1\t7\n")
    assert {r["metric"]: r["value"] for r in readers.stats_reports(spark, stats).collect()} == {"bases mapped (cigar)": 6331.0, "COV:1": 7.0}
    idx = file(tmp_path, "o.idx", "Dsp whatever\nchr\\d 100\nchrx 50\n")
    assert [(r["Species"], r["Bpsum"]) for r in readers.headed_index(spark, idx).orderBy("Bpsum").collect()] == [("Dsp", 50), ("Dsp", 100)]
    log = file(tmp_path, "l.txt", "Model\tReplicate\tlog-likelihood\tp(a, b)\nIM_1\tRound_1_Replicate_2\t-5\t0.1,0.2\nModel\tReplicate\tlog-likelihood\tp(c)\nSI_2\tRound_2_Replicate_1\t-6\t0.3\n")
    got = readers.optimisation_logs(spark, log).orderBy("line").collect()
    assert [(r["model"], r["round"], r["replicate"], r["values"].get("a"), r["values"].get("c")) for r in got] == [("IM", "1", "2", "0.1", None), ("SI", "2", "1", None, "0.3")]
    gff = file(tmp_path, "g.gff3", "##gff\nc1\tx\tgene\t5\t20\t.\t+\t.\tID=g1;n=1\nc1\tx\tgene\t30\t45\t.\t+\t.\tID=g2\nc2\tx\tgene\t1\t9\t.\t+\t.\tID=g3\n")
    models = readers.gff3(spark, gff)
    tables = jobs.paranome_tables(spark.createDataFrame([(1, "g1"), (1, "g2"), (1, "g3"), (2, "gx")], "family long, gene string"), models)
    assert sorted((r["seq_a"], r["seq_b"], r["links"]) for r in tables["linkage"].collect()) == [("c1", "c1", 1), ("c1", "c2", 1)]
    assert tables["missing"].count() == 1
    seg = spark.createDataFrame([(1, 7, "g", "c1", "g1", "g2", 0), (2, 7, "g", "c2", "g3", "g3", 1)], "id int, multiplicon int, genome string, sequid string, first string, last string, order int")
    out = jobs.segment_tables(seg, models)
    assert out["pairs"].first()["genes_ratio"] == 2.0 and out["sizes"].first()["segments"] == 2


def test_cigar_and_tsv(spark, tmp_path):
    df = spark.createDataFrame([(1, "100M10I100M10D100M", 5), (2, None, 5)], "id int, cg string, start int")
    got = cigar.parsed(df, "cg").orderBy("id").collect()
    assert (got[0]["cig_matches"], got[0]["cig_insertions"], got[0]["cig_deletions"], got[0]["cig_compressed"]) == (300, 10, 10, 2)
    ops = cigar.operations(df, ["id"], "cg", "start").orderBy("place").collect()
    assert [(r["op"], r["at"]) for r in ops] == [("M", 5), ("I", 105), ("M", 105), ("D", 205), ("M", 215)]
    writers.tsv(df.withColumn("x", F.lit(1.5)), f"file://{tmp_path}/t", decimals=5)
    text = "".join(r[0] + "\n" for r in spark.read.text(f"file://{tmp_path}/t").collect())
    assert "1.50000" in text and "NA" in text


def test_extrema_and_modes(spark):
    df = spark.createDataFrame([("s", i, f) for i, f in enumerate([1, 3, 5, 4, 9], 1)], "s string, v int, f int")
    got = {(r["v"], r["extremum"]) for r in summary.local_extrema(df, group=["s"], value="v", freq="f").collect()}
    assert got == {(1, "min"), (3, "max"), (4, "min"), (5, "max")}
    ties = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2)], "g string, v int")
    assert {r["g"]: r["mode_raw"] for r in summary.mode_or_null(ties, ["g"], "v").collect()} == {"a": 1, "b": None}


def test_recode_helpers(spark):
    df = spark.createDataFrame([("Scaffold_11",), ("Scaffold_2",), ("chr1",)], "id string")
    assert [r[0] for r in df.orderBy(recode.natural_key("id")).collect()] == ["chr1", "Scaffold_2", "Scaffold_11"]
    rules = [("Scaffold_?1", "A"), ("Scaffold_?2", "B")]
    assert sorted(r[0] for r in df.select(recode.renamed_by_patterns("id", rules)).collect()) == ["B", "Scaffold_11", "chr1"]
    assert sorted(r[0] for r in df.select(recode.renamed_by_patterns("id", rules, anchored=False)).collect()) == ["A1", "B", "chr1"]
    keys = spark.createDataFrame([("chr", "red", 0), ("Scaff", "blue", 1)], "key string, col string, ord int")
    assert recode.coloured(df, keys, columns=["id"], key="key", colour="col", order="ord").where("colour = 'blue'").count() == 2


def test_fasta_chunks_are_those_of_whole_records(spark, tmp_path):
    path = file(tmp_path, "x.fa", ">a one\nACGTA\nCGTAC\nGT\n>b\n" + "TTGCA\n" * 7 + ">empty\n>c\nG\n")
    want = sorted(map(tuple, readers.chunked(readers.fasta(spark, path), 8).where("bases <> ''").collect()))
    assert sorted(map(tuple, readers.fasta_chunks(spark, path, 8).collect())) == want


def test_loading_lists_what_is_wrong(spark, tmp_path):
    import pytest

    rows = jobs.preprocess_repeats(spark, file(tmp_path, "rm.out", RM))
    path = f"file://{tmp_path}/pre"
    names = [n for n, _ in readers.REPEAT_FIELDS if n not in readers.DROPPED] + ["overlapping", "bp_naive", "bp_algor"]
    writers.tsv(rows.select(*names), path)
    good, other = file(tmp_path, "a.idx", "sex chrx 1000\nauto chr\\d 500\n"), file(tmp_path, "b.idx", "sex chrx 1000\nlost chrY 5\n")
    loaded, index = jobs.loaded(spark, {"sp": path}, {"sp": good})
    assert loaded.count() == 3 and index.count() == 2
    assert jobs.loaded(spark, {"sp": path, "two": path}, {"sp": good})[1] is None
    with pytest.raises(ValueError, match="subset lost of sp"):
        jobs.loaded(spark, {"sp": path}, {"sp": other})
    with pytest.raises(ValueError, match="without repeats: x"):
        jobs.loaded(spark, {"sp": path}, {"x": good})


def test_scratch_tables_go_when_cleared(spark):
    from pathlib import Path

    from loomspan.session import cleared, kept, scratch_root

    assert kept(spark.range(5)).count() == 5
    root = Path(scratch_root(spark).removeprefix("file://"))
    assert any(root.iterdir())
    cleared(spark)
    assert not root.exists()
    assert kept(spark.range(3)).count() == 3

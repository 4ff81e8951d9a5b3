"""Readers of ragged biological text formats. Paths may be folders or globs; all reading is Spark's.

Lines that don't have the fields a format asks for are given apart, by `bad_rows`, or raise with fail=True.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions import cigar
from loomspan.operators.patterns import meeting
from loomspan.operators.scans import Running, dealt
from loomspan.session import kept

REPEAT_FIELDS = [
    ("score_SW", "int"), ("perc_divg", "double"), ("perc_del", "double"), ("perc_ins", "double"), ("sequid", "string"),
    ("begin", "int"), ("end", "int"), ("left", "string"), ("orient", "string"), ("name", "string"),
    ("default_repclass", "string"), ("begin_match", "string"), ("end_match", "string"), ("left_match", "string"), ("ID", "string"),
]
DROPPED = ["left", "begin_match", "end_match", "left_match", "ID"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def _typed(fields: Column, names: list[tuple[str, str]]) -> list[Column]:
    return [F.try_element_at(fields, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(names, 1)]


def repeat_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, fields): lines that begin with a number, so not the headers, split at white space."""
    rows = _lines(spark, path).where(F.col("value").rlike(r"^\s*\d"))
    return rows.withColumn("fields", F.split(F.trim("value"), r"\s+"))


def _good() -> Column:
    """Whether a repeat line has 15 fields, or a 16th that is the overlap mark."""
    n = F.size("fields")
    return (n == 15) | ((n == 16) & (F.element_at("fields", -1) == "*"))


def bad_rows(spark: SparkSession, path: str) -> DataFrame:
    """(value): repeat lines without 15 fields, or a 16th that is the overlap mark."""
    return repeat_lines(spark, path).where(~_good()).select("value")


def _repeat_table(lines: DataFrame) -> DataFrame:
    out = lines.where(_good()).select(*_typed(F.col("fields"), REPEAT_FIELDS), (F.size("fields") == 16).alias("overlapping"))
    return out.drop(*DROPPED).withColumn("bp_naive", F.abs(F.col("end") - F.col("begin")) + 1)


def repeats(spark: SparkSession, path: str, fail: bool = False) -> DataFrame:
    """Raw repeat annotation: 11 kept columns without the match positions, overlapping (16th field '*'), bp_naive."""
    if fail and not (bad := bad_rows(spark, path)).isEmpty():
        raise ValueError(f"a line without 15 fields and an optional mark: {bad.first()[0]!r}")
    return _repeat_table(repeat_lines(spark, path))


def observed_repeats(spark: SparkSession, path: str) -> tuple[DataFrame, Observation]:
    """repeats' table, and what is seen of its lines while the table is first written or counted: lines, bad, example (a bad line)."""
    seen = Observation()
    bad = ~_good()
    lines = repeat_lines(spark, path).observe(seen, F.count("*").alias("lines"), F.count_if(bad).alias("bad"), F.max(F.when(bad, F.col("value"))).alias("example"))
    return _repeat_table(lines), seen


def preprocessed_repeats(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Preprocessed repeat tables of several species (a header line, white space between fields), with Species."""
    names = [(n, t) for n, t in REPEAT_FIELDS if n not in DROPPED] + [("overlapping", "boolean"), ("bp_naive", "int"), ("bp_algor", "int")]
    out = None
    for species, path in paths.items():
        one = repeat_lines(spark, path).select(*_typed(F.col("fields"), names), F.lit(species).alias("Species"))
        out = one if out is None else out.unionByName(one)
    return out


LEGACY_FIELDS = [*REPEAT_FIELDS, ("Class", "string"), ("Subclass", "string"), ("Order", "string"), ("Super_family", "string")]


def legacy_repeats(spark: SparkSession, path: str) -> DataFrame:
    """Older rows that are classified already: the 15 fields, then class, subclass, order and superfamily."""
    return repeat_lines(spark, path).where(F.size("fields") >= 19).select(*_typed(F.col("fields"), LEGACY_FIELDS))


def subset_index(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(Species, Subset, Pattern, Bpsum) of index files with three fields a line."""
    out = None
    for species, path in paths.items():
        f = F.split(F.trim("value"), r"\s+")
        one = _lines(spark, path).select(F.lit(species).alias("Species"), *_typed(f, [("Subset", "string"), ("Pattern", "string"), ("Bpsum", "long")]))
        out = one if out is None else out.unionByName(one)
    return out


def headed_index(spark: SparkSession, path: str) -> DataFrame:
    """(Species, Pattern, Bpsum) of older index files, whose first line names the species; one small file a species."""
    rows = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    rows = rows.select(F.split(F.trim(F.col("l")[0]), r"\s+")[0].alias("Species"), F.explode(F.slice("l", 2, F.size("l"))).alias("value"))
    return rows.select("Species", *_typed(F.split(F.trim("value"), r"\s+"), [("Pattern", "string"), ("Bpsum", "long")]))


def sequence_index(spark: SparkSession, path: str) -> DataFrame:
    """(sequid, start, end) from lines of id and length."""
    f = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).select(f[0].alias("sequid"), F.lit(0).cast("long").alias("start"), f[1].cast("long").alias("end"))


# The alignment format's columns, and its optional tags with the names used here.
PAF_FIELDS = [
    ("Qname", "string"), ("Qlen", "long"), ("Qstart", "long"), ("Qend", "long"), ("strand", "string"), ("Tname", "string"),
    ("Tlen", "long"), ("Tstart", "long"), ("Tend", "long"), ("matches", "long"), ("ali_len", "long"), ("mapQ", "int"),
]
PAF_TAGS = {
    "tp": ("type_aln", "string"), "cm": ("num_minimizers", "int"), "s1": ("chaining_score", "int"), "s2": ("second_chain_score", "int"),
    "NM": ("mismatches_and_gaps", "int"), "MD": ("regenerate_refseq", "string"), "AS": ("DP_ali_score", "int"), "SA": ("list_supp_ali", "string"),
    "ms": ("DP_max_score", "int"), "nn": ("ambiguous_bases", "int"), "ts": ("transcript_strand", "string"), "cg": ("CIGAR_string", "string"),
    "cs": ("diff_string", "string"), "dv": ("divergence", "double"), "de": ("gap_compr_diverg", "double"),
    "rl": ("length_repetitive_seeds", "int"), "zd": ("zd_unknown", "int"),
}


def paf(spark: SparkSession, path: str, drop_empty: bool = False) -> DataFrame:
    """Alignments: 12 columns, the known tags as typed columns (null where missing) and other tags in a map.

    Of a repeated tag the first value counts. With alignment strings, their totals, indel lists and identities are added.
    drop_empty leaves out tag columns without any value, at the cost of one pass.
    """
    f = F.split("value", "\t")
    rows = _lines(spark, path).where(F.size(f) >= 12).withColumn("_f", f)
    tags = F.transform(F.slice("_f", 13, F.greatest(F.size("_f") - 12, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), x.substr(F.lit(6), F.length(x)).alias("v")))
    rows = rows.withColumn("_t", tags)
    value = lambda k: F.try_element_at(F.filter("_t", lambda x: x["k"] == k), F.lit(1))["v"]
    known = [value(k).try_cast(t).alias(n) for k, (n, t) in PAF_TAGS.items()]
    other = F.filter("_t", lambda x: ~x["k"].isin(*PAF_TAGS))
    keys = F.array_distinct(F.transform(other, lambda x: x["k"]))
    rest = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter("_t", lambda x: x["k"] == k), 1)["v"])).alias("other_tags")
    out = cigar.parsed(rows.select(*_typed(F.col("_f"), PAF_FIELDS), *known, rest), "CIGAR_string")
    out = cigar.identities(out, matches="matches", ali_len="ali_len", edits="mismatches_and_gaps")
    if drop_empty:
        names = [n for n, _ in PAF_TAGS.values()]
        there = out.agg(*[F.bool_or(F.col(n).isNotNull()).alias(n) for n in names]).first()
        out = out.drop(*[n for n in names if not there[n]])
    return out


def sides(df: DataFrame, keep: list[str]) -> DataFrame:
    """An alignment table in long form: (db, sequid, length, begin, end, keep) for query and target, ids prefixed Q. and T."""
    one = lambda db: F.struct(F.lit(db).alias("db"), F.concat(F.lit(f"{db}."), F.col(f"{db}name")).alias("sequid"), F.col(f"{db}len").alias("length"), F.col(f"{db}start").alias("begin"), F.col(f"{db}end").alias("end"))
    return df.select(*keep, F.explode(F.array(one("Q"), one("T"))).alias("s")).select("s.*", *keep)


def gff3(spark: SparkSession, path: str) -> DataFrame:
    """Gene models, with gene: the text after the first = of the attributes, up to a semicolon."""
    schema = "sequid string, source string, feature string, start long, end long, score string, strand string, phase string, attributes string"
    rows = spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    return rows.where("attributes is not null").withColumn("gene", F.regexp_extract("attributes", "=([^;]*)", 1))


def family_lists(spark: SparkSession, path: str) -> DataFrame:
    """(family, gene): a line is a family; its id is a hash of file and members, as line numbers mean nothing."""
    rows = _lines(spark, path).select(F.xxhash64(F.col("_metadata.file_path"), "value").alias("family"), F.split(F.trim("value"), r"\s+").alias("g"))
    return rows.select("family", F.explode("g").alias("gene"))


ORTHOGROUP_SCHEMA = (
    "OGid string, Method string, Species string, BRAKER_status string, ChimericGeneStatus boolean, RNAseq_status string, RNAseq_OGstatus string, "
    "GO_status string, GO_OGstatus string, GeneID string, Scaffold string, ScaffoldCategory string, GeneStart int, GeneEnd int, OGtype string"
)


def orthogroups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ORTHOGROUP_SCHEMA).option("sep", "\t").option("header", True).csv(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    schema = "id int, multiplicon int, genome string, sequid string, first string, last string, order int"
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def coverage(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(sample, covg, freq) of coverage histograms: the column named like 'freq' and the other; each file's last bin is left out."""
    rows = spark.read.option("sep", sep).option("header", True).csv(path)
    freq = next(c for c in rows.columns if "freq" in c.lower())
    other = next(c for c in rows.columns if c != freq)
    out = rows.select(F.col("_metadata.file_name").alias("sample"), F.col(other).try_cast("long").alias("covg"), F.col(freq).try_cast("long").alias("freq")).where("covg is not null")
    return out.withColumn("_m", F.max("covg").over(Window.partitionBy("sample"))).where("covg < _m").drop("_m")


def coverage_wide(df: DataFrame, samples: list[str]) -> DataFrame:
    """One row a coverage, one column a sample."""
    return df.groupBy("covg").pivot("sample", samples).agg(F.sum("freq")).na.fill(0, samples)


def stats_reports(spark: SparkSession, path: str) -> DataFrame:
    """(sample, metric, value) of SN lines and (metric COV:<coverage>) COV lines of alignment-statistics reports."""
    rows = _lines(spark, path).select(F.col("_metadata.file_name").alias("sample"), F.split("value", "\t").alias("f"))
    sn = rows.where(F.col("f")[0] == "SN").select("sample", F.rtrim(F.col("f")[1], F.lit(":")).alias("metric"), F.col("f")[2].try_cast("double").alias("value"))
    cov = rows.where(F.col("f")[0] == "COV").select("sample", F.concat(F.lit("COV:"), F.col("f")[2]).alias("metric"), F.col("f")[3].try_cast("double").alias("value"))
    return sn.unionByName(cov)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence): records with their lines joined."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    return rows.select(F.regexp_extract("value", r"^([^\r\n]*)", 1).alias("header"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "").alias("sequence"))


def fasta_chunks(spark: SparkSession, path: str, width: int = 1 << 16) -> DataFrame:
    """(header, chunk, bases) straight from the lines, for records of any length: no record is ever held as one string.

    Lines are numbered once, in a table of their own; each goes to the chunks that it reaches into.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.rtrim("value").alias("value"))
    rows = kept(rows.withColumn("line", F.monotonically_increasing_id()).where("value <> ''"))
    head = F.col("value").startswith(">")
    rows = rows.withColumn("bases", F.when(~head, F.regexp_replace("value", r"\s", "")))
    # a record's number is its first line's; places are counted along the file, less what lies before the record
    scan = dealt(rows, key=["file"], order=["line"])
    scan = scan.running(record=Running("last", F.when(head, F.col("line")), own=True), header=Running("last", F.when(head, F.expr("substring(value, 2)")), own=True), _sum=Running("sum", F.length("bases")))
    scan = scan.with_columns(_sum=F.coalesce("_sum", F.lit(0))).kept().running(_before=Running("last", F.when(head, F.col("_sum")), own=True))
    rows = scan.rows.where(F.col("record").isNotNull() & (F.col("bases") != "")).withColumn("start", F.col("_sum") - F.col("_before"))
    last = F.floor((F.col("start") + F.length("bases") - 1) / width)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / width), last)))
    low = F.greatest(F.col("chunk") * width - F.col("start"), F.lit(0))
    part = F.substring(F.col("bases"), (low + 1).cast("int"), (F.least((F.col("chunk") + 1) * width - F.col("start"), F.length("bases")) - low).cast("int"))
    pieces = rows.groupBy("file", "record", "header", F.col("chunk").cast("int").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("start", part.alias("b")))).alias("l"))
    return pieces.select("header", "chunk", F.array_join(F.transform("l", lambda x: x["b"]), "").alias("bases"))


def chunked(df: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(header, chunk, bases) of a FASTA table."""
    n = F.greatest(F.ceil(F.length("sequence") / width).cast("int"), F.lit(1))
    rows = df.select("header", "sequence", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return rows.select("header", "chunk", F.substring(F.col("sequence"), F.col("chunk") * width + 1, F.lit(width)).alias("bases"))


def excerpts(chunks: DataFrame, regions: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(pattern, begin, end, tag, header, sequence): stretches [begin, end) from 0 of records whose header contains a pattern.

    regions: a table (pattern, begin, end, tag); negative begins count as 0; case is ignored.
    """
    heads = chunks.select("header").distinct()
    hit = meeting(heads, regions, id="header", literal=F.lower("pattern"), test=F.lower("header").contains(F.lower("pattern")), fold=F.lower).withColumn("begin", F.greatest("begin", F.lit(0)))
    hit = hit.where("begin < end").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("begin") / width).cast("int"), F.floor((F.col("end") - 1) / width).cast("int"))))
    part = hit.join(chunks, ["header", "chunk"])
    low = F.greatest(F.col("begin") - F.col("chunk") * width, F.lit(0))
    part = part.withColumn("_p", F.substring(F.col("bases"), (low + 1).cast("int"), (F.least(F.col("end") - F.col("chunk") * width, F.lit(width)) - low).cast("int")))
    rows = part.groupBy("pattern", "begin", "end", "tag", "header").agg(F.sort_array(F.collect_list(F.struct("chunk", "_p"))).alias("_l"))
    return rows.select("pattern", "begin", "end", "tag", "header", F.array_join(F.transform("_l", lambda x: x["_p"]), "").alias("sequence"))


def optimisation_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, round, replicate, model, execution, values, numbers): logs whose header is repeated with other parameter names.

    The last header field is name(p1, p2, ...), its values are comma-joined; values maps every column and parameter to text,
    numbers those that are numbers to doubles; round, replicate, model and execution are parts of names, so text.
    Files are small logs, one task each.
    """
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).where(F.trim("value") != "")
    head = F.when(F.col("value").startswith("Model\t"), F.col("value"))
    rows = rows.withColumn("_h", F.last(head, True).over(Window.partitionBy("file").orderBy("line"))).where(~F.col("value").startswith("Model\t") & F.col("_h").isNotNull())
    h, v = F.split("_h", "\t"), F.split("value", "\t")
    params = F.transform(F.split(F.regexp_extract(F.element_at(h, -1), r"\(([^)]*)\)", 1), ","), lambda x: F.trim(x))
    names = F.concat(F.slice(h, 1, F.size(h) - 1), params)
    values = F.concat(F.slice(v, 1, F.size(h) - 1), F.split(F.element_at(v, -1), ","))
    rows = rows.where(F.size(names) == F.size(values)).withColumn("values", F.map_from_arrays(names, F.transform(values, lambda x: F.trim(x))))
    numbers = F.map_filter(F.transform_values("values", lambda _, x: x.try_cast("double")), lambda _, x: x.isNotNull())
    rep, mod = F.split(F.col("values")["Replicate"], "_"), F.split(F.col("values")["Model"], "_")
    return rows.select("file", "line", F.get(rep, F.lit(1)).alias("round"), F.get(rep, F.lit(3)).alias("replicate"), mod[0].alias("model"), F.get(mod, F.lit(1)).alias("execution"), "values", numbers.alias("numbers"))


def sampled_lines(spark: SparkSession, path: str, lines: int, seed: int = 1) -> DataFrame:
    """About so many random lines of a text."""
    rows = spark.read.text(path)
    n = rows.count()
    return rows.sample(fraction=min(1.0, lines / n), seed=seed) if n else rows


def split_after(df: DataFrame, column: str, keyword: str) -> DataFrame:
    """Rows with a text cut into lines after each occurrence of a keyword."""
    return df.withColumn(column, F.explode(F.split(column, f"(?<={keyword})")))


def tsv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def sequence_sizes(sides_table: DataFrame, *, seq: str = "sequid", length: str = "length", side: str = "db") -> DataFrame:
    """(side, seq, length): the distinct sequences of a table with a row for each side of an alignment."""
    return sides_table.where(F.col(seq).isNotNull()).select(side, seq, length).distinct()

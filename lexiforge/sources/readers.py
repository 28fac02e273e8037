"""Readers and writers of the text formats around a corrector (S1-S24). Malformed lines are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nfc

EXPORT = "id string, set string, context array<string>, right array<string>, typed string, shown string, truth string, class string, capital boolean, real boolean, truth_in boolean, candidates array<struct<t:string,s:double,r:double,keep:boolean,x:boolean>>"
TEACHER = "id string, model string, ll_left array<double>, ll_full array<double>"
VSEC = "text string, annotations array<struct<current_syllable:string,is_correct:boolean,alternative_syllables:array<string>>>"
VIWIKI = "text string, mistakes array<struct<text:string,start_offset:string,suggest:array<string>>>"
KEYBOARD = "min_overlap double, keys array<struct<name:string,x0:double,x1:double,y0:double,y1:double>>, habits map<string,struct<partners:string,heavy:string>>"


def lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, line_no, line) of text files. A file is read whole by one task, in order, so that a
    line has its number; large corpora come as many files."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    d = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return d.where("line != ''").withColumn("line_no", (F.col("line_no") + 1).cast("long"))


def word_counts(spark: SparkSession, path: str, glob: str = "*-words.txt") -> DataFrame:
    """(source, word, n) of files named <source>-words.txt: `id word n` by tabs (the first field
    is dropped) or `word n` by a blank. Other lines and bad numbers are skipped, repeats added."""
    d = lines(spark, path, glob)
    tabs = F.split("line", "\t")
    fields = F.when(F.contains("line", F.lit("\t")), F.slice(tabs, 2, 1 << 20)).otherwise(F.split(F.trim("line"), " "))
    d = d.select(F.regexp_extract("file", r"([^/]+)-words\.txt$", 1).alias("source"), fields.alias("f")).where(F.size("f") == 2)
    d = d.select("source", nfc(F.col("f")[0]).alias("word"), F.col("f")[1].try_cast("long").alias("n")).where("n is not null and word != ''")
    return d.groupBy("source", "word").agg(F.sum("n").alias("n"))


def sentences(spark: SparkSession, path: str, glob: str = "*-sentences.txt") -> DataFrame:
    """S3: (source, line_no, id, text) of lines `id text` by a tab; text "" where it is missing. A
    missing folder has no rows."""
    try:
        d = lines(spark, path, glob)
        d.schema  # noqa: B018 - a missing path shows here
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "source string, line_no long, id string, text string")
    f = F.split("line", "\t", 2)
    return d.select(F.regexp_extract("file", r"([^/]+)-sentences\.txt$", 1).alias("source"), "line_no", f[0].alias("id"), F.coalesce(F.try_element_at(f, F.lit(2)), F.lit("")).alias("text"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(lexicon, line_no, word, per_billion) of lines `word number` by a tab; # is a comment."""
    f = F.split("line", "\t")
    d = lines(spark, path).where(~F.startswith("line", F.lit("#")) & (F.size(f) >= 2))
    return d.select(F.regexp_extract("file", r"([^/]+?)(\.\w+)?$", 1).alias("lexicon"), "line_no", f[0].alias("word"), f[1].try_cast("double").alias("per_billion")).where("per_billion > 0")


def write_lexicon(words: DataFrame, path: str, header: str = "word\tper billion words") -> None:
    """One file in order, behind a comment; a lexicon is a head of bounded size."""
    rows = words.select(F.concat_ws("\t", "word", F.round("per_billion").cast("long").cast("string")).alias("value"), F.col("per_billion").alias("_p"), F.col("word").alias("_w"))
    head = words.sparkSession.createDataFrame([("# " + header, None, None)], rows.schema)
    head.unionByName(rows).coalesce(1).sortWithinPartitions(F.desc_nulls_first("_p"), F.asc_nulls_first("_w")).select("value").write.mode("overwrite").text(path)


def write_model(model: dict[str, DataFrame], path: str, words: int) -> None:
    """The tables of an n-gram model as Parquet, sorted by key, with the size of its vocabulary."""
    for name, df in model.items():
        df.sortWithinPartitions(*df.columns[:-1]).withColumn("vocabulary", F.lit(words)).write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, name: str, words: int) -> DataFrame:
    """A table of a model; empty if it was made for another vocabulary."""
    return spark.read.parquet(f"{path}/{name}").where(F.col("vocabulary") == words).drop("vocabulary")


def json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Objects of a JSON lines file; blank and broken lines are skipped."""
    d = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return d.limit(limit) if limit else d


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line; nulls are left out."""
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame, out: str = "line") -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def misspellings(spark: SparkSession, path: str) -> DataFrame:
    """(keys, fix) of lines `typo fix` by a tab: lower-case typos of three bytes or more that no
    Telex keys of a Vietnamese syllable are."""
    from ..functions.syllable import telex

    f = F.split("line", "\t")
    d = lines(spark, path).where(~F.startswith("line", F.lit("#")) & (F.size(f) >= 2)).select(F.lower(F.trim(f[0])).alias("keys"), F.trim(f[1]).alias("fix"), "line_no")
    d = d.where((F.octet_length("keys") >= 3) & (F.col("fix") != "") & (telex("keys")["kind"] != "vietnamese"))
    return d.groupBy("keys").agg(F.max_by("fix", "line_no").alias("fix"))


def personal(spark: SparkSession, path: str) -> DataFrame:
    """(word, fix) of lines `ignore word` and `fix word right`; the last fix of a word counts,
    a fix wins over an ignore; fix null means ignore."""
    f = F.split("line", "\t")
    d = lines(spark, path).select("line_no", f[0].alias("verb"), F.lower(F.trim(F.try_element_at(f, F.lit(2)))).alias("word"), F.trim(F.try_element_at(f, F.lit(3))).alias("fix")).where("word != ''")
    d = d.where("verb = 'ignore' or (verb = 'fix' and fix != '')")
    return d.groupBy("word").agg(F.max_by("fix", F.when(F.col("verb") == "fix", F.col("line_no"))).alias("fix"))


def app_policy(spark: SparkSession, path: str) -> DataFrame:
    """(exe, mode, guard) of lines `verb exe`; the last line of each kind counts."""
    f = F.split("line", "\t")
    d = lines(spark, path).select("line_no", F.lower(F.trim(f[0])).alias("verb"), F.lower(F.trim(F.try_element_at(f, F.lit(2)))).alias("exe")).where("exe != ''")
    mode, guard = F.col("verb").isin("code", "off", "normal"), F.col("verb").isin("guard", "noguard")
    return d.where(mode | guard).groupBy("exe").agg(F.max_by("verb", F.when(mode, F.col("line_no"))).alias("mode"), (F.max_by("verb", F.when(guard, F.col("line_no"))) == "guard").alias("guard"))


def classify_apps(apps: DataFrame, user: DataFrame, builtin: DataFrame) -> DataFrame:
    """(exe, mode, guard): the user's policy, else the built-in one, else normal and guarded.
    Both are small tables of programs."""
    u = user.select(F.lower("exe").alias("_k"), F.col("mode").alias("_um"), F.col("guard").alias("_ug"))
    b = builtin.select(F.lower("exe").alias("_k"), F.col("mode").alias("_bm"), F.col("guard").alias("_bg"))
    d = apps.select("exe", F.lower("exe").alias("_k")).join(u, "_k", "left").join(b, "_k", "left")
    return d.select("exe", F.coalesce("_um", "_bm", F.lit("normal")).alias("mode"), F.coalesce("_ug", "_bg", F.lit(True)).alias("guard"))


#: Settings: default, and the values allowed.
SETTINGS: dict[str, tuple[object, Column | tuple]] = {"vietnamese": (True, ("0", "1")), "english": (True, ("0", "1")), "restore_marks": (True, ("0", "1")), "journal_right": (False, ("0", "1")), "method": ("telex", ("telex", "vni")), "preset": ("balanced", ("careful", "balanced", "bold")), "tau": (0.999, (0.5, 0.9999))}


def settings(text: str) -> dict[str, object]:
    """key=value lines; a value that is not allowed keeps the default."""
    out = {k: v for k, (v, _) in SETTINGS.items()}
    for line in text.splitlines():
        key, eq, value = (x.strip() for x in line.partition("="))
        if not eq or key not in SETTINGS:
            continue
        default, allowed = SETTINGS[key]
        if isinstance(default, bool):
            out[key] = value == "1" if value in allowed else out[key]
        elif isinstance(default, float):
            try:
                number = float(value)
            except ValueError:
                continue
            out[key] = number if allowed[0] <= number <= allowed[1] else out[key]
        elif value in allowed:
            out[key] = value
    return out


def keyboard(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(name, y0, y1, x0, x1) of the keys and (key, partners, heavy) of habits."""
    d = spark.read.schema(KEYBOARD).option("multiLine", True).json(path)
    keys = d.select(F.explode("keys").alias("k")).select("k.name", "k.y0", "k.y1", "k.x0", "k.x1")
    return keys, d.select(F.explode("habits").alias("key", "h")).select("key", "h.partners", "h.heavy")


def shards(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The union of shards, read as one table."""
    return spark.read.schema(schema).json(paths)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases as written by write_cases; a gold may be a|b."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("id", T.LongType()), ("history", T.StringType()), ("typed", T.StringType()), ("gold", T.StringType()), ("is_error", T.IntegerType()))])
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "DROPMALFORMED").csv(path)


def write_cases(df: DataFrame, path: str) -> None:
    """S23."""
    df.select("source", "id", "history", "typed", "gold", "is_error").write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """S24."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_journal(batch: DataFrame, path: str, most_bytes: int = 8 << 20) -> bool:
    """Appends rows as tab-separated lines unless the journal has reached its size; whether it did."""
    spark = batch.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jpath) and fs.getContentSummary(jpath).getLength() >= most_bytes:
        return False
    batch.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in batch.columns]).alias("value")).write.mode("append").text(path)
    return True

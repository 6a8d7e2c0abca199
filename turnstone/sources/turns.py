"""Sources: raw turn tables in CSV, id pairs in JSON lines, vocabularies, registries, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import npy, records

TURNS = "folder string, dialogueID string, date string, `from` string, text string"
PAIRS = "ctx array<int>, resp array<int>, src_ids array<int>, trg_ids array<int>, _corrupt_record string"


def largest_csv(spark: SparkSession, folder: str) -> str:
    """The largest CSV file of a folder, the first by name among equals; an error if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", "length")
    found = files.orderBy(F.desc("length"), "path").first()
    if found is None:
        raise FileNotFoundError(f"no CSV file in {folder}")
    return found["path"]


def read_turns(spark: SparkSession, path: str, mode: str = "all") -> DataFrame:
    """id, ord, ts, speaker, text; ord follows files and places in them. Malformed rows and rows without speaker, text or dialogue are left out. Large
    files are read in many tasks, and bytes that are no UTF-8 are replaced (see `records`).

    mode: all files, or the `largest` alone."""
    at = largest_csv(spark, path) if mode == "largest" else path
    names = spark.read.option("header", True).option("escape", '"').csv(at).columns
    raw = records.parsed(records.records(spark, at), names)
    raw = raw.select("ord", *[(F.col(f"`{f}`") if f in names else F.lit(None).cast("string")).alias(f) for f in ("folder", "dialogueID", "date", "from", "text")])
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    kept = raw.filter(filled("from") & filled("text") & filled("dialogueID"))
    key = F.when(filled("folder"), F.concat_ws("/", "folder", "dialogueID")).otherwise(F.col("dialogueID"))
    return kept.select(key.alias("id"), "ord", T.parse_date(F.col("date")).alias("ts"), F.trim("from").alias("speaker"), F.trim("text").alias("text"))


def read_pairs(spark: SparkSession, path: str, max_ctx: int = 100, max_resp: int = 42) -> tuple[DataFrame, DataFrame]:
    """(pairs ctx, resp; counts of skipped lines by reason). Older key names are accepted, an empty list falls through to them."""
    raw = spark.read.schema(PAIRS).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    pick = lambda a, b: F.when(F.size(a) > 0, F.col(a)).otherwise(F.coalesce(F.col(b), F.col(a)))
    df = raw.select(pick("ctx", "src_ids").alias("ctx"), pick("resp", "trg_ids").alias("resp"), "_corrupt_record")
    reason = F.when(F.col("_corrupt_record").isNotNull(), "malformed").when(F.col("ctx").isNull() | F.col("resp").isNull(), "missing_key").when((F.size("ctx") == 0) | (F.size("resp") == 0), "empty").otherwise("kept")
    df = df.withColumn("reason", reason)
    pairs = df.filter("reason = 'kept'").select(F.slice("ctx", F.greatest(F.size("ctx") - max_ctx + 1, F.lit(1)), F.lit(max_ctx)).alias("ctx"), F.slice("resp", 1, max_resp).alias("resp"))
    return pairs, df.groupBy("reason").agg(F.count("*").alias("n"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """piece, id of a flat JSON object, or of one nested under word2idx."""
    text = spark.read.option("wholetext", True).text(path)
    nested = F.from_json(F.get_json_object("value", "$.word2idx"), "map<string,int>")
    flat = F.from_json("value", "map<string,int>")
    return text.select(F.explode(F.coalesce(nested, flat)).alias("piece", "id"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    fields = "id name architecture checkpoint tokenizer dataset description".split()
    return spark.read.schema(", ".join(f"{f} string" for f in fields)).option("multiLine", True).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON document, or None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """at, value: the lines of text files in order, the first `most` alone if given (a bounded scan is the feature)."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(at.alias("at"), "value")
    return lines if most is None else lines.orderBy("at").limit(most)


def read_pair_array(spark: SparkSession, path: str) -> DataFrame:
    """ctx, resp of a JSON document that is an array of pairs."""
    return spark.read.schema("ctx string, resp string").option("multiLine", True).json(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """id, vec of a .npy file, or of a folder of them as `sinks.write_matrix` leaves it; ids run on over its files in order of names."""
    return npy.read_npy(spark, path)


def pieces_of(rows: DataFrame, vocab: DataFrame, key: str, ids: str) -> DataFrame:
    """key, pieces: an array of ids by a join with the vocabulary; an id that is not in it becomes <id>."""
    each = rows.select(key, F.posexplode(ids).alias("at", "id")).join(vocab.select("id", "piece"), "id", "left")
    piece = F.coalesce("piece", F.concat(F.lit("<"), F.col("id").cast("string"), F.lit(">")))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))), lambda x: x["piece"]).alias("pieces"))

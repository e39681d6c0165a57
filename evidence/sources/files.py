"""Readers and writers of landed files: pipe-delimited dumps, nested JSON, lookups, series, datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines_of(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """The lines of text files that are not blank: path, seq and line; seq orders the lines of one file.

    The encoding is UTF-8 or one of a byte a character. Large files are split: such an encoding
    is scanned as Latin-1, whose characters then become those of the encoding.
    """
    plain = encoding.lower().replace("_", "-") in ("utf-8", "utf8")
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value") if plain else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    if not plain:
        high = [(chr(b), bytes([b]).decode(encoding, "replace")) for b in range(128, 256)]
        line = F.translate(line, "".join(a for a, _ in high), "".join(b for _, b in high))
    seq = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    out = raw.select(F.col("_metadata.file_path").alias("path"), seq.alias("seq"), F.rtrim(line, F.lit("\r")).alias("line"))
    return out.where(F.trim("line") != "")


def raw_rows(spark: SparkSession, path: str, encoding: str = "windows-1250") -> DataFrame:
    """Pipe-delimited rows as path, seq and cols, an array of texts; one trailing bar goes, so that empty last columns survive."""
    return lines_of(spark, path, encoding).select("path", "seq", F.split(F.regexp_replace("line", r"\|$", ""), r"\|", -1).alias("cols"))


def read_unl(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "windows-1250") -> DataFrame:
    """Pipe-delimited rows with `seq`, which orders the rows of a file.

    Blank lines go, one trailing bar goes, so that empty last columns survive; an empty field is
    null, a field that is no valid value of its type drops the row, and so does a short row.
    Dates are dd.mm.yyyy or yyyy-mm-dd, by their first ten characters.
    """
    out = raw_rows(spark, path, encoding).where(F.size("cols") >= len(schema))
    columns, valid = [], F.lit(True)
    for i, field in enumerate(schema):
        text = F.when(F.col("cols")[i] != "", F.col("cols")[i])
        value = parsed_date(text) if isinstance(field.dataType, T.DateType) else text.try_cast(field.dataType)
        columns.append(value.alias(field.name))
        valid = valid & (text.isNull() | value.isNotNull())
    return out.where(valid).select("seq", *columns)


def parsed_date(text: Column) -> Column:
    """dd.mm.yyyy or yyyy-mm-dd, read from the first ten characters; null for anything else."""
    ten = F.substring(text, 1, 10)
    return F.coalesce(F.try_to_date(ten, "dd.MM.yyyy"), F.try_to_date(ten, "yyyy-MM-dd"))


def write_unl(rows: DataFrame, path: str) -> None:
    """Rows as pipe-delimited text with a trailing bar; nulls are empty."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    rows.select(F.concat(F.concat_ws("|", *fields), F.lit("|")).alias("value")).write.text(path)


def child_rows(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows of a dependent dump whose parent was kept."""
    return rows.join(parents.select(key).distinct(), key, "left_semi")


def registry(people: DataFrame, organs: DataFrame, memberships: DataFrame, deputies: DataFrame, term: int, club_type: int = 1, government_type: int = 5) -> dict[str, DataFrame]:
    """Five tables: people, clubs, club memberships, governments' memberships, deputies of a term.

    A membership counts with function 0 and an organ of the set.
    """
    clubs = organs.where(F.col("type") == club_type)
    governments = organs.where(F.col("type") == government_type)
    plain = memberships.where("function = 0")
    return {
        "people": people,
        "clubs": clubs,
        "club_memberships": plain.join(clubs.select("organ_id", "abbr"), "organ_id"),
        "government_memberships": plain.join(governments.select("organ_id"), "organ_id", "left_semi"),
        "deputies": deputies.where(F.col("term") == term),
    }


def read_nested(spark: SparkSession, path: str, schema: T.StructType, session: int | None = None, inner: str = "messages", lines: bool = False) -> DataFrame:
    """One row for each message of nested JSON files, with the debate's columns: an array of debates each, or with lines a debate a line."""
    debates = spark.read.schema(schema).option("multiLine", not lines).json(path)
    if session is not None:
        debates = debates.where(F.col("session") == session)
    return debates.select(*[c for c in debates.columns if c != inner], F.posexplode(inner).alias("pos", "m")).select("*", "m.*").drop("m")


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header domain, tier, note: domains in lower case, tiers as integers."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.lower(F.btrim("domain")).alias("domain"), F.col("tier").try_cast("int").alias("tier"), "note").where("tier is not null")


def monthly(rows: DataFrame, at: str, value: str, digits: int = 3, order: str | None = None) -> DataFrame:
    """Monthly mean, and the last value of each month by time, or by `order`, which tells equal times apart."""
    month = F.date_format(at, "yyyy-MM")
    return rows.where(F.col(value).isNotNull()).groupBy(month.alias("month")).agg(F.round(F.avg(value), digits).alias("mean"), F.max_by(value, order or at).alias("last"))


def json_stat(rows: DataFrame, labels: str, values: str) -> DataFrame:
    """Series of a JSON-stat document: time labels zipped with values, M as dash, nulls left out, two digits."""
    zipped = F.arrays_zip(F.col(labels).alias("label"), F.col(values).alias("value"))
    return rows.select(F.explode(zipped).alias("z")).where("z.value is not null").select(F.replace("z.label", F.lit("M"), F.lit("-")).alias("month"), F.round("z.value", 2).alias("value"))


def piped_series(rows: DataFrame, line: str, seq: str) -> DataFrame:
    """Monthly means of all columns of a piped table: month, name, value (three digits).

    The line that comes first by seq, whose first field is no date, names the columns; others have dd.mm.yyyy or yyyy-mm-dd
    and numbers with a decimal comma or point. Fields without a name or number are left out. The names are one row, whatever the length of the table.
    """
    parts = F.split(line, r"\|")
    day = parsed_date(parts[0])
    head = rows.where(day.isNull()).agg(F.min_by(F.transform(parts, lambda x: F.btrim(x)), seq).alias("_names"))
    data = rows.where(day.isNotNull()).crossJoin(F.broadcast(head)).select(F.date_format(day, "yyyy-MM").alias("month"), F.explode(F.arrays_zip(F.col("_names").alias("name"), parts.alias("field"))).alias("z"), day.alias("_day"))
    value = F.replace(F.btrim("z.field"), F.lit(","), F.lit(".")).try_cast("double")
    named = data.select("month", F.col("z.name").alias("name"), value.alias("v")).where("name <> '' and v is not null")
    return named.groupBy("month", "name").agg(F.round(F.avg("v"), 3).alias("value"))


def fx_table(rows: DataFrame, line: str, currency: str = "EUR") -> DataFrame:
    """Monthly means of the columns of a piped table whose name holds a currency: month and value."""
    return piped_series(rows, line, "seq").where(F.col("name").contains(currency)).select("month", "value")


#: Keys under which records give a day and a rate, first come first served: fixed values.
DAY_KEYS, RATE_KEYS = ("date", "datum"), ("2T repo", "2w repo", "repo", "Repo", "2T_repo", "rate")


def rate_series(rows: DataFrame, record: str, seq: str, days: tuple[str, ...] = DAY_KEYS, keys: tuple[str, ...] = RATE_KEYS) -> DataFrame:
    """Monthly rates of JSON records whose keys change: month and value (two digits); the last record of a month by seq counts.

    The day is dd.mm.yyyy or yyyy-mm-dd under the first of `days` that is not empty, the rate under the first of `keys` that
    is neither empty nor 0; numbers or texts, with decimal comma or point. What is no such record is left out.
    """
    v = F.try_parse_json(record)
    text = lambda k: F.try_variant_get(v, f"$['{k}']", "string")
    first = lambda ks, empty: F.coalesce(*[F.when(~text(k).isin(*empty), text(k)) for k in ks])
    read = rows.select(seq, first(days, ("",)).alias("day"), first(keys, ("", "0", "0.0")).alias("rate"))
    month = F.when(F.col("day").contains("."), F.concat_ws("-", F.split_part("day", F.lit("."), F.lit(3)), F.split_part("day", F.lit("."), F.lit(2)))).otherwise(F.substring("day", 1, 7))
    value = F.round(F.replace("rate", F.lit(","), F.lit(".")).try_cast("double"), 2)
    good = read.select(seq, month.alias("month"), value.alias("value")).where("month is not null and value is not null")
    return good.groupBy("month").agg(F.max_by("value", seq).alias("value"))


def nested_dataset(rows: DataFrame, group: str, order: str, columns: list[str], drop: tuple[str, ...] = ("rawText",)) -> DataFrame:
    """One row for each group with its messages as an ordered array of structs."""
    kept = [c for c in columns if c not in drop]
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in kept if c != order]))).alias("messages")).withColumn("n_messages", F.size("messages"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Answers by cache key: broken lines go, the last line of a key wins, fences are stripped."""
    from ..functions.text import strip_fences

    parsed = lines_of(spark, path).select("path", "seq", F.from_json("line", "cache_key string, response_text string").alias("r")).where("r.cache_key is not null")
    return parsed.groupBy("r.cache_key").agg(F.max_by("r.response_text", F.struct("path", "seq")).alias("t")).select("cache_key", strip_fences(F.col("t")).alias("response_text"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir; where that is unset, a local session (a test) gets an own folder and a cluster fails."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(rows: DataFrame, name: str) -> DataFrame:
    """Rows written once under `shared_path`, so that all that read them see the same rows in the same partitions."""
    path = shared_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

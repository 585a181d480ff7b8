"""Readers and writers: delimited files, structure lists, record files, plate matrices, JSON stores, Parquet tables.

All files are read and written by Spark's own readers and writers, so any store that Spark reaches will do. Schemas are
given or all columns are text; nothing is inferred by a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: ends a record of a structure-data file.
RECORD_END = "$$$$"


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A CSV file, or one with tabs if the path ends in .tsv; with a header. Without a schema all columns are text."""
    reader = spark.read.option("header", True).option("sep", "\t" if path.rstrip("/").endswith(".tsv") else ",")
    return (reader.schema(schema) if schema else reader).csv(path)


def valid_structure(text: Column) -> Column:
    """Whether a structure's text is there and could be one: square brackets close before others open, round ones are balanced, and
    every ring number outside of square brackets stands an even number of times. False for null."""
    bare = F.regexp_replace(text, r"\[[^\[\]]+\]", "*")
    signs = F.split(F.regexp_replace(bare, r"[^()]", ""), "")
    depth = F.aggregate(signs, F.lit(0), lambda d, c: F.when((d < 0) | (c == ""), d).when(c == "(", d + 1).otherwise(d - 1))
    rings = F.concat(F.regexp_extract_all(bare, F.lit(r"%(\d\d)"), 1), F.regexp_extract_all(F.regexp_replace(bare, r"%\d\d", ""), F.lit(r"(\d)"), 1))
    # a ring number in two digits is the one in a single digit
    names = F.transform(rings, lambda r: r.cast("int"))
    paired = F.forall(F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n)) % 2 == 0)
    return F.coalesce((F.trim(text) != "") & ~F.regexp_like(text, F.lit(r"\s")) & ~F.regexp_like(bare, F.lit(r"[\[\]]")) & (depth == 0) & paired, F.lit(False))


def read_structures(spark: SparkSession, path: str, column: str = "smiles") -> DataFrame:
    """A delimited file with a structure column under any case of its name, as ``smiles``, ``mol_id`` and the rest.

    Fails if the column is missing; ``is_valid`` is whether the text is there and its brackets and ring digits pair up.
    """
    df = read_delimited(spark, path)
    found = [c for c in df.columns if c.lower() == column.lower()]
    if not found:
        raise ValueError(f"no column {column} in {path}: {', '.join(df.columns)}")
    df = df.withColumnRenamed(found[0], "smiles").withColumn("is_valid", valid_structure(F.col("smiles")))
    return df if "mol_id" in df.columns else df.withColumn("mol_id", F.concat(F.lit("mol_"), F.monotonically_increasing_id().cast("string")))


def read_smi(spark: SparkSession, path: str) -> DataFrame:
    """Lines of structure and identifier; blank lines and those that start with # are skipped."""
    rows = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' AND NOT startswith(line, '#')")
    parts = F.split("line", r"\s+", 2)
    return rows.select(parts[0].alias("smiles"), F.get(parts, 1).alias("mol_id"))


def read_lines(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """A delimited text file without its first ``skip`` lines, as arrays of fields; for reader exports with a preamble."""
    whole = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    lines = whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return lines.filter((F.col("line_no") >= skip) & (F.trim("line") != "")).select("file", "line_no", F.split("line", ",").alias("fields"))


def read_plate_matrix(spark: SparkSession, path: str, n_columns: int = 12) -> DataFrame:
    """A plate matrix (row letter, then a value per column, with a header) as well, row, column and value."""
    from tesserae.operators.assay import matrix_to_long

    names = [str(i + 1) for i in range(n_columns)]
    schema = T.StructType([T.StructField("row", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    return matrix_to_long(read_delimited(spark, path, schema), "row", names)


def read_plate_long(spark: SparkSession, path: str, well: str = "well", value: str = "value") -> DataFrame:
    """Well names and values as well, row, column and value."""
    from tesserae.operators.assay import split_wells

    df = read_delimited(spark, path).select(F.col(well).alias("well"), F.expr(f"try_cast(`{value}` AS double)").alias("value"))
    return split_wells(df)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of structure-data files: title, the block up to M END, and the data fields as a map.

    Files are split at the record mark by the reader, so many tasks read one file and none holds it whole. An incomplete
    record has a null block.
    """
    return _records(spark.read.option("lineSep", RECORD_END).text(path))


def stream_records(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """The records of files as they come into a folder, as a stream; columns as of ``read_records``."""
    return _records(spark.readStream.option("lineSep", RECORD_END).option("maxFilesPerTrigger", files_a_batch).text(folder))


def convert_records(stream: DataFrame, folder: str, checkpoint: str, names: list[str]):
    """Write a stream of records as Parquet with chosen properties, all that is there now, and return the finished query; a second
    call goes on behind the first."""
    query = flattened(stream, names).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _records(rows: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("value", r"\r", ""), r"^\n", "")
    rows = rows.select(text.alias("t")).filter(F.trim(F.regexp_replace("t", r"\s+", " ")) != "")
    fields = F.regexp_extract_all("t", F.lit(r"(?m)^> +<([^>]+)>[^\n]*\n((?:(?!> +<)[^\n]+\n?)*)"), 1)
    values = F.transform(F.regexp_extract_all("t", F.lit(r"(?m)^> +<([^>]+)>[^\n]*\n((?:(?!> +<)[^\n]+\n?)*)"), 2), lambda x: F.rtrim(F.regexp_replace(x, r"\n+$", "")))
    block = F.when(F.col("t").contains("M  END"), F.concat(F.substring_index("t", "M  END", 1), F.lit("M  END")))
    unique = F.map_from_entries(F.transform(F.array_distinct(fields), lambda n: F.struct(n, F.get(values, F.array_position(fields, n).cast("int") - 1))))
    return rows.select(F.trim(F.substring_index("t", "\n", 1)).alias("title"), block.alias("block"), unique.alias("properties"))


def flattened(records: DataFrame, names: list[str]) -> DataFrame:
    """Chosen properties of records as columns."""
    return records.select("title", "block", *(F.try_element_at("properties", F.lit(n)).alias(n) for n in names))


def write_records(df: DataFrame, path: str, title: str, block: str, properties: list[str]) -> None:
    """Rows as structure-data records; properties that are null are left out."""
    fields = [F.when(F.col(p).isNotNull(), F.concat(F.lit(f"\n> <{p}>\n"), F.col(p).cast("string"), F.lit("\n"))).otherwise("") for p in properties]
    body = F.regexp_replace(F.col(block), r"^[^\n]*\n", "")
    text = F.concat(F.coalesce(F.col(title).cast("string"), F.lit("")), F.lit("\n"), body, *fields, F.lit("\n"))
    df.filter(F.col(block).isNotNull()).select(text.alias("value")).write.option("lineSep", RECORD_END + "\n").text(path)


def read_blocks(spark: SparkSession, folder: str, glob: str = "*.mol2") -> DataFrame:
    """A folder of one-structure files: path and text."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(folder).select(F.input_file_name().alias("path"), F.col("value").alias("block"))


def read_json(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """JSON documents by a schema; with ``field``, the elements of that array, one a row; a missing array gives none."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(F.explode(field).alias("_r")).select("_r.*") if field else df


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_catalogue(df: DataFrame, path: str, partition: str = "source") -> None:
    """The native catalogue: Parquet by source, so that a search in one source prunes the others."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


#: Registered data sets, their task and the columns of structure and target.
DATASETS = {
    "esol": ("regression", "smiles", "measured log solubility in mols per litre"),
    "freesolv": ("regression", "smiles", "expt"),
    "lipophilicity": ("regression", "smiles", "exp"),
    "bace": ("classification", "mol", "Class"),
    "bbbp": ("classification", "smiles", "p_np"),
    "tox21": ("classification", "smiles", "NR-AR"),
    "sider": ("classification", "smiles", "Hepatobiliary disorders"),
    "clintox": ("classification", "smiles", "CT_TOX"),
    "hiv": ("classification", "smiles", "HIV_active"),
}
#: Tasks of the property model and the range of their values.
TASKS = {"solubility": (-10.0, 2.0), "permeability": (-8.0, -4.0), "cyp3a4": (0.0, 1.0), "herg": (0.0, 1.0), "logd": (-2.0, 6.0), "pka": (0.0, 14.0)}


def datasets(spark: SparkSession) -> DataFrame:
    """The registry as a relation."""
    return spark.createDataFrame([(n, *v) for n, v in DATASETS.items()], "name string, task string, smiles_column string, target_column string")


def load_dataset(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """A registered data set's file as smiles and target; ValueError for an unknown name."""
    if name not in DATASETS:
        raise ValueError(f"unknown data set {name}: one of {', '.join(DATASETS)}")
    _, smiles, target = DATASETS[name]
    df = read_delimited(spark, f"{folder}/{name}.csv")
    return df.select(F.col(f"`{smiles}`").alias("smiles"), F.expr(f"try_cast(`{target}` AS double)").alias("target"))


# The absorption, distribution, metabolism and toxicity sets by the folder their files lie in.
ADMET = {
    "adme": (
        "caco2_wang", "bioavailability_ma", "lipophilicity_astrazeneca", "solubility_aqsoldb", "hia_hou", "pgp_broccatelli", "bbb_martins", "ppbr_az", "vdss_lombardo",
        "cyp2c9_veith", "cyp2d6_veith", "cyp3a4_veith", "cyp2c9_substrate_carbonmangels", "cyp2d6_substrate_carbonmangels", "cyp3a4_substrate_carbonmangels",
        "half_life_obach", "clearance_microsome_az", "clearance_hepatocyte_az",
    ),
    "tox": ("ld50_zhu", "herg", "ames", "dili", "skin_reaction"),
}


def admet_datasets(spark: SparkSession) -> DataFrame:
    """(name, kind, file) of the registered sets."""
    return spark.createDataFrame([(n, kind, f"{kind}/{n}.csv") for kind, names in ADMET.items() for n in names], "name string, kind string, file string")


def load_admet(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """A registered set's file under a folder, all columns as text; ValueError for an unknown name."""
    for kind, names in ADMET.items():
        if name in names:
            return read_delimited(spark, f"{folder}/{kind}/{name}.csv")
    raise ValueError(f"unknown data set {name}")


def checksums(spark: SparkSession, path: str, bits: int = 256) -> DataFrame:
    """(path, length, checksum): the SHA-2 of each file's bytes, a task a file; for files that fit a row (2 GB)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", bits).alias("checksum"))


def verified(spark: SparkSession, path: str, expected: dict[str, str], bits: int = 256) -> DataFrame:
    """(name, expected, checksum, matches): files by name against the checksums they should have; one that is missing doesn't match."""
    wanted = spark.createDataFrame(list(expected.items()), "name string, expected string")
    found = checksums(spark, path, bits).select(F.element_at(F.split("path", "/"), -1).alias("_n"), "checksum")
    return wanted.join(found, F.col("name") == F.col("_n"), "left").select("name", "expected", "checksum", F.coalesce(F.col("checksum") == F.lower("expected"), F.lit(False)).alias("matches"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database. With a whole-number column it is read by ``parts`` tasks, each a range between its least and
    greatest value; filters and columns are pushed down to the database."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if column is None:
        return reader.option("dbtable", table).load()
    ends = reader.option("query", f"SELECT MIN({column}) AS LO, MAX({column}) AS HI FROM {table}").load().first()
    reader = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", table)
    if ends[0] is None or ends[0] == ends[1]:
        return reader.load()
    return reader.option("partitionColumn", column).option("lowerBound", int(ends[0])).option("upperBound", int(ends[1]) + 1).option("numPartitions", parts).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", rows_a_batch: int = 1000, **options: str) -> None:
    """Rows to a table of a database, a connection for each task."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", rows_a_batch).options(**options).mode(mode).save()


def in_batches(df: DataFrame, work, schema: str, size: int = 1000) -> DataFrame:
    """``work`` (pandas rows in, pandas rows out) on at most ``size`` rows at a time, where they lie."""

    def run(batches):
        for rows in batches:
            for at in range(0, len(rows), size):
                yield work(rows.iloc[at : at + size])

    return df.mapInPandas(run, schema)

"""Files by name: listings, sidecars, sequences of parts, and moves that never lose a file."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def listing(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False, skip_folder: str | None = None) -> DataFrame:
    """`path, length` of the files whose name fits `pattern` (`*` for any run), in the folder or all below
    it, but for folders whose name ends with `skip_folder`. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    return files if skip_folder is None else files.where(~F.element_at(F.split("path", "/"), -2).endswith(skip_folder))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest prefix that both texts share."""
    n = F.least(F.length(a), F.length(b))
    return F.size(F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))


def common_suffix(a: Column, b: Column) -> Column:
    """Length of the longest suffix that both texts share."""
    return common_prefix(F.reverse(a), F.reverse(b))


def sidecars(bases: DataFrame, files: DataFrame, folder: str, base: str, name: str, kinds: tuple[str, ...]) -> DataFrame:
    """Each base with the files of its folder whose names begin with its name, ignoring case, and end in one
    of `kinds`: `folder, base, name, suffix`, the suffix being what follows the base, in lower case.

    Every prefix of a file's name is a key, so the join is on equal keys; names are short."""
    some = files.where(F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)).isin(*kinds)).withColumn("_n", F.explode(F.sequence(F.lit(1), F.length(name))))
    some = some.withColumn("_key", F.lower(F.substring(F.col(name), F.lit(1), F.col("_n"))))
    own = bases.select(folder, base, F.lower(base).alias("_key"))
    return own.join(some, [folder, "_key"]).select(folder, base, name, F.lower(F.substring(F.col(name), F.col("_n") + 1, F.length(name))).alias("suffix"))


def sequences(files: DataFrame, lists: DataFrame, folder: str, name: str, auto: bool = True) -> DataFrame:
    """Videos as sequences of parts: `folder, sequence, part, name`.

    First the lists: each of `lists(folder, sequence, parts)` claims its parts. Unclaimed files of a
    folder, if there are several, are one sequence where what lies between the common prefix and
    suffix of the first and the last name is at most two characters long in all names, shorter ones
    first, then by that; otherwise each is its own."""
    claimed = lists.select(folder, "sequence", F.posexplode("parts").alias("part", name))
    free = files.join(claimed.select(folder, F.lower(name).alias("_l")).distinct(), (files[folder] == claimed[folder]) & (F.lower(files[name]) == F.col("_l")), "left_anti").select(folder, name)
    ends = free.groupBy(folder).agg(F.min(name).alias("_a"), F.max(name).alias("_z"), F.count("*").alias("_files"))
    ends = ends.select(folder, "_a", "_files", common_prefix(F.col("_a"), F.col("_z")).alias("_p"), common_suffix(F.col("_a"), F.col("_z")).alias("_q"))
    rows = free.join(ends, folder).withColumn("_m", F.length(name) - F.col("_p") - F.col("_q"))
    fits = rows.groupBy(folder).agg((F.bool_and(F.col("_m").between(0, 2)) & (F.max("_files") > 1)).alias("_fits"))
    rows = rows.join(fits, folder).withColumn("_fits", F.col("_fits") & F.lit(auto))
    whole = F.concat(F.substring(F.col(name), F.lit(1), F.col("_p")), F.substring(F.col(name), F.length(name) - F.col("_q") + 1, F.length(name)))
    title = F.concat(F.regexp_replace(whole, r"\.[^.]*$", ""), F.lit(".vseq"))
    middle = F.substring(F.col(name), F.col("_p") + 1, F.col("_m"))
    grouped = rows.where("_fits").groupBy(folder).agg(F.array_sort(F.collect_list(F.struct(F.col("_m").alias("n"), F.lower(middle).alias("m"), F.col(name).alias("f")))).alias("_x"), F.min(title).alias("sequence"))
    grouped = grouped.select(folder, "sequence", F.posexplode("_x").alias("part", "_x")).select(folder, "sequence", "part", F.col("_x.f").alias(name))
    single = rows.where("not _fits").select(folder, F.col(name).alias("sequence"), F.lit(0).alias("part"), name)
    return claimed.unionByName(grouped).unionByName(single)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def save_replacing(df: DataFrame, path: str, attempts: int = 2) -> None:
    """Write a table beside `path`, then move it there in place of what was: a reader meets the old or the
    new table, or none for a moment, but never half of one. The move is tried twice."""
    spark = df.sparkSession
    temporary = path.rstrip("/") + ".tmp"
    df.write.mode("overwrite").parquet(temporary)
    files, target = _files(spark, path)
    for n in range(attempts):
        files.delete(target, True)
        if files.rename(spark._jvm.org.apache.hadoop.fs.Path(temporary), target):
            return
    raise OSError(f"could not move {temporary} to {path}")


def soft_delete(spark: SparkSession, path: str) -> str | None:
    """Move a file aside, as its name with the first 12 digits of its content's SHA-256; what is there already
    is the same file, and the new one goes. Returns the new path, none where there is no file."""
    files, source = _files(spark, path)
    if not files.exists(source):
        return None
    content = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    stem, dot, kind = path.rpartition(".")
    target = f"{stem or kind}.{hashlib.sha256(content).hexdigest()[:12]}{dot}{kind if stem else ''}"
    aside = spark._jvm.org.apache.hadoop.fs.Path(target)
    if files.exists(aside):
        files.delete(source, False)
    elif not files.rename(source, aside):
        raise OSError(f"could not move {path}")
    return target

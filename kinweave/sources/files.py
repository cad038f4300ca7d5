"""A folder of mixed files as raw records, with a report of what each gave.

Files are found and told apart in tables: the listing, the source of each file
and its place in the order are columns, and readers leave files out by
conditions on their names, so no list of files is in a plan or on the driver.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.functions.text import BLANK, col
from kinweave.operators.positions import with_positions
from kinweave.plans.lineage import cut
from kinweave.sources.blocks import csv_rows, file_uri, json_objects, listed_together, pieces
from kinweave.sources.csv_records import csv_field_records, header_places
from kinweave.sources.json_records import PROFILE_URL, ats_records, linkedin_records, url_records
from kinweave.sources.profile_tables import profile_records
from kinweave.sources.text_records import note_records, resume_records

#: Room for the records of one file in ``rec_seq``.
FILE_ROOM = 1 << 32
#: Characters of a file that tell its source where its name doesn't.
HEAD = 2000

# The source of each extension.
EXTENSIONS = {".csv": "recruiter_csv", ".json": "ats_json", ".pdf": "resume", ".docx": "resume", ".md": "resume"}
#: Those that hold no plain text; no codec for them is built.
NO_CODEC = (".pdf", ".docx")


def _ends(name: str | Column, ends: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(col(name)).endswith(e) for e in ends))


def kind_by_text(text: str | Column) -> Column:
    """``recruiter_csv``, ``ats_json`` or ``resume``, by the first 2000 characters."""
    head = F.ltrim(F.substring(col(text), 1, 2000))
    first = F.substring_index(head, "\n", 1)
    return (
        F.when(head.startswith("{") | head.startswith("["), "ats_json")
        .when(F.contains(first, F.lit(",")) & ~F.contains(first, F.lit("@")), "recruiter_csv")
        .otherwise("resume")
    )


def source_of(path: str | Column, text: str | Column) -> Column:
    """The source of a file, by extension, else by what it holds."""
    name = F.lower(col(path))
    by_name = [F.when(name.endswith(end), kind) for end, kind in EXTENSIONS.items()]
    return F.coalesce(*by_name, kind_by_text(text))


def _place(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """(place to read, URI) of a path; null if nothing is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return None
    whole = place.makeQualified(system.getUri(), system.getWorkingDirectory())
    as_it_is = re.sub(r"([\\{}\[\]*?])", r"\\\1", whole.toString())  # nothing in it is taken as a pattern
    return as_it_is, re.sub(r"^([^:/]+):///", r"\1:/", whole.toUri().toString()).rstrip("/")


def found_files(spark: SparkSession, asked: DataFrame, places: list[str]) -> DataFrame:
    """(n, path, given, uri) of the files at and below what was asked for; hidden files are left out.

    ``asked`` is (n, path, given, uri); a file is found under each path that leads to it.
    """
    with listed_together(spark):
        every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(places).select(file_uri().alias("file")).distinct()
    steps = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    return every.select("file", F.explode(above).alias("uri")).join(asked, "uri").select("n", "path", "given", F.col("file").alias("uri"))


def _whole(spark: SparkSession, places: list[str], where: Column | None = None) -> DataFrame:
    """(uri, value): whole files as texts, without a byte-order mark.  Compressed files are read as what they hold."""
    with listed_together(spark):
        texts = spark.read.option("recursiveFileLookup", True).text(places, wholetext=True)
    texts = texts if where is None else texts.filter(where)
    return texts.select(file_uri().alias("uri"), F.regexp_replace("value", "^\\uFEFF", "").alias("value"))


def _joined_lines(lines: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("block", "id", "piece")))
    return lines.groupBy("uri").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "\n").alias("value"))


def kinds_by_text(lines: DataFrame) -> DataFrame:
    """(uri, kind) of files by what they begin with; ``lines`` is as ``pieces`` gives it."""
    lines = lines.filter("block = 0")
    first = lines.groupBy("uri").agg(F.min("id").alias("first"))
    heads = lines.join(first, "uri").filter(F.col("id") < F.col("first") + HEAD).withColumn("piece", F.left("piece", F.lit(HEAD)))
    return _joined_lines(heads).select("uri", kind_by_text("value").alias("kind"))


def load(
    spark: SparkSession, paths: list[str] = (), notes: list[str] = (), profiles: list[str] = (), profile_urls: list[str] = (),
    users: DataFrame | None = None, repos: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(raw records, report): all sources in their order, and (path, source, n_records, warning) per source.

    A path is a file or a folder of files.  ``profiles`` may hold a JSON or other text or a profile
    link in place of a path.  ``users`` and ``repos`` are saved tables of public profiles and
    repositories.  The order of records is that of the arguments: files (of a folder by
    name), notes, profile exports, profile links, users by login.  What is absent or
    gives nothing is warned of in the report and fails nothing; so are files
    whose text only a codec could read (.pdf, .docx), which give no record.

    CSV and JSON files of those extensions are read in blocks, whatever their size.  Other files are
    one row each.
    """
    asked: list[tuple[int, str, str | None, str | None, str | None]] = []  # (n, path, given source, URI, text given in place of a path)
    places: dict[str, dict[int, str]] = {"paths": {}, "notes": {}, "profiles": {}}  # by n
    for kind, given, every in (("paths", None, paths), ("notes", "recruiter_notes", notes), ("profiles", "linkedin", profiles)):
        for path in every:
            inline = kind == "profiles" and (path.lstrip()[:1] in ("{", "[") or "\n" in path or re.fullmatch(PROFILE_URL + r"\S*", path.strip()))
            found = None if inline else _place(spark, path)
            if found:
                places[kind][len(asked)] = found[0]
            asked.append((len(asked), path, given, found[1] if found else None, path if inline else None))
    asked += [(len(asked) + k, url, "linkedin", None, url) for k, url in enumerate(profile_urls)]
    schema = "n int, path string, given string, uri string, value string"
    listed = spark.createDataFrame(asked, schema)
    every = listed.filter("value is not null").select("n", "path", "given", F.lit(None).cast("string").alias("uri"), "value")
    roots = list(dict.fromkeys(x for some in places.values() for x in some.values()))
    if roots:
        there = found_files(spark, listed.filter("uri is not null").select("n", "path", "given", "uri"), roots)
        every = every.unionByName(there, allowMissingColumns=True)
    by_name = reduce(lambda c, x: c.when(F.lower("uri").endswith(x[0]), x[1]), EXTENSIONS.items(), F)
    no_codec = F.coalesce(_ends("uri", NO_CODEC), F.lit(False))
    # Sorting by ranges reads its input twice; a folder is listed once.
    files = cut(with_positions(cut(every), ["n", F.coalesce("uri", F.lit(""))], "rank").withColumns({"kind": F.coalesce("given", by_name), "no_codec": no_codec}))

    # Each reader lists and opens only the paths that have files for it.
    kinds_of = {"unnamed": F.col("kind").isNull(), **{end: _ends("uri", (end,)) for end in (".csv", ".json", ".md")}}
    met_below = files.filter("given is null and uri is not null").groupBy("n").agg(*(F.max(c).alias(k) for k, c in kinds_of.items())).collect()
    below = {k: list(dict.fromkeys(places["paths"][r["n"]] for r in met_below if r[k])) for k in kinds_of}
    others, told = None, set()
    if below["unnamed"]:
        others = cut(pieces(spark, below["unnamed"], ~_ends("_metadata.file_name", tuple(EXTENSIONS))))
        kinds = kinds_by_text(others).withColumnRenamed("kind", "told")
        files = cut(files.withColumn("unnamed", F.col("kind").isNull()).join(kinds, "uri", "left").withColumn("kind", F.coalesce("kind", "told", F.lit("resume"))))
        told = {r["kind"] for r in files.filter("unnamed").select("kind").distinct().collect()}
    of = files.filter("not no_codec").select("n", "rank", "kind", "uri", "given", F.col("value").alias("inline"))
    met = lambda rows, kind: rows.join(of.filter(F.col("kind") == kind).filter("uri is not null"), "uri")
    seq = lambda pos: F.col("rank").cast("long") * F.lit(FILE_ROOM) + pos
    is_path = F.col("given").isNull()
    parts: list[DataFrame] = []
    if below[".json"]:
        ats = met(json_objects(pieces(spark, below[".json"], _ends("_metadata.file_name", (".json",)), "}")).withColumnRenamed("pos", "place"), "ats_json").filter(is_path)
        parts.append(ats_records(ats, seq(F.col("place"))))
    tables = [pieces(spark, below[".csv"], _ends("_metadata.file_name", (".csv",)))] if below[".csv"] else []
    if "recruiter_csv" in told:
        tables.append(others.join(files.filter("unnamed and kind = 'recruiter_csv'").select("uri").distinct(), "uri", "left_semi"))
    head = {"places": header_places(F.col("header"))}
    parts += [csv_field_records(met(csv_rows(lines, head), "recruiter_csv").filter(is_path), seq(F.col("number") - 1)) for lines in tables]
    if below[".md"]:
        parts.append(resume_records(met(_whole(spark, below[".md"], _ends("_metadata.file_name", (".md",))), "resume").filter(is_path), seq(F.lit(0))))
    if "ats_json" in told:
        parts.append(ats_records(met(_joined_lines(others), "ats_json").filter(is_path), seq(F.col("pos"))))
    if "resume" in told:
        parts.append(resume_records(met(_joined_lines(others), "resume").filter(is_path), seq(F.lit(0))))
    if places["notes"]:
        parts.append(note_records(met(_whole(spark, list(places["notes"].values())), "recruiter_notes"), seq(F.lit(0))))
    if not files.filter("kind = 'linkedin'").isEmpty():
        texts = of.filter("kind = 'linkedin' and inline is not null").select("uri", "rank", F.col("inline").alias("value"))
        if places["profiles"]:
            texts = texts.unionByName(met(_whole(spark, list(places["profiles"].values())), "linkedin").select("uri", "rank", "value"))
        texts = cut(texts)  # read three times
        is_json = F.ltrim("value", F.lit(BLANK)).rlike(r"^[{\[]") | F.coalesce(F.col("uri").endswith(".json"), F.lit(False))
        is_link = F.col("uri").isNull() & ~is_json & ~F.contains("value", F.lit("\n"))
        parts.append(linkedin_records(texts.filter(is_json), seq(F.col("pos"))))
        parts.append(url_records(texts.filter(is_link), seq(F.lit(0))))
        parts.append(resume_records(texts.filter(~is_json & ~is_link), seq(F.lit(0)), source="linkedin"))
    n_files = files.count()
    if users is not None:
        asked.append((len(asked), "users", "github", None, None))
        listed = spark.createDataFrame(asked, schema)
        repos = users.sparkSession.createDataFrame([], "login string, repo_rank int, language string") if repos is None else repos
        parts.append(profile_records(with_positions(users, ["login"], "_place"), repos, F.lit(n_files) * F.lit(FILE_ROOM) + F.col("_place")))
    # The report and what follows read the records, the files are read once.
    raw = cut(reduce(DataFrame.unionByName, parts)) if parts else spark.createDataFrame([], schemas.RAW_SCHEMA)
    return raw, source_report(listed, files, raw, n_files)


def source_report(asked: DataFrame, files: DataFrame, raw: DataFrame, n_files: int) -> DataFrame:
    """(path, source, n_records, warning) for the sources asked for (n, path, given); ``files`` has their files, by rank."""
    ranks = files.select("rank", "n").union(asked.filter("given = 'github'").select(F.lit(n_files).cast("long"), "n"))
    counts = raw.groupBy(F.expr(f"rec_seq div {FILE_ROOM}L").alias("rank")).agg(F.count(F.lit(1)).alias("records"))
    # Users go on beyond the room of one file, as the last source.
    counts = counts.withColumn("rank", F.least("rank", F.lit(n_files).cast("long"))).join(ranks, "rank").groupBy("n").agg(F.sum("records").alias("records"))
    there = files.groupBy("n").agg(F.min_by("kind", "rank").alias("kind"), F.sum(F.col("no_codec").cast("long")).alias("closed"))
    found = asked.join(there, "n", "left").join(counts, "n", "left")
    source = F.coalesce("kind", "given")
    absent = F.col("kind").isNull() & (F.coalesce("given", F.lit("")) != "github")
    folder_empty = absent & F.col("uri").isNotNull()
    return found.select(
        "path", source.alias("source"), F.coalesce("records", F.lit(0)).alias("n_records"),
        F.when(absent & ~folder_empty, F.concat(F.lit("input not found, skipped: "), "path"))
        .when(F.col("closed") > 0, F.concat(F.lit("no codec for "), F.col("closed").cast("string"), F.lit(" of the files, skipped: "), "path"))
        .when(F.col("records").isNull(), F.concat(F.lit("no records extracted from "), F.coalesce(source, F.lit("unknown")), F.lit(" source: "), "path")).alias("warning"),
    )

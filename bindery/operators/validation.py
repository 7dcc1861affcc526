"""Validation of bundles as joins over their files (job_id, path, content as text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.frames import settled
from bindery.functions.text import image_targets, link_targets, trim_space

#: Messages, and the keys that a log must hold.
MISSING, NO_CONCEPTS, BROKEN = "bundle incompleto: falta %s", "bundle inválido: conceptos/ vacío", 'link roto en index.md: "%s"'
ORPHAN, EMPTY, NO_HEADING = 'el concepto "%s" no está enlazado desde index.md', 'el concepto "%s" está vacío', 'el concepto "%s" no empieza con un encabezado'
SHORT, NO_ASSET, NO_KEY = 'el concepto "%s" casi no tiene contenido', 'el concepto "%s" referencia un recurso inexistente: "%s"', 'log.md sin el campo de trazabilidad "%s"'
TRACE_KEYS = ("SHA-256", "Formato", "Conceptos generados")


def resolved(path: Column) -> Column:
    """A relative path without empty, '.' and '..' steps; those that lead out of it stay in front."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def concepts(files: DataFrame) -> DataFrame:
    """job_id, name, content of each concept."""
    return files.filter(F.col("path").rlike(r"(?i)^conceptos/[^/]+\.md$")).select("job_id", base_name(F.col("path")).alias("name"), F.coalesce("content", F.lit("")).alias("content"))


def index_links(files: DataFrame) -> DataFrame:
    """job_id, pos, target, path of each local link of index.md."""
    found = files.filter("path = 'index.md'").select("job_id", F.posexplode(link_targets(F.col("content"))).alias("pos", "target"))
    return found.filter(~F.col("target").rlike("^https?://")).withColumn("path", resolved(F.col("target")))


def errors(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, err: the first thing that makes a bundle invalid, of all of `jobs` (job_id)."""
    held = files.groupBy("job_id").agg(
        F.max(F.col("path") == "index.md").alias("index"), F.max(F.col("path") == "log.md").alias("log"),
        F.max(F.col("path").startswith("conceptos/")).alias("folder"), F.max(F.col("path").rlike(r"(?i)^conceptos/[^/]+\.md$")).alias("concept"),
    )
    broken = index_links(files).join(files.select("job_id", "path"), ["job_id", "path"], "left_anti").groupBy("job_id").agg(F.min_by("target", "pos").alias("target"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    err = (
        F.when(no("index"), F.lit(MISSING % "index.md"))
        .when(no("log"), F.lit(MISSING % "log.md"))
        .when(no("folder"), F.lit(MISSING % "conceptos/"))
        .when(no("concept"), F.lit(NO_CONCEPTS))
        .when(F.col("target").isNotNull(), F.format_string(BROKEN, F.col("target")))
    )
    return jobs.select("job_id").join(held, "job_id", "left").join(broken, "job_id", "left").select("job_id", err.alias("err")).filter("err IS NOT NULL")


def orphans(files: DataFrame) -> DataFrame:
    """job_id, name of concepts to which no link of the index leads."""
    linked = index_links(files).select("job_id", base_name(F.col("path")).alias("name")).distinct()
    return concepts(files).select("job_id", "name").join(linked, ["job_id", "name"], "left_anti")


def concept_warnings(files: DataFrame) -> DataFrame:
    """job_id, name, ord, message of empty, headless and very short concepts."""
    body = trim_space(F.col("content"))
    words = F.size(F.regexp_extract_all(body, F.lit(r"(?U)\S+"), F.lit(0)))
    found = F.when(body == "", F.array(F.struct(F.lit(0).alias("ord"), F.format_string(EMPTY, "name").alias("message")))).otherwise(
        F.array_compact(F.array(
            F.when(~body.startswith("#"), F.struct(F.lit(0).alias("ord"), F.format_string(NO_HEADING, "name").alias("message"))),
            F.when(words < 3, F.struct(F.lit(1).alias("ord"), F.format_string(SHORT, "name").alias("message"))),
        ))
    )
    return concepts(files).select("job_id", "name", F.inline(found))


def missing_assets(files: DataFrame) -> DataFrame:
    """job_id, name, ord, ref of image references of concepts that lead to no file of the bundle."""
    refs = concepts(files).select("job_id", "name", F.posexplode(image_targets(F.col("content"))).alias("ord", "ref")).filter(~F.col("ref").rlike("^(?:https?://|data:)"))
    refs = refs.withColumn("path", resolved(F.concat(F.lit("conceptos/"), "ref")))
    return refs.join(files.select("job_id", "path"), ["job_id", "path"], "left_anti").select("job_id", "name", "ord", "ref")


def warnings(files: DataFrame) -> DataFrame:
    """job_id, check (4 to 7), name, ord, message of each warning."""
    row = lambda check, name, ord_, message: ("job_id", F.lit(check).alias("check"), name.alias("name"), ord_.cast("int").alias("ord"), message.alias("message"))
    none = F.lit(0)
    orphan = orphans(files).select(*row(4, F.col("name"), none, F.format_string(ORPHAN, "name")))
    poor = concept_warnings(files).select(*row(5, F.col("name"), F.col("ord"), F.col("message")))
    lost = missing_assets(files).select(*row(6, F.col("name"), F.col("ord"), F.format_string(NO_ASSET, "name", "ref")))
    keys = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(key).alias("key")) for k, key in enumerate(TRACE_KEYS)])
    log = files.filter("path = 'log.md'").select("job_id", F.col("content"), F.inline(keys)).filter(~F.col("content").contains(F.col("key")))
    log = log.select(*row(7, F.lit(""), F.col("ord"), F.format_string(NO_KEY, "key")))
    return orphan.unionByName(poor).unionByName(lost).unionByName(log)


def reports(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, level, warnings (in order of check, name, place), err, for each of `jobs`. An invalid bundle has no warnings."""
    files = settled(files)  # each check reads them
    listed = warnings(files).groupBy("job_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("check", "name", "ord", "message"))), lambda w: w["message"]).alias("warnings"))
    joined = jobs.select("job_id").join(errors(files, jobs), "job_id", "left").join(listed, "job_id", "left")
    level = F.when(F.col("err").isNotNull(), "invalid").when(F.size("warnings") > 0, "valid_with_warnings").otherwise("valid")
    none = F.array().cast("array<string>")
    return joined.select("job_id", level.alias("level"), F.when(F.col("err").isNotNull(), none).otherwise(F.coalesce("warnings", none)).alias("warnings"), "err")


def publishable(reports_: DataFrame) -> DataFrame:
    return reports_.filter("level <> 'invalid'")

"""File inventories: canonical formats, duplicates, version families, graph, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import classify, normalize_title, stable_id
from ..functions.types import strip
from ..session import materialize

#: Formats of one text, the best first; files of other formats are no siblings.
FORMAT_PRIORITY = ("md", "txt", "html", "htm", "mhtml")
#: The container that a suffix means; a text with a publishing date is an article_candidate, anything else a file.
CONTAINERS = {
    "text_document": ("md", "txt", "html", "htm", "mhtml"), "document": ("pdf", "docx"), "workbook": ("xls", "xlsx"), "table": ("csv", "tsv"),
    "image": ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tif", "tiff"), "recording": ("mp3", "wav", "m4a", "mp4", "mov", "mkv"),
}
#: Marks of copies and versions that may end a stem.
VERSION_MARKS = (r"\s*[\(（]\d+[\)）]\s*", r"\s*[-_ ]?(?:copy|副本)\s*\d*\s*", r"\s*[-_ ]?(?:final|最终版?|修订版?|最新版)\s*", r"\s*[-_ ]?v\d+(?:\.\d+)*\s*")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def container_type(path: Column, publish_date: Column | None = None) -> Column:
    """What kind of thing a file is, by its suffix and, for texts, whether a publishing date is known."""
    out = F.lit("file")
    for name, suffixes in CONTAINERS.items():
        label = F.lit(name)
        if name == "text_document" and publish_date is not None:
            label = F.when(publish_date.isNotNull(), "article_candidate").otherwise(name)
        out = F.when(suffix(path).isin(*suffixes), label).otherwise(out)
    return out


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def family_stem(path: Column) -> Column:
    """The normalised name without suffix and without the marks of copies and versions at its end, however many; never empty for them."""
    whole = strip(stem(path))
    least = F.regexp_extract(whole, f"(?i)^(\\S.*?)(?:{'|'.join(VERSION_MARKS)})+$", 1)
    kept = normalize_title(F.when(least != "", strip(least)).otherwise(whole))
    return F.when(kept != "", kept).otherwise(normalize_title(stem(path)))


def sibling_key(path: Column) -> Column:
    """Folder and normalised name, which the formats of one text share; any other file is alone."""
    folder = F.lower(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))
    return F.when(suffix(path).isin(*FORMAT_PRIORITY), F.concat(folder, F.lit("|"), normalize_title(stem(path)))).otherwise(F.lower(path))


def top_folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.get(F.split(path, "/"), F.lit(0))).otherwise("(root)")


def _dated(part: Column) -> Column:
    """The date that one folder or file name bears: YYYY-MM-DD, or --MM-DD without a year."""

    def found(pattern: str, year: bool) -> Column:
        number = lambda k: F.regexp_extract(part, pattern, k).try_cast("int")
        month, day = (number(k + year) for k in (1, 2))
        head = F.concat(F.regexp_extract(part, pattern, 1), F.lit("-")) if year else F.lit("--")
        text = F.concat(head, F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0"))
        return F.when(month.between(1, 12) & day.between(1, 31), text)

    return F.coalesce(
        found(r"(?<!\d)(20\d{2})[-_.年/](\d{1,2})[-_.月/](\d{1,2})日?(?!\d)", True),
        found(r"(?<!\d)(\d{1,2})月(\d{1,2})日(?!\d)", False),
        found(r"^(\d{2})(\d{2})$", False),
        found(r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)", True),
    )


def collection_date(path: Column) -> Column:
    """The date in the file's stem or, the innermost first, in one of the three folders around it."""
    folders = F.slice(F.reverse(F.split(path, "/")), 2, 3)
    return F.coalesce(_dated(strip(stem(path))), *(_dated(strip(F.get(folders, F.lit(k)))) for k in range(3)))


def priority(path: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(s) for s in FORMAT_PRIORITY)), suffix(path)), F.lit(0)), F.lit(99))


def mark_canonical(files: DataFrame) -> DataFrame:
    """files (path, sha256, ...) with canonical (best format of its siblings) and duplicate_of (first canonical file of equal bytes)."""
    siblings = Window.partitionBy(sibling_key(F.col("path"))).orderBy(priority(F.col("path")), F.lower("path"), "path")
    marked = files.withColumn("canonical", F.row_number().over(siblings) == 1)
    same = Window.partitionBy("sha256", "canonical").orderBy(F.lower("path"), "path")
    first = F.first("path").over(same)
    return marked.withColumn("duplicate_of", F.when(F.col("canonical") & F.col("sha256").isNotNull() & (first != F.col("path")), first))


def family_representatives(files: DataFrame) -> DataFrame:
    """The latest, then largest, then last-named canonical file of every version family."""
    w = Window.partitionBy(family_stem(F.col("path"))).orderBy(F.desc("modified"), F.desc("bytes"), F.desc("path"))
    return files.filter("canonical and duplicate_of is null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def inventory_summary(files: DataFrame) -> DataFrame:
    """Files by container and by suffix, in one pass of grouping sets."""
    f = files.select(container_type(F.col("path")).alias("container"), suffix(F.col("path")).alias("suffix"), "canonical", "duplicate_of")
    out = f.groupingSets([["container"], ["suffix"], []], "container", "suffix").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("files"), F.count_if("canonical").alias("canonical_files"), F.count("duplicate_of").alias("duplicates"))
    return out


#: What files of a role are called until someone looks at them.
FAMILIES = {
    "performance_table": "表现数据", "tabular_data": "待筛查表格", "visual_layout": "视觉资产", "audience_voice": "评论与用户声音", "audio_video": "音视频课程或演示", "unclassified": "待识别资料",
}
OTHER_TEXTS = "其他正文"


def provisional_family(business_role: Column, evidence_role: Column, category: Column) -> Column:
    """The business role, else a text's category, else the name of the evidence role; empty values count as absent."""
    given = lambda c: F.nullif(c, F.lit(""))
    role = F.coalesce(given(evidence_role), F.lit("unclassified"))
    named = F.when(role == "content_text", F.coalesce(given(category), F.lit(OTHER_TEXTS)))
    for key, name in FAMILIES.items():
        named = named.when(role == key, name)
    return F.coalesce(given(business_role), named.otherwise(role))


def canonical_counts(files: DataFrame, label: Column, otherwise: str) -> DataFrame:
    """(label, files) of the canonical files; a file that doesn't say whether it is canonical is."""
    return files.filter(F.coalesce("canonical", F.lit(True))).groupBy(F.coalesce(F.nullif(label, F.lit("")), F.lit(otherwise)).alias("label")).agg(F.count(F.lit(1)).alias("files"))


def star_edges(rows: DataFrame, key: Column, node: str, kind: str, order: list[str]) -> DataFrame:
    """Edges from the first node of each key to the others: as many as nodes, never a pair for every two."""
    keyed = rows.select(key.alias("_key"), node, *[o for o in order if o != node]).filter("_key is not null")
    hub = F.first(node).over(Window.partitionBy("_key").orderBy(*order))
    edges = keyed.withColumn("source", hub).filter(F.col("source") != F.col(node))
    return edges.select(stable_id("edge-", 16, F.lit(kind), F.col("source").cast("string"), F.col(node).cast("string")).alias("edge_id"), "source", F.col(node).alias("target"), F.lit(kind).alias("kind"))


def incremental_manifest(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, action, reason): reuse what is unchanged in bytes, parser and metric version and complete, else parse."""
    old = before.select("path", *(F.col(c).alias(f"old_{c}") for c in ("sha256", "parser", "metrics", "status")))
    both = now.join(old, "path", "left")
    reason = (
        F.when(F.col("old_sha256").isNull(), "new_file").when(F.col("old_sha256") != F.col("sha256"), "content_changed").when(F.col("old_parser") != F.col("parser"), "parser_changed")
        .when(F.col("old_metrics") != F.col("metrics"), "metrics_changed").when(F.col("old_status") != "complete", "previous_incomplete").otherwise("unchanged")
    )
    return both.select("path", F.when(reason == "unchanged", "reuse").otherwise("parse").alias("action"), reason.alias("reason"))


def removed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    return before.select("path").join(now.select("path"), "path", "left_anti")


def role(path: Column, title: Column, rules: list[tuple[str, str]], otherwise: str = "unclassified") -> Column:
    """The first role whose pattern matches the path or the title."""
    return classify(F.concat_ws(" ", path, title), rules, otherwise)


#: What a file is inside a project, by its path.
ARTIFACT_ROLES = [
    ("test", r"(^|/)tests?/|test_[^/]*\.py$|\.spec\.[jt]s$"), ("documentation", r"(^|/)(docs?|references)/|readme|\.md$"), ("configuration", r"\.(toml|ya?ml|ini|cfg|json)$|(^|/)\.[^/]+$"),
    ("code", r"\.(py|js|ts|java|scala|r|sh|sql)$"), ("sample", r"(^|/)(samples?|examples?|fixtures?)/"), ("output", r"(^|/)(out|outputs?|results?|dist|build)/"),
]


def project_profile(files: DataFrame, project: str, path: str = "path") -> DataFrame:
    """Files of every project by role, and whether code, tests, samples and outputs are there."""
    marked = files.withColumn("_role", classify(F.col(path), ARTIFACT_ROLES, "other"))
    names = [name for name, _ in ARTIFACT_ROLES]
    return marked.groupBy(project).agg(F.count(F.lit(1)).alias("files"), *(F.count_if(F.col("_role") == n).alias(n) for n in [*names, "other"]), F.bool_or(F.col("_role") == "code").alias("code_backed"), F.bool_or(F.col("_role") == "test").alias("test_backed"))


def project_roots(paths: DataFrame, path: str, strong: list[str], weak: list[str]) -> DataFrame:
    """Folders that hold a strong marker file with none above them, and those of weak markers outside of these."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    name = F.element_at(F.split(path, "/"), -1)
    found = paths.select(folder.alias("root"), name.isin(strong).alias("is_strong")).filter(name.isin(strong + weak)).groupBy("root").agg(F.bool_or("is_strong").alias("strong"))

    def above(rows: DataFrame) -> DataFrame:
        """Every proper ancestor folder of each root."""
        parts = F.split("root", "/")
        ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        return rows.select("root", F.explode(F.array_append(ups, F.lit(""))).alias("up")).filter("up <> root")

    firm = found.filter("strong").select("root")
    inner = above(firm).join(firm.select(F.col("root").alias("up")), "up").select("root").distinct()
    outermost = firm.join(inner, "root", "left_anti")
    loose = found.filter("not strong").select("root")
    covered = above(loose).join(outermost.select(F.col("root").alias("up")), "up").select("root").distinct()
    return outermost.withColumn("marker", F.lit("strong")).unionByName(loose.join(covered, "root", "left_anti").withColumn("marker", F.lit("weak")))


#: What a numbered page ends in, how a screenshot names its moment, and what exports add to their names.
PAGE_END = r"(?i)(?:[-_ ]?(?:page|p|截图|第)[-_ ]*\p{Nd}+\s*(?:页)?|[\(（]\p{Nd}+[\)）])$"
CAPTURE = r"(?i)(?:screenshot|screen[_ -]?shot|截图)[_ -]?([0-9]{4}[-_][0-9]{2}[-_][0-9]{2})[_ -]?([0-9]{2})[0-9]{4}"
EXPORT_MARKS = (
    r"(?<!\d)20\d{2}[-_.年/]?\d{1,2}[-_.月/]?\d{1,2}(?:日)?(?!\d)", r"(?<!\d)\d{1,2}月\d{1,2}日(?!\d)", r"(?<!\d)20\d{6}(?!\d)", r"(?<!\d)\d{10,}(?!\d)", r"(?i)(?:^|[-_ ])(?:export|download|data)[-_ ]*\d+(?=$|[-_ ])",
)


def _parent(path: Column) -> Column:
    return F.lower(F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(""))


def export_stem(path: Column) -> Column:
    """The file's name without dates, long numbers and export marks: a hint of a repeated export."""
    value = stem(path)
    for mark in EXPORT_MARKS:
        value = F.regexp_replace(value, mark, " ")
    return F.coalesce(F.nullif(normalize_title(value), F.lit("")), F.lit("unnamed_export"))


def sequence_stem(path: Column) -> Column:
    """The name before a page number at its end; null for names without one."""
    whole = strip(stem(path))
    head = strip(F.regexp_replace(whole, PAGE_END, ""))
    return F.when((head != whole) & (head != ""), F.nullif(normalize_title(head), F.lit("")))


def capture_session(path: Column) -> Column:
    """Folder, day and hour of a screenshot whose name tells its moment; else null."""
    day = F.regexp_extract(stem(path), CAPTURE, 1)
    return F.when(day != "", F.concat_ws("|", _parent(path), F.replace(day, F.lit("_"), F.lit("-")), F.regexp_extract(stem(path), CAPTURE, 2)))


def capture_units(images: DataFrame, path: str = "path") -> DataFrame:
    """path, unit (its first path in order) and members: screenshots of one hour and folder, and numbered pages of one name and folder, are one unit each; other images are units of their own.

    A unit's members stay rows: none is gathered into an array, however many there are.
    """
    file = F.col(path)
    day, whole, head = F.col("_day"), F.col("_whole"), F.col("_head")
    # each step is bound by a projection of its own, so that a pattern is tried once on a name
    named = images.select(path).distinct().withColumn("_stem", stem(file)).withColumn("_day", F.regexp_extract("_stem", CAPTURE, 1))
    named = named.withColumn("_whole", F.when(day == "", strip(F.col("_stem")))).withColumn("_head", strip(F.regexp_replace(whole, PAGE_END, "")))
    named = named.withColumn("_name", F.nullif(normalize_title(F.when((head != whole) & (head != ""), head)), F.lit("")))
    session = F.when(day != "", F.concat_ws("|", _parent(file), F.replace(day, F.lit("_"), F.lit("-")), F.regexp_extract("_stem", CAPTURE, 2)))
    numbered = F.when(F.col("_name").isNotNull(), F.concat_ws("|", _parent(file), F.lit("page"), F.col("_name")))
    # written once: units and members both read the keys
    keyed = materialize(named.select(path, F.coalesce(session, numbered, F.concat(F.lit("\0"), file)).alias("_key")), "capture-keys")
    units = keyed.groupBy("_key").agg(F.min(F.struct(F.lower(path).alias("low"), file.alias("first"))).alias("u"), F.count(F.lit(1)).alias("members"))
    return keyed.join(units, "_key").select(path, F.col("u.first").alias("unit"), "members")

"""Code metadata: calls, callers, affected files, structure, and the texts that are embedded for code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by file extension, and directories that hold no sources.
LANGUAGES = {
    "java": "java", "py": "python", "go": "go", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "vue": "vue", "kt": "kotlin", "rs": "rust",
    "c": "c", "cpp": "cpp", "h": "c", "cs": "csharp", "rb": "ruby", "php": "php", "sql": "sql", "sh": "shell",
}
SKIPPED = ("node_modules", "target", "dist", "build", ".next", "vendor", "__pycache__")
INCIDENT_WORDS = ("fix", "bug", "hotfix", "rollback", "revert", "incident", "crash", "error", "failure", "故障", "修复")


def simple_name(call: Column) -> Column:
    """``a.b.C.m(X)`` -> ``m``."""
    return F.substring_index(F.substring_index(call, "(", 1), ".", -1)


def call_edges(units: DataFrame) -> DataFrame:
    """(project_id, caller_file, method_name), each once; enriched calls win where a unit has any."""
    calls = F.when(F.size(F.coalesce("enriched_calls", F.array().cast("array<string>"))) > 0, F.col("enriched_calls")).otherwise(F.col("calls"))
    return units.select("project_id", F.col("file_path").alias("caller_file"), F.explode(calls).alias("call")).select("project_id", "caller_file", simple_name(F.col("call")).alias("method_name")).where(F.length("method_name") > 0).distinct()


def callers(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that call each (project_id, method_name) of the same project."""
    return methods.select("project_id", "method_name").distinct().join(edges, ["project_id", "method_name"]).select("project_id", "method_name", "caller_file").distinct()


def ripple(changed: DataFrame, units: DataFrame, edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(project_id, file): the changed files and, one level out, the files that call their methods, those that the files
    had ``before`` included."""
    both = units if before is None else units.select("project_id", "file_path", "method_name").unionByName(before.select("project_id", "file_path", "method_name"))
    methods = both.join(changed, ["project_id", "file_path"], "left_semi").where(F.col("method_name").isNotNull())
    out = callers(methods, edges).select("project_id", F.col("caller_file").alias("file"))
    return changed.select("project_id", F.col("file_path").alias("file")).union(out).distinct()


def without_files(units: DataFrame, gone: DataFrame) -> DataFrame:
    """Units that stay when files (project_id, file_path) are deleted."""
    return units.join(gone, ["project_id", "file_path"], "left_anti")


def impact(changed: DataFrame, units: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """Per method of a changed file: how many files of any project call one of its name, and the first ``most`` of them."""
    methods = units.join(changed, ["project_id", "file_path"], "left_semi").where(F.col("method_name").isNotNull()).select("project_id", "file_path", "method_name").distinct()
    found = methods.join(edges.select("method_name", "caller_file").distinct(), "method_name").groupBy("project_id", "file_path", "method_name").agg(F.array_sort(F.collect_set("caller_file")).alias("files"))
    return found.select("project_id", F.concat("file_path", F.lit("#"), "method_name").alias("changed_method"), F.size("files").alias("n_callers"), F.array_join(F.slice("files", 1, most), "|").alias("first_callers"))


def enclosing(units: DataFrame, points: DataFrame, lines: int = 64) -> DataFrame:
    """Interval join within a file: the innermost unit whose lines hold each point (ties: the later start, the smaller id).

    Units are spread over the stretches of ``lines`` lines they reach into and meet only the points of the same stretch,
    so a large file is many small groups."""
    stretch = lambda c: F.floor(F.col(c) / lines)
    spread = units.where("start_line <= end_line").withColumn("stretch", F.explode(F.sequence(stretch("start_line"), stretch("end_line"))))
    inside = points.withColumn("stretch", stretch("line")).join(spread, ["project_id", "file_path", "stretch"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), (-F.col("start_line")).alias("s"), F.col("unit_id"))).alias("b")
    return inside.groupBy("project_id", "file_path", "point_id", "line").agg(best).select("project_id", "file_path", "point_id", "line", F.col("b.unit_id").alias("unit_id"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.get(F.array(F.try_element_at(known, extension(path))), F.lit(0)), extension(path))


def is_source(path: Column) -> Column:
    return ~path.rlike(r"(^|/)(\.[^/]+|" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")(/|$)")


def module_of(path: Column, root: str | None = None) -> Column:
    """The package part behind ``src/main/<language>/<root>`` (or ``src/test``), or ``cmd/<name>``; else null. A repository
    of another layout names the folder that holds its modules as ``root``."""
    if root:
        return F.nullif(F.regexp_extract(path, rf"(?:^|/){root}/([^/]+)/", 1), F.lit(""))
    source = F.regexp_extract(path, r"(?:^|/)src/(?:main|test)/[^/]+/[^/]+/([^/]+)(?=/|$)", 1)
    command = F.regexp_extract(path, r"(?:^|/)(cmd/[^/]+)", 1)
    return F.coalesce(F.nullif(source, F.lit("")), F.nullif(command, F.lit("")))


#: Build tools by file name, in the order in which they are looked for.
BUILD_FILES = {
    "pom.xml": "Maven", "build.gradle": "Gradle", "build.gradle.kts": "Gradle", "go.mod": "Go Mod", "package.json": "npm", "Cargo.toml": "Cargo", "requirements.txt": "pip", "pyproject.toml": "Poetry", "CMakeLists.txt": "CMake",
}
GO_FRAMEWORKS = {"gin": "Gin", "beego": "Beego", "fiber": "Fiber", "echo": "Echo"}


def stacks(files: DataFrame) -> DataFrame:
    """(project_id, build_tool, framework, entry_points) of files (project_id, path, text): what their names and contents
    tell, without build files by the main language."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rank = F.coalesce(*[F.when(name == f, F.lit(i)) for i, f in enumerate(BUILD_FILES)])
    tool = F.get(F.array(*[F.lit(t) for t in BUILD_FILES.values()]), F.min("rank"))
    boot = F.lower(name).rlike("springbootapplication|springapplication") | ((name == "pom.xml") & F.contains("text", F.lit("spring-boot-starter")))
    go = F.when(extension(F.col("path")) == "go", F.coalesce(*[F.when(F.contains("text", F.lit(w)), F.lit(i)) for i, w in enumerate(GO_FRAMEWORKS)]))
    language = language_of(F.col("path"))
    main = F.when((language == "java") & F.contains("text", F.lit("public static void main")), "main").when((language == "java") & F.contains("text", F.lit("@SpringBootApplication")), "application").when((language == "go") & F.contains("text", F.lit("func main()")), "main")
    rows = files.select("project_id", "path", rank.alias("rank"), boot.alias("boot"), go.alias("go"), language.alias("language"), main.alias("main"))
    spoken = rows.groupBy("project_id", "language").agg(F.count_distinct("path").alias("n")).groupBy("project_id").agg(F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("language"))
    by = rows.groupBy("project_id").agg(tool.alias("build_tool"), F.coalesce(F.bool_or("boot"), F.lit(False)).alias("boot"), F.min("go").alias("go"), F.count_distinct(F.when(F.col("main").isNotNull(), F.col("path"))).alias("entry_points"))
    java = F.when(F.col("boot"), "Spring Boot").otherwise("Java")
    named = F.coalesce(F.get(F.array(*[F.lit(f) for f in GO_FRAMEWORKS.values()]), F.col("go")), F.lit("Go"))
    bare = F.when(F.col("language") == "java", java).when(F.col("language") == "python", "Python").when(F.col("language").isin("javascript", "typescript"), "Node.js").when(F.col("language") == "go", "Go")
    framework = F.when(F.col("build_tool").isin("Maven", "Gradle"), java).when(F.col("build_tool") == "Go Mod", named).when(F.col("build_tool").isNull(), bare)
    return by.join(spoken, "project_id").select("project_id", "build_tool", framework.alias("framework"), "entry_points")


def vector_text(units: DataFrame) -> Column:
    """Comment, signature or name, calls and the start of the body, a line each."""
    line = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(c, F.lit("\n"))).otherwise(F.lit(""))
    calls = F.when(F.size(F.coalesce("calls", F.array().cast("array<string>"))) > 0, F.concat(F.lit("calls: "), F.array_join("calls", ", "), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(line(F.col("comment")), line(F.coalesce("signature", "method_name")), calls, line(F.substring("body", 1, 200)))


def incident_severity(message: Column) -> Column:
    """Null where a message names no incident, else CRITICAL, MINOR or MAJOR (words match inside words, too)."""
    low = F.lower(message)
    return F.when(low.rlike("|".join(INCIDENT_WORDS)), F.when(low.rlike("critical|urgent|p0|严重|紧急"), "CRITICAL").when(low.rlike("typo|minor|docs|style|轻微"), "MINOR").otherwise("MAJOR"))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end of a text, both counted from 1 and clamped; null where nothing is left."""
    lines = F.split(text, "\n", -1)
    a, b = F.greatest(F.lit(1), start), F.least(F.size(lines), end)
    return F.when(a <= b, F.array_join(F.slice(lines, a, b - a + 1), "\n"))

"""Workspaces on disk: discovery, project files, packages, instructions, git feeds.

The driver lists folders (with pruning, which a recursive file source can't do); contents are read,
hashed and parsed by tasks.
"""

from __future__ import annotations

import hashlib
import os
import subprocess
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import rules
from cairn.functions.identity import stable_key
from cairn.operators.common import first_of, nearest_folder

PRUNED = {".git", ".vs", ".idea", "node_modules", "bin", "obj", "dist", "out"}


def walk(root: str) -> Iterator[str]:
    """Relative paths of files, depth first in name order; links and unreadable folders are skipped."""
    todo = [""]
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            continue
        below = []
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink():
                continue
            if e.is_dir():
                low = e.name.lower()
                if low not in PRUNED and not low.startswith(("bin_", "obj_")):
                    below.append(path)
            else:
                yield path
        todo += reversed(below)


def discover(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root_path, relative_path, full_path, language, is_generated, content_hash, size_bytes, content, stable_key) of admitted files.

    A file under nested roots belongs to the longest of them.
    """
    for r in roots:
        if not os.path.isdir(r):
            raise FileNotFoundError(r)
    roots = sorted({os.path.abspath(r) for r in roots})
    rows = [(r, p, os.path.join(r, p)) for r in roots for p in walk(r)]
    x = spark.createDataFrame(rows, "root_path string, relative_path string, full_path string").where(rules.admitted(F.col("relative_path")))
    x = first_of(x, ["full_path"], [F.desc(F.length("root_path"))])

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            contents = []
            for p in b.full_path:
                with open(p, "rb") as f:
                    contents.append(f.read())
            b["content"] = contents
            yield b

    x = x.mapInPandas(load, "root_path string, relative_path string, full_path string, content binary")
    path = F.col("relative_path")
    key = "workspace:" + hashlib.sha256("\n".join(roots).encode()).hexdigest()
    return x.withColumns({"language": rules.language(path), "is_generated": rules.is_generated(path), "content_hash": F.sha2("content", 256), "size_bytes": F.length("content").cast("bigint"), "stable_key": stable_key("file", F.lit(key), "root_path", "relative_path")})


def project_rows(content: bytes) -> dict:
    """What a .csproj says: sdk, target frameworks, output type, test flag, references with lines, packages."""
    text = content.decode("utf-8-sig", errors="replace")
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return {"sdk": "", "target_frameworks": "", "output_type": "", "is_test": False, "references": [], "packages": []}
    lines = text.split("\n")

    def line_of(needle: str) -> int:
        return next((i for i, x in enumerate(lines, 1) if needle in x), 1)

    def value(*names: str) -> str:
        return next((e.text.strip() for e in root.iter() if e.tag.rpartition("}")[2] in names and e.text), "")

    packages = [e.get("Include", "") for e in root.iter() if e.tag.rpartition("}")[2] == "PackageReference"]
    refs = [e.get("Include", "") for e in root.iter() if e.tag.rpartition("}")[2] == "ProjectReference"]
    test = value("IsTestProject").lower() == "true" or any(p.lower().startswith(("xunit", "nunit", "mstest", "microsoft.net.test.sdk")) for p in packages)
    return {"sdk": root.get("Sdk", ""), "target_frameworks": value("TargetFrameworks", "TargetFramework"), "output_type": value("OutputType"), "is_test": test, "references": [(r, line_of(r)) for r in refs], "packages": packages}


PROJECTS = "relative_path string, sdk string, target_frameworks string, output_type string, is_test boolean, references array<struct<path:string,line:int>>, packages array<string>"


def projects(files: DataFrame) -> DataFrame:
    """Projects and their kind, of the .csproj files of a discovery."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [{"relative_path": p, **project_rows(c)} for p, c in zip(b.relative_path, b.content)]
            if out:
                x = pd.DataFrame(out)
                x["references"] = [[{"path": p, "line": n} for p, n in r] for r in x["references"]]
                yield x

    x = files.where(F.lower("relative_path").endswith(".csproj")).select("relative_path", "content").mapInPandas(run, PROJECTS)
    folder = F.regexp_replace("relative_path", "/?[^/]*$", "")
    return x.withColumns({"folder": folder, "project_kind": rules.project_kind(F.col("sdk"), F.col("output_type"), F.col("is_test")), "name": F.regexp_extract("relative_path", "([^/]*)\\.csproj$", 1)})


def normal_path(path: Column) -> Column:
    """Without empty and . segments, and each .. taken with the one before it. Backslashes are characters like others."""

    def add(out: Column, s: Column) -> Column:
        back = (s == "..") & (F.size(out) > 0) & ~F.coalesce(F.element_at(F.slice(out, -1, 1), 1) == "..", F.lit(False))
        return F.when(s.isin("", "."), out).when(back, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(F.concat(out, F.array(s)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), add), "/")


def project_references(found: DataFrame) -> DataFrame:
    """(source, target, target_path, line): references by normalised path; target is null if no project is there."""

    x = found.select(F.col("relative_path").alias("source"), "folder", F.explode("references").alias("r"))
    x = x.select("source", normal_path(F.concat_ws("/", F.nullif("folder", F.lit("")), "r.path")).alias("target_path"), F.col("r.line").alias("line"))
    known = found.select(F.col("relative_path").alias("target_path"), F.col("relative_path").alias("target"))
    return x.join(known, "target_path", "left").select("source", "target", "target_path", "line")


def file_owners(files: DataFrame, found: DataFrame) -> DataFrame:
    own = found.select(F.col("relative_path").alias("project"), "folder")
    return nearest_folder(files.select("relative_path"), "relative_path", ["relative_path"], own, "folder")


def facets(found: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """(project, facet): roles by SDK, packages, output and source markers (project with AddHostedService)."""
    has = lambda *names: F.exists("packages", lambda p: F.lower(p).rlike("^(" + "|".join(names) + ")"))
    cases = {
        "test": F.col("is_test"),
        "aspnet_core_host": F.col("sdk").contains("Sdk.Web"),
        "worker": F.col("sdk").contains("Sdk.Worker"),
        "application": F.lower("output_type").isin("exe", "winexe") | F.col("sdk").contains("Sdk.Web") | F.col("sdk").contains("Sdk.Worker"),
        "ef_core": has("microsoft\\.entityframeworkcore"),
        "database": has("microsoft\\.entityframeworkcore", "dapper", "microsoft\\.data\\.", "npgsql", "mysql"),
    }
    out = found.select(F.col("relative_path").alias("project"), F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in cases.items()]), lambda x: x.isNotNull())).alias("facet"))
    if markers is not None:
        out = out.unionByName(markers.select("project", F.lit("worker").alias("facet")))
    return out.distinct()


def package_scripts(files: DataFrame) -> DataFrame:
    """(relative_path, name, script, command, kind) of package.json files."""
    x = files.where(F.lower("relative_path").rlike("(^|/)package\\.json$")).select("relative_path", F.decode("content", "UTF-8").alias("j"))
    scripts = F.from_json(F.get_json_object("j", "$.scripts"), "map<string,string>")
    x = x.select("relative_path", F.get_json_object("j", "$.name").alias("name"), F.explode(scripts).alias("script", "command"))
    return x.withColumn("kind", rules.script_kind(F.col("script"))).where("kind is not null")


def global_settings(files: DataFrame) -> DataFrame:
    """(relative_path, key, value) of global.json."""
    x = files.where(F.lower("relative_path").rlike("(^|/)global\\.json$")).select("relative_path", F.decode("content", "UTF-8").alias("j"))
    keys = ["sdk.version", "sdk.rollForward", "sdk.allowPrerelease"]
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.get_json_object("j", f"$.{k}").alias("value")) for k in keys])
    return x.select("relative_path", F.explode(rows).alias("r")).select("relative_path", "r.key", "r.value").where("value is not null")


def instructions(files: DataFrame) -> DataFrame:
    """Instruction files for contributors and their precedence by depth."""
    name = F.lower(rules.file_name(F.col("relative_path")))
    folder = F.regexp_replace("relative_path", "[^/]*$", "")
    return files.where(name.isin("agents.md", "claude.md", "contributing.md", "copilot-instructions.md")).select("relative_path", rules.rule_precedence(F.lit(100), folder).alias("precedence"))


def solutions(files: DataFrame) -> DataFrame:
    path = F.lower("relative_path")
    return files.where(path.endswith(".sln") | path.endswith(".slnx")).select("relative_path", F.regexp_extract("relative_path", "([^/]*)\\.slnx?$", 1).alias("name"), rules.extension(F.col("relative_path")).alias("format"))


def parse_porcelain(output: str) -> list[tuple[str, str, str | None]]:
    """(code, path, old path) of `status --porcelain=v1 -z`: renames and copies take the next field."""
    parts, out, i = output.split("\0"), [], 0
    while i < len(parts):
        entry = parts[i]
        i += 1
        if len(entry) < 4:
            continue
        code, path, old = entry[:2], entry[3:], None
        if ("R" in code or "C" in code) and i < len(parts):
            old = parts[i]
            i += 1
        out.append((code, path, old))
    return out


def parse_name_status(output: str) -> list[tuple[str, str, str | None]]:
    """(code, path, old path) of `diff --name-status -z`."""
    parts, out, i = output.split("\0"), [], 0
    while i + 1 < len(parts):
        code = parts[i]
        if code[:1] in "RC" and i + 2 < len(parts):
            out.append((code[:1], parts[i + 2], parts[i + 1]))
            i += 3
        elif code:
            out.append((code[:1], parts[i + 1], None))
            i += 2
        else:
            i += 1
    return out


def git_deltas(spark: SparkSession, roots: list[str], base: str | None = None, target: str = "HEAD", most: int = 100) -> tuple[DataFrame, bool]:
    """Deltas of the repositories that hold the roots, and whether there were more than `most`."""
    if not 1 <= most <= 1000:
        raise ValueError("most must be from 1 to 1000")
    rows, tops = [], []
    for r in roots:
        got = subprocess.run(["git", "-C", r, "rev-parse", "--show-toplevel"], capture_output=True, text=True)
        if not got.returncode and got.stdout.strip() not in tops:
            tops.append(got.stdout.strip())
    for top in tops:
        args = ["diff", "--name-status", "-z", f"{base}...{target}"] if base else ["status", "--porcelain=v1", "-z"]
        text = subprocess.run(["git", "-C", top, *args], capture_output=True, text=True, check=True).stdout
        rows += [(top, *x) for x in (parse_name_status if base else parse_porcelain)(text)]
    numbered = [(i, *x) for i, x in enumerate(rows[:most])]
    df = spark.createDataFrame(numbered, "ord bigint, repository string, code string, path string, old_path string")
    return df.withColumn("status", rules.git_status(F.col("code"))), len(rows) > most



def package_projects(files: DataFrame) -> DataFrame:
    """(relative_path, name, language, project_kind, package_manager) of package.json files.

    Language and manager follow from the files beside it: a tsconfig, a lock file.
    """
    folder = F.regexp_replace("relative_path", "/?[^/]*$", "")
    name = F.lower(rules.file_name(F.col("relative_path")))
    beside = files.withColumns({"folder": folder, "n": name}).groupBy("folder").agg(F.max(F.col("n").rlike("^tsconfig.*\\.json$")).alias("ts"), F.max(F.col("n") == "pnpm-lock.yaml").alias("pnpm"), F.max(F.col("n") == "yarn.lock").alias("yarn"))
    x = files.where(name == "package.json").select("relative_path", folder.alias("folder"), F.decode("content", "UTF-8").alias("j"))
    groups = [F.coalesce(F.json_object_keys(F.get_json_object("j", f"$.{g}")), F.array().cast("array<string>")) for g in ("dependencies", "devDependencies", "peerDependencies")]
    x = x.withColumn("d", F.transform(F.concat(*groups), lambda v: F.lower(v))).join(beside, "folder")
    frontend = F.arrays_overlap("d", F.array(*[F.lit(v) for v in ("react", "react-dom", "vite", "next")]))
    own = F.nullif(F.trim(F.get_json_object("j", "$.name")), F.lit(""))
    return x.select(
        "relative_path",
        F.coalesce(own, F.regexp_extract("folder", "([^/]*)$", 1)).alias("name"),
        F.when(F.array_contains("d", "typescript") | F.col("ts"), "typescript").otherwise("javascript").alias("language"),
        F.when(frontend, "frontend").otherwise("library").alias("project_kind"),
        F.when(F.col("pnpm"), "pnpm").when(F.col("yarn"), "yarn").otherwise("npm").alias("package_manager"),
    )
